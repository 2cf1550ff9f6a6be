"""Toxicity by a grammar of weighted finite-state transducers.

Sequential transducers over token classes are composed once. The insult transducer
turns lexicon words into insults, stronger after an intensifier; the threat transducer
turns a verb of violence into a threat that is open until its victim follows, stronger
after a word of intent; negation weakens insults and threats within its reach, reported
speech weakens those up to the clause's end, and a target makes an insult directed, as
it makes a threat count. The composed machine runs over the clauses that hold a lexicon
match, each to its true ends, not over whole texts; its output is a few weights a
clause, summed over the document. A logistic regression over these sums (and their
density) gives the score, so how much a negated or a directed insult counts is learned,
not set.

The lexicon has fixed seed words and word beginnings learned from the labels:
those much more frequent in toxic documents than in others, weighted by their
log-odds. The fit uses a bounded sample of FIT_DOCS labelled documents of up to FIT_CHARS
characters, half of them toxic where there are so many, those with the least hashes of
doc_id (a threshold on the whole 64-bit hash, from counts over all labels, so the sample is as
full for 10^11 labels as for a thousand); weights undo the halving. Every text is scored whole.

Edge cases: a null or empty text has no clause and scores the base rate of texts
without a match; of several labels of one id the largest counts; without both
labels in the sample only the seed words count; repeated rows are scored each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import cut, draw_below, slices
from sievelake.llm.langid import held_out

FIT_DOCS, FIT_CHARS = 6000, 20_000
THRESHOLD = 0.3
#: Learned beginnings: length, least toxic documents, least odds ratio.
STEM, STEM_DOCS, STEM_ODDS = range(3, 10), 5, 4.0

#: Seed words of each class, in English, German, French and Spanish.
INSULTS = "idiot moron scum trash clown stupid pathetic worthless loser disgusting dumb fool imbecile idioten dummkopf abschaum idiote crétin ordure imbécil estúpido basura".split()
THREATS = "kill hurt destroy beat shoot stab burn töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he him she her they them u du dich dir ihr euch sie tu toi te vous ils elles tú ti usted vosotros ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nobody nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says saying called calls wrote writes claimed claims reported quoted sagte sagt nannte schrieb behauptete dit disait écrit appelé dijo dice escribió llamó".split()
INTENTS = "will shall gonna going must werde wirst wird vais vas va voy vamos".split()
INTENSIFIERS = "such so very total complete utter absolute damn fucking völlig echt tellement vraiment tan muy".split()

WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Marks that end a clause.
MARKS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{MARKS}]")


@dataclass
class Transducer:
    """A sequential transducer: arcs[state][symbol] = (next state, output symbol, weight); unknown symbols pass unchanged and lead to `other[state]`."""

    start: int = 0
    arcs: dict[int, dict[str, tuple[int, str, float]]] = field(default_factory=lambda: defaultdict(dict))
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs[state].get(symbol) or (self.other.get(state, state), symbol, 1.0)

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append((y, w))
        return out


#: Token classes: lexicon word, verb of violence, word of intent, intensifier, target, negation, report, anything else.
L, V, M, X, Y, N, R, O = "LVMXYNRO"
#: Made of them: insult, open threat; directed and weakened insults, threats with their victim.
I, T, DIRECTED, WEAK, THREAT = "ITDwH"
TOKENS = (L, V, M, X, Y, N, R, O)
ALPHABET = (I, T, Y, N, R, O, DIRECTED, WEAK, THREAT)


def insult(reach: int = 2) -> Transducer:
    """A lexicon word is an insult, a stronger one within `reach` tokens after an intensifier. State k: k more tokens."""
    t = Transducer()
    for k in range(reach + 1):
        t.arcs[k][X] = (reach, O, 1.0)
        t.arcs[k][L] = (max(0, k - 1), I, 1.25 if k else 1.0)
        t.other[k] = max(0, k - 1)
    return t


def threat(reach: int = 3) -> Transducer:
    """A verb of violence opens a threat; a target within `reach` tokens is its victim and completes it, with more weight if a word of intent led to the verb.

    States 0; 1..reach after a word of intent; then as many after a verb, and as many after an intended one.
    """
    t = Transducer()
    for k in range(3 * reach + 1):
        kind, left = divmod(k - 1, reach) if k else (0, -1)
        t.other[k] = k - 1 if left > 0 else 0
        t.arcs[k][M] = (reach, O, 1.0) if kind == 0 else (t.other[k], O, 1.0)
        meant = k and kind in (0, 2)
        t.arcs[k][V] = (3 * reach if meant else 2 * reach, T, 1.0)
        if kind:
            t.arcs[k][Y] = (0, THREAT, 1.5 if kind == 2 else 1.0)
    return t


def negation(reach: int = 3) -> Transducer:
    """After N, insults and threats within `reach` tokens are weakened. State k: k more tokens."""
    t = Transducer()
    for k in range(reach + 1):
        t.arcs[k][N] = (reach, N, 1.0)
        t.other[k] = max(0, k - 1)
        if k:
            t.arcs[k][I] = (k - 1, WEAK, 1.0)
            t.arcs[k][T] = (k - 1, WEAK, 1.0)
            t.arcs[k][THREAT] = (k - 1, WEAK, 1.0)
    return t


def reported() -> Transducer:
    """After R, insults and threats are weakened to the clause's end."""
    t = Transducer(other={0: 0, 1: 1})
    t.arcs[0][R] = (1, R, 1.0)
    t.arcs[1][I] = (1, WEAK, 1.0)
    t.arcs[1][T] = (1, WEAK, 1.0)
    t.arcs[1][THREAT] = (1, WEAK, 1.0)
    return t


def target(reach: int = 4) -> Transducer:
    """An insult within `reach` tokens after a target (or the victim of a threat) is directed, and a threat counts as one."""
    t = Transducer()
    for k in range(reach + 1):
        t.arcs[k][Y] = (reach, Y, 1.0)
        t.arcs[k][THREAT] = (reach, THREAT, 1.0)
        t.other[k] = max(0, k - 1)
        if k:
            t.arcs[k][I] = (k - 1, DIRECTED, 1.0)
            t.arcs[k][T] = (k - 1, THREAT, 1.0)
    return t


def scoring() -> Transducer:
    """Weights of what is left; a second insult in a clause counts a little more."""
    t = Transducer(other={0: 0, 1: 1})
    for s in (0, 1):
        for x, w in ((I, 1.0 + 0.2 * s), (DIRECTED, 1.0 + 0.2 * s), (WEAK, 1.0), (THREAT, 1.0)):
            t.arcs[s][x] = (1, x, w)
        for x in (O, Y, N, R, T):
            t.arcs[s][x] = (s, x, 0.0)
    return t


def compose(a: Transducer, b: Transducer, alphabet: Iterable[str] = ALPHABET) -> Transducer:
    """The transducer that feeds a's output to b; weights multiply. Only reachable states are made."""
    ids, todo, out = {(a.start, b.start): 0}, [(a.start, b.start)], Transducer()
    while todo:
        p, q = todo.pop()
        here = ids[p, q]
        for x in alphabet:
            p2, y, w = a.step(p, x)
            q2, z, v = b.step(q, y)
            if (p2, q2) not in ids:
                ids[p2, q2] = len(ids)
                todo.append((p2, q2))
            out.arcs[here][x] = (ids[p2, q2], z, w * v)
    return out


def grammar() -> Transducer:
    """What becomes of insults and threats in their clause."""
    return compose(compose(compose(negation(), reported()), target()), scoring())


def machine() -> Transducer:
    """From token classes to weights: insult and threat composed with the grammar."""
    return compose(compose(insult(), threat(), (*TOKENS, I)), grammar(), TOKENS)


@dataclass
class Model:
    """words: seed words by class; stems: learned beginnings with weights; then the regression's mean, scale and coefficients."""

    stems: dict[str, float]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coef: np.ndarray | None = None


SEED = {w: c for c, group in ((X, INTENSIFIERS), (M, INTENTS), (R, REPORTS), (N, NEGATIONS), (Y, TARGETS), (V, THREATS), (L, INSULTS)) for w in group}
SEED_WEIGHT = 4.0


def finder(stems: dict[str, float]):
    """An automaton over the beginnings of insults and threats."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in {*INSULTS, *THREATS, *stems}:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


class Scorer:
    """Features of texts under a lexicon."""

    NAMES = (I, DIRECTED, WEAK, THREAT)

    def __init__(self, stems: dict[str, float]):
        self.stems, self.machine, self.automaton = stems, machine(), finder(stems)
        self.longest = max(map(len, stems), default=0)
        self.shortest = min(map(len, stems), default=1)

    def classify(self, word: str) -> tuple[str, float]:
        c = SEED.get(word)
        if c == L:
            return c, SEED_WEIGHT
        best = max((self.stems.get(word[:k], 0.0) for k in range(self.shortest, min(self.longest, len(word)) + 1)), default=0.0)
        if best > 0:
            return L, best
        return c or O, 1.0

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of the clauses of a lower-case text that hold the beginning of a lexicon word."""
        end = 0  # of the clause before; what lies before it isn't looked at again, so the whole is linear
        for last, n in self.automaton.iter(text):
            a = last - n + 1
            if a < end or a and text[a - 1].isalnum():
                continue
            start = max(end, *(text.rfind(x, end, a) + 1 for x in MARKS))
            m = CLAUSE_END.search(text, last + 1)
            end = m.start() if m else len(text)
            yield start, end

    def features(self, raw: str) -> np.ndarray:
        text = raw.lower()
        sums, seen, hits, clauses, top = dict.fromkeys(self.NAMES, 0.0), {}, 0, 0, 0.0
        for a, b in self.clauses(text):
            tokens = WORDS.findall(text, a, b)
            classes = [self.classify(w) for w in tokens]
            total = 0.0
            for w, (_, strength), (symbol, weight) in zip(tokens, classes, self.machine.run(c for c, _ in classes)):
                if weight and symbol in sums:
                    sums[symbol] += weight * strength
                    total += weight * strength * (0.5 if symbol == WEAK else 1.0)
                    if symbol != THREAT:
                        seen[w] = strength
                    hits += 1
            clauses += total > 0
            top = max(top, total)
        words = 1 + text.count(" ") + text.count("\n")
        spread = sum(seen.values())
        return np.array([*(np.log1p(sums[k]) for k in self.NAMES), np.log1p(spread), np.log1p(len(seen)), np.log1p(clauses), np.log1p(top), np.log1p(100 * hits / words), np.log1p(100 * spread / words), np.log(words)])


def learn_stems(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Word beginnings by log-odds of toxic documents; one that adds little to a shorter one is left out."""
    df = {0: Counter(), 1: Counter()}
    for text, y in zip(texts, labels):
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        df[int(y)].update({w[:k] for w in words for k in STEM if len(w) >= k})
    n = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    rated = {}
    for s, c in df[1].items():
        if c >= STEM_DOCS and s not in SEED:
            odds = ((c + 0.5) / (n[1] + 1)) / ((df[0][s] + 0.5) / (n[0] + 1))
            if odds >= STEM_ODDS:
                rated[s] = (odds, c)
    chosen: dict[str, float] = {}
    for s in sorted(rated, key=lambda s: (-rated[s][1] * log(rated[s][0]), s)):
        odds, _ = rated[s]
        shorter = [rated[s[:k]][0] for k in STEM if k < len(s) and s[:k] in chosen]
        if not shorter or odds > 1.5 * max(shorter):
            chosen[s] = log(odds)
    return chosen


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (v * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """share: of toxic documents among all, if it isn't that of the sample. Stems are learned on one half of the sample and the regression on the other and then both the other way round, so that it sees stems as new texts meet them."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model({})
    half = np.arange(len(y)) % 2
    x = np.zeros((len(y), 11))
    for k in (0, 1):
        learned = Scorer(learn_stems([t for t, h in zip(texts, half) if h == k], y[half == k]))
        for i in np.flatnonzero(half != k):
            x[i] = learned.features(texts[i])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    share, here = y.mean() if share is None else share, y.mean()
    weight = np.where(y == 1, share / here, (1 - share) / (1 - here))
    return Model(learn_stems(texts, y), mean, scale, regress((x - mean) / scale, y, weight=weight))


def probability(model: Model, scorer: Scorer, text: str | None) -> float:
    x = scorer.features(text or "")
    if model.coef is None:
        return float(1 - np.exp(-x[:2].sum()))
    z = float(((x - model.mean) / model.scale) @ model.coef[:-1] + model.coef[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n: int = FIT_DOCS) -> Model:
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__sl_id")).agg(F.max(F.col(label_col).cast("int")).alias("__sl_y"))
    marked = cut(marked.withColumn("__sl_h", F.xxhash64("__sl_id")))
    of = {y: c for y, c in marked.groupBy(F.col("__sl_y") > 0).count().collect()}
    positive, other = of.get(True, 0), of.get(False, 0)
    half = min(positive, max(n // 2, n - other))
    drawn = None
    for side, total, wanted in ((F.col("__sl_y") > 0, positive, half), (F.col("__sl_y") <= 0, other, n - half)):
        part = marked.where(side & (F.col("__sl_h") <= draw_below(F.lit(max(1, total)), wanted))).orderBy("__sl_h").limit(wanted)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.where(F.length(text_col) <= FIT_CHARS).join(F.broadcast(drawn), F.col(id_col) == F.col("__sl_id"))  # n narrow rows at most
    sample = rows.select(F.col(text_col).alias("t"), F.col("__sl_y").alias("y"), F.col("__sl_h").alias("h")).orderBy("h", "t").limit(n).collect()
    unique = {r["t"]: int(r["y"] > 0) for r in sample}  # copies would count as evidence twice
    whole = positive + other <= n
    return fit(list(unique), list(unique.values()), None if whole else positive / (positive + other))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model.stems)
        for b in slices(batches, 2):
            p = np.array([probability(model, scorer, t) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
