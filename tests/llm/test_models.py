"""What the learned operators fit and how they score, against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import helpers as H

pytest.importorskip("sievelake.llm")
from pyspark.sql import functions as F  # noqa: E402

from sievelake.llm import common, entries, langid, toxicity  # noqa: E402


def test_samples_are_full_at_any_size(spark):
    for n in (300, 1000, 10**9, 10**11, 10**13):
        below = spark.range(1).select(common.draw_below(F.lit(n), 400).alias("x")).first().x
        assert (below + 2**63) / 2**64 * n == pytest.approx(min(n, 480), rel=1e-3)


def grams_of(t: str) -> set[int]:
    row = np.zeros(langid.V, np.uint8)
    langid.presence(t, row)
    return set(np.flatnonzero(row).tolist())


def test_folded_matrix_is_kernel_ridge_regression():
    r = random.Random(2)
    texts = [" ".join("".join(r.choice(["ba", "ti", "ko", "un"][k % 3 :]) for _ in range(3)) for _ in range(5)) for k in range(45)]
    langs = ["abc"[k % 3] for k in range(45)]
    names, matrix = langid.fit(texts, langs, landmarks=45)
    sets = [grams_of(t) for t in texts]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    dual = np.linalg.solve(kernel + langid.RIDGE * 45 * np.eye(45), np.array([[1.0 if x == n else -1.0 for n in names] for x in langs]))
    for t in ("batiko unko", "titi ba", "kokoun un", texts[0]):
        g = grams_of(t)
        want = np.array([len(g & y) / (len(g) * len(y)) ** 0.5 for y in sets]) @ dual
        got = matrix[sorted(g)].sum(0) / len(g) ** 0.5
        assert got == pytest.approx(want, abs=2e-3)
        assert langid.score([t], names, matrix)[0] == [names[want.argmax()]]


def test_grams_by_definition():
    """Texts share as many hashed grams as they share grams, but for rare collisions."""
    def plain(t):
        t = " " + re.sub(r"[\W\d_]+", " ", t.lower()) + " "  # a blank at an end stays one
        return {t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1)}

    for t in ("Der Fluß, 12 und die Brücke!", "a", "ещё одна  строка", "x y z " * 50):
        assert len(grams_of(t)) == pytest.approx(len(plain(t)), abs=1)
    assert len(grams_of("ab cde") & grams_of("xb cdf")) == pytest.approx(len(plain("ab cde") & plain("xb cdf")), abs=1)


def test_every_language_is_learned(spark, tmp_path):
    r = random.Random(9)
    sounds = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for k in range(100)}
    rows = [(k, " ".join(r.choice(sounds[f"l{k % 100:02}"]) + r.choice(sounds[f"l{k % 100:02}"]) for _ in range(30))) for k in range(1200)]
    folder = H.write_tables(tmp_path, rows=rows)
    t = pq.read_table(f"{folder}/documents.parquet")
    pq.write_table(t.set_column(t.column_names.index("lang"), "lang", pa.array([f"l{k % 100:02}" for k in range(1200)])), f"{folder}/documents.parquet")
    got = {x.doc_id: x.lang_pred for x in entries.QUERIES["op6_language_id"](spark, folder).collect()}
    held = [k for k in range(1200) if H.out_of_fit(k)]
    assert set(got.values()) == set(sounds) and sum(got[k] == f"l{k % 100:02}" for k in held) >= 0.97 * len(held)


def test_long_texts_and_one_id_are_learned_from(spark):
    """A language with nothing but one long text, and one whose rows share an id, are classes too."""
    rows = [(k, "tik tak tok " * 5, "aa") for k in range(40)] + [(1, "ombu olu ombo " * 20_000, "bb")] + [(3, f"zzyx zyxx {k}", "cc") for k in range(50)]
    docs = spark.createDataFrame([x for x in rows if not H.out_of_fit(x[0])], "doc_id bigint, text string, lang string")
    names, matrix = langid.learn(docs)
    assert names == ["aa", "bb", "cc"] and langid.score(["olu ombu", "tak tik", "zyxx"], names, matrix)[0] == ["bb", "aa", "cc"]


def plain_features(scorer, raw):
    """Over every clause of the text, by the single transducers in turn."""
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.scoring()]
    sums, clauses, top = dict.fromkeys(scorer.NAMES, 0.0), 0, 0.0
    for clause in re.split(r"[.!?;:\n]", raw.lower()):
        tokens = toxicity.WORDS.findall(clause)
        classes = [scorer.classify(w) for w in tokens]
        out, weights = [c for c, _ in classes], [1.0] * len(tokens)
        for t in parts:
            step = t.run(out)
            out, weights = [x for x, _ in step], [a * w for a, (_, w) in zip(weights, step)]
        total = 0.0
        for (_, strength), x, w in zip(classes, out, weights):
            if w and x in sums:
                sums[x] += w * strength
                total += w * strength * (0.5 if x == toxicity.WEAK else 1.0)
        clauses += total > 0
        top = max(top, total)
    return [*(np.log1p(sums[k]) for k in scorer.NAMES), np.log1p(clauses), np.log1p(top)]


VOCABULARY = ["idiot", "idiots", "Scum", "kill", "killing", "hurt", "you", "them", "not", "never", "said", "will", "such", "so", "stone", "river", ".", "!", "\n", ",", "'", "_", "ünü", "snarl", "x_idiot"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=40), st.sampled_from([" ", ""]))
def test_matched_clauses_are_all_that_count(words, gap):
    scorer = toxicity.Scorer({"snar": 2.0, "ün": 1.5})
    text = gap.join(words)
    x = scorer.features(text)
    assert [*x[:4], x[6], x[7]] == pytest.approx(plain_features(scorer, text))


def test_clauses_run_to_their_true_ends():
    s = toxicity.Scorer({})
    far = "she said " + "word " * 3000 + "idiot"
    got = dict(zip(s.NAMES, s.features(far)))
    assert got["w"] > 0 and got["I"] == got["D"] == 0
    assert s.features("word " * 300 + "idiots" + " word" * 300)[1] == 0


def test_negation_and_reporting_lower_the_score():
    r = random.Random(6)
    plain = ["the river and the stone of the garden", "a letter from the window", "paper in the morning"]
    texts, labels = [], []
    for k in range(600):
        base = [r.choice(plain) for _ in range(4)]
        kind = k % 6
        if kind == 0:
            base.insert(r.randrange(4), r.choice(["you are an idiot", "what such a moron", "I will kill you"]))
        elif kind == 1:
            base.insert(r.randrange(4), r.choice(["he is not an idiot", "she said the man was a moron", "they never will hurt you"]))
        texts.append(". ".join(base) + f" {k}.")
        labels.append(int(kind == 0))
    model = toxicity.fit(texts, labels)
    scorer = toxicity.Scorer(model.stems)
    p = lambda t: toxicity.probability(model, scorer, f"a letter from the window. {t}. paper in the morning.")
    assert p("you are an idiot") > 0.5 > p("he is not an idiot")
    assert p("I will kill you") > 0.5 > max(p("she said I will kill you"), p("I will not kill you"))
    assert p("such a moron") > 0.5 > p("she said the man was a moron")


def test_composed_machine_does_what_its_parts_do():
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.scoring()]
    whole, r = toxicity.machine(), random.Random(1)
    for _ in range(500):
        symbols = [r.choice(toxicity.TOKENS) for _ in range(14)]
        out, weights = symbols, [1.0] * 14
        for t in parts:
            step = t.run(out)
            out, weights = [x for x, _ in step], [a * w for a, (_, w) in zip(weights, step)]
        got = whole.run(symbols)
        assert [x for x, _ in got] == out and [w for _, w in got] == pytest.approx(weights)


def test_sample_of_labels_is_balanced_and_weighted(spark):
    rows = [(k, ("you are an idiot " if k % 50 == 0 else "the river ") + f"of stone {k}.") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 50 == 0)) for k in range(4000)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, n=200)
    scorer = toxicity.Scorer(model.stems)
    assert toxicity.probability(model, scorer, "you are an idiot") > 0.5 > 0.1 > toxicity.probability(model, scorer, "the river of stone 5.")
