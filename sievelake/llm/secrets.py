"""Secret scan in built-in expressions: key patterns and sliding-window entropy.

A pattern's matches come from regexp_extract_all and their places from the gaps
that split() leaves between them; both see the same leftmost, non-overlapping
matches, and the expensive expressions run only on texts that match at all. Places
are prefix sums, and overlaps prefix maxima, of blocks of sqrt(n) elements, so a text
may hold any number of matches.

Entropy: candidate strings are long runs of key characters. The first class of
CLASSES that a candidate belongs to gives its threshold; one of no class (a run with
separators but no digit) is no candidate. Over each, a window of W characters slides;
entering and leaving characters change an array of counts and the sum of c * log2(c)
by two terms, so a step costs the same whatever the window. A window is hot if its
entropy reaches the threshold. The span runs from the first hot window to the end of
the last. Candidates on the allow list (UUIDs, named checksums, runs of words), spans
that hold a placeholder, and spans that touch a pattern's span are suppressed.

No Python runs on rows and nothing is shuffled. Edge cases: a null text is empty
and has no spans; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.arrays import let, most_before, sums_before

#: Kinds in their order, each with its pattern, the group whose length counts, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
W = 20
#: Character classes and the least entropy in bits of a window; log2(20) = 4.32 is the most there can be.
CLASSES = (
    ("digits", r"^[0-9]+$", 2.9),
    ("hexadecimal", r"^[0-9a-fA-F]*[0-9][0-9a-fA-F]*$", 2.9),
    ("letters", r"^[a-zA-Z]*([a-z][A-Z]|[A-Z][a-z])[a-zA-Z]*$", 3.95),
    ("one_case", r"^([a-z0-9]+|[A-Z0-9]+)$", 3.5),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
    ("base64", r"[0-9]", 3.7),
)
#: Candidates that are no secrets: UUIDs, checksums, runs of words joined by dashes, slashes or underscores with numbers, capitalised words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^(sha1|sha256|sha384|sha512|md5)[-=]",
    r"^[/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_=-]*$",
    r"^([a-z]{2,})?([A-Z][a-z]{2,})*$",
)
#: Spans that hold one of these are placeholders.
PLACEHOLDER = r"(?i)example|changeme|placeholder|your_|xxxx|dummy"
SPAN = "array<struct<start: int, kind: int, end: int>>"


def places(text: Column, pattern: str, found: Column) -> Column:
    """The starts of the pattern's matches `found`."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def starts(gap_and_size: Column) -> Column:
        before = sums_before(F.transform(gap_and_size, lambda x: x["gap"] + x["size"]))
        return F.zip_with(before, gap_and_size, lambda at, x: at + x["gap"])

    return let(F.filter(F.zip_with(gaps, F.transform(found, lambda x: F.length(x)), lambda g, n: F.struct(g.alias("gap"), n.alias("size"))), lambda x: x["size"].isNotNull()), starts)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches whose group has at least `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(places(text, pattern, found).alias("start"), found.alias("word"), tested.alias("tested"))
    spans = F.transform(F.filter(rows, lambda x: F.length(x["tested"]) >= least), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["word"])).alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def hot_range(codes: Column, bits: Column, window: int = W) -> Column:
    """struct(first, last): the start of the first window of entropy `bits` or more and the end of the last; first is -1 if none is."""
    logs = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])
    f = lambda c: F.element_at(logs, c + 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a, code):
        old = F.when(a["i"] >= window, F.get(codes, a["i"] - window)).otherwise(F.lit(-1))
        came, went = F.get(a["n"], code), F.get(a["n"], old)
        same = old == code
        s = F.when(same, a["s"]).otherwise(a["s"] + f(came + 1) - f(came) + F.when(old >= 0, f(went - 1) - f(went)).otherwise(0.0))
        n = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda v, j: v + F.when(j == code, 1).when(j == old, -1).otherwise(0)))
        return F.struct(n.alias("n"), s.alias("s"), a["i"].alias("i"), a["first"].alias("first"), a["last"].alias("last"))

    def judge(a):
        hot = (a["i"] >= window - 1) & (log2(window) - a["s"] / window >= bits)
        first = F.when(hot & (a["first"] < 0), a["i"] - (window - 1)).otherwise(a["first"])
        return F.struct(a["n"].alias("n"), a["s"].alias("s"), (a["i"] + 1).alias("i"), first.alias("first"), F.when(hot, a["i"] + 1).otherwise(a["last"]).alias("last"))

    # judging is a step of its own so that the new sum is computed once
    twice = F.flatten(F.transform(codes, lambda c: F.array(c, F.lit(-2))))
    return F.aggregate(twice, zero, lambda a, c: F.when(c == -2, judge(a)).otherwise(step(a, c)), lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def threshold(word: Column) -> Column:
    """The least entropy of a candidate of this class; null if it is of none or allowed."""
    allowed, bits = F.lit(False), F.lit(None).cast("double")
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(word.rlike(pattern), least).otherwise(bits)
    return F.when(~allowed, bits)


def entropy_spans(text: Column, kind: int) -> Column:
    """Spans of high entropy in the candidate strings."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    rows = F.transform(F.arrays_zip(places(text, CANDIDATE, found).alias("start"), found.alias("word")), lambda x: F.struct(x["start"].alias("start"), x["word"].alias("word"), threshold(x["word"]).alias("bits")))

    def measure(x):
        codes = F.transform(F.split(x["word"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return F.struct(x["start"].alias("start"), x["word"].alias("word"), hot_range(F.filter(codes, lambda c: c >= 0), x["bits"]).alias("hot"))

    hot = F.transform(F.filter(rows, lambda x: x["bits"].isNotNull()), measure)
    hot = F.filter(hot, lambda x: (x["hot"]["first"] >= 0) & ~F.substring(x["word"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"]).rlike(PLACEHOLDER))
    spans = F.transform(hot, lambda x: F.struct((x["start"] + x["hot"]["first"]).alias("start"), F.lit(kind).alias("kind"), (x["start"] + x["hot"]["last"]).alias("end")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def apart(extra: Column, base: Column) -> Column:
    """The spans of extra (in order, none meeting another) that meet none of base: by the running maximum of base's ends over both, sorted."""
    marks = F.concat(
        F.transform(base, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("kind"), x["end"].alias("end"))),
        F.transform(extra, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("end"))),
    )

    def ends(m: Column) -> Column:
        before = most_before(F.transform(m, lambda x: x["end"]))
        both = F.zip_with(m, before, lambda x, e: F.struct(x["kind"].alias("kind"), e.alias("reach")))
        return F.filter(both, lambda x: x["kind"] == 0)

    kept = F.zip_with(extra, let(F.array_sort(marks), ends), lambda x, e: F.when(e["reach"] <= x["start"], x))
    return F.when((F.size(base) > 0) & (F.size(extra) > 0), F.filter(kept, lambda x: x.isNotNull())).otherwise(extra)


NAMES = [k for k, *_ in KINDS] + ["entropy"]


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (pattern spans) and extra (entropy spans), each an array of (start, kind, end) in code points."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__sl_t"))
    text = F.col("__sl_t")
    rows = rows.select("doc_id", F.concat(*[matches(text, p, k, g, n) for k, (_, p, g, n) in enumerate(KINDS)]).alias("base"), entropy_spans(text, len(KINDS)).alias("extra"))
    return rows.select("doc_id", "base", apart(F.col("extra"), F.col("base")).alias("extra"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return scan(docs, id_col, text_col).select(
        "doc_id", *[of(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans")
    )
