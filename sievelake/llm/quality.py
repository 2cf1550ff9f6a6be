"""Quality rules: one threshold table compiled into Spark projections.

No user function runs: tokenising, ratios and the repeated-window count are
built-in expressions over the row, so the operator is one narrow scan of any
size, without a shuffle.

The stop-word and word-length rules hold for writing with letters and spaces, so
they are asked only of texts with less than one and a half bytes a character, as
Latin script has; texts in other scripts are judged by the other rules alone. A Latin-script language whose
function words STOP_WORDS doesn't have loses its texts of 40 words or more to the
stop-word rule: give the table further words, or `rules` without it, for such corpora.

Edge cases: a null text has no words (all counts 0, base_failed true); an empty
text likewise. Repeated rows are scored row by row. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import words_of

#: Frequent function words by language; a text that has none of them is a list, a table or noise.
STOP_WORDS_BY_LANGUAGE = {
    "en": "the of and to in a is that for on with as was are by be this at or from it an have not",
    "fr": "de la le les et des en un une du que qui dans pour par sur au aux il elle est pas avec ce",
    "de": "der die das und von zu den mit ist im dem ein eine nicht für auf sich als auch es werden",
    "es": "el los las y del que se por una con para no su al lo como más",
    "it": "di che non per sono della", "pt": "os não uma com foi mais", "nl": "het een van dat niet zijn", "sv": "och att det som är på", "da no": "og er ikke til af av",
    "fi": "ja on ei että oli mutta", "pl": "na nie się że jest do", "cs sk": "je že jsem tak ako", "hu": "és hogy nem egy az volt", "ro": "și în nu cu care este", "tr": "ve bir bu için ile da",
    "id ms": "yang dan ini itu dengan untuk", "vi": "và của là có không được", "sw": "ya wa kwa ni katika", "hr sl": "da su koji kako ki", "lt lv": "ir kad yra un ar",
}
STOP_WORDS = tuple(dict.fromkeys(w for words in STOP_WORDS_BY_LANGUAGE.values() for w in words.split()))

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose metric lies outside [low, high]; only texts of at least `words` words, and for which `asked` holds, are asked."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0
    asked: str | None = None


#: The thresholds. Metrics are SQL over the counted columns, so this table can be kept in a configuration.
LATIN = "2 * text_bytes < 3 * text_chars"
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0, 0, LATIN),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None, 40, LATIN),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.6),
    Rule("stuttering", "n_adjacent / n_words", None, 0.3),
    Rule("upper_case_words", "n_upper_words / n_words", None, 0.6, 20),
)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep` and the counted columns that the rules are stated over."""
    text = F.col("__sl_text")
    step = docs.select(*[F.col(c) for c in dict.fromkeys((id_col, *keep))], F.coalesce(F.col(text_col), F.lit("")).alias("__sl_text"))
    names = step.columns[:-1]
    step = step.select(*names, words_of(text).alias("__sl_w"), F.split(text, "\n").alias("__sl_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.octet_length(text).cast("long").alias("text_bytes"), F.length(text).cast("long").alias("text_chars"))
    w, lines = F.col("__sl_w"), F.col("__sl_l")
    n = F.size(w)
    window = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *names,
        "n_symbols",
        "text_bytes",
        "text_chars",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))).cast("long").alias("n_upper_words"),
        F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long").alias("n_adjacent"),
        F.filter(lines, lambda x: x.rlike(WORD_IN)).alias("__sl_f"),
        window.alias("__sl_h"),
    )
    step = step.withColumns({
        "n_lines": F.size("__sl_f").cast("long"),
        "n_dup_lines": (F.size("__sl_f") - F.size(F.array_distinct("__sl_f"))).cast("long"),
        "__sl_s": F.when(
            F.size(F.array_distinct("__sl_h")) < F.size("__sl_h"),
            F.sort_array(F.transform("__sl_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    })
    s = F.col("__sl_s")
    repeated = F.sort_array(F.transform(F.filter(s, lambda x, k: _same(s, x, k)), lambda x: x["i"]))
    step = step.drop("__sl_f", "__sl_h").withColumn("__sl_r", repeated)
    r = F.col("__sl_r")
    covered = F.aggregate(
        F.transform(r, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(r, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return step.select(*names, *COUNTED)


WORD_IN = r"[^\x20\x09-\x0D]"
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words", "n_adjacent", "n_lines", "text_bytes", "text_chars")


def _same(s: Column, x: Column, k: Column) -> Column:
    before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column per rule, true where the document passes it."""
    out = {}
    for rule in rules:
        m = F.expr(f"try_divide({rule.metric.split('/')[0]}, {rule.metric.split('/')[1]})" if rule.metric.count("/") == 1 else rule.metric)
        ok = F.lit(True)
        if rule.low is not None:
            ok &= F.coalesce(m >= F.lit(rule.low), F.lit(True))
        if rule.high is not None:
            ok &= F.coalesce(m <= F.lit(rule.high), F.lit(True))
        out[rule.name] = ok | (F.col("n_words") < rule.words) | (F.lit(False) if rule.asked is None else ~F.expr(rule.asked))
    return out


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base_failed, the names of the failed rules and the verdict `kept`, a row for each document."""
    verdicts = compiled(rules)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in verdicts.items()]), lambda x: x.isNotNull())
    out = counts(docs, id_col, text_col, keep).withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns (in a struct meanwhile, so that no name clashes); one narrow scan.

    Testing a row number too keeps the filter above the projections: pushed below them, it would hold every counted column's
    expression once for each rule.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__sl_doc"), F.col(text_col).alias("__sl_in"))
    return score(packed, rules, "__sl_doc", "__sl_in").withColumn("__sl_row", F.monotonically_increasing_id()).where("kept and __sl_row >= 0").select("__sl_doc.*")
