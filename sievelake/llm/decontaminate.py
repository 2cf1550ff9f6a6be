"""Benchmark decontamination by winnowing.

Both sides hash every k-gram of words and keep, of each window of w = W - k + 1
consecutive k-grams, those with the least hash. Any shared span of W words has a
whole window of k-grams in common, so at least one kept fingerprint meets. A
fingerprint carries the hashes of the words around it, so a meeting is extended
word by word into the hit span without reading a text again. Items of fewer than
W words are kept as one fingerprint of their whole length, which is looked up
among all grams of that length.

The documents are scanned once. A bit table of the benchmark's fingerprints, of
a fixed size, goes along and drops nearly all fingerprints that meet nothing (a
full table only lets more of them through); the rest is joined by hash, so
neither side has to fit in one place, and frequent passages are pre-filtered and
split by the adaptive skew join. Equal fingerprints of several items, with equal
words around, are one row with a list of ids, so a passage that many items share
meets a document once.

Edge cases: a null or blank text has no words; a null or blank item has no
window; repeated items count once by item_id, items without an id mark words but
are not listed; repeated rows keep a row each, and rows of one id with other texts
are told apart by a hash of the text; empty tables give no hits; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import LOWER, as_bytes, cut, row_hash, slices, small
from sievelake.llm.textvec import grams, words

W, K = 10, 5
#: log2 of the bits in the table of benchmark fingerprints (4 MB).
TABLE_BITS = 25
#: ASCII letters (lower) and digits and every byte outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True

MARK = "h bigint, pos int, size int, left array<bigint>, right array<bigint>"


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The positions whose value is the least of a window of w; g shorter than w has none."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1) if n < 64 else _sliding_min(g, w)
    chosen = np.zeros(len(g), bool)
    for s in range(w):
        chosen[s : s + n] |= g[s : s + n] == least
    return np.flatnonzero(chosen)


def _sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    n = len(g) - w + 1
    out = g[:n].copy()
    for s in range(1, w):
        np.minimum(out, g[s : s + n], out=out)
    return out


def texts_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts in turn, and the bounds of each text's words (one more than texts)."""
    joined = b"\n".join(texts).translate(LOWER)
    starts, _, hashes = words(joined, INSIDE)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))


def marks_of(hashes: np.ndarray, bounds: np.ndarray, lengths: Iterable[int], want=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, text, position in text, hash) of the winnowed k-grams (size K) and of all grams of the given lengths."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    g = grams(hashes, K)
    if len(g):
        inside = owner[: len(g)] == owner[K - 1 :]
        least = np.where(inside, g, np.uint64(2**64 - 1))
        at = winnow(least, W - K + 1)
        at = at[inside[at]]
        if want is not None:
            at = at[want(g[at])]
        yield 0, owner[at], at - bounds[owner[at]], g[at]
    for n in lengths:
        g = grams(hashes, n)
        if len(g):
            at = np.flatnonzero(owner[: len(g)] == owner[n - 1 :]) if want is None else np.flatnonzero(want(_tagged(g, n)) & (owner[: len(g)] == owner[n - 1 :]))
            yield n, owner[at], at - bounds[owner[at]], _tagged(g[at], n)


def _tagged(g: np.ndarray, n: int) -> np.ndarray:
    return g ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)


def _around(hashes: np.ndarray, lo: int, hi: int, at: int, size: int) -> dict:
    """The words before a mark (nearest first) and after it, as far as a span of W words round it can reach."""
    signed = hashes.view(np.int64)
    if size:
        return {"left": [], "right": signed[at : at + size].tolist()}
    return {"left": signed[max(lo, at - (W - K)) : at][::-1].tolist(), "right": signed[at : min(hi, at + W)].tolist()}


def item_marks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and a mark for each fingerprint of the items."""

    def run(batches):
        for b in slices(batches, 1):
            hashes, bounds = texts_words(as_bytes(b.column(1)))
            ids, rows = b.column(0).to_pylist(), []
            for t in range(b.num_rows):
                lo, hi = int(bounds[t]), int(bounds[t + 1])
                n = hi - lo
                own = hashes[lo:hi]
                if n >= W:
                    g = grams(own, K)
                    rows += [{"item_id": ids[t], "h": int(g[p].view(np.int64)), "pos": int(p), "size": 0} | _around(hashes, lo, hi, lo + int(p), 0) for p in winnow(g, W - K + 1)]
                elif n:
                    rows.append({"item_id": ids[t], "h": int(_tagged(grams(own, n), n)[0].view(np.int64)), "pos": 0, "size": n} | _around(hashes, lo, hi, lo, n))
            yield pa.RecordBatch.from_pylist(rows, schema)

    picked = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("item_id", pa.string()), ("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
    return picked.mapInArrow(run, f"item_id string, {MARK}")


def bit_table(hashes: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """A set of the hashes (column h) as a bit array of a fixed size, made in 4096 blocks."""
    block = bits - 12

    def run(key, pdf):
        import pandas as pd

        one = np.zeros(1 << block, np.uint8)
        one[pdf["low"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(one, bitorder="little").tobytes()]})

    top = F.shiftrightunsigned(F.col("h"), 64 - bits)
    pairs = hashes.select(F.shiftrightunsigned(top, block).cast("int").alias("block"), top.bitwiseAND((1 << block) - 1).cast("int").alias("low")).distinct()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in pairs.groupBy("block").applyInPandas(run, "block int, bits binary").toLocalIterator():  # 4096 rows of a fixed size
        out[r["block"] << (block - 3) : (r["block"] + 1) << (block - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def scan(docs: DataFrame, table: np.ndarray, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_hash (of the text), n_words and the marks that may meet the benchmark, a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    mark = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    def run(batches):
        bits = sent.value

        def want(g):
            top = (g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            return (bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1 == 1

        for b in slices(batches, 1):
            hashes, bounds = texts_words(as_bytes(b.column(1)))
            found = [[] for _ in range(b.num_rows)]
            for size, text, pos, g in marks_of(hashes, bounds, lengths, want):
                for t, p, h in zip(text.tolist(), pos.tolist(), g.view(np.int64).tolist()):
                    found[t].append({"h": h, "pos": p, "size": size} | _around(hashes, int(bounds[t]), int(bounds[t + 1]), int(bounds[t]) + p, size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(bounds)), pa.array(found, pa.list_(mark))], ["doc_id", "row_hash", "n_words", "marks"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_hash(text_col).alias("row_hash"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, row_hash bigint, n_words bigint, marks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MARK.split(', '))}>>")


def _common(a: str, b: str):
    """How many leading elements of two arrays agree."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, n_words, n_hit, spans (hit word ranges, end exclusive), items (ids as strings, sorted), a row for each document."""
    items = cut(item_marks(benchmark, item_col, item_text_col))
    lengths = [r["size"] for r in items.where("size > 0").select("size").distinct().collect()]  # W - 1 at most
    seen = cut(scan(docs, bit_table(items.select("h")), sorted(lengths), id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    mine = seen.where(F.size("marks") > 0).select("rid", F.explode("marks").alias("m")).select("rid", "m.*")
    other = items.groupBy(F.col("h").alias("h2"), F.col("size").alias("size2"), F.col("left").alias("left2"), F.col("right").alias("right2")).agg(F.collect_set("item_id").alias("ids"))
    met = mine.join(other, (F.col("h") == F.col("h2")) & (F.col("size") == F.col("size2")))
    met = met.select("rid", "ids", "pos", "size", _common("left", "left2").alias("a"), _common("right", "right2").alias("b"))
    met = met.where(F.when(F.col("size") > 0, F.col("b") == F.col("size")).otherwise((F.col("b") >= K) & (F.col("a") + F.col("b") >= W)))
    met = met.select("rid", "ids", F.struct((F.col("pos") - F.col("a")).alias("lo"), (F.col("pos") + F.col("b")).alias("hi")).alias("span"))
    hits = met.groupBy("rid").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))  # of one document
    rows = seen.select("rid", "doc_id", "row_hash", "n_words").join(hits, "rid", "left")
    spans = F.sort_array(F.coalesce("spans", F.expr("cast(array() as array<struct<lo: int, hi: int>>)")))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end")), lambda s: s["n"])
    rows = rows.select("doc_id", "row_hash", "n_words", spans.alias("spans"), F.array_sort(F.coalesce("items", F.expr("cast(array() as array<string>)"))).alias("items"))
    return rows.select("doc_id", "row_hash", "n_words", covered.alias("n_hit"), "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    return contamination(docs, benchmark, **columns).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark."""
    bad = cut(contamination(docs, benchmark, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias("__sl_id"), F.col("row_hash").alias("__sl_hash")).distinct())
    return docs.join(small(bad), F.col(id_col).eqNullSafe(F.col("__sl_id")) & (row_hash(text_col) == F.col("__sl_hash")), "left_anti")
