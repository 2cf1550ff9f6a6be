"""Line dedup: lines found in many documents stay in one of them.

Every long enough line becomes a row of its 128-bit hash, its document and its
position, stored once, as the range partitioner reads them twice; texts are never
shuffled for the search. The rows are range-partitioned
by (hash, document) and sorted by (hash, document descending, position), so that a
task streams over runs of equal hashes and holds one counter. A run that reaches
a partition's edge may go on in the next one (a frequent line fills many
partitions): its rows are set aside with the run's count and largest document,
and are decided by a join with these summaries, two for each partition at most.

The decisions are kept as bitmaps, one for each document that loses lines: a bit
for each line, packed and deflated. Only applying them reads texts again.

Edge cases: a null or empty text is one empty line; repeated rows of one doc_id
count as one document, each with its own bitmap (equal rows share one); a null
doc_id counts as one document below all others; ids may be of any atomic type with an
order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import LOWER, as_bytes, cut, range_parts, row_hash, slices

MIN_CHARS, MIN_DOCS = 20, 3
BLANK = b"\t\n\x0b\x0c\r "


def hashed(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[int], list[bytes]]:
    """Positions and 128-bit hashes of the lines whose key has min_chars or more."""
    at, hashes, digest = [], [], xxhash.xxh3_128_digest
    for p, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip(BLANK)
        # a code point has four bytes at most
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars):
            at.append(p)
            hashes.append(digest(key))
    return at, hashes


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (hash), d (document), r (hash of the text: tells repeated rows of an id apart), p (position), for lines of min_chars or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            row, at, hashes = [], [], []
            for i, text in enumerate(as_bytes(b.column(2))):
                p, h = hashed(text, min_chars)
                row += [i] * len(p)
                at += p
                hashes += h
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(row), b.column(1).take(row), pa.array(at, pa.int32())], ["h1", "h2", "d", "r", "p"])

    picked = docs.select(F.col(id_col).alias("d"), row_hash(text_col).alias("r"), F.col(text_col).alias("t"))
    return picked.mapInArrow(run, f"h1 bigint, h2 bigint, d {picked.schema['d'].dataType.simpleString()}, r bigint, p int")


#: {}: the type of the ids.
SCAN = "kind tinyint, h1 bigint, h2 bigint, d {}, r bigint, p int, docs bigint"
ROW, SUMMARY, DROP = 0, 1, 2


def _scan(min_docs: int):
    """Over sorted rows: DROP rows that are decided, ROW and SUMMARY rows of the runs at the partition's two edges.

    A batch is h1, h2, the ids (integers, or objects for other types; zero where null), r, p and whether the id is null.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of_id, zero = pa.int64(), 0

        def ids(column: pa.Array) -> np.ndarray:
            if pa.types.is_integer(column.type):
                return column.fill_null(0).to_numpy()
            out = np.empty(len(column), object)
            out[:] = column.to_pylist()
            return out

        def out(kind, c, docs=None):
            n = len(c[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *[pa.array(x) for x in c[:2]], pa.array(c[2], kind_of_id, mask=c[5]), *[pa.array(x) for x in c[3:5]], pa.array(np.zeros(n, np.int64) if docs is None else docs)], ["kind", "h1", "h2", "d", "r", "p", "docs"])

        def summary(h, docs, largest):
            one = lambda x, t: np.array([x], t)
            d = one(zero if largest is None else largest, np.int64 if pa.types.is_integer(kind_of_id) else object)
            return out(SUMMARY, [one(h[0], np.int64), one(h[1], np.int64), d, one(0, np.int64), one(0, np.int32), one(largest is None, bool)], one(docs, np.int64))

        # Of the open run: its hash, documents so far, largest document (its first) and last one. Rows wait
        # in `held` only while fewer than min_docs documents were seen; the partition's first run is never decided here.
        h, docs, largest, last, first, held = None, 0, None, None, True, []

        def add(c: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
            nonlocal docs, held
            docs += n
            if first:
                yield out(ROW, c)
            elif docs < min_docs:
                held.append(c)
            else:
                for x in [*held, c]:
                    gone = (x[2] != (zero if largest is None else largest)) | (x[5] != (largest is None))
                    if gone.any():
                        yield out(DROP, [y[gone] for y in x])
                held = []

        for b in batches:
            if not b.num_rows:
                continue
            kind_of_id = b.column(2).type
            zero = 0 if pa.types.is_integer(kind_of_id) else None
            null = b.column(2).is_null().to_numpy(zero_copy_only=False)
            c = [b.column(0).to_numpy(), b.column(1).to_numpy(), ids(b.column(2)), b.column(3).to_numpy(), b.column(4).to_numpy(), null]
            doc_at = lambda i: None if null[i] else c[2][i]  # noqa: B023, E731
            turn = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            new_doc = np.concatenate([[True], turn | (c[2][1:] != c[2][:-1]) | (null[1:] != null[:-1])])
            starts = np.concatenate([[0], np.flatnonzero(turn) + 1])
            ends = np.concatenate([starts[1:], [b.num_rows]])
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)

            def begin(i: int) -> None:
                nonlocal h, docs, largest, held
                h, docs, largest, held = (int(c[0][i]), int(c[1][i])), 0, doc_at(i), []  # noqa: B023

            going_on = h == (int(c[0][0]), int(c[1][0]))
            if not going_on:
                if h is not None and first:
                    yield summary(h, docs, largest)
                    first = False
                begin(0)
            yield from add([x[: ends[0]] for x in c], int(n_docs[0]) - (going_on and last == (doc_at(0),)))
            if len(starts) > 1:
                if first:
                    yield summary(h, docs, largest)
                    first = False
                if len(starts) > 2:  # runs that begin and end in this batch, all at once
                    inside, s = slice(int(starts[1]), int(starts[-1])), starts[1:-1]
                    k = np.repeat(np.arange(len(s)), np.diff(starts[1:]))
                    gone = (n_docs[1:-1] >= min_docs)[k] & ((c[2][inside] != c[2][s][k]) | (null[inside] != null[s][k]))
                    if gone.any():
                        yield out(DROP, [x[inside][gone] for x in c])
                begin(int(starts[-1]))
                yield from add([x[starts[-1] :] for x in c], int(n_docs[-1]))
            last = (doc_at(b.num_rows - 1),)
        if h is not None:
            yield from (out(ROW, x) for x in held)
            yield summary(h, docs, largest)

    return run


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """d, r, p of each line that goes."""
    rows = cut(line_hashes(docs, id_col, text_col, min_chars))
    ordered = rows.repartitionByRange(range_parts(docs), "h1", "h2", F.desc_nulls_last("d")).sortWithinPartitions("h1", "h2", F.desc_nulls_last("d"), "r", "p")
    seen = cut(ordered.mapInArrow(_scan(min_docs), SCAN.format(rows.schema["d"].dataType.simpleString())))
    edges = seen.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("d").alias("most"))
    edges = edges.where(F.col("docs") >= min_docs).select("h1", "h2", "most")
    # `edges` has two rows for each partition at most
    late = seen.where(F.col("kind") == ROW).join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("most")))
    return seen.where(F.col("kind") == DROP).select("d", "r", "p").unionByName(late.select("d", "r", "p"))


def pack(positions: Iterable[int]) -> bytes:
    """A deflated bitmap with the given bits set; positions past its end are 0."""
    at = np.asarray(positions, np.int64)
    bits = np.zeros(int(at.max()) + 1 if len(at) else 0, np.uint8)
    bits[at] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines the bitmap drops."""
    out = np.zeros(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        out[: len(bits)] = bits
    return out


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """d, r and the bitmap of the lines to drop, for documents that lose any."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(x) for x in b.column(2).to_pylist()], pa.binary())], ["d", "r", "bitmap"])

    each = dropped_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("d", "r").agg(F.collect_set("p").alias("p"))  # a document's lines at most
    return each.mapInArrow(run, f"d {each.schema['d'].dataType.simpleString()}, r bigint, bitmap binary")


def _with_bitmaps(docs: DataFrame, columns: list, id_col: str, text_col: str, **limits) -> DataFrame:
    """columns, the text and its bitmap."""
    marks = cut(drop_bitmaps(docs, id_col, text_col, **limits))
    rows = docs.select(*columns, F.col(id_col).alias("__sl_d"), row_hash(text_col).alias("__sl_r"), F.col(text_col).alias("__sl_t"))
    marks = marks.select(F.col("d").alias("__sl_d2"), F.col("r").alias("__sl_r2"), "bitmap")
    same = F.col("__sl_d").eqNullSafe(F.col("__sl_d2")) & (F.col("__sl_r") == F.col("__sl_r2"))
    return rows.join(marks.hint("shuffle_hash"), same, "left").drop("__sl_d", "__sl_r", "__sl_d2", "__sl_r2")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without the dropped lines, the lines before, the lines dropped."""
    if not bitmap:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    drop = unpack(bitmap, len(lines))
    return b"\n".join([x for x, gone in zip(lines, drop.tolist()) if not gone]), len(lines), int(drop.sum())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    rows = _with_bitmaps(docs, [F.col(id_col).alias("doc_id")], id_col, text_col, **limits)

    def run(batches):
        for b in slices(batches, 1):
            done = [kept_text(t or b"", m) for t, m in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "__sl_t", "bitmap").mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """All columns of docs, the text without the dropped lines (null stays null), n_chars (if there) counted anew."""
    rows = _with_bitmaps(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__sl_doc")], id_col, text_col, **limits)

    def run(batches):
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else kept_text(t, m)[0] for t, m in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())], pa.binary()).cast(pa.string())], ["__sl_doc", "__sl_t"])

    rest = [c for c in docs.columns if c != text_col]
    rows = rows.withColumn("__sl_doc", F.struct(*[F.col(f"__sl_doc.`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("__sl_one")))
    # one pass over the join: two, for changed and unchanged texts, would shuffle the texts twice
    done = rows.select("__sl_doc", "__sl_t", "bitmap").mapInArrow(run, rows.select("__sl_doc", "__sl_t").schema)
    count = F.length("__sl_t")
    return done.select(*[(F.col("__sl_t") if c == text_col else count.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"__sl_doc.`{c}`")).alias(c) for c in docs.columns])
