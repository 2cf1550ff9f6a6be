"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints (64 bits, XXH64 of 3-word shingles) are collapsed to distinct
values first, so copies cost one row. The 64 bits are grouped by correlation
into m parts. If thresholds t_p >= -1 of the parts sum to tau - m + 1, then any
value within tau bits differs by at most t_p in some part p; so each value
probes only its own parts' neighbourhoods, with the thresholds that a dynamic
programme finds cheapest for it. Its costs are candidate counts estimated from
histograms of half-parts, which are counted over all values and have a fixed
size. A value whose part is crowded (near copies) thus skips that part.

Buckets that stay crowded all the same (near copies can agree in every group of
bits, so no further group splits them) are not paired up: their members take the
pigeonhole's other allocation, all 64 bits as one part, whose threshold of two is
dealt one to the stored and one to the probing side. Each value is written under
itself and its 64 one-bit neighbours; two values within two bits share such a
key, two that share one are within two bits, and a key has 65 members at most, so
the work is linear and the links the same whatever the skew.

Edge cases: a null, empty or blank text has fingerprint 0 and is linked like any
other; texts of one or two words are one shingle; repeated rows (also of one
doc_id) keep a row each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import LOWER, as_bytes, components, cut, join_groups, row_hash, slices, small

BITS, TAU, SHINGLE, SEED = 64, 2, 3, 42
#: In a bucket of more values than this, pairs would cost more than the one-part allocation's 65 rows a value: its members take that one.
CROWDED = 64
#: Rows written for a probe, in candidates checked: what the dynamic programme weighs signatures with.
PROBE_COST = 1.0


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of one UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n, line = len(words), b" ".join(words)
    if n <= shingle:
        h = xxhash.xxh64_intdigest(line, seed)
        return h - (h >> 63 << 64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: n - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    digest, total, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, np.int64)
    for k in range(0, total, 1 << 15):
        h = np.array([digest(line[a:e], seed) for a, e in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint) and row_hash (of the text) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x) for x in as_bytes(b.column(1))], pa.int64()), b.column(2)], ["doc_id", "fp", "row_hash"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_hash(text_col).alias("row_hash"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp bigint, row_hash bigint")


def n_parts(n: int, tau: int = TAU) -> int:
    """As many parts as keep the expected bucket of n random values smaller than the probes of fewer parts."""
    def cost(m: int) -> float:
        width, spare = BITS / m, tau - m + 1
        probes = m * 1.0 if spare == 0 else (m - 1) + (1 + width) if spare == 1 else 1 + width + width * width / 2
        return m + probes * (1 + n / 2**width)
    return min(range(1, tau + 2), key=cost)


def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m groups; a group takes next the bit most correlated with it."""
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for p in range(m):
        want = BITS // m + (p < BITS % m)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b][rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < want:
            best = max(sorted(left), key=lambda b: (corr[b][group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def halves(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each part in sub-parts of 11 bits at most."""
    return [[g[k : k + 11] for k in range(0, len(g), 11)] for g in groups]


def balls(counts: np.ndarray, width: int, tau: int = TAU) -> np.ndarray:
    """counts at distance 0, 1, ... tau of each value; the distances' masks are those of `width` bits."""
    ids, out = np.arange(1 << width), [counts]
    masks = {0: [0]}
    for r in range(1, tau + 1):
        masks[r] = sorted({m | 1 << k for m in masks[r - 1] for k in range(width) if not m >> k & 1})
        out.append(sum((counts[ids ^ m] for m in masks[r]), np.zeros(1 << width)))
    return np.array(out)


def costs(fp: np.ndarray, subs: list[list[list[int]]], tables: list[list[np.ndarray]], n: int, tau: int = TAU) -> list[np.ndarray]:
    """Of each part: an array (threshold from -1 to tau) x (value) of probes and estimated candidates."""
    out = []
    for parts, balls_of in zip(subs, tables):
        width = sum(map(len, parts))
        near = None  # expected share at each distance
        for bits, table in zip(parts, balls_of):
            mine = table[:, part_values(fp, bits).astype(np.int64)] / max(n, 1)
            near = mine if near is None else np.array([sum(near[a] * mine[r - a] for a in range(r + 1)) for r in range(tau + 1)])
        signatures, rows = 0, [np.zeros(len(fp))]
        ring = 1
        for r in range(tau + 1):
            signatures += ring
            ring = ring * (width - r) // (r + 1)
            rows.append(PROBE_COST * signatures + n * near[: r + 1].sum(0))
        out.append(np.array(rows))
    return out


def allocate(cost: list[np.ndarray], tau: int = TAU) -> np.ndarray:
    """Thresholds (parts x values) of least cost that sum to tau - m + 1, by dynamic programming over the parts."""
    m, n = len(cost), cost[0].shape[1]
    goal = tau - m + 1
    best = {0: (np.zeros(n), np.zeros((0, n), np.int8))}
    for p, c in enumerate(cost):
        after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s, (total, chosen) in best.items():
            for t in range(-1, tau + 1):
                if not goal - tau * (m - p - 1) <= s + t <= goal + (m - p - 1):
                    continue
                new, row = total + c[t + 1], np.vstack([chosen, np.full((1, n), t, np.int8)])
                if s + t in after:
                    less = new < after[s + t][0]
                    after[s + t] = np.where(less, new, after[s + t][0]), np.where(less, row, after[s + t][1])
                else:
                    after[s + t] = new, row
        best = after
    return best[goal][1]


def signatures(fp: np.ndarray, groups: list[list[int]], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, probe) rows: each value under its own parts, and under the neighbours it probes."""
    keys, who, probe = [], [], []

    def put(k, f, is_probe):
        keys.append(k)
        who.append(f)
        probe.append(np.full(len(k), is_probe, np.int8))

    for p, bits in enumerate(groups):
        value, top = part_values(fp, bits), np.uint64(p << 40 if len(bits) <= 40 else p << 62)
        put(value ^ top if len(bits) <= 40 else value, fp, 0)
        ring = [0]
        for r in range(int(chosen[p].max()) + 1):
            here = chosen[p] >= r
            if r:
                ring = sorted({m | 1 << k for m in ring for k in range(len(bits)) if not m >> k & 1})
            for mask in ring:
                put((value[here] ^ np.uint64(mask)) ^ (top if len(bits) <= 40 else np.uint64(0)), fp[here], 1)
    return np.concatenate(keys), np.concatenate(who), np.concatenate(probe)


def _columns(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def links(values: DataFrame, n: int) -> DataFrame:
    """(a, b) for a graph over the distinct values (column fp) that has the same components as all pairs within TAU bits."""

    def cooccur(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            for k in range(0, b.num_rows, 1 << 14):
                x = np.unpackbits(_columns(b)[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], ["k", "c"])

    def table(df: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in df.groupBy("k").agg(F.sum("c").alias("c")).collect():  # `size` rows at most, whatever the input
            out[r["k"]] = r["c"]
        return out

    m = n_parts(n)
    groups = bit_groups(table(values.mapInArrow(cooccur, "k int, c bigint"), BITS * BITS).reshape(BITS, BITS), n, m)
    subs = halves(groups)
    flat = [bits for parts in subs for bits in parts]

    def histogram(batches):
        counts = np.zeros((len(flat), 1 << 11), np.int64)
        for b in batches:
            fp = _columns(b)
            for k, bits in enumerate(flat):
                counts[k] += np.bincount(part_values(fp, bits).astype(np.int64), minlength=1 << 11)
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], ["k", "c"])

    counts = table(values.mapInArrow(histogram, "k int, c bigint"), len(flat) << 11).reshape(len(flat), 1 << 11)
    made = iter([balls(counts[k][: 1 << len(bits)], len(bits)) for k, bits in enumerate(flat)])
    tables = [[next(made) for _ in parts] for parts in subs]

    def probe(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1 << 14):
                fp = _columns(b)[k : k + (1 << 14)]
                key, who, is_probe = signatures(fp, groups, allocate(costs(fp, subs, tables, n)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who.view(np.int64)), pa.array(is_probe)], ["key", "fp", "probe"])

    rows = cut(values.select("fp").mapInArrow(probe, "key bigint, fp bigint, probe tinyint"))
    buckets = rows.groupBy("key").agg(
        F.count_if(F.col("probe") == 0).alias("stored"), F.count_if(F.col("probe") == 1).alias("probes"), F.min("fp").alias("lo"), F.max("fp").alias("hi")
    ).where("stored > 0 and probes > 0 and lo <> hi").select("key", (F.col("stored") > CROWDED).alias("crowded"))
    rows = cut(rows.join(buckets, "key"))
    stored, probing = (rows.where(f"not crowded and probe = {k}").select("key", F.col("fp").alias(c)) for k, c in ((0, "a"), (1, "b")))
    found = stored.join(probing, (stored["key"] == probing["key"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU)).select("a", "b")
    near = rows.where("crowded").select("fp").distinct().select(
        "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda i: F.when(i == BITS, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))).alias("key")
    )
    stars = near.groupBy("key").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return found.unionByName(stars).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """fp, root (of its component), component_id (the component's smallest doc_id), rows (of prints with this fp) of each distinct value."""
    values = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = components(links(values.select("fp"), values.count()))
    placed = cut(values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    return cut(join_groups(placed, least, "root", "size").select("fp", "root", "component_id", "rows"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    prints = cut(fingerprints(docs, id_col, text_col))
    return join_groups(prints, grouped(prints), "fp", "rows").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the smallest id (null last), then of the least text hash; of equal rows any one."""
    prints = cut(fingerprints(docs, id_col, text_col))
    rows = cut(join_groups(prints, grouped(prints), "fp", "rows").groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_hash"))
    best = cut(rows.groupBy("root").agg(F.min(key).alias("best"), F.count("*").alias("size")))
    rows = cut(join_groups(rows, best, "root", "size").select(F.col("doc_id").alias("__sl_id"), F.col("row_hash").alias("__sl_hash"), "n", key.eqNullSafe(F.col("best")).alias("stays")))
    same = F.col(id_col).eqNullSafe(F.col("__sl_id")) & (row_hash(text_col) == F.col("__sl_hash"))
    out = docs.join(small(cut(rows.where("not stays").select("__sl_id", "__sl_hash"))), same, "left_anti")
    again = cut(rows.where("stays and n > 1").select("__sl_id", "__sl_hash"))
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def as_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
