"""Merging findings of several sources that mean the same.

The merge is greedy and depends on order, so it can't be a connected-components
job: findings come in order, each joins the first merged finding that it
duplicates, and the one of the higher tier represents both. Two findings can only
meet if their line ranges nearly touch, so a file's findings are cut, by a
running maximum, into blocks between which no range reaches; a block, not a
file, is what a task has to hold. Findings are shuffled once, by file, and the
blocks of a file pass through one task.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import severity
from sievelake.functions.similarity import SIMILAR, ratio
from sievelake.operators.scope import end_line

#: Fixed value: lines between ranges that still count as touching.
NEAR = 2


def ranges_touch(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return (a_first - NEAR <= end_line(b_first, b_last)) & (b_first - NEAR <= end_line(a_first, a_last))


def blocks(findings: DataFrame) -> DataFrame:
    """findings with __new: whether a block begins, in order of file, line and ord; ranges of different blocks don't touch."""
    order = Window.partitionBy("file").orderBy("line_start", "ord")
    # a range that ends before it starts still reaches from its start
    end = F.greatest("line_start", end_line(F.col("line_start"), F.col("line_end")))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return findings.withColumn("__new", F.coalesce(F.col("line_start") - NEAR > reach, F.lit(True)))


def merge_blocks(rows: pa.Table) -> pa.Table:
    """The merged findings of whole blocks, without __new and __tier. rows: as blocks() gives them, with __tier, __rank and __none (whether also_flagged_by, here empty, is null)."""
    starts = rows.column("__new").to_numpy()
    rows = rows.take(np.lexsort((rows.column("ord").to_numpy(), np.cumsum(starts))))
    bounds = np.append(np.flatnonzero(starts), len(rows))
    check, source, title = (rows.column(c).combine_chunks().dictionary_encode() for c in ("check_id", "source", "title"))
    codes = lambda x: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = (codes(check) * (len(source.dictionary) + 1) + codes(source)).tolist()
    titles, named = [*title.dictionary.to_pylist(), ""], codes(title).tolist()  # no title is an empty one
    # lines may be null, but only in blocks of one finding
    first = rows.column("line_start").to_pylist()
    last = [b or a for a, b in zip(first, rows.column("line_end").to_pylist())]
    tier, rank = rows.column("__tier").to_pylist(), rows.column("__rank").to_pylist()
    alike: dict[tuple[int, int], bool] = {}

    def similar(new: int, old: int) -> bool:
        if (found := alike.get((new, old))) is None:
            found = alike[new, old] = ratio(titles[new], titles[old]) >= SIMILAR
        return found

    winner: list[int] = []  # of each merged finding: the row that represents it, the row whose place it has
    place: list[int] = []
    others: dict[int, list[int]] = {}  # by its number: the rows that its representative has met
    for begin, end in itertools.pairwise(bounds.tolist()):
        base = len(winner)
        winner.append(begin)
        place.append(begin)
        for new in range(begin + 1, end):
            for at in range(base, len(winner)):
                old = winner[at]
                if kind[new] == kind[old]:
                    if first[new] == first[old] and last[new] == last[old]:
                        break
                elif first[new] - NEAR <= last[old] and first[old] - NEAR <= last[new] and similar(named[new], named[old]):
                    break
            else:
                winner.append(new)
                place.append(new)
                continue
            top = max(rank[new], rank[old])
            # only the winner's own list of others survives; the place in the order is the first one's
            if tier[new] > tier[old]:
                winner[at], others[at] = new, [old]
            else:
                others.setdefault(at, []).append(new)
            rank[winner[at]] = top
    out = rows.drop_columns(["__new", "__tier"]).take(np.array(winner))
    replaced = {"ord": rows.column("ord").take(np.array(place)), "__rank": pa.array([rank[k] for k in winner], out.schema.field("__rank").type)}
    if others:
        at = list(others)
        met = sorted({k for x in others.values() for k in x})
        label = dict(zip(met, (f"{a}:{b}" for a, b in zip(source.take(pa.array(met)).to_pylist(), check.take(pa.array(met)).to_pylist()))))
        also = [[*own, *(label[x] for x in others[k])] for k, own in zip(at, out.column("also_flagged_by").take(pa.array(at)).to_pylist())]
        replaced["also_flagged_by"] = _put(out.column("also_flagged_by"), at, also)
        replaced["__none"] = _put(out.column("__none"), at, [False] * len(at))
        if "raw" in out.column_names:
            raw = [json.dumps(_object(x) | {"also_flagged_by": y}, ensure_ascii=False, separators=(",", ":")) for x, y in zip(out.column("raw").take(pa.array(at)).to_pylist(), also)]
            replaced["raw"] = _put(out.column("raw"), at, raw)
    return pa.table([replaced.get(name, out.column(name)) for name in out.column_names], names=out.column_names)


def _put(column: pa.ChunkedArray, at: list[int], values: list) -> pa.ChunkedArray:
    """column with other values at some places."""
    take = np.arange(len(column))
    take[at] = len(column) + np.arange(len(at))
    return pa.chunked_array([*column.chunks, pa.array(values, column.type)]).combine_chunks().take(pa.array(take))


def _object(text: str | None) -> dict:
    value = json.loads(text) if text else {}
    return value if isinstance(value, dict) else {}


def merged(findings: DataFrame) -> DataFrame:
    """The merged findings, with their columns; findings need ord (their order), and get also_flagged_by (in raw too, if there is one) and the merged severity.

    Null titles compare as empty ones. Rows without a file or a line form blocks of their own.
    """
    raw = F.from_json(F.get_json_object("raw", "$.also_flagged_by"), "array<string>") if "raw" in findings.columns else F.lit(None).cast("array<string>")
    have = F.col("also_flagged_by") if "also_flagged_by" in findings.columns else F.lit(None).cast("array<string>")
    rows = findings.withColumn("also_flagged_by", F.coalesce(have, raw))
    columns = rows.columns
    rows = blocks(rows).withColumns({"__tier": severity.tier_priority(F.col("tier")), "__rank": severity.rank(F.col("severity"))})
    # on its way to Python, a null list costs as much as all nulls before it in its batch, so these go as empty ones
    rows = rows.withColumns({"__none": F.col("also_flagged_by").isNull(), "also_flagged_by": F.coalesce("also_flagged_by", F.expr("cast(array() as array<string>)"))})
    # the window has sorted them so already
    rows = rows.sortWithinPartitions("file", "line_start", "ord")
    out = rows.mapInArrow(_merge_sorted, rows.drop("__new", "__tier").schema)
    return out.withColumn("severity", F.when(F.col("__rank") >= 0, severity.of_rank(F.col("__rank"))).otherwise(F.col("severity"))).withColumn("also_flagged_by", F.when(~F.col("__none"), F.col("also_flagged_by"))).select(*columns)


def _merge_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges block after block of rows sorted by file and line; a task holds a batch and the block that goes on after it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("__new").to_numpy(zero_copy_only=False))
        if len(starts):
            cut = int(starts[-1])
            whole = [x for x in (*held, b.slice(0, cut)) if x.num_rows]
            if whole:
                yield from merge_blocks(pa.Table.from_batches(whole)).to_batches()
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield from merge_blocks(pa.Table.from_batches(held)).to_batches()
