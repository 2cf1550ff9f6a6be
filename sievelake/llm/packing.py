"""Best-fit packing of tokenised documents into sequences by bin completion.

Token counts are integers up to the sequence length, so a packing is decided on
the histogram of piece lengths (one number per length, whatever the corpus
size): the driver solves bin packing over it and gets patterns, a multiset of
lengths with a multiplicity. Executors then deal pieces to the patterns' slots
by their rank among the pieces of equal length. Ranks come from a window over
(length, salt), with as many salts as a length's pieces need to keep every group
small, and prefix sums of the groups' counts, so no length, however frequent, and no
document, however often repeated, meets in one task. Full pieces
need no packing.

The solver: best-fit decreasing on counts gives the first incumbent; if it isn't
at the lower bound (the better of the sum bound and Martello and Toth's L2), a
depth-first bin completion takes the largest length left, enumerates its
fillings by least waste, of any number of pieces, commits each to as many bins as
counts allow, prunes by the waste that a better packing can still afford, and
completes nodes by best fit for new incumbents. Passes for incumbents go deep along
fillings of little waste, found exactly by the sums that the pieces can reach (a bit
for each sum): of the fewest pieces within the waste that a better packing can have,
then of least waste with the fewest, the longest, about the average or random pieces.
The last pass looks at all undominated fillings (those whose pieces don't fit into the
pieces of another), each in full, half and single multiplicity. Rounds of the same
search then re-pack parts of the incumbent.

What bounds the effort, never the input: `nodes` (an eighth of them, or two for each
length, for each pass, half for the last; a tenth of them for the sets tried at one of
its nodes), WIDTH, FEW and SPARE for the passes before, `rounds`, which end early
after PATIENCE of them without a gain, and PART_BINS, the bins of a part. With nodes=None
the last pass has no bounds: it ends only when every packing that could be better is
ruled out (exact, and exponential).

Edge cases: a null or empty text has the end token only; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut, slices

LENGTH, END = 1024, 2
#: A text is encoded in parts of about so many characters.
PART = 1 << 18
#: Pieces of one length that are ranked together, about.
GROUP = 500
#: Fillings tried at a node of the first pass; rounds without a gain that end the search; bins that a round re-packs.
WIDTH, PATIENCE, PART_BINS = 4, 8, 450
#: Pieces up to which the fewest are looked for; tokens of waste up to which fewer pieces are preferred.
FEW, SPARE = 4, 31
#: The most rows of ranks' offsets that are broadcast; more are joined by a shuffle.
SMALL = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids (uint32), those of the tokenizer file at `path`.

    A byte-level BPE whose ids follow its merges is encoded by ranks, which is
    some times faster and gives the same ids; texts with a special token's string,
    and other tokenizers, go through the tokenizer itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges", [])]
    vocab = model.get("vocab", {})
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and all(vocab.get("".join(x)) == 256 + i for i, x in enumerate(merges))
    )
    if not plain:
        return slow
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    general = tiktoken.Encoding("general", pat_str=words + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    # where no two spaces follow each other the look-ahead says nothing, and a pattern without it is faster
    single = tiktoken.Encoding("single", pat_str=words + r"|\s+", mergeable_ranks=ranks, special_tokens={})
    two = re.compile(r"\s\s")

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return np.concatenate([np.array((general if two.search(x) else single).encode_ordinary(x), np.uint32) for x in parts(text)])

    return fast


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that end before a space after a non-space: a boundary of words in any byte-level BPE's pattern."""
    edge, a = re.compile(r"\S\s"), 0
    while len(text) - a > size:
        m = edge.search(text, a + size)
        if not m:
            break
        yield text[a : m.start() + 1]
        a = m.start() + 1
    yield text[a:]


def pieces_of(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of a document of n tokens; the first one takes what is over."""
    if n <= length:
        return [n]
    return [n % length] * (n % length > 0) + [length] * (n // length)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenized(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in slices(batches, 1):
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                at = 0
                for k, n in enumerate(pieces_of(len(ids), length)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {PIECES}")


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], cap: int) -> Plan:
    """Best-fit decreasing, many equal pieces and equal bins at a time."""
    open_bins: dict[int, Counter] = {}
    done: Plan = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = cap - sum(pattern)
        if room:
            open_bins.setdefault(room, Counter())[pattern] += n
        else:
            done.append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in sorted(r for r in open_bins if r >= s):
            group = open_bins[room]
            for pattern in list(group):
                if not left:
                    break
                each = room // s
                whole = min(group[pattern], left // each)
                if whole:
                    group[pattern] -= whole
                    left -= whole * each
                    put((*pattern, *(s,) * each), whole)
                if left and group[pattern]:
                    group[pattern] -= 1
                    put((*pattern, *(s,) * left), 1)
                    left = 0
                if not group[pattern]:
                    del group[pattern]
            if not group:
                del open_bins[room]
            if not left:
                break
        each = cap // s
        if left // each:
            put((s,) * each, left // each)
        if left % each:
            put((s,) * (left % each), 1)
    return done + [(p, n) for g in open_bins.values() for p, n in g.items()]


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """The larger of the sum bound and Martello and Toth's L2."""
    if not counts:
        return 0
    size = np.array(sorted(counts))
    n = np.array([counts[int(s)] for s in size])
    best = -(-int((size * n).sum()) // cap)
    for k in [0, *size[size <= cap // 2].tolist()]:
        big, mid, small = size > cap - k, (size <= cap - k) & (size > cap // 2), (size <= cap // 2) & (size >= k)
        over = int((size * n)[small].sum()) - (int(n[mid].sum()) * cap - int((size * n)[mid].sum()))
        best = max(best, int(n[big].sum() + n[mid].sum()) + max(0, -(-over // cap)))
    return best


def fillings(first: int, counts: dict[int, int], cap: int, sizes: list[int] | None = None, width: int | None = WIDTH, draw: Random | None = None, few: int = 0, level: bool = False) -> list[tuple[int, ...]]:
    """Of each of the `width` least wastes that a bin with `first` can have (of every one if None), one filling.

    It is the one of fewest pieces if up to `few` are enough, else one with the longest pieces, with pieces drawn at random, or (level)
    with about as many of each length as a bin has on average.
    """
    sizes = sorted(counts) if sizes is None else sizes
    room = cap - first
    own = {s: n for s in sizes[: bisect_right(sizes, room)] if (n := min(counts[s] - (s == first), room // s))}
    order = list(own)
    if draw:
        draw.shuffle(order)
    sums, stages, mask = 1, [], (1 << room + 1) - 1
    for s in order:
        stages.append(sums)
        n, step = own[s], 1
        while n:
            k = min(step, n)
            sums |= sums << s * k
            n, step = n - k, step * 2
        sums &= mask
    bins = sum(s * n for s, n in counts.items()) / cap
    layers = [1]  # sums of 0, 1, 2, ... pieces, copies not counted
    for _ in range(few):
        more = 0
        for s in own:
            more |= layers[-1] << s
        layers.append(more & mask)
    out: list[tuple[int, ...]] = []
    while sums and (width is None or len(out) < width):
        total = sums.bit_length() - 1
        sums ^= 1 << total
        picked = _fewest(total, order, own, layers) if few else None
        if picked is None:
            picked = []
            for s, before in zip(reversed(order), reversed(stages)):
                if not total:
                    break
                fit = (k for k in range(min(own[s], total // s), -1, -1) if before >> total - k * s & 1)
                k = min(fit, key=lambda k: abs(k - counts[s] / bins)) if level else next(fit)
                picked += [s] * k
                total -= k * s
        out.append(tuple(sorted(picked, reverse=True)))
    return out


def _fewest(total: int, sizes: list[int], own: dict[int, int], layers: list[int]) -> list[int] | None:
    """As few pieces as make up the total, the longest first; None if the layers don't tell."""
    n = next((n for n, sums in enumerate(layers) if sums >> total & 1), None)
    picked: list[int] = []
    for k in range(n or 0, 0, -1):
        s = next((s for s in reversed(sizes) if s <= total and layers[k - 1] >> total - s & 1 and picked.count(s) < own[s]), None)
        if s is None:
            return None
        picked.append(s)
        total -= s
    return None if n is None else picked


def all_fillings(first: int, counts: dict[int, int], cap: int, sizes: list[int] | None = None, tries: int | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of a bin that holds `first`, least waste first, then fewest pieces; of the first `tries` sets if it is given.

    The capacity alone bounds the pieces. A set goes if another piece fits in, or if
    its pieces are seen to fit side by side into the pieces of a set kept.
    """
    sizes = sorted(counts) if sizes is None else sizes
    found: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(cap - first, len(sizes) - 1, ())]
    while stack and (tries is None or tries > 0):
        free, top, picked = stack.pop()
        tries = None if tries is None else tries - 1
        top = min(bisect_right(sizes, free) - 1, top)
        if top < 0:
            used = Counter((first, *picked))
            if all(s > free or counts[s] == used[s] for s in sizes[: bisect_right(sizes, free)]):
                found.append((free, picked))
            continue
        s = sizes[top]
        for n in range(min(counts[s] - (s == first), free // s) + 1):  # the last one is taken up first
            stack.append((free - n * s, top - 1, (*picked, *(s,) * n)))
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept: list[tuple[int, ...]] = []
    for _, picked in found:
        if not any(fits_into(picked, other) for other in kept):
            kept.append(picked)
            yield picked


def fits_into(pieces: tuple[int, ...], spaces: tuple[int, ...]) -> bool:
    """Whether best fit puts the pieces (descending) into the spaces; if so, the set of spaces dominates that of pieces."""
    rooms = sorted(spaces)
    for s in pieces:
        k = bisect_left(rooms, s)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - s)
    return True


def complete(counts: dict[int, int], cap: int, nodes: int | None = 3000, rounds: int = 40) -> Plan:
    """Patterns and multiplicities of a packing of all pieces (none longer than cap).

    After a search over everything, rounds of it re-pack parts of the incumbent:
    bins that aren't full together with full ones drawn at random (from a fixed
    seed), a problem small enough for the search to end well.
    """
    counts = {s: n for s, n in counts.items() if n}
    least, draw, stale = lower_bound(counts, cap), Random(0), 0
    best = search(counts, cap, best_fit(counts, cap), nodes)
    for k in range(rounds if nodes else 0):
        if size_of(best) <= least or stale == PATIENCE:
            break
        bins: Counter = Counter()
        for pattern, n in best:
            bins[pattern] += n
        loose, full = [p for p in bins if sum(p) < cap], [p for p in bins if sum(p) == cap]
        draw.shuffle(full)
        if k % 2:
            draw.shuffle(loose)
        else:
            loose.sort(key=lambda p: (sum(p) - cap) * draw.uniform(0.5, 1))  # those with most room first, about
        part: Counter = Counter()
        for p in loose + full:
            free = (PART_BINS * 2 // 3 if sum(p) < cap else PART_BINS) - part.total()
            if free > 0:
                part[p] = min(bins[p], free, 40 if sum(p) < cap else 2)
        inner: Counter = Counter()
        for p, n in part.items():
            for s in p:
                inner[s] += n
        again = search(dict(inner), cap, list(part.items()), nodes)
        stale += 1
        if size_of(again) < part.total():
            stale = 0
            bins.subtract(part)
            for p, n in again:
                bins[p] += n
            best = [(p, n) for p, n in bins.items() if n]
    return best


def size_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def search(counts: dict[int, int], cap: int, best: Plan, nodes: int | None) -> Plan:
    """Depth-first bin completion from the incumbent `best`: passes along fillings of little waste, then one that leaves nothing out but what `nodes` cuts off."""
    least, total = lower_bound(counts, cap), sum(s * n for s, n in counts.items())
    bins = size_of(best)

    def tried(rest: dict[int, int], used: int, waste: int, way: str | Random) -> Iterable[tuple[int, ...]]:
        """The fillings of a node, in the order of the pass."""
        sizes = sorted(rest)
        if way == "all":
            return all_fillings(sizes[-1], rest, cap, sizes, nodes and nodes // 10)
        if way != "spare":
            return fillings(sizes[-1], rest, cap, sizes, WIDTH, way if isinstance(way, Random) else None, FEW if way == "few" else 0, way == "level")
        share = ((bins - 1) * cap - total - waste) // max(1, bins - 1 - used)  # the waste that each further bin of a better packing can have
        return sorted(fillings(sizes[-1], rest, cap, sizes, max(WIDTH, min(share, SPARE) + 1), None, FEW), key=lambda x: (cap - sizes[-1] - sum(x) > share, len(x), -sum(x)))

    def children(rest: dict[int, int], plan: Plan, used: int, waste: int, way: str | Random) -> Iterator[tuple[dict[int, int], Plan, int, int]]:
        first, whole = max(rest), way == "all"
        later = []
        for more in tried(rest, used, waste, way):
            need = Counter((first, *more))
            most = min(rest[s] // k for s, k in need.items())
            for times in sorted({most, (most + 1) // 2, 1} if whole else {(most + 1) // 2} if way == "level" else {most}, reverse=True):
                if times < most and whole:
                    later.append((more, need, times))
                else:
                    yield commit(rest, plan, used, waste, (first, *more), need, times)
        for more, need, times in later:  # one at a time reaches any multiplicity
            yield commit(rest, plan, used, waste, (first, *more), need, times)

    def commit(rest, plan, used, waste, pattern, need, times):
        after = dict(rest)
        for s, k in need.items():
            after[s] -= times * k
            if not after[s]:
                del after[s]
        return after, [*plan, (pattern, times)], used + times, waste + times * (cap - sum(pattern))

    for way in ("spare", "few", "long", "level", Random(len(counts)), "all"):
        if not nodes and way != "all":
            continue
        left_nodes = nodes and max(nodes // (2 if way == "all" else 8), 2 * len(counts))  # enough for a whole dive
        stack = [iter([(counts, [], 0, 0)])]
        while stack and left_nodes != 0 and bins > least:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            if left_nodes:
                left_nodes -= 1
            rest, plan, used, waste = node
            # what is left needs (all - packed) / cap bins at least, so the waste so far bounds the whole
            if waste > (bins - 1) * cap - total:
                continue
            if not rest:
                best, bins = plan, used
                continue
            if len(plan) % 16 == 0:
                tail = best_fit(rest, cap)
                if (n := used + size_of(tail)) < bins:
                    best, bins = plan + tail, n
            stack.append(children(*node, way))
    return best


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: arrays over segments sorted by (length, first rank)."""
    taken, base, rows = Counter(), 0, []
    for pattern, times in plan:
        at = 0
        for s in pattern:
            rows.append((s, taken[s], base, at))
            taken[s] += times
            at += s
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", nodes: int = 3000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Full pieces have negative sequence ids."""
    spark = docs.sparkSession
    pieces = cut(tokenized(docs, tokenizer or default_tokenizer(), length, end, id_col, text_col).withColumn("__sl_n", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < length)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `length` rows at most
    salts = [1 + counts.get(k, 0) // GROUP for k in range(length)]
    salted = short.withColumn("__sl_s", F.pmod(F.xxhash64("__sl_n"), F.get(F.lit(salts), F.col("length").cast("int"))).cast("int"))
    groups = salted.groupBy("length", "__sl_s").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__sl_s").rowsBetween(Window.unboundedPreceding, -1))
    groups = cut(groups.select(F.col("length").alias("__sl_l"), F.col("__sl_s").alias("__sl_g"), F.coalesce(before, F.lit(0).cast("bigint")).alias("__sl_before")))
    ranked = salted.withColumn("__sl_rank", F.row_number().over(Window.partitionBy("length", "__sl_s").orderBy("doc_id", "start", "__sl_n")) - 1)
    few = sum(salts) <= SMALL
    ranked = ranked.join(F.broadcast(groups) if few else groups, (F.col("length") == F.col("__sl_l")) & (F.col("__sl_s") == F.col("__sl_g")))
    sent = spark.sparkContext.broadcast(slots(complete(counts, length, nodes)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        plan = sent.value
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            lo, hi = np.searchsorted(plan["length"], size, "left"), np.searchsorted(plan["length"], size, "right")
            while (open_ := hi - lo > 1).any():  # the last segment of this length that begins at the rank or before
                mid = (lo + hi) // 2
                right = open_ & (plan["rank"][np.minimum(mid, len(plan["rank"]) - 1)] <= rank)
                lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan["base"][lo] + rank - plan["rank"][lo]), pa.array(plan["offset"][lo])], [*columns, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*columns, (F.col("__sl_before") + F.col("__sl_rank")).alias("rank")).mapInArrow(place, f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") == length).select(*columns, (-1 - F.col("__sl_n")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(full)
