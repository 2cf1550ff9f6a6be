"""The packing search against exhaustive versions."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import helpers as H

pytest.importorskip("sievelake.llm")
from sievelake.llm import entries, packing  # noqa: E402


def sets_of(first, counts, cap):
    sizes = sorted(counts)
    for pick in itertools.product(*(range(counts[s] - (s == first) + 1) for s in sizes)):
        pieces = tuple(s for s, n in zip(reversed(sizes), reversed(pick)) for _ in range(n))
        if sum(pieces) <= cap - first:
            yield pieces


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 4), st.booleans())
def test_fillings_have_every_least_waste(counts, few, drawn):
    first = max(counts)
    every = list(sets_of(first, counts, 24))
    got = packing.fillings(first, counts, 24, None, None, random.Random(1) if drawn else None, few)
    assert [sum(x) for x in got] == sorted({sum(x) for x in every}, reverse=True) and set(got) <= set(every)
    assert packing.fillings(first, counts, 24, None, 2, None, few) == packing.fillings(first, counts, 24, None, None, None, few)[:2]
    if few and not drawn:
        for x in got:
            fewest = min(len(y) for y in every if sum(y) == sum(x))
            assert len(x) == fewest or fewest > few or len(set(x)) < len(x) or any(counts[s] < few for s in counts)


def least(pieces, cap):
    """The fewest bins, by trying all ways."""
    def go(rest, rooms):
        if not rest:
            return len(rooms)
        ways = [go(rest[1:], tuple(sorted((*rooms[:k], x - rest[0], *rooms[k + 1 :])))) for k, x in enumerate(rooms) if x >= rest[0] and x not in rooms[:k]]
        return min([*ways, go(rest[1:], tuple(sorted((*rooms, cap - rest[0]))))])
    return go(sorted(pieces, reverse=True), ())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 14), min_size=1, max_size=8), st.integers(14, 20))
def test_without_bounds_the_search_is_exact(pieces, cap):
    counts = {s: pieces.count(s) for s in pieces}
    plan = packing.complete(counts, cap, None)
    assert packing.size_of(plan) == least(pieces, cap)
    assert sorted(s for p, n in plan for s in p * n) == sorted(pieces)


def test_large_mixes_reach_the_bound():
    r = random.Random(4)
    for n in (1_000, 60_000):
        counts = {}
        for _ in range(n):
            s = min(1023, max(1, int(r.lognormvariate(5.3, 1.0))))
            counts[s] = counts.get(s, 0) + 1
        plan, total = packing.complete(counts, 1024), {}
        for pattern, k in plan:
            assert sum(pattern) <= 1024
            for s in pattern:
                total[s] = total.get(s, 0) + k
        assert total == counts and packing.size_of(plan) == packing.lower_bound(counts, 1024)


@pytest.mark.parametrize("counts", [{13: 31_000, 11: 30_000}, {17: 50_000, 19: 40_000, 23: 30_000}, {100: 5000, 150: 3000, 31: 9000, 7: 20_000}, {1023: 5, 1: 5}])
def test_repeated_lengths_reach_the_bound(counts):
    """Corpora of copies: few lengths, so that full bins have to use them up in proportion."""
    plan, total = packing.complete(counts, 1024), dict.fromkeys(counts, 0)
    for pattern, k in plan:
        assert sum(pattern) <= 1024
        for s in pattern:
            total[s] += k
    assert total == counts and packing.size_of(plan) == packing.lower_bound(counts, 1024)


def test_hot_lengths_and_repeated_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rows = [(7, "the same words again and again") for _ in range(400)] + [(k, H.text(k, 30)) for k in range(30)]
    got = entries.QUERIES["op9_packing"](spark, H.write_tables(tmp_path, rows=rows)).collect()
    assert sorted(x.doc_id for x in got) == sorted(d for d, _ in rows)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) == -(-sum(x.length for x in got) // 1024)
