"""The queries on awkward tables, against DuckDB or plain Python."""

import random
import zlib

import numpy as np
import pytest

from . import helpers as H

pytest.importorskip("sievelake.llm")
from sievelake.llm import entries, packing  # noqa: E402


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return H.write_tables(tmp_path_factory.mktemp("sf"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return H.write_tables(tmp_path_factory.mktemp("empty"), rows=[], pages=[], items=[], labels=[])


@pytest.mark.parametrize("name", list(entries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert H.collected(entries.QUERIES[name](spark, sf)) == H.oracle(sf, entries.ORACLE_SQL[name])


ITEMS = [(1, H.text(900, 30)), (2, H.text(901, 40)), (3, None), (5, "zzz zzz"), (7, "repeated a")]


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    return H.write_tables(tmp_path_factory.mktemp("big"), rows=H.giants(), items=ITEMS)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_line_dedup", "op8_secret_scan"])
def test_very_long_texts_against_sql(spark, big, name):
    assert H.collected(entries.QUERIES[name](spark, big)) == H.oracle(big, entries.ORACLE_SQL[name])


def test_very_long_texts(spark, big):
    rows = H.giants()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in entries.QUERIES["op4_decontamination"](spark, big).collect())
    assert got == H.hits(rows, ITEMS) and dict((g[0], g[2]) for g in got)[60] >= 30
    prints = {r.doc_id: r.fingerprint for r in entries.QUERIES["op1_simhash"](spark, big).collect()}
    assert prints == {d: f"{H.fingerprint(t):016x}" for d, t in rows}
    pieces = entries.QUERIES["op9_packing"](spark, big).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows}
    assert entries.QUERIES["op6_language_id"](spark, big).count() == entries.QUERIES["op10_toxicity"](spark, big).count() == len(rows)


def test_decontamination_by_definition(spark, tmp_path):
    r = random.Random(8)
    items = [(k, " ".join(r.choice("abc") for _ in range(r.choice([1, 2, 5, 9, 10, 11, 14, 30])))) for k in range(25)]
    rows = [(k, " ".join(r.choice("abcd"[: 3 + k % 2]) for _ in range(r.choice([0, 1, 4, 9, 10, 12, 40, 120])))) for k in range(120)]
    got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in entries.QUERIES["op4_decontamination"](spark, H.write_tables(tmp_path, rows=rows, items=items)).collect())
    assert got == H.hits(rows, items)


@pytest.mark.parametrize("name", list(entries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert entries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(entries.QUERIES))
def test_null_ids(spark, tmp_path, name):
    rows = [(None, "a line that is long enough to count\nx"), (None, None), (1, "a line that is long enough to count"), (2, "a line that is long enough to count")]
    pages = [(None, None, None), (None, "u", "y" * 200), (3, "v", "y" * 200), (None, "u", "z" * 200)]
    folder = H.write_tables(tmp_path, rows=rows, pages=pages, items=[(None, "a line that is long"), (1, None)], labels=[(None, None, None), (1, 0, True), (2, 1, None)])
    assert entries.QUERIES[name](spark, folder).count() == 4


def test_simhash(spark, sf):
    docs = H.documents()
    prints = [H.fingerprint(t) for _, t in docs]
    roots = H.groups(prints)
    least = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, 10**9), docs[k][0])
    want = sorted((least[roots[k]], docs[k][0], f"{prints[k]:016x}") for k in range(len(docs)))
    got = sorted((r.component_id, r.doc_id, r.fingerprint) for r in entries.QUERIES["op1_simhash"](spark, sf).collect())
    assert got == want
    assert len({x[0] for x in want}) < len(docs) - 8


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = entries.QUERIES["op9_packing"](spark, sf).collect()
    want = []
    for d, t in H.documents():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, n in enumerate(packing.pieces_of(len(ids))):
            want.append((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(w[3] for w in want) // 1024) + 1


def test_language(spark, tmp_path):
    r = random.Random(3)
    parts = {"xx": ["ba", "de", "ki", "lo"], "yy": ["zu", "er", "ong", "shi"]}
    rows = [(k, " ".join("".join(r.choice(parts["xx" if k % 2 else "yy"]) for _ in range(3)) for _ in range(6))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "😀 ."), (1005, "ba" * 300_000)]
    folder = H.write_tables(tmp_path, rows=rows)
    import pyarrow as pa
    import pyarrow.parquet as pq

    lang = [None if k % 11 == 0 or k >= 1000 else "xx" if k % 2 else "yy" for k, _ in rows]
    t = pq.read_table(f"{folder}/documents.parquet")
    pq.write_table(t.set_column(t.column_names.index("lang"), "lang", pa.array(lang, pa.string())), f"{folder}/documents.parquet")
    got = {x.doc_id: x for x in entries.QUERIES["op6_language_id"](spark, folder).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in range(1000, 1004))
    assert got[1005].lang_pred == "xx"
    assert all(got[k].held_out == H.out_of_fit(k) for k, _ in rows)
    held = [k for k in range(300) if H.out_of_fit(k)]
    assert sum(got[k].lang_pred == ("xx" if k % 2 else "yy") for k in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_toxicity(spark, tmp_path):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        toxic, words = k % 5 == 0, H.text(k, 40).split()
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grumpf" + r.choice("abc"), "snarlix" + r.choice("de"), "idiot"]))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, 1, toxic))
    rows += [(1000, None), (1001, ""), (1002, "idiot " * 50_000)]
    got = {x.doc_id: x for x in entries.QUERIES["op10_toxicity"](spark, H.write_tables(tmp_path, rows=rows, labels=labels)).collect()}
    held = [k for k in range(600) if H.out_of_fit(k)]
    assert sum(got[k].predicted == (k % 5 == 0) for k in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score and got[1000].predicted == 0
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) and x.held_out == H.out_of_fit(x.doc_id) for x in got.values())


def test_html_rows(spark, sf):
    got = sorted((r.page_id, r.text) for r in entries.QUERIES["op7_html_extraction"](spark, sf).collect() if r.text is not None)
    assert got[0] == (1, H.text(5, 40)) and (4, "") in got and len(got) == 10
