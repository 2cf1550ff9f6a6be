"""The pipeline against a plain version, stage by stage, and on empty input."""

import re

import pytest

from . import helpers as H

pytest.importorskip("sievelake.llm")
import corpus_pipeline as P  # noqa: E402

from sievelake.llm import packing, quality  # noqa: E402


def plain_lines(rows):
    keys, docs = {}, {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = H.lower(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 20:
                docs.setdefault(k, set()).add(d)
    keys = {k: max(v) for k, v in docs.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        out.append((d, None if t is None else "\n".join(x for x in t.split("\n") if keys.get(H.lower(x.strip(" \t\n\x0b\x0c\r")), d) == d)))
    return out


def plain_near(rows):
    roots, seen, out = H.groups([H.fingerprint(t) for _, t in rows]), {}, []
    for (d, _), r in zip(rows, roots):
        seen[r] = min(seen.get(r, d), d)
    done = set()
    for (d, t), r in zip(rows, roots):
        if d == seen[r] and (r, d) not in done:
            done.add((r, d))
            out.append((d, t))
    return out


def plain_clean(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(t or ""))

    windows = set()
    for _, t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} - {()}
    sizes = {len(w) for w in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]


def test_stages(spark, tmp_path):
    rows = [r for r in H.documents() if r[0] < 50]
    items = [(1, H.text(900, 30)), (2, "")]
    sf = H.write_tables(tmp_path, rows=rows, items=items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {x.doc_id for x in quality.score(docs).where("kept").collect()}
    want = [r for r in rows if r[0] in kept]
    plain = {"quality_rules": lambda x: want, "line_dedup": plain_lines, "near_dedup": plain_near, "decontamination": lambda x: plain_clean(x, items)}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name in plain:
            assert out.columns == docs.columns
            want = plain[name](want)
            assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted(want, key=repr), name
            assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in out.collect())
        else:
            encode = packing.encoder(packing.default_tokenizer())
            assert sorted((x.doc_id, x.length) for x in out.collect()) == sorted((d, n) for d, t in want for n in packing.pieces_of(len(encode(t or "")) + 1))
        docs = out
    assert {r[0] for r in want} < {r[0] for r in rows}


def test_repeated_rows_and_empty_input(spark, tmp_path):
    long = "the river and the stone of " + H.text(1, 60)
    (tmp_path / "a").mkdir()
    sf = H.write_tables(tmp_path / "a", rows=[(1, long), (1, long), (2, long), (3, "that is for the garden " + H.text(2, 60)), (3, "that is for the garden " + H.text(2, 60))])
    assert {x.doc_id for x in P.run(spark, sf).collect()} == {1, 3}
    near = P.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(x.doc_id for x in near.collect()) == [1, 3]
    (tmp_path / "c").mkdir()
    other, third = "that is for the paper " + H.text(3, 60), "with the letter into " + H.text(4, 60)
    sf = H.write_tables(tmp_path / "c", rows=[(1, long), (7, long), (7, other), (None, third), (None, third), (None, long), (8, third + " x")])
    near = P.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert len({H.fingerprint(t) for t in (long, other, third)}) == 3 and (H.fingerprint(third) ^ H.fingerprint(third + " x")).bit_count() > 2
    assert sorted(((x.doc_id, x.text) for x in near.collect()), key=repr) == sorted([(1, long), (7, other), (None, third), (8, third + " x")], key=repr)
    (tmp_path / "b").mkdir()
    assert P.run(spark, H.write_tables(tmp_path / "b", rows=[], items=[])).count() == 0


def test_repeated_ids_with_other_texts(spark, tmp_path):
    """Rows of one id are judged each by their own text, in every stage, and the run's tables but the last go."""
    import os

    from sievelake.llm.common import shared_dir

    passage = H.text(900, 30)
    clean = "the river and the stone of " + H.text(5, 60)
    other = "that is for the garden " + H.text(6, 60)
    rows = [(7, f"the letter in the paper {H.text(1, 40)} {passage}"), (7, clean), (7, clean), (None, other), (8, f"in the morning {passage}")]
    sf = H.write_tables(tmp_path, rows=rows, items=[(1, passage)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = sorted(((x.doc_id, x.text) for x in P.decontamination(spark, docs, sf).collect()), key=repr)
    assert left == sorted([(7, clean), (7, clean), (None, other)], key=repr)
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(shared))
    assert sorted(map(repr, {x.doc_id for x in P.run(spark, sf).collect()})) == ["7", "None"]
    new = [x for x in set(os.listdir(shared)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{shared}/{new[0]}") == ["4-best_fit_packing"]
