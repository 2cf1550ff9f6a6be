"""Ids of other types, repeated ids, hot groups, crowded buckets."""

import random

import pytest

from . import helpers as H

pytest.importorskip("sievelake.llm")
from pyspark.sql import functions as F  # noqa: E402

from sievelake.llm import common, decontaminate, lines, secrets, simhash  # noqa: E402

LONG = "a line that is long enough to be counted"


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "int", "timestamp", "double"])
def test_lines_with_ids_of_any_type(spark, kind):
    rows = [r for r in H.documents() if r[0] < 40 or r[0] >= 70] + [(None, LONG), (None, f"x\n{LONG}"), (90, LONG), (91, LONG), (92, f"{LONG}\ny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = F.lpad(F.col("doc_id").cast("string"), 5, "0") if kind == "string" else F.timestamp_seconds("doc_id") if kind == "timestamp" else F.col("doc_id").cast(kind)
    plain = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(docs).collect()}
    back = F.unix_timestamp("doc_id") if kind == "timestamp" else F.col("doc_id").cast("bigint")
    got = lines.report(docs.withColumn("doc_id", key))
    assert got.schema["doc_id"].dataType.simpleString() == kind
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.withColumn("doc_id", back.cast("bigint")).collect()}
    assert got == plain and sum(x[2] for x in got) > 5
    out = lines.deduplicated(docs.withColumn("doc_id", key))
    assert out.columns == ["doc_id", "text"] and out.count() == len(rows)


def test_an_empty_string_is_an_id(spark):
    docs = spark.createDataFrame([("", LONG), ("a", LONG), (None, LONG), ("", "other " + LONG)], "doc_id string, text string")
    assert {(r.doc_id, r.n_dropped) for r in lines.report(docs).collect()} == {("", 1), ("", 0), ("a", 0), (None, 1)}


def test_decontamination_of_repeated_ids(spark):
    passage = H.text(900, 30)
    rows = [(7, f"{H.text(1, 30)} {passage}"), (7, H.text(2, 40)), (7, H.text(2, 40)), (None, passage), (None, "clean words"), (8, None), (9, passage), (9, passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (2, passage), (None, passage), (3, "short item here")], "item_id bigint, text string")
    left = sorted(((x.doc_id, x.text) for x in decontaminate.clean_documents(docs, items).collect()), key=repr)
    assert left == sorted([(7, H.text(2, 40)), (7, H.text(2, 40)), (None, "clean words"), (8, None)], key=repr)
    assert {(x.doc_id, x.n_items) for x in decontaminate.report(docs, items).collect() if x.contaminated} == {(7, 2), (None, 2), (9, 2)}


def test_a_passage_of_many_items_meets_a_document_once(spark):
    passage = H.text(900, 12)
    docs = spark.createDataFrame([(1, passage), (2, f"{passage} {passage}"), (3, "nothing of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, passage) for k in range(300)] + [(1000, f"{passage} {H.text(5, 9)}")], "item_id bigint, text string")
    got = {x.doc_id: (x.n_hit, x.items) for x in decontaminate.contamination(docs, items).collect()}
    assert got[1][0] == 12 and got[2][0] == 24 and got[3] == (0, [])
    assert got[1][1] == got[2][1] == sorted([*map(str, range(300)), "1000"])


@pytest.mark.parametrize("hot", [2, 10**6])
def test_groups_are_joined_whole_whatever_their_size(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(k % 7 if k < 900 else k, k) for k in range(1000)], "g bigint, v bigint")
    groups = rows.groupBy("g").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    got = common.join_groups(rows, common.cut(groups), "g", "n")
    sums = {r.g: r.s for r in groups.collect()}
    assert got.columns == ["g", "v", "s"] and sorted((r.v, r.s) for r in got.collect()) == sorted((k, sums[k % 7 if k < 900 else k]) for k in range(1000))


def test_links_of_a_crowded_bucket_are_near(spark):
    """The one-part allocation's links too are of two bits or fewer, and few for each value."""
    r = random.Random(5)
    base = r.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(500)})
    frame = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp bigint")
    found = simhash.links(frame, len(values)).collect()
    assert found and all(((x.a ^ x.b) % 2**64).bit_count() <= 2 for x in found) and len(found) <= 65 * len(values)


def test_many_matches_in_one_text(spark):
    """50,000 matches in a text, with places by definition; and candidates among them."""
    text = " ".join(f"secret={'k%05d' % k} 9f8a7b6c5d4e3f2a1b0c9d8e" if k % 5 == 0 else f"token: abc{k:05d}" for k in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "z"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    import re

    want = []
    for k, (_, p, g, n) in enumerate(secrets.KINDS):
        want += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
    assert sorted((x.start, x.kind, x.end) for x in got[1].base) == sorted(want) and len(want) >= 50_000
    assert got[1].extra == [] and got[2].base == got[3].base == []


def test_warc_ids_of_any_text_and_cleared_folders(spark):
    import os

    from sievelake.llm import warc

    ids = ["a\r\nb", "100%", " x ", "é:y", "", "a\nWARC-Type: revisit", "%0D"]
    rows = [(i, f"http://h/\n{k}", f"page {k % 5} " * 40) for k, i in enumerate(ids)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    shared = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(shared))
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert set(got) == {*ids, None} and len(got) == len(rows)
    for k in (0, 1):
        first, again = sorted(i for i, _, h in rows if h and h.startswith(f"page {k} "))
        assert got[first].record_type == "response" and got[again].record_type == "revisit" and got[again].refers_to == first
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("warc-")]


def test_warc_reads_by_the_length_of_records(spark, tmp_path):
    from sievelake.llm import warc

    pages = spark.createDataFrame([(k, f"u{k}", H.text(k, 200)) for k in range(300)], "page_id bigint, url string, html string").repartition(2)
    index = warc.write(pages, f"file://{tmp_path}/w")
    back = warc.read(index, f"file://{tmp_path}/w", payloads=False, block=20_000)
    assert back.rdd.getNumPartitions() == -(-sum(r.length for r in index.collect()) // 20_000) > 4
    assert sorted(int(r.id) for r in back.collect()) == list(range(300))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_quality_rules_keep_other_scripts_and_languages(spark):
    from sievelake.llm import quality

    russian = " ".join(f"Старый город стоит на берегу широкой реки номер {k} и помнит много разных событий." for k in range(9))
    thai = " ".join(f"ประเทศไทยมีภูมิประเทศหลากหลายและวัฒนธรรมเก่าแก่มากแห่งหนึ่ง{k}" for k in range(60))
    polish = " ".join(f"Rzeka płynie {k} razy przez stare miasto, że nikt nie wie, skąd się bierze jej woda." for k in range(9))
    turkish = " ".join(f"Eski şehir {k} yıl önce bir nehir ve dağ için kuruldu, bu yüzden herkes onu bilir." for k in range(9))
    noise = " ".join(f"qzx{k} vbnm{k} lkjh{k} poiu{k}" for k in range(20))
    rows = [(1, russian), (2, thai), (3, polish), (4, turkish), (5, noise), (6, None), (7, "")]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k].failed_rules for k in (1, 2, 3, 4)] == [[]] * 4 and got[5].failed_rules == ["stop_words"]
    assert all(got[k].kept != got[k].base_failed for k in (1, 2, 3, 4)) and not got[6].kept and not got[7].kept
