"""The operators' parts against plain versions."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import helpers as H

pytest.importorskip("sievelake.llm")
from pyspark.sql import functions as F  # noqa: E402

from sievelake.llm import common, decontaminate, html, lines, packing, quality, secrets, simhash, textvec, toxicity, warc  # noqa: E402


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode("utf-8", "replace")) % 2**64 == H.fingerprint(t.encode("utf-8", "replace").decode())


def test_allocation_is_the_cheapest_and_complete():
    r = np.random.default_rng(0)
    for m in (1, 2, 3):
        cost = [np.sort(r.random((4, 50)), axis=0) for _ in range(m)]
        got = simhash.allocate(cost)
        assert (got.sum(0) == 2 - m + 1).all()
        for k in range(50):
            best = min(sum(cost[p][t + 1, k] for p, t in enumerate(ts)) for ts in itertools.product(range(-1, 3), repeat=m) if sum(ts) == 3 - m)
            assert sum(cost[p][got[p, k] + 1, k] for p in range(m)) == pytest.approx(best)


@pytest.mark.parametrize("crowd", [0, 300])
def test_links_have_the_components_of_all_pairs(spark, crowd):
    r = random.Random(crowd)
    values = {0, *(r.getrandbits(64) for _ in range(300))}
    for v in list(values)[:60]:
        for _ in range(3):
            values.add(v := v ^ 1 << r.randrange(64) ^ (1 << r.randrange(64)))
    base = r.getrandbits(64)
    values |= {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(crowd)}
    values = sorted(values)
    signed = [v - (v >> 63 << 64) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = simhash.links(frame, len(values)).collect()
    assert all(((x.a ^ x.b) % 2**64).bit_count() <= 2 or crowd for x in found)
    roots = {x.node: x.root for x in common.components(spark.createDataFrame([(x.a, x.b) for x in found], "a bigint, b bigint")).collect()}
    ours = {}
    for v in signed:
        ours.setdefault(roots.get(v, v), set()).add(v)
    theirs = {}
    for v, g in zip(signed, H.groups(values)):
        theirs.setdefault(g, set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(k, k) == (0 if k <= 200 else 1000) for k in [*range(201), *range(1000, 1200)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5), st.integers(0, 3)), max_size=60), st.integers(1, 5), st.integers(1, 4))
def test_line_scan_over_any_split(rows, size, cuts):
    """Sorted rows cut into partitions at document bounds and into small batches decide as a whole table does."""
    rows = sorted({(h, d, p) for h, d, p in rows}, key=lambda x: (x[0], -x[1], x[2]))
    bounds = sorted({0, len(rows), *(k * len(rows) // cuts for k in range(cuts))})
    bounds = sorted({next((j for j in range(b, len(rows)) if j == 0 or rows[j][:2] != rows[j - 1][:2]), len(rows)) for b in bounds})
    if not bounds or bounds[0]:
        bounds = [0, *bounds]
    seen = []
    for a, e in zip(bounds, bounds[1:]):
        part = rows[a:e]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in c], pa.int64()), pa.array([1] * len(c), pa.int64()), pa.array([x[1] or None for x in c], pa.int64()), pa.array([0] * len(c), pa.int64()), pa.array([x[2] for x in c], pa.int32())], ["h1", "h2", "d", "r", "p"]) for c in (part[k : k + size] for k in range(0, len(part), size))]
        for b in lines._scan(3)(iter(batches)):
            seen += b.to_pylist()
    gone = {(x["h1"], x["d"] or 0, x["p"]) for x in seen if x["kind"] == lines.DROP}
    stats = {}
    for x in seen:
        if x["kind"] == lines.SUMMARY:
            n, most = stats.get(x["h1"], (0, 0))
            stats[x["h1"]] = n + x["docs"], max(most, x["d"] or 0)
    gone |= {(x["h1"], x["d"] or 0, x["p"]) for x in seen if x["kind"] == lines.ROW and stats[x["h1"]][0] >= 3 and (x["d"] or 0) != stats[x["h1"]][1]}
    docs = {}
    for h, d, _ in rows:
        docs.setdefault(h, set()).add(d)
    assert gone == {(h, d, p) for h, d, p in rows if len(docs[h]) >= 3 and d != max(docs[h])}


def test_bitmaps():
    assert lines.unpack(lines.pack([0, 3, 9]), 12).tolist() == [k in (0, 3, 9) for k in range(12)]
    assert not lines.unpack(None, 3).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), min_size=10, max_size=30), st.integers(0, 40))
def test_winnowing_meets_every_shared_span(doc, item, at):
    a = np.array(doc[:at] + item + doc[at:], np.uint64) + np.uint64(1)
    b = np.array(item, np.uint64) + np.uint64(1)
    w = decontaminate.W - decontaminate.K + 1
    mine, other = (set(textvec.grams(x, 5)[decontaminate.winnow(textvec.grams(x, 5), w)].tolist()) for x in (a, b))
    assert mine & other


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_words_are_the_same_in_any_piece(data):
    inside = decontaminate.INSIDE
    old, textvec.PIECE = textvec.PIECE, 16
    try:
        a, e, h = textvec.words(data, inside)
    finally:
        textvec.PIECE = old
    a2, e2, h2 = textvec.words(data, inside)
    assert a.tolist() == a2.tolist() and e.tolist() == e2.tolist() and h.tolist() == h2.tolist()
    assert [data[x:y] for x, y in zip(a, e)] == re.findall(rb"[0-9a-z\x80-\xff]+", data)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_tokenizer(t):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    old, packing.PART = packing.PART, 20
    try:
        got = np.concatenate([packing.encoder(path)(x) for x in packing.parts(t, 20)]).tolist()
    finally:
        packing.PART = old
    assert got == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids == packing.encoder(path)(t).tolist()


def test_encoder_with_special_and_spaces():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    for t in ("a<|endoftext|>b", "two  spaces \n\n and\ttabs  ", "I'll don't  'S", "  x", "ı İ ſ K"):
        assert packing.encoder(packing.default_tokenizer())(t).tolist() == whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6))
def test_packing_is_valid_and_near_the_bound(counts):
    plan = packing.complete(counts, 20)
    total = {}
    for pattern, n in plan:
        assert sum(pattern) <= 20 and n > 0
        for s in pattern:
            total[s] = total.get(s, 0) + n
    assert total == counts
    bins = sum(n for _, n in plan)
    assert packing.lower_bound(counts, 20) <= bins <= sum(n for _, n in packing.best_fit(counts, 20))


def test_bin_completion_improves_best_fit():
    # best-fit decreasing needs 3 bins, 2 are enough: 6+4, 5+3+2
    counts = {6: 1, 5: 1, 4: 1, 3: 1, 2: 1}
    assert sum(n for _, n in packing.complete(counts, 10)) == 2
    worse = {44: 2, 24: 2, 22: 4, 21: 4, 17: 2, 8: 4, 6: 4}
    assert sum(n for _, n in packing.complete(worse, 61)) <= sum(n for _, n in packing.best_fit(worse, 61))


def test_full_bins_of_many_short_pieces():
    for counts in ({134: 42_000, 110: 14_000}, {600: 3, 1: 5000}):  # 6 x 134 + 2 x 110 is full
        plan, total = packing.complete(counts, 1024), {}
        for pattern, n in plan:
            assert sum(pattern) <= 1024
            for s in pattern:
                total[s] = total.get(s, 0) + n
        assert total == counts and sum(n for _, n in plan) == packing.lower_bound(counts, 1024)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 4), min_size=1, max_size=4))
def test_no_undominated_filling_is_left_out(counts):
    first, sizes = max(counts), sorted(counts)
    got = list(packing.all_fillings(first, counts, 20))
    for pick in itertools.product(*(range(counts[s] - (s == first) + 1) for s in sizes)):
        pieces = tuple(s for s, n in zip(reversed(sizes), reversed(pick)) for _ in range(n))
        if sum(pieces) <= 20 - first:
            assert any(fits(pieces, x) for x in got)
    assert all(first + sum(x) <= 20 and not any(x is not y and packing.fits_into(x, y) for y in got[: got.index(x)]) for x in got)


def fits(pieces, spaces):
    """Whether the pieces can be dealt to the spaces, by trying all ways."""
    return not pieces or any(pieces[0] <= x and fits(pieces[1:], (*spaces[:k], x - pieces[0], *spaces[k + 1 :])) for k, x in enumerate(spaces))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_search_of_small_problems_is_exact(pieces):
    def least(rest, rooms):
        if not rest:
            return len(rooms)
        ways = [least(rest[1:], tuple(sorted((*rooms[:k], x - rest[0], *rooms[k + 1 :])))) for k, x in enumerate(rooms) if x >= rest[0] and x not in rooms[:k]]
        return min([*ways, least(rest[1:], tuple(sorted((*rooms, 15 - rest[0]))))])

    counts = {s: pieces.count(s) for s in pieces}
    assert sum(n for _, n in packing.complete(counts, 15)) == least(sorted(pieces, reverse=True), ())


def test_slots_are_gapless():
    plan = [((5, 5, 3), 2), ((5, 4), 3), ((3,), 1)]
    s = packing.slots(plan)
    assert s["length"].tolist() == sorted(s["length"].tolist()) and len(s["rank"]) == 6


def test_entropy_matches_the_definition(spark):
    from math import log2

    r = random.Random(5)
    words = ["".join(r.choice(a) for _ in range(n)) for a, n in (("abcdef0123456789", 40), (secrets.ALPHABET, 30), ("ab1", 50), ("abc123", 21), (secrets.ALPHABET, 20), ("a", 19))]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    codes = F.transform(F.split("w", ""), lambda c: F.instr(F.lit(secrets.ALPHABET), c) - 1)
    for bits in (1.2, 2.9, 3.7):
        got = {x.w: tuple(x.hot) for x in rows.select("w", secrets.hot_range(codes, F.lit(bits)).alias("hot")).collect()}
        for w in words:
            hot = [k for k in range(len(w) - 19) if -sum(w[k : k + 20].count(c) / 20 * log2(w[k : k + 20].count(c) / 20) for c in set(w[k : k + 20])) >= bits - 1e-12]
            assert got[w] == ((hot[0], hot[-1] + 20) if hot else (-1, -1)), (w, bits)


def test_quality_stage_keeps_all_columns(spark, tmp_path):
    folder = H.write_tables(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    want = sorted(x.doc_id for x in quality.score(docs).where("kept").collect())
    assert sorted(x.doc_id for x in kept.collect()) == want


def test_warc_records_and_ranges():
    data = warc.record("7", "http://x/", b"pay\r\n\r\nload", "0" * 64, "3")
    got = warc.parse(data)
    assert (got["id"], got["type"], got["refers_to"], got["payload_bytes"]) == ("7", "revisit", "3", 11)
    with pytest.raises(ValueError, match="differs"):
        warc.parse(warc.record("7", None, b"x", "0" * 64, None))
    assert warc.ranges([0, 10, 500, 520], [10, 10, 20, 10], most=100, gap=5) == [(0, 2, 0, 20), (2, 4, 500, 30)]


def test_warc_reads_only_what_is_selected(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "page %d " % k * 40) for k in range(50)], "page_id bigint, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = warc.read(index.where("url like '%7'"), f"file://{tmp_path}/w").collect()
    assert sorted((x.url, bytes(x.payload).decode()) for x in got) == sorted((f"http://h/{k}", "page %d " % k * 40) for k in range(7, 50, 10))


@pytest.mark.parametrize(("page", "want"), [
    ("a<b>c</b> d", "ac d"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol><li>e</ul>f", "- a\n- b\n  3. c\n  9. d\n- e\n\nf"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>all</table>z", "Name       N\nlong name  1\nall\n\nz"),
    ("<table><caption>C</caption><tr><td>a<br>b<td>c</table>", "C\na  c\nb"),
    ("x<script>if (a</b) '</p>'</script>y<style>p{}</style><!-- no --><template>n</template>z", "xyz"),
    ("<div hidden>n</div><p style='DISPLAY : none'>n</p><input type=hidden value=n>v", "v"),
    ("<details><summary>S</summary>n<p>n</p></details><details open><summary>T</summary><p>y</details>", "S\nT\n\ny"),
    ("<pre>\n a  b\n  c\n</pre>d", " a  b\n  c\n\nd"),
    ("a &lt; b &amp; c &eacute;&nbsp;x &bogus;", "a < b & c é x &bogus;"),
    ("1 < 2 <3 </ >x<br>y<br><br>z", "1 < 2 <3 x\ny\n\nz"),
    ("<html><head><title>T</title><meta x></head><body>b</body></html>", "b"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ('<a href="x>y">l</a><a title=\'"\'>m</a> <a "n', "lm"),
    ("", ""), ("   ", ""), ("</p></div>x", "x"),
])
def test_layout(page, want):
    assert html.render(page) == want


@pytest.mark.parametrize("page, want", [
    ("let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be", "let x=2 be"),
    ("<math><semantics><mrow><mi>y</mi><mspace/><mn>1</mn></mrow><annotation encoding='application/x-tex'>\\y</annotation></semantics></math>z", "y1z"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math>", "1 2\n3 4"),
    ("<svg><title>n</title><desc>n</desc><defs><text>n</text></defs><path d='M0 0'/><text x=1>A <tspan>b</tspan></text><text display='none'>n</text><text>C</text></svg>d", "A b\nC\nd"),
    ("<svg><style/><title/><defs/><text>A</text></svg>d<title>n</title>e", "A\nde"),
    ("<svg><foreignObject><p>one<p>two</foreignObject></svg>d", "one\n\ntwo\n\nd"),
    ("<svg><defs><p>shown</p>d", "shown\n\nd"),
    ("<desc>a</desc><svg><a href=x/>b</a></svg>", "ab"),
    ("<head><title>T</title>Hello<p>there", "Hello\n\nthere"),
    ("<html><head>\n<title>T</title> <meta x>\n</head>b", "b"),
])
def test_formulas_drawings_and_open_heads(page, want):
    assert html.render(page) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<svg> </svg> <math> </math> <text> </text> <title/> <style/> <defs> <desc> </desc> <foreignObject> <mi> </mi> <mtd> <annotation> <p> </p> <table> <td> </table> <pre> </pre> <details> <summary> </details> <head> x".split()), max_size=40))
def test_any_foreign_markup_is_balanced(parts):
    page, depth = " ".join(parts), 0
    for kind, *_ in html.events(page):
        depth += {"start": 1, "end": -1, "text": 0}[kind]
        assert depth >= 0
    assert depth == 0
    html.render(page)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <li> <ul> </ul> <td> <tr> <table> </table> </td> x <b> </b> <pre> </pre> <details> </details> <summary> <caption> </caption> <dd> < &amp; <!-- --> <head> <body> <title> </title> <script> </script> <option> <select> <blockquote> </blockquote>".split()), max_size=40))
def test_any_markup_is_rendered(parts):
    html.render(" ".join(parts))


def test_deep_and_hostile_markup():
    for page in ("<div>" * 20000 + "x", "<ul><li>" * 300 + "x", '<a "' * 5000, "<" * 20000, "<table><tr><td>" * 200 + "x"):
        html.render(page)


def test_grammar_composes_to_what_its_parts_do():
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.scoring()]
    whole, r = toxicity.grammar(), random.Random(1)
    for _ in range(300):
        symbols = [r.choice("ITYNRO") for _ in range(12)]
        out, weights = symbols, [1.0] * 12
        for t in parts:
            step = t.run(out)
            out, weights = [x for x, _ in step], [a * w for a, (_, w) in zip(weights, step)]
        assert whole.run(symbols) == list(zip(out, weights))


def test_negated_and_reported_insults_weigh_less():
    s = toxicity.Scorer({})
    plain, directed, negated, told = (dict(zip(s.NAMES, s.features(t))) for t in ("the idiot came.", "you are an idiot.", "he came, not an idiot.", "she said that the old idiot came."))
    assert plain["I"] > 0 and directed["D"] > 0 and directed["I"] == 0
    assert negated["I"] == 0 and negated["w"] > 0 and told["I"] == told["D"] == 0 and told["w"] > 0
