"""The renderer against plain versions: a tree builder that walks its stack, a table laid on a grid cell by cell, a recursive renderer of well-formed trees."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("sievelake.llm")
from sievelake.llm import html  # noqa: E402


def plain_events(page):
    """What html.events gives, every search by walking over the open elements."""
    stack, out, foreign = [], [], [""]  # of (name, own space, space of the children)

    def close(k):
        while len(stack) > k:
            name, own, _ = stack.pop()
            out.append(("end", name, own))

    def outermost(names, barrier):
        best = -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in barrier:
                break
            if stack[k][0] in names:
                best = k
        return best

    for kind, x, attrs in html.tokens(page, foreign):
        names = [s[0] for s in stack]
        if kind == "text":
            if names[-1:] == ["head"] and x.strip(" \t\n\r\f"):
                close(len(stack) - 1)
            out.append(("text", x, ""))
        elif kind == "start":
            if stack and stack[-1][2] and x in html.BREAKOUT:
                while stack and stack[-1][2]:
                    close(len(stack) - 1)
            space = foreign[0] = x if x in html.FOREIGN_HIDDEN else stack[-1][2] if stack else ""
            if space and x not in html.FOREIGN_HIDDEN:
                out.append(("start", x, space))
                if "/" in attrs:
                    out.append(("end", x, space))
                else:
                    stack.append((x, space, "" if x in html.INTEGRATION[space] else space))
                continue
            if x in ("html", "body", "head") and x in [s[0] for s in stack]:
                continue
            if x == "body" and (k := outermost({"head"}, {"html"})) >= 0:
                close(k)
            elif x not in html.HIDDEN | {"html", "head"} and stack and stack[-1][0] == "head":
                close(len(stack) - 1)
            if x in html.IMPLIED and (k := outermost(*html.IMPLIED[x])) >= 0:
                close(k)
            if x in html.CLOSES_P and (k := outermost({"p"}, set("table td th caption html body button".split()))) >= 0:
                close(k)
            out.append(("start", x, space))
            if x in html.VOID or space and "/" in attrs:
                out.append(("end", x, space))
            else:
                stack.append((x, space, space))
        elif x == "br":
            out += [("start", "br", ""), ("end", "br", "")]
        elif x in names and x not in ("html", "body"):
            if x == "table" or outermost({x}, html.SCOPE - {x}) >= 0:
                close(max(k for k, n in enumerate(names) if n == x))
    close(0)
    return out


TAGS = "p div b li ul ol dl dt dd table tr td th tbody caption select option head body html title svg math text mi foreignObject desc blockquote span button br hr template".split()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ["x", "<g/>"]), max_size=50))
def test_events_are_those_of_a_walk(parts):
    page = "".join(parts)
    assert [(k, x, s) for k, x, _, s in html.events(page)] == plain_events(page)


def plain_grid(rows):
    """Cells on a matrix, one square at a time."""
    taken, where = set(), []
    for r, row in enumerate(rows):
        c = 0
        for text, span, deep in row:
            while (r, c) in taken:
                c += 1
            below = r + deep if deep else len(rows)
            taken |= {(y, x) for y in range(r, min(below, len(rows))) for x in range(c, c + span)}
            where.append((r, c, c + span, text))
            c += span
    starts = sorted({c for _, c, _, _ in where})
    where = [(r, [k for k, s in enumerate(starts) if c <= s < e], text.split("\n")) for r, c, e, text in where]
    widths = [0] * len(starts)
    for _, columns, lines in where:
        if len(columns) == 1:
            widths[columns[0]] = max(widths[columns[0]], max(map(len, lines)))
    for _, columns, lines in sorted((x for x in where if len(x[1]) > 1), key=lambda x: (len(x[1]), x[1][0])):
        room = sum(widths[k] for k in columns) + 2 * (len(columns) - 1)
        widths[columns[-1]] += max(0, max(map(len, lines)) - room)
    out = []
    for r in range(len(rows)):
        cells = {columns[0]: lines for y, columns, lines in where if y == r}
        for k in range(max((len(x) for x in cells.values()), default=0)):
            out.append("  ".join((cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(0 if c not in cells else widths[c]) if c in cells else " " * widths[c] for c in range(len(starts))))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc\nd", "", "eeee"]), st.just(1), st.integers(0, 3)), max_size=4), max_size=5))
def test_row_spans_against_a_matrix(rows):
    want = [x.rstrip() for x in plain_grid(rows)]
    assert html.grid(rows) == [x for x in want if x]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc", "eeee eeee eeee"]), st.integers(1, 3), st.integers(0, 3)), max_size=4), max_size=5))
def test_cells_begin_where_a_matrix_has_them(rows):
    taken, want = set(), []
    for r, row in enumerate(rows):
        c, here = 0, []
        for text, span, deep in row:
            while (r, c) in taken:
                c += 1
            taken |= {(y, x) for y in range(r, len(rows) if not deep else r + deep) for x in range(c, c + span)}
            here.append((c, c + span, text))
            c += span
        want.append(here)
    assert html.placed(rows) == want
    lines = html.grid(rows)
    assert [w for line in lines for w in line.split()] == [w for row in rows for text, _, _ in row for w in text.split()]
    at = {}  # cells that begin in one column are set at one place
    for row, line in zip([x for x in want if x], lines):
        place = 0
        for c, _, text in row:
            place = line.index(text, place)
            assert at.setdefault(c, place) == place
            place += len(text)


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<td rowspan=0>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd     e"),
    ("<table><tr><td colspan=20000>all<tr><td>x<td>y</table>", "all\nx  y"),
    ("<table><tr><td colspan=99999999999999999999>all<td>z</table>", "all  z"),
    ("<table><tr><td colspan=' 2x'>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td colspan=-2>a<td colspan=0>b</table>", "a  b"),
])
def test_spans(page, want):
    assert html.render(page) == want


def tree(r, depth=0):
    """A random well-formed tree as (name, children) and words."""
    kids = []
    for _ in range(r.randrange(1, 4)):
        kids.append(tree(r, depth + 1) if depth < 4 and r.random() < 0.6 else f"w{r.randrange(100)}")
    name = r.choice(["div", "p", "b", "ul", "section", "blockquote", "i"]) if depth else "div"
    if name == "p":
        kids = [k for k in kids if isinstance(k, str)] or ["w"]
    if name in ("b", "i"):
        kids = [k if isinstance(k, str) else "w" for k in kids]
    return name, kids


def markup(node):
    if isinstance(node, str):
        return node
    name, kids = node
    inner = " ".join(f"<li>{markup(k)}</li>" if name == "ul" else markup(k) for k in kids)
    return f"<{name}>{inner}</{name}>"


def plain_lines(node):
    """Lines of a tree, recursively: (gap asked before, line), the gap after."""
    spaced = {"p", "ul", "blockquote"}

    def flow(items):
        out, buf, gap = [], [], 0

        def flush():
            nonlocal buf
            if buf:
                out.append((pending[0], " ".join(buf)))
                pending[0], buf = 0, []

        pending = [0]
        for x in items:
            if isinstance(x, str) or x[0] in ("b", "i"):
                buf += [x] if isinstance(x, str) else x[1]
                continue
            name, kids = x
            gap = 2 if name in spaced else 1
            flush()
            pending[0] = max(pending[0], gap)
            if name == "ul":
                for k in kids:
                    pending[0] = max(pending[0], 1)
                    lines, after = flow([k])
                    for n, (g, line) in enumerate(lines):
                        out.append((max(g, pending[0]) if n == 0 else g, ("- " if n == 0 else "  ") + line))
                        pending[0] = 0
                    pending[0] = max(pending[0], after, 1)
            else:
                lines, after = flow(kids)
                for n, (g, line) in enumerate(lines):
                    out.append((max(g, pending[0]) if n == 0 else g, ("  " if name == "blockquote" else "") + line))
                    pending[0] = 0
                pending[0] = max(pending[0], after)
            pending[0] = max(pending[0], gap)
        flush()
        return out, pending[0]

    return flow([node])[0]


def nested_list(node, inside=False):
    if isinstance(node, str):
        return False
    return node[0] == "ul" and inside or any(nested_list(k, inside or node[0] == "ul") for k in node[1])


def test_trees_against_a_recursive_renderer():
    r, n = random.Random(3), 0
    while n < 400:
        t = tree(r)
        if nested_list(t):  # these are set without a blank line; test_layout has them
            continue
        n += 1
        want = []
        for gap, line in plain_lines(t):
            want += [""] * (gap > 1 and bool(want)) + [line]
        assert html.render(markup(t)) == "\n".join(want), markup(t)


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x" + "</div>" * 100_000,
    "<p><b><i><span>" * 25_000 + "x" + "</span></i></b></p>" * 25_000,
    "<ul><li>" * 50_000 + "x" + "</li></ul>" * 50_000,
    "<blockquote>y" * 50_000 + "</blockquote>" * 50_000,
    "<table><tr><td>y" * 50_000 + "</td></tr></table>" * 50_000,
    "<svg><g>" * 50_000 + "<text>x</text>" + "</g></svg>" * 50_000,
    "<table>" + "<tr><td rowspan=65534>x" * 20_000 + "</table>",
    "<table><tr>" + f"<td>{'w' * 600}" * 1000 + "<tr><td colspan=999>a<td>b" * 5000 + "</table>",
    "<b>" * 100_000 + "x" + "</i>" * 100_000,
])
def test_deep_and_closed_markup_in_linear_time(page):
    began = time.perf_counter()
    text = html.render(page)
    assert text.strip() and len(text) < 100 * len(page) and time.perf_counter() - began < 20
