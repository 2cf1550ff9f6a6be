"""Layout-aware text of HTML pages.

A tokenizer and a tree builder turn the markup, however broken, into balanced
start and end events: void elements, implied end tags (p, li, dt, dd, options,
table parts), stray end tags, raw text. Rules of visibility drop what a browser
doesn't show: head, scripts, styles, templates, hidden and display:none
subtrees, closed details and dialogs, comments, and in SVG and MathML titles,
definitions and annotations. A layout engine fed by the events emits
all other text: blocks on lines of their own, blank lines round paragraphs,
headings, lists and tables, list markers with nested indents, preformatted text
as it is, and table cells padded to their columns, with column and row spans as
HTML defines them (spans of over 1000 columns or 65534 rows are of that many);
formulas are inline, each text of a drawing and row of a formula has a line of its
own. It keeps stacks instead of recursing, and of each name the places of its open
elements, so a tag costs the same at any depth. Layout has limits, text has none:
indents stop growing at MAX_INDENT, alignment at columns of MAX_WIDTH and lines of
MAX_LINE, and tables inside MAX_TABLES others are set as plain rows.

Edge cases: a null page gives null text, an empty one empty text; text outside
any tag is shown, and ends an open head; an unclosed tag at the end is dropped; repeated rows are
rendered each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import slices

# Element names by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas".split())
#: Elements that are not shown inside svg and math; self-closing tags end there.
FOREIGN_HIDDEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Inside svg and math these hold HTML again.
INTEGRATION = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
#: Start tags that end an open svg or math.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike"
    " sub sup table tt u ul var".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol p pre search section summary table ul tr caption option".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
CLOSES_P = BLOCK - frozenset("body html option tr caption legend summary".split())
#: A start tag of the key ends open elements of the values, up to the barrier elements.
IMPLIED = {
    "li": ("li", frozenset("ul ol menu dir".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])),
    "option": ("option", frozenset("select datalist".split())), "optgroup": ("option optgroup", frozenset(["select"])),
    "tr": ("tr td th caption", frozenset(["table"])), "td": ("td th", frozenset("tr table".split())), "th": ("td th", frozenset("tr table".split())),
    "thead": ("tr td th thead tbody tfoot caption colgroup", frozenset(["table"])), "tbody": ("tr td th thead tbody tfoot caption colgroup", frozenset(["table"])),
    "tfoot": ("tr td th thead tbody tfoot caption colgroup", frozenset(["table"])),
}
IMPLIED = {k: (frozenset(v.split()), b) for k, (v, b) in IMPLIED.items()}
#: An end tag doesn't close anything beyond these.
SCOPE = frozenset("table td th caption html template".split())
LISTS = frozenset("ul ol menu dir".split())
#: Blanks up to which nested blocks are indented, columns and lines are padded; nested tables that are aligned; cells that reach down at once.
MAX_INDENT, MAX_WIDTH, MAX_LINE, MAX_TABLES, MAX_DOWN = 200, 500, 2000, 50, 1000
#: The most columns and rows of a cell.
MAX_COLUMNS, MAX_ROWS = 1000, 65534

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<decl>[!?][^>]*(?:>|\Z))|(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
#: A tag with a quote that isn't closed ends at the next >.
LOOSE = re.compile(r"<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
NO_SHOW = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def tokens(page: str, foreign: list[str]) -> Iterator[tuple[str, str, dict]]:
    """('text' | 'start' | 'end', text or name, attributes); a tag's closing slash is the attribute "/". foreign[0]: what the last start tag is in, set by the reader."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", _text(page[at:]), {}
            return
        m = TAG.match(page, lt)
        if lt > at:
            yield "text", _text(page[at:lt]), {}
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
                yield "text", "<", {}
                at = lt + 1
                continue
            gt = page.find(">", lt)
            if gt < 0:
                return  # cut off inside a tag
            m = LOOSE.match(page, lt)
            if not m:
                at = gt + 1  # like </3>: a bogus comment
                continue
        at, found = m.end(), m.groupdict()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if m["slash"]:
            yield "end", name, {}
            continue
        attrs = m["attrs"]
        found = {}
        if attrs and not attrs.isspace():
            at_attr = 0
            for a in ATTR.finditer(attrs):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
                found.setdefault(a[1].lower(), _text(value) if value else "")
                at_attr = a.end()
            if attrs.endswith("/") and at_attr < len(attrs):
                found["/"] = ""
        yield "start", name, found
        if (name in RAW or name in ESCAPABLE_RAW) and not (foreign[0] and "/" in found):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : end.start() if end else n]
            yield "text", raw if name in RAW else _text(raw), {}
            at = end.start() if end else n


def _text(s: str) -> str:
    return unescape(s) if "&" in s else s


def hidden(name: str, attrs: dict, space: str = "") -> bool:
    if space and (name in FOREIGN_HIDDEN[space] or attrs.get("display", "").strip() == "none" or attrs.get("visibility", "").strip() in ("hidden", "collapse")):
        return True
    if name in HIDDEN or "hidden" in attrs and attrs["hidden"].lower() != "until-found":
        return True
    if name == "input" and attrs.get("type", "").lower() == "hidden" or name == "dialog" and "open" not in attrs:
        return True
    return bool((style := attrs.get("style")) and NO_SHOW.search(style))


def events(page: str) -> Iterator[tuple[str, str, dict, str]]:
    """Balanced events: what the tokenizer gives, with implied ends; the last item is svg or math for their elements."""
    stack: list[str] = []
    spaces: list[str] = []  # of each open element: svg or math for its children, empty for HTML
    own: list[str] = []  # the same for the element itself
    html_at: list[int] = []  # places of open elements whose children are HTML
    at: dict[str, list[int]] = {}  # of each name: where its open elements are in the stack
    foreign = [""]

    def close(k: int) -> Iterator[tuple[str, str, dict, str]]:
        while len(stack) > k:
            if not spaces.pop():
                html_at.pop()
            at[stack[-1]].pop()
            yield "end", stack.pop(), {}, own.pop()

    def put(x: str, inside: str, space: str) -> None:
        at.setdefault(x, []).append(len(stack))
        if not inside:
            html_at.append(len(stack))
        stack.append(x)
        spaces.append(inside)
        own.append(space)

    def innermost(names: frozenset) -> int:
        return max((at[n][-1] for n in names if at.get(n)), default=-1)

    def find(names: frozenset, barrier: frozenset) -> int:
        """The outermost open element of names inside the innermost barrier, or -1."""
        inside, best = innermost(barrier), len(stack)
        for n in names:
            if places := at.get(n):
                k = bisect_right(places, inside)
                if k < len(places):
                    best = min(best, places[k])
        return best if best < len(stack) else -1

    p, head, html = frozenset(["p"]), frozenset(["head"]), frozenset(["html"])
    stop = frozenset("table td th caption html body button".split())
    for kind, x, attrs in tokens(page, foreign):
        if kind == "text":
            if stack and stack[-1] == "head" and x.strip(" \t\n\r\f"):
                yield from close(len(stack) - 1)
            yield kind, x, attrs, ""
        elif kind == "start":
            if spaces and spaces[-1] and x in BREAKOUT:
                yield from close(html_at[-1] + 1 if html_at else 0)
            foreign[0] = space = x if x in FOREIGN_HIDDEN else spaces[-1] if spaces else ""
            if space and x not in FOREIGN_HIDDEN:
                yield kind, x, attrs, space
                if "/" in attrs:
                    yield "end", x, {}, space
                else:
                    put(x, "" if x in INTEGRATION[space] else space, space)
                continue
            if x in ("html", "body", "head") and at.get(x):
                continue
            if x == "body" and (k := find(head, html)) >= 0 or x not in HIDDEN and x not in ("html", "head") and stack and stack[-1] == "head" and (k := len(stack) - 1) >= 0:
                yield from close(k)
            if x in IMPLIED and (k := find(*IMPLIED[x])) >= 0:
                yield from close(k)
            if x in CLOSES_P and at.get("p") and (k := find(p, stop)) >= 0:
                yield from close(k)
            yield kind, x, attrs, space
            if x in VOID or space and "/" in attrs:
                yield "end", x, {}, space
            else:
                put(x, space, space)
        elif x == "br":
            yield "start", "br", {}, ""
            yield "end", "br", {}, ""
        elif at.get(x) and x not in ("html", "body") and (x == "table" or at[x][-1] > innermost(SCOPE - {x} if x in SCOPE else SCOPE)):
            yield from close(at[x][-1])
    yield from close(0)


class Flow:
    """Lines of one flow (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.buf: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = 0
        self.marker: str | None = None

    def text(self, s: str) -> None:
        if not s:
            return
        words = SPACE.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.buf)
            return
        if words[0] == " ":
            self.space = self.space or bool(self.buf)
            words = words[1:]
        if self.space:
            self.buf.append(" ")
        self.space = words[-1] == " "
        self.buf.append(words[:-1] if self.space else words)

    def flush(self) -> None:
        if self.buf:
            self.put("".join(self.buf))
            self.buf = []
        self.space = False

    def put(self, line: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.marker or "").ljust(min(self.indent, MAX_INDENT)) + line)
        self.marker = None

    def rest(self, gap: int) -> None:
        """Ends the line; gap 2 asks for a blank one before the next."""
        self.flush()
        self.gap = max(self.gap, gap)

    def br(self) -> None:
        if self.buf:
            self.flush()
        elif self.lines and self.gap < 2:
            self.lines.append("")

    def pre(self, s: str) -> None:
        self.flush()
        for line in s.split("\n"):
            self.put(line.rstrip("\r"))

    def result(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def span_of(value: str | None, most: int, least: int = 1) -> int:
    """A span as HTML reads it: leading digits, clamped; 1 if there are none."""
    m = re.match(r"[ \t\n\r\f]*\+?([0-9]+)", value or "")
    if not m:
        return 1
    digits = m[1].lstrip("0")
    return max(least, most if len(digits) > 9 else min(most, int(digits or 0)))


def placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, end column, text) of each row's cells; cells that reach down from rows above take their columns first. A row span of 0 reaches to the end."""
    down: list[tuple[int, int, int]] = []  # columns and the row before which it ends
    out = []
    for r, row in enumerate(rows):
        down = sorted(x for x in down if x[2] > r)
        here, c, k, more = [], 0, 0, []
        for text, span, deep in row:
            while k < len(down) and down[k][0] <= c:  # a cell begins at the next free column
                c = max(c, down[k][1])
                k += 1
            here.append((c, c + span, text))
            if deep != 1 and len(down) + len(more) < MAX_DOWN:
                more.append((c, c + span, r + deep if deep else len(rows)))
            c += span
        down += more
        out.append(here)
    return out


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Table rows as lines; cells are padded to their column, two blanks apart, and may have several lines. Columns in which no cell begins have no width."""
    cells = [[(a, e, text.split("\n")) for a, e, text in row] for row in placed(rows)]
    starts = sorted({a for row in cells for a, _, _ in row})
    cells = [[(bisect_left(starts, a), bisect_left(starts, e), text) for a, e, text in row] for row in cells]
    widths = [0] * len(starts)
    for row in cells:
        for a, e, text in row:
            if e - a == 1:
                widths[a] = max(widths[a], min(MAX_WIDTH, max(map(len, text))))
    for a, e, text in sorted((x for row in cells for x in row if x[1] - x[0] > 1), key=lambda x: (x[1] - x[0], x[0])):  # a spanning cell widens its last column if it must
        widths[e - 1] += max(0, min(MAX_WIDTH, max(map(len, text))) - sum(widths[a:e]) - 2 * (e - a - 1))
    left = [0]
    for w in widths:
        left.append(min(MAX_LINE, left[-1] + w + 2))
    out = []
    for row in cells:
        for k in range(max((len(text) for _, _, text in row), default=0)):
            line = ""
            for a, _, text in row:
                if k < len(text) and text[k]:
                    line = line.ljust(max(left[a], len(line) + 2) if line else left[a]) + text[k]
            out.append(line.rstrip())
    return [x for x in out if x]


def render(page: str) -> str:
    """The visible text of a page."""
    flows, tables, lists = [Flow()], [], []
    hide = 0  # depth inside a hidden element
    pre = 0
    details: list[list] = []  # of each open one: whether it is closed to the reader, and how deep inside its children we are
    for kind, x, attrs, space in events(page):
        flow = flows[-1]
        if kind == "text":
            if hide or details and details[-1][0] and not details[-1][1]:
                continue
            if pre:
                flow.buf.append(x)
            elif not (tables and tables[-1]["depth"] == len(flows)):  # text between cells isn't laid out
                flow.text(x)
            elif x.strip(" \t\n\r\f"):
                flow.text(x)
            continue
        if kind == "start":
            if hide or hidden(x, attrs, space):
                hide += 1
                continue
            if details and details[-1][0] and x != "summary" and details[-1][1] == 0:
                hide += 1
                continue
            if details:
                details[-1][1] += 1
            if space:
                if pre:
                    continue
                if x in ("text", "mtr", "mlabeledtr") or x == "math" and attrs.get("display", "").lower() == "block":
                    flow.rest(1)
                elif x == "mtd":
                    flow.text(" ")
                continue
            if x == "br":
                flow.br()
            elif x == "table":
                flow.rest(2)
                tables.append({"rows": [], "cell": None, "depth": len(flows), "caption": None, "flat": len(tables) >= MAX_TABLES})
            elif x in ("tr", "td", "th", "caption") and tables and tables[-1]["flat"]:
                flow.text(" ")
                if x in ("tr", "caption"):
                    flow.rest(1)
            elif x == "tr":
                if tables:
                    tables[-1]["rows"].append([])
            elif x in ("td", "th", "caption") and tables:
                flows.append(Flow())
                tables[-1]["cell"] = span_of(attrs.get("colspan"), MAX_COLUMNS), span_of(attrs.get("rowspan"), MAX_ROWS, 0)
            elif x in LISTS:
                flow.rest(1 if lists else 2)
                start = attrs.get("start", "1")
                lists.append([x, int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 10 else 1, flow.indent])
            elif x == "li":
                flow.rest(1)
                base = lists[-1][2] if lists else 0
                if lists and lists[-1][0] == "ol":
                    value = attrs.get("value", "")
                    if value.isascii() and value.isdigit() and len(value) < 10:
                        lists[-1][1] = int(value)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    mark = "- "
                flow.marker, flow.indent = " " * min(base, MAX_INDENT) + mark, base + len(mark)
            elif x == "dd":
                flow.rest(1)
                flow.indent += 4
            elif x == "blockquote":
                flow.rest(2)
                flow.indent += 2
            elif x == "pre":
                flow.rest(2)
                pre += 1
            elif x == "option":
                flow.rest(1)
            elif x in BLOCK:
                flow.rest(2 if x in SPACED else 1)
            if x == "details":
                details.append(["open" not in attrs, 0])
            continue
        # an end
        if hide:
            hide -= 1
            continue
        if x == "details" and details:
            details.pop()
        if details:
            details[-1][1] -= 1
        if space:
            if x in ("text", "mtr", "mlabeledtr") and not pre:
                flow.rest(1)
            continue
        if x == "table" and tables:
            table = tables.pop()
            flow.flush()
            if table["flat"]:
                flow.rest(2)
                continue
            rows = table["rows"]
            if table["caption"]:
                for line in table["caption"].split("\n"):
                    flow.put(line)
            for line in grid(rows):
                flow.put(line)
            flow.rest(2)
        elif x in ("td", "th", "caption") and tables and len(flows) > tables[-1]["depth"]:
            done = flows.pop().result()
            if x == "caption":
                tables[-1]["caption"] = done
            else:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1]["rows"][-1].append((done, *(tables[-1]["cell"] or (1, 1))))
        elif x in LISTS:
            flow.rest(1 if len(lists) > 1 else 2)
            if lists:
                flow.indent = lists.pop()[2]
            flow.marker = None
        elif x == "li":
            flow.rest(1)
            flow.marker = None
            flow.indent = lists[-1][2] if lists else 0
        elif x == "dd":
            flow.rest(1)
            flow.indent = max(0, flow.indent - 4)
        elif x == "blockquote":
            flow.rest(2)
            flow.indent = max(0, flow.indent - 2)
        elif x == "pre":
            pre -= 1
            raw, flow.buf, flow.space = "".join(flow.buf), [], False
            if raw := raw.removeprefix("\n"):
                flow.pre(raw.rstrip("\n"))
            flow.rest(2)
        elif x in BLOCK:
            flow.rest(2 if x in SPACED else 1)
    while len(flows) > 1:  # events are balanced; this is for cells outside tables only
        rest = flows.pop().result()
        flows[-1].text(rest)
    return flows[0].result()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else render(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {picked.schema['page_id'].dataType.simpleString()}, text string")
