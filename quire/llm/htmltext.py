"""Layout-aware rendering of HTML: all visible text, with block spacing, list markers and aligned table cells.

A tokenizer and a tree builder with implied tags (html, head, body, tbody, tr; unclosed p, li, dt, dd, option, cells and rows)
make a tree; visibility rules drop what a browser doesn't show: head, scripts, templates, `hidden`, closed dialogs, all but the
summary of closed `details`, and what `display` and `visibility` hide. These two are read from inline styles and style sheets, by
importance, specificity and order; selectors may be made of tags, classes, ids, attributes (present or equal), descendants and
children, and rules with other selectors are left out. `display:none` takes all that is inside, `visibility` is inherited. The
rest is laid out: paragraphs, headings, lists and tables stand apart by an empty line, other blocks by a line end, `pre` keeps its
white space, `ol` counts, nested lists are indented, and table cells begin at their column. A column is as wide as its longest
cell, but 60 characters at most, so that padding stays bounded: after a longer cell the row goes on in the next line, still in
the next cell's column.

Defined cases: null gives null; an empty page or one without visible text gives an empty string; a tag that never ends hides the
rest, as in browsers; nothing recurses, so depth is not limited. Repeated rows are rendered each for itself.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$(?![\s\S])))", re.S)
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+)>"""
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"""(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\])*)""")
_SIMPLE = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
_STEP = re.compile(r"\s*>\s*|\s+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen frame".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
HEAD = frozenset("title meta link style script base noscript template".split())
NEVER = frozenset("head title script style template noscript iframe noembed noframes object applet audio video canvas datalist svg math textarea select".split()) - {"textarea", "select"}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre listing section summary table ul".split()
)
SCOPE = frozenset("html table td th caption marquee object template button applet body".split())
SPECIAL = (CLOSES_P | SCOPE | frozenset("tr tbody thead tfoot colgroup select option".split())) - {"p"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre listing figure menu dir".split())
BLOCK = CLOSES_P | frozenset("body html tr caption option optgroup legend tbody thead tfoot search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CAP = 60


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Builder:
    """Builds the tree; open elements are on a stack."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.body: Node | None = None
        self.sheets: list[str] = []

    def open(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        return node

    def start_body(self) -> None:
        if self.body is None:
            del self.stack[1:]
            self.body = self.open("body", {})

    def find(self, tags, stops=SCOPE) -> int:
        """Depth of the nearest open element of `tags`, or -1 if one of `stops` is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stops:
                return -1
        return -1

    def close(self, tags, stops=SCOPE) -> bool:
        if (i := self.find(tags, stops)) > 0:
            del self.stack[i:]
            return True
        return False

    def item(self, tags) -> None:
        """An open list item ends where the next begins, unless another structure is open in between."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                del self.stack[i:]
                return
            if tag in SPECIAL and tag not in ("address", "div"):
                return

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            return
        if tag == "head":
            if self.body is None and len(self.stack) == 1:
                self.open("head", attrs)
            return
        if tag == "body":
            if self.body is None:
                self.start_body()
            self.body.attrs = attrs | self.body.attrs
            return
        if self.body is None:
            if tag in HEAD:
                if len(self.stack) == 1:
                    self.open("head", {})
            else:
                self.start_body()
        if tag in CLOSES_P:
            self.close(("p",))
        if tag == "li":
            self.item(("li",))
        elif tag in ("dd", "dt"):
            self.item(("dd", "dt"))
        elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
        elif tag == "a":
            self.close(("a",), SPECIAL)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"):
            if self.find(("table",), ("html", "template")) < 0:
                return  # outside of a table these tags mean nothing
            bound = ("table", "html", "template")
            self.close(("td", "th", "caption"), bound)
            if tag not in ("td", "th"):
                self.close(("tr",), bound)
                if tag != "tr":
                    self.close(("tbody", "thead", "tfoot", "colgroup"), bound)
            if tag in ("td", "th", "tr") and self.find(("tbody", "thead", "tfoot"), bound) < 0:
                self.close(("colgroup",), bound)
                self.open("tbody", {})
            if tag in ("td", "th") and self.find(("tr",), bound) < 0:
                self.open("tr", {})
        node = self.open(tag, attrs)
        if tag in VOID or closed and tag in ("path", "rect", "circle", "use", "line"):
            self.stack.pop()
        elif tag in ("svg", "math") and closed:
            self.stack.pop()
        del node

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.close(("head",), ())
            return
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag in HEADINGS:
            self.close(HEADINGS)
        elif tag in ("td", "th", "caption", "tr", "tbody", "thead", "tfoot", "table"):
            self.close((tag,), ("html", "template") if tag == "table" else ("table", "html", "template"))
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol"})
        elif tag in SPECIAL or tag == "p":
            self.close((tag,))
        else:
            self.close((tag,), SPECIAL)

    def text(self, data: str) -> None:
        if self.body is None:
            if not data.strip(" \t\n\f\r"):
                return
            self.start_body()
        self.stack[-1].kids.append(data)


def build(html: str) -> tuple[Node, list[str]]:
    """The tree of a page and the text of its style sheets."""
    b, i, n = Builder(), 0, len(html)
    while i < n:
        at = html.find("<", i)
        if at < 0 or at == n - 1:
            b.text(_decode(html[i:]))
            break
        nxt = html[at + 1]
        if not (nxt.isascii() and nxt.isalpha() or nxt in "/!?"):
            stop = html.find("<", at + 1)
            stop = n if stop < 0 else stop
            b.text(_decode(html[i:stop]))
            i = stop
            continue
        if at > i:
            b.text(_decode(html[i:at]))
        if nxt in "!?" or nxt == "/" and not (html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha()):
            if html.startswith("<!--", at):
                i = _COMMENT.match(html, at).end()
            else:
                stop = html.find(">", at)
                i = n if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, at)
        if not m:
            break  # a tag that never ends
        i, tag = m.end(), m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        closed = m[3].endswith("/")
        b.start(tag, _attributes(m[3]) if m[3] else {}, closed)
        if tag in RAW or tag in ("textarea", "title"):
            if b.stack[-1].tag == tag and not (closed and tag in ("title",) and any(x.tag == "svg" for x in b.stack)):
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, i)
                end = stop.start() if stop else n
                if tag == "style":
                    b.sheets.append(html[i:end])
                elif tag == "textarea":
                    b.stack[-1].kids.append(_decode(html[i:end]))
                b.stack.pop()
                close = html.find(">", end)
                i = n if close < 0 or not stop else close + 1
        elif tag == "plaintext":
            b.text(html[i:])
            break
    return b.root, b.sheets


def _decode(text: str) -> str:
    return unescape(text) if "&" in text else text


def _on_screen(sheet: str) -> str:
    """The rules of a sheet that hold on any screen: blocks of other at-rules (print, sizes, key frames) are left out."""
    out, kept, skip, last = [], [], 0, 0
    for m in re.finditer(r"[{};]", sheet):
        head, last = sheet[last : m.end()], m.end()
        if m[0] == "{":
            rule = head[:-1].strip().lower()
            if skip or rule.startswith("@") and not _applies(rule):
                skip += 1
                continue
            kept.append(not rule.startswith("@"))
            if kept[-1]:
                out.append(head)
        elif m[0] == "}":
            if skip:
                skip -= 1
            elif kept and kept.pop():
                out.append(head)
        elif not skip and not head.strip().startswith("@"):
            out.append(head)
    return "".join(out) + ("" if skip else sheet[last:])


def _applies(rule: str) -> bool:
    if rule.startswith("@media"):
        return any(" ".join(q.split()) in ("", "all", "screen", "only all", "only screen", "not print", "not speech") for q in rule[6:].split(","))
    return rule.startswith(("@layer", "@supports"))


def _declared(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that bear on visibility."""
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(style)]


def _hides(name: str, value: str) -> bool:
    return value == "none" if name == "display" else value in ("hidden", "collapse")


def _rules(sheets: list[str]):
    """(selector, declarations) of the rules that bear on visibility, in order."""
    for sheet in sheets:
        for m in _RULE.finditer(_on_screen(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S))):
            if said := _declared(m[2]):
                for selector in m[1].split(","):
                    yield selector.strip(), said


def hidden_selectors(sheets: list[str]) -> set[str]:
    """The selectors that a style sheet hides."""
    return {selector for selector, said in _rules(sheets) if any(_hides(name, value) for name, value, _ in said)}


class Styles:
    """The rules of a page. A selector is a chain of parts; a node's state tells which parts it matches with all that they need
    above it, so that a node is matched in one step from its parent's state, however deep it is."""

    def __init__(self, sheets: list[str]):
        self.parts: list[tuple] = []  # tag, classes, id, attributes, part before, must be the parent's
        self.by_key: dict[str, list[int]] = {}
        self.said: dict[int, list[tuple]] = {}  # last part -> (property, value, weight)
        for order, (selector, said) in enumerate(_rules(sheets)):
            if (last := self._add(selector)) is not None:
                part, weight = last
                self.said.setdefault(part, []).extend((name, value, (important, 0, *weight, order)) for name, value, important in said)

    def _add(self, selector: str) -> tuple[int, tuple[int, int, int]] | None:
        """The last part of a selector and its specificity."""
        texts, steps, at = [], [], 0
        for m in _STEP.finditer(re.sub(r"\[[^\]]*\]", lambda x: re.sub(r"\s+", "\x00", x[0]), selector)):
            texts.append(selector[at : m.start()])
            steps.append(">" in m[0])
            at = m.end()
        texts.append(selector[at:])
        found = []
        for text in texts:
            m = _COMPOUND.fullmatch(text)
            if not text or not m:
                return None
            classes, ids, attrs = set(), set(), []
            for x in _SIMPLE.finditer(m[2]):
                if x[1]:
                    (classes if x[1] == "." else ids).add(x[2])
                else:
                    attrs.append((x[3].lower(), next((v for v in x.groups()[3:] if v is not None), None)))
            found.append((None if m[1] in (None, "*") else m[1].lower(), classes, ids, attrs))
        before = None
        for k, (tag, classes, ids, attrs) in enumerate(found):
            self.parts.append((tag, classes, ids, attrs, before, k > 0 and steps[k - 1]))
            before = len(self.parts) - 1
            key = "#" + min(ids) if ids else "." + min(classes) if classes else tag or "*"
            self.by_key.setdefault(key, []).append(before)
        return before, (sum(len(x[2]) for x in found), sum(len(x[1]) + len(x[3]) for x in found), sum(x[0] is not None for x in found))

    def match(self, node: Node, parent: int, above: int) -> int:
        """Bits of the parts that a node matches; parent: its parent's, above: those of any node above."""
        a, own = node.attrs, 0
        classes = a["class"].split() if "class" in a else ()
        for key in ("*", node.tag, "#" + a.get("id", ""), *("." + c for c in set(classes))):
            for p in self.by_key.get(key, ()):
                tag, need, ids, attrs, before, child = self.parts[p]
                if (
                    (tag is None or tag == node.tag) and need.issubset(classes) and ids <= {a.get("id")}
                    and all(n in a and v in (None, a[n]) for n, v in attrs)
                    and (before is None or (parent if child else above) >> before & 1)
                ):
                    own |= 1 << p
        return own

    def of(self, node: Node, own: int) -> dict[str, str]:
        """The winning `display` and `visibility` of a node."""
        won: dict[str, tuple] = {}
        if own:
            for p, said in self.said.items():
                if own >> p & 1:
                    for name, value, weight in said:
                        if name not in won or weight >= won[name][0]:
                            won[name] = weight, value
        if "style" in node.attrs:
            for name, value, important in _declared(node.attrs["style"]):
                weight = (important, 1, 0, 0, 0, 0)
                if name not in won or weight >= won[name][0]:
                    won[name] = weight, value
        return {name: value for name, (_, value) in won.items()}


def present(node: Node, style: dict[str, str]) -> bool:
    """Whether a node has a box at all."""
    a = node.attrs
    return not (node.tag in NEVER or node.tag == "input" or "hidden" in a or node.tag == "dialog" and "open" not in a or style.get("display") == "none")


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.out: list[str] = []
        self.need = self.hard = 0
        self.space = False
        self.indent, self.lead = "", None

    def brk(self, lines: int) -> None:
        self.need, self.space = max(self.need, lines), False

    def write(self, s: str) -> None:
        if not self.out:
            self.out.append(self.indent if self.lead is None else self.lead)
            self.lead = None
        elif lines := max(self.need, self.hard):
            self.out.append("\n" * min(lines, 2) + (self.indent if self.lead is None else self.lead))
            self.lead = None
        elif self.space:
            self.out.append(" ")
        self.need = self.hard = 0
        self.space = False
        self.out.append(s)

    def text(self, s: str) -> None:
        flat = _BLANK.sub(" ", s)
        bare = flat.strip(" ")
        if not bare:
            self.space = self.space or bool(flat)
            return
        if flat[0] == " ":
            self.space = True
        self.write(bare)
        self.space = flat[-1] == " "

    def pre(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.hard += 1
            if line:
                self.write(line)

    def value(self) -> str:
        return "".join(self.out)


def lay_out(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table from its rows of (text, colspan, rowspan). A cell that reaches into the next one's column ends its line."""
    placed: list[dict[int, tuple[str, int]]] = [{} for _ in rows]
    busy: list[set[int]] = [set() for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while c in busy[r]:
                c += 1
            placed[r][c] = (text, across)
            for k in range(r + 1, min(len(rows), r + down)):
                busy[k].update(range(c, c + across))
            c += across
    width: dict[int, int] = {}
    for row in placed:
        for c, (text, across) in row.items():
            if across == 1:
                width[c] = max(width.get(c, 0), min(_CAP, max(map(len, text.split("\n")))))
    used = sorted({c for row in placed for c in row})
    start, x = {}, 0
    for c in used:
        start[c] = x
        x += width.get(c, 0) + 2
    out = []
    for row in placed:
        split = {c: text.split("\n") for c, (text, _) in row.items()}
        for k in range(max(map(len, split.values()), default=0)):
            line = ""
            for c in sorted(split):
                if k < len(split[c]) and split[c][k]:
                    if line and len(line) + 2 > start[c]:
                        out.append(line)
                        line = ""
                    line = line.ljust(start[c]) + split[c][k]
            out.append(line)
    return out


def render(html: str | None) -> str | None:
    """The visible text of one page."""
    if html is None:
        return None
    root, sheets = build(html)
    styles = Styles(sheets)
    states: list[tuple[int, int, bool]] = [(0, 0, True)]  # of the open nodes: parts matched, those of any above, shown
    flows = [Flow()]
    tables: list[list] = []
    lists: list[list] = []
    saved: list[tuple[str, str | None]] = []
    keep = 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if node.__class__ is str:
            if not states[-1][2]:
                continue
            if keep:
                flow.pre(node)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            parent, above, shown = states[-1]
            own = styles.match(node, parent, above) if styles.parts else 0
            style = styles.of(node, own) if own or "style" in node.attrs else {}
            if not present(node, style):
                continue
            if tag == "br":
                flow.hard += 1
                flow.space = False
                continue
            if tag in ("hr", "img", "wbr") or tag in VOID:
                if tag == "hr":
                    flow.brk(1)
                continue
            if tag in BLOCK:
                flow.brk(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                begin = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1])
            elif tag == "li":
                counted, number = lists[-1] if lists else (False, 1)
                if counted and re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                    number = int(node.attrs["value"])
                marker = f"{number}. " if counted else "- "
                if lists:
                    lists[-1][1] = number + 1
                saved.append((flow.indent, flow.lead))
                flow.lead = (flow.indent if flow.lead is None else flow.lead) + marker
                flow.indent += " " * len(marker)
            elif tag in ("dd", "blockquote"):
                saved.append((flow.indent, None))
                flow.indent += "  "
            elif tag in ("pre", "listing", "xmp", "textarea"):
                keep += 1
            elif tag == "table":
                tables.append([])
                lists.append([False, 1])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(Flow())
            seen = style.get("visibility", "inherit")
            states.append((own, above | own, shown if seen in ("inherit", "unset") else not _hides("visibility", seen)))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if k.__class__ is not str and k.tag == "summary"][:1]
            todo.append((node, True))
            todo.extend((k, False) for k in reversed(kids))
            continue
        states.pop()
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            flow.indent, lead = saved.pop()
            if flow.lead is not None:
                flow.lead = lead  # nothing was written under the marker
        elif tag in ("dd", "blockquote"):
            flow.indent, _ = saved.pop()
        elif tag in ("pre", "listing", "xmp", "textarea"):
            keep -= 1
        elif tag in ("td", "th") and tables:
            text = flows.pop().value()
            span = [int(v) if (v := node.attrs.get(k, "1")).isdecimal() and v.isascii() and len(v) < 7 else 1 for k in ("colspan", "rowspan")]
            tables[-1][-1].append((text, min(1000, max(1, span[0])), max(1, span[1]) if span[1] else len(tables[-1]) + 65534))
            continue
        elif tag == "table":
            lists.pop()
            rows = tables.pop()
            if any(text for row in rows for text, _, _ in row):
                for k, line in enumerate(lay_out(rows)):
                    if line:
                        flow.brk(1)
                        flow.write(line)
        if tag in BLOCK:
            flow.brk(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 1)
    return flows[0].value()


def visible_text(html: Column | str) -> Column:
    """The rendered text of an HTML column."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([render(x) for x in col.to_pylist()], pa.string())

    return run(F.col(html).cast("string") if isinstance(html, str) else html)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`df` with the visible text of every whole page in `out` (replacing a column of that name)."""
    return df.withColumn(out, visible_text(html))
