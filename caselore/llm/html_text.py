"""Visible text of HTML pages the way a page lays it out.

A small tree builder (implied and omitted tags, void and raw elements, content misplaced in tables) is followed by a
renderer that walks the tree once: blocks start lines, paragraphs and headings stand apart, lists are indented with
their marks, table cells are aligned in columns, and what a browser hides is left out: elements that are never drawn,
``hidden``, display and visibility (inherited, so a child may show itself again) from style attributes and from the rules
of ``<style>`` whose selectors are made of a tag, classes and an id. Other selectors, media conditions on the viewport,
rules for html and body (pages that hide themselves until their script runs) and linked sheets are not applied.

Each ``text`` of an svg is a line; title, desc, defs and the like are not drawn, nor are the copies that ``use`` makes.
Formulas are their tokens in order, with ``/`` for the bar of a fraction and the sign of a root; a matrix is a table.

Defined results: a null page stays null, an empty one gives ""; tags that are never closed end with the page; a tag
without an end (``<p`` at the very end) is dropped; nesting may be of any depth; repeated rows and ids give a row each.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style title head template noscript iframe noembed noframes audio video canvas object "
                   "datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "search section summary table ul".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl dir menu figure hr".split())
ENDS_P = BLOCK - frozenset("body html li dd dt option optgroup legend".split())
LISTS = frozenset("ul ol dir menu".split())
TABLE_PARTS = frozenset("table caption colgroup col tbody thead tfoot tr td th".split())
ROW_GROUPS = frozenset("tbody thead tfoot".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")

# Svg and MathML.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                       "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc title "
                        "style script".split())
MATH_UNDRAWN = frozenset("annotation annotation-xml style script".split())
TOKENS = frozenset("mi mn mo ms mtext".split())
DRAWN_AS = {"text": "div", "foreignobject": "div", "mtable": "table", "mtr": "tr", "mlabeledtr": "tr", "mtd": "td"}
FONT = re.compile(r"\b(?:color|face|size)\s*=", re.I)
UNQUOTED_END = re.compile(r"=\s*[^\s\"'=]+\Z")
UNPRINTED = dict.fromkeys(range(0x2061, 0x2065))  # invisible operators

# Style rules.
DISPLAYS = frozenset("none contents block inline flow flow-root table flex grid ruby math list-item inline-block inline-table "
                     "inline-flex inline-grid run-in table-row table-cell table-caption table-column table-column-group "
                     "table-row-group table-header-group table-footer-group -webkit-box -webkit-inline-box -webkit-flex "
                     "-ms-flexbox inherit initial unset".split())
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset".split())
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
BRACE = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|[{};]")
DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*\"|'[^']*'|\([^()]*\)|[\"'(])++")
SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
MEDIA = frozenset(["", "all", "screen", "only screen", "only all"])
NO_RULES: dict = {}

# New element -> (open elements that it ends, elements that it does not look beyond).
ENDED_BY = {
    "li": (frozenset(["li"]), LISTS), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    **{g: (frozenset(["tr", "td", "th", "caption", "colgroup"]) | ROW_GROUPS, frozenset(["table"])) for g in ROW_GROUPS},
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def parse(page: str, sheets: list[str] | None = None) -> Node:
    """The tree of a page; text nodes are strings. The texts of its style elements are added to ``sheets``."""
    root = Node("html")
    stack, at, n, last = [root], 0, len(page), page.rfind(">")
    foreign = [""]  # for each open element, whether its content is svg or math
    opened: dict[str, int] = {}  # open elements by tag, so that a search for one that is not there costs nothing

    def put(node):
        top = stack[-1]
        tag = node.tag if isinstance(node, Node) else None
        if (top.tag in ("table", "tr") or top.tag in ROW_GROUPS) and (
                node.strip() != "" if tag is None else tag not in TABLE_PARTS and tag not in ("script", "style", "template")):
            for i in range(len(stack) - 1, 0, -1):  # what has no place in a table stands before it
                if stack[i].tag == "table":
                    above = stack[i - 1].children
                    above.insert(len(above) - 1 if above and above[-1] is stack[i] else len(above), node)
                    return
        top.children.append(node)

    def push(node):
        stack.append(node)
        tag, around = node.tag, foreign[-1]
        if tag in ("svg", "math"):
            foreign.append(tag)
        elif around and (tag in ("foreignobject", "desc") if around == "svg" else tag in TOKENS or tag == "annotation-xml"):
            foreign.append("")
        else:
            foreign.append(around)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def close(tags, beyond):
        if not any(opened.get(t) for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for node in stack[i:]:
                    opened[node.tag] -= 1
                del stack[i:], foreign[i:]
                return True
            if stack[i].tag in beyond:
                return False
        return False

    def break_out():
        while foreign[-1]:
            opened[stack.pop().tag] -= 1
            foreign.pop()

    while at < n:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/!a-zA-Z][^>]*\Z", rest)
            text = rest[:cut.start()] if cut else rest
            if text:
                put(html.unescape(text) if "&" in text else text)
            break
        if m.start() > at:
            text = page[at:m.start()]
            put(html.unescape(text) if "&" in text else text)
        at = m.end()
        if m[2] is None:
            if foreign[-1] and page.startswith("<![CDATA[", m.start()):
                end = page.find("]]>", m.start())
                put(page[m.start() + 9:end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        tag = m[2].lower()
        if foreign[-1] and (tag in ("p", "br") if m[1] else tag in BREAKS_OUT or tag == "font" and FONT.search(m[3])):
            break_out()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                put(Node("br"))
            elif tag == "p":
                if not close(frozenset(["p"]), frozenset(["td", "th", "table", "button"])):
                    put(Node("p"))
            elif tag[:1] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
                close(frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]), frozenset(["td", "th", "table"]))
            elif tag in LISTS or tag == "table":
                close(frozenset([tag]), frozenset())
            elif tag == "li":
                close(frozenset([tag]), LISTS | {"table"})
            else:
                close(frozenset([tag]), frozenset(["table"]) if tag in TABLE_PARTS else frozenset(["td", "th", "table"]))
            continue
        if tag == "html" or tag == "body" and opened.get("body"):
            continue
        if tag in ("body", "frameset") and opened.get("head"):
            close(frozenset(["head"]), frozenset())
        elif stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "template", "noscript"):
            close(frozenset(["head"]), frozenset())  # content ends an open head
        inside = foreign[-1]
        if tag in ENDS_P and not inside:
            close(frozenset(["p"]), frozenset(["td", "th", "table", "button"]))
        if tag in ENDED_BY and not inside:
            ended, beyond = ENDED_BY[tag]
            while close(ended, beyond):
                pass
            if tag == "tr" and stack[-1].tag == "table" or tag in ("td", "th") and stack[-1].tag in ("table", *ROW_GROUPS):
                for implied in (["tbody"] if stack[-1].tag == "table" else []) + (["tr"] if tag != "tr" else []):
                    node = Node(implied)
                    stack[-1].children.append(node)
                    push(node)
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /\n\t") else ())
        put(node)
        if inside or tag in ("svg", "math"):
            if m[3].endswith("/") and not UNQUOTED_END.search(m[3]):
                continue
        elif tag in VOID:
            continue
        if tag in RAW and (not inside or tag in ("script", "style", "title")):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            node.children.append(html.unescape(page[at:end.start() if end else n]))
            if tag == "style" and sheets is not None and not opened.get("template") and not opened.get("noscript"):
                a = node.attrs or {}
                if a.get("media", "").strip().lower() in MEDIA and a.get("type", "").strip().lower() in ("", "text/css"):
                    sheets.append(page[at:end.start() if end else n])
            close_at = page.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else n
            continue
        push(node)
    return root


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the valid settings of display and visibility."""
    out = []
    for m in DECLARATION.finditer(COMMENT.sub(" ", text)):
        name, _, value = m[0].partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        if name == "display" and value and DISPLAYS.issuperset(value.split()) or name == "visibility" and value in VISIBILITIES:
            out.append((name, value, important))
        elif name == "content-visibility" and value in ("hidden", "visible", "auto", "initial", "unset", "inherit"):
            out.append((name, value, important))
    return out


def _blocks(css: str):
    """(what stands before a block, the block) of a sheet."""
    start = begin = depth = 0
    head = ""
    for m in BRACE.finditer(css):
        if m[0] == "{":
            if not depth:
                head, begin = css[start:m.start()].strip(), m.end()
            depth += 1
        elif m[0] == "}":
            depth -= depth > 0
            if not depth:
                if begin:
                    yield head, css[begin:m.start()]
                start, begin = m.end(), 0
        elif m[0] == ";" and not depth:
            start = m.end()
    if depth:
        yield head, css[begin:]


def _own(body: str) -> str:
    """A block without the blocks inside it."""
    out, start, depth = [], 0, 0
    for m in BRACE.finditer(body):
        if m[0] == ";" and not depth:
            out.append(body[start:m.end()])
            start = m.end()
        elif m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= depth > 0
            start = start if depth else m.end()
    return "".join(out) + ("" if depth else body[start:])


@lru_cache(64)
def rules(sheets: tuple[str, ...]) -> dict:
    """Rules by the id, class or tag that they ask for: (tag, ids, classes, property, value, rank) each."""
    out: dict = {}
    order, todo = 0, [_blocks(COMMENT.sub(" ", x)) for x in reversed(sheets) if "display" in x.lower() or "visibility" in x.lower()]
    limit = len(todo) + 16  # nested media blocks
    while todo:
        head, body = next(todo[-1], (None, ""))
        if head is None:
            todo.pop()
            continue
        if head[:1] == "@":
            if head[:6].lower() == "@media" and len(todo) < limit and any(q.strip().lower() in MEDIA for q in head[6:].split(",")):
                todo.append(_blocks(body))
            continue
        settings = declarations(_own(body) if "{" in body else body)
        for selector in head.split(",") if settings else ():
            m = SELECTOR.fullmatch(selector.strip())
            if m is None or not m[0]:
                continue
            tag = (m[1] or "*").lower()
            names = re.findall(r"[.#][^.#]+", m[2])
            ids, classes = ([x[1:] for x in names if x[0] == c] for c in "#.")
            if tag in ("html", "body"):
                continue
            key = names[0] if names else tag
            for name, value, important in settings:
                order += 1
                rank = (important, 0, len(ids), len(classes), tag != "*", order)
                out.setdefault(key, []).append((tag, ids, classes, name, value, rank))
    return out


def seen(node: Node, around: str, sheet: dict) -> tuple[bool, str | None]:
    """Whether the element is laid out, and its own visibility, if it has one."""
    tag, a = node.tag, node.attrs
    if tag in (SVG_UNDRAWN if around[:3] == "svg" else MATH_UNDRAWN if around == "math" else HIDDEN):
        return False, None
    laid_out, own = True, "hidden" if tag == "mphantom" and around == "math" else None
    if tag == "dialog":
        laid_out = bool(a) and "open" in a
    if a:
        if "hidden" in a:
            laid_out = False
        if tag == "input" and a.get("type", "").lower() == "hidden":
            return False, None
    if not a and not sheet:
        return laid_out, own
    best: dict = {}
    if a and (around[:3] == "svg" or tag == "svg"):
        for name in ("display", "visibility"):
            if name in a:
                for name_, value, _ in declarations(f"{name}:{a[name]}"):
                    best[name_] = ((False, -1), value)
    if sheet:
        classes = a["class"].split() if a and "class" in a else ()
        id_ = a.get("id") if a else None
        for key in ("*", tag, *["." + c for c in set(classes)], *(["#" + id_] if id_ else [])):
            for want, ids, needed, name, value, rank in sheet.get(key, ()):
                if (want in ("*", tag) and all(x == id_ for x in ids) and all(c in classes for c in needed)
                        and (name not in best or best[name][0] < rank)):
                    best[name] = rank, value
    if a and "style" in a:
        for name, value, important in declarations(a["style"]):
            if name not in best or best[name][0] <= (important, 1):
                best[name] = (important, 1), value
    if "display" in best:
        laid_out = best["display"][1] != "none"
    if "content-visibility" in best and best["content-visibility"][1] == "hidden":
        laid_out = False
    if "visibility" in best:
        value = best["visibility"][1]
        own = "visible" if value == "initial" else None if value in ("inherit", "unset") else value
        if own == "collapse" and (tag == "tr" or tag in ROW_GROUPS):
            laid_out = False
    return laid_out, own


def drawn_children(node: Node, around: str) -> list:
    """The children that an svg or MathML element draws."""
    tag = node.tag
    if around == "svg" and tag == "switch":
        parts = [c for c in node.children if isinstance(c, Node)]
        return [c for c in parts if not c.attrs or not (c.attrs.get("requiredextensions") or "systemlanguage" in c.attrs)][:1]
    if around == "math":
        parts = [c for c in node.children if isinstance(c, Node)]
        if tag in ("semantics", "maction"):
            return parts[:1]
        if tag == "mfrac" and len(parts) == 2:
            bar = (node.attrs or {}).get("linethickness", "").strip()[:1] != "0"
            return [parts[0], _sign("/" if bar else ""), parts[1]]
        if tag == "msqrt":
            return [_sign("\u221a"), *parts]
        if tag == "mroot" and len(parts) == 2:
            return [parts[1], _sign("\u221a"), parts[0]]
    return node.children


def _sign(text: str) -> Node:
    node = Node("mo")
    node.children.append(text)
    return node


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a page or of one cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # line breaks owed before the next text
        self.indent = ""
        self.mark = ""
        self.keep = 0

    def text(self, s: str):
        if not self.keep:
            s = BLANKS.sub(" ", s)
            if s[:1] == " " and (not self.inline or self.inline[-1][-1:] in (" ", "\n")):
                s = s[1:]
        if s:
            self.inline.append(s)

    def flush(self):
        joined = "".join(self.inline)
        self.inline.clear()
        if not self.keep:
            joined = joined.strip(" ")
        if joined.strip():
            self.put([x if self.keep else x.strip(" ") for x in joined.split("\n")])

    def put(self, lines: list[str]):
        while lines and not lines[-1].strip():
            lines.pop()
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        for x in lines:
            head = self.indent[:len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.mark = ""
            self.lines.append((head + x).rstrip())

    def block(self, gap: int):
        self.flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.flush()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []

    def lay_out(self) -> list[str]:
        """Cells in columns two blanks apart; a spanning cell widens the last of its columns."""
        placed, taken = [], {}
        for r, row in enumerate(self.rows):
            c = 0
            for across, down, lines in row:
                while taken.get((r, c)):
                    c += 1
                if down > 1 or across > 1:
                    for i in range(down):
                        for j in range(across):
                            taken[r + i, c + j] = True
                placed.append((r, c, across, lines))
                c += across
        widths: dict[int, int] = {}
        for _, c, across, lines in sorted(placed, key=lambda p: p[2]):
            most = max(map(width, lines), default=0)
            if across == 1:
                widths[c] = max(widths.get(c, 0), most)
            else:
                have = sum(widths.get(c + j, 0) for j in range(across)) + 2 * (across - 1)
                last = c + across - 1
                widths[last] = widths.get(last, 0) + max(0, most - have)
        used = [c for c in sorted(widths) if widths[c]]
        start, x = {}, 0
        for c in used:
            start[c] = x
            x += widths[c] + 2
        out, by_row = [], {}
        for r, c, across, lines in placed:
            by_row.setdefault(r, []).append((next((start[k] for k in range(c, c + across) if k in start), 0), lines))
        for r in sorted(by_row):
            for k in range(max(len(lines) for _, lines in by_row[r])):
                line, end = [], 0
                for x, lines in by_row[r]:
                    if k < len(lines) and lines[k]:
                        line.append(" " * (x - end) + lines[k])
                        end = x + width(lines[k])
                if line:
                    out.append("".join(line))
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1") if node.attrs else "1"
    return min(max(int(value), 1), most) if value.strip().isdigit() and len(value) < 6 else 1


def render(root: Node, sheet: dict = NO_RULES) -> str:
    # An element is left under the tag it was drawn as; content is shown or not, and stands in svg, svg text, math, a token or none.
    flow, flows, tables, lists, work = Flow(), [], [], [], [(root, "", True, "")]
    while work:
        node, leaving, shown, around = work.pop()
        if isinstance(node, str):
            if shown and around in ("", "svg text"):
                flow.text(node)
            elif shown and around == "token":
                flow.text(BLANKS.sub(" ", node).strip(" ").translate(UNPRINTED))
            continue
        tag = leaving or node.tag
        if not leaving:
            if around == "token":
                around = ""
            laid_out, own = seen(node, around, sheet)
            if not laid_out:
                continue
            if own:
                shown = own == "visible"
            children, inside = node.children, around
            if around:
                children = drawn_children(node, around)
                if tag == "foreignobject" and around == "svg":
                    inside = ""
                elif tag == "text" and around == "svg":
                    inside = "svg text"
                elif tag in TOKENS and around == "math":
                    inside = "token" if all(isinstance(c, str) for c in children) else ""
                elif tag == "svg" and around == "math":
                    inside = "svg"
                tag = DRAWN_AS.get(tag, "span")
            elif tag in ("svg", "math"):
                inside = tag
                tag = "div" if tag == "math" and node.attrs and node.attrs.get("display", "").lower() == "block" else "span"
            if tag == "br":
                flow.inline.append("\n")
                continue
            if tag == "hr":
                flow.block(2)
                if shown:
                    flow.put(["---"])
                flow.gap = 2
                continue
            if tag == "input":
                if shown and node.attrs and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "file", "password", "image"):
                    flow.text(node.attrs.get("value", ""))
                continue
            if tag in LISTS:
                flow.block(1 if lists else 2)
                lists.append([tag, _span(node, "start", 10**6) if tag == "ol" else 0, flow.indent])
            elif tag == "li":
                flow.block(1)
                if flow.mark:  # an item without text of its own before an inner list
                    flow.put([""] if flow.mark.strip() else [])
                mark = "* "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.mark = mark if shown else ""
                flow.indent = (lists[-1][2] if lists else "") + " " * len(mark)
            elif tag in ("blockquote", "dd"):
                flow.block(2 if tag == "blockquote" else 1)
                flow.indent += "    " if tag == "dd" else "> "
            elif tag == "pre" or tag == "textarea":
                flow.block(2)
                flow.keep += 1
            elif tag == "table":
                flow.block(2)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                flows.append((flow, lists))
                flow, lists = Flow(), []
            elif tag in BLOCK or tag == "caption":
                flow.block(2 if tag in APART else 1)
            work.append((node, tag, shown, around))
            work.extend([(c, "", shown, inside) for c in reversed(children)])
            continue
        if tag in LISTS:
            flow.block(1 if len(lists) > 1 else 2)
            flow.indent, flow.mark = lists.pop()[2], ""
        elif tag == "li":
            flow.flush()
            if flow.mark:
                flow.put([""])
                flow.mark = ""
            flow.indent = lists[-1][2] if lists else ""
            flow.block(1)
        elif tag in ("blockquote", "dd"):
            flow.block(2 if tag == "blockquote" else 1)
            flow.indent = flow.indent[:-4] if tag == "dd" else flow.indent[:-2]
        elif tag == "pre" or tag == "textarea":
            flow.flush()
            flow.keep -= 1
            flow.gap = 2
        elif tag in ("td", "th") and tables:
            lines = flow.done()
            flow, lists = flows.pop()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((_span(node, "columnspan" if node.tag == "mtd" else "colspan", 1000), _span(node, "rowspan", 1000), lines))
        elif tag == "table":
            lines = tables.pop().lay_out()
            if lines:
                flow.put(lines)
            flow.block(2)
        elif tag in BLOCK or tag == "caption":
            flow.block(2 if tag in APART else 1)
    return "\n".join(flow.done()).strip("\n")


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    sheets: list[str] = []
    root = parse(page, sheets)
    return render(root, rules(tuple(sheets)) if sheets else NO_RULES)


def extract(df: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The id and the visible ``text`` of each page."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(html_column).alias("html"))

    def run(batches):
        for part in slices(batches, 1):
            yield [part.column(0), pa.array([page_text(p) for p in part.column(1).to_pylist()], pa.string())]

    return arrow_map(rows, run, f"`{id_column}` {kind}, text string")
