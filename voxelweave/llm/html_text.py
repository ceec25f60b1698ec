"""Visible text of web pages, laid out as blocks, lists and aligned tables.

A tree builder closes what HTML lets an author leave out and drops what is not shown; its events go to a renderer that
keeps one open buffer for each block that needs its own text (list items, cells, preformatted text), so that depth of
nesting costs no recursion.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import groups_of_texts, short_batches, strings

#: Fixed values of the HTML standard: elements without content, elements laid out as blocks, elements never shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "ul"}
HIDDEN = {"applet", "audio", "canvas", "datalist", "embed", "head", "iframe", "link", "meta", "noembed", "noframes", "noscript", "object", "script", "style", "svg", "template", "title", "video"}
SPACED = {"blockquote", "dl", "fieldset", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "ol", "p", "pre", "table", "ul"}
#: What a start tag ends when it is open, and up to which elements it looks.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "dialog"}
SCOPE = {"table", "td", "th", "caption", "template", "button", "object"}
SPACE = " \t\n\r\f"
SPACES = re.compile("[ \t\n\r\f]+")
#: Bounds that the standard gives for colspan and rowspan.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
SIMPLE = re.compile(r"[a-z][a-z0-9]*|(?:[a-z][a-z0-9]*)?[.#][\w-]+", re.IGNORECASE)
HEAD_ONLY = {"base", "link", "meta", "noscript", "script", "style", "template", "title", "head", "html"}


def width(text: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Buffer:
    """Lines of one block. Space between inline texts collapses; blocks end lines and may ask for an empty one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.put(first)
            for x in rest:
                self.end_line(True)
                self.put(x)
            return
        bare = SPACES.sub(" ", data.strip(SPACE))
        if not bare:
            self.space = self.space or bool(data)
            return
        if self.line and (self.space or data[0] in SPACE):
            self.line.append(" ")
        self.put(bare)
        self.space = data[-1] in SPACE

    def put(self, text: str) -> None:
        if text:
            if not self.line and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(text)

    def end_line(self, forced: bool = False) -> None:
        if self.line or forced:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def paste(self, lines: list[str], spaced: bool) -> None:
        """Finished lines as a block."""
        self.block(spaced)
        for k, x in enumerate(lines):
            if k == 0:
                self.put(x)
            else:
                self.line = [x]
            self.end_line(True)
        self.block(spaced)

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[0]:
            del lines[0]
        while lines and not lines[-1]:
            del lines[-1]
        return lines


Cell = tuple[list[str], int, int]


def declared(style: str) -> dict[str, str]:
    """What declarations say of display and visibility; the last one counts."""
    return {k.lower(): v.lower() for k, v in DECLARED.findall(style)}


def style_rules(css: str) -> dict[str, dict[str, str]]:
    """Display and visibility by simple selector: an element's name, .class, #id, or a name with one of these.

    Other selectors and what stands in at-rules say nothing here.
    """
    out: dict[str, dict[str, str]] = {}
    depth, start, head, skipped = 0, 0, "", 0
    css = re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.DOTALL)
    for m in re.finditer(r"[{};]", css):
        if m.group() == "{":
            if depth == 0:
                head, skipped = css[start : m.start()].strip(), 0
            depth += 1
            skipped = max(skipped, depth - 1)
            if depth == 1:
                start = m.end()
        elif m.group() == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                if not head.startswith("@") and not skipped and (said := declared(css[start : m.start()])):
                    for x in map(str.strip, head.split(",")):
                        if SIMPLE.fullmatch(x):
                            name, mark, rest = re.fullmatch(r"([^.#]*)([.#]?)(.*)", x).groups()
                            out.setdefault(name.lower() + mark + rest, {}).update(said)
                head, start = "", m.end()
        elif depth == 0:
            start = m.end()
    return out


def placed(rows: list[list[Cell]]) -> list[list[tuple[list[str], int, int]]]:
    """Cells (lines, columns, rows spanned) as (lines, first column, column after); cells from above take their room."""
    out, busy = [], []
    for r in rows:
        cells, more, at, k = [], [], 0, 0
        for lines, columns, deep in r:
            while k < len(busy) and busy[k][0] <= at:
                at = max(at, busy[k][1])
                k += 1
            cells.append((lines, at, at + columns))
            more.append((at, at + columns, deep))
            at += columns
        out.append(cells)
        busy = sorted((a, b, n - 1) for a, b, n in busy + more if n > 1)
    return out


def layout_table(rows: list[list[Cell]], caption: list[str]) -> list[str]:
    """Rows with their columns aligned, two spaces apart; columns in which no cell begins take no room."""
    grid = placed(rows)
    starts = sorted({a for r in grid for _, a, _ in r})
    place = {a: k for k, a in enumerate(starts)}
    widths = [0] * len(starts)
    for several in (False, True):  # single cells first; cells over several columns widen the last of theirs
        for r in grid:
            for lines, a, b in r:
                x, y = place[a], bisect.bisect_left(starts, b)
                if (y - x > 1) == several:
                    have = sum(widths[x:y]) + 2 * (y - x - 1)
                    widths[y - 1] += max(0, max(map(width, lines), default=0) - have)
    offsets = [0, *itertools.accumulate(w + 2 for w in widths)]
    out = [*caption]
    for r in grid:
        for k in range(max((len(lines) for lines, _, _ in r), default=0)):
            line, at = [], 0
            for lines, a, _ in r:
                if k < len(lines) and lines[k]:
                    gap = max(offsets[place[a]] - at, 2 if at else 0)
                    line += [" " * gap, lines[k]]
                    at += gap + width(lines[k])
            out.append("".join(line).rstrip(" "))
    return out


class Page(HTMLParser):
    """Feed it a page; `lines` then holds what a reader sees."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # element, whether it is shown, whether its text is visible, and of a closed details 1, or 2 after its summary
        self.open: list[list] = []
        self.rules: dict[str, dict[str, str]] = {}
        self.after_pre = False
        self.count: dict[str, int] = {}
        self.hidden = 0
        self.buffers = [Buffer()]
        self.lists: list[list] = []  # kind and next number
        self.tables: list[dict] = []
        self.pre = 0

    def styled(self, tag: str, given: dict) -> dict[str, str]:
        """Display and visibility that the page's own rules and the element's style give it, the closest last."""
        out: dict[str, str] = {}
        if self.rules:
            names = [f".{c}" for c in (given.get("class") or "").split()] + ([f"#{given['id']}"] if given.get("id") else [])
            for key in (tag, *(x for n in names for x in (n, tag + n))):
                out |= self.rules.get(key, {})
        return out | declared(given.get("style") or "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.imply(tag)
        self.after_pre = False
        given = dict(reversed(attrs))  # of attributes with one name the first counts
        style = self.styled(tag, given)
        shown = tag not in HIDDEN and "hidden" not in given and not (tag == "input" or tag == "dialog" and "open" not in given) and style.get("display") != "none"
        visible = self.open[-1][2] if self.open else True
        if style.get("visibility") in ("visible", "hidden", "collapse"):
            visible = style["visibility"] == "visible"
        if self.open and (state := self.open[-1][3]):  # in a closed details only the first summary is shown
            shown = shown and tag == "summary" and state == 1
            self.open[-1][3] = 2 if tag == "summary" else state
        if tag in VOID:
            if not self.hidden and shown:
                if tag == "br":
                    self.buffers[-1].end_line(True)
                elif tag == "hr":
                    self.buffers[-1].block(True)
            return
        self.open.append([tag, shown, visible, int(tag == "details" and "open" not in given)])
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += not shown
        if not self.hidden:
            self.begin(tag, given)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash has no meaning in HTML

    def imply(self, tag: str) -> None:
        """Close what the start of this element ends."""
        if self.count.get("head") and tag not in HEAD_ONLY:
            self.close_to("head")
        if tag in CLOSES_P and self.count.get("p"):
            self.close_within({"p"}, SCOPE)
        if tag in ENDS:
            self.close_within(*ENDS[tag])
        if tag in ("td", "th") and self.count.get("table") and not self.within("tr", {"table"}):
            self.handle_starttag("tr", [])

    def within(self, tag: str, stop: set[str]) -> bool:
        for name, *_ in reversed(self.open):
            if name == tag:
                return True
            if name in stop:
                return False
        return False

    def close_within(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        depth = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                depth = k
            elif self.open[k][0] in stop:
                break
        while depth is not None and len(self.open) > depth:
            self.pop()

    def close_to(self, tag: str) -> None:
        while self.open:
            name = self.open[-1][0]
            self.pop()
            if name == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.count.get("p"):
            if not self.hidden:
                self.buffers[-1].block(True)
            return
        if tag == "br":
            self.handle_starttag("br", [])
        if tag in VOID or not self.count.get(tag):
            return
        if tag not in ("table", "body", "html") and self.count.get("table") and not self.within(tag, {"table"}):
            return  # an end tag inside a table doesn't reach out of it
        self.close_to(tag)

    def pop(self) -> None:
        tag, shown, *_ = self.open.pop()
        self.count[tag] -= 1
        if not self.hidden:
            self.end(tag)
        self.hidden -= not shown

    def begin(self, tag: str, given: dict) -> None:
        here = self.buffers[-1]
        if tag in ("ul", "ol", "menu", "dir"):
            here.block(not self.lists)
            start = given.get("start") or "1"
            self.lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "table":
            here.block(True)
            self.tables.append({"rows": [], "caption": [], "spans": []})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th", "caption") and self.tables:
            number = lambda name, most: min(int(x), most) if re.fullmatch(r"[0-9]{1,9}", x := (given.get(name) or "1").strip(SPACE)) else 1
            # a rowspan of 0 reaches to the end of the table
            self.tables[-1]["spans"].append((max(number("colspan", MOST_COLUMNS), 1), number("rowspan", MOST_ROWS) or MOST_ROWS))
            self.buffers.append(Buffer())
        elif tag in ("li", "blockquote", "dd"):
            here.block(tag == "blockquote")
            self.buffers.append(Buffer())
        elif tag in BLOCK:
            here.block(tag in SPACED)
        if tag in ("pre", "textarea"):
            self.pre += 1
            self.after_pre = True

    def end(self, tag: str) -> None:
        if tag in ("pre", "textarea"):
            self.pre -= 1
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
            self.buffers[-1].block(not self.lists)
        elif tag == "table":
            t = self.tables.pop()
            self.buffers[-1].paste(layout_table(t["rows"], t["caption"]), True)
        elif tag in ("td", "th") and self.tables:
            lines, span = self.buffers.pop().done(), self.tables[-1]["spans"].pop()
            self.tables[-1]["rows"][-1:] = [[*(self.tables[-1]["rows"] or [[]])[-1], (lines, *span)]]
        elif tag == "caption" and self.tables:
            self.tables[-1]["spans"].pop()
            self.tables[-1]["caption"] += self.buffers.pop().done()
        elif tag in ("li", "blockquote", "dd"):
            lines = self.buffers.pop().done()
            if tag == "li":
                mark = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    mark = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
            else:
                mark = "    " if tag == "dd" else "> "
            rest = mark if tag == "blockquote" else " " * len(mark)
            self.buffers[-1].paste([((mark if k == 0 else rest) + x).rstrip(" ") for k, x in enumerate(lines)], tag == "blockquote") if lines else None
        elif tag in BLOCK:
            self.buffers[-1].block(tag in SPACED)

    def handle_data(self, data: str) -> None:
        if self.count.get("head") and data.strip() and not self.hidden_in_head():
            self.close_to("head")
        if self.open and self.open[-1][0] == "style":
            for key, said in style_rules(data).items():
                self.rules.setdefault(key, {}).update(said)
        if self.after_pre:  # a line break right after the start of preformatted text isn't shown
            data, self.after_pre = data.removeprefix("\r").removeprefix("\n"), False
        if not self.hidden and not (self.open and (not self.open[-1][2] or self.open[-1][3])):
            self.buffers[-1].text(data, self.pre > 0)

    def hidden_in_head(self) -> bool:
        return self.open[-1][0] != "head"

    def lines(self) -> list[str]:
        self.close_all()
        return self.buffers[0].done()

    def close_all(self) -> None:
        while self.open:
            self.pop()


def visible_text(html: str) -> str:
    """All text that a page shows, line by line. Text outside of any element is shown too; no markup, no text lost."""
    page = Page()
    page.feed(html)
    HTMLParser.close(page)  # what is left of a broken tag
    return "\n".join(page.lines())


def extract(pages: DataFrame) -> DataFrame:
    """pages with the visible text of each one's html as `text`, and n_lines (long).

    Null and empty pages give an empty text without lines. Rows stay as they are, repeated ones too; columns named
    text or n_lines are replaced. No rows give no rows.
    """
    short_batches(pages.sparkSession)
    pages = pages.select(*[c for c in pages.columns if c not in ("text", "n_lines")])
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = strings(batch.column(at).cast(pa.string()))
            for begin, end in groups_of_texts(found):
                texts = [visible_text(x) for x in found[begin:end]]
                part = batch.slice(begin, end - begin)
                lines = [x.count("\n") + 1 if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[*batch.schema.names, "text", "n_lines"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, text string, n_lines long")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, n_lines, the text and its digest, for each row of pages, repeated ones too; null html has an empty text."""
    return extract(pages).select("page_id", "n_lines", "text", F.sha2("text", 256).alias("text_sha256"))
