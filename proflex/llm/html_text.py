"""Operator 9: visible text of HTML pages, laid out.

A tokenizer reads the page once, from left to right: what it has passed it does not look at
again, so tags, comments and quotes that never end cost no more than others.  A tag that the page
ends within is no text, and an open comment reaches to the end, as in the public HTML standard.
A tree builder keeps the stack of open elements, adds the tags that HTML implies (a `p` ends
before a block, a `li` before the next `li`, a cell gets its row, body content ends the head)
and decides whether each element is visible.  A renderer follows its events: blocks stand on
lines of their own, paragraphs, headings, lists, tables and quotations keep an empty line
around them, list items get a mark or number (by `type`, `start`, `value` and `reversed`) and are
indented by depth, up to MAX_INDENT columns, quotations in a line get quotation marks,
preformatted text keeps its white space, and table cells are padded to columns, below and beside
cells that span several.

Not visible: `head`, `script`, `style`, `template`, `noscript` and other elements without
layout, `hidden` attributes, `display:none`, `visibility:hidden` (but for what is `visible` again
within), closed `dialog`s, closed `details` but for their summary, and what is
never drawn of `svg` and `math`: definitions, titles, descriptions, annotations.  All other
text is given, navigation and footers included.  `img` shows its `alt` text, inputs of a visible
kind their value, `textarea` its text, `object` its fallback (that of `audio`, `video`
and `canvas` is not drawn).
A drop-down `select` shows its last selected option, else its first that is not disabled, and
a list (`multiple` or a `size` above 1) shows all of them.

Tables within cells become one line of the cell.  Everything is a loop over a stack, so nesting
of any depth is allowed; the depths of the open elements of each kind are kept, so none are
searched for.

Edge cases: null and empty pages give an empty text; text without tags is given as one block;
repeated rows give repeated results; other columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

# Element kinds of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head title script style template noscript noframes noembed iframe "
                      "audio video canvas "
                      "datalist meta link base area map rp annotation annotation-xml mphantom".split())
#: Elements of `svg` that are not drawn where they stand.
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
#: Start tags that end an open `svg` or `math`.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
                     "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Kinds of `input` whose value is not text on the page; an unknown kind is a text field.
INPUT_HIDDEN = frozenset("hidden password checkbox radio file image color range".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header "
                           "hgroup legend li main nav option optgroup search section summary caption thead tbody tfoot tr td th".split())
ENDS_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("html head title meta link base script style template noscript".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th caption".split())
#: Elements that an end tag inside them cannot close.
SCOPE = frozenset("table td th caption html".split())
#: Elements whose content is text up to their end tag; in the second kind, with character references.
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPED_TEXT = frozenset("title textarea".split())
#: Most columns of a cell, and most rows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
MARKUP = re.compile(r"<(?=[A-Za-z!?]|/.)", re.S)
TAG_NAME = re.compile(r"[^ \t\n\r\f/>]+")
BETWEEN = re.compile(r"[ \t\n\r\f/]*+")
ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)"""
                       r"""(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"?|'([^']*+)'?|([^ \t\n\r\f>]*+)))?""")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Widest padding of a table column; longer cells are kept whole and not padded to.
MAX_PAD = 60
#: Widest indentation; what is nested deeper stands at this column.
MAX_INDENT = 80


def width(text: str) -> int:
    """Columns a string takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Box:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []      # inline text of the line being filled
        self.space = False              # white space waits for the next word
        self.gap = False                # an empty line waits for the next line

    def text(self, data: str, indent: str) -> None:
        if not data:
            return
        words = SPACE.split(data)
        if not self.parts and words[0] == "":
            words = words[1:]
            self.space = False
        elif self.space and words[0]:
            self.parts.append(" ")
        for i, word in enumerate(words):
            if i and word and self.parts:
                self.parts.append(" ")
            if word:
                if not self.parts:
                    self.parts.append(indent)
                self.parts.append(word)
        self.space = bool(words) and words[-1] == "" and bool(self.parts) or self.space and not any(words)

    def end_line(self) -> None:
        line = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if line.strip():
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line)

    def raw(self, line: str) -> None:
        """A line as it is, of preformatted text or a table."""
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line.rstrip())


class Element:
    """An open element: `visible` if it has a place in the layout, `drawn` if its text shows there."""

    __slots__ = ("tag", "visible", "drawn", "attrs", "data")

    def __init__(self, tag: str, visible: bool, drawn: bool, attrs: dict):
        self.tag, self.visible, self.drawn, self.attrs, self.data = tag, visible, drawn, attrs, None


def number(value: str) -> int | None:
    return int(value) if re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", value) else None


def letters(n: int) -> str:
    """1 is a, 26 is z, 27 is aa."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(97 + digit) + out
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
        times, n = divmod(n, value)
        out += sign * times
    return out


def item_number(n: int, kind: str) -> str:
    """The number of an item as the list's `type` writes it; in digits where that has no form for it."""
    text = letters(n) if kind in ("a", "A") and n > 0 else roman(n) if kind in ("i", "I") and 0 < n < 4000 else str(n)
    return text.upper() if kind in ("A", "I") else text


def is_list(select: Element) -> bool:
    """A `select` that shows all its options, not a drop-down."""
    size = select.attrs.get("size", "")
    return "multiple" in select.attrs or size.isdecimal() and size.lstrip("0") not in ("", "1")


class Layout:
    """Tokenizer, tree builder and renderer of one page."""

    def __init__(self, items: dict[int, int] | None = None):
        self.open: list[Element] = []
        self.depths: dict[str, list[int]] = {}  # where the open elements of each kind stand
        self.boxes = [Box()]
        self.indents: list[str] = []            # each whole, with those around it
        self.mark = ""
        self.pre = 0
        self.quotes = 0
        self.lists = 0
        self.items = items or {}                # items of each list that counts down, from an earlier run
        self.counted: dict[int, int] = {}

    # -- tokenizer --------------------------------------------------------------------------

    def feed(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = MARKUP.search(html, at)
            stop = found.start() if found else end
            if stop > at:
                self.handle_data(unescape(html[at:stop]))
            if not found:
                return
            at = self.markup(html, stop)

    def markup(self, html: str, at: int) -> int:
        """Handle the tag or comment that begins at `at`; where it ends."""
        if html[at + 1] == "!" or html[at + 1] == "?" or html[at + 1] == "/" and not (html[at + 2].isascii() and html[at + 2].isalpha()):
            if html.startswith("<!--", at):
                if html.startswith((">", "->"), at + 4):
                    return html.index(">", at) + 1
                found = COMMENT_END.search(html, at + 4)
                return found.end() if found else len(html)
            if html.startswith("<![CDATA[", at) and self.in_foreign():
                stop = html.find("]]>", at)
                self.handle_data(html[at + 9:stop if stop >= 0 else len(html)])
                return stop + 3 if stop >= 0 else len(html)
            stop = html.find(">", at)
            return stop + 1 if stop >= 0 else len(html)
        closing = html[at + 1] == "/"
        name = TAG_NAME.match(html, at + 1 + closing)
        tag, at, attrs, end = name.group().lower(), name.end(), {}, len(html)
        while True:
            gap = BETWEEN.match(html, at)
            at = gap.end()
            if at >= end:
                return end
            if html[at] == ">":
                break
            part = ATTRIBUTE.match(html, at)
            at = part.end()
            if not closing:
                key = part.group(1).lower()
                attrs.setdefault(key, unescape(next((v for v in part.groups()[1:] if v is not None), "")))
        at += 1
        if closing:
            self.handle_endtag(tag)
            return at
        foreign = tag in ("svg", "math") or self.in_foreign()
        self.handle_starttag(tag, attrs)
        if foreign and gap.group().endswith("/") and (tag not in BREAKOUT or self.in_foreign()):
            self.handle_endtag(tag)
        elif tag == "plaintext":
            self.handle_data(html[at:])
            return end
        elif tag in RAW_TEXT or tag in ESCAPED_TEXT:
            found = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I).search(html, at)
            stop = found.start() if found else end
            if stop > at:
                self.handle_data(unescape(html[at:stop]) if tag in ESCAPED_TEXT else html[at:stop])
            return stop
        return at

    def in_foreign(self) -> bool:
        outer = self.depth("svg", "math")
        return outer >= 0 and outer > self.depth("foreignobject", "annotation-xml", "mtext", "mi", "mo", "mn", "ms")

    # -- tree builder ---------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "body" and self.is_open("body"):
            return
        if tag not in HEAD_ONLY and any(e.tag == "head" for e in self.open[:2]):
            self.close_nearest(("head",), ())
        if tag in BREAKOUT:
            self.close_nearest(("svg", "math"), {"foreignobject", "annotation-xml", "mtext", "mi", "mo", "mn", "ms", "desc", "title"})
        if tag in ("select", "input", "textarea"):
            self.close_nearest(("select",), SCOPE)
        if tag in ENDS_P:
            self.close_nearest(("p",), SCOPE | {"button"})
        if tag in HEADINGS and self.open and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag == "li":
            self.close_nearest(("li",), SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self.close_nearest(("dt", "dd"), SCOPE | {"dl"})
        elif tag in ("td", "th"):
            self.close_nearest(("td", "th", "caption"), {"table"})
            if self.nearest(("table", "tr")) == "table":
                self.push("tr", {})
        elif tag == "tr":
            self.close_nearest(("tr", "caption"), {"table"})
        elif tag in SECTIONS or tag == "caption":
            self.close_nearest((*SECTIONS, "caption"), {"table"})
        elif tag in ("option", "optgroup"):
            self.close_nearest(("option", tag), SCOPE | {"select"})
        elif tag == "a":
            self.close_nearest(("a",), SCOPE | BLOCK)
        if tag in VOID:
            self.void(tag, attrs)
        else:
            self.push(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.void("br", {})
        elif tag not in VOID:
            self.close_nearest((tag,), () if tag in ("body", "html", "head", "table") else
                       {"table"} if tag in CELLS or tag in SECTIONS or tag == "tr" else
                       SCOPE)

    def in_textarea(self) -> bool:
        return bool(self.open) and self.open[-1].tag == "textarea"

    def depth(self, *tags: str) -> int:
        """Where the innermost open element of these kinds stands, or -1."""
        return max((held[-1] for tag in tags if (held := self.depths.get(tag))), default=-1)

    def is_open(self, tag: str) -> bool:
        return bool(self.depths.get(tag))

    def innermost(self, *tags: str):
        depth = self.depth(*tags)
        return self.open[depth] if depth >= 0 else None

    def open_select(self):
        """The open `select`, if it is visible."""
        select = self.innermost("select")
        return select if select is not None and select.data is not None else None

    def nearest(self, tags) -> str:
        element = self.innermost(*tags)
        return element.tag if element is not None else ""

    def close_nearest(self, tags, barrier) -> None:
        """Close down to the innermost open element of `tags`, if no barrier stands above it."""
        depth = self.depth(*tags)
        if depth >= 0 and depth >= self.depth(*barrier):
            while len(self.open) > depth:
                self.pop()

    def is_visible(self, tag: str, attrs: dict) -> bool:
        if self.open and not self.open[-1].visible:
            return False
        if self.in_closed_details():
            details = self.open[-1]
            if tag != "summary" or details.data:
                return False
            details.data = True     # one summary shows
        if tag == "option" and (select := self.open_select()) is not None and not is_list(select):
            return True     # a drop-down shows its choice, hidden in the list or not
        if tag in SVG_HIDDEN and self.is_open("svg"):
            return False
        return not (tag in INVISIBLE or "hidden" in attrs or tag == "dialog" and "open" not in attrs
                    or "style" in attrs and NOT_DISPLAYED.search(attrs["style"]))

    def in_closed_details(self) -> bool:
        return bool(self.open) and self.open[-1].tag == "details" and "open" not in self.open[-1].attrs

    def is_drawn(self, attrs: dict) -> bool:
        found = "style" in attrs and VISIBILITY.findall(attrs["style"])
        return found[-1].lower() == "visible" if found else not self.open or self.open[-1].drawn

    # -- renderer -------------------------------------------------------------------------

    def push(self, tag: str, attrs: dict) -> None:
        element = Element(tag, self.is_visible(tag, attrs), self.is_drawn(attrs), attrs)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(element)
        if not element.visible:
            return
        if tag == "select":
            element.data = [(self.indents, self.pre, self.mark)]
            self.indents, self.pre, self.mark = [], 0, ""
            self.boxes.append(Box())        # of text beside the options, which is not shown
        elif (select := self.open_select()) is not None and tag in ("option", "optgroup"):
            if tag == "option":
                self.boxes.append(Box())
                element.data = select
            elif is_list(select) and element.drawn and attrs.get("label", "").strip():
                select.data.append(("label", attrs["label"]))
            return
        elif tag == "text" and self.is_open("svg"):
            self.boxes[-1].end_line()
        elif tag == "q":
            if element.drawn:
                self.inline("\u201c" if self.quotes % 2 == 0 else "\u2018")
            self.quotes += 1
        if tag not in BLOCK:
            return
        box = self.boxes[-1]
        box.end_line()
        if tag in SPACED and not (tag in LISTS and self.in_item()):
            box.gap = True
        if tag == "table":
            element.data = []
        elif tag == "tr":
            element.data = []
        elif tag in CELLS:
            self.boxes.append(Box())
            element.data = (self.indents, self.pre)
            self.indents, self.pre = [], 0
        elif tag in LISTS:
            start = number(attrs.get("start", ""))
            element.data = [start if start is not None else self.items.get(self.lists, 1), self.lists, 0]
            self.lists += 1
            self.indent("")
        elif tag == "li":
            self.begin_item()
        elif tag in ("blockquote", "dd"):
            self.indent("  ")
        elif tag == "pre":
            self.pre += 1

    def in_item(self) -> bool:
        return self.is_open("li")

    def indent(self, more: str) -> None:
        self.indents.append((self.indentation() + more)[:MAX_INDENT])

    def indentation(self) -> str:
        return self.indents[-1] if self.indents else ""

    def begin_item(self) -> None:
        of = self.innermost(*LISTS, *CELLS)
        mark = "- "
        if of is not None and of.tag == "ol" and of.visible:
            item = self.open[-1]
            value = number(item.attrs.get("value", ""))
            if value is not None:
                of.data[0] = value
            kind = item.attrs.get("type", of.attrs.get("type", "")).strip()
            mark = f"{item_number(of.data[0], kind)}. "
            of.data[0] += -1 if "reversed" in of.attrs else 1
            of.data[2] += 1
        self.mark = self.indentation() + mark
        self.indent(" " * len(mark))

    def pop(self) -> None:
        element = self.open.pop()
        tag = element.tag
        self.depths[tag].pop()
        if not element.visible:
            return
        if tag == "select":
            self.boxes.pop()
            (self.indents, self.pre, self.mark), *options = element.data
            if element.drawn:
                self.show_options(options, is_list(element))
        elif tag == "option" and element.data is not None:
            box = self.boxes.pop()
            box.end_line()
            text = element.attrs.get("label", "").strip() or " ".join(line.strip() for line in box.lines)
            disabled = "disabled" in element.attrs or any(
                "disabled" in self.open[depth].attrs for depth in self.depths.get("optgroup", ()))
            element.data.data.append(("selected" if "selected" in element.attrs else "disabled" if disabled else "option", text))
            return
        elif tag == "optgroup" and self.open_select() is not None:
            return
        elif tag == "text" and self.is_open("svg"):
            self.boxes[-1].end_line()
        elif tag == "q":
            self.quotes -= 1
            if element.drawn:
                self.inline("\u201d" if self.quotes % 2 == 0 else "\u2019")
        if tag not in BLOCK:
            return
        self.boxes[-1].end_line()
        if tag in CELLS:
            cell = self.boxes.pop()
            self.indents, self.pre = element.data
            self.add_cell(element, " ".join(line.strip() for line in cell.lines if line.strip()))
        elif tag == "tr":
            if (table := self.open_table()) is not None:
                table.data.append(element.data)
            else:
                self.table_lines([element.data])
        elif tag == "table":
            self.table_lines(element.data)
        elif tag in LISTS or tag in ("blockquote", "dd"):
            if tag == "ol" and "reversed" in element.attrs:
                self.counted[element.data[1]] = element.data[2]
            self.indents.pop()
        elif tag == "li":
            self.indents.pop()
            self.mark = ""
        elif tag == "pre":
            self.pre -= 1
        if tag in SPACED and not (tag in LISTS and self.in_item()):
            self.boxes[-1].gap = True

    def show_options(self, options: list[tuple[str, str]], as_list: bool) -> None:
        if as_list:
            self.boxes[-1].end_line()
            for _, text in options:
                self.inline(text)
                self.boxes[-1].end_line()
            return
        chosen = [text for kind, text in options if kind == "selected"][-1:] or [text for kind, text in options if kind == "option"][:1]
        for text in chosen:
            self.inline(text)

    def open_table(self):
        table = self.innermost("table")
        return table if table is not None and table.visible else None

    def add_cell(self, element: Element, text: str) -> None:
        if element.tag == "caption":
            if text:
                self.boxes[-1].raw(self.indentation() + text)
            return
        def span(name, most):
            value = number(element.attrs.get(name, ""))
            return min(value, most) if value is not None and value >= 0 else 1

        row = self.innermost("tr")
        cell = (text, max(span("colspan", MAX_COLSPAN), 1), span("rowspan", MAX_ROWSPAN) or MAX_ROWSPAN)
        if row is not None and row.visible:
            row.data.append(cell)
        else:
            self.table_lines([[cell]])

    def table_lines(self, rows: list[list[tuple[str, int, int]]]) -> None:
        """Rows of cells (text, columns, rows).  A column is as wide as its widest cell of up to MAX_PAD;
        columns in which no cell begins take no room."""
        placed, held = [], []       # held: (first column, column behind, rows to go) of cells from above
        for row in rows:
            here, at, new, passed = [], 0, [], 0
            held.sort()
            for text, columns, down in row:
                while passed < len(held) and held[passed][0] <= at:
                    at = max(at, held[passed][1])
                    passed += 1
                here.append((at, text, columns))
                if down > 1:
                    new.append((at, at + columns, down - 1))
                at += columns
            held = [(first, behind, left - 1) for first, behind, left in held if left > 1] + new
            placed.append(here)
        pads: dict[int, int] = {}
        for here in placed:
            for at, text, columns in here:
                size = width(text)
                pads[at] = max(pads.get(at, 0), size if columns == 1 and size <= MAX_PAD else 0)
        begins, total = {}, 0
        for at in sorted(pads):
            begins[at] = total
            total += pads[at] + 2
        indent = self.indentation()
        for here in placed:
            parts, reached = [], 0
            for at, text, _ in here:
                if text:
                    gap = max(begins[at] - reached, 2 if parts else 0)
                    parts.append(" " * gap + text)
                    reached += gap + width(text)
            if parts:
                self.boxes[-1].raw(indent + "".join(parts))

    def void(self, tag: str, attrs: dict) -> None:
        if not self.is_visible(tag, attrs):
            return
        box = self.boxes[-1]
        if tag not in ("br", "hr") and not self.is_drawn(attrs):
            return
        if tag == "br":
            box.end_line()
        elif tag == "hr":
            box.end_line()
            box.gap = True
        elif tag == "img" and attrs.get("alt", "").strip():
            self.inline(attrs["alt"])
        elif tag == "input" and attrs.get("type", "text").strip().lower() not in INPUT_HIDDEN:
            if attrs.get("value", "").strip():
                self.inline(attrs["value"])
        elif tag == "input" and attrs["type"].strip().lower() == "image" and attrs.get("alt", "").strip():
            self.inline(attrs["alt"])

    def inline(self, data: str) -> None:
        box, indent = self.boxes[-1], self.indentation()
        if not box.parts and self.mark and data.strip():
            indent, self.mark = self.mark, ""
        box.text(data, indent)

    def handle_data(self, data: str) -> None:
        if self.open and not (self.open[-1].visible and self.open[-1].drawn) or self.in_closed_details():
            return
        if self.is_open("svg") and not (self.is_open("text") or self.is_open("foreignobject")):
            return      # characters beside the text elements are not drawn
        if self.in_textarea():
            area = self.open[-1]
            lines = data.replace("\r\n", "\n").split("\n")
            if area.data is None and len(lines) > 1 and not lines[0]:
                del lines[0]
            area.data = True
            for i, line in enumerate(lines):
                if i:
                    self.boxes[-1].end_line()
                self.inline(line)
            return
        if not self.pre:
            self.inline(data)
            return
        box, indent = self.boxes[-1], self.indentation()
        for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                done = "".join(box.parts)
                box.parts = []
                if done.strip() or box.lines and not box.gap:
                    box.raw(done)
            if line:
                box.parts.append(line if box.parts else indent + line)


def extract(html: str) -> str:
    """Visible text of one page."""
    layout = laid_out(html)
    if layout.counted:      # lists that count down begin with the number of their items
        layout = laid_out(html, layout.counted)
    return "\n".join(layout.boxes[0].lines).rstrip("\n")


def laid_out(html: str, items: dict[int, int] | None = None) -> Layout:
    layout = Layout(items)
    layout.feed(html)
    while layout.open:
        layout.pop()
    layout.boxes[0].end_line()
    return layout


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256 of every page.  A projection of the rows;
    nothing is shuffled."""
    source = id_and_text(df, id_col, html_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def make():
        def row(page_id, html):
            text = extract(html or "")
            return [(page_id, text, len(text), text.count("\n") + 1 if text else 0,
                     hashlib.sha256(text.encode()).hexdigest())]
        return row

    return map_batches(source, make, f"page_id {id_type}, text string, n_chars bigint, n_lines bigint, "
                                     "text_sha256 string")
