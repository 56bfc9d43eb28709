"""CommonMark reader that keeps source positions.

Documents are independent and the grammar of containers cannot be expressed as columns, so this runs
as plain Python inside one narrow ``mapInPandas`` stage (see ``operators.parsing``). The reader
never rebuilds text: every block is a list of source positions, and inline syntax is marked as
hidden at those positions. What is left is prose.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from clausewise.functions.lexicon import ADMONITIONS

SPACE = " \t\n\r"
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})(.*)$", re.S)
_ATX = re.compile(r"(#{1,6})(?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"[-+*](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})[.)](?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_TABLE_RULE = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_ATTR = r"""(?:\s+[A-Za-z_:][\w:.\-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9\-]*{_ATTR}*\s*/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9\-]*\s*>"
_HTML_INLINE = re.compile(rf"(?:{_OPEN_TAG}|{_CLOSE_TAG}|<!---?>|<!--(?:[^-]|-[^-]|--[^>])*-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>)", re.S)
#: Start of an HTML block, what ends it (None: a blank line), and whether it may interrupt a paragraph.
_HTML_BLOCKS = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{_BLOCK_TAGS})(?=\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:{_OPEN_TAG}|{_CLOSE_TAG})\s*$"), None, False),
)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^<>\x00-\x20]*|[\w.!#$%&'*+/=?^`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?)*)>")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~‐-‧‰-⁞¡§«¶·»¿、-〃〈-】]")


@dataclass
class Block:
    """A leaf block of prose. ``at`` holds the source position of each content character."""

    content: str
    at: list[int]
    kind: str
    procedural: bool
    line: int
    segments: list[tuple[int, int]] = field(default_factory=list)
    code: list[tuple[int, int]] = field(default_factory=list)
    admonition: str = ""


@dataclass
class Parsed:
    source: str
    masked: str
    blocks: list[Block]
    #: (source line, text) of raw HTML, in the order of the source.
    html: list[tuple[int, str]]


@dataclass
class _Container:
    kind: str  # quote or item
    indent: int = 0
    ordered: bool = False
    mark: str = ""
    empty: bool = False


def line_spans(source: str) -> list[tuple[int, int, int]]:
    """Start, end and next start of each line; lines end with CR LF, CR or LF."""
    out, start = [], 0
    for m in re.finditer(r"\r\n|\r|\n", source):
        out.append((start, m.start(), m.end()))
        start = m.end()
    out.append((start, len(source), len(source)))
    return out


def front_matter_end(source: str) -> int:
    """End of a YAML or TOML front matter; 0 without one or with an open one."""
    m = re.match(r"(---|\+\+\+)\r?\n", source)
    if not m:
        return 0
    for start, end, after in line_spans(source)[1:]:
        if source[start:end].rstrip(" \t\r") in (m[1], "..."):
            return after
    return 0


def admonition_word(text: str) -> str:
    m = re.match(r"[ \t*_>:!\-\[]*([A-Za-z]+)[ \t]*(.?)", text, re.S)
    if m and m[1].lower() in ADMONITIONS and (not m[2] or m[2] in ":]*!"):
        return m[1].lower()
    return ""


class _Line:
    """A cursor over one source line that knows columns, so that tabs count to the next multiple of 4."""

    def __init__(self, source: str, start: int, end: int) -> None:
        self.source, self.pos, self.end, self.col = source, start, end, 0
        self.pending = 0  # columns of a partly used tab

    def indent(self) -> int:
        """Columns of blanks ahead."""
        col, p = self.col, self.pos
        width = self.pending
        while p < self.end and self.source[p] in " \t":
            step = 1 if self.source[p] == " " else 4 - col % 4
            width += step
            col += step
            p += 1
        return width

    def skip(self, columns: int) -> None:
        """Consumes up to that many columns of blanks."""
        used = min(columns, self.pending)
        self.pending -= used
        columns -= used
        while columns > 0 and self.pos < self.end and self.source[self.pos] in " \t":
            step = 1 if self.source[self.pos] == " " else 4 - self.col % 4
            self.pos += 1
            self.col += step
            if step > columns:
                self.pending = step - columns
                return
            columns -= step

    def skip_blanks(self) -> None:
        self.skip(1 << 30)

    def advance(self, n: int) -> None:
        self.pos += n
        self.col += n

    @property
    def rest(self) -> str:
        return self.source[self.pos : self.end]

    @property
    def blank(self) -> bool:
        return not self.rest.strip(" \t")


class _Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.spans = line_spans(source)
        self.blocks: list[Block] = []
        self.html: list[tuple[int, str]] = []
        self.refs: set[str] = set()
        self.stack: list[_Container] = []
        self.para: list[tuple[int, int]] = []
        self.para_line = 0
        self.fence: tuple[str, int, int] | None = None
        self.html_end: re.Pattern | None | bool = False
        self.in_code = False
        self.table = 0

    # -- leaves -------------------------------------------------------------------------------
    def emit(self, lines: list[tuple[int, int]], kind: str, line: int, skip: frozenset[int] = frozenset()) -> None:
        at: list[int] = []
        for k, (a, b) in enumerate(lines):
            if k:
                at.append(lines[k - 1][1] if self.source[lines[k - 1][1] : lines[k - 1][1] + 1] in ("\r", "\n") else a)
            at += [p for p in range(a, b) if p not in skip]
        while at and self.source[at[0]] in SPACE:
            at.pop(0)
        while at and self.source[at[-1]] in SPACE:
            at.pop()
        if not at:
            return
        content = "".join("\n" if self.source[p] in "\r\n" else self.source[p] for p in at)
        procedural = any(c.kind == "item" and c.ordered for c in self.stack)
        if kind == "paragraph" and any(c.kind == "item" for c in self.stack):
            kind = "list-item"
        self.blocks.append(Block(content, at, kind, procedural, line))

    def close_para(self, kind: str = "paragraph") -> None:
        if self.para:
            lines = self.definitions(self.para)
            if lines:
                self.emit(lines, kind, self.para_line + len(self.para) - len(lines))
        self.para = []

    def definitions(self, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Takes link reference definitions from the start of a paragraph."""
        while lines:
            text = "\n".join(self.source[a:b] for a, b in lines)
            m = re.match(r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*(?:\n[ \t]*)?[ \t](?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""", text)
            if not m or not m[1].strip():
                m = re.match(r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)""", text)
            if not m or not m[1].strip():
                break
            self.refs.add(label_key(m[1]))
            lines = lines[m[0].count("\n") if m[0].endswith("\n") else len(lines) :]
        return lines

    def close_leaf(self) -> None:
        self.close_para()
        self.fence, self.html_end, self.in_code, self.table = None, False, False, 0

    def close_to(self, depth: int) -> None:
        if depth < len(self.stack):
            self.close_leaf()
            del self.stack[depth:]

    # -- lines --------------------------------------------------------------------------------
    def read(self) -> None:
        front = front_matter_end(self.source)
        for n, (a, b, _) in enumerate(self.spans):
            if a < front:
                continue
            if a == b == len(self.source) and n == len(self.spans) - 1:
                break
            self.line(n, _Line(self.source, a, b))
        self.close_leaf()

    def matched(self, c: _Line) -> int:
        """How many open containers the line continues."""
        for k, box in enumerate(self.stack):
            if box.kind == "quote":
                if c.indent() <= 3 and c.rest.lstrip(" \t").startswith(">"):
                    c.skip_blanks()
                    c.advance(1)
                    c.skip(1)
                else:
                    return k
            elif c.blank:
                if box.empty:
                    return k
            elif c.indent() >= box.indent:
                c.skip(box.indent)
            else:
                return k
        return len(self.stack)

    def line(self, n: int, c: _Line) -> None:
        depth = self.matched(c)
        whole = depth == len(self.stack)
        if self.fence and whole:
            mark, size, _ = self.fence
            m = re.match(rf"[ ]{{0,3}}{re.escape(mark)}{{{size},}}[ \t]*$", c.rest)
            if m and c.indent() <= 3:
                self.fence = None
            return
        if self.html_end is not False and whole:
            if self.html_end is None and c.blank:
                self.html_end = False
            else:
                self.html.append((n, c.rest))
                if self.html_end is not None and self.html_end.search(c.rest):
                    self.html_end = False
                return
        if not whole and not self.para:
            self.close_to(depth)
        if self.in_code and (c.blank or c.indent() >= 4) and whole:
            return
        self.in_code = False
        opened = False
        lazy = bool(self.para) and not whole
        while True:
            if c.blank:
                if whole or not self.para:
                    for box in self.stack[depth:]:
                        pass
                self.close_to(depth)
                self.close_leaf()
                if self.stack and self.stack[-1].kind == "item" and opened:
                    self.stack[-1].empty = True
                return
            deep = c.indent() >= 4
            text = c.rest.lstrip(" \t")
            if deep:
                if self.para and not opened:
                    break
                self.close_to(depth)
                self.in_code = True
                self._filled()
                return
            if text.startswith(">"):
                self.close_to(depth)
                self.close_leaf()
                self._filled()
                c.skip_blanks()
                c.advance(1)
                c.skip(1)
                self.stack.append(_Container("quote"))
                depth, opened, lazy = len(self.stack), True, False
                continue
            if m := _ATX.match(text):
                self.close_to(depth)
                self.close_leaf()
                self._filled()
                c.skip_blanks()
                start, end = c.pos + len(m[1]), c.end
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", self.source[start:end])
                self.emit([(start, start + len(body))], "heading", n)
                return
            if m := _FENCE.match(text):
                self.close_to(depth)
                self.close_leaf()
                self._filled()
                self.fence = (m[1][0], len(m[1]), c.indent())
                return
            if self._html_start(n, c, text, depth, bool(self.para)):
                return
            if self.para and whole and not opened and (m := _SETEXT.match(text)):
                if self.definitions(self.para):
                    self.close_para("heading")
                    return
            if _RULE.match(text):
                self.close_to(depth)
                self.close_leaf()
                self._filled()
                return
            if self._list_start(c, text, depth, opened):
                depth, opened, lazy = len(self.stack), True, False
                if c.blank:
                    self.stack[-1].empty = True
                    return
                continue
            break
        if self.table and not lazy and whole and not opened:
            self.row(c, n)
            return
        if not lazy and self._table_start(n, c, depth):
            return
        if not lazy:
            if not whole or opened:
                self.close_to(depth)
            self.table = 0
        self._filled()
        c.skip_blanks()
        if not self.para:
            self.para_line = n
        self.para.append((c.pos, c.end))

    def _filled(self) -> None:
        for box in self.stack:
            box.empty = False

    def _html_start(self, n: int, c: _Line, text: str, depth: int, in_para: bool) -> bool:
        if not text.startswith("<"):
            return False
        for start, end, interrupts in _HTML_BLOCKS:
            if start.match(text) and (interrupts or not in_para):
                self.close_to(depth)
                self.close_leaf()
                self._filled()
                self.html.append((n, c.rest))
                if end is None or not end.search(text):
                    self.html_end = end
                return True
        return False

    def _list_start(self, c: _Line, text: str, depth: int, opened: bool) -> bool:
        bullet, ordered = _BULLET.match(text), _ORDERED.match(text)
        m = bullet or ordered
        if not m:
            return False
        after = text[m.end() :]
        in_list = depth < len(self.stack) and self.stack[depth].kind == "item"
        if self.para and not opened and not in_list:
            # what interrupts a paragraph: a non-empty item, and a number only if it is 1
            if not after.strip() or (ordered and int(ordered[1]) != 1):
                return False
        base = c.indent()
        self.close_to(depth)
        self.close_leaf()
        self._filled()
        c.skip_blanks()
        c.advance(m.end())
        gap = c.indent()
        if not after.strip():
            width = 1
        elif gap > 4:
            width = 1
        else:
            width = gap
        c.skip(width)
        self.stack.append(_Container("item", base + m.end() + width, bool(ordered), text[m.end() - 1]))
        return True

    # -- tables -------------------------------------------------------------------------------
    @staticmethod
    def cells(source: str, start: int, end: int) -> list[tuple[int, int]]:
        """Spans of the cells of a row; an escaped bar does not part them."""
        out, at, p = [], start, start
        while p < end:
            if source[p] == "\\":
                p += 2
                continue
            if source[p] == "|":
                out.append((at, p))
                at = p + 1
            p += 1
        out.append((at, end))
        if out and not source[out[0][0] : out[0][1]].strip():
            out.pop(0)
        if out and not source[out[-1][0] : out[-1][1]].strip():
            out.pop()
        return out

    def _table_start(self, n: int, c: _Line, depth: int) -> bool:
        if n + 1 >= len(self.spans) or c.blank:
            return False
        nxt = _Line(self.source, *self.spans[n + 1][:2])
        saved = self.stack
        if self.matched(nxt) < len(saved) or nxt.indent() >= 4:
            return False
        rule = nxt.rest.strip(" \t")
        if not _TABLE_RULE.match(rule) or ("|" not in rule and ":" not in rule and "-" not in rule):
            return False
        if "|" not in c.rest and "|" not in rule:
            return False
        columns = len([x for x in rule.strip("|").split("|")])
        c2 = self.cells(self.source, c.pos, c.end)
        if "|" not in c.rest or len(c2) != columns:
            return False
        self.close_to(depth)
        self.close_leaf()
        self._filled()
        self.table = columns
        self.row(c, n)
        self._skip_rule = n + 1
        return True

    _skip_rule = -1

    def row(self, c: _Line, n: int) -> None:
        if n == self._skip_rule:
            return
        c.skip_blanks()
        end = c.end
        while end > c.pos and self.source[end - 1] in " \t":
            end -= 1
        for a, b in self.cells(self.source, c.pos, end)[: self.table]:
            skip = frozenset(p for p in range(a, b - 1) if self.source[p : p + 2] == "\\|")
            self.emit([(a, b)], "table-cell", n, skip)


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


class _Inline:
    """Marks syntax (hidden) and code over the content of one block."""

    def __init__(self, content: str, refs: set[str]) -> None:
        self.s, self.refs = content, refs
        self.visible = bytearray(b"\1") * len(content)
        self.code = bytearray(len(content))
        self.html: list[tuple[int, int]] = []
        self.no_close: dict[int, int] = {}

    def hide(self, a: int, b: int) -> None:
        self.visible[a:b] = bytes(max(0, b - a))

    def run(self) -> None:
        self.span(0, len(self.s))

    def code_end(self, i: int) -> int:
        """End of the code span that starts at ``i``, or -1."""
        s = self.s
        n = len(s)
        j = i
        while j < n and s[j] == "`":
            j += 1
        size = j - i
        if self.no_close.get(size, -1) >= 0 and i >= self.no_close[size]:
            return -1
        k = s.find("`", j)
        while k >= 0:
            e = k
            while e < n and s[e] == "`":
                e += 1
            if e - k == size:
                return e
            k = s.find("`", e)
        self.no_close[size] = min(i, self.no_close.get(size, i))
        return -1

    def skip(self, i: int) -> int:
        """End of the token at ``i`` that brackets cannot cut: escape, code, autolink or HTML."""
        s = self.s
        ch = s[i]
        if ch == "\\" and i + 1 < len(s):
            return i + 2
        if ch == "`":
            e = self.code_end(i)
            if e > 0:
                return e
            while i < len(s) and s[i] == "`":
                i += 1
            return i
        if ch == "<":
            m = _AUTOLINK.match(s, i) or _HTML_INLINE.match(s, i)
            if m:
                return m.end()
        return i + 1

    def label_end(self, i: int, end: int, no_links: bool) -> int:
        """Position of the bracket that closes the one at ``i``, or -1."""
        p, s = i + 1, self.s
        while p < end:
            ch = s[p]
            if ch == "]":
                return p
            if ch == "[":
                image = p > i + 1 and s[p - 1] == "!" and s[p - 2 : p - 1] != "\\"
                inner = self.link_tail(p, end, image)
                if inner > 0:
                    if no_links and not image:
                        return -1
                    p = inner
                    continue
                close = self.label_end(p, end, False)
                if close < 0:
                    return -1
                p = close + 1
                continue
            p = self.skip(p)
        return -1

    def link_tail(self, i: int, end: int, image: bool = False) -> int:
        """End of the link or image whose bracket is at ``i``, or -1."""
        close = self.label_end(i, end, not image)
        if close < 0:
            return -1
        s = self.s
        if s[close + 1 : close + 2] == "(":
            e = self.destination(close + 2, end)
            if e > 0:
                return e
        if s[close + 1 : close + 2] == "[":
            e = s.find("]", close + 2, end)
            if e >= 0:
                label = s[close + 2 : e] or s[i + 1 : close]
                return e + 1 if label_key(label) in self.refs else -1
        return close + 1 if label_key(s[i + 1 : close]) in self.refs else -1

    def destination(self, p: int, end: int) -> int:
        s = self.s
        m = re.compile(r"\s*").match(s, p, end)
        p = m.end()
        if s[p : p + 1] == "<":
            m = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(s, p, end)
            if not m:
                return -1
            p = m.end()
        else:
            depth = 0
            while p < end and s[p] not in " \t\n" and ord(s[p]) >= 32:
                if s[p] == "\\" and p + 1 < end:
                    p += 2
                    continue
                if s[p] == "(":
                    depth += 1
                elif s[p] == ")":
                    if not depth:
                        break
                    depth -= 1
                p += 1
            if depth:
                return -1
        tail = re.compile(r"""(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S).match(s, p, end)
        return tail.end() if tail else -1

    def span(self, i: int, end: int) -> None:
        s = self.s
        delims: list[list] = []
        while i < end:
            ch = s[i]
            if ch == "\\" and i + 1 < end:
                i += 2
            elif ch == "`":
                e = self.code_end(i)
                if 0 < e <= end:
                    self.hide(i, e)
                    self.code[i:e] = b"\1" * (e - i)
                    i = e
                else:
                    i = self.skip(i)
            elif ch == "<":
                m = _AUTOLINK.match(s, i, end)
                if not m and (m := _HTML_INLINE.match(s, i, end)):
                    self.html.append((i, m.end()))
                if m:
                    self.hide(i, m.end())
                    i = m.end()
                else:
                    i += 1
            elif ch == "!" and s[i + 1 : i + 2] == "[":
                e = self.link_tail(i + 1, end, True)
                if e > 0:
                    self.hide(i, e)
                    i = e
                else:
                    i += 2
            elif ch == "[":
                e = self.link_tail(i, end)
                if e > 0:
                    close = self.label_end(i, end, True)
                    self.span(i + 1, close)
                    self.hide(i, i + 1)
                    self.hide(close, e)
                    i = e
                else:
                    i += 1
            elif ch in "*_~":
                j = i
                while j < end and s[j] == ch:
                    j += 1
                self.delimiter(delims, ch, i, j)
                i = j
            else:
                i += 1
        self.resolve(delims)

    def delimiter(self, delims: list[list], ch: str, i: int, j: int) -> None:
        before = self.s[i - 1] if i else " "
        after = self.s[j] if j < len(self.s) else " "
        space = lambda c: c.isspace()
        punct = lambda c: bool(_PUNCTUATION.match(c))
        left = not space(after) and (not punct(after) or space(before) or punct(before))
        right = not space(before) and (not punct(before) or space(after) or punct(after))
        can_open, can_close = left, right
        if ch == "_":
            can_open, can_close = left and (not right or punct(before)), right and (not left or punct(after))
        size = j - i
        if ch == "~":
            if size < 2:
                return
            for k in range(i + size % 2, j, 2):
                delims.append([ch, k, k + 2, can_open, can_close, size, True])
            return
        for k in range(i, j):
            delims.append([ch, k, k + 1, can_open, can_close, size, True])

    def resolve(self, delims: list[list]) -> None:
        """Pairs delimiters; paired ones are hidden."""
        floor: dict[tuple, int] = {}
        for c in range(len(delims)):
            ch, a, b, _, closes, size, free = delims[c]
            if not closes or not free:
                continue
            key = (ch, delims[c][3], size % 3)
            o = c - 1
            while o > floor.get(key, -1):
                x = delims[o]
                # a run that both opens and closes must not add up to a multiple of 3
                odd = (x[4] or delims[c][3]) and (x[5] + size) % 3 == 0 and not (x[5] % 3 == 0 and size % 3 == 0)
                same_run = x[2] <= a and x[0] == ch and self.s[x[1] : b] == ch * (b - x[1]) and x[1] >= a - size
                if x[0] == ch and x[3] and x[6] and not odd and not (same_run and self._one_run(x[1], b, ch)):
                    x[6] = delims[c][6] = False
                    self.hide(x[1], x[2])
                    self.hide(a, b)
                    for y in delims[o + 1 : c]:
                        y[6] = False
                    break
                o -= 1
            else:
                floor[key] = c - 1

    def _one_run(self, a: int, b: int, ch: str) -> bool:
        return all(x == ch for x in self.s[a:b])


def _runs(flags: bytearray, at: list[int], floor: int = 0) -> list[tuple[int, int]]:
    """Source spans of flagged characters, neighbours joined."""
    out: list[list[int]] = []
    for f, p in zip(flags, at):
        if f and p >= floor:
            if out and out[-1][1] == p:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1])
    return [(a, b) for a, b in out]


def parse(source: str) -> Parsed:
    reader = _Reader(source)
    reader.read()
    masked = [c if c in "\r\n" else " " for c in source]
    blocks, html = [], list(reader.html)
    for b in reader.blocks:
        inline = _Inline(b.content, reader.refs)
        inline.run()
        for i, j in inline.html:
            html.append((b.line + b.content.count("\n", 0, i), b.content[i:j]))
        b.segments = _runs(inline.visible, b.at)
        if not b.segments:
            continue
        for x, y in b.segments:
            masked[x:y] = source[x:y]
        b.code = _runs(inline.code, b.at)
        start = b.segments[0][0]
        b.admonition = admonition_word(source[start : start + 48])
        blocks.append(b)
    return Parsed(source, "".join(masked), blocks, sorted(html, key=lambda x: x[0]))
