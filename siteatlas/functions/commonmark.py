"""Headings and links of CommonMark texts: container blocks, leaf blocks, and inlines by a bracket and a delimiter stack.

Read are block quotes and nested lists (a line continues, opens or lazily
continues them), ATX and setext headings, fenced and indented code, HTML blocks,
link definitions; code spans, autolinks, raw tags, inline and reference links,
images, emphasis, escapes and character references. A text is read line by line
and each block once; what is left out: definitions whose title is on a line of
its own.
"""

from __future__ import annotations

import re
from html import unescape

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_DEFINITION = re.compile(r"""\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(?:<([^<>\n]*)>|(\S+))[ \t]*(?:"[^"]*"|'[^']*'|\([^()]*\))?[ \t]*$""")
# Elements whose tags begin an HTML block that ends with a blank line.
_BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
_TAG = r"""<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']{0,4000}'|"[^"]{0,4000}"))?){0,200}\s*/?)>"""
_HTML = [  # how a block of this kind begins, and the line that ends it
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.IGNORECASE), re.compile(r"</(?:script|pre|style|textarea)>", re.IGNORECASE)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS)})(?:\s|/?>|$)", re.IGNORECASE), None),
    (re.compile(_TAG + r"\s*$"), None),
]


def lines_of(text: str) -> list[str]:
    """Lines with their ends; a line ends with \\n, \\r or both."""
    return _LINE.findall(text)


def _indent(line: str) -> tuple[int, str]:
    """Columns of white space at the start, and the rest."""
    body = line.lstrip(" \t")
    return len(line[: len(line) - len(body)].expandtabs(4)), body


class Blocks:
    """(kind, number of its first line, text) of headings and paragraphs, and link definitions by name."""

    def __init__(self, lines: list[str]):
        self.found: list[tuple[str, int, str]] = []
        self.known: dict[str, str] = {}
        self.open: list[tuple[str, int]] = []  # containers: ("quote", 0), ("item", columns of its text)
        self.paragraph: list[str] = []
        self.start = 0
        self.code: tuple[str, int] | None = None  # the open fence
        self.html: re.Pattern | bool | None = None  # what ends the open HTML block; False: a blank line
        self.blank = False
        for n, line in enumerate(lines):
            self._line(n, line.rstrip("\r\n"))
        self._close()

    def _close(self) -> None:
        """The paragraph ends; definitions at its start are taken out."""
        held, self.paragraph = self.paragraph, []
        n = 0
        while n < len(held) and (m := _DEFINITION.match(held[n])):
            self.known.setdefault(name_of(m[1]), unescape(_ESCAPED.sub(r"\1", m[2] if m[2] is not None else m[3])))
            n += 1
        if held[n:]:
            self.found.append(("text", self.start + n, "\n".join(held[n:])))

    def _leave(self, depth: int) -> None:
        if len(self.open) > depth:
            self._close()
            del self.open[depth:]
            self.code = self.html = None

    def _line(self, n: int, line: str) -> None:
        rest, depth, last = line, 0, self.blank
        for kind, columns in self.open:  # containers that the line continues
            indent, body = _indent(rest)
            if kind == "quote" and indent < 4 and body.startswith(">"):
                rest = body[1:]
                rest = rest[1:] if rest.startswith((" ", "\t")) else rest
            elif kind == "item" and (not body or indent >= columns):
                rest = " " * (indent - columns) + body if body else ""
            else:
                break
            depth += 1
        whole = depth == len(self.open)
        if whole and (self.code or self.html is not None):
            self._verbatim(rest)
            self.blank = False
            return
        opened = False
        while True:  # containers that it opens
            indent, body = _indent(rest)
            if indent >= 4 or not body:
                break
            if body.startswith(">"):
                kind, rest = ("quote", 0), body[1:]
                rest = rest[1:] if rest.startswith((" ", "\t")) else rest
            elif (m := _MARKER.match(body)) and not _RULE.match(body):
                after = body[m.end() :]
                spaces, inner = _indent(after)
                if self.paragraph and whole and not opened and (not inner or m[2] not in (None, "1")):
                    break  # an empty item, or one that doesn't begin at 1, is no interruption
                pad = spaces if inner and 1 <= spaces <= 4 else 1
                kind, rest = ("item", indent + m.end() + pad), " " * (spaces - pad) + inner if inner else ""
            else:
                break
            self._leave(depth)
            self._close()
            self.open.append(kind)
            depth, whole, opened = depth + 1, True, True
        self._leaf(n, rest, depth, whole, opened, last)

    def _verbatim(self, rest: str) -> None:
        indent, body = _indent(rest)
        if self.code:
            if indent < 4 and (m := _FENCE.match(body)) and m[1][0] == self.code[0] and len(m[1]) >= self.code[1] and not m[2].strip():
                self.code = None
        elif self.html is False:
            if not body:
                self.html = None
        elif self.html.search(rest):
            self.html = None

    def _leaf(self, n: int, rest: str, depth: int, whole: bool, opened: bool, last: bool) -> None:
        indent, body = _indent(rest)
        self.blank = not body
        if not body:
            if not whole and self.open[depth][0] == "quote":
                self._leave(depth)
            self._close()
            return
        if indent >= 4 and (not self.paragraph or opened):
            if not whole:
                self._leave(depth)
            return  # indented code
        if indent < 4:
            fence, atx = _FENCE.match(body), _ATX.match(body)
            kind = next((i for i, (begin, _) in enumerate(_HTML) if begin.match(body)), None) if body[0] == "<" else None
            if kind == len(_HTML) - 1 and self.paragraph:
                kind = None
            setext = _SETEXT.match(body) if self.paragraph and whole and not opened else None
            if (fence and not (fence[1][0] == "`" and "`" in fence[2])) or atx or kind is not None or setext or _RULE.match(body):
                if not whole:
                    self._leave(depth)
                if setext:
                    held, self.paragraph = self.paragraph, []
                    self.found.append((f"h{1 if setext[1][0] == '=' else 2}", self.start, "\n".join(x.strip() for x in held)))
                    return
                self._close()
                if atx:
                    self.found.append((f"h{len(atx[1])}", n, (atx[2] or "").strip()))
                elif kind is not None:
                    self.html = _HTML[kind][1] or False
                    if self.html and self.html.search(body):
                        self.html = None
                elif fence:
                    self.code = (fence[1][0], len(fence[1]))
                return
        if not whole and (not self.paragraph or last):
            self._leave(depth)  # else a lazy line: the paragraph goes on
        if not self.paragraph:
            self.start = n
        self.paragraph.append(body)


_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_RUN = re.compile(r"[^\\`<!\[\]*_&]+")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_RAW = re.compile(_TAG + r"|<!--(?:(?!-->).){0,4000}-->|<\?.{0,4000}?\?>|<![A-Za-z][^>]{0,4000}>", re.DOTALL)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TARGET = re.compile(r"""\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*|))(?:\s+(?:"(?:[^"\\]|\\.){0,2000}"|'(?:[^'\\]|\\.){0,2000}'|\((?:[^()\\]|\\.){0,2000}\)))?\s*\)""")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]")


def name_of(label: str) -> str:
    """The name by which a definition is found."""
    return " ".join(label.split()).casefold()


class _Item:
    __slots__ = ("active", "begin", "closes", "end", "kind", "left", "opens", "target", "text")

    def __init__(self, kind, text="", begin=0, end=0, target=None):
        self.kind, self.text, self.begin, self.end, self.target = kind, text, begin, end, target
        self.left, self.opens, self.closes, self.active = 0, False, False, True


def _delimiter(text: str, begin: int, end: int) -> _Item:
    """A run of * or _, with what it may open and close."""
    before, after = text[begin - 1] if begin else " ", text[end] if end < len(text) else " "
    mark = lambda c: not (c.isalnum() or c.isspace())
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    out = _Item("run", text[begin], begin, end)
    out.left = end - begin
    out.opens = left and (text[begin] == "*" or not right or mark(before))
    out.closes = right and (text[begin] == "*" or not left or mark(after))
    return out


def _emphasised(items: list[_Item]) -> None:
    """Delimiters that belong together go."""
    stack: list[_Item] = []
    floor: dict[tuple, int] = {}
    for item in items:
        if item.kind != "run":
            continue
        while item.closes and item.left:
            key, at = (item.text, item.opens, item.left % 3), len(stack) - 1
            least = floor.get(key, 0)
            while at >= least:
                o = stack[at]
                if o.text == item.text and o.left and not ((o.closes or item.opens) and (o.left + item.left) % 3 == 0 and not (o.left % 3 == 0 and item.left % 3 == 0)):
                    break
                at -= 1
            if at < least:
                floor[key] = len(stack)
                break
            o, n = stack[at], 2 if stack[at].left >= 2 and item.left >= 2 else 1
            o.left, item.left = o.left - n, item.left - n
            del stack[at + 1 :]
            if not o.left:
                stack.pop()
            floor = {k: min(v, len(stack)) for k, v in floor.items()}
        if item.opens and item.left:
            stack.append(item)


def _text(items: list[_Item]) -> str:
    _emphasised(items)
    return "".join(i.text * i.left if i.kind == "run" else i.text for i in items)


def inlines(text: str, known: dict[str, str]) -> list[_Item]:
    """A block's inlines; links have target, and their own text."""
    items: list[_Item] = []
    brackets: list[int] = []
    unclosed: set[int] = set()  # lengths of backtick runs that nothing closes any more
    i, size = 0, len(text)
    while i < size:
        c = text[i]
        if m := _RUN.match(text, i):
            items.append(_Item("text", m[0], i, m.end()))
            i = m.end()
        elif c == "\\":
            n = 2 if _ESCAPED.match(text, i) else 1
            items.append(_Item("text", text[i + n - 1], i, i + n))
            i += n
        elif c == "`":
            end = i
            while end < size and text[end] == "`":
                end += 1
            close = None if end - i in unclosed else re.compile(f"(?<!`)`{{{end - i}}}(?!`)").search(text, end)
            if close:
                inner = text[end : close.start()].replace("\n", " ")
                items.append(_Item("code", inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner, i, close.end()))
                i = close.end()
            else:
                unclosed.add(end - i)
                items.append(_Item("text", text[i:end], i, end))
                i = end
        elif c == "<":
            if m := _AUTO.match(text, i):
                items.append(_Item("link", m[1], i, m.end(), m[1]))
            elif m := _RAW.match(text, i):
                items.append(_Item("tag", "", i, m.end()))
            else:
                items.append(_Item("text", "<", i, i + 1))
            i = items[-1].end
        elif c == "&":
            m = _REFERENCE.match(text, i)
            items.append(_Item("text", unescape(m[0]) if m else "&", i, m.end() if m else i + 1))
            i = items[-1].end
        elif c in "*_":
            end = i
            while end < size and text[end] == c:
                end += 1
            items.append(_delimiter(text, i, end))
            i = end
        elif c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
            n = 1 if c == "[" else 2
            brackets.append(len(items))
            items.append(_Item("image" if n == 2 else "bracket", text[i : i + n], i, i + n))
            i += n
        elif c == "]" and brackets:
            i = _closed(text, i, items, brackets, known)
        else:
            items.append(_Item("text", c, i, i + 1))
            i += 1
    return items


def _closed(text: str, i: int, items: list[_Item], brackets: list[int], known: dict[str, str]) -> int:
    """A closing bracket: what stands since the last open one becomes a link or an image, or stays."""
    at = brackets.pop()
    opener, target, end = items[at], None, i + 1
    if opener.active:
        if m := _TARGET.match(text, i + 1):
            target, end = unescape(_ESCAPED.sub(r"\1", m[1] if m[1] is not None else m[2])), m.end()
        else:
            m = _LABEL.match(text, i + 1)
            label = m[1] if m and m[1].strip() else text[opener.end : i]
            target = known.get(name_of(label)) if len(label) < 1000 else None
            end = m.end() if m else end
    if target is None:
        items.append(_Item("text", "]", i, i + 1))
        return i + 1
    link = opener.kind == "bracket"
    own = _Item("link" if link else "picture", _text(items[at + 1 :]), opener.begin, end, target)
    items[at:] = [own]
    if link:
        for b in brackets:
            if items[b].kind == "bracket":
                items[b].active = False
    return end


def plain(items: list[_Item]) -> str:
    return _text(items)


def links_of(text: str, known: dict[str, str]) -> list[tuple[str, str, str]]:
    """(label, target, what follows in the block) of each link."""
    items = inlines(text, known)
    _emphasised(items)
    said = [i.text * i.left if i.kind == "run" else i.text for i in items]
    out, tail = [], ""
    for n in range(len(items) - 1, -1, -1):
        if items[n].kind == "link":
            out.append((items[n].text, items[n].target, tail[:TAIL]))
        tail = (said[n] + tail)[: 2 * TAIL]
    return out[::-1]


#: Characters of a description that are kept.
TAIL = 4000
