"""Main text of HTML pages by line-block distribution.

Markup is cut into lines, one for each block element; where a container outside
an article or main element begins or ends, an empty line stands. A line's length
counts as zero where it belongs to page furniture (by element, role or class
name) or, outside an article or main element, where most of it is link text.
Lengths are summed over sliding windows of lines. Text begins where a window
surges over a threshold (outside an article or main element a share of the page's
greatest window within bounds), with the lines that lead to it, and ends where the window dives to zero or at the border of an article or main
element; the lines of non-zero length between are the article.

On a page that has an article or main element with text, what surges inside it
is the text. What surges outside is a second reading: it takes over, for the whole
page, only with several lines that hold more than OUTSIDE times as much, lines of
a pattern that repeats (containers of one class, as of comments or teasers) not
counted.

Defined results: a null or empty page, and a page without such a surge, give
empty text; every row gives one row, repeated rows too, an empty table none;
columns of `keep` named text or n_chars are an error. Unclosed elements end with
the element around them; an unclosed comment or script runs to the end of the
page, as in browsers. From the first tag whose quotes don't close on, tags end at
their first >, so any page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siteatlas.llm.storage import table, tune

WINDOW = 3
#: Least and greatest threshold of a surge, and the share of the page's greatest window between them.
SURGE, SURGE_MOST, SURGE_SHARE = 40, 120, 0.04
INSIDE, OUTSIDE, REPEATED = 4, 2, 3

_RAW = frozenset("script style noscript template iframe svg object textarea select button canvas title".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in _RAW}
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_FURNITURE = frozenset("nav footer aside form menu dialog head fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form toolbar".split())
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar widget related share sharing social comment comments respond disqus replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search toolbar pagination pager hidden".split()
)
_CONTAINERS = frozenset("div section main article aside header footer nav".split())
_LINKING = frozenset("with has no without".split())
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|[0-9]+")


def _furniture(tag: str, attrs: str, inside: bool, names: bool = True) -> bool:
    """inside: within the article or main element, whose own header stays."""
    if tag in _FURNITURE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if names and name in ("class", "id"):
            for word in value.split():
                parts = [x.lower() for x in _PART.findall(word)]
                ends = {parts[0], parts[-1]} & _NAMES if parts else set()
                if inside:
                    ends -= {"header"}
                if ends and not _LINKING & set(parts):
                    return True
    return False


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, / of an end tag, tag in lower case, attributes) of all markup; the tag is empty for comments and raw elements, which are one token each."""
    at, last, strict = 0, page.rfind(">"), True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            yield begin, at, "", "", ""
            continue
        if begin > last:
            return  # no tag ends any more
        m = _NAME.match(page, begin + 1)
        if not m:
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.find(">", begin) + 1
                yield begin, at, "", "", ""
            else:
                at = begin + 1
            continue
        found = _QUOTED.match(page, m.end()) if strict else None
        strict = strict and found is not None
        at = found.end() if found else page.find(">", m.end()) + 1
        if not at:
            return
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            end = _CLOSING[tag].search(page, at)
            at = end.end() if end else len(page)
            yield begin, at, "", "title" if tag == "title" else "", "raw"
            continue
        yield begin, at, m[1], tag, page[m.end() : at - 1]


Line = tuple[str, bool, bool, float, bool]


def lines_of(page: str, names: bool = True) -> list[Line]:
    """(text, furniture, in an article or main element, share of link text, of a repeated pattern) of each block, in page order; empty text where a container begins or ends."""
    out: list = []
    open_: list[tuple[str, bool, bool, bool, tuple]] = []  # tag, furniture, main, link, patterns; each holds for what is inside
    depth: dict[str, int] = {}  # how many of each tag are open
    elements: dict[str, int] = {}  # how many elements have the pattern
    text: list[str] = []
    linked = size = 0
    at = 0

    def close_tag() -> str:
        tag = open_.pop()[0]
        depth[tag] -= 1
        return tag

    def close_line():
        nonlocal text, linked, size
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, bad, main, linked / size if size else 0.0, patterns))
        text, linked, size = [], 0, 0

    bad = main = link = False
    patterns: tuple = ()
    for begin, end, ending, tag, attrs in _tokens(page):
        if begin > at:
            piece = page[at:begin]
            text.append(piece)
            n = len(piece.strip())
            size += n
            linked += n if link else 0
        at = end
        if not tag or attrs == "raw":
            if tag:
                close_line()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            close_line()
            if tag in _CONTAINERS and not main:
                out.append(("", False, False, 0.0, ()))
        if tag in _VOID:
            continue
        if ending:
            if depth.get(tag):
                while close_tag() != tag:
                    pass
        else:
            if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                while open_ and (open_[-1][0] == tag or (open_[-1][0] in _INLINE | {"p"} and any(x[0] == tag for x in open_[-2:]))):
                    close_tag()
            flaw = _furniture(tag, attrs, main, names)
            own = patterns
            if tag in ("div", "li", "section", "article") and (m := _CLASS.search(attrs)):
                pattern = f"{tag} {' '.join((m[1] or m[2] or m[3] or '').split())}"
                elements[pattern] = elements.get(pattern, 0) + 1
                own = (*patterns[-7:], pattern)
            depth[tag] = depth.get(tag, 0) + 1
            open_.append((tag, bad or flaw, main or (tag in ("article", "main") and not flaw), link or tag == "a", own))
        bad, main, link, patterns = open_[-1][1:] if open_ else (False, False, False, ())
    if at < len(page):
        text.append(page[at:])
        size += len(page) - at
    close_line()
    return [(line, shut, inside, share, any(elements[x] >= REPEATED for x in own)) for line, shut, inside, share, own in out]


def _found(size: list[float], main: list[bool], window: int, surge: int, share: float) -> list[int]:
    """Which lines stand between a surge and the dive after it; no window reaches over the border of an article or main element."""
    runs, begin = [], 0
    while begin < len(size):
        end = begin
        while end < len(size) and main[end] == main[begin]:
            end += 1
        sums = list(itertools.accumulate(size[begin:end], initial=0))
        runs.append((begin, size[begin:end], [sums[min(i + window, end - begin)] - sums[i] for i in range(end - begin)]))
        begin = end
    least = max(surge, min(surge * SURGE_MOST / SURGE, share * max((max(total) for _, _, total in runs), default=0)))
    kept: list[int] = []
    for begin, own, total in runs:
        i = 0
        while i < len(own):
            if own[i] and total[i] >= least:
                first = i
                while first and own[first - 1] and (not kept or kept[-1] < begin + first - 1):
                    first -= 1  # lines right before the surge, as headings are
                kept += range(begin + first, begin + i)
                while i < len(own) and total[i]:
                    if own[i]:
                        kept.append(begin + i)
                    i += 1
            else:
                i += 1
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SURGE_SHARE, names: bool = True) -> str:
    """names: whether class names and identifiers tell furniture."""
    lines = lines_of(page or "", names)
    main = [m for _, _, m, _, _ in lines]
    size = [0 if bad or (linked > 0.6 and not m) else len(line) for line, bad, m, linked, _ in lines]
    inside = _found([n * INSIDE if m else 0 for n, m in zip(size, main, strict=True)], main, window, surge, 0.0)
    other = _found([0 if m else n for n, m in zip(size, main, strict=True)], main, window, surge, share)
    held = sum(size[i] for i in inside)
    if not held:
        return " ".join(lines[i][0] for i in other)
    rival = [size[i] for i in other if not lines[i][4]]
    if len(rival) > 2 and sum(rival) - max(rival) > OUTSIDE * held:
        inside = _found(size, main, window, surge, share)
    return " ".join(lines[i][0] for i in inside)


def extract_main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """The columns of `keep`, text, n_chars for each row of df."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would come twice")
    tune(df.sparkSession)
    kept = df.select(*(df[c] for c in keep))
    schema = kept.select("*").schema.add("text", "string").add("n_chars", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow)

    return df.select(*(df[c] for c in keep), df[html_col].alias("_html")).mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
