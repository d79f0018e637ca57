"""The content of a page, by a tree of its elements.

Lines of text are the leaves. A line is worth the letters that it has more than
those of its links, twice counted, less a price that short lines don't reach;
headings and table cells pay none. Values go up the tree: an element holds what
its lines and elements are worth, but none that is worth less than nothing, and
a section, list or other container only for what it has above the price of
taking it in. The content is the element of the greatest value, with what that
value counts. So one long block wins over the page around it, and several blocks
of text win together. Main and article elements count half as much again.

Furniture (menus, headers, footers, sidebars, forms, adverts) and readers'
comments have no part in it. The loose reading, for pages with little text and
many links, has no prices and takes furniture too, comments never.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CONTAINERS = frozenset("div section article main aside ul ol dl figure details fieldset header footer nav form menu blockquote".split())
FREE = frozenset("h1 h2 h3 h4 h5 h6 th td caption dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PRICE, JOIN, LINKED, PRIOR = 20.0, 60.0, 2.0, 1.5


@dataclass
class Tree:
    """Elements in document order, each behind the one that holds it; lines with the element that they stand in."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    up: list[int] = field(default_factory=lambda: [-1])
    furniture: list[bool] = field(default_factory=lambda: [False])
    comment: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    lines: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, letters inside links

    def add(self, tag: str, up: int, furniture: bool, comment: bool, main: bool) -> int:
        self.tag.append(tag)
        self.up.append(up)
        self.furniture.append(furniture or self.furniture[up])
        self.comment.append(comment or self.comment[up])
        self.main.append(main or self.main[up])
        return len(self.tag) - 1


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def line_values(tree: Tree, price: float = PRICE) -> list[float]:
    """What each line is worth; a heading's worth is with the lines that follow it."""
    out = []
    for at, text, linked in tree.lines:
        if tree.furniture[at] or tree.comment[at]:
            out.append(-1.0)
            continue
        n = _letters(text)
        value = (n - LINKED * linked) - (0.0 if tree.tag[at] in FREE else price)
        if tree.tag[at] in HEADINGS:
            value = min(value, 0.0)
        out.append(value * (PRIOR if tree.main[at] and value > 0 else 1.0))
    return out


def best_lines(tree: Tree, price: float = PRICE, join: float = JOIN) -> list[int]:
    """Numbers of the lines of the element of the greatest value, the outermost of equal ones."""
    worth = line_values(tree, price)
    value = [0.0] * len(tree.tag)
    for (at, _, _), x in zip(tree.lines, worth, strict=True):
        value[at] += max(x, 0.0)
    gain = [0.0] * len(tree.tag)
    for i in range(len(tree.tag) - 1, -1, -1):
        gain[i] = value[i] - (join if tree.tag[i] in CONTAINERS else 0.0)
        if gain[i] > 0 and tree.up[i] >= 0:
            value[tree.up[i]] += gain[i]
    top = max(range(len(tree.tag)), key=lambda i: (value[i], -i))
    if value[top] <= 0:
        return []
    inside = [False] * len(tree.tag)
    inside[top] = True
    for i in range(top + 1, len(tree.tag)):
        inside[i] = inside[tree.up[i]] and (gain[i] > 0 or tree.tag[i] in HEADINGS)
    kept, title = [], None
    for n, ((at, text, _), x) in enumerate(zip(tree.lines, worth, strict=True)):
        if not inside[at] or x < 0 or not text:
            continue
        if tree.tag[at] in HEADINGS:
            title = n  # stays if a line follows it before the next one
            continue
        if title is not None:
            kept.append(title)
            title = None
        kept.append(n)
    return kept


def content(tree: Tree) -> tuple[str, str]:
    """Text of the content, a line for each block, and the loose reading."""
    return "\n".join(tree.lines[n][1] for n in best_lines(tree)), "\n".join(text for at, text, _ in tree.lines if text and not tree.comment[at])
