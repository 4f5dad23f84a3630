"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier on tags, class names, link share and
length gives each block a cost for either label: the capacities of its edges to the two
terminals. Blocks that follow each other, and blocks under the same element, are tied
by edges whose weight is the price of labelling them differently. The minimum cut,
found by max-flow, separates content from boilerplate. Blocks whose own capacity is
over that of all their ties are settled before, which leaves the cut the same.

Blocks of menus, headers and footers of the page, sidebars, notices, adverts, forms and
reader comments are boilerplate by rule. Class names and ids alone mark an element as such
only until it is seen to hold the page's content: it is let off, and the cut decides, if
it holds a main element, or an article or one of good name whose text is over 4 times
the content outside such elements. Names like has-sidebar tell of a layout and mark nothing;
within an article a name marks only if it says nothing else (ad-box does, notice-of-race
does not); article and main themselves are marked by names of reader comments alone.
Pages are read in linear time, whatever their tags.
Scripts, styles and comments are never text.
Character references are decoded, white space in a block (and ``<br>``) becomes one
space, and blocks are joined by one line feed. Null html is empty, and a page without
content gives an empty text. Each row is a page of its own; repeated rows, null ids and
unclosed or crossed tags are allowed. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import slices

_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"""[^>"']*""")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "blockquote"}
_JUNK_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "noscript", "object", "canvas", "audio", "video", "search"}
_JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_JUNK_WORDS = set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs sidebar sidebars aside rail footer footers masthead topbar toolbar comment comments commentlist respond disqus reply replies discussion share sharing social related recommended recommendations teaser teasers widget widgets pagination pager login search copyright disclaimer skip feedback".split())
_COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "disqus", "reply", "replies"}
_FILLERS = set("box block wrap wrapper container inner outer area section list item items group holder panel bar link links post posts page site top bottom left right small large main first last the a form field title text button buttons thread author meta body content js wp".split())
_HEADER_WORDS = {"header", "heading", "head"}
_GOOD_WORDS = set("article post entry story content main maincontent maintext articlebody text body".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_LAYOUT = {"no", "not", "has", "have", "with", "without"}
JUNK = -1e6
OUTSIDE = 4
NESTED = 64  # elements marked by name within each other; deeper ones count as part of the last


def _kind(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is boilerplate by rule or by its names, whether it marks
    content, and whether it is the main element."""
    soft, chief = False, name == "main"
    junk, good = name in _JUNK_TAGS or (name == "header" and not inside), name in ("article", "main")
    if "=" in attrs and name not in ("html", "body"):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                tokens = [[w.lower() for w in _SPLIT.split(t) if w] for t in value.split()]
                tokens = [set(t) for t in tokens if t and t[0] not in _LAYOUT]
                words = set().union(*tokens)
                if name in ("article", "main"):
                    soft |= bool(words & _COMMENT_WORDS)
                elif inside:  # in an article a name must speak of nothing else
                    soft |= any(t & _JUNK_WORDS and t <= _JUNK_WORDS | _FILLERS for t in tokens)
                else:
                    soft |= bool(words & _JUNK_WORDS or (words & _HEADER_WORDS and not words & _GOOD_WORDS))
                good |= name not in _INLINE and any(t & _GOOD_WORDS and not t & _JUNK_WORDS for t in tokens)
            elif key == "role":
                junk |= value.lower() in _JUNK_ROLES
                good |= value.lower() in ("main", "article")
                chief |= value.lower() == "main"
            elif key == "style":
                junk |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key == "aria-hidden":
                junk |= value.lower() == "true" and name not in _INLINE
    if not junk and re.search(r"(?:^|\s)hidden(?:[\s/=]|$)", attrs, re.I) and "hidden" not in "".join(x[1] + x[2] for x in _ATTR.findall(attrs)):
        junk = True
    return junk, soft, good, chief


def blocks(page: str) -> list[tuple]:
    """(text, tag, junk, good, share of link text, parent, grandparent) in page order."""
    return _let_off(_marked(page))


def _let_off(marked: list[tuple]) -> list[tuple]:
    """Drop the marks by name of elements that hold the page's content, outermost first."""
    found = [m[0] for m in marked]
    ends: dict[int, list[int]] = {}  # by element: its blocks
    for i, (_, hard, softs, _, _) in enumerate(marked):
        for s in () if hard else softs:
            ends.setdefault(s, []).append(i)
    if not ends:
        return found
    left = [set(m[2]) for m in marked]
    fair = [0 if m[1] else len(b[0]) * (cost((*b[:2], False, *b[3:])) > 0) for b, m in zip(found, marked)]
    clean = sum(n for n, x in zip(fair, left) if not x)
    for s in sorted(ends):
        held = [i for i in ends[s] if marked[i][2].index(s) < marked[i][3]]
        if not held:
            continue
        chief = any(marked[i][2].index(s) < marked[i][4] for i in held)
        if chief or sum(fair[i] for i in held) > OUTSIDE * clean:
            for i in ends[s]:
                left[i].discard(s)
                if not left[i]:
                    clean += fair[i]
    return [b if m[1] or x else (*b[:2], False, *b[3:]) for b, m, x in zip(found, marked, left)]


def tokens(page: str):
    """Text and markup in page order, in time linear in the page: ("text", text),
    ("open", name, attributes, end) and ("close", name); what is raw is left to the
    caller, who sends the place to go on from.

    A tag ends at the first ``>`` outside quotes. Where none is left, quotes protect
    nothing in the rest of the page; a tag without any ``>`` takes the rest."""
    at, n, quotes = 0, len(page), True
    while at < n:
        begun = at
        while True:
            at = page.find("<", at)
            if at < 0 or page[at + 1 : at + 2] in ("!", "?") or _NAME.match(page, at + 1) or (page[at + 1 : at + 2] == "/" and _NAME.match(page, at + 2)):
                break
            at += 1
        if at < 0:
            yield "text", page[begun:]
            return
        if at > begun:
            yield "text", page[begun:at]
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.index(">", at + 4) + 1
            else:
                m = _COMMENT_END.search(page, at + 4)
                at = m.end() if m else n
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield "text", page[at + 9 :] if end < 0 else page[at + 9 : end]
            at = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closing = page[at + 1] == "/"
        m = _NAME.match(page, at + 1 + closing)
        end = m.end()
        while quotes:
            end = _PLAIN.match(page, end).end()
            if end == n:
                quotes = False
            elif page[end] == ">":
                break
            else:
                end = page.find(page[end], end + 1) + 1
                quotes = end > 0
        if not quotes:
            end = page.find(">", m.end())
            if end < 0:
                return
        if closing:
            at = end + 1
            yield "close", m[0].lower()
        else:
            at = yield "open", m[0].lower(), page[m.end() : end], end + 1


class _Open:
    """Open elements, with what closing and blocks ask for at no cost of depth."""

    def __init__(self):
        self.stack: list[tuple] = [("", False, False, 0, False, (), 0, 0)]  # name, junk, good, serial, and what _marked gives
        self.walls = [0]  # places of elements that are not inline
        self.at: dict[str, list[int]] = {}  # by name: places
        self.links = 0

    def push(self, element: tuple):
        name = element[0]
        if name not in _INLINE:
            self.walls.append(len(self.stack))
        self.at.setdefault(name, []).append(len(self.stack))
        self.links += name == "a"
        self.stack.append(element)

    def close(self, i: int):
        while len(self.stack) > i:
            name = self.stack.pop()[0]
            self.at[name].pop()
            self.links -= name == "a"
        while self.walls[-1] >= i:
            self.walls.pop()

    def last(self, names) -> int:
        """Place of the innermost open element of these names, or 0."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)


def _marked(page: str) -> list[tuple]:
    """Each block, whether it is boilerplate whatever the names, the elements around it
    that are so by name, and how many of these hold content marks, and main, around it."""
    out: list[tuple] = []
    opened = _Open()
    stack = opened.stack
    serial, parts, linked = 0, [], 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                i = opened.walls[-1]
                block = (text, stack[i][0], stack[-1][1], stack[-1][2], min(1.0, linked / len(text)), stack[max(0, i - 1)][3], stack[max(0, i - 2)][3])
                out.append((block, *stack[-1][4:]))
            parts, linked = [], 0

    low, go_on = None, None
    scan = tokens(page)
    while True:
        try:
            token = scan.send(go_on)
        except StopIteration:
            break
        go_on = None
        if token[0] == "text":
            text = html.unescape(token[1]) if "&" in token[1] else token[1]
            parts.append(text)
            if opened.links:
                linked += len(text)
            continue
        name = token[1]
        inline = name in _INLINE
        if name == "br":
            parts.append(" ")
            go_on = None if token[0] == "close" else token[3]
            continue
        if token[0] == "close":
            i = opened.last((name,))
            if i and not (inline and opened.walls[-1] > i):
                if not inline or stack[i][1] != stack[i - 1][1]:
                    flush()
                opened.close(i)
            elif not inline:
                flush()
            continue
        attrs, go_on = token[2], token[3]
        if not inline:
            flush()
            # what an opening tag closes
            if (name not in _VOID or name == "hr") and stack[opened.walls[-1]][0] == "p":
                opened.close(opened.walls[-1])
            if name in _CLOSES:
                i = opened.last(_CLOSES[name])
                if i > opened.last(_WALLS):
                    opened.close(i)
        if name in _RAW:
            low = page.lower() if low is None else low
            if len(low) != len(page):  # a letter whose lower case is longer
                low = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = low.find("</" + name, go_on)
            go_on = len(page) if end < 0 else end
            continue
        if name in _VOID or attrs.endswith("/") and name in ("path", "circle", "rect", "line", "use", "g"):
            continue
        top = stack[-1]
        hard, soft, good, chief = _kind(name, attrs, top[2]) if attrs or not inline else (False,) * 4
        junk = hard or soft
        if inline and junk and not top[1]:
            flush()
        serial += 1
        softs = (*top[5], serial) if soft and len(top[5]) < NESTED else top[5]
        opened.push((name, top[1] or junk, top[2] or good, serial, top[4] or hard, softs, len(softs) if good else top[6], len(softs) if chief else top[7]))
    flush()
    return out


def cost(block: tuple) -> float:
    """What labelling the block boilerplate costs more than labelling it content."""
    text, tag, junk, good, linked, _, _ = block
    if junk:
        return JUNK
    n = len(text)
    score = -1.5 + min(n / 60, 4) * (1 - linked) - 4 * linked
    score += 0.5 * (text[-1] in ".!?…”\"") + {"p": 1, "pre": 1, "blockquote": 1, "li": -0.5, "td": -0.5, "h1": 1, "h2": 0.5, "h3": 0.5}.get(tag, 0)
    return score + 8 * good


def ties(found: list[tuple]) -> dict[tuple[int, int], float]:
    """Edges by adjacency and by a common element."""
    out: dict[tuple[int, int], float] = {}
    by_parent: dict[int, int] = {}
    by_grandparent: dict[int, int] = {}
    for i, b in enumerate(found):
        if b[2]:
            continue  # what is boilerplate by rule says nothing of its neighbours
        for held, key, weight in ((by_parent, b[5], 0.8), (by_grandparent, b[6], 0.3)):
            j = held.get(key)
            if j is not None:
                out[j, i] = out.get((j, i), 0) + weight
            held[key] = i
        if i and not found[i - 1][2]:
            out[i - 1, i] = out.get((i - 1, i), 0) + 0.3
    return out


def cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of the minimum cut: True for content."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    pull = list(scores)
    free = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and (pull[i] > free[i] or pull[i] <= -free[i]):
            label[i] = pull[i] > free[i]
            for j, w in near[i].items():
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    free[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {v: k for k, v in enumerate(rest)}
        capacity = [{number[j]: w for j, w in near[i].items() if j in number} for i in rest]
        for i, yes in zip(rest, _max_flow([pull[i] for i in rest], capacity)):
            label[i] = yes
    return [bool(x) for x in label]


def _max_flow(pull: list[float], residual: list[dict[int, float]], eps: float = 1e-9) -> list[bool]:
    """Shortest augmenting paths by levels (Dinic); True on the source's side."""
    n = len(pull)
    supply, demand = [max(0.0, x) for x in pull], [max(0.0, -x) for x in pull]
    while True:
        level = [0 if supply[i] > eps else -1 for i in range(n)]
        queue = deque(i for i in range(n) if not level[i])
        reached = False
        while queue:
            i = queue.popleft()
            reached |= demand[i] > eps
            for j, c in residual[i].items():
                if c > eps and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        arcs = [list(x) for x in residual]
        for start in range(n):
            while supply[start] > eps:
                path = [start]
                while path and demand[path[-1]] <= eps:
                    i = path[-1]
                    while arcs[i] and not (residual[i][arcs[i][-1]] > eps and level[arcs[i][-1]] == level[i] + 1):
                        arcs[i].pop()
                    if arcs[i]:
                        path.append(arcs[i][-1])
                    else:
                        path.pop()
                        if path:
                            arcs[path[-1]].pop()
                if not path:
                    break
                flow = min([supply[start], demand[path[-1]], *(residual[a][b] for a, b in zip(path, path[1:]))])
                supply[start] -= flow
                demand[path[-1]] -= flow
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= flow
                    residual[b][a] = residual[b].get(a, 0) + flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    labels = cut([cost(b) for b in found], ties(found))
    return "\n".join(b[0] for b, yes in zip(found, labels) if yes)


def _extract(batches):
    for b in slices(batches):
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
