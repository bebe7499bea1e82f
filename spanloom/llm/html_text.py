"""Main text of web pages by tag-path ratios (op2).

A page is read once into blocks: runs of text between block-level tags, each with its root-to-leaf tag path (tags, with the first class,
id or role where there is one; steps beyond `STEPS` count as the last). Text length, punctuation and link text are summed per path and
divided by the path's blocks. These ratios are smoothed along the page with weights by path similarity, fused into one value, from
which link text takes its share (and, where the page has an article or main element, being outside it takes `OUTSIDE`), and paths that
reach a share of the best value are content. Where the page has a title (a first-level heading), the least element that holds it and content is
looked at alone, from the title on; where articles are marked, the one with the title. No branch is dropped for its size. Then the least
element that holds all content gives the rest of the article: its headings, paragraphs, lists and quotes; a first-level heading that
stands before that element is the title, and comes first.

Readers' comments are told by repetition (`records`), and by sections without a heading behind prose (`loose_sections`). What no structure
tells apart stays: a plain list of comments, or boxes beside an article on a page with neither a title nor marks.

Before the ratios are taken, what tags, ARIA roles or attributes tell to be no article text is left out: navigation, headers, footers,
asides, forms (but for one that frames the page), scripts, styles, hidden elements. Names of classes and ids have no meaning here, they only tell paths apart.

Null and empty pages, and pages without text, give an empty text; an empty table gives no rows, repeated rows are read once each, and other
columns are not read. Unclosed and crossed tags are read as browsers do: a block tag ends an open paragraph, a list item ends the one
before (of up to `NEAR` open elements), an end tag without a start is ignored. A page of any length and depth is read in linear time and memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.base import strings, table

STEPS, NEAR, OUTSIDE = 64, 256, 1 / 16

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<[!?/][^<>]*+>|<[a-zA-Z][^<>]*+>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_SPACES = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*+(?:\s|$)")
_DIGITS = re.compile(r"\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe noembed noframes title xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr td th caption figure figcaption details summary".split())
_NEVER = frozenset("nav footer aside script style noscript template textarea iframe button select option datalist dialog menu head title object canvas svg math audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset("article main nav header footer aside h1".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("thead", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table select article section div main body html td th".split())


class Element:
    """tag, the path's number, the parent's place in the page's elements, whether it is left out."""

    __slots__ = ("tag", "path", "parent", "out")

    def __init__(self, tag: str, path: int, parent: int, out: bool):
        self.tag, self.path, self.parent, self.out = tag, path, parent, out


class Block:
    __slots__ = ("at", "path", "text", "length", "punctuation", "links")

    def __init__(self, at: int, path: int, text: str, links: int):
        self.at, self.path, self.text, self.links = at, path, text, links
        self.length = len(text)
        self.punctuation = len(_PUNCTUATION.findall(text))


class Paths:
    """Tag paths by number; each is its parent's number and a step."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.depth = [0], [0]
        self.inner = [False]  # whether a path goes through an article or main element

    def below(self, path: int, tag: str, label: str) -> int:
        if self.depth[path] == STEPS:
            return path
        n = self.number.setdefault((path, tag + label), len(self.parent))
        if n == len(self.parent):
            self.parent.append(path)
            self.depth.append(self.depth[path] + 1)
            self.inner.append(self.inner[path] or tag in ("article", "main"))
        return n

    def steps(self, path: int) -> list[int]:
        """The path and all above it, from the root on."""
        out = [path]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out[::-1]

    def similarity(self, a: int, b: int) -> float:
        """Shared leading steps of two paths, as a share of the longer one."""
        longer = max(self.depth[a], self.depth[b]) + 1
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return (self.depth[a] + 1) / longer


class Page:
    """A page's elements in order, and its text blocks."""

    def __init__(self, page: str):
        self.paths = Paths()
        self.elements = [Element("", 0, 0, False)]
        self.blocks: list[Block] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [0]
        around = [0]  # the innermost element that isn't inline, for each open element
        articles = [False]
        count: dict[str, int] = defaultdict(int)  # open elements by tag
        parts: list[str] = []
        links = at = 0
        elements, below = self.elements, self.paths.below

        def flush() -> None:
            nonlocal links
            if parts:
                text = _SPACES.sub(" ", unescape("".join(parts))).strip()
                if text:
                    self.blocks.append(Block(around[-1], elements[around[-1]].path, text, links))
                parts.clear()
            links = 0

        def pop_to(i: int) -> None:
            if any(elements[e].tag not in _INLINE for e in stack[i:]):
                flush()
            for e in stack[i:]:
                count[elements[e].tag] -= 1
            del stack[i:], around[i:], articles[i:]

        def up(tags: tuple[str, ...]) -> int:
            """The outermost of the open elements with these tags, up to the next that holds them off; 0 if there is none."""
            low = 0
            for i in range(len(stack) - 1, max(0, len(stack) - NEAR), -1):
                tag = elements[stack[i]].tag
                if tag in tags:
                    low = i
                elif tag in _SCOPE:
                    break
            return low

        find, n = _TAG.search, len(page)
        while at < n:
            m = find(page, at)
            text = page[at : m.start() if m else n]
            if text:
                parts.append(text)
                if count["a"]:
                    links += len(text)
            if m is None:
                break
            at = m.end()
            if m[1]:
                tag, attributes = m[1].lower(), m[2]
                if tag in _RAW:
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if not attributes.endswith("/") else m
                    at = close.end() if close else n
                    continue
                if tag == "br":
                    parts.append(" ")
                    continue
                if tag in _VOID:
                    if tag == "hr":
                        flush()
                    continue
                if tag in _ENDS_P and count["p"] and (i := up(("p",))):
                    pop_to(i)
                if tag in _ENDS_LIKE and any(count[x] for x in _ENDS_LIKE[tag]) and (i := up(_ENDS_LIKE[tag])):
                    pop_to(i)
                inline = tag in _INLINE
                if not inline:
                    flush()
                out = elements[stack[-1]].out or tag in _NEVER or (tag == "header" and not articles[-1])
                label = ""
                if attributes and not attributes.isspace():
                    names = [(kind.lower(), x or y or z) for kind, x, y, z in _NAMES.findall(attributes) if x or y or z]
                    out = out or any(kind == "role" and not _ROLES.isdisjoint(x.lower().split()) for kind, x in names) or bool(_HIDDEN.search(attributes))
                    label = "." + names[0][1].split()[0].lower() if names and names[0][1].split() else ""
                elements.append(Element(tag, elements[stack[-1]].path if inline else below(elements[around[-1]].path, tag, label), stack[-1], out))
                stack.append(len(elements) - 1)
                around.append(around[-1] if inline else stack[-1])
                articles.append(articles[-1] or tag == "article")
                count[tag] += 1
            elif m[3]:
                tag = m[3].lower()
                if count[tag]:
                    i = len(stack) - 1
                    while elements[stack[i]].tag != tag:
                        i -= 1
                    pop_to(i)
                elif tag == "p":
                    flush()
                elif tag == "br":
                    parts.append(" ")
        flush()


def content_paths(paths: Paths, found: list[Block], boxes: frozenset[int] = frozenset(), share: float = 0.25, radius: int = 2, weight: float = 0.7) -> set[int]:
    """The paths whose fused ratio is at least `share` of the best one. weight: of length against punctuation. boxes: paths that reach that without their neighbours' help too."""
    total: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        t = total[b.path]
        t[0] += 1
        t[1] += b.length
        t[2] += b.punctuation
        t[3] += b.links
    length = {p: t[1] / t[0] for p, t in total.items()}
    punctuation = {p: t[2] / t[0] for p, t in total.items()}
    kernel = [exp(-((i / max(radius, 1)) ** 2)) for i in range(radius + 1)]
    smooth: dict[int, list[float]] = {p: [0.0, 0.0] for p in total}
    along = [b.path for b in found]
    near: dict[tuple[int, int], float] = {}
    for i, p in enumerate(along):
        w, x, y = 1.0, length[p], punctuation[p]
        window = along[max(0, i - radius) : i + radius + 1]
        alike = window.count(p) == len(window)  # then the mean is the path's own
        for j in () if alike else range(max(0, i - radius), min(len(along), i + radius + 1)):
            q = along[j]
            if q != p:
                s = near.get((p, q))
                if s is None:
                    s = near[p, q] = paths.similarity(p, q)
                s *= kernel[abs(i - j)]
            elif j != i:
                s = kernel[abs(i - j)]
            else:
                continue
            w, x, y = w + s, x + s * length[q], y + s * punctuation[q]
        smooth[p][0] += x / w / total[p][0]
        smooth[p][1] += y / w / total[p][0]
    top = [max((v[k] for v in smooth.values()), default=0) or 1 for k in (0, 1)]
    fused = {p: (weight * v[0] / top[0] + (1 - weight) * v[1] / top[1]) * (1 - min(1, total[p][3] / max(1, total[p][1]))) for p, v in smooth.items()}
    # where a page marks its article, a path outside it counts for a part only, and so does its text
    marked = any(paths.inner[p] for p in fused)
    counts = {p: 1.0 if paths.inner[p] or not marked else OUTSIDE for p in fused}
    fused = {p: v * counts[p] for p, v in fused.items()}
    best = max(fused.values(), default=0)
    chosen = {p: paths.steps(p) for p, v in fused.items() if best and v >= share * best}
    if not chosen:
        return set()
    longest, densest = max(length.values(), default=0) or 1, max(punctuation.values(), default=0) or 1
    own = lambda p: weight * length[p] / longest + (1 - weight) * punctuation[p] / densest
    return {p for p, v in fused.items() if best and v >= share * best and (p not in boxes or own(p) >= share)}


def settle_forms(read: Page) -> None:
    """Leaves forms out, but for those that are the page's frame: they hold its landmarks or title, or all of its text."""
    elements = read.elements
    if not any(e.tag == "form" for e in elements):
        return
    frame, in_form = [e.tag in _LANDMARKS for e in elements], [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        frame[elements[i].parent] |= frame[i]
    for i in range(1, len(elements)):
        in_form[i] = in_form[elements[i].parent] or elements[i].tag == "form"
    alone = all(in_form[b.at] or elements[b.at].out for b in read.blocks)
    for i in range(1, len(elements)):
        e = elements[i]
        e.out = e.out or elements[e.parent].out or (e.tag == "form" and not alone and not frame[i])


def records(read: Page, inside: list[Block]) -> set[int]:
    """The elements that hold readers' comments, told by repetition: siblings of one tag and label, without headings, each a byline and a text.

    A byline is a first block without a sentence's end, or a `time` element; if bylines differ in their digits only, they are numbers of steps.
    Three siblings or more that hold one text each, in an element of their own behind two paragraphs, are comments without bylines. Either
    kind counts only behind other prose and with none after it, so a page of nothing but records, and repeated boxes amid an article, stay.
    """
    elements = read.elements
    n = len(elements)
    none = len(inside)
    lo, hi = [none] * n, [-1] * n  # an element's first and last block
    many, headed, timed = [0] * n, [False] * n, [e.tag == "time" for e in elements]
    for i, b in enumerate(inside):
        many[b.at] += 1
        lo[b.at], hi[b.at] = min(lo[b.at], i), i
        headed[b.at] |= elements[b.at].tag in _HEADINGS
    for e in range(n - 1, 0, -1):
        up = elements[e].parent
        many[up] += many[e]
        headed[up] |= headed[e]
        timed[up] |= timed[e]
        lo[up], hi[up] = min(lo[up], lo[e]), max(hi[up], hi[e])
    first: dict[int, int] = {}  # the first of siblings of one path
    groups: dict[int, list[int]] = {}
    filled = [0] * n  # children with text
    for e in range(1, n):
        x = elements[e]
        if many[e] and not x.out:
            filled[x.parent] += x.tag not in _HEADINGS
            if x.tag == "li" or x.tag not in _TEXTUAL and x.tag not in _INLINE:
                key = x.parent * len(read.paths.parent) + x.path
                like = first.setdefault(key, e)
                if like != e:
                    groups.setdefault(key, [like]).append(e)
    if not groups:
        return set()

    prose = [bool(_SENTENCE.search(b.text)) and elements[b.at].tag not in _HEADINGS for b in inside]
    found = []
    for members in groups.values():
        if any(headed[e] for e in members):
            continue
        parent, firsts = elements[members[0]].parent, [inside[lo[e]] for e in members]
        bylined = all(many[e] > 1 and not _SENTENCE.search(b.text) for e, b in zip(members, firsts, strict=True))
        bylined = bylined and any(c.isalpha() for b in firsts for c in b.text) and (len({_DIGITS.sub("", b.text) for b in firsts}) > 1 or len({b.text for b in firsts}) == 1)
        bylined = bylined or all(timed[e] for e in members)
        bare = len(members) > 2 and filled[parent] == len(members) and elements[members[0]].tag != "li" and all(many[e] == 1 and inside[lo[e]].at != e for e in members)
        if bylined or bare:
            found.append((lo[members[0]], hi[members[-1]], 1 if bylined else 2, members))
    if not found:
        return set()
    found.sort(key=lambda x: (-x[1], x[0]))
    out: set[int] = set()
    before = [0]
    for x in prose:
        before.append(before[-1] + x)
    last = len(inside)  # from here on all is records, or no prose
    for begin, end, least, members in found:
        if before[last] <= before[min(last, end + 1)] and before[begin] >= least:
            out.update(members)
            last = min(last, begin)
    return out


def lone_boxes(elements: list[Element], inside: list[Block]) -> frozenset[int]:
    """Paths of text straight in boxes (neither paragraphs nor lists), but for labels: a box that begins one of several like elements."""
    seen, several = set(), set()  # parents and paths of elements; those of more than one
    width = max(e.path for e in elements) + 1
    for e in elements:
        key = e.parent * width + e.path
        if key in seen:
            several.add(key)
        seen.add(key)
    found, begun = set(), set()
    for b in inside:
        parent = elements[b.at].parent
        label = parent not in begun and elements[parent].parent * width + elements[parent].path in several
        if elements[b.at].tag not in _TEXTUAL and not label:
            found.add(b.path)
        begun.add(parent)
    return frozenset(found)


def loose_sections(elements: list[Element], inside: list[Block]) -> set[int]:
    """Sections without a heading, behind prose of the element they stand in that is in no section: the text after an article, not a part of it."""
    if not any(e.tag == "section" for e in elements):
        return set()
    n, none = len(elements), len(inside)
    headed, begin, prose = [False] * n, [none] * n, [none] * n  # prose: its first block, outside sections below
    for i, b in enumerate(inside):
        begin[b.at] = min(begin[b.at], i)
        if elements[b.at].tag in _HEADINGS:
            headed[b.at] = True
        elif _SENTENCE.search(b.text):
            prose[b.at] = min(prose[b.at], i)
    for e in range(n - 1, 0, -1):
        up = elements[e].parent
        headed[up] |= headed[e]
        begin[up] = min(begin[up], begin[e])
        if elements[e].tag != "section":
            prose[up] = min(prose[up], prose[e])
    return {e for e in range(1, n) if elements[e].tag == "section" and not headed[e] and prose[elements[e].parent] < begin[e]}


def article_of(elements: list[Element], title: Block | None, content: list[Block], marked: bool) -> int:
    """The element that the article is looked for in: 0 (the whole page) if no title tells it.

    On a page that marks articles, the one that holds the title; on others the least element that holds the title and prose, above sections.
    """
    if title is None:
        return 0
    up = elements[title.at].parent
    line = [up]
    while line[-1]:
        line.append(elements[line[-1]].parent)
    if marked:
        return next((e for e in line if elements[e].tag == "article"), 0)
    of, least = {e: i for i, e in enumerate(line)}, len(line) - 1
    last, meets = least, [least] * len(elements)  # where an element meets the title's line
    for e in range(1, len(elements)):
        meets[e] = of.get(e, meets[elements[e].parent])
    for b in content:
        if elements[b.at].tag not in _HEADINGS:
            least = min(least, meets[b.at])
    while least < last and (elements[line[least]].tag == "section" or elements[line[least]].tag in _TEXTUAL):
        least += 1
    return line[least]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    read = Page(page)
    settle_forms(read)
    elements = read.elements
    inside = [b for b in read.blocks if not elements[b.at].out]
    comments = records(read, inside) | loose_sections(elements, inside)
    if comments:
        for e in range(1, len(elements)):
            elements[e].out = elements[e].out or elements[elements[e].parent].out or e in comments
        inside = [b for b in inside if not elements[b.at].out]
    if not inside:
        return ""
    paths = content_paths(read.paths, inside, boxes=lone_boxes(elements, inside))
    marked = any(read.paths.inner[p] for p in paths)
    title = next((b for b in inside if elements[b.at].tag == "h1" and b.links <= 0.6 * b.length and (read.paths.inner[b.path] or not marked)), None)
    article = article_of(elements, title, [b for b in inside if b.path in paths], marked)
    if article:
        above = {article}
        up = article
        while up:
            up = elements[up].parent
            above.add(up)
        # on a page with marks, its other articles are no content; on others, what the title's element doesn't hold or what stands before the title
        other, own = [False] * len(elements), [False] * len(elements)
        for e in range(1, len(elements)):
            other[e] = other[elements[e].parent] or (elements[e].tag == "article" and e not in above)
            own[e] = own[elements[e].parent] or e == article
        at = inside.index(title)
        left = [b for i, b in enumerate(inside) if (not other[b.at] if marked else own[b.at] and i >= at)]
        if any(own[b.at] and b.path in paths and elements[b.at].tag not in _HEADINGS for b in left):
            inside = left
    held = [0] * len(elements)  # content blocks by the elements that hold them
    for b in inside:
        held[b.at] += b.path in paths
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e].parent] += held[e]
    container = max((e for e in range(len(elements)) if held[e] == held[0]), default=0)
    if elements[container].tag in _TEXTUAL:
        container = elements[container].parent
    # by element: whether the blocks of its own are the article's, if links aren't most of them
    rest = [False] * len(elements)
    within = [False] * len(elements)
    for e in range(container, len(elements)):
        parent = elements[e].parent
        within[e] = e == container or within[parent]
        textual = elements[e].tag in _TEXTUAL or elements[e].tag in _INLINE
        rest[e] = within[e] and (e == container or held[e] > 0 and not textual or (textual and rest[parent]))
    chosen = [b.path in paths or (rest[b.at] and b.links <= 0.6 * b.length) for b in inside]
    first = chosen.index(True) if True in chosen else 0
    if not any(elements[b.at].tag == "h1" for b, c in zip(inside, chosen, strict=True) if c):
        title = max((i for i in range(first) if elements[inside[i].at].tag == "h1" and inside[i].links <= 0.6 * inside[i].length), default=first)
        chosen[title] = chosen[title] or title < first
    return " ".join(b.text for b, c in zip(inside, chosen, strict=True) if c)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of each page; the scan's partitions are kept, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in strings(part, html)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return pages.select(*keep, html).mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
