"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of balanced tags and texts.  Its *shape* is that stream with neighbours that repeat,
single elements or sequences of them, folded into repeated groups.  Shapes of a host are aligned one
after another: equal labels merge, what only one side has becomes optional, repeats become groups, and
texts that differ become slots.  Every page takes part.  Inference runs in the tasks that read the
pages; what they find for a host is merged in two rounds, host by host, so a host with any share of the
pages is no one task's work.

Pages are read through their host's wrapper: its article element, or the innermost one outside of
which nothing varies, less the blocks whose texts are the same on every page.  Elements that HTML or
a class's one word sets aside go everywhere; longer names with such a word only where a host's pages
don't differ, so that there is no wrapper to tell, only outside of articles, and only if less text stands in them
than elsewhere.

Elements may be nested to any depth: paths are chained hashes, and recursion is given as much room as
a page is deep.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, text_of

#: Hosts a task keeps before it hands on what it has; parts a host's findings are merged in first.
TASK_HOSTS, MERGE_PARTS = 1000, 32
#: Hosts up to which the wrappers' readings are broadcast (17 bytes a constant text, and a path).
BROADCAST_ROWS = 20_000
#: Labels that the unit of a repeated group has at most; longer units stay as they are.
UNIT = 6
#: Cells (labels times labels) up to which two sequences are compared at once; longer ones are halved first.
CELLS = 1 << 28

# Fixed values of HTML: elements without content, with raw content, that end a paragraph, and that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend optgroup option tbody td tfoot th thead title tr".split()) | {"dd", "dt"}
#: An open element that a start tag ends, and the elements that shield it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}

#: Elements that never hold an article's text.
ASIDE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video "
    "dialog menu title xmp noembed noframes datalist".split()
)
#: Words in a class, id or role that say the same.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead toolbar share sharing social related recommended recommendations comment "
    "comments disqus replies respond pagination pager widget widgets search form banner complementary contentinfo dialog "
    "copyright".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HEADING = frozenset("p h1 h2 h3 h4 h5 h6".split())
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)


@lru_cache(maxsize=20_000)
def label_of(tag: str, attributes: str) -> str:
    """A tag with its class, id and role; in an id, which numbers what it names, digits are alike.  ``!`` marks what isn't shown."""
    found = {}
    if _NAMED.search(attributes):
        for m in _ATTR.finditer(attributes):
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    out = tag
    for key, sign in (("class", "."), ("id", "#"), ("role", "@")):
        names = entities.unescape(found.get(key, "")).lower().split()
        out += "".join(sign + (re.sub(r"\d+", "0", n) if key == "id" else n) for n in sorted(set(names)))
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        out += "!"
    return out


@lru_cache(maxsize=20_000)
def set_aside(label: str, lone: bool = False) -> bool:
    """Whether a label says that its element isn't part of an article; ``lone``: also if a name only begins or ends so."""
    tag, *names = re.split(r"[.#@]", label)
    if label.endswith("!"):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in ASIDE_TAGS:
        return True
    for name in names:
        words = re.split(r"[^a-z]+", name)
        if not lone:
            if name in ASIDE_WORDS:
                return True
        elif words[0] not in ("has", "with", "no", "not") and (words[0] in ASIDE_WORDS or words[-1] in ASIDE_WORDS):
            return True
    return False


@lru_cache(maxsize=20_000)
def is_header(label: str) -> bool:
    """Whether a label is a page header's; inside an article it may hold the title."""
    tag, *names = re.split(r"[.#@]", label)
    return tag == "header" or any(re.split(r"[^a-z]+", n)[0] == "header" for n in names if tag not in ("html", "body", "main", "article"))


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, value) of a page: ``open`` and ``close`` with a label, balanced, and ``text``, decoded."""
    stack: list[tuple[str, str]] = []
    still: dict[str, int] = {}  # open elements by tag

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            tag, label = stack.pop()
            still[tag] -= 1
            yield "close", tag, label

    def innermost(tags: set | frozenset, shields: set) -> int | None:
        if not any(still.get(t) for t in tags):
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in shields:
                return None
        return None

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            yield "text", "", entities.unescape(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = innermost({tag}, set())
            if k is not None:
                yield from close_to(k)
            elif tag == "br":
                yield "text", "", " "
            continue
        if tag in ENDS_P and (k := innermost({"p"}, {"button", "table"})) is not None:
            yield from close_to(k)
        if tag in CLOSES:
            own, shields = CLOSES[tag]
            while (k := innermost(own, shields)) is not None:
                yield from close_to(k)
        label = label_of(tag, m[3])
        yield "open", tag, label
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            yield "close", tag, label
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inside = page[at : close.start() if close else end]
            if tag in ("title", "textarea"):
                yield "text", "", entities.unescape(inside)
            at = close.end() if close else end
            yield "close", tag, label
        else:
            stack.append((tag, label))
            still[tag] = still.get(tag, 0) + 1
    yield from close_to(0)


# ---------------------------------------------------------------- inference
#
# A wrapper is a list [label, optional, repeated, items], items in order.  A text is the label "" with its
# constant text, or null for a slot, in place of items.  A repeated group of several items is labelled by
# their labels, "(h2,p)", and stands on no path of its own.


def shape(stream: list[tuple[str, str, str]]) -> list:
    """The wrapper of one page, from its events."""
    root = ["", False, False, []]
    stack = [root]
    for kind, _, value in stream:
        if kind == "open":
            node = [value, False, False, []]
            stack[-1][3].append(node)
            stack.append(node)
        elif kind == "close":
            done = stack.pop()
            done[3] = folded(done[3])
        elif text := " ".join(value.split()):
            stack[-1][3].append(["", False, False, text])
    root[3] = folded(root[3])
    return root


def is_group(label: str) -> bool:
    return label[:1] == "("


def folded(items: list) -> list:
    """Items with neighbours of one label, then of one sequence of labels, folded into one, repeated unless it is text."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merged(out[-1], item)
            if item[0]:
                out[-1][2] = True
            else:
                out[-1][3] = None
        else:
            out.append(item)
    for n in range(2, min(UNIT, len(out) // 2) + 1):
        out = grouped(out, n)
    return out


def grouped(items: list, n: int, units: tuple[tuple[str, ...], ...] = ()) -> list:
    """Items with sequences of ``n`` labels that repeat, or are one of ``units``, folded into groups."""
    labels = [x[0] for x in items]
    out, i = [], 0
    while i < len(items):
        unit = labels[i : i + n]
        if len(unit) == n and not any(map(is_group, unit)) and (unit == labels[i + n : i + 2 * n] or tuple(unit) in units):
            name = f"({','.join(unit)})"
            group = [name, False, True, items[i : i + n]]
            i += n
            while labels[i : i + n] == unit:
                group = merged(group, [name, False, True, items[i : i + n]])
                i += n
            out.append(group)
        else:
            out.append(items[i])
            i += 1
    return out


def merged(a: list, b: list) -> list:
    """Two items of one label as one: optional or repeated if either is; texts that differ are a slot."""
    if not a[0] and not isinstance(a[3], list):
        return ["", a[1] or b[1], False, a[3] if a[3] == b[3] else None]
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def aligned(a: list, b: list) -> list:
    """Two sequences of items as one: a longest common subsequence of labels merges, the rest is optional."""
    units = tuple({x[0]: tuple(y[0] for y in x[3]) for x in (*a, *b) if is_group(x[0])}.values())
    for n in sorted({len(u) for u in units}):
        a, b = grouped(a, n, units), grouped(b, n, units)
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b)):
        return [merged(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for k, m in [*common([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in (*a[i:k], *b[j:m])]
        if k < len(a):
            out.append(merged(a[k], b[m]))
        i, j = k + 1, m + 1
    return folded(out)


def rows_of(a: list[str], b: list[str], keep: bool) -> list[int]:
    """After each label of ``a`` (or only after the last), a bit for every label of ``b``: 0 where the longest common subsequence grows."""
    full = (1 << len(b)) - 1
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    row, out = full, []
    for x in a:
        same = at.get(x, 0)
        row = ((row + (row & same)) | (row & ~same)) & full
        if keep:
            out.append(row)
    return out if keep else [row]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, by rows of bits; long sequences are halved until they fit ``CELLS``."""
    n, m = len(a), len(b)
    begin = 0
    while begin < min(n, m) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(n, m) - begin and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    head, tail = [(k, k) for k in range(begin)], [(n - end + k, m - end + k) for k in range(end)]
    x, y = a[begin : n - end], b[begin : m - end]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        up, down = rows_of(x[:half], y, False)[0], rows_of(x[half:][::-1], y[::-1], False)[0]
        left, right = [0], [0]
        for j in range(len(y)):
            left.append(left[-1] + (~up >> j & 1))
            right.append(right[-1] + (~down >> j & 1))
        cut = max(range(len(y) + 1), key=lambda j: left[j] + right[len(y) - j])
        found = common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in common(x[half:], y[cut:])]
    else:
        rows, found, i, j = rows_of(x, y, True), [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    j -= 1
                    found.append((i, j))
        found.reverse()
    return head + [(begin + i, begin + j) for i, j in found] + tail


def expression(wrapper: list) -> str:
    """A wrapper as a regular expression over tags, ``#`` for a slot."""
    out: list[str] = []
    stack = list(reversed(wrapper[3]))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        label, optional, repeated, inner = item
        marks = "+" * repeated + "?" * optional
        opening, closing = ("(", f"){marks}") if marks else ("", "")
        if not label:
            out.append(opening + ("#" if inner is None else json.dumps(inner, ensure_ascii=False)) + closing)
            continue
        out.append(opening + ("" if is_group(label) else f"<{label}>"))
        stack.append(("" if is_group(label) else "</>") + closing)
        stack.extend(reversed(inner))
    return "".join(out)


def flat(wrapper: list) -> list:
    """A wrapper as a flat list: label and flags of an element, its items, 0; the empty label, flags and text of a text."""
    out: list = []
    stack: list = list(reversed(wrapper[3]))
    while stack:
        item = stack.pop()
        if item == 0:
            out.append(0)
            continue
        out += [item[0], item[1] + 2 * item[2]]
        if not item[0]:
            out.append(item[3])
        else:
            stack.append(0)
            stack.extend(reversed(item[3]))
    return out


def unflat(tokens: list) -> list:
    """The wrapper of ``flat``."""
    root = ["", False, False, []]
    stack, k = [root], 0
    while k < len(tokens):
        if tokens[k] == 0:
            stack.pop()
            k += 1
            continue
        item = [tokens[k], bool(tokens[k + 1] & 1), bool(tokens[k + 1] & 2), []]
        stack[-1][3].append(item)
        k += 2
        if item[0]:
            stack.append(item)
        else:
            item[3] = tokens[k]
            k += 1
        room_for(len(stack))
    return root


def room_for(depth: int) -> None:
    """Let functions recurse as deep as elements nest."""
    if 8 * depth + 500 > sys.getrecursionlimit():
        sys.setrecursionlimit(16 * depth + 1000)


def tag_of(label: str) -> str:
    return re.split(r"[.#@!]", label, maxsplit=1)[0]


@lru_cache(maxsize=20_000)
def article_kind(label: str) -> str:
    """``article`` or ``main`` for labels of such elements."""
    tag = tag_of(label)
    return "article" if tag == "article" else "main" if tag == "main" or "@main" in label else ""


def below(path: int, label: str) -> int:
    """The path of an element below a path: a chained hash."""
    return xxhash.xxh3_64_intdigest(label, path)


def named(path: int, text: str) -> str:
    """The name of a text at a path."""
    return xxhash.xxh3_64_hexdigest(text, path)


class Host:
    """What is known of a host: its wrapper and, by path, how many characters of text its article and main elements hold.

    ``low`` and ``high`` are the least and greatest hash of a page's texts: they differ if pages do.
    ``plain`` and ``partial`` count characters outside of what is set aside, and in elements that only a part of a name sets aside.
    """

    def __init__(self, wrapper: list | None = None, mass: dict[int, int] | None = None, pages: int = 0, low: int | None = None, high: int | None = None, plain: int = 0, partial: int = 0):
        self.wrapper, self.mass, self.pages = wrapper, mass or {}, pages
        self.low, self.high, self.plain, self.partial = low, high, plain, partial

    @property
    def lone(self) -> bool:
        """Whether all pages are alike, so that what is constant says nothing."""
        return self.low == self.high

    @property
    def by_name(self) -> bool:
        """Whether parts of names set elements aside."""
        return self.lone and self.partial <= self.plain

    def add_page(self, page: str) -> None:
        self.pages += 1
        paths, counts, aside, partial = [0], [0], 0, 0
        texts: list[str] = []
        stream = list(events(page))
        some, deepest = False, 0
        for kind, tag, value in stream:
            if kind == "open":
                aside += aside > 0 or set_aside(value) or tag == "a" or is_header(value)
                partial += partial > 0 or set_aside(value, True)
                paths.append(below(paths[-1], value))
                counts.append(0)
                deepest = max(deepest, len(paths))
            elif kind == "close":
                aside -= aside > 0
                partial -= partial > 0
                path, n = paths.pop(), counts.pop()
                counts[-1] += n
                if n and article_kind(value):
                    self.mass[path] = self.mass.get(path, 0) + n
            elif text := " ".join(value.split()):
                some = True
                if not aside:
                    texts.append(text)
                    counts[-1] += len(text)
                    if partial:
                        self.partial += len(text)
                    else:
                        self.plain += len(text)
        room_for(deepest)
        if some:  # a page without text has no template either
            own = xxhash.xxh3_64_intdigest("\0".join(texts)) if texts else None
            self._merge(shape(stream), own, own)

    def _merge(self, wrapper: list | None, low: int | None, high: int | None) -> None:
        if wrapper is not None:
            self.wrapper = wrapper if self.wrapper is None else merged(self.wrapper, wrapper)
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)

    def add(self, other: Host) -> None:
        self.pages += other.pages
        self.plain += other.plain
        self.partial += other.partial
        for k, n in other.mass.items():
            self.mass[k] = self.mass.get(k, 0) + n
        self._merge(other.wrapper, other.low, other.high)

    def to_json(self) -> str:
        known = [None if self.wrapper is None else flat(self.wrapper), list(self.mass.items()), self.pages, self.low, self.high, self.plain, self.partial]
        return json.dumps(known, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Host:
        wrapper, mass, *rest = json.loads(text)
        return cls(None if wrapper is None else unflat(wrapper), dict(mass), *rest)

    def constants(self) -> list[str]:
        """The names of the texts that every page has, unless all pages are alike."""
        out: set[str] = set()
        stack = [(self.wrapper[3], 0)] if self.wrapper is not None and not self.lone else []
        while stack:
            items, path = stack.pop()
            for label, optional, _, inner in items:
                if optional:
                    continue
                if label:
                    stack.append((inner, path if is_group(label) else below(path, label)))
                elif inner is not None:
                    out.add(named(path, inner))
        return sorted(out)

    def main(self) -> str:
        """The path, in hex, of the wrapper's element that holds the article; "" for the whole page.

        Of the articles (else of the main elements) the one with most text; without any, the
        innermost element outside of which there are only constants, what is set aside, and links
        that stand in no heading or paragraph.
        """
        lone, by_name = self.lone, self.by_name
        if self.wrapper is None:
            return ""
        found: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        stack = [(self.wrapper[3], 0, 0)]
        while stack:
            items, path, depth = stack.pop()
            for label, _, _, inner in items:
                if is_group(label):
                    stack.append((inner, path, depth))
                elif label and not set_aside(label):
                    own = below(path, label)
                    if (kind := article_kind(label)) and self.mass.get(own):
                        found[kind].append((own, depth))
                    stack.append((inner, own, depth + 1))
        for kind in ("article", "main"):
            if found[kind]:
                return f"{max(found[kind], key=lambda p: (self.mass[p[0]], -p[1], p[0]))[0]:016x}"
        known: dict[tuple[int, bool, bool], bool] = {}

        def varies(item: list, fixed: bool, prose: bool = False) -> bool:
            label, optional, _, inner = item
            fixed = fixed and not optional
            if not label:
                return lone or not fixed or inner is None
            key = (id(item), fixed, prose)
            if key not in known:
                known[key] = False
                if not is_group(label):
                    tag = tag_of(label)
                    if set_aside(label, by_name) or lone and is_header(label) or tag == "a" and not prose:
                        return False
                    prose = prose or tag in _HEADING
                for x in inner:
                    if varies(x, fixed, prose):
                        known[key] = True
                        break
            return known[key]

        path, items = 0, opened([(x, True) for x in self.wrapper[3]])
        while len(holding := {x[0] for x, fixed in items if varies(x, fixed)}) == 1:
            label = holding.pop()
            if tag_of(label) not in BLOCK:
                break
            path = below(path, label)
            items = opened([(y, fixed and not x[1]) for x, fixed in items if x[0] == label for y in x[3]])
        return f"{path:016x}" if path else ""


def opened(items: list[tuple[list, bool]]) -> list[tuple[list, bool]]:
    """Items with those of groups in their groups' places."""
    out = []
    for x, fixed in items:
        out += opened([(y, fixed and not x[1]) for y in x[3]]) if is_group(x[0]) else [(x, fixed)]
    return out


# ---------------------------------------------------------------- reading


def read_page(page: str, main: str, constants: frozenset | set = frozenset(), lone: bool = True, by_name: bool = True) -> tuple[str, bool]:
    """The main text of a page through the element at path ``main`` ("" for all), and whether that fits the page.

    Blocks of ``constants`` alone go.  It doesn't fit a page that lacks the element, or has more text
    outside of it than inside, not counting constants, links and what is set aside.  What encloses the
    element sets nothing aside in it.
    """
    wanted, paths = int(main or "0", 16), [0]
    blocks: list[str] = []
    run: list[str] = []
    varying, there = False, not main
    inside, aside, outer, articles = int(not main), 0, 0, 0
    links = within = without = 0

    def flush() -> None:
        nonlocal varying
        if run:
            if (text := " ".join("".join(run).split())) and varying:
                blocks.append(text)
            run.clear()
        varying = False

    for kind, tag, value in events(page):
        if kind == "open":
            paths.append(below(paths[-1], value))
            links += tag == "a"
            articles += article_kind(value) != ""
            if not inside and paths[-1] == wanted:
                inside, there, outer, aside = len(paths), True, aside, 0
            elif aside or set_aside(value, by_name and not articles) or lone and not (inside and main) and is_header(value):
                aside += 1
            if tag in BLOCK:
                flush()
            elif tag == "br":
                run.append(" ")
        elif kind == "close":
            if tag in BLOCK:
                flush()
            if main and inside == len(paths):
                inside, aside = 0, outer
            elif aside:
                aside -= 1
            articles -= article_kind(value) != ""
            links -= tag == "a"
            paths.pop()
        elif not aside and (text := " ".join(value.split())):
            new = not constants or named(paths[-1], text) not in constants
            if inside:
                run.append(value)
                varying = varying or new
                within += len(text) * new
            elif not links:
                without += len(text) * new
        elif inside and not aside:
            run.append(value)
    flush()
    return "\n".join(blocks), there and without <= within


def main_text(page: str, main: str, constants: frozenset | set = frozenset(), lone: bool = True, by_name: bool = True) -> str:
    """``read_page``, by the page's own wrapper where the host's doesn't fit."""
    text, fits = read_page(page, main, constants, lone, by_name)
    if not fits:
        own = Host()
        own.add_page(page)
        text, _ = read_page(page, own.main(), constants, lone, by_name)
    return text


def host_of(url):
    """The host of a url column, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, main, wrapper, lone, by_name, constants) per host of ``pages`` (url, html): all pages take part.

    ``constants`` has the 16 digits each of the names of texts that every page has, ``lone`` says that
    the pages don't differ, ``by_name`` that parts of names set elements aside.
    """
    require(pages, "url", "html")

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Host] = {}
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                hosts.setdefault(name, Host()).add_page(page.as_py())
            if len(hosts) >= TASK_HOSTS:
                yield of(hosts)
                hosts = {}
        if hosts:
            yield of(hosts)

    def of(hosts: dict[str, Host]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(hosts), pa.string()), pa.array([h.to_json() for h in hosts.values()], pa.string())], ["host", "known"]
        )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host, one host after another."""
        own, host = None, None
        for batch in batches:
            for name, known in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != own and host is not None:
                    yield of({own: host})
                    host = None
                own = name
                other = Host.from_json(known.as_py())
                if host is None:
                    host = other
                else:
                    host.add(other)
        if host is not None:
            yield of({own: host})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [Host.from_json(x.as_py()) for x in batch.column(1)]
            columns = [
                [h.pages for h in known], [h.main() for h in known], [expression(h.wrapper) if h.wrapper else "" for h in known],
                [h.lone for h in known], [h.by_name for h in known], [" ".join(h.constants()) for h in known],
            ]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["host", "pages", "main", "wrapper", "lone", "by_name", "constants"],
            )

    parts = (
        pages.select(host_of(F.col("url")).alias("host"), text_of("html").alias("html"))
        .mapInArrow(infer, "host string, known string")
        .withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    )
    first = parts.repartition("host", "part").sortWithinPartitions("host").select("host", "known").mapInArrow(combine, "host string, known string")
    second = first.repartition("host").sortWithinPartitions("host").mapInArrow(combine, "host string, known string")
    return second.mapInArrow(finish, "host string, pages long, main string, wrapper string, lone boolean, by_name boolean, constants string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html): the whole page's main text.

    Character references are decoded, white space inside a block (line breaks included) is one
    space, blocks are joined by a line feed in page order.  A block whose texts are the same on every
    page of the host goes.  Null and empty pages, and pages without
    an article, give the empty text.  Pages without a host share the wrapper of the host "".
    Repeated rows are read alike.  An empty table gives no rows.
    """
    require(pages, "page_id", "url", "html")
    mains = materialize(wrappers(pages).select("host", "main", "lone", "by_name", "constants"))
    if mains.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        mains = F.broadcast(mains)
    rows = (
        pages.select("page_id", "url", text_of("html").alias("html"), host_of(F.col("url")).alias("host"))
        .join(mains, "host", "left")
        .select(
            "page_id", "url", "html", F.coalesce("main", F.lit("")).alias("main"),
            *[F.coalesce(c, F.lit(True)).alias(c) for c in ("lone", "by_name")], F.coalesce("constants", F.lit("")).alias("constants"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named_by = lru_cache(maxsize=1000)(lambda text: frozenset(text.split()))
        for batch in batches:
            rows = zip(*(batch.column(k) for k in range(2, 7)))
            texts = [main_text(page.as_py(), main.as_py(), named_by(known.as_py()), lone.as_py(), by_name.as_py()) for page, main, lone, by_name, known in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
