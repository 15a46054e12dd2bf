"""Main text of HTML pages by union-free regular-expression inference.

The pages of a host are token streams (block tags and text), nested by their tags. Aligning them one after the other
gives the host's wrapper: what all have stays; a mismatch becomes an optional group, a stretch that repeats becomes a
repeated group, and texts that differ become text slots. There are no alternatives (union-free); where an element is
optional in three places or more, or has as many in one page, its order is free, and it and what stands between become one repeated group of
optionals. Every task folds the pages it reads into one wrapper a host, and wrappers are aligned with each other in the
same way, so no page is moved or left out to infer them.

A wrapper is then judged once, slot by slot, to a plan (``judged``): the article, or the main region, or else the places
that hold most of the varying text, without menus, headers, footers, sidebars, notices, adverts, forms and comments. A
place is an element or all optional siblings of one name between the same neighbours. Elements that HTML or a clear word
of their class or id names as such go; a word that may also name content ("alert", "search") lets no element of an article go, and
others only where the wrapper finds no text below it that varies between the host's pages.
Each page is laid along the plan, element by element, and the texts in content slots are its blocks. A text that stands
in the same slot (path of keys) of half of a host's different pages, ``TEMPLATE_PAGES`` of them at least, is a constant of
the wrapper and no page's own; those are counted exactly over all pages.

Defined cases: null html is an empty page with empty text; a url that is null or has no host belongs to the host "";
of a page cut short what is there counts; a page without article is judged by its host's wrapper; where no place fits a
page, or less than half of its text is there, all its text that is not set aside counts; where everything would be
template or set aside by words, it is kept; repeated rows are extracted each and count once; an empty table gives an
empty result; a page of any length is read whole; of elements nested deeper than ``DEPTH`` those that are set aside still are, and
what the others hold lies in the element around them; other columns of the input are ignored. Text that a browser does not show (scripts,
styles, templates, frames, what stands in for media) and form fields are no text; formulas, drawings and buttons are
text of the block around them.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm import common

# Element names by how they behave in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr button output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object textarea title select canvas audio video".split())
#: Their elements are no blocks of the page.
FLAT = frozenset("svg math".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select body html article section div".split())
#: Elements, and words in classes, ids and roles, that are not the article. A header is one of the page unless it stands in an article.
AWAY = frozenset("head nav footer aside form dialog menu fieldset input header".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners "
    "sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer "
    "cookie cookies consent gdpr notice notices newsletter share sharing social related recommended recommendations comment comments commentlist "
    "disqus complementary contentinfo popup modal overlay subscribe subscription signup login replies reply respond".split()
)
#: Words that may also name content.
UNSURE_WORDS = frozenset("alert search".split())

#: Words beside which a listed word of an id still names a part of the layout; beside others ("related-work") it is a heading's anchor.
LAYOUT_WORDS = frozenset("area articles bar block bottom box container content div form inner items left link links list main outer page panel post posts right section site slot top unit wrap wrapper".split())
#: A text of so many different pages of a host, and of half of them, is template.
TEMPLATE_PAGES = 5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Marks such as "has-sidebar" tell about a page, not about the element.
HAS = re.compile(r"(?:has|with|without|no|is)[-_]", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A wrapper's element: [key, flags, characters of text, kids or, if all pages have the same few texts there, those or their hashes]. Groups have the key "(".
OPTIONAL, REPEATED = 1, 2
TEXT, GROUP = "#", "("
#: Optional places of one key in a list from which its order is free.
FREE = 3
#: Texts that a repeated slot may hold on every page alike.
SAME = 16
#: Elements below each other.
DEPTH = 200
#: Entries of the table by which two lists are aligned; longer ones are cut at keys that occur once in both, or else in stretches.
TABLE, STRETCH = 250_000, 500
#: Optional siblings of one name and different marks from which they are one element, that accepts every element with the marks all have.
MANY, ANY = 64, ".*"


def _marks(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    words: set[str] = set()
    for kind, a, b, c in MARKS.findall(attributes):
        for mark in (a or b or c).split():
            if not HAS.match(mark):
                found = {w.lower() for w in WORDS.findall(mark)}
                words |= found if kind.lower() != "id" or found <= AWAY_WORDS | UNSURE_WORDS | LAYOUT_WORDS else found - AWAY_WORDS - UNSURE_WORDS
    return ".".join(["", *sorted(words)]) if words else ""


def tree(page: str) -> list:
    """A page as nested [key, kids]: kids are elements or texts, in order; texts are decoded, with single spaces."""
    root: list = ["", []]
    stack, texts, at, end, flat, aside = [root], [], 0, len(page), "", 0

    def close_text() -> None:
        if texts:
            block = " ".join("".join(texts).split())
            texts.clear()
            if block:
                stack[-1][1].append(block)

    def open_(key: str) -> None:
        nonlocal aside
        aside = aside if aside < len(stack) else 0
        if len(stack) <= DEPTH or not aside and _away(key):
            aside = aside if len(stack) <= DEPTH else len(stack)
            stack[-1][1].append([key, []])
            stack.append(stack[-1][1][-1])
        else:  # what it holds lies in the element around it
            stack.append([key, stack[-1][1]])

    def close_to(names: tuple[str, ...], within: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0].partition(".")[0]
            if name in names:
                close_text()
                del stack[i:]
                return
            if name in within:
                return

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            texts.append(entities.unescape(page[at:]))
            break
        if found.start() > at:
            texts.append(entities.unescape(page[at : found.start()]))
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if name in RAW and not found[1]:  # a script inside a paragraph does not cut it
            stop = _ENDS[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if flat or name in FLAT:  # what is inside runs on in the block around it
            flat = "" if found[1] and name == flat else flat or ("" if found[1] or found[3].rstrip().endswith("/") else name)
            continue
        if found[1]:
            if name not in INLINE:
                close_to((name,))
            elif len(stack) > 1 and stack[-1][0].partition(".")[0] == name:
                close_to((name,))
            continue
        key = name + _marks(found[3])
        if name in INLINE:
            if name == "br":
                texts.append(" ")
            elif name not in VOID and _away(key):
                close_text()
                open_(key)
            continue
        close_text()
        if name in ENDS_P:
            close_to(("p",), SCOPES)
        if name in ENDS_SAME:
            close_to(ENDS_SAME[name], SCOPES)
        if name in VOID or found[3].rstrip().endswith("/"):
            stack[-1][1].append([key, []])
        else:
            open_(key)
    close_text()
    return root


_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@lru_cache(maxsize=4096)
def _away(key: str, inside: bool = False) -> bool:
    """Whether an element is named as no part of an article; ``inside`` one, a header is part of it."""
    name, *words = key.split(".")
    return name in AWAY and not (inside and name == "header") or name not in ("", "html", "body") and not AWAY_WORDS.isdisjoint(words)


@lru_cache(maxsize=4096)
def _unsure(key: str) -> bool:
    return not UNSURE_WORDS.isdisjoint(key.split(".")[1:])


@lru_cache(maxsize=4096)
def _named(key: str, name: str) -> bool:
    """Whether an element is the article, or the main region."""
    first, *words = key.split(".")
    return first == name or name == "main" and "main" in words


def form(node: list) -> list:
    """The wrapper of one page: its tree with repeated stretches folded."""
    known = lambda k: k if len(k) <= 40 else hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    kids = [[TEXT, 0, len(k), [known(k)]] if isinstance(k, str) else form(k) for k in node[1]]
    return [node[0], 0, sum(k[2] for k in kids), free_order(folded(kids), 0)]


def _keys(kids: list) -> list[str]:
    return [k[0] if k[0] != GROUP else GROUP + k[3][0][0] for k in kids]


def folded(kids: list) -> list:
    """Stretches of up to four elements that follow themselves become one repeated group, or one repeated element."""
    out: list = []
    for kid in kids:
        out.append(kid)
        again = True
        while again:
            again = False
            for n in range(1, 5):
                if len(out) >= 2 * n and out[-1][0] != TEXT and _keys(out[-n:]) == _keys(out[-2 * n : -n]):
                    one = [merged(a, b, True) for a, b in zip(out[-2 * n : -n], out[-n:], strict=True)]
                    out[-2 * n :] = [one[0][:1] + [one[0][1] | REPEATED] + one[0][2:]] if n == 1 else [[GROUP, REPEATED, sum(k[2] for k in one), one]]
                    again = n > 1
                    break
                if n > 1 and len(out) > n and out[-n - 1][0] == GROUP and len(out[-n - 1][3]) == n and _keys(out[-n:]) == _keys(out[-n - 1][3]):
                    group = out[-n - 1]
                    body = [merged(a, b, True) for a, b in zip(group[3], out[-n:], strict=True)]
                    out[-n - 1 :] = [[GROUP, group[1] | REPEATED, sum(k[2] for k in body), body]]
                    break
    return out


def merged(a: list, b: list, within: bool = False) -> list:
    """The wrapper that accepts what either of two elements of one key accepts. ``within`` a page, both texts are its own; those of
    two pages stay known only where they are the same."""
    if a[0] == TEXT:
        texts = a[3] if a[3] == b[3] else sorted({*a[3], *b[3]}) if within and a[3] and b[3] else None
        return [TEXT, a[1] | b[1], a[2] + b[2], texts if texts and len(texts) <= SAME else None]
    return [a[0], a[1] | b[1], a[2] + b[2], aligned(a[3], b[3], within)]


def aligned(a: list, b: list, within: bool = False) -> list:
    """Two element lists as one: common elements in a common order, the others optional in their places."""
    if not a or not b:
        return general([[k[0], k[1] | OPTIONAL, *k[2:]] for k in a or b])
    a, b = accepted(a, b), accepted(b, a)
    x, y = _keys(a), _keys(b)
    if x == y:
        return [merged(p, q, within) for p, q in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*matches(x, y), (len(x), len(y))]:
        out += [[k[0], k[1] | OPTIONAL, *k[2:]] for k in (*a[i:p], *b[j:q])]
        if p < len(x):
            out.append(merged(a[p], b[q], within))
        i, j = p + 1, q + 1
    return general(free_order(folded(out)))


def matches(x: list[str], y: list[str], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Places of equal keys in two lists, upwards in both: a longest such list where the table is small, else one between anchors."""
    head = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    tail = next((k for k, (p, q) in enumerate(zip(x[head:][::-1], y[head:][::-1], strict=False)) if p != q), min(len(x), len(y)) - head)
    n, m = len(x) - tail, len(y) - tail
    ends = [(i + n + k, j + m + k) for k in range(tail)]
    begins = [(i + k, j + k) for k in range(head)]
    inner = _between(x[head:n], y[head:m], i + head, j + head)
    return [*begins, *inner, *ends]


def _between(x: list[str], y: list[str], i: int, j: int) -> list[tuple[int, int]]:
    if not x or not y or set(x).isdisjoint(y):
        return []
    if len(x) * len(y) <= TABLE:
        return [(i + p, j + q) for p, q in _longest(x, y)]
    counts, others = Counter(x), Counter(y)
    place = {k: q for q, k in enumerate(y) if others[k] == 1}
    anchors = _rising([(p, place[k]) for p, k in enumerate(x) if counts[k] == 1 and k in place])
    if not anchors:  # stretches that lie at the same share of both lists
        parts = max(len(x), len(y)) // STRETCH + 1
        anchors = [(len(x) * k // parts, len(y) * k // parts) for k in range(1, parts)]
    out, p, q = [], 0, 0
    for c, d in [*anchors, (len(x), len(y))]:
        if c < p or d < q:
            continue
        out += matches(x[p:c], y[q:d], i + p, j + q)
        p, q = c, d
        if c < len(x) and d < len(y) and x[c] == y[d]:
            out.append((i + c, j + d))
            p, q = c + 1, d + 1
    return out


def _longest(x: list[str], y: list[str]) -> Iterator[tuple[int, int]]:
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places, from pairs that rise in the first."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        at = bisect_left(tops, q)
        tops[at : at + 1], ends[at : at + 1] = [q], [k]
        before.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@lru_cache(maxsize=4096)
def _accepts(general_key: str, key: str) -> bool:
    """Whether a key that stands for many accepts an element's: the same name, and all of its marks."""
    name, *marks = general_key.removesuffix(ANY).split(".")
    first, *own = key.split(".")
    return name == first and set(marks) <= set(own)


def accepted(kids: list, others: list) -> list:
    """``kids`` with the keys that stand for many in ``others`` in place of those they accept."""
    many = [k[0] for k in others if k[0].endswith(ANY)]
    if not many:
        return kids
    return folded([[next((g for g in many if k[0] not in (TEXT, GROUP) and _accepts(g, k[0])), k[0]), *k[1:]] for k in kids])


def general(kids: list) -> list:
    """Where a list has ``MANY`` optional elements of one name or more, marks that differ from page to page tell nothing: from the
    first to the last of them they become one repeated element with the marks that all have, beside it what else stands there."""
    by: dict[str, list[int]] = {}
    for i, k in enumerate(kids):
        if k[1] & OPTIONAL and k[0] not in (TEXT, GROUP):
            by.setdefault(k[0].partition(".")[0], []).append(i)
    for name, at in by.items():
        if len(at) < MANY:
            continue
        marks = set.intersection(*(set(kids[i][0].removesuffix(ANY).split(".")[1:]) for i in at))
        one = kids[at[0]]
        for i in at[1:]:
            one = [one[0], one[1] | kids[i][1], one[2] + kids[i][2], aligned(one[3], kids[i][3], True)]
        one = [".".join([name, *sorted(marks)]) + ANY, one[1] | REPEATED, *one[2:]]
        kids = [*kids[: at[0]], one, *[k for i, k in enumerate(kids[at[0] + 1 :], at[0] + 1) if i not in set(at)]]
        return general(kids)
    return kids


def free_order(kids: list, flag: int = OPTIONAL) -> list:
    """Where a key is optional in ``FREE`` places or more, all from its first to its last place as one repeated group with each key
    once, optional. In one page any such key will do."""
    at: dict[str, list[int]] = {}
    for i, k in enumerate(_keys(kids)):
        if kids[i][1] & flag == flag or kids[i][0] == GROUP:
            at.setdefault(k.removeprefix(GROUP), []).append(i)
    free = [p for p in at.values() if len(p) >= FREE]
    if not free:
        return kids
    first, last = min(p[0] for p in free), max(p[-1] for p in free)
    by_key: dict[str, list] = {}
    for one in (m for kid in kids[first : last + 1] for m in members(kid)):
        by_key[one[0]] = merged(by_key[one[0]], one, True) if one[0] in by_key else one
    body = [[k[0], k[1] | OPTIONAL, *k[2:]] for _, k in sorted(by_key.items())]
    return [*kids[:first], [GROUP, REPEATED, sum(k[2] for k in body), body], *kids[last + 1 :]]


def members(kid: list) -> Iterator[list]:
    """The elements and texts of a group, and of groups within it."""
    if kid[0] == GROUP:
        for one in kid[3]:
            yield from members(one)
    else:
        yield kid


def pattern(node: list) -> str:
    """A wrapper as a regular expression over tags and text slots, for reading."""
    ends = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}[node[1]]
    if node[0] == TEXT:
        inner = "#text" if node[3] is None or len(node[3]) > 1 else json.dumps(node[3][0])
    else:
        inner = "".join(map(pattern, node[3]))
        inner = inner if node[0] in ("", GROUP) else f"<{node[0]}>{inner}</{node[0].partition('.')[0]}>"
    return f"({inner}){ends}" if ends else inner


def judged(wrapper: list) -> dict:
    """The plan of a wrapper: what holds the article in its pages (``name``: "article", "main" or ""), the ``path`` of places down
    to the densest one, each a list of keys, and, where no element is named, ``keep``: the paths of elements of an unsure name that
    hold text which varies."""

    def has(node: list, name: str) -> bool:
        return node[0] not in (TEXT, GROUP) and _named(node[0], name) or node[0] != TEXT and any(has(k, name) for k in node[3])

    name = next((n for n in ("article", "main") if has(wrapper, n)), "")
    keep: set[str] = set()

    def walk(node: list, path: str, inside: bool) -> None:
        for kid in (m for k in node[3] for m in members(k)):
            if kid[0] == TEXT or _away(kid[0], inside):
                continue
            here, within = f"{path}/{kid[0]}", inside or kid[0].partition(".")[0] == "article"
            if _unsure(kid[0]) and varying(kid):
                keep.add(here)
            walk(kid, here, within)

    if not name:
        walk(wrapper, "", False)
    path, at = [], wrapper[3]
    while True:
        whole = sum(map(varying, at))
        most = max(places(at), key=lambda place: sum(map(varying, place)), default=None)
        if not whole or most is None or sum(map(varying, most)) < 0.6 * whole:
            return {"name": name, "path": path, "keep": sorted(keep)}
        path.append(sorted({k[0] for k in most}))
        at = [k for one in most for k in one[3]]


def places(kids: list) -> list[list]:
    """The elements of a list of kids that may hold an article, with optional siblings of one name between the same neighbours together."""
    out: list[list] = []
    open_: dict[str, list] = {}
    for group in kids:
        for kid in members(group):
            name = kid[0].partition(".")[0]
            if kid[0] == TEXT or _away(kid[0]) or _unsure(kid[0]):
                continue
            if not kid[1] & OPTIONAL:
                open_ = {}
            if kid[1] & REPEATED or name in ENDS_P - {"div", "section", "main", "article", "center", "table"}:
                continue
            if name in open_ and kid[1] & OPTIONAL:
                open_[name].append(kid)
            else:
                out.append([kid])
                if kid[1] & OPTIONAL:
                    open_[name] = out[-1]
    return out


def varying(node: list, inside: bool = False) -> int:
    """Characters of the text below an element that is not the same on all pages and not set aside."""
    if node[0] == TEXT:
        return node[2] if node[3] is None else 0
    return 0 if node[0] != GROUP and _away(node[0], inside) else sum(varying(k, inside) for k in node[3])


def _slot(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def texts_of(node: list, path: str, keep: frozenset, inside: bool = False, words: bool = True) -> Iterator[tuple[str, str]]:
    """(path of keys, text) of all texts below a page's element that are not set aside; without ``words`` only element names set aside.

    Elements of an unsure name count in articles and where the plan keeps their path.
    """
    for kid in node[1]:
        if isinstance(kid, str):
            yield path, kid
            continue
        here, name = f"{path}/{kid[0]}", kid[0].partition(".")[0]
        if words and (_away(kid[0], inside) or not inside and _unsure(kid[0]) and here not in keep) or name in AWAY and not (inside and name == "header"):
            continue
        yield from texts_of(kid, here, keep, inside or name == "article", words)


def articles(node: list, path: str, name: str, words: bool = True) -> Iterator[tuple[list, str]]:
    """The outermost elements of a page that its plan names, with their paths, outside of what is set aside."""
    for kid in node[1]:
        if isinstance(kid, str) or kid[0].partition(".")[0] in AWAY or words and _away(kid[0]) and not _named(kid[0], name):
            continue
        here = f"{path}/{kid[0]}"
        if _named(kid[0], name):
            yield kid, here
        else:
            yield from articles(kid, here, name, words)


def laid(page: list, plan: dict) -> list[tuple[str, str]]:
    """(path, text) of the texts of a page's tree in the content slots of its host's plan, in order."""
    keep = plan["keep"]
    if plan["name"]:
        # A page whose only article lies in an element with a set-aside word ("sidebar-layout") has it there.
        ones = list(articles(page, "", plan["name"])) or list(articles(page, "", plan["name"], False))
        if found := [x for one, path in ones for x in texts_of(one, path, keep, True)]:
            return found
    everything = list(texts_of(page, "", keep)) or list(texts_of(page, "", keep, words=False))
    at = [(page, "")]
    for keys in plan["path"]:
        many = [k for k in keys if k.endswith(ANY)]
        at = [(k, f"{path}/{k[0]}") for node, path in at for k in node[1] if not isinstance(k, str) and (k[0] in keys or any(_accepts(g, k[0]) for g in many))]
    there = [x for node, path in at for x in texts_of(node, path, keep)]
    return there if 2 * _size(there) >= _size(everything) else everything


def _size(found: list[tuple[str, str]]) -> int:
    return sum(len(text) for _, text in found)


def slots(page: list) -> list[int]:
    """The slots of a page with what they hold, once each."""
    return sorted({_slot(path, text) for path, text in texts_of(page, "", frozenset(), True, False)})


def blocks(page: list, plan: dict, template: frozenset = frozenset()) -> list[str]:
    """The texts of a page's tree in the content slots of its host's plan, without the wrapper's constants, in order."""
    found = laid(page, plan)
    own = [text for path, text in found if not template or _slot(path, text) not in template]
    return own or [text for _, text in found]


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """(host, wrapper, n_pages) inferred from all pages of (url, html); the wrapper is its JSON form."""
    return _aligned(_parts(pages), fan_in)


def _parts(pages: DataFrame) -> DataFrame:
    """Stored rows of two kinds: a wrapper of the pages that a task read of a host, and the slots of one page, known by the hash of its html."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for batch in batches:
            seen = []
            for name, page in zip(batch["host"], batch["html"], strict=True):
                page = page if isinstance(page, str) else ""
                made = tree(page)
                one = form(made)
                held = known.get(name)
                known[name] = [merged(held[0], one), held[1] + 1] if held else [one, 1]
                seen.append((name, None, None, _slot("", page), slots(made)))
            yield pd.DataFrame(seen, columns=columns)
            if len(known) > 20_000:  # the same host may come again; its parts are aligned later
                yield rows(known)
                known = {}
        yield rows(known)

    def rows(known: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame([(h, json.dumps(w), n, None, None) for h, (w, n) in known.items()], columns=columns)

    columns = ["host", "wrapper", "n_pages", "page", "slots"]
    schema = "host string, wrapper string, n_pages long, page long, slots array<long>"
    return common.stored(pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(infer, schema), "wrapper-parts")


def _aligned(parts: DataFrame, fan_in: int) -> DataFrame:
    def join(parts: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for part in sorted(parts["wrapper"]):
            one = json.loads(part)
            whole = merged(whole, one) if whole else one
        return pd.DataFrame([(parts["host"].iloc[0], json.dumps(whole), int(parts["n_pages"].sum()))], columns=["host", "wrapper", "n_pages"])

    schema = "host string, wrapper string, n_pages long"
    parts = parts.where("wrapper IS NOT NULL").select("host", "wrapper", "n_pages")
    # A host has a part for each task that read it; `fan_in` of them are aligned in one group, and so on until each host has one.
    while True:
        counted = common.stored(parts.groupBy("host").agg(F.count("*").alias("n_parts")), "wrapper-counts")
        most = counted.agg(F.max("n_parts")).first()[0] or 0
        groups = F.ceil(F.col("n_parts") / fan_in).cast("int")
        salted = parts.join(counted, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), groups))
        parts = salted.groupBy("host", "salt").applyInPandas(lambda p: join(p), schema)
        if most <= fan_in:
            return parts
        parts = common.stored(parts, "wrapper-joined")


def _templates(parts: DataFrame) -> DataFrame:
    """(host, template): the slots, with what they hold, of half of a host's different pages; at most twice as many as a page has."""
    each = parts.where("page IS NOT NULL").select("host", "page", "slots").dropDuplicates(["host", "page"])
    totals = each.where(F.size("slots") > 0).groupBy("host").agg(F.count("*").alias("pages"))
    counts = each.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    return counts.join(totals, "host").where("2 * n >= pages").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))


def extracted(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    parts = _parts(pages)
    found = _aligned(parts, 64)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "plan": [json.dumps(judged(json.loads(w))) for w in batch["wrapper"]]})

    plans = found.mapInPandas(judge, "host string, plan string").join(_templates(parts), "host", "left")
    plans = common.stored(plans.withColumn("template", F.coalesce("template", F.array().cast("array<long>"))), "wrapper-plans")
    # A plan is a few keys; hosts are broadcast while they are few and joined by a shuffle beyond, whose skewed hosts Spark splits.
    size = plans.agg(F.sum(F.length("host") + F.length("plan") + 8 * F.size("template") + 32)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(plans) if size <= broadcast_bytes else plans, "host", "left").select("page_id", "url", "html", "host", "plan", "template")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, tuple[dict, frozenset]] = {}
            texts = []
            for page, name, plan, template in zip(batch["html"], batch["host"], batch["plan"], batch["template"], strict=True):
                if name not in known:
                    made = json.loads(plan)
                    known[name] = {**made, "keep": frozenset(made["keep"])}, frozenset(map(int, template))
                texts.append("\n".join(blocks(tree(page if isinstance(page, str) else ""), *known[name])))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    return rows.mapInPandas(lay, "page_id long, url string, text string, n_chars long")
