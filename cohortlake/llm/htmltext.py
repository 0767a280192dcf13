"""Main text of web pages by tag-path ratios.

Every text block has a path: its block elements from the root down, with their class and id words. Per path,
text length, punctuation and link text are added up and set against the number of blocks. The
ratios are smoothed over neighbouring paths in page order, fused to one score, and the paths above a share of the
best score are the content paths. All blocks on them are given out, and with them the short ones of the article: of an
<article> or <main> that holds nearly all of their text, else of the lowest element that holds all of it.

Tags, roles and classes or ids that consist of words for boilerplate leave an element out. Where other words or words for
layout stand beside them, it stays if it holds most text of the page, with words of reader comments nearly all. Words that
articles use too, and all words on a section of an article, leave it out only where its ratio is low or its text mostly
links; words on headings never.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, text_of

THRESHOLD = 0.1  # part of the best path's score that a content path reaches
HOLDS = 0.95  # part of the content text that an article or main holds whose short blocks are given out
KEEPS = {"part": 0.5, "comment": HOLDS}  # part of the page's text that an element holds which stays in spite of its words
LINKED = 0.5  # part of link text from which a block is a menu

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noframes xmp svg math object".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_OUT_TAGS = set("head nav header footer aside form button select option fieldset label dialog menu script style noscript template iframe svg math object audio video canvas".split())
_OUT_WORDS = set(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar sidebars rail menu menus nav navbar navigation breadcrumb
    breadcrumbs toolbar masthead header footer comment comments commentlist reply replies respond discussion disqus share sharing social related
    recommended recommendations newsletter subscribe subscription signup login search widget widgets pagination pager copyright legal disclaimer hidden
    skip teaser teasers""".split()
)
_MAYBE_WORDS = set(
    """sponsor sponsors promotion banner banners consent notice notices alert alerts header masthead discussion share sharing social
    related recommended recommendations subscription login search copyright legal disclaimer skip teaser teasers""".split()
)
_COMMENT_WORDS = set("comment comments commentary commenter commentlist reply replies respond disqus".split())
_MAYBE_COMMENT_WORDS = set("comment commentary commenter reply respond".split())
_LAYOUT_WORDS = set("wrapper wrap container content main article page body layout".split())
_PLACE_WORDS = set("site top left right bottom primary secondary bar box list item inner outer block area section slot unit text fixed global".split())
_BESIDE_WORDS = set("has with no without".split())  # has-sidebar names what stands beside the element
_OUT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_NEVER_OUT = set("html body main article".split()) | _HEADINGS
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set("ul ol dl table article section div body td th blockquote".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _boilerplate(names: str, section: bool) -> str:
    """What class and id words say: "" (nothing), "out", "part" (out unless it is most of the page), "comment" (out unless it is nearly all), "ratio"."""
    named: set[str] = set()
    other = False
    for token in names.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
        if words & _BESIDE_WORDS:
            other = True
            continue
        found = words & (_OUT_WORDS | _COMMENT_WORDS)
        if found & _MAYBE_WORDS and words & _LAYOUT_WORDS:
            other, found = True, found - _MAYBE_WORDS
        named |= found
        other = other or bool(words - found - _PLACE_WORDS)
    if not named:
        return ""
    if section or named <= _MAYBE_WORDS:
        return "ratio"
    if not other and not named & _MAYBE_COMMENT_WORDS:
        return "out"
    return "comment" if named & _COMMENT_WORDS else "part"


class _Element:
    __slots__ = ("tag", "path", "out", "link", "up", "inside", "maybe", "kind", "depth")

    def __init__(self, tag: str, rest: str, up: _Element | None, paths: dict):
        self.tag, self.up, self.kind = tag, up, ""
        self.path, self.out, self.link, self.depth = (up.path, up.out, up.link, up.depth + 1) if up else (0, False, False, 0)
        self.inside, self.maybe = (up.inside or tag in ("article", "main"), up.maybe) if up else (False, None)
        if tag in _INLINE:
            self.link = self.link or tag == "a"
        names = ""
        if rest.strip(" /\n\t\r"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if tag not in _NEVER_OUT:
                self.kind = _boilerplate(names, tag == "section" and self.inside)
                unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
                self.out = self.out or self.kind == "out" or unseen or bool(set(found.get("role", "").lower().split()) & _OUT_ROLES)
                if self.kind in KEEPS or self.kind == "ratio":
                    self.maybe = self
        self.out = self.out or tag in _OUT_TAGS
        if tag not in _INLINE and up:
            words = " ".join(sorted(set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()))))
            self.path = paths.setdefault((up.path, tag, words), len(paths) + 1)


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(innermost element, text, characters of link text) of every text block outside boilerplate, in page order."""
    paths: dict[tuple[int, str, str], int] = {}
    root = _Element("", "", None, paths)
    at, stack, found, parts, links, owner, pos = root, [root], [], [], 0, root, 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            found.append((owner, text, links))
        parts, links = [], 0

    def say(raw: str) -> None:
        nonlocal owner, links
        if not raw or at.out:
            return
        text = html.unescape(raw)
        if not parts or owner.path == 0:
            owner = at
        parts.append(text)
        links += len(text.strip()) if at.link else 0

    def cut(start: int) -> None:
        for e in stack[start:]:
            opened[e.tag] -= 1
        del stack[start:]

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag not in _INLINE:
                flush()
            if opened[tag]:
                cut(max(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
                at = stack[-1]
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag == "br":
            say(" ")
            continue
        if tag not in _INLINE:
            flush()
            if tag not in _VOID:
                closes = _CLOSED_BY.get(tag)
                may = opened["p"] or any(opened[c] for c in closes or ())
                for i in range(len(stack) - 1 if may else 0, 0, -1):
                    if closes and stack[i].tag in closes:
                        cut(i)
                        break
                    if stack[i].tag == "p":
                        cut(i)
                        if not closes:
                            break
                    elif stack[i].tag in _SCOPES:
                        break
                at = stack[-1]
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = close.end() if close else len(page)
            continue
        if rest.rstrip().endswith("/") and tag in ("path", "use"):
            continue
        at = _Element(tag, rest, at, paths)
        stack.append(at)
        opened[tag] += 1
    flush()
    return found


def _holders(found: list[tuple[_Element, str, int]]) -> list[_Element]:
    """All elements with a block somewhere inside, inner ones after outer ones."""
    seen: dict[_Element, None] = {}
    for element, _, _ in found:
        while element is not None and element not in seen:
            seen[element] = None
            element = element.up
    return sorted(seen, key=lambda e: e.depth)


def _lengths(found: list[tuple[_Element, str, int]], holders: list[_Element]) -> tuple[dict[_Element, int], dict[_Element, int]]:
    """Characters, and those of links, inside every element."""
    length, linked = dict.fromkeys(holders, 0), dict.fromkeys(holders, 0)
    for element, text, links in found:
        length[element] += len(text)
        linked[element] += min(links, len(text))
    for e in reversed(holders):
        if e.up is not None:
            length[e.up] += length[e]
            linked[e.up] += linked[e]
    return length, linked


def content_paths(found: list[tuple[_Element, str, int]], threshold: float) -> set[int]:
    """Paths whose smoothed, fused ratio reaches ``threshold`` of the best."""
    sums: dict[int, list[float]] = {}
    for element, text, links in found:
        s = sums.setdefault(element.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += min(links, len(text))
        s[3] += 1
    raw = [(length / n) * (1 + marks / n) * (1 - linked / length) for length, marks, linked, n in sums.values()]
    smooth = [0.25 * raw[max(0, i - 1)] + 0.5 * x + 0.25 * raw[min(len(raw) - 1, i + 1)] for i, x in enumerate(raw)]
    best = max(smooth, default=0.0)
    return {path for path, s, x in zip(sums, smooth, raw, strict=True) if s >= threshold * best and x > 0}


def _ratio(parts: list[tuple[_Element, str, int]]) -> tuple[float, float]:
    """(fused ratio, part of link text) of some blocks."""
    length, n = sum(len(text) for _, text, _ in parts), len(parts)
    linked = sum(min(links, len(text)) for _, text, links in parts) / length
    return (length / n) * (1 + sum(len(_PUNCTUATION.findall(text)) for _, text, _ in parts) / n) * (1 - linked), linked


def _without_named(found: list[tuple[_Element, str, int]], threshold: float) -> list[tuple[_Element, str, int]]:
    """The blocks but for those of elements that their words call boilerplate and their place, ratio or links too."""
    if all(element.maybe is None for element, _, _ in found):
        return found
    holders = _holders(found)
    length, linked = _lengths(found, holders)
    total = sum(len(text) for _, text, _ in found)
    gone: dict[_Element, bool] = {}
    for e in holders:  # from the outside in
        gone[e] = (e.up is not None and gone[e.up]) or (e.kind in KEEPS and (length[e] < KEEPS[e.kind] * total or linked[e] >= LINKED * length[e]))
        if gone[e] and e.up is not None and not gone[e.up]:
            total -= length[e] if length[e] < total else 0
    found = [x for x in found if not gone[x[0]]]
    named: dict[_Element, list[tuple[_Element, str, int]]] = {}
    paths: dict[int, list[tuple[_Element, str, int]]] = {}
    outer: dict[_Element, _Element | None] = {}
    for e in holders:
        outer[e] = (outer[e.up] if e.up is not None else None) or (e if e.kind == "ratio" else None)
    for block in found:
        paths.setdefault(block[0].path, []).append(block)
        if outer[block[0]] is not None:
            named.setdefault(outer[block[0]], []).append(block)
    if not named:
        return found
    best = max(_ratio(parts)[0] for parts in paths.values())
    out = set()
    for element, parts in named.items():
        score, links = _ratio(parts)
        if score < threshold * best or links >= LINKED:
            out.add(element)
    return [x for x in found if outer[x[0]] not in out or (x[0].inside and x[0].tag in _HEADINGS)]


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The article of a page as plain text; empty if there is none."""
    found = _without_named(blocks(page), threshold)
    chosen = content_paths(found, threshold)
    main = [x for x in found if x[0].path in chosen]
    if not main:
        return ""
    holders = _holders(found)
    inside, _ = _lengths(main, holders)
    total = sum(len(text) for _, text, _ in main)
    named = [e for e in holders if e.tag in ("article", "main") and inside[e] >= HOLDS * total]
    top = max(named or [e for e in holders if inside[e] == total], key=lambda e: e.depth)
    whole = top.tag not in ("", "html", "body")  # the page itself has menus beside the article
    under: dict[_Element, bool] = {}  # inside the article's element
    beside: dict[_Element, bool] = {}  # and no element in between holds content
    for e in holders:
        under[e] = e is top or (e.up is not None and under[e.up])
        beside[e] = e is top or (under[e] and beside[e.up] and not inside[e])

    def given(element: _Element, text: str, links: int) -> bool:
        return element.path in chosen or (under[element] and (whole or not beside[element] or links < LINKED * len(text)))

    return " ".join(text for element, text, links in found if given(element, text, links))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: id, its other columns but the html, text, n_chars (code points).

    Null and empty pages, and pages of boilerplate alone, have the empty text. Character references
    are decoded, white space inside a block becomes one space, blocks are joined in page order by one space.
    Broken markup is read as far as it goes: tags left open end with their container, a script or comment that is
    never closed runs to the end. Repeated rows give repeated rows; an empty table an empty table.
    Columns named text and n_chars in the input are replaced by the result.
    """
    check_columns(pages, id_col, html_col)
    other = [c for c in dict.fromkeys(pages.columns) if c not in (html_col, "text", "n_chars") and pages.columns.count(c) == 1]
    rows = pages.select(*[F.col(f"`{c}`") for c in other], text_of(pages, html_col).alias("__html"))
    out = rows.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__html", 4 << 20):
            data, at = flat(batch.column("__html"))
            whole = data.tobytes()
            texts = [main_text(whole[a:b].decode("utf-8", "replace"), threshold) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column(c) for c in other] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*other, "text", "n_chars"])

    return rows.mapInArrow(run, out)
