"""Main text of pages by union-free regular-expression wrappers.

Every page becomes a tree of tags and text slots. Trees of one host are
aligned level by level: equal neighbours become one repeated group, tags that
only some pages have become optional, texts that differ become slots, texts
that never differ stay literal. The result is the host's wrapper, a
union-free regular expression over tags. It is fitted on all pages: each task
aligns its own, then wrappers are aligned in two steps per host, so no task
sees all pages of a large host.

Wrapper nodes are judged once per host: which are page furniture, which hold
the article. A page is then matched with its host's wrapper, and its text is
read from the nodes that were judged to hold the article.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import new_stage_path, shared_fs, text_or_empty

# Tags by their meaning in HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noframes".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = set("head nav header footer aside form script style noscript template iframe svg canvas object button select option menu dialog title textarea video audio map input".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget notice notices cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus form search pagination pager toolbar".split())
# words that say where a part stands, not what it is
PLACE_WORDS = set("area bar block bottom box container inner left list primary right secondary section site slot top unit wrap wrapper".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEAD_CONTENT = set("base basefont bgsound head html link meta noscript script style template title".split())
CELLS = set("td th dt dd caption".split())
# words that ids are made of where they name a part of the layout; other ids name places in a text
ID_WORDS = FURNITURE_WORDS | PLACE_WORDS | set("article body content entry page post story text".split())
BLOCKS_CLOSE_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

LCS_CELLS = 250_000  # beyond this many comparisons, levels are halved before they are aligned
LEAST_PAGES = 3  # pages of a host that must show a text or link node before it counts as the host's
SKELETONS = 64  # distinct skeletons of a host that a task holds before it aligns them
HOSTS = 2_000  # wrappers a task holds before it hands them on
SALTS = 64  # first-step groups per host
RARE = 32  # an optional entry that fewer than one in so many pages have is left out
JUDGED = 256  # wrappers a worker keeps


class Node:
    """A tag with its kids (nodes and strings)."""

    __slots__ = ("tag", "key", "kids", "blocks")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.kids = tag, key, []
        self.blocks: dict[str, int] = {}  # digest and length of the blocks of text in it and in its kids


def key_of(tag: str, attributes: str) -> str:
    """Tag with its class, layout id and role, digits aside: what makes two tags the same in a wrapper."""
    if "=" not in attributes:
        return tag
    found = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)}
    if "id" in found and not set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found["id"]).lower())) <= ID_WORDS:
        del found["id"]
    marks = [("." if name == "class" else "#" if name == "id" else "@") + re.sub(r"\d+", "", " ".join(sorted(found[name].split()))) for name in ("class", "id", "role") if name in found]
    return " ".join([tag, *marks])


def parse(page: str) -> Node:
    """Tree of a page, however broken: missing end tags are implied, stray ones ignored, a cut-off tag dropped."""
    root = Node("", "")
    stack = [root]
    position, size = 0, len(page)
    while position < size:
        found = TOKEN.search(page, position)
        start = found.start() if found else size
        if start > position:
            if stack[-1].tag == "head" and not page[position:start].isspace():
                _close(stack, {"head"}, set())
            stack[-1].kids.append(page[position:start])
        if not found:
            break
        position = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        if found["tag2"] and not page.endswith(">", found.start(), position):
            break  # a tag that the end of the page cuts off
        tag = tag.lower()
        if found["end"] or found["end2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        attributes = found["attributes"] or found["rest"] or ""
        if tag not in HEAD_CONTENT:
            _close(stack, {"head"}, set())
        if tag in BLOCKS_CLOSE_P:
            _close(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "body", "main"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], SCOPE.get(tag, set()))
        node = Node(tag, key_of(tag, attributes))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, position)
            position = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in scope:
            return
        if stack[depth].tag in tags:
            del stack[depth:]
            return


# A wrapper entry is [key, repeated, optional, kids, literal text or None, characters seen, pages that have it, digests of
# the blocks in it that all of them have, whether they have others too]; the key of a text is "#".
KEY, REPEATED, OPTIONAL, KIDS, LITERAL, CHARS, SEEN, COMMON, VARIED = range(9)


def block_digest(key: str, text: str) -> str:
    return hashlib.blake2b(f"{key}\t{text}".encode(), digest_size=8).hexdigest()


def note_blocks(root: Node) -> Node:
    """Gives each block of text, read as text_of reads it, to the node above the one it stands in."""
    parts: list[str] = []

    def walk(node: Node, within: Node, above: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                parts.append(html.unescape(kid))
                continue
            if kid.tag == "br":
                parts.append(" ")
            if kid.tag in INLINE:
                if named(kid.key) < WHOLE:
                    walk(kid, within, above)
            else:
                end(within, above)
                walk(kid, kid, within)
                end(kid, within)

    def end(within: Node, above: Node) -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                above.blocks[block_digest(within.key, text)] = len(text)
            parts.clear()

    walk(root, root, root)
    end(root, root)
    return root


def skeleton(node: Node) -> list:
    kids: list[list] = []
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if text:
                # of a long text the digest is enough to see whether it ever differs
                literal = text if len(text) <= 80 else hashlib.blake2b(text.encode(), digest_size=12).hexdigest()
                kids.append(["#", False, False, [], literal, len(text), 1, {}, False])
        elif kid.tag not in INLINE or kid.kids:
            kids.append(skeleton(kid))
    return [node.key, False, False, folded(kids), None, 0, 1, node.blocks, False]


def folded(entries: list[list]) -> list[list]:
    """Equal neighbours, and equal neighbouring groups of two to four, as one repeated entry."""
    out: list[list] = []
    for entry in entries:
        if out and out[-1][KEY] == entry[KEY]:
            out[-1] = merged(out[-1], entry, True)
            out[-1][REPEATED] = True
        else:
            out.append(entry)
    for width in (2, 3, 4):
        i = 0
        while i + 2 * width <= len(out):
            if [e[KEY] for e in out[i:i + width]] == [e[KEY] for e in out[i + width:i + 2 * width]]:
                group = [merged(a, b, True) for a, b in zip(out[i:i + width], out[i + width:i + 2 * width])]
                j = i + 2 * width
                while [e[KEY] for e in out[j:j + width]] == [e[KEY] for e in group]:
                    group = [merged(a, b, True) for a, b in zip(group, out[j:j + width])]
                    j += width
                out[i:j] = [["(" + "|".join(e[KEY] for e in group) + ")", True, False, group, None, 0, 1, {}, False]]
            i += 1
    return out


def merged(a: list, b: list, same_page: bool = False) -> list:
    """One entry that stands for two of one key."""
    return [a[KEY], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], aligned(a[KIDS], b[KIDS], same_page),
            a[LITERAL] if a[LITERAL] == b[LITERAL] else None, a[CHARS] + b[CHARS], max(a[SEEN], b[SEEN]) if same_page else a[SEEN] + b[SEEN], *_common(a, b, same_page)]


def _common(a: list, b: list, same_page: bool) -> tuple[dict[str, int], bool]:
    x, y = a[COMMON], b[COMMON]
    if same_page:
        return x | y, a[VARIED] or b[VARIED]
    return {k: n for k, n in x.items() if k in y}, a[VARIED] or b[VARIED] or x.keys() != y.keys()


def _grouped(entries: list[list], others: list[list]) -> list[list]:
    """Entries that occur as a repeated group on the other side, put into one."""
    for group in others:
        if group[KEY].startswith("("):
            keys = [e[KEY] for e in group[KIDS]]
            for i in range(len(entries) - len(keys) + 1):
                if [e[KEY] for e in entries[i:i + len(keys)]] == keys:
                    entries = [*entries[:i], [group[KEY], True, False, entries[i:i + len(keys)], None, 0, max(e[SEEN] for e in entries[i:i + len(keys)]), {}, False], *entries[i + len(keys):]]
                    break
    return entries


def aligned(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Entries of both lists in order: matches merged, mismatches optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    keys_a, keys_b = [e[KEY] for e in a], [e[KEY] for e in b]
    if keys_a == keys_b:
        return [merged(x, y, same_page) for x, y in zip(a, b)]
    out: list[list] = []
    i = j = 0
    for x, y in [*_matches(keys_a, keys_b), (len(a), len(b))]:
        for e in [*a[i:x], *b[j:y]]:
            out.append([*e[:OPTIONAL], True, *e[KIDS:]])
        if x < len(a):
            out.append(merged(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; large levels are halved (Hirschberg) down to LCS_CELLS, so memory stays linear."""
    if len(a) * len(b) > LCS_CELLS and min(len(a), len(b)) > 1:
        half = len(a) // 2
        before, after = _prefix_matches(b, a[:half]), _prefix_matches(b[::-1], a[half:][::-1])
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        return _matches(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _matches(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _prefix_matches(b: list[str], a: list[str]) -> list[int]:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``: one bit of an integer per place of ``b``."""
    places: dict[str, int] = {}
    for j, key in enumerate(b):
        places[key] = places.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a 0 where the length grows
    for key in a:
        hits = row & places.get(key, 0)
        row = (row + hits | row & ~hits) & full
    return [0, *accumulate(bit == "0" for bit in reversed(f"{row:0{len(b)}b}"[-len(b):]))]


def shape(entry: list) -> str:
    """What two skeletons must share to differ in texts only."""
    return f"{entry[KEY]}{'+' * entry[REPEATED]}{'?' * entry[OPTIONAL]}[{','.join(map(shape, entry[KIDS]))}]" if entry[KIDS] else f"{entry[KEY]}{'+' * entry[REPEATED]}"


def absorb(into: list, entry: list) -> None:
    """Adds a skeleton of the same shape: only literals and character counts can change."""
    if into[LITERAL] != entry[LITERAL]:
        into[LITERAL] = None
    into[CHARS] += entry[CHARS]
    into[SEEN] += entry[SEEN]
    into[COMMON], into[VARIED] = _common(into, entry, False)
    for a, b in zip(into[KIDS], entry[KIDS]):
        absorb(a, b)


def align_all(wrappers: list[list]) -> list:
    """One wrapper of several, the same in whatever order they come, without its rarest branches."""
    return pruned(reduce(merged, sorted(wrappers, key=json.dumps)))


def pruned(entry: list) -> list:
    """Without optional entries that few of the pages have: what each page has for itself doesn't pile up.

    Pages of a rare template are read by themselves.
    """
    entry[KIDS] = [pruned(e) for e in entry[KIDS] if not e[OPTIONAL] or e[SEEN] * RARE >= entry[SEEN]]
    return entry


def forgetful(entry: list) -> list:
    """Without the common blocks of entries on too few pages to be judged by them; their lengths stay as one sum."""
    if entry[SEEN] < LEAST_PAGES and entry[COMMON]:
        entry[COMMON] = {"": sum(entry[COMMON].values())}
    for kid in entry[KIDS]:
        forgetful(kid)
    return entry


# ---- judging a wrapper

PART, WHOLE, TAG = 1, 2, 3  # how a key names furniture: a word inside a class or id, a whole class or id, the tag or role


@lru_cache(maxsize=65536)
def named(key: str) -> int:
    """How the key names furniture; 0 if it does not."""
    tag, *marks = key.split(" ")
    if tag in FURNITURE_TAGS:
        return TAG
    words, _, roles = " ".join(marks).partition("@")
    if set(roles.split()) & FURNITURE_ROLES:
        return TAG
    found = 0
    for token in words.split():
        parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
        if parts & FURNITURE_WORDS:
            found = max(found, PART if parts - FURNITURE_WORDS - PLACE_WORDS else WHOLE)
    return found


def holder(key: str) -> int:
    """ARTICLE or MAIN if the tag or role says so."""
    tag, roles = key.split(" ")[0], key.partition("@")[2].split()
    return ARTICLE if tag == "article" or "article" in roles else MAIN if tag == "main" or "main" in roles else 0


def never_furniture(key: str, in_article: bool) -> bool:
    """Whole pages and articles; an article inside another one can be a comment or a teaser."""
    return key.split(" ")[0] in ("", "html", "body") or holder(key) == MAIN or (holder(key) == ARTICLE and not in_article)


ARTICLE, MAIN, DENSE = 1, 2, 3  # why a node holds the article; a page uses the first of these that it has


@dataclass
class Facts:
    """What an entry shows over all pages."""

    chars: int = 0
    linked: int = 0  # of them inside links
    running: int = 0  # of them outside links and furniture tags, and not the same on all pages
    holder: bool = False  # an article or main is in it
    varies: bool = False  # a text in it is not the same on all pages
    headline: bool = False  # an h1 that varies is in it


def facts_of(entry: list, found: dict[int, Facts], linked: bool = False) -> Facts:
    """Facts of the entry and, by id, of all entries below."""
    if entry[KEY] == "#":
        fixed = entry[LITERAL] is not None and not entry[REPEATED] and entry[SEEN] > 1
        own = Facts(entry[CHARS], entry[CHARS] * linked, 0 if linked or fixed else entry[CHARS], varies=not fixed)
    else:
        tag = entry[KEY].split(" ")[0]
        kids = [facts_of(e, found, linked or tag == "a") for e in _kids(entry)]
        open_ = named(entry[KEY]) != TAG or tag in ("form", "header")
        varies = any(k.varies for k in kids)
        own = Facts(sum(k.chars for k in kids), sum(k.linked for k in kids), open_ * sum(k.running for k in kids), open_ and (bool(holder(entry[KEY])) or any(k.holder for k in kids)),
                    varies, open_ and (tag == "h1" and varies or any(k.headline for k in kids)))
    found[id(entry)] = own
    return own


def furniture_of(entry: list, total: int, facts: Facts, in_article: bool) -> bool:
    """Furniture by its name and by what the wrapper shows of it."""
    name = named(entry[KEY]) if entry[KEY] != "#" else 0
    tag = entry[KEY].split(" ")[0]
    if not name or never_furniture(entry[KEY], in_article):
        return False
    share = facts.running / total if total else 0
    most = share > (0.5 if name == PART or facts.holder else 0.8)  # most of all running text
    if name == TAG:  # a form around the page, the header of an article
        return not (tag == "form" and most or tag == "header" and facts.headline)
    if most or facts.headline:
        return False
    return name == WHOLE or 2 * facts.linked > facts.chars or (entry[SEEN] > 1 and not facts.running)


def _running(entry: list, furniture: set[int], linked: bool = False) -> int:
    """Characters of an entry's texts that differ between pages or repeat, outside furniture and links."""
    if entry[KEY] == "#":
        return 0 if linked or (entry[LITERAL] is not None and not entry[REPEATED]) else entry[CHARS]
    if id(entry) in furniture or linked:
        return 0
    inside = linked or entry[KEY].split(" ")[0] == "a"
    return sum(_running(e, furniture, inside) for e in entry[KIDS])


def judged(entry: list) -> dict:
    """The wrapper with its verdicts: furniture, holds, kids by key, and what of its text is the host's.

    common: blocks that all pages show; links: nothing but links; trusted, of
    the whole: whether article and main hold most running text.
    """
    facts: dict[int, Facts] = {}
    whole = facts_of(entry, facts).running
    furniture: set[int] = set()

    def mark(e: list, in_article: bool) -> None:
        if e[KEY] != "#" and furniture_of(e, whole, facts[id(e)], in_article):
            furniture.add(id(e))
            return
        for k in _kids(e):
            mark(k, in_article or holder(e[KEY]) == ARTICLE)

    mark(entry, False)
    total = _running(entry, furniture)
    dense = [entry]
    while total:  # down to the smallest node that holds nearly all running text
        heavy = next((same for key, same in _by_key(dense).items() if key.split(" ")[0] not in INLINE and not any(e[REPEATED] or id(e) in furniture for e in same)
                      and sum(_running(e, furniture) for e in same) >= 0.8 * total), None)
        if heavy is None:
            break
        dense = heavy
    dense_ids = set(map(id, dense))

    def weight(e: list, tier: int, inside: bool = False) -> int:
        """Running characters in the entries of this tier, outside furniture."""
        inside = inside or not tier or (e[KEY] != "#" and holder(e[KEY]) == tier)
        if e[KEY] == "#":
            return inside * facts[id(e)].running
        return 0 if id(e) in furniture else sum(weight(k, tier, inside) for k in _kids(e))

    def shown(e: list) -> int:
        return sum(n * e[SEEN] for n in e[COMMON].values()) + sum(shown(k) for k in _kids(e) if k[KEY] != "#" and id(k) not in furniture)

    def verdict(same: list[list], pages: int, repeated: bool = False, templates: bool = True) -> dict:
        key, seen = same[0][KEY], sum(e[SEEN] for e in same)
        holds = holder(key) or (DENSE if id(same[0]) in dense_ids else 0)
        repeated = repeated or any(e[REPEATED] for e in same)
        if holds:
            # its pages decide what is a template; where most of its text is the same, they are copies of one another
            pages, repeated = seen, False
            templates = 2 * sum(map(shown, same)) <= sum(facts[id(e)].chars for e in same)
        common: dict[str, int] = {}
        for e in same:
            for digest in e[COMMON]:
                common[digest] = common.get(digest, 0) + e[SEEN]
        chars, linked = (sum(getattr(facts[id(e)], n) for e in same) for n in ("chars", "linked"))
        of_host = templates and seen >= LEAST_PAGES and 2 * seen > pages
        return {"furniture": all(id(e) in furniture for e in same), "holds": holds, "kids": {k: verdict(v, pages, repeated, templates) for k, v in _by_key(same).items()},
                "repeated": repeated, "varied": any(e[VARIED] for e in same), "links": of_host and not holds and not repeated and 10 * linked >= 9 * chars > 0,
                "common": {d for d, n in common.items() if templates and n >= LEAST_PAGES and 2 * n > pages}}

    out, all_running = verdict([entry], entry[SEEN]), weight(entry, 0)
    out["trusted"] = {tier for tier in (ARTICLE, MAIN) if 2 * weight(entry, tier) >= all_running}
    return out


def _by_key(entries: list[list]) -> dict[str, list[list]]:
    """Kids that are tags, by key: pages whose order differs leave one key at several places of a wrapper."""
    out: dict[str, list[list]] = {}
    for entry in entries:
        for e in _kids(entry):
            if e[KEY] != "#":
                out.setdefault(e[KEY], []).append(e)
    return out


def _kids(entry: list) -> list[list]:
    """Kids with the members of repeated groups, repeated themselves, in the groups' places."""
    out = []
    for e in entry[KIDS]:
        if e[KEY].startswith("("):
            for member in _kids(e):
                member[REPEATED] = True
                out.append(member)
        else:
            out.append(e)
    return out


def text_of(root: Node, wrapper: dict) -> str:
    """Blocks of the nodes that hold the article, without the host's own, joined by two line breaks.

    A heading that all pages show stays where text of the page follows it, and
    so do such cells of a table: their places in the article are the page's.
    """
    tiers: dict[int, list[tuple[str, bool, bool]]] = {}  # blocks, whether they are the host's, whether they are headings
    open_blocks: dict[int, list[str]] = {}

    def end_block(block: tuple) -> None:
        key, own, above, links = block
        tag = key.split(" ")[0]
        for tier, parts in open_blocks.items():
            if text := " ".join("".join(parts).split()):
                hosts = links and tag not in HEADINGS
                if not hosts and tag not in CELLS and above and above["common"] and (above["varied"] or not (own and own["repeated"])):
                    hosts = block_digest(key, text) in above["common"]
                tiers.setdefault(tier, []).append((text, hosts, tag in HEADINGS))
        open_blocks.clear()

    def walk(node: Node, entry: dict | None, held: frozenset[int], block: tuple) -> None:
        kids = (entry or {}).get("kids", {})
        for kid in node.kids:
            if isinstance(kid, str):
                for tier in held:
                    open_blocks.setdefault(tier, []).append(html.unescape(kid))
                continue
            judgement = kids.get(kid.key)
            inline = kid.tag in INLINE
            if not inline:
                end_block(block)
            if judgement is None:
                skip, inner = named(kid.key) > PART and not never_furniture(kid.key, ARTICLE in held), held
            else:
                skip, inner = judgement["furniture"], held | {judgement["holds"]} if judgement["holds"] else held
            if kid.tag == "br":
                for tier in held:
                    open_blocks.setdefault(tier, []).append(" ")
            elif not skip:
                if len(inner) > len(held):
                    tiers.setdefault(judgement["holds"], [])
                kid_block = block if inline else (kid.key, judgement, block[1], block[3] or bool(judgement and judgement["links"]))
                walk(kid, judgement, inner, kid_block)
                if not inline:
                    end_block(kid_block)

    start = (root.key, wrapper, wrapper, False)
    walk(root, wrapper, frozenset([wrapper["holds"]]) if wrapper["holds"] else frozenset(), start)
    end_block(start)
    # a page that shows nothing but its host's blocks keeps them
    texts = {tier: _of_page(blocks) or [t for t, *_ in blocks] for tier, blocks in tiers.items()}
    longest = max((sum(map(len, blocks)) for blocks in texts.values()), default=0)
    for tier in (ARTICLE, MAIN, DENSE):
        if tier in texts and (tier in wrapper["trusted"] or 2 * sum(map(len, texts[tier])) >= longest):
            return "\n\n".join(texts[tier])
    return ""


def _of_page(blocks: list[tuple[str, bool, bool]]) -> list[str]:
    """Blocks that are not the host's; a heading of the host stays with a block of the page below it."""
    out: list[str] = []
    waiting: list[str] = []
    for text, hosts, heading in blocks:
        if hosts and heading:
            waiting = [text]
        elif not hosts:
            out += [*waiting, text]
            waiting = []
    return out


def main_text(page: str, wrapper: dict | None) -> str:
    """Text of a page by its host's verdicts; a page that has none of the nodes they speak of is judged by itself."""
    root = parse(page)
    return (wrapper and text_of(root, wrapper)) or text_of(root, judged(skeleton(note_blocks(root))))


# ---- the Spark job

def host_of(url: str | Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def fit_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) from (host, page) rows: all pages of each host, aligned."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, dict[str, list]] = {}
        seen: dict[str, int] = {}

        def hand_on() -> pa.RecordBatch:
            rows = [{"host": h, "wrapper": json.dumps(align_all(list(found.values()))), "pages": seen[h]} for h, found in hosts.items()]
            hosts.clear()
            seen.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64())]))

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                entry = skeleton(note_blocks(parse(page.as_py())))
                found = hosts.setdefault(host, {})
                seen[host] = seen.get(host, 0) + 1
                form = shape(entry)
                if form in found:
                    absorb(found[form], entry)
                else:
                    found[form] = entry
                if len(found) > SKELETONS:
                    one = align_all(list(found.values()))
                    hosts[host] = {shape(one): one}
                if len(hosts) > HOSTS:
                    yield hand_on()
        if hosts:
            yield hand_on()

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = align(rows)
        return out.assign(wrapper=[json.dumps(forgetful(json.loads(w))) for w in out["wrapper"]])

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        one = align_all([json.loads(w) for w in rows["wrapper"]])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(one)], "pages": [rows["pages"].sum()]})

    kind = "host string, wrapper string, pages long"
    parts = pages.mapInArrow(own, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = parts.groupBy("host", "salt").applyInPandas(align, kind)
    return parts.groupBy("host").applyInPandas(whole, kind)


class Judgements:
    """Verdicts by host from the written wrappers; a bounded number is kept."""

    def __init__(self, path: str):
        store, folder = shared_fs(path)
        self.table = dataset.dataset(folder, filesystem=store, format="parquet")
        self.known: dict[str, dict] = {}

    def of(self, hosts: list[str]) -> dict[str, dict]:
        """Verdicts of all these hosts, read in one pass over the files that can hold them."""
        if missing := set(hosts) - self.known.keys():
            if len(self.known) > JUDGED:
                self.known = {h: self.known[h] for h in self.known.keys() & set(hosts)}
            for part in self.table.to_batches(filter=dataset.field("host").isin(sorted(missing)), batch_size=64):
                for host, wrapper in zip(part["host"].to_pylist(), part["wrapper"]):
                    self.known[host] = judged(json.loads(wrapper.as_py()))
        return self.known


def main_text_column(page: Column, host: Column, path: str) -> Column:
    """Main text of each page; a worker reads the wrappers of a batch's hosts from ``path``, each once."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        judgements = Judgements(path)
        for pages, hosts in batches:
            names = hosts.to_pylist()
            for at in range(0, len(names), JUDGED):
                known = judgements.of(names[at:at + JUDGED])
                yield pa.array([main_text(p.as_py(), known.get(h)) for p, h in zip(pages[at:at + JUDGED], names[at:at + JUDGED])], pa.string())

    return texts(page, host)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text; a null or odd URL
    belongs to the host "". A page that has none of the nodes its host's
    wrapper speaks of (a rare template) is judged by itself. Repeated pages and ids each give their row; an
    empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host_of(F.col(url_column).cast("string")).alias("host"), text_or_empty(html_column).alias("page"))
    path = new_stage_path(pages.sparkSession, "wrappers")
    fit_wrappers(rows.select("host", "page")).select("host", "wrapper").sortWithinPartitions("host").write.option("maxRecordsPerFile", 256).parquet(path)
    # pages of a host side by side, so that a task reads each wrapper once
    rows = rows.sortWithinPartitions("host").withColumn("text", main_text_column(F.col("page"), F.col("host"), path))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
