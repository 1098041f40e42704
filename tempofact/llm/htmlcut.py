"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes blocks: runs of text within one block-level element. A block has features: its enclosing elements, class
and id words, the share of linked text, length, kind of element, end. A logistic classifier turns them into a log-odds
of being content, the capacity of the block's terminal edge. Blocks that follow each other and blocks under one parent
are joined by smoothness edges, weaker with distance in the tree. The minimum cut keeps the blocks on the content side.

The classifier starts from ``PRIOR`` and is fitted to the blocks of a bounded sample (``SAMPLE`` pages) whose markup says what
is content, an article or main element. Each block counts twice, as it is and with the elements that say so hidden, so that
what tells content from the rest is learnt for pages without such elements too.

Tags are scanned, never searched for by backtracking: the time is linear in the page.

Defined results: null or empty pages give an empty text; broken markup is read as far as it goes: a tag without > ends
the page; an attribute without its second quote ends at the next >; scripts, styles, titles and text areas are raw up to
their own end tag (without one a script or style holds the rest, a title or text area nothing); a head without end tag ends
before the first element or text that cannot stand in it, an svg or select at the next block; other elements that are
skipped whole are read if they are never closed; hidden elements are never text; every row gives one row.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import bounded_sample, extended, packed, received, send, tune
from tempofact.session import ship

SAMPLE, STRENGTH = 2000, 20.0
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><\"'=]*)")
IN_TAG = re.compile(r"=\s*+[\"']|>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

SKIPPED = frozenset("script style template noscript iframe svg math object canvas textarea title head select datalist audio video".split())
#: Of these, what holds no tags, what may hold its like, and what the next block ends; what a head may hold.
RAW = frozenset("script style textarea title".split())
NESTING = frozenset("template svg math object".split())
SHORT = frozenset("svg math select datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul hr".split()
)
#: Elements that an opening tag of the same set closes, up to the enclosing container.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "option": frozenset(["option"])}
LIMITS = frozenset("ul ol menu dl table body html article section div main aside nav form".split())
ENDS_P = BLOCK - {"html", "body"}
BAD_TAGS = frozenset("nav footer aside dialog menu search button label fieldset".split())
GOOD_TAGS = frozenset(["article", "main"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids: what is never part of an article even if marked up as one, and what lies around it.
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion teaser teasers cookie cookies consent gdpr notice notices notification alert "
    "comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription paywall".split()
)
AROUND = frozenset(
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side widget footer foot header masthead topbar login signup search popup modal overlay copyright legal "
    "toolbar pager pagination".split()
)
GOOD_WORDS = frozenset("article content main post entry story body text prose".split())
#: What may stand beside a word of APART in the name of a part of a page; with other words the name tells of a subject.
STRUCTURE = frozenset(
    "area bar block body bottom box btn button buttons card cards center col column container content entry feed field footer form frame group head header heading holder icon icons "
    "image inner input item items label left level link links list message module nav outer overlay panel popup post posts region right row section sidebar side signup slot space spot "
    "story stories stream strip tab text thread title tools top unit user widget wrap wrapper wrappers article articles author avatar meta modal banner thumb count number".split()
)
#: Names that begin or end so tell a state or a subject, not a part of the page.
STATE_FIRST = frozenset("has no with without is not show hide category tag format type status".split())
STATE_LAST = frozenset("open closed enabled disabled off on".split())
HEADS = frozenset("header heading headline title".split())
SOFT_END = (".", "!", "?", "…", ":", "\"", "”")
NEXT, SIBLING = 0.4, 0.3

#: Context of a block: in an article, in a part named like one, unknown, around one by name, by element, apart by name.
ARTICLE, NAMED, UNKNOWN, NEAR, OUTER, OTHER = range(6)
PARAGRAPH, ITEM, PLAIN = range(3)
#: Log-odds by feature, before fitting: (context, its weight), words, linked share outside and inside articles, kind, end.
PRIOR = np.array([4.0, 1.0, -0.6, -3.0, -5.0, -6.0, -0.5, -0.3, 0.2, 1.2, 0.0, -0.5, -1.5, -3.0, 0.0, -0.2, -0.5, -1.0, 0.8, -0.2, 0.0, 0.4, -2.0])
AT = {"context": 0, "words": 6, "links": 10, "inside": 14, "kind": 18, "end": 21, "rights": 22}


class Element:
    __slots__ = ("tag", "context", "depth", "hidden", "link", "skip", "serial", "block", "above")

    def __init__(self, tag: str, context: int, parent: Element | None, hidden: bool, serial: int):
        self.tag, self.context, self.hidden, self.serial, self.skip = tag, context, hidden, serial, False
        self.depth = parent.depth + 1 if parent else 0
        self.link = bool(parent and parent.link) or tag == "a"
        self.block, self.above = self, parent.serial if parent else 0  # its block and the number of the element around it


def tokens(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """(tag or "", end tag?, attributes or text, where it ends), scanned once from left to right."""
    at, size, missing = 0, len(page), set()
    while at < size:
        i = page.find("<", at)
        if i < 0:
            yield "", False, page[at:], size
            return
        if i > at:
            yield "", False, page[at:i], i
        m = NAME.match(page, i)
        if m:
            end = tag_end(page, m.end(), missing)
            if end < 0:
                return
            tag = m.group(2).lower()
            at = end + 1
            yield tag, bool(m.group(1)), page[m.end() : end], at
            if tag in RAW and not m.group(1) and page[end - 1] != "/":
                stop = None if tag in missing else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if stop:
                    at = stop.start()
                elif tag in ("script", "style"):
                    return
                else:
                    missing.add(tag)
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            if end < 0:
                return
            at = end + 3
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            end = page.find(">", i)
            if end < 0:
                return
            at = end + 1
        else:
            yield "", False, "<", i + 1
            at = i + 1


def tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the > of a tag stands, or -1. A > within a quoted value is none; a quote is one after = only."""
    while m := IN_TAG.search(page, at):
        quote = page[m.end() - 1]
        if quote == ">":
            return m.end() - 1
        end = -1 if quote in missing else page.find(quote, m.end())
        if end < 0:
            missing.add(quote)
            return page.find(">", m.end())
        at = end + 1
    return -1


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def named(a: dict[str, str]) -> tuple[bool, bool, bool]:
    """What class names and the id say: apart, around, content."""
    apart = around = good = False
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = SPLIT.split(CAMEL.sub("-", name).lower())
        if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            continue
        apart = apart or tells_apart(parts)
        if not GOOD_WORDS.isdisjoint(parts) and (HEADS & set(parts) or AROUND.isdisjoint(parts)):
            good = True
        elif not AROUND.isdisjoint(parts):
            around = True
    return apart, around, good


def tells_apart(parts: list[str]) -> bool:
    """Whether a name says that a part is no content: a word of APART, alone or with words for parts of a page, and not after "main"."""
    rest = [p for p in parts if p not in APART and p and not p.isdigit()]
    return len(rest) < len([p for p in parts if p and not p.isdigit()]) and parts[0] != "main" and all(p in STRUCTURE or p in AROUND or p in GOOD_WORDS or len(p) < 3 for p in rest)


def opened(tag: str, raw: str, parent: Element, serial: int, blind: bool) -> Element:
    """``blind``: elements and roles that say what is content or not say nothing."""
    context, hidden = parent.context, parent.hidden
    a = attributes(raw) if raw and not raw.isspace() and tag not in ("html", "body") else {}
    apart, around, good = named(a) if a else (False, False, False)
    role = a.get("role", "").lower()
    if a:
        style = a.get("style", "").replace(" ", "").lower()
        hidden = hidden or "hidden" in a or "display:none" in style or "visibility:hidden" in style
    marked = tag == "main" or role == "main" or good and (tag == "article" or role == "article")
    if apart and (blind or not marked or context in (OUTER, OTHER)) or context == OTHER:
        context = OTHER
    elif not blind and (tag in BAD_TAGS or tag == "header" and context != ARTICLE and not good or role in BAD_ROLES):
        context = OUTER
    elif not blind and (tag in GOOD_TAGS or role in ("main", "article")) and context != OUTER:
        context = ARTICLE
    elif context in (ARTICLE, NAMED, UNKNOWN) and (around and not good or tag == "form"):
        context = NEAR
    elif good and context == UNKNOWN:
        context = NAMED
    return Element(tag, context, parent, hidden, serial)


def is_closed(page: str, tag: str, at: int, memo: dict[str, tuple[list[int], list[int]]]) -> bool:
    """Does an element opened before ``at`` have an end tag of its own?"""
    if tag not in memo:
        found = [(m.start(), bool(m.group(1))) for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I)]
        memo[tag] = [i for i, end in found if end], [i for i, end in found if not end]
    ends, begins = memo[tag]
    i, j = bisect_left(ends, at), bisect_left(begins, at)
    return i < len(ends) and (tag in NESTING or j == len(begins) or ends[i] < begins[j])


def blocks_of(page: str, blind: bool = False) -> list[tuple[str, tuple, int, int]]:
    """(text, features, depth, parent) of each block in page order. ``parent`` numbers the enclosing containers."""
    out: list[tuple[str, tuple, int, int]] = []
    stack, parts, linked, serial = [Element("", UNKNOWN, None, False, 0)], [], 0, 0
    count: Counter[str] = Counter()  # open elements by tag, so that no end tag searches the stack in vain
    memo: dict = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                own = stack[-1].block
                out.append((text, features(text, own, linked), own.depth, own.above))
        linked = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            count[e.tag] -= 1
        del stack[i:]

    def topmost(tags: frozenset[str]) -> int:
        return next((i for i in range(1, len(stack)) if stack[i].tag in tags), 0) if any(count[t] for t in tags) else 0

    for tag, closing, raw, end in tokens(page):
        if not tag:
            top = stack[-1]
            if top.tag == "head" and not raw.isspace():
                close(len(stack) - 1)
                top = stack[-1]
            if not top.hidden:
                parts.append(raw)
                if top.link:
                    linked += len(raw)
            continue
        if tag in RAW:
            continue
        if not closing and stack[-1].skip:
            head = topmost(frozenset(["head"])) if tag == "body" or stack[-1].tag == "head" and tag not in IN_HEAD else 0
            if i := head or (topmost(SHORT) if tag in BLOCK else 0):
                close(i)
        if tag in VOID:
            if stack[-1].skip:
                continue
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if closing:
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if count[tag] > 0 else 0
            if tag in BLOCK and not (stack[i] if i else stack[-1]).skip:
                flush()
            if i:
                close(i)
            continue
        if tag in BLOCK and not stack[-1].skip:
            flush()
        if tag in SKIPPED and raw.endswith("/"):
            continue
        ends = CLOSES.get(tag) or (CLOSES["p"] if tag in ENDS_P else None)
        if ends and any(count[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in LIMITS or stack[i].skip:
                    break
        if raw.endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        own = opened(tag, raw, stack[-1], serial, blind)
        own.skip = stack[-1].skip or tag in SKIPPED and (tag in SHORT or tag == "head" or is_closed(page, tag, end, memo))
        own.hidden = own.hidden or own.skip
        if tag not in BLOCK or own.skip:
            own.block = stack[-1].block
        stack.append(own)
        count[tag] += 1
    flush()
    return out


def features(text: str, own: Element, linked: int) -> tuple[int, int, int, int, bool, bool]:
    """(context, words, linked share, kind of element, ends like prose, claims rights), each a small number."""
    words, share = text.count(" ") + 1, linked / len(text)
    kind = PARAGRAPH if own.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption") else ITEM if own.tag in ("li", "dt", "dd", "td", "th") else PLAIN
    return (
        own.context, 0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3, 0 if not linked else 1 if share < 0.3 else 2 if share < 0.7 else 3,
        kind, text.endswith(SOFT_END), (text[:1] == "©" or text[:9].lower() == "copyright") and own.context != ARTICLE,
    )


def indicators(f: tuple) -> np.ndarray:
    context, words, links, kind, end, rights = f
    x = np.zeros(len(PRIOR))
    x[[AT["context"] + context, AT["words"] + words, AT["inside" if context == ARTICLE else "links"] + links, AT["kind"] + kind]] = 1
    x[AT["end"]], x[AT["rights"]] = end, rights
    return x


def odds_table(weights: np.ndarray) -> dict[tuple, float]:
    """The log-odds of every combination of features."""
    return {f: float(indicators(f) @ weights) for f in product(range(6), range(4), range(4), range(3), (False, True), (False, True))}


def edges_of(blocks: list[tuple[str, tuple, int, int]]) -> list[tuple[int, int, float]]:
    """Smoothness between followers, by distance in the tree and of context, and between blocks of one parent and context."""
    out, last = [], {}
    for i, (_, f, depth, parent) in enumerate(blocks):
        if i:
            _, g, d, above = blocks[i - 1]
            out.append((i - 1, i, NEXT / (1 + abs(depth - d) + (parent != above) + 2 * (f[0] != g[0]))))
        if (parent, f[0]) in last:
            out.append((last[parent, f[0]], i, SIBLING))
        last[parent, f[0]] = i
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]], eps: float = 1e-9) -> list[bool]:
    """Which nodes lie on the source side. Positive odds are capacities from the source, negative ones to the sink.

    Shortest augmenting paths from each node with excess; a search that finds no sink closes the nodes it saw, which
    no later path can leave, so each is searched once more at most.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    left, closed = list(odds), [False] * n
    for s in range(n):
        while left[s] > eps and not closed[s]:
            came, todo, end = {s: s}, deque([s]), -1
            while todo and end < 0:
                x = todo.popleft()
                for y, w in near[x].items():
                    if w > eps and y not in came and not closed[y]:
                        came[y] = x
                        if left[y] < -eps:
                            end = y
                            break
                        todo.append(y)
            if end < 0:
                for x in came:
                    closed[x] = True
                break
            push, x = min(left[s], -left[end]), end
            while x != s:
                push, x = min(push, near[came[x]][x]), came[x]
            x = end
            while x != s:
                near[came[x]][x] -= push
                near[x][came[x]] += push
                x = came[x]
            left[s] -= push
            left[end] += push
    return closed


def main_text(page: str | None, odds: dict[tuple, float] | None = None) -> tuple[str, int, int]:
    """The text, the number of blocks, and of blocks kept."""
    odds = odds or DEFAULT
    blocks = blocks_of(page) if page else []
    keep = min_cut([odds[b[1]] for b in blocks], edges_of(blocks))
    kept = [b[0] for b, k in zip(blocks, keep) if k]
    return "\n".join(kept), len(blocks), len(kept)


def labelled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (features, content or not) of pages that mark their content, as they are and blind to such marks."""
    for b in batches:
        n: Counter = Counter()
        for page in b.column("html").to_pylist():
            seen = blocks_of(page) if page else []
            if any(f[0] == ARTICLE for _, f, _, _ in seen):
                for (_, f, _, _), (_, g, _, _) in zip(seen, blocks_of(page, blind=True)):
                    n[f, f[0] == ARTICLE] += 1
                    n[g, f[0] == ARTICLE] += 1
        cols = list(zip(*([*map(int, f), int(y), k] for (f, y), k in n.items()))) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], [*"abcdef", "y", "n"])


def fit(pages: DataFrame, bound: int = SAMPLE, rounds: int = 25) -> np.ndarray:
    """Weights of the block classifier: the most likely ones under a normal prior around PRIOR.

    ``bound`` pages are read, those with the least hash of page_id and html; their blocks are counted by features, so
    the driver sees a few hundred rows. The counts weigh as much as ``STRENGTH`` pages.
    """
    tune(pages.sparkSession, 500)
    chosen = bounded_sample(pages.select(F.xxhash64("page_id", "html").alias("h")).distinct(), "h", bound)
    sample = pages.select("html", F.xxhash64("page_id", "html").alias("h")).join(F.broadcast(chosen), "h").select("html")
    names = [*"abcdef", "y"]
    got = sample.mapInArrow(labelled_blocks, ", ".join(f"{c} bigint" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n")).collect()
    if not got:
        return PRIOR
    x, y, n = np.array([indicators((*map(int, r[:4]), bool(r[4]), bool(r[5]))) for r in got]), np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)
    n, w = n * min(1.0, STRENGTH * 30 / n.sum()), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - p)) - (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Every row without html, with text, n_blocks and n_kept."""
    tune(pages.sparkSession, 500)
    row, back = packed(pages, "html", "text", "n_blocks", "n_kept")
    rest = pages.select(row, F.col("html").alias("_html"))
    model = send(pages.sparkSession, PRIOR if weights is None else weights)  # a fixed few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = odds_table(received(model))
        for b in batches:
            got = [main_text(p, odds) for p in b.column("_html").to_pylist()]
            own = [b.column(i) for i in range(b.num_columns - 1)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *cols], [*b.schema.names[:-1], "text", "n_blocks", "n_kept"])

    return rest.mapInArrow(run, extended(rest, "text string, n_blocks bigint, n_kept bigint", "_html")).select(*back, "text", "n_blocks", "n_kept")


DEFAULT = odds_table(PRIOR)
ship(__name__)
