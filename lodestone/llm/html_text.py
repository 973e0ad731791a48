"""Main text of HTML pages: a host suffix array finds what pages share, and what a page states itself corrects it.

Every page goes through the suffix array of its host. The token streams of a host's pages are concatenated and
their suffixes ranked by prefix doubling to the depth of a long substring; equal ranks are the intervals of the suffix
array that share that many tokens. Tasks send each interval once, with its number of pages, and the intervals of all
tasks meet by a hash of their tokens, so that a host with a third of all pages is no larger than its distinct substrings.
Runs covered by substrings of enough distinct pages are boilerplate; unique runs stay. Pages alike in all text that may
be the main text are one page, so that copies of an article do not make it boilerplate.

The check that follows is structural. An article (or else main) element holds the main text; elements for navigation,
adverts, forms and the like never do, by tag, role or class, however rare they are. What an article says in paragraphs,
headings and the like is its own, however often it is repeated, and therefore not asked of the array; what it holds in
elements that say nothing (div, section) goes if whole blocks of it are boilerplate. What is neither is for the array alone.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

#: Tokens of a long substring (a power of two), and distinct pages of a host from which it is boilerplate.
DEPTH, PAGES = 16, 3
#: Tokens of page streams that are ranked together.
STREAM = 1 << 20
#: Share of a block's characters in links from which it is all links, links in a row with nothing else that are a menu, and share of an article's characters in links from which it is a teaser of another one.
LINKED, MENU, TEASER = 0.9, 2, 0.5

MARKUP = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[/!?a-zA-Z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "object", "video", "audio", "select", "xmp"}
NOISE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "datalist"} | RAW
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
NOISE_NAMES = set(
    "ad ads adbox adsense adslot adslots adunit adunits adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing related recommended"
    " recommendations comment comments commentlist disqus reply replies respond pagination pager toolbar login search skip widget widgets teaser disclaimer copyright".split()
)
HEADER_NAMES = {"header", "topbar"}
#: Words that say where or how something stands; a name is noise if it has a noise word and otherwise only these.
PLACES = set("area bar block blocks body bottom box btn button buttons col column container content cta desktop form group holder icon icons inline inner item items left link links list main mobile module outer page panel placeholder post posts primary right row secondary section side site slot space sticky text title top unit wrap wrapper zone".split())
#: Elements whose ids are anchors and often slugs of their text.
ANCHORS = {"article", "dd", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "p", "section", "span"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr caption ul".split()
)
SPACES = {"br", "td", "th", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that say nothing of what they hold.
PLAIN = {"div", "section", "center"}
#: Kinds of blocks: what an article states, what it holds in elements of PLAIN, what only the suffix array decides, and noise by structure.
STATED, HELD, OPEN, NAMED = range(4)
#: Elements that a new block of their own kind ends.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}


def _noisy(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in NOISE or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in NOISE_ROLES:
        return True
    names = found.get("class", "").split() + ([] if tag in ANCHORS else found.get("id", "").split())
    noise = NOISE_NAMES if in_main or tag in ("main", "article") else NOISE_NAMES | HEADER_NAMES
    return any(noise.intersection(parts) and not parts - noise - PLACES for parts in ({x.lower() for x in NAME.findall(name)} for name in names))


def blocks(page: str) -> list[tuple[int, str, int, int, str]]:
    """(part, text, characters in links, links, element) of the visible blocks of a page in order: part is -1 for noise, 0 for undecided text, n for the n-th article, and minus 2 for text of main outside articles."""
    out: list[tuple[int, str, int, int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the part of what they hold
    part, articles, run, at = 0, 0, [], 0
    links, linked, begun = 0, 0, 0  # whether a link is open, characters of the run inside links, and its links
    holder = ""  # the block element that text now stands in

    def end():
        nonlocal run, linked, begun
        if run:
            if text := " ".join("".join(run).split()):
                out.append((part, text, linked, begun, holder))
            run, linked, begun = [], 0, links

    def leave(depth: int):
        nonlocal part
        end()
        del stack[depth:]
        part = stack[-1][1] if stack else 0

    size = len(page)
    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            run.append(html.unescape(page[at : m.start()]))
            linked += len(run[-1]) if links else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if m[1] or m[4] else 1
            begun += links
        if m[1] or m[4]:
            if tag in BLOCKS:
                end()
            elif tag in SPACES:
                run.append(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
            if tag in BLOCKS:
                holder = stack[-1][0] if stack else ""
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = size if close is None else close.start()
                close = close and MARKUP.match(page, at)
                at = close.end() if close else size
            continue
        if tag in BLOCKS:
            end()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in IMPLIED.get(tag, ())):
                leave(len(stack) - 1)
        elif tag in SPACES:
            run.append(" ")
        if tag in VOID:
            continue
        inside = part
        if part != -1:
            if _noisy(tag, attributes, part != 0):
                inside = -1
            elif tag == "article" and part <= 0:
                articles += 1
                inside = articles
            elif part == 0 and (tag == "main" or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes)):
                inside = -2
        if inside != part or tag in BLOCKS and tag != "p" or stack and tag == stack[-1][0]:
            if inside != part:
                end()
            stack.append((tag, inside))
            part = inside
        if tag in BLOCKS:
            holder = tag
    if at < size:
        run.append(html.unescape(page[at:]))
    end()
    return out


def without_menus(found: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each of a stretch of undecided blocks (text, characters in links, links) stays: all but those of links alone, MENU or more in a row."""
    kept: list[bool] = []
    run = links = 0
    for text, linked, n in [*found, ("", -1, 0)]:
        if linked >= LINKED * len(text):
            run, links = run + 1, links + n
            continue
        kept += [links < MENU] * run
        kept.append(True)
        run = links = 0
    return kept[:-1]


def page_blocks(page: str | None) -> tuple[list[str], list[int]]:
    """(visible blocks in order, the kind of each). Articles are decided, and main if it has none; else main outside articles, or with neither the whole page, is open."""
    found = blocks(page or "")
    sizes: dict[int, list[int]] = {}
    for part, text, linked, *_ in found:
        size = sizes.setdefault(part, [0, 0])
        size[0], size[1] = size[0] + len(text), size[1] + linked
    own = {part for part, (n, linked) in sizes.items() if part > 0 and linked < TEASER * n} or {part for part in sizes if part > 0}
    if not own and -2 in sizes:
        own = {-2}
    outside = -2 if own else 0
    stays = iter(without_menus([x[1:4] for x in found if x[0] == outside and x[0] not in own]))
    kinds = []
    for part, *_, holder in found:
        if part in own:
            kinds.append(HELD if holder in PLAIN else STATED)
        else:
            kinds.append(OPEN if part == outside and next(stays) else NAMED)
    return [x[1] for x in found], kinds


def split_page(page: str | None) -> tuple[list[str], list[bool]]:
    """(blocks of a page without the noise by structure, whether only the suffix array decides each)."""
    kept = [(t, k == OPEN) for t, k in zip(*page_blocks(page)) if k != NAMED]
    return [t for t, _ in kept], [u for _, u in kept]


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#\\]*)", (url or "").strip())
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def token_hashes(texts: list[str], host: str) -> np.ndarray:
    """64-bit hashes of the white-space tokens of the texts, each hash mixed with the host."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(host.encode()) & 0xFFFFFFFF
    return np.array([xxh64_intdigest(w, seed) for t in texts for w in t.encode("utf-8", "replace").split()], np.uint64)


def window_keys(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A 64-bit key of the depth tokens from each position on."""
    n = len(tokens) - depth + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    keys, odd = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(depth):
        keys = (keys ^ tokens[k : k + n]) * odd
        keys ^= keys >> np.uint64(29)
    return keys


def suffix_ranks(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Ranks of all suffixes by their first depth tokens, by prefix doubling: equal ranks are one interval of the suffix array."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def intervals(streams: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key, distinct streams) of every interval of the suffix array of the concatenated streams; none spans two streams."""
    streams = [s for s in streams if len(s) >= depth]
    if not streams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parted = [x for i, s in enumerate(streams) for x in (s, np.array([i], np.uint64))]  # a token of its own after each
    rank = suffix_ranks(np.concatenate(parted), depth)
    starts = np.cumsum([0] + [len(s) + 1 for s in streams[:-1]])
    where = np.concatenate([np.arange(a, a + len(s) - depth + 1) for a, s in zip(starts, streams)])
    keys = np.concatenate([window_keys(s, depth) for s in streams])
    page = np.repeat(np.arange(len(streams)), [len(s) - depth + 1 for s in streams])
    once = np.unique(rank[where] * len(streams) + page, return_index=True)[1]  # an interval and a page meet once
    ranks, first, counts = np.unique(rank[where][once], return_index=True, return_counts=True)
    return keys[once][first], counts


def page_stream(texts: list[str], kinds: list[int], host: str, page: int) -> np.ndarray:
    """The tokens that are asked of the suffix array: those of held and open blocks, a token of the page's own, those of noise."""
    asked, noise = ([t for t, k in zip(texts, kinds) if k in own] for own in ((HELD, OPEN), (NAMED,)))
    return np.concatenate([token_hashes(asked, host), np.array([page], np.uint64), token_hashes(noise, host)])


def repeated_substrings(streams: DataFrame, pages_least: int = PAGES, depth: int = DEPTH) -> DataFrame:
    """(key): substrings of depth tokens that occur in pages_least of the streams (tokens), one for each page, at least. Hosts differ in all tokens."""

    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def flush():
            keys, n = intervals(held, depth)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        total = 0
        for batch in batches:
            for tokens in batch.column(0):
                held.append(tokens.values.to_numpy().view(np.uint64))
                total += len(held[-1])
                if total > STREAM:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    found = streams.mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= pages_least).select("key")


def windows(streams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(row, at, key): the substrings of depth tokens of streams (row, tokens), and where each starts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            keys = [window_keys(t.values.to_numpy().view(np.uint64), depth).view(np.int64) for t in batch.column(1)]
            sizes = [len(k) for k in keys]
            rows = np.repeat(batch.column(0).to_numpy(), sizes)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at), pa.array(np.concatenate(keys))], ["row", "at", "key"])

    return streams.select("row", "tokens").mapInArrow(run, "row long, at int, key long")


def main_text(texts: list[str], kinds: list[int], covered: list[int], depth: int = DEPTH) -> str:
    """The blocks of a page (noise by structure left out) joined, less what the suffix array found in them: covered are the starts of repeated windows in the page's stream.

    Open blocks lose the tokens that are covered. Held ones go if all of theirs are, unless those are half of the page's text or more: then the pages are copies of one article.
    """
    if not covered or not (OPEN in kinds or HELD in kinds):
        return "\n".join(texts)
    words = [t.split() if k in (OPEN, HELD) else [] for t, k in zip(texts, kinds)]
    size = sum(map(len, words))
    gone = np.zeros(max(size, max(covered)) + depth + 1, np.int64)
    at = np.array(covered, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + depth, -1)
    gone = np.cumsum(gone) > 0
    ends = np.cumsum([len(w) for w in words])
    repeated = [k == HELD and bool(gone[e - len(w) : e].all()) for w, e, k in zip(words, ends, kinds)]
    if 2 * sum(len(t) for t, r in zip(texts, repeated) if r) >= sum(len(t) for t, k in zip(texts, kinds) if k in (STATED, HELD)):
        repeated = [False] * len(texts)
    out = []
    for text, own, end, kind, r in zip(texts, words, ends, kinds, repeated):
        if kind == OPEN:
            text = " ".join(w for w, g in zip(own, gone[end - len(own) : end]) if not g)
        if text and not r:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, pages_least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null, empty and textless pages have an empty text. A page without a usable url belongs to a host without name.
    Repeated rows give repeated rows, and count as one page of their host. Markup that the page's end breaks off is no text.
    Every page is parsed once; what that gives is written to the shared folder.
    """
    pages = pages.select("page_id", "url", "html")
    ids = pages.select("page_id").schema[0].dataType.simpleString()

    def parse(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts, kinds = page_blocks(page)
                host = host_of(url)
                kept = [(t, k) for t, k in zip(texts, kinds) if k != NAMED]
                digest = xxh64_intdigest("\n".join([host, *(t for t, _ in kept)]).encode("utf-8", "replace"))
                rows.append((digest - (1 << 63), [t for t, _ in kept], [k for _, k in kept], page_stream(texts, kinds, host, digest).view(np.int64)))
            columns = zip(*rows) if rows else [[]] * 4
            kinds_of = pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), k) for c, k in zip(columns, kinds_of))], ["page_id", "url", "digest", "blocks", "kinds", "tokens"])

    parsed = pages.mapInArrow(parse, f"page_id {ids}, url string, digest long, blocks array<string>, kinds array<tinyint>, tokens array<long>")
    parsed = cut(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed", "zstd")
    distinct = parsed.groupBy("digest").agg(F.min("row").alias("row")).select("row")
    known = cut(repeated_substrings(parsed.select("row", "tokens").join(distinct, "row", "left_semi").select("tokens"), pages_least), "repeated")
    asking = F.exists("kinds", lambda k: k.isin(HELD, OPEN))  # the others are evidence only: nothing that is found changes their text
    hits = windows(parsed.where(asking)).join(known, "key").groupBy("row").agg(F.collect_list("at").alias("covered"))

    def rest(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(b, k, c or []) for b, k, c in zip(*(batch.column(x).to_pylist() for x in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    stated = parsed.where(~asking).withColumn("covered", F.lit(None).cast("array<int>"))
    left = parsed.where(asking).join(hits, "row", "left").unionByName(stated)
    return left.select("page_id", "url", "blocks", "kinds", "covered").mapInArrow(rest, f"page_id {ids}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
