"""Main text of web pages: structure first, then a suffix array per host.

A page is cut into blocks of text; scripts, styles, forms, menus, headers, footers, sidebars, notices,
adverts and reader comments are left out by their elements and class names, and where a page has an
``article`` or ``main`` element the blocks are those inside it. The token streams of a host's pages are
then concatenated and sorted as a suffix array (prefix doubling); substrings of ``min_tokens`` tokens or
more that stand on a large share of the pages are boilerplate. Covered tokens go, unique runs stay.

A host with more than ``shard_pages`` pages is split by a hash of the page into shards of about that
size, so no host is gathered in one task. What stands on a large share of all its pages does so on those of one
shard at least: such runs are looked for by a suffix array per shard, counted in every shard, and judged by
their pages on the whole host. So the size of the shards changes no text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, stored, texts_of

# Fixed values of HTML: elements without content, whose content is no markup, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
IMPLIED_END = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# What is no main text, by element and by class, id or role.
SKIP = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video map title".split())
_NAMES = (
    "ads?|advert(s|isement|isements|ising)?|sponsor(s|ed)?|promo(s|tion)?|banner|cookies?|consent|gdpr|notice|notification|alert|newsletter|subscribe|subscription|popup|modal|overlay|"
    "nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|complementary|contentinfo|search|comments?|comment-list|disqus|replies|respond|discussion|share|sharing|social|related|recommended|recommendations|widget|widgets|toolbar|pagination|pager|login|signup|skip-link|tags"
)
_SKIP_NAME = re.compile(rf"(?:site-|page-|post-|main-|article-|user-|reader-|top-|left-|right-)?(?:{_NAMES})(?:[-_](?:{_NAMES}|box|bar|block|section|container|wrapper|wrap|list|area|links?|form|text|message|content|inner|item|unit|slot|left|right|top|bottom|main|column|col|\d+))*", re.IGNORECASE)
_HEADER_NAME = re.compile(r"(?:site-|page-|top-|main-)?(?:header|masthead|branding|topbar)|banner", re.IGNORECASE)
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_MAIN = frozenset({"article", "main"})


def _left_out(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in SKIP or (tag == "header" and not in_main):
        return True
    if tag in ("html", "body") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        for word in value.split():
            if _SKIP_NAME.fullmatch(word) or (not in_main and _HEADER_NAME.fullmatch(word)):
                return True
    return False


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article or main element) of the blocks that structure leaves, references decoded, white space single."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # (element, left out)
    dead = mains = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, mains > 0))
        parts.clear()

    def pop() -> None:
        nonlocal dead, mains
        tag, skipped = stack.pop()
        dead -= skipped
        mains -= tag in _MAIN

    tags: dict[str, tuple[list[int], list[int]]] = {}

    def closes(tag: str, at: int) -> bool:
        """Whether more end tags than start tags of an element follow: one of them ends an element that is open."""
        if tag not in tags:
            found = re.compile(rf"<(/?){re.escape(tag)}\b", re.IGNORECASE).finditer(page)
            places = [(m.start(), m[1]) for m in found]
            tags[tag] = [p for p, end in places if end], [p for p, end in places if not end]
        ends, starts = tags[tag]
        return len(ends) - bisect_left(ends, at) > len(starts) - bisect_left(starts, at)

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at and not dead:
            parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                # an end tag does not reach out of the article it stands in
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in IMPLIED_END:
            ends = IMPLIED_END.get(tag, frozenset({"p"}))
            while stack and (stack[-1][0] in ends or (stack[-1][0] in INLINE and any(t in ends for t, _ in stack[-4:]))):
                pop()
        if tag in _MAIN and dead and not mains and not any(skipped and closes(t, at) for t, skipped in stack):
            while any(skipped for _, skipped in stack):  # a menu or header that is never closed
                pop()
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        skipped = _left_out(tag, attributes or "", mains > 0)
        stack.append((tag, skipped))
        dead += skipped
        mains += tag in _MAIN
    flush()
    if any(inside for _, inside in out):
        out = [b for b in out if b[1]]
    return out


def common_starts(streams: list[list[str]], min_tokens: int, needed: int) -> list[np.ndarray]:
    """Where in each stream a substring of ``min_tokens`` starts that ``needed`` streams have.

    The streams are concatenated with a sentinel of its own after each; prefix doubling ranks the suffixes by their
    first ``min_tokens`` tokens; suffixes of equal rank are an interval of longest common prefix ``min_tokens`` or more.
    """
    sizes = np.array([len(s) for s in streams])
    ends = np.cumsum(sizes + 1)
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    common = np.zeros(ends[-1] if len(ends) else 0, dtype=bool)
    if len(streams) >= needed and sizes.sum() >= min_tokens:
        ids, _ = pd.factorize(np.array([t for s in streams for t in [*s, ""]], dtype=object))
        rank = ids.astype(np.int64) + len(streams)
        rank[ends - 1] = np.arange(len(streams))  # sentinels: equal to nothing else
        done = 1
        while done < min_tokens:
            step = min(done, min_tokens - done)
            behind = np.r_[rank[step:] + 1, np.zeros(step, dtype=np.int64)]
            _, rank = np.unique(rank * (behind.max() + 1) + behind, return_inverse=True)
            done += step
        order = np.argsort(rank, kind="stable")  # the suffix array, by the first min_tokens tokens
        key = np.unique(rank[order] * len(streams) + page[order])
        pages = np.bincount(key // len(streams), minlength=rank.max() + 1)
        starts = np.flatnonzero(pages[rank] >= needed)
        common[starts[ends[page[starts]] - 1 - starts >= min_tokens]] = True  # not over a page's end
    return [common[e - n - 1 : e - 1] for e, n in zip(ends, sizes, strict=True)]


def covered(starts: np.ndarray, min_tokens: int) -> np.ndarray:
    """The tokens within ``min_tokens`` from a start on."""
    edge = np.zeros(len(starts) + min_tokens + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + min_tokens, -1)
    return np.cumsum(edge)[: len(starts)] > 0


def needed_pages(pages: int, share: float, least_pages: int) -> int:
    return max(least_pages, int(np.ceil(share * pages)))


def covered_tokens(streams: list[list[str]], min_tokens: int, share: float, least_pages: int) -> list[np.ndarray]:
    """Which tokens of each stream stand in a substring of ``min_tokens`` or more that enough streams have."""
    starts = common_starts(streams, min_tokens, needed_pages(len(streams), share, least_pages))
    return [covered(s, min_tokens) for s in starts]


def runs_of(tokens: list[str], min_tokens: int) -> list[str]:
    """The substring of ``min_tokens`` from each token on, as far as there is one; tokens hold no space."""
    return [" ".join(tokens[i : i + min_tokens]) for i in range(len(tokens) - min_tokens + 1)]


def unique_runs(blocks: list[list[str]], inside: list[bool], marks: np.ndarray) -> list[str]:
    """Blocks without covered tokens. Inside an article only a wholly covered block goes.

    What is a copy of another page is no boilerplate: an article of which more than four fifths are covered stays
    whole, and so do the blocks outside where no token of theirs is left.
    """
    within = np.repeat(np.array(inside, dtype=bool), [len(b) for b in blocks]) if blocks else np.zeros(0, dtype=bool)
    for side, most in ((within, 0.8), (~within, 1 - 1e-9)):
        if side.any() and marks[side].mean() > most:
            marks = marks & ~side
    out, at = [], 0
    for tokens, main in zip(blocks, inside, strict=True):
        own = marks[at : at + len(tokens)]
        at += len(tokens)
        kept = tokens if main and not own.all() else [t for t, m in zip(tokens, own, strict=True) if not m]
        if kept:
            out.append(" ".join(kept))
    return out


def extract_main_text(
    pages: DataFrame, min_tokens: int = 8, share: float = 0.5, least_pages: int = 6, shard_pages: int = 512
) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Blocks are joined by two line feeds. Null or empty html gives an empty text. Pages whose url has no host form one
    host. Repeated rows are pages of their own. Broken and unclosed markup ends where its parent ends.
    """
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("host"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks_of(p) for p in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    batch.column("host"),
                    batch.column("shards"),
                    pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())),
                    pa.array([[m for _, m in b] for b in found], pa.list_(pa.bool_())),
                ],
                names=["page_id", "url", "host", "shards", "blocks", "inside"],
            )

    # only hosts of several shards are looked up: a small stored table, so that pages are dealt by host and shard at once
    counts = source.groupBy("host").agg(F.count("*").alias("pages"))
    shards = stored(counts.select("host", "pages", F.ceil(F.col("pages") / shard_pages).cast("int").alias("shards")).where("shards > 1"), "host-shards")
    sized = source.join(F.broadcast(shards.select("host", "shards")), "host", "left").select("page_id", "url", "host", "shards", "html")

    def dealt(pages: DataFrame) -> DataFrame:
        parsed = pages.mapInArrow(parse, "page_id long, url string, host string, shards int, blocks array<string>, inside array<boolean>")
        parts = F.coalesce("shards", F.lit(1))
        placed = parsed.withColumn("shard", F.pmod(F.xxhash64("page_id", "url", "blocks"), parts).cast("int")).drop("shards")
        # by both keys: a shuffle by host alone would do for the groups but not for a hot host
        return placed.repartition(*key)

    key = ["host", "shard"]
    result = "page_id long, url string, text string, n_chars long"

    def streams_of(group: pd.DataFrame) -> list[list[str]]:
        return [[t for b in blocks for t in b.split(" ")] for blocks in group["blocks"]]

    def cleaned(group: pd.DataFrame, marks: list[np.ndarray]) -> pd.DataFrame:
        tokens = [[b.split(" ") for b in blocks] for blocks in group["blocks"]]
        text = ["\n\n".join(unique_runs(b, list(i), m)) for b, i, m in zip(tokens, group["inside"], marks, strict=True)]
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"].astype(object), "text": text, "n_chars": [len(t) for t in text]})

    def clean(group: pd.DataFrame) -> pd.DataFrame:
        return cleaned(group, covered_tokens(streams_of(group), min_tokens, share, least_pages))

    few = dealt(sized.where("shards IS NULL")).groupBy(*key).applyInPandas(clean, result)
    if shards.isEmpty():
        return few
    many = dealt(sized.where("shards IS NOT NULL"))  # three times in one plan, whose shuffle Spark writes once

    def local(group: pd.DataFrame) -> pd.DataFrame:
        streams = streams_of(group)
        starts = common_starts(streams, min_tokens, needed_pages(len(streams), share, 1))
        runs = {" ".join(t[i : i + min_tokens]) for t, own in zip(streams, starts, strict=True) for i in np.flatnonzero(own)}
        return pd.DataFrame([(group["host"].iloc[0], run) for run in sorted(runs)], columns=["host", "run"], dtype=object)

    def count(pages: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        found = dict.fromkeys(runs["run"], 0)
        for tokens in streams_of(pages) if found else ():
            for run in found.keys() & set(runs_of(tokens, min_tokens)):
                found[run] += 1
        host = pages["host"].iloc[0] if found and len(pages) else None
        kept = [(host, run, n) for run, n in found.items() if n]
        return pd.DataFrame(kept, columns=["host", "run", "n"], dtype=object)

    def judge(pages: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        common = set(runs["run"])
        starts = [np.array([r in common for r in runs_of(t, min_tokens)] + [False] * min(len(t), min_tokens - 1), dtype=bool) for t in streams_of(pages)]
        return cleaned(pages, [covered(s, min_tokens) for s in starts])

    def everywhere(runs: DataFrame):
        """The runs of a host in each of its shards; the key has the types it has there, since cogroup does not cast."""
        sent = runs.join(shards, "host").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return sent.select("host", F.col("shard").cast("int").alias("shard"), "run").groupBy(*key)

    runs = many.groupBy(*key).applyInPandas(local, "host string, run string").distinct()
    counted = many.groupBy(*key).cogroup(everywhere(runs)).applyInPandas(count, "host string, run string, n long")
    least = F.greatest(F.lit(least_pages), F.ceil(F.lit(float(share)) * F.col("pages")))
    common = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(shards.select("host", "pages"), "host").where(F.col("n") >= least)
    return few.unionAll(many.groupBy(*key).cogroup(everywhere(common)).applyInPandas(judge, result))
