"""Main text of web pages with a suffix array for each host (operator 10).

A page's markup is read into blocks of text.  Blocks inside the page's article
(``article`` or ``main``, without what is marked as a menu, advert, form,
comment and so on) are its text.  Every other block is a candidate: those
marked as boilerplate, and those that the markup says nothing about, which
decide pages without an article.

The candidates' words of all pages of a host are laid end to end, with a
separator after each page, and sorted by prefix doubling into the suffix array
of depth ``run`` words.  Equal neighbours from different pages are a long
substring that the pages share; the blocks it covers are boilerplate, and
unique runs stay.  A host of more than ``host_words`` candidate words is dealt
by page into shards of that size, each with its own array; the ``run`` words
that begin a suffix are then also counted by their 128-bit hash over the whole
host, and those found in two shards are given back to them.  So a host has the
same long substrings however it is dealt.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import redealt
from .util import slices, stage, stage_observed

RUN = 4
HOST_WORDS = 300_000
MIXER = np.uint64(0x9E3779B97F4A7C15)

# Elements by their meaning.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template head title svg math iframe object embed audio video canvas map select textarea button datalist".split())
MARKED = frozenset("nav footer header aside form menu dialog".split())
ARTICLES = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe"])
#: An end tag of these closes what an unclosed inner element left open.
BOUNDS = frozenset("article main nav footer header aside form div section table ul ol menu body html dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Class and id tokens that mark boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies disqus toolbar pagination pager skip-link widget copyright legal".split()
)
#: Parts that make a compound token tell of a page's state, such as no-sidebar or menu-open.
STATES = frozenset("no not non has have with without is open opened closed ok on off enabled disabled".split())
#: Names that also stand for what an article tells about.
TOLD = frozenset(["legal"])
#: Elements that hold the whole page: their class tells nothing about a part of it.
PAGES = frozenset(["html", "body", "main"])
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"[\s ]+")
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

CONTENT, OPEN, BOILERPLATE = range(3)


def named(value: str, in_article: bool) -> bool:
    """Whether a token of a class or id names boilerplate; outside articles a part of a compound token is enough."""
    for token in value.lower().split():
        if token in NAMES and not (in_article and token in TOLD):
            return True
        parts = re.split("[-_]+", token)
        if not in_article and not NAMES.isdisjoint(parts) and STATES.isdisjoint(parts):
            return True
    return False


def marked(tag: str, attributes: str, in_article: bool = False) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its kind, role or state; and by its class or id."""
    surely, by_name = tag in MARKED, False
    if attributes.strip():
        for name, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name in ("class", "id"):
                by_name |= tag not in PAGES and named(value, in_article)
            elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
                surely = True
        surely |= bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes)) and "overflow" not in attributes
    return surely, by_name


def blocks(page: str) -> list[tuple[int, str]]:
    """(CONTENT, OPEN or BOILERPLATE, text) of every block with text, in page order.

    OPEN blocks are inside no article and bear no mark.  Unclosed elements and
    pages that end in the middle of a tag are read as far as they go.  If the
    only articles are inside elements with a telling class, and hold more words
    than what bears no mark, those elements are taken for wrappers of the page.
    """
    found, wrappers = _blocks(page, frozenset())
    if wrappers and not any(kind == CONTENT for kind, _ in found):
        again, _ = _blocks(page, wrappers)
        words = [sum(t.count(" ") + 1 for kind, t in some if kind == wanted) for some, wanted in ((found, OPEN), (again, CONTENT))]
        if words[1] > words[0]:
            return again
    return found


def _blocks(page: str, unmarked: frozenset[int]) -> tuple[list[tuple[int, str]], frozenset[int]]:
    """Blocks by the marks of all elements but ``unmarked`` (by number); and the elements whose class alone hides an article."""
    stack: list[tuple[str, int, int]] = []  # element, state inside it, number if its class alone marks it
    found: list[tuple[int, str]] = []
    wrappers: set[int] = set()
    parts: list[str] = []
    state, at, number = OPEN, 0, 0
    SKIP = 3

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text and state != SKIP:
            found.append((state, text))

    for match in TOKEN.finditer(page):
        if match.start() < at:
            continue
        parts.append(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag in SILENT:
            close()
        if match[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in BOUNDS and tag not in BOUNDS:
                    break
            state = stack[-1][1] if stack else OPEN
        elif tag not in VOID and not match[3].endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                state = stack[-1][1] if stack else OPEN
            number += 1
            by_class = 0
            if tag in SILENT:
                state = SKIP
            elif state != SKIP:
                in_article = any(s == CONTENT for _, s, _ in stack)
                surely, by_name = marked(tag, match[3], in_article)
                if tag == "header" and in_article:
                    surely = False
                by_name &= number not in unmarked
                if tag in ARTICLES and state == BOILERPLATE and not surely and not by_name:
                    wrappers.update(n for _, _, n in stack if n)
                if surely or by_name:
                    by_class = number if not surely else 0
                    state = BOILERPLATE
                elif tag in ARTICLES and state == OPEN:
                    state = CONTENT
            stack.append((tag, state, by_class))
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
                parts.clear()
    parts.append(page[at:])
    close()
    return found, frozenset(wrappers)


def host_of(url: str | None) -> str:
    match = HOST.match(url or "")
    return match[1].lower() if match else ""


STAGED = "row_number long, page_id long, url string, host string, text string, candidates array<struct<place: int, kind: int, text: string>>, n_words long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page: the article's text, and the candidates."""
    row = TaskContext.get().partitionId() << 34
    candidate = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.int32()), ("text", pa.string())]))
    for batch in slices(batches, 64):
        rows, ids, urls = [], batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        for page_id, url, page in zip(ids, urls, batch.column("html").to_pylist(), strict=True):
            found = blocks(page or "")
            text = "\n".join(t for kind, t in found if kind == CONTENT)
            others = [{"place": i, "kind": kind, "text": t} for i, (kind, t) in enumerate(found) if kind != CONTENT]
            has_article = len(others) < len(found)
            if not has_article and not any(c["kind"] == OPEN for c in others):
                has_article = True  # nothing is left to decide
            rows.append((row, page_id, url, host_of(url), text if has_article else None, others, sum(c["text"].count(" ") + 1 for c in others)))
            row += 1
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), candidate, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["row_number", "page_id", "url", "host", "text", "candidates", "n_words"])


def shared_starts(words: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """At which words a substring of ``run`` words starts that two pages share.

    ``words``: a number for each word, equal words having equal numbers;
    separators are negative and all different.  Doubling ranks the suffixes
    by their first 1, 2, 4, ... words.
    """
    n = len(words)
    if n < run:
        return np.zeros(n, bool)
    rank, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        nexts = np.full(n, -1, np.int64)
        nexts[:-step] = rank[step:]
        rank = np.unique(rank * (n + 1) + nexts + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    suffixes = np.argsort(rank, kind="stable")
    ranks, pages = rank[suffixes], page[suffixes]
    starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    lowest, highest = np.minimum.reduceat(pages, starts), np.maximum.reduceat(pages, starts)
    shared = np.zeros(n, bool)
    shared[suffixes] = np.repeat(lowest != highest, np.diff(np.r_[starts, n]))
    return shared


def covered_by(starts: np.ndarray, run: int) -> np.ndarray:
    """Which words lie in a run from one of the starts."""
    steps = np.zeros(len(starts) + run + 1, np.int64)
    at = np.flatnonzero(starts)
    steps[at] += 1
    steps[at + run] -= 1
    return np.cumsum(steps)[: len(starts)] > 0


def word_lanes(words: Iterable[str]) -> np.ndarray:
    """128-bit hashes of words, as two numbers each."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words), "<u8").reshape(-1, 2)


def run_hashes(words: np.ndarray, lanes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``run`` words without a separator start, and a 128-bit hash of each (two longs)."""
    n = max(0, len(words) - run + 1)
    before = np.r_[0, np.cumsum(words < 0)]
    starts = np.flatnonzero(before[run : run + n] == before[:n])
    h = np.zeros((len(starts), 2), np.uint64)
    for i in range(run):
        h = (h ^ lanes[words[starts + i]]) * MIXER
        h ^= h >> np.uint64(29)
    return starts, h.view(np.int64)


def _runs(run: int):
    """host, shard, a, b: the hashed runs of the pages of shards, once for some pages."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            words, owner, numbers = [], [], {}
            keys = list(zip(batch.column("host").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            for i, candidates in enumerate(batch.column("candidates").to_pylist()):
                at = len(words)
                words += [numbers.setdefault(w, len(numbers)) for c in candidates for w in c["text"].split()]
                words.append(-1)
                owner += [i] * (len(words) - at)
            starts, h = run_hashes(np.array(words, np.int64), word_lanes(numbers), run)
            found = list({(*keys[owner[s]], a, b) for s, (a, b) in zip(starts.tolist(), h.tolist(), strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string() if i == 0 else pa.int64()) for i in range(4)], ["host", "shard", "a", "b"])

    return hashes


def _shard(run: int):
    """The open blocks of one shard, and whether shared substrings cover them; ``known`` has runs that other shards share."""

    def solve(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        rows = sorted(table.select(["row_number", "candidates"]).to_pylist(), key=lambda r: r["row_number"])
        words, page, block, blocks_ = [], [], [], []
        numbers: dict[str, int] = {}
        for i, r in enumerate(rows):
            for c in r["candidates"]:
                own = [numbers.setdefault(w, len(numbers)) for w in c["text"].split()]
                words += own
                page += [i] * len(own)
                block += [len(blocks_)] * len(own)
                blocks_.append((r["row_number"], c["place"], c["kind"], c["text"]))
            words.append(-1 - i)  # a separator that equals nothing else
            page.append(i)
            block.append(-1)
        words, block = np.array(words, np.int64), np.array(block, np.int64)
        starts = shared_starts(words, np.array(page, np.int64), run)
        if known is not None and known.num_rows:
            elsewhere = set(zip(known.column("a").to_pylist(), known.column("b").to_pylist(), strict=True))
            at, h = run_hashes(words, word_lanes(numbers), run)
            starts[at] |= np.fromiter(((a, b) in elsewhere for a, b in h.tolist()), bool, len(at))
        inside = block >= 0
        size = np.bincount(block[inside], minlength=len(blocks_))
        # A block of a run's length or more is judged by runs inside it; shorter
        # ones, like the entries of a menu, by runs over their neighbours too.
        own = starts.copy()
        own[len(own) - run + 1 :] = False
        own[: len(own) - run + 1] &= block[: len(block) - run + 1] == block[run - 1 :]
        wide, narrow = covered_by(starts, run), covered_by(own, run)
        covered = np.where(size[np.maximum(block, 0)] >= run, narrow, wide) if len(blocks_) else wide
        share = np.bincount(block[inside], covered[inside], len(blocks_)) / np.maximum(size, 1)
        judged = [(*b[:2], b[3], bool(s >= 0.5)) for b, s in zip(blocks_, share, strict=True) if b[2] == OPEN]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        return pa.table({name: pa.array([j[i] for j in judged], kind) for i, (name, kind) in enumerate(zip(("row_number", "place", "text", "covered"), kinds))})

    return solve


def host_blocks(read: DataFrame, run: int = RUN, host_words: int = HOST_WORDS) -> DataFrame:
    """row_number, place, text, covered of every open block of staged pages."""
    sizes = read.groupBy("host").agg(F.sum("n_words").alias("w"))
    shards = sizes.select(F.xxhash64("host").alias("h"), F.col("host").alias("own"), F.greatest(F.lit(1), F.ceil(F.col("w") / host_words)).alias("shards"))
    shards, seen = stage_observed(shards, "hosts", most=F.max("shards"))
    dealt = read.where("n_words > 0").select("host", F.xxhash64("host").alias("key"), "row_number", "candidates")
    dealt = dealt.join(shards, (redealt(F.col("key")) == F.col("h")) & (F.col("host") == F.col("own")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("row_number"), F.col("shards")))
    pages, solve, result = dealt.select("host", "shard", "row_number", "candidates").groupBy("host", "shard"), _shard(run), "row_number long, place int, text string, covered boolean"
    if (seen["most"] or 1) == 1:
        return stage(pages.applyInArrow(lambda table: solve(table), result), "host-blocks")
    runs = dealt.where("shards > 1").select("host", "shard", "candidates").mapInArrow(_runs(run), "host string, shard long, a long, b long")
    # Each run of a host with the shards that hold it: at most one number for ``host_words`` words.
    both = runs.groupBy("host", "a", "b").agg(F.collect_set("shard").alias("in")).where("size(in) > 1")
    both = both.select("host", F.explode("in").alias("shard"), "a", "b")
    return stage(pages.cogroup(both.groupBy("host", "shard")).applyInArrow(solve, result), "host-blocks")


def extract(pages: DataFrame, run: int = RUN, host_words: int = HOST_WORDS) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks are joined by a line feed; white space inside a block is one space;
    character references are decoded.  Null or empty html, or a page without
    text, gives an empty text.  Very long pages are read whole; an empty table
    gives an empty table; a null page_id stays null.  A null url is a host of its own.  Repeated rows
    each give a row, and count as distinct pages.  A page without an article
    all of whose blocks are covered is a copy of another and keeps them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = stage(rows.mapInArrow(_read, STAGED), "pages")
    judged = host_blocks(read, run, host_words)
    kept = F.array_sort(F.collect_list(F.struct("place", "text", "covered")))
    unique = judged.groupBy("row_number").agg(kept.alias("b"))
    chosen = F.when(F.exists("b", lambda x: ~x["covered"]), F.filter("b", lambda x: ~x["covered"])).otherwise(F.col("b"))
    unique = unique.select(F.col("row_number").alias("n"), F.array_join(F.transform(chosen, lambda x: x["text"]), "\n").alias("own"))
    decided = read.where("text is not null").select("page_id", "url", "text")
    rest = read.where("text is null").join(unique, F.col("row_number") == F.col("n"), "left")
    return decided.unionByName(rest.select("page_id", "url", F.coalesce("own", F.lit("")).alias("text")))
