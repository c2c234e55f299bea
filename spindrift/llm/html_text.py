"""Main text of web pages with a suffix array over each host's pages.

A page is cut into blocks, each in a zone: the article, chrome by its element or class names (menus, footers,
adverts, forms, comments), a content box (``main`` or by class name), or none of these.  The word streams of a host's
pages are sorted in one suffix array, through ``DEPTH`` words; strings of that many words that occur on distinct pages
(pages of different words) are boilerplate and go, inside the marked zone too: the article, else the content box, else
the other blocks.  Unique runs outside the marked zone stay, chrome excepted.  A marked zone that is mostly repeated is
a copy of an article and stays whole.

Hosts are dealt in shards of bounded size, so that one host with a third of all pages fills many tasks.  A shard's
array finds what repeats inside the shard; what repeats only between shards of a host is found in two rounds.  Every
string of ``DEPTH`` words has an anchor, the smallest hash of its strings of ``ANCHOR`` words: equal strings have equal
anchors, so only strings whose anchor is in several shards can repeat between them.  These are then compared by 64-bit
hashes of string and page over the whole host, and each shard is told which of its strings repeat.
"""

from __future__ import annotations

import html as entities
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

DEPTH = 8
ANCHOR = 4
#: Bits of an anchor that are compared; chance matches only let more strings into the second round.
ANCHOR_BITS = 40
SHARD_BYTES = 1 << 20
#: A host's hashes are compared in one group for each so many of its shards.
GROUP_SHARDS = 32
#: Hosts of more than one shard are broadcast up to this many (some 50 bytes each), joined beyond.
BROADCAST_HOSTS = 100_000
CHROME, OTHER, BODY, ARTICLE = 0, 1, 2, 3

#: Fixed values of HTML: elements whose content is not text, void elements, and those that begin or end a block.
RAW = frozenset("script style noscript template textarea svg iframe math canvas object audio video head title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first ends an open element of the second inside the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_PARAGRAPH = BLOCK - {"button", "caption", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "select"}
CHROME_ELEMENTS = frozenset("nav footer aside form menu dialog button select fieldset search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb"
    " breadcrumbs comment comments commentlist disqus respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login"
    " share sharing social related recommended footer topbar masthead widget widgets pager pagination toolbar skip".split()
)
ARTICLE_WORDS = frozenset("articlebody".split())
#: Whole class and id names of content boxes, and of page headers outside one.
BODY_NAMES = frozenset("article article-body article-content article-text content main-content page-content post post-body post-content entry entry-content story story-body text-body".split())
HEADER_NAMES = frozenset("header site-header page-header top-header topheader".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/][^<>]*(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _zone(name: str, attributes: str, zone: int) -> int:
    """The zone of an element's content, from its parent's."""
    if zone == CHROME or name in CHROME_ELEMENTS or (name == "header" and zone < BODY):
        return CHROME
    if name == "article":
        zone = ARTICLE
    elif name == "main":
        zone = max(zone, BODY)
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower().strip()
            if key == "role" and value in CHROME_ROLES or key == "hidden" or (key == "aria-hidden" and value == "true"):
                return CHROME
            if key == "itemprop" and value in ARTICLE_WORDS:
                zone = ARTICLE
            elif key == "role" and value in ("main", "article"):
                zone = max(zone, BODY if value == "main" else ARTICLE)
            elif key in ("class", "id") and name not in ("html", "body"):
                words, names = set(_WORDS.findall(value)), set(value.split())
                if name in ("article", "main"):
                    if not words.isdisjoint(("comment", "comments", "ad", "related", "sponsored")):
                        return CHROME
                elif not words.isdisjoint(CHROME_WORDS) or (zone < BODY and not names.isdisjoint(HEADER_NAMES)):
                    return CHROME
                elif not names.isdisjoint(BODY_NAMES):
                    zone = max(zone, BODY)
    return zone


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of the page's blocks in order: references decoded, white space as single spaces."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = [("", OTHER)]

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, stack[-1][1]))

    def pop_to(k: int) -> None:
        while len(stack) > k:
            if stack[-1][0] in BLOCK or stack[-1][1] != stack[-2][1]:
                close_block()
            stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("body", "html", "main", "article"):
                    break
            else:
                if name in BLOCK:
                    close_block()
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                done = _CLOSE[name].search(page, at)
                if name != "head" and name != "title":
                    at = done.end() if done else end
                elif done:
                    at = done.end()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in ("body", "html"):
            close_block()
            continue
        if name in VOID:
            if name == "hr":
                close_block()
            continue
        if name in NO_PARAGRAPH or name in ENDS:
            endable = ENDS.get(name, set()) | ({"p"} if name in NO_PARAGRAPH else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in endable:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK and not (name in ENDS and stack[k][0] == "p"):
                    break
        zone = _zone(name, m[3], stack[-1][1])
        if name in BLOCK or zone != stack[-1][1]:
            close_block()
        stack.append((name, zone))
    pop_to(1)
    close_block()
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip(), re.I)
    return found[1].lower() if found else ""


_PACKED = "host string, shard long, shards long, pages binary, size long"
#: Numbers of one shard for one group of the host's hashes, and the other way.
_SENT = "host string, part long, shard long, n long, numbers binary, size long"


def _pack(rows: list) -> tuple[bytes, int]:
    raw = json.dumps(rows, ensure_ascii=False).encode("utf-8", "surrogatepass")
    return pa.Codec("zstd").compress(raw, asbytes=True), len(raw)


def _unpack(data: bytes, size: int) -> list:
    return json.loads(pa.Codec("zstd").decompress(data, size, asbytes=True).decode("utf-8", "surrogatepass"))


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the pages of each shard, packed: what is shuffled is compressed text without markup."""
    for batch in c.chunks(batches, "html", 16 << 20):
        dealt: dict[tuple[str, int, int], list] = {}
        for page_id, url, host, shard, shards, html in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "host", "shard", "shards", "html"))):
            dealt.setdefault((host, shard, shards), []).append([page_id, url, blocks(html or "")])
        packed = [(*key, *_pack(rows)) for key, rows in dealt.items()]
        columns = list(zip(*packed))
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["host", "shard", "shards", "pages", "size"])


def repeated_windows(codes: np.ndarray, page: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place of the joined streams whether the ``depth`` words from it also occur on another page.

    ``codes`` are word numbers; each page's stream is closed by a -1.  The suffix array is sorted by prefix doubling,
    only through ``depth`` words (a power of two); suffixes equal so far form a group.
    """
    n = len(codes)
    breaks = codes < 0
    rank = codes + 1 + int(breaks.sum())
    rank[breaks] = np.arange(int(breaks.sum()))
    step = 1
    while True:
        order = np.argsort(rank, kind="stable")
        value = rank[order]
        new = np.append(True, value[1:] != value[:-1])
        if step >= depth:
            break
        dense = np.empty(n, dtype=np.int64)
        dense[order] = np.cumsum(new)
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = dense[step:]
        rank = dense * (n + 2) + follow
        step *= 2
    first = np.flatnonzero(new)
    pages = page[order]
    several = np.maximum.reduceat(pages, first) != np.minimum.reduceat(pages, first)
    size = np.diff(np.append(first, n))
    out = np.empty(n, dtype=bool)
    out[order] = np.repeat(several & (size > 1), size)
    return out


class Streams:
    """The joined word streams of a shard's pages: ``codes`` and ``page`` as :func:`repeated_windows` takes them."""

    def __init__(self, table: pa.Table) -> None:
        self.rows = [row for data, size in zip(table.column("pages").to_pylist(), table.column("size").to_pylist()) for row in _unpack(data, size)]
        vocabulary: defaultdict[str, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        codes, numbers, sizes = array("q"), [], []
        known: dict[str, int] = {}
        for _, _, own in self.rows:
            joined = " ".join([text for text, _ in own])
            stream = [*map(vocabulary.__getitem__, joined.split())]
            numbers.append(known.setdefault(joined, len(known)))  # copies of a page are one page
            sizes.append(len(stream) + 1)
            codes.extend(stream)
            codes.append(-1)
        self.codes, self.page = np.array(codes, dtype=np.int64), np.repeat(np.array(numbers, dtype=np.int64), sizes)
        self.words, self.known = list(vocabulary), list(known)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a string of DEPTH words begins, and the strings' hashes and anchors."""
        value = np.array([_hash(w) for w in self.words] + [0], dtype=np.uint64)[self.codes]
        breaks = np.append(0, np.cumsum(self.codes < 0))
        at = np.flatnonzero(breaks[DEPTH:] == breaks[:-DEPTH])
        if not len(at):
            return at, at.astype(np.uint64), at.astype(np.uint64)
        short = _mixed(_rolled(value, ANCHOR)) >> np.uint64(64 - ANCHOR_BITS)
        n = len(value) - DEPTH + 1
        anchors = np.minimum.reduce([short[k : k + n] for k in range(DEPTH - ANCHOR + 1)])
        return at, _mixed(_rolled(value, DEPTH))[at], anchors[at]

    def page_hashes(self) -> np.ndarray:
        """By page number."""
        return np.array([_hash(text) for text in self.known], dtype=np.uint64)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _rolled(value: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(value) - length + 1, dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + value[k : k + len(out)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _squeeze(*numbers: np.ndarray) -> tuple[bytes, int]:
    """Compressed bytes of numbers below 2**64; the first array ascends and is kept as steps."""
    first, *others = numbers
    raw = b"".join(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(first, prepend=np.uint64(0)), *others))
    return pa.Codec("zstd").compress(raw, asbytes=True), len(raw)


def _expand(data: bytes, size: int, n: int) -> list[np.ndarray]:
    """What :func:`_squeeze` took: arrays of ``n`` numbers each, the last one of any length."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), dtype=np.uint8)
    ends = [*range(8 * n, min(16 * n, len(raw)) + 1, 8 * n)] if n else []
    parts = [x.reshape(8, -1).T.copy().view(np.uint64).ravel() for x in np.split(raw, ends) if len(x)]
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:]]


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 6
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.table([pa.array(x, t) for x, t in zip(columns, types)], ["host", "part", "shard", "n", "numbers", "size"])


def _received(table: pa.Table) -> Iterator[tuple[int, list[np.ndarray]]]:
    for shard, n, data, size in zip(*(table.column(x).to_pylist() for x in ("shard", "n", "numbers", "size"))):
        yield shard, _expand(data, size, n)


def _key(table: pa.Table) -> tuple[str, int, int]:
    """Host, shard, and how many groups the host's hashes are dealt to; 0 for a host of one shard."""
    host, shard, shards = (table.column(x)[0].as_py() for x in ("host", "shard", "shards"))
    return host, shard, -(-shards // GROUP_SHARDS) if shards > 1 else 0


def _told(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.uint64), *(numbers[0] for _, numbers in _received(table))])


def _anchors(table: pa.Table) -> pa.Table:
    """The anchors of a shard of a large host."""
    host, shard, parts = _key(table)
    if not parts:
        return _sent([])
    anchors = np.unique(Streams(table).hashes()[2])
    part = anchors % np.uint64(parts)
    own = [(k, anchors[part == k]) for k in np.unique(part).tolist()]
    return _sent([(host, k, shard, len(x), *_squeeze(x)) for k, x in own])


def _shared_anchors(table: pa.Table) -> pa.Table:
    """To each shard its anchors that other shards have too."""
    host, part = table.column("host")[0].as_py(), table.column("part")[0].as_py()
    sent = [(shard, numbers[0]) for shard, numbers in _received(table)]
    values, shards = np.unique(np.concatenate([x for _, x in sent]), return_counts=True)
    several = values[shards > 1]
    found = [(shard, x[np.isin(x, several)]) for shard, x in sent]
    return _sent([(host, part, shard, len(x), *_squeeze(x)) for shard, x in found if len(x)])


def _windows(table: pa.Table, told: pa.Table) -> pa.Table:
    """The strings of a shard that other shards may have: hash, and page number + 1 or 0 for several pages; then the pages' hashes."""
    if not table.num_rows or not told.num_rows:
        return _sent([])
    host, shard, parts = _key(table)
    streams = Streams(table)
    at, window, anchor = streams.hashes()
    some = np.isin(anchor, _told(told))
    page = streams.page[at[some]]
    values, first, place = np.unique(window[some], return_index=True, return_inverse=True)
    several = np.zeros(len(values), dtype=bool)
    several[place[page != page[first][place]]] = True
    page, names = page[first], streams.page_hashes()
    part, rows = values % np.uint64(parts), []
    for k in np.unique(part).tolist():
        own = part == k
        used, number = np.unique(page[own], return_inverse=True)
        rows.append((host, k, shard, int(own.sum()), *_squeeze(values[own], np.where(several[own], 0, number + 1), names[used])))
    return _sent(rows)


def _shared_windows(table: pa.Table) -> pa.Table:
    """To each shard its strings of one page that are also on another page of the host."""
    host, part = table.column("host")[0].as_py(), table.column("part")[0].as_py()
    sent = [(shard, values, number, names[np.maximum(number, 1) - np.uint64(1)]) for shard, (values, number, names) in _received(table)]
    values, place = np.unique(np.concatenate([x[1] for x in sent]), return_inverse=True)
    number, page = np.concatenate([x[2] for x in sent]), np.concatenate([x[3] for x in sent])
    some = np.zeros(len(values), dtype=np.uint64)
    some[place] = page
    several = np.zeros(len(values), dtype=bool)
    several[place[(number == 0) | (page != some[place])]] = True
    found = [(shard, x[(number > 0) & np.isin(x, values[several])]) for shard, x, number, _ in sent]
    return _sent([(host, part, shard, len(x), *_squeeze(x)) for shard, x in found if len(x)])


def _runs(*values: np.ndarray) -> np.ndarray:
    """For each word the length of the run of equal values that it is in."""
    new = np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in values]))
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def _kept(own: list[list], repeated: np.ndarray) -> np.ndarray:
    """Which words of a page are its text.

    A repeated run goes where it has DEPTH words inside its block or is the whole block; a shorter one is the end of a
    string that reaches over from the next block.  A marked zone that such runs cover by half is a copy and stays.
    Outside the marked zone a run stays where it has DEPTH unique words, over blocks of one zone, and is not chrome.
    """
    counts = np.array([text.count(" ") + 1 for text, _ in own])
    zones = np.repeat([zone for _, zone in own], counts)
    top = zones.max()
    length = _runs(repeated, np.repeat(np.arange(len(own)), counts))
    cut = repeated & ((length >= DEPTH) | (length == np.repeat(counts, counts)))
    marked = zones == top
    if top > OTHER and 2 * np.count_nonzero(cut & marked) >= np.count_nonzero(marked):
        cut = cut & ~marked
    return (zones > CHROME) & ~cut & (marked | (~repeated & (_runs(repeated, zones) >= DEPTH)))


def _judged(table: pa.Table, told: pa.Table) -> pa.Table:
    streams = Streams(table)
    rows = streams.rows
    pages = [own for _, _, own in rows]
    begins = repeated_windows(streams.codes, streams.page)
    if told.num_rows:
        at, window, _ = streams.hashes()
        begins[at[np.isin(window, _told(told))]] = True
    reach = np.maximum.accumulate(np.where(begins, np.arange(len(begins)) + DEPTH, 0))
    covered = np.arange(len(begins)) < reach
    texts, boiler, at = [], [], 0
    for own in pages:
        n = sum(text.count(" ") + 1 for text, _ in own)
        repeated, kept, place = covered[at : at + n], [], 0
        keep = _kept(own, repeated) if own else repeated
        flags = keep.tolist()
        for text, _ in own:
            size = text.count(" ") + 1
            these = flags[place : place + size]
            place += size
            if all(these):
                kept.append(text)
            elif any(these):
                kept.append(" ".join(compress(text.split(" "), these)))
        at += n + 1
        texts.append("\n".join(kept))
        boiler.append(int((repeated & ~keep).sum()))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(boiler, pa.int64())], ["page_id", "url", "text", "n_chars", "n_boilerplate"])


def extract_main_text(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of every page.

    A null or empty html gives an empty text; a null url counts to a nameless host; repeated rows and null ids stay.
    n_boilerplate: removed words that also occur, in a string of DEPTH words, on another page of the host.
    A host's pages are dealt by a hash over ceil(bytes / shard_bytes) shards; the result does not depend on their size.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.trim("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    sizes = own.groupBy("host").agg(F.ceil(F.sum(F.octet_length(F.coalesce("html", F.lit("")))) / shard_bytes).cast("int").alias("shards"))
    sizes = c.materialise(sizes.filter("shards > 1"), "large-hosts")
    small = sizes.count() <= BROADCAST_HOSTS
    shards = F.coalesce("shards", F.lit(1)).cast("long")
    dealt = own.join(F.broadcast(sizes) if small else sizes, "host", "left").withColumns({"shard": F.pmod(F.xxhash64("page_id", "url"), shards), "shards": shards})
    packed = dealt.select("page_id", "url", "host", "shard", "shards", "html").mapInArrow(_parsed, _PACKED)
    shard = packed.groupBy("host", "shard")  # one exchange serves the three passes over it
    anchors = shard.applyInArrow(_anchors, _SENT).groupBy("host", "part").applyInArrow(_shared_anchors, _SENT)
    windows = shard.cogroup(anchors.groupBy("host", "shard")).applyInArrow(_windows, _SENT).groupBy("host", "part").applyInArrow(_shared_windows, _SENT)
    return shard.cogroup(windows.groupBy("host", "shard")).applyInArrow(_judged, "page_id long, url string, text string, n_chars long, n_boilerplate long")
