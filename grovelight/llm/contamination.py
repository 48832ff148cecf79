"""Evaluation passages inside a large corpus: size-partitioned MinHash containment search.

Items are the queries; documents of any length are searched for them in two ways, both of which name
every true pair and are followed by an exact check.

* Passages of ``run`` words (12), containment 1: a document that holds the passage holds all its
  shingles of five words, so also the one with the least hash, the passage's MinHash. The index maps
  these least shingles to items; a hit is verified by the shared run itself (exact containment).
* Whole items, containment ``share`` (2/3): items are put into partitions by size, each with its own
  window over the documents and its own threshold. An item's sketch are the first of its words in a
  MinHash order that sets rare words before common ones. Of ``n`` word positions at most
  ``n - ceil(share * n)`` may be absent from a window, so a sketch of ``m`` positions must share
  ``m - (n - ceil(share * n))`` of them with it. This is a necessary condition, not an estimate: no
  item is missed, whatever words were replaced. Verified by counts of all words, then by a longest
  common subsequence within a stretch of 1.5 times the item's length.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|sup|sub|small|big|mark|wbr|code|tt)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z!?][^<>]*>", re.S)
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
WORD = re.compile(r"[^\W_]+")
BATCH = 256  # documents looked at together


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing, entities and markup. None has none."""
    if not text:
        return []
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    return WORD.findall(text.lower())


#: Odd multipliers of the hashes.
MULTIPLY, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * MULTIPLY
        return x ^ (x >> np.uint64(29))


def shingles(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each position on, and whether all of them are known (not negative)."""
    n = max(0, len(ids) - width + 1)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(width):
            part = ids[k : k + n]
            h = h * STEP + mixed(part.astype(np.uint64) + np.uint64(1))
            ok &= part >= 0
    return mixed(h), ok


class Lists:
    """Lists of numbers by sorted key: start and length of each list in one array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        pairs = np.unique(np.stack([keys.astype(np.uint64), values.astype(np.uint64)]), axis=1) if len(keys) else np.zeros((2, 0), np.uint64)
        self.values = pairs[1].astype(np.int64)
        self.keys, self.start, self.size = np.unique(pairs[0], return_index=True, return_counts=True)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``keys`` that have a list, repeated for each value, and the values."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        at = at[hit]
        n = self.size[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), self.values[np.repeat(self.start[at], n) + inside]


@dataclass
class Part:
    """Items of similar size with the sketches of their words."""

    reach: int  # longest stretch of an item
    items: np.ndarray  # their numbers
    need: np.ndarray  # sketch positions that a window must share
    posting: Lists  # word -> place in ``items``
    weight: np.ndarray  # of each entry of the posting: how often the item has the word
    known: np.ndarray  # by word: whether any sketch has it


@dataclass
class Index:
    """Of one block of items; its size is in proportion to the block's text."""

    run: int = 12
    width: int = 5
    share: float = 2 / 3
    stretch: float = 1.5
    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    number: dict[str, int] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)

    def build(self, items: list[tuple[int, str | None]]) -> Index:
        for i, t in items:
            if w := words_of(t):
                self.ids.append(i)
                self.words.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64))
        keys, owners = [], []
        for i, w in enumerate(self.words):
            if len(w) >= self.run:
                h, _ = shingles(w, self.width)
                least = np.unique(np.lib.stride_tricks.sliding_window_view(h, self.run - self.width + 1).min(axis=1))
                keys.append(least)
                owners.append(np.full(len(least), i))
        self.least = Lists(np.concatenate(keys), np.concatenate(owners)) if keys else Lists(np.zeros(0), np.zeros(0))
        self.counts = [Counter(w.tolist()) for w in self.words]
        self.runs: dict[int, set] = {}
        held = np.zeros(len(self.number), np.int64)  # items that hold each word
        for c in self.counts:
            held[list(c)] += 1
        names = list(self.number)
        rank = np.array([xxhash.xxh64_intdigest(x) >> 8 for x in names], np.int64)  # the same order on every worker
        order = np.lexsort((rank, np.ceil(np.log2(np.maximum(held, 1)))))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            sizes[len(w).bit_length()].append(i)
        self.parts = [self._part(own, place) for _, own in sorted(sizes.items())]
        return self

    def _part(self, own: list[int], place: np.ndarray) -> Part:
        words, at, weights, need = [], [], [], []
        for k, i in enumerate(own):
            n, c = len(self.words[i]), self.counts[i]
            absent, got = n - self._least(n), 0
            for x in sorted(c, key=lambda x: place[x]):
                words.append(x)
                at.append(k)
                weights.append(c[x])
                got += c[x]
                if got >= absent + math.ceil(n / 4):
                    break
            need.append(got - absent)
        posting = Lists(np.array(words), np.array(at))
        order = np.lexsort((np.array(at), np.array(words)))  # the order of the lists
        known = np.zeros(len(place), bool)
        known[words] = True
        return Part(max(self._width(len(self.words[i])) for i in own), np.array(own), np.array(need), posting, np.array(weights)[order], known)

    def _least(self, n: int) -> int:
        return math.ceil(self.share * n - 1e-9)

    def _width(self, n: int) -> int:
        return max(1, math.floor(self.stretch * n + 1e-9))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, str]]:
        """(item, number of the text, kind) of a batch of documents."""
        get = self.number.get
        gap = [-1] * self.run
        flat: list[int] = []
        start, size = [], []
        for t in texts:
            w = words_of(t)
            start.append(len(flat))
            size.append(len(w))
            flat += [get(x, -1) for x in w]
            flat += gap
        ids, begin, size = np.array(flat, np.int64), np.array(start, np.int64), np.array(size, np.int64)
        found = self._passages(ids, begin)
        out = [(i, d, "passage") for d, i in sorted(found)]
        seen = set(found)
        for part in self.parts:
            for d, i, a, b in self._windows(part, ids, begin, size):
                if (d, i) not in seen and self._in_order(ids[a:b], i):
                    seen.add((d, i))
                    out.append((i, d, "edited"))
        return [(self.ids[i], d, kind) for i, d, kind in out]

    def _passages(self, ids: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a run of 12 words."""
        h, ok = shingles(ids, self.width)
        here = np.flatnonzero(ok)
        at, item = self.least.find(h[here])
        found: set[tuple[int, int]] = set()
        pos = here[at]
        doc = np.searchsorted(begin, pos, side="right") - 1
        for p, d, i in zip(pos.tolist(), doc.tolist(), item.tolist(), strict=True):
            if (d, i) in found:
                continue
            if i not in self.runs:
                w = self.words[i].tolist()
                self.runs[i] = {tuple(w[k : k + self.run]) for k in range(len(w) - self.run + 1)}
            near = ids[max(0, p - self.run + self.width) : p + self.run].tolist()
            if any(tuple(near[k : k + self.run]) in self.runs[i] for k in range(len(near) - self.run + 1)):
                found.add((d, i))
        return found

    def _windows(self, part: Part, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item and window (twice as long as the longest stretch, overlapping by half) that share enough of the item's sketch."""
        pos = np.flatnonzero((ids >= 0) & part.known[np.maximum(ids, 0)])
        doc = np.searchsorted(begin, pos, side="right") - 1
        k = (pos - begin[doc]) // part.reach
        per = size // part.reach + 1
        first = np.cumsum(per) - per  # number of each document's first window
        back = k > 0
        window = np.concatenate([first[doc] + k, (first[doc] + k - 1)[back]])
        vocabulary = len(part.known)
        key = np.unique(window * vocabulary + np.concatenate([ids[pos], ids[pos][back]]))
        window, word = key // vocabulary, key % vocabulary
        at = np.minimum(np.searchsorted(part.posting.keys, word.astype(np.uint64)), max(0, len(part.posting.keys) - 1))
        n = part.posting.size[at]
        entry = np.repeat(part.posting.start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(window, n) * len(part.items) + part.posting.values[entry]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        if not len(pair):
            return
        heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        shared = np.add.reduceat(part.weight[entry][order], heads)
        window, place = pair[heads] // len(part.items), pair[heads] % len(part.items)
        good = shared >= part.need[place]
        window, place = window[good], place[good]
        doc = np.searchsorted(first, window, side="right") - 1
        a = begin[doc] + (window - first[doc]) * part.reach
        b = np.minimum(a + 2 * part.reach, begin[doc] + size[doc])
        yield from zip(doc.tolist(), part.items[place].tolist(), a.tolist(), b.tolist(), strict=True)

    def _in_order(self, words: np.ndarray, i: int) -> bool:
        """Two thirds of the item's words in its order within a stretch of the words."""
        item = self.words[i].tolist()
        n = len(item)
        least, width = self._least(n), self._width(n)
        left = Counter(self.counts[i])
        at = [(p, x) for p, x in enumerate(words.tolist()) if x in left]
        there = Counter(x for _, x in at)
        if sum(min(m, there[x]) for x, m in left.items()) < least:
            return False
        bits: dict[int, int] = defaultdict(int)
        for k, x in enumerate(item):
            bits[x] |= 1 << k
        full = (1 << n) - 1

        def common(part: list[tuple[int, int]]) -> int:
            row = full
            for _, x in part:  # bit-parallel longest common subsequence; words outside the item change nothing
                u = row & bits[x]
                row = ((row + u) | (row - u)) & full
            return n - row.bit_count()

        if common(at) < least:
            return False
        shared = e = 0  # ``left``: the item's counts less those of the stretch; below 0 for words too many
        for j, (s, x) in enumerate(at):
            while e < len(at) and at[e][0] < s + width:
                shared += left[at[e][1]] > 0
                left[at[e][1]] -= 1
                e += 1
            if shared >= least and common(at[j:e]) >= least:
                return True
            left[x] += 1
            shared -= left[x] > 0
        return False


_BUILT: dict[str, Index] = {}


def index_of(token: str, items: list[tuple[int, str | None]], params: dict) -> Index:
    """The index of a block of items, built once per worker process."""
    if token not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[token] = Index(**params).build(items)
    return _BUILT[token]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The queries in blocks of bounded size, whatever their number."""
    need = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    size = need.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        yield [tuple(r) for r in need.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", block_bytes: int = 16 << 20, **params) -> DataFrame:
    """item_id, doc_id, kind ('passage' or 'edited'): every document that holds an item in whole or part.

    One scan of the documents for all items up to ``block_bytes`` of item text (16 MB, some 200,000
    items; more items, more scans), no shuffle. The block is broadcast, its index built once per
    worker process. NULL or empty texts on either side give no pair; items of fewer words than a
    passage can only be found whole; a repeated item or document gives each pair once per document
    row. Extra columns are ignored. Whole texts are read, however long.
    """
    spark = docs.sparkSession
    schema = f"{item_id} bigint, {doc_id} bigint, kind string"
    arrow = pa.schema([(item_id, pa.int64()), (doc_id, pa.int64()), ("kind", pa.string())])
    need = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text)).filter(F.col(doc_id).isNotNull() & (F.length(text) > 0))
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes):
        shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, token=token):
            index = index_of(token, shared.value, params)
            for b in batches:
                docs_, texts = b.column(0).to_pylist(), b.column(1)
                rows = [(i, docs_[k + d], kind) for k in range(0, len(docs_), BATCH) for i, d, kind in index.search(texts.slice(k, BATCH).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        part = need.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def leak_report(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """suite, held_split, source, n_items, n_docs: distinct items and documents with a leak."""
    d = docs.select("doc_id", "source")
    return found.join(d, "doc_id").join(items.select("item_id", "suite", "held_split"), "item_id").groupBy("suite", "held_split", "source").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))
