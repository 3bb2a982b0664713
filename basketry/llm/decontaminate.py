"""Benchmark decontamination with suffix arrays over shards of the training text.

Every batch of documents is a shard; one of very many words is cut into several that overlap.  A
shard's words are one sequence, and its suffix array is sorted by word.  Every suffix of every
benchmark item is looked up in each shard by binary search, which gives all places of its window.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from basketry.llm import blocks

#: A window: this many item words in a row; a shorter item is one window.
WINDOW = 10
#: Items are searched in blocks of so many words; each block is one pass over the documents.
BLOCK_WORDS = 1 << 20
#: Most words of one suffix array; batches of usual prose have fewer.
SHARD_WORDS = 1 << 20


@dataclass
class Items:
    """A block of benchmark items as word hashes."""

    ids: list[str]
    words: np.ndarray
    first: np.ndarray

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Item and length of the suffix at each word."""
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        return item, self.first[item + 1] - np.arange(len(self.words))


def item_blocks(items: DataFrame, text: str, item_id: str, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks, each bounded by its words; the driver holds one block at a time."""
    ids, parts, held = [], [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        data, offsets = blocks.text_bytes(pa.array([row["t"]], pa.string()))
        found = blocks.words(data, offsets, blocks.ALPHANUMERIC).hashes
        if not len(found) or row["i"] is None:
            continue
        if held and held + len(found) > block_words:
            yield Items(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            ids, parts, held = [], [], 0
        ids.append(row["i"])
        parts.append(found)
        held += len(found)
    if held:
        yield Items(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


class SuffixArray:
    """Suffixes of a shard in word order, resolved to ``depth`` words.

    Words become ranks; a key packs three ranks (two from 2 ** 21 words on), so each round triples
    the depth to which the order holds, and only suffixes that are still tied are sorted again.
    Rank 0 ends a document.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int):
        n_docs = len(first) - 1
        n = len(hashes) + n_docs
        ends = first[1:] + np.arange(n_docs)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.vocabulary = ranked[new]
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.cumsum(new)
        self.seq = np.zeros(n, np.int64)
        self.seq[is_word] = rank
        self.place = np.flatnonzero(is_word)  # sequence position of each word
        self.word = np.cumsum(is_word) - 1  # word number at each sequence position
        self.n = n
        self.sa = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        bits = max(1, int(self.n + 1).bit_length())
        packed = 3 if 3 * bits <= 63 else 2  # Arrow's limit for one text is under 2 ** 31 words
        n, step, rank = self.n, 1, self.seq
        sa = np.arange(n)
        group = np.zeros(n, np.int64)  # first place of the tie that each place lies in
        loose = np.arange(n)  # places that are still tied
        while len(loose) and (step == 1 or step < depth):
            at = sa[loose]
            key = np.zeros(len(at), np.int64)
            for i in range(packed):
                there = at + i * step
                key = (key << bits) | np.where(there < n, rank[np.minimum(there, n - 1)], 0)
            if len(loose) == n:
                inner = np.argsort(key)
            else:
                inner = np.lexsort((key, group[loose]))
            sa[loose] = at[inner]
            key, held = key[inner], group[loose]
            new = np.ones(len(loose), bool)
            new[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1])
            head = loose[np.flatnonzero(new)][np.cumsum(new) - 1]
            group[loose] = head
            rank = np.empty(n, np.int64)
            rank[sa] = group + 1
            size = np.diff(np.append(np.flatnonzero(new), len(loose)))
            loose = loose[np.repeat(size > 1, size)]
            step *= packed
        return sa

    def search(self, query: np.ndarray, start: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Binary search of the query's suffixes at ``start``, one more word of each at a time.

        Yields (depth, suffixes, low, high): those whose first ``depth`` words occur, and the
        places of the suffix array where they do.
        """
        at = np.searchsorted(self.vocabulary, query)
        found = at < len(self.vocabulary)
        found[found] = self.vocabulary[at[found]] == query[found]
        wanted = np.where(found, at + 1, -1)
        live = np.arange(len(start))
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        depth = 0
        while len(live):
            goal = wanted[start[live] + depth]
            keep = goal > 0
            live, low, high, goal = live[keep], low[keep], high[keep], goal[keep]
            low, high = self._bound(low, high, goal, depth, False), self._bound(low, high, goal, depth, True)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            depth += 1
            yield depth, live, low, high
            keep = most[live] > depth
            live, low, high = live[keep], low[keep], high[keep]

    def _bound(self, low: np.ndarray, high: np.ndarray, goal: np.ndarray, depth: int, above: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            there = np.minimum(self.sa[mid] + depth, self.n - 1)
            less = self.seq[there] <= goal[open_] if above else self.seq[there] < goal[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all intervals, and the interval each belongs to."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def _words(batch: pa.RecordBatch, text: str) -> blocks.Words:
    return blocks.words(*blocks.text_bytes(batch.column(batch.schema.get_field_index(text))), blocks.ALPHANUMERIC)


def _shards(found: blocks.Words, depth: int) -> Iterator[tuple[int, SuffixArray]]:
    """Suffix arrays over the batch, each with the number of its first word.

    Neighbours share ``depth`` - 1 words, so every ``depth`` words in a row lie whole in one of them.
    """
    n, shared = len(found.hashes), max(depth - 1, 0)
    size = max(SHARD_WORDS, 2 * shared)
    for at in range(0, max(n - shared, 1), size - shared):
        stop = min(at + size, n)
        yield at, SuffixArray(found.hashes[at:stop], np.clip(found.first, at, stop) - at, depth)


def _windows(items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and item of every window."""
    item, left = items.suffixes()
    length = np.diff(items.first)[item]
    whole = np.minimum(length, window)
    start = np.flatnonzero(left >= whole)
    return start, whole[start], item[start]


OUTCOME = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_OUTCOME_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


#: Pairs of documents and items that are put together at a time.
PAIRS = 1 << 20


def _with_items(known: np.ndarray, in_docs: np.ndarray, n_docs: int, of_items: np.ndarray, n_items: int) -> np.ndarray:
    """``known`` (document, item) pairs and those that share a window, each once and in order.

    ``in_docs`` holds (window, document) and ``of_items`` (window, item), sorted.  The pairs of many windows are made in pieces, so
    memory follows the distinct pairs and not how often each is found.
    """
    window = in_docs // n_docs
    low, high = np.searchsorted(of_items, window * n_items), np.searchsorted(of_items, (window + 1) * n_items)
    upto, at = np.cumsum(high - low), 0
    while at < len(in_docs):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        place, which = _expand(low[at:stop], high[at:stop])
        known = np.union1d(known, in_docs[at:stop][which] % n_docs * n_items + of_items[place] % n_items)
        at = stop
    return known


def _hits(found: blocks.Words, items: Items, window: int):
    """Per document of the batch: spans of hit words and ids of the items that occur."""
    start, length, item = _windows(items, window)
    cover = np.zeros(len(found.hashes) + 1, np.int64)
    doc_of = found.doc
    n_docs, n_items = len(found.first) - 1, len(items.ids)
    pairs = np.zeros(0, np.int64)
    for base, sa in _shards(found, window):
        for depth, live, low, high in sa.search(items.words, start, length):
            done = length[live] == depth
            if not done.any():
                continue
            # Windows of the same words have the same places, which are looked at once for all of their items.
            distinct, one, number = np.unique(low[done], return_index=True, return_inverse=True)
            at, which = _expand(distinct, high[done][one])
            word = base + sa.word[sa.sa[at]]
            np.add.at(cover, word, 1)
            np.add.at(cover, word + depth, -1)
            in_docs = np.unique(which * n_docs + doc_of[word])
            of_items = np.unique(number * n_items + item[live[done]])
            pairs = _with_items(pairs, in_docs, n_docs, of_items, n_items)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans: dict[int, list[list[int]]] = {}
    for lo, hi in edge.reshape(-1, 2):  # a run of hit words may pass from one document to the next
        for d in range(doc_of[lo], doc_of[hi - 1] + 1):
            base = found.first[d]
            a, b = max(lo, base), min(hi, found.first[d + 1])
            if a < b:
                spans.setdefault(d, []).append([int(a - base), int(b - base)])
    ids: dict[int, list[str]] = {}
    if len(pairs):
        docs, starts = np.unique(pairs // n_items, return_index=True)
        for d, some in zip(docs, np.split(pairs % n_items, starts[1:])):
            ids[int(d)] = [items.ids[i] for i in some]
    return spans, ids


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                  item_id: str = "item_id", window: int = WINDOW, into: str = "overlap",
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct ``into``: number of words, spans of hit words, ids of items.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters.  A word is
    hit when it lies in an occurrence of ``window`` consecutive words of an item, or of the whole
    of a shorter item.  Documents flow through without a shuffle, once for each block of
    items, so memory depends on neither the number of documents nor that of items.

    NULL and empty texts have no words and no hits; items without words or id hit nothing; equal
    items all count; an earlier column named ``into`` is replaced.
    """
    blocks.limit_batches(docs.sparkSession)
    docs = docs.drop(into)
    out = docs.withColumn(into, F.lit(None).cast(OUTCOME))
    found_any = False
    for block in item_blocks(items, item_text, item_id, block_words):
        out = _pass(out, block, text, window, into)
        found_any = True
    return out if found_any else _pass(out, Items([], np.zeros(0, np.uint64), np.zeros(1, np.int64)), text, window, into)


def _pass(docs: DataFrame, block: Items, text: str, window: int, into: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((block.ids, block.words, block.first))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in blocks.slices(batches, text):
            found = _words(batch, text)
            spans, ids = _hits(found, items, window)
            at = batch.schema.get_field_index(into)
            known = batch.column(at)
            rows = [{"n_words": int(n), "spans": spans.get(i, []), "items": ids.get(i, [])} for i, n in enumerate(found.counts)]
            if known.null_count < len(known):
                for row, old in zip(rows, known.to_pylist()):
                    row["spans"] = _merge(old["spans"], row["spans"])
                    row["items"] = sorted({*old["items"], *row["items"]})
            else:
                for row in rows:
                    row["items"] = sorted(set(row["items"]))
            columns = list(batch.columns)
            columns[at] = pa.array(rows, _OUTCOME_ARROW)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(search, docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
                    item_id: str = "item_id", least: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim match of every benchmark suffix over all shards, with a place of it.

    One row per item and suffix with a match of at least ``least`` words: ``item_id``,
    ``item_word``, ``n_words``, ``doc_id``, ``doc_word``.  Each shard gives its own best, the
    shuffle keeps the best of all; ties go to the smallest document id, then word.
    """
    blocks.limit_batches(docs.sparkSession)
    schema = "item_id string, item_word int, n_words int, doc_id string, doc_word int"
    parts = []
    for block in item_blocks(items, item_text, item_id, block_words):
        sent = docs.sparkSession.sparkContext.broadcast((block.ids, block.words, block.first))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(*sent.value)
            item, left = known.suffixes()
            deepest = int(left.max())
            for batch in blocks.slices(batches, "text"):
                found = _words(batch, "text")
                for base, sa in _shards(found, deepest):
                    best = np.zeros(len(left), np.int64)
                    low, high = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
                    for depth, live, lo, hi in sa.search(known.words, np.arange(len(left)), left):
                        best[live], low[live], high[live] = depth, lo, hi
                    at = np.flatnonzero(best >= least)
                    if not len(at):
                        continue
                    place, which = _expand(low[at], high[at])
                    word = base + sa.word[sa.sa[place]]
                    first = np.full(len(at), len(found.hashes))
                    np.minimum.at(first, which, word)
                    doc = found.doc[first]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([known.ids[i] for i in item[at]], pa.string()),
                        pa.array(at - known.first[item[at]], pa.int32()), pa.array(best[at], pa.int32()),
                        batch.column(0).take(pa.array(doc)).cast(pa.string()), pa.array(first - found.first[doc], pa.int32()),
                    ], names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        parts.append(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = every.groupBy("item_id", "item_word").agg(F.max_by(
        F.struct("n_words", "doc_id", "doc_word"),
        F.struct(F.col("n_words"), (-F.coalesce(F.expr("try_cast(doc_id as bigint)"), F.lit(0))), (-F.col("doc_word")))).alias("b"))
    return best.select("item_id", "item_word", "b.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, with the same columns."""
    marked = find_overlaps(docs, items, text, into="_overlap", **options)
    return marked.filter(F.size("_overlap.spans") == 0).select(*docs.columns)
