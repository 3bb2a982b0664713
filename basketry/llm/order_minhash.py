"""Order MinHash: fingerprints of minimal occurrence-numbered k-mers in text order.

A k-mer and its occurrence number within the text give one hash.  The hash also deals the k-mer to
one of ``SKETCHES`` groups; of each group the ``TUPLE`` smallest are selected, put back into text
order, and hashed together.  Two texts agree in a group when they share its smallest k-mers in the
same order, so the share of equal groups falls with the edit distance, also for moved blocks.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm import blocks
from basketry.session import spool

#: Bytes of a k-mer, groups of a fingerprint, k-mers of a group.
K, SKETCHES, TUPLE = 9, 32, 2
#: K-mers looked at per group before all of a text are.
LOOK = 12
#: Texts are fingerprinted in parts of so many bytes.
PART = 1 << 19


def _numbered(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every (k-mer, occurrence number), and the document of each, in text order."""
    sizes = np.diff(offsets)
    n = len(data)
    width = np.minimum(sizes, k)
    counts = np.where(sizes > 0, sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][doc]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(blocks.byte_codes(False)[data] * blocks.powers(blocks._size(n))[:n], out=sums[1:])
    end = start + width[doc]
    h = blocks.mixed((sums[end] - sums[start]) * blocks.inverse_powers(blocks._size(n))[start])
    own = h ^ blocks.mixed(doc.astype(np.uint64) + np.uint64(1))
    ranked = np.sort(own)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice):
        marks = np.zeros(1 << 22, bool)
        marks[(twice >> np.uint64(42)).astype(np.int64)] = True
        at = np.flatnonzero(marks[(own >> np.uint64(42)).astype(np.int64)])
        order = at[np.argsort(own[at], kind="stable")]
        same = own[order]
        head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        again = nth > 0
        h[order[again]] = blocks.mixed(h[order[again]] + nth[again].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return h, doc


def _selected(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n_docs: int, sketches: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tuple hash of each (document, group) from the k-mers ``at``, and how many it rests on."""
    group = doc[at] * sketches + (h[at] % np.uint64(sketches)).astype(np.int64)
    order = np.lexsort((h[at], group))
    at, group = at[order], group[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    nth = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
    least = nth < size
    at, group = at[least], group[least]
    order = np.lexsort((at, group))  # back to text order within each group
    at, group = at[order], group[order]
    filled = np.bincount(group, minlength=n_docs * sketches)
    head = np.cumsum(filled) - filled
    out = np.zeros(n_docs * sketches, np.uint64)
    for i in range(size):
        has = filled > i
        out[has] = blocks.mixed(out[has] * np.uint64(0xD6E8FEB86659FD93) + h[at[head[has] + i]] + np.uint64(i))
    return out.reshape(n_docs, sketches), filled.reshape(n_docs, sketches)


def fingerprints(texts: list[str], k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One row of ``sketches`` 32-bit tuple hashes for each text; 0 where a group is empty."""
    out = np.zeros((len(texts), sketches), np.uint32)
    raw = [t.encode() for t in texts]
    at = 0
    while at < len(raw):
        stop, held = at, 0
        while stop < len(raw) and (stop == at or held + len(raw[stop]) <= PART):
            held += len(raw[stop])
            stop += 1
        lengths = np.array([len(r) for r in raw[at:stop]], np.int64)
        data = np.frombuffer(b"".join(raw[at:stop]), np.uint8)
        h, doc = _numbered(data, np.concatenate([[0], np.cumsum(lengths)]), k)
        if len(h):
            n_docs = stop - at
            total = np.bincount(doc, minlength=n_docs)
            limit = np.minimum(LOOK * size * sketches / np.maximum(total, 1), 1)
            # The group is a low digit of the hash, the size its high digits: the two are independent.
            near = np.flatnonzero(h / 2.0 ** 64 <= limit[doc])
            found, filled = _selected(h, doc, near, n_docs, sketches, size)
            scarce = (filled.min(1) < size) & (limit < 1)
            if scarce.any():
                all_of = np.flatnonzero(scarce[doc])
                again, _ = _selected(h, doc, all_of, n_docs, sketches, size)
                found[scarce] = again[scarce]
            found = np.where(found > 0, (found >> np.uint64(32)) | np.uint64(1), 0)
            out[at:stop] = found.astype(np.uint32)
        at = stop
    return out


def as_text(prints: np.ndarray) -> list[str]:
    return [p.astype(">u4").tobytes().hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the groups filled in either text that agree; two empty texts are alike."""
    used = (a != 0) | (b != 0)
    n = used.sum(1)
    return np.where(n > 0, ((a == b) & used).sum(1) / np.maximum(n, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprint_column(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text, as hexadecimal text.

    Equal texts have equal fingerprints; NULL counts as empty, whose groups are all 0; a text
    shorter than a k-mer is one k-mer.  An earlier column named ``into`` is replaced.
    """
    blocks.limit_batches(docs.sparkSession)
    ready = docs.drop(into).withColumn(into, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, text):
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            columns[batch.schema.get_field_index(into)] = pa.array(as_text(fingerprints(texts)), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return ready.mapInArrow(run, ready.schema)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    edited_prints = fingerprints(edited)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(as_text(prints), pa.string()), pa.array(as_text(edited_prints), pa.string()),
        pa.array(likeness(prints, edited_prints), pa.float64()), pa.array(likeness(prints, next_prints), pa.float64()),
    ]


def compare_with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is that of the next smaller id, after the smallest the largest.  One
    shuffle sorts the texts by id over all tasks; a task walks its rows with the next one at hand.
    Only the last row of each task needs a text from elsewhere, the first of the next task; these
    few rows, one for each task, are joined afterwards.

    NULL texts are empty; NULL ids come last; rows with one id follow each other by their
    text; a lone document is its own next.
    """
    spark = blocks.limit_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in _RESULT.split(", ")], "part", "edge", "edge_text"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = None
        held = None  # last row so far: id, text, fingerprint

        def edge(which: str, id_: pa.Array, t: str) -> pa.RecordBatch:
            none = [pa.nulls(1, c) for c in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(
                [id_, *none, pa.array([part], pa.int32()), pa.array([which], pa.string()), pa.array([t], pa.string())], names=names)

        for batch in blocks.slices(batches, "text"):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            kind = ids.type
            prints = fingerprints(texts)
            if held is None:
                yield edge("first", ids.slice(0, 1), texts[0])
            else:
                ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.vstack([held[2], prints])
            n = len(texts) - 1
            held = (ids.slice(n, 1), texts[n], prints[n:])
            if n:
                yield pa.RecordBatch.from_arrays([
                    ids.slice(0, n), *_results(texts[:n], texts[1:], prints[:n], prints[1:]),
                    pa.array(np.full(n, part), pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
        if held is not None:
            yield edge("last", held[0], held[1])

    walked = spool(rows.mapInArrow(walk, f"doc_id {id_type}, {_RESULT}, part int, edge string, edge_text string"), "fingerprints")
    first = walked.filter("edge = 'first'").select("part", F.col("edge_text").alias("next_text"))
    parts = first.select("part")  # one row for each task
    circle = Window.orderBy("part")
    following = parts.select("part", F.lead("part").over(circle).alias("next_part"), F.min("part").over(Window.partitionBy()).alias("start"))
    following = following.select("part", F.coalesce("next_part", "start").alias("next_part"))
    last = (
        walked.filter("edge = 'last'").select("doc_id", F.col("edge_text").alias("text"), "part")
        .join(following, "part").join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text"):
            texts, after = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_results(texts, after, fingerprints(texts), fingerprints(after))], names=names[:7])

    done = walked.filter("edge is null").select(*names[:7])
    return done.unionByName(last.mapInArrow(finish, f"doc_id {id_type}, {_RESULT}"))
