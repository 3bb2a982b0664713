"""Removal of repeated byte strings with difference-cover suffix arrays.

Suffixes that begin with the same ``LENGTH`` bytes must meet in one place.  Every such window has an
anchor, the least hash of the short strings inside it, which depends on its bytes alone; so windows
are dealt out by anchor, a run of neighbouring windows with one anchor at a time.  Only runs whose
anchor occurs again are looked at.  Runs with the same bytes are one; what remains of an
anchor is sorted: sampled triples are named and ranked, recursively, the other suffixes are merged
in, and neighbours in the order are compared over ``LENGTH`` bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm import blocks
from basketry.session import spool

#: Bytes of a repeated string, and of the short strings that anchors are chosen from.
LENGTH, SEED = 100, 24
#: Most windows in one run; longer ones (periodic text) are cut.
RUN = 512
#: Bytes sorted at a time.
SORTED_BYTES = 1 << 20


def _hash_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(blocks.byte_codes(False)[data] * blocks.powers(blocks._size(len(data)))[:len(data)], out=sums[1:])
    return sums


def _string_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return blocks.mixed((sums[end] - sums[start]) * blocks.inverse_powers(blocks._size(len(sums) - 1))[start])


def _sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``span`` neighbours, by doubling."""
    size = 1
    while size * 2 <= span:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (span - size)], values[span - size:]) if size < span else values


def _least_hashes(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each short string, the least of each window of ``length`` bytes, and hash sums."""
    sums = _hash_sums(data)
    short = _string_hashes(sums, np.arange(len(data) - seed + 1), np.arange(seed, len(data) + 1))
    return short, _sliding(short, length - seed + 1, np.minimum), sums


def anchor_positions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Anchors at their places: (anchor, document) for each place that is the least of some window."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short, least, _ = _least_hashes(data, length, seed)
    span = length - seed + 1
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == short)
    doc = np.searchsorted(offsets, chosen, "right") - 1
    inside = chosen + seed <= offsets[doc + 1]
    return short[chosen[inside]], doc[inside]


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of windows with one anchor: (anchor, first window, number of windows, document), and hash sums."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), empty, empty, empty, _hash_sums(data)
    _, least, sums = _least_hashes(data, length, seed)
    change = np.zeros(len(data) + 1, np.int64)
    inside = np.diff(offsets) >= length
    np.add.at(change, offsets[:-1][inside], 1)
    np.add.at(change, offsets[1:][inside] - length + 1, -1)
    valid = np.cumsum(change[:len(least)]) > 0
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first[offsets[:-1][inside]] = True
    start = np.flatnonzero(first)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~first[1:], False)) + 1
    count = stop - start
    parts = -(-count // RUN)
    which = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = start[which] + nth * RUN
    count = np.minimum(stop[which] - begin, RUN)
    return least[start][which], begin, count, np.searchsorted(offsets, begin, "right") - 1, sums


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of every key from 1, equal keys equal, and the number of ranks."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def difference_cover_order(seq: np.ndarray) -> np.ndarray:
    """Suffix order of ``seq`` (values from 1).

    Suffixes at positions 1 and 2 modulo 3 are ranked by their first three values; where ranks
    tie, the ranks themselves are the sequence of the next level.
    A suffix at a multiple of 3 is its first value and the rank of the next.  Each of the two
    sorted lists then finds its places in the other by the keys that both can form.
    """
    n = len(seq)
    bits = max(8, int(max(n, seq.max(initial=0)) + 2).bit_length())
    if 3 * bits > 63:
        raise ValueError("too long a sequence; sort smaller blocks")
    ext = np.concatenate([seq, np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triple = ((ext[sample] << bits | ext[np.minimum(sample + 1, n)]) << bits) | ext[np.minimum(sample + 2, n + 1)]
    names, distinct = _ranks(triple)
    if distinct < len(sample):
        order = difference_cover_order(names)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(ext[zeros] << bits | rank[zeros + 1])]
    at1, at2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    two = lambda p: ext[p] << bits | rank[p + 1]
    three = lambda p: (ext[p] << bits | ext[p + 1]) << bits | rank[p + 2]
    z2, z3 = two(zeros), three(zeros)
    out = np.empty(n, np.int64)
    out[np.arange(len(zeros)) + np.searchsorted(two(at1), z2) + np.searchsorted(three(at2), z3)] = zeros
    before = np.empty(len(sampled), np.int64)
    before[sampled % 3 == 1] = np.searchsorted(z2, two(at1), "right")
    before[sampled % 3 == 2] = np.searchsorted(z3, three(at2), "right")
    out[np.arange(len(sampled)) + before] = sampled
    return out


def repeated_windows(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each window (context after context) equals an earlier one.

    The contexts are sorted as one text: neighbours in suffix order whose first ``length`` bytes
    are equal form a group, and all but its first member are repeated.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    order = difference_cover_order(data.astype(np.int64) + 1)
    first = np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.full(len(data), -1, np.int64)
    window[first] = np.arange(len(first))
    order = order[window[order] >= 0]
    sums = _hash_sums(data)
    h = _string_hashes(sums, order, order + length)
    same = np.zeros(len(order), bool)
    same[1:] = h[1:] == h[:-1]
    near = np.flatnonzero(same)
    for at in range(0, len(near), 1 << 14):  # the bytes decide, not the hash
        some = near[at:at + (1 << 14)]
        span = np.arange(length)
        same[some] = (data[order[some][:, None] + span] == data[order[some - 1][:, None] + span]).all(1)
    group = np.cumsum(~same) - 1
    least = np.minimum.reduceat(order, np.flatnonzero(~same)) if len(order) else order
    out = np.zeros(len(first), bool)
    out[window[order]] = order != least[group]
    return out


def _spans(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, text_key, twice): every anchor of every text once, and whether it stands there twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = blocks.text_bytes(batch.column(1))
            anchor, doc = anchor_positions(data, offsets, length)
            order = np.lexsort((anchor, doc))
            anchor, doc = anchor[order], doc[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[head].view(np.int64)), pa.array(keys[doc[head]], pa.int64()),
                pa.array(np.diff(np.append(head, len(anchor))) > 1)], names=["anchor", "text_key", "twice"])

    return texts.select("text_key", "text").mapInArrow(run, "anchor long, text_key long, twice boolean")


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """Runs whose anchor is in the text's list, with the bytes that their windows cover."""
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            data, offsets = blocks.text_bytes(batch.column(2))
            anchor, start, count, doc, sums = anchor_runs(data, offsets, length)
            keep = _listed(anchor, doc, batch.column(3))
            anchor, start, count, doc = anchor[keep], start[keep], count[keep], doc[keep]
            end = start + count + length - 1
            raw = data.tobytes()
            h = _string_hashes(sums, start, end) ^ blocks.mixed(count.astype(np.uint64))
            # A run that repeats one of its own windows needs sorting even on its own.
            inner = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own = _string_hashes(sums, inner, inner + length)
            run_of = np.repeat(np.arange(len(start)), count)
            order = np.lexsort((own, run_of))
            again = (own[order][1:] == own[order][:-1]) & (run_of[order][1:] == run_of[order][:-1])
            periodic = np.zeros(len(start), bool)
            periodic[run_of[order][1:][again]] = True
            where = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), batch.column(0).take(where), batch.column(1).take(where),
                pa.array((start - offsets[doc]).astype(np.int64)), pa.array(count, pa.int32()), pa.array(periodic),
                pa.array([raw[a:b] for a, b in zip(start, end)], pa.binary()),
            ], names=["anchor", "h", "doc_id", "text_key", "start", "n", "periodic", "bytes"])

    return joined.mapInArrow(
        run, f"anchor long, h long, doc_id {id_type}, text_key long, start long, n int, periodic boolean, bytes binary")


def _listed(anchor: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each run's anchor is in the list of its document."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    salt = lambda d: blocks.mixed(d.astype(np.uint64) + np.uint64(7))
    return np.isin(anchor ^ salt(doc), values ^ salt(owner)) if len(values) else np.zeros(len(anchor), bool)


def _kept_windows(ambiguous: DataFrame, length: int) -> DataFrame:
    """For each run: the ranges of its windows that no earlier run of its anchor holds."""
    id_type = ambiguous.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        seen: dict[str, object] = {"anchor": None, "hashes": np.zeros(0, np.uint64)}

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            counts = np.array([r[4] for r in rows], np.int64)
            texts = [r[5] for r in rows]
            repeated = repeated_windows(texts, counts, length)
            # An anchor with more runs than one block holds hands on the windows it has had.
            hashes = None
            if seen["anchor"] == rows[0][0] or len(rows) > 1:
                data = np.frombuffer(b"".join(texts), np.uint8)
                at = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
                first = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                hashes = _string_hashes(_hash_sums(data), first, first + length)
                if seen["anchor"] == rows[0][0]:
                    mine = np.repeat(np.array([r[0] == rows[0][0] for r in rows]), counts)
                    repeated |= mine & np.isin(hashes, seen["hashes"])
            last = rows[-1][0]
            mine = np.repeat(np.array([r[0] == last for r in rows]), counts)
            before = seen["hashes"] if seen["anchor"] == last else np.zeros(0, np.uint64)
            seen["hashes"] = np.union1d(before, hashes[mine]) if hashes is not None else before
            seen["anchor"] = last
            edges = np.cumsum(counts) - counts
            kept = [_spans(~repeated[a:a + c]).tolist() for a, c in zip(edges, counts)]
            return pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in rows], pa.from_numpy_dtype(np.int64) if id_type == "bigint" else None),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array(kept, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "text_key", "start", "kept"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SORTED_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    columns = ambiguous.select("anchor", "doc_id", "text_key", "start", "n", "bytes")
    return columns.mapInArrow(run, f"doc_id {id_type}, text_key long, start long, kept array<array<int>>")


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Final pass over the texts that have repeated anchors: what is removed, what is kept."""
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            data, offsets = blocks.text_bytes(batch.column(2))
            anchor, start, count, doc, _ = anchor_runs(data, offsets, length)
            listed = _listed(anchor, doc, batch.column(3))
            window = np.zeros(len(data) + 1, np.int64)
            np.add.at(window, start[listed], 1)
            np.add.at(window, start[listed] + count[listed], -1)
            window = np.cumsum(window[:-1])
            for d, kept in enumerate(batch.column(4).to_pylist()):
                for run_ in kept or ():
                    for a, b in run_["kept"]:
                        window[offsets[d] + run_["start"] + a:offsets[d] + run_["start"] + b] = 0
            cover = np.zeros(len(data) + 1, np.int64)
            hit = np.flatnonzero(window > 0)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
            removed = np.cumsum(cover[:-1]) > 0
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                flags = removed[a:b]
                spans = _spans(flags)
                out.append((int(flags.sum()), spans.tolist(), hashlib.sha256(data[a:b][~flags].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.list_(pa.list_(pa.int32()))), pa.array([o[2] for o in out], pa.string()),
            ], names=["doc_id", "text_key", "n_removed", "spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {id_type}, text_key long, n_removed long, spans array<array<int>>, kept_sha256 string")


def repeated_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (bytes, end exclusive), ``kept_sha256``.

    A byte goes when a string of ``length`` bytes around it also starts earlier: in a document with a
    smaller id, or before in the same one.  Everything is judged on the input.  The later copies of a
    text lose all bytes if there are ``length`` of them; only the first copy is looked at further.

    NULL is an empty text; a NULL id comes after all others; different texts under one id are
    ordered by a hash of the text; rows equal in id and text are one document, each with its result.
    """
    blocks.limit_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    order = [F.col("doc_id").isNull().alias("_none"), F.col("doc_id")]
    rows = spool(docs.select(
        "doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    firsts = rows.filter(F.col("n_bytes") >= length).groupBy("text_key").agg(F.min(F.struct(*order)).alias("f")).select(
        "text_key", F.col("f.doc_id").alias("first_id"))

    spread = Window.partitionBy("anchor").orderBy("text_key")
    seen = _anchors(docs.filter(F.octet_length("text") >= length), length)
    seen = seen.withColumn("_before", F.lag("text_key").over(spread)).filter("_before is null or _before != text_key")
    seen = seen.withColumn("_after", F.lead("text_key").over(spread)).filter("twice or _before is not null or _after is not null")
    lists = seen.groupBy("text_key").agg(F.collect_list("anchor").alias("anchors"))
    lists = spool(lists.join(firsts, "text_key"), "anchors")
    texts = docs.join(lists, (docs["text_key"] == lists["text_key"]) & docs["doc_id"].eqNullSafe(lists["first_id"]))
    texts = texts.select(docs["doc_id"], docs["text_key"], "text", "anchors")

    found = _contexts(texts, length)
    at = F.struct(*order, F.col("text_key"), F.col("start"), F.col("n"), F.col("periodic"), F.col("bytes"))
    owners = found.groupBy("anchor", "h").agg(F.min(at).alias("o")).select("anchor", "o.*")
    own = Window.partitionBy("anchor").orderBy("_none", "doc_id", "text_key", "start")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owners = spool(owners.withColumn("runs", F.count("*").over(whole)), "runs")
    sure = owners.filter("runs = 1 and not periodic").select(
        "doc_id", "text_key", "start", F.array(F.array(F.lit(0), F.col("n"))).alias("kept"))
    unsure = owners.filter("runs > 1 or periodic").repartition("anchor").sortWithinPartitions("anchor", "_none", "doc_id", "text_key", "start")
    kept = sure.unionByName(_kept_windows(unsure, length)).groupBy("text_key").agg(F.collect_list(F.struct("start", "kept")).alias("kept"))
    cut = _cut(
        docs.join(lists.join(kept, "text_key", "left"), (docs["text_key"] == lists["text_key"]) & docs["doc_id"].eqNullSafe(lists["first_id"]))
        .select(docs["doc_id"], docs["text_key"], "text", "anchors", "kept"), length)
    # Rows equal in id and text give equal results; one of them is joined back to all.
    cut = spool(cut.groupBy("text_key").agg(F.min(F.struct("n_removed", "spans", "kept_sha256")).alias("c")), "cuts")
    out = rows.join(firsts, "text_key", "left").join(cut, "text_key", "left")
    copy = F.col("first_id").eqNullSafe(F.col("doc_id"))
    long = F.col("n_bytes") >= length
    none = F.array().cast("array<array<int>>")
    everything = F.array(F.array(F.lit(0), F.col("n_bytes").cast("int")))
    return out.select(
        "doc_id", "n_bytes",
        F.when(~long, 0).when(~copy, F.col("n_bytes")).otherwise(F.coalesce("c.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(~long, none).when(~copy, everything).otherwise(F.coalesce("c.spans", none)).alias("spans"),
        F.when(~long, F.col("sha")).when(~copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.kept_sha256", "sha")).alias("kept_sha256"))
