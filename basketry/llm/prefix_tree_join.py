"""N-gram Jaccard join: rare-first prefixes find candidates, prefix trees verify them.

Every set of shingles has one global order: shingles that are frequent in the corpus last, the
others by hash.  Similar sets must share shingles near the front of that order, so only fronts
are shuffled.  Candidates are then checked against an anchor set by walking a prefix tree of the
candidate sets: what two sets share from the front is counted once, and a branch is left as soon as
the shingles that remain cannot reach the required overlap.

Only connected components are wanted, so sets that are already connected are not compared again.
Of the others, a pair is made only if the parities of both sets allow the similarity: every set
has 512 bits, each the parity of the shingles that fall on it, and two sets differ in at least as many shingles as bits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm import blocks
from basketry.llm.graph import components
from basketry.session import discard, spool

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A shingle in this share of the documents goes last in the order, as does one in more fronts than FULL.
FREQUENT = 0.001
FULL = 16
#: Rounds that tie the sets of a shingle to one anchor before the remaining pairs are listed.
STAR_ROUNDS = 2
#: Columns of 64 parities each.
PARITIES = [f"p{i}" for i in range(8)]
#: Parts that a frequent shingle's sets are dealt to.
SALT = 16


def front(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of a set of ``n`` of which a similar set must hold at least one."""
    return n - (percent * n + 99) // 100 + 1


def emitted(n: np.ndarray | int, percent: int = PERCENT):
    """Front and slack: with it, frequent shingles can be skipped and shared ones counted."""
    f = front(n, percent)
    return np.minimum(n, f + np.maximum(16, f // 2))


def _front_sql(n: str, percent: int) -> str:
    return f"({n} - floor(({percent} * {n} + 99) / 100) + 1)"


def _short_front_sql(n: str, percent: int) -> str:
    """Shingles of which a similar set that is at least as large holds one in its front."""
    return f"({n} - floor((2 * {percent} * {n} + 99 + {percent}) / (100 + {percent})) + 1)"


def _emitted_sql(n: str, percent: int) -> str:
    f = _front_sql(n, percent)
    return f"least({n}, {f} + greatest(16, floor({f} / 2)))"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = blocks.text_bytes(column)
    found = blocks.words(data, offsets, blocks.PRINTED)
    h, first = found.hashes, found.first
    combined = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        combined += h[i:len(h) - size + 1 + i] * blocks.mixed(i + 1)
    combined = blocks.mixed(combined)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            s = np.sort(combined[a:b - size + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(blocks.mixed((h[a:b] * blocks.mixed(np.arange(101, 101 + b - a))).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> np.uint64:
    """One number for a set, the same for equal sets."""
    return blocks.mixed(blocks.mixed(s + np.uint64(0x51ED270B)).sum(keepdims=True) + np.uint64(len(s)))[0]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of words per set: each bit is the parity of how many of its shingles fall on it."""
    bits = 64 * len(PARITIES)
    counts = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        counts[i] = np.bincount((blocks.mixed(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts, axis=1, bitorder="little").view(np.int64)


def _features(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (key, size and parities of its set), and rows of shingles common in one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text"):
            sets = shingle_sets(batch.column(1), size)
            keys = np.array([set_key(s) for s in sets], np.uint64)
            _, once = np.unique(keys, return_index=True)
            every = np.sort(np.concatenate([sets[i] for i in once])) if len(once) else np.zeros(0, np.uint64)
            head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(every)))
            often = count >= max(2, FREQUENT * len(once))
            n = batch.num_rows
            m = int(often.sum())
            none = pa.nulls
            words = parities(sets)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0), none(m, batch.column(0).type)]),
                pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(keys.view(np.int64)), none(m, pa.int64())]),
                pa.concat_arrays([batch.column(2), none(m, pa.int64())]),
                pa.concat_arrays([none(n, pa.int64()), pa.array(every[head[often]].view(np.int64))]),
                pa.concat_arrays([none(n, pa.int64()), pa.array(count[often], pa.int64())]),
                *[pa.concat_arrays([pa.array(np.ascontiguousarray(words[:, i])), none(m, pa.int64())]) for i in range(len(PARITIES))],
            ], names=["doc_id", "n", "cls", "text_key", "token", "df", *PARITIES])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, n long, cls long, text_key long, token long, df long, "
    return docs.mapInArrow(run, shape + ", ".join(f"{p} long" for p in PARITIES))


def _entries(docs: DataFrame, size: int, percent: int, last: np.ndarray, hot: dict[int, object]) -> DataFrame:
    """The emitted front of every set: (token, cls, n, pos, frequent)."""
    sent = docs.sparkSession.sparkContext.broadcast((last, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hot = sent.value
        for batch in blocks.slices(batches, "text"):
            sets = shingle_sets(batch.column(1), size)
            ids = batch.column(0).to_pylist()
            done, tokens, counts, keys, sizes, frequent = set(), [], [], [], [], []
            for s, doc in zip(sets, ids):
                if not len(s):
                    continue
                key = int(set_key(s).astype(np.int64))
                if key in done or (key in hot and hot[key] is not None and hot[key] != doc):
                    continue
                done.add(key)
                at = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
                late = last[at] == s if len(last) else np.zeros(len(s), bool)
                e = int(emitted(len(s), percent))
                ordered = np.concatenate([s[~late], s[late]])[:e]
                tokens.append(ordered)
                counts.append(e)
                keys.append(key)
                sizes.append(len(s))
                frequent.append(np.arange(e) >= int((~late).sum()))
            if not tokens:
                continue
            counts = np.array(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)),
                pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])), pa.array(np.concatenate(frequent)),
            ], names=["token", "cls", "n", "pos", "frequent"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, cls long, n int, pos int, frequent boolean")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries whose token another set holds too, with the token's number of sets; one shuffle.

    A frequent token's entries are dealt to parts, so no task has all of them.
    """
    part = F.when(F.col("frequent"), F.pmod("cls", F.lit(SALT))).otherwise(F.lit(0))
    group = Window.partitionBy("token", "part")
    order = group.orderBy("cls")
    entries = entries.withColumn("part", part).withColumn("_before", F.lag("cls").over(order)).filter("_before is null or _before != cls")
    return entries.withColumn("df", F.count("*").over(group)).filter("frequent or df > 1").drop("_before")


def _text_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``cls`` and its set as big-endian bytes, for the classes of the wanted texts."""
    texts = docs.select("text", "text_key").join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text"):
            sets = [s for s in shingle_sets(batch.column(0), size) if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(set_key(s).astype(np.int64)) for s in sets], pa.int64()),
                pa.array([s.astype(">u8").tobytes() for s in sets], pa.binary())], names=["cls", "tokens"])

    return texts.select("text").mapInArrow(run, "cls long, tokens binary").dropDuplicates(["cls"])


def walk_tree(anchor: np.ndarray, others: list[bytes], percent: int = PERCENT) -> list[bool]:
    """Which of the sets are similar to the anchor, by one walk over their prefix tree.

    Sorted, the sets are the leaves of the tree from left to right; what a set shares with the one
    before is the path it has in common with it.  Overlap counts of that path are kept.
    """
    order = sorted(range(len(others)), key=others.__getitem__)
    out = [False] * len(others)
    n_a = len(anchor)
    path, overlap, ahead = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in order:
        tokens = np.frombuffer(others[i], ">u8").astype(np.uint64)
        n = len(tokens)
        need = -(-percent * (n + n_a) // (100 + percent))
        if min(n, n_a) < need:
            continue
        m = min(len(path), n)
        differ = np.flatnonzero(path[:m] != tokens[:m])
        common = int(differ[0]) if len(differ) else m
        # Bound at the end of the common path: shared so far and what can still be shared.
        if common and overlap[common - 1] + min(n - common, n_a - ahead[common - 1]) < need:
            continue
        rest = tokens[common:]
        place = np.searchsorted(anchor, rest)
        inside = anchor[np.minimum(place, n_a - 1)] == rest
        before = overlap[common - 1] if common else 0
        counts = before + np.cumsum(inside)
        after = place + inside
        reach = counts + np.minimum(n - common - 1 - np.arange(len(rest)), n_a - after)
        dead = np.flatnonzero(reach < need)
        stop = int(dead[0]) + 1 if len(dead) else len(rest)
        path = tokens[:common + stop]
        overlap = np.concatenate([overlap[:common], counts[:stop]])
        ahead = np.concatenate([ahead[:common], after[:stop]])
        out[i] = not len(dead)
    return out


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar.  Each batch of an anchor's candidates is one prefix tree."""
    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a")), "a").select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict[int, list[int]] = {}
            for i, key in enumerate(a):
                groups.setdefault(key, []).append(i)
            keep = []
            for rows in groups.values():
                anchor = np.frombuffer(batch.column(2)[rows[0]].as_py(), ">u8").astype(np.uint64)
                found = walk_tree(anchor, [batch.column(3)[i].as_py() for i in rows], percent)
                keep += [i for i, ok in zip(rows, found) if ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    A set holds the distinct ``size``-word shingles of a text, lower-cased A-Z; a shorter text is one
    shingle, a NULL or empty one has none and links with nothing.  Sets link when
    100 * intersection >= percent * union.  ``component_id`` is the smallest id reachable by
    links, NULL ids aside.  Equal sets are one class from the start and are compared once, named by a
    64-bit hash.  Repeated rows and ids keep their rows.
    """
    spark = blocks.limit_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    features = spool(_features(docs, size), "sets")
    rows = features.filter("token is null").select("doc_id", "n", "cls", "text_key")
    filled = rows.filter("n > 0")

    # Shingles in FREQUENT of all sets: at most the mean set size / FREQUENT of them, so they fit a
    # broadcast, as do the at most 1 / FREQUENT classes that hold that share of all rows.
    total = filled.count()
    floor = max(FULL, FREQUENT * total)
    last = features.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= floor)
    last = np.sort(np.array([r[0] for r in last.select("token").collect()], np.int64).view(np.uint64))
    crowded = filled.groupBy("cls").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc")).filter(F.col("c") >= floor)
    hot = {r["cls"]: r["doc"] for r in crowded.collect()}

    entries = spool(_shared(_entries(docs, size, percent, last, hot)), "fronts")
    heavy = F.col("frequent") | (F.col("df") > FULL)
    state = entries.groupBy("cls").agg(F.first("n").alias("n"), F.sum(heavy.cast("int")).alias("h"))
    state = state.select("cls", (F.expr(_emitted_sql("n", percent)) - F.col("h") - F.expr(_front_sql("n", percent))).alias("slack"))

    known = features.filter("n > 0").select("cls", *PARITIES).join(entries.select("cls").distinct(), "cls", "left_semi")
    bits = spool(known.dropDuplicates(["cls"]), "parities")

    links = None
    tried = None
    comp = entries.select("cls").distinct().withColumn("comp", F.col("cls"))
    sets = None
    written, classes = [], []
    for step in range(STAR_ROUNDS + 1):
        if step == 0:  # nothing is connected yet: every set is a class of its own
            now = entries.withColumn("comp", F.col("cls"))
        else:
            now = entries.join(comp, "cls")
            # Tokens whose sets are not all connected yet.
            spread = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
            now = spool(now.join(spread, "token", "left_semi"), "open")
        if step == 0:
            pairs = _possible(_star(now, percent), bits, percent)
        elif step < STAR_ROUNDS:
            pairs = _many_stars(now, step, bits, percent)
        else:
            pairs = _remaining(now, state, bits, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = spool(pairs.select("a", "b"), "pairs")
        if step:
            discard(now)
        written.append(pairs)
        if pairs.isEmpty():
            if step < STAR_ROUNDS:
                continue
            break
        sets = _sets_for(sets, pairs, filled, docs, size)
        fresh = spool(_verify(pairs, sets, percent), "links")
        written.append(fresh)
        links = fresh if links is None else links.union(fresh)
        tried = pairs if tried is None else tried.union(pairs)
        roots = components(links, "a", "b")
        merged = spool(
            entries.select("cls").distinct().join(roots, F.col("cls") == F.col("node"), "left")
            .select("cls", F.coalesce("root", "cls").alias("comp")), "classes")
        discard(roots, *classes)
        comp, classes = merged, [merged]
    if classes:  # else the classes are read from the entries
        discard(entries)
    discard(bits, *written, *([] if sets is None else [sets]))

    classed = rows.join(comp, "cls", "left").select("doc_id", "n", F.coalesce("comp", "cls").alias("comp"))
    smallest = classed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return classed.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _fits(percent: int):
    """Sizes that allow the required similarity."""
    return (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)


def _alike(percent: int, a: str, b: str):
    """Whether parities (struct columns or aliases ``a`` and ``b``) and sizes allow the required similarity.

    Similar sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    """
    differ = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITIES), F.lit(0))
    return differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose parities allow the similarity."""
    side = lambda s: bits.select(F.col("cls").alias(s), *[F.col(p).alias(f"{s}_{p}") for p in PARITIES])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike(percent, "a_", "b_")).select("a", "b")


def _star(now: DataFrame, percent: int) -> DataFrame:
    """Each set of a token against the token's anchor: as many pairs as entries at most.

    The anchor is the set of the lowest rank of its (token, part).  The anchors of a token's parts are paired
    with the lowest of them.
    """
    rank = F.xxhash64(F.lit(0), "comp", "cls")
    center = now.groupBy("token", "part").agg(F.min(F.struct(rank.alias("r"), "cls", "n", "comp")).alias("c"))
    top = center.groupBy("token").agg(F.min("c").alias("top"))
    columns = lambda c, side: [
        F.col(f"{c}.cls").alias("x"), F.col(f"{side}cls").alias("y"), F.col(f"{c}.n").alias("n_a"), F.col(f"{side}n").alias("n_b"),
        F.col(f"{c}.comp").alias("comp_a"), F.col(f"{side}comp").alias("comp")]
    joined = now.join(center, ["token", "part"]).select(*columns("c", "")).unionByName(
        center.join(top, "token").select(*columns("top", "c.")))
    pairs = joined.filter("comp_a != comp").filter(_fits(percent))
    enough = F.expr(f"least({_emitted_sql('n_a', percent)} - {_front_sql('n_a', percent)}, {_emitted_sql('n_b', percent)} - {_front_sql('n_b', percent)}) / 4")
    counted = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.count("*").alias("shared"), F.first(enough).alias("enough"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return counted.filter(F.col("shared") >= F.greatest(F.col("enough"), F.lit(1)))


def _many_stars(now: DataFrame, step: int, bits: DataFrame, percent: int) -> DataFrame:
    """Each set of a common token against the token's anchor, where parities allow it: as many pairs as entries at most.

    Every token has an anchor of its own, so a set of a large group meets many, and is left alone only if it is
    similar to none of them.
    """
    common = now.filter(F.col("frequent") | (F.col("df") > FULL)).join(bits, "cls")
    rank = F.xxhash64(F.lit(step), "token", "cls")
    center = common.groupBy("token", "part").agg(F.min(F.struct(rank.alias("r"), "cls", "n", "comp", *PARITIES)).alias("c"))
    top = center.groupBy("token").agg(F.min("c").alias("top"))
    sized = lambda df, c, side: df.withColumns({"n_a": F.col(f"{c}.n").cast("long"), "n_b": F.col(f"{side}n").cast("long")}).filter(
        F.col(f"{c}.comp") != F.col(f"{side}comp")).filter(_fits(percent)).filter(_alike(percent, f"{c}.", side)).select(
        F.least(f"{c}.cls", f"{side}cls").alias("a"), F.greatest(f"{c}.cls", f"{side}cls").alias("b"))
    return sized(common.join(center, ["token", "part"]), "c", "").union(sized(center.join(top, "token"), "top", "c.")).distinct()


def _remaining(now: DataFrame, state: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Every other pair that may be similar and is not connected yet.

    Between sets with enough rare shingles, rare ones decide: sets of a pair share as many of them
    as both have slack beyond their fronts.  A set that lacks rare shingles is paired through
    its frequent ones as well, within the fronts of the order in which they were emitted; the smaller set
    of such a pair need only show a front that a set of its size or more must meet.  Pairs whose parities tell them
    apart are not made.
    """
    rows = now.join(state, "cls")
    heavy = F.col("frequent") | (F.col("df") > FULL)
    side = lambda df, s, *more: df.select(
        "token", F.col("cls").alias(f"cls_{s}"), F.col("n").alias(f"n_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("slack").alias(f"slack_{s}"),
        *[F.col(p).alias(f"{s}_{p}") for p in more])
    rare = rows.filter(~heavy)
    light = side(rare, "a").join(side(rare, "b"), "token").filter("cls_a < cls_b and comp_a != comp_b").filter(_fits(percent))
    light = light.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(
        F.count("*").alias("shared"), F.first(F.least("slack_a", "slack_b")).alias("slack"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    light = _possible(light.filter(F.col("shared") > F.col("slack")), bits, percent)
    # The larger set of a pair looks with its front, the smaller one is found by a shorter front.
    dense = rows.filter(heavy & (F.col("pos") < F.expr(_front_sql("n", percent)))).join(bits, "cls")
    found = dense.filter(F.col("pos") < F.expr(_short_front_sql("n", percent)))
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") > F.col("cls_b")))
    short = (
        side(dense, "a", *PARITIES).join(side(found, "b", *PARITIES), "token")
        .filter(larger & ((F.col("slack_a") < 0) | (F.col("slack_b") < 0)) & (F.col("comp_a") != F.col("comp_b")))
        .filter(_fits(percent) & _alike(percent, "a_", "b_"))
    )
    return light.union(short.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))).distinct()


def _sets_for(sets: DataFrame | None, pairs: DataFrame, filled: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Sets of all classes in ``pairs``; those read before are kept, only new ones are read."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    if sets is not None:
        wanted = wanted.join(sets.select("cls"), "cls", "left_anti")
    texts = spool(filled.join(wanted, "cls").groupBy("cls").agg(F.min("text_key").alias("text_key")), "texts").select("text_key")
    if sets is not None and texts.isEmpty():
        return sets
    more = spool(_text_sets(docs, texts, size), "tokens")
    discard(texts)
    return more if sets is None else sets.unionByName(more)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest id stays.

    Rows without words stay.  Of rows equal in id and text one stays; rows with a NULL id stay
    unless their text is in a component that has an id.
    """
    found = similar_components(docs, text, doc_id, **options)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    kept = docs.join(keep, docs[doc_id].eqNullSafe(keep["_kept"]), "left_semi")
    return kept.withColumn("_same", F.xxhash64(text)).dropDuplicates([doc_id, "_same"]).drop("_same")
