"""Hard negatives by exact inner-product search in cover trees.

Rows are dealt to shards around pivots, and each shard holds a cover tree of its rows.  A vector gets one more
component that brings all norms of a shard to the same length, so near in distance means large in
inner product.  A node covers its rows with a ball; the ball bounds every inner product
with a query, so nodes outside the query's window of scores are skipped, the others are visited best bound first,
and the rows of a leaf are scored exactly in integers.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm import blocks
from basketry.session import spool

#: Rows of one shard, queries of one block: what a task holds at a time.
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Rows that pivots are chosen from, by hash, and the most pivots; every row is indexed.
PIVOT_SAMPLE, MAX_PIVOTS = 2048, 256
#: Radius of a level over that of the next one, and rows that need no further split.
BASE, LEAF_ROWS = 1.3, 64
#: A ball whose points lie so far apart that children would hold fewer rows stays a leaf.
LEAST_CHILD = 8
NOTHING = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as int64; beyond the range of a long they are clipped."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    return np.array([[min(max(x, NOTHING + 1), NO_ID) for x in row] for row in exact], np.int64)


@dataclass
class CoverTree:
    """Nodes in breadth-first order; the rows of a leaf lie together."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray  # numbers into ``names``
    names: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    start: np.ndarray  # -1 for an inner node
    stop: np.ndarray
    holds: np.ndarray  # node x label

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
        """Split balls into separated balls of the next level's radius until few rows are left."""
        names, codes = np.unique(labels, return_inverse=True)
        square = (vectors ** 2).sum(1)
        points = np.concatenate([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], 1)
        from_point = lambda rows, c: np.sqrt(((points[rows] - points[c]) ** 2).sum(1))
        nodes, rows_of, order = [], [], []
        mean = points.mean(0)
        waiting = [(np.arange(len(points)), int(((points - mean) ** 2).sum(1).argmin()), -1, 0)]
        while waiting:
            below = []
            for rows, c, parent, level in waiting:
                radius = float(from_point(rows, c).max())
                children = []
                if len(rows) > LEAF_ROWS and radius > 0:
                    left, next_center = rows, c
                    while len(left) and len(children) * LEAST_CHILD <= len(rows):
                        inside = from_point(left, next_center) <= radius / BASE
                        children.append((left[inside], next_center))
                        left = left[~inside]
                        next_center = int(left[0]) if len(left) else -1
                    children = [] if len(left) else children
                at = sum(map(len, order))
                nodes.append((c, radius, parent, level, -1 if children else at, -1 if children else at + len(rows)))
                rows_of.append(rows)
                if children:
                    below += [(r, k, len(nodes) - 1, level + 1) for r, k in children]
                else:
                    order.append(rows)
            waiting = below
        center, radius, parent, level, start, stop = (np.array(x) for x in zip(*nodes))
        holds = np.zeros((len(nodes), len(names)), bool)
        for i, rows in enumerate(rows_of):
            holds[i, codes[rows]] = True
        place = np.concatenate(order)
        return CoverTree(vectors[place], ids[place], codes[place], names, vectors[center], radius, parent, level, start, stop, holds)

    def search(self, queries: np.ndarray, owner: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray,
               same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best rows of each window: (window, id, score), ties by smaller id.

        Window ``w`` asks for rows with a score between ``low`` and ``high`` with query ``owner[w]``, of its
        ``label`` but another id than ``own`` if ``same``, else of another label.
        """
        n = len(owner)
        norm = np.sqrt((queries ** 2).sum(1))[owner]
        # Labels of windows as numbers of this tree; -1 where the tree has none of that label.
        at = np.minimum(np.searchsorted(self.names, label), len(self.names) - 1)
        code = np.where(self.names[at] == label, at, -1)
        if same:
            fits = np.where(code[:, None] >= 0, self.holds[:, np.maximum(code, 0)].T, False)
        else:
            kinds = self.holds.sum(1)
            fits = kinds[None] > np.where(code[:, None] >= 0, self.holds[:, np.maximum(code, 0)].T, False)
        middle = (queries @ self.center.T)[owner]
        reach = norm[:, None] * self.radius[None] * (1 + 1e-9) + 1
        best, least = middle + reach, middle - reach
        alive = fits & (best >= low[:, None]) & (least <= high[:, None])
        for depth in range(1, int(self.level.max()) + 1):
            on = np.flatnonzero(self.level == depth)
            alive[:, on] &= alive[:, self.parent[on]]
        leaves = np.flatnonzero(self.start >= 0)
        bound = np.where(alive[:, leaves], np.minimum(best[:, leaves], high[:, None]), -np.inf)
        turn = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, turn, 1)
        top = np.full((n, k), NOTHING)
        top_id = np.full((n, k), NO_ID)
        for step in range(len(leaves)):
            going = np.flatnonzero((bound[:, step] > -np.inf) & (bound[:, step] >= top[:, -1]))
            if not len(going):
                break
            leaf_of = turn[going, step]
            for leaf in np.unique(leaf_of):
                w = going[leaf_of == leaf]
                self._visit(leaves[leaf], queries, owner, code, own, low, high, same, w, top, top_id)
        window, place = np.nonzero(top > NOTHING)
        return window, top_id[window, place], top[window, place]

    def _visit(self, node: int, queries, owner, code, own, low, high, same, w, top, top_id) -> None:
        """Score a leaf's rows for windows ``w`` and merge them into their best rows."""
        rows = slice(self.start[node], self.stop[node])
        asked, number = np.unique(owner[w], return_inverse=True)
        scores = inner_products(queries[asked], self.vectors[rows].astype(float))[number]
        if same:
            ok = (self.labels[rows][None] == code[w][:, None]) & (self.ids[rows][None] != own[w][:, None])
        else:
            ok = self.labels[rows][None] != code[w][:, None]
        ok &= (scores >= low[w][:, None]) & (scores <= high[w][:, None])
        k = top.shape[1]
        scores = np.concatenate([top[w], np.where(ok, scores, NOTHING)], 1)
        ids = np.concatenate([top_id[w], np.broadcast_to(self.ids[rows], (len(w), ok.shape[1]))], 1)
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        r, c = np.nonzero((scores >= least[:, None]) & (scores > NOTHING))
        s, i = scores[r, c], ids[r, c]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        top[w], top_id[w] = NOTHING, NO_ID
        top[w[r[keep]], rank[keep]] = s[keep]
        top_id[w[r[keep]], rank[keep]] = i[keep]


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as one array; shorter vectors count as filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(size), max(1, width, int(size.max(initial=0)))))
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]] if len(size) else np.zeros(0)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def _compact(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2 ** 15 else np.int32 if most < 2 ** 31 else np.float64)


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x.astype(float), ((0, 0), (0, max(0, width - x.shape[1]))))


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Separated rows of a bounded sample, chosen farthest first."""
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(PIVOT_SAMPLE).select("vector").toArrow()
    points = np.unique(_matrix(sample.column(0)), axis=0)
    wanted = min(n, MAX_PIVOTS, len(points))
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < wanted and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")), sent.value.shape[1])
            p = _widened(sent.value, x.shape[1])
            cell = ((p ** 2).sum(1)[None] - 2 * x @ p.T).argmin(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(deal, f"{rows._jdf.schema().toDDL()}, cell int")


def _plant(table: pa.Table) -> pa.Table:
    tree = CoverTree.build(_matrix(table["vector"]), _ids(table["id"].combine_chunks()), table["label"].to_numpy().astype(np.int64))
    tree.vectors, tree.center = _compact(tree.vectors), _compact(tree.center)
    return pa.table({"shard": table["shard"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """Trees of all rows (row, id, label, vector), and their number.

    A pivot's rows are dealt to as many trees as they fill, by row number, so copies of one vector do not meet
    in one task.
    """
    n = rows.count()
    pivots = _pivots(rows, -(-n // SHARD_ROWS))
    dealt = spool(_dealt(rows, pivots), "vectors")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    first, parts, total = {}, {}, 0
    for cell in sorted(sizes):
        first[cell], parts[cell] = total, -(-sizes[cell] // SHARD_ROWS)
        total += parts[cell]
    look = lambda d: F.element_at(F.create_map(*[F.lit(v) for c in d for v in (c, d[c])]), F.col("cell"))
    shard = (look(first) + F.pmod(F.xxhash64("row"), look(parts))).cast("int")
    trees = dealt.withColumn("shard", shard).groupBy("shard").applyInArrow(_plant, "shard int, tree binary")
    return spool(trees, "trees"), total


def _packed(queries: DataFrame, n_blocks: int) -> DataFrame:
    """Queries (row, id, label, vector, windows) in blocks, one row each."""
    def pack(table: pa.Table) -> pa.Table:
        wanted = table["windows"].to_pylist()
        owner = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        flat = [x for w in wanted for x in w]
        block = {
            "vectors": _compact(_matrix(table["vector"])), "row": table["row"].to_numpy(), "id": _ids(table["id"].combine_chunks()),
            "label": table["label"].to_numpy().astype(np.int64), "owner": owner, "place": np.array([x["place"] for x in flat], np.int32),
            "low": np.array([x["low"] for x in flat], np.int64), "high": np.array([x["high"] for x in flat], np.int64)}
        return pa.table({"block": table["block"][:1], "queries": pa.array([pickle.dumps(block)], pa.binary())})

    return (queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
            .groupBy("block").applyInArrow(pack, "block int, queries binary"))


def search(queries: DataFrame, n_queries: int, trees: DataFrame, n_trees: int, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of every window over all trees: (row, place, rank, id, score).

    Blocks of queries meet every tree; a tree gives at most ``k`` rows a window, which are ranked afterwards.
    """
    packed = spool(_packed(queries, max(1, -(-n_queries // BLOCK_ROWS))), "queries")
    parts = max(1, min(n_trees, 8192))
    met = (packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("shard"), "queries").repartition(parts, "shard")
           .join(trees.repartition(parts, "shard"), "shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, tree = pickle.loads(batch.column(0)[i].as_py()), pickle.loads(batch.column(1)[i].as_py())
                width = max(q["vectors"].shape[1], tree.vectors.shape[1])
                tree.vectors, tree.center = _widened(tree.vectors, width), _widened(tree.center, width)
                owner = q["owner"]
                window, ids, scores = tree.search(
                    _widened(q["vectors"], width), owner, q["label"][owner], q["id"][owner], q["low"], q["high"], same, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["row"][owner[window]]), pa.array(q["place"][window]),
                     pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
                    names=["row", "place", "id", "score"])

    found = met.select("queries", "tree").mapInArrow(run, "row long, place int, id long, score long")
    best_first = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _whole(x: Column, up: bool) -> Column:
    """Hundredths as whole numbers, rounded up or down."""
    down = F.floor(x / 100) if not up else F.ceil(x / 100)
    return down.cast("long")


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Hard negatives of every anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)`` and a score is an integer inner product, clipped to a long.  A positive is one of
    the first rows of the anchor's label with another id; a negative is one of the first rows
    of another label whose score lies between ``least`` and ``most`` per cent of the positive's.  Ties go to
    the smaller id, a NULL id last.  Rows without label or vector, or with a component that is NULL or not finite,
    take no part.  Repeated rows count each, so a repeated anchor gives its rows again.  Shorter vectors count as
    filled up with zeros.  Empty tables, anchors without positives and positives without negatives give no rows;
    further columns are left out.
    """
    blocks.limit_batches(rows.sparkSession)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ready = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asks"))
    kept = spool(ready, "vectors")
    asking = kept.filter("asks").drop("asks")
    n_asking = asking.count()
    if not n_asking:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees, n_trees = index(kept.drop("asks"))
    window = lambda place, low, high: F.struct(place.alias("place"), low.alias("low"), high.alias("high"))
    all_scores = F.array(window(F.lit(0), F.lit(int(NOTHING) + 1), F.lit(int(NO_ID))))
    near = spool(
        search(asking.withColumn("windows", all_scores), n_asking, trees, n_trees, True, positives)
        .select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    hundredths = F.col("positive_score").cast("decimal(38,0)")
    bounds = near.groupBy("row").agg(F.collect_list(
        window(F.col("place"), _whole(hundredths * least, True), _whole(hundredths * most, False))).alias("windows"))
    hard = search(asking.join(bounds, "row"), n_asking, trees, n_trees, False, negatives)
    named = near.join(asking.select("row", F.col("id").alias("anchor_id")), "row")
    return hard.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
