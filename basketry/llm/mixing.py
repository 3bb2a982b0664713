"""Mixing sources to target weights: random keys, distributed prefix sums, exact cuts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketry.session import spool

#: Word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the random key that name a bucket; buckets only divide the sorting work.
BUCKET_DIGITS = 3


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` words per source from ``(_source, source_size)``.

    Sources take the weights in turn by code point, NULL last (``_source`` sorts that way).  A
    share above ``max_epochs`` times its source stops there and the rest is shared again by
    weight: sorted by the level at which they stop, the first source that does not stop fixes
    the level of all after it.  One row per source, so plain windows serve.
    """
    ranked = totals.withColumn("_i", F.row_number().over(Window.orderBy("_source")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    rows = (
        ranked.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_stop", F.col("_cap") / F.col("_w"))
    )
    rising = Window.orderBy("_stop", "_i")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward)
    rows = rows.withColumn("_level", level)
    stops = F.col("_stop") < F.col("_level")
    final = F.max(F.when(~stops, F.col("_level"))).over(everything)
    return rows.select(
        "_source", "source_size",
        F.when(stops, F.col("_cap").cast("double")).otherwise(final * F.col("_w")).alias("target"),
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    Rows get a random key from a hash of the seed, the source and the id.  The key's first digits are a
    bucket of its source, equally full by construction, so a source with a third of all rows is
    sorted by as many tasks as there are buckets.  Bucket totals give each bucket its offset, a
    window inside it the running total: a distributed prefix sum.  Every document is taken in
    each full epoch of its source; the remaining budget is cut at the exact word, so the last
    document may be taken in part and the words taken add up to the whole part of the target.

    Empty and NULL texts have size 0.  NULL sources are one source, sorted last.  Rows alike in
    id and source keep an order by their text; equal rows may swap, which shows nowhere.
    Columns of ``docs`` that carry one of the new names are replaced; all others pass, whatever their names.
    """
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*[c for c in docs.columns if c in added])
    # Columns go by their place meanwhile, so that none can clash with a working column.
    names, places = docs.columns, [f"u{i}" for i in range(len(docs.columns))]
    docs, place_of = docs.toDF(*places), {c.lower(): p for c, p in zip(names, places)}
    text, source, doc_id = (place_of[c.lower()] for c in (text, source, doc_id))
    keyed = docs.select(
        "*",
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string"))).alias("_source"),
    ).withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_source")))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))

    sums = spool(keyed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    plan = (
        offsets.join(targets, "_source")
        .withColumn("_budget", F.floor("target"))
        .withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("_budget") - F.col("_full") * F.col("source_size"))
    )
    inside = (
        Window.partitionBy("_source", "_bucket").orderBy("_key", F.xxhash64(text))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, ["_source", "_bucket"])
    part = F.greatest(F.least(F.col("_rest") - F.col("_offset") - F.col("_before"), F.col("size")), F.lit(0))
    return joined.select(
        *[F.col(p).alias(c) for p, c in zip(places, names)], "size", "source_size", "target",
        (F.col("_full") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, once each, with ``taken``; a trainer repeats them by it."""
    return mix(docs, **options).filter("taken > 0").select(*[c for c in docs.columns if c != "taken"], "taken")
