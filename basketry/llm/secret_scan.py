"""Secrets told apart by corpus-wide ownership; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.session import spool

#: Patterns of the base kinds and of the kind that ownership adds, in the order of the result.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "owned": r"[A-Za-z0-9+/_-]{20,}",
}
BASE = ("assign", "access", "hex")
#: A value seen under this many owners is a copied example.
EXAMPLE_OWNERS = 3
MASK = "[secret]"


def _value(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match


def _long_enough(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(_value(kind, match)) >= 6
    if kind == "access":
        return F.length(match) >= 20
    if kind == "owned":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def looks_live(value: Column) -> Column:
    """Long, with a digit and a letter, many different characters, and no placeholder word."""
    return (
        (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & ~value.rlike("(?i)example|sample|dummy|placeholder|changeme|x{4}|0{6}|1234567")
    )


def _rows_with_pieces(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """One narrow row per document: per kind, its matches and the lengths of what lies between.

    Positions follow from the two lists, so the text is read by three or four regular
    expressions and never leaves this stage.  A pattern is only split where it matches at all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = []
    for kind, pattern in PATTERNS.items():
        found = F.when(t.rlike(pattern), F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split(t, pattern, -1), lambda p: F.length(p)).alias("gaps"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("matches"),
        ))
        kinds.append(found)
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("_owner"), F.md5(t).alias("_text_key"),
        F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("_kinds"),
    )


def _candidates(rows: DataFrame) -> DataFrame:
    """Positions of every match, by a running sum over the pieces of a document and kind."""
    pieces = rows.select("_row", "doc_id", "_owner", "_text_key", F.explode("_kinds").alias("k")).select(
        "_row", "doc_id", "_owner", "_text_key", F.col("k.kind").alias("kind"),
        F.posexplode(F.arrays_zip(F.col("k.gaps").alias("gap"), F.col("k.matches").alias("match"))).alias("_at", "z"))
    pieces = pieces.select("_row", "doc_id", "_owner", "_text_key", "kind", "_at", "z.gap", "z.match").filter("match is not null")
    upto = Window.partitionBy("_row", "kind").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    placed = pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    keep, value = F.lit(False), F.lit(None).cast("string")
    for kind in PATTERNS:
        this = F.col("kind") == kind
        keep = keep | (this & _long_enough(kind, F.col("match")))
        value = F.when(this, _value(kind, F.col("match"))).otherwise(value)
    return placed.filter(keep).select(
        "_row", "doc_id", "_owner", "_text_key", "kind", "start", "end",
        value.alias("_value"), F.sha2(value, 256).alias("value_hash"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories (documents) of every value, hot values included.

    Repeats go before each count: first equal sightings, then sightings of one owner.
    """
    sightings = candidates.select("value_hash", "_owner", "_text_key").distinct()
    by_owner = sightings.groupBy("value_hash", "_owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.count("_owner").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _classified(docs: DataFrame, text: str, doc_id: str, source: str) -> tuple[DataFrame, DataFrame]:
    rows = spool(_rows_with_pieces(docs, text, doc_id, source), "secret-rows")
    found = spool(_candidates(rows), "secret-spans")
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
        .when(looks_live(F.col("_value")), "live").otherwise("weak")
    )
    spans = found.join(ownership(found), "value_hash").withColumn("verdict", verdict)
    return rows, spans.filter(F.col("kind").isin(*BASE) | (F.col("verdict") == "live"))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id`` and ``secrets`` of every row of ``docs``: spans by start, then kind.

    A secret has kind, start, end (code points, end exclusive), value_hash, n_owners,
    n_repositories and verdict: ``example`` for a value that at least ``EXAMPLE_OWNERS`` sources
    hold, else ``live`` for one that looks like a credential, else ``weak``.  The owner is the
    document's source, a repository a distinct text, so copies of one file count once.
    Besides the base kinds, long mixed strings of few owners are spans of the kind ``owned``.

    NULL and empty texts have no secrets; a NULL source owns values but counts as no owner;
    repeated rows and ids keep a row each.
    """
    rows, spans = _classified(docs, text, doc_id, source)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (k, i)]), F.col("kind"))
    lists = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank.alias("rank"), "kind", "end", "value_hash", "n_owners", "n_repositories", "verdict"))).alias("secrets"))
    none = F.array().cast(lists.schema["secrets"].dataType)
    return rows.select("_row", "doc_id").join(lists, "_row", "left").select(
        "doc_id", F.coalesce("secrets", none).alias("secrets"))


def _swap(kind: str):
    """What lies before a match, and the match with its value masked where the value is live."""
    def swap(gap: Column, match: Column) -> Column:
        value = _value(kind, match)
        hidden = F.concat(F.substring(match, F.lit(1), F.length(match) - F.length(value)), F.lit(MASK))
        return F.concat(gap, F.coalesce(F.when(F.array_contains("_mask_values", value), hidden).otherwise(match), F.lit("")))
    return swap


def mask_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with every live value replaced by ``MASK``; all rows and columns stay.

    Copied examples and weak values stay as they are.  Masks go by text, so equal texts are
    masked alike.
    """
    _, spans = _classified(docs, text, doc_id, source)
    live = spans.filter("verdict = 'live'").groupBy(F.col("_text_key").alias("_mask_key")).agg(F.collect_set("_value").alias("_mask_values"))
    keyed = docs.withColumn("_mask_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(live, "_mask_key", "left")
    masked = F.col(text)
    for kind, pattern in PATTERNS.items():
        pieces = F.zip_with(
            F.split(masked, pattern, -1), F.regexp_extract_all(masked, F.lit(pattern), F.lit(0)), _swap(kind))
        joined = joined.withColumn("_masked", F.array_join(pieces, ""))
        masked = F.col("_masked")
    clean = F.when(F.col("_mask_values").isNull(), F.col(text)).otherwise(masked)
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
