"""String expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions.money import col

UNIT_SEPARATOR = "\x1f"


def slice_key(category: Column | str, region_id: Column | str) -> Column:
    """File-safe key of a (category, region) slice."""
    raw = F.concat(col(category), F.lit("__"), col(region_id))
    return F.regexp_replace(raw, "[^0-9A-Za-z._-]+", "_")


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """sha256 over ``name=value`` pairs in name order; NULL hashes as empty text."""
    names = sorted(columns or df.columns)
    parts = [
        F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("")))
        for n in names
    ]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)


def same_text(c: Column | str, value: str) -> Column:
    """Case-insensitive equality; the value is data, never a pattern."""
    return F.lower(col(c)) == F.lower(F.lit(value))


def sample_order(id_column: Column | str, seed: int) -> Column:
    """Repeatable pseudo-random order key of a row."""
    return F.md5(F.concat(col(id_column), F.lit(f"#{seed}")))
