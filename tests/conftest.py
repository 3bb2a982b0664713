"""Shared session and the small retail fixture: two SKUs, two stores, one region."""
from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry.operators.silver import Lake  # noqa: E402
from basketry.session import local_session  # noqa: E402
from basketry.sources.star import calendar_dim  # noqa: E402

MONTH = dt.date(2026, 3, 1)
NOW = dt.datetime(2026, 3, 31, 12, 0)

CANONICAL_DDL = (
    "source_system string, source_txn_id string, txn_timestamp timestamp, sku string, quantity double, "
    "unit_price double, discount_amount double, store_id string, batch_id string, ingested_at timestamp, ingest_seq bigint"
)


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, 8)


@pytest.fixture()
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


@pytest.fixture(scope="session")
def dims(spark):
    product = spark.createDataFrame(
        [("SKU-A", "Product 0", "Electronics", "TestBrand", 10.0), ("SKU-B", "Product 1", "Electronics", "TestBrand", 11.0)],
        "sku_id string, product_name string, category string, brand string, list_price double")
    store = spark.createDataFrame(
        [("STORE-PHYS", "physical", "REGION-T"), ("STORE-ONL", "online", "REGION-T")],
        "store_id string, store_type string, region_id string")
    return product, store, calendar_dim(spark, dt.date(2026, 2, 1), dt.date(2026, 3, 31))


@pytest.fixture(scope="session")
def canonical(spark):
    """Rows with defaults; a test names only the fields it cares about."""
    def make(rows):
        out = []
        for i, r in enumerate(rows):
            base = {
                "source_system": "pos_system_a", "source_txn_id": f"T-{i:04d}",
                "txn_timestamp": dt.datetime(2026, 3, 10, 9, 30), "sku": "SKU-A", "quantity": 2.0, "unit_price": 10.0,
                "discount_amount": 0.0, "store_id": "STORE-PHYS", "batch_id": "batch_1",
                "ingested_at": dt.datetime(2026, 3, 10, 12, 0), "ingest_seq": i,
            }
            out.append({**base, **r})
        names = [c.split()[0] for c in CANONICAL_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in out], CANONICAL_DDL)
    return make
