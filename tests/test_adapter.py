"""Each feed reaches the canonical contract through its spec."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators.adapter import CANONICAL, SPECS, Spec, adapt, compile_spec
from basketry.sources.feeds import FEED_SCHEMAS, read_feed


def landed(spark, source, row):
    return spark.createDataFrame([row], FEED_SCHEMAS[source]).withColumns({
        "source_system": F.lit(source), "batch_id": F.lit("batch_1"),
        "ingested_at": F.lit(dt.datetime(2026, 3, 10, 12, 0))})


def one(spark, source, row):
    df = adapt(landed(spark, source, row), source)
    assert df.columns == CANONICAL
    return df.first()


def test_us_dates_and_currency_text(spark):
    r = one(spark, "pos_system_a", ("A-1", "03/10/2026 14:30", "SKU-A", 3, "$19.99", 1.50, "STORE-PHYS"))
    assert (r.source_txn_id, r.txn_timestamp, r.unit_price, r.discount_amount, r.store_id) == (
        "A-1", dt.datetime(2026, 3, 10, 14, 30), 19.99, 1.5, "STORE-PHYS")


def test_thousands_separator_and_blanks(spark):
    assert one(spark, "pos_system_a", ("A", "03/10/2026 14:30", "S", 1, " $1,234.50 ", 0.0, "X")).unit_price == 1234.5
    assert one(spark, "pos_system_a", ("A", "03/10/2026 14:30", "S", 1, "free", 0.0, "X")).unit_price is None


def test_iso_dates_and_cents(spark):
    r = one(spark, "pos_system_b", ("B-1", "2026-03-10 08:15:00", "SKU-B", 2, 2599, 300, "STORE-PHYS"))
    assert (r.txn_timestamp, r.unit_price, r.discount_amount) == (dt.datetime(2026, 3, 10, 8, 15), 25.99, 3.0)


def test_foreign_currency_and_price_from_total(spark):
    r = one(spark, "online_channel", ("ONL-1", "2026-03-10T19:45:00", "SKU-A", 4, 100.0, 10.0, "CAD", "STORE-ONL"))
    assert r.unit_price == 18.25 and r.discount_amount == pytest.approx(7.3)
    assert r.txn_timestamp == dt.datetime(2026, 3, 10, 19, 45)


def test_zero_quantity_has_no_price(spark):
    assert one(spark, "online_channel", ("O", "2026-03-10T19:45:00", "S", 0, 100.0, 0.0, "CAD", "X")).unit_price is None


def test_bad_date_is_null_and_missing_discount_is_zero(spark):
    r = one(spark, "pos_system_a", ("A-bad", "not-a-date", "SKU-A", 1, "$5.00", None, "STORE-PHYS"))
    assert r.txn_timestamp is None and r.discount_amount == 0.0


def test_unpadded_dates_and_nan(spark):
    r = one(spark, "pos_system_a", ("A", "3/1/2026 9:05", "S", 1, "$NaN", float("nan"), "X"))
    assert r.txn_timestamp == dt.datetime(2026, 3, 1, 9, 5) and r.unit_price is None and r.discount_amount == 0.0
    assert one(spark, "pos_system_a", ("A", "13/01/2026 09:05", "S", 1, "$1", 0.0, "X")).txn_timestamp is None


def test_specs_are_checked_before_any_job():
    with pytest.raises(ValueError, match="unknown transform"):
        compile_spec(Spec("x", {"sku": "s"}, {"sku": {"type": "nope"}}), "x")
    with pytest.raises(ValueError, match="spec is for"):
        compile_spec(SPECS["pos_system_a"], "pos_system_b")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_feed_files_keep_their_declared_schema(spark, tmp_path, fmt):
    rows = [("A-1", "03/10/2026 14:30", "SKU-A", 3, "$19.99", 1.5, "S"), ("A-2", "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, FEED_SCHEMAS["pos_system_a"])
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(str(tmp_path / fmt))
    back = read_feed(spark, "pos_system_a", str(tmp_path / fmt), fmt)
    assert back.schema == FEED_SCHEMAS["pos_system_a"] and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_malformed_fields_become_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("txn_id,ts,sku,qty,unit_price,disc,store_id\nA,03/10/2026 10:00,S,many,$1,0.5,X\n")
    r = read_feed(spark, "pos_system_a", str(tmp_path / "a.csv")).first()
    assert r.qty is None and r.txn_id == "A" and r.disc == 0.5


FOURTH = {"source": "kiosk", "fields": {"source_txn_id": "no", "txn_timestamp": "at", "sku": "item", "quantity": "n", "unit_price": "each",
                                        "discount_amount": "off", "store_id": "shop"},
          "transforms": {"txn_timestamp": {"type": "datetime", "format": "yyyyMMdd HHmm"}, "unit_price": {"type": "currency_string", "strip": "EUR"}}}


def test_a_fourth_feed_is_a_file(spark, lake, dims, tmp_path):
    import json

    from conftest import MONTH, NOW

    from basketry.operators.adapter import adapt_all, load_specs
    from basketry.plans import months

    (tmp_path / "kiosk.json").write_text(json.dumps(FOURTH))
    specs = load_specs(tmp_path)
    feed = spark.createDataFrame([("1", "20260310 1405", "SKU-A", 2, "EUR 1,250.50", None, "STORE-PHYS"), ("2", "x", "SKU-A", 1, "1", 0.0, "STORE-PHYS")],
                                 "no string, at string, item string, n int, each string, off double, shop string")
    run = months.run_month(spark, lake, {"kiosk": feed}, MONTH, *dims, NOW, specs)
    assert (run["rows_in"], run["rows_loaded"], run["rows_rejected"], run["rows_promoted"]) == (2, 1, 1, 1)
    with pytest.raises(ValueError, match="landed without each, off"):
        adapt_all({"kiosk": feed.drop("each", "off")}, specs=specs)
    with pytest.raises(ValueError, match="no spec"):
        adapt_all({"kiosk": feed})


@pytest.mark.parametrize("change, fault", [
    ("{", "not JSON"), ("[]", "no source"), ({"source": ""}, "no source"), ({"fields": []}, "objects"), ({"transforms": {"sku": 1}}, "objects"),
    ({"extra": 1}, "unknown key 'extra'"), ({"fields": {"colour": "c"}}, "unknown column 'colour'.*no source for 'sku'"),
    ({"fields": {**FOURTH["fields"], "sku": 3}}, "'sku' needs the name"), ({"transforms": {"sku": {"type": "magic"}}}, "unknown transform 'magic'"),
    ({"transforms": {"txn_timestamp": {"type": "datetime"}}}, "lacks 'format'"), ({"transforms": {"unit_price": {"type": "cents", "by": 2}}}, "unknown 'by'")])
def test_faults_of_a_spec_are_named_when_it_is_loaded(change, fault):
    import json

    from basketry.operators.adapter import parse_spec

    with pytest.raises(ValueError, match=fault):
        parse_spec(change if isinstance(change, str) else json.dumps({**FOURTH, **change}))


def test_built_in_specs():
    from basketry.operators.adapter import SPECS

    assert set(SPECS) == {"pos_system_a", "pos_system_b", "online_channel"}


def test_corrupt_records_keep_file_and_line(spark, tmp_path):
    from basketry.sources.feeds import read_feed_checked

    csv = tmp_path / "b.csv"
    csv.write_text("transaction_ref,sale_dt,item_code,units,price_cents,discount_cents,location\n"
                   "T1,2026-03-01 10:00:00,A,2,100,0,S\nT2,2026-03-01 10:00:00,A,many,100,0,S\nT3,short\nT4,2026-03-01 10:00:00,A,,100,0,S\n")
    rows = {r.transaction_ref: r for r in read_feed_checked(spark, "pos_system_b", str(csv), "csv").collect()}
    assert rows["T1"].raw_line is rows["T1"].raw_file is rows["T4"].raw_line is None and rows["T4"].units is None
    assert rows["T2"].raw_line == "T2,2026-03-01 10:00:00,A,many,100,0,S" and rows["T2"].raw_file.endswith("b.csv")
    assert rows["T2"].price_cents == 100 and rows["T3"].raw_line == "T3,short"

    json_file = tmp_path / "o.json"
    json_file.write_text('{"order_id":"O1","qty_ordered":1}\n{"order_id":"O2","qty_ord\n{"order_id":"O3","qty_ordered":"x"}\nno json\n')
    got = read_feed_checked(spark, "online_channel", str(json_file), "json").collect()
    assert sorted(r.raw_line for r in got if r.raw_line) == ['no json', '{"order_id":"O2","qty_ord', '{"order_id":"O3","qty_ordered":"x"}']
    with pytest.raises(ValueError, match="unknown feed format"):
        read_feed_checked(spark, "online_channel", "x", "xml")


def test_corrupt_records_are_quarantined_beside_sound_feeds(spark, dims, lake, canonical):
    from conftest import MONTH, NOW

    from basketry.operators import silver as S

    sound = canonical([{}, {"source_txn_id": "B", "quantity": -1.0}])
    broken = canonical([{"source_txn_id": "C"}]).withColumns({"raw_file": F.lit("f.csv"), "raw_line": F.lit("C,?")})
    run = S.process_batch(spark, lake, sound.unionByName(broken, allowMissingColumns=True), dims[0], MONTH, "r", NOW)
    assert (run["rows_in"], run["rows_loaded"], run["rows_rejected"], run["status"]) == (3, 1, 2, "ok")
    kept = {r.source_txn_id: (r.reject_reason, r.raw_file, r.raw_line) for r in spark.read.parquet(lake.rejected).collect()}
    assert kept == {"B": ("quantity:quantity_not_positive", None, None), "C": ("record:corrupt", "f.csv", "C,?")}
