"""Split running totals, medians and modes against brute force."""
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.operators.ordered import exact_medians, modes, quantiles, ranked_values, running_totals


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 7])
def test_running_totals_over_many_buckets(spark, descending, buckets):
    rng = random.Random(3)
    values = {(g, round(rng.gauss(0, 100), 2)): rng.randrange(1, 9) for g in "ab" for _ in range(300)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in values.items()], "g string, v double, n int")
    got = running_totals(df, "v", ["n"], ["g"], descending, buckets).collect()
    assert len(got) == len(values)
    for g in "ab":
        total = 0
        for v in sorted((v for h, v in values if h == g), reverse=descending):
            total += values[g, v]
            row = next(r for r in got if r.g == g and r.v == v)
            assert row.n_upto == total
        assert {r.n_all for r in got if r.g == g} == {total}


@pytest.mark.parametrize("buckets", [1, 5])
def test_medians_with_hot_values_and_nulls(spark, buckets):
    rng = random.Random(5)
    rows = []
    for g in ("odd", "even", "one"):
        n = {"odd": 301, "even": 300, "one": 1}[g]
        for i in range(n):
            rows.append((g, 50.0 if i % 3 == 0 else round(rng.uniform(0, 100), 2), None if i % 10 == 1 else float(i)))
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.x, r.y) for r in exact_medians(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, buckets).collect()}
    for g in got:
        assert got[g][0] == pytest.approx(statistics.median(x for h, x, _ in rows if h == g), abs=1e-6)
        assert got[g][1] == pytest.approx(statistics.median(y for h, _, y in rows if h == g and y is not None), abs=1e-6)


def test_median_of_the_whole_table(spark):
    df = spark.range(1, 8).withColumn("v", F.col("id") * 1.5)
    assert exact_medians(df, [], {"m": F.col("v")}, 3).first().m == 6.0


def test_mode_ties_go_to_the_smallest(spark):
    rng = random.Random(1)
    rows = [(rng.choice("gh"), rng.choice(["x", "y", "z", None])) for _ in range(200)] + [("t", "b"), ("t", "a")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = dict(modes(df, ["g"], F.col("v"), "m").collect())
    for g in got:
        counts = Counter(v for h, v in rows if h == g and v)
        assert got[g] == min(counts, key=lambda v: (-counts[v], v))
    assert got["t"] == "a"


@pytest.mark.parametrize("buckets", [1, 5])
def test_quantiles_in_one_pass_are_those_of_percentile(spark, buckets):
    rng = random.Random(9)
    for size in (1, 2, 7, 400):
        values = [round(rng.gauss(0, 5), 1) for _ in range(size)]
        values += [3.0] * (size // 3)  # a hot value
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v double")
        shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
        n, got = quantiles(ranked_values(df, F.col("v"), buckets), shares)
        want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
        assert n == len(values) and [got[s] for s in shares] == pytest.approx(want, abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert quantiles(ranked_values(empty, F.col("v")), [0.5]) == (0, {})
