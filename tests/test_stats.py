import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from verdictflow.operators import sets, stats
from verdictflow.schemas import HISTORY

D = date


def flags(spark, values):
    return spark.createDataFrame([(v,) for v in values], "accurate int")


def test_binomial_stats(spark):
    row = stats.binomial_stats(flags(spark, [1, 0, 1, None]), "accurate").first()
    assert (row.success, row.n, row.rate) == (2, 4, 0.5)
    assert row.sd_prop == 0.5
    assert row.sd_n == pytest.approx(1.0)
    assert row.se == pytest.approx(math.sqrt(0.25 / 4))


def test_binomial_stats_at_the_ends(spark):
    empty = stats.binomial_stats(flags(spark, []), "accurate").first()
    assert (empty.success, empty.n, empty.rate, empty.se) == (0, 0, None, None)
    for value in (0, 1):
        row = stats.binomial_stats(flags(spark, [value] * 3), "accurate").first()
        assert (row.rate, row.se) == (value, 0.0)


def test_count_table_leaves_null_out(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 1.0, 0.0, None]], "outcome double")
    got = {r.outcome: (r.n, r.share) for r in stats.count_table(df, "outcome").collect()}
    assert got == {1.0: (2, "66.7%"), 0.0: (1, "33.3%")}


def test_confusion_matrix(spark):
    rows = [(1.0, 1), (1.0, 0), (0.0, 0), (2.0, 1), (None, 1), (1.0, None)]
    df = spark.createDataFrame(rows, "outcome double, pred int")
    got = {r.outcome: (r.predicted_0, r.predicted_1) for r in stats.confusion_matrix(df).collect()}
    assert got == {1.0: (1, 1), 0.0: (1, 0), 2.0: (0, 1)}


def test_verdict_counts(make_posts):
    flairs = [None, "", "nta", "YTA", "Asshole", "META", "ESH"]
    posts = make_posts([(i, "t", "b", f, i) for i, f in enumerate(flairs)])
    assert tuple(stats.verdict_counts(posts).first()) == (7, 2, 1)


def test_accuracy_summary(spark):
    rows = [(1.0, 1, D(2024, 1, 2)), (1.0, 0, D(2024, 1, 3)), (2.0, 0, D(2024, 1, 4))]
    df = spark.createDataFrame(rows, "outcome double, accurate int, post_date date")
    sampled = df.filter("outcome = 1")
    got = {r.outcome_type: r for r in stats.accuracy_summary(sampled, df, "2024-02-01").collect()}
    assert (got["Total"].success, got["Total"].n, got["Total"].rate) == (1, 2, 0.5)
    assert (got["YTA"].success, got["YTA"].n) == (1, 2)
    assert (got["NTA"].success, got["NTA"].n, got["NTA"].rate) == (0, 0, None)
    assert all(r.date == D(2024, 2, 1) for r in got.values())
    assert all(r.min_post_date == D(2024, 1, 2) for r in got.values())
    assert all(r.max_post_date == D(2024, 1, 4) for r in got.values())


def history(spark, rates):
    rows = [
        (D(2024, 1, i + 1), kind, 0, 1, rate, 0.0, None, None)
        for i, rate in enumerate(rates)
        for kind in ("Total", "YTA")
    ]
    return spark.createDataFrame(rows, HISTORY)


def test_control_limits(spark):
    one = stats.control_limits(history(spark, [0.5])).first()
    assert (one.mean_rate, one.sd_rate, one.ucl) == (0.5, None, None)
    two = stats.control_limits(history(spark, [0.4, 0.6])).first()
    sd = math.sqrt(0.02)
    assert two.ucl == pytest.approx(0.5 + 3 * sd) and two.lcl == pytest.approx(0.5 - 3 * sd)
    chart = stats.control_chart(history(spark, [0.4, 0.6]))
    assert chart.count() == 2 and "NestedLoop" not in plan_of(chart)


def test_history_upsert(spark):
    old = history(spark, [0.1, 0.2])
    new = history(spark, [0.9]).withColumn("date", F.lit("2024-01-02").cast("date"))
    fresh = new.withColumn("date", F.lit("2024-01-09").cast("date"))

    def rates(df):
        return sorted((str(r.date), r.rate) for r in df.filter("outcome_type = 'Total'").collect())

    assert rates(sets.history_upsert(old, new)) == [("2024-01-01", 0.1), ("2024-01-02", 0.9)]
    kept = sets.history_upsert(old, new, overwrite_day=False)
    assert rates(kept) == [("2024-01-01", 0.1), ("2024-01-02", 0.2)]
    for overwrite in (True, False):
        assert len(rates(sets.history_upsert(old, fresh, overwrite))) == 3
        assert len(rates(sets.history_upsert(old.limit(0), new, overwrite))) == 1


def test_union_distinct_aligns_columns_and_matches_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "id int, s string")
    b = spark.createDataFrame([(None, 1), ("y", 3)], "s string, id int")
    got = sorted((r.id, r.s) for r in sets.union_distinct(a, b).collect())
    assert got == [(1, None), (2, "x"), (3, "y")]
    missing = spark.createDataFrame([(1,)], "id int")
    assert sets.union_distinct(a, missing).count() == 2
    assert sets.union_all(a, b).count() == 5


def test_mean_accuracy(spark):
    df = spark.createDataFrame([(1, 1, "val"), (0, 1, "val"), (0, 0, "test")], "pred int, label int, split string")
    got = {r.split: (r.n, r.accuracy) for r in stats.mean_accuracy(df, by=["split"]).collect()}
    assert got == {"val": (2, 0.5), "test": (1, 1.0)}
