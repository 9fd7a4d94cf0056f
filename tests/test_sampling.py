import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from verdictflow.operators import sampling


def key(number, seed):
    return hashlib.md5(f"{number}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    return [(i, rng.choice([0, 1, 1, 1, None])) for i in range(6000)]


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, "submission_id int, label int")


def by_class(rows, seed):
    groups = {}
    for number, label in rows:
        groups.setdefault(label, []).append(number)
    return {c: sorted(g, key=lambda n: key(n, seed)) for c, g in groups.items()}


def test_balanced_sample(frame, rows):
    groups = by_class(rows, 4)
    for n in (1, 500, 2000, 10**9):
        got = {r.submission_id for r in sampling.balanced_sample(frame, "label", n, seed=4).collect()}
        assert got == {i for c, g in groups.items() if c is not None for i in g[:n]}
    assert sampling.balanced_sample(frame, "label", 0, seed=4).count() == 0


def test_balanced_sample_with_a_counted_size(frame, rows):
    n = frame.agg(F.count_if(F.col("label") == 0)).scalar()
    got = sampling.balanced_sample(frame, "label", n).groupBy("label").count().collect()
    zeros = sum(label == 0 for _, label in rows)
    assert {r["label"]: r["count"] for r in got} == {0: zeros, 1: zeros}


def test_stratified_split_is_a_partition_with_the_right_sizes(frame, rows):
    got = {r.submission_id: r.split for r in sampling.stratified_split(frame, "label").collect()}
    assert len(got) == len(rows)
    for group in by_class(rows, 42).values():
        hold = math.ceil(len(group) * 0.132865)
        val = hold // 2
        want = ["val"] * val + ["test"] * (hold - val) + ["train"] * (len(group) - hold)
        assert [got[i] for i in group] == want


def test_stratified_subsample(frame, rows):
    got = {r.submission_id for r in sampling.stratified_subsample(frame, "label", 0.3).collect()}
    want = set()
    for group in by_class(rows, 42).values():
        want |= set(group[math.ceil(len(group) * 0.3) :])
    assert got == want


def test_small_and_single_strata(spark):
    frame = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "submission_id int, label int")
    split = sampling.stratified_split(frame, "label").collect()
    assert len(split) == 3
    assert sampling.balanced_sample(frame, "label", 1).count() == 2


def test_the_split_shuffles_no_text(frame):
    wide = frame.withColumn("text", F.repeat(F.lit("x"), 50))
    plan = plan_of(sampling.stratified_split(wide, "label"))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("text" in line for line in exchanges)


def test_sample_n(frame, rows):
    order = sorted((n for n, _ in rows), key=lambda n: key(n, 9))
    got = [r.submission_id for r in sampling.sample_n(frame, 5, seed=9).collect()]
    assert got == order[:5]
    assert sampling.sample_n(frame, 10**6).count() == len(rows)


def test_ranked_order(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 0.5)], "submission_id int, logits double")
    assert [r.submission_id for r in sampling.ranked(df).collect()] == [2, 1, 3]
