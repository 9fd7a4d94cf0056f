import math
import random

import numpy as np
import pytest

from tests.conftest import plan_of
from verdictflow.operators import quantiles, sampling


def scored(spark, pairs):
    return spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(pairs)], "submission_id int, pred int, logits double")


def expected(pairs, share):
    out = []
    for cls, q in ((0, share), (1, 1 - share)):
        values = [x for p, x in pairs if p == cls and x is not None and not math.isnan(x)]
        out.append(float(np.quantile(values, q)) if values else None)
    return out


def samples():
    rng = random.Random(3)
    normal = [(int(x > 0.5), x) for x in (rng.gauss(0, 1) for _ in range(4000))]
    heavy = [(0, rng.choice([1.0, 1.0, 2.0, rng.random()])) for _ in range(3000)]
    outliers = [(1, rng.random()) for _ in range(2000)] + [(1, 1e300), (1, -1e300)]
    constant = [(0, 7.0)] * 500 + [(1, 7.0)] * 3
    tiny = [(0, 1.0), (0, 2.0), (1, 5.0)]
    gaps = [(0, float("nan")), (0, None), (0, 3.0), (1, 4.0), (1, float("nan"))]
    return [normal, heavy, outliers, constant, tiny, gaps, []]


@pytest.mark.parametrize("case", range(7))
@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_thresholds_are_exact(spark, case, limit):
    pairs = samples()[case]
    for share in (0.1, 0.5, 0.0):
        df = scored(spark, pairs)
        got = quantiles.class_thresholds(df, share, gather_limit=limit, sketch_accuracy=50).first()
        for ours, wanted in zip(got, expected(pairs, share)):
            assert ours == wanted or ours == pytest.approx(wanted, rel=1e-14)


def test_equal_values_around_the_rank_are_not_rounded(spark):
    pairs = [(0, 0.1)] * 7 + [(1, 0.7)] * 8
    assert tuple(quantiles.class_thresholds(scored(spark, pairs), 0.3).first()) == (0.1, 0.7)
    assert sampling.confident_extremes(scored(spark, pairs), 0.3).count() == 0


def test_narrowing_leaves_few_rows_to_rank(spark):
    df = scored(spark, samples()[0])
    left = quantiles.class_thresholds(df, gather_limit=20, sketch_accuracy=50)
    # The ranked values carry the bounds found by the sketches.
    assert "score#" in plan_of(left)
    few = plan_of(left)
    assert ">=" in few and "<=" in few


def test_extremes_are_strict_and_ignore_nan(spark):
    pairs = [(0, float(i)) for i in range(11)] + [(1, float(i)) for i in range(100, 111)]
    pairs += [(0, float("nan")), (1, None)]
    got = sorted(r.logits for r in sampling.confident_extremes(scored(spark, pairs)).collect())
    assert got == [0.0, 110.0]


def test_an_empty_class_selects_nothing_on_its_side(spark):
    zeros = scored(spark, [(0, float(i)) for i in range(11)])
    assert [r.logits for r in sampling.confident_extremes(zeros).collect()] == [0.0]
    ones = scored(spark, [(1, float(i)) for i in range(11)])
    assert [r.logits for r in sampling.confident_extremes(ones).collect()] == [10.0]


def test_extremes_are_at_most_their_share(spark):
    rng = random.Random(11)
    pairs = [(int(x > 0.5), x) for x in (rng.gauss(0, 1) for _ in range(2000))]
    n = [sum(p == c for p, _ in pairs) for c in (0, 1)]
    got = sampling.confident_extremes(scored(spark, pairs), 0.1).count()
    assert 0 < got <= math.ceil(0.1 * n[0]) + math.ceil(0.1 * n[1])


def test_extremes_need_no_cross_join(spark):
    df = sampling.confident_extremes(scored(spark, samples()[0]))
    df.collect()
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Subquery" in plan


@pytest.mark.parametrize("case", range(7))
def test_halving_alone_is_exact_and_ends(spark, monkeypatch, case):
    """As if every sketch failed to narrow a class."""
    monkeypatch.setattr(quantiles, "_narrow", lambda rows, spans, accuracy: None)
    pairs = samples()[case]
    for share in (0.1, 0.5):
        got = quantiles.class_thresholds(scored(spark, pairs), share, gather_limit=20).first()
        for ours, wanted in zip(got, expected(pairs, share)):
            assert ours == wanted or ours == pytest.approx(wanted, rel=1e-14)


def test_whole_numbers_keep_the_order_of_doubles():
    values = [-math.inf, -1e300, -1.5, -0.0, 0.0, 1e-300, 2.0, math.inf]
    numbers = [quantiles._number(v) for v in values]
    assert numbers == sorted(numbers)
    assert [quantiles._double(n) for n in numbers] == values
