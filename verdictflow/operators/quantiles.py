"""Exact score thresholds per predicted class, without gathering a class in one task."""

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.scores import without_nan

SKETCH_ACCURACY = 2000
GATHER_LIMIT = 1_000_000


@dataclass
class _Span:
    """Where the wanted order statistics of a class lie: ranks `rank` and `rank + 1`."""

    cls: int
    n: int
    rank: int
    fraction: float
    below_hi: int  # rows < hi
    lo: float | None = None
    hi: float | None = None
    below: int = 0  # rows < lo
    up_to_lo: int = 0  # rows <= lo

    @property
    def inside(self):
        """Rows strictly between lo and hi."""
        return max(self.below_hi - self.up_to_lo, 0)

    def strictly_inside(self, score):
        inside = F.lit(True)
        if self.lo is not None:
            inside &= score > self.lo
        if self.hi is not None:
            inside &= score < self.hi
        return inside

    def within(self, score):
        within = F.lit(True)
        if self.lo is not None:
            within &= score >= self.lo
        if self.hi is not None:
            within &= score <= self.hi
        return within


def class_thresholds(
    df: DataFrame,
    share=0.1,
    class_col="pred",
    score_col="logits",
    gather_limit=GATHER_LIMIT,
    sketch_accuracy=SKETCH_ACCURACY,
) -> DataFrame:
    """One row (t0, t1): the `share` quantile of the scores of class 0 and the
    `1 - share` quantile of class 1, linearly interpolated; NULL for an empty class.

    Up to `gather_limit` rows are ranked at once. A larger class is narrowed first:
    a bounded quantile sketch brackets the wanted rank, a count checks the bracket,
    and so on until few rows lie inside. Every pass reads two columns and returns
    one row; the sketch never decides the result, only what is left to rank.
    """
    score = without_nan(F.col(score_col))
    rows = df.select(F.col(class_col).alias("cls"), score.alias("score")).filter(
        F.col("cls").isin(0, 1) & F.col("score").isNotNull()
    )
    sizes = rows.agg(
        F.count_if(F.col("cls") == 0).alias("n0"), F.count_if(F.col("cls") == 1).alias("n1")
    ).first()
    spans = []
    for cls, n, wanted in ((0, sizes.n0, share), (1, sizes.n1, 1 - share)):
        if n:
            place = (n - 1) * wanted
            spans.append(_Span(cls, n, math.floor(place), place - math.floor(place), n))
    while wide := [span for span in spans if span.inside > gather_limit]:
        before = {span.cls: span.inside for span in wide}
        _narrow(rows, wide, sketch_accuracy)
        # Where the sketch gains too little, halve the range of values by a count. There are
        # 64 bits to a double, so this ends whatever the distribution.
        slow = [span for span in wide if span.inside > max(gather_limit, before[span.cls] / 2)]
        if slow:
            _halve(rows, slow)
    return _rank_inside(rows, spans)


def _number(value: float) -> int:
    """Doubles as whole numbers of the same order."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(number: int) -> float:
    bits = number if number >= 0 else -number | -(2**63)
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _halve(rows, spans):
    """Move an end of each span to the middle of its values, counted as doubles."""
    score = F.col("score")
    middles = []
    for span in spans:
        lo = _number(-math.inf if span.lo is None else span.lo)
        hi = _number(math.inf if span.hi is None else span.hi)
        middles.append(_double((lo + hi) // 2))
    checks = []
    for i, (span, mid) in enumerate(zip(spans, middles)):
        mine = F.col("cls") == span.cls
        checks += [
            F.count_if(mine & (score < mid)).alias(f"below{i}"),
            F.count_if(mine & (score <= mid)).alias(f"up_to{i}"),
            F.max(F.when(mine & (score < mid), score)).alias(f"left{i}"),
            F.min(F.when(mine & (score > mid), score)).alias(f"right{i}"),
        ]
    found = rows.agg(*checks).first()
    for i, (span, mid) in enumerate(zip(spans, middles)):
        below, up_to = found[f"below{i}"], found[f"up_to{i}"]
        if below <= span.rank:
            span.lo, span.below, span.up_to_lo = mid, below, up_to
        if up_to >= min(span.rank + 2, span.n):
            span.hi, span.below_hi = mid, below
        if below > span.rank and up_to < min(span.rank + 2, span.n):
            # The wanted ranks lie left and right of the middle: nothing is between them.
            left, right = found[f"left{i}"], found[f"right{i}"]
            last = F.col("cls") == span.cls
            counts = rows.agg(F.count_if(last & (score < left)).alias("n")).first()
            span.lo, span.below, span.up_to_lo = left, counts["n"], below
            span.hi, span.below_hi = right, below


def _narrow(rows, spans, accuracy):
    score = F.col("score")
    wanted = []
    for i, span in enumerate(spans):
        slack = 3 * span.inside / accuracy
        place = span.rank - span.up_to_lo
        ends = [(place - slack) / span.inside, (place + 2 + slack) / span.inside]
        member = (F.col("cls") == span.cls) & span.strictly_inside(score)
        wanted.append(
            F.percentile_approx(
                F.when(member, score), [min(max(e, 0.0), 1.0) for e in ends], accuracy
            ).alias(f"s{i}")
        )
    sketch = rows.agg(*wanted).first()

    checks = []
    for i, span in enumerate(spans):
        lo, hi = sketch[f"s{i}"]
        mine = F.col("cls") == span.cls
        checks += [
            F.count_if(mine & (score < lo)).alias(f"below{i}"),
            F.count_if(mine & (score <= lo)).alias(f"up_to_lo{i}"),
            F.count_if(mine & (score < hi)).alias(f"below_hi{i}"),
            F.count_if(mine & (score <= hi)).alias(f"up_to_hi{i}"),
        ]
    counts = rows.agg(*checks).first()
    for i, span in enumerate(spans):
        lo, hi = sketch[f"s{i}"]
        if counts[f"below{i}"] <= span.rank:
            span.lo, span.below = lo, counts[f"below{i}"]
            span.up_to_lo = counts[f"up_to_lo{i}"]
        if counts[f"up_to_hi{i}"] >= min(span.rank + 2, span.n):
            span.hi, span.below_hi = hi, counts[f"below_hi{i}"]


def _rank_inside(rows, spans):
    """Rank the distinct values left inside the spans and interpolate."""
    score = F.col("score")
    keep = F.lit(False)
    offset = F.lit(0)
    for span in spans:
        mine = F.col("cls") == span.cls
        keep |= mine & span.within(score)
        offset = F.when(mine, F.lit(span.below)).otherwise(offset)
    values = rows.filter(keep).groupBy("cls", "score").agg(F.count(F.lit(1)).alias("copies"))
    running = Window.partitionBy("cls").orderBy("score")
    ranked = values.withColumn("upto", F.sum("copies").over(running) + offset)
    first = F.col("upto") - F.col("copies")

    def at(span, rank):
        here = (F.col("cls") == span.cls) & (first <= rank) & (F.lit(rank) < F.col("upto"))
        return F.max(F.when(here, score))

    thresholds = {0: F.max(F.lit(None).cast("double")), 1: F.max(F.lit(None).cast("double"))}
    for span in spans:
        low = at(span, span.rank)
        if span.fraction:
            high = at(span, span.rank + 1)
            mixed = low * F.lit(1 - span.fraction) + high * F.lit(span.fraction)
            low = F.when(low == high, low).otherwise(mixed)
        thresholds[span.cls] = low
    return ranked.agg(thresholds[0].alias("t0"), thresholds[1].alias("t1"))
