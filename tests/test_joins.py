import random

from pyspark.sql import functions as F

from tests.conftest import nodes_of, plan_of
from verdictflow.operators import filters, joins
from verdictflow.plans import assess
from verdictflow.schemas import PENDING


def ids(df):
    return sorted(r.submission_id for r in df.collect())


def make_pending(spark, titles):
    rows = [(t, None, f"u{i}", None, 0.0, 1, i) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, PENDING)


def test_undecided_and_decided(make_posts):
    posts = make_posts([(i, "t", "b", f, i) for i, f in enumerate([None, "", " ", "nta", "META"])])
    assert ids(filters.undecided(posts)) == ["0"]
    assert ids(filters.decided(posts)) == ["2", "3", "4"]
    assert ids(filters.two_class(posts)) == ["3"]


def test_length_filter_modes(make_posts):
    bodies = ["x" * n for n in (200, 201, 6499, 6500)] + [None]
    posts = make_posts([(i, "t", b, None, i) for i, b in enumerate(bodies)])
    assert ids(filters.length_filter(posts)) == ["1", "2"]
    assert len(ids(filters.length_filter(posts, "as_written"))) == 5


def test_newest_is_a_top_n_and_breaks_ties_by_id(make_posts):
    posts = make_posts([(3, "t", "b", None, 5), (1, "t", "b", None, 5), (2, "t", "b", None, 1)])
    top = filters.newest(posts, 2)
    assert [r.submission_id for r in top.collect()] == ["1", "3"]
    assert "TakeOrderedAndProject" in plan_of(top)


def test_unseen_by_title_matches_null_with_null(spark, make_posts):
    posts = make_posts([(1, "a", "b", None, 1), (2, None, "b", None, 2), (3, "c", "b", None, 3)])
    known = spark.createDataFrame([("a",), (None,)], "title string")
    assert ids(joins.unseen_by_title(posts, known)) == ["3"]
    nothing = spark.createDataFrame([], "title string")
    assert ids(joins.unseen_by_title(posts, nothing)) == ["1", "2", "3"]


def skewed_posts(make_posts, n=3000):
    """A third of the rows under one title, a tenth with none, the rest spread out."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        place = rng.random()
        title = "hot" if place < 1 / 3 else None if place < 0.43 else f"t{rng.randrange(800)}"
        flair = rng.choice([None, "YTA", "nta", "META", "ESH"])
        rows.append((i, title, "b", flair, rng.randrange(500)))
    return rows, make_posts(rows)


def test_spread_anti_join_equals_brute_force(spark, make_posts, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows, posts = skewed_posts(make_posts)
    for known in (["hot", "t1", "t2"], [None, "t3"], ["t5"] * 3, []):
        state = spark.createDataFrame([(k,) for k in known], "title string")
        got = ids(joins.unseen_by_title(posts, state, min_rows=10))
        assert got == sorted(str(r[0]) for r in rows if r[1] not in known)
    state = spark.createDataFrame([("hot",)], "title string")
    assert ids(joins.unseen_by_title(posts.limit(0), state, min_rows=10)) == []


def test_hot_keys_finds_every_heavy_title(make_posts):
    _, posts = skewed_posts(make_posts)
    found = joins.hot_keys(posts, "title", min_rows=200)
    names = posts.select("title").distinct().join(found, F.xxhash64("title") == F.col("hot"))
    rows = {r.title: r.pieces for r in names.collect()}
    assert set(rows) == {"hot", None}
    assert rows["hot"] > 1000


def test_spread_join_splits_a_hot_title(make_posts, setting, spark):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    _, posts = skewed_posts(make_posts)
    lookup = spark.createDataFrame([("hot", 1), ("t1", 2)], "title string, outcome int")
    joined = joins.spread_join(posts, lookup, "title", "left", ["submission_id"], min_rows=10)
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "_piece" in plan and "BroadcastNestedLoop" not in plan
    assert joined.count() == posts.count()
    assert joined.filter("outcome = 1").count() == posts.filter("title = 'hot'").count()


def brute_lookup(rows, titles):
    best = {}
    for number, title, _, flair, hour in rows:
        if title in titles:
            key = (-hour, str(number))
            if title not in best or key < best[title][0]:
                best[title] = (key, flair)
    return {title: flair for title, (_, flair) in best.items()}


def test_title_lookup_takes_the_newest_post(spark, make_posts, setting):
    rows, posts = skewed_posts(make_posts)
    titles = ["hot", "t1", "t1", "t7", "absent", None]
    pending = make_pending(spark, titles)
    expected = brute_lookup(rows, {t for t in titles if t is not None})
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {r.title: r.outcome_str for r in joins.title_lookup(pending, posts).collect()}
        assert got == expected


def test_ranking_by_title_is_cut_before_the_shuffle(make_posts):
    _, posts = skewed_posts(make_posts)
    for plan in (plan_of(joins.latest_by_title(posts)), plan_of(joins.newest_of_each(posts))):
        assert plan.count("WindowGroupLimit") == 2


def test_resolve_keeps_one_row_per_prediction(spark, make_posts, setting):
    rows, posts = skewed_posts(make_posts)
    titles = ["hot"] * 40 + ["t1", "t1", "t9", None, "absent"]
    pending = make_pending(spark, titles)
    expected = brute_lookup(rows, set(titles) - {None})
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        lookup = assess.coded_lookup(pending, posts)
        merged = joins.resolve(pending, lookup, min_rows=10)
        got = merged.collect()
        assert sorted(r.message_id for r in got) == list(range(len(titles)))
        assert all(r.outcome_str == expected.get(r.title) for r in got)
        done, waiting = joins.resolved(merged), joins.still_unresolved(merged)
        assert done.count() + waiting.count() == len(titles)
        assert waiting.columns == PENDING.fieldNames()


def test_new_by_id_drops_logged_and_repeated_ids(spark, make_posts, setting):
    posts = make_posts(
        [
            (1, "old", "b", "nta", 1),
            (1, "new", "b", "nta", 2),
            (2, "t", "b", "nta", 1),
            (3, "t", "b", "nta", 1),
        ]
    )
    logged = spark.createDataFrame([("2",), ("9",)], "submission_id string")
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        new = joins.new_by_id(posts, logged)
        assert {r.submission_id: r.title for r in new.collect()} == {"1": "new", "3": "t"}


def test_unique_ids_are_not_sorted(spark, make_posts):
    _, posts = skewed_posts(make_posts)
    logged = spark.range(50).select(F.col("id").cast("string").alias("submission_id"))
    new = joins.new_by_id(posts, logged)
    assert not any(name in ("Sort", "Window") for name in nodes_of(new))
    assert new.count() == posts.count() - 50


def test_rows_of_one_id_and_time_are_told_apart_by_their_body(make_posts):
    posts = make_posts([(1, "t", "b", "nta", 1), (1, "t", "a", "nta", 1)])
    kept = {joins.first_by_id(posts.repartition(n)).first().selftext for n in (1, 2, 3)}
    assert len(kept) == 1
