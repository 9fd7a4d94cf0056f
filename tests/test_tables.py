from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from verdictflow.operators import filters
from verdictflow.operators import joins
from verdictflow.plans import monitor
from verdictflow.schemas import DAILY_LOG, PENDING, TRAINING_CSV
from verdictflow.sources import scans, tables
from verdictflow.streaming.ingest import unscored


def pending_rows(spark, titles):
    return spark.createDataFrame([(t, None, "u", None, 0.0, 1, i) for i, t in enumerate(titles)], PENDING)


def titles(df):
    return sorted(r.title for r in df.collect())


def test_missing_table_is_empty_or_an_error(spark, tmp_path):
    path = str(tmp_path / "none")
    empty = scans.read_if_exists(spark, path, PENDING)
    assert empty.count() == 0 and empty.schema == PENDING
    with pytest.raises(FileNotFoundError):
        scans.read_required(spark, path, PENDING)


def test_versions_replace_each_other_while_being_read(spark, tmp_path):
    table = tables.pending_table(spark, str(tmp_path))
    assert table.version() == -1 and table.read().count() == 0
    table.write(pending_rows(spark, ["a", "b"]))
    table.write(table.read().filter("title = 'a'"))
    assert (table.version(), titles(table.read())) == (1, ["a"])
    assert titles(table.read(0)) == ["a", "b"]


def test_incomplete_version_does_not_count(spark, tmp_path):
    table = tables.pending_table(spark, str(tmp_path))
    table.write(pending_rows(spark, ["a"]))
    (tmp_path / "pending" / "v=000000000001").mkdir()
    assert (table.version(), titles(table.read())) == (0, ["a"])
    table.write(pending_rows(spark, ["b"]))
    assert (table.version(), titles(table.read())) == (1, ["b"])


def test_marks_are_known_whatever_others_write(spark, tmp_path):
    table = tables.pending_table(spark, str(tmp_path))
    table.write(pending_rows(spark, ["a"]), mark="s.0")
    table.write(pending_rows(spark, ["b"]))
    assert table.has("s.0") and not table.has("s.1") and not table.has("t.0")
    assert titles(table.read()) == ["b"]


def test_a_write_after_an_old_version_is_refused(spark, tmp_path):
    table = tables.pending_table(spark, str(tmp_path))
    table.write(pending_rows(spark, ["a"]))
    table.write(pending_rows(spark, ["b"]))
    assert table.write_after(pending_rows(spark, ["c"]), version=0) is None
    assert titles(table.read()) == ["b"]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (tables.pending_table(spark, str(tmp_path)) for _ in range(2))
    one.write(pending_rows(spark, ["a"]))
    tries = []

    def slow(rows):
        if not tries:
            two.update(lambda inner: inner.union(pending_rows(spark, ["b"])))
        tries.append(1)
        return rows.union(pending_rows(spark, ["c"]))

    one.update(slow)
    assert (len(tries), titles(one.read())) == (2, ["a", "b", "c"])


def test_an_abandoned_claim_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.VersionedTable, "CLAIM_SECONDS", 0.5)
    table = tables.pending_table(spark, str(tmp_path))
    table.write(pending_rows(spark, ["a"]))
    table._claim(1)
    table.update(lambda rows: rows.union(pending_rows(spark, ["b"])))
    assert (table.version(), titles(table.read())) == (2, ["a", "b"])


def test_old_versions_go_and_each_stream_keeps_its_newest(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), PENDING, keep=2)
    table.write(pending_rows(spark, ["a"]), mark="s.0")
    table.write(pending_rows(spark, ["b"]), mark="s.1")
    for title in "cde":
        table.write(pending_rows(spark, [title]))
    assert [v.number for v in table._versions()] == [4, 3, 1] and table.has("s.1")


def test_dry_run_writes_nothing(spark, tmp_path, make_posts):
    rows = pending_rows(spark, ["a"])
    table = tables.pending_table(spark, str(tmp_path))
    assert titles(table.write(rows, dry_run=True)) == ["a"]
    log = tables.daily_log(spark, str(tmp_path))
    log.append(log_rows(make_posts, [(1, "t", "b", "nta", 1)]), dry_run=True)
    box = tables.outbox(spark, str(tmp_path))
    box.append(spark.createDataFrame([(1, "m")], "message_id long, message string"), "ruling", dry_run=True)
    assert list(tmp_path.iterdir()) == []


def log_rows(make_posts, rows):
    return unscored(monitor.decided_batch(make_posts(rows)), DAILY_LOG)


def test_log_is_appended_and_read_by_date(spark, tmp_path, make_posts):
    log = tables.daily_log(spark, str(tmp_path))
    log.append(log_rows(make_posts, [(i, "t", "b", "nta", 24 * i) for i in range(6)]))
    log.append(log_rows(make_posts, [(10, "t", "b", "nta", 1)]))
    assert log.read().count() == 7
    batch = monitor.decided_batch(make_posts([(20, "t", "b", "nta", 5), (21, "t", "b", "nta", 50)]))
    part = log.read_dates_of(batch)
    assert sorted(r.submission_id for r in part.collect()) == ["0", "10", "2"]
    assert "PartitionFilters: [" in plan_of(part) and "PartitionFilters: []" not in plan_of(part)
    assert "dynamicpruning" in plan_of(part)
    nothing = log.read_dates_of(batch.limit(0))
    assert nothing.count() == 0


def test_log_of_very_many_dates(spark, tmp_path):
    log = tables.DailyLog(spark, str(tmp_path / "log"), schema=spark.createDataFrame([], "n long, post_date date").schema)
    days = spark.range(0, 9000, 2).select(
        F.col("id").alias("n"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("post_date")
    )
    days.coalesce(1).write.partitionBy("post_date").parquet(str(tmp_path / "log"))
    batch = days.filter("n % 4 = 0").union(days.limit(1).selectExpr("n", "date'1999-12-31'"))
    got = [r.n for r in log.read_dates_of(batch).collect()]
    assert sorted(got) == list(range(0, 9000, 4))


def test_last_days_of_a_partitioned_log(spark, tmp_path, make_posts):
    log = tables.daily_log(spark, str(tmp_path))
    log.append(log_rows(make_posts, [(i, "t", "b", "nta", 24 * i) for i in range(8)]))

    def days(**options):
        rows = scans.last_days(log.read(), date(2024, 1, 6), 3, **options).collect()
        return sorted(r.post_date.day for r in rows)

    assert days() == [4, 5, 6]
    assert days(exclude_today=True) == [4, 5]
    assert "PartitionFilters: []" not in plan_of(scans.last_days(log.read(), "2024-01-06", 3))


def test_files_of_the_last_days_by_name(spark, tmp_path):
    for day in ("2024-01-04", "2024-01-05", "2024-01-06", "2024-01-07"):
        (tmp_path / f"{day}_post.csv").write_text(f"{day}\n")
    (tmp_path / "notes.csv").write_text("none\n")
    files = spark.read.schema("day string").csv(str(tmp_path))

    def days(**options):
        return sorted(r.day for r in scans.files_last_days(files, date(2024, 1, 6), 2, **options).collect())

    assert days() == ["2024-01-05", "2024-01-06"]
    assert days(exclude_today=True) == ["2024-01-05"]
    assert days(date_format="%m-%d-%Y") == []


def test_training_csv_keeps_text_as_it_is(spark, tmp_path):
    texts = ['line one\nline "two", with, commas', "", " spaced ", "back\\slash", "tail\r\nreturn", None, '"']
    rows = [(str(i), text, text, "YTA") for i, text in enumerate(texts)]
    path = str(tmp_path / "csv")
    scans.write_training_csv(spark.createDataFrame(rows, TRAINING_CSV), path)
    got = sorted(tuple(r) for r in scans.training_csv(spark, path).collect())
    assert got == sorted(rows)


def test_training_csv_reads_doubled_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('submission_id,title,selftext,link_flair_text\n1,"a ""b"" c","x\ny",YTA\n')
    row = scans.training_csv(spark, str(path)).first()
    assert (row.title, row.selftext, row.link_flair_text) == ('a "b" c', "x\ny", "YTA")


def test_archive_keeps_one_partition_per_run(spark, tmp_path):
    archive = tables.Archive(spark, str(tmp_path / "a"), PENDING)
    assert archive.read().count() == 0
    archive.append(pending_rows(spark, ["a"]), "2024-01-01-06-00")
    archive.append(pending_rows(spark, ["b"]), "2024-01-02-06-00")
    archive.append(pending_rows(spark, ["b"]), "2024-01-02-06-00")
    got = sorted((r.title, r.run_ts) for r in archive.read().collect())
    assert got == [("a", "2024-01-01-06-00"), ("b", "2024-01-02-06-00")]


def test_outbox_adds_each_message_once_per_kind(spark, tmp_path):
    box = tables.outbox(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "m")], "message_id long, message string")
    two = spark.createDataFrame([(1, "m"), (2, "n")], "message_id long, message string")
    box.append(one, "ruling")
    box.append(two, "ruling")
    box.append(one, "update")
    assert sorted((r.message_id, r.kind) for r in box.read().collect()) == [
        (1, "ruling"),
        (1, "update"),
        (2, "ruling"),
    ]
    twice = spark.createDataFrame([(7, "b"), (7, "a")], "message_id long, message string")
    box.append(twice, "ruling")
    assert [r.message for r in box.read().filter("message_id = 7").collect()] == ["a"]


def test_outbox_writers_take_turns_and_compare_their_days_only(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    box = tables.outbox(spark, str(tmp_path))
    rows = spark.createDataFrame(
        [(i, f"m{i}", date(2024, 1, 1 + i % 3)) for i in range(30)], "message_id long, message string, date_created date"
    )
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda _: box.append(rows, "ruling").count(), range(4)))
    assert sorted(added) == [0, 0, 0, 30]
    assert sorted(r.message_id for r in box.read().collect()) == list(range(30))
    one_day = rows.filter("message_id % 3 = 0")
    new = box._unknown(one_day.withColumn("kind", F.lit("ruling")).withColumnRenamed("date_created", "day"), "ruling")
    assert new.count() == 0 and "dynamicpruning" in plan_of(new)
    assert box.append(one_day, "update").count() == 10


def test_a_claim_left_behind_is_taken_over(spark, tmp_path, monkeypatch):
    box = tables.outbox(spark, str(tmp_path))
    monkeypatch.setattr(tables.Outbox, "CLAIM_SECONDS", 0)
    (tmp_path / "outbox" / "_claims").mkdir(parents=True)
    (tmp_path / "outbox" / "_claims" / "ruling").touch()
    one = spark.createDataFrame([(1, "m")], "message_id long, message string")
    assert box.append(one, "ruling").count() == 1
    assert not (tmp_path / "outbox" / "_claims" / "ruling").exists()


def test_posts_without_a_date_are_logged_once(spark, tmp_path, make_posts):
    log = tables.daily_log(spark, str(tmp_path))
    posts = make_posts([(1, "a", "b", "nta", 1), (2, "c", "d", "YTA", 30)])
    posts = posts.withColumn("created_utc", F.when(F.col("submission_id") == "2", F.col("created_utc")))
    batch = monitor.decided_batch(posts)
    for _ in range(2):
        new = joins.new_by_id(batch, log.read_dates_of(batch))
        log.append(unscored(new, DAILY_LOG))
    assert sorted((r.submission_id, r.post_date) for r in log.read().collect()) == [("1", None), ("2", date(2024, 1, 2))]
    dated = batch.filter("post_date is not null")
    assert [r.submission_id for r in log.read_dates_of(dated).collect()] == ["2"]


def indexed_log(spark, tmp_path):
    return tables.daily_log(spark, str(tmp_path), indexed=True)


def test_a_batch_of_new_ids_does_not_open_the_log(spark, tmp_path, make_posts):
    log = indexed_log(spark, tmp_path)
    log.append(log_rows(make_posts, [(i, "t", "b", "nta", i % 50) for i in range(300)]))
    fresh = monitor.decided_batch(make_posts([(1000 + i, "t", "b", "nta", i % 50) for i in range(40)]))
    maybe = log.may_be_known(fresh)
    assert maybe.count() <= 2  # ids that share all bits by chance
    new = monitor.unlogged(fresh.filter(~F.col("submission_id").isin([r.submission_id for r in maybe.collect()])), log)
    assert new.count() >= 38 and f"{tmp_path}/daily_log" not in plan_of(new).replace("daily_log_ids", "")
    both = fresh.unionByName(monitor.decided_batch(make_posts([(i, "t", "b", "nta", i % 50) for i in range(5)])))
    assert monitor.unlogged(both, log).count() == 40
    other_day = monitor.decided_batch(make_posts([(1, "t", "b", "nta", 2000)]))
    assert monitor.unlogged(other_day, log).count() == 1


def test_an_older_log_is_indexed_when_it_is_first_used(spark, tmp_path, make_posts):
    rows = [(i, "t", "b", "nta", i) for i in range(60)]
    tables.daily_log(spark, str(tmp_path)).append(log_rows(make_posts, rows[:30]))
    log = indexed_log(spark, tmp_path)
    log.append(log_rows(make_posts, rows[30:50]))
    batch = monitor.decided_batch(make_posts(rows))
    assert {r.submission_id for r in monitor.unlogged(batch, log).collect()} == {str(i) for i in range(50, 60)}
    undated = batch.withColumn("post_date", F.lit(None).cast("date"))
    log.append(unscored(undated.limit(3), DAILY_LOG))
    assert monitor.unlogged(undated, log).count() == 57


def test_a_crowded_index_is_never_wrong(spark, tmp_path, make_posts, monkeypatch):
    log = indexed_log(spark, tmp_path)
    log.index.slots = 2
    log.append(log_rows(make_posts, [(i, "t", "b", "nta", 1) for i in range(200)]))
    batch = monitor.decided_batch(make_posts([(i, "t", "b", "nta", 1) for i in range(400)]))
    assert {r.submission_id for r in monitor.unlogged(batch, log).collect()} == {str(i) for i in range(200, 400)}


def test_a_batch_of_many_dates_makes_few_files(spark, tmp_path, make_posts):
    log = indexed_log(spark, tmp_path)
    rows = [(i, "t", "b", "nta", 24 * i) for i in range(400)]
    log.append(log_rows(make_posts, rows))
    undated = monitor.decided_batch(make_posts([(900, "t", "b", "nta", 0)])).withColumn("post_date", F.lit(None).cast("date"))
    log.append(unscored(undated, DAILY_LOG))
    log.append(log_rows(make_posts, [(500, "t", "b", "nta", 24)]))
    assert len(list(tmp_path.rglob("*.parquet"))) < 60
    assert log.read().count() == 402 and log.read().schema.fieldNames() == DAILY_LOG.fieldNames()
    batch = monitor.decided_batch(make_posts([(1, "t", "b", "nta", 24), (3, "t", "b", "nta", 48), (4, "t", "b", "nta", 20_000)]))
    assert sorted(r.submission_id for r in log.read_dates_of(batch).collect()) == ["1", "2", "500"]
    assert "PartitionFilters: []" not in plan_of(log.read_dates_of(batch))
    assert sorted(r.submission_id for r in monitor.unlogged(batch, log).collect()) == ["3", "4"]
    assert [r.submission_id for r in log.read_dates_of(undated).collect()] == ["900"]
    assert monitor.unlogged(undated, log).count() == 0
    everything = monitor.decided_batch(make_posts(rows))
    assert monitor.unlogged(everything, tables.daily_log(spark, str(tmp_path))).count() == 0
    assert sorted(r.post_date.day for r in scans.last_days(log.read(), "2024-01-06", 3).collect()) == [4, 5, 6]
