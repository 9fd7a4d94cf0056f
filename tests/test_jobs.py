"""The jobs from the command line, one after the other over one folder of state."""

import json

import pytest
from pyspark.sql import functions as F

from verdictflow import jobs
from verdictflow.sources import tables
from verdictflow.sources.models import ModelStore


@pytest.fixture
def folder(make_posts, tmp_path):
    rows = []
    for i in range(90):
        flair = [None, "YTA", "NTA"][i % 3]
        word = "rude loud" if i % 3 == 1 or i % 2 else "kind quiet"
        rows.append((i, f"title {i}", f"{word} " * (i % 7 + 1), flair, i))
    make_posts(rows).write.parquet(f"{tmp_path}/posts")
    return tmp_path


def run(spark, job, folder, **settings):
    return jobs.settings_of(job, {"posts": f"{folder}/posts", "root": f"{folder}/state", **settings}).run(spark)


def test_jobs_follow_each_other(spark, folder):
    trained = run(spark, "train", folder)
    assert trained["model"] == 0 and set(trained["accuracy"]) == {"val", "test"}
    stored = ModelStore(spark, f"{folder}/state/models/linear").load()
    assert stored.settings["hold_share"] == "0.132865"
    found = run(spark, "predict", folder, run_date="2024-03-01", n_posts=None)
    assert found == {"model": 0, "scored": 30, "published": 2, "pending": 2}
    again = run(spark, "predict", folder, run_date="2024-03-01", n_posts=None, scorer="python", n_publish=3)
    assert again["scored"] == 28 and again["pending"] == 5
    assert run(spark, "assess", folder, run_ts="2024-03-02-06-00") == {"resolved": 0, "pending": 5}
    posts = spark.read.parquet(f"{folder}/posts")
    posts.withColumn("link_flair_text", F.coalesce("link_flair_text", F.lit("YTA"))).write.parquet(f"{folder}/later")
    assessed = run(spark, "assess", folder, run_ts="2024-03-02-06-00", posts=f"{folder}/later")
    assert assessed == {"resolved": 5, "pending": 0}
    kinds = {r["kind"]: r["count"] for r in tables.outbox(spark, f"{folder}/state").read().groupBy("kind").count().collect()}
    assert kinds == {"ruling": 5, "update": 5}
    assert run(spark, "monitor", folder)["logged"] == 60
    assert run(spark, "monitor", folder)["logged"] == 0
    report = run(spark, "report", folder, run_date="2024-03-01")
    assert {name: r["n"] for name, r in report.items()} == {"Total": 60, "YTA": 30, "NTA": 30}
    assert tables.history_table(spark, f"{folder}/state").read().count() == 3


def test_dry_runs_write_nothing(spark, folder):
    assert "model" not in run(spark, "train", folder, dry_run=True)
    assert not (folder / "state").exists()
    run(spark, "train", folder)
    run(spark, "predict", folder, dry_run=True)
    run(spark, "monitor", folder, dry_run=True)
    run(spark, "report", folder, dry_run=True)
    assert sorted(p.name for p in (folder / "state").iterdir()) == ["models"]


def test_settings_are_checked():
    with pytest.raises(ValueError, match="n_pots"):
        jobs.settings_of("predict", {"posts": "p", "root": "r", "n_pots": 3})
    with pytest.raises(TypeError):
        jobs.settings_of("predict", {"posts": "p"})
    assert jobs.settings_of("monitor", {"posts": "p", "root": "r"}).n_posts == 500


def test_command_line_reads_a_file(folder, tmp_path, spark, monkeypatch, capsys):
    monkeypatch.setattr(jobs, "build_session", lambda name: spark)
    monkeypatch.setattr(jobs, "remove_staged", lambda spark: None)
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"posts": f"{folder}/posts", "root": f"{folder}/state"}))
    jobs.main(["train", "--settings", str(path)])
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["job"] == "train" and printed["result"]["model"] == 0


def test_a_job_without_a_model_stops(spark, folder):
    with pytest.raises(LookupError):
        run(spark, "predict", folder)
