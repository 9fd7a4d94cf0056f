"""Run a job from the command line: `python -m verdictflow.jobs predict --settings settings.json`.

Settings are a JSON object; what it leaves out has the defaults of the job's class below. All
state lies below `root`: the models, the pending predictions, the log, the history and the messages.
"""

import argparse
import json
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone

from verdictflow.plans import assess, monitor, predict, training
from verdictflow.schemas import POSTS
from verdictflow.session import build_session, remove_staged
from verdictflow.sources import tables
from verdictflow.sources.models import ModelStore


def _today():
    return datetime.now(timezone.utc).strftime("%Y-%m-%d")


@dataclass
class Settings:
    posts: str  # path of the post feed, Parquet or another format that Spark reads
    root: str
    posts_format: str = "parquet"
    model: str = "linear"  # the name of the stored model
    dry_run: bool = False
    seed: int = 0

    def feed(self, spark):
        return spark.read.schema(POSTS).format(self.posts_format).load(self.posts)

    def models(self, spark):
        return ModelStore(spark, f"{self.root}/models/{self.model}")


@dataclass
class Train(Settings):
    """Weights from the decided posts of the two classes, stored with their held-out accuracy."""

    hold_share: float = 0.132865
    drop_share: float = 0.0
    threshold: float = 0.5

    def run(self, spark):
        result = training.train(
            training.training_posts(self.feed(spark)), self.hold_share, self.seed, self.threshold, self.drop_share
        )
        accuracy = {r["split"]: r["accuracy"] for r in result.accuracy.collect()}
        if self.dry_run:
            return {"accuracy": accuracy}
        described = {f"accuracy_{split}": value for split, value in accuracy.items()}
        version = self.models(spark).save(result.weights, hold_share=self.hold_share, seed=self.seed, **described)
        return {"accuracy": accuracy, "model": version}


@dataclass
class Predict(Settings):
    """Publish the surest of the newest undecided posts."""

    run_date: str = ""
    n_posts: int | None = 200
    n_publish: int = 2
    share: float = 0.1
    scorer: str = "native"  # or "python"

    def run(self, spark):
        stored = self.models(spark).load()
        result = predict.run_predict(
            self.feed(spark),
            tables.pending_table(spark, self.root),
            tables.outbox(spark, self.root),
            stored.python_step() if self.scorer == "python" else stored.step(),
            self.run_date or _today(),
            dry_run=self.dry_run,
            seed=self.seed,
            n_posts=self.n_posts,
            n_publish=self.n_publish,
            share=self.share,
        )
        return {
            "model": stored.version,
            "scored": result.scored.count(),
            "published": result.published.count(),
            "pending": result.pending.count(),
        }


@dataclass
class Assess(Settings):
    """Grade the pending predictions whose verdict is in."""

    run_ts: str = ""

    def run(self, spark):
        result = assess.run_assess(
            tables.pending_table(spark, self.root),
            self.feed(spark),
            tables.resolved_archive(spark, self.root),
            tables.outbox(spark, self.root),
            self.run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%d-%H-%M"),
            dry_run=self.dry_run,
            seed=self.seed,
        )
        return {"resolved": result.resolved.count(), "pending": result.pending.count()}


@dataclass
class Monitor(Settings):
    """Add newly decided posts, scored, to the daily log."""

    n_posts: int | None = 500
    length_mode: str = "as_written"

    def run(self, spark):
        rows, counts = monitor.run_monitor(
            self.feed(spark),
            tables.daily_log(spark, self.root, indexed=True),
            self.models(spark),
            dry_run=self.dry_run,
            n_posts=self.n_posts,
            length_mode=self.length_mode,
        )
        return {"logged": rows.count(), **counts.first().asDict()}


@dataclass
class Report(Settings):
    """Add the day's accuracy on a balanced sample to the history."""

    run_date: str = ""
    overwrite_day: bool = True

    def run(self, spark):
        result = monitor.run_report(
            self.feed(spark),
            self.models(spark),
            tables.history_table(spark, self.root),
            tables.history_archive(spark, self.root),
            self.run_date or _today(),
            dry_run=self.dry_run,
            overwrite_day=self.overwrite_day,
            seed=self.seed,
        )
        return {r["outcome_type"]: {"n": r["n"], "rate": r["rate"]} for r in result.summary.collect()}


JOBS = {"train": Train, "predict": Predict, "assess": Assess, "monitor": Monitor, "report": Report}


def settings_of(job: str, values: dict) -> Settings:
    """The settings of a job; a name that it does not know is an error."""
    kind = JOBS[job]
    unknown = set(values) - {field.name for field in fields(kind)}
    if unknown:
        raise ValueError(f"{job} has no settings {sorted(unknown)}")
    return kind(**values)


def main(arguments=None):
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--settings", required=True, help="a JSON file, or a JSON object")
    given = parser.parse_args(arguments)
    text = given.settings
    if not text.lstrip().startswith("{"):
        with open(text) as file:
            text = file.read()
    settings = settings_of(given.job, json.loads(text))
    spark = build_session(f"verdictflow-{given.job}")
    try:
        found = settings.run(spark)
    finally:
        remove_staged(spark)
    print(json.dumps({"job": given.job, "settings": asdict(settings), "result": found}))
    return found


if __name__ == "__main__":
    main()
