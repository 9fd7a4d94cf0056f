"""Stored models: each save is a new version, and jobs take the newest one there is."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions.text import VOCABULARY
from verdictflow.operators import model, scorer
from verdictflow.schemas import MODEL
from verdictflow.sources.tables import VersionedTable


@dataclass(frozen=True)
class StoredModel:
    """A model as it was saved; `row` is its one row."""

    version: int
    vocabulary: int
    settings: dict[str, str]
    row: DataFrame

    def step(self):
        """Scoring as a projection."""
        return scorer.native_step(self.row, self.vocabulary)

    def python_step(self):
        """Scoring in Arrow batches."""
        return scorer.python_step(self.row, self.vocabulary)


class ModelStore:
    """Versions of a linear model, with its vocabulary and the settings it was trained with.

    A model is one row with an array of fixed size, so a job that scores reads one row. A job
    goes on with the version it has read while a newer one is saved; the newest `keep` stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep=20):
        self.table = VersionedTable(spark, path, MODEL, keep)

    def save(self, weights: DataFrame, vocabulary=VOCABULARY, **settings) -> int:
        """Save rows of weights as the newest model; its version."""
        described = [part for key, value in settings.items() for part in (F.lit(key), F.lit(str(value)))]
        named = F.create_map(*described) if described else F.create_map().cast("map<string,string>")
        row = model.dense_model(weights, vocabulary).select(
            F.lit(vocabulary).alias("vocabulary"), "bias_micro", "unseen_micro", "weights", named.alias("settings")
        )
        self.table.write(row)
        return self.table.version()

    def load(self, version: int | None = None) -> StoredModel:
        """The newest model, or that of a version."""
        chosen = self.table.version() if version is None else version
        row = self.table.read(chosen)
        facts = row.select("vocabulary", "settings").first() if chosen >= 0 else None
        if facts is None:
            raise LookupError(f"{self.table.path}: no model" + ("" if version is None else f" {version}"))
        return StoredModel(chosen, facts["vocabulary"], dict(facts["settings"]), row)
