"""Look up the verdicts of pending predictions, grade them, and keep the rest pending."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.labels import code_outcome
from verdictflow.functions.messages import update_message
from verdictflow.functions.scores import grade
from verdictflow.operators import joins
from verdictflow.schemas import PENDING
from verdictflow.session import stage


def coded_lookup(pending, posts):
    """Title, flair and outcome code of the pending titles found among the posts."""
    return joins.title_lookup(pending, posts).withColumn(
        "outcome", code_outcome(F.col("outcome_str"))
    )


def with_updates(resolved, seed=0):
    """Resolved rows with grade and message."""
    return resolved.withColumn("grade", grade(F.col("pred"), F.col("outcome"))).withColumn(
        "message",
        update_message(
            F.col("title"),
            F.col("pred"),
            F.col("outcome"),
            F.col("outcome_str"),
            F.col("url"),
            F.col("message_id"),
            seed,
        ),
    )


@dataclass
class AssessResult:
    resolved: DataFrame  # pending rows with a verdict, graded, with their message
    pending: DataFrame  # the rows still without one
    any_resolved: bool


def assess(pending, posts, seed=0):
    """One assessment run; the join is staged because both halves read it."""
    merged = stage(joins.resolve(pending, coded_lookup(pending, posts)), "merged")
    resolved = with_updates(joins.resolved(merged), seed)
    waiting = joins.still_unresolved(merged).select(*PENDING.fieldNames())
    return AssessResult(resolved, waiting, not joins.resolved(merged).isEmpty())


def run_assess(state, posts, archive, outbox, run_ts, dry_run=False, seed=0):
    """`assess`, then the writes; nothing is written when no verdict came in.

    The state comes last: a run that stopped before it is repeated as a whole, with
    the same messages and, for the same `run_ts`, the same archive partition.
    """
    while True:
        version = state.version()
        result = assess(state.read(version), posts, seed)
        if dry_run or not result.any_resolved:
            return result
        outbox.append(result.resolved, "update")
        archive.append(result.resolved, run_ts)
        written = state.write_after(result.pending, version)
        if written is not None:  # else another job wrote the state: take its rows in
            result.pending = written
            return result
