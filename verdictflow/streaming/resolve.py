"""Resolution of pending predictions as verdicts arrive."""

from verdictflow.plans.assess import assess
from verdictflow.streaming.common import start, stream_id


def resolve_stream(posts, pending, archive, checkpoint, to_batch=None, **trigger):
    """For every batch of posts, archive the pending rows it decides and keep the others.

    A batch writes the pending table with its own mark, so a repeated batch is known
    whatever other writers did, and starts again from the rows as they are when another
    writer comes first. The archive partition belongs to the batch and is written before.
    """
    stream = stream_id(pending.spark, checkpoint)

    def settle(batch, batch_id):
        mark = f"{stream}.{batch_id}"
        feed = to_batch(batch) if to_batch else batch
        while not pending.has(mark):
            version = pending.version()
            result = assess(pending.read(version), feed)
            if result.any_resolved:
                archive.append(result.resolved, f"{stream}-{batch_id:012d}")
            pending.write_after(result.pending, version, mark)

    return start(posts, settle, checkpoint, trigger)
