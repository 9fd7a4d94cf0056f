"""What joins of similar things share: buckets, blocks, and links counted without pairs.

Things have a numeric id `gid`, `bands` (bucket keys; similar things share one with a
probability near 1) and a `sketch` that a cheap test works on.

1. Buckets of two or more things are kept, one of each set of buckets with the same members.
2. Within a bucket things are connected if the cheap test lets a pair pass. Only a spanning
   set of links leaves a task, never the pairs.
3. Components of these links hold all similar pairs. They are compared again by the exact
   test, which counts links per thing and gives another spanning set.

Large buckets and components are dealt into blocks, and each pair of blocks is a group of
its own, so that no group is unbounded: a group of n things in k blocks is read k times.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm.graph import components
from verdictflow.session import stage

#: Things in a block of a bucket, and bytes in a block of a component.
BUCKET_BLOCK = 8_192
BLOCK_BYTES = 6_000_000


def bucket_members(things: DataFrame) -> DataFrame:
    """`bucket, n, gid` of the buckets that are compared. `things`: one row per gid."""
    rows = things.select("gid", F.explode(F.array_distinct("bands")).alias("bucket"))
    full = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("gid")).alias("members"))
        .filter(F.col("n") > 1)
    )
    kept = full.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    return rows.join(kept.select("bucket", "n"), "bucket")


def blocked(rows: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: adds `lo, hi, own`."""
    parts = rows.withColumn("blocks", F.greatest(blocks.cast("int"), F.lit(1)))
    own = F.pmod(F.xxhash64("gid", F.lit(1)), F.col("blocks")).cast("int")
    parts = parts.withColumn("own", own)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (
        parts.withColumn("other", F.explode(others))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other", "blocks")
    )


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted partition, each as a whole."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        if rest and any(rest[-1][k].iloc[-1] != c[0] for k, c in zip(keys, columns)):
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b < len(batch):
                part = batch.iloc[a:b]
                yield pd.concat([*rest, part]) if rest else part
                rest = []
            else:
                rest.append(batch.iloc[a:b])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


class Classes:
    """Classes of the rows of one group."""

    def __init__(self, n):
        self.label = np.arange(n)

    def join(self, i, others):
        """Row i and `others` become one class."""
        if len(others):
            labels = np.unique(self.label[np.append(others, i)])
            self.label[np.isin(self.label, labels)] = labels[0]

    def roots(self, gids):
        """The smallest gid of each row's class."""
        least = np.full(len(gids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, gids)
        return least[self.label]


def _connect(passing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = passing()
        for group in whole_groups(batches, ["bucket", "lo", "hi"]):
            if len(group) < 2:
                continue
            gids = group["gid"].to_numpy()
            own = group["own"].to_numpy()
            cross = group["lo"].iloc[0] != group["hi"].iloc[0]
            look = test(group["sketch"].to_numpy())
            classes = Classes(len(group))
            for i in range(len(group) - 1):
                # Those that are in the row's class already need no test.
                open_rows = classes.label[i + 1 :] != classes.label[i]
                if cross:
                    open_rows &= own[i + 1 :] != own[i]
                others = np.flatnonzero(open_rows) + i + 1
                if len(others):
                    classes.join(i, others[look(i, others)])
            roots = classes.roots(gids)
            linked = roots != gids
            if linked.any():
                yield pd.DataFrame({"a": gids[linked], "b": roots[linked]})

    return run


def candidate_groups(things: DataFrame, passing: Callable) -> DataFrame:
    """`gid, root` of the things that may be similar to another one.

    `passing()` returns a function of a group's sketches, which returns a test of one row
    against others of the group.
    """
    members = stage(bucket_members(things), "bucket-members")
    rows = members.join(things.select("gid", "sketch"), "gid")
    rows = blocked(rows, F.ceil(F.col("n") / BUCKET_BLOCK))
    rows = rows.select("bucket", "lo", "hi", "own", "gid", "sketch")
    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links = dealt.mapInPandas(_connect(passing), "a long, b long")
    return components(links).withColumnRenamed("id", "gid")


def _verify(linked):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = linked()
        for group in whole_groups(batches, ["root", "lo", "hi"]):
            if len(group) < 2:
                continue
            gids, copies = group["gid"].to_numpy(), group["copies"].to_numpy()
            cross = group["lo"].iloc[0] != group["hi"].iloc[0]
            classes, count = Classes(len(group)), np.zeros(len(group), dtype=np.int64)
            for i, j in test(group, group["own"].to_numpy(), cross):
                # Each pair once, i and j are arrays.
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                _union(classes, i, j)
            roots = classes.roots(gids)
            found = count > 0
            if found.any():
                yield pd.DataFrame({"a": gids[found], "b": roots[found], "links": count[found]})

    return run


def _union(classes: Classes, i: np.ndarray, j: np.ndarray):
    """Join the classes of linked rows: labels sink to the smallest until none changes."""
    label = classes.label
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label[:] = label[label]
        if (label == before).all():
            return


def dealt_groups(things: DataFrame) -> DataFrame:
    """The `things` of groups (`root`) of two or more, with the `blocks` of their group."""
    sizes = things.groupBy("root").agg(F.sum("bytes").alias("group_bytes"), F.count("*").alias("of_root"))
    rows = things.join(sizes.filter(F.col("of_root") > 1), "root")
    return rows.withColumn("blocks", F.ceil(F.col("group_bytes") / BLOCK_BYTES)).drop(
        "group_bytes", "of_root", "bytes"
    )


def links_and_classes(groups: DataFrame, linked: Callable) -> DataFrame:
    """`gid, n_links, class_root` of every thing that has a link to another one.

    `groups`: `gid, root, copies, blocks` and what `linked()` needs; a link counts as often as
    the other thing has `copies`. Only here is what `linked()` needs sent, once for each pair of
    blocks.
    """
    rows = blocked(groups, F.col("blocks"))
    dealt = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    found = stage(dealt.mapInPandas(_verify(linked), "a long, b long, links long"), "links-found")
    counts = found.groupBy(F.col("a").alias("gid")).agg(F.sum("links").alias("n_links"))
    classes = components(found.select("a", "b")).select(
        F.col("id").alias("gid"), F.col("root").alias("class_root")
    )
    return counts.join(classes, "gid")
