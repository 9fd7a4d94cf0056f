"""URL filters as a sort-merge range join of canonical keys.

The key of a host and path is the host's labels in reverse, a slash, and the path. A rule
for a host covers the keys that start with its own key, an interval in the order of keys.
Because a rule also covers subdomains, a url has a key for each suffix of its host, so that
one interval per rule is enough. Each distinct key is swept once, however many urls have it;
those that a rule covers are joined back to their urls.

Rules and url keys are sorted together into ranges of keys. In each range a window in key
order keeps the stack of rules that are open: the slot of a nesting depth holds the latest
rule that began at this depth, and it is still open if its key is a prefix of the key at
hand. Rules that began before a range and reach into it are handed to the range, found by
the prefixes of the range's first key. Everything is DataFrame code.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictflow.llm.common import LOWER, UPPER, join_groups
from verdictflow.session import stage

RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """The part after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case.

    Empty for NULL and for a url without `://`.
    """
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty like the host."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


def _key(labels: Column, path: Column) -> Column:
    """`labels` come from the top-level label down; no label has a slash."""
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _prefixes(key: Column) -> Column:
    """All proper prefixes of a key that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.length(key) - 1), lambda n: F.substr(key, F.lit(1), n))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row per rule key: `key, rule, size, verdict, depth`.

    `depth` counts the rules that enclose it. Of equal rules with different verdicts
    `block` is taken (the later in order). A NULL path is empty; rules without a host or
    verdict do not count.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    host = F.translate(F.col("host"), UPPER, LOWER)
    keyed = (
        rules.select("host", "path", "verdict")
        .filter(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(
            _key(F.reverse(F.split(host, r"\.")), path).alias("key"),
            F.concat(host, path).alias("rule"),
            "verdict",
        )
        .groupBy("key", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    enclosing = keyed.select("key", F.explode(_prefixes(F.col("key"))).alias("outer_key")).join(
        keyed.select(F.col("key").alias("outer_key")), "outer_key"
    )
    depths = enclosing.groupBy("key").agg(F.count("*").alias("n"))
    return keyed.join(depths, "key", "left").select(
        "key",
        "rule",
        F.length("rule").alias("size"),
        "verdict",
        F.coalesce("n", F.lit(0)).cast("int").alias("depth"),
    )


def _sweep(points: DataFrame, rules: DataFrame, max_depth: int) -> DataFrame:
    """The longest rule whose key is a prefix of each point (`key, n`): adds `hit`, or NULL."""
    nothing = F.lit(None).cast("struct<key:string,rule:string,size:int,verdict:string,depth:int>")
    spark = points.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rule = F.struct("key", "rule", "size", "verdict", "depth")
    events = rules.select("key", rule.alias("rule"), F.lit(None).cast("long").alias("n"))
    events = events.unionByName(points.select("key", nothing.alias("rule"), "n"))
    # Written once, so that every reader sees the same ranges.
    dealt = events.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "url-events")

    first = dealt.groupBy("range").agg(F.min("key").alias("first_key"))
    reaching = (
        first.select("range", F.explode(_prefixes(F.col("first_key"))).alias("key"))
        .join(rules, "key")
        .select("key", rule.alias("rule"), F.lit(None).cast("long").alias("n"), "range")
    )
    # In key order, and a rule before the urls that have the very key of the rule.
    order = Window.partitionBy("range").orderBy("key", F.col("rule").isNull())
    swept = dealt.unionByName(reaching)
    slots = [f"slot_{depth}" for depth in range(max_depth + 1)]
    for depth, slot in enumerate(slots):
        began = F.when(F.col("rule.depth") == depth, F.col("rule"))
        swept = swept.withColumn(slot, F.last(began, ignorenulls=True).over(order))
    still_open = [
        F.when(F.startswith(F.col("key"), F.col(slot)["key"]), F.col(slot))
        for slot in reversed(slots)
    ]
    return swept.filter(F.col("n").isNotNull()).select(
        "key", "n", (F.coalesce(*still_open) if still_open else nothing).alias("hit")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url="url", default="allow") -> DataFrame:
    """Every distinct url host and path with the longest rule that fits it.

    Returns `host, path, rule, verdict`, one row per distinct host and path of `pages`;
    `rule` is NULL and `verdict` is `default` where no rule fits. A rule fits its host and
    all subdomains if the path starts with the rule's path. Of two rules of one length
    the one for the longer host is taken. A NULL url has an empty host and path. With no
    pages the result is empty; with no rules all get the default.
    """
    urls = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.distinct()
    table = stage(rule_table(rules), "url-rules")
    # One number; nesting is bounded by the labels of a host and the length of a path.
    max_depth = table.agg(F.max("depth")).first()[0]
    if max_depth is None:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.slice(labels, 1, n))
    points = urls.select(F.struct("host", "path").alias("url"), F.explode(suffixes).alias("labels"))
    points = points.select("url", _key(F.col("labels"), F.col("url.path")).alias("key"))
    points = stage(points, "url-keys")
    keys = points.groupBy("key").agg(F.count("*").alias("n"))
    swept = stage(_sweep(keys, table, max_depth), "url-hits").filter(F.col("hit").isNotNull())
    hits = swept.withColumnRenamed("key", "hit_key")
    found = join_groups(points, hits, "key", "hit_key", "n", points.count(), "inner")
    found = found.select("url", "hit").unionByName(
        urls.select(F.struct("host", "path").alias("url"), F.lit(None).cast(dict(hits.dtypes)["hit"]).alias("hit"))
    )
    longest = F.struct(F.col("hit.size"), F.length(F.substring_index("hit.key", "/", 1)))
    best = F.max_by("hit", F.when(F.col("hit").isNotNull(), longest))
    judged = found.groupBy("url").agg(best.alias("hit"))
    return judged.select(
        "url.host",
        "url.path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )


def filter_pages(pages: DataFrame, rules: DataFrame, url="url", default="allow") -> DataFrame:
    """`pages` with `host, path, rule, verdict`; columns of these names are replaced.

    Every row of `pages` is returned once, repeated rows included.
    """
    results = ["host", "path", "rule", "verdict"]
    judged = judge_urls(pages, rules, url, default)
    kept = pages.select(
        *[c for c in pages.columns if c not in results],
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    return kept.join(judged, ["host", "path"]).select(
        *[c for c in pages.columns if c not in results], *results
    )
