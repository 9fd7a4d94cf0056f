"""Secret scans that link the parts of a credential.

Three patterns find what is a secret by itself (`assign`, `access`, `hex`). Further patterns
find parts that mean little alone: long mixed strings (`secret`), network addresses
(`endpoint`) and account names (`login`). Parts lie on the line of character offsets of their
text; each opens a scope of `reach` characters on both sides, and one ordered pass over the
parts of a text (window frames over offsets, an interval join without pairs) tells which
complementary parts reach it:

* a `secret` is reported when an access identifier or an endpoint is in reach,
* a `login` when a secret of any kind and an endpoint are in reach,
* an `endpoint` when it is in reach of an access identifier and a secret of any kind.

Offsets count code points, the end is exclusive. Everything is DataFrame code.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictflow.llm import common
from verdictflow.session import stage

#: Kinds in the order of equal starts. The first three stand alone, the others are linked.
KINDS = ["assign", "access", "hex", "secret", "endpoint", "login"]
BASE = KINDS[:3]

#: Fixed patterns. In front of them, what a match must fulfil to stay.
PATTERNS = {
    "assign": (
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    # A run that is long enough is found by its length; shorter ones are never reported, and
    # a run has no second start that is longer.
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "secret": r"[A-Za-z0-9+/]{32,}",
    "endpoint": r"""[a-z]{2,12}://[^\x00-\x20"'<>]{4,}""",
    "login": (
        r"([uU][sS][eE][rR][nN][aA][mM][eE]|[uU][sS][eE][rR]|[lL][oO][gG][iI][nN])"
        r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
    ),
}
LEAST_VALUE = 6
REACH = 300

PART = "struct<start:int,rank:int,end:int>"


def _parts(kind: str) -> Column:
    """The matches of one kind, in order, as (start, rank, end).

    What lies between the matches and the matches themselves alternate, so that lengths
    add up to offsets.
    """
    found, text = F.col(f"found_{kind}"), F.col("whole")
    gaps = F.transform(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found)), F.length)
    sizes = F.transform(found, F.length)
    both = F.zip_with(gaps, sizes, lambda gap, size: gap + size)
    before = common.running(both, lambda a, b: a + b, F.lit(0))
    columns = [before.alias("before"), gaps.alias("gap"), sizes.alias("size"), found.alias("match")]
    if kind == "assign":
        columns.append(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(2)).alias("value"))
    rows = F.arrays_zip(*columns)
    if kind == "assign":
        rows = F.filter(rows, lambda r: F.length(r["value"]) >= LEAST_VALUE)
    if kind == "secret":  # lower and upper case letters and digits
        rows = F.filter(
            rows, lambda r: r["match"].rlike("[a-z]") & r["match"].rlike("[A-Z]") & r["match"].rlike("[0-9]")
        )

    def part(r):
        start = r["before"] + r["gap"]
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + r["size"]).alias("end")
        )

    return F.when(F.size(found) > 0, F.transform(rows, part)).otherwise(F.array().cast(f"array<{PART}>"))


def _near(kinds: list[str], reach: int) -> Column:
    """Whether a part of one of `kinds`, other than the row's own, is in reach.

    Scopes are measured between starts.
    """
    ranks = [KINDS.index(k) for k in kinds]
    frame = (
        Window.partitionBy("doc_id", "text_key")
        .orderBy(F.col("part.start"))
        .rangeBetween(-reach, reach)
    )
    return F.coalesce(F.max(F.col("part.rank").isin(ranks)).over(frame), F.lit(False))


def linked_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Of `doc_id, text_key, part` rows, the weak parts whose complement is in reach."""
    any_secret = ["assign", "hex", "secret"]
    marked = found.select(
        "doc_id",
        "text_key",
        "part",
        _near(["access", "endpoint"], reach).alias("by_place"),
        _near(["access"], reach).alias("by_access"),
        _near(any_secret, reach).alias("by_secret"),
        _near(["endpoint"], reach).alias("by_endpoint"),
    )
    rank = F.col("part.rank")
    keep = (
        ((rank == KINDS.index("secret")) & F.col("by_place"))
        | ((rank == KINDS.index("login")) & F.col("by_secret") & F.col("by_endpoint"))
        | ((rank == KINDS.index("endpoint")) & F.col("by_access") & F.col("by_secret"))
    )
    return marked.filter(keep).select("doc_id", "text_key", "part")


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _matched(rows: DataFrame, kept: list[str]) -> DataFrame:
    """`kept` columns of `rows` (doc_id, whole and others) with `text_key, base, weak`."""
    found = rows.select(
        *kept, "doc_id", "whole", *[F.regexp_extract_all("whole", F.lit(p), F.lit(0)).alias(f"found_{k}") for k, p in PATTERNS.items()]
    )
    return found.select(
        *kept,
        "doc_id",
        text_key(F.col("whole")).alias("text_key"),
        F.concat(*[_parts(k) for k in BASE]).alias("base"),
        F.concat(*[_parts(k) for k in KINDS if k not in BASE]).alias("weak"),
    )


def _may_link() -> Column:
    """False for texts that lack a part that any of their weak parts needs, wherever it may be."""

    def has(parts, *kinds):
        ranks = [KINDS.index(k) for k in kinds]
        return F.exists(parts, lambda p: p["rank"].isin(ranks))

    access, endpoint = has("base", "access"), has("weak", "endpoint")
    any_secret = has("base", "assign", "hex") | has("weak", "secret")
    return (
        (has("weak", "secret") & (access | endpoint))
        | (has("weak", "login") & any_secret & endpoint)
        | (endpoint & access & any_secret)
    )


def _with_spans(found: DataFrame, kept: list[str], reach: int) -> DataFrame:
    """`kept` columns, `base` and `spans` of a stored table of matched texts.

    Only offsets of texts whose parts may link are dealt, and these texts' rows.
    """
    may_link = found.filter(_may_link())
    parts = may_link.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("part")).distinct()
    linked = linked_parts(parts, reach).groupBy("doc_id", "text_key").agg(F.collect_list("part").alias("linked"))
    linked = linked.withColumnsRenamed({"doc_id": "linked_id", "text_key": "linked_key"})
    same = F.col("doc_id").eqNullSafe(F.col("linked_id")) & (F.col("text_key") == F.col("linked_key"))
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{PART}>"))))
    columns = [*kept, "text_key", F.array_sort("base").alias("base")]
    alone = found.filter(~_may_link()).select(*columns, F.array_sort("base").alias("spans"))
    return alone.unionByName(may_link.join(linked, same, "left").select(*columns, spans.alias("spans")))


def scan(docs: DataFrame, text="text", doc_id="doc_id", reach: int = REACH) -> DataFrame:
    """The spans of each row: `doc_id, text_key, base, spans`.

    `base` holds the parts that stand alone and `spans` all that are reported, each in
    order of start and kind, as (start, rank, end) with the kind's place in `KINDS`. There is
    one row per input row; repeated rows have equal spans. A NULL text is empty; a NULL id
    is an id of its own. `text_key` tells texts under one id apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    # The patterns run once over the texts; from here on there are only offsets.
    return _with_spans(stage(_matched(rows, []), "secret-parts"), ["doc_id"], reach)


def listed(parts: Column) -> Column:
    """Parts as `kind:start:end`, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda p: F.concat_ws(":", F.get(kinds, p["rank"]), p["start"], p["end"])
    return F.array_join(F.transform(parts, one), ",")


def count_of(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda p: p["rank"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column, mask="[SECRET]") -> Column:
    """`text` with each reported span replaced by `mask`; overlapping spans make one."""
    return common.without(text, spans, "start", "end", mask)


def redact(docs: DataFrame, text="text", doc_id="doc_id", mask="[SECRET]", reach: int = REACH) -> DataFrame:
    """`docs` with every reported span of `text` masked; rows and columns stay.

    A NULL text stays NULL, an empty one empty; repeated rows are masked alike, and a NULL id is an
    id of its own. Matched texts are written once; only those are dealt whose parts may link.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        docs[doc_id].alias("doc_id"),
        F.coalesce(docs[text], F.lit("")).alias("whole"),
    )
    found = _with_spans(stage(_matched(rows, ["doc"]), "matched-texts"), ["doc"], reach)
    new = masked(F.col("doc")[text], F.col("spans"))
    return found.select(*[new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
