"""Subword tokens: byte-pair merges learned from counts of distinct words, and applied to texts.

A word is a row of symbols written as `<a><b>`; words are letters only, so the brackets are free.
Adjacent symbols are counted over the distinct words once. A round joins the most frequent pair and
counts anew only the words that hold it, so what it reads grows with the vocabulary, not with the text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.text import words
from verdictflow.session import stage

# Rounds after which the words are staged anew.
STAGE_EVERY = 8
# A word is frequent when it is more than 1 / FREQUENT_SHARE of all words, so there are fewer than that.
FREQUENT_SHARE = 250_000
# Up to so many merges are counted in whole texts; beyond that a join of words takes less.
MOST_IN_TEXT = 64
# From here on no character is a letter; the merged symbols of a text are written as one each.
FIRST_CODE = 0xF0000


def _exploded(posts, text_col):
    return posts.select(F.explode(words(F.col(text_col))).alias("word"))


def word_table(posts: DataFrame, text_col="combined_text") -> DataFrame:
    """`word, n, symbols` of each distinct word, a symbol per character.

    Words are counted in each task before the shuffle.
    """
    counted = _exploded(posts, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.withColumn("symbols", F.regexp_replace("word", "(?s)(.)", "<$1>"))


def _symbols(column):
    """The symbols of a bracketed word."""
    return F.split(F.expr(f"substring({column}, 2, length({column}) - 2)"), "><")


def _pairs(symbols):
    """Adjacent symbols of a list of them, in order."""
    return F.zip_with(
        F.slice(symbols, F.lit(1), F.size(symbols) - 1),
        F.slice(symbols, F.lit(2), F.size(symbols) - 1),
        lambda left, right: F.struct(left.alias("left"), right.alias("right")),
    )


def _each_pair(table):
    """`left, right, n` of each place in each word with two symbols or more."""
    several = table.filter(F.col("symbols").contains("><"))
    # In a lambda the word is split once, and not wherever the list is named.
    pairs = F.flatten(F.transform(F.array(_symbols("symbols")), _pairs))
    return several.select("n", F.explode(pairs).alias("p")).select("p.left", "p.right", "n")


def _summed(pairs):
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def pair_counts(table: DataFrame) -> DataFrame:
    """`left, right, n` of adjacent symbols over all words."""
    return _summed(_each_pair(table.select("n", "symbols")))


def recounted(counts: DataFrame, table: DataFrame, left, right) -> DataFrame:
    """The `pair_counts` of `table` after `left` before `right` is joined, from those before.

    Only words that hold the pair are counted, as they were (less) and as they are (more).
    """
    before = F.struct((-F.col("n")).alias("n"), "symbols")
    after = F.struct("n", merged(F.col("symbols"), left, right).alias("symbols"))
    held = table.filter(F.col("symbols").contains(f"<{left}><{right}>"))
    both = held.select(F.explode(F.array(before, after)).alias("w")).select("w.n", "w.symbols")
    return _summed(counts.unionByName(_each_pair(both))).filter("n > 0")


def merged(symbols, left, right):
    """Bracketed symbols with each `left` before `right` joined, from the left."""
    return F.replace(symbols, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))


def learn(table: DataFrame, n_merges: int, least=2):
    """The merges as (left, right, n) in order, and the words with their symbols after them.

    A round joins the most frequent pair; of equal ones the first by left, then right. It
    ends early when no pair occurs `least` times. One row reaches the driver per round.
    """
    merges = []
    table = stage(table, "words")
    for k in range(n_merges):
        if k == 0:
            counts = stage(pair_counts(table), "pairs")
        best = counts.orderBy(F.desc("n"), "left", "right").first()
        if best is None or best["n"] < least:
            break
        merges.append((best["left"], best["right"], best["n"]))
        if k + 1 < n_merges:
            counts = stage(recounted(counts, table, best["left"], best["right"]), "pairs")
        table = table.withColumn("symbols", merged(F.col("symbols"), best["left"], best["right"]))
        if (k + 1) % STAGE_EVERY == 0:
            table = stage(table, "words")
    return merges, table


def subwords(text_col, merges, max_words=None):
    """The subword tokens of a text, by the merges in order; for texts with words not in a table."""
    bracketed = F.regexp_replace(F.array_join(words(F.col(text_col), max_words), " "), "(?s)([^ ])", "<$1>")
    for left, right, *_ in merges:
        bracketed = merged(bracketed, left, right)
    tokens = F.split(F.regexp_replace(bracketed, "> <", "><"), "><")
    return F.filter(F.transform(tokens, lambda t: F.btrim(t, F.lit("<>"))), lambda t: t != "")


def n_subwords(text, merges):
    """The number of `subwords` of a text. A symbol is one character, so a merge shortens the text by one."""
    codes: dict[str, str] = {}
    coded = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    for left, right, *_ in merges:
        code = codes.setdefault(left + right, chr(FIRST_CODE + len(codes)))
        coded = F.replace(coded, F.lit(codes.get(left, left) + codes.get(right, right)), F.lit(code))
    return F.length(F.replace(coded, F.lit(" "), F.lit(""))).cast("long")


def _sums_by_word(rows: DataFrame, table: DataFrame, id_col, text_col) -> DataFrame:
    """`_id, n_tokens` of the ids of posts with words.

    Frequent words meet a broadcast part of the table and are summed up where they are read; only
    the others are shuffled, as one row per post and word.
    """
    sizes = table.select(F.col("word").alias("_word"), F.size(_symbols("symbols")).alias("_size"), F.col("n").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    frequent = sizes.filter(F.col("_n") * FREQUENT_SHARE > total).select(
        F.col("_word").alias("_frequent"), F.col("_size").alias("_frequent_size")
    )
    each = rows.select(F.col(id_col).alias("_id"), F.explode(words(F.col(text_col))).alias("word"))
    met = each.join(F.broadcast(frequent), F.col("word") == F.col("_frequent"), "left")
    # The frequent words of a post are one row, dealt by a key that is no word: words are letters only.
    counts = met.groupBy("_id", F.when(F.col("_frequent").isNull(), F.col("word")).alias("_key")).agg(
        F.count("*").alias("_times"), F.sum("_frequent_size").alias("_frequent_tokens")
    )
    counts = counts.withColumn("_key", F.coalesce("_key", F.concat(F.lit("#"), F.col("_id").cast("string"))))
    tokens = F.coalesce("_frequent_tokens", F.col("_times") * F.col("_size"), F.lit(0))
    found = counts.join(sizes.drop("_n"), F.col("_key") == F.col("_word"), "left")
    return found.groupBy("_id").agg(F.sum(tokens).alias("n_tokens"))


def subword_counts(
    posts: DataFrame, table: DataFrame, id_col="submission_id", text_col="combined_text", limit=4096, merges=None
):
    """`id_col, n_tokens, n_used` of each post: its subword tokens, and those a model of `limit` sees.

    The tokens of a word are counted once, in `table`, which is joined to the words of the posts. Where
    `table` has all of these words and the `merges` behind it are given and few, they are counted in
    the texts instead, and no words are shuffled. A NULL text has NULL counts.
    """
    rows = posts.select(id_col, text_col)
    if merges is not None and len(merges) <= MOST_IN_TEXT:
        each = rows.select(F.col(id_col).alias("_id"), n_subwords(F.col(text_col), merges).alias("n"))
        sums = each.groupBy("_id").agg(F.sum("n").alias("n_tokens"))
    else:
        sums = _sums_by_word(rows, table, id_col, text_col)
    found = rows.select(id_col, F.col(text_col).isNotNull().alias("_has_text")).join(
        sums, F.col(id_col) == F.col("_id"), "left"
    )
    has, total = F.col("_has_text"), F.coalesce("n_tokens", F.lit(0))
    used = F.least(total, F.lit(limit))
    return found.select(id_col, F.when(has, total).alias("n_tokens"), F.when(has, used).alias("n_used"))
