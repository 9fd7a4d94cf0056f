"""The queries of these operators, each over the whole tables of a data folder."""

from pyspark.sql import functions as F

from verdictflow.llm import (
    centroids,
    decontaminate,
    embedding_dedup,
    exact_dedup,
    jaccard_join,
    lang_id,
    lm_score,
    mixing,
    quality,
    run_detect,
    secret_scan,
    toxicity,
    url_filter,
)
from verdictflow.llm.common import held_out

#: Fixed rules of the url query: host, path and verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def op1_lm_score(spark, d):
    """The language-model score of each document, from counts over all of them."""
    return lm_score.score_texts(read(spark, d, "documents"))


def op2_jaccard_join(spark, d):
    """The class of near copies of each document, and its number of links."""
    found = jaccard_join.join_similar(read(spark, d, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return found.select("doc_id", "class_id", "n_links", kept.alias("kept"))


def op3_embedding_dedup(spark, d):
    """The component of near-duplicate vectors of each vector."""
    return embedding_dedup.near_duplicates(read(spark, d, "embeddings"))


def op4_quality(spark, d):
    """The quality of each document."""
    docs = read(spark, d, "documents")
    views = quality.train(*quality.training_sample(docs, read(spark, d, "labels")))
    found = quality.score(docs, views, "found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def op5_language(spark, d):
    """The language of each document."""
    docs = read(spark, d, "documents")
    net = lang_id.train(lang_id.training_sample(docs))
    found = lang_id.identify(docs.select("doc_id", "text"), net, "found")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score"
    )


def op6_decontaminate(spark, d):
    """The words of each document that lie in a window of a test item."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, read(spark, d, "benchmark"), "overlap")
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


def op7_toxicity(spark, d):
    """The toxicity of each document, with the offsets of its toxic words."""
    docs = read(spark, d, "documents")
    field = toxicity.train(toxicity.training_sample(docs, read(spark, d, "labels")))
    found = toxicity.score(docs.select("doc_id", "text"), field, "found")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "found.score",
        "found.predicted",
        "found.spans",
    )


def op8_url_filter(spark, d):
    """The verdict on each page's url."""
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    judged = url_filter.filter_pages(read(spark, d, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_secret_scan(spark, d):
    """The secrets in each document."""
    found = secret_scan.scan(read(spark, d, "documents"))
    base = secret_scan.listed(F.col("base"))
    return found.select(
        "doc_id",
        *[secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op10_mix(spark, d):
    """How many words of each document the mix takes."""
    chosen, quotas = mixing.mix(read(spark, d, "documents"))
    # One row per source.
    quotas = F.broadcast(quotas.withColumnRenamed("source", "of_source"))
    return chosen.join(quotas, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        "source",
        "members",
        "repeats",
    )


_BLANKS = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs):
    """`docs` in which each tenth text, by the hash of its id, ends in repetitions."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", _BLANKS), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    p = F.lit(1) + F.floor(rest / (3 + F.col("g") % 8))
    rows = rows.withColumn("p", p.cast("int")).withColumn("rest", rest.cast("int"))
    period = F.slice("words", F.col("a").cast("int") + 1, F.col("p"))
    times = F.ceil(F.col("rest") / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(period, times)), 1, F.col("rest"))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, d):
    """The periodic runs of each document."""
    found = run_detect.find_runs(with_planted_runs(read(spark, d, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # Of equal quotients the run that comes first stays.
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(
            r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"], r
        ).otherwise(best),
    )
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_centroids(spark, d):
    """The cluster of each vector."""
    found = centroids.cluster(read(spark, d, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def op13_exact_dedup(spark, d):
    """The group of equal texts of each document."""
    return exact_dedup.find_copies(read(spark, d, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_mix": op10_mix,
    "op11_runs": op11_runs,
    "op12_centroids": op12_centroids,
    "op13_exact_dedup": op13_exact_dedup,
}
