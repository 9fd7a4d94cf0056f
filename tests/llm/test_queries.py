"""The queries of the training-data operators: against SQL, brute force and held-out labels."""

import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import difference, duck
from verdictflow.llm import jaccard_join
from verdictflow.llm.mixing import targets_for
from verdictflow.llm.oracle import ORACLES
from verdictflow.llm.queries import QUERIES
from verdictflow.session import stage

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="module")
def db():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, SMALL, QUERIES[name], ORACLES[name], db) is None


def _accuracy(spark, name, predicted, right):
    found = QUERIES[name](spark, LARGER)
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    rows = found.filter("held_out").join(right, "doc_id").filter(F.col("truth").isNotNull())
    return rows.agg(F.avg((F.col(predicted) == F.col("truth")).cast("double"))).first()[0]


def test_languages_of_the_held_out_fold(spark):
    right = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    assert _accuracy(spark, "op5_language", "lang_pred", right) > 0.95


@pytest.mark.parametrize(
    "name, label, least, area", [("op7_toxicity", "toxic", 0.9, 0.9), ("op4_quality", "quality", 0.95, 0.95)]
)
def test_labels_of_the_held_out_fold(spark, name, label, least, area):
    right = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    found = QUERIES[name](spark, LARGER)
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    rows = found.filter("held_out").join(right, "doc_id").filter("truth is not null").collect()
    hits = sum(r["predicted"] == r["truth"] for r in rows)
    assert hits > least * len(rows)
    yes = [r["score"] for r in rows if r["truth"] == 1]
    no = [r["score"] for r in rows if r["truth"] == 0]
    # The area under the curve; answering alike for all has 0.5.
    above = sum((a > b) + (a == b) / 2 for a in yes for b in no)
    assert above > area * len(yes) * len(no)


def _targets(sizes):
    """Targets by weights 5, 2, 1 in code point order, none above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, free, rest = {}, set(order), sum(sizes.values())
    while True:
        unit = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {**targets, **{s: unit * weight[s] for s in free}}
        targets.update({s: 3 * sizes[s] for s in over})
        rest -= sum(3 * sizes[s] for s in over)
        free -= over


def test_mix_meets_its_targets(spark):
    rows = QUERIES["op10_mix"](spark, LARGER).collect()
    again = QUERIES["op10_mix"](spark, LARGER).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    texts = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in texts}
    of_source = defaultdict(int)
    for r in texts:
        of_source[r["source"]] += size[r["doc_id"]]
    targets = _targets(of_source)
    assert targets == pytest.approx(targets_for(of_source, sum(of_source.values())))
    assert sum(targets.values()) == pytest.approx(sum(of_source.values()))
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == of_source[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.05)


def _classes(texts):
    """Class of each id, by comparing all pairs."""
    runs = {}
    for i, text in texts.items():
        words = words_of(text)
        size = min(5, len(words))
        runs[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()
    label = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        shared = len(runs[a] & runs[b])
        if shared and shared >= 0.8 * len(runs[a] | runs[b]) - 1e-9:
            low, high = sorted((label[a], label[b]))
            label = {i: low if at == high else at for i, at in label.items()}
    return label


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = set(docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near copies", "test items", "secrets", "mix"]

    def after(name, rows):
        kept = stage(stages[name](spark, rows, SMALL), "tested")
        return kept, {r["doc_id"]: r["text"] for r in kept.collect()}

    first, kept = after("toxicity", docs)
    rejected = {r["doc_id"] for r in QUERIES["op7_toxicity"](spark, SMALL).filter("predicted = 1").collect()}
    assert set(kept) == {r["doc_id"] for r in docs.collect()} - rejected

    second, once = after("near copies", first)
    label = _classes(kept)
    assert set(once) == {i for i in kept if label[i] == i}

    third, cut = after("test items", second)
    windows = set()
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = words_of(item["text"])
        n = min(10, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    for i, text in once.items():
        words = words_of(text)
        hit = any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words)))
        assert (cut.get(i) != text) == hit

    fourth, masked = after("secrets", third)
    assert set(masked) == set(cut)
    assert all(set(s.columns) == columns for s in (first, second, third, fourth))
    assert all("AKIA" not in (t or "") for t in masked.values())

    _, mixed = after("mix", fourth)
    assert set(mixed.items()) <= set(masked.items()) and mixed
    whole = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == mixed


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = jaccard_join.least_matches()
    assert (fewest[1:] >= fewest[:-1]).all()
    assert fewest[-1] < 0.8 * jaccard_join.COMPARED
