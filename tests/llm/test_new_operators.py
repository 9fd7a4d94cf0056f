"""Run detection, centroid clustering, exact duplicates and language-model scores against brute force."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import centroids, exact_dedup, lm_score, run_detect

WORDS = "a b c d e".split()


def brute_runs(words):
    """(start, length, period) of every run, by looking at every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, kinds = rng.randint(0, rng.choice([8, 40, 200])), rng.randint(1, 5)
        words = [rng.choice(WORDS[:kinds]) for _ in range(size)]
        if words and rng.random() < 0.6:
            at = rng.randrange(size)
            period = rng.randint(1, max(1, (size - at) // 3))
            words = [words[i] if i < at else words[at + (i - at) % period] for i in range(size)]
            words += rng.choices(WORDS, k=rng.randint(0, 9))
        yield words


def _as_numbers(words):
    return np.array([WORDS.index(w) for w in words], dtype=np.int64)


def test_runs_equal_brute_force_in_pieces_of_several_texts():
    texts = list(_random_texts(1, 900))
    at, n_runs = 0, 0
    rng = random.Random(2)
    while at < len(texts):
        part = texts[at : at + rng.randint(1, 9)]
        at += len(part)
        for words, runs in zip(part, run_detect.runs_in([_as_numbers(w) for w in part])):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(words)
            n_runs += len(runs)
    assert n_runs > 300


def test_grid_in_small_blocks(monkeypatch):
    monkeypatch.setattr(run_detect, "BLOCK", 7)
    texts = list(_random_texts(3, 60))
    for words, runs in zip(texts, run_detect.runs_in([_as_numbers(w) for w in texts])):
        assert [tuple(r) for r in runs.tolist()] == brute_runs(words)


@pytest.mark.parametrize("seed", range(4))
def test_common_extensions(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 + seed, 300)
    words[120:200] = words[20:100]
    words = np.append(words, 99)
    ahead = run_detect.CommonExtensions(words)
    i, j = rng.integers(0, 300, (2, 2000))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, ahead(i, j)):
        most = 301 - max(a, b)
        same = words[a : a + most] == words[b : b + most]
        assert n == (most if same.all() else int(np.argmin(same)))


def test_a_long_text_of_one_word_is_one_run():
    (runs,) = run_detect.runs_in([np.zeros(100_000, dtype=np.int64)])
    assert runs.tolist() == [[0, 100_000, 1]]


def test_runs_of_rows(spark):
    texts = [" ".join(w) for w in _random_texts(5, 150)]
    odd = [None, "", " \t\n ", "x " * 6, "x " * 5, "é é " * 7, "y\x0by\x0cy\ry\ny\ty", "a b " * 4 + "c"]
    rows = [(i, t) for i, t in enumerate(texts + odd)] + [(None, "x x x x x x x"), (3, texts[3]), (2**60 + 1, "q")]
    docs = spark.createDataFrame([(i, t, "z", "z") for i, t in rows], "doc_id long, text string, runs string, n_words string")
    found = run_detect.find_runs(docs).collect()
    expected = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        expected.append((i, len(words), runs, kept))
    key = repr
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=key) == sorted(
        expected, key=key
    )
    assert run_detect.find_runs(docs.limit(0)).collect() == []


def test_the_best_run_is_by_exact_quotient(spark, tmp_path):
    from verdictflow.llm.queries import op11_runs

    texts = {i: " ".join(w) for i, w in enumerate(_random_texts(8, 300))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for row in op11_runs(spark, str(tmp_path)).collect():
        words = texts[row.doc_id].split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()


# Clustering


def brute_clusters(rows, clusters, rounds):
    """Cluster and distance of each (id, whole vector), and the centroids."""
    name = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    start = sorted(rows, key=lambda r: (name(r[0]), r[1]))[:clusters]
    middle = [list(v) for _, v in start]
    for step in range(rounds + 1):
        placed = []
        for _, v in rows:
            best = min(range(len(middle)), key=lambda k: (sum((x - y) ** 2 for x, y in zip(v, middle[k])), k))
            placed.append((best, sum((x - y) ** 2 for x, y in zip(v, middle[best]))))
        if step < rounds:
            for k in range(len(middle)):
                own = [v for (_, v), (c, _) in zip(rows, placed) if c == k]
                if own:
                    middle[k] = [sum(x) // len(own) for x in zip(*own)]
    return placed, middle


def _vectors(seed, n, dim, spread):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + rng.uniform(-spread, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("dim, clusters, pivots, spread", [(2, 5, 3, 1.0), (6, 9, 4, 0.1), (6, 9, 1, 0.3), (3, 4, 12, 0.0)])
def test_clusters_equal_brute_force(spark, dim, clusters, pivots, spread):
    rows = _vectors(dim, 120, dim, spread)
    rows += [(7, rows[7][1]), (None, rows[0][1]), (200, [0.0] * dim)]
    odd = [(300, None), (301, [1.0]), (302, [float("nan")] + [0.0] * (dim - 1)), (303, [None] * dim), (304, [float("inf")] * dim)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string")
    found = centroids.cluster(frame, dim=dim, clusters=clusters, rounds=3, pivots=pivots).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    placed, middle = brute_clusters(whole, clusters, 3)
    own = Counter()
    for k, d in placed:
        own[k] += d
    expected = [
        (i, k, d, own[k], sum(own.values()), ",".join(map(str, middle[k]))) for (i, _), (k, d) in zip(whole, placed)
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64)], schema)
    assert {(r.cluster, r.distance) for r in centroids.cluster(same).collect()} == {(0, 0)}
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []


def test_bounds_hold_and_rule_out_most_centroids():
    rng = np.random.default_rng(0)
    middle = rng.integers(-256, 256, (40, 16))
    vectors = (middle[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(np.int64)
    simplex = centroids.Simplex(middle, 12)
    points, over = simplex.points(vectors), simplex.points(middle)
    exact = np.sqrt(centroids.squares(vectors, middle))
    flat = ((points[:, None, :-1] - over[None, :, :-1]) ** 2).sum(axis=2)
    lower = np.sqrt(flat + (points[:, None, -1] - over[None, :, -1]) ** 2)
    upper = np.sqrt(flat + (points[:, None, -1] + over[None, :, -1]) ** 2)
    assert (lower <= exact + 1e-6).all() and (exact <= upper + 1e-6).all()
    assert (lower <= upper.min(axis=1, keepdims=True) + 1e-6).mean() < 0.2
    number, distance = centroids.Nearest(simplex, middle)(vectors, points)
    squared = centroids.squares(vectors, middle)
    assert (number == squared.argmin(axis=1)).all() and (distance == squared.min(axis=1)).all()


# Exact duplicates


def test_quotient_filters_give_back_what_was_put_in():
    rng = np.random.default_rng(1)
    for skip, n in [(8, 0), (8, 1), (8, 300), (3, 5000), (0, 40)]:
        prints = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(skip)) | np.uint64(
            (5 % (1 << skip)) << (64 - skip) if skip else 0
        )
        counts = rng.integers(1, 4, len(prints))
        built = exact_dedup.QuotientFilter.build(prints, counts, skip)
        back, times = built.entries(5 % (1 << skip))
        assert (back == prints).all() and (times == counts).all()


def test_merging_filters_adds_counts():
    a = (np.array([1, 5, 9], dtype=np.uint64), np.array([1, 2, 1]))
    b = (np.array([5, 9, 11], dtype=np.uint64), np.array([1, 1, 7]))
    prints, counts = exact_dedup.merged([a, b])
    assert prints.tolist() == [1, 5, 9, 11] and counts.tolist() == [1, 3, 2, 7]


def _copies(spark, rows):
    docs = spark.createDataFrame([(i, t, "p", "k") for i, t in rows], "doc_id long, text string, print string, kept string")
    return sorted((tuple(r) for r in exact_dedup.find_copies(docs).collect()), key=repr)


def _expected_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    result = []
    for text, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        result += [(i, last, len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(result, key=repr)


def test_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(300)]
    rows += [(1000 + i, "hot " * 50) for i in range(150)] + [(2**60 + i, f"alone {i}") for i in range(50)]
    rows += [(None, "text 1"), (None, None), (5, None), (6, ""), (6, ""), (7, "twice"), (7, "twice"), (None, "nobody"), (None, "nobody")]
    rows += [(8, "a"), (9, "a "), (10, "A"), (11, "é"), (12, "é")]
    assert _copies(spark, rows) == _expected_copies(rows)
    # One mark for all: every text is routed and compared as a whole.
    monkeypatch.setattr(exact_dedup, "LEAST_MARKS", 64)
    monkeypatch.setattr(exact_dedup, "MOST_MARKS", 64)
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", 16)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    assert _copies(spark, rows) == _expected_copies(rows)
    assert _copies(spark, []) == []


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: F.lit(12345).cast("long"))
    assert _copies(spark, rows) == _expected_copies(rows)


# Language model


def _plain_scores(texts, order, min_count, backoff=0.4):
    micro = lambda x: int(np.round(np.log(x) * 1e6))
    counts = Counter()
    for words in texts:
        for k in range(1, order + 1):
            counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    total = max(1, sum(len(words) for words in texts))
    result = []
    for words in texts:
        sum_ = 0
        for i in range(len(words)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                n = counts[tuple(words[i - k + 1 : i + 1])]
                if k == 1 or n >= min_count:
                    before = counts[tuple(words[i - k + 1 : i])] if k > 1 else total
                    sum_ += micro(n) - micro(before) + (longest - k) * micro(backoff)
                    break
        result.append((len(words), sum_))
    return result


@pytest.mark.parametrize("order, min_count, chunk", [(1, 2, 10**6), (2, 2, 10**6), (3, 2, 25), (3, 3, 1), (5, 2, 40)])
def test_scores_equal_the_plain_computation(spark, monkeypatch, order, min_count, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk)
    rng = random.Random(order)
    texts = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))] for _ in range(80)]
    texts += [texts[0]] * 5 + [["a"] * 400]
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    found = lm_score.score_texts(docs, order=order, min_count=min_count).collect()
    found = [(r.n_words, r.micro_score) for r in sorted(found)]
    assert found == _plain_scores(texts, order, min_count)


def test_packed_numbers_and_counts_come_back():
    rng = np.random.default_rng(3)
    for prints in (np.array([7], np.uint64), np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)), np.array([0, 2**64 - 1], np.uint64)):
        assert (lm_score._unpacked(lm_score._packed(prints)) == prints).all()
    counts = np.array([1, 254, 255, 256, 3, 10**12])
    assert (lm_score._from_counts(lm_score._counts(counts), len(counts)) == counts).all()
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert (lm_score._from_planes(lm_score._planes(numbers)) == numbers).all()
