"""Quality classification by co-training.

Two logistic regressions look at a document from two sides: one at its text (shapes of
words, shares of kinds of characters, repetition), the other at what is known of the page
(source, language, length). Both learn from labelled documents; then, over some rounds,
each labels the unlabelled documents it is surest of for the other one. At last both are
calibrated on labelled documents they have not learned from and combined.

Features are computed in the tasks; only feature vectors of a bounded sample reach the
driver.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import common
from verdictflow.llm.common import sigmoid

#: Training sample: so many labelled documents of each label, so many without a label.
PER_LABEL = 1_500
UNLABELLED = 3_000
ROUNDS = 4
#: In a round each view labels this share of the unlabelled documents, the surest of each label.
SURE_SHARE = 0.05
SEED = 9
SHAPES = 128
HASHED_SOURCES, HASHED_LANGS = 64, 16

_KIND = bytearray(b"o" * 256)
for _c in range(256):
    ch = chr(_c)
    if "a" <= ch <= "z" or _c >= 128:
        _KIND[_c] = ord("a")
    elif "A" <= ch <= "Z":
        _KIND[_c] = ord("A")
    elif ch.isdigit():
        _KIND[_c] = ord("9")
    elif _c in b" \t\r":
        _KIND[_c] = ord(" ")
    elif ch == "\n":
        _KIND[_c] = ord("\n")
    elif 33 <= _c < 127:
        _KIND[_c] = _c
_KIND = bytes(_KIND)
_CACHE = 200_000


def _shape(token: bytes) -> int:
    """The bucket of a word's shape: kinds of characters, runs of a kind as one."""
    squeezed = bytes(c for i, c in enumerate(token) if i == 0 or c != token[i - 1])
    return zlib.crc32(squeezed[:12]) % SHAPES


def content_features(text: str | None, shapes: dict[bytes, int]) -> np.ndarray:
    """The text side of a document; an empty text has zeros. `shapes` keeps known words."""
    out = np.zeros(SHAPES + 10)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    kinds = data.translate(_KIND)
    tokens = kinds.split()
    for t in tokens:
        if t not in shapes:
            shapes[t] = _shape(t)
    if len(shapes) > _CACHE:
        shapes.clear()
        shapes.update((t, _shape(t)) for t in set(tokens))
    places = np.fromiter(map(shapes.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    n_tokens, n = max(1, len(tokens)), len(data)
    out[:SHAPES] = np.sqrt(np.bincount(places, minlength=SHAPES) / n_tokens)
    lines = data.split(b"\n")
    words = data.split()
    out[SHAPES:] = [
        kinds.count(b"a") / n,
        kinds.count(b"A") / n,
        kinds.count(b"9") / n,
        (kinds.count(b" ") + kinds.count(b"\n")) / n,
        np.log1p(n) / 12,
        np.log1p(len(lines)) / 6,
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / max(1, len(words)),
        min(1.0, n / n_tokens / 20),
        data.count(b"|") / n_tokens,
    ]
    return out


def meta_features(source, lang, n_chars) -> np.ndarray:
    """The page side of a document; NULL is a value of its own."""
    out = np.zeros(HASHED_SOURCES + HASHED_LANGS + 2)
    name = lambda v: "null" if v is None else f"v{v}"
    out[zlib.crc32(name(source).encode()) % HASHED_SOURCES] = 1
    out[HASHED_SOURCES + zlib.crc32(name(lang).encode()) % HASHED_LANGS] = 1
    missing = n_chars is None or n_chars != n_chars
    out[-2:] = [0 if missing else np.log1p(max(0, n_chars)) / 12, missing]
    return out


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes: dict[bytes, int] = {}
    for batch in batches:
        content = [content_features(t, shapes) for t in batch["text"]]
        meta = [
            meta_features(*row) for row in batch[["source", "lang", "n_chars"]].itertuples(index=False)
        ]
        yield pd.DataFrame({"label": batch["label"], "content": content, "meta": meta})


@dataclass
class Views:
    content: np.ndarray
    meta: np.ndarray
    #: Weights of both views' log-odds and a bias.
    link: np.ndarray


def _log_odds(w, x):
    return x @ w[:-1] + w[-1]


def train(labelled, unlabelled, prior: float, rounds=ROUNDS, seed=SEED) -> Views | None:
    """Views from (label, content, meta) rows and (content, meta) rows; None without both labels.

    `prior` is the share of label 1 among all labelled documents; the sample holds both
    labels evenly, and calibration restores the share.
    """
    y = np.array([r[0] for r in labelled], dtype=float)
    if len(set(y)) < 2:
        return None
    sides = [np.array([r[k] for r in labelled], dtype=float) for k in (1, 2)]
    pool = [
        np.array([r[k] for r in unlabelled], dtype=float).reshape(len(unlabelled), -1) for k in (0, 1)
    ]
    learn = np.random.default_rng(seed).random(len(y)) < 0.7
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn = np.ones(len(y), dtype=bool)
    given = [np.full(len(unlabelled), np.nan) for _ in sides]  # labels from the other view
    views = [None, None]
    for round_ in range(rounds + 1):
        for k in (0, 1):
            more = ~np.isnan(given[k])
            x = np.concatenate([sides[k][learn], pool[k][more]]) if more.any() else sides[k][learn]
            views[k] = common.fit_logistic(x, np.concatenate([y[learn], given[k][more]]))
        if round_ == rounds or not len(unlabelled):
            break
        for k in (0, 1):
            odds = _log_odds(views[k], pool[k])
            count = max(1, int(SURE_SHARE * len(odds)))
            free = np.flatnonzero(np.isnan(given[1 - k]))
            for label, order in ((1, -odds), (0, odds)):
                best = free[np.argsort(order[free], kind="stable")[:count]]
                sure = best[odds[best] > 1] if label else best[odds[best] < -1]
                given[1 - k][sure] = label
    check = ~learn if (~learn).any() else learn
    odds = np.column_stack([_log_odds(v, s[check]) for v, s in zip(views, sides)])
    link = common.fit_logistic(odds, y[check], l2=1e-2)
    even = y[check].mean()
    link[-1] += np.log(prior / (1 - prior)) - np.log(even / (1 - even))
    return Views(views[0], views[1], link)


def training_sample(docs: DataFrame, labels: DataFrame, label="quality", seed=SEED):
    """(labelled rows, unlabelled rows, share of label 1): see PER_LABEL and UNLABELLED.

    Nothing of the held-out fold is used. An id labelled twice has its highest label.
    """
    ids = (
        labels.filter(F.col(label).isin(0, 1) & ~common.held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull())
    )
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    drawn = common.sample_per_class(ids, "label", PER_LABEL, order)
    others = (
        docs.select("doc_id")
        .filter(~common.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .join(labels.select("doc_id"), "doc_id", "left_anti")
        .orderBy(order, "doc_id")
        .limit(UNLABELLED)
        .withColumn("label", F.lit(-1))
    )
    # At most 2 * PER_LABEL + UNLABELLED ids.
    chosen = F.broadcast(drawn.select("doc_id", "label").union(others.distinct()))
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").join(chosen, "doc_id")
    rows = rows.select("text", "source", "lang", "n_chars", "label").mapInPandas(
        _features, "label int, content array<double>, meta array<double>"
    )
    found = rows.collect()
    labelled = [(r["label"], r["content"], r["meta"]) for r in found if r["label"] >= 0]
    unlabelled = [(r["content"], r["meta"]) for r in found if r["label"] < 0]
    total = sum(counts.values())
    return labelled, unlabelled, counts.get(1, 0) / total if total else 0.5


def _scorer(views: Views | None):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        shapes: dict[bytes, int] = {}
        for texts, sources, langs, sizes in batches:
            if views is None:
                part = np.full((len(texts), 3), 0.5)
            else:
                content = np.array([content_features(t, shapes) for t in texts]).reshape(len(texts), -1)
                meta = np.array([meta_features(*v) for v in zip(sources, langs, sizes)])
                odds = np.column_stack(
                    [_log_odds(views.content, content), _log_odds(views.meta, meta)]
                )
                part = np.column_stack([sigmoid(odds), sigmoid(_log_odds(views.link, odds))])
            scores = pd.DataFrame(part, columns=["content_score", "meta_score", "score"])
            yield scores.assign(predicted=(scores["score"] >= 0.5).astype("int32"))

    return F.pandas_udf(
        run, "content_score double, meta_score double, score double, predicted int"
    )


def score(docs: DataFrame, views: Views | None, into: str) -> DataFrame:
    """`docs` with a struct (content_score, meta_score, score, predicted) in `into`.

    Whole texts are read. `score` is the combined probability of good quality. A NULL or
    empty text has text features of zero, NULLs among the page columns are values of their
    own. Without views all scores are 0.5.
    """
    return docs.withColumn(
        into, _scorer(views)("text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double"))
    )
