"""Language identification with a byte convolutional network.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide over
a window, each keeps its largest response, and a softmax layer turns these into
probabilities. A text has the mean log-probability of its windows, weighted by their
letters. The network is trained in numpy on a bounded sample of labelled text and applied to
batches of windows of whole texts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Training sample: so many texts of a language, and about so many windows of each, drawn by seed
#: from the whole text.
PER_LANGUAGE = 1_000
SAMPLE_WINDOWS = 4
EPOCHS = 6
SEED = 5
UNKNOWN = "und"

#: Bytes are read by class: 0 for all that is no letter, a-z in either case, then the bytes
#: of other characters, with the capitals of the Latin-1 letters as small ones.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_CLASS[0x80:0x97] = _CLASS[0xA0:0xB7]
_CLASS[0x98:0x9F] = _CLASS[0xB8:0xBF]
_CLASS_TABLE = _CLASS.tobytes()
CLASSES = 155
_REACH = max(WIDTHS) - 1
_ROWS = 64


@dataclass
class Network:
    languages: list[str]
    #: By offset from the filter's first byte: class -> responses of all filters that reach it.
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _new_network(languages, rng) -> Network:
    tables = []
    for offset in range(max(WIDTHS)):
        wide = FILTERS * sum(w > offset for w in WIDTHS)
        tables.append(rng.normal(0, 0.3, (CLASSES, wide)).astype(np.float32))
    total = FILTERS * len(WIDTHS)
    out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
    return Network(
        languages,
        tables,
        np.zeros(total, dtype=np.float32),
        out,
        np.zeros(len(languages), dtype=np.float32),
    )


def windows_of(text: str) -> np.ndarray:
    """The windows of a text as rows of byte classes; each sees the first bytes of the next.

    The last is filled up with class 0. An empty text has one window.
    """
    data = text.encode("utf-8", "replace").translate(_CLASS_TABLE)
    count = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(count * WINDOW + _REACH, dtype=np.uint8)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + _REACH)[::WINDOW]


def _responses(net: Network, rows: np.ndarray) -> np.ndarray:
    """Responses (window, position, filter); widest filters come last."""
    n = len(rows)
    found = np.empty((n, WINDOW, len(net.bias)), dtype=np.float32)
    np.take(net.tables[0], rows[:, :WINDOW], axis=0, out=found)
    for offset in range(1, max(WIDTHS)):
        table = net.tables[offset]
        found[:, :, -table.shape[1] :] += table[rows[:, offset : offset + WINDOW]]
    return found


def log_probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities (window, language) of windows, a few at a time."""
    pooled = np.empty((len(rows), len(net.bias)), dtype=np.float32)
    for at in range(0, len(rows), _ROWS):
        pooled[at : at + _ROWS] = _responses(net, rows[at : at + _ROWS]).max(axis=1)
    scores = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _gradients(net: Network, rows, labels):
    """Of the mean cross-entropy, in the order of tables, bias, out, out_bias."""
    n, total = len(rows), len(net.bias)
    found = _responses(net, rows)
    place = found.argmax(axis=1)
    pooled = np.take_along_axis(found, place[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(pooled, 0)
    scores = hidden @ net.out + net.out_bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p /= n
    down = (p @ net.out.T) * (pooled > 0)
    tables = []
    for offset, table in enumerate(net.tables):
        wide = table.shape[1]
        seen = rows[np.arange(n)[:, None], place[:, total - wide :] + offset].astype(np.int64)
        cell = seen * wide + np.arange(wide)
        grad = np.bincount(cell.ravel(), down[:, total - wide :].ravel(), CLASSES * wide)
        tables.append(grad.reshape(CLASSES, wide).astype(np.float32))
    return [*tables, down.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def train(samples: list[tuple[str, str]], epochs=EPOCHS, seed=SEED) -> Network | None:
    """A network from (text, language) pairs; None if there are none."""
    languages = sorted({language for _, language in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for text, language in sorted(samples):
        own = windows_of(text)
        own = own[(own > 0).sum(axis=1) >= WINDOW // 8] if len(own) > 1 else own
        rows.append(own)
        labels += [languages.index(language)] * len(own)
    rows, labels = np.concatenate(rows), np.array(labels)
    net = _new_network(languages, rng)
    adam = common.Adam([*net.tables, net.bias, net.out, net.out_bias], 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), _ROWS):
            pick = order[at : at + _ROWS]
            adam.step(_gradients(net, rows[pick], labels[pick]))
    return net


def training_sample(docs: DataFrame, text="text", lang="lang", doc_id="doc_id", seed=SEED):
    """(text, language) pairs for training: see PER_LANGUAGE and SAMPLE_WINDOWS.

    Only rows with a text that has a letter, a language, and an id out of the held-out fold.
    """
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    rows = docs.filter(
        ~common.held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    ).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), order.alias("order"))
    # Languages are counted without reading the texts.
    counted = docs.select(F.col(lang).cast("string").alias("lang"))
    picked = common.sample_per_class(rows, "lang", PER_LANGUAGE, F.col("order"), counted)
    # At most PER_LANGUAGE texts of each language.
    return [(r["text"], r["lang"]) for r in picked.select(_windows("text", "order").alias("text"), "lang").collect()]


def _windows(text: str, order: str):
    """The seeded windows of a text, in order; a short one as a whole."""
    number = F.ceil(F.length(text) / WINDOW).cast("int")
    drawn = F.filter(
        F.sequence(F.lit(0), number - 1),
        lambda k: F.pmod(F.xxhash64(F.col(order), k), number.cast("long")) < SAMPLE_WINDOWS,
    )
    pieces = F.transform(drawn, lambda k: F.substr(F.col(text), k * WINDOW + 1, F.lit(WINDOW)))
    return F.when(number <= SAMPLE_WINDOWS, F.col(text)).otherwise(F.array_join(pieces, " "))


def _identify(net: Network | None):
    def row(text):
        letters = bool(text) and any(c.isalpha() for c in text)
        if net is None or not letters:
            return UNKNOWN, 0.0
        rows = windows_of(text)
        weight = (rows[:, :WINDOW] > 0).sum(axis=1).astype(float)
        weight = weight if weight.sum() else np.ones(len(rows))
        mean = (log_probabilities(net, rows) * weight[:, None]).sum(axis=0) / weight.sum()
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return net.languages[best], float(p[best] / p.sum())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([row(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, net: Network | None, into: str, text="text") -> DataFrame:
    """`docs` with a struct (lang_pred, score) in the new column `into`.

    Only the text is read. A NULL text and one without a letter is `und` with score 0, as is
    every text if there is no network. Equal texts have equal results.
    """
    return docs.withColumn(into, _identify(net)(F.col(text)))
