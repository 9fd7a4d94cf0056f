"""Toxicity with a linear-chain conditional random field.

The field tags the words of a sentence as clean or toxic. A word speaks through hashed
features (the word, its beginnings and its end), neighbours through transition weights.
Forward-backward gives each word its marginal probability of being toxic; marginals of a
document are summed up to a score, words with a high one are its offending spans.

Labels mark documents, so the words of the training sample are labelled first: a word is
toxic in a toxic document if one of its features is found in many toxic and in next to no
other documents. Training runs in numpy on a bounded sample; scoring maps whole texts in
Arrow batches.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import common
from verdictflow.llm.common import Adam, sigmoid

#: Training sample: so many documents of each label. Of one with more than so many characters
#: about as many are taken, in whole sentences drawn by seed from all of them.
PER_LABEL = 2_000
SAMPLE_CHARS = 20_000
SEED = 3
BUCKETS = 1 << 20
#: A sentence ends at one of these characters, or after so many words.
ENDS = ".!?\n"
SENTENCE_WORDS = 256
#: Clean sentences in training for each one with a toxic word.
CLEAN_PER_TOXIC = 8
#: A feature marks words as toxic if this share of toxic documents has it, and so few others.
LEAST_SHARE = 0.01
LEAST_DOCS = 4
PURITY = 0.98
REJECT = 0.3
#: Words of whole sentences that a step of the training works on at once, which bounds its arrays.
STEP_WORDS = 1 << 17
#: Words whose emission a Python worker keeps; beyond that it starts anew.
_CACHE = 120_000
#: Texts of the training sample that are scored together.
_TOGETHER = 50

#: Characters of the texts that a Python worker scores together, or one text.
_PIECE_CHARS = 1_000_000

RESULT = "score double, predicted int, spans array<struct<begin:int,end:int>>"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_FIELDS = [
    pa.field("score", pa.float64()),
    pa.field("predicted", pa.int32()),
    pa.field("spans", pa.list_(pa.field("element", _SPAN))),
]

_END = b"."
_TABLE = bytearray(common._WORD_BYTES)
for _c in ENDS:
    _TABLE[ord(_c)] = ord(_END)
_TABLE = bytes(_TABLE)


PREFIXES = (4, 5, 6, 7)


def features(word: bytes, solo=frozenset()) -> list[str]:
    """The word, its beginnings and its end, counted in characters; of `solo` words the word."""
    w = word.decode("utf-8", "replace")
    if word in solo:
        return [f"w{w}"]
    return [f"w{w}", f"z{w[-3:]}", *[f"{n}{w[:n]}" for n in PREFIXES]]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def sentences(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a text, and where its sentences begin and end."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    tokens = data.replace(_END, b" . ").split()
    stop = np.fromiter((t == _END for t in tokens), dtype=bool, count=len(tokens))
    words = [t for t in tokens if t != _END]
    sentence = np.cumsum(stop)[~stop]
    return words, *_bounds(sentence)


def _bounds(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of equal numbers, cut at SENTENCE_WORDS."""
    n = len(sentence)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.diff(sentence, prepend=sentence[0] - 1))
    size = np.diff(np.append(begin, n))
    parts = -(-size // SENTENCE_WORDS)
    first = np.repeat(begin, parts)
    number = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first + number * SENTENCE_WORDS
    return start, np.minimum(start + SENTENCE_WORDS, np.repeat(begin + size, parts))


def marginals(emission: np.ndarray, begin, end, trans: np.ndarray) -> tuple:
    """Log-odds of toxic against clean of each word, by forward-backward.

    `trans[a, b]` weighs the step from tag a to tag b. Also returns the log-odds passed
    forward and backward, without the emission of the word itself.
    """
    order = np.argsort(begin - end, kind="stable")
    begin, end = begin[order], end[order]
    size = end - begin
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    t = np.exp(trans)
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -n, side="left")) for n in range(longest + 1)]
    for n in range(1, longest):  # sentences longer than n come first
        at = begin[: active[n]] + n
        odds = np.exp(np.clip(forward[at - 1] + emission[at - 1], -40, 40))
        forward[at] = np.log((odds * t[1, 1] + t[0, 1]) / (odds * t[1, 0] + t[0, 0]))
    for n in range(1, longest):
        at = end[: active[n]] - 1 - n
        odds = np.exp(np.clip(backward[at + 1] + emission[at + 1], -40, 40))
        backward[at] = np.log((odds * t[1, 1] + t[1, 0]) / (odds * t[0, 1] + t[0, 0]))
    return emission + forward + backward, forward, backward


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    #: Of the document score: weights of `summary` and a bias.
    link: np.ndarray
    #: Toxic words that say nothing about others that begin alike.
    solo: frozenset

    def emission(self, word: bytes) -> float:
        return self.bias + float(sum(self.weights[bucket(f)] for f in features(word, self.solo)))


def summary(odds: np.ndarray) -> tuple[float, float]:
    """What a document's score is made of: its most toxic word, and how many there are."""
    if not len(odds):
        return -10.0, 0.0
    p = sigmoid(odds)
    return float(np.clip(odds.max(), -10, 10)), float(np.log1p(p[p > 0.1].sum()))


def label_words(docs: list[list[bytes]], toxic: list[int]) -> tuple[set[str], frozenset]:
    """The features that mark a word of a toxic document as toxic, and the solo words.

    A word that makes up nearly all documents with its beginning marks by itself.
    """
    # A kind of feature at a time: most of what is counted is rare, and goes before the next.
    n_yes, n_no = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    yes, no = {}, Counter()
    for size in (None, *PREFIXES):
        seen, others = Counter(), Counter()
        for words, label in zip(docs, toxic):
            if label:
                seen.update({word.decode("utf-8", "replace")[:size] for word in words})
        # Only what enough toxic documents have is counted in the others.
        seen = {f: n for f, n in seen.items() if n >= max(LEAST_DOCS, LEAST_SHARE * n_yes)}
        for words, label in zip(docs, toxic):
            if not label:
                others.update({word.decode("utf-8", "replace")[:size] for word in words} & seen.keys())
        kind = size or "w"
        yes.update({f"{kind}{f}": n for f, n in seen.items()})
        no.update({f"{kind}{f}": n for f, n in others.items()})
    marking = {
        f
        for f, n in yes.items()
        if n / n_yes / (n / n_yes + no[f] / n_no) >= PURITY
    }
    solo = set()
    for f in [f for f in marking if f[0] == "w"]:
        begin = f"{PREFIXES[0]}{f[1:][: PREFIXES[0]]}"
        if yes[f] >= 0.8 * yes[begin]:
            solo.add(f[1:].encode())
            marking -= {g for g in features(f[1:].encode()) if g[0] not in "wz"}
    return marking, frozenset(solo)


def _one_of_each(samples):
    """One of the sample's near copies: those with one smallest word run."""
    kept = {}
    for text, label in samples:
        words = common.byte_words(text)
        runs = [zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))]
        kept.setdefault((min(runs), label), (text, label))
    return list(kept.values())


def _blocks(begin, end):
    """Slices of neighbouring sentences with at most STEP_WORDS words, or of one sentence."""
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + STEP_WORDS, side="right")))
        yield slice(at, to)
        at = to


def _later(begin, n) -> np.ndarray:
    """Places of the words that have one before them in their sentence."""
    inner = np.ones(n, dtype=bool)
    inner[begin] = False
    return np.flatnonzero(inner)


def _steps_seen(tags, begin, end, block) -> np.ndarray:
    """How often a tag follows another in the sentences of a block."""
    first, last = begin[block][0], end[block][-1]
    y = tags[first:last].astype(np.int8)
    later = _later(begin[block] - first, len(y))
    return np.bincount(2 * y[later - 1] + y[later], minlength=4).reshape(2, 2).astype(float)


def _gradient(emission, tags, begin, end, trans) -> tuple[np.ndarray, np.ndarray]:
    """What each word is too toxic by, and how often a tag is expected to follow another."""
    odds, forward, backward = marginals(emission, begin, end, trans)
    gap = sigmoid(odds) - tags
    # Expected steps: both tags of neighbours, in proportion to their joint weight.
    forward += emission
    backward += emission
    later = _later(begin, len(emission))
    left, right = forward[later - 1], backward[later]
    joint = np.empty((4, len(later)))
    for a in (0, 1):
        for b in (0, 1):
            joint[2 * a + b] = trans[a, b] + a * left + b * right
    joint -= joint.max(axis=0)
    np.exp(joint, out=joint)
    joint /= joint.sum(axis=0)
    return gap, joint.sum(axis=1).reshape(2, 2)


def train(samples: list[tuple[str, int]], steps=60, rate=0.3, l2=1e-6, seed=SEED) -> Field | None:
    """A field from (text, label) pairs; None without both labels or without words."""
    samples = _one_of_each(sorted(samples))
    rng = np.random.default_rng(seed)
    rng.shuffle(samples)
    labels = [label for _, label in samples]
    if len(set(labels)) < 2:
        return None
    # Texts as arrays of word numbers, which take a fraction of the memory of their words.
    numbers: dict[bytes, int] = {}
    split = []
    for text, _ in samples:
        words, starts, stops = sentences(text)
        ids = (numbers.setdefault(w, len(numbers)) for w in words)
        split.append((np.fromiter(ids, np.int32, len(words)), starts, stops))
    del samples
    if not numbers:
        return None
    spelled = list(numbers)
    marking, solo = label_words([[spelled[n] for n in np.unique(ids)] for ids, _, _ in split], labels)

    # Sentences with a toxic word, and some of the others.
    marked = np.array([any(f in marking for f in features(w)) for w in spelled], dtype=bool)
    offset = np.cumsum([0, *[len(ids) for ids, _, _ in split]])
    begin = np.concatenate([starts + at for (_, starts, _), at in zip(split, offset)])
    end = np.concatenate([stops + at for (_, _, stops), at in zip(split, offset)])
    flat = np.concatenate([ids for ids, _, _ in split])
    tags = np.concatenate([marked[ids] & (label == 1) for (ids, _, _), label in zip(split, labels)])
    before = np.append(0, np.cumsum(tags, dtype=np.int32))
    hot = before[end] > before[begin]
    del before
    keep = hot | (rng.random(len(hot)) < CLEAN_PER_TOXIC * max(1, hot.sum()) / max(1, len(hot)))
    if keep.any():
        begin, end = begin[keep], end[keep]
    size = end - begin
    # Every sentence's place in `flat`, word by word.
    index = np.ones(size.sum(), dtype=np.int32)
    at = np.cumsum(size) - size
    index[at] = begin - np.append(0, end[:-1] - 1)
    np.cumsum(index, dtype=np.int32, out=index)
    tags = tags[index]
    index = flat[index]
    del flat
    seen_words = np.flatnonzero(np.bincount(index, minlength=len(spelled)))
    word_of = np.searchsorted(seen_words, index).astype(np.int32)
    del index
    # Solo words have one cell, the rest of their row points to a cell without weight.
    cells = np.full((len(seen_words), len(PREFIXES) + 2), BUCKETS, dtype=np.int32)
    for row, n in zip(cells, seen_words):
        own = [bucket(f) for f in features(spelled[n], solo)]
        row[: len(own)] = own
    # Only the buckets in use are trained; the others stay 0. The last has no weight.
    in_use = np.zeros(BUCKETS + 1, dtype=bool)
    in_use[cells] = in_use[BUCKETS] = True
    used = np.flatnonzero(in_use)
    cells = (np.cumsum(in_use, dtype=np.int32) - 1)[cells]
    end = np.cumsum(size)
    begin = end - size

    # A word without known features is clean.
    weights, bias, trans = np.zeros(len(used)), np.full(1, -4.0), np.zeros((2, 2))
    adam = Adam([weights, bias, trans], rate)
    blocks = list(_blocks(begin, end))
    n = len(word_of)
    seen = sum(_steps_seen(tags, begin, end, block) for block in blocks)
    for _ in range(steps):
        word_score = weights[cells].sum(axis=1) + bias[0]
        by_word, gaps, expected = np.zeros(len(seen_words)), 0.0, np.zeros((2, 2))
        for block in blocks:
            first, last = begin[block][0], end[block][-1]
            words = word_of[first:last]
            gap, joint = _gradient(word_score[words], tags[first:last], begin[block] - first, end[block] - first, trans)
            by_word += np.bincount(words, gap, len(seen_words))
            gaps += gap.sum()
            expected += joint
        grad = np.bincount(cells.ravel(), np.repeat(by_word, cells.shape[1]), len(used))
        grad[-1] = 0
        adam.step([grad / n + l2 * weights, np.array([gaps / n]), (expected - seen) / n + l2 * trans])
    del cells, word_of, tags
    table = np.zeros(BUCKETS, dtype=np.float32)
    table[used[:-1]] = weights[:-1]
    field = Field(table, float(bias[0]), trans, np.zeros(3), solo)
    shown, known = [], {}
    for at in range(0, len(split), _TOGETHER):
        part = [([spelled[n] for n in ids], *bounds) for ids, *bounds in split[at : at + _TOGETHER]]
        shown += [summary(odds) for odds in document_odds(field, part, known)]
    field.link = common.fit_logistic(np.array(shown), np.array(labels, dtype=float))
    return field


def document_odds(field: Field, docs: list[tuple], known: dict[bytes, float]):
    """For each document, as from `sentences`, the log-odds of its words.

    The sentences of all run through the field together. `known` keeps emissions of words.
    """
    emissions, begins, ends, at = [], [], [], 0
    for words, begin, end in docs:
        for w in words:
            if w not in known:
                known[w] = field.emission(w)
        emissions.append(np.fromiter(map(known.__getitem__, words), float, len(words)))
        begins.append(begin + at)
        ends.append(end + at)
        at += len(words)
    if not docs:
        return
    odds, _, _ = marginals(
        np.concatenate(emissions), np.concatenate(begins), np.concatenate(ends), field.trans
    )
    at = 0
    for words, _, _ in docs:
        yield odds[at : at + len(words)]
        at += len(words)


def training_sample(
    docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", label="toxic", seed=SEED
) -> list[tuple[str, int]]:
    """(text, label) pairs for training: see PER_LABEL and SAMPLE_CHARS.

    Ids are drawn in a seeded order from the labels, none of the held-out fold. An id labelled
    twice counts with its highest label.
    """
    ids = (
        labels.filter(F.col(label).isin(0, 1) & ~common.held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).alias("label"))
        .filter(F.col("id").isNotNull())
    )
    drawn = common.sample_per_class(ids, "label", PER_LABEL, F.xxhash64(F.lit(seed), F.col("id")))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    # At most PER_LABEL ids of each label.
    rows = texts.join(F.broadcast(drawn), "id").select("label", _sampled("text", "id", seed).alias("text"))
    return [(r["text"], r["label"]) for r in rows.collect()]


def _sampled(text: str, doc_id: str, seed: int):
    """A text, or of a long one a seeded share of its sentences that has about SAMPLE_CHARS characters."""
    fine = 1 << 20
    share = F.lit(SAMPLE_CHARS * fine) / F.length(text)
    drawn = F.filter(
        F.split(text, r"(?<=[.!?\n])"),
        lambda s, k: F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), k), F.lit(fine)) < share,
    )
    return F.when(F.length(text) <= SAMPLE_CHARS, F.col(text)).otherwise(F.array_join(drawn, ""))


_LOWER = str.maketrans(common.UPPER, common.LOWER)


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Runs of toxic words as character offsets."""
    places = [m.span() for m in re.finditer(common.WORD, text.translate(_LOWER))]
    spans, before = [], None
    for n in np.flatnonzero(toxic).tolist():
        begin, end = places[n]
        if before == n - 1:
            spans[-1]["end"] = end
        else:
            spans.append({"begin": begin, "end": end})
        before = n
    return spans


def _scorer(field: Field | None, reject: float):
    def batch(texts, known):
        split = [sentences(text) for text in texts]
        for text, odds in zip(texts, document_odds(field, split, known)):
            score = float(sigmoid(np.dot(summary(odds), field.link[:-1]) + field.link[-1]))
            toxic = odds > 0
            yield score, int(score >= reject), _spans(text, toxic) if toxic.any() else []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, float] = {}
        for texts in batches:
            rows = []
            # Of a batch only the texts of a piece are Python strings at a time.
            for begin, end in common.ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), _PIECE_CHARS):
                if field is None:
                    rows += [(0.0, 0, [])] * (end - begin)
                else:
                    rows += batch(texts.slice(begin, end - begin).to_pylist(), known)
                if len(known) > _CACHE:
                    known.clear()
            columns = zip(*rows) if rows else ((), (), ())
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS)]
            yield pa.StructArray.from_arrays(arrays, fields=_FIELDS)

    return F.arrow_udf(run, RESULT)


def score(
    docs: DataFrame, field: Field | None, into: str, text="text", reject=REJECT
) -> DataFrame:
    """`docs` with a struct (score, predicted, spans) in the new column `into`.

    Only the text is read, as a whole. `score` is the probability of a toxic label and
    `predicted` is 1 from `reject` on; `spans` are runs of words that are more likely toxic
    than clean, as character offsets. A NULL text is empty, and an empty text has the score
    of a text without toxic words. Without a field every score is 0.
    """
    return docs.withColumn(into, _scorer(field, reject)(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The rows of `docs` that are not rejected; columns stay.

    A NULL or empty text is scored as one without toxic words. Repeated rows go or stay together.
    Without labels of both kinds nothing is rejected.
    """
    name = common.free_name(docs, "toxicity")
    field = train(training_sample(docs, labels, text, doc_id))
    return score(docs, field, name, text).filter(F.col(name)["predicted"] == 0).drop(name)
