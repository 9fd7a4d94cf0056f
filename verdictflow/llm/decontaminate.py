"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all runs of words of the test items. A text is streamed through it word
by word; the automaton's state and the longest matching length say which item windows end at
a word. Spans of a text that hold a window are hit; texts can have these spans cut out, or
be dropped when too much of them is hit.

Items are dealt into shards of a bounded number of words, so that one automaton always fits
into a task. Texts are mapped in Arrow batches and never shuffled.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from verdictflow.llm import common
from verdictflow.session import stage

#: Words of one automaton, about 100 MB in a task. Longer items are split with an overlap.
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000
WINDOW = 10
#: Texts with a larger share of hit words are dropped as a whole.
MAX_COVERAGE = 0.5

OVERLAP = (
    "n_words long, n_hit long, longest int, items array<string>, "
    "spans array<struct<first:int,last:int,begin:int,end:int>>"
)
_SPAN = pa.struct([(name, pa.int32()) for name in ("first", "last", "begin", "end")])
_FIELDS = [
    pa.field("n_words", pa.int64()),
    pa.field("n_hit", pa.int64()),
    pa.field("longest", pa.int32()),
    pa.field("items", pa.list_(pa.field("element", pa.string()))),
    pa.field("spans", pa.list_(pa.field("element", _SPAN))),
]
#: Characters of the texts that are Python strings at a time, or one text.
_PIECE_CHARS = 1_000_000


class Automaton:
    """All runs of words of some items, each run one path from the start state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        texts = [[number(w, len(self.vocabulary)) for w in words] for _, words in items]
        for text in texts:
            state = 0
            for word in text:
                state = self._extend(state, word)
        self._mark(items, texts, window)
        self._index_pairs(texts, window)

    def _new_state(self, length, step, link):
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state, word, target):
        """A copy of `target` for runs no longer than those that reach it from `state`."""
        copy = self._new_state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state != -1 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, state, word):
        """The state of a run of words made longer by `word`."""
        target = self.step[state].get(word)
        if target is not None:  # another item has the run
            exact = self.length[target] == self.length[state] + 1
            return target if exact else self._split(state, word, target)
        new = self._new_state(self.length[state] + 1, {}, 0)
        while state != -1 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.step[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, word, target)
        return new

    def _mark(self, items, texts, window):
        """Note at the state of each window its size and the items that have it."""
        self.marks: dict[int, tuple[int, set]] = {}
        for (item_id, _), text in zip(items, texts):
            size = min(window, len(text))
            state = 0
            for n, word in enumerate(text, 1):
                state = self.step[state][word]
                if n >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks.setdefault(at, (size, set()))[1].add(item_id)
        # For each state the nearest marked state on its way back to the start.
        self.nearest = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            marked = state in self.marks
            self.nearest[state] = state if marked else self.nearest[self.link[state]]

    def _index_pairs(self, texts, window):
        """Pairs of neighbouring words that items have, and what begins short items."""
        size = self.size = max(1, len(self.vocabulary))
        pairs = {a * size + b for text in texts for a, b in zip(text, text[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        short = [text for text in texts if len(text) < window]
        self.single = np.zeros(size, dtype=bool)
        self.single[[text[0] for text in short if len(text) == 1]] = True
        begin = {text[0] * size + text[1] for text in short if len(text) > 1}
        self.short_pairs = np.array(sorted(begin), dtype=np.int64)

    def candidates(self, ids: np.ndarray, window: int) -> list[tuple[int, int]]:
        """Runs of words that can hold a window: every neighbouring pair is in an item.

        `ids` has -1 for words that no item has.
        """
        if not len(ids):
            return []
        linked = np.zeros(len(ids), dtype=bool)  # to the word before
        short = (ids >= 0) & self.single[np.maximum(ids, 0)]
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        codes = ids[both - 1] * self.size + ids[both]
        known = _contains(self.pairs, codes)
        linked[both[known]] = True
        short[both[_contains(self.short_pairs, codes)]] = True
        begin = np.flatnonzero(~linked)
        end = np.append(begin[1:], len(ids))
        some_short = np.add.reduceat(short, begin, dtype=np.int64) > 0
        keep = (end - begin >= window) | some_short
        return list(zip(begin[keep].tolist(), end[keep].tolist()))

    def stream(self, ids: list[int]):
        """Yield (word number, longest length, window size, items) where a window ends."""
        state, matched = 0, 0
        step, link, length = self.step, self.link, self.length
        for n, word in enumerate(ids):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            following = step[state].get(word)
            if following is None:
                matched = 0
                continue
            state, matched = following, matched + 1
            at = self.nearest[state]
            while at > 0:
                size, items = self.marks[at]
                if size <= matched:
                    yield n, matched, size, items
                at = self.nearest[link[at]]

    def overlap(self, words: list[bytes], ids: np.ndarray, window: int):
        """Hit runs of words (merged), the longest match and the items of a text."""
        runs, longest, found = [], 0, set()
        for begin, end in self.candidates(ids, window):
            for n, matched, size, items in self.stream(ids[begin:end].tolist()):
                last = begin + n + 1
                first = last - size
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
                longest = max(longest, matched)
                found |= items
        return runs, longest, found


def _contains(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return table[at] == codes


_built: dict = {}


def _automaton(items, window):
    """The automaton of these items, built once per Python worker."""
    key = hash((window, tuple((i, tuple(w)) for i, w in items)))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


_LOWER = str.maketrans(common.UPPER, common.LOWER)


def _spans(text: str, runs) -> list[dict]:
    """Runs as word numbers (first, last) and character offsets (begin, end), ends exclusive."""
    places = [m.span() for m in re.finditer(common.WORD, text.translate(_LOWER))]
    return [
        {"first": a, "last": b, "begin": places[a][0], "end": places[b - 1][1]} for a, b in runs
    ]


def _overlaps(items, window):
    """The function that maps batches of texts to OVERLAP structs."""

    def row(automaton, text):
        words = common.byte_words(text)
        get = automaton.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        runs, longest, found = automaton.overlap(words, ids, window)
        return (
            len(words),
            sum(b - a for a, b in runs),
            longest,
            sorted(i for i in found if i is not None),
            _spans(text, runs) if runs else [],
        )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(items, window)
        for texts in batches:
            rows = []
            # Of a batch only the texts of a piece are Python strings at a time.
            for begin, end in common.ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), _PIECE_CHARS):
                rows += [row(automaton, text) for text in texts.slice(begin, end - begin).to_pylist()]
            columns = zip(*rows) if rows else ((),) * len(_FIELDS)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS)]
            yield pa.StructArray.from_arrays(arrays, fields=_FIELDS)

    # Else a filter on the result is moved below it, and texts go through two workers a task.
    return F.arrow_udf(run, OVERLAP).asNondeterministic()


def item_pieces(items: DataFrame, text="text", item_id="item_id", window=WINDOW) -> DataFrame:
    """`item, words, shard`: the items, long ones in pieces that overlap by a window."""
    rows = items.select(
        F.col(item_id).cast("string").alias("item"), common.words(F.col(text)).alias("all")
    ).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(PIECE_WORDS))
    rows = rows.select("item", "all", F.explode(starts).alias("at"))
    rows = rows.select("item", F.slice("all", F.col("at") + 1, PIECE_WORDS + window - 1).alias("words"))
    rows = stage(rows, "item-pieces")
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    return rows.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)).cast("int"))


def _merged(a: Column, b: Column) -> Column:
    """Two OVERLAP structs of one text as one."""
    none = F.array().cast("array<struct<first:int,last:int,begin:int,end:int>>")

    def step(done, span):
        before = F.element_at(done, -1)
        both = F.struct(
            before["first"].alias("first"),
            F.greatest(before["last"], span["last"]).alias("last"),
            before["begin"].alias("begin"),
            F.greatest(before["end"], span["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (span["first"] <= before["last"])
        head = F.slice(done, 1, F.size(done) - 1)
        return F.when(touches, F.concat(head, F.array(both))).otherwise(
            F.concat(done, F.array(span))
        )

    spans = F.aggregate(F.array_sort(F.concat(a["spans"], b["spans"])), none, step)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return F.struct(
        a["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.greatest(a["longest"], b["longest"]).alias("longest"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        spans.alias("spans"),
    )


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    into: str,
    text="text",
    item_text="text",
    item_id="item_id",
    window=WINDOW,
) -> DataFrame:
    """`docs` with an OVERLAP struct in the new column `into`; rows and columns stay.

    A window is `window` consecutive words of an item, or a whole shorter item with at least
    one word. Every word of a text inside an occurrence of a window is hit. `longest` is the
    longest run of words that a hit run shares with an item (within a piece of it); `items`
    are the ids with occurring windows, as sorted strings. A NULL text has no words; a NULL
    item text is no item; an item with a NULL id makes hits and is not listed; items with
    one text are all listed. Without items nothing is hit.
    """
    pieces = item_pieces(items, item_text, item_id, window)
    shards = sorted(r[0] for r in pieces.select("shard").distinct().collect()) or [0]
    if len(shards) == 1:
        return docs.withColumn(into, _overlaps(_items_of(pieces, shards[0]), window)(F.col(text)))
    # Several automata: one pass finds the texts that may hold a window of any, and writes them
    # apart; only those go through the automata, one at a time.
    flag = common.free_name(docs, "may_hit")
    looked = docs.withColumn(into, _look(pieces, window)(F.col(text)))
    looked = stage(looked.withColumn(flag, F.col(into)["may_hit"]), "looked-at")
    none = F.struct(
        F.col(into)["n_words"].alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.lit(0).alias("longest"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<first:int,last:int,begin:int,end:int>>").alias("spans"),
    )
    clean = looked.filter(~F.col(flag)).withColumn(into, none).drop(flag)
    docs = looked.filter(flag).withColumn(into, none).drop(flag)
    fresh = common.free_name(docs, "shard")
    for shard in shards:
        docs = docs.withColumn(fresh, _overlaps(_items_of(pieces, shard), window)(F.col(text)))
        docs = stage(docs.withColumn(into, _merged(F.col(into), F.col(fresh))).drop(fresh), "overlaps")
    return clean.unionByName(docs)


def _items_of(pieces: DataFrame, shard: int) -> list[tuple]:
    """The items of a shard: at most about SHARD_WORDS words."""
    rows = pieces.filter(F.col("shard") == shard).select("item", "words").collect()
    return [(r["item"], [w.encode() for w in r["words"]]) for r in rows]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = max(0, len(words) - size + 1)
    runs = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        runs = (runs ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


#: Bits of the bitmap of windows: 16 for each, within these.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 26, 16


def _look(pieces: DataFrame, window: int):
    """The function that maps texts to (n_words, may_hit); false only where no window occurs.

    Windows are marked in a bitmap of at most MOST_BITS; when it fills up more texts go through
    the automata, with the same result.
    """
    size = F.least(F.size("words"), F.lit(window))
    facts = pieces.groupBy(size.alias("size")).agg(F.sum(F.size("words")).alias("words")).collect()
    sizes = sorted(r["size"] for r in facts)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * sum(r["words"] for r in facts)):
        bits *= 2

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(bits, dtype=bool)
        for batch in batches:
            for words in batch["words"]:
                hashes = _word_hashes([w.encode() for w in words])
                marks[_window_hashes(hashes, min(window, len(hashes))) % np.uint64(bits)] = True
        packed = np.packbits(marks).view(np.int64)
        at = np.flatnonzero(packed)
        yield pd.DataFrame({"at": at, "word": packed[at]})

    words = pieces.select("words").mapInPandas(marked, "at long, word long")
    words = words.groupBy("at").agg(F.bit_or("word").alias("word"))
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    for row in words.collect():  # at most MOST_BITS / 64 rows
        bitmap[row["at"]] = row["word"]
    shared = pieces.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value.view(np.uint8)

        def is_marked(hashes):
            at = (hashes % np.uint64(bits)).astype(np.int64)
            return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).any()

        for texts in batches:
            rows = []
            for text in texts:
                hashes = _word_hashes(common.byte_words(text))
                hit = any(is_marked(_window_hashes(hashes, n)) for n in sizes)
                rows.append((len(hashes), hit))
            yield pd.DataFrame(rows, columns=["n_words", "may_hit"])

    return F.pandas_udf(run, "n_words long, may_hit boolean")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text="text",
    item_text="text",
    item_id="item_id",
    window=WINDOW,
    max_coverage=MAX_COVERAGE,
) -> DataFrame:
    """`docs` without what they share with test items; columns stay, other rows are unchanged.

    Hit spans are cut out of a text. A document is dropped if more than `max_coverage` of its
    words are hit. A NULL, an empty text and one without words stay as they are; repeated rows
    are treated alike. Without items nothing is cut.
    """
    name = common.free_name(docs, "overlap")
    marked = find_overlaps(docs, items, name, text, item_text, item_id, window)
    hit = F.col(name)
    kept = marked.filter(hit["n_hit"] <= max_coverage * hit["n_words"])
    return kept.withColumn(text, common.without(F.col(text), hit["spans"], "begin", "end")).drop(name)
