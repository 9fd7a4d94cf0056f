"""Periodic runs of words in texts, by longest common extensions over a difference cover.

A run is a stretch of words that repeats with a smallest period q, is at least `max(6, 4 q)` words
long, and cannot be extended by a neighbouring word. For every period the positions of a grid
of twice its width are compared with the words one period later; a run holds a grid position
from which more than a period of words agree. Those that do are extended to both sides.

Extensions are answered by a structure over the suffixes at positions of a difference cover:
any two positions reach cover positions together within a few words, which are compared, and
the common prefix of the suffixes there is a range minimum of a sparse table. Only texts with
a position that is left by the grid are sorted.

Words are those between blanks (space, and bytes 9 to 13). All work is on one text or a piece of
several texts of bounded size; nothing is shuffled.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import common

#: A perfect difference cover: each difference modulo 13 is that of two of the residues.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Least length of a run: so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words handled together (one text may be longer), and grid positions.
PIECE_WORDS, BLOCK = 500_000, 2_000_000

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
_PLACE = np.cumsum(_IN_COVER) - 1
#: Words to compare until both positions, given modulo 13, are in the cover.
_TO_COVER = np.array(
    [
        [
            next(c for c in range(MODULUS) if _IN_COVER[(i + c) % MODULUS] and _IN_COVER[(j + c) % MODULUS])
            for j in range(MODULUS)
        ]
        for i in range(MODULUS)
    ]
)


class CommonExtensions:
    """Longest common prefixes of suffixes of `words`, an array of numbers.

    The words at the ends of texts must occur nowhere else.
    """

    def __init__(self, words: np.ndarray):
        # Behind the end, numbers that differ from all others and from each other.
        pad = -1 - np.arange(2 * MODULUS)
        self.words = np.concatenate([words, pad]).astype(np.int64)
        n = len(words)
        full = -(-n // MODULUS)
        self.sample = (np.arange(full)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.n = len(self.sample)
        # Cover positions behind the end are harmless: the padding tells them apart.
        self.words = np.concatenate([self.words, -1 - 2 * MODULUS - np.arange(MODULUS)])
        levels = self._sort()
        self.table = self._sparse(self._common(levels))

    def _first_ranks(self) -> np.ndarray:
        """The rank of each sampled suffix by its first 13 words; equal ones share a rank."""
        low = self.words.min()
        bits = max(1, int(self.words.max() - low + 1).bit_length())
        per_key = max(1, 62 // bits)
        keys = []
        for at in range(0, MODULUS, per_key):
            key = np.zeros(self.n, dtype=np.int64)
            for c in range(at, min(at + per_key, MODULUS)):
                key = (key << bits) | (self.words[self.sample + c] - low)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(self.n, dtype=bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(self.n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(self.n), 0))
        return rank

    def _sort(self) -> list[np.ndarray]:
        """Sort the sampled suffixes, doubling the words looked at; the ranks of each step.

        A rank is the first place of its group, so a group that is split keeps its places, and
        only groups of several suffixes are sorted again.
        """
        levels = [self._first_ranks()]
        step = len(COVER)
        while True:
            rank = levels[-1]
            size = np.bincount(rank, minlength=self.n)
            tied = np.flatnonzero(size[rank] > 1)
            if not len(tied):
                break
            behind = np.append(rank, -1)[np.minimum(tied + step, self.n)]
            order = np.lexsort((behind, rank[tied]))
            at, own, behind = tied[order], rank[tied][order], behind[order]
            group = np.r_[True, own[1:] != own[:-1]]
            first = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
            place = own + np.arange(len(at)) - first
            new = group | np.r_[True, behind[1:] != behind[:-1]]
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, place, 0))
            levels.append(rank)
            step *= 2
        self.rank = levels[-1]
        return levels

    def _common(self, levels) -> np.ndarray:
        """The common words of each sampled suffix with the one before it in order."""
        order = np.empty(self.n, dtype=np.int64)
        order[self.rank] = np.arange(self.n)
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = np.append(levels[k], -1)
            same = rank[np.minimum(a, self.n)] == rank[np.minimum(b, self.n)]
            step = 1 << k
            a[same] += step * len(COVER)
            b[same] += step * len(COVER)
            length[same] += step * MODULUS
        length += self._compare(self._position(a), self._position(b), np.full(len(a), MODULUS))
        return np.append(0, length)

    def _position(self, index) -> np.ndarray:
        return index // len(COVER) * MODULUS + np.array(COVER)[index % len(COVER)]

    def _compare(self, i, j, most) -> np.ndarray:
        """How many of the words from `i` and `j` on agree, `most` at most."""
        length = np.zeros(len(i), dtype=np.int64)
        alive = np.arange(len(i))
        for c in range(MODULUS):
            alive = alive[(c < most[alive])]
            alive = alive[self.words[i[alive] + c] == self.words[j[alive] + c]]
            if not len(alive):
                break
            length[alive] += 1
        return length

    @staticmethod
    def _sparse(values) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words that agree from positions `i` and `j` (different) on."""
        ahead = _TO_COVER[i % MODULUS, j % MODULUS]
        length = self._compare(i, j, ahead)
        on = np.flatnonzero(length == ahead)
        if len(on):
            a, b = i[on] + ahead[on], j[on] + ahead[on]
            a = self.rank[a // MODULUS * len(COVER) + _PLACE[a % MODULUS]]
            b = self.rank[b // MODULUS * len(COVER) + _PLACE[b % MODULUS]]
            low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            found = np.empty(len(on), dtype=np.int64)
            for k in np.unique(level):
                of = level == k
                row = self.table[k]
                found[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
            length[on] += found
        return length


def _least(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def _grid_hits(words, starts, sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, position and period of the grid positions from which enough words agree."""
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    number = -((period - sizes[text]) // (2 * period))
    ends = np.cumsum(number)
    at = 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        of = np.repeat(np.arange(at, upto), number[at:upto])
        k = np.arange(len(of)) - (ends[of] - number[of] - (ends[at] - number[at]))
        p = period[of]
        i = starts[text[of]] + 2 * p * k
        same = np.flatnonzero(words[i] == words[i + p])
        of, i, p = of[same], i[same], p[same]
        # A run's first grid position is less than two periods from its start.
        wanted = np.minimum(_least(p) - 3 * p + 1, MODULUS)
        for c in range(1, MODULUS):
            going = (c >= wanted) | (words[i + c] == words[i + p + c])
            of, i, p, wanted = of[going], i[going], p[going], wanted[going]
            if not len(of):
                break
        if len(of):
            yield text[of], i, p
        at = upto


def _merged(found: list[np.ndarray]) -> np.ndarray:
    """Rows (start, end, period), one per start and end: the smallest period."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def runs_in(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of word numbers (0 or more) its runs: rows of start, length and period.

    They are in the order of start, then period.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.zeros((0, 3), dtype=np.int64)
    result = [none] * len(texts)
    if not len(texts) or sizes.max() < LEAST_WORDS:
        return result
    # After each text a number that occurs once.
    high = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    parts = [part for k, t in enumerate(texts) for part in (t, [high + k])]
    words = np.concatenate([*parts, np.arange(high + len(texts), high + len(texts) + MODULUS)]).astype(np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    hits = list(_grid_hits(words, starts, sizes))
    if not hits:
        return result

    # Extend within the texts that have hits.
    own = np.unique(np.concatenate([text for text, _, _ in hits]))
    chosen = np.concatenate([words[starts[k] : starts[k] + sizes[k] + 1] for k in own])
    new_starts = np.zeros(len(texts), dtype=np.int64)
    new_starts[own] = np.cumsum(sizes[own] + 1) - (sizes[own] + 1)
    ahead = CommonExtensions(chosen)
    back = CommonExtensions(np.append(chosen[:-1][::-1], chosen[-1]))
    last = len(chosen) - 1
    found = [none]
    for text, i, p in hits:
        i = i - starts[text] + new_starts[text]
        j = i + p
        start = i - back(last - i, last - j)
        end = j + ahead(i, j)
        long = end - start >= _least(p)
        found = [_merged([*found, np.column_stack([start, end, p])[long]])]
    (rows,) = found
    of = np.searchsorted(new_starts[own], rows[:, 0], "right") - 1
    first = np.searchsorted(of, np.arange(len(own) + 1))
    for k, text in enumerate(own):
        part = rows[first[k] : first[k + 1]]
        part = np.column_stack([part[:, 0] - new_starts[text], part[:, 1] - part[:, 0], part[:, 2]])
        result[text] = part[np.lexsort((part[:, 2], part[:, 0]))]
    return result


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:size] == 0


def _pieces(split: list[list[bytes]]) -> Iterator[range]:
    begin = size = 0
    for k, words in enumerate(split):
        if k > begin and size + len(words) > PIECE_WORDS:
            yield range(begin, k)
            begin, size = k, 0
        size += len(words)
    if begin < len(split):
        yield range(begin, len(split))


def _analysed(texts) -> Iterator[tuple[int, list[dict], str]]:
    """The number of words, the runs and the collapsed text of each text."""
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    for piece in _pieces(split):
        number: dict[bytes, int] = defaultdict(count().__next__)
        numbered = [
            np.fromiter(map(number.__getitem__, split[k]), dtype=np.int64, count=len(split[k])) for k in piece
        ]
        for k, runs in zip(piece, runs_in(numbered)):
            words = split[k]
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
            as_rows = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
            yield len(split[k]), as_rows, b" ".join(words).decode("utf-8", "replace")


RUN = "struct<start: long, length: long, period: long>"
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def find_runs(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """`doc_id, n_words, runs, collapsed` of every row of `docs`.

    `runs` are in the order of start, then period; `collapsed` is the text without the words that
    a run contains after its first period, joined by single spaces. A NULL or empty text has no
    words, no runs and an empty `collapsed`. Repeated rows, equal texts and NULL ids are rows of
    their own; other columns of `docs` are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in common.pieces(texts):
                sizes, runs, collapsed = zip(*_analysed(texts[begin:end]))
                columns = [
                    batch.column("doc_id").slice(begin, end - begin),
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, _RUNS),
                    pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string"
    return rows.mapInArrow(analyse, schema)
