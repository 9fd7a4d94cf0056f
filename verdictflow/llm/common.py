"""Column expressions that several operators share."""

import numpy as np
from pyspark.sql import Column, Window, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word: a run of ASCII digits and letters and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HELD_OUT_FOLD = 2
FOLDS = 4


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of `text` in order, ASCII letters in lower case; none for NULL."""
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(pieces, lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from; false for a NULL id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


def free_name(df, base: str) -> str:
    """`base`, or `base` with underscores in front if `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


# For the functions that run on Arrow batches: words as bytes.

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def byte_words(text: str | None) -> list[bytes]:
    """The words of `words()` as UTF-8 bytes."""
    return [] if not text else text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


def pieces(texts, limit: int = 4_000_000):
    """Split a batch into (from, to) ranges of at most `limit` characters, or one text."""
    yield from ranges([len(text) if text else 0 for text in texts], limit)


def ranges(sizes: list[int], limit: int):
    """(from, to) ranges of neighbours whose sizes add up to at most `limit`, or of one."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def sample_per_class(rows, label: str, per_class: int, order, counted=None):
    """At most `per_class` rows of each label, the first in `order` (a seeded 64-bit hash).

    Labels are counted first (over `counted`, or `rows`), and rows beyond about four times as
    many as are wanted are left out where they are read, so that few reach the task of a label.
    """
    counts = (rows if counted is None else counted).filter(F.col(label).isNotNull())
    share = counts.groupBy(F.col(label).alias("of_label")).agg(
        F.least(F.lit(1.0), 4 * per_class / F.count("*")).alias("share")
    )
    fine = 1 << 30
    # One row per label; what is trained has an output for each of them.
    near = rows.join(F.broadcast(share), F.col(label) == F.col("of_label")).filter(
        F.pmod(order, F.lit(fine)) < F.col("share") * fine
    )
    near = near.drop("of_label", "share")
    place = Window.partitionBy(label).orderBy(order)
    name = free_name(near, "place")
    picked = near.withColumn(name, F.row_number().over(place))
    return picked.filter(F.col(name) <= per_class).drop(name)


#: A group is hot when it holds more than 1 / HOT_SHARE of the rows, so there are fewer than that.
HOT_SHARE = 1000


def join_groups(rows, groups, key: str, group_key: str, size: str, n_rows: int, how="left"):
    """`rows` joined with `groups`, one row per key, where a few keys may hold much of the rows.

    `size` is a column of `groups` with the number of rows of the key, `n_rows` the number of all.
    Rows of hot groups stay where they are: these groups are broadcast. `how` is left or inner.
    """
    same = F.col(key) == F.col(group_key)
    is_hot = F.col(size) * HOT_SHARE > n_rows
    hot = F.broadcast(groups.filter(is_hot))
    others = rows.join(hot, same, "left_anti").join(groups.filter(~is_hot), same, how)
    return rows.join(hot, same).unionByName(others)


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once; inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine, zero: Column) -> Column:
    """For each element what the elements before it combine to.

    In blocks of about the root of their number: blocks are combined first, and an element
    looks at the blocks before it and at its own block.
    """

    def in_blocks(v, width):
        block = lambda i: F.floor(i / width).cast("int")
        number = F.ceil(F.size(v) / width).cast("int")
        each = F.transform(
            F.sequence(F.lit(0), number - 1), lambda b: F.aggregate(F.slice(v, b * width + 1, width), zero, combine)
        )
        heads = lambda e: F.transform(e, lambda _, k: F.aggregate(F.slice(e, F.lit(1), k), zero, combine))
        return _let(
            _let(each, heads),
            lambda head: F.transform(
                v, lambda _, i: F.aggregate(F.slice(v, i - i % width + 1, i % width), F.get(head, block(i)), combine)
            ),
        )

    blocks = lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: in_blocks(v, width))
    return _let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


#: Code points of a piece of text in which spans are cut.
_PIECE = 4096


def without(text: Column, spans: Column, begin: str, end: str, mask: str = "") -> Column:
    """`text` with each span replaced by `mask`; spans are in order, overlapping ones make one.

    The text is cut into pieces once, and what stays is taken out of the pieces around it, so
    the work grows with the text and not with text times spans.
    """

    def cut(pieces, a, b):
        first, last = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        around = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b > a, F.substr(around, a % _PIECE + 1, b - a)).otherwise("")

    def kept(pieces, covered):
        rows = F.arrays_zip(covered.alias("covered"), spans.alias("span"))
        return F.transform(
            rows,
            lambda r: F.when(
                r["span"][begin] >= r["covered"], F.concat(cut(pieces, r["covered"], r["span"][begin]), F.lit(mask))
            ).otherwise(""),
        )

    ends = F.transform(spans, lambda p: p[end])
    covered = running(ends, lambda a, b: F.greatest(a, b), F.lit(0))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    changed = _let(
        pieces,
        lambda p: F.concat(
            F.array_join(_let(covered, lambda c: kept(p, c)), ""), cut(p, F.array_max(ends), F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Adam updates of a list of arrays, in place."""

    def __init__(self, arrays, rate):
        self.arrays, self.rate, self.n = arrays, rate, 0
        self.mean = [np.zeros_like(a) for a in arrays]
        self.square = [np.zeros_like(a) for a in arrays]

    def step(self, gradients):
        self.n += 1
        for a, g, m, s in zip(self.arrays, gradients, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            scale = np.sqrt(s / (1 - 0.999**self.n)) + 1e-8
            a -= self.rate * (m / (1 - 0.9**self.n)) / scale


def fit_logistic(x, y, l2=1e-3, steps=400, rate=0.05):
    """Weights of a logistic regression; the last is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    adam = Adam([w], rate)
    for _ in range(steps):
        adam.step([x.T @ (sigmoid(x @ w) - y) / max(1, len(y)) + l2 * w])
    return w
