"""Mixing sources to target weights as a min-cost flow.

Documents are summed up by membership pattern, the set of sources that have their text. Words
flow from patterns to the quotas of their sources; each further pass over the texts of a
pattern, from whichever source, costs more per word than the one before, so that sources
which share texts are filled with as little repetition as possible. The flow says how many
words each pattern gives to each of its sources: some full passes over its documents there,
and a rest that is filled with documents in a seeded order. Only sums per pattern reach the
driver, never documents.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from verdictflow.llm import common
from verdictflow.llm.common import free_name
from verdictflow.session import stage

#: Fixed weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: A pass costs so many times the one before: convex, so early passes fill first.
PASS_PRICE = 3
#: Passes over texts with very many copies that have a price of their own.
LAST_PASS = 12
SEED = 11
#: More patterns than this are refused: their sums are solved on the driver.
MAX_PATTERNS = 100_000
#: Rounds that fill a rest with documents that still fit into it.
FILLS = 4

_DIGIT = 16
_DRAW_BITS = 63


def word_size(text: Column) -> Column:
    """Number of runs without blanks and ASCII white space; 0 for NULL."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(pieces, lambda p: p != "")).cast("long")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, with structs as dicts. Sent as Arrow it takes no Python workers."""
    kinds = StructType.fromDDL(schema)
    columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.nulls(0)] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays(columns, kinds.names), kinds)


def targets_for(sizes: dict, total: int, passes: int = MAX_PASSES, weights=WEIGHTS) -> dict:
    """Target words of each source: `total` shared by weight, none above `passes` times its size.

    Sources take weights in code point order, NULL last. What a source cannot take is
    shared again among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, targets = float(total), list(order), {}
    while open_sources:
        whole = sum(weight[s] for s in open_sources)
        share = {s: left * weight[s] / whole for s in open_sources}
        full = [s for s in open_sources if share[s] > passes * sizes[s]]
        if not full:
            return {**targets, **share}
        for s in full:
            targets[s] = float(passes * sizes[s])
            left -= targets[s]
        open_sources = [s for s in open_sources if s not in targets]
    return targets


class _Flow:
    """The largest flow from node 0 to node 1, by blocking flows in layers."""

    def __init__(self, nodes):
        self.out = [[] for _ in range(nodes)]
        self.to, self.room = [], []

    def add(self, a, b, room) -> int:
        """An arc; the next number is its way back."""
        for start, end, size in ((a, b, room), (b, a, 0)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(size)
        return len(self.to) - 2

    def _layers(self):
        layer = [-1] * len(self.out)
        layer[0], waiting = 0, [0]
        for a in waiting:
            for arc in self.out[a]:
                b = self.to[arc]
                if self.room[arc] > 0 and layer[b] < 0:
                    layer[b] = layer[a] + 1
                    waiting.append(b)
        return layer

    def fill(self):
        """Send as much more as the rooms allow."""
        while (layer := self._layers())[1] >= 0:
            tried = [0] * len(self.out)  # arcs before are of no more use in these layers
            path, at = [], 0
            while True:
                if at == 1:
                    room = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= room
                        self.room[arc ^ 1] += room
                    full = next(k for k, arc in enumerate(path) if not self.room[arc])
                    at = self.to[path[full] ^ 1]
                    del path[full:]
                out = self.out[at]
                while tried[at] < len(out):
                    arc = out[tried[at]]
                    if self.room[arc] > 0 and layer[self.to[arc]] == layer[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(out):
                    path.append(out[tried[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def _components(patterns: list[list]) -> list[list[int]]:
    """Indexes of the patterns that are connected by shared sources."""
    root: dict = {}

    def find(s):
        while root.setdefault(s, s) != s:
            s = root[s]
        return s

    for members in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    groups: dict = {}
    for i, members in enumerate(patterns):
        if members:
            groups.setdefault(find(members[0]), []).append(i)
    return list(groups.values())


def pass_costs(words: int, distinct: int) -> list[tuple[int, int]]:
    """(room, price per word) of each pass over `distinct` words, until `words` are there.

    The last pass of LAST_PASS takes all that is left.
    """
    rooms = []
    while words > 0 and distinct > 0 and len(rooms) < LAST_PASS:
        rooms.append((min(distinct, words), PASS_PRICE ** len(rooms)))
        words -= distinct
    return rooms + ([(words, PASS_PRICE**LAST_PASS)] if words > 0 else [])


def route(patterns: list[dict], distinct: list[int], targets: dict, passes=MAX_PASSES) -> list[dict]:
    """Words that each pattern gives to each of its sources, so that the quotas fill at the least cost.

    A pattern is the words that its texts have in each source, copies included; `distinct` counts
    each text once. A text costs more the more often it is taken from whatever source, so sources
    that share texts take those that no other has first. Only what leaves the start has a price, and
    what has left it is never taken back; so the least cost is found by opening the passes
    in the order of their price, and filling the network after each.
    """
    given = [dict.fromkeys(members, 0) for members in patterns]
    for group in _components([[("source", s) for s in members] for members in patterns]):
        place = {s: k for k, s in enumerate(dict.fromkeys(s for i in group for s in patterns[i]), 2 + len(group))}
        flow = _Flow(2 + len(group) + len(place))
        arcs, rooms, begin = {}, {}, {}
        for node, i in enumerate(group, 2):
            rooms[i] = pass_costs(passes * sum(patterns[i].values()), distinct[i])
            begin[i] = flow.add(0, node, 0)
            for s, size in patterns[i].items():
                arcs[i, s] = flow.add(node, place[s], passes * size)
        for s, node in place.items():
            flow.add(node, 1, round(targets[s]))
        for k in range(LAST_PASS + 1):
            opened = [i for i in group if k < len(rooms[i])]
            for i in opened:
                flow.room[begin[i]] += rooms[i][k][0]
            if opened:
                flow.fill()
        for (i, s), arc in arcs.items():
            given[i][s] = flow.room[arc ^ 1]
    return given


def _cut(docs: DataFrame, wanted: dict[int, tuple[int, int]], rows: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each pattern, the draw below which its documents fill at most the rest.

    `wanted` has a pattern's first draw and its rest; documents with a smaller draw, without words
    or longer than the rest are passed over. `rows` bounds the documents of a pattern.
    Returns `(draw, words)` by pattern: documents with a smaller draw have `words` words,
    and with the next draw they would have more than the rest. The draw is found digit by
    digit from sums per pattern and digit. Once no pattern has more documents than a digit has
    values, all bits that are left make one digit.
    """
    spark = docs.sparkSession
    state = {p: (0, 0, rows[p]) for p in wanted}
    whole = {}
    shift = _DRAW_BITS
    while shift > 0 and state:
        few = max(n for _, _, n in state.values()) <= 1 << _DIGIT
        width = shift if few else min(_DIGIT, shift)
        known = _small(
            spark,
            [(p, *wanted[p], prefix, below) for p, (prefix, below, _) in state.items()],
            "pattern int, from_draw long, rest long, prefix long, below long",
        )
        # At most MAX_PATTERNS rows.
        inside = docs.join(F.broadcast(known), "pattern").filter(
            (F.col("draw") >= F.col("from_draw")) & F.col("size").between(1, F.col("rest"))
        )
        if shift < _DRAW_BITS:
            inside = inside.filter(F.shiftright("draw", shift) == F.col("prefix"))
        digit = F.shiftright("draw", shift - width)
        sums = inside.groupBy("pattern", "below", "rest", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        before = Window.partitionBy("pattern").orderBy("digit")
        sums = sums.withColumn("upto", F.col("below") + F.sum("words").over(before))
        over = F.col("upto") > F.col("rest")
        found = sums.groupBy("pattern").agg(
            F.min(F.when(over, F.struct("digit", F.col("upto") - F.col("words"), "n"))).alias("next"),
            F.max("upto").alias("all"),
        )
        after = {}
        for pattern, step, words in found.collect():
            if step is None:  # everything fits
                whole[pattern] = (1 << _DRAW_BITS, words)
            else:
                after[pattern] = tuple(step)
        state, shift = after, shift - width
    return {**whole, **{p: (prefix, below) for p, (prefix, below, _) in state.items()}}


def choose_ranges(
    docs: DataFrame, given: dict[int, int], sizes: dict[int, int], rows: dict[int, int]
) -> list[tuple]:
    """How the words a pattern gives are taken: `(pattern, full passes, ranges of draws)`.

    `docs` has `pattern, size, draw`, and `rows` the number of rows of a pattern in it.
    A pattern that gives more words than it has is passed as a whole as often as that goes.
    The rest is filled in the order of draws up to the first document that is too long,
    then again with later documents that fit, a few rounds long. A range is
    `(low, high, most)`: documents with a draw from low to high and at most so many words.
    """
    passes = {p: given[p] // sizes[p] if sizes[p] else 0 for p in given}
    rests = {p: given[p] - passes[p] * sizes[p] for p in given if sizes[p]}
    taken = {p: [] for p in given}
    begin = {p: 0 for p in rests}
    for _ in range(FILLS):
        rests = {p: rest for p, rest in rests.items() if rest > 0}
        if not rests:
            break
        cuts = _cut(docs, {p: (begin[p], rest) for p, rest in rests.items()}, rows)
        for p, rest in list(rests.items()):
            draw, words = cuts.get(p, (1 << _DRAW_BITS, 0))
            taken[p].append((begin[p], draw - 1, rest))
            begin[p], rests[p] = draw, rest - words
            if draw >= 1 << _DRAW_BITS:
                del rests[p]
    return [(p, passes[p], taken[p]) for p in given]


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded number of 63 bits; rows equal in id and text have the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text, F.length(text)), 1)


def _text_key(text: Column) -> Column:
    """128 bits that equal texts share; NULL is empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def sized(docs: DataFrame, source="source", text="text", doc_id="doc_id", seed=SEED) -> DataFrame:
    """`doc_id, source, text_key, size, draw` of each row."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        _text_key(F.col(text)).alias("text_key"),
        word_size(F.col(text)).alias("size"),
        _draw(F.col(doc_id), F.col(text), seed).alias("draw"),
    )


def memberships(table: DataFrame) -> DataFrame:
    """`key, members, copies, words` of each distinct text: the sources that have it, NULL as the last.

    Copies are added up in each task first. A text has at most as many members as there are
    sources.
    """
    texts = table.groupBy("text_key").agg(
        F.collect_set(F.struct("source")).alias("found"), F.count("*").alias("copies"), F.max("size").alias("words")
    )
    members = F.array_sort(F.transform("found", lambda m: m["source"]))
    return texts.select(F.col("text_key").alias("key"), members.alias("members"), "copies", "words")


def with_members(rows: DataFrame, shared: DataFrame, n_rows: int) -> DataFrame:
    """`rows` with `members`; `shared` holds the texts of several sources."""
    found = common.join_groups(rows, shared.select("key", "members", "copies"), "text_key", "key", "copies", n_rows)
    own = F.coalesce("members", F.array("source"))
    return found.withColumn("members", own).drop("key", "copies")


def solve(table: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix of a `sized` table with `members`, and its distinct texts.

    Returns `known, known_source, passes, ranges`, one row per pattern and source, and the quotas
    `source, source_size, target`. Both are bounded by MAX_PATTERNS.
    """
    spark = table.sparkSession
    sums = table.groupBy("members", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sums = sums.limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    # No more patterns than above.
    once = texts.groupBy("members").agg(F.sum("words").alias("words")).collect()
    distinct = {tuple(r["members"]): r["words"] for r in once}
    by_pattern: dict = {}
    n_rows = {(tuple(r["members"]), r["source"]): r["rows"] for r in sums}
    last = lambda s: (s is None, str(s))
    for r in sorted(sums, key=lambda r: ([last(s) for s in r["members"]], last(r["source"]))):
        by_pattern.setdefault(tuple(r["members"]), {})[r["source"]] = r["size"]
    by_source: dict = {}
    for sizes in by_pattern.values():
        for s, size in sizes.items():
            by_source[s] = by_source.get(s, 0) + size
    targets = targets_for(by_source, sum(by_source.values()))
    given = route(list(by_pattern.values()), [distinct[p] for p in by_pattern], targets)

    kind, element = dict(table.dtypes)["members"], dict(table.dtypes)["source"]
    pairs = [(p, s, words[s], sizes[s]) for (p, sizes), words in zip(by_pattern.items(), given) for s in sizes]
    known = _small(
        spark, [(list(p), s, i) for i, (p, s, _, _) in enumerate(pairs)], f"known {kind}, known_source {element}, pattern int"
    )
    # Read several times: staged, its joins and their broadcasts are made once.
    numbered = stage(table.join(F.broadcast(known), _same_pattern()).select("pattern", "size", "draw"), "mix-draws")
    rows = choose_ranges(
        numbered,
        {i: pair[2] for i, pair in enumerate(pairs)},
        {i: pair[3] for i, pair in enumerate(pairs)},
        {i: n_rows[pair[:2]] for i, pair in enumerate(pairs)},
    )
    ends = ("low", "high", "most")
    ranges = _small(
        spark,
        [(list(pairs[i][0]), pairs[i][1], passes, [dict(zip(ends, r)) for r in taken]) for i, passes, taken in rows],
        f"known {kind}, known_source {element}, passes long, ranges array<struct<low:long,high:long,most:long>>",
    )
    quotas = _small(
        spark, [(s, by_source[s], targets[s]) for s in by_source], f"source {element}, source_size long, target double"
    )
    return ranges, quotas


def _same_pattern() -> Column:
    return F.col("members").eqNullSafe(F.col("known")) & F.col("source").eqNullSafe(F.col("known_source"))


def _with_repeats(rows: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """Adds how often a row is taken. `ranges` has at most MAX_PATTERNS rows."""
    chosen = F.exists(
        "ranges",
        lambda r: F.col("draw").between(r["low"], r["high"]) & F.col("size").between(1, r["most"]),
    )
    joined = rows.join(F.broadcast(ranges), _same_pattern(), "left")
    return joined.withColumn(
        name, F.coalesce(F.col("passes") + chosen.cast("long"), F.lit(0).cast("long"))
    ).drop("known", "known_source", "passes", "ranges")


def _solved(docs, source, text, doc_id, seed):
    """The sized table with members, the shared texts, their number of rows, ranges and quotas."""
    table = stage(sized(docs, source, text, doc_id, seed), "mix-sizes")
    texts = stage(memberships(table), "mix-texts")
    shared = stage(texts.filter(F.size("members") > 1), "mix-shared")
    n_rows = table.count()
    table = with_members(table, shared, n_rows)
    return table, shared, n_rows, *solve(table, texts)


def mix(docs: DataFrame, source="source", text="text", doc_id="doc_id", seed=SEED) -> tuple[DataFrame, DataFrame]:
    """How often each document is taken, and the quotas.

    A text is a member of every source that has a row with it; NULL is a source too. Returns
    `doc_id, source, members, size, repeats`, one row per row of `docs`, and
    `source, source_size, target`. What a row gives counts for its own source. Rows equal in
    id and text, and of one source, are taken or left together. A document without words is
    repeated with the full passes only. With no documents both are empty.
    """
    table, _, _, ranges, quotas = _solved(docs, source, text, doc_id, seed)
    chosen = _with_repeats(table, ranges, "repeats")
    return chosen.select("doc_id", "source", "members", "size", "repeats"), quotas


def mixed_documents(
    docs: DataFrame, source="source", text="text", doc_id="doc_id", seed=SEED
) -> DataFrame:
    """The documents that the mix takes, each once, with the number of its `repeats`.

    All columns of `docs` stay; if one is called `repeats`, the new column gets an
    underscore in front. A row is taken by its own draw. Only the texts of several sources
    are looked up, and of these the hash; if there are few, no text is shuffled. A NULL or
    empty text is taken with full passes only; a NULL source is a source.
    """
    _, shared, n_rows, ranges, _ = _solved(docs, source, text, doc_id, seed)
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        docs[source].alias("source"),
        _text_key(docs[text]).alias("text_key"),
        word_size(docs[text]).alias("size"),
        _draw(docs[doc_id], docs[text], seed).alias("draw"),
    )
    taken = _with_repeats(with_members(whole, shared, n_rows), ranges, "repeats").filter(F.col("repeats") > 0)
    return taken.select("doc.*", F.col("repeats").alias(free_name(docs, "repeats")))
