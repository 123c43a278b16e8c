"""Joins of similar documents by n-gram Jaccard similarity, exact and without all pairs.

The method is set-relation skipping. An inverted list per shingle of a set's
prefix is cut into blocks by set size, and whole blocks that cannot hold a
partner are skipped, as are list entries whose position leaves too few shingles.
A set's answers come from those of a very similar set: equal sets are one set;
each set is first compared with the one leader that shares most of its lists,
and what that settles is never compared again. Only where a list still holds
sets of different components are its other pairs looked at.

Everything stays in Spark: lists, leaders, links and components are tables.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.words import hashed_words, row_shingles
from siftrank.session import intermediate_tables, written

# Shingles in a larger share of the documents come last in the common order.
# The order decides how much work there is, never the result.
FREQUENT_SHARE = 0.0005
FREQUENT_MOST = 100_000
COUNTED_AT_ONCE = 2_000_000
# Lists of at most so many sets are looked through pair by pair.
SHORT_LIST = 32
# Sets of a longer list that are compared in one task with as many others, fewer of
# long texts: together they have so many shingles at most.
PART_SETS = 256
PART_SHINGLES = 2_000_000
# Rows of one or two numbers that are sent to all tasks at most.
BROADCAST_ROWS = 1_000_000
# Leaders that a set is compared with at once.
LEADERS = 8


def _frequent(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(4, FREQUENT_SHARE * len(held))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["t", "n"]
        )

    for batch in batches:
        for _, words, at in hashed_words(batch.column(0)):
            for k in range(len(at) - 1):
                held.append(row_shingles(words[at[k] : at[k + 1]], n))
            if sum(map(len, held)) >= COUNTED_AT_ONCE:
                yield counted()
                held.clear()
    if held:
        yield counted()


def frequent_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles many documents share, the most frequent last.

    All documents are counted, a few thousand at a time; what is frequent in all
    is frequent in some such part. At most ``FREQUENT_MOST`` numbers come back.
    """
    counts = texts.mapInArrow(lambda it: _frequent(n, it), "t long, n long")
    rows = (
        counts.groupBy("t")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "t")
        .limit(FREQUENT_MOST)
        .toPandas()
    )
    return rows["t"].to_numpy(dtype=np.int64).view(np.uint64)[::-1]


def _sets(n: int, percent: int, frequent, batches) -> Iterator[pa.RecordBatch]:
    order = np.argsort(frequent.value)
    known = frequent.value[order]
    seen: set[int] = set()
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids, sizes, prefixes, packed = [], [], [], []
        texts = batch.column(batch.num_columns - 1)
        for first, words, at in hashed_words(texts):
            for k in range(len(at) - 1):
                shingles = row_shingles(words[at[k] : at[k + 1]], n)
                sizes.append(len(shingles))
                number = xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0
                ids.append(number)
                if number in seen or not len(shingles):
                    prefixes.append(None)
                    packed.append(None)
                    continue
                seen.add(number)
                length = len(shingles) - -(-percent * len(shingles) // 100) + 1
                prefixes.append(_prefix(shingles, length, known, order).view(np.int64))
                packed.append(pack(texts[first + k].as_py().encode()))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(np.array(ids, dtype=np.uint64).view(np.int64)),
                pa.array(sizes, type=pa.int64()),
                pa.array(prefixes, type=pa.list_(pa.int64())),
                pa.array(packed, type=pa.binary()),
            ],
            ["id", "set", "n", "prefix", "packed"],
        )


def _prefix(shingles, length, known, order) -> np.ndarray:
    """The first ``length`` shingles: rare ones by number, then frequent ones by rank."""
    if not len(known):
        return shingles[:length]
    near = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    often = known[near] == shingles
    rare = shingles[~often][:length]
    if len(rare) == length:
        return rare
    ranks = order[near[often]]
    return np.concatenate([rare, shingles[often][np.argsort(ranks)][: length - len(rare)]])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (t, n, set): those of lists with two sets or more, once each.

    One entry waits for the next batch, which says whether its list goes on.
    """
    waiting, in_list = None, False
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        t, s = (batch.column(k).to_numpy() for k in (0, 1))
        fresh = np.ones(len(t), dtype=bool)
        fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        rows = np.flatnonzero(fresh)
        same = t[rows[1:]] == t[rows[:-1]]
        follows = np.insert(same, 0, in_list)
        emitted = rows[:-1][follows[:-1] | same]
        if len(emitted):
            yield batch.take(pa.array(emitted))
        waiting, in_list = batch.slice(rows[-1], 1), bool(follows[-1])
    if waiting is not None and in_list:
        yield waiting


def _checked(n: int, percent: int, batches) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress

    def shingles(packed: bytes) -> np.ndarray:
        text = pa.array([unpack(packed).decode()])
        return next(row_shingles(words, n) for _, words, _ in hashed_words(text))

    at, left = None, None
    for batch in batches:
        links = []
        for a, x, y in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
            if (a := a.as_py()) != at:
                at, left = a, shingles(x.as_py())
            right = shingles(y.as_py())
            both = len(np.intersect1d(left, right, assume_unique=True))
            links.append(100 * both >= percent * (len(left) + len(right) - both))
        yield batch.select([0, 1]).filter(pa.array(links, type=pa.bool_()))


def _sent_if_small(stored: DataFrame) -> DataFrame:
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def checked_links(pairs: DataFrame, packed: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the stored ``pairs`` (a, b) whose whole texts are similar enough."""
    pairs = _sent_if_small(pairs)
    x = packed.select(F.col("set").alias("a"), F.col("packed").alias("x"))
    y = packed.select(F.col("set").alias("b"), F.col("packed").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return both.mapInArrow(lambda it: _checked(n, percent, it), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for each end of the ``links`` (a, b): its component's least end.

    Each vertex hooks onto its least neighbour, chains are halved until they end
    in roots, and links between different roots go into the next round. At least
    half of a round's roots disappear, so rounds grow with the logarithm.
    """
    roots = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"))
        hooks = written(hooks.select("v", F.least("v", "least").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("v").alias("root"), F.col("root").alias("above"))
            jumped = written(hooks.join(up, "root").select("v", "root", "above"), "hooks")
            hooks = jumped.select("v", F.col("above").alias("root"))
            if jumped.where("root <> above").isEmpty():
                break
        roots = hooks if roots is None else written(_renamed(roots, hooks, "root"), "roots")
        links = _renamed(_renamed(links, hooks, "a"), hooks, "b")
        links = written(links.where("a <> b").distinct(), "links")
        if links.isEmpty():
            return roots


def _renamed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` with each value of a column replaced by its root, if it has one."""
    to = roots.select(F.col("v").alias(column), F.col("root").alias("_to"))
    renamed = rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column))
    return renamed.drop("_to")


def _needed(percent: int):
    """Shingles that two similar sets of ``n`` and ``m`` share at least."""
    return F.lit(percent) * (F.col("n") + F.col("m")) / (100 + percent)


def _sizes_fit(percent: int):
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _fits(percent: int):
    """A pair that meets here first, in the order of shingles, can be similar."""
    return _sizes_fit(percent) & (F.least("rest", "other_rest") >= _needed(percent))


def _enough(percent: int, in_prefixes):
    """Sets that share ``in_prefixes`` shingles of their prefixes can be similar.

    What else they share comes after the end of the shorter reaching prefix, where
    one of them has no more than its size without its prefix.
    """
    after = F.ceil(F.lit(percent) * F.greatest("n", "m") / 100) - 1
    return in_prefixes >= _needed(percent) - after


def _other(lists: DataFrame, *more: str) -> DataFrame:
    """The lists' entries under the names for the other one of two sets."""
    return lists.select(
        "t",
        "block",
        F.col("set").alias("other"),
        F.col("n").alias("m"),
        F.col("rest").alias("other_rest"),
        *(F.col(c).alias(f"other_{c}") for c in more),
    )


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _short_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs of the short lists that share enough of them to be similar.

    ``long`` is how many long lists a set is in, so how many a pair shares at most.
    """
    near = _other(short, "long").withColumn(
        "block", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1))
    )
    met = short.join(near, ["t", "block"])
    met = met.where((F.col("set") < F.col("other")) & _sizes_fit(percent))
    shared = met.groupBy("set", "other").agg(
        F.count("*").alias("lists"),
        F.max(F.least("rest", "other_rest")).alias("left"),
        F.first("n").alias("n"),
        F.first("m").alias("m"),
        F.first(F.least("long", "other_long")).alias("long"),
    )
    # unless they may have met before, in a long list, enough must be left here
    left = (F.col("long") > 0) | (F.col("left") >= _needed(percent))
    shared = shared.where(left & _enough(percent, F.col("lists") + F.col("long")))
    return shared.select(F.col("set").alias("a"), F.col("other").alias("b"))


def _leader_pairs(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set with the leaders of most of its lists; other leaders every turn.

    At first with one of them, which settles most, then with several. A list's block
    for sets of one size has as leader, at first, the set that is in most lists: the
    text that copies were made from shares more with each of them than they do with
    one another. Later it is the one that comes first by hash. A set looks at the
    blocks of its own size and of the next smaller one.
    """
    at = F.xxhash64("set", F.lit(turn))
    key = [at] if turn else [-F.col("long"), at]
    first = F.min(F.struct(*(c.alias(f"k{k}") for k, c in enumerate(key)), "set", "root", "n", "rest"))
    leaders = lists.groupBy("t", "block").agg(first.alias("l"))
    leaders = _other(leaders.select("t", "block", "l.set", "l.root", "l.n", "l.rest"), "root")
    looking = lists.withColumn("block", F.explode(F.array("block", F.col("block") - 1)))
    met = looking.join(_sent_if_small(written(leaders, "leaders")), ["t", "block"])
    met = met.where((F.col("root") != F.col("other_root")) & _fits(percent))
    shared = met.groupBy("set", "other").agg(F.count("*").alias("lists"))
    best = Window.partitionBy("set").orderBy(F.desc("lists"), "other")
    chosen = shared.withColumn("k", F.row_number().over(best))
    chosen = chosen.where(F.col("k") <= (LEADERS if turn else 1))
    return chosen.select(*_ordered("set", "other")).distinct()


def _sized(lists: DataFrame) -> DataFrame:
    """Entries with whether their list ``is_long`` and with their set's number of such lists."""
    long = lists.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") > SHORT_LIST)
    marked = lists.join(long.select("t", F.lit(True).alias("is_long")), "t", "left")
    marked = written(marked.withColumn("is_long", F.coalesce("is_long", F.lit(False))), "lists")
    number = marked.where("is_long").groupBy("set").agg(F.count("*").cast("int").alias("long"))
    return marked.join(number, "set", "left").withColumn("long", F.coalesce("long", F.lit(0)))


def _open_lists(lists: DataFrame) -> DataFrame:
    """Lists with several components, each entry marked ``minor`` if it is
    outside of the list's largest component."""
    sizes = lists.groupBy("t", "root").agg(F.count("*").alias("k"))
    most = sizes.groupBy("t").agg(
        F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("list_size")
    )
    most = most.where("most.k < list_size")
    marked = lists.join(most, "t").withColumn("minor", F.col("root") != F.col("most.root"))
    return marked.drop("most")


def _other_pairs(open_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that may be similar."""
    return _grouped_pairs(open_lists, percent).select("a", "b")


def _grouped_pairs(open_lists: DataFrame, percent: int) -> DataFrame:
    """``(a, b, t, w, i, j)``: pairs across components that may be similar, each with a
    group of sets that are compared together.

    Lists in which they might meet besides these are short ones, and what meets
    there is settled already. So of what two sets share, all is in open lists. In
    the first list that they share, what is ``ahead`` for each, open lists included,
    bounds what they share; a list that leaves too little ahead is passed over, be it
    the pair's first or not.

    Blocks ``w - 1`` and ``w`` of a list make a window, and its sets are dealt into
    parts by hash: a group has the sets of two parts, however long the list is.
    """
    forward = Window.partitionBy("set").orderBy("rest")
    window = F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("w")
    entries = open_lists.withColumn("ahead", F.row_number().over(forward)).select(
        "t", window, "block", "set", "root", "n", "rest", "minor", "ahead"
    )
    entries = written(entries, "windows")
    parts = F.greatest(F.count("*") / PART_SETS, F.sum("n") / PART_SHINGLES)
    sizes = entries.groupBy("t", "w").agg(
        F.ceil(parts).cast("int").alias("parts"),
        F.max("minor").alias("any_minor"),
        F.count("*").alias("k"),
    )
    sizes = sizes.where("any_minor AND k > 1").select("t", "w", "parts")
    dealt = entries.join(_sent_if_small(written(sizes, "sizes")), ["t", "w"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    groups = dealt.select("*", other).select(
        "t",
        "w",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        *("part", "block", "set", "root", "n", "rest", "minor", "ahead"),
    )
    met = groups.groupBy("t", "w", "i", "j").applyInArrow(
        lambda table: _met(percent, table), "a long, b long, t long, w int, i int, j int"
    )
    group = F.min(F.struct("t", "w", "i", "j")).alias("g")
    return met.groupBy("a", "b").agg(group).select("a", "b", "g.*")


def _met(percent: int, table: pa.Table) -> pa.Table:
    """Of the sets of two parts: the pairs that may be similar."""
    columns = ("w", "i", "j", "part", "block", "set", "root", "n", "rest", "ahead", "minor")
    w, i, j, part, block, own, root, n, rest, ahead, minor = (
        table[c].to_numpy() for c in columns
    )
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = []
    # rows of a matrix of pairs, some of them at a time
    for k in range(0, len(left), 256):
        x, y = left[k : k + 256, None], right[None, :]
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fits = (root[x] != root[y]) & (minor[x] | minor[y])
        fits &= 100 * least >= percent * most
        # both in the earlier block: the window before has them
        fits &= (block[x] == w[0]) | (block[y] == w[0])
        if i[0] == j[0]:
            fits &= own[x] < own[y]
        needed = percent * (least + most) / (100 + percent)
        fits &= np.minimum(rest[x], rest[y]) >= needed
        after = -(-percent * most // 100) - 1
        fits &= np.minimum(ahead[x], ahead[y]) >= needed - after
        at = np.nonzero(fits)
        found.append(np.stack([own[x[at[0], 0]], own[y[0, at[1]]]]))
    pairs = np.sort(np.concatenate(found, axis=1), axis=0)
    same = {c: pa.array(np.repeat(table[c].to_numpy()[:1], pairs.shape[1])) for c in ("t", "w", "i", "j")}
    return pa.table({"a": pairs[0], "b": pairs[1]} | same)


def _checked_groups(pairs: DataFrame, packed: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the stored pairs with groups whose whole texts are similar enough.

    A text goes to each group that needs it, once.
    """
    group = ["t", "w", "i", "j"]
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set"), *group).distinct()
    texts = packed.join(_sent_if_small(written(ends, "ends")), "set").select("set", "packed", *group)
    both = pairs.groupBy(*group).cogroup(texts.groupBy(*group))
    return both.applyInArrow(
        lambda asked, known: _checked_group(n, percent, asked, known), "a long, b long"
    )


def _checked_group(n: int, percent: int, asked: pa.Table, known: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    packed = dict(zip(known["set"].to_pylist(), known["packed"], strict=True))
    held: dict[int, np.ndarray] = {}

    def shingles(number: int) -> np.ndarray:
        if number not in held:
            text = pa.array([unpack(packed[number].as_py()).decode()])
            held[number] = next(row_shingles(words, n) for _, words, _ in hashed_words(text))
        return held[number]

    asked = asked.select(["a", "b"]).sort_by([("a", "ascending"), ("b", "ascending")])
    links = []
    for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
        left, right = shingles(a), shingles(b)
        if len(left) > len(right):
            left, right = right, left
        near = np.minimum(np.searchsorted(right, left), len(right) - 1)
        both = int(np.count_nonzero(right[near] == left))
        links.append(100 * both >= percent * (len(left) + len(right) - both))
    return asked.filter(pa.array(links, type=pa.bool_()))


def _rows_and_roots(texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """The sets of ``texts``, stored, and the components of those that link, if any do."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts.select("text"), n))
    id_type = texts.schema["id"].dataType.simpleString()
    rows = written(
        texts.mapInArrow(
            lambda it: _sets(n, percent, frequent, it),
            f"id {id_type}, set long, n long, prefix array<long>, packed binary",
        ),
        "sets",
        outlives=True,
    )
    entries = rows.where("prefix IS NOT NULL").select(
        F.posexplode("prefix").alias("pos", "t"), "set", "n"
    )
    lists = (
        entries.select(
            "t",
            "set",
            F.col("n").cast("int").alias("n"),
            (F.col("n") - F.col("pos")).cast("int").alias("rest"),
        )
        .repartition("t")
        .sortWithinPartitions("t", "n", "set")
        .mapInArrow(_shared, "t long, set long, n int, rest int")
    )
    # sizes of similar sets differ by less than one step, rounding included
    step = F.log(F.lit(100 / percent)) * (1 + 1e-9)
    block = F.floor(F.log(F.col("n").cast("double")) / step)
    lists = written(_sized(lists.withColumn("block", block.cast("int"))), "lists")
    packed = rows.where("packed IS NOT NULL").select("set", "packed")
    listed = _sent_if_small(written(lists.select("set").distinct(), "listed"))
    packed = packed.join(listed, "set", "left_semi")
    packed = written(packed.dropDuplicates(["set"]), "packed")

    tried = written(_short_pairs(lists.where("NOT is_long"), percent), "pairs")
    roots = _joined(None, written(checked_links(tried, packed, n, percent), "links"))

    # long lists: leaders first, as long as that settles much, then what is left
    whole = lists.where("is_long").select("t", "block", "set", "n", "rest", "long")
    size, before, turn = whole.count(), None, 0
    while size:
        labelled = whole.withColumn("root", F.col("set"))
        labelled = _open_lists(labelled if roots is None else _renamed(labelled, roots, "root"))
        labelled = written(labelled, "lists")
        left = _work(labelled)
        last = left <= size // 4 or (before is not None and left > 0.8 * before)
        make = _grouped_pairs(labelled, percent) if last else _leader_pairs(labelled, percent, turn)
        pairs = written(make.join(tried, ["a", "b"], "left_anti"), "pairs")
        check = _checked_groups if last else checked_links
        roots = _joined(roots, written(check(pairs, packed, n, percent), "links"))
        if last:
            break
        tried = tried.unionByName(pairs)
        before, turn = left, turn + 1
    return rows, None if roots is None else written(roots, "roots", outlives=True)


def similar_components(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, a row per row of ``docs``.

    Two texts link when their sets of distinct ``n``-word shingles (A-Z
    lower-cased) have a Jaccard similarity of ``percent`` / 100 or more; a text of
    fewer words is one shingle. ``component_id`` is the least id that links lead
    to, the row's own included.

    Null and empty texts and texts without words have no shingles and link with
    nothing. Rows with equal texts link, whatever their ids; rows with equal ids
    do so only if their texts do. Null ids are never a component's id unless it
    has no other. Other columns are ignored. An empty table gives an empty result.
    Sets are known by 64-bit numbers.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with intermediate_tables(docs.sparkSession):
        rows, roots = _rows_and_roots(texts, n, percent)
    labels = rows.select("id", "n", F.col("set").alias("root"))
    if roots is not None:
        labels = _renamed(labels, roots, "root")
    least = labels.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    named = labels.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    return named


def _work(open_lists: DataFrame) -> int:
    """Pairs that looking through all open lists would meet."""
    per_list = open_lists.groupBy("t").agg(
        (F.sum(F.col("minor").cast("long")) * F.count("*")).alias("pairs")
    )
    return per_list.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components ``roots`` with more links between their sets."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    more = components(_renamed(_renamed(links, roots, "a"), roots, "b").where("a <> b").distinct())
    kept = _renamed(roots, more, "root")
    fresh = more.join(roots.select("v"), "v", "left_anti")
    return written(kept.unionByName(fresh), "roots")
