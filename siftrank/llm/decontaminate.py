"""Benchmark passages in documents, found by spaced seeds.

A seed is a number of words that follow each other, or do so but for one word that
is skipped. The fewer words may be substituted in a stretch, the more of them a seed
can have without missing any: :func:`seed_weight` gives the most. Seeds of the
benchmark are hashed once, those of the documents on the fly; a hit fixes how passage
and document lie on each other, and the words around it are compared one by one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.words import hashed_words, mixed
from siftrank.operators.ranges import in_ranges
from siftrank.session import written

_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
_FILTER_BITS = 22
# Bits of the filter for all items, where they are in several blocks.
_ALL_BITS = 27
# Hits, and words on their diagonals, that are looked at together.
_AT_ONCE = 500_000


def substituted(length: int, share: float) -> int:
    """How many of ``length`` words may differ if at least ``share`` of them are equal."""
    return int(length - np.ceil(share * length - 1e-9))


def seed_weight(length: int, share: float) -> int:
    """The most words of a seed that no stretch of ``length`` words can be without.

    ``e`` substituted words leave ``e + 1`` runs of equal ones, some of them empty, which
    make ``e // 2 + 1`` groups of two neighbours or one. A group is a run, or two with one
    word between them; the largest has at least the mean.
    """
    e = substituted(length, share)
    return -(-(length - e) // (e // 2 + 1))


def least_weight(item: int, min_words: int, share: float) -> int:
    """The weight that finds all allowed stretches of an item of so many words."""
    return min(seed_weight(n, share) for n in range(min(item, min_words), item + 1))


def masks(weight: int) -> list[tuple[int, ...]]:
    """The places of a seed's words: without a gap, and with one word skipped."""
    return [tuple(k + (k >= gap) for k in range(weight)) for gap in range(weight, 0, -1)]


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A number for each window of ``words``, of the words the mask looks at."""
    size = len(words) - mask[-1]
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    gap = next((i for i, k in enumerate(mask) if k > i), 0)
    total = np.full(size, 1 + (len(mask) << 32) + gap, dtype=np.uint64)
    for k in mask:
        total = total * _FACTOR + words[k : k + size]
    return mixed(total)


class _Items:
    """One block of benchmark items: their words and a sorted table of their seeds."""

    def __init__(
        self,
        ids: list,
        texts: list[str | None],
        min_words: int,
        share: float,
        shortest_item: int = 1,
    ):
        self.ids, held = [], []
        for first, words, at in hashed_words(pa.array(texts, type=pa.string())):
            for k in range(len(at) - 1):
                if at[k + 1] - at[k] >= max(shortest_item, 1):
                    self.ids.append(ids[first + k])
                    held.append(words[at[k] : at[k + 1]])
        empty = [np.empty(0, dtype=np.uint64)]
        self.lengths = np.array([len(w) for w in held], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate(held or empty)
        weights = {n: least_weight(n, min_words, share) for n in set(self.lengths.tolist())}
        # an exact item needs no gap
        self.masks = sorted(
            {m for n, w in weights.items() for m in masks(w)[: None if w < n else 1]}
        )
        keys, items, places = [], [], []
        for k, words in enumerate(held):
            weight = weights[len(words)]
            for mask in masks(weight)[: None if weight < len(words) else 1]:
                own = seeds(words, mask)
                keys.append(own)
                items.append(np.full(len(own), k))
                places.append(np.arange(len(own)))
        keys = np.concatenate(keys or empty)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.items = np.concatenate(items or empty)[order].astype(np.int64)
        self.places = np.concatenate(places or empty)[order].astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self._slot(self.keys)] = True
        self.least = np.array(
            [min(n, min_words) for n in self.lengths.tolist()], dtype=np.int64
        )
        # a stretch has at least so many equal words
        self.least_equal = self.least - np.array(
            [substituted(n, share) for n in self.least.tolist()], dtype=np.int64
        )

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def diagonals(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct ``(row, item, place of the item's first word)`` of the seeds that occur
        in both, sorted. A seed that goes over the end of a row is none."""
        held, n_held = [np.empty((0, 3), dtype=np.int64)], 0
        for mask in self.masks:
            own = seeds(words, mask)
            place = np.flatnonzero(self.filter[self._slot(own)])
            low = np.searchsorted(self.keys, own[place], side="left")
            high = np.searchsorted(self.keys, own[place], side="right")
            row = np.searchsorted(at, place, side="right") - 1
            real = (high > low) & (place + mask[-1] < at[np.minimum(row + 1, len(at) - 1)])
            place, low, high, row = place[real], low[real], high[real], row[real]
            ends = np.cumsum(high - low)
            begin = 0
            while begin < len(place):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + _AT_ONCE, side="right")))
                n = (high - low)[begin:end]
                each = np.repeat(np.arange(begin, end), n)
                k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + low[each]
                found = np.column_stack((row[each], self.items[k], place[each] - self.places[k]))
                held.append(np.unique(found, axis=0))
                n_held += len(held[-1])
                if n_held > _AT_ONCE:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    n_held = 0
                begin = end
        return np.unique(np.concatenate(held), axis=0)


def best_stretch(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest ``[start, end)`` that begins and ends with equal words and in which at
    least ``share`` of all words are equal."""
    score = np.concatenate([[0.0], np.cumsum(same - share)])
    # only a start with a lower score than all before it can begin the longest
    begins = np.flatnonzero(same)
    lower = np.ones(len(begins), dtype=bool)
    lower[1:] = score[begins[1:]] < np.minimum.accumulate(score[begins])[:-1]
    begins = begins[lower]
    ends = np.flatnonzero(same) + 1
    first = np.searchsorted(-score[begins], -(score[ends] + 1e-9))
    found = first < len(begins)
    lengths = ends[found] - begins[first[found]]
    if not len(lengths):
        return 0, 0
    best = int(np.argmax(lengths))
    return int(begins[first[found][best]]), int(ends[found][best])


def _compared(table: _Items, words: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """``(row, item, first place, equal or not)`` of diagonals with enough equal words."""
    found = table.diagonals(words, at)
    row, item, shift = found[:, 0], found[:, 1], found[:, 2]
    low = np.maximum(shift, at[row])
    n = np.minimum(shift + table.lengths[item], at[row + 1]) - low
    source = table.starts[item] + low - shift
    ends = np.cumsum(n)
    begin = 0
    while begin < len(found):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + _AT_ONCE, side="right")))
        lengths = n[begin:end]
        first = np.cumsum(lengths) - lengths
        k = np.arange(lengths.sum()) - np.repeat(first, lengths)
        same = (
            words[k + np.repeat(low[begin:end], lengths)]
            == table.words[k + np.repeat(source[begin:end], lengths)]
        )
        enough = np.add.reduceat(same.astype(np.int64), first) >= table.least_equal[item[begin:end]]
        for d in np.flatnonzero(enough):
            yield (
                int(row[begin + d]),
                int(item[begin + d]),
                int(low[begin + d]),
                same[first[d] : first[d] + lengths[d]],
            )
        begin = end


def _blocks(items: DataFrame, most_items: int, most_chars: int) -> list[DataFrame]:
    """``items`` in blocks of so many items and characters; a longer one is a block by itself.

    Blocks follow the items' order, so one that is there very often is in several.
    """
    used = F.length(F.coalesce("text", F.lit(""))).cast("long")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(used), F.lit(0)).alias("chars")).first()
    if size.n <= most_items and size.chars <= most_chars:
        return [items]
    tied = items.withColumns({"used": used, "tie": F.monotonically_increasing_id()})
    ranged = in_ranges(tied, ["item_id", "text", "tie"], 1 + size.n // most_items)
    earlier = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.floor(F.coalesce(F.sum("used").over(earlier), F.lit(0)) / most_chars)
    block = F.struct("part", F.floor(F.col("nth") / most_items).alias("nth"), chars.alias("chars"))
    numbered = written(ranged.select("item_id", "text", block.alias("block")), "items")
    # a row for each block
    names = numbered.select("block.*").distinct().orderBy("part", "nth", "chars").collect()
    return [
        numbered.where(
            (F.col("block.part") == r.part) & (F.col("block.nth") == r.nth) & (F.col("block.chars") == r.chars)
        ).select("item_id", "text")
        for r in names
    ]


def _item_seeds(min_words: int, share: float, shortest_item: int, batches):
    """The numbers of all seeds of items (text), and the masks that they were made with."""
    for batch in batches:
        table = _Items([None] * len(batch), batch.column(0).to_pylist(), min_words, share, shortest_item)
        numbers = pa.array(table.keys.view(np.int64))
        weights = pa.array([_mask_name(m) for m in table.masks], pa.string())
        yield pa.RecordBatch.from_arrays([numbers, pa.nulls(len(numbers), pa.string())], ["h", "mask"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(weights), pa.int64()), weights], ["h", "mask"])


def _mask_name(mask: tuple[int, ...]) -> str:
    return " ".join(map(str, mask))


def _with_a_seed(texts: DataFrame, items: DataFrame, min_words: int, share: float, shortest: int):
    """The ``texts`` that have a seed of any item, and some others: a filter of bounded size
    has a bit for the number of each seed. Texts are read once for all blocks."""
    spark = texts.sparkSession
    found = items.select("text").mapInArrow(
        lambda it: _item_seeds(min_words, share, shortest, it), "h long, mask string"
    )
    found = written(found, "seeds")
    masks = [tuple(map(int, r.mask.split())) for r in found.where("mask IS NOT NULL").select("mask").distinct().collect()]
    at = F.shiftrightunsigned("h", 64 - _ALL_BITS)
    words = (
        found.where("h IS NOT NULL")
        .select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
        .toPandas()
    )
    filled = np.zeros(1 << (_ALL_BITS - 6), dtype=np.uint64)
    filled[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast((filled, sorted(masks)))

    def candidates(batches):
        bits, known = sent.value
        for batch in batches:
            has = np.zeros(len(batch), dtype=bool)
            for first, words, at in hashed_words(batch.column(1)):
                for mask in known:
                    slot = seeds(words, mask) >> np.uint64(64 - _ALL_BITS)
                    bit = bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))
                    place = np.flatnonzero(bit & np.uint64(1))
                    row = np.searchsorted(at, place, side="right") - 1
                    inside = place + mask[-1] < at[np.minimum(row + 1, len(at) - 1)]
                    has[first + row[inside]] = True
            yield batch.filter(pa.array(has))

    return written(texts.mapInArrow(candidates, texts.schema), "candidates")


def _found(items, share: float, batches) -> Iterator[pa.RecordBatch]:
    table = object.__new__(_Items)
    vars(table).update(items.value)
    for batch in batches:
        rows, ids, starts, ends, equal = [], [], [], [], []
        for first, words, at in hashed_words(batch.column(1)):
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for row, item, low, same in _compared(table, words, at):
                begin, end = best_stretch(same, share)
                longest = best.get((row, item), (0, 0, 0))
                if end - begin >= table.least[item] and end - begin > longest[1] - longest[0]:
                    n = int(same[begin:end].sum())
                    best[row, item] = (int(low + begin - at[row]), int(low + end - at[row]), n)
            for (row, item), (start, end, n) in best.items():
                rows.append(first + row)
                ids.append(table.ids[item])
                starts.append(start)
                ends.append(end)
                equal.append(n)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(ids, type=table.id_type),
                    *(pa.array(x, type=pa.int64()) for x in (starts, ends, equal)),
                ],
                ["id", "item_id", "start_word", "end_word", "n_equal"],
            )


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = 13,
    share: float = 0.8,
    block_items: int = 20_000,
    block_chars: int = 32_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest_item: int = 5,
) -> DataFrame:
    """``(id_col, item_id, start_word, end_word, n_equal)``: passages found in documents.

    A row for each document and benchmark item (``item_id``, ``text``) that lie on
    each other in a stretch of ``min_words`` words or more, or of the whole item
    if it is shorter, of which at least ``share`` are equal (A-Z lower-cased); of
    several stretches the longest. Words may be substituted, not inserted. Items of
    fewer than ``shortest_item`` words are not looked for, with 1 all that have words;
    those of fewer than five are found only word for word at the default share.

    Null and empty texts contain nothing. Repeated documents are found each by
    itself, repeated items too. Null ids are kept; ids may be of any type. Other columns are ignored.
    If either table is empty, so is the result.

    The benchmark is worked through in blocks of bounded size, each of which is sent to
    all tasks. If there are several, documents without any seed of any item are left out
    by a pass before, so that the text of most is read once.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    id_type, item_type = texts.schema["id"].dataType, items.schema["item_id"].dataType
    schema = (
        f"id {id_type.simpleString()}, item_id {item_type.simpleString()}, "
        "start_word long, end_word long, n_equal long"
    )
    spark, found = docs.sparkSession, None
    blocks = _blocks(items, block_items, block_chars)
    if len(blocks) > 1:
        texts = _with_a_seed(texts, items, min_words, share, shortest_item)
    for part in blocks:
        own = part.toArrow()
        table = _Items(
            own["item_id"].to_pylist(), own["text"].to_pylist(), min_words, share, shortest_item
        )
        table.id_type = own.schema.field("item_id").type
        sent = spark.sparkContext.broadcast(vars(table))
        hits = texts.mapInArrow(lambda it, sent=sent: _found(sent, share, it), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnRenamed("id", id_col)
