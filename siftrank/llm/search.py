"""Ranked lexical search for many items at once, sharing what their queries share.

A document's score for an item is a sum over the item's terms, so items that share
terms share sums. Items with the same terms are one set. The sets' terms are brought
into a common order, the most shared first, and neighbours that occur together in
two sets or more are replaced by a node that stands for both, again and again, nodes
included. What comes out is a graph: nodes are shared term sets, a set is what is
left of it, terms and nodes. For some thousand documents at a time the sum of every
node is made once, from those of its two parts, and a set adds up its nodes.

Texts are read once for a million term positions of items, and reduced to their
counts of these terms, which are stored. Every task keeps the best documents of each
set; a sample ranked before says below which score nothing needs to be kept.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.words import row_slices
from siftrank.operators.ranges import in_ranges
from siftrank.session import written

# Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTE = np.zeros(256, dtype=bool)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Positions of item terms for which texts are read once, and of one graph.
PASS_POSITIONS = 1_000_000
BLOCK_POSITIONS = 50_000
# Documents whose sums are made together, and bytes for the sums of nodes.
DOCUMENTS = 4096
NODE_BYTES = 128 << 20
SAMPLE = 0.01


# Nodes as pairs of parts, and what is left of each set, by its number. A part is a
# term's number or, from the number of terms on, a node. Plain, to be sent to tasks.
Graph = tuple[np.ndarray, list[tuple[int, np.ndarray]]]


def shared_pairs(sets: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes (pairs of parts, each after its parts) and what is left of each set.

    Each round looks at neighbours only, so its work grows with the number of terms.
    Of overlapping pairs the one that is more frequent in all sets is replaced.
    """
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    parts = np.concatenate(sets).astype(np.int64) if len(sets) else np.empty(0, dtype=np.int64)
    of = np.repeat(np.arange(len(sets)), lengths)
    shared = np.bincount(parts, minlength=1)
    order = np.lexsort((parts, -shared[parts], of))
    parts, of = parts[order], of[order]
    made: list[np.ndarray] = []
    n_nodes = n_terms
    while len(parts) > 1:
        base = n_nodes + 1
        inside = of[1:] == of[:-1]
        codes = np.where(inside, parts[:-1] * base + parts[1:], -1)
        unique, number, counts = np.unique(codes, return_inverse=True, return_counts=True)
        # by frequency, then by code: neighbours never have the same place
        place = np.empty(len(unique), dtype=np.int64)
        place[np.lexsort((-unique, counts))] = np.arange(1, len(unique) + 1)
        rank = np.where(inside & (counts[number] > 1), place[number], 0)
        around = np.concatenate([[0], rank, [0]])
        chosen = (rank > 0) & (rank > around[:-2]) & (rank > around[2:])
        used, again = np.unique(number[chosen], return_counts=True)
        used = used[again > 1]
        if not len(used):
            break
        chosen &= np.isin(number, used)
        at = np.flatnonzero(chosen)
        made.append(np.stack([unique[used] // base, unique[used] % base], axis=1))
        parts[at] = n_nodes + np.searchsorted(used, number[at])
        n_nodes += len(used)
        keep = np.ones(len(parts), dtype=bool)
        keep[at + 1] = False
        parts, of = parts[keep], of[keep]
    pairs = np.concatenate(made) if made else np.empty((0, 2), dtype=np.int64)
    return pairs, np.split(parts, np.searchsorted(of, np.arange(1, len(sets))))


def _graph_rows(vocabulary, table: pa.Table) -> pa.Table:
    """Of one block's sets: ``(block, set, parts)``, nodes having no set."""
    table = table.combine_chunks()
    terms = table["terms"].combine_chunks()
    numbers = pc.index_in(terms.flatten(), value_set=vocabulary.value).to_numpy()
    cuts = np.cumsum(pc.list_value_length(terms).to_numpy())[:-1]
    pairs, left = shared_pairs(np.split(numbers.astype(np.int64), cuts), len(vocabulary.value))
    rows = [p.tolist() for p in pairs] + [p.tolist() for p in left]
    return pa.table(
        {
            "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()),
            "set": pa.array([None] * len(pairs) + table["set"].to_pylist(), pa.int64()),
            "nth": pa.array(range(len(rows)), pa.int64()),
            "parts": pa.array(rows, pa.list_(pa.int64())),
        }
    )


def _counts(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text): ``(id, n, terms, counts)`` for texts with at least one term."""
    known = vocabulary.value
    for batch in batches:
        for first, text, rows in row_slices(batch.column(1)):
            inside = _TERM_BYTE[text]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            row_starts = rows[:-1][rows[:-1] < len(text)]
            begins[row_starts] |= inside[row_starts]
            starts = np.flatnonzero(begins)
            if not len(starts):
                continue
            letters = _LOWER[text[inside]]
            offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(
                len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)
            )
            row = np.searchsorted(rows, starts, side="right") - 1
            number = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            hit = number >= 0
            codes, counts = np.unique(row[hit] * len(known) + number[hit], return_counts=True)
            n = np.bincount(row, minlength=len(rows) - 1)
            some = np.flatnonzero(n)
            ends = np.searchsorted(codes // len(known), some, side="right")
            lists = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some + first)),
                    pa.array(n[some]),
                    pa.ListArray.from_arrays(lists, pa.array((codes % len(known)).astype(np.int32))),
                    pa.ListArray.from_arrays(lists, pa.array(counts.astype(np.int64))),
                ],
                ["id", "n", "terms", "counts"],
            )


class _Best:
    """The best documents of each set so far, of equal ones those with the least ids."""

    def __init__(self, k: int, floors: dict[int, int]):
        self.k = k
        self.floors = dict(floors)
        self.held: dict[int, pa.Table] = {}

    def add(self, number: int, scores: np.ndarray, ids: pa.Array) -> None:
        least = self.floors.get(number, 1)
        if scores.max() < least:
            return
        at = np.flatnonzero(scores >= least)
        if len(at) > self.k:
            last = np.partition(scores[at], -self.k)[-self.k]
            at = at[scores[at] >= last]
        found = pa.table({"score": scores[at], "id": ids.take(pa.array(at))})
        if number in self.held:
            found = pa.concat_tables([self.held[number], found])
        order = pc.sort_indices(
            found, [("score", "descending"), ("id", "ascending")], null_placement="at_start"
        )
        found = found.take(order[: self.k]).combine_chunks()
        self.held[number] = found
        if len(found) == self.k:
            self.floors[number] = max(least, found["score"][-1].as_py())

    def rows(self) -> Iterator[pa.RecordBatch]:
        for number, found in self.held.items():
            numbers = pa.array(np.full(len(found), number, dtype=np.int64))
            yield from found.add_column(0, "set", numbers).select(["set", "id", "score"]).to_batches()


def _ranked(graphs, weights, floors, k: int, batches) -> Iterator[pa.RecordBatch]:
    """Of (id, m, terms, counts): ``(set, id, score)``, the best ``k`` of this task."""
    best = _Best(k, floors.value)
    for batch in batches:
        for graph in graphs.value:
            size = NODE_BYTES // (8 * (len(graph[0]) + 1))
            size = max(64, min(DOCUMENTS, size))
            for first in range(0, len(batch), size):
                _add_scores(graph, weights.value, batch.slice(first, size), best)
    yield from best.rows()


def _add_scores(graph: Graph, weights: np.ndarray, batch: pa.RecordBatch, best: _Best) -> None:
    pairs, sets = graph
    ids, m = batch.column(0), batch.column(1).to_numpy()
    lengths = pc.list_value_length(batch.column(2)).to_numpy()
    term = batch.column(2).flatten().to_numpy()
    tf = batch.column(3).flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), lengths)
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    order = np.argsort(term, kind="stable")
    term, row, gain = term[order], row[order], gain[order]
    at = np.searchsorted(term, np.arange(len(weights) + 1)).tolist()
    sums = np.zeros((len(pairs), len(ids)), dtype=np.int64)

    def add(total: np.ndarray, part: int) -> None:
        if part >= len(weights):
            total += sums[part - len(weights)]
        elif (begin := at[part]) < (end := at[part + 1]):
            total[row[begin:end]] += gain[begin:end]

    for node, (left, right) in enumerate(pairs.tolist()):
        add(sums[node], left)
        add(sums[node], right)
    for number, parts in sets:
        total = np.zeros(len(ids), dtype=np.int64)
        for part in parts.tolist():
            add(total, part)
        best.add(number, total, ids)


def _lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())


def _blocks(sets: DataFrame, block_positions: int) -> DataFrame:
    """``(set, block, terms)``, written: sets with near terms in the same block."""
    positions = sets.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    near = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    parts = -(-positions // block_positions) or 1
    ranged = in_ranges(sets.withColumn("near", near), ["near", "terms"], parts)
    earlier = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("terms")).over(earlier), F.lit(0))
    number = F.shiftleft(F.col("part").cast("long"), 33)
    return written(
        ranged.select(
            (number + F.col("nth")).alias("set"),
            (number + F.floor(before / block_positions)).alias("block"),
            "terms",
        ),
        "item_sets",
    )


def _passes(sets: DataFrame, pass_positions: int) -> list[tuple[int, int]]:
    """First and last block of each pass; a row per block is fetched for that."""
    sizes = sets.groupBy("block").agg(F.sum(F.size("terms")).alias("n")).orderBy("block").collect()
    passes, size = [], 0
    for block, n in sizes:
        if passes and size + n <= pass_positions:
            passes[-1] = (passes[-1][0], block)
            size += n
        else:
            passes.append((block, block))
            size = n
    return passes


def _graphs(sets: DataFrame, vocabulary) -> list[Graph]:
    """The graphs of the blocks, made one in a task, fetched for sending them out."""
    rows = (
        sets.select("block", "set", "terms")
        .groupBy("block")
        .applyInArrow(
            lambda table: _graph_rows(vocabulary, table),
            "block long, set long, nth long, parts array<long>",
        )
        .toPandas()
        .sort_values(["block", "nth"])
    )
    graphs = []
    for _, block in rows.groupby("block"):
        nodes = block["set"].isna()
        pairs = np.array(block["parts"][nodes].tolist(), dtype=np.int64).reshape(-1, 2)
        left = block[~nodes]
        numbers = left["set"].astype("int64").tolist()
        graphs.append((pairs, [(s, np.array(p)) for s, p in zip(numbers, left["parts"], strict=True)]))
    return graphs


def _best_of(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("set").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(texts: DataFrame, sets: DataFrame, k: int) -> DataFrame | None:
    """``(set, rank, id, score)`` for the sets of one pass."""
    spark = texts.sparkSession
    terms = sets.select(F.explode("terms").alias("term")).distinct().toArrow()["term"]
    terms = pc.array_sort_indices(terms.combine_chunks()), terms.combine_chunks()
    vocabulary = spark.sparkContext.broadcast(terms[1].take(terms[0]).cast(pa.large_string()))
    id_type = texts.schema["id"].dataType.simpleString()
    hits = written(
        texts.mapInArrow(
            lambda it: _counts(vocabulary, it),
            f"id {id_type}, n long, terms array<int>, counts array<long>",
        ),
        "counts",
    )
    n_docs, length = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    held = np.zeros(len(vocabulary.value), dtype=np.int64)
    rows = df.toPandas()
    held[rows["term"]] = rows["df"]
    ratio = ((2 * n_docs + 2) / (2 * d + 1) for d in held.tolist())
    weights = np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)
    weights = spark.sparkContext.broadcast(weights)
    graphs = spark.sparkContext.broadcast(_graphs(sets, vocabulary))

    # products of counts may pass 64 bits before they are divided
    m = F.expr(
        f"10L + (CAST(90 AS DECIMAL(2,0)) * CAST(n AS DECIMAL(18,0)) * CAST({n_docs}L AS DECIMAL(18,0)))"
        f" div CAST({length}L AS DECIMAL(19,0))"
    )
    rows = hits.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "counts")

    def ranked(some: DataFrame, floors: dict[int, int]) -> DataFrame:
        floors = spark.sparkContext.broadcast(floors)
        best = some.mapInArrow(
            lambda it: _ranked(graphs, weights, floors, k, it), f"set long, id {id_type}, score long"
        )
        return _best_of(best, k)

    last = ranked(rows.sample(SAMPLE, seed=1), {}).where(F.col("rank") == k)
    return ranked(rows, {r["set"]: r["score"] for r in last.select("set", "score").collect()})


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_positions: int = PASS_POSITIONS,
    block_positions: int = BLOCK_POSITIONS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` best documents of each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
    A-Z lower-cased, each once per item. A term's weight is
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and counts
    ``(10^9 tf) div (1000 tf + 8 m)`` times, ``m`` being ``10 + (90 n N) div L``,
    with the documents ``N`` and all terms ``L`` of those that have any. Scores of 0
    are left out; of equal scores the smaller id comes first, null before all.

    Documents and items are rows: ids that repeat stay apart. Null and empty texts,
    and those without a term, are neither counted nor found, and such items find
    nothing. Ids are numbers, texts or dates. Other columns are ignored, and empty
    tables give an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = F.regexp_extract_all(_lowered(F.col(item_text_col)), F.lit(TERM), F.lit(0))
    asked = items.select(
        F.col(item_col).alias("item"), F.array_sort(F.array_distinct(found)).alias("terms")
    ).where(F.size("terms") > 0)
    sets = _blocks(asked.select("terms").distinct(), block_positions)
    result = None
    for first, last in _passes(sets, pass_positions):
        best = _searched(texts, sets.where(F.col("block").between(first, last)), k)
        if best is not None:
            result = best if result is None else result.unionByName(best)
    members = asked.join(sets, "terms").select("item", "set")
    if result is None:
        result = texts.select(
            F.lit(0).cast("long").alias("set"),
            "id",
            F.lit(0).cast("long").alias("score"),
            F.lit(0).alias("rank"),
        ).where("false")
    return members.join(result, "set").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
