"""Byte-level BPE encoding and decoding over all distinct words.

Documents become blocks: their pre-tokens as positions in the block's own list of
distinct ones. These lists are exploded and shuffled by word, so that each distinct
word of all documents is encoded once; its ids are joined back to where the word
stands in the blocks, and put in place by position, block by block. Decoding joins
ids with the table of token bytes. Positions stay in their block, so what is shuffled
are words, not occurrences.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.bpe import distinct_pieces, gathered, merged, read_ranks
from siftrank.llm.tables import written_buckets

BLOCK_PIECES = 4_500_000
# Distinct pieces that end a block before it is full.
BLOCK_WORDS = 1_000_000
# Words of a task that wait to be sent back to their blocks together.
HELD_WORDS = 400_000
# Pieces, in whole rows, that are put in place at once; tokens that are decoded at once.
PLACED_AT_ONCE = 500_000
DECODED_AT_ONCE = 500_000


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, compressed with bytes of one rank side by side."""
    parts = [np.array([len(a) for a in arrays], dtype="<u4").tobytes()]
    for values in arrays:
        parts.append(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(packed: bytes, n: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    lengths, at, arrays = data[: 4 * n].view("<u4"), 4 * n, []
    for length in lengths.tolist():
        planes = data[at : at + 4 * length].reshape(4, -1)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 * length
    return arrays


class _Block:
    def __init__(self, pattern):
        self.pattern = pattern
        self.ids, self.lengths, self.sequence = [], [], []
        self.words: dict[str, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def places(self, piece: str) -> tuple[int, ...]:
        words, found = self.words, self.pattern.findall(piece)
        # a piece that is one word is held as one string
        found = [piece] if found == [piece] else found
        own = tuple(words.setdefault(w, len(words)) for w in found)
        self.pieces[piece] = own
        return own

    def add(self, ids: list, pieces: list[str], which: np.ndarray, rows: np.ndarray) -> None:
        found = self.pieces.get
        lists = [found(p) or self.places(p) for p in pieces]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        values = np.array([k for x in lists for k in x], dtype=np.uint32)
        sequence, ends = gathered(values, offsets, which)
        self.ids += ids
        self.lengths.append(np.diff(np.concatenate([[0], ends])[rows]))
        self.sequence.append(sequence)

    def batch(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """Frequent words get small places, and bytes of one rank stand together."""
        sequence = np.concatenate(self.sequence)
        by_count = np.argsort(-np.bincount(sequence, minlength=len(self.words)), kind="stable")
        place = np.empty(len(by_count), dtype="<u4")
        place[by_count] = np.arange(len(by_count))
        words = list(self.words)
        packed = _packed(place[sequence])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(id_type)),
                pa.array([np.concatenate(self.lengths)], pa.list_(pa.int64())),
                pa.array([packed], pa.binary()),
                pa.array([[words[k] for k in by_count]], pa.list_(pa.string())),
            ],
            ["block", "ids", "lengths", "sequence", "words"],
        )


def _blocks(
    pattern: str, size: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    compiled = regex.compile(pattern)
    number, block = TaskContext.get().partitionId() << 32, _Block(compiled)
    id_type = None
    for batch in batches:
        id_type = batch.column(0).type
        ids = batch.column(0).to_pylist()
        for first, pieces, which, rows in distinct_pieces(batch.column(1)):
            block.add(ids[first : first + len(rows) - 1], pieces, which, rows)
            block.size += len(which)
            if block.size >= size or len(block.pieces) >= BLOCK_WORDS:
                full, block = block.batch(number, id_type), _Block(compiled)
                number += 1
                yield full
    if block.ids:
        yield block.batch(number, id_type)


def _encoded(ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (word, block, place) sorted by word: each block's places with their ids.

    A word's rows follow each other, so it is encoded once.
    """
    table = ranks.value
    held: dict[int, tuple[list[int], list[list[int]]]] = {}
    n_held = 0

    def rank(left: bytes, right: bytes) -> int | None:
        return table.get(left + right)

    def emitted() -> pa.RecordBatch:
        packed = []
        for places, codes in held.values():
            lengths = np.array([len(c) for c in codes])
            packed.append(_packed(np.array(places), lengths, np.array([c for x in codes for c in x])))
        numbers = pa.array(list(held), pa.int64())
        return pa.RecordBatch.from_arrays([numbers, pa.array(packed, pa.binary())], ["block", "codes"])

    last, codes = None, []
    for batch in batches:
        words, numbers, places = (batch.column(k).to_pylist() for k in range(3))
        for word, number, place in zip(words, numbers, places, strict=True):
            if word != last:
                last, codes = word, [table[s] for s in merged(word.encode(), rank)]
            own = held.get(number)
            if own is None:
                own = held[number] = ([], [])
            own[0].append(place)
            own[1].append(codes)
        n_held += len(words)
        if n_held >= HELD_WORDS:
            yield emitted()
            held.clear()
            n_held = 0
    if held:
        yield emitted()


def _column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that begin at ``at``, which has one entry more than there are."""
    buffers = [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    values = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers)
    return values.cast(pa.binary())


def _token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in order of their ids, and where each begins."""
    known = {code: token for token, code in ranks.items()}
    tokens = [known.get(code, b"") for code in range(max(known, default=-1) + 1)]
    starts = np.cumsum([0, *map(len, tokens)]).astype(np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), starts


def _put_in_place(tokens, at_once: int, blocks: pa.Table, words: pa.Table) -> pa.Table:
    blocks = blocks.combine_chunks()
    row = {name: blocks.column(name)[0] for name in ("ids", "lengths", "sequence")}
    rows = np.concatenate([[0], np.cumsum(row["lengths"].values.to_numpy())]).astype(np.int64)
    (order,) = _unpacked(row["sequence"].as_py(), 1)
    parts = [_unpacked(packed.as_py(), 3) for packed in words.column("codes")]
    nothing = [np.empty(0, dtype="<u4")]
    places, lengths, codes = (np.concatenate([*x] or nothing) for x in zip(*parts or [nothing * 3]))
    # lists of ids in order of their words' places
    by_place = np.argsort(places, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    codes, ends = gathered(codes, offsets, by_place)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    cuts = np.flatnonzero(np.diff(rows[:-1] // at_once)) + 1
    stretches = pairwise([0, *cuts.tolist(), len(rows) - 1])
    return pa.Table.from_batches(
        [
            _placed(tokens.value, codes, offsets, order, row["ids"].values.slice(a, b - a), rows[a : b + 1])
            for a, b in stretches
        ]
    )


def _placed(tokens, codes, offsets, order, row_ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
    """A stretch of rows: its words' ids one after the other, and their bytes."""
    ids, ends = gathered(codes, offsets, order[rows[0] : rows[-1]])
    ids_at = np.concatenate([[0], ends]).astype(np.int64)[rows - rows[0]]
    # the join with the table of token bytes, by number
    data, starts = tokens
    texts = [
        gathered(data, starts, ids[k : k + DECODED_AT_ONCE])[0]
        for k in range(0, len(ids), DECODED_AT_ONCE)
    ]
    texts = np.concatenate([*texts, np.empty(0, dtype=np.uint8)])
    texts_at = np.concatenate([[0], np.cumsum(np.diff(starts)[ids])])[ids_at]
    return pa.RecordBatch.from_arrays(
        [
            row_ids,
            pa.array(np.diff(ids_at), pa.int64()),
            _column(ids.view(np.uint8), 4 * ids_at),
            _column(texts, texts_at),
        ],
        ["id", "n_tokens", "token_ids", "decoded"],
    )


def encoded_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """``(id_col, n_tokens, token_ids, decoded)``, a row per row of ``docs``.

    ``token_ids`` are little-endian unsigned 32-bit numbers by the ranks of a .tiktoken
    file, which the driver reads, each match of ``pattern`` by itself and without
    special tokens; ``decoded`` are the bytes that these ids stand for. A block holds
    whole texts of about ``block_pieces`` pre-tokens; the result does not depend on it.

    Null and empty texts have no tokens. Rows are encoded one by one, so repeated ones
    and null ids do not matter; other columns are ignored; an empty table gives an
    empty result.
    """
    spark, at_once = docs.sparkSession, min(PLACED_AT_ONCE, block_pieces)
    ranks = read_ranks(vocabulary)
    sent = spark.sparkContext.broadcast(ranks)
    # as large as the vocabulary
    tokens = spark.sparkContext.broadcast(_token_table(ranks))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    # bucketed, so that positions need not be shuffled to meet their words again
    blocks = written_buckets(
        texts.mapInArrow(
            lambda it: _blocks(pattern, block_pieces, it),
            f"block long, ids array<{id_type}>, lengths array<long>, sequence binary, "
            "words array<string>",
        ),
        "blocks",
        "block",
    )
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    coded = (
        words.select("word", "block", "place")
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(lambda it: _encoded(sent, it), "block long, codes binary")
    )
    rows = (
        blocks.select(F.col("block").alias("own"), "ids", "lengths", "sequence")
        .groupBy("own")
        .cogroup(coded.groupBy("block"))
        .applyInArrow(
            lambda left, right: _put_in_place(tokens, at_once, left, right),
            f"id {id_type}, n_tokens long, token_ids binary, decoded binary",
        )
    )
    return rows.withColumnRenamed("id", id_col)


def decoded_ids(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, decoded)``: the bytes of ``rows`` (id, codes), by a join with ``tokens``.

    ``tokens`` (code, bytes) has a row for each token of a vocabulary, so it is small.
    Rows are told apart, so ids may repeat or be null. Rows without codes decode to no
    bytes; codes that the table does not have are an error.
    """
    numbered = rows.select("id", "codes", F.monotonically_increasing_id().alias("row"))
    codes = numbered.select("row", "id", F.posexplode_outer("codes").alias("place", "code"))
    known = codes.join(F.broadcast(tokens), "code", "left")
    missing = F.col("code").isNotNull() & F.col("bytes").isNull()
    value = F.when(missing, F.raise_error("a code is not in the vocabulary").cast("binary"))
    known = known.select("row", "id", "place", value.otherwise(F.coalesce("bytes", F.lit(b""))).alias("b"))
    parts = F.array_sort(F.collect_list(F.struct("place", "b")))
    joined = known.groupBy("row", "id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["b"]))
    return joined.select("id", whole.alias("decoded"))
