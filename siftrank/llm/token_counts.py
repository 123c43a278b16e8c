"""Token counts by heap-and-linked-list merging; no token id is ever made."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.bpe import PIECES, distinct_pieces, merged, read_merges, read_special_tokens

# Pieces whose counts a task remembers; beyond that it starts over.
REMEMBERED = 400_000


class _Counts(dict):
    """The number of tokens of each piece, worked out when first asked for."""

    def __init__(self, merges: dict, pattern):
        self.rank, self.pattern = lambda a, b: merges.get((a, b)), pattern
        self.words: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.words.clear()
        total = 0
        for word in self.pattern.findall(piece):
            n = self.words.get(word)
            if n is None:
                n = self.words[word] = len(merged(word.encode(), self.rank))
            total += n
        self[piece] = total
        return total


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, a row per row of ``docs``.

    Counts by the merges of a .json vocabulary file, which the driver reads, and its
    pre-token ``pattern``. Strings of its special tokens count as one token each.
    Null and empty texts have no tokens. Rows are counted one by one, so repeated
    ones and null ids do not matter; other columns are ignored; an empty table gives
    an empty result.
    """
    special = [s for s in read_special_tokens(vocabulary) if s]
    cut = regex.compile("|".join(map(regex.escape, special))).pattern if special else None
    sent = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def counted(batches):
        merges = {pair: k for k, pair in enumerate(sent.value)}
        counts = _Counts(merges, regex.compile(pattern))
        special_tokens = regex.compile(cut) if cut else None
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            for first, pieces, which, rows in distinct_pieces(texts):
                of_piece = np.array([counts[p] for p in pieces], dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(of_piece[which])])[rows]
                n_tokens[first : first + len(rows) - 1] = np.diff(total)
            if special_tokens:
                for row in np.flatnonzero(pc.match_substring_regex(texts, cut)):
                    parts = special_tokens.split(texts[row].as_py())
                    n_tokens[row] = len(parts) - 1 + sum(
                        counts[piece] for part in parts for piece in PIECES.findall(part)
                    )
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"]
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(counted, f"id {id_type}, n_bytes long, n_tokens long")
    return rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
