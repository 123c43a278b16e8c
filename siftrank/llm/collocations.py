"""Phrases that occur together more often than their parts let expect.

The method is prefix-free parsing. A text's words are cut into chunks where the
words themselves say so: behind a word that, with the two before it, hashes to a
trigger. Equal passages are therefore cut alike wherever they stand, and copies
become equal chunks. Chunks overlap in the three words that a phrase of four can
reach back, as far as they are in the same piece of text. What is shuffled are
distinct chunks and how often the parse has them; phrases are counted inside the
distinct chunks, weighted, and each in the chunk that its last word is new in.

Phrases of fewer than ``least`` occurrences are of no use, nor are longer ones that
hold them. Two passes over numbers of phrases find what cannot be frequent, by
filters of bounded size; the last pass counts the words themselves, so neither
filters nor numbers decide a result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.words import mixed, row_slices, run_hashes
from siftrank.session import intermediate_tables, salts_for, written

LONGEST = 4
# A chunk ends, on average, after so many words.
CHUNK_WORDS = 32
# Words that are counted together before their counts are sent.
BLOCK_WORDS = 2_000_000
# Bits of a filter for each of its entries, and of the largest filter.
FILTER_BITS = 16
FILTER_MOST = 1 << 28

_SEPARATOR, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SEPARATOR
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEPS = np.cumprod(np.full(LONGEST + 1, 0x9FB21C651E98DF25, dtype=np.uint64))
_SPACE, _LINE = 0x20, 0x0A


def _slices_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The stretches of ``data``, as one array of texts; they may overlap."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at])
    )


def _with(separator: str, *parts):
    return pc.binary_join_element_wise(*parts, pa.scalar(separator, pa.large_string()))


def _chunks(chunk_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): ``(lang, old, chunk)``, the first ``old`` words of a chunk being
    the overlap. Words are apart by a space, pieces by a line end."""
    for batch in batches:
        lang = batch.column(0)
        for first, text, rows in row_slices(batch.column(1)):
            kind = _KIND[text]
            inside = kind == 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            row_starts = rows[:-1][rows[:-1] < len(text)]
            begins[row_starts] |= inside[row_starts]
            starts = np.flatnonzero(begins)
            n = len(starts)
            if not n:
                continue
            row = np.searchsorted(rows, starts, side="right") - 1
            breaks = np.cumsum(kind == _BREAK)[starts]
            opens = np.ones(n, dtype=bool)  # a piece
            opens[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])

            letters = _LOWER[text[inside]]
            at = np.flatnonzero(begins[inside])
            lengths = np.diff(np.append(at, len(letters)))
            places = at + np.arange(n)
            spaced = np.full(len(letters) + n, _SPACE, dtype=np.uint8)
            spaced[np.arange(len(letters)) + np.repeat(np.arange(n), lengths)] = letters
            spaced[places[1:][opens[1:]] - 1] = _LINE

            words = run_hashes(letters.astype(np.uint64) + np.uint64(1), at)
            window = words * _STEPS[0]
            window[1:] += words[:-1] * _STEPS[1]
            window[2:] += words[:-2] * _STEPS[2]
            ends = mixed(window) % np.uint64(chunk_words) == 0
            fresh = np.diff(row, prepend=-1) > 0
            ends &= np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) >= 2
            ends[np.append(fresh[1:], True)] = True
            last = np.flatnonzero(ends) + 1
            new = np.concatenate([[0], last[:-1]])
            piece = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            old = np.minimum(LONGEST - 1, new - piece[new])
            begin = places[new - old]
            size = places[last - 1] + lengths[last - 1] - begin
            yield pa.RecordBatch.from_arrays(
                [
                    lang.take(pa.array(row[new] + first)),
                    pa.array(old.astype(np.int8)),
                    _slices_of(spaced, begin, size).cast(pa.string()),
                ],
                ["lang", "old", "chunk"],
            )


def parsed(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``(lang, old, chunk, f)``: the distinct chunks of (lang, text) and their frequency."""
    chunks = docs.mapInArrow(
        lambda it: _chunks(chunk_words, it), "lang string, old tinyint, chunk string"
    )
    return chunks.groupBy("lang", "old", "chunk").agg(F.count("*").alias("f"))


class _Block:
    """Chunks with their words as numbers: ``word`` in ``texts``, ``weight``, ``lang``.

    ``reach`` is how many words before it are in the word's piece, ``new`` whether it
    is past the overlap.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        chunk = table["chunk"].combine_chunks().cast(pa.large_string())
        langs = table["lang"].combine_chunks().dictionary_encode()
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)
        offsets = offsets[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = (data != _SPACE) & (data != _LINE)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        at = np.flatnonzero(begins[inside])
        letters = data[inside]
        ends = np.append(at, len(letters)).astype(np.int64)
        strings = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))
        )
        coded = strings.dictionary_encode()
        self.texts = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)

        n = len(starts)
        row = np.searchsorted(offsets, starts, side="right") - 1
        opens = np.ones(n, dtype=bool)
        opens[1:] = (row[1:] != row[:-1]) | (data[starts[1:] - 1] == _LINE)
        at = np.arange(n)
        self.reach = at - np.maximum.accumulate(np.where(opens, at, 0))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        old = table["old"].to_numpy()
        self.new = at - first[row] >= old[row]
        self.weight = table["f"].to_numpy()[row]
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[row]

    def numbers(self) -> np.ndarray:
        """A number for each word, the same in all blocks, and different by language."""

        def hashed(texts: pa.Array) -> np.ndarray:
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8).astype(np.uint64)
            return run_hashes(data + np.uint64(1), offsets[:-1])

        lang = _with(":", self.langs.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        return mixed(hashed(self.texts)[self.word] ^ hashed(lang)[self.lang])


def _gram_numbers(words: np.ndarray, size: int) -> np.ndarray:
    """For the phrase of ``size`` words that ends at each word; the first ones have none."""
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        total[size - 1 :] += words[size - 1 - k : len(words) - k] * _STEPS[k]
    return mixed(total + np.uint64(size))


def _counted(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal codes: where the first is, the sum of weights, and each one's number."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(fresh)
    sums = np.add.reduceat(weights[order], at) if len(at) else weights[:0]
    number = np.empty(len(codes), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[at], sums, number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("chunk").nbytes
        if size >= 6 * BLOCK_WORDS:
            yield _Block(pa.Table.from_batches(held))
            held, size = [], 0
    if held and sum(map(len, held)):
        yield _Block(pa.Table.from_batches(held))


def _filtered(bits: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(numbers), dtype=bool)
    at = numbers % np.uint64(64 * len(bits))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _frequent_numbers(sizes, pairs, batches) -> Iterator[pa.RecordBatch]:
    """``(h, c)``: numbers of phrases and counts; longer ones only if all their pairs pass."""
    for block in _blocks(batches):
        words = block.numbers()
        pair_ok = None if pairs is None else _filtered(pairs.value, _gram_numbers(words, 2))
        for size in sizes:
            use = block.new & (block.reach >= size - 1)
            if pair_ok is not None:
                for k in range(size - 1):
                    use[k:] &= pair_ok[: len(use) - k]
            at = np.flatnonzero(use)
            numbers = _gram_numbers(words, size)[at]
            where, sums, _ = _counted(numbers, block.weight[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[where].view(np.int64)), pa.array(sums)], ["h", "c"]
            )


def _phrases(filters, batches) -> Iterator[pa.RecordBatch]:
    """``(lang, phrase, size, c)`` of what passes the filters; a null phrase is any word."""
    for block in _blocks(batches):
        numbers = block.numbers()
        base = len(block.texts)
        code = block.lang * base + block.word
        passes = np.ones(len(code), dtype=bool)
        for size in range(1, LONGEST + 1):
            if size > 1:
                # the phrase of one word less that ends one word earlier, then this word
                before = np.empty_like(number)
                before[0], before[1:] = 0, number[:-1]
                code = before * base + block.word
                ok = _filtered(filters[0 if size == 2 else 1].value, _gram_numbers(numbers, size))
                passes[1:] = passes[:-1] & passes[1:] if size > 2 else True
                passes &= ok & (block.reach >= size - 1)
            # numbers for all that may go on, counts for what is new here
            at = np.flatnonzero(passes)
            where, _, found = _counted(code[at], block.weight[at])
            number = np.zeros(len(code), dtype=np.int64)
            number[at] = found
            sums = np.zeros(len(where), dtype=np.int64)
            np.add.at(sums, found, np.where(block.new[at], block.weight[at], 0))
            use = np.flatnonzero(sums)
            ends = at[where[use]]
            parts = [block.texts.take(pa.array(block.word[ends - k])) for k in range(size)][::-1]
            phrase = parts[0] if size == 1 else _with(" ", *parts)
            yield _phrase_rows(block.langs.take(pa.array(block.lang[ends])), phrase, size, sums[use])
            if size == 1:
                where, total, _ = _counted(block.lang, np.where(block.new, block.weight, 0))
                langs = block.langs.take(pa.array(block.lang[where]))
                yield _phrase_rows(langs, pa.nulls(len(where), pa.string()), 0, total)


def _phrase_rows(lang, phrase, size, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            lang.cast(pa.string()),
            phrase.cast(pa.string()),
            pa.array(np.full(len(counts), size, dtype=np.int8)),
            pa.array(counts),
        ],
        ["lang", "phrase", "size", "c"],
    )


def _filter_of(numbers: DataFrame, at_most: int):
    """The numbers ``h`` as a broadcast bit per remainder, at most ``at_most`` bits.

    Where the numbers are too many for it, more pass that need not; none is lost.
    """
    spark = numbers.sparkSession
    stored = written(numbers, "frequent")
    bits = 1 << max(10, (FILTER_BITS * stored.count()).bit_length())
    bits = min(bits, at_most)
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = (
        stored.groupBy(F.shiftright(at, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int((h & {bits - 1}L) & 63))")).alias("bits"))
        .toPandas()
    )
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(
        np.uint64
    )
    return spark.sparkContext.broadcast(filled)


def frequent_phrases(chunks: DataFrame, least: int, filter_bits: int = FILTER_MOST) -> DataFrame:
    """``(lang, phrase, size, c)`` of phrases of up to four words with ``c >= least``,
    and of each language's words together, whose phrase is null."""

    def frequent(sizes, pairs):
        counts = chunks.mapInArrow(lambda it: _frequent_numbers(sizes, pairs, it), "h long, c long")
        numbers = counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        return _filter_of(numbers.select("h"), filter_bits)

    pairs = frequent([2], None)
    filters = [pairs, frequent([3, 4], pairs)]
    counts = chunks.mapInArrow(
        lambda it: _phrases(filters, it), "lang string, phrase string, size tinyint, c long"
    )
    found = counts.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("c"))
    return found.where(F.col("phrase").isNull() | (F.col("c") >= least))


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of phrases of two words and more.

    A phrase's parts are frequent as well, so they are all there.
    """
    words = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.col("size").cast("int") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(words, 1, k), " ").alias("head"),
            F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("rest"),
        ),
    )
    cuts = phrases.where("size > 1").select(
        "lang", "phrase", F.col("c").alias("a"), F.inline(cut)
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    scored = both.withColumn(
        "score",
        F.expr(
            "(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)))"
            " div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
        ),
    )
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def _covered(phrases: DataFrame, percent: int) -> DataFrame:
    """``(lang, phrase, longer)``: the most frequent longer phrase around each phrase."""
    words = F.split("phrase", " ")
    size = F.col("size").cast("int")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1),
                lambda i: F.array_join(F.slice(words, i, n), " "),
            ),
        )
    )
    parts = phrases.where("size > 2").select("lang", "c", F.explode(inner).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))


def collocations(
    docs: DataFrame,
    least: int = 30,
    top: int = 2000,
    covered_percent: int = 80,
    chunk_words: int = CHUNK_WORDS,
    filter_bits: int = FILTER_MOST,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    A-Z is lower-cased, texts are split into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. A phrase is two to four words of a piece
    with ``a >= least`` occurrences, overlaps included. A cut into two parts of
    ``l`` and ``r`` occurrences scores ``floor(2000000 a / (l + r))``, and its
    lowest cut counts, the leftmost of equals. Phrases inside a longer one with
    ``covered_percent`` of their occurrences or more are left out. ``n`` counts all
    words. Of equal scores the more frequent comes first, then the smaller phrase.

    A null text is empty, a null language ``und``. Empty texts, and languages without
    frequent phrases, give nothing; repeated rows count as often as they stand there.
    Other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    with intermediate_tables(spark):
        chunks = written(parsed(texts, chunk_words), "chunks")
        found = frequent_phrases(chunks, least, filter_bits)
        phrases = written(found, "phrases", outlives=True)
    counts = phrases.where("phrase IS NULL").select("lang", F.col("c").alias("n"))
    phrases = phrases.where("phrase IS NOT NULL")
    kept = (
        _scored(phrases)
        .join(_covered(phrases, covered_percent), ["lang", "phrase"], "left")
        .where(
            F.col("longer").isNull()
            | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * covered_percent)
        )
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may have most phrases: ranked in parts first
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts_for(spark)))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = kept.withColumn("part", part).withColumn("rank", in_part).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (
        ranked.where(F.col("rank") <= top)
        .join(counts, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
