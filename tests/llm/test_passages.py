"""Passages found by spaced seeds, against comparing every window."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from samples import collected

from siftrank.llm.decontaminate import (
    _Items,
    _with_a_seed,
    benchmark_overlaps,
    best_stretch,
    least_weight,
    substituted,
)
from siftrank.llm.queries import op10_benchmark_overlaps
from siftrank.llm.words import hashed_words


def brute_stretch(same, share):
    best = 0
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if same[a] and same[b - 1] and sum(same[a:b]) >= share * (b - a) - 1e-9:
                best = max(best, b - a)
    return best


def test_best_stretch():
    r = random.Random(4)
    for _ in range(300):
        same = np.array([r.random() < 0.6 for _ in range(r.randint(1, 25))])
        begin, end = best_stretch(same, 0.8)
        assert end - begin == brute_stretch(same, 0.8), same


def test_planted_passages(spark):
    r = random.Random(1)
    word = lambda: f"v{r.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (36, 20, 14, 8, 5, 4)]
    docs, want = [], set()
    for k in range(120):
        text = [word() for _ in range(r.randint(0, 80))]
        at = r.randrange(len(text) + 1)
        item = k % 8
        if item < 5:
            own = list(items[item])
            if len(own) >= 20:
                # one word in ten is another
                for place in range(5, len(own), 10):
                    own[place] = word()
            text[at:at] = own
            want.add((k, item))
        elif item == 5:
            text[at:at] = items[0][:9]
        docs.append((k, " ".join(text).upper() if k % 2 else " ".join(text)))
    found = benchmark_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    ).collect()
    assert {(f.doc_id, f.item_id) for f in found} == want
    texts = dict(docs)
    for f in found:
        words = texts[f.doc_id].lower().split()[f.start_word : f.end_word]
        assert 0.8 * len(words) <= f.n_equal <= len(words)


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame(
        [(k, f"start {k} " + " ".join(f"t{k}x{j}" for j in range(20))) for k in range(30)],
        "doc_id long, text string",
    )
    items = docs.withColumnRenamed("doc_id", "item_id")
    whole = benchmark_overlaps(docs, items)
    assert whole.count() == 30
    assert collected(benchmark_overlaps(docs, items, block_items=7)) == collected(whole)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "brown fox jumps over the lazy dog near"), (2, None), (3, ""), (4, "one two"), (1, "brown fox jumps over the lazy dog near")],
        "item_id long, text string",
    )
    found = collected(benchmark_overlaps(odd, items))
    assert found == [(1, 1, 2, 10, 8)] * 2 + [(7, 1, 2, 10, 8)] * 2
    assert benchmark_overlaps(nothing, items).collect() == []
    assert benchmark_overlaps(odd, items.where("false")).collect() == []


def test_no_allowed_substitution_is_missed():
    """All placements of substituted words between an equal first and last word."""
    for n in range(1, 21):
        item = " ".join(f"i{k}" for k in range(n))
        table = _Items([1], [item], 13, 0.8)
        for e in range(substituted(n, 0.8) + 1):
            texts = []
            for places in combinations(range(1, n - 1), e):
                texts.append(" ".join(f"x{k}" if k in places else f"i{k}" for k in range(n)))
            for _, words, at in hashed_words(pa.array(texts, type=pa.string())):
                found = {tuple(f) for f in table.diagonals(words, at).tolist()}
                assert found >= {(row, 0, int(at[row])) for row in range(len(at) - 1)}, (n, e)


def test_longer_stretches_have_a_seed_in_any_runs():
    """The least largest group of neighbouring runs, by trying all of their lengths."""

    def avoidable(left, runs, before, weight):
        # runs of equal words with less than ``weight`` in any two neighbours
        if runs == 0:
            return left == 0
        most = min(left, weight - 1 - before)
        return any(avoidable(left - k, runs - 1, k, weight) for k in range(most + 1))

    for n in range(13, 41):
        e = substituted(n, 0.8)
        assert not any(avoidable(n - k, k + 1, 0, least_weight(40, 13, 0.8)) for k in range(e + 1))


def test_substituted_passages(spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in (15, 12, 10)]
    changed = [(3, 7, 11), (5, 6), (3, 5)]
    docs = []
    for k, (item, places) in enumerate(zip(items, changed, strict=True)):
        own = [f"x{j}" if j in places else w for j, w in enumerate(item)]
        docs.append((k, " ".join(["before", *own, "after"])))
    found = benchmark_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    )
    want = [(k, k, 1, 1 + len(w), len(w) - len(changed[k])) for k, w in enumerate(items)]
    assert collected(found) == sorted(want)


def test_items_of_few_words_in_the_query(spark, tmp_path):
    items = [(1, "i4w0 i4w1 i4w2 i4w3"), (2, "i2w0 I2W1"), (3, "single"), (4, ""), (5, None)]
    docs = [
        (1, "before i4w0 i4w1 i4w2 i4w3 after"),
        (2, "i2w0 i2w1"),
        (3, "a single word"),
        (4, "i4w0 i4w1 i4w2 other i2w0 and i2w1 singles"),
        # the end of one text and the beginning of the next are no item
        (5, "ends with i2w0"),
        (6, "i2w1 begins"),
        (7, ""),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = collected(op10_benchmark_overlaps(spark, str(tmp_path)))
    assert found == [(1, 1, 1, 5, 4), (2, 2, 0, 2, 2), (3, 3, 1, 2, 1)]


def test_items_with_ids_of_any_type_in_many_blocks(spark):
    """The same rows for one block and for fifty, for texts as ids and repeated items."""
    r = random.Random(12)
    words = [f"v{k}" for k in range(200)]
    items = [(f"item {k % 45}", " ".join(r.choices(words, k=r.randrange(3, 40)))) for k in range(60)]
    items += [("same", items[0][1])] * 30 + [(None, items[1][1]), ("null", None)]
    docs = [(k, " ".join(r.choices(words, k=20) + items[k % 60][1].split() + r.choices(words, k=9))) for k in range(80)]
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string").repartition(4)
    one = benchmark_overlaps(texts, asked, shortest_item=1)
    many = benchmark_overlaps(texts, asked, shortest_item=1, block_items=2)
    small = benchmark_overlaps(texts, asked, shortest_item=1, block_chars=300)
    assert dict(one.dtypes)["item_id"] == "string"
    # documents without any seed are not looked at again
    plain = [(100 + k, " ".join(f"other{k}x{j}" for j in range(30))) for k in range(50)]
    more = texts.unionByName(spark.createDataFrame(plain, "doc_id long, text string"))
    few = _with_a_seed(more.withColumnRenamed("doc_id", "id"), asked, 13, 0.8, 1)
    assert 80 <= few.count() < 90
    rows = sorted(map(str, one.collect()))
    assert len(rows) > 80 and any("same" in x for x in rows)
    assert sorted(map(str, many.collect())) == rows == sorted(map(str, small.collect()))
