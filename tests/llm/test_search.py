"""Ranked search against a loop over all documents, and the graphs by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.llm.search import ranked_documents, shared_pairs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    texts = [(i, terms(t)) for i, t in docs]
    texts = [(i, t, Counter(t)) for i, t in texts if t]
    n_docs, total = len(texts), sum(len(t) for _, t, _ in texts)
    df = Counter(term for _, _, tf in texts for term in tf)
    out = []
    for item, text in items:
        scores = []
        for doc_id, t, tf in texts:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            score = 0
            for term in set(terms(text)):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted(map(tuple, ranked_documents(docs, items, **options).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)] + ["É", "ñu", "A1", "z-z", "你好"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)] + [(5, None), (6, ""), (7, "...")]
    shared = [rng.choices(words, k=6) for _ in range(4)]
    items = []
    for i in range(40):
        text = rng.choices(words, k=rng.randrange(8)) + rng.choice(shared) + rng.choice(shared)
        items.append((i, ", ".join(text)))
    return docs, items + [(40, items[3][1]), (41, None), (42, "..."), (3, "unseen"), (None, items[5][1])]


@pytest.mark.parametrize("seed", range(2))
def test_against_a_loop_over_all_documents(spark, seed):
    docs, items = corpus(seed)
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert found(texts, asked, k=10) == brute(docs, items, 10)
    # several graphs in a pass, and several passes
    assert found(texts, asked, k=3, block_positions=40) == brute(docs, items, 3)
    many = found(texts, asked, k=10, pass_positions=200, block_positions=60)
    assert many == brute(docs, items, 10)


def test_ids_of_other_types(spark):
    docs, items = corpus(5)
    docs = [(f"d{i}", t) for i, t in docs if t] + [(None, "w1 w2 w3")]
    texts = spark.createDataFrame(docs, "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in items[:9]], "item_id string, text string")
    assert found(texts, asked, k=4) == brute(docs, [(f"q{i}", t) for i, t in items[:9]], 4)


def expanded(part, pairs, n_terms):
    if part < n_terms:
        return [int(part)]
    return [t for side in pairs[part - n_terms] for t in expanded(side, pairs, n_terms)]


def test_graphs_hold_the_sets_and_share_their_pairs():
    rng = random.Random(2)
    core = [rng.sample(range(50), 8) for _ in range(5)]
    sets = [np.array(sorted({*rng.choice(core), *rng.choice(core), *rng.sample(range(50), 3)})) for _ in range(80)]
    pairs, left = shared_pairs(sets, 50)
    for before, after in zip(sets, left, strict=True):
        assert sorted(t for part in after for t in expanded(part, pairs, 50)) == before.tolist()
    uses = Counter(int(p) for p in [*pairs.flatten(), *np.concatenate(left)] if p >= 50)
    assert len(pairs) and all(uses[50 + k] >= 1 for k in range(len(pairs)))
    assert all(max(p) < 50 + k for k, p in enumerate(pairs.tolist()))
    additions = 2 * len(pairs) + sum(map(len, left))
    assert additions < 0.6 * sum(map(len, sets))


def test_graphs_of_little():
    assert [len(x) for x in shared_pairs([], 3)[0]] == []
    pairs, left = shared_pairs([np.array([2])], 3)
    assert not len(pairs) and left[0].tolist() == [2]


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "the OLD bridge over word"), (2, None), (3, ""), (1, "word one two"), (4, "你好 x null")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    asked = asked.withColumns({c: F.lit("z") for c in ("set", "terms", "block", "rank", "score", "item")})
    assert found(odd, asked) == brute(rows, items, 10)
    clashing = odd.withColumns({c: F.lit("z") for c in ("item_id", "rank", "m", "terms", "counts")})
    assert found(clashing, asked) == brute(rows, items, 10)
    assert found(nothing, asked) == []
    assert found(odd, asked.where("false")) == []
    assert found(odd.where("text IS NULL"), asked) == []
