"""Collocations against plain counting, and the parse by itself."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftrank.llm.collocations import _scored, collocations, parsed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top=2000, percent=80):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            words[lang] += len(piece)
            for size in range(1, 5):
                for i in range(len(piece) - size + 1):
                    counts[lang][tuple(piece[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = any(
                100 * f[longer] >= percent * a
                for longer in f
                if len(phrase) < len(longer) and f[longer] >= least
                and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
            )
            if not inside:
                cuts = [(f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase))]
                score, k = min((2000000 * a // (l + r), k) for k, (l, r) in enumerate(cuts))
                found.append((-score, -a, " ".join(phrase).encode(), *cuts[k]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def found(docs, **options):
    return sorted(map(tuple, collocations(docs, **options).collect()))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "OLD", "ñu", "tea", "a-b", "x" * 30, "é", "Zed", "w9"]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ? ! "])
        if rng.random() < 0.3:
            text += passage
        rows.append((rng.choice(["en", "en", "en", "fr", "", None]), rng.choice([text, text, text, None])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_counting(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for options in (
        {"least": 4},
        {"least": 2, "chunk_words": 3, "top": 25},
        # filters that let nearly everything through change nothing
        {"least": 3, "chunk_words": 1, "filter_bits": 64},
    ):
        want = {k: options[k] for k in ("least", "top") if k in options}
        assert found(docs, **options) == brute(rows, **want)


def test_shares_of_the_words_around(spark):
    """A phrase goes if a longer one, kept or not, has four fifths of it."""
    rows = [("x", "a b c")] * 8 + [("x", "a b")] * 2 + [("x", "b c")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=2) == brute(rows, 2)
    assert {r[2] for r in found(docs, least=2)} == {"a b c", "b c"}


def test_copies_become_equal_chunks(spark):
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    docs = [("en", passage)] * 300 + [("en", f"own{i} " + passage) for i in range(20)]
    chunks = parsed(spark.createDataFrame(docs, "lang string, text string")).collect()
    # the cuts of a passage are found again behind other words
    assert len(chunks) < 20 + 40
    assert max(c.f for c in chunks) == 320
    words = sum(c.f * (len(c.chunk.split()) - c.old) for c in chunks)
    assert words == 320 * 400 + 20


def test_products_beyond_64_bits(spark):
    huge = 6 * 10**18
    rows = [("x", "a b", 2, huge), ("x", "a", 1, huge), ("x", "b", 1, huge + 1)]
    (row,) = _scored(spark.createDataFrame(rows, "lang string, phrase string, size int, c long")).collect()
    assert (row.score, row.l) == (2000000 * huge // (2 * huge + 1), huge)


def test_odd_rows(spark, odd, nothing):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(docs, least=2) == brute(rows, 2)
    clashing = docs.withColumns({c: F.lit("z") for c in ("chunk", "f", "old", "phrase", "c", "rank", "n")})
    assert found(clashing, least=2) == brute(rows, 2)
    assert found(nothing.withColumn("lang", F.lit("en"))) == []
    assert found(docs.where("text IS NULL OR text = ''")) == []
