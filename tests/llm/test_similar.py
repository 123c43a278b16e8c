"""n-gram Jaccard join against all pairs, compared one by one."""

import random
import re
from itertools import combinations

import pytest

from siftrank.llm import similar
from siftrank.llm.similar import _open_lists, _other_pairs, components, similar_components


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(
        ((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)),
        key=repr,
    )


def varied(seed):
    """Families of near copies around the limit, a passage in many texts, short texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = r.choices(words, k=30)
    rows = []
    for _ in range(4):
        base = r.choices(words, k=r.choice([6, 40, 80]))
        for _ in range(25):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append(own)
    rows += [r.choices(words, k=30) + passage for _ in range(25)]
    rows += [r.choices(words[:4], k=r.randint(0, 5)) for _ in range(20)]
    r.shuffle(rows)
    return [(k, " ".join(w).title() if k % 3 else " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "short"), [(4, 85, 16), (5, 80, 2)])
def test_equals_all_pairs(spark, monkeypatch, n, percent, short):
    monkeypatch.setattr(similar, "SHORT_LIST", short)
    rows = varied(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_components(docs, n, percent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, n, percent)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = similar_components(odd, 4, 85)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 4, 85)
    assert similar_components(nothing).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 9)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(k, 1) for k in range(1, 41)} | {
        (k, 100) for k in range(100, 140)
    }


def test_pairs_of_families_that_take_turns_as_the_largest(spark):
    """Two sets of 200 share 15 of the 31 lists of their prefixes, as 85 % need: in some one's
    family is the largest, in some the other's, and in some a third."""
    families = {1: range(1000, 1040), 2: range(2000, 2040), 3: range(3000, 3040)}
    rows = []
    for t in range(15):
        most = 1 + t % 3
        for family, sets in families.items():
            members = sets if family == most else sets[:1]
            rows += [(t, 5, s, 200, 200 - t, family) for s in members]
    for t in range(15, 30):
        rows += [(t, 5, s, 200, 200 - t, f) for f in (1, 2) for s in families[f][5:]]
    lists = spark.createDataFrame(rows, "t long, block int, set long, n int, rest int, root long")
    found = {tuple(r) for r in _other_pairs(_open_lists(lists), 85).collect()}
    assert {(1000, 2000), (1000, 3000), (2000, 3000)} <= found
    # 15 lists are shared, by those that meet in all of them, and one less is too few
    assert all((a < 2000) != (b < 2000) or (a, b) == (2000, 3000) for a, b in found)
    fewer = {tuple(r) for r in _other_pairs(_open_lists(lists.where("t < 14")), 85).collect()}
    assert fewer == set()
