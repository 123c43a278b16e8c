"""Toxicity and languages: what is learned shows on texts that were held out."""

import math
import random

from samples import TEXTS

from siftrank.llm.languages import (
    _STEPS,
    DIMENSIONS,
    identified_languages,
    learned_languages,
)
from siftrank.llm.toxicity import (
    Lexicon,
    _letters,
    folded,
    found_hits,
    labelled_sample,
    learned_lexicon,
    toxicity_score,
    toxicity_scores,
)

SYLLABLES = {
    "en": "the ing er on th an re at en nd ed",
    "de": "sch ung ich ein ge ver keit ü der en ß",
    "fr": "eau oi é que les ment è aux ou re",
    "es": "ción que os ado mente ñ la el ar ó",
}


def sentence(r, language, n):
    parts = SYLLABLES[language].split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_folding():
    table = _letters()
    assert folded("ＩＤIОT, 1d10t!", table) == folded("idiot idiot", table)
    assert folded("$tupid s7up1d pay 5$ now", table).split()[:2] == folded("stupid stupid", table).split()
    assert folded("", table).split() == []


def test_exceptions_void_hits():
    table = _letters()
    lexicon = Lexicon({" idiot ": 3.0, " scum": 2.0, " scumm": 2.5}, {" pond scum "})
    automaton = lexicon.automaton()
    hits = lambda text: sorted(found_hits(folded(text, table), automaton).values())
    assert hits("An idiot, scummy") == [2.5, 3.0]
    assert hits("pond scum") == [] and hits("idiotic ponds") == [] and hits("scum pond scum") == [2.0]


def test_toxicity_is_learned(spark, odd, nothing):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(500):
        words = sentence(r, "en", r.randint(20, 90)).split()
        toxic = k % 4 == 0
        for _ in range(5 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["blarghy", "zonkest", "Zonking", "z0nk", "bl@rgh"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = learned_lexicon(labelled_sample(docs, table.where("doc_id < 300"), 10_000))
    scores = toxicity_scores(docs.where("doc_id >= 300"), lexicon).collect()
    assert len(scores) == 200
    assert sum((s.score >= 0.5) == (s.doc_id % 4 == 0) for s in scores) >= 196
    by_function = docs.select("doc_id", toxicity_score(lexicon)("text").alias("score")).collect()
    assert {s.doc_id: s.score for s in scores} == {
        s.doc_id: s.score for s in by_function if s.doc_id >= 300
    }
    assert toxicity_scores(odd, lexicon).count() == len(TEXTS)
    assert toxicity_scores(nothing, lexicon).collect() == []
    # nothing to learn from: the plain lexicon
    plain = learned_lexicon(labelled_sample(docs, table.where("toxic = 0"), 100))
    judged = spark.createDataFrame([(1, "you 1di0t moron"), (2, "good day"), (3, None)], "doc_id int, text string")
    found = {s.doc_id: s.score >= 0.5 for s in toxicity_scores(judged, plain).collect()}
    assert found == {1: True, 2: False, 3: False}


def test_languages(spark, odd, nothing):
    r = random.Random(2)
    rows = [(k, sentence(r, lang, r.randint(3, 60)), lang) for k in range(150) for lang in SYLLABLES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learned_languages(docs.where("doc_id < 75"))
    found = identified_languages(docs.where("doc_id >= 75"), model).collect()
    assert len(found) == 300 and all(0 <= f.score <= 1 for f in found)
    right = docs.where("doc_id >= 75").join(
        identified_languages(docs.where("doc_id >= 75").selectExpr("struct(doc_id, lang) AS doc_id", "text"), model)
        .selectExpr("doc_id.doc_id AS doc_id", "doc_id.lang AS lang", "lang_pred"),
        ["doc_id", "lang"],
    )
    assert right.where("lang = lang_pred").count() >= 291
    odd_rows = {f.doc_id: f.lang_pred for f in identified_languages(odd, model).collect()}
    assert {odd_rows[k] for k in (2, 3, 4)} == {"und"} and odd_rows[1] != "und"
    assert identified_languages(nothing, model).collect() == []
    assert {f.lang_pred for f in identified_languages(odd, learned_languages(nothing.selectExpr("text", "'x' AS lang"))).collect()} == {"und"}
    one = learned_languages(docs.where("lang = 'de'"))
    assert {f.lang_pred for f in identified_languages(docs.limit(9), one).collect()} == {"de"}


def test_languages_are_learned_from_distinct_texts(spark, monkeypatch):
    """Copies count once, however many, and no language is left out."""
    given = []

    class Kept:
        def __init__(self, x, names):
            given.append((len(x), sorted(names)))

    monkeypatch.setattr("siftrank.llm.languages.Languages", Kept)
    rows = [("the same text again", "en")] * 3000 + [(f"text {k * 'x'} of", "en") for k in range(40)]
    rows += [("de zin", "nl")] * 50
    learned_languages(spark.createDataFrame(rows, "text string, lang string"), most_rows=20)
    many = [(f"text {chr(97 + k % 26)}", f"l{k}") for k in range(230)]
    learned_languages(spark.createDataFrame(many, "text string, lang string"))
    assert given == [(11, ["en"] * 10 + ["nl"]), (230, sorted(name for _, name in many))]


def test_scores_against_a_plain_search_of_all_entries(spark):
    """Random lexicons and texts: every entry looked for at every place, one by one."""
    r = random.Random(9)
    table = _letters()
    for _ in range(30):
        words = ["".join(r.choices("abé3о", k=r.randint(1, 5))) for _ in range(12)]
        plain = [folded(w, table).strip() for w in words]
        weights = {f" {w} ": r.uniform(0.5, 4) for w in r.sample(plain, 5) if w}
        weights |= {f" {w[:2]}": r.uniform(0.5, 4) for w in r.sample(plain, 4) if len(w) > 1}
        exceptions = {f" {r.choice(plain)} {r.choice(plain)} " for _ in range(4)}
        lexicon = Lexicon(weights, {e for e in exceptions if e.split()}, -1.5, 0.7, 0.4)
        texts = [" ".join(r.choices(words + [".", "!", "A"], k=r.randint(0, 25))) for _ in range(40)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for row in toxicity_scores(docs, lexicon).collect():
            text = folded(texts[row.doc_id], table)
            best = {}
            for entry, weight in lexicon.weights.items():
                for at in range(len(text)):
                    if text.startswith(entry, at):
                        best[at] = max(best.get(at, 0.0), weight)
            for phrase in lexicon.exceptions:
                for at in range(len(text)):
                    if text.startswith(phrase, at):
                        best = {k: w for k, w in best.items() if not at <= k < at + len(phrase) - 1}
            n, total = len(text.split()), math.fsum(best.values())
            assert (row.n_words, row.n_hits) == (n, len(best)), text
            x = -1.5 + 0.7 * math.log1p(total) + 0.4 * math.log1p(100 * total / (n + 20))
            assert abs(row.score - 1 / (1 + math.exp(-x))) < 1e-12


def plain_language(model, text):
    """All sequences counted in a loop, all machines asked one by one."""
    codes, last = [0], 0
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or last:
            codes.append(code)
        last = code
    if last:
        codes.append(0)
    counts = [0] * DIMENSIONS
    for size in (1, 2, 3):
        for i in range(len(codes) - size + 1):
            total = 0
            for n in range(size):
                total = (total + codes[i + n]) * _STEPS[n] % 2**32
                total ^= total >> 15
            counts[total >> 20] += 1
    norm = math.sqrt(sum(counts))
    margins = [sum(w * math.sqrt(c) / norm for w, c in zip(m, counts) if c) + m[-1] for m in model.weights.tolist()]
    family = max(range(len(model.families)), key=lambda k: margins[k])
    members = model.members[model.families[family]]
    votes, belief = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for group, left, right, k in model.duels:
        if group == model.families[family]:
            votes[left if margins[k] > 0 else right] += 1
            belief[left] += 1 / (1 + math.exp(-4 * margins[k]))
            belief[right] += 1 - 1 / (1 + math.exp(-4 * margins[k]))
    score = 1 / (1 + math.exp(-4 * margins[family]))
    if len(members) == 1:
        return members[0], score
    winner = max(members, key=lambda m: (votes[m], belief[m], m))
    return winner, score * belief[winner] / (len(members) - 1)


def test_languages_against_machines_asked_one_by_one(spark):
    r = random.Random(7)
    rows = [(k, sentence(r, lang, r.randint(3, 40)), lang) for k in range(60) for lang in SYLLABLES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learned_languages(docs)
    texts = [sentence(r, r.choice(list(SYLLABLES)), r.randint(1, 12)) for _ in range(40)]
    texts += ["a", " é!! Ñ ?", "x1y2", "ABC. def", "你好 ok"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in identified_languages(asked, model).collect():
        name, score = plain_language(model, texts[row.doc_id])
        assert row.lang_pred == name, texts[row.doc_id]
        assert abs(row.score - score) < 1e-3
