"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first (look-alike letters, digits that stand for letters), so the
lexicon and what it is matched against have the same spelling. Entries are whole
words and word beginnings with weights learned from labelled texts; exception
phrases are word pairs that only harmless texts have, and void the hits in them.
The weights of a text's hits, normalised by its length, give the score.
"""

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import in_share
from siftrank.llm.words import hashed_words, row_shingles
from siftrank.session import written

# Letters of other scripts that look like a Latin one, digits and signs
# that stand for letters. One, l and i are the same.
LOOK_ALIKES = {
    "a": "аαɑ",
    "b": "вβ",
    "c": "сϲ",
    "d": "ԁ",
    "e": "еεє",
    "g": "ɡ",
    "h": "һн",
    "i": "іιıl1",
    "j": "ј",
    "k": "кκ",
    "m": "м",
    "n": "пη",
    "o": "оοσ0",
    "p": "рρ",
    "s": "ѕ5",
    "t": "тτ7",
    "u": "υ",
    "v": "ѵν",
    "w": "ԝω",
    "x": "хχ",
    "y": "уγ",
}
DIGITS = {"3": "e", "4": "a", "8": "b", "@": "a", "$": "s"}
STEM_LENGTHS = (3, 4, 5, 6, 7)

# A small lexicon for the case that there is nothing to learn from.
PLAIN_LEXICON = (
    "clown",
    "disgusting",
    "idiot",
    "loser",
    "moron",
    "pathetic",
    "scum",
    "stupid",
    "trash",
    "worthless",
)


class _Letters(dict):
    """What a character becomes: a letter, itself, or a space if it is in no word."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        plain = plain if len(plain) == 1 else chr(code)
        plain = self.known.get(plain, plain)
        self[code] = out = plain if plain.isalnum() else " "
        return out


def _letters() -> _Letters:
    table = _Letters()
    table.known = {x: letter for letter, looks in LOOK_ALIKES.items() for x in looks} | DIGITS
    return table


def folded(text: str, table: _Letters) -> str:
    """Lower case words, look-alikes folded, with one space before and after each."""
    if "$" in text:
        # only inside of words: after them it is a sign
        text = "".join(
            " " if c == "$" and not text[k + 1 : k + 2].isalpha() else c for k, c in enumerate(text)
        )
    words = " ".join(text.lower().translate(table).split())
    return f" {words} " if words else " "


@dataclass
class Lexicon:
    """Entries ``" word "`` or ``" stem"`` with weights, exception phrases, and how the
    score depends on the weights found."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -3.0
    of_total: float = 1.0
    of_density: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, total: float, n_words: int) -> float:
        x = self.bias + self.of_total * math.log1p(total)
        x += self.of_density * math.log1p(100 * total / (n_words + 20))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def found_hits(text: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """The heaviest entry at each word, by where the word begins in the folded text."""
    hits: dict[int, float] = {}
    void = []
    if not len(automaton):
        return hits
    for end, (length, weight) in automaton.iter(text):
        at = end - length + 2
        if weight is None:
            void.append((at, end))
        elif weight > hits.get(at, 0.0):
            hits[at] = weight
    for begin, end in void:
        for at in [at for at in hits if begin <= at < end]:
            del hits[at]
    return hits


def _entries(text: str, table: _Letters) -> set[str]:
    words = set(folded(text, table).split())
    stems = {f" {w[:k]}" for w in words for k in STEM_LENGTHS if len(w) >= k}
    return stems | {f" {w} " for w in words}


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number that near copies mostly share: the least of a text's shingles."""
    for batch in batches:
        keys = []
        for _, words, at in hashed_words(batch.column(0)):
            for k in range(len(at) - 1):
                shingles = row_shingles(words[at[k] : at[k + 1]], 5)
                keys.append(int(shingles[:1].view(np.int64)[0]) if len(shingles) else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *batch.columns], ["family", "text", "toxic"]
        )


def _counted(rows_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of what ``rows_of`` finds in toxic and in other texts."""
    table = _letters()
    counts = (Counter(), Counter())

    def emitted():
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([counts[1][x] for x in names], pa.int64()),
                pa.array([counts[0][x] for x in names], pa.int64()),
            ],
            ["entry", "toxic", "other"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            counts[toxic.as_py()].update(rows_of(text.as_py() or "", table))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield emitted()
                for c in counts:
                    c.clear()
    yield emitted()


def _counts(sample: DataFrame, rows_of) -> DataFrame:
    parts = sample.select("text", "toxic").mapInArrow(
        lambda it: _counted(rows_of, it), "entry string, toxic long, other long"
    )
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(family, text, toxic)``: at most about ``rows`` labelled texts, half of them
    toxic if there are enough, chosen by a hash of their ids; one of near copies."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    few = F.lit(False)
    for toxic, n in sizes.items():
        few = few | ((F.col("toxic") == toxic) & in_share(F.col("doc_id"), rows / 2 / n))
    chosen = labels.where(few)
    # about ``rows`` ids at most
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    families = texts.mapInArrow(_family, "family long, text string, toxic int")
    return written(families.dropDuplicates(["family", "toxic"]), "labelled")


def learned_lexicon(
    sample: DataFrame, most_entries: int = 2000, least_texts: int = 4, least_weight: float = 1.5
) -> Lexicon:
    """Weights from seven tenths of the sample, the score's form from the rest.

    The weight of an entry is how much likelier a toxic text has it than another one,
    as a logarithm, of the numbers of texts less one standard deviation.
    """
    learning = sample.where(F.pmod("family", F.lit(10)) < 7)
    totals = learning.agg(
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")
    ).first()
    a, b = totals.toxic, totals.n - totals.toxic
    if not a or not b:
        return Lexicon({f" {''.join(map(_fold_letter, w))}": 3.0 for w in PLAIN_LEXICON})
    least = max(least_texts, 0.003 * a)
    careful = F.col("toxic") - F.sqrt("toxic") + 0.5
    weight = F.log(careful / (a + 1)) - F.log((F.col("other") + F.sqrt("other") + 0.5) / (b + 1))
    best = (
        _counts(learning, _entries)
        .where(F.col("toxic") >= least)
        .select("entry", "toxic", weight.alias("weight"))
        .where(F.col("weight") >= least_weight)
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "entry")
        .limit(most_entries)
        .collect()
    )
    weights = {r.entry: r.weight for r in best}
    for entry in sorted(weights, key=len, reverse=True):
        # a beginning that says as much makes longer ones needless
        word = entry.rstrip()
        stems = [word[:k] for k in range(4, len(word) + (entry != word))]
        if any(weights.get(s, 0.0) >= weights[entry] - 0.1 for s in stems if s != entry):
            del weights[entry]
    lexicon = Lexicon(weights)
    lexicon.exceptions = _learned_exceptions(learning, lexicon)
    _calibrate(lexicon, sample.where(F.pmod("family", F.lit(10)) >= 7))
    return lexicon


def _fold_letter(letter: str) -> str:
    return {"l": "i"}.get(letter, letter)


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> set[str]:
    """Word pairs around a hit that several harmless texts have and no toxic one."""

    def pairs(text: str, table: _Letters, cache: dict = {}) -> set[str]:  # noqa: B006
        if "a" not in cache:
            cache["a"] = lexicon.automaton()
        text, found = folded(text, table), set()
        for at in found_hits(text, cache["a"]):
            end = text.index(" ", at)
            after = text.find(" ", end + 1)
            before = text.rfind(" ", 0, max(0, at - 1))
            if after > 0:
                found.add(text[at - 1 : after + 1])
            if before >= 0 and at > 1:
                found.add(text[before : end + 1])
        return found

    rows = (
        _counts(sample, pairs)
        .where("toxic = 0 AND other >= 3")
        .orderBy(F.desc("other"), "entry")
        .limit(1000)
        .collect()
    )
    return {r.entry for r in rows}


def _calibrate(lexicon: Lexicon, sample: DataFrame) -> None:
    """Fit the three numbers of the score by logistic regression."""
    rows = _scanned(sample.select(F.col("toxic").alias("id"), "text"), lexicon, "int").toPandas()
    y = rows["id"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return
    total, n = rows["total"].to_numpy(), rows["n_words"].to_numpy()
    x = np.stack([np.ones(len(y)), np.log1p(total), np.log1p(100 * total / (n + 20))], axis=1)
    w = np.zeros(3)
    pull = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (p - y) + pull @ w)
        w -= np.clip(step, -2, 2)
    lexicon.bias, lexicon.of_total, lexicon.of_density = map(float, w)


def _scanned(texts: DataFrame, lexicon: Lexicon, id_type: str) -> DataFrame:
    """``(id, n_words, n_hits, total, score)`` of ``texts`` (id, text)."""

    def scan(batches):
        automaton, table = lexicon.automaton(), _letters()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = folded(value.as_py() or "", table)
                hits = found_hits(text, automaton)
                n_words, total = max(0, text.count(" ") - 1), math.fsum(hits.values())
                rows.append((n_words, len(hits), total, lexicon.score(total, n_words)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.float64()),
                ],
                ["id", "n_words", "n_hits", "total", "score"],
            )

    schema = f"id {id_type}, n_words long, n_hits long, total double, score double"
    return texts.mapInArrow(scan, schema)


def toxicity_score(lexicon: Lexicon):
    """A function from a text column to its score."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, table = lexicon.automaton(), _letters()
        for column in texts:
            scores = []
            for value in column:
                text = folded(value.as_py() or "", table)
                total = math.fsum(found_hits(text, automaton).values())
                scores.append(lexicon.score(total, max(0, text.count(" ") - 1)))
            yield pa.array(scores, pa.float64())

    return score


def toxicity_scores(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, score, n_words, n_hits, total)``, a row per row of ``docs``.

    ``score`` is from 0 to 1, ``total`` the weight of all hits. Null and empty texts have
    no hits and the score of a text without words. Rows are scored one by one, so
    repeated ones and null ids do not matter; other columns are ignored; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _scanned(texts, lexicon, texts.schema["id"].dataType.simpleString())
    return rows.select(F.col("id").alias(id_col), "score", "n_words", "n_hits", "total")
