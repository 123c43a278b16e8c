"""Language identification in two steps: the family, then the language within it.

A text is the hashed counts of its letter sequences. Linear support vector machines
tell each family from the others; within the chosen family one machine for each pair
of languages votes.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Language codes by family. Codes not listed are a family of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
    "sinitic": "yue zh",
}
DIMENSIONS = 4096
UNDETERMINED = "und"

_STEPS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), code)


def letter_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letters[np.minimum(codes, len(letters) - 1)], codes, np.uint32(0))


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x32400)])


def sequence_counts(codes: np.ndarray) -> np.ndarray:
    """Weights of sequences of one to three letters (word ends count as letters)."""
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    # of several characters that are no letters in a row one is enough
    codes = codes[(codes != 0) | np.append(codes[1:] != 0, True)]
    counts = np.zeros(DIMENSIONS)
    total = np.zeros(len(codes), dtype=np.uint32)
    for n in range(3):
        total = (total[: len(codes) - n] + codes[n:]) * np.uint32(_STEPS[n])
        total ^= total >> np.uint32(15)
        counts += np.bincount(total >> np.uint32(20), minlength=DIMENSIONS)
    weights = np.sqrt(counts)
    return (weights / max(1e-9, np.linalg.norm(weights))).astype(np.float32)


def _support_vectors(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4) -> np.ndarray:
    """A linear machine with squared hinge loss; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    step, t = 1 / (2 * 2 + penalty), 1.0
    for _ in range(400):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = penalty * ahead - 2 * ((weight * y * slack).astype(np.float32) @ x)
        new = ahead - step * slope
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_next * (new - w)
        w, t = new, t_next
    return w


class Languages:
    """Families, languages, and the weights of all machines side by side."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        names = np.array(languages)
        groups = np.array([family_of(v) for v in languages])
        self.families = sorted(set(groups.tolist()))
        self.members = {f: sorted(set(names[groups == f].tolist())) for f in self.families}
        columns = []
        if len(self.families) > 1:
            columns += [_support_vectors(x, np.where(groups == f, 1, -1)) for f in self.families]
        self.duels = []
        for family in self.families:
            for left, right in combinations(self.members[family], 2):
                rows = (names == left) | (names == right)
                machine = _support_vectors(x[rows], np.where(names[rows] == left, 1, -1))
                self.duels.append((family, left, right, len(columns)))
                columns.append(machine)
        self.weights = np.array(columns, dtype=np.float32).reshape(-1, DIMENSIONS + 1)

    def predicted(self, counts: np.ndarray) -> tuple[str, float]:
        """The language and how sure it is, 0 to 1."""
        margins = self.weights[:, :-1] @ counts + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-4 * margins.astype(float)))
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            best = int(np.argmax(margins[: len(self.families)]))
            family, score = self.families[best], float(sure[best])
        members = self.members[family]
        if len(members) == 1:
            return members[0], score
        votes = dict.fromkeys(members, 0)
        belief = dict.fromkeys(members, 0.0)
        for group, left, right, k in self.duels:
            if group == family:
                votes[left if margins[k] > 0 else right] += 1
                belief[left] += sure[k]
                belief[right] += 1 - sure[k]
        winner = max(members, key=lambda m: (votes[m], belief[m], m))
        return winner, score * belief[winner] / (len(members) - 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, h, text), once for each language and hash of a task."""
    letters, pack = letter_table(), zstandard.ZstdCompressor(level=1).compress
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        rows, packed = [], []
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)):
            if key not in seen:
                seen.add(key)
                codes = letter_codes(batch.column(2)[k].as_py(), letters)
                packed.append(pack(sequence_counts(codes).astype(np.float16).tobytes()))
                rows.append(k)
        own = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*own.columns, pa.array(packed, pa.binary())], ["lang", "h", "packed"]
        )


def learned_languages(labelled: DataFrame, most_rows: int = 6000) -> Languages | None:
    """Fit on ``labelled`` (text, lang): ``most_rows`` distinct texts at most, or one of each
    language if these are more; as many of each language, those with the least hashes.
    Null texts and languages are left out; None if nothing is left."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    labelled = labelled.select("lang", F.xxhash64("text").alias("h"), "text")
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return None
    most = max(1, most_rows // len(sizes))
    # of more hashes than are needed, as their number is an estimate, the least are taken
    scale = 1 << 30
    shares = labelled.sparkSession.createDataFrame(
        [(r.lang, int(min(1.0, (2 * most + 50) / max(r.n, 1)) * scale)) for r in sizes],
        "lang string, share long",
    )
    place = F.pmod(F.col("h"), F.lit(scale))
    few = labelled.select("lang", "h").join(F.broadcast(shares), "lang").where(place < F.col("share"))
    by_hash = Window.partitionBy("lang").orderBy(place, "h")
    ranked = few.select("lang", "h").distinct().withColumn("k", F.row_number().over(by_hash))
    least = ranked.where(F.col("k") <= most).select("lang", "h")
    chosen = labelled.join(F.broadcast(least), ["lang", "h"]).select("lang", "h", "text")
    rows = chosen.mapInArrow(_vectors, "lang string, h long, packed binary")
    rows = rows.dropDuplicates(["lang", "h"]).select("lang", "packed")
    rows = rows.toPandas().sort_values(["lang", "packed"])
    unpack = zstandard.ZstdDecompressor().decompress
    if not len(rows):
        return None
    x = np.empty((len(rows), DIMENSIONS), dtype=np.float32)
    for k, packed in enumerate(rows["packed"]):
        x[k] = np.frombuffer(unpack(packed), dtype=np.float16)
    return Languages(x, rows["lang"].tolist())


def identified_languages(
    docs: DataFrame, model: Languages | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, lang_pred, score)``, a row per row of ``docs``.

    ``lang_pred`` is one of the model's languages, or ``und`` with score 0 for null and
    empty texts, texts without a letter, and without a model. Rows are judged one by
    one, so repeated ones and null ids do not matter; other columns are ignored; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    parts = vars(model) if model else None
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def judge(batches):
        letters, known = letter_table(), None
        if sent.value is not None:
            known = object.__new__(Languages)
            vars(known).update(sent.value)
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                codes = letter_codes(value.as_py() or "", letters)
                name, score = UNDETERMINED, 0.0
                if known is not None and codes.any():
                    name, score = known.predicted(sequence_counts(codes))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    rows = texts.mapInArrow(judge, f"id {id_type}, lang_pred string, score double")
    return rows.withColumnRenamed("id", id_col)
