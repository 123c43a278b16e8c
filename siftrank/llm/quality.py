"""Line-first quality rules, in DataFrame functions only.

Lines are judged one by one (punctuation, navigation, boilerplate) and failing
ones taken out; a document that loses too much of its words is rejected, as is
one that fails the rules on whole documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# What separates the entries of menus, and phrases of page furniture.
SEPARATOR = r"[|›»•·→]"
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share on",
    "sign in",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
WINDOW = 8


def _count(text: Column, pattern: str) -> Column:
    """Characters of a one-character ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _after(values: Column, k: int) -> Column:
    return F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0)))


def line_fails(line: Column) -> Column:
    """A line with words that is a menu, furniture, mostly symbols or a fragment."""
    n_words = F.size(F.regexp_extract_all(line, F.lit(WORD), 0))
    n_separators = _count(line, SEPARATOR)
    symbols = 10 * _count(line, SYMBOL) > F.length(line)
    menu = (n_separators >= 3) & (4 * n_separators >= n_words)
    furniture = (n_words <= 15) & F.lower(line).rlike("|".join(BOILERPLATE))
    fragment = (n_words <= 2) & ~line.rlike(r"[.!?…:;,)\"'\x{201D}\x{00BB}]\s*$")
    return symbols | menu | furniture | fragment


def judged_documents(
    docs: DataFrame,
    max_lost: float = 0.5,
    min_words: int = 20,
    max_repeated: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: counts, ``base_failed``, ``kept`` and the cleaned text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line),
    ``n_repeat_words`` (words in windows of eight words that occur twice or more in
    the text). ``base_failed``: fewer than ``min_words`` words, or a larger share
    than ``max_repeated`` of them repeated. ``kept``: not so, and lines with at most
    ``max_lost`` of the words failed. ``cleaned`` has the text without failed lines.

    Null and empty texts and texts without words have zero counts and fail. Rows
    are judged one by one, so repeated ones and null ids do not matter; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    rows = rows.select(
        id_col,
        "text",
        F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    rows = rows.select(
        id_col,
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter("lines", lambda x: line_fails(x)).alias("failed"),
    )
    # numbers of two, four and then eight words from each position on
    for k in (1, 2, 4):
        paired = F.zip_with("hashes", _after(F.col("hashes"), k), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn("hashes", paired)
    windows = F.slice("hashes", 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("windows", windows).drop("hashes")
    # only texts with a repeated window are looked at more closely
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(repeated, placed)).drop("windows")
    twice = F.filter(
        "placed",
        lambda p, k: F.coalesce(p["h"] == F.get("placed", k - 1)["h"], F.lit(False))
        | F.coalesce(p["h"] == F.get("placed", k + 1)["h"], F.lit(False)),
    )
    rows = rows.withColumn("starts", F.array_sort(F.transform(twice, lambda p: p["i"])))
    steps = F.zip_with(
        "starts",
        _after(F.col("starts"), 1),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    failed_words = _total(
        F.transform("failed", lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), 0)))
    )
    rows = rows.select(
        id_col,
        "n_words",
        "word_chars",
        _count(F.col("text"), SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_total(steps), F.lit(0)).cast("long").alias("n_repeat_words"),
        failed_words.alias("failed_words"),
        F.array_join(
            F.filter(F.split("text", "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)), "\n"
        ).alias("cleaned"),
    )
    base_failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") > max_repeated * F.col("n_words") + 1e-9
    )
    rows = rows.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.col("failed_words") <= max_lost * F.col("n_words"))
    return rows.withColumn("kept", kept)
