"""Registered queries of this subpackage, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from siftrank.llm import corpus_queries
from siftrank.llm.byte_bpe import encoded_documents
from siftrank.llm.decontaminate import benchmark_overlaps
from siftrank.llm.languages import identified_languages, learned_languages
from siftrank.llm.main_text import main_texts
from siftrank.llm.quality import BOILERPLATE, SEPARATOR, SYMBOL, judged_documents
from siftrank.llm.secrets import found_secrets, joined_spans
from siftrank.llm.similar import similar_components
from siftrank.llm.token_counts import token_counts
from siftrank.llm.toxicity import labelled_sample, learned_lexicon, toxicity_scores
from siftrank.llm.url_filters import judged_urls

# The rules of the URL query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LABELLED_ROWS = 20_000


def _remainder(divisor):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    lexicon = learned_lexicon(labelled_sample(docs, labels, LABELLED_ROWS))
    scores = toxicity_scores(docs, lexicon)
    return scores.select(
        "doc_id",
        F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_main_texts(spark, sf_dir):
    return main_texts(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark, sf_dir):
    return token_counts(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )


def op4_similar_documents(spark, sf_dir):
    return similar_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_benchmark_overlaps(spark, sf_dir):
    return benchmark_overlaps(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shortest_item=1
    )


def op5_found_secrets(spark, sf_dir):
    found = found_secrets(_table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["kind"] != "literal")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined_spans(plain).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op6_byte_bpe(spark, sf_dir):
    rows = encoded_documents(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_languages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = learned_languages(docs.where(_remainder(4) != 2).select("text", "lang"))
    found = identified_languages(docs, model)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op8_judged_urls(spark, sf_dir):
    judged = judged_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_judged_documents(spark, sf_dir):
    judged = judged_documents(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_main_texts": op2_main_texts,
    "op3_token_counts": op3_token_counts,
    "op4_similar_documents": op4_similar_documents,
    "op5_found_secrets": op5_found_secrets,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_languages": op7_languages,
    "op8_judged_urls": op8_judged_urls,
    "op9_judged_documents": op9_judged_documents,
    "op10_benchmark_overlaps": op10_benchmark_overlaps,
} | corpus_queries.QUERIES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_SIMILAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS words
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS s
  FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
  WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON x = w.doc_id"""


def _count(pattern: str) -> str:
    return f"(length(x) - length(regexp_replace(x, '{pattern}', '', 'g')))"


_N_WORDS = f"len({_WORDS.format('x')})"
_FAILS = f"""
  10 * {_count(SYMBOL)} > length(x)
  OR ({_count(SEPARATOR)} >= 3 AND 4 * {_count(SEPARATOR)} >= {_N_WORDS})
  OR ({_N_WORDS} <= 15 AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}'))
  OR ({_N_WORDS} <= 2 AND NOT regexp_matches(x, '[.!?…:;,)"''”»]\\s*$'))"""

_JUDGED = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, {_WORDS.format("text")} AS words,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
  FROM w, unnest(range(1, len(words) - 6)) AS r(i) WHERE len(words) >= 8),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 8)) AS r(k) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(list_sum(list_transform(list_filter(lines, lambda x: {_FAILS}),
                                          lambda x: {_N_WORDS})), 0) AS failed_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 2 * failed_words <= n_words AS kept
FROM based"""

# The others learn, encode, or lex, which SQL cannot express.
ORACLE_SQL = {
    "op4_similar_documents": _SIMILAR,
    "op9_judged_documents": _JUDGED,
} | corpus_queries.ORACLE_SQL
