"""Registered queries over the whole corpus, sharding, and their SQL."""

from pyspark.sql import functions as F

from siftrank.llm.collocations import collocations
from siftrank.llm.search import ranked_documents
from siftrank.llm.sharding import DRAW_DIGITS, regular_tree, sharded

SHARDS = 16


def op11_ranked_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_documents(docs, items, k=10)


def op12_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_tree_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = sharded(docs, regular_tree(SHARDS), regular_tree(SHARDS + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


QUERIES = {
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_tree_shards": op13_tree_shards,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

_SEARCH = f"""
WITH t AS (
  SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms
  FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
figures AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM t),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
hits AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, n, unnest(terms) AS term FROM t)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM hits, figures GROUP BY term, docs),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS gain
  FROM hits JOIN weights USING (term), figures),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score
  FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scores QUALIFY rank <= 10"""

_COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
                                           lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4)) AS s(size)),
grams AS (
  SELECT lang, size, phrase, CAST(count(*) AS BIGINT) AS c FROM phrases GROUP BY ALL
  HAVING size = 1 OR c >= 30),
total AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, c AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM grams, (VALUES (1), (2), (3)) AS r(k) WHERE size > k AND c >= 30),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.c AS l, t.c AS r,
         CAST((2000000 * a::HUGEINT) // (h.c + t.c) AS BIGINT) AS score
  FROM cuts JOIN grams AS h ON h.lang = cuts.lang AND h.phrase = head
  JOIN grams AS t ON t.lang = cuts.lang AND t.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, c, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') AS phrase
  FROM grams, (VALUES (2), (3)) AS m(n), (VALUES (1), (2), (3)) AS r(i)
  WHERE c >= 30 AND n < size AND i <= size - n + 1),
longer AS (SELECT lang, phrase, max(c) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT scored.* FROM scored LEFT JOIN longer USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""

# The checksum of a text in SQL: a table of 256 entries made by its rule, then a
# step for each byte.
_CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
text_bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
sums AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM text_bytes, crc_table)"""


def _draw(name: str, weight: str) -> str:
    number = f"('0x' || substr(md5({name} || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, {DRAW_DIGITS}))"
    return f"-ln(({number}::BIGINT + 0.5::DOUBLE) / {16**DRAW_DIGITS}::DOUBLE) / {weight}"


def _placed(name: str, n_shards: int) -> str:
    """The tree's descent, level after level."""
    leaves = ", ".join(f"({x.region}, {x.rack}, {x.shard}, {x.weight})" for x in regular_tree(n_shards))
    return f"""
{name}_tree(region, rack, shard, weight) AS (VALUES {leaves}),
{name}_region AS (
  SELECT d.doc_id, arg_min(region, {_draw("'region ' || region", "weight")}) AS region
  FROM documents AS d, (SELECT region, sum(weight) AS weight FROM {name}_tree GROUP BY region)
  GROUP BY d.doc_id),
{name}_rack AS (
  SELECT d.doc_id, arg_min(rack, {_draw("'rack ' || rack", "weight")}) AS rack
  FROM {name}_region AS d
  JOIN (SELECT region, rack, sum(weight) AS weight FROM {name}_tree GROUP BY ALL) USING (region)
  GROUP BY d.doc_id),
{name} AS (
  SELECT d.doc_id, arg_min(shard, {_draw("'shard ' || shard", "weight")}) AS shard
  FROM {name}_rack AS d JOIN {name}_tree USING (rack) GROUP BY d.doc_id)"""


_SHARDED = f"""
WITH {_CRC},{_placed("now", SHARDS)},{_placed("grown", SHARDS + 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot,
       grown.shard AS grown_shard
FROM sums JOIN now USING (doc_id) JOIN grown USING (doc_id)"""

ORACLE_SQL = {
    "op11_ranked_search": _SEARCH,
    "op12_collocations": _COLLOCATIONS,
    "op13_tree_shards": _SHARDED,
}
