"""From raw documents to token ids: five stages, each on what the one before kept.

Rows are told apart by their id and all their columns, so repeated and null ids do no
harm. Every stage keeps the columns of its input, whatever their names, but for the last,
which has ``(doc_id, n_tokens, token_ids, text)``. Empty tables stay empty. Texts are
looked at whole, however long; null and empty ones, and those without words, are neither
toxic nor copies nor contaminated, hold no secret, and have no tokens.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm.byte_bpe import encoded_documents
from siftrank.llm.decontaminate import benchmark_overlaps
from siftrank.llm.secrets import without_secrets
from siftrank.llm.similar import similar_components
from siftrank.llm.toxicity import labelled_sample, learned_lexicon, toxicity_score
from siftrank.session import written

LABELLED_ROWS = 20_000


def _free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame, row: str) -> DataFrame:
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return docs.withColumn(row, F.struct("doc_id", F.xxhash64(*plain).alias("row")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = learned_lexicon(labelled_sample(docs, labels, LABELLED_ROWS))
    return docs.where(toxicity_score(lexicon)(F.col("text").cast("string")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of texts that share 0.8 of their
    five-word shingles, directly or through others; texts without words stay."""
    row, copy = _free_name(docs, "row"), _free_name(docs, "copy")
    keyed = _keyed(docs, row)
    groups = similar_components(keyed, n=5, percent=80, id_col=row)
    first = groups.where(F.col(row) == F.col("component_id")).select(row).distinct()
    # a repeated row is a copy, unless it has no words
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    number = F.when(wordless, F.monotonically_increasing_id()).otherwise(-1)
    kept = keyed.withColumn(copy, number).join(first, row, "left_semi")
    return kept.dropDuplicates([row, copy]).drop(row, copy)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    row = _free_name(docs, "row")
    keyed = _keyed(docs, row)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = benchmark_overlaps(keyed, benchmark, id_col=row, shortest_item=1)
    hits = hits.select(row).distinct()
    # a table of known size, so that it is sent to all tasks only if it is small
    return keyed.join(written(hits, "hits"), row, "left_anti").drop(row)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of secrets and ``n_chars`` brought up to date."""
    masked = docs.withColumn("text", without_secrets(F.col("text")))
    if "n_chars" not in docs.columns:
        return masked
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(n_chars, "n_chars"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian 32-bit numbers, and the text that they decode to."""
    rows = encoded_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return rows.select("doc_id", "n_tokens", "token_ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", to_token_ids),
]

# The lexicon is learned and token ids come from merging, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
