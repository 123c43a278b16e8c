"""Readers for the tab- and colon-separated text formats."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions.text import query_terms
from siftrank.operators.topics import last_wins
from siftrank.session import spread
from siftrank.sources.warc import read_warc, warc_documents

# Header lines of a topic file with statistics. The word after
# the '#' names the program that wrote the file and may be any.
STATS_HEADER = r"^#\w+-(COMMENT|COLLECTION|LENGTH|NDOCS):"
LENGTH_HEADER = r"^#\w+-LENGTH:(\d+)"
NDOCS_HEADER = r"^#\w+-NDOCS:(\d+)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, seq)``, where ``seq`` follows the order of lines in a file."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def _require(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(
        F.raise_error(F.concat(F.lit(message + ": "), F.col("value")))
    )


def read_keyval(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``: lines cut at the first tab; no tab means no text."""
    halves = F.split("value", "\t", 2)
    return spread(spark.read.text(path)).select(
        halves[0].alias("doc_id"), F.coalesce(F.get(halves, 1), F.lit("")).alias("text")
    )


def read_documents(spark: SparkSession, path: str, input_format: str = "WARC") -> DataFrame:
    """``(doc_id, text)`` from a web archive or from key-value text."""
    kind = input_format.upper()
    if kind == "KEYVAL":
        return read_keyval(spark, path)
    if kind == "WARC":
        return warc_documents(read_warc(spark, path))
    raise ValueError(f"input format must be WARC or KEYVAL, not {input_format!r}")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, url, anchors)`` from anchor text as written by the sinks."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        fields[0].alias("doc_id"),
        F.get(fields, 1).alias("url"),
        F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0))).alias("anchors"),
    )


def parse_topics(lines: DataFrame, reject_stats: bool = False) -> DataFrame:
    """``(qid, seq, terms)`` from lines ``qid:query``, one row per line.

    The whole line is lowercased and a second colon ends the query. A line that
    has nothing after its first colon is an error, and with ``reject_stats`` so
    is the header of a file that already carries statistics.
    """
    line = F.lower("value")
    fields = F.split(line, ":")
    topic = F.struct(fields[0].alias("qid"), query_terms(F.get(fields, 1)).alias("terms"))
    checked = _require(line.rlike("^[^:]*:.*[^:]"), topic, "topic line without a query")
    if reject_stats:
        checked = F.when(
            F.col("value").rlike(STATS_HEADER),
            F.raise_error("topic file carries statistics already; use the original topics"),
        ).otherwise(checked)
    return lines.select(checked.alias("topic"), "seq").select(
        "topic.qid", "seq", "topic.terms"
    )


def topics_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a topic file given as one string: ``(value, seq)``."""
    return spark.range(1).select(
        F.posexplode(F.split(F.lit(text.strip("\n")), "\n")).alias("seq", "value")
    )


def read_topic_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a topic file, for the statistics job: ``(qid, seq, terms)``."""
    return parse_topics(_lines(spark, path))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, terms)`` for a run; of lines with the same id the last counts."""
    return last_wins(parse_topics(_lines(spark, path), reject_stats=True))


def parse_weighted_topics(lines: DataFrame) -> DataFrame:
    """``(qid, terms, n_docs, coll_len)`` from a topic file with statistics.

    Terms are written ``term=qtf=df=cf``. Those that the collection lacks
    (cf of 0 or less) are dropped. Missing or zero collection figures are an
    error, as are malformed terms and negative weights.
    """
    header = F.col("value").rlike(STATS_HEADER)
    figures = lines.filter(header).agg(
        F.max(_figure(LENGTH_HEADER)).alias("coll_len"),
        F.max(_figure(NDOCS_HEADER)).alias("n_docs"),
    )
    known = (F.col("stats.n_docs") > 0) & (F.col("stats.coll_len") > 0)
    fields = F.split(F.lower("value"), ":")
    words = F.filter(
        F.split(F.coalesce(F.get(fields, 1), F.lit("")), " "), lambda w: w != ""
    )

    def entry(word: Column) -> Column:
        parts = F.split(word, "=")
        return F.struct(
            parts[0].alias("term"),
            parts[1].cast("int").alias("qtf"),
            parts[2].cast("long").alias("df"),
            parts[3].cast("long").alias("cf"),
        )

    well_formed = F.forall(words, lambda w: w.rlike(r"^[^=]*=\d+=\d+=-?\d+$"))
    terms = F.filter(F.transform(words, entry), lambda t: t["cf"] > 0)
    topics = lines.filter(~header).select(
        "seq",
        fields[0].alias("qid"),
        _require(well_formed, terms, "error in query format").alias("terms"),
    )
    return (
        last_wins(topics)
        .withColumn("stats", figures.select(F.struct("*")).scalar())
        .select(
            F.when(known, F.col("qid"))
            .otherwise(F.raise_error("no collection statistics in the topic file"))
            .alias("qid"),
            "terms",
            F.col("stats.n_docs").alias("n_docs"),
            F.col("stats.coll_len").alias("coll_len"),
        )
    )


def _figure(pattern: str) -> Column:
    digits = F.regexp_extract("value", pattern, 1)
    return F.when(digits != "", digits.cast("long"))


def read_weighted_topics(spark: SparkSession, path: str) -> DataFrame:
    return parse_weighted_topics(_lines(spark, path))


def read_run(
    spark: SparkSession, path: str, default_model: str = "run", model: str | None = None
) -> DataFrame:
    """``(qid, model, doc_id, score)`` from a run file ``qid[:model]⇥doc⇥score``.

    With ``model`` only its rows are read; in a run that has a folder for each model,
    the other folders are not opened.
    """
    fields = F.split("value", "\t")
    key = F.split(fields[0], ":", 2)
    lines = spark.read.text(path)
    if model is not None and "model" in lines.columns:
        lines = lines.filter(F.col("model") == F.lit(model))
    run = lines.select(
        key[0].alias("qid"),
        F.coalesce(F.get(key, 1), F.lit(default_model)).alias("model"),
        fields[1].alias("doc_id"),
        fields[2].cast("double").alias("score"),
    )
    return run if model is None else run.filter(F.col("model") == F.lit(model))
