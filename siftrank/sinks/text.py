"""Writers and row formats for the exchange files.

Every writer fails when its output exists already.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The constant second column of a run file, and the fields of a
# statistics header.
RUN_CONSTANT = "Q0"
STATS_COMMENT = (
    "COMMENT: query term weight, document frequency, collection frequency (for each term)"
)


def anchor_lines(anchors: DataFrame) -> DataFrame:
    """``doc_id ⇥ url ⇥ anchor ⇥ anchor …``"""
    return anchors.select(F.concat_ws("\t", "doc_id", "url", "anchors").alias("value"))


def write_anchors(anchors: DataFrame, path: str) -> None:
    anchor_lines(anchors).write.text(path, compression="gzip")


def run_rows(run: DataFrame, tagged: bool = True) -> DataFrame:
    """``qid:model ⇥ doc_id ⇥ score``, or without the model."""
    key = F.concat_ws(":", "qid", "model") if tagged else F.col("qid")
    return run.select(
        F.concat_ws("\t", key, "doc_id", F.col("score").cast("string")).alias("value"),
        "model",
    )


def write_run(run: DataFrame, path: str, tagged: bool = True) -> None:
    run_rows(run, tagged).select("value").write.text(path)


def write_run_by_model(run: DataFrame, path: str) -> None:
    """One folder per model, so that a reader of one model opens no other."""
    run_rows(run).write.partitionBy("model").text(path)


def topic_lines(weighted: DataFrame) -> DataFrame:
    """``(seq, value)`` with ``qid:term=qtf=df=cf term=qtf=df=cf …``"""
    words = F.transform(
        "terms", lambda t: F.concat_ws("=", t["term"], t["qtf"], t["df"], t["cf"])
    )
    return weighted.select(
        "seq", F.concat("qid", F.lit(":"), F.array_join(words, " ")).alias("value")
    )


def stats_file_lines(weighted: DataFrame, collection: str, program: str = "RUN") -> DataFrame:
    """``value``: four header lines, then the topics in the order of ``seq``.

    ``program`` is the word that starts each header line; readers take any.
    """
    head = weighted.agg(
        F.coalesce(F.max("coll_len"), F.lit(0)).alias("coll_len"),
        F.coalesce(F.max("n_docs"), F.lit(0)).alias("n_docs"),
    ).select(
        F.posexplode(
            F.array(
                F.lit(f"#{program}-{STATS_COMMENT}"),
                F.lit(f"#{program}-COLLECTION:{collection}"),
                F.concat(F.lit(f"#{program}-LENGTH:"), F.col("coll_len").cast("string")),
                F.concat(F.lit(f"#{program}-NDOCS:"), F.col("n_docs").cast("string")),
            )
        ).alias("nth", "value")
    )
    missing = F.lit(None).cast(weighted.schema["seq"].dataType)
    body = topic_lines(weighted).select(F.lit(4).alias("nth"), "seq", "value")
    return (
        head.select("nth", missing.alias("seq"), "value")
        .unionByName(body)
        .orderBy("nth", "seq")
        .select("value")
    )


def write_stats_file(
    weighted: DataFrame, path: str, collection: str, program: str = "RUN"
) -> None:
    """One file: it is as small as the topic file it extends."""
    stats_file_lines(weighted, collection, program).coalesce(1).write.text(path)


def trec_run(
    run: DataFrame,
    model: str | None = None,
    strip_prefix: str = "^wt09-",
    tag: str | None = None,
) -> DataFrame:
    """Ranked rows as run lines: ``(qid, rank, value)``, ordered by both.

    A run file holds one model. Name it when ``run`` has several; without a
    name a second model is an error. ``tag`` is what the lines call the model.
    """
    qid = F.regexp_replace("qid", strip_prefix, "") if strip_prefix else F.col("qid")
    name = F.col("model")
    if model is not None:
        run = run.filter(F.col("model") == model)
    else:
        # two are enough to tell, and are found without finishing the run
        several = len(run.select("model").distinct().limit(2).collect()) > 1
        if several:
            raise ValueError("the run holds several models: name one")
    if tag is not None:
        name = F.when(name.isNotNull(), F.lit(tag))
    return (
        run.select(qid.alias("qid"), "doc_id", "rank", "score", name.alias("tag"))
        .select(
            "qid",
            "rank",
            F.concat_ws(
                "\t",
                "qid",
                F.lit(RUN_CONSTANT),
                "doc_id",
                F.col("rank").cast("string"),
                F.col("score").cast("string"),
                "tag",
            ).alias("value"),
        )
        .orderBy(F.coalesce(F.col("qid").try_cast("int"), F.lit(0)), "qid", "rank")
    )


def write_trec_run(run: DataFrame, path: str, **options) -> None:
    trec_run(run, **options).select("value").write.text(path)
