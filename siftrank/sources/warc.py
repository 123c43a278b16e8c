"""Web archives as tables of records.

Files are listed by Spark's own sources as rows of path and length. Those that are
longer than a fair share of the work are searched for places where a reader can
start; files and pieces are then dealt out by size. No list of them passes through
the program that starts the job. Tasks read streams, a record at a time; what is held
in memory is one batch of records.
"""

import json
import sys
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import siftrank.sources.files as files
import siftrank.sources.records as records
from siftrank.functions.text import decode_utf8, html_to_text, strip_index_page
from siftrank.operators.ranges import in_ranges, offsets
from siftrank.session import written

SCHEMA = (
    "record_no long, warc_type string, warc_date string, warc_record_id string, "
    "content_type string, content_length int, headers map<string,string>, "
    "content binary, path string"
)

BATCH_RECORDS = 500
BATCH_BYTES = 16 << 20
PIECE_BYTES = 128 << 20
# What opening a file is reckoned to cost.
OPEN_BYTES = 4 << 20
# Rows of path and length that one task puts in order at most.
ORDERED_ROWS = 10_000

_PIECES = "path string, start long, end long, before long, within long, whole boolean"


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], record_type: str):
        self.paths = paths
        self.record_type = record_type

    def __getstate__(self) -> dict:
        """What tasks get: each has its own path in its partition."""
        return {"paths": [], "record_type": self.record_type}

    def partitions(self) -> list[InputPartition]:
        return [WarcFile(path) for path in self.paths]

    def read(self, partition: WarcFile):
        size = files.size_of(partition.path)
        with records.open_stretch(partition.path, 0, size) as stream:
            found = records.records(stream, self.record_type)
            yield from _batches(found, partition.path)


def _batches(found, path: str, before: int = 0):
    """Arrow batches of records; ``before`` is how many came before them in their file."""
    schema = pa.schema(
        [
            ("record_no", pa.int64()),
            ("warc_type", pa.string()),
            ("warc_date", pa.string()),
            ("warc_record_id", pa.string()),
            ("content_type", pa.string()),
            ("content_length", pa.int32()),
            ("headers", pa.map_(pa.string(), pa.string())),
            ("content", pa.binary()),
            ("path", pa.string()),
        ]
    )
    batch, size = [], 0
    for record in found:
        batch.append(record | {"record_no": record["record_no"] + before, "path": path})
        size += len(record["content"] or b"")
        if len(batch) == BATCH_RECORDS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(batch, schema)
            batch, size = [], 0
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema)


class WarcDataSource(DataSource):
    """``format("warc")``, over one file or, in the option ``files``, a JSON list.

    ``record_type`` says which records to read; the default is ``response``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        files = self.options.get("files")
        paths = json.loads(files) if files else [self.options["path"]]
        return WarcReader(paths, self.options.get("record_type", "response"))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files that a path, folder or glob stands for, as Spark's own sources see it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return sorted(unquote(f) for f in files.inputFiles())


def _by_value(spark: SparkSession) -> None:
    """Tasks carry this code along, so that executors need no copy of the package."""
    for module in (sys.modules[__name__], records, files):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(WarcDataSource)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files, other than empty ones, that a path, folder or
    glob stands for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "length")


def _indexed(record_type: str, piece_bytes: int, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            found = records.pieces(row["path"], row["length"], record_type, piece_bytes)
            yield pa.RecordBatch.from_pylist([{"path": row["path"]} | piece for piece in found])


def archive_pieces(
    spark: SparkSession, listed: DataFrame, record_type: str = "response", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """``(path, start, end, before, within, whole)``: files searched for places to start at.

    ``within`` counts a piece's records of the type, ``before`` those of earlier
    pieces. ``whole`` is false where a file is cut off or broken. Archives that are
    not compressed are searched by their headers, the rest is passed over.
    """
    _by_value(spark)
    spread = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(lambda it: _indexed(record_type, piece_bytes, it), _PIECES)


def archive_report(spark: SparkSession, path: str, record_type: str = "") -> DataFrame:
    """``(path, n_records, whole)`` for each file: what is there to read, and whether
    the file ends within a record or cannot be unpacked to its end."""
    found = archive_pieces(spark, archive_files(spark, path), record_type)
    return found.groupBy("path").agg(
        F.sum("within").alias("n_records"), F.bool_and("whole").alias("whole")
    )


def _read(record_type: str, payload: bool, batches: Iterator[pa.RecordBatch]):
    rows = (row for batch in batches for row in batch.to_pylist())
    for path, pieces in groupby(rows, lambda row: row["path"]):
        with records.open_file(path) as opened:
            for row in pieces:
                with records.stretch(opened, path, row["start"], row["end"]) as stream:
                    found = records.records(stream, record_type, payload)
                    yield from _batches(found, path, row["before"])


def _dealt(pieces: DataFrame, n_pieces: int, share: int) -> DataFrame:
    """``pieces`` with the number of the task that reads them, ``share`` bytes each."""
    # a task opens a file once, however many of its pieces it reads
    cost = F.col("end") - F.col("start") + F.when(F.col("start") == 0, OPEN_BYTES).otherwise(0)
    earlier = [Window.unboundedPreceding, -1]
    if n_pieces <= ORDERED_ROWS:
        order = Window.partitionBy(F.lit(0)).orderBy("path", "start").rowsBetween(*earlier)
        used = F.coalesce(F.sum(cost).over(order), F.lit(0))
        return pieces.withColumn("task", F.floor(used / share))
    ranged = in_ranges(pieces, ["path", "start"], -(-n_pieces // ORDERED_ROWS))
    before = F.broadcast(offsets(ranged.withColumn("all", F.lit(0)), ["all"], used=F.sum(cost)))
    order = Window.partitionBy("part").orderBy("nth").rowsBetween(*earlier)
    used = F.col("used") + F.coalesce(F.sum(cost).over(order), F.lit(0))
    dealt = ranged.join(before.select("part", "used"), "part")
    return dealt.withColumn("task", F.floor(used / share)).select(*pieces.columns, "task")


def read_warc(
    spark: SparkSession,
    path: str,
    record_type: str = "response",
    payload: bool = True,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Records of a web archive; ``path`` may be a file, a folder or a glob.

    A task reads files and pieces of files of about ``piece_bytes``, or fewer where
    there are cores to spare; short pieces share tasks worth ``OPEN_BYTES``. Files longer
    than ``piece_bytes`` are searched first, unless there are so many others that a file
    is no more than a quarter of a core's share; a compressed one can be read in pieces
    if it has members. ``record_no`` counts a file's records of the type, read in pieces
    or not. Without ``payload`` the ``content`` is null and is not kept, nor, in archives
    that are not compressed, read.
    """
    _by_value(spark)
    cores = spark.sparkContext.defaultParallelism
    listed = archive_files(spark, path)
    figures = [F.count("*"), F.coalesce(F.sum("length"), F.lit(0))]
    n_files, total = listed.agg(*figures).first()
    long = F.col("length") > max(piece_bytes, total // (4 * cores))
    whole = listed.filter(~long).select(
        "path", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(0).cast("long").alias("before")
    )
    n_pieces = n_files
    pieces = whole
    if not listed.filter(long).isEmpty():
        found = written(archive_pieces(spark, listed.filter(long), record_type, piece_bytes), "pieces")
        pieces = whole.unionByName(found.select(*whole.columns))
        n_pieces = n_files + found.count()
    cost = total + n_files * OPEN_BYTES
    share = max(OPEN_BYTES, min(piece_bytes, cost // cores))
    n_tasks = max(1, min(n_pieces, -(-cost // share)))
    dealt = _dealt(pieces, n_pieces, share).repartitionByRange(n_tasks, "task")
    dealt = dealt.sortWithinPartitions("path", "start")
    return dealt.select("path", "start", "end", "before").mapInArrow(
        lambda it: _read(record_type, payload, it), SCHEMA
    )


def warc_pages(
    found: DataFrame, id_field: str = "WARC-TREC-ID", need_id: bool = True
) -> DataFrame:
    """``(doc_id, url, html)`` of the records that have a URL and, if asked for, an id.

    Links on pages without an id count like others.
    """
    pages = found.select(
        F.col("headers")[id_field].alias("doc_id"),
        F.col("headers")["WARC-Target-URI"].alias("url"),
        decode_utf8(F.col("content")).alias("html"),
    ).filter("url is not null")
    return pages.filter("doc_id is not null") if need_id else pages


def warc_documents(
    found: DataFrame, id_field: str = "WARC-TREC-ID", with_url: bool = True
) -> DataFrame:
    """``(doc_id, text)``; by default the URL is part of the text."""
    return page_documents(warc_pages(found, id_field), with_url)


def page_documents(pages: DataFrame, with_url: bool = True) -> DataFrame:
    """``(doc_id, url, html)`` → ``(doc_id, text)``."""
    body = html_to_text(F.col("html"))
    url = strip_index_page(F.col("url"))
    return pages.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.concat(url, F.lit("\t"), body) if with_url else body).alias("text"),
    )
