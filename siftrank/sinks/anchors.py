"""Anchor text files from parts, so that no line has to fit into a row.

A file's lines are written as their parts come by. Tasks write under names of their
own; only files of tasks that the job counts are moved to where readers look.
"""

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

import siftrank.sources.files as files

COLUMNS = ["doc_id", "url", "part", "last", "anchors"]
_ATTEMPTS = "_temporary"


class WrittenFile(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class AnchorTextWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> WrittenFile:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.txt.gz"
        file_system, folder = files.file_system(f"{self.path}/{_ATTEMPTS}")
        file_system.create_dir(folder, recursive=True)
        with file_system.open_output_stream(f"{folder}/{name}", compression="gzip") as out:
            for doc_id, url, part, last, anchors in iterator:
                if part == 0:
                    out.write(f"{doc_id}\t{url}".encode())
                for anchor in anchors:
                    out.write(f"\t{anchor}".encode())
                if last:
                    out.write(b"\n")
        return WrittenFile(name)

    def commit(self, messages) -> None:
        file_system, folder = files.file_system(self.path)
        for message in messages:
            if message is not None:
                file_system.move(f"{folder}/{_ATTEMPTS}/{message.name}", f"{folder}/{message.name}")
        self._clean(file_system, folder)
        with file_system.open_output_stream(f"{folder}/_SUCCESS") as mark:
            mark.write(b"")

    def abort(self, messages) -> None:
        self._clean(*files.file_system(self.path))

    def _clean(self, file_system, folder: str) -> None:
        from pyarrow import fs

        if file_system.get_file_info(f"{folder}/{_ATTEMPTS}").type != fs.FileType.NotFound:
            file_system.delete_dir(f"{folder}/{_ATTEMPTS}")


class AnchorTextSink(DataSource):
    """``format("anchor_text")``: rows of :func:`anchor_parts`, a URL's in order."""

    @classmethod
    def name(cls) -> str:
        return "anchor_text"

    def schema(self) -> str:
        return "doc_id string, url string, part long, last boolean, anchors array<string>"

    def writer(self, schema, overwrite: bool) -> AnchorTextWriter:
        return AnchorTextWriter(self.options["path"])


def write_anchor_parts(parts: DataFrame, path: str) -> None:
    """The same lines as :func:`siftrank.sinks.text.write_anchors`, from parts.

    A URL's parts go to one task, in order, which holds one of them at a time. Fails
    when the output exists already.
    """
    spark = parts.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileExistsError(path)
    # by value, so that executors need no copy of this package
    for module in (sys.modules[__name__], files):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(AnchorTextSink)
    rows = parts.select(*COLUMNS).repartition("url").sortWithinPartitions("url", "part")
    rows.write.format("anchor_text").mode("append").save(path)
