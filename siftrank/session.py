"""What the operators read from the session."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts_for(spark: SparkSession) -> int:
    """Parts into which a hot group is split before its final ranking.

    Grows with the cluster: one per eight shuffle partitions, so that a group
    that holds most rows still keeps a good share of the tasks busy.
    """
    return max(1, min(512, shuffle_partitions(spark) // 8))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, one in the warehouse. On a cluster that has to be a folder
    that all executors reach, so one of this machine's is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own = warehouse.startswith(("file:", "/"))
    if own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return warehouse + "/_intermediate"


class _Owner:
    """The tables that were written within a call."""

    def __init__(self):
        self.folders: list[str] = []
        self.tables: list[str] = []


_owners: ContextVar[tuple[_Owner, ...]] = ContextVar("owners", default=())


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, the tables that were written within, but those that outlive it.

    What is read lazily from them has to be read, or written elsewhere, before that.
    Tables that outlive this belong to the call around it, if that is one as well.
    """
    own = _Owner()
    token = _owners.set((*_owners.get(), own))
    try:
        yield
    finally:
        _owners.reset(token)
        for table in own.tables:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in own.folders:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_table(name: str) -> str:
    """A name for a table of the catalogue; its entry goes with the other tables."""
    table = f"{name}_{uuid.uuid4().hex}"
    if owners := _owners.get():
        owners[-1].tables.append(table)
    return table


def new_folder(spark: SparkSession, name: str, outlives: bool = False) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owners = _owners.get()[:-1] if outlives else _owners.get()
    if owners:
        owners[-1].folders.append(folder)
    return folder


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a costly result feeds more than one consumer. Unlike a cached
    block the table outlives any executor, and its readers see columns only. It
    stays until it is deleted, as :func:`intermediate_tables` does.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name, outlives)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out over all cores.

    For collections in few large files that cannot be read in parts. Where the
    splits suffice, as they do in any large collection, nothing is moved.
    Only for plain scans: counting the splits of other plans may run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
