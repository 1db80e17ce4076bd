"""Reading table files, and tables written on the way so that work is neither repeated nor lost with an executor."""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from shelfwise.tables import SCHEMAS, SQL_NAMES, RetailTables

#: Called with label and frame before a table is written, for tests and logs that want to see what is run.
OBSERVERS: list[Callable[[str, DataFrame], None]] = []
#: Folders of the scopes that are open, innermost last.
_SCOPES: list[str] = []
#: Bucketed tables by the scope they were written in.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: below ``spark.checkpoint.dir``, one subfolder per application.

    Only a local session without that setting falls back to its warehouse folder; on a cluster the setting is required,
    because executors must all see the files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"
    return f"{base.rstrip('/')}/shelfwise-{context.applicationId}"


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Owner of the tables that the code inside writes on the way: they are deleted when the block ends.

    Results computed inside must therefore be written or collected before the block is left.
    """
    folder = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        for name in _TABLES.pop(folder, []):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        drop_folder(spark, folder)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for a table written on the way: in the innermost ``scope``, with which it goes, or in the shared folder."""
    return f"{_SCOPES[-1] if _SCOPES else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Hadoop, so that it may lie in any store Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(df: DataFrame) -> str:
    """What a frame computes and from which files: changes when its plan does, or when a file it reads is rewritten."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    digest = hashlib.sha256(f"{spark.sparkContext.applicationId} {df.semanticHash()}".encode())
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}".encode())
    return digest.hexdigest()


def listing(spark: SparkSession, folder: str, names: list[str]) -> str:
    """What files the named tables of a folder have, with sizes and times: another text when one is rewritten, added or gone.

    A table ``<folder>/<name>.parquet`` is a file or a folder of files. Two calls to the file system, however many there are.
    """
    path, found = spark._jvm.org.apache.hadoop.fs.Path, ""
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    tables = f"{folder.rstrip('/')}/{{{','.join(names)}}}.parquet"
    for pattern in (tables, f"{tables}/*"):
        found += spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(files.globStatus(path(pattern)))
    return hashlib.sha256(re.sub(r"access_time=\d+", "", found).encode()).hexdigest()


def write_once(df: DataFrame, label: str, cluster_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return a scan of it. Runs the job when called.

    Cuts the lineage like a reliable checkpoint, but stays columnar: later scans prune columns and push filters down.
    ``cluster_by`` brings rows of the same key together in evenly sized files; adaptive execution splits a key that is
    too large for one file. Inside a ``scope`` the table lives until the scope ends, else as long as the folder does.
    """
    path = work_folder(df.sparkSession, label)
    even = df.hint("rebalance", cluster_by).sortWithinPartitions(cluster_by) if cluster_by else df
    for see in OBSERVERS:
        see(label, even)
    writer = even.write.option("compression", compression) if compression else even.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def dealt_by_one_key(spark: SparkSession) -> Iterator[None]:
    """Inside, joins on several keys take frames as they are if both are dealt out by one of them.

    For bucketed tables, whose buckets are known to be even; elsewhere all keys of a join spread a frequent one.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``write_once``, in buckets by ``key``: what groups or joins by the key afterwards needs no exchange.

    Nor does the write, if ``df`` comes dealt out by the key into as many partitions. A bucket is one task's later: see
    ``sources.buckets`` for their number. Only the session's catalog knows of buckets, so the table is listed there.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    dealt = df.repartition(buckets, key)
    if _SCOPES:
        _TABLES.setdefault(_SCOPES[-1], []).append(name)
    with dealt_by_one_key(spark):
        for see in OBSERVERS:
            see(label, dealt)
        writer = dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd")
        writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def read_tables(spark: SparkSession, folder: str, fmt: str = "parquet", **options: str) -> RetailTables:
    """Read the six input tables from ``folder/<table>`` with fixed schemas (no inference pass).

    For CSV pass ``header="true"``; the bill date stays text, as it arrives in mixed formats.
    """
    return RetailTables(
        **{
            name: spark.read.format(fmt).schema(schema).options(**options).load(f"{folder.rstrip('/')}/{name}")
            for name, schema in SCHEMAS.items()
        }
    )


def write_tables(tables: RetailTables, folder: str, mode: str = "errorifexists") -> RetailTables:
    """Write every table present as ``folder/<table>`` parquet and return scans of the result."""
    written = {}
    for name, df in tables.present().items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(path)
        written[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return RetailTables(**written)


def save_as_tables(tables: RetailTables, database: str = "default", mode: str = "errorifexists") -> None:
    """Save every table in the session catalog under its SQL name."""
    for name, df in tables.present().items():
        df.write.mode(mode).saveAsTable(f"{database}.{SQL_NAMES[name]}")
