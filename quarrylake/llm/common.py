"""Session and storage helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column id table that may be broadcast (some 50 bytes each in a hashed relation, so 100 MB at most).
BROADCAST_ROWS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all of Spark runs in one
    process, as in tests, a temporary folder is made and remembered for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, what: str, by: str | None = None) -> DataFrame:
        """Like :func:`materialize`, in one folder for each value of a column if asked."""
        path = fresh_path(self.spark, what)
        df.write.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)  # the table is held, so its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if found := self.paths.pop(id(table), None):
                delete_path(self.spark, found[0])

    def drop_all(self, *needed: DataFrame) -> None:
        """Delete all but the files that the given tables are read from."""
        wanted = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for table in needed for f in table.inputFiles()}
        for key, (path, _) in list(self.paths.items()):
            if path.split(":", 1)[-1].lstrip("/") not in wanted:
                del self.paths[key]
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table whose counted rows are within the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a table of large rows is made: at most so many rows in an Arrow batch, then as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
