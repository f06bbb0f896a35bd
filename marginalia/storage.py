"""Shared storage for intermediate tables, and column picking that survives odd schemas.

Lineage is cut by writing a table in the folder every executor can reach
(``spark.checkpoint.dir``), never on a machine's own disk.  Folders made here
are removed when the driver's JVM ends.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.shipping import ship

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine may do without the setting, a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_ROOT).rstrip("/")


def place_of(names: list[str], name: str) -> int:
    """The first place of ``name`` among columns: exactly, else ignoring case."""
    found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"column {name!r} is missing; there are {names}")
    return found[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root, with its scheme, removed when the driver ends."""
    ship(spark)
    path = f"{shared_root(spark)}/marginalia/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    whole = fs.makeQualified(hpath).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)


def remove_folder(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def cut(df: DataFrame, label: str, folder: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = folder or new_folder(spark, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *keep: Column, **columns: str) -> DataFrame:
    """Select columns by exact name (else ignoring case) and cast them.

    Works by position, so further columns with equal names, or names that
    differ in case only, do no harm: the first exact match is taken.
    """
    ship(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(names))])
    out = []
    for name, kind in columns.items():
        out.append(F.col(f"__c{place_of(names, name)}").cast(kind).alias(name))
    return flat.select(*out, *keep)


class Rows:
    """A frame whose rows have a key: their place in their file.

    The place stays the same whenever the rows are read again.  Frames that
    don't come from files are written to the shared folder first.  Columns have
    plain names, so that any names and repetitions do no harm.
    """

    key = ("__file", "__row")

    def __init__(self, df: DataFrame):
        ship(df.sparkSession)
        self.names = df.columns
        plain = [f"__c{i}" for i in range(len(self.names))]
        place = [F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row")]
        try:
            keyed = df.select(*place, *[F.col(f"`{n}`") for n in self.names])
            keyed.schema  # resolves all names, or raises
        except AnalysisException:
            keyed = cut(df.toDF(*plain), "rows").select(*place, *plain)
        self.frame = keyed.toDF(*self.key, *plain)

    @classmethod
    def of(cls, df: DataFrame | Rows) -> Rows:
        return df if isinstance(df, cls) else cls(df)

    def at(self, name: str) -> str:
        """The plain name of the column that carries ``name``: exactly, else ignoring case."""
        return f"__c{place_of(self.names, name)}"

    def pick(self, **columns: str) -> DataFrame:
        """The key and the named columns, cast."""
        return self.frame.select(*self.key, *[F.col(self.at(n)).cast(kind).alias(n) for n, kind in columns.items()])

    def restored(self, df: DataFrame) -> DataFrame:
        """``df``, a frame with the plain names, under the names that came in."""
        return df.select(*[F.col(f"__c{i}") for i in range(len(self.names))]).toDF(*self.names)

    def only(self, kept: DataFrame) -> DataFrame:
        """The rows whose key is in ``kept``, as they came in."""
        return self.restored(self.frame.join(kept.select(*self.key), list(self.key), "left_semi"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
