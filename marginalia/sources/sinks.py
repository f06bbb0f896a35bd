"""Sinks: fixed-field CSV with nested values as JSON, versioned tables, append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import shared_root


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """The given fields in order; missing ones and nulls are empty, nested values are JSON text."""
    kinds = dict(df.dtypes)
    cell = lambda n: F.lit("") if n not in kinds else F.to_json(n) if kinds[n].startswith(("array", "map", "struct")) else F.coalesce(F.col(n).cast("string"), F.lit(""))
    df.select(*[cell(n).alias(n) for n in fields or df.columns]).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside, then rename: readers see the old table or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_index(df: DataFrame, path: str, key: str) -> None:
    """An index snapshot in the order of its key, so readers can skip by it."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def evidence_tables(spark, tables: dict[str, DataFrame], name: str) -> dict[str, str]:
    """Each table of a model in a folder of its own below the shared root; returns the places."""
    places = {}
    for table, df in tables.items():
        places[table] = f"{shared_root(spark)}/{name}/{table}"
        replace_table(df, places[table])
    return places
