"""Panels, small tables and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.operators.checks import require_columns

MANIFEST_COLUMNS = ("dataset_id", "tier", "filename", "md5", "url")


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset_id", "split")) -> DataFrame:
    """Write Parquet partitioned for split pruning, read it back and compare the row counts."""
    from pyspark.sql import Observation

    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*partition_by).option(
        "compression", "snappy").parquet(path)
    back = df.sparkSession.read.parquet(path)
    stored = back.count()
    if stored != seen.get["rows"]:
        raise ValueError(f"wrote {seen.get['rows']} rows but {stored} are stored")
    return back


def read_panel(
    spark: SparkSession, path: str, splits: Sequence[str], columns: Sequence[str], check: bool = True
) -> DataFrame:
    """Only the requested splits (pruned as directories) and columns (pruned in the scan)."""
    needed = list(dict.fromkeys([*columns, "split"]))
    panel = spark.read.parquet(path).where(F.col("split").isin(*splits)).select(*needed)
    if check:
        found = {r["split"] for r in panel.select("split").distinct().collect()}
        if found != set(splits):
            raise ValueError(f"expected splits {sorted(splits)}, found {sorted(found)}")
    return panel.select(*columns)


def read_table_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A typed CSV table with a header; required columns must exist and the table must have rows."""
    table = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    require_columns(table, required)
    if table.isEmpty():
        raise ValueError(f"no rows in {path}")
    return table


def write_table_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; meant for result tables of a few rows per method or series."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def select_manifest(df: DataFrame, names: Sequence[str] = (), tiers: Sequence[str] = ()) -> DataFrame:
    """Manifest rows by dataset name and tier; an unknown name is an error."""
    if names:
        spark = df.sparkSession
        wanted = spark.createDataFrame([(n,) for n in names], "dataset_id string")
        unknown = [r[0] for r in wanted.join(df, "dataset_id", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown dataset_id values: {', '.join(sorted(unknown))}")
        df = df.where(F.col("dataset_id").isin(*names))
    return df.where(F.col("tier").isin(*tiers)) if tiers else df


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """md5, sha256 and size of every file under a folder, by its path below that folder.

    A file's content is one cell, so a file must stay below 2 GB. The root names one folder, no pattern.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    return files.select(
        F.substr("path", F.lit(len(whole) + 2)).alias("path"), F.col("length").alias("size_bytes"),
        F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"),
    )


def diff_digests(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that are changed, missing or new against a recorded inventory."""
    a = current.select("path", F.col("sha256").alias("_now"), F.col("size_bytes").alias("_now_size"))
    b = recorded.select("path", F.col("sha256").alias("_then"), F.col("size_bytes").alias("_then_size"))
    status = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "new")
        .when((F.col("_now") != F.col("_then")) | (F.col("_now_size") != F.col("_then_size")), "changed")
        .otherwise("same")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def _json_text(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def snapshot_id(digests: DataFrame) -> DataFrame:
    """sha256 of the JSON list of (path, sha256, size) records in path order (one entry per file)."""
    record = F.concat(
        F.lit('{"path": '), _json_text(F.col("path")), F.lit(', "sha256": "'), F.col("sha256"),
        F.lit('", "size_bytes": '), F.col("size_bytes").cast("string"), F.lit("}"),
    )
    listed = digests.agg(F.sort_array(F.collect_list(F.struct("path", record.alias("r")))).alias("a"))
    return listed.select(
        F.sha2(F.concat(F.lit("["), F.array_join("a.r", ", "), F.lit("]")), 256).alias("snapshot_id"),
        F.size("a").cast("bigint").alias("files"),
    )
