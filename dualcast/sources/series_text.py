"""Series text files: attribute header, then one colon-separated line per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.operators.ranking import global_rank

# the printable characters that Windows-1252 puts on bytes 0x80-0x9F, taken from the codec itself
_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", errors="ignore")]
_LATIN = "".join(chr(b) for b in _BYTES)
_CP1252 = "".join(bytes([b]).decode("cp1252") for b in _BYTES)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file and an order inside the file that survives file splitting."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("raw"),
    )


def detect_encoding(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per file: UTF-8 when every line is valid, else Windows-1252."""
    return _lines(spark, path).groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("raw")), "utf-8").otherwise("cp1252").alias("encoding")
    )


def decode_line(raw: Column, encoding: Column) -> Column:
    """Text of a raw line under the encoding found for its file."""
    legacy = F.translate(F.decode(raw.cast("binary"), "iso-8859-1"), _LATIN, _CP1252)
    return F.when(encoding == "cp1252", legacy).otherwise(raw)


def parse_timestamp(text: Column) -> Column:
    """Wall-clock time from ``yyyy-MM-dd HH-mm-ss`` or an ISO text; anything else is an error."""
    hyphens = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH-mm-ss")).cast("timestamp_ntz")
    hyphen_form = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2}$")
    return F.when(hyphen_form, hyphens).otherwise(text.cast("timestamp_ntz"))


def read_series_text(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Series rows and file metadata.

    Rows: ``file, source_order, attributes, declared, parts, series_value``; metadata: one row per file
    with a map of the header values, the declared attributes and the encoding.
    """
    encodings = detect_encoding(spark, path)
    lines = _lines(spark, path).join(encodings, "file").withColumn("line", F.trim(decode_line(F.col("raw"), F.col("encoding"))))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).drop("raw")
    place = F.struct("_at", "_line")
    starts = lines.where(F.lower("line") == "@data").groupBy("file").agg(F.min(place).alias("_data"))
    placed = lines.join(starts, "file", "left")
    header = placed.where(F.col("line").startswith("@") & (F.col("_data").isNull() | (place < F.col("_data"))))
    words = F.split("line", r"\s+", 3)
    value = F.regexp_extract("line", r"^@\S+\s+(.*)$", 1)
    is_attribute = F.lower("line").startswith("@attribute")
    key = F.lower(F.regexp_extract("line", r"^@(\S+)", 1))
    setting = F.when(value == "", "true").when(F.lower(value).isin("true", "false"), F.lower(value)).otherwise(value)
    # a header has a handful of lines per file
    metadata = header.groupBy("file", "encoding").agg(
        F.sort_array(F.collect_list(F.when(is_attribute, F.struct(
            place.alias("p"), words[1].alias("name"), F.lower(words[2]).alias("kind"))))).alias("_attributes"),
        F.map_from_entries(F.array_distinct(F.sort_array(F.collect_list(
            F.when(~is_attribute, F.struct(key.alias("k"), setting.alias("v"))))))).alias("settings"),
        F.max("_data").isNotNull().alias("has_data"),
    ).select(
        "file", "encoding", "settings", "has_data",
        F.transform("_attributes", lambda a: F.struct(a["name"].alias("name"), a["kind"].alias("kind"))).alias("declared"),
    )
    rows = placed.where(place > F.col("_data")).join(metadata.select("file", "declared"), "file")
    rows = rows.withColumn("parts", F.split("line", ":"))
    values = F.transform(
        F.split(F.element_at("parts", -1), ","), lambda x: F.when(F.trim(x) != "?", F.trim(x).cast("double"))
    )
    well_formed = F.size("parts") == F.size("declared") + 1
    names = F.transform("declared", lambda a: a["name"])
    place = ["file", "_at", "_line"]
    ordered = rows.join(global_rank(rows.select(*place), [F.col(c) for c in place], "source_order"), place)
    return ordered.select(
        "file", "source_order", "declared", "line",
        F.when(well_formed, F.map_from_arrays(names, F.slice("parts", F.lit(1), F.size("declared")))).alias("attributes"),
        F.when(well_formed, values).alias("series_value"),
    ), metadata


def row_problem() -> Column:
    """Why a series row cannot be used, or null."""
    empty = (F.size("series_value") == 0) | ~F.exists("series_value", lambda x: x.isNotNull())
    return F.when(F.col("attributes").isNull(), "field count").when(empty, "empty or all missing")


def validate_series_rows(rows: DataFrame, mode: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """``fail`` raises on the first bad row as it is read; ``quarantine`` returns good and bad rows."""
    checked = rows.withColumn("problem", row_problem())
    if mode == "quarantine":
        return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())
    message = F.concat_ws(" ", F.lit("malformed series row:"), "problem", F.lit("in"), "file")
    return checked.withColumn(
        "series_value", F.when(F.col("problem").isNull(), F.col("series_value")).otherwise(F.raise_error(message).cast("array<double>"))
    ).drop("problem")


def require_data(metadata: DataFrame) -> DataFrame:
    """The metadata itself, or an error when a file has no data section."""
    if not metadata.where(~F.col("has_data")).isEmpty():
        raise ValueError("a file has no @data section")
    return metadata


def to_long(rows: DataFrame, dataset_id: str, step: str | None = "hour") -> DataFrame:
    """One row per observation: 0-based index, and the timestamp when the file declares a start."""
    has_name = F.map_contains_key("attributes", "series_name")
    series_id = F.when(has_name, F.element_at("attributes", "series_name")).otherwise(
        F.format_string("series_%06d", F.col("source_order"))
    )
    flat = rows.select(
        F.lit(dataset_id).alias("dataset_id"), series_id.alias("series_id"), "source_order",
        F.try_element_at("attributes", F.lit("series_type")).alias("series_type"),
        F.try_element_at("attributes", F.lit("start_timestamp")).alias("_start"),
        F.posexplode("series_value").alias("time_index", "value"),
    ).withColumn("time_index", F.col("time_index").cast("bigint"))
    stamp = F.lit(None).cast("timestamp_ntz")
    if step:
        offset = F.make_dt_interval(**{f"{step}s": F.col("time_index").cast("int")})
        stamp = parse_timestamp(F.col("_start")) + offset
    return flat.withColumn("timestamp", stamp).drop("_start")


def write_series_text(panel: DataFrame, path: str, file: Column, header: Sequence[str], start: Column) -> None:
    """Write a panel as series text, one file per value of ``file``; ``start`` is the series' first timestamp text."""
    rows = panel.withColumn("_file", file).groupBy("_file", "series_id").agg(
        F.min("timestamp").alias("timestamp"),
        F.sort_array(F.collect_list(F.struct("time_index", F.coalesce(F.col("value").cast("string"), F.lit("?")).alias("v")))).alias("_v"),
    )
    line = F.concat_ws(":", "series_id", start, F.array_join("_v.v", ","))
    data = rows.select(F.col("_file").alias("file"), F.lit(len(header)).alias("ord"), F.col("series_id").alias("key"), line.alias("value"))
    heads = rows.select(F.col("_file").alias("file")).distinct().select(
        "file", F.posexplode(F.array(*[F.lit(h) for h in header])).alias("ord", "value")
    ).select("file", "ord", F.lit("").alias("key"), "value")
    lines = heads.unionByName(data)
    lines.repartition("file").sortWithinPartitions("file", "ord", "key").select("file", "value").write.mode(
        "overwrite").partitionBy("file").text(path)
