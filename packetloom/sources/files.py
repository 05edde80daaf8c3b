"""Packet files: CSV and line JSON scans, chunked export with a manifest, and conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.flows import merge_labels
from packetloom.schemas import LABEL_FILE, PACKETS

CHUNK_ROWS = 100_000  # fixed value: rows per exported file
_MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", T.LongType())])


def read_packets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by their names in the header: extra ones are left out, missing ones and values that do not fit are null.
    Files of one folder must share a header; Spark raises an error where they do not."""
    found = _by_header(spark, path)
    return found.select(*[_typed(found, f.name, f.dataType).alias(f.name) for f in PACKETS.fields])


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def _typed(found: DataFrame, name: str, kind: T.DataType) -> Column:
    return F.col(f"`{name}`").try_cast(kind) if name in found.columns else F.lit(None).cast(kind)


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """The index column has the name of an unnamed one, or none at all."""
    found = _by_header(spark, path)
    index, label = LABEL_FILE.fields
    name = index.name if index.name in found.columns else "_c0"
    return found.select(
        _typed(found, name, index.dataType).alias("packet_index"), _typed(found, label.name, label.dataType).alias("label")
    )


def load_and_merge(spark: SparkSession, packets_csv: str, labels_csv: str) -> DataFrame:
    packets = read_packets_csv(spark, packets_csv).drop("label")
    return merge_labels(packets, read_labels_csv(spark, labels_csv))


def read_packets_json(spark: SparkSession, *paths: str, keep_corrupt: bool = False) -> DataFrame:
    """Blank and unreadable lines are left out; with keep_corrupt the unreadable ones are rows with their text."""
    schema = PACKETS
    reader = spark.read.option("mode", "DROPMALFORMED")
    if keep_corrupt:
        reader = reader.option("mode", "PERMISSIVE")
        schema = T.StructType([*PACKETS.fields, T.StructField("_corrupt_record", T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema).json(list(paths))


def write_packets_json(packets: DataFrame, path: str, rows_per_file: int = CHUNK_ROWS) -> str:
    packets.write.option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)
    return path


def export_manifest(spark: SparkSession, data_path: str) -> DataFrame:
    """One row per file of an export with its row count."""
    return (
        read_packets_json(spark, data_path)
        .groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
        .agg(F.count("*").alias("rows"))
    )


def export_summary(manifest: DataFrame) -> DataFrame:
    """Rows, files, rows of the largest file and columns of an export."""
    return manifest.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("num_files"),
        F.max("rows").alias("largest"),
        F.lit([f.name for f in PACKETS.fields]).alias("columns"),
    )


def write_manifest(manifest: DataFrame, path: str) -> str:
    manifest.write.json(path)
    return path


def read_by_manifest(spark: SparkSession, data_path: str, manifest_path: str) -> DataFrame:
    # names only, the list Spark keeps of any scan
    files = spark.read.schema(_MANIFEST).json(manifest_path).select("file").collect()
    if not files:
        raise FileNotFoundError(f"no files listed in the manifest at {manifest_path}")
    return read_packets_json(spark, *[f"{data_path}/{row[0]}" for row in files])


def first_rows(packets: DataFrame, max_rows: int | None) -> DataFrame:
    return packets if max_rows is None else packets.orderBy("packet_index").limit(max_rows)


def convert(
    spark: SparkSession, packets_csv: str, labels_csv: str, out: str, max_rows: int | None = None,
    rows_per_file: int = CHUNK_ROWS,
) -> DataFrame:
    """CSV pair to labelled line JSON; returns the manifest that was written next to it."""
    merged = first_rows(load_and_merge(spark, packets_csv, labels_csv), max_rows)
    write_packets_json(merged, f"{out}/packets", rows_per_file)
    write_manifest(export_manifest(spark, f"{out}/packets"), f"{out}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{out}/manifest")
