"""Text sources and sinks: JSON lines, JSON arrays, CSV, prompt files, manifests, and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """rows as files of one JSON array each, one for each partition."""

    def gathered(batches):
        import pyarrow as pa

        said = [x for b in batches for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"[{','.join(said)}]"])], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns))).mapInArrow(gathered, "value string").write.mode(mode).text(path)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, quoted line breaks and perhaps a byte order mark: all strings, blank for null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_long_chunks(spark: SparkSession, path: str, columns: list[str], least: int = 150, size: str = "char_count") -> DataFrame:
    return read_csv_strings(spark, path, columns).where(F.col(size).cast("int") >= least)


def read_prompt(spark: SparkSession, path: str, required: tuple[str, ...] = ("System", "User template")) -> dict[str, str]:
    """The sections of a Markdown prompt file by their ## headings; ValueError if a required one lacks."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"(?m)^## ").alias("parts"))
    rows = text.select(F.explode(F.slice("parts", 2, 1000)).alias("p")).select(F.trim(F.substring_index("p", "\n", 1)).alias("name"), F.trim(F.expr("substr(p, instr(p, '\n') + 1)")).alias("text")).collect()
    found = {r["name"]: r["text"].strip() for r in rows}
    if missing := [n for n in required if n not in found]:
        raise ValueError(f"prompt lacks {missing}")
    return found


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys in order."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    rows.select(*(fields or rows.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def read_manifests(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Manifests under a glob pattern with their folder; files that are no JSON are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(pattern)
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).where("_broken IS NULL").drop("_broken")
