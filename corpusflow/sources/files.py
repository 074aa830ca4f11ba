"""Reading and writing the file formats of corpus work, by any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.sources import csv, merged


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad lines with their text."""
    fields = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    is_bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    return parsed.where(~is_bad).select(*(F.col("j").getField(f.name).alias(f.name) for f in fields.fields)), parsed.where(is_bad).select("value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON list of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; strings unless a schema is given.  Line breaks may stand in quotes, and large files are still split."""
    return csv.read(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> None:
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def read_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id a line; blanks are skipped, each id once."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def path_key(path: Column | None = None) -> tuple[Column, Column]:
    """The stem of the input file's name and the name of its folder."""
    # Spark percent-encodes the paths it reads; only a plus sign stands for itself there
    p = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))) if path is None else path
    return F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("eval_set")


def key_from_path(df: DataFrame) -> DataFrame:
    """``df``, read from files, with id (file stem) and eval_set (folder)."""
    return df.select("*", *path_key())


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under a snapshot folder, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n[:2] == "v=" and n[2:].isdigit()]
    return sorted(v for v in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/_SUCCESS")))


def write_snapshot(df: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """Write a new version beside the old ones, which stay as backups; readers see it once it is complete.

    A dry run writes nothing and returns the counts only.
    """
    spark = df.sparkSession
    have = snapshot_versions(spark, path)
    old = read_snapshot(spark, path).count() if have else 0
    version = (have[-1] if have else 0) + 1
    if not dry_run:
        df.write.mode("overwrite").parquet(f"{path}/v={version}")
        df = spark.read.schema(df.schema).parquet(f"{path}/v={version}")  # counts what was written
    return {"before": old, "after": df.count(), "version": version}


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    if version is None and merged.is_table(spark, path):
        return merged.read(spark, path)
    have = snapshot_versions(spark, path)
    if not have:
        raise FileNotFoundError(f"no complete snapshot under {path}")
    return spark.read.parquet(f"{path}/v={version or have[-1]}")


def restore_if_empty(target: DataFrame, snapshot: DataFrame, force: bool = False) -> DataFrame:
    """The snapshot's rows if the target is empty or ``force`` is set, else the target's."""
    return snapshot if force or target.isEmpty() else target


def stream_ndjson(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A stream of JSON lines from a folder; blank and invalid lines are dropped."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(path).where("trim(value) <> ''").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))
    fields = rows.schema["j"].dataType.names
    return rows.where(F.col("j").isNotNull() & F.coalesce(*(F.col("j").getField(f).cast("string") for f in fields)).isNotNull()).select("j.*")
