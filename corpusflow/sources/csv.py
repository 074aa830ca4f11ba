"""CSV with line breaks inside quotes, read by all tasks of a file.

A file is read as lines, by splits.  The quotes in each split say, summed up over the splits before it, whether it begins inside a quoted value; with that each
task puts the lines of its splits together to records.  What a split begins or ends with in the middle of a record, two rows a split, is put
together across splits.  Quotes stand around whole values and are doubled inside them, as writers do; a lone quote in an unquoted value isn't such a file.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.session import stored

_PIECES = "file string, block long, place long, kind string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _records(odd: frozenset):
    """Whole records of each split, the rest of one that began before it (``head``) and the beginning of one that goes on (``tail``)."""

    def run(batches):
        at, inside, held, first, place, out = None, False, [], True, 0, []

        def end():
            if at is not None and (held or (inside and first)):
                out.append((*at, place, "head" if first and at in odd else "tail", "\n".join(held)))

        for b in batches:
            if not b.num_rows:
                continue
            files, blocks, values = (b.column(i).to_pylist() for i in range(3))
            quotes = pc.count_substring(pc.fill_null(b.column(2), ""), '"').to_numpy(zero_copy_only=False)
            for file, block, value, n in zip(files, blocks, values, (quotes & 1).tolist()):
                if (file, block) != at:
                    end()
                    at, held, first, place = (file, block), [], True, 0
                    inside = at in odd
                held.append(value)
                inside ^= bool(n)
                if not inside:
                    kind = "head" if first and at in odd else "whole"
                    out.append((*at, place, kind, "\n".join(held)))
                    held, first, place = [], False, place + 1
            if len(out) >= 4096:
                yield _batch(out)
        end()
        if out:
            yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], ["file", "block", "place", "kind", "text"])
    out.clear()
    return got


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text): the records of CSV files, headers included; block and place are their order in a file."""
    lines = _lines(spark, path)
    quotes = lines.groupBy("file", "block").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)) % 2  # a row a split
    odd = frozenset((r["file"], r["block"]) for r in quotes.withColumn("odd", before).where("odd = 1").select("file", "block").collect())
    pieces = stored(lines.mapInArrow(_records(odd), _PIECES), "csv")
    broken = pieces.where("kind <> 'whole'")
    # a record is the tail that it begins with and the heads up to the next one; splits in the middle of it are heads too
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail", "place")
    begun = broken.withColumn("of", F.last(F.when(F.col("kind") == "tail", F.struct("block", "place")), ignorenulls=True).over(order))
    whole = begun.groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    columns = ("file", "block", "place", "text")
    return pieces.where("kind = 'whole'").select(*columns).unionByName(whole.select("file", "of.block", "of.place", "text"))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with a header each; strings unless a schema is given."""
    text = records(spark, path)
    head = ((F.col("block") == 0) & (F.col("place") == 0))
    options = {"escape": '"', "mode": "PERMISSIVE"}
    if schema is None:
        first = text.where(head).orderBy("file").select("text").first()  # a row a file
        names = spark.read.option("escape", '"').csv(spark.sparkContext.parallelize([first["text"].rstrip("\r")], 1)).first() if first else []
        schema = ", ".join("`" + (n or f"_c{i}").replace("`", "``") + "` string" for i, n in enumerate(names))
    parsed = text.where(~head).where("trim(text) <> ''").select(F.from_csv(F.regexp_replace("text", "\r$", ""), schema, options).alias("r"))
    return parsed.select("r.*")
