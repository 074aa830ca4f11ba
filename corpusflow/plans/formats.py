"""Queries over file formats and streams: a given table is written under the shared folder and read back, or streamed from there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans.registry import query, table
from corpusflow.session import checkpoint_dir, stored
from corpusflow.sources import files
from corpusflow.streaming import ops


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


_HASHED = "SELECT doc_id, source, md5(text) AS h FROM documents"


@query(_HASHED)
def src1_jsonl(spark, sf_dir):
    path = _folder(spark, "jsonl")
    _texts(spark, sf_dir).write.json(path)
    return files.read_jsonl(spark, path, "doc_id long, source string, text string").select("doc_id", "source", F.md5("text").alias("h"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'bad' ELSE source END AS what FROM documents")
def src2_jsonl_tolerant(spark, sf_dir):
    path = _folder(spark, "jsonl")
    broken = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "source": "x'))
    line = F.when(F.col("doc_id") % 10 == 0, broken).otherwise(F.to_json(F.struct("doc_id", "source", "text")))
    _texts(spark, sf_dir).select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path)
    good, bad = files.read_jsonl_tolerant(spark, path, "doc_id long, source string")
    return good.select("doc_id", F.col("source").alias("what")).union(bad.select(F.regexp_extract("value", r"([0-9]+)", 1).cast("long"), F.lit("bad")))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def src3_json_array(spark, sf_dir):
    path = _folder(spark, "arrays")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_nationkey").alias("file"))
    one = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey"))).alias("value"))  # a file is one list
    one.write.partitionBy("file").text(path)
    kinds = {c: table(spark, sf_dir, "supplier").schema[c].dataType.simpleString() for c in ("s_suppkey", "s_name", "s_nationkey")}
    return files.read_json_array(spark, path, ", ".join(f"{c} {k}" for c, k in kinds.items())).select(*kinds)


@query(_HASHED)
def src4_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    files.write_csv(_texts(spark, sf_dir).select("doc_id", "source", "text"), path)
    return files.read_csv(spark, path, "doc_id long, source string, text string").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"))


@query("SELECT DISTINCT source AS id FROM documents")
def src5_id_list(spark, sf_dir):
    path = _folder(spark, "ids")
    padded = F.concat(F.lit(" "), F.col("source"), F.lit(" "))
    _texts(spark, sf_dir).select(F.explode(F.array(padded, F.lit(""))).alias("value")).write.text(path)
    return files.read_id_list(spark, path)


@query("SELECT 'set=' || lang || ' +1 %' AS eval_set, count(*) AS n, true AS named FROM documents GROUP BY lang")
def src6_key_from_path(spark, sf_dir):
    path = _folder(spark, "keys")
    rows = _texts(spark, sf_dir).select(F.concat("lang", F.lit(" +1 %")).alias("set"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    rows.write.partitionBy("set").text(path)
    found = files.key_from_path(spark.read.option("basePath", path).text(path))
    return found.groupBy(F.regexp_replace("eval_set", "%25", "%").alias("eval_set")).agg(F.count("*").alias("n"), F.every(F.col("id").startswith("part-")).alias("named"))


@query("SELECT doc_id, source, 1 + CAST(doc_id % 2 = 0 AS BIGINT) AS versions FROM documents")
def src7_snapshot(spark, sf_dir):
    path, rows = _folder(spark, "snapshot"), _texts(spark, sf_dir).select("doc_id", "source")
    files.write_snapshot(rows.where("doc_id % 2 = 0"), path)
    files.write_snapshot(rows, path, dry_run=True)
    files.write_snapshot(rows, path)
    both = files.read_snapshot(spark, path).union(files.read_snapshot(spark, path, 1))
    return both.groupBy("doc_id", "source").agg(F.count("*").alias("versions"))


@query("SELECT doc_id, source FROM documents")
def src11_restore_if_empty(spark, sf_dir):
    path, rows = _folder(spark, "snapshot"), _texts(spark, sf_dir).select("doc_id", "source")
    files.write_snapshot(rows, path)
    restored = files.restore_if_empty(rows.where("doc_id is null"), files.read_snapshot(spark, path))
    return files.restore_if_empty(restored, rows.where("doc_id is null"))


# streams


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a stream of files under the shared folder."""
    path = _folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _ran(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there."""
    spark = stream.sparkSession
    path = _folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").start(path)
    else:  # all files are one batch, so the last batch has everything
        run = writer.foreachBatch(lambda batch, i: batch.write.mode("append" if mode == "update" else "overwrite").parquet(path)).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema(stream.schema).parquet(path)


_TURNS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations"


@query(f"WITH t AS ({_TURNS}) SELECT b.conv_id, CAST(2 AS INTEGER) AS held, md5(a.role || ':' || a.text || '|' || b.role || ':' || b.text) AS h FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.i = a.i + 1 JOIN t c ON c.conv_id = a.conv_id AND c.i = a.i + 3 WHERE a.i % 2 = 1")
def str1_session_memory(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = _ran(ops.session_memory(_streamed(rows, "turns"), "conv_id", "turn", "role", "text"), "memory")
    said = F.transform(F.from_json("compressed", "array<array<string>>"), lambda x: F.concat_ws(":", x[0], x[1]))
    return out.select("conv_id", "held", F.md5(F.array_join(said, "|")).alias("h"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id FROM events")
def str3_dedup_stream(spark, sf_dir):
    return _ran(ops.dedup_stream(_streamed(_events(spark, sf_dir), "events"), "user_id", "ts"), "dedup").select("user_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS bytes, round(sum(value), 4) AS ms FROM events GROUP BY 1")
def str4_cache_counters(spark, sf_dir):
    return _ran(ops.cache_counters(_streamed(_events(spark, sf_dir), "events"), "event_type", F.col("event_id"), "value"), "counters", "complete")


_REQ = "SELECT event_id, user_id % 40 AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch(ts), event_id) AS i FROM events"


@query(f"""WITH RECURSIVE q AS MATERIALIZED ({_REQ}), f AS (SELECT key, i, event_id, t AS w, false AS hit FROM q WHERE i = 1 UNION ALL
SELECT q.key, q.i, q.event_id, CASE WHEN q.t < f.w + 14400 THEN f.w ELSE q.t END, q.t < f.w + 14400 FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1) SELECT event_id, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS status FROM f""")
def str5_ttl_cache(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 40).alias("key"), F.col("ts").cast("double").alias("t"), "ts")
    return _ran(ops.ttl_cache(_streamed(rows, "requests").withWatermark("ts", "1 hour"), "key", "t", "event_id", 14400, ts="ts"), "cache").select("event_id", "status")


@query()
def str6_token_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.split("text", "(?<= )").alias("tokens"))
    # counted beside posexplode, the tokens would be split anew for each of them
    rows = rows.select("key", "tokens", F.size("tokens").alias("n")).select("key", "n", F.posexplode("tokens").alias("seq", "token"))
    rows = rows.select("key", "seq", "token", (F.col("seq") == F.col("n") - 1).alias("final"))
    return _ran(ops.token_chunks(_streamed(rows, "tokens"), "key", "seq", "token", "final"), "chunks")


@query("""WITH e AS (SELECT user_id, epoch(ts) AS t, event_type AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('view', 'purchase', 'click')),
p AS (SELECT *, last_value(CASE WHEN k = 'view' THEN t END IGNORE NULLS) OVER w AS opened, max(CASE WHEN k = 'view' THEN i END) OVER w AS since, max(CASE WHEN k <> 'view' THEN i END) OVER w AS closed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, CAST(opened AS DOUBLE) AS response_start, CAST(t AS DOUBLE) AS interrupted_at FROM p WHERE k = 'click' AND since IS NOT NULL AND since > coalesce(closed, 0)""")
def str7_barge_in(spark, sf_dir):
    kind = F.create_map(*map(F.lit, ("view", "response_start", "purchase", "response_end", "click", "speech_start")))[F.col("event_type")]
    order = F.concat(F.lpad(F.unix_micros("ts").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = _events(spark, sf_dir).select("user_id", kind.alias("kind"), F.col("ts").cast("double").alias("t"), order.alias("o")).where("kind is not null")
    return _ran(ops.barge_in(_streamed(rows, "speech"), "user_id", "o", "kind", "t"), "interrupted")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'click' AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events WHERE event_type IN ('click', 'purchase')),
p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY i) AS p FROM e), k AS (SELECT *, sum(CASE WHEN s AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS k FROM p)
SELECT user_id, CAST(min(t) AS DOUBLE) AS start_ms, CAST(min(CASE WHEN NOT s THEN t END) AS DOUBLE) AS end_ms FROM k WHERE k > 0 GROUP BY user_id, k HAVING min(CASE WHEN NOT s THEN t END) - min(t) >= 250""")
def str8_speech_segments(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end")
    order = F.concat(F.lpad(F.unix_micros("ts").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = _events(spark, sf_dir).select("user_id", kind.alias("kind"), F.unix_millis("ts").cast("double").alias("t"), order.alias("o")).where("kind is not null")
    return _ran(ops.speech_segments(_streamed(rows, "voice"), "user_id", "o", "kind", "t"), "segments")


@query("SELECT user_id, round(epoch(min(ts)) - 1704067200, 4) AS seconds FROM events GROUP BY 1")
def str9_first_chunk_latency(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", F.timestamp_seconds(F.lit(1704067200)).alias("started"))
    out = _ran(ops.first_chunk_latency(_streamed(rows, "events"), "user_id", "ts", "started"), "latency", "update")
    return out.select("user_id", F.round("seconds", 4).alias("seconds"))


@query("SELECT user_id, coalesce(max(event_id) FILTER (event_id % 3 <> 0), max(event_id)) AS event_id, true AS found FROM events GROUP BY 1")
def str10_incremental_upsert(spark, sf_dir):
    path, inbox, rows = _folder(spark, "upserts"), _folder(spark, "inbox"), table(spark, sf_dir, "events").select("user_id", "event_id")
    for part in (rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0")):  # the second run goes on where the first ended
        part.write.mode("append").parquet(inbox)
        run = ops.incremental_upsert(spark.readStream.schema(rows.schema).parquet(inbox), path, f"{path}-checkpoint", "user_id", "event_id")
        run.awaitTermination()
    return files.read_snapshot(spark, path).select("user_id", "event_id", F.lit(True).alias("found"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS value FROM documents")
def str11_keep_old_on_error(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).alias("new"))
    return rows.select("doc_id", ops.keep_old_on_error(F.col("new"), F.col("lang")).alias("value"))


@query("SELECT conv_id, turn, md5(text) AS h FROM conversations")
def src10_stream_ndjson(spark, sf_dir):
    path = _folder(spark, "ndjson")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    table(spark, sf_dir, "conversations").select(F.explode(F.array(line, F.lit(""), F.lit("not json"))).alias("value")).write.text(path)
    return _ran(files.stream_ndjson(spark, path, "conv_id long, turn long, text string"), "parsed").select("conv_id", "turn", F.md5("text").alias("h"))
