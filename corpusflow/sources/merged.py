"""Keyed tables that are merged on reading: a write costs what it brings, whatever the table holds.

A table is a folder of runs and of manifests.  Keys are hashed to buckets; a run is a folder of rows, one a key, by bucket.  A write adds one run of its
rows and a manifest that lists it, so that readers see all of it or nothing.  Readers take each key's row of the newest run; buckets that
lie in one run are read as they are.  Where a bucket has FAN runs of a level, they are merged into one of the next level, so that a row is written
again as often as the logarithm of the table's size says.  Folders that no late manifest lists are removed.

One writer at a time, as a stream is: a manifest's number is taken by creating its file, and a second writer's attempt fails.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import remove

BUCKETS, FAN, LATE = 16, 8, 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.endswith(".json"))


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path))


def _load(spark: SparkSession, path: str, name: str | None = None) -> dict:
    names = [name] if name else _manifests(spark, path)[-1:]
    if not names:
        return {"version": 0, "done": {}, "key": None, "buckets": None, "runs": []}
    fs, p = _fs(spark, f"{path}/manifests/{names[0]}")
    with_ = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
    finally:
        with_.close()
    return json.loads(text)


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    manifest["version"] += 1
    name = f"{path}/manifests/{manifest['version']:012d}.json"
    fs, draft = _fs(spark, f"{name}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final = _fs(spark, name)[1]
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer made version {manifest['version']} of {path}")


def _rows(spark: SparkSession, path: str, runs: list[dict], only: set[int] | None = None) -> DataFrame:
    """The rows of the runs' buckets with ``__seq`` and ``__bucket``."""
    got = None
    for r in runs:
        own = sorted(set(r["buckets"]) & only) if only is not None else r["buckets"]
        if own:
            df = spark.read.option("basePath", f"{path}/runs/{r['folder']}").parquet(*(f"{path}/runs/{r['folder']}/__bucket={b}" for b in own)).withColumn("__seq", F.lit(r["seq"]).cast("long"))
            got = df if got is None else got.unionByName(df, allowMissingColumns=True)
    return got


def _newest(rows: DataFrame, key: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("__seq",)]
    return rows.groupBy("__bucket", F.col(key).alias("__k")).agg(F.max_by(F.struct(*columns), F.col("__seq")).alias("__r")).select("__r.*")


def _write(rows: DataFrame, path: str, folder: str, buckets: int) -> list[int]:
    """Writes rows with ``__bucket`` as a run and returns the buckets that it has."""
    spark = rows.sparkSession
    rows.repartition(buckets, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/runs/{folder}")
    fs, p = _fs(spark, f"{path}/runs/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("__bucket="))


def put(batch: DataFrame, path: str, key: str, order: str, writer: str = "", batch_id: int | None = None, buckets: int = BUCKETS, fan: int = FAN) -> None:
    """Upserts each key's latest row of ``batch``, by ``order``; it takes the place of the key's row whatever that one's order is.

    A ``batch_id`` that its ``writer`` has written is not written again.
    """
    spark = batch.sparkSession
    if clash := {"__seq", "__bucket", "__k", "__r"} & set(batch.columns):
        raise ValueError(f"columns of the table itself: {sorted(clash)}")
    manifest = _load(spark, path)
    if batch_id is not None and manifest["done"].get(writer, -1) >= batch_id:
        return
    manifest["key"], manifest["buckets"] = key, manifest["buckets"] or buckets
    latest = batch.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("__r")).select("__r.*")
    rows = latest.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int"))
    seq = max((r["seq"] for r in manifest["runs"]), default=0) + 1
    folder = f"{seq:012d}-{uuid.uuid4().hex}"
    has = _write(rows, path, folder, manifest["buckets"])
    if has:
        manifest["runs"].append({"folder": folder, "seq": seq, "level": 0, "buckets": has})
    if batch_id is not None:
        manifest["done"][writer] = batch_id
    _commit(spark, path, manifest)
    while compact(spark, path, fan):
        pass
    vacuum(spark, path)


def compact(spark: SparkSession, path: str, fan: int = FAN) -> bool:
    """Merges the runs of the lowest level that some buckets have ``fan`` of, for those buckets; False if there are none."""
    manifest = _load(spark, path)
    count: dict = defaultdict(list)
    for r in manifest["runs"]:
        for b in r["buckets"]:
            count[r["level"], b].append(r)
    full = {k for k, runs in count.items() if len(runs) >= fan}
    if not full:
        return False
    level = min(k[0] for k in full)
    own = {b for lv, b in full if lv == level}
    runs = [r for r in manifest["runs"] if r["level"] == level and own & set(r["buckets"])]
    seq = max(r["seq"] for r in runs)
    folder = f"{seq:012d}-{uuid.uuid4().hex}"
    has = _write(_newest(_rows(spark, path, runs, own), manifest["key"]), path, folder, manifest["buckets"])
    for r in runs:
        r["buckets"] = [b for b in r["buckets"] if b not in own]
    manifest["runs"] = [r for r in manifest["runs"] if r["buckets"]] + [{"folder": folder, "seq": seq, "level": level + 1, "buckets": has}]
    _commit(spark, path, manifest)
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, one a key."""
    manifest = _load(spark, path)
    if not manifest["runs"]:
        raise FileNotFoundError(f"no rows under {path}")
    times: dict[int, int] = defaultdict(int)
    for r in manifest["runs"]:
        for b in r["buckets"]:
            times[b] += 1
    parts = []
    if alone := {b for b, n in times.items() if n == 1}:
        parts.append(_rows(spark, path, manifest["runs"], alone).drop("__seq"))
    if several := {b for b, n in times.items() if n > 1}:
        parts.append(_newest(_rows(spark, path, manifest["runs"], several), manifest["key"]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.drop("__bucket")


def vacuum(spark: SparkSession, path: str, late: int = LATE) -> None:
    """Removes manifests but the last ``late``, and the runs that none of these lists."""
    names = _manifests(spark, path)
    kept = {r["folder"] for n in names[-late:] for r in _load(spark, path, n)["runs"]}
    fs, p = _fs(spark, f"{path}/runs")
    for s in fs.listStatus(p) if fs.exists(p) else ():
        if s.getPath().getName() not in kept:
            remove(spark, str(s.getPath()))
    for n in names[:-late]:
        remove(spark, f"{path}/manifests/{n}")
