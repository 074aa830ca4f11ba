"""Vector and term search over whole query sets, reranking, contexts, cache keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import ColumnLike, col, strip, tokens
from corpusflow.operators import ordered
from corpusflow.operators.vector_blocks import best_of, grouped_topk
from corpusflow.session import stored

#: Query vectors go to the tasks in blocks of at most this many; more queries, more passes over the chunks.
QUERY_BLOCK = 20_000
#: Terms of queries, each counted for its query, that go to the tasks at once; scores, and words of documents, that a task holds at once.
TERM_BLOCK, SCORED_CELLS = 500_000, 500_000


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: ColumnLike) -> Column:
    """The vector divided by its length, in doubles; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def top_ranked(scored: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The best ``k`` rows of each key with their rank, by score and then the tie column."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(asked: DataFrame, block: int):
    """The rows of a stated query set, a column q among them, in blocks of about ``block`` rows, one after the other on the driver."""
    parts = -(-asked.count() // block)
    for i in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)).toPandas()
        if len(rows):
            yield rows


def _over_blocks(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def vector_scan(queries: DataFrame, chunks: DataFrame, keep, query_id: str, query_vec: str, chunk_id: str, chunk_vec: str, schema: str, digits: int = 6, block: int = QUERY_BLOCK, group: tuple[str, str] | None = None) -> DataFrame:
    """What ``keep(score matrix, chunk ids)`` leaves of the cosines of a block of queries and a batch of chunks: rows (query number, columns of ``schema`` after the first).

    The query set is stated and goes to the tasks in blocks; each task multiplies its chunks with a block.  Rows without a vector are left
    out.  With ``group``, columns of the queries and the chunks, pairs of different groups score minus infinity.
    """
    of = [F.lit(0), F.lit(0)] if group is None else [F.col(c) for c in group]
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("v"), of[0].alias("g")).where("v is not null")
    rows = chunks.select(F.col(chunk_id).alias("c"), F.col(chunk_vec).alias("v"), of[1].alias("g")).where("v is not null")
    return _over_blocks([rows.mapInPandas(_scanned(b, keep, digits), schema) for b in _blocks(asked, block)], queries.sparkSession, schema)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, query_vec: str, chunk_id: str, chunk_vec: str, digits: int = 6, block: int = QUERY_BLOCK, group: tuple[str, str] | None = None) -> DataFrame:
    """The ``k`` chunks with the highest cosine for each query, of its own ``group`` where that is given: query, chunk, score, rank.

    Each batch keeps its best ``k`` a query, and each task the best of its batches; k rows a query and task are shuffled, not every pair.
    """
    q_kind, c_kind = queries.schema[query_id].dataType.simpleString(), chunks.schema[chunk_id].dataType.simpleString()

    def best(score, own):
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(own, kind="stable")] = np.arange(len(own))
        q, c = best_of(score, rank, k)
        return q, own[c], score[q, c]

    found = vector_scan(queries, chunks, best, query_id, query_vec, chunk_id, chunk_vec, f"{query_id} {q_kind}, {chunk_id} {c_kind}, score double", digits, block, group)
    return top_ranked(found, query_id, "score", chunk_id, k)


def vector_at_least(queries: DataFrame, chunks: DataFrame, least: float, query_id: str, query_vec: str, chunk_id: str, chunk_vec: str, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """Every pair of a query and a chunk with a cosine of at least ``least``: query, chunk, score."""
    q_kind, c_kind = queries.schema[query_id].dataType.simpleString(), chunks.schema[chunk_id].dataType.simpleString()

    def good(score, own):
        q, c = np.nonzero(score >= least)
        return q, own[c], score[q, c]

    return vector_scan(queries, chunks, good, query_id, query_vec, chunk_id, chunk_vec, f"{query_id} {q_kind}, {chunk_id} {c_kind}, score double", digits, block)


def vector_summary(queries: DataFrame, chunks: DataFrame, query_id: str, query_vec: str, chunk_id: str, chunk_vec: str, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """Per query over all chunks but the one of its own id: n, total, least and best of the cosines."""
    q_kind = queries.schema[query_id].dataType.simpleString()

    def summed(score, own, ids):
        other = ids[:, None] != own[None, :]
        n = other.sum(axis=1)
        some = n > 0
        low, high = np.where(other, score, np.inf).min(axis=1), np.where(other, score, -np.inf).max(axis=1)
        return np.flatnonzero(some), n[some], (score * other).sum(axis=1)[some], low[some], high[some]

    parts = vector_scan(queries, chunks, summed, query_id, query_vec, chunk_id, chunk_vec, f"{query_id} {q_kind}, n long, total double, least double, best double", digits, block)
    return parts.groupBy(query_id).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("best").alias("best"))


def _scanned(rows: pd.DataFrame, keep, digits: int):
    def unit(v) -> np.ndarray:
        m = np.stack([np.asarray(x, float) for x in v])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    ids, matrix, groups = rows["q"].to_numpy(), unit(rows["v"]), rows["g"].to_numpy()
    by_id = keep.__code__.co_argcount == 3

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            step = max(1, SCORED_CELLS // len(pdf))
            vectors, own, of = unit(pdf["v"]).T, pdf["c"].to_numpy(), pdf["g"].to_numpy()
            for i in range(0, len(ids), step):
                score = np.round(matrix[i : i + step] @ vectors, digits)
                score[groups[i : i + step, None] != of[None, :]] = -np.inf
                q, *cols = keep(score, own, ids[i : i + step]) if by_id else keep(score, own)
                yield pd.DataFrame({0: ids[i + q]} | dict(enumerate(cols, 1)))

    return run


def rerank(cands: DataFrame, key: str, scorer: Column, prior: str, k: int) -> DataFrame:
    """Candidates rescored; a score that is not a number counts -999; best ``k`` with ties in their prior order."""
    out = cands.withColumn("rerank_score", F.when(scorer.isNull() | F.isnan(scorer), F.lit(-999.0)).otherwise(scorer))
    w = Window.partitionBy(key).orderBy(F.col("rerank_score").desc(), prior)
    return out.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)


def threshold_keep_first(df: DataFrame, rank: str, score: str, least: float) -> DataFrame:
    return df.where((F.col(rank) == 1) | (F.col(score) >= least))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 4, block: int = TERM_BLOCK) -> DataFrame:
    """Okapi BM25 of a stated query set over all documents: query, doc, score, rank.

    Negative inverse document frequencies are replaced by ``epsilon`` times the average one.  Tokens are made once and kept in the
    shared folder.  The weights of a block of queries' terms go to the tasks, which hold them as an inverted index, score their
    documents by the terms they share with a query and keep the best ``k``; postings aren't shuffled.
    """
    spark = queries.sparkSession
    q_kind, d_kind = queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    schema = f"{query_id} {q_kind}, {doc_id} {d_kind}, score double"
    words = stored(docs.select(F.col(doc_id).alias("d"), tokens(doc_text).alias("t")), "tokens")
    df = stored(words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    n, avg_len = words.agg(F.count("*"), F.avg(F.size("t"))).first()
    idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.agg(F.avg(idf)).first()[0]
    terms = queries.select(F.col(query_id).alias("q"), F.explode(tokens(query_text)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    asked = terms.join(df, "term").select("q", "term", (F.when(idf < 0, F.lit(epsilon * mean if mean is not None else None)).otherwise(idf) * F.col("times")).alias("weight"))
    parts = [words.mapInArrow(_scored(rows, k, k1, b, avg_len, digits), schema) for rows in _blocks(asked, block)]
    return top_ranked(_over_blocks(parts, spark, schema), query_id, "score", doc_id, k)


def _scored(rows: pd.DataFrame, k: int, k1: float, b: float, avg_len: float, digits: int):
    ids, q = np.unique(rows["q"].to_numpy(), return_inverse=True)
    names, term = np.unique(rows["term"].to_numpy().astype(str), return_inverse=True)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(names) + 1))
    q, weight = q[order], rows["weight"].to_numpy()[order]
    known = pa.array(names.tolist(), pa.string())
    most = max(1, SCORED_CELLS // len(ids))

    def parts(batch):
        """Pieces of at most ``most`` documents and about SCORED_CELLS words, one document at least."""
        words = np.cumsum(pa.compute.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = words[low - 1] if low else 0
            n = max(1, min(most, int(np.searchsorted(words, before + SCORED_CELLS, "right")) - low))
            yield batch.slice(low, n)
            low += n

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                held = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                size = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pa.compute.index_in(held.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                pair, tf = np.unique((doc * len(names) + at)[at >= 0], return_counts=True)
                doc, at = pair // len(names), pair % len(names)
                part_score = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avg_len))
                many = start[at + 1] - start[at]
                posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[at], many)
                cell = q[posting] * len(size) + np.repeat(doc, many)
                total = np.bincount(cell, weight[posting] * np.repeat(part_score, many), len(ids) * len(size)).reshape(len(ids), len(size))
                met = np.zeros(total.shape, bool)
                met.ravel()[cell] = True
                total = np.where(met, np.round(total, digits), -np.inf)
                if len(size) > k:  # ties at the k-th score stay for the last ranking
                    met &= total >= np.partition(total, len(size) - k, axis=1)[:, len(size) - k, None]
                x, y = np.nonzero(met)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), part.column(0).take(pa.array(y)), pa.array(total[x, y])], ["q", "d", "s"])

    return run


def context_scores(ranked: DataFrame, key: str, rank: str, score: str, digits: int = 4) -> DataFrame:
    """Per query: its scores in order, and their max, min and average, which is summed in that order.

    Rounded as doubles are: what lies half way in decimals goes by the nearest double, not by how it prints.
    """
    near = lambda x: F.round(x * 10.0**digits) / 10.0**digits
    held = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, score))), lambda x: x[score].cast("double")).alias("__s"))
    known = F.filter("__s", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(known), F.lit(0))
    return held.select(key, F.transform("__s", near).alias("scores"), near(F.array_max("__s")).alias("score_max"), near(F.array_min("__s")).alias("score_min"), near(mean).alias("score_avg"))


def merge_contexts(private: DataFrame, corpus: DataFrame, key: str, rank: str) -> DataFrame:
    """Private hits before the corpus's, ranked anew; a key's hits are numbered by ranges, however many."""
    both = private.withColumn("origin", F.lit(0)).unionByName(corpus.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    return ordered.before(both, [key], ["origin", rank], name="merged_rank").withColumn("merged_rank", F.col("merged_rank") + 1)


def assemble_context(ranked: DataFrame, key: str, rank: str, title: str, text: str, label: str = "Tài liệu") -> DataFrame:
    """Per query the numbered passages, parted by blank lines."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x"))))
    one = lambda p, i: F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit(": "), p["t"], F.lit("]\n"), p["x"])
    return ranked.groupBy(key).agg(items.alias("__i")).select(key, F.array_join(F.transform("__i", one), "\n\n").alias("context"))


def build_prompt(df: DataFrame, question: str, context: str, summary: str, history: str, few_shot: list[tuple[str, str]], fallback: str) -> DataFrame:
    """``df`` with prompt: examples, context or the fallback sentence, summary, history (array of role, text, interrupted), question."""
    examples = "\n".join(f"user: {q}\nassistant: {a}" for q, a in few_shot)
    said = F.transform(history, lambda h: F.concat(h["role"], F.lit(": "), h["text"], F.when(F.coalesce(h["interrupted"], F.lit(False)), F.lit(" [interrupted]")).otherwise(F.lit(""))))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    parts = [
        F.lit(examples) if examples else F.lit(None).cast("string"),
        F.when(blank(context), F.lit(fallback)).otherwise(F.concat(F.lit("context:\n"), F.col(context))),
        F.when(~blank(summary), F.concat(F.lit("summary: "), F.col(summary))),
        F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.array_join(said, "\n")),
        F.concat(F.lit("question: "), F.col(question)),
    ]
    return df.withColumn("prompt", F.concat_ws("\n\n", *parts))


def cache_key(query: ColumnLike, settings: dict[str, object], prefix: str = "retrieval:") -> Column:
    """sha256 over the settings and the query without case and extra white space; any changed setting changes it."""
    level = strip(F.regexp_replace(F.lower(col(query)), r"\s+", " "))
    fixed = ",".join(f'"{k}":"{settings[k]}"' for k in sorted(settings))
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit("{" + fixed + ',"query":"'), level, F.lit('"}')), 256))


NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the url namespace of RFC 4122


def uuid5(name: ColumnLike, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based uuid, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), col(name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def semantic_cache_rows(answers: DataFrame, parts: list[str], now: str, ttl: int) -> DataFrame:
    """Rows to write to a semantic cache: id from the joined key parts, expires_at; the latest row of an id wins."""
    rows = answers.withColumn("id", uuid5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))))
    rows = rows.withColumn("expires_at", F.col(now) + F.make_dt_interval(secs=F.lit(float(ttl))))
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.col(now)).alias("r"))
    return latest.select("r.*")


def semantic_lookup(requests: DataFrame, cache: DataFrame, equal: list[str], request_id: str, vec: str, cache_id: str, cache_vec: str, now: str, expires: str, least: float = 0.9) -> DataFrame:
    """The best cache row per request: equal on the keys, not expired, cosine at least ``least``.

    Requests and cache rows of a key meet as blocks of vectors; a block gives one row a request.  Rows without a vector, key or time match nothing.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(equal)]
    asked = stored(requests.select(*keys, F.col(request_id).alias("id"), F.col(vec).alias("v"), F.col(now).cast("double").alias("at"), F.monotonically_increasing_id().alias("q")).dropna(), "requests")
    rows = cache.select(*keys, F.col(cache_id).alias("c"), F.col(cache_vec).alias("v"), F.col(expires).cast("double").alias("at")).dropna()
    best = grouped_topk(asked.select(*(f"k{i}" for i in range(len(equal))), "q", "v", "at"), rows, len(equal), 1, least=least)
    return top_ranked(best.join(asked.select("q", F.col("id").alias(request_id)), "q").select(request_id, F.col("c").alias("cache_id"), "score"), request_id, "score", "cache_id", 1).drop("rank")


def cache_path(exact_hit: str, semantic_hit: str, filtered: str, hyde: str) -> Column:
    """bypass, hit, semantic_hit or miss: filters bypass both caches, HyDE the semantic one."""
    return F.when(F.col(filtered), "bypass").when(F.col(exact_hit), "hit").when(~F.col(hyde) & F.col(semantic_hit), "semantic_hit").otherwise("miss")


def article_best(scores: DataFrame, query: str, article: str, score: str, least: float, k: int = 3) -> DataFrame:
    """Chunks over the threshold, the best score of each article, the best ``k`` articles of each query."""
    best = scores.where(F.col(score) >= least).groupBy(query, article).agg(F.max(score).alias(score))
    return top_ranked(best, query, score, article, k)


def select_chunks(scores: DataFrame, query: str, chunk: str, score: str, least: float = 0.9, fallback: int = 3) -> DataFrame:
    """Chunks of at least ``least``; for queries without one, the best ``fallback``."""
    good = F.count_if(F.col(score) >= least).over(Window.partitionBy(query))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), chunk))
    out = scores.withColumn("__good", good).withColumn("rank", rank)
    return out.where(F.when(F.col("__good") > 0, F.col(score) >= least).otherwise(F.col("rank") <= fallback)).drop("__good")


def candidate_urls(found: DataFrame, question: str, source_pos: str, hit_pos: str, url: str, domain: Column, exclude: Column, cap: int = 20) -> DataFrame:
    """Urls per question: the question's own results before those of its aspects, none of the excluded domain, each once, at most ``cap`` (the feature's limit)."""
    rows = found.where(~domain.eqNullSafe(exclude))
    first = rows.groupBy(question, url).agg(F.min(F.struct(source_pos, hit_pos)).alias("__p"))
    w = Window.partitionBy(question).orderBy("__p", url)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("__p")


def sweep(ranked: DataFrame, configs: list[tuple[int, int]], key: str, rank: str, scorer: str, chunk: str) -> DataFrame:
    """Rerank the first fetch_k and keep top_k, for each (fetch_k, top_k); the configurations are a small fixed table."""
    table = ranked.sparkSession.createDataFrame(configs, "fetch_k int, top_k int")
    rows = ranked.join(F.broadcast(table), F.col(rank) <= F.col("fetch_k"))
    w = Window.partitionBy("fetch_k", "top_k", key).orderBy(F.col(scorer).desc(), chunk)
    return rows.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= F.col("top_k"))

