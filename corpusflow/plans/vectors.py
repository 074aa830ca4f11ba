"""Queries over embeddings and the benchmark: vector and term search, reranking, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import chunking, text
from corpusflow.functions.scorers import embedder, hashed_words, pair_scorer, score_query, token_overlap
from corpusflow.operators import clean, retrieval, stats
from corpusflow.operators.vector_index import VectorIndex
from corpusflow.plans.cleaning import chunk_words_sql
from corpusflow.plans.registry import query, table

# the stated query set: every vector whose id is divisible by 20, against all
_DOT = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))"
_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = f"round({_DOT} / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(c.v, lambda x: x * x))), 6)"
_PAIRS = f"{_VEC}, s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS qlabel, {_COS} AS score FROM v q, v c WHERE q.vec_id % 20 = 0)"


def _top(k: int, rows: str = "s") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {rows} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("qlabel")), rows


def searched(spark, sf_dir, k):
    q, rows = vectors(spark, sf_dir)
    return retrieval.vector_topk(q, rows, k, "query_id", "embedding", "vec_id", "embedding")


@query(f"WITH {_VEC} SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) * (x / sqrt(list_sum(list_transform(v, lambda y: y * y)))))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS first FROM v")
def ret1_l2_normalize(spark, sf_dir):
    v = retrieval.l2_normalize("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.dot(v, v), 6).alias("norm"), F.round(v[0], 6).alias("first"))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM ({_top(10)})")
def ret2_vector_topk(spark, sf_dir):
    return searched(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM ({_top(5, '(SELECT * FROM s WHERE label = 3)')})")
def ret3_filtered_search(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    return retrieval.vector_topk(q, rows.where("label = 3"), 5, "query_id", "embedding", "vec_id", "embedding").drop("rank")


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM ({_top(10)})")
def ret2_indexed_topk(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    return VectorIndex(rows, "vec_id", "embedding").topk(q, 10, "query_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM ({_top(5, '(SELECT * FROM s WHERE label = 3)')})")
def ret3_indexed_filtered(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    return VectorIndex(rows, "vec_id", "embedding", ["label"]).topk(q, 5, "query_id", "embedding", F.col("label") == 3).drop("rank")


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM (SELECT * FROM s WHERE label = qlabel AND vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)")
def joi6_similarity_join(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    found = retrieval.vector_topk(q, rows, 6, "query_id", "embedding", "vec_id", "embedding", group=("qlabel", "label"))
    return retrieval.top_ranked(found.drop("rank").where("vec_id <> query_id"), "query_id", "score", "vec_id", 5).drop("rank")


_RR = "round(CASE WHEN vec_id % 13 = 0 THEN -999 ELSE (vec_id * 37 % 101) / 101.0 END, 6)"


def _reranked(spark, sf_dir, fetch, k):
    score = F.when(F.col("vec_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.round((F.col("vec_id") * 37 % 101) / 101.0, 6))
    return retrieval.rerank(searched(spark, sf_dir, fetch), "query_id", score, "rank", k)


@query(f"WITH {_PAIRS}, t AS (SELECT query_id, vec_id, rank, {_RR} AS rerank_score FROM ({_top(15)})) SELECT query_id, vec_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM t QUALIFY rerank_rank <= 5")
def ret4_rerank(spark, sf_dir):
    out = _reranked(spark, sf_dir, 15, 5)
    return out.select("query_id", "vec_id", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM ({_top(10)}) WHERE rank = 1 OR score >= 0.3")
def ret5_threshold_keep_first(spark, sf_dir):
    return retrieval.threshold_keep_first(searched(spark, sf_dir, 10), "rank", "score", 0.3).select("query_id", "vec_id", "score")


_TOK = r"list_filter(string_split(regexp_replace(regexp_replace(lower({}), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


def bm25_sql(queries: str, docs: str, k: int) -> str:
    """Over tables queries(q, t) and docs(d, t)."""
    return f"""dt AS (SELECT d, {_TOK.format('t')} AS w FROM ({docs})), qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest({_TOK.format('t')}) AS term FROM ({queries})) GROUP BY 1, 2),
po AS (SELECT d, len, term, count(*) AS tf FROM (SELECT d, len(w) AS len, unnest(w) AS term FROM dt) GROUP BY 1, 2, 3), tot AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM dt),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM po, tot GROUP BY term, n), mi AS (SELECT avg(idf0) AS m FROM df), idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * m ELSE idf0 END AS idf FROM df, mi),
sc AS (SELECT q, d, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) * times), 4) AS score FROM po JOIN qt USING (term) JOIN idf USING (term), tot GROUP BY 1, 2),
top AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM sc QUALIFY rank <= {k})"""


@query(f"WITH {bm25_sql('SELECT item_id AS q, text AS t FROM benchmark', 'SELECT doc_id AS d, text AS t FROM documents', 5)} SELECT q AS item_id, d AS doc_id, score, rank FROM top")
def ret6_bm25_topk(spark, sf_dir):
    out = retrieval.bm25_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, "item_id", "text", "doc_id", "text")
    return out.withColumn("rank", F.col("rank").cast("long"))


def flagship(spark, sf_dir):
    """documents -> trimmed lines -> word range -> first per prefix -> word chunks with ids -> BM25 top 5 per benchmark item."""
    docs = table(spark, sf_dir, "documents").withColumn("text", text.trim_lines("text"))
    docs = clean.dedup_prefix(clean.word_range(docs, "text").select("doc_id", "source", "text"), "text", "doc_id")
    chunks = chunking.explode_chunks(docs, chunking.chunk_words("text"))
    out = retrieval.bm25_topk(table(spark, sf_dir, "benchmark"), chunks, 5, "item_id", "text", "chunk_id", "text")
    return out.withColumn("rank", F.col("rank").cast("long"))


_TRIMMED = r"""SELECT doc_id, source, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM documents"""
_KEPT = rf"""SELECT * FROM ({_TRIMMED}) WHERE len(regexp_extract_all(text, '[^\s]+')) BETWEEN 150 AND 3000 QUALIFY row_number() OVER (PARTITION BY left(text, 300) ORDER BY doc_id) = 1"""


@query(f"WITH kept AS ({_KEPT}), ck AS ({chunk_words_sql().replace('FROM documents', 'FROM kept')}), {bm25_sql('SELECT item_id AS q, text AS t FROM benchmark', '''SELECT source || '_' || doc_id || '_' || i AS d, x AS t FROM ck''', 5)} SELECT q AS item_id, d AS chunk_id, score, rank FROM top")
def q1_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {_PAIRS}, t AS ({_top(5)}) SELECT query_id, array_to_string(list_transform(list(round(score, 4) ORDER BY rank), lambda x: printf('%.4f', x)), ',') AS scores, round(max(score), 4) AS score_max, round(min(score), 4) AS score_min, round(avg(score), 4) AS score_avg FROM t GROUP BY 1")
def ret7_context_scores(spark, sf_dir):
    out = retrieval.context_scores(searched(spark, sf_dir, 5), "query_id", "rank", "score")
    return out.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ","))


@query("WITH r AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS origin FROM documents) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY origin, doc_id) AS merged_rank FROM r")
def ret8_merge_contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    out = retrieval.merge_contexts(rows.where("doc_id % 7 = 0"), rows.where("doc_id % 7 <> 0"), "source", "doc_id")
    return out.select("source", "doc_id", F.col("merged_rank").cast("long").alias("merged_rank"))


@query("WITH r AS (SELECT lang, doc_id, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) SELECT lang, md5(string_agg('[Tài liệu ' || i || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS h FROM r WHERE i <= 30 GROUP BY 1")
def ret9_assemble_context(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("zero", F.lit(0))
    best = retrieval.top_ranked(rows, "lang", "zero", "doc_id", 30)
    return retrieval.assemble_context(best, "lang", "rank", "source", "text").select("lang", F.md5("context").alias("h"))


@query(f"WITH {_PAIRS}, a AS (SELECT query_id, label AS article, max(score) AS score FROM s WHERE score >= 0.2 GROUP BY 1, 2) SELECT query_id, article, score FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article) <= 3")
def ret14_article_best(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    scored = retrieval.vector_at_least(q, rows, 0.2, "query_id", "embedding", "vec_id", "embedding")
    scored = scored.join(rows.select("vec_id", F.col("label").alias("article")), "vec_id")
    return retrieval.article_best(scored, "query_id", "article", "score", 0.2).select("query_id", "article", "score")


@query(f"WITH {_PAIRS}, o AS (SELECT *, count(*) FILTER (score >= 0.42) OVER (PARTITION BY query_id) AS good, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE vec_id <> query_id) SELECT query_id, vec_id, score FROM o WHERE CASE WHEN good > 0 THEN score >= 0.42 ELSE rank <= 3 END")
def ret15_select_chunks(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    # a query's own vector may be among its best: one more is kept
    few = retrieval.vector_topk(q, rows, 4, "query_id", "embedding", "vec_id", "embedding").drop("rank")
    good = retrieval.vector_at_least(q, rows, 0.42, "query_id", "embedding", "vec_id", "embedding")
    scored = few.union(good).distinct().where("vec_id <> query_id")
    return retrieval.select_chunks(scored, "query_id", "vec_id", "score", 0.42).select("query_id", "vec_id", "score")


@query(f"WITH {_PAIRS}, t AS ({_top(20)}), c AS (SELECT * FROM (VALUES (10, 3), (15, 5), (20, 7)) x(fetch_k, top_k)), r AS (SELECT fetch_k, top_k, query_id, vec_id, row_number() OVER (PARTITION BY fetch_k, query_id ORDER BY (vec_id * 37 % 101) DESC, vec_id) AS f FROM t JOIN c ON rank <= fetch_k) SELECT fetch_k, top_k, query_id, vec_id FROM r WHERE f <= top_k")
def ret17_sweep(spark, sf_dir):
    ranked = searched(spark, sf_dir, 20).withColumn("s", F.col("vec_id") * 37 % 101)
    return retrieval.sweep(ranked, [(10, 3), (15, 5), (20, 7)], "query_id", "rank", "s", "vec_id").select("fetch_k", "top_k", "query_id", "vec_id")


@query(f"WITH {_PAIRS} SELECT query_id, vec_id AS cache_id, score FROM (SELECT * FROM s WHERE label = qlabel AND vec_id <> query_id AND vec_id % 20 <> 0 AND 1000 + vec_id >= 1000 + query_id AND score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 1)")
def joi7_semantic_lookup(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    requests = q.select("query_id", "embedding", F.col("qlabel").alias("label"), (F.col("query_id") + 1000).alias("now"))
    cache = rows.where("vec_id % 20 <> 0").withColumn("expires", F.col("vec_id") + 1000)
    return retrieval.semantic_lookup(requests, cache, ["label"], "query_id", "embedding", "vec_id", "embedding", "now", "expires", 0.3)


@query(f"WITH {_PAIRS}, t AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label = qlabel QUALIFY rank <= 10), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id * 37 % 101) DESC, rank) AS f FROM t) SELECT query_id, vec_id FROM r WHERE f <= 5")
def joi9_session_search(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    found = retrieval.vector_topk(q, rows, 10, "query_id", "embedding", "vec_id", "embedding", group=("qlabel", "label"))
    return retrieval.rerank(found, "query_id", (F.col("vec_id") * 37 % 101).cast("double"), "rank", 5).select("query_id", "vec_id")


@query(f"WITH {_PAIRS}, b AS (SELECT query_id, max(score) AS best FROM s WHERE vec_id <> query_id GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS docs, (SELECT round(avg(length(text)), 4) FROM documents) AS avg_chars, round(avg(score), 4) AS score_mean, round(min(score), 4) AS score_min, round(max(score), 4) AS score_max, (SELECT count(*) FROM b) AS questions, (SELECT count(*) FROM b WHERE best >= 0.5) AS best_ge_50, (SELECT count(*) FROM b WHERE best >= 0.4) AS best_ge_40 FROM s WHERE vec_id <> query_id")
def agg18_corpus_report(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    summary = retrieval.vector_summary(q, rows, "query_id", "embedding", "vec_id", "embedding")
    return stats.corpus_report(table(spark, sf_dir, "documents"), summary, "text", (0.5, 0.4))


_SPLIT = r"list_distinct(regexp_extract_all({}, '[^\s]+'))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect({_SPLIT.format('q')}, {_SPLIT.format('t')})) / greatest(1, len({_SPLIT.format('q')})), 6) AS score,
 round(CASE WHEN len({_TOK.format('q')}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_TOK.format('q')}), {_TOK.format('t')})) / len(list_distinct({_TOK.format('q')})) END, 6) AS overlap FROM p""")
def udf1_pair_scorer(spark, sf_dir):
    def make():
        return lambda q, t: [len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()))) for a, b in zip(q, t)]

    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.round(pair_scorer(make)(F.col("text"), F.col("answer")), 6).alias("score"), F.round(token_overlap("text", "answer"), 6).alias("overlap"))


@query()
def udf2_embedder(spark, sf_dir):
    v = embedder(lambda: hashed_words(32))
    return table(spark, sf_dir, "documents").select("doc_id", v(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("n"), F.round(retrieval.dot("v", "v"), 3).alias("norm"))


@query("SELECT a.conv_id, a.turn, md5(a.text || ' ' || left(b.text, 300)) AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def udf3_score_query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    b = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return rows.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(score_query("text", "answer")).alias("h"))
