"""Queries over conversations, labels and documents: rules, guardrails, joins, set operations, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import rules, text
from corpusflow.functions.packs import TEST_EN
from corpusflow.operators import joins, reshape, retrieval, sample, stats
from corpusflow.plans.cleaning import LINKS, URL, VOICE, WORDS, trim
from corpusflow.plans.noise import WITH_CONV, WITH_DOC, noised, noised_conv
from corpusflow.plans.registry import query, table


def _word_sql(x: str, patterns) -> str:
    return rf"regexp_matches({x}, '(^|[^\pL\pN_])({'|'.join(patterns)})($|[^\pL\pN_])')"


def _group_sql(x: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_word_sql(x, p)} THEN '{label}'" for label, p in groups) + f" ELSE '{default}' END"


_Q = trim("lower(noised)")
_SAFETY = f"CASE WHEN {_Q} = '' THEN 'empty_query' ELSE {_group_sql(_Q, TEST_EN.safety, 'normal')} END"
_MESSAGES = ", ".join(f"('{k}', '{v}')" for k, v in TEST_EN.messages.items())


@query(f"WITH {WITH_CONV} SELECT conv_id, turn, safety, safety <> 'normal' AS triggered, message FROM (SELECT conv_id, turn, {_SAFETY} AS safety FROM n) JOIN (VALUES {_MESSAGES}) m(safety, message) USING (safety)")
def cls1_assess_safety(spark, sf_dir):
    return rules.with_safety(noised_conv(table(spark, sf_dir, "conversations")), "noised", TEST_EN).select("conv_id", "turn", "safety", "triggered", "message")


_S = trim(r"regexp_replace(lower(noised), '\s+', ' ', 'g')")
_SIG = [_group_sql(_S, TEST_EN.audience, "general"), _group_sql(_S, TEST_EN.condition, "general"), _group_sql(_S, TEST_EN.intent, "general_information")]


@query(f"WITH {WITH_CONV} SELECT conv_id, turn, {_SIG[0]} AS audience, {_SIG[1]} AS condition, {_SIG[2]} AS intent FROM n")
def cls2_semantic_signature(spark, sf_dir):
    s = rules.semantic_signature("noised", TEST_EN)
    return noised_conv(table(spark, sf_dir, "conversations")).select("conv_id", "turn", s["audience"].alias("audience"), s["condition"].alias("condition"), s["intent"].alias("intent"))


@query(f"WITH {WITH_CONV} SELECT 'audience=' || {_SIG[0]} || '|condition=' || {_SIG[1]} || '|intent=' || {_SIG[2]} AS key, count(*) AS n FROM n GROUP BY 1")
def cls3_signature_key(spark, sf_dir):
    rows = noised_conv(table(spark, sf_dir, "conversations"))
    return rows.groupBy(rules.signature_key(rules.semantic_signature("noised", TEST_EN)).alias("key")).agg(F.count("*").alias("n"))


@query(f"""WITH {WITH_CONV}, g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS doc_count, coalesce(sum(length({trim('noised')})) FILTER (role = 'user'), 0) AS total_chars FROM n GROUP BY 1)
SELECT conv_id, doc_count, CAST(total_chars AS BIGINT) AS total_chars, CASE WHEN doc_count < 1 THEN 'no_retrieved_document' WHEN total_chars < 400 THEN 'retrieved_context_too_short' ELSE 'sufficient' END AS reason, doc_count >= 1 AND total_chars >= 400 AS sufficient FROM g""")
def cls4_assess_evidence(spark, sf_dir):
    rows = noised_conv(table(spark, sf_dir, "conversations"))
    return rules.assess_evidence(rows, rows.where("role = 'user'"), "conv_id", "noised", min_chars=400)


_UNSAFE = _word_sql(f"lower({VOICE})", TEST_EN.unsafe_claims)


@query(f"WITH {WITH_DOC} SELECT doc_id, NOT {_UNSAFE} AS safe, NOT contains(lower({VOICE}), '{TEST_EN.disclaimer.lower()}') AS needs_disclaimer, regexp_matches({LINKS}, '{URL}') AS removed_url, {_UNSAFE} AS unsafe_claim FROM n")
def cls5_output_safety(spark, sf_dir):
    return noised(table(spark, sf_dir, "documents")).select("doc_id", rules.output_safety("noised", TEST_EN).alias("s")).select("doc_id", "s.*")


_PAIRS = """p AS (SELECT a.conv_id, a.turn, a.noised AS q, b.noised AS a FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def _qa(spark, sf_dir):
    rows = noised_conv(table(spark, sf_dir, "conversations"))
    a, b = rows.where("role = 'user'").alias("a"), rows.where("role = 'assistant'").alias("b")
    return a.join(b, F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1")).select("a.conv_id", "a.turn", F.col("a.noised").alias("q"), F.col("b.noised").alias("a"))


@query(f"WITH {WITH_CONV}, {_PAIRS} SELECT conv_id, turn, CASE WHEN conv_id % 17 = 0 THEN 'skipped' WHEN {trim('q')} = '' OR {trim('a')} = '' THEN 'missing' WHEN contains(q, 'hewh') OR contains(a, 'hewh') THEN 'bad_pattern' WHEN {WORDS.format('a')} < 90 THEN 'short_answer' ELSE 'ok' END AS reason FROM p")
def cls6_validate_qa(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", rules.validate_qa("q", "a", F.col("conv_id") % 17 == 0, "hewh").alias("reason"))


@query(f"SELECT CASE WHEN w <= 10 THEN '<=10' WHEN w <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS n FROM (SELECT {WORDS.format('text')} AS w FROM documents) GROUP BY 1")
def cls7_length_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(rules.length_bucket(text.word_count("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT CASE WHEN value / 50 >= 3 THEN '>=3' WHEN value / 50 >= 2 THEN '2-3' WHEN value / 50 >= 1 THEN '1-2' WHEN value / 50 >= 0.5 THEN '0.5-1' ELSE '<0.5' END AS bucket FROM events) SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM b GROUP BY 1")
def cls8_score_bucket(spark, sf_dir):
    return stats.share_of_total(table(spark, sf_dir, "events").select(rules.score_bucket(F.col("value") / 50).alias("bucket")), "bucket")


@query("SELECT event_type, round(avg(value), 4) AS mean, CASE WHEN avg(value) <= 40 THEN 'good' WHEN avg(value) <= 50 THEN 'acceptable' ELSE 'bad' END AS grade FROM events GROUP BY 1")
def cls9_threshold_grade(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return out.select("event_type", F.round("m", 4).alias("mean"), rules.threshold_grade(F.col("m"), 40, 50).alias("grade"))


# joins


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def joi1_pending(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)")
def joi2_inner(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def joi3_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("""WITH c AS (SELECT doc_id, unnest([doc_id * 7, doc_id * 3 + 1, doc_id % 50]) AS cand, unnest([0, 1, 2]) AS pos FROM documents),
f AS (SELECT c.doc_id, min_by(l.source, pos) AS found FROM c JOIN documents l ON l.doc_id = cand WHERE l.n_chars > 500 GROUP BY 1)
SELECT doc_id, found FROM documents LEFT JOIN f USING (doc_id)""")
def joi5_first_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    lookup = rows.where("n_chars > 500").select(F.col("doc_id").alias("cand"), F.col("source").alias("found"))
    return joins.first_candidate(rows.select("doc_id"), "doc_id", F.expr("array(doc_id * 7, doc_id * 3 + 1, doc_id % 50)"), lookup, "cand", "found")


@query("SELECT d.doc_id, d.source, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def joi12_attach_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source")
    return rows.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "pos"), "pos", "left").select(F.col("pos").alias("doc_id"), "source", "toxic")


@query(r"""WITH q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, 'retrieval:' || sha256('{"fetch_k":"15","model":"m1","top_k":"5","version":"3","query":"' || t || '"}') AS key FROM q""")
def ret11_cache_key(spark, sf_dir):
    key = retrieval.cache_key("text", {"top_k": 5, "fetch_k": 15, "model": "m1", "version": 3})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"))


@query(r"""WITH c AS (SELECT conv_id, string_agg(role || ': ' || text || CASE WHEN turn % 3 = 2 THEN ' [interrupted]' ELSE '' END, chr(10) ORDER BY turn, role, text) AS history, max_by(text, turn) AS question, CASE WHEN conv_id % 2 = 0 THEN min_by(text, turn) END AS context FROM conversations GROUP BY 1)
SELECT conv_id, md5(concat_ws(chr(10) || chr(10), 'user: q1' || chr(10) || 'assistant: a1' || chr(10) || 'user: q2' || chr(10) || 'assistant: a2', CASE WHEN regexp_replace(coalesce(context, ''), '\s+', '', 'g') = '' THEN 'nothing found' ELSE 'context:' || chr(10) || context END, history, 'question: ' || question)) AS h FROM c""")
def ret10_build_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["turn"] % 3 == 2).alias("interrupted")))
    conv = rows.groupBy("conv_id").agg(turns.alias("history"), F.max_by("text", "turn").alias("question"), F.when(F.col("conv_id") % 2 == 0, F.min_by("text", "turn")).alias("context"), F.lit("").alias("summary"))
    out = retrieval.build_prompt(conv, "question", "context", "summary", "history", [("q1", "a1"), ("q2", "a2")], "nothing found")
    return out.select("conv_id", F.md5("prompt").alias("h"))


@query()
def ret12_semantic_cache_rows(spark, sf_dir):
    rows = noised_conv(table(spark, sf_dir, "conversations")).withColumn("key", rules.signature_key(rules.semantic_signature("noised", TEST_EN)))
    rows = rows.select("key", "role", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("now"))
    return retrieval.semantic_cache_rows(rows, ["key", "role"], "now", 3600)


# windows, samples and sets over documents


@query("""SELECT doc_id, 'syn_' || source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) + coalesce((SELECT max(n) FROM (SELECT source AS s, count(*) AS n FROM documents WHERE doc_id % 10 = 0 GROUP BY 1) WHERE s = source), 0) AS VARCHAR), 4, '0') AS syn_id FROM documents WHERE doc_id % 10 <> 0""")
def win1_running_id(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    old = rows.where("doc_id % 10 = 0").groupBy("source").agg(F.count("*").alias("n"))
    return stats.running_id(rows.where("doc_id % 10 <> 0"), "source", "doc_id", old).select("doc_id", "syn_id")


@query(f"SELECT doc_id, i - 1 AS chunk_index, left(l, 20) AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def win2_chunk_index(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return out.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.substring("l", 1, 20).alias("head"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def win3_last_turns(spark, sf_dir):
    return stats.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("WITH g AS (SELECT conv_id AS session, count(*) AS n FROM conversations GROUP BY 1), b AS (SELECT *, CASE WHEN n > 3 THEN (n - 4) // 2 + 1 ELSE 0 END AS batches FROM g) SELECT session, n - 2 * batches AS held, 2 * batches AS compressed, batches FROM b")
def win3_memory_fold(spark, sf_dir):
    return stats.memory_fold(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session"), "session", "turn")


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM documents GROUP BY 1")
def win7_share_of_total(spark, sf_dir):
    return stats.share_of_total(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= 20")
def srt4_stratified(spark, sf_dir):
    return sample.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("WITH g AS (SELECT source, count(*) AS w FROM documents GROUP BY 1) SELECT source, w, CAST(greatest(1, round_even(100 * w / sum(w) OVER (), 0)) AS BIGINT) AS allocation FROM g")
def srt5_proportional(spark, sf_dir):
    return sample.proportional(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("w")), "w", 100)


@query("WITH r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS VARCHAR) AS n FROM documents) SELECT doc_id, 'clip_' || CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS blind_id FROM r")
def srt6_blind_ids(spark, sf_dir):
    return sample.blind_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, n_chars > 2000 AS kept FROM documents")
def srt9_size_filter(spark, sf_dir):
    kept, out = sample.size_filter(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 2000)
    return kept.select("doc_id", F.lit(True).alias("kept")).union(out.select("doc_id", F.lit(False).alias("kept")))


_PARTS = "SELECT doc_id AS k, source, 0 AS part FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'b', 1 FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT -1 - doc_id, source, 1 FROM documents"


def _parts(spark, sf_dir):
    """Two overlapping parts that together hold every document."""
    rows = table(spark, sf_dir, "documents")
    b = rows.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("k"), F.lit("b").alias("source"))
    return [rows.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), "source"), b.union(rows.select((-1 - F.col("doc_id")).alias("k"), "source"))]


@query(f"SELECT k, min_by(source, part) AS source FROM ({_PARTS}) GROUP BY k")
def set1_union_first(spark, sf_dir):
    return reshape.union_distinct(_parts(spark, sf_dir), "k")


@query(f"SELECT k, max_by(source, part) AS source FROM ({_PARTS}) GROUP BY k")
def set1_union_last(spark, sf_dir):
    return reshape.union_distinct(_parts(spark, sf_dir), "k", last_wins=True)


@query(r"""WITH n AS (SELECT unnest(['one curated passage', 'another one']) AS text) SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source, md5(text) AS h FROM documents
UNION ALL SELECT regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5'), 'curated', md5(text) FROM n""")
def set2_append_curated(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "source")
    return reshape.append_curated(rows, [{"text": "one curated passage"}, {"text": "another one"}], {"source": "curated"}, "text", "chunk_id").select("chunk_id", "source", F.md5("text").alias("h"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set3_difference(spark, sf_dir):
    return reshape.difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def set4_intersection(spark, sf_dir):
    return reshape.intersection(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id, clip, score FROM (SELECT doc_id, 'clip_0001' AS clip, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT doc_id, 'clip_0002', CASE WHEN toxic = 1 THEN NULL ELSE CAST(toxic AS DOUBLE) END FROM labels) WHERE score IS NOT NULL")
def set5_ratings_long(spark, sf_dir):
    wide = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("how good is clip_0001?"), F.when(F.col("toxic") == 1, "n/a").otherwise("0").alias("clip_0002"))
    return reshape.ratings_long(wide, ["how good is clip_0001?", "clip_0002"], keep=["doc_id"])


@query("SELECT doc_id, c.c AS condition, k.k AS criterion, CAST(NULL AS DOUBLE) AS score FROM documents, (VALUES ('a'), ('b')) c(c), (VALUES ('natural'), ('clear')) k(k)")
def set7_rating_sheet(spark, sf_dir):
    return reshape.rating_sheet(table(spark, sf_dir, "documents").select("doc_id"), ["a", "b"], ["natural", "clear"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def set8_flatten_json(spark, sf_dir):
    return reshape.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def agg16_top_counts(spark, sf_dir):
    return stats.top_counts(table(spark, sf_dir, "documents"), "source")


@query("SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def agg17_distinct_counts(spark, sf_dir):
    return stats.distinct_counts(table(spark, sf_dir, "documents"), {"texts": "text", "sources": "source", "langs": "lang"})


@query("WITH m AS (SELECT 'quality' AS metric, CAST(quality AS DOUBLE) AS v FROM labels UNION ALL SELECT 'rated', CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END FROM labels UNION ALL SELECT 'never', NULL FROM labels) SELECT metric, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, count(*) FILTER (v IS NULL) AS missing FROM m GROUP BY 1 HAVING avg(v) IS NOT NULL")
def agg8_metric_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", F.when(F.col("toxic") == 0, F.col("quality").cast("double")).otherwise(F.lit(float("nan"))).alias("rated"), F.lit(None).cast("double").alias("never"))
    return stats.metric_stats(rows, ["quality", "rated", "never"])


@query("SELECT source, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agg9_metrics_by(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"), F.count("*").alias("n"))


@query("WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality >= 0.5) AS answerable, round(avg(quality), 4) AS mean_score FROM labels) SELECT *, n - answerable AS gap, round(100.0 * answerable / n, 2) AS answerable_pct, round(100.0 * (n - answerable) / n, 2) AS gap_pct FROM c")
def agg10_coverage(spark, sf_dir):
    return stats.coverage(table(spark, sf_dir, "labels"), "quality", 0.5)


@query()
def agg11_wer_cer(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(stats.wer("text", "hyp"), 6).alias("wer"), F.round(stats.cer("text", "hyp"), 6).alias("cer"))


@query()
def agg11_wer_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.filter(F.split("text", " "), lambda w, i: i % 9 != 4).alias("w"))
    said = rows.select("doc_id", "text", F.array_join(F.transform("w", lambda w, i: F.when(i % 11 == 7, F.reverse(w)).otherwise(w)), " ").alias("hyp"))
    return said.select("doc_id", F.round(stats.wer("text", "hyp"), 6).alias("wer"), F.round(stats.cer("text", "hyp"), 6).alias("cer"))

