"""Queries over documents: cleaning, deduplication, chunking, normalising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import chunking, dictionary, text
from corpusflow.functions.packs import TEST_EN
from corpusflow.operators import clean
from corpusflow.plans import chunk_sql
from corpusflow.plans.noise import WITH_CONV, WITH_DOC, noised, noised_conv
from corpusflow.plans.registry import query, table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noised(table(spark, sf_dir, "documents"))


COLLAPSE = trim(r"regexp_replace(regexp_replace({}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
INVISIBLE = "replace(replace(replace(replace({}, ' ', ' '), '​', ''), '‌', ''), '﻿', '')"


@query(f"WITH {WITH_DOC} SELECT doc_id, {COLLAPSE.format('noised')} AS t FROM n")
def cln1_collapse_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.collapse_ws("noised").alias("t"))


@query(f"WITH {WITH_DOC} SELECT doc_id, {INVISIBLE.format('noised')} AS t FROM n")
def cln2_strip_invisible(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.strip_invisible("noised").alias("t"))


@query(rf"""WITH {WITH_DOC}, m AS (SELECT doc_id, noised, regexp_extract(noised, '(?i)\n(Bibliography|References?)([^\pL\pN_]|$)', 0) AS h FROM n)
SELECT doc_id, CASE WHEN h = '' THEN noised ELSE left(noised, CAST(strpos(noised, h) - 1 AS INT)) END AS t FROM m""")
def cln3_cut_references(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.cut_references("noised", TEST_EN).alias("t"))


_UNWANTED = r"(?i)^(-{5,}$|https?://\S+$|(Author\s*:|Source\s*:)|(Home|Contact|Sitemap)([^\pL\pN_]|$))"


@query(rf"""WITH {WITH_DOC} SELECT doc_id, array_to_string(list_filter(string_split(noised, chr(10)), lambda x: NOT regexp_matches({trim('x')}, '{_UNWANTED}')), chr(10)) AS t FROM n""")
def cln5_drop_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.drop_lines("noised", TEST_EN).alias("t"))


_TOC = r"(?s)^(.*?)\nCONTENTS\n(?:[ \t]*(?:\d+\.[^\n]*)?(?:\n|\z))*(.*)$"


def _toc_sql(x: str) -> str:
    before, after = f"regexp_extract({x}, '{_TOC}', 1)", f"regexp_extract({x}, '{_TOC}', 2)"
    return f"CASE WHEN contains({x}, chr(10) || 'CONTENTS' || chr(10)) THEN {before} || CASE WHEN {after} <> '' THEN chr(10) || {after} ELSE '' END ELSE {x} END"


@query(f"WITH t AS (SELECT doc_id, 'intro' || chr(10) || 'CONTENTS' || chr(10) || '1. ' || lang || chr(10) || chr(10) || '2. two' || chr(10) || text AS x FROM documents) SELECT doc_id, {_toc_sql('x')} AS t FROM t")
def cln4_remove_toc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    toc = F.concat(F.lit("intro\nCONTENTS\n1. "), F.col("lang"), F.lit("\n\n2. two\n"), F.col("text"))
    return rows.select("doc_id", text.remove_toc(toc, TEST_EN).alias("t"))


@query(rf"""WITH {WITH_DOC}, a AS (SELECT doc_id, {INVISIBLE.format('noised')} AS x FROM n), m AS (SELECT doc_id, x, regexp_extract(x, '(?i)\n(Bibliography|References?)([^\pL\pN_]|$)', 0) AS h FROM a),
b AS (SELECT doc_id, CASE WHEN h = '' THEN x ELSE left(x, CAST(strpos(x, h) - 1 AS INT)) END AS x FROM m), c AS (SELECT doc_id, {_toc_sql('x')} AS x FROM b),
d AS (SELECT doc_id, array_to_string(list_filter(string_split(x, chr(10)), lambda y: NOT regexp_matches({trim('y')}, '{_UNWANTED}')), chr(10)) AS x FROM c) SELECT doc_id, {COLLAPSE.format('x')} AS t FROM d""")
def cln6_clean_content(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_content("noised", TEST_EN).alias("t"))


@query(f"WITH {WITH_DOC} SELECT doc_id, array_to_string(list_filter(list_transform(string_split(noised, chr(10)), lambda x: {trim('x')}), lambda x: x <> ''), chr(10)) AS t FROM n")
def cln7_trim_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.trim_lines("noised").alias("t"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE length(text) >= CASE source WHEN 'src0' THEN 300 WHEN 'src1' THEN 800 ELSE 200 END")
def cln8_min_length(spark, sf_dir):
    return clean.min_length(table(spark, sf_dir, "documents"), "text", {"src0": 300, "src1": 800}, "source").select("doc_id", "source", "n_chars")


WORDS = r"len(regexp_extract_all({}, '[^\s]+'))"


@query(rf"SELECT doc_id, CAST({WORDS.format('text')} AS BIGINT) AS word_count FROM documents WHERE {WORDS.format('text')} BETWEEN 150 AND 3000")
def cln9_word_range(spark, sf_dir):
    return clean.word_range(table(spark, sf_dir, "documents"), "text").select("doc_id", "word_count")


@query(f"""WITH {WITH_DOC}, c AS (SELECT noised AS b, {COLLAPSE.format(INVISIBLE.format('noised'))} AS a FROM n),
s AS (SELECT count(*) AS n_in, count(*) FILTER (length(a) >= 200) AS n_out, count(*) FILTER (length(a) >= 200 AND a <> b) AS n_changed FROM c)
SELECT *, n_in - n_out AS n_dropped, round(CASE WHEN n_out > 0 THEN 100.0 * n_changed / n_out ELSE 0 END, 4) AS pct_changed FROM s""")
def cln10_clean_report(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("after", text.collapse_ws(text.strip_invisible("noised")))
    return clean.clean_report(rows, "noised", "after")


@query(rf"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
SELECT CASE WHEN r > 1 THEN 'skipped_dup' WHEN w < 150 THEN 'short' WHEN w > 3000 THEN 'long' ELSE 'kept' END AS reason,
 count(*) AS n, CAST(min(w) AS BIGINT) AS min_words, round(avg(w), 4) AS avg_words, CAST(max(w) AS BIGINT) AS max_words FROM w GROUP BY 1""")
def cln11_filter_report(spark, sf_dir):
    return clean.filter_report(table(spark, sf_dir, "documents"), "text", "doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def cln12_source_allowlist(spark, sf_dir):
    return clean.source_allowlist(table(spark, sf_dir, "documents"), ["src1", "src3", "src5"]).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, count(*) > 0 AS kept FROM documents GROUP BY text")
def cln13_dedup_first(spark, sf_dir):
    return clean.dedup_first(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.lit(True).alias("kept"))


@query("SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 300) ORDER BY doc_id) = 1")
def cln14_dedup_prefix(spark, sf_dir):
    return clean.dedup_prefix(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "text", "doc_id").select("doc_id", "n_chars")


@query(f"WITH {WITH_CONV} SELECT conv_id, turn, role FROM n WHERE {trim('noised')} <> ''")
def cln15_complete_cases(spark, sf_dir):
    return clean.complete_cases(noised_conv(table(spark, sf_dir, "conversations")), ["noised"]).select("conv_id", "turn", "role")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS contexts FROM documents")
def cln16_migrate_field(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("gold_context"))
    return clean.migrate_field(rows).select("doc_id", F.array_join("contexts", "|").alias("contexts"))


@query(f"WITH {WITH_CONV} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS STRING) ELSE 'q_' || left(md5({trim('noised')}), 8) END AS id, {trim('noised')} AS question FROM n")
def cln17_normalize_sample(spark, sf_dir):
    rows = noised_conv(table(spark, sf_dir, "conversations")).withColumn("code", F.when(F.col("turn") % 2 == 0, F.col("conv_id"))).withColumn("question", F.col("noised"))
    return clean.normalize_sample(rows, "question", ["no", "code"]).select("conv_id", "turn", "id", "question")


# chunks

_FLAT = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}), lambda x: x <> ''), ' ')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({_FLAT}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS n, md5(array_to_string({_SENTENCES}, '|')) AS h FROM documents")
def chk1_split_sentences(spark, sf_dir):
    s = chunking.split_sentences("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


def _hashed(rows: DataFrame, chunks) -> DataFrame:
    out = rows.select("doc_id", F.posexplode(chunks).alias("i", "x"))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), F.length("x").cast("long").alias("chars"), F.md5("x").alias("h"))


def _hashed_sql(chunks: str, rows: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT doc_id, i - 1 AS i, length(c[i]) AS chars, md5(c[i]) AS h FROM (SELECT doc_id, c, unnest(range(1, CAST(len(c) + 1 AS BIGINT))) AS i FROM (SELECT {key} AS doc_id, {chunks} AS c FROM {rows}))"


@query(_hashed_sql(chunk_sql.by_length(_SENTENCES, 600, 150, 60, 0)))
def chk2_chunk_range(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_range("text"))


@query(_hashed_sql(chunk_sql.by_length(_SENTENCES, 400, 0, 60, 2)))
def chk3_chunk_fixed(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_fixed("text", 400, overlap=2))


def chunk_words_sql(window: int = 200, stride: int = 150, least: int = 80) -> str:
    return rf"""SELECT doc_id, source, i // {stride} AS i, array_to_string(w[i + 1 : i + {window}], ' ') AS x
 FROM (SELECT doc_id, source, w, unnest(range(0, greatest(len(w), 1), {stride})) AS i FROM (SELECT doc_id, source, regexp_extract_all(text, '[^\s]+') AS w FROM documents))
 WHERE length(array_to_string(w[i + 1 : i + {window}], ' ')) >= {least}"""


@query(f"WITH c AS ({chunk_words_sql()}) SELECT doc_id, length(x) AS chars, md5(x) AS h FROM c")
def chk4_chunk_words(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_words("text")).select("doc_id", "chars", "h")


@query(f"WITH RECURSIVE {chunk_sql.sentence_window('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, i, length(x) AS chars, md5(x) AS h FROM w")
def chk5_sentence_window(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_sentence_window("text"))


@query(rf"""WITH RECURSIVE {chunk_sql.sentence_window('SELECT doc_id AS key, text FROM documents WHERE length(text) > 5000')}
SELECT regexp_replace(md5('rechunk_' || key || '_' || i), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') AS chunk_id, key AS doc_id, i AS chunk_index, md5(x) AS h FROM w
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, 0, md5(text) FROM documents WHERE length(text) <= 5000""")
def chk6_rechunk_oversize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), "text", F.col("text").alias("embed_text"))
    return chunking.rechunk_oversize(rows).select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("h"))


@query(_hashed_sql(chunk_sql.min_punct("text")))
def chk7_chunk_min_punct(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_min_punct("text"))


@query()
def chk8_stream_buffer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    return chunking.chunk_stream_buffer(rows, "key", "seq", "token")


@query(rf"""WITH c AS (SELECT conv_id, turn, text, length({trim('text')}) AS n, regexp_extract(substr(text, 41), '(?s)^(.*?)[.!?,;:…]\s', 0) AS head FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN n >= 200 THEN length(text) WHEN n >= 40 AND head <> '' THEN 40 + length(head) END AS BIGINT) AS cut FROM c""")
def chk9_flush_point(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.flush_point("text").cast("long").alias("cut"))


@query(_hashed_sql(chunk_sql.paragraph_pack("text")))
def chk10_paragraph_pack(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.split_paragraph_pack("text"))


@query()
def chk11_chunk_recursive(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), chunking.chunk_recursive("text"))


@query(_hashed_sql(chunk_sql.last_delim("text"), "conversations", "conv_id * 100 + turn"))
def chk12_split_last_delim(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 100 + F.col("turn"))
    return _hashed(rows, chunking.split_last_delim(F.split("text", "(?<= )")))


@query(f"WITH c AS ({chunk_words_sql()}) SELECT source || '_' || doc_id || '_' || i AS chunk_id, regexp_replace(md5(source || '_' || doc_id || '_' || i), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM c")
def chk13_chunk_id(spark, sf_dir):
    rows = chunking.explode_chunks(table(spark, sf_dir, "documents"), chunking.chunk_words("text", min_chars=0))
    return rows.where(F.length("text") >= 80).select("chunk_id", chunking.uuid_of("chunk_id").alias("uuid"))


@query("SELECT doc_id, md5('passage: ' || CASE WHEN doc_id % 3 = 0 THEN text ELSE source || '. ' || text END) AS h FROM documents")
def chk14_embed_text(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chunking.embed_text(title, "text", "passage: ")).alias("h"))


STATS = """count(*) AS n, CAST(min(l) AS BIGINT) AS min_len, CAST(max(CASE WHEN r = n // 4 THEN l END) AS BIGINT) AS p25, CAST(max(CASE WHEN r = n // 2 THEN l END) AS BIGINT) AS median,
 CAST(max(CASE WHEN r = 3 * n // 4 THEN l END) AS BIGINT) AS p75, CAST(max(l) AS BIGINT) AS max_len, round(avg(l), 4) AS avg_len, round(100.0 * sum(CASE WHEN regexp_matches(x, '[.?!]$') THEN 0 ELSE 1 END) / count(*), 4) AS pct_open"""


def chunk_stats(chunks: DataFrame, by: str = "config") -> DataFrame:
    """One row of length statistics per configuration; quartiles by rank (n // 4, n // 2, 3n // 4).

    Ranks come from the number of chunks of each length, of which there are few, and a running total over them.
    """
    from pyspark.sql.window import Window

    rows = chunks.groupBy(by, F.length("x").alias("l")).agg(F.count("*").alias("c"), F.count_if(~F.col("x").rlike("[.?!]$")).alias("open"))
    w = Window.partitionBy(by)
    rows = rows.withColumn("upto", F.sum("c").over(w.orderBy("l"))).withColumn("m", F.sum("c").over(w))
    at = lambda e, name: F.min(F.when(F.col("upto") > F.floor(F.expr(e)), F.col("l"))).cast("long").alias(name)
    return rows.groupBy(by).agg(
        F.sum("c").alias("n"), F.min("l").cast("long").alias("min_len"), at("m / 4", "p25"), at("m / 2", "median"), at("3 * m / 4", "p75"), F.max("l").cast("long").alias("max_len"),
        F.round(F.sum(F.col("c") * F.col("l")) / F.sum("c"), 4).alias("avg_len"), F.round(100.0 * F.sum("open") / F.sum("c"), 4).alias("pct_open"),
    )


def _labelled(spark, sf_dir, window, stride) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.lit(f"w{window}").alias("config"), "doc_id", F.explode(chunking.chunk_words("text", window, stride)).alias("x"))


@query(f"""WITH c AS ({chunk_words_sql()}), r AS (SELECT 'w200' AS config, x, length(x) AS l, row_number() OVER (ORDER BY length(x)) - 1 AS r, count(*) OVER () AS n FROM c),
d AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1)
SELECT config, {STATS.replace('n //', 'r.n //')}, (SELECT count(*) FROM d WHERE k >= 10) AS docs_ge10, (SELECT count(*) FROM d WHERE k >= 5) AS docs_ge5, (SELECT count(*) FROM d WHERE k = 1) AS docs_1 FROM r GROUP BY config""")
def chk15_chunk_stats(spark, sf_dir):
    rows = _labelled(spark, sf_dir, 200, 150)
    k = rows.groupBy("config", "doc_id").count().groupBy("config").agg(F.count_if(F.col("count") >= 10).alias("docs_ge10"), F.count_if(F.col("count") >= 5).alias("docs_ge5"), F.count_if(F.col("count") == 1).alias("docs_1"))
    return chunk_stats(rows).join(k, "config")


@query(f"""WITH c AS (SELECT 'w200' AS config, * FROM ({chunk_words_sql()}) UNION ALL SELECT 'w100' AS config, * FROM ({chunk_words_sql(100, 100)})),
r AS (SELECT config, x, length(x) AS l, row_number() OVER (PARTITION BY config ORDER BY length(x)) - 1 AS r, count(*) OVER (PARTITION BY config) AS n FROM c)
SELECT config, {STATS.replace('n //', 'r.n //')} FROM r GROUP BY config""")
def chk16_compare_chunkers(spark, sf_dir):
    return chunk_stats(_labelled(spark, sf_dir, 200, 150).union(_labelled(spark, sf_dir, 100, 100)))


# normalising


def _alias_sql(x: str) -> str:
    for a, b in TEST_EN.aliases:
        x = f"regexp_replace({x}, '(?i){a}', '{b}', 'g')"
    return x


_ASR = rf"regexp_replace({trim('lower(text)')}, '\s+', ' ', 'g')"
for _a, _b in TEST_EN.asr_fixes:
    _ASR = f"replace({_ASR}, '{_a}', '{_b}')"


@query(f"SELECT conv_id, turn, md5({_alias_sql('text')}) AS h FROM conversations")
def nrm1_expand_aliases(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.expand_aliases("text", TEST_EN.aliases)).alias("h"))


@query(f"SELECT doc_id, md5({_alias_sql('text')}) AS h FROM documents")
def nrm1_expand_dictionary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(dictionary.expand_aliases("text", TEST_EN.aliases)).alias("h"))


@query(f"SELECT conv_id, turn, md5({_alias_sql(_ASR)}) AS h FROM conversations")
def nrm2_asr_fixups(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.asr_fixups("text", TEST_EN)).alias("h"))


_SCORE = r"""regexp_replace(upper(replace(noised, 'ß', 'ss')), '["''`‘’“”.,;:!?()\[\]{}\-–—/|]', ' ', 'g')"""
_SIMPLE = trim(r"regexp_replace(regexp_replace(lower({}), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g')")


def _digit_sql(x: str) -> str:
    for d, w in TEST_EN.digits.items():  # twice: matches that share a bound
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\pL\pN_])({d})($|[^\pL\pN_])', '\1{w}\3', 'g')"
    return x


@query(f"WITH {WITH_DOC} SELECT doc_id, md5({trim(f'''regexp_replace({_digit_sql(_SCORE)}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')''')}) AS h FROM n")
def nrm3_score_norm(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.score_norm("noised", TEST_EN.digits, compose=False)).alias("h"))


@query(f"SELECT doc_id, md5({_SIMPLE.format('text')}) AS h FROM documents")
def nrm4_simple_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.simple_norm("text")).alias("h"))


_MD = "noised"
for _p, _r in ((r"\*{1,3}([^*\n]+)\*{1,3}", r"\1"), (r"_{1,3}([^_\n]+)_{1,3}", r"\1"), (r"(?m)^#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*[0-9]+\.[ \t]+", ""), (r"`{1,3}([^`]*)`{1,3}", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\n+", " ")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_r}', 'g')"


@query(f"WITH {WITH_DOC} SELECT doc_id, md5({trim(_MD)}) AS h FROM n")
def nrm5_strip_markdown(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.strip_markdown("noised")).alias("h"))


LINKS = r"regexp_replace(noised, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
URL = r"(?i)https?://[^\s]+|www\.[^\s]+"
VOICE = rf"regexp_replace(regexp_replace({LINKS}, '{URL}', '', 'g'), '[ \t\n\r\f\v]{{2,}}', ' ', 'g')"


@query(f"WITH {WITH_DOC} SELECT doc_id, md5({VOICE}) AS h, regexp_matches({LINKS}, '{URL}') AS removed_url FROM n")
def nrm6_voice_clean(spark, sf_dir):
    v = text.voice_clean("noised")
    return docs(spark, sf_dir).select("doc_id", F.md5(v["text"]).alias("h"), v["removed_url"].alias("removed_url"))


@query(rf"WITH {WITH_DOC} SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(noised, chr(10)), lambda x: {trim('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)(ignore\s+(all\s+)?previous\s+instructions|system\s+prompt)')), chr(10))) AS h FROM n")
def nrm7_drop_injection_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.drop_injection_lines("noised", TEST_EN)).alias("h"))


@query(f"WITH {WITH_DOC} SELECT doc_id, md5({trim(r'''regexp_replace(noised, '[ \t\n\r\f\v]*\(\p{Lu}{2}[^()]*\)', '', 'g')''')}) AS h FROM n")
def nrm8_strip_source_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.strip_source_tags("noised")).alias("h"))


@query()
def nrm9_spoken_form(spark, sf_dir):
    said = F.concat(F.lit("nhiệt độ "), (F.col("doc_id") % 40).cast("string"), F.lit("°C lúc 7:30, "), (F.col("n_chars") % 100).cast("string"), F.lit("% <en>5 km</en> "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.spoken_form(said)).alias("h"))


@query()
def nrm10_number_words(spark, sf_dir):
    said = F.concat(F.lit("có "), (F.col("doc_id") * 7919 % 2_000_003).cast("string"), F.lit(" và "), F.col("n_chars").cast("string"), F.lit(" ký tự: "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.numbers_to_words(said)).alias("h"))


_W = r"SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents"


@query(rf"""WITH w AS ({_W}), c AS (SELECT *, regexp_extract(tok, '^[^\pL\pN]*', 0) AS a, regexp_replace(tok, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') AS core FROM w),
lex AS (SELECT lower(n_name) AS k, 'x' AS v FROM nation UNION ALL SELECT * FROM (VALUES ('the', 'ði'), ('and', 'ænd'), ('que', 'ke'), ('der', 'deɐ')) t(k, v))
SELECT doc_id, md5(string_agg(CASE WHEN v IS NULL THEN tok ELSE replace(tok, core, v) END, ' ' ORDER BY pos)) AS h FROM c LEFT JOIN lex ON lower(core) = k GROUP BY doc_id""")
def nrm11_lexicon_lookup(spark, sf_dir):
    return lexicon_lookup(table(spark, sf_dir, "documents"), _lexicon(spark, sf_dir)).select("doc_id", F.md5("text").alias("h"))


def _lexicon(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("k"), F.lit("x").alias("v"))
    return names.union(spark.createDataFrame([("the", "ði"), ("and", "ænd"), ("que", "ke"), ("der", "deɐ")], "k string, v string"))


def _cores(rows: DataFrame) -> DataFrame:
    toks = rows.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "tok"))
    return toks.withColumn("core", F.regexp_replace("tok", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def lexicon_lookup(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every token's core replaced by the lexicon's entry, its punctuation kept, in order."""
    hit = _cores(rows).join(lexicon, F.lower("core") == F.col("k"), "left")
    said = F.when(F.col("v").isNull(), F.col("tok")).otherwise(F.replace("tok", F.col("core"), F.col("v")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"])
    return hit.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("text"))


@query(rf"""WITH w AS ({_W}), c AS (SELECT lower(regexp_replace(tok, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')) AS core FROM w),
lex AS (SELECT lower(n_name) AS k FROM nation UNION ALL SELECT * FROM (VALUES ('the'), ('and'), ('que'), ('der')) t(k))
SELECT core, count(*) AS n FROM c WHERE core <> '' AND core NOT IN (SELECT k FROM lex) GROUP BY core""")
def nrm12_lexicon_oov(spark, sf_dir):
    cores = _cores(table(spark, sf_dir, "documents")).select(F.lower("core").alias("core")).where("core <> ''")
    return cores.join(_lexicon(spark, sf_dir), F.col("core") == F.col("k"), "left_anti").groupBy("core").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5('theo Điều ' || (doc_id % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' của Luật này ' ELSE ' Luật An toàn ' END || text) AS h FROM documents")
def nrm13_qualify_refs(spark, sf_dir):
    said = F.concat(F.lit("theo Điều "), (F.col("doc_id") % 9 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(" của Luật này ")).otherwise(F.lit(" ")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.qualify_refs(said, "Luật An toàn", ["Luật", "Nghị định", "Thông tư"])).alias("h"))


@query("SELECT doc_id, CAST(0 AS INTEGER) AS pos, lang AS aspect FROM documents UNION ALL SELECT doc_id, 1, source FROM documents")
def nrm14_parse_llm_json(spark, sf_dir):
    said = F.concat(F.lit("<think>no {</think>```json\n{\"aspects\": [\""), F.col("lang"), F.lit("\", \""), F.col("source"), F.lit("\"]}\n``` end"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.parse_llm_json(said, "aspects array<string>").alias("j"))
    return rows.select("doc_id", F.posexplode("j.aspects").alias("pos", "aspect"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')[1:4], chr(10))) AS h FROM documents")
def nrm15_query_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.query_lines("text"), "\n")).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS t FROM documents")
def nrm16_truncate_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_hint("text", 60).alias("t"))
