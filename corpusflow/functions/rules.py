"""Rule classification and guardrails over texts, driven by pattern packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.packs import VI_DEFAULT, Pack
from corpusflow.functions.text import ColumnLike, any_word, col, strip, voice_clean


def first_group(text: Column, groups, default: str) -> Column:
    """The label of the first group with a matching word."""
    return F.coalesce(*(F.when(text.rlike(any_word(p)), F.lit(label)) for label, p in groups), F.lit(default))


def assess_safety(q: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """empty_query, medical_emergency, clinical_decision, out_of_scope or normal; the first that applies."""
    text = strip(F.lower(F.coalesce(col(q), F.lit(""))))
    return F.when(text == "", F.lit("empty_query")).otherwise(first_group(text, pack.safety, "normal"))


def with_safety(df: DataFrame, q: str, pack: Pack = VI_DEFAULT) -> DataFrame:
    """``df`` with safety, triggered and message; the messages are a table of a few rows."""
    table = df.sparkSession.createDataFrame(list(pack.messages.items()), "safety string, message string")
    out = df.withColumn("safety", assess_safety(q, pack)).withColumn("triggered", F.col("safety") != "normal")
    return out.join(F.broadcast(table), "safety", "left")


def semantic_signature(q: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """struct(audience, condition, intent)."""
    text = strip(F.regexp_replace(F.lower(F.coalesce(col(q), F.lit(""))), r"\s+", " "))
    return F.struct(
        first_group(text, pack.audience, "general").alias("audience"),
        first_group(text, pack.condition, "general").alias("condition"),
        first_group(text, pack.intent, "general_information").alias("intent"),
    )


def signature_key(signature: Column) -> Column:
    return F.concat_ws("|", *(F.concat(F.lit(f"{f}="), signature[f]) for f in ("audience", "condition", "intent")))


def assess_evidence(queries: DataFrame, docs: DataFrame, key: str, text: str, min_docs: int = 1, min_chars: int = 120) -> DataFrame:
    """Per query: sufficient, reason, doc_count, total_chars; queries without a document are kept."""
    got = docs.groupBy(key).agg(F.count("*").alias("doc_count"), F.sum(F.length(strip(F.coalesce(F.col(text), F.lit(""))))).alias("total_chars"))
    out = queries.select(key).distinct().join(got, key, "left").fillna(0, ["doc_count", "total_chars"])
    reason = F.when(F.col("doc_count") < min_docs, "no_retrieved_document").when(F.col("total_chars") < min_chars, "retrieved_context_too_short").otherwise("sufficient")
    return out.withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "sufficient")


def output_safety(text: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """struct(safe, needs_disclaimer, removed_url, unsafe_claim)."""
    clean = voice_clean(text)
    unsafe = clean["text"].rlike(any_word(pack.unsafe_claims))
    return F.struct((~unsafe).alias("safe"), (~F.contains(F.lower(clean["text"]), F.lit(pack.disclaimer.lower()))).alias("needs_disclaimer"), clean["removed_url"].alias("removed_url"), unsafe.alias("unsafe_claim"))


def missing_disclaimer_suffix(text: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(pack.disclaimer.lower())), F.lit("")).otherwise(F.lit(" " + pack.disclaimer))


def validate_qa(question: ColumnLike, answer: ColumnLike, skip: Column, bad: str, min_words: int = 90) -> Column:
    """skipped, missing, bad_pattern, short_answer or ok, in this order."""
    q, a = (strip(F.coalesce(col(c), F.lit(""))) for c in (question, answer))
    words = F.regexp_count(a, F.lit(r"\S+"))
    return F.when(skip, "skipped").when((q == "") | (a == ""), "missing").when(q.rlike(bad) | a.rlike(bad), "bad_pattern").when(words < min_words, "short_answer").otherwise("ok")


def length_bucket(words: Column) -> Column:
    return F.when(words <= 10, "<=10").when(words <= 20, "11-20").otherwise(">20")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds <= 5, "0-5").when(seconds <= 10, "5-10").otherwise(">10")


def score_bucket(score: Column) -> Column:
    return F.when(score >= 3, ">=3").when(score >= 2, "2-3").when(score >= 1, "1-2").when(score >= 0.5, "0.5-1").otherwise("<0.5")


def threshold_grade(value: Column, good: float, acceptable: float, lower_is_better: bool = True) -> Column:
    if lower_is_better:
        return F.when(value <= good, "good").when(value <= acceptable, "acceptable").otherwise("bad")
    return F.when(value >= good, "good").when(value >= acceptable, "acceptable").otherwise("bad")
