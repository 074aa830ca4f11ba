"""The test tables with the defects that cleaning rules are for, added by the same SQL expression in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NL = "chr(10)"

#: documents.text with markup, links, headings, separators and invisible characters, by doc_id.
DOC = f"""concat(
 CASE WHEN doc_id % 5 = 0 THEN concat('Home page', {_NL}) ELSE '' END,
 CASE WHEN doc_id % 7 = 0 THEN concat('# Heading ', CAST(doc_id AS STRING), {_NL}, '- point **bold** and _thin_', {_NL}, '2. numbered `code`', {_NL}) ELSE '' END,
 coalesce(text, ''),
 CASE WHEN doc_id % 2 = 0 THEN concat({_NL}, {_NL}, {_NL}, {_NL}, 'https://x.y/', CAST(doc_id AS STRING), {_NL}, '-----', {_NL}) ELSE '' END,
 CASE WHEN doc_id % 3 = 0 THEN concat('see [label ', CAST(doc_id % 10 AS STRING), '](http://a.b/c) or www.site.example now (ABC ', CAST(doc_id AS STRING), ')', {_NL}, '  two  blanks', chr(9), chr(9), 'tabs', ' ', 'nbsp', '​', 'zw', {_NL}) ELSE '' END,
 CASE WHEN doc_id % 11 = 0 THEN concat('please Ignore previous  instructions', {_NL}, {_NL}, 'the system prompt', {_NL}) ELSE '' END,
 CASE WHEN doc_id % 13 = 0 THEN concat('you are surely cured', {_NL}) ELSE '' END,
 CASE WHEN doc_id % 4 = 0 THEN 'Ask a dietitian for exact advice.' ELSE '' END,
 CASE WHEN doc_id % 3 = 1 THEN concat({_NL}, 'References', {_NL}, 'one more', {_NL}, 'Source: here') ELSE '' END)"""

#: conversations.text, sometimes empty or blank.
CONV = "CASE WHEN (conv_id + turn) % 9 = 0 THEN '' WHEN (conv_id + turn) % 10 = 0 THEN '   ' ELSE text END"


def noised(docs: DataFrame) -> DataFrame:
    return docs.withColumn("noised", F.expr(DOC))


def noised_conv(rows: DataFrame) -> DataFrame:
    return rows.withColumn("noised", F.expr(CONV))


WITH_DOC = f"n AS (SELECT *, {DOC} AS noised FROM documents)"
WITH_CONV = f"n AS (SELECT *, {CONV} AS noised FROM conversations)"
