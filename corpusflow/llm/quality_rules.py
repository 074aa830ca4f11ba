"""Document quality rules, and cross-document line frequency per host.

``measure`` counts words, symbols, repeated lines and repeated 8-word windows of each text in one pass.
``template_lines`` finds the lines that a host repeats over many different documents: normalised lines are
hashed and counted per host by different texts.  Around every line above the limit, alone or in a block of such lines,
stand the document's own lines; a boilerplate line has other ones around it in nearly every document, while copies, edited
ones too, keep theirs.  An own line is told by its smallest word and the two after it, which most edits leave alone.
A document that boilerplate leaves with too little text is rejected as depleted; ``clean`` cuts it out of the rest.

Null texts have no words.  A null host is a host of its own.  Ties don't arise: counts decide.  Rows are judged by host and
text alone, told apart by a 64-bit hash of both: equal rows, null ids and repeated ids need no rule.  Texts of any length are taken
whole.  Extra columns pass through ``keep`` and ``clean``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import vec
from corpusflow.llm.shared import identity, stored, unused

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: A line is boilerplate on a host if at least this many different texts have it ...
LINE_DOCS = 20
#: ... with as many different own lines before or after it as this share of those texts.
NEIGHBOUR_SHARE = 0.6
#: A document is depleted if fewer words than this are left, or less than this share of its words.
LEAST_WORDS, LEAST_SHARE = 20, 0.3

_SPACE = r"[\x20\x09-\x0D]+"


def _measure(batches):
    for part in vec.slices(batches, "text"):
        data, off = vec.utf8(part.column(1))
        n = len(off) - 1
        inside = ~vec.WHITE[data]
        starts, ends, row = vec.runs(inside, off)
        prefix = vec.prefix_hash(data)
        h = vec.span_hash(prefix, starts, ends)
        at, win = vec.windows(h, row, 8)
        key = vec.mix(win + row[at].astype(np.uint64) * vec.BASE)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = vec.cover(at[twice], 8, len(h))
        lines, stops, owner = vec.runs(data != 10, off)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside, out=total[1:])
        real = total[stops] > total[lines]
        line_key = vec.mix(vec.span_hash(prefix, lines[real], stops[real]) + owner[real].astype(np.uint64) * vec.BASE)
        _, first = np.unique(line_key, return_index=True)
        cols = [
            np.bincount(row, minlength=n),
            vec.counts(inside & ((data & 0xC0) != 0x80), off),
            vec.counts(SYMBOL[data], off),
            np.bincount(owner[real], minlength=n) - np.bincount(owner[real][first], minlength=n),
            np.bincount(row[covered], minlength=n),
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [pa.array(c.astype(np.int64)) for c in cols], ["doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None) -> DataFrame:
    """doc_id, key (see ``row_key``), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, a row per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    key = row_key(host_col, text_col) if host_col else F.lit(None).cast("binary")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key")).mapInArrow(
        _measure, f"doc_id {kind}, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def _level(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), _SPACE, " "), "[0-9]+", "0"))


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\x00"))


def row_key(host_col: str, text_col: str):
    return identity(host_col, text_col)


def lines(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """A row per row of ``docs`` with lines that hold a word: key and its lines, each by a hash of the host and the line (case, digits and white space levelled), number of words and a mark that edits elsewhere in the line leave alone."""
    parts = F.filter(F.transform(F.split(F.col(text_col).cast("string"), "\n"), _level), lambda x: x != "")

    def told(words):
        mark = F.slice(words, F.array_position(words, F.array_min(words)).cast("int"), 3)
        return F.struct(_line(_host(host_col), F.array_join(words, " ")).alias("line"), F.size(words).alias("w"), F.xxhash64(F.array_join(mark, " ")).alias("mark"))

    rows = docs.select(row_key(host_col, text_col).alias("key"), F.transform(F.transform(parts, lambda x: F.split(x, " ")), told).alias("lines"))
    return stored(rows.where("size(lines) > 0"), "lines")


def _line(host, level):
    return F.xxhash64(host, level)


def _often(texts: DataFrame, line_docs: int) -> DataFrame:
    """The lines (key, line, w, before, after) that many texts of their host have, with the nearest own lines on either side; once a text."""
    many = lambda rows: rows.groupBy("line").count().where(F.col("count") >= line_docs).select("line")
    at = texts.select("key", F.posexplode("lines").alias("i", "x")).select("key", "i", "x.*")
    # by rows first, which leaves few lines; then by different texts
    some = at.select("key", "i", "line").join(stored(many(at), "many"), "line").dropDuplicates(["key", "i"])
    some = stored(some, "some")
    hits = stored(some.join(many(some.select("key", "line").distinct()), "line").select("key", "i"), "hits")
    near = at.join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key", "i"]).join(hits.withColumn("often", F.lit(True)), ["key", "i"], "left")
    own = F.last(F.when(F.col("often").isNull(), F.col("mark")), ignorenulls=True)
    upward, downward = (Window.partitionBy("key").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("i"), F.col("i").desc()))
    near = near.withColumn("before", own.over(upward)).withColumn("after", own.over(downward))
    return stored(near.where("often").select("key", "line", "w", "before", "after"), "near")


def template_lines(near: DataFrame, line_docs: int = LINE_DOCS, neighbour_share: float = NEIGHBOUR_SHARE) -> DataFrame:
    """The lines above the limits; exact counts over all documents."""
    n = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  a missing neighbour counts as one
    found = near.groupBy("line").agg(n("key").alias("docs"), n("before").alias("b"), n("after").alias("a"))
    return found.where((F.col("docs") >= line_docs) & (F.greatest("a", "b") >= F.col("docs") * neighbour_share)).select("line")


def _boilerplate(docs: DataFrame, host_col: str, text_col: str, line_docs: int, neighbour_share: float) -> DataFrame:
    """Per key of a text with boilerplate: how many words it has in such lines, and their hashes."""
    near = _often(lines(docs, host_col, text_col), line_docs)
    gone = near.join(template_lines(near, line_docs, neighbour_share), "line").groupBy("key")
    return stored(gone.agg(F.sum("w").alias("n_template_words"), F.collect_set("line").alias("template")), "boilerplate")


def _judged(counted: DataFrame, gone: DataFrame, least_words: int, least_share: float) -> DataFrame:
    out = counted.join(gone, "key", "left").withColumn("n_template_words", F.coalesce("n_template_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_template_words")
    depleted = (F.col("n_template_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", line_docs: int = LINE_DOCS, neighbour_share: float = NEIGHBOUR_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``measure`` plus n_template_words and kept, a row per row of ``docs``."""
    gone = _boilerplate(docs, host_col, text_col, line_docs, neighbour_share).drop("template")
    return _judged(measure(docs, id_col, text_col, host_col), gone, least_words, least_share).drop("key")


def _verdicts(docs: DataFrame, host_col: str, text_col: str, line_docs: int, neighbour_share: float, least_words: int, least_share: float) -> DataFrame:
    """Per key that fails or has boilerplate: key, kept and template (hashes of lines), under names that ``docs`` doesn't have."""
    gone = _boilerplate(docs, host_col, text_col, line_docs, neighbour_share)
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    found = _judged(measure(rows, "id", "text", "host"), gone, least_words, least_share).where("not kept or template is not null").dropDuplicates(["key"])
    return found.select(*(F.col(c).alias(n) for c, n in zip(("key", "kept", "template"), unused(docs, "key", "kept", "template"))))


def keep(docs: DataFrame, host_col: str = "source", text_col: str = "text", line_docs: int = LINE_DOCS, neighbour_share: float = NEIGHBOUR_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the rules."""
    found = _verdicts(docs, host_col, text_col, line_docs, neighbour_share, least_words, least_share)
    key, kept, _ = found.columns
    return docs.join(found.where(~F.col(kept)).select(key), row_key(host_col, text_col) == F.col(key), "left_anti")


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", line_docs: int = LINE_DOCS, neighbour_share: float = NEIGHBOUR_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``keep`` with the boilerplate lines cut out of the texts; a text without one stays as it is."""
    found = _verdicts(docs, host_col, text_col, line_docs, neighbour_share, least_words, least_share)
    key, kept, template = found.columns
    own = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(template, _line(_host(host_col), _level(x))))
    out = docs.join(found, row_key(host_col, text_col) == F.col(key), "left").where(F.coalesce(kept, F.lit(True)))
    return out.withColumn(text_col, F.when(F.col(template).isNotNull(), F.array_join(own, "\n")).otherwise(F.col(text_col))).select(docs.columns)
