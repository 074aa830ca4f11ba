"""Secret scans, in DataFrame functions only.

Three fixed patterns give the base spans.  Beside them, two first-order character Markov models, of random
strings and of ordinary identifiers, score every long run of token characters by their log-likelihood ratio;
a run that is likelier random is a span of kind ``random`` unless a base span overlaps it.  The models are
counted in Spark from labelled samples: identifiers from a bounded sample of documents, and random strings
made from digests of the same rows in the notations that keys come in.  The sample only fits the model;
every whole text is scanned.

Null texts are empty: no spans.  Empty tables give no rows; their model is flat and finds nothing.  Repeated
rows are scanned each, and train the model once.  Ties between spans are ordered by kind.  Texts of any length are scanned whole.
Extra columns pass through ``redact``, whatever their names.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import stored, unused

# fixed values: the base patterns and the least lengths of what they match
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
#: About as many documents train the model of ordinary identifiers, those with the smallest hashes of id and text.
TRAIN_DOCS = 2000
#: Tasks that the sample is dealt to, as each of its texts makes thousands of strings.
TRAIN_TASKS = 24
#: Nats by which a run must be likelier random, and nats per character.
MARGIN, PER_CHAR = 12.0, 0.4

#: Matches of a text that are folded at once.
CHUNK = 256

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _chunks(items: Column) -> Column:
    """An array in pieces of CHUNK items."""
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(a, i + 1, F.lit(CHUNK)))
    return F.transform(F.array(items), cut)[0]  # what a lambda is given is computed once


def _folded(items: Column, state: Column, step) -> Column:
    """The spans that ``step(state, item)``, a new state and an array of spans, gives along ``items``.

    Spans are gathered by pieces of the items and the pieces put together, so that a text of n matches costs n times CHUNK, not n squared.
    """
    empty = F.expr(f"cast(array() as {_SPAN})")

    def item(acc, x):
        new, given = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], given).alias("out"))

    def piece(acc, chunk):
        done = F.aggregate(chunk, F.struct(acc["state"].alias("state"), empty.alias("out")), item)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out"))
    return F.aggregate(_chunks(items), start, piece, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.array(F.struct(start.alias("start"), kind.alias("kind"), end.alias("end")))


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """The matches of a pattern as spans in code points, from the pieces between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    empty = F.expr(f"cast(array() as {_SPAN})")

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() if ok is None else x["hit"].isNotNull() & ok(x["hit"])
        return end, F.when(good, _span(start, F.lit(kind), end)).otherwise(empty)

    return F.when(text.rlike(pattern), _folded(both, F.lit(0), step)["out"]).otherwise(empty)


def _free(spans: Column) -> Column:
    """Spans in order without those of kind 3 that overlap one of another kind; spans of kind 3 don't overlap each other."""
    empty = F.expr(f"cast(array() as {_SPAN})")
    kept = lambda st: F.when(st["start"] >= 0, _span(st["start"], F.lit(3), st["end"])).otherwise(empty)

    def step(st, x):
        """reach: where the spans of other kinds end so far; start, end: of the last span of kind 3 while it may be overlapped."""
        more = x["kind"] == 3
        late = x["start"] >= st["end"]  # nothing later can overlap the one that waits
        waits = more & (x["start"] >= st["reach"])
        stays = ~more & late | more
        new = F.struct(
            F.when(more, st["reach"]).otherwise(F.greatest(st["reach"], x["end"])).alias("reach"),
            F.when(waits, x["start"]).otherwise(F.lit(-1)).alias("start"),
            F.when(waits, x["end"]).otherwise(F.lit(-1)).alias("end"),
        )
        return new, F.concat(F.when(stays, kept(st)).otherwise(empty), F.when(more, empty).otherwise(F.array(x)))

    start = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    done = _folded(spans, start, step)
    return F.transform(F.array(done), lambda d: F.array_sort(F.concat(d["out"], kept(d["state"]))))[0]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_DOCS) -> DataFrame:
    """Labelled strings (s, label): 1 random, 0 an ordinary identifier, from a bounded number of documents.

    Hashes are even, so that those under rows / (number of documents) of their range are about ``rows``; no order is needed.
    """
    share = min(1.0, rows / max(1, docs.count()))
    keyed = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    some = keyed.where(F.col("key") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).dropDuplicates(["key"])
    some = stored(some.select("id", "text"), "sample").repartition(TRAIN_TASKS)
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z][a-z]*"), F.lit(0))
    some = some.select("id", F.filter(words, lambda w: F.length(w) > 1).alias("w"))

    def made(i):
        d = lambda n: F.sha2(F.concat_ws(":", F.lit(n), i, F.col("id")), 256)
        return F.array(
            F.base64(F.unhex(d("a"))),
            F.substring(d("b"), 1, 40),
            F.upper(F.substring(F.conv(F.substring(d("c"), 1, 15), 16, 36), 1, 11)),
            F.substring(F.base64(F.unhex(d("d"))), 1, 40),
            F.lower(F.substring(F.conv(F.substring(d("e"), 1, 15), 16, 36), 1, 11)),
        )

    pairs = F.zip_with("w", F.slice(F.col("w"), 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    named = F.transform(
        F.filter(pairs, lambda p: p["b"].isNotNull()),
        lambda p: F.array(p["a"], F.concat(p["a"], F.lit("_"), p["b"]), F.concat(F.lower(p["a"]), F.initcap(p["b"])), F.concat(p["a"], F.lit("-"), p["b"]), F.concat(F.upper(p["a"]), F.lit("_"), F.upper(p["b"])), F.concat(p["a"], F.lit("/"), p["b"], F.length(p["b"]).cast("string"))),
    )
    random = some.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: made(i.cast("string"))))).alias("s"), F.lit(1).alias("label"))
    return some.select(F.explode(F.flatten(named)).alias("s"), F.lit(0).alias("label")).union(random)


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios random : ordinary of a character after another, flattened; counted in Spark."""
    n = len(ALPHABET)
    code = F.filter(F.transform(F.split("s", ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)
    coded = labelled.select("label", code.alias("c"))
    two = F.zip_with("c", F.slice(F.col("c"), 2, 1 << 30), lambda a, b: (a - 1) * n + b - 1)
    seen = coded.select("label", F.explode(F.filter(two, lambda x: x.isNotNull())).alias("pair")).groupBy("label", "pair").count()
    counts = np.full((2, n, n), smooth)
    for r in seen.collect():  # at most 2 * n * n rows
        counts[r["label"], r["pair"] // n, r["pair"] % n] += r["count"]
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    return np.round(p[1] - p[0], 6).ravel().tolist()


def _ratio(table: Column) -> object:
    n = len(ALPHABET)

    def score(run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(acc, c):
            add = F.when((acc["last"] >= 0) & (c >= 0), F.element_at(table, F.greatest(acc["last"] * n + c + 1, F.lit(1)))).otherwise(F.lit(0.0))
            return F.struct(c.alias("last"), (acc["sum"] + add).alias("sum"))

        return F.aggregate(codes, start, step, lambda acc: acc["sum"])

    return score


def scan(docs: DataFrame, model: list[float], text_col: str = "text", margin: float = MARGIN, per_char: float = PER_CHAR, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two more columns, named by ``base`` and ``spans``: arrays of (start, kind, end) in code points, in order."""
    assert len(model) == len(ALPHABET) ** 2 and all(math.isfinite(x) for x in model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    score = _ratio(table)
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    likely = lambda hit: score(hit) >= F.greatest(F.lit(margin), per_char * F.length(hit))
    found = docs.withColumn(base, F.array_sort(F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    (more,) = unused(found, "more")
    found = found.withColumn(more, _spans(text, RUN, 3, likely))
    return found.withColumn(spans, F.when(F.size(more) == 0, F.col(base)).otherwise(_free(F.array_sort(F.concat(base, more))))).drop(more)


def named(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), train(samples(docs, id_col, text_col)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with every span of the texts replaced by ``mark``; overlapping spans by one."""
    base, spans = unused(docs, "base", "spans")
    found = scan(docs, train(samples(docs, id_col, text_col)), text_col, base=base, spans=spans)

    def step(st, x):
        """Overlapping spans become one; the last one waits for more."""
        apart = x["start"] >= st["end"]
        new = F.struct(F.when(apart, x["start"]).otherwise(st["start"]).alias("start"), F.greatest(st["end"], x["end"]).alias("end"))
        return new, F.when(apart & (st["start"] >= 0), _span(st["start"], F.lit(0), st["end"])).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    text = F.col(text_col)
    joined = _folded(F.col(spans), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), step)
    joined = F.transform(F.array(joined), lambda d: F.concat(d["out"], _span(d["state"]["start"], F.lit(0), d["state"]["end"])))[0]

    def cut(chunks):
        """Each piece's part of the text, cut out of the whole once, with its spans replaced, and what is left."""
        ends = F.transform(chunks, lambda c: F.element_at(c, -1)["end"])

        def part(c, i):
            low = F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
            held = F.array(F.struct(low.alias("low"), F.substr(text, low + 1, F.element_at(c, -1)["end"] - low).alias("text")))
            from_ = lambda h, j: F.when(j == 0, h["low"]).otherwise(F.element_at(c, F.greatest(j, F.lit(1)))["end"])
            piece = lambda h: F.transform(c, lambda x, j: F.concat(F.substr(h["text"], from_(h, j) - h["low"] + 1, x["start"] - from_(h, j)), F.lit(mark)))
            return F.transform(held, lambda h: F.array_join(piece(h), ""))[0]

        return F.concat(F.array_join(F.transform(chunks, part), ""), F.substr(text, F.element_at(ends, -1) + 1))

    whole = F.transform(F.array(_chunks(joined)), cut)[0]
    return found.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(docs.columns)
