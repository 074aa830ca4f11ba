"""Splitting texts into sentences and chunks.  Every function returns an array of strings per text.

Sentence packers are folds over the sentence array (``aggregate``), so a chunking job is one projection followed by
``posexplode``; the few splitters that step back or recurse are Arrow-batched helpers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.folding import fold, once
from corpusflow.functions.text import ColumnLike, col, strip

_NONE = "cast(array() as array<string>)"


def _tidy(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _split_after(c: Column, marks: str) -> Column:
    return F.split(c, rf"(?<=[{marks}])\s+")


def split_sentences(c: ColumnLike) -> Column:
    """Sentences of the text with its lines run together."""
    flat = F.array_join(_tidy(F.split(col(c), "\n")), " ")
    return _tidy(_split_after(flat, ".!?"))


def split_paragraph_sentences(c: ColumnLike) -> Column:
    """Sentences that don't run over line ends."""
    return F.flatten(F.transform(_tidy(F.split(col(c), "\n")), lambda p: _tidy(_split_after(p, ".?!"))))


def pack_words(sentence: Column, size: int, least: int) -> Column:
    """A sentence's words joined up to ``size`` characters; pieces under ``least`` are dropped."""

    none = F.expr(_NONE)

    def step(st, w):
        joined = F.when(st["sub"] == "", w).otherwise(F.concat_ws(" ", st["sub"], w))
        full = F.length(joined) > size
        kept = F.when(full & (st["sub"] != "") & (F.length(st["sub"]) >= least), F.array(st["sub"])).otherwise(none)
        return F.struct(F.when(full, w).otherwise(joined).alias("sub")), kept

    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    last = lambda d: F.when((d["state"]["sub"] != "") & (F.length(d["state"]["sub"]) >= least), F.array(d["state"]["sub"])).otherwise(none)
    return once(fold(words, F.struct(F.lit("").alias("sub")), step, "string"), lambda d: F.concat(d["out"], last(d)))


def chunk_sentences_by_length(sentences: Column, size: int = 600, least: int = 150, drop: int = 60, overlap: int = 0) -> Column:
    """Sentences joined until the next would pass ``size``; not closed before ``least``, so a chunk can pass ``size``.

    A sentence over ``size`` closes the chunk and is packed word by word.  Chunks under ``drop`` are dropped.  With
    ``overlap`` the last sentences of a closed chunk open the next one, if it had more; each counts one more character then.
    ``least=0`` closes as soon as the next sentence doesn't fit.
    """
    none = F.expr(f"cast(array() as array<{_CUT}>)")

    def cuts(held: Column) -> Column:
        """Where chunks begin and end, from the sentences' lengths alone."""
        sizes = F.transform(held, lambda s: F.length(s))

        def step(st, x):
            at, add = x["i"], x["n"] + F.when(x["i"] > st["first"], 1).otherwise(0)
            has = at > st["first"]
            close = has & (st["len"] + add > size) & (st["len"] >= least)
            kept = F.when(at - st["first"] > overlap, overlap).otherwise(0) if overlap else F.lit(0)
            kept_len = F.aggregate(F.slice(x["back"], -F.greatest(kept, F.lit(1)), kept), F.lit(0), lambda a, n: a + n + 1) if overlap else F.lit(0)
            giant = x["n"] > size
            first = F.when(giant, at + 1).when(close, at - kept).otherwise(st["first"])
            length = F.when(giant, 0).when(close, kept_len + add).otherwise(st["len"] + add)
            ended = F.when((giant & has) | (~giant & close), F.array(_cut(st["first"], at, F.lit(False)))).otherwise(none)
            return F.struct(first.alias("first"), length.alias("len")), F.concat(ended, F.when(giant, F.array(_cut(at, at + 1, F.lit(True)))).otherwise(none))

        def items(n: Column) -> Column:
            # with an overlap each sentence knows the lengths of those before it that a new chunk may keep
            back = (lambda i: F.slice(n, F.greatest(i + 1 - overlap, F.lit(1)), F.least(i, F.lit(overlap)))) if overlap else (lambda i: F.expr("cast(array() as array<int>)"))
            return F.transform(n, lambda x, i: F.struct(i.alias("i"), x.alias("n"), back(i).alias("back")))

        done = fold(once(sizes, items), F.struct(F.lit(0).alias("first"), F.lit(0).alias("len")), step, _CUT)
        last = lambda d: F.when(d["state"]["first"] < F.size(held), F.array(_cut(d["state"]["first"], F.size(held), F.lit(False)))).otherwise(none)
        return once(done, lambda d: F.concat(d["out"], last(d)))

    def chunks(held: Column) -> Column:
        text = lambda c: F.array_join(F.slice(held, c["from"] + 1, c["to"] - c["from"]), " ")
        long_enough = lambda c: F.filter(F.array(text(c)), lambda t: F.length(t) >= drop)
        return F.flatten(F.transform(cuts(held), lambda c: F.when(c["giant"], pack_words(F.element_at(held, c["from"] + 1), size, drop)).otherwise(long_enough(c))))

    return once(sentences, chunks)


_CUT = "struct<from:int,to:int,giant:boolean>"


def _cut(start: Column, end: Column, giant: Column) -> Column:
    return F.struct(start.alias("from"), end.alias("to"), giant.alias("giant"))


def chunk_range(c: ColumnLike, least: int = 150, size: int = 600, drop: int = 60, overlap: int = 0) -> Column:
    return chunk_sentences_by_length(split_sentences(c), size, least, drop, overlap)


def chunk_fixed(c: ColumnLike, size: int = 600, overlap: int = 0, drop: int = 60) -> Column:
    return chunk_sentences_by_length(split_sentences(c), size, 0, drop, overlap)


def chunk_words(c: ColumnLike, window: int = 200, stride: int = 150, min_chars: int = 80) -> Column:
    """Windows of ``window`` words every ``stride`` words; shorter texts than ``min_chars`` are dropped."""
    words = F.filter(F.split(col(c), r"\s+"), lambda w: w != "")

    def windows(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(stride))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(held, i, window), " ")), lambda x: F.length(x) >= min_chars)

    # a lambda variable is split once; the words themselves would be split for every window
    return F.transform(F.array(words), windows)[0]


def _window(size: list[int], window: int, stride: int) -> list[tuple[int, int]]:
    """Where windows over sentences of ``size`` words begin and end."""
    out, at = [], 0
    while at < len(size):
        end, words = at + 1, size[at]
        while end < len(size) and words + size[end] <= window:
            words += size[end]
            end += 1
        out.append((at, end))
        if end == len(size):
            break
        back, words = end, 0
        while back > at and words + size[back - 1] <= window - stride:
            back -= 1
            words += size[back]
        at = back if back > at else end
    return out


#: A word, parted by what Unicode counts as white space.
_WORD = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def chunk_sentence_window(c: ColumnLike, window: int = 200, stride: int = 150) -> Column:
    """Whole sentences up to ``window`` words; the next chunk steps back by at most ``window - stride`` words.

    Only the sentences' numbers of words go to Python; texts stay where they are.
    """

    @F.pandas_udf("array<struct<from:int,to:int>>")
    def run(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda n: None if n is None else [{"from": a, "to": b} for a, b in _window(n.tolist(), window, stride)])

    sentences = split_paragraph_sentences(c)
    cuts = run(F.transform(sentences, lambda s: F.regexp_count(s, F.lit(_WORD))))
    text = lambda held: F.transform(held["cuts"], lambda x: F.array_join(F.slice(held["all"], x["from"] + 1, x["to"] - x["from"]), " "))
    return once(F.struct(sentences.alias("all"), cuts.alias("cuts")), text)


def rechunk_oversize(chunks: DataFrame, size: int = 5000, window: int = 200, stride: int = 150) -> DataFrame:
    """Chunks over ``size`` characters replaced by sentence windows with ids of their own; the others unchanged.

    The new id is a uuid layout of md5("rechunk_{id}_{i}"); chunk_index is index * 1000 + i; embed_text is the piece.
    """
    big = F.length("text") > size
    pieces = F.when(big, chunk_sentence_window("text", window, stride)).otherwise(F.array("text"))
    out = chunks.withColumn("__big", big).select("*", F.posexplode(pieces).alias("__i", "__piece"))
    new_id = uuid_of(F.concat_ws("_", F.lit("rechunk"), "chunk_id", F.col("__i").cast("string")))
    changes = {
        "chunk_id": F.when(F.col("__big"), new_id).otherwise(F.col("chunk_id")),
        "chunk_index": F.when(F.col("__big"), F.col("chunk_index") * 1000 + F.col("__i")).otherwise(F.col("chunk_index")),
        "embed_text": F.when(F.col("__big"), F.col("__piece")).otherwise(F.col("embed_text")),
        "text": F.col("__piece"),
    }
    return out.withColumns(changes).drop("__big", "__i", "__piece")


def chunk_min_punct(c: ColumnLike, least: int = 40) -> Column:
    """Cut behind . ! ? once the trimmed buffer has ``least`` characters; the pieces joined are the text."""
    parts = F.filter(F.split(col(c), r"(?<=[.!?])"), lambda x: x != "")

    def step(acc, p):
        buf = F.concat(acc["buf"], p)
        cut = p.rlike("[.!?]$") & (F.length(strip(buf)) >= least)
        return F.struct(F.when(cut, F.lit("")).otherwise(buf).alias("buf"), F.when(cut, F.concat(acc["out"], F.array(buf))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit("").alias("buf"), F.expr(_NONE).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: F.when(strip(acc["buf"]) != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]))


def flush_point(c: ColumnLike, least: int = 40, most: int = 200) -> Column:
    """Where to cut a buffer: its end from ``most`` characters on, else behind the first mark and space past ``least``; else null."""
    b = col(c)
    n = F.length(strip(b))
    at = F.regexp_instr(F.substring(b, least + 1, 1 << 30), F.lit(r"[.!?,;:…]\s"))
    return F.when(n >= most, F.length(b)).when((n >= least) & (at > 0), least + at + 1)


def _pack(parts: Column, size: int) -> Column:
    def step(acc, p):
        fits = (acc["buf"] != "") & (F.length(acc["buf"]) + 1 + F.length(p) <= size)
        out = F.when((acc["buf"] != "") & ~fits, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        return F.struct(F.when(fits, F.concat_ws(" ", acc["buf"], p)).otherwise(p).alias("buf"), out.alias("out"))

    start = F.struct(F.lit("").alias("buf"), F.expr(_NONE).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]))


def split_paragraph_pack(c: ColumnLike, size: int = 256) -> Column:
    """Per line, sentences packed up to ``size``; longer ones cut behind minor marks, then between words.

    The pieces of a long sentence are packed with the sentences around them.
    """

    def small(s: Column) -> Column:
        minor = _tidy(_split_after(s, ",;:\\-–—"))
        words = F.flatten(F.transform(minor, lambda p: F.when(F.length(p) > size, pack_words(p, size, 0)).otherwise(F.array(p))))
        return F.when(F.length(s) > size, words).otherwise(F.array(s))

    def per_line(p: Column) -> Column:
        return _pack(F.flatten(F.transform(_tidy(_split_after(p, ".!?…")), small)), size)

    return F.flatten(F.transform(_tidy(F.split(col(c), r"[\r\n]+")), per_line))


def _recursive(text: str, size: int, overlap: int, marks: tuple[str, ...]) -> list[str]:
    mark, rest = next(((m, marks[i + 1 :]) for i, m in enumerate(marks) if m == "" or m in text), ("", ()))
    parts = list(text) if mark == "" else [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    out: list[str] = []
    held: list[str] = []

    def close():
        joined = "".join(held).strip()
        if joined:
            out.append(joined)
        while held and sum(map(len, held)) > overlap:
            held.pop(0)

    for p in parts:
        if len(p) > size:
            if held:
                close()
                held.clear()
            out += _recursive(p, size, overlap, rest) if rest else [p]
            continue
        if held and sum(map(len, held)) + len(p) > size:
            close()
            while held and sum(map(len, held)) + len(p) > size:
                held.pop(0)
        held.append(p)
    joined = "".join(held).strip()
    return [*out, joined] if joined else out


def chunk_recursive(c: ColumnLike, size: int = 400, overlap: int = 50, cap: int = 50) -> Column:
    """Cut at paragraphs, else lines, sentences, words, characters; at most the first ``cap`` chunks (the feature's limit)."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _recursive(t, size, overlap, ("\n\n", "\n", ".", " ", ""))[:cap] for t in text])

    return run(col(c))


def split_last_delim(tokens: Column, marks: str = ".!?;:,\n") -> Column:
    """Sentences of a token stream: with each token, all up to the last mark in the buffer is given out."""
    inside = "[" + re.escape(marks) + "]"

    def step(acc, t):
        buf = F.concat(acc["buf"], F.coalesce(t, F.lit("")))
        head = F.regexp_extract(buf, rf"(?s)^(.*{inside})", 1)
        new = F.when(strip(head) != "", F.concat(acc["out"], F.array(strip(head)))).otherwise(acc["out"])
        return F.struct(F.substr(buf, F.length(head) + 1).alias("buf"), new.alias("out"))

    start = F.struct(F.lit("").alias("buf"), F.expr(_NONE).alias("out"))
    return F.aggregate(tokens, start, step, lambda acc: F.when(strip(acc["buf"]) != "", F.concat(acc["out"], F.array(strip(acc["buf"])))).otherwise(acc["out"]))


class StreamBuffer:
    """Token buffer of a streamed answer: cut behind the last . ! ? past half of ``least``; without one, over twice ``least``, at the last space."""

    def __init__(self, least: int = 20, text: str = ""):
        self.least, self.text = least, text
        half = least // 2
        # greedy up to the last place that may be cut: a mark with half of ``least`` before it, a space from there to twice ``least``
        self.sentence = re.compile(rf"(?s).{{{half},}}[.!?]")
        self.phrase = re.compile(rf"(?s).{{{half},{2 * least - 1}}}(?= )")

    def _head(self) -> int:
        """How many characters are ready to be given out."""
        if len(self.text) < self.least:
            return 0
        whole = self.sentence.match(self.text)
        if whole is None and len(self.text) > 2 * self.least:
            whole = self.phrase.match(self.text)
        return whole.end() if whole else 0

    def add(self, token: str) -> list[str]:
        self.text += re.sub(r"\n+", " ", token) if "\n" in token else token
        out = []
        while n := self._head():
            out.append(self.text[:n].rstrip())
            self.text = self.text[n:]
        return out

    def close(self) -> list[str]:
        left, self.text = self.text.rstrip(), ""
        return [left] if left.strip() else []


def chunk_stream_buffer(rows: DataFrame, key: str, order: str, token: str, least: int = 20) -> DataFrame:
    """Batch form of the token-stream chunker: (key, chunk_index, chunk) per response."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = StreamBuffer(least)
        out = [x for t in pdf.sort_values(order)[token] for x in buf.add(t or "")] + buf.close()
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "chunk_index": range(len(out)), "chunk": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, chunk_index int, chunk string")


# ids and texts of chunks


def uuid_of(seed: ColumnLike) -> Column:
    """md5 of the seed in the layout of a uuid."""
    return F.regexp_replace(F.md5(col(seed)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def chunk_id(source: ColumnLike, doc_index: ColumnLike, i: ColumnLike) -> Column:
    return F.concat_ws("_", col(source), col(doc_index).cast("string"), col(i).cast("string"))


def embed_text(title: ColumnLike, text: ColumnLike, prefix: str = "") -> Column:
    whole = F.when(F.coalesce(col(title), F.lit("")) != "", F.concat(col(title), F.lit(". "), col(text))).otherwise(col(text))
    return F.concat(F.lit(prefix), whole) if prefix else whole


def explode_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """A row per chunk: chunk_id, the id and source columns, chunk_index, text."""
    out = docs.select(id_col, source_col, F.posexplode(chunks).alias("chunk_index", "text"))
    return out.select(chunk_id(source_col, id_col, "chunk_index").alias("chunk_id"), id_col, source_col, "chunk_index", "text")
