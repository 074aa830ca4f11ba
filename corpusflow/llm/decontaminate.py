"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of documents.  Its text is the sequence of word numbers in the vocabulary of the
benchmark windows; words outside that vocabulary can't be part of an occurrence and become separators, and
runs between separators that are shorter than the shortest window are left out.  The shard's suffix array is
built by prefix doubling, its Burrows-Wheeler transform is stored in a wavelet matrix, and every window is
searched backward through the matrix's ranks, all windows at once.  Occurrences are located by walking back
to sampled suffix positions and merged into spans per document.

Null and word-free texts and items have no words: never hit, never searched.  Repeated items and rows are each
taken on their own, ids may be null (an item's counts as the empty string) or repeat.  Ties don't arise: every occurrence counts.  Texts of any length are searched
whole; a text beyond a shard's size is a shard of its own.  An empty benchmark or document table gives no hits or no rows.
Extra columns pass through ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vec
from corpusflow.llm.shared import identity, stored, unused

WINDOW = 10
SAMPLE = 16
#: Items are sent to the tasks in blocks of at most this many characters; more blocks, more passes.
BLOCK_CHARS = 8 << 20
SHARD_BYTES = 2 << 20

_BYTES = np.arange(256)
WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def words(arr: pa.Array):
    data, off = vec.utf8(arr)
    data = vec.lower_ascii(data)
    starts, ends, row = vec.runs(WORD[data], off)
    return data, off, starts, ends, row, vec.span_hash(vec.prefix_hash(data), starts, ends)


class Windows:
    """The windows of a block of items as rows of word numbers, by length; number 0 is the separator."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WINDOW):
        _, _, _, _, row, h = words(pa.array(texts, pa.string()))
        self.ids = ids
        self.vocab = np.unique(h)
        num = np.searchsorted(self.vocab, h) + 1
        cuts = np.searchsorted(row, np.arange(len(ids) + 1))
        by_len: dict[int, list] = {}
        for i in range(len(ids)):
            own = num[cuts[i] : cuts[i + 1]]
            if len(own):
                m = min(width, len(own))
                view = np.lib.stride_tricks.sliding_window_view(own, m)
                by_len.setdefault(m, []).append((view, np.full(len(view), i)))
        self.by_len = {}
        for m, parts in by_len.items():
            rows, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            unique, back = np.unique(rows, axis=0, return_inverse=True)
            self.by_len[m] = (unique, back.ravel(), owner)
        self.least = min(self.by_len, default=0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer text, by prefix doubling; the text's end sorts lowest."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        rank = new
        step *= 2
        if step >= n or rank.max() == n:
            return np.argsort(rank, kind="stable")


class FMIndex:
    """Burrows-Wheeler transform of ``text`` in a wavelet matrix, with suffix positions sampled."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text) + 1
        order = np.concatenate([[n - 1], suffix_array(text + 1)]) if n > 1 else np.array([0])
        full = np.append(text + 1, 0)
        bwt = full[order - 1]
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(full, minlength=sigma + 2))])
        self.bits = max(1, int(sigma + 1).bit_length())
        self.ranks, self.zeros, seq = [], [], bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.sampled = order % SAMPLE == 0
        self.where = np.where(self.sampled, order, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at`` in the transform; both vectors."""
        low, high = np.zeros(len(at), np.int64), at.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros):
            bit = (symbol >> level) & 1
            lo1, hi1 = ones[low], ones[high]
            low = np.where(bit == 1, zeros + lo1, low - lo1)
            high = np.where(bit == 1, zeros + hi1, high - hi1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbols at ``at``."""
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ranks, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of the patterns (rows of equal length), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            alive = high > low
            symbol = patterns[alive, j] + 1
            low[alive] = self.first[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back until a sampled one."""
        at, out, walked = at.copy(), np.zeros(len(at), np.int64), 0
        open_ = np.arange(len(at))
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.where[at[done]] + walked
            open_, at = open_[~done], at[~done]
            symbol = self.access(at)
            at = self.first[symbol] + self.rank(symbol, at)
            walked += 1
        return out


def shard_text(num: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``least`` vocabulary words of one document, each ended by a separator; and the word of each place."""
    n = len(num)
    good = num > 0
    new = np.ones(n, bool)
    new[1:] = ~good[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(good & new)
    nxt = np.ones(n, bool)
    nxt[:-1] = ~good[1:] | (row[1:] != row[:-1])
    end = np.flatnonzero(good & nxt) + 1
    long_ = end - start >= least
    start, end = start[long_], end[long_]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.repeat(start - first, size) + np.arange(size.sum())
    text = np.where(place < np.repeat(end, size), num[np.minimum(place, n - 1)], 0)
    return text, place


def _search(block: Windows):
    def run(batches):
        for part in vec.slices(batches, "text", SHARD_BYTES):
            _, off, starts, ends, row, h = words(part.column(1))
            n = len(off) - 1
            hit = np.zeros(len(h), bool)
            pairs = np.zeros((0, 2), np.int64)
            if len(h) and block.least:
                num = np.minimum(np.searchsorted(block.vocab, h), len(block.vocab) - 1)
                num = np.where(block.vocab[num] == h, num + 1, 0)
                text, place = shard_text(num, row, block.least)
                if len(text):
                    index = FMIndex(text, len(block.vocab) + 1)
                    found = []
                    for m, (pattern, back, owner) in block.by_len.items():
                        low, high = index.search(pattern)
                        many = high - low
                        which = np.repeat(np.arange(len(pattern)), many)
                        if not len(which):
                            continue
                        rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                        at = place[index.locate(rows)]
                        hit |= vec.cover(at, m, len(h))
                        both = np.unique(np.stack([which, row[at]], axis=1), axis=0)
                        order = np.argsort(back, kind="stable")
                        group = np.searchsorted(back[order], np.arange(len(pattern) + 1))
                        size = group[both[:, 0] + 1] - group[both[:, 0]]
                        pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(group[both[:, 0]], size)
                        found.append(np.stack([np.repeat(both[:, 1], size), owner[order[pick]]], axis=1))
                    if found:
                        pairs = np.unique(np.concatenate(found), axis=0)
            first, last, owner_row = vec.runs(hit, np.searchsorted(row, np.arange(n + 1)))
            spans = [[] for _ in range(n)]
            for a, b, r in zip(first.tolist(), last.tolist(), owner_row.tolist()):
                spans[r].append((int(starts[a] - off[r]), int(ends[b - 1] - off[r]), b - a))
            items = [[] for _ in range(n)]
            for r, i in pairs.tolist():
                items[r].append(block.ids[i])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                    pa.array([[{"start": a, "end": b, "words": w} for a, b, w in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() for x in items]),
                ],
                ["doc_id", "n_words", "spans", "items", "items_sha256"],
            )

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int):
    """How many blocks of bounded size the items make, and a generator that brings one after the other to the driver."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total, longest = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    n = max(1, -(-(total + longest) * 2 // chars)) if total > chars else 1

    def each():
        for i in range(n):
            rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)).collect()
            yield Windows([r.id for r in rows], [r.text for r in rows])

    return n, each()


_SPANS = "spans array<struct<start:long,end:long,words:long>>"


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, n_words, spans (byte offsets of maximal hit runs and their words), items, items_sha256.

    A benchmark beyond ``block_chars`` is searched block by block.  What the blocks find is written and joined by a hash of id and
    text, as rows alike in both are hit alike, and merged over the words of the text itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, {_SPANS}, items array<string>, items_sha256 string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, blocks = _blocks(benchmark, item_col, item_text, block_chars)
    if n == 1:
        return rows.mapInArrow(_search(next(blocks)), schema)
    keyed = rows.withColumn("key", identity("doc_id", "text"))
    search = lambda b: keyed.select("key", "text").mapInArrow(_search(b), schema.replace(f"doc_id {kind}", "key binary"))
    parts = [stored(search(b).where("size(spans) > 0").select("key", "spans", "items").dropDuplicates(["key"]), "hits") for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = keyed.join(merged, "key", "left").select("doc_id", "text", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_merge, schema)
    return joined.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))


def _merge(batches):
    """Merge the spans of several blocks over the words of the text itself."""
    for part in vec.slices(batches, "text", SHARD_BYTES):
        _, off, starts, ends, row, _ = words(part.column(1))
        n = len(off) - 1
        hit = np.zeros(len(starts), bool)
        for r, spans in enumerate(part.column(2).to_pylist()):
            for s in spans or ():
                hit[np.searchsorted(starts, s["start"] + off[r]) : np.searchsorted(starts, s["end"] + off[r])] = True
        first, last, owner = vec.runs(hit, np.searchsorted(row, np.arange(n + 1)))
        out = [[] for _ in range(n)]
        for a, b, r in zip(first.tolist(), last.tolist(), owner.tolist()):
            out[r].append({"start": int(starts[a] - off[r]), "end": int(ends[b - 1] - off[r]), "words": b - a})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(out, kind), part.column(3), pa.array([""] * n)], ["doc_id", "n_words", "spans", "items", "items_sha256"])


def report(docs: DataFrame, benchmark: DataFrame, **cols) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = occurrences(docs, benchmark, **cols)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), "items_sha256", (F.size("spans") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """``docs``, all columns, with the hit spans cut out of the texts; ids may be null or repeat, with equal or different texts.

    Documents without a hit keep their text as it is; a document never goes.
    """
    key, spans = unused(docs, "key", "spans")
    hash_ = identity(id_col, text_col)  # rows with one hash are alike
    rows = docs.select(hash_.alias("doc_id"), F.col(text_col).alias("text"))
    found = occurrences(rows, benchmark, **cols).where("size(spans) > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(spans))
    found = stored(found.dropDuplicates([key]), "spans")
    raw = F.col(text_col).cast("string").cast("binary")

    def step(acc, s):
        return F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(raw, acc["at"] + 1, s["start"].cast("int") - acc["at"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(raw, acc["at"] + 1, F.lit(2**31 - 1))))
    out = docs.join(found, hash_ == F.col(key), "left")
    return out.withColumn(text_col, F.when(F.col(spans).isNotNull(), rest.cast("string")).otherwise(F.col(text_col))).select(docs.columns)
