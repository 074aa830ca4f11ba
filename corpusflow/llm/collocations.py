"""Phrase collocations by vertical partitioning of the phrase tree.

Phrases of two words, then of three and so on up to one less than ``longest``, are counted by hash bucket, a pass for each length.  A bucket with too
few holds no frequent phrase, so suffixes are cut there: a leaf is a suffix's longest beginning, of at most ``longest`` words, without such a
phrase in it.  The counts of pairs also give the load under each class of two-word prefixes, and classes are put together into groups
within a budget of suffixes, so that a group's tree fits into memory; a class above the budget is split by its longer prefixes.  A last pass sends each group
the leaves of a task, counted and packed.  A group's leaves are put together and walked in order as a depth-truncated
suffix tree, whose nodes are counted from the leaf totals below them.  Nodes of split classes are summed over their groups.

What goes to the driver and back is fixed in size: a bit a bucket for each length and a load a class.  The buckets save work only: where a corpus
is so large that most are full, more of them (``bits``) keep rare pairs out of the shuffle; results don't depend on them.

Null texts are empty; a null language is ``und``, with the rows that say so.  Repeated rows count each.  Texts of any length are worked on whole.
Ties of cuts go to the shorter first part, ties of phrases to the count and then the phrase, by bytes.  Extra columns are not passed, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import vec
from corpusflow.llm.shared import stored

# fixed values: the query's limits
LEAST, LONGEST, TOP, KEEP = 30, 4, 2000, 80
#: Buckets that pairs of words are counted by, as a power of two, and classes of prefixes.
BITS, CLASS_BITS, BLOCK_BITS = 24, 16, 12
#: Suffixes a group holds at most, unless they are one class's; a small corpus gets smaller groups, so that all tasks have some.
GROUP, LEAST_GROUP = 1 << 20, 1 << 12
#: Groups are dealt to at most so many tasks; a task walks its groups one after another.
TASKS = 16_384
#: Rows counted in a task before they are given on.
HELD = 1 << 20
SALTS = 16

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
#: Inside keys a word's bytes are raised by one and a zero ends it, so that keys sort as their words do.
_BACK = bytes([0x20, *range(255)])


class _Words:
    """The words of a slice: ``keys`` with a zero behind each word, where they start and end, and which are followed by one of the same piece."""

    def __init__(self, part: pa.RecordBatch, bits: int):
        lang = part.column(part.schema.get_field_index("lang")).cast(pa.string())
        data, off = vec.utf8(part.column(part.schema.get_field_index("text")))
        inside = ~_OUTSIDE[data]
        starts, ends, rows = vec.runs(inside, off)
        piece = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
        self.lang, self.rows, self.size, self.bits = lang, rows, ends - starts, bits
        self.bytes = vec.lower_ascii(data[inside])
        self.keys = np.zeros(len(self.bytes) + len(starts), np.uint8)
        self.keys[np.arange(len(self.bytes)) + np.repeat(np.arange(len(starts)), self.size)] = self.bytes + 1
        self.end = np.cumsum(self.size + 1) - 1
        self.start = self.end - self.size
        self.prefix = vec.prefix_hash(self.keys)
        self.hash = vec.span_hash(self.prefix, self.start, self.end)
        next_ = np.zeros(len(starts), bool)
        if len(starts) > 1:
            next_[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
        own = np.array([zlib.crc32(x.encode()) for x in lang.to_pylist()], np.uint64)[rows] if len(starts) else self.hash
        #: Of phrases of ``n`` words, here two: which words begin one, and all words' buckets.
        self.ok, self.n, self.gram = next_, 2, self.hash
        self._extend(own * vec.BASE)
        self.pair = self.bucket

    def _extend(self, more: np.ndarray | int = 0) -> None:
        gram = np.zeros_like(self.gram)
        last = self.n - 1
        if len(gram) > last:
            gram[:-last] = self.gram[:-last] * vec.STEP + self.hash[last:]
        self.gram = vec.mix(gram + more)
        self.bucket = (self.gram >> vec.U(64 - self.bits)).astype(np.int64)

    def longer(self, often: np.ndarray) -> None:
        """From phrases of n words to those of one more, both of whose parts of n words are ``often``."""
        ok = self.ok & (often[self.bucket >> 3] >> (self.bucket & 7) & 1).astype(bool)
        self.full = ok
        self.ok = ok.copy()
        self.ok[:-1] &= ok[1:]
        self.ok[-1:] = False
        self.n += 1
        self._extend()

    def words(self) -> pa.Table:
        off = np.zeros(len(self.size) + 1, np.int32)
        np.cumsum(self.size, out=off[1:])
        word = pa.Array.from_buffers(pa.string(), len(self.size), [None, pa.py_buffer(off), pa.py_buffer(self.bytes)])
        return pa.table({"lang": self.lang.take(pa.array(self.rows)), "word": word, "n": pa.array(np.ones(len(off) - 1, np.int64))})

    def leaves(self, often: list[np.ndarray], first: np.ndarray, ways: np.ndarray, longest: int, shift: int) -> pa.Table:
        words = np.zeros(len(self.size), np.int64)
        for n, bits in enumerate(often, 2):
            self.longer(bits)
            words[self.full] = n
        if longest > len(often) + 1:  # no longer phrases than these are counted by bucket
            words[self.ok] = longest
        at = np.flatnonzero(words)
        start, end = self.start[at], self.end[at + words[at] - 1]
        size = end - start
        off = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=off[1:])
        keys = self.keys[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
        of = self.pair[at] >> shift
        group = first[of] + (vec.span_hash(self.prefix, start, end) % ways[of].astype(np.uint64)).astype(np.int64)
        key = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(keys)])
        return pa.table({"group": pa.array(group.astype(np.int32)), "lang": self.lang.take(pa.array(self.rows[at])), "key": key, "n": pa.array(np.ones(len(at), np.int64))})


class _Sums:
    """Counts rows by all columns but n, within bounds, and gives them on when there are many."""

    def __init__(self, chunk: int = 1 << 14):
        self.held, self.rows, self.chunk = [], 0, chunk

    def add(self, t: pa.Table, at_end: bool = False) -> list[pa.RecordBatch]:
        if t.num_rows:
            self.held.append(self._sum(t))
            self.rows += self.held[-1].num_rows
        if self.rows <= HELD and not at_end or not self.held:
            return []
        t = self._sum(pa.concat_tables(self.held)) if len(self.held) > 1 else self.held[0]
        if t.num_rows <= HELD // 2 and not at_end:
            self.held, self.rows = [t], t.num_rows
            return []
        self.held, self.rows = [], 0
        return t.to_batches(max_chunksize=self.chunk)

    @staticmethod
    def _sum(t: pa.Table) -> pa.Table:
        by = [c for c in t.column_names if c != "n"]
        return t.group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"]).combine_chunks()


def _count(bits: int, often: list[np.ndarray]):
    """Words, with their numbers, and phrases by bucket: of two words, or of one more than the last of ``often``, which words aren't given with."""
    low = min(BLOCK_BITS, bits)

    def run(batches):
        seen, words = np.zeros(1 << bits, np.uint32), _Sums()
        none = {"block": pa.int32(), "at": pa.binary(), "counts": pa.binary()}

        def given(found):
            for b in found:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, t) for t in none.values())], ["lang", "word", "n", *none])

        for part in vec.slices(batches, "text"):
            w = _Words(part, bits)
            for bits_ in often:
                w.longer(bits_)
            at, n = np.unique(w.bucket[w.ok], return_counts=True)
            seen[at] += n.astype(np.uint32)
            if not often:
                yield from given(words.add(w.words()))
        yield from given(words.add(pa.table({}), at_end=True))
        full = np.flatnonzero(seen)
        cut = np.flatnonzero(np.diff(full >> low, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(full)]):
            own = full[i:j]
            row = [int(own[0]) >> low, (own & (1 << low) - 1).astype("<u2").tobytes(), seen[own].astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *(pa.array([x], t) for x, t in zip(row, none.values()))], ["lang", "word", "n", *none])

    return run


def _merge(bits: int, least: int):
    low = min(BLOCK_BITS, bits)
    classes = max(1, 1 << max(0, min(CLASS_BITS, bits) - (bits - low)))

    def run(batches):
        key, total = None, None

        def row():
            often = total >= least
            load = np.where(often, total, 0).reshape(classes, -1).sum(1)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary()), pa.array([load.astype("<i8").tobytes()], pa.binary())], ["block", "often", "load"])

        for b in batches:
            for block, at, counts in zip(*(b.column(i) for i in range(3))):
                if block.as_py() != key:
                    if key is not None:
                        yield row()
                    key, total = block.as_py(), np.zeros(1 << low, np.int64)
                total[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(counts.as_py(), "<u4")
        if key is not None:
            yield row()

    return run


def groups_of(load: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's first group and how many it is split over, and which groups are parts of a class.

    Classes in order fill a group up to the budget; one above it gets groups of its own.
    """
    first, ways, split, used = np.zeros(len(load), np.int64), np.ones(len(load), np.int64), [False], 0
    for c in np.flatnonzero(load).tolist():
        n = int(load[c])
        if n > budget:
            first[c], ways[c] = len(split), -(-n // budget)
            split += [True] * int(ways[c])
            continue
        if used + n > budget or split[-1]:
            split.append(False)
            used = 0
        first[c], used = len(split) - 1, used + n
    return first, ways, np.array(split)


def _packed(found: list[pa.RecordBatch]):
    """Rows (group, lang, key, n) as one row a group and language: keys with a zero behind each, and counts."""
    for t in found:
        t = pa.Table.from_batches([t]).sort_by([("group", "ascending"), ("lang", "ascending")])
        group, lang = t["group"].to_numpy(), t["lang"].combine_chunks().dictionary_encode()
        code = lang.indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(group)]
        names, n = lang.dictionary.to_pylist(), t["n"].to_numpy().astype("<i8")
        keys = t["key"].to_pylist()
        rows = [(int(group[i]), names[code[i]], b"\x00\x00".join(keys[i:j]), n[i:j].tobytes()) for i, j in zip(cut, cut[1:]) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["group", "lang", "keys", "n"])


def _leaves(often: list[np.ndarray], first: np.ndarray, ways: np.ndarray, longest: int, bits: int):
    shift = bits - min(CLASS_BITS, bits)

    def run(batches):
        sums = _Sums(HELD)
        for part in vec.slices(batches, "text"):
            yield from _packed(sums.add(_Words(part, bits).leaves(often, first, ways, longest, shift)))
        yield from _packed(sums.add(pa.table({}), at_end=True))

    return run


def _walk(least: int, split: np.ndarray):
    """Nodes of two words or more of each group's suffix tree, from its leaves; those of whole classes only if frequent."""
    names = ["lang", "phrase", "words", "n", "whole"]

    def nodes(group: int, held: dict[str, dict[bytes, int]]):
        out: tuple[list, ...] = ([], [], [], [], [])
        words: list[bytes] = []
        counts: list[int] = []
        whole = not split[group]

        def close(to: int) -> None:
            while len(words) > to:
                n = counts.pop()
                if len(words) > 1 and (n >= least or not whole):
                    for column, x in zip(out, (lang, b"\0".join(words).translate(_BACK).decode(), len(words), n, whole)):
                        column.append(x)
                words.pop()
                if counts:
                    counts[-1] += n

        for lang, leaves in held.items():
            for key in sorted(leaves):
                leaf, same = key.split(b"\0"), 0
                while same < len(words) and same < len(leaf) and words[same] == leaf[same]:
                    same += 1
                close(same)
                for w in leaf[same:]:
                    words.append(w)
                    counts.append(0)
                counts[-1] += leaves[key]
            close(0)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()))], names)

    def run(batches):
        at, held = None, {}
        for b in batches:
            for group, lang, keys, n in zip(*b.columns):
                if group.as_py() != at:
                    if held:
                        yield from nodes(at, held)
                    at, held = group.as_py(), {}
                own = held.setdefault(lang.as_py(), {})
                for key, x in zip(keys.as_py().split(b"\x00\x00"), np.frombuffer(n.as_py(), "<i8").tolist()):
                    own[key] = own.get(key, 0) + x
        if held:
            yield from nodes(at, held)

    return run


def _often(blocks: DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets have at least ``least`` phrases, as bits, and how many phrases of such buckets each class has."""
    rows = blocks.where("block is not null").select("block", "at", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_merge(bits, least), "block int, often binary, load binary")
    low = min(BLOCK_BITS, bits)
    often, load = np.zeros(max(1, (1 << bits) // 8), np.uint8), np.zeros(1 << min(CLASS_BITS, bits), np.int64)
    for r in rows.collect():  # a bit a bucket and a number a class, whatever the corpus
        bit, own = np.frombuffer(r["often"], np.uint8), np.frombuffer(r["load"], "<i8")
        often[r["block"] * (1 << low) // 8 :][: len(bit)] = bit
        load[r["block"] * len(own) :][: len(own)] = own
    return often, load


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = BITS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of at most ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kinds = "lang string, word string, n long, block int, at binary, counts binary"
    seen = stored(rows.mapInArrow(_count(bits, []), kinds), "phrases")
    bit, load = _often(seen, bits, least)
    often = [bit]
    for _ in range(longest - 3):
        often.append(_often(rows.mapInArrow(_count(bits, often), kinds), bits, least)[0])
    budget = max(LEAST_GROUP, min(group, int(load.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    first, ways, split = groups_of(load, budget)
    leaves = rows.mapInArrow(_leaves(often, first, ways, longest, bits), "group int, lang string, keys binary, n binary")
    nodes = leaves.repartitionById(min(len(split), TASKS), "group").sortWithinPartitions("group").mapInArrow(_walk(least, split), "lang string, phrase string, words int, n long, whole boolean")
    nodes = stored(nodes, "phrases")
    parts = nodes.where("not whole").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = seen.where("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.lit(1).alias("words"), F.sum("n").alias("n"))
    total = seen.where("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    return nodes.where("whole").drop("whole").unionByName(parts).unionByName(words.where(F.col("n") >= least)), total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, keep: int = KEEP, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score is that of the cut into two parts with the lowest, floor(2000000 a / (l + r)).  A phrase is left out if a longer one that
    holds it has at least ``keep`` per cent of its count.
    """
    found, total = frequencies(docs, text_col, lang_col, least, longest, bits, group)
    found = stored(found, "phrases")
    part = found.select("lang", F.col("phrase").alias("part"), "n")
    longer = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    piece = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    # frequent parts are few against the phrases that they begin or end, so that skewed joins split
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("part").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("big", big("a") * 2_000_000).withColumn("both", big("l") + big("r")).withColumn("score", F.expr("big div both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = longer.where("words > 2").select("lang", "n", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("i"))
    inner = inner.groupBy("lang", piece(F.col("i"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * keep))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
