"""Exact removal of repeated byte strings, with suffix arrays built by linear grouping.

Two equal 100-byte strings hold the same 32-byte grams, so the gram with the smallest hash in them, the anchor, is
the same at the same place.  Spark shuffles one row per anchor, keyed by the gram, not one per byte:

1. Anchors of every text are selected in one pass.  Occurrences whose whole context (the 68 bytes on either side) is
   seen before in the same slice are known repeats and don't go on.
2. Occurrences are grouped by context, told by a 128-bit hash: later ones are repeats throughout.  The first ones are counted
   by gram; those whose gram has one context are done.
3. The different contexts of a gram are sent to the gram's shard, once each.  A shard writes the halves of its
   contexts, read away from the anchor, as blocks of 17 bytes into one text and sorts its suffixes; neighbours in
   suffix order give the common lengths on both sides, and with them, for each of the 69 places of a window over
   the anchor, which occurrence is the first.  What is compared there are bytes, the gram's among them.
4. A gram with more contexts than a shard holds is split by its neighbouring bytes: the windows at places lo to hi all hold the lo
   bytes before the gram and the 68 - hi after it, so halves of the range go to groups by those bytes, and halves of halves
   until the groups fit.  A group of one place holds equal windows; its first occurrence is a minimum.
5. Per document the repeated windows are merged into removed spans.

Suffix sorting is the linear grouping construction (``lyndon_suffix_array``): suffixes are grouped by Lyndon prefix, the groups
are taken in descending order, each moves the previous smaller suffixes of its members to new groups, and a last
pass emits every group's order along the same pointers; nothing is renamed recursively.

Null texts are empty.  Rows with null or repeated ids are ordered by id (nulls first) and text and treated as different
documents in that order; between equal rows any is the first.  Texts under 100 bytes have nothing to remove, texts of any length are
taken whole.  An empty table gives no rows.  Extra columns are not passed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import vec
from corpusflow.llm.shared import stored

LENGTH, GRAM = 100, 32
SIDE = LENGTH - GRAM
PLACES = SIDE + 1
BLOCK = 17
#: Contexts that a shard holds at once, and that a group may have before it is split; a group's contexts stay together.
SHARD = 40_000
#: Bytes of text within which known repeats are left out before anything moves.
SLICE = 4 << 20
_TOP = np.uint64(2**64 - 1)
_OPEN = -2


def lyndon_suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a non-empty integer text; its end sorts below every symbol."""
    text = np.append(np.unique(symbols, return_inverse=True)[1] + 1, 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(start, n))
    link = np.empty(n, np.int64)
    link[order] = np.repeat(start, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = np.zeros(n, np.int64)
    size[start] = sizes
    order, link, place, size = order.tolist(), link.tolist(), place.tolist(), size.tolist()
    prev = [_OPEN] * n

    end = n - 1
    while end >= 0:
        low = link[order[end]]
        if low == end:
            s = order[end]
            p = s - 1
            while p >= 0 and link[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                g = link[p]
                if size[g] > 1:
                    last = g + size[g] - 1
                    size[g] -= 1
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    link[p] = last
                    size[last] = 1
            end = low - 1
            continue
        times: dict[int, int] = {}
        members = order[low : end + 1]
        for s in members:
            if prev[s] != _OPEN:
                continue
            todo, p = [s], s - 1
            while todo:  # a pointer through an open member of the group waits for that one's
                while p >= 0 and link[p] >= low and prev[p] != _OPEN:
                    p = prev[p]
                if p >= 0 and link[p] >= low:
                    todo.append(p)
                    p -= 1
                else:
                    prev[todo.pop()] = p
        for s in members:
            p = prev[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for p in by_times[k]:
                g = link[p]
                last = g + size[g] - 1 - moved.get(g, 0)
                moved[g] = moved.get(g, 0) + 1
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
            for g, m in moved.items():
                if m == size[g]:
                    continue
                first = g + size[g] - m
                size[g] -= m
                size[first] = m
                for p in order[first : first + m]:
                    link[p] = first
        end = low - 1

    out = [0] * n
    free = list(range(n))  # next free place of the group that starts here
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = link[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = prev[s]
    return np.array(out[1:], np.int64)


def _grams(data: np.ndarray) -> np.ndarray:
    h, n, m = vec.BYTE[data], 1, int(vec.BASE)
    while n < GRAM:
        h = h[:-n] * np.uint64(m) + h[n:]
        m, n = m * m % 2**64, 2 * n
    return vec.mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram has the smallest hash of some LENGTH-byte window of their row, and those hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.minimum(_grams(data), _TOP - np.uint64(1))
    size = off[1:] - off[:-1]
    left = np.repeat(off[1:], size) - np.arange(len(data))  # bytes to the row's end
    h[left[: len(h)] < GRAM] = _TOP
    low = _sliding_min(h, PLACES)
    low[left[: len(low)] < LENGTH] = 0
    pad = np.full(PLACES - 1, _TOP)
    reach = ~_sliding_min(np.concatenate([pad, ~low, pad]), PLACES)
    at = np.flatnonzero((reach[: len(h)] == h) & (h != _TOP))
    return at, h[at]


#: The bytes in another order, for a second hash of the same span.
_OTHER = np.random.Generator(np.random.PCG64(5)).permutation(256).astype(np.uint8)


def _select(batches):
    """Rows (k, c, c2, doc, pos) of a slice's anchors: hashes of the gram and, twice, of the context; all null for known repeats."""
    for part in vec.slices(batches, "text", SLICE):
        data, off = vec.utf8(part.column(1))
        at, g = anchors(data, off)
        if not len(at):
            continue
        row = np.searchsorted(off, at, "right") - 1
        begin, stop = np.maximum(at - SIDE, off[row]), np.minimum(at + LENGTH, off[row + 1])
        c, c2 = (vec.mix(vec.span_hash(vec.prefix_hash(d), begin, stop) + (at - begin).astype(np.uint64) * vec.STEP) for d in (data, _OTHER[data]))
        doc = part.column(0).to_numpy()[row]
        pos = at - off[row]
        order = np.lexsort((pos, doc, c2, c))
        same = np.zeros(len(at), bool)
        same[order[1:]] = (c[order][1:] == c[order][:-1]) & (c2[order][1:] == c2[order][:-1])
        hashes = [pa.array(x.view(np.int64), mask=same) for x in (g, c, c2)]
        yield pa.RecordBatch.from_arrays([*hashes, pa.array(doc, pa.int64()), pa.array(pos.astype(np.int32))], ["k", "c", "c2", "doc", "pos"])


def _pack(batches):
    press = zstandard.ZstdCompressor(level=3)
    for part in vec.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], ["doc", "z"])


_CONTEXT = "k long, lo int, hi int, doc long, pos int, gram binary, before binary, after binary, hot boolean"
_CONTEXT_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_CONTEXT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _CONTEXT_TYPES)], [x.split()[0] for x in _CONTEXT.split(", ")])


def _contexts(batches):
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some, rows = batch.slice(at, 256), []
            for doc, z, asked in zip(*(some.column(i).to_pylist() for i in range(3))):
                b = open_(z)
                for a in asked:
                    p = a["pos"]
                    rows.append((a["k"], 0, SIDE, doc, p, b[p : p + GRAM], b[max(0, p - SIDE) : p][::-1], b[p + GRAM : p + LENGTH], a["hot"]))
            yield _context_rows(rows)


def _halve(batches):
    """Each context once for either half of its range of places, keyed by the bytes that the windows there share."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = []
            for _, lo, hi, doc, pos, gram, before, after, _ in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns)):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if len(before) >= a and len(after) >= SIDE - b:
                        shared = before[:a][::-1] + gram + after[: SIDE - b]
                        key = hashlib.blake2b(shared, digest_size=8, salt=bytes((a, b))).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), a, b, doc, pos, gram, before, after, False))
            yield _context_rows(rows)


def _matrix(half: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of at most SIDE bytes as rows of byte + 1, padded with 0, and their lengths."""
    raw = half.to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    out = np.zeros((len(raw), SIDE), np.uint8)
    out[np.repeat(np.arange(len(raw)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def first_windows(gram: np.ndarray, before: tuple, after: tuple, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For contexts in document order: which of the PLACES windows over each anchor, from place lo to hi, repeat an earlier context's."""
    n = len(gram)
    sides = []
    kinds = np.unique(gram, return_inverse=True)[1].ravel()
    for bytes_, size in (before, after):
        keyed = np.concatenate([kinds.astype(">u8").view(np.uint8).reshape(n, 8), bytes_], axis=1)
        _, first, back = np.unique(np.ascontiguousarray(keyed).view(f"V{8 + SIDE}").ravel(), return_index=True, return_inverse=True)
        sides.append((first, back.ravel(), bytes_[first], size[first], kinds[first]))
    blocks = np.concatenate([s[2] for s in sides])
    named = np.unique(np.ascontiguousarray(blocks).view(f"S{BLOCK}").ravel(), return_inverse=True)[1].reshape(len(blocks), SIDE // BLOCK)
    top = named.max() + 1
    heads = np.concatenate([top + 2 * s[4] + i for i, s in enumerate(sides)])
    width = SIDE // BLOCK + 1
    order = lyndon_suffix_array(np.concatenate([heads[:, None], named], axis=1).ravel())
    order = order[order % width == 0] // width
    sizes = np.concatenate([s[3] for s in sides])
    a, b = order[:-1], order[1:]
    differ = blocks[a] != blocks[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    common = np.where(heads[a] == heads[b], np.minimum(common, np.minimum(sizes[a], sizes[b])), -1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    where = (rank[sides[0][1]], rank[len(sides[0][0]) + sides[1][1]])
    repeated = np.zeros((n, PLACES), bool)
    for o in range(PLACES):
        fits = np.flatnonzero((before[1] >= o) & (after[1] >= SIDE - o) & (lo <= o) & (o <= hi))
        if not len(fits):
            continue
        group = [np.concatenate([[0], np.cumsum(common < need)])[w[fits]] for need, w in ((o, where[0]), (SIDE - o, where[1]))]
        _, first = np.unique(group[0] * len(order) + group[1], return_index=True)
        repeated[fits, o] = True
        repeated[fits[first], o] = False
    return repeated


def _shard(batches):
    def solve(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks().sort_by([("doc", "ascending"), ("pos", "ascending")]).combine_chunks()
        col = lambda c: t.column(c).chunk(0)
        gram = np.frombuffer(b"".join(col("gram").to_pylist()), f"V{GRAM}")
        found = first_windows(gram, _matrix(col("before")), _matrix(col("after")), col("lo").to_numpy(), col("hi").to_numpy())
        some = np.flatnonzero(found.any(axis=1))
        bits = np.packbits(found[some], axis=1)
        return pa.RecordBatch.from_arrays([col("doc").take(pa.array(some)), col("pos").take(pa.array(some)), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc", "pos", "mask"])

    held, n = [], 0
    for batch in batches:
        k = batch.column(0).to_numpy()
        while held and n >= SHARD:  # close the shard where the gram changes
            last = held[-1].column(0)[-1].as_py()
            same = int(np.argmax(k != last)) if (k != last).any() else len(k)
            if same:
                held.append(batch.slice(0, same))
                n += same
            if same == len(k):
                k = k[:0]
                break
            yield solve(held)
            held, n = [], 0
            batch, k = batch.slice(same), k[same:]
        if len(k):
            held.append(batch)
            n += len(k)
    if held:
        yield solve(held)


def _place_mask(place: int) -> bytes:
    return np.packbits(np.arange(PLACES) == place).tobytes()


def _solved(contexts: DataFrame) -> DataFrame:
    """(doc, pos, mask): the windows over each context that repeat an earlier one of its group."""
    return contexts.repartition("k").sortWithinPartitions("k").mapInArrow(_shard, "doc long, pos int, mask binary")


def _split(contexts: DataFrame) -> DataFrame:
    """``_solved`` for contexts of which some are in groups that a shard can't hold."""
    fit, hot = contexts.where("not hot"), contexts.where("hot")
    out = []
    while not hot.isEmpty():  # at most as often as 69 places can be halved
        halves = stored(hot.mapInArrow(_halve, _CONTEXT).drop("hot"), "halves")
        large = halves.groupBy("k").count().where(F.col("count") > SHARD).select("k", F.lit(True).alias("hot"))
        told = stored(halves.join(large, "k", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "told").select(contexts.columns)
        fit, hot = fit.union(told.where("not hot")), told.where("hot and lo < hi")
        # one place: all of a window's bytes are the key, and its first occurrence is a minimum
        one = told.where("hot and lo = hi").withColumn("w", F.expr(f"concat(gram, substring(before, 1, lo), substring(after, 1, {SIDE} - lo))")).select("lo", "w", "doc", "pos")
        first = one.groupBy("lo", "w").agg(F.min(F.struct("doc", "pos")).alias("first"))
        later = one.join(first, ["lo", "w"]).where(F.struct("doc", "pos") != F.col("first"))
        mask = F.element_at(F.array(*(F.lit(_place_mask(i)) for i in range(PLACES))), F.col("lo") + 1)
        out.append(later.select("doc", "pos", mask.alias("mask")))
    masks = _solved(fit)
    for more in out:
        masks = masks.union(more)
    return masks


def _masks(found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Places and, a row of bits a place, the windows that repeat there; a null mask is all of them."""
    pos, mask = found.field("pos"), found.field("mask")
    whole = np.packbits(np.ones(PLACES, bool)).tobytes()
    held = b"".join(mask.fill_null(whole).to_pylist())
    return pos.to_numpy().astype(np.int64), np.frombuffer(held, np.uint8).reshape(len(pos), len(whole))


def _covered(pos: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's ``n`` bytes lie in a window that repeats."""
    start = (pos[:, None] - np.arange(PLACES))[np.unpackbits(bits, axis=1, count=PLACES).astype(bool)]
    first = np.zeros(n, bool)
    first[start[(start >= 0) & (start + LENGTH <= n)]] = True
    return vec.cover(np.flatnonzero(first), LENGTH, n)


def _remove(batches):
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        lists = batch.column(2)
        size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        until = np.cumsum(size)
        pos, bits = _masks(lists.flatten())
        for doc, z, begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (until - size).tolist(), until.tolist()):
            b = open_(z)
            n = len(b)
            if begin == end:
                rows.append((doc, n, 0, 0, hashlib.sha256(b).hexdigest(), []))
                continue
            gone = _covered(pos[begin:end], bits[begin:end], n)
            first, last, _ = vec.runs(gone, np.array([0, n]))
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            rows.append((doc, n, int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(first, last)]))
        cols = list(zip(*rows)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets of what goes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, full = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    plain = n == full and kind in ("bigint", "int", "smallint", "tinyint")
    if plain:
        rows = rows.withColumn("doc", F.col("doc_id").cast("long"))
    else:  # numbers rise with the sorted partitions; stored, or they could change when a row is computed again
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        rows = stored(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered")
    texts = rows.select("doc", "text").mapInArrow(_pack, "doc long, z binary")
    found = rows.select("doc", "text").mapInArrow(_select, "k long, c long, c2 long, doc long, pos int")
    # known repeats have no hashes; their place deals them out
    spread = F.coalesce("c", F.xxhash64("doc", "pos"))
    context = Window.partitionBy("spread", "c2").orderBy("doc", "pos")
    found = found.withColumn("spread", spread).withColumn("later", F.col("k").isNull() | (F.row_number().over(context) > 1))
    found = stored(found.select("doc", "pos", F.when(~F.col("later"), F.col("k")).alias("k")), "anchors")
    firsts = found.where("k is not null")
    several = stored(firsts.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k", (F.col("m") > SHARD).alias("hot")), "several")
    asked = firsts.join(several, "k").groupBy("doc").agg(F.collect_list(F.struct("pos", "k", "hot")).alias("asked"))
    contexts = texts.join(asked, "doc").select("doc", "z", "asked").mapInArrow(_contexts, _CONTEXT)
    masks = stored(_solved(contexts) if several.where("hot").isEmpty() else _split(stored(contexts, "contexts")), "windows")
    every = found.where("k is null").select("doc", "pos", F.lit(None).cast("binary").alias("mask")).union(masks)
    per_doc = every.groupBy("doc").agg(F.collect_list(F.struct("pos", "mask")).alias("found"))
    out = texts.join(per_doc, "doc", "left").select("doc", "z", "found").mapInArrow(_remove, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    if plain:
        return out.withColumn("doc_id", F.col("doc").cast(kind)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    return out.join(rows.select("doc", "doc_id"), "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
