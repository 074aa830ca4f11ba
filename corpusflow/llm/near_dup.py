"""MinHash near-duplicate detection on word shingles.

Documents of which over a quarter of the shingles are in no other candidate can't be linked and leave early.
Every distinct shingle set gets 256 universal-hash minima (multiply-shift); the first 128 are banded 32 x 4.  Members of
a bucket are compared with a bucket leader, by signature (two bits of each minimum) and then on the full
sets; verified links become components by alternating large-star and small-star.  Leaders come from the first half of
the bands.  What the members of a bucket are still apart in, they settle without the bucket's pairs: all shingles of
these documents are put in one order, rarest first, and a linked pair must share a shingle among the first places of both
(prefix filter with positions).  An edited copy's first places are its own edits, so a copy that is too far from its
origin meets none of the origin's other copies there.  Families whose copies would still meet too often elect further leaders
first, as long as that links them.

With 32 bands of 4 rows a pair of similarity 0.75 shares no bucket with probability 5e-6; its signatures differ more
than allowed with probability 1e-6.

Null or word-free texts have an empty set and are linked with nothing.  Texts of one to four words have one
shingle, the whole sequence; texts of any length are taken whole.  Rows with a null id are returned alone (component null,
kept).  Rows that repeat an id are each in the component of their own text.  Ties: the smallest id stands for its
component.  Extra columns pass through ``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import vec
from corpusflow.llm.shared import cut, identity, stored, unused

HASHES, BANDS, ROWS, WORDS = 256, 32, 4, 5
#: Signatures whose minima agree in their lowest two bits in fewer places can't come from a pair of similarity 0.75:
#: 13 in 16 agree on average, a quarter of them by chance, and this is 4.8 standard deviations below.
LEAST_SHARED = 178
#: The last join is made once it compares at most this many places of shingles a member, or leaders find few links more.
COMPARED = 1000
LEAST_LED = 0.02
#: Size classes per doubling of a document's number of shingles.
SIZE_CLASSES = 32
#: Ids are broadcast only up to this many; beyond it the same join shuffles.
BROADCAST_IDS = 500_000

_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(arr: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its ``n``-word shingles (or of the whole, if shorter)."""
    data, off = vec.utf8(arr)
    data = vec.lower_ascii(data)
    starts, ends, row = vec.runs(~vec.WHITE[data], off)
    h = vec.span_hash(vec.prefix_hash(data), starts, ends)
    at, win = vec.windows(h, row, n)
    first = np.searchsorted(row, np.arange(len(off)))
    cuts = np.searchsorted(row[at], np.arange(len(off)))
    out = []
    for i in range(len(off) - 1):
        lo, hi = cuts[i], cuts[i + 1]
        if hi > lo:
            out.append(np.unique(win[lo:hi]))
            continue
        own = h[first[i] : first[i + 1]]
        acc = np.uint64(len(own))
        if len(own):
            acc = vec.mix(np.array([int.from_bytes(own.tobytes(), "little") % (2**61 - 1)], np.uint64) + acc)
            out.append(acc)
        else:
            out.append(own)
    return out


def _sketch(batches):
    for part in vec.slices(batches, "text", 512 << 10):
        sets = shingles(part.column(1))
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        sums = np.zeros((2, len(sets)), np.int64)
        bands, planes = np.zeros((len(sets), 0), np.int64), np.zeros((len(sets), 0), np.int64)
        if len(full):
            h = np.concatenate([sets[i] for i in full])
            start = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            sums[0, full] = np.add.reduceat(vec.mix(h + vec.STEP), start).view(np.int64)
            sums[1, full] = np.bitwise_xor.reduceat(vec.mix(h ^ vec.BASE), start).view(np.int64)
            sig = np.empty((len(full), HASHES), np.uint32)
            for k in range(HASHES):
                sig[:, k] = np.minimum.reduceat((h * _A[k] + _B[k]) >> np.uint64(32), start)
            key = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * vec.BASE
            wide = sig[:, : BANDS * ROWS].astype(np.uint64).reshape(len(full), BANDS, ROWS)
            for r in range(ROWS):
                key = (key + wide[:, :, r]) * vec.STEP
            low = np.stack([sig & 1, sig >> 1 & 1], axis=1).astype(np.uint8)
            bits = np.ascontiguousarray(np.packbits(low, axis=2)).view(np.int64).reshape(len(full), -1)
            bands, planes = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), bits.shape[1]), np.int64)
            bands[full], planes[full] = vec.mix(key).view(np.int64), bits
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), _lists(bands), _lists(planes)], ["doc_id", "n_shingles", "s1", "s2", "bands", "planes"])


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.int64()))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _sketch, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, planes array<long>"
    )


def _pack(batches):
    press = zstandard.ZstdCompressor(level=3)
    for part in vec.slices(batches, "text"):
        z = pa.array([press.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), z], ["doc", "z"])


def _verify(batches):
    """Rows (a, b, their packed texts) to the pairs that are linked."""
    open_ = zstandard.ZstdDecompressor().decompress
    last, last_set = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        za, zb = batch.column(2), batch.column(3)
        keep = []
        for at in range(0, batch.num_rows, 256):
            some = range(at, min(at + 256, batch.num_rows))
            right = shingles(pa.array([open_(zb[i].as_py()).decode() for i in some], pa.string()))
            for i, other in zip(some, right):
                if a[i] != last:
                    last, last_set = a[i], shingles(pa.array([open_(za[i].as_py()).decode()], pa.string()))[0]
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * both >= 75 * (len(last_set) + len(other) - both):
                    keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""
    left, right = (texts.select(F.col("doc").alias(c), F.col("z").alias("z" + c)) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(_verify, "a long, b long")


def _rows(batches):
    """Rows (h, doc), a row per shingle of a packed text."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            sets = shingles(pa.array([open_(z).decode() for z in some.column(1).to_pylist()], pa.string()))
            size = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(some.column(0).to_numpy(), size))], ["h", "doc"])


def _unshared(texts: DataFrame) -> DataFrame:
    """(doc, u): how many of a document's shingles no other candidate has."""
    held = texts.select("doc", "z").mapInArrow(_rows, "h long, doc long").groupBy("h").agg(F.min("doc").alias("doc"), F.max("doc").alias("other"))
    return held.where("doc = other").groupBy("doc").agg(F.count("*").alias("u"))


def _near(one: str, two: str) -> Column:
    """What a linked pair's sizes, unshared shingles and signatures can be; the first two bound the similarity exactly.

    No shingle that only one document has is in the intersection, and all of them are in the union.
    """
    n, u, planes, n2, u2, planes2 = (f"{c}{side}" for side in (one, two) for c in ("n", "u", "planes"))
    most = F.least(F.col(n) - F.col(u), F.col(n2) - F.col(u2))
    least = F.greatest(F.col(n) + F.col(u2), F.col(n2) + F.col(u))
    words = HASHES // 64
    differ = F.lit(0)
    for i in range(words):
        low, high = (F.col(planes)[j].bitwiseXOR(F.col(planes2)[j]) for j in (i, i + words))
        differ = differ + F.bit_count(low.bitwiseOR(high))
    return (100 * most >= 75 * least) & (HASHES - differ >= LEAST_SHARED)


def _led(many: DataFrame, scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Near pairs (a, b) of members and leaders, from the first half of the bands.

    The rows that go by bucket are narrow; signatures are joined to the distinct pairs.
    """
    half = many.where(F.col("band") < BANDS // 2).select("k", "doc")
    lead = half.join(scores, "doc").groupBy("k").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("doc2"))
    return _profiled(half.join(lead, "k").where("doc <> doc2"), profile)


def _profiled(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The distinct near pairs (a, b) of the rows (doc, doc2)."""
    pairs = pairs.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(profile.select(F.col("doc").alias(c), *(F.col(x).alias(x + c) for x in ("n", "u", "planes"))), c)
    return pairs.where(_near("a", "b")).select("a", "b")


def _prefixes(live: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (doc, n, h, at): the shingles of the live documents (doc, n) that can be the first common one of a linked pair.

    Every document's shingles are put in one order, rarest first; ``at`` is a shingle's place in it.  Shingles that no other live
    document holds take the first places and need no row.
    """
    held = texts.join(live.select("doc"), "doc", "left_semi").mapInArrow(_rows, "h long, doc long")
    shared = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    place = Window.partitionBy("doc")
    ranked = held.join(shared, "h").withColumn("r", F.row_number().over(place.orderBy("df", "h"))).withColumn("m", F.count("*").over(place))
    return ranked.join(live, "doc").withColumn("at", F.col("n") - F.col("m") + F.col("r") - 1).where("4 * at <= n").select("doc", "n", "h", "at")


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n) * SIZE_CLASSES).cast("int")


def _meetings(places: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of ``places`` as the smaller and as the larger document of a pair, by shingle h and the smaller one's size class c.

    A pair is linked if 7 * common >= 3 * (n + n2).  Its first common shingle, at places ``at`` and ``at2``, leaves at most n - at and
    n2 - at2 common ones, so 3 * n2 <= 4 * n - 7 * at and the other way round.  What only one component holds is left out; ``major``
    marks the component that holds most of a key, whose members needn't meet each other.
    """
    places = places.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    small = places.where("7 * at <= n").withColumn("c", _size_class(F.col("n"))).withColumn("small", F.lit(True))
    most = F.least(F.col("n"), F.floor((4 * F.col("n") - 7 * F.col("at")) / 3))
    classes = F.sequence(_size_class(F.ceil(F.col("n") * 3 / 4)), _size_class(most))
    large = places.withColumn("c", F.explode(classes)).withColumn("small", F.lit(False))
    rows = small.unionByName(large)
    held = rows.groupBy("h", "c", "comp").agg(F.count("*").alias("m")).groupBy("h", "c").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("most"), F.count("*").alias("comps"))
    return cut(rows.join(held.where("comps > 1"), ["h", "c"]).withColumn("major", F.expr("comp = most")).drop("most", "comps"))


def _comparisons(rows: DataFrame) -> int:
    """How many rows of the last join are compared."""
    n = lambda cond: F.count_if(F.expr(cond))
    each = rows.groupBy("h", "c").agg((n("small and not major") * n("not small") + n("small and major") * n("not small and not major")).alias("x"))
    return each.agg(F.sum("x")).first()[0] or 0


def _first_common(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components whose first common shingle allows a link."""
    large = rows.where("not small").select("h", "c", *(F.col(x).alias(x + "2") for x in ("doc", "comp", "n", "at", "major")))
    fits = "comp <> comp2 and n <= n2 and 3 * n2 <= 4 * n - 7 * at and 3 * n <= 4 * n2 - 7 * at2"
    out = rows.where("small and not major").join(large, ["h", "c"]).where(fits).unionByName(rows.where("small and major").join(large.where("not major2"), ["h", "c"]).where(fits))
    return out.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every id that the links (a, b) connect with a smaller one: the smallest such.

    Alternates large-star (join a node's larger neighbours to its smallest one) and small-star (join its
    smaller neighbours to the smallest), until all hang on their root.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # done when every node hangs on one root and no root hangs on another
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("hangs").alias("h"), F.max("holds").alias("r")).where("h > 1 or (h = 1 and r = 1)").isEmpty():
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def _open(many: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows (k, doc, comp) of buckets whose members are in several components."""
    rest = many.select("k", "doc").join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    several = rest.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return cut(rest.join(several, "k", "left_semi").select("k", "doc", "comp"))


def _next_led(live: DataFrame, scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Near pairs (a, b) of members and their bucket's best leader outside the component of the first one."""
    rows = live.join(scores, "doc")
    best = F.struct("score", -F.col("doc"))
    first = rows.groupBy("k").agg(F.max_by("comp", best).alias("led"))
    second = rows.join(first, "k").where("comp <> led").groupBy("k").agg(F.max_by(F.struct(F.col("doc").alias("doc2"), F.col("comp").alias("comp2")), best).alias("s")).select("k", "s.*")
    return _profiled(live.join(second, "k").where("comp <> comp2"), profile)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles and root, the smallest id of its component, of every row; ids that aren't null don't repeat."""
    sk = cut(sketches(docs, id_col, text_col))
    full = sk.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    # members of a class have the same set, and so the same bands and planes
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    classes = cut(classes.withColumnRenamed("n_shingles", "n"))

    rows = classes.select("doc", F.posexplode("bands").alias("band", "k"))
    many = cut(rows.join(rows.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "k"))
    # the origin of a family shares larger buckets with more members than a copy does: it leads
    scores = cut(many.groupBy("doc").agg(F.sum("size").alias("score")))
    ids = scores.select("doc")
    if scores.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    texts = cut(source.join(ids, "doc", "left_semi").mapInArrow(_pack, "doc long, z binary"))
    profile = classes.select("doc", "n", "planes").join(ids, "doc", "left_semi").join(_unshared(texts), "doc", "left").fillna(0, "u")
    profile = cut(profile.where("4 * u <= n"))  # with more than a quarter unshared, no link is possible
    many = cut(many.select("k", "doc", "band").join(profile.select("doc"), "doc", "left_semi"))

    tested = cut(_led(many, scores, profile))
    comp = components(cut(_links(tested, texts)))
    live = _open(many, comp)
    places = cut(_prefixes(live.select("doc").distinct().join(profile.select("doc", "n"), "doc"), texts))
    members, rows = places.select("doc").distinct().count(), _meetings(places, comp)
    while _comparisons(rows) > COMPARED * members:  # many may be linked with each other: further leaders first
        pairs = cut(_next_led(live, scores, profile).join(tested, ["a", "b"], "left_anti"))
        found = cut(_links(pairs, texts))
        if found.count() < LEAST_LED * members or found.isEmpty():
            break
        tested = cut(tested.union(pairs))
        comp = components(comp.select(F.col("doc").alias("a"), F.col("comp").alias("b")).union(found))
        live, rows = _open(many, comp), _meetings(places, comp)
    last = cut(_links(cut(_first_common(rows).join(tested, ["a", "b"], "left_anti")), texts))
    if not last.isEmpty():
        comp = components(comp.select(F.col("doc").alias("a"), F.col("comp").alias("b")).union(last))

    of = classes.select(F.col("n").alias("n_shingles"), "s1", "s2", "doc").join(comp, "doc", "left").select(*same, F.coalesce("comp", "doc").alias("root"))
    return sk.select("doc_id", *same).join(of, same, "left").select("doc_id", "n_shingles", "root")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, text, row, n): the different rows that have an id, numbered in that order, or None if no id repeats."""
    n, full = docs.agg(F.count(id_col), F.count_distinct(id_col)).first()
    if n == full:
        return None
    one = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), identity(id_col, text_col).alias("row")).dropDuplicates(["row"])
    # numbers rise with the sorted partitions; stored, or they could change when a row is computed again
    return stored(one.orderBy("id", "text").withColumn("n", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (it is its component's smallest id)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = _numbered(docs, "doc_id", "text")
    if named is None:
        out = _classes(docs, "doc_id", "text")
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), identity("doc_id", "text")).alias("row"), "text")
        found = _classes(named, "n", "text").withColumnRenamed("doc_id", "n").join(named.select("n", "row"), "n")
        found = found.join(named.select(F.col("n").alias("root"), F.col("id").cast("long").alias("id")), "root", "left").select("row", "n_shingles", F.col("id").alias("root"))
        alone = rows.where("row is null").select("doc_id", "text")
        out = rows.where("row is not null").join(found, "row").select("doc_id", "n_shingles", "root").union(sketches(alone, "doc_id", "text").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that near-duplicate detection doesn't keep.

    Rows that share an id are documents of their own, in the order of their texts, but equal rows are one and stay or
    go together; rows without an id stay.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    (gone,) = unused(docs, "gone")
    named = _numbered(own, "doc_id", "text")
    if named is None:
        drop = _classes(own, "doc_id", "text").where("doc_id <> root").select(F.col("doc_id").alias(gone))
        return docs.join(drop, F.col(id_col).cast("long") == F.col(gone), "left_anti")
    drop = _classes(named, "n", "text").where("doc_id <> root").select(F.col("doc_id").alias("n"))
    keyed = docs.withColumn(gone, F.when(F.col(id_col).isNotNull(), identity(id_col, text_col)))
    return keyed.join(named.join(drop, "n").select(F.col("row").alias(gone)), gone, "left_anti").select(docs.columns)
