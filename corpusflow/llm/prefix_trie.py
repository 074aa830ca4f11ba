"""Prefix trie of conversations, from adaptive radix trees over ranges of their keys.

A turn's id is WIDTH bytes, big-endian: a digest of role and text, then the text's length in bytes.  A conversation's key is the ids
of its turns.  Equal keys are counted first, so that thousands of copies are a few rows; keys are then dealt by ranges, so that a first
turn which a third of all conversations share is spread over many tasks.  Each task puts its keys into an adaptive radix tree, whose
nodes grow from 4 to 16, 48 and 256 children and keep the bytes without branches as one path.  Only depths at turn
borders are nodes of the trie.  Nodes on the paths to a range's first and last key may go on in the next ranges: their parts, two
rows a task, are put together in one more task, and those whose parent is such a node get it by a join.

Null roles and texts are empty, null turns come first.  Rows of one turn are ordered by role and digest of the text, so only equal ones are ties; each
repeated row is a turn of its own.  Rows without conv_id are in no conversation and left out.  A turn of any length is WIDTH bytes; a
conversation's key is held whole, WIDTH bytes a turn.  An empty table gives no rows.  Extra columns are not passed, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import stored
from corpusflow.operators import ordered

DIGEST, LENGTH = 12, 4
WIDTH = DIGEST + LENGTH
#: Bytes of keys a task's tree is made of, about; ids of equal keys that are written as one row.
SHARD, RUN = 8 << 20, 1 << 15
#: Children that a node has room for, before it is laid out anew.
ROOM = (4, 16, 48, 256)
NOTHING = hashlib.sha256().hexdigest()


class Node:
    """A node of an adaptive radix tree: the first ``end`` bytes of ``key``, a value if a key ends here, and children by their next byte.

    Up to 16 children: ``index`` has their bytes in order.  Up to 48: ``index`` has a place for each byte, 0 for none.  Then: children by byte.
    """

    __slots__ = ("key", "end", "value", "room", "index", "kids")

    def __init__(self, key: bytes, end: int, value=None):
        self.key, self.end, self.value = key, end, value
        self.room, self.index, self.kids = ROOM[0], bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Sets the child of a byte, which may have one."""
        if self.room <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.room:
                at = next((i for i, b in enumerate(self.index) if b > byte), len(self.kids))
                self.index.insert(at, byte)
                self.kids.insert(at, kid)
                return
        elif self.room == 256:
            self.kids[byte] = kid
            return
        elif self.index[byte] or len(self.kids) < self.room:
            if not self.index[byte]:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
            else:
                self.kids[self.index[byte] - 1] = kid
            return
        self._grow()
        self.put(byte, kid)

    def _grow(self) -> None:
        had = list(self.items())
        self.room = ROOM[ROOM.index(self.room) + 1]
        self.index = bytearray() if self.room == 16 else bytearray(256) if self.room == 48 else None
        self.kids = [None] * 256 if self.room == 256 else []
        for byte, kid in had:
            self.put(byte, kid)

    def items(self):
        """Children in the order of their bytes."""
        if self.room <= 16:
            return zip(self.index, self.kids)
        if self.room == 48:
            return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


def insert(root: Node, key: bytes, value) -> None:
    above, node, at = None, root, 0
    while True:
        if not key.startswith(node.key[at : node.end], at):
            same = at
            while same < len(key) and key[same] == node.key[same]:
                same += 1
            fork = Node(node.key, same)
            fork.put(node.key[same], node)
            above.put(node.key[above.end], fork)
            node = fork
        at = node.end
        if at == len(key):
            node.value = value
            return
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key, len(key), value))
            return
        above, node = node, kid


def _shared(a: bytes, b: bytes, at: int, end: int) -> int:
    """How many bytes two keys share that share ``at``; at most ``end``."""
    end = min(end, len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    while a[at] == b[at]:
        at += 1
    return at


def last_length(key: bytes, end: int) -> int:
    return int.from_bytes(key[end - LENGTH : end]) if end else 0


def nodes(root: Node, first: bytes, last: bytes):
    """Of a tree whose keys lie from ``first`` to ``last``: its whole nodes, and the parts of those on the paths to these two.

    Whole nodes are (low, depth, parent's low, edge, depth of the parent on it, n, children, leaves, saved, sha): either the parent's low or its
    place is None.  Parts are lists by depth of (n, low, children, leaves, saved, sha), one list for each edge, where the
    second has None at what the first has; they count whole nodes below only.
    """
    order = [(root, 0, -1, _shared(root.key, first, 0, root.end), _shared(root.key, last, 0, root.end))]
    for i, (node, _, _, f, t) in enumerate(order):  # grows while it is read: parents before children
        for _, kid in node.items():
            order.append((kid, node.end + 1, i, _shared(kid.key, first, f, kid.end) if f == node.end else f, _shared(kid.key, last, t, kid.end) if t == node.end else t))
    below = [[0, None, 0, 0, 0] for _ in order]  # n, low, children, leaves, saved
    edges = [[None] * (len(first) // WIDTH + 1), [None] * (len(last) // WIDTH + 1)]
    own: list = [None] * len(order)

    def depths(start: int, end: int) -> range:
        """Turn borders after the byte before ``start``, up to ``end``, the deepest first."""
        return range(end // WIDTH, (start - 1) // WIDTH, -1) if start else range(end // WIDTH, -1, -1)

    for i in range(len(order) - 1, -1, -1):
        node, start, parent, f, t = order[i]
        n, low, kids, leaves, saved = below[i]
        if node.value:
            n, low = n + node.value[0], node.value[1] if low is None else min(low, node.value[1])
        made = []
        for d in depths(start, node.end):
            sha = node.value[2] if node.value and d * WIDTH == node.end else None
            edge = 0 if f >= d * WIDTH else 1 if t >= d * WIDTH else None
            if edge is not None:
                edges[edge][d] = (n, low, kids, leaves, saved, sha)
                made.append((d, edge))
                kids = leaves = saved = 0
            else:
                leaves = leaves if kids else 1
                saved += (n - 1) * last_length(node.key, d * WIDTH)
                made.append((d, None, kids, leaves, saved, sha))
                kids = 1
        own[i] = (n, low, made)
        if parent >= 0:
            up = below[parent]
            up[0] += n
            up[1] = low if up[1] is None else min(up[1], low)
            for k, x in ((2, kids), (3, leaves), (4, saved)):
                up[k] += x
    at: list = [None] * len(order)  # the last trie node at or above
    whole = []
    for i, (node, start, parent, _, _) in enumerate(order):
        n, low, made = own[i]
        here = at[parent] if parent >= 0 else None
        for d, edge, *rest in reversed(made):
            if edge is None:
                kids, leaves, saved, sha = rest
                whole.append((low, d, *here, n, kids, leaves, saved, sha))
                here = (low, None, None)
            else:
                here = (None, edge, d)
        at[i] = here
    return whole, edges


# what a range gives: whole nodes, and two edges (edge without conv_id) with parts by depth
PARTS = "part int, conv_id long, depth long, parent_conv_id long, edge int, at long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key binary, parts array<struct<n:long,low:long,kids:long,leaves:long,saved:long,sha:string>>"
_PART = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string())])
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(_PART)]
_NAMES = [x.split()[0] for x in PARTS.split("<")[0].split(", ")]
_MADE = 1 << 13


def _batches(rows: list[tuple]):
    for i in range(0, len(rows), _MADE):
        columns = zip(*rows[i : i + _MADE])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], _NAMES)


def _runs(batches):
    """(key, first, n, ids) of consecutive rows with one key: their ids in order, comma-joined."""
    key, first, ids, names = None, None, [], ["key", "first", "n", "ids"]
    out: list[tuple] = []

    def batch():
        got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)
        out.clear()
        return got

    for b in batches:
        for conv, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key or len(ids) >= RUN:
                if ids:
                    out.append((key, first, len(ids), ",".join(ids)))
                key, first, ids = k, conv, []
            ids.append(str(conv))
        if out:
            yield batch()
    if ids:
        out.append((key, first, len(ids), ",".join(ids)))
        yield batch()


def _tree(batches):
    """The trie nodes of a range of sorted runs."""
    root, key, value, first = Node(b"", 0), None, None, None

    def done():
        if key is not None:
            insert(root, key, (value[0], value[1], value[2].hexdigest()))

    for b in batches:
        for k, low, n, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
            if k == key:
                value[0] += n
                value[2].update(b"," + ids.encode())
                continue
            done()
            key, value = k, [n, low, hashlib.sha256(ids.encode())]
            first = k if first is None else first
    done()
    if key is not None:
        part = TaskContext.get().partitionId()
        whole, edges = nodes(root, first, key)
        yield from _batches([(part, *x, None, None) for x in whole])
        for edge, k in ((0, first), (1, key)):
            yield from _batches([(part, None, None, None, edge, None, None, None, None, None, None, k, [x and dict(zip(("n", "low", "kids", "leaves", "saved", "sha"), x)) for x in edges[edge]])])


class _Edge:
    """A trie node on some range's edge, while its parts come."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "sha", "above", "depth")

    def __init__(self, above: _Edge | None, depth: int):
        self.n, self.low, self.kids, self.leaves, self.saved, self.sha, self.above, self.depth = 0, None, 0, 0, 0, None, above, depth


def _join_edges(batches):
    """The nodes on edges, whole, and for each edge's depths (part, edge, at) the node's smallest member as conv_id without depth."""
    path: list[_Edge] = []
    found: list[_Edge] = []
    places: list[tuple] = []
    last = b""

    def close(to: int) -> None:
        while len(path) > to:
            x = path.pop()
            x.leaves = x.leaves if x.kids else 1
            x.saved += (x.n - 1) * last_length(last, x.depth * WIDTH)
            if x.above:
                x.above.kids += 1
                x.above.leaves += x.leaves
                x.above.saved += x.saved

    for b in batches:
        for part, edge, key, parts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "edge", "key", "parts"))):
            close(_shared(last, key, 0, len(key)) // WIDTH + 1)
            last = key
            for d, x in enumerate(parts):
                if d == len(path):
                    path.append(_Edge(path[-1] if path else None, d))
                    found.append(path[-1])
                if x is None:
                    continue
                node = path[d]
                node.n += x["n"]
                node.low = x["low"] if node.low is None else min(node.low, x["low"])
                node.kids += x["kids"]
                node.leaves += x["leaves"]
                node.saved += x["saved"]
                node.sha = node.sha or x["sha"]
                places.append((part, edge, d, node))
    close(0)
    rows = [(None, x.low, x.depth, x.above and x.above.low, None, None, x.n, x.kids, x.leaves, x.saved, x.sha, None, None) for x in found]
    yield from _batches(rows)
    yield from _batches([(part, node.low, None, None, edge, d, None, None, None, None, None, None, None) for part, edge, d, node in places])


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id): the turns of each conversation from 0."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * DIGEST)
    length = F.lpad(F.hex(F.octet_length("text")), 2 * LENGTH, "0")
    return ordered.before(rows.select("conv_id", "turn", "role", F.unhex(F.concat(digest, length)).alias("id")), ["conv_id"], ["turn", "role", "id"], name="pos").select("conv_id", "pos", "id")


def rebuilt(turns: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, id) where conversation c begins with the first h turns of conversation c - c % step, h = crc32(c) % most, then its own after h.

    Each conversation has one more row, at pos -1 with an empty id, so that those without turns are there.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("m"))
    own = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    known = own.join(sizes.select(F.col("conv_id").alias("base"), "m"), "base", "left").withColumn("took", F.least("h", F.coalesce("m", F.lit(0))))
    head = turns.where(F.col("pos") < most - 1).where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), "pos", "id")
    heads = known.join(head, "base").where("pos < h").select("conv_id", "pos", "id")
    rest = turns.join(known.select("conv_id", "h", "took"), "conv_id").where("pos >= h").select("conv_id", (F.col("took") + F.col("pos") - F.col("h")).alias("pos"), "id")
    return heads.unionByName(rest).unionByName(sizes.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(b"").alias("id")))


def _keys(batches):
    conv, ids, names = None, [], ["conv_id", "key"]
    out: list[tuple] = []

    def batch():
        got = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names)
        out.clear()
        return got

    for b in batches:
        for c, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if c != conv:
                if conv is not None:
                    out.append((conv, b"".join(ids)))
                conv, ids = c, []
            ids.append(i)
        if out:
            yield batch()
    if conv is not None:
        out.append((conv, b"".join(ids)))
        yield batch()


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, pos (any order that ascends within a conversation) and id.
    """
    spark = turns.sparkSession
    keys = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "id").mapInArrow(_keys, "conv_id long, key binary")
    keys = stored(keys, "trie")
    runs = stored(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key binary, first long, n long, ids string"), "trie")
    held = runs.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // shard))
    found = stored(runs.repartitionByRange(n, "key").sortWithinPartitions("key", "first").mapInArrow(_tree, PARTS), "trie")
    edges = found.where("conv_id is null").repartition(1).sortWithinPartitions("part", "edge")  # two rows a range
    joined = stored(edges.mapInArrow(_join_edges, PARTS), "trie")
    places = joined.where("depth is null").select("part", "edge", "at", F.col("conv_id").alias("up"))
    whole = found.where("conv_id is not null")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    hung = whole.where("edge is not null").join(places, ["part", "edge", "at"]).withColumn("parent_conv_id", F.col("up"))
    return whole.where("edge is null").select(*columns).unionByName(hung.select(*columns)).unionByName(joined.where("depth is not null").select(*columns))
