"""Phrases, the source mix and the prefix trie against plain re-statements, on small tables and hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import collocations, mixing, prefix_trie

SF = "/root/testdata/sf0.001"


# phrases


def plain_collocations(rows, least, longest, top, keep):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= keep * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(found)[:top]):  # noqa: E741
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    words = ["a", "the", "The", "of", "é", "x\x01", "x", "x\x00y", "😀", "b" * 50]
    rows = [(rng.choice(["en", None, "und", "de"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", "\n", ".", " "]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    return [*rows, ("en", None), ("en", ""), (None, " \t\n.,"), ("fr", "one"), ("en", "a the of " * 3000), *[("de", "der die das und der die das")] * 5]


@pytest.mark.parametrize("bits,group,least,longest,top", [(24, 1 << 22, 4, 4, 2000), (4, 64, 3, 4, 7), (12, 40, 2, 3, 50), (18, 100, 2, 6, 2000)])
def test_collocations(spark, monkeypatch, bits, group, least, longest, top):
    monkeypatch.setattr(collocations, "LEAST_GROUP", 1)
    rows = phrase_rows()
    df = spark.createDataFrame([(t, lang, 1, "k") for lang, t in rows], "text string, lang string, n long, `group` string").repartition(5)
    got = collocations.collocations(df, least=least, longest=longest, top=top, bits=bits, group=group)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, longest, top, 80)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_counts_given_on_in_between(spark, monkeypatch):
    sums = collocations._Sums()
    monkeypatch.setattr(collocations, "HELD", 4)
    pa = collocations.pa
    given = []
    for i in range(6):
        given += sums.add(pa.table({"k": pa.array(["a", f"x{i}", f"y{i}"]), "n": pa.array([1, 2, 3])}))
    given += sums.add(pa.table({}), at_end=True)
    total = Counter()
    for b in given:
        for k, n in zip(*(c.to_pylist() for c in b.columns)):
            total[k] += n
    assert total == Counter({"a": 6} | {f"x{i}": 2 for i in range(6)} | {f"y{i}": 3 for i in range(6)})
    assert len(given) > 1


def test_groups_keep_to_their_budget():
    load = np.array([5, 0, 3, 2, 40, 1, 9, 10, 11])
    first, ways, split = collocations.groups_of(load, 10)
    held = Counter()
    for c in np.flatnonzero(load):
        if load[c] > 10:
            assert ways[c] == -(-load[c] // 10) and split[first[c] : first[c] + ways[c]].all()
        else:
            assert not split[first[c]]
            held[first[c]] += load[c]
    assert max(held.values()) <= 10


# the mix


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([0, 10], [3, 1]) == [0, 15]
    assert mixing.targets([], []) == [] and mixing.targets([0], [3]) == [0]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1000) for _ in range(rng.randrange(1, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        out = mixing.targets(sizes, weights)
        assert sum(out) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(out, sizes))
        share = {t / w for t, s, w in zip(out, sizes, weights) if t < 2 * s}
        assert len(share) <= 1 and all(2 * s / w <= min(share, default=0) for t, s, w in zip(out, sizes, weights) if share and t == 2 * s)


def mixed(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(200), rng.choice(["a", "b", "Z", "é", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \n", None), (1003, "x " * 30_000, "b"), (1003, "x " * 30_000, "b"), (None, "q q", "a"), (None, "q q", "a"), (7, "one", "only")]
    return spark.createDataFrame([(d, t, s, 3, "r", 0) for d, t, s in rows], "doc_id long, text string, source string, size int, `row` string, k int"), rows


def test_mix(spark):
    df, rows = mixed(spark)
    got = mixing.report(df.repartition(6), block=64).collect()
    again = mixing.report(df.repartition(3), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    assert sorted(str((r.doc_id, r.source, r.size)) for r in got) == sorted(str((d, s, len((t or "").split()))) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == float(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in order)


def test_slots_of_the_mix(spark):
    df, _ = mixed(spark)
    rows = mixing.documents(df)
    each = mixing.sources(rows)
    quota = {r.k: r.quota for r in each.collect()}
    got = mixing.mix(rows, each, 64).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.slot, r.k, r["rank"]].append((r.place, r.n))
    assert len({s for s, _, _ in slots}) == len(slots)  # one block a slot
    for (_, k, rank), parts in slots.items():  # blocks are filled without gaps
        at = 0
        for place, n in sorted(parts):
            assert place == at and n > 0
            at += n
        assert at == min(64, quota[k] - rank * 64)
    for k in quota:  # ranks follow slots, and any stretch of the mix has the source's share
        own = sorted((s, rank) for s, x, rank in slots if x == k)
        assert [r for _, r in own] == list(range(-(-quota[k] // 64)))
        total = sum(-(-q // 64) for q in quota.values())
        for i, (s, _) in enumerate(own):
            assert abs(i - s * len(own) / total) < 6


def test_mix_of_nothing(spark):
    df, _ = mixed(spark)
    assert mixing.report(df.limit(0)).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixing.report(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id int, text string, source string")).collect()] == [(0, 0.0, 0)] * 2


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    df, _ = mixed(spark)
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.report(df)


# the trie


def plain_trie(conv):
    """Nodes of {conv_id: turns}, a turn being (role, text)."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, t in conv.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(m) if len(conv[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    return out


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 120), 5000, 5004, 10**12]:
        if c % 7 == 5:
            continue
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é😀", "x" * 300])))
    rows += [(40, None, "user", "late"), (40, None, "user", None), (41, 0, "user", "again"), (41, 0, "user", "again"), (None, 1, "user", "nobody"), (60, 2**40, None, None)]
    rows += [(200 + i, t, "user", "same") for i in range(0, 400) for t in range(3)]  # copies, and a first turn that most share
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, pos int, id string"), rows


@pytest.mark.parametrize("parts", [1, 40])
def test_trie(spark, parts):
    df, rows = conversations(spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df.repartition(5))))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted_rows(got) == plain_trie(plain_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_of_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df)))
    assert sorted_rows(got) == plain_trie(plain_rebuilt([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df.limit(0)))).collect() == []


def test_runs_of_copies(spark, monkeypatch):
    """One conversation of a hundred turns, copied; ids are cut into runs."""
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1040, 5) for t in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df)))) == plain_trie(plain_rebuilt(rows))


def test_node_layouts():
    rng = random.Random(2)
    root, want = prefix_trie.Node(b"", 0), {}
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        node = prefix_trie.Node(b"k", 1)
        for b in rng.sample(range(256), n):
            node.put(b, prefix_trie.Node(bytes([b]), 1, b))
        assert node.room == next(r for r in prefix_trie.ROOM if r >= n)
        assert [(b, k.value) for b, k in node.items()] == sorted((b, b) for b, _ in node.items()) and len(list(node.items())) == n
        assert all((node.child(b) is None) == (b not in dict(node.items())) for b in range(256))
    for _ in range(3000):
        key = bytes(rng.choice(b"abc\x00\xff") if rng.random() < 0.9 else rng.randrange(256) for _ in range(rng.randrange(12)))
        want[key] = len(want)
        prefix_trie.insert(root, key, want[key])
    got, todo = {}, [root]
    while todo:
        node = todo.pop()
        if node.value is not None:
            got[node.key[: node.end]] = node.value
        assert node is root or node.value is not None or len(list(node.items())) > 1  # paths are compressed
        todo += [k for _, k in node.items()]
    assert got == want


def test_whole_nodes_and_edges():
    """A range of one key has only edges."""
    key = b"a" * 12 + b"\0\0\0\5" + b"b" * 12 + b"\0\0\0\7"
    root = prefix_trie.Node(b"", 0)
    prefix_trie.insert(root, key, (2, 3, "x"))
    whole, edges = prefix_trie.nodes(root, key, key)
    assert whole == [] and [x[:2] for x in edges[0]] == [(2, 3)] * 3 and edges[1] == [None] * 3 and edges[0][2][5] == "x"


def test_turn_ids_sort_by_digest_and_hold_the_length(spark):
    df = spark.createDataFrame([(1, 0, "user", "é")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.turn_ids(df).select(F.hex("id").alias("x")).first().x.endswith("00000002")
