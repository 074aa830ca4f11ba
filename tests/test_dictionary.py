"""Dictionaries by automaton give what one expression an entry gives."""

import random
import re
import time

import pytest

from corpusflow.functions import dictionary, text
from corpusflow.functions.packs import TEST_EN, VI_DEFAULT


def plain(t, pairs):
    for alias, formal in pairs:
        t = re.sub(re.escape(alias), lambda _, f=formal: f, t, flags=re.I)
    return t


@pytest.mark.parametrize("seed", range(200))
def test_chains_in_order(seed):
    rng = random.Random(seed)
    some = lambda least, most: "".join(rng.choice("abAé") for _ in range(rng.randint(least, most)))
    pairs = tuple((some(1, 4), some(0, 5)) for _ in range(rng.randint(1, 12)))
    for _ in range(10):
        t = some(0, 40)
        assert dictionary.Aliases(pairs).rewrite(t) == plain(t, pairs)


def test_same_as_the_column_function(spark):
    rows = [(t,) for t in ("The article on nutrition", "THEtheDer QUE", "Tiểu đường type 2 và BÀ BẦU", "İstanbul ſtraße K", "", None, "$1 \\ the")]
    df = spark.createDataFrame(rows, "t string")
    odd = (("$1", "\\2$"), ("\\", "$0"), ("i", "J"), ("s", "z"), ("k", "q"), ("the", ""))
    for pairs in (TEST_EN.aliases, VI_DEFAULT.aliases, odd):
        got = df.select(dictionary.expand_aliases("t", pairs).alias("a"), text.expand_aliases("t", pairs).alias("b")).collect()
        assert all(r.a == r.b for r in got), pairs
    assert [r[0] for r in df.select(dictionary.holds_any("t", ["NUTRI", "bầu"])).collect()] == [True, False, True, False, False, None, False]
    assert [r[0] for r in df.select(dictionary.holds_any("t", [])).collect()] == [False] * 5 + [None, False]
    with pytest.raises(ValueError):
        dictionary.expand_aliases("t", [("", "x")])


def test_large_dictionaries():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(50_000)]
    pairs = tuple((w, words[(i + 1) % len(words)]) if i % 2 == 0 else (w, f"<{i}>") for i, w in enumerate(words))
    rules = dictionary.Aliases(pairs)
    t = " ".join(rng.choices(words, k=2000) + ["other words"] * 2000)
    began = time.time()
    got = rules.rewrite(t)
    assert time.time() - began < 20
    there = set(t.split())
    made = there | {f for a, f in pairs if a in there}
    few = [p for p in pairs if p[0] in made]
    assert got == plain(t, few)
