"""Rewriting and finding by dictionaries of any size: one automaton of all entries (Aho-Corasick) instead of an expression per entry.

Case is ignored as by the column functions beside: two characters are the same if they are after raising and lowering, one by one, so
that places in the folded text are places in the text.  The entries go to each task once, so the dictionary must fit a task's memory;
the automaton is made once a Python worker.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import ColumnLike, col


class _Fold(dict):
    """Code points to what they are compared by."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        up = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
        self[point] = out = ord(up.lower()[0])
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text in the form that is compared, character by character."""
    return text.translate(_FOLD)


class Aliases:
    """Ordered (alias, formal) pairs; each is applied to what the ones before it made."""

    def __init__(self, pairs: tuple[tuple[str, str], ...]):
        self.keys = [fold(a) for a, _ in pairs]
        self.formal = [(f, fold(f)) for _, f in pairs]
        self.reach = max(map(len, self.keys), default=1) - 1
        places: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            places.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, ids in places.items():
            self.automaton.add_word(k, ids)
        self.automaton.make_automaton()

    def _found(self, folded: str, a: int, b: int) -> set[int]:
        """The pairs whose alias lies between a and b."""
        return {i for _, ids in self.automaton.iter(folded, a, b) for i in ids}

    def rewrite(self, text: str) -> str:
        """The pairs in order, each at all its places from the left.

        Only pairs that occur are looked at: those in the text, and later ones that a replacement has made, which lie around it.
        """
        if not self.keys:
            return text
        folded = fold(text)
        queue = list(known := self._found(folded, 0, len(folded)))
        heapq.heapify(queue)
        while queue:
            now = heapq.heappop(queue)
            key, (formal, formal_folded) = self.keys[now], self.formal[now]
            at, parts, folds, made, length = 0, [], [], [], 0
            while (hit := folded.find(key, at)) >= 0:
                parts += text[at:hit], formal
                folds += folded[at:hit], formal_folded
                length += hit - at
                made.append((length, length + len(formal)))
                length += len(formal)
                at = hit + len(key)
            if not made:
                continue
            text, folded = "".join([*parts, text[at:]]), "".join([*folds, folded[at:]])
            until = 0
            for a, b in made:  # no place is searched twice but for the reach of an alias
                a, b = max(a - self.reach, until - self.reach, 0), min(b + self.reach, len(folded))
                if b > a:
                    for i in self._found(folded, a, b) - known:
                        if i > now:
                            known.add(i)
                            heapq.heappush(queue, i)
                until = max(until, b)
        return text


@lru_cache(maxsize=4)
def _aliases(pairs: tuple[tuple[str, str], ...]) -> Aliases:
    return Aliases(pairs)


@lru_cache(maxsize=4)
def _words(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(fold(w), w)
    found.make_automaton()
    return found


def expand_aliases(c: ColumnLike, aliases) -> Column:
    """Replace aliases in order, any case, inside words too; each sees what the one before it made.  Null stays null; an empty alias is an error."""
    pairs = tuple((a, f) for a, f in aliases)
    if not all(a for a, _ in pairs):
        raise ValueError("an alias is empty")

    @F.pandas_udf("string")
    def expand(texts: pd.Series) -> pd.Series:
        rules = _aliases(pairs)
        return texts.map(lambda t: None if t is None else rules.rewrite(t))

    return expand(col(c))


def holds_any(c: ColumnLike, words) -> Column:
    """Whether one of the words occurs, any case, inside words too; null for null, false if there are no words."""
    sought = tuple(words)
    if not all(sought):
        raise ValueError("a word is empty")
    if not sought:
        return F.when(col(c).isNotNull(), F.lit(False))

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        found = _words(sought)
        return pd.Series([None if t is None else next(found.iter(fold(t)), None) is not None for t in texts], dtype=object)

    return holds(col(c))
