"""Token ids of a public byte-level BPE, with a cache over space-separated pieces.

The vocabulary is read in each task from files named by parameter (a ``.tiktoken`` rank file and, for texts
that hold a special token's string, the ``.json`` of the same vocabulary).  A text is cut before each space:
where every space stands before a visible character, no pre-token of the byte-level pattern crosses such
a cut, so the pieces' ids joined are the text's ids.  Any other text is encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
CACHE = 300_000
_UNSAFE = re.compile(r" (?=\s|$)")


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < CACHE:
            self[piece] = ids
        return ids


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS, json: str = JSON):
    """A function from text to its ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers
    import tiktoken

    with open(_path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    pieces = _Pieces(plain)
    whole: list = []

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(_path(json)))
            return array("I", whole[0].encode(text, add_special_tokens=False).ids).tobytes()
        if _UNSAFE.search(text):
            return array("I", plain(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", plain(first)).tobytes() + b"".join(map(pieces.__getitem__, rest))

    return encode
