"""The chunkers said in SQL: folds over lists, as the Spark side folds over arrays."""

from __future__ import annotations


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tidy(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda y: {trim('y')}), lambda y: y <> '')"


def split_after(x: str, marks: str) -> str:
    """The pieces of a text cut at the white space behind one of the marks."""
    return rf"string_split(regexp_replace({x}, '([{marks}])\s+', '\1' || chr(1), 'g'), chr(1))"


def fold(items: str, start: dict[str, str], step: dict[str, str], item: str = "p") -> str:
    """A fold of the state ``a`` over the strings ``items``; a step sees the string as ``x.p``."""
    first = ", ".join(f"{k}: {v}" for k, v in start.items())
    each = ", ".join(f"{k}: {v}" for k, v in step.items())
    zero = "{" + f"{item}: '', {first}" + "}"
    return f"list_reduce(list_transform({items}, lambda i: {{{item}: i, {first}}}), lambda a, x: {{{item}: '', {each}}}, {zero})"


NONE = "CAST([] AS VARCHAR[])"


def pack_words(sentence: str, size: int, least: int) -> str:
    """A sentence's words joined up to ``size`` characters; pieces under ``least`` are dropped."""
    joined = "CASE WHEN a.sub = '' THEN x.w ELSE a.sub || ' ' || x.w END"
    full = f"length({joined}) > {size}"
    kept = f"CASE WHEN {full} AND a.sub <> '' AND length(a.sub) >= {least} THEN list_append(a.res, a.sub) ELSE a.res END"
    words = rf"regexp_extract_all({sentence}, '[^\s]+')"
    done = fold(words, {"sub": "''", "res": NONE}, {"sub": f"CASE WHEN {full} THEN x.w ELSE {joined} END", "res": kept}, "w")
    return f"list_transform([{done}], lambda f: CASE WHEN f.sub <> '' AND length(f.sub) >= {least} THEN list_append(f.res, f.sub) ELSE f.res END)[1]"


def by_length(sentences: str, size: int, least: int, drop: int, overlap: int) -> str:
    """Sentences joined until the next would pass ``size``."""
    text = "array_to_string({0}.buf, ' ')"
    closed = lambda s: f"CASE WHEN length({text.format(s)}) >= {drop} THEN list_append({s}.res, {text.format(s)}) ELSE {s}.res END"
    keep = f"CASE WHEN len(a.buf) > {overlap} THEN a.buf[-{overlap}:] ELSE {NONE} END" if overlap else NONE
    kept = f"CAST(coalesce(list_sum(list_transform({keep}, lambda k: length(k) + 1)), 0) AS BIGINT)" if overlap else "CAST(0 AS BIGINT)"
    add = "length(x.p) + CAST(len(a.buf) > 0 AS BIGINT)"
    close = f"(len(a.buf) > 0 AND a.n + {add} > {size} AND a.n >= {least})"
    giant = f"length(x.p) > {size}"
    step = {
        "buf": f"CASE WHEN {giant} THEN {NONE} ELSE list_append(CASE WHEN {close} THEN {keep} ELSE a.buf END, x.p) END",
        "n": f"CASE WHEN {giant} THEN 0 ELSE CASE WHEN {close} THEN {kept} ELSE a.n END + {add} END",
        "res": f"CASE WHEN {giant} THEN list_concat(CASE WHEN len(a.buf) > 0 THEN {closed('a')} ELSE a.res END, {pack_words('x.p', size, drop)}) WHEN {close} THEN {closed('a')} ELSE a.res END",
    }
    done = fold(sentences, {"buf": NONE, "n": "CAST(0 AS BIGINT)", "res": NONE}, step)
    return f"list_transform([{done}], lambda f: CASE WHEN len(f.buf) > 0 THEN {closed('f')} ELSE f.res END)[1]"


def min_punct(text: str, least: int = 40) -> str:
    both = "a.buf || x.p"
    cut = f"(regexp_matches(x.p, '[.!?]$') AND length({trim(both)}) >= {least})"
    done = fold(rf"regexp_extract_all({text}, '[^.!?]*[.!?]|[^.!?]+$')", {"buf": "''", "res": NONE}, {"buf": f"CASE WHEN {cut} THEN '' ELSE {both} END", "res": f"CASE WHEN {cut} THEN list_append(a.res, {both}) ELSE a.res END"})
    return f"list_transform([{done}], lambda f: CASE WHEN {trim('f.buf')} <> '' THEN list_append(f.res, f.buf) ELSE f.res END)[1]"


def last_delim(text: str) -> str:
    both = "a.buf || x.p"
    head = f"regexp_extract({both}, '(?s)^(.*[.!?;:,\\n])', 1)"
    done = fold(f"regexp_extract_all({text}, '[^ ]* |[^ ]+$')", {"buf": "''", "res": NONE}, {"buf": f"substr({both}, length({head}) + 1)", "res": f"CASE WHEN {trim(head)} <> '' THEN list_append(a.res, {trim(head)}) ELSE a.res END"})
    return f"list_transform([{done}], lambda f: CASE WHEN {trim('f.buf')} <> '' THEN list_append(f.res, {trim('f.buf')}) ELSE f.res END)[1]"


def paragraph_pack(text: str, size: int = 256) -> str:
    """Per line, sentences packed up to ``size``; longer ones cut behind minor marks, then between words."""
    words = f"list_transform({tidy(split_after('s', ',;:\\-–—'))}, lambda m: CASE WHEN length(m) > {size} THEN {pack_words('m', size, 0)} ELSE [m] END)"
    small = f"list_transform({tidy(split_after('l', '.!?…'))}, lambda s: CASE WHEN length(s) > {size} THEN flatten({words}) ELSE [s] END)"
    fits = f"(a.buf <> '' AND length(a.buf) + 1 + length(x.p) <= {size})"
    done = fold(f"flatten({small})", {"buf": "''", "res": NONE}, {"buf": f"CASE WHEN {fits} THEN a.buf || ' ' || x.p ELSE x.p END", "res": f"CASE WHEN a.buf <> '' AND NOT {fits} THEN list_append(a.res, a.buf) ELSE a.res END"})
    line = f"list_transform([{done}], lambda f: CASE WHEN f.buf <> '' THEN list_append(f.res, f.buf) ELSE f.res END)[1]"
    return rf"flatten(list_transform({tidy(f"string_split_regex({text}, '[\r\n]+')")}, lambda l: {line}))"


def sentence_window(rows: str, window: int = 200, stride: int = 150) -> str:
    """A table w(key, i, x) of whole sentences up to ``window`` words, stepping back by at most ``window - stride``; ``rows`` gives key, text."""
    sentences = f"flatten(list_transform({tidy('string_split(text, chr(10))')}, lambda l: {tidy(split_after('l', '.?!'))}))"
    back = window - stride
    end = f"greatest({{0}} + 1, coalesce(list_max(list_filter(range({{0}} + 1, CAST(len(s) + 1 AS BIGINT)), lambda e: c[e + 1] - c[{{0}} + 1] <= {window})), 0))"
    again = f"CASE WHEN c[e + 1] - c[low + 1] <= {back} THEN e ELSE least(e, coalesce(list_min(list_filter(range(low + 1, e), lambda b: c[e + 1] - c[b + 1] <= {back})), e)) END"
    return rf"""s0 AS MATERIALIZED (SELECT key, text, {sentences} AS s FROM ({rows})), s1 AS MATERIALIZED (SELECT key, s, list_transform(range(0, CAST(len(s) + 1 AS BIGINT)), lambda k: coalesce(list_sum(list_transform(s[1:k], lambda y: len(regexp_extract_all(y, '[^\s]+')))), 0)) AS c FROM s0 WHERE len(s) > 0),
r AS (SELECT key, s, c, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS low, {end.format('CAST(0 AS BIGINT)')} AS e FROM s1
 UNION ALL SELECT key, s, c, i, low, {end.format('low')} AS e FROM (SELECT key, s, c, i + 1 AS i, {again} AS low FROM r WHERE e < len(s))),
w AS (SELECT key, i, array_to_string(s[low + 1 : e], ' ') AS x FROM r UNION ALL SELECT key, 0, text FROM s0 WHERE len(s) = 0 AND {trim('text')} <> '')"""
