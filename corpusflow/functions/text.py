"""Cleaning and normalising texts: every function takes a column (or a name) and returns a column.

Null stays null unless a function says otherwise.  Nothing here shuffles; a chain of these is one projection.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.packs import VI_DEFAULT, Pack

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lines(c: ColumnLike) -> Column:
    return F.split(col(c), "\n")


def any_of(patterns) -> str:
    """One case-insensitive alternation; bounded by words where the pack's patterns are plain words."""
    return "(?iu)(?:" + "|".join(patterns) + ")"


def any_word(patterns) -> str:
    return r"(?iuU)\b(?:" + "|".join(patterns) + r")\b"


# cleaning


def collapse_ws(c: ColumnLike) -> Column:
    """Three and more newlines become two, runs of spaces and tabs one space; trimmed."""
    out = F.regexp_replace(col(c), r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip_invisible(c: ColumnLike) -> Column:
    """No-break spaces become spaces; zero-width spaces, joiners and byte-order marks go."""
    return F.translate(col(c), " ​‌﻿", " ")


def cut_references(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """Nothing from the first reference heading at a line's start on."""
    return F.split(col(c), r"(?iuU)\n(?:" + "|".join(pack.references) + r")\b", 2)[0]


def remove_toc(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """The first contents heading goes with the numbered and blank lines that follow it."""
    head = r"(?s)^(.*?)\n" + pack.toc_heading + r"\n(?:[ \t]*(?:\d+\.[^\n]*)?(?:\n|\z))*(.*)$"
    found = col(c).contains("\n" + pack.toc_heading + "\n")
    before, after = F.regexp_extract(col(c), head, 1), F.regexp_extract(col(c), head, 2)
    return F.when(found, F.concat(before, F.when(after != "", F.concat(F.lit("\n"), after)).otherwise(F.lit("")))).otherwise(col(c))


def drop_lines(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """Without separator lines, lines that are only a url, bylines and navigation lines."""
    unwanted = r"(?iuU)^(?:-{5,}$|https?://\S+$|(?:" + "|".join(pack.bylines) + r")|(?:" + "|".join(pack.navigation) + r")\b)"
    return F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike(unwanted)), "\n")


def clean_content(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    return collapse_ws(drop_lines(remove_toc(cut_references(strip_invisible(c), pack), pack), pack))


def trim_lines(c: ColumnLike) -> Column:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), "\n")


def word_count(c: ColumnLike) -> Column:
    """Words between white space; 0 for blank."""
    return F.regexp_count(col(c), F.lit(r"\S+")).cast("long")


# normalising


def expand_aliases(c: ColumnLike, aliases=VI_DEFAULT.aliases) -> Column:
    """Replace aliases in order, any case, inside words too; each sees what the one before it made."""
    out = col(c)
    for alias, formal in aliases:
        out = F.regexp_replace(out, "(?iu)" + re.escape(alias), formal.replace("\\", r"\\").replace("$", r"\$"))
    return out


def asr_fixups(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """Lower case, single spaces, the literal fixes, then the aliases."""
    out = F.regexp_replace(strip(F.lower(col(c))), r"\s+", " ")
    for heard, meant in pack.asr_fixes:
        out = F.replace(out, F.lit(heard), F.lit(meant))
    return expand_aliases(out, pack.aliases)


def nfc(c: ColumnLike) -> Column:
    """Unicode normal form C; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(col(c))


def score_norm(c: ColumnLike, digits: dict[str, str] = VI_DEFAULT.digits, compose: bool = True) -> Column:
    """For scoring transcripts: upper case, quotes and punctuation as spaces, single digits as words."""
    out = F.upper(nfc(c) if compose else col(c))
    out = F.regexp_replace(out, r"[\"'`‘’“”.,;:!?()\[\]{}\-–—/|]", " ")
    for digit, word in digits.items():
        out = F.regexp_replace(out, rf"(?U)\b{digit}\b", word)
    return strip(F.regexp_replace(out, r"\s+", " "))


def simple_norm(c: ColumnLike) -> Column:
    """Lower case, everything but letters, digits and underscores as spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: ColumnLike) -> Column:
    return F.filter(F.split(simple_norm(c), " "), lambda t: t != "")


# fixed values: the markdown that goes, in the order it goes, and what stays of it
_STARS, _UNDERSCORES = (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"), (r"_{1,3}([^_\n]+)_{1,3}", "$1")
_MARKDOWN = ((r"(?m)^#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*[0-9]+\.[ \t]+", ""), (r"`{1,3}([^`]*)`{1,3}", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\n+", " "))


def strip_markdown(c: ColumnLike, underscores: bool = True) -> Column:
    """Bold, italics, headings, bullets, numbers, code and links as plain text on one line."""
    out = col(c)
    for pattern, new in (_STARS, *([_UNDERSCORES] if underscores else []), *_MARKDOWN):
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


# fixed value: what counts as a url in spoken text
_URL = r"(?i)https?://\S+|www\.\S+"


def voice_clean(c: ColumnLike) -> Column:
    """struct(text, removed_url): links as their labels, urls gone, white space single."""
    text = F.regexp_replace(col(c), r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(F.regexp_replace(text, _URL, ""), r"\s{2,}", " ")
    return F.struct(out.alias("text"), text.rlike(_URL).alias("removed_url"))


def drop_injection_lines(c: ColumnLike, pack: Pack = VI_DEFAULT) -> Column:
    """Lines trimmed, without blank ones and those that give the model orders."""
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.rlike(any_of(pack.injection))), "\n")


def strip_source_tags(c: ColumnLike) -> Column:
    """Without parenthesised tags that begin with two capitals."""
    return strip(F.regexp_replace(col(c), r"\s*\(\p{Lu}{2}[^()]*\)", ""))


def query_lines(c: ColumnLike, n: int = 4) -> Column:
    """The first ``n`` lines that aren't blank, trimmed."""
    return F.slice(F.filter(F.transform(lines(c), strip), lambda x: x != ""), 1, n)


def truncate_hint(c: ColumnLike, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def qualify_refs(c: ColumnLike, law: str, keywords, reach: int = 40, mention: str = r"Điều \d+") -> Column:
    """Name the law behind every article mention unless one of the keywords follows within ``reach`` characters."""
    ahead = "".join(rf"(?!(?s:.){{0,{max(0, reach - len(k))}}}{re.escape(k)})" for k in keywords)
    return F.regexp_replace(col(c), rf"({mention})(?!\d){ahead}", "$1 " + law.replace("$", r"\$"))


def parse_llm_json(c: ColumnLike, schema: str) -> Column:
    """The object in a model's answer: without thoughts and code fences, from the first brace to the last."""
    out = F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(out, r"(?s)\{.*\}", 0), schema)


# reading aloud

# fixed values: units and their spoken names
_UNITS = {"km": "ki lô mét", "kg": "ki lô gam", "mg": "mi li gam", "ml": "mi li lít", "cm": "xen ti mét", "mm": "mi li mét", "m": "mét", "g": "gam", "l": "lít", "h": "giờ"}


def spoken_form(c: ColumnLike, units: dict[str, str] = _UNITS) -> Column:
    """Text ready to be read aloud: temperatures, money, percent, units, times, dates, phone numbers, versions, decimals.

    The rules run in this order; spans inside <en>...</en> are left as they are.  Dates and times out of range stay.
    """

    # fixed values: the patterns, their spoken forms and their order
    def rules(x: Column) -> Column:
        x = F.regexp_replace(x, r"(-?\d+(?:[.,]\d+)?)\s*°\s*C\b", "$1 độ xê")
        x = F.regexp_replace(x, r"(\d+(?:[.,]\d+)?)\s*(?:đ|VND|VNĐ)(?![\p{L}\p{N}])", "$1 đồng")
        x = F.regexp_replace(x, r"\$\s*(\d+(?:[.,]\d+)?)", "$1 đô la")
        x = F.regexp_replace(x, r"(\d)\s*%", "$1 phần trăm")
        for unit, word in units.items():
            x = F.regexp_replace(x, rf"(\d)\s*{unit}(?![\p{{L}}\p{{N}}])", "$1 " + word)
        x = F.regexp_replace(x, r"\b([01]?\d|2[0-3]):([0-5]\d)\b", "$1 giờ $2 phút")
        x = F.regexp_replace(x, r"\b(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/(\d{4})\b", "ngày $1 tháng $2 năm $3")
        x = F.regexp_replace(x, r"(?<=\d)\.(?=\d+\.\d)|(?<=\d\.\d)\.(?=\d)", " chấm ")
        return F.regexp_replace(x, r"(\d),(\d)", "$1 phẩy $2")

    parts = F.split(col(c), r"(?=<en>)|(?<=</en>)")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("<en>"), x).otherwise(rules(x))), "")


# fixed values: the Vietnamese digits
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")


def _below_thousand(n: Column) -> Column:
    digit = lambda i: F.element_at(F.array(*map(F.lit, DIGITS)), i.cast("int") + 1)
    hundreds, rest = F.floor(n / 100), n % 100
    tens, ones = F.floor(rest / 10), rest % 10
    ten = F.when(tens == 1, "mười").when(tens > 1, F.concat_ws(" ", digit(tens), F.lit("mươi")))
    one = F.when(ones == 0, F.lit(None)).when((ones == 1) & (tens > 1), "mốt").when((ones == 5) & (tens > 0), "lăm").otherwise(digit(ones))
    low = F.when((rest < 10) & (hundreds > 0), F.when(rest > 0, F.concat_ws(" ", F.lit("lẻ"), digit(rest)))).otherwise(F.concat_ws(" ", ten, one))
    return F.concat_ws(" ", F.when(hundreds > 0, F.concat_ws(" ", digit(hundreds), F.lit("trăm"))), F.nullif(low, F.lit("")))


def number_words(c: ColumnLike) -> Column:
    """An integer in Vietnamese words, up to 999 billion on either side of zero; null beyond."""
    n = F.abs(col(c).cast("bigint"))
    billions, millions, thousands, rest = F.floor(n / 1_000_000_000), F.floor(n / 1_000_000) % 1000, F.floor(n / 1000) % 1000, n % 1000
    part = lambda v, name: F.when(v > 0, F.concat_ws(" ", _below_thousand(v), F.lit(name)))
    last = F.when(rest > 0, F.when((thousands > 0) & (rest < 10), F.concat_ws(" ", F.lit("không trăm lẻ"), _below_thousand(rest))).when((thousands > 0) & (rest < 100), F.concat_ws(" ", F.lit("không trăm"), _below_thousand(rest))).otherwise(_below_thousand(rest)))
    words = F.concat_ws(" ", F.when(col(c).cast("bigint") < 0, "âm"), part(billions, "tỷ"), part(millions, "triệu"), part(thousands, "nghìn"), last)
    return F.when(n == 0, DIGITS[0]).when(billions < 1000, words)


def numbers_to_words(c: ColumnLike) -> Column:
    """The text with its whole numbers in words; numbers that are too large stay."""
    pattern = r"(?U)\b\d+\b"
    numbers = F.transform(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)), lambda d: F.coalesce(number_words(F.when(F.length(d) <= 12, d)), d))
    pieces = F.zip_with(F.split(col(c), pattern, -1), numbers, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit(""))))
    return F.array_join(pieces, "")
