"""Extraction from saved pages with regular expressions on columns: titles, bodies, links, urls, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import ColumnLike, col, strip, trim_lines

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))
TITLES = (r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>")
BODIES = (r"(?is)<article[^>]*>(.*)</article>", r"(?is)<main[^>]*>(.*)</main>", r"(?is)<body[^>]*>(.*)</body>")
BOILERPLATE = r"(?is)<!--.*?-->|<(script|style|nav|aside|noscript|footer|form)\b[^>]*>.*?</\1\s*>|<div class=\"ads?\"[^>]*>.*?</div>"


def unescape(c: ColumnLike) -> Column:
    """The common named entities; &amp; last, so that nothing is decoded twice."""
    out = col(c)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _first(c: ColumnLike, patterns) -> Column:
    return F.coalesce(*(F.when(col(c).rlike(p), F.regexp_extract(col(c), p, 1)) for p in patterns))


def extract_title(html: ColumnLike, patterns=TITLES) -> Column:
    """The first matching title element's text; null if there is none or it is blank."""
    text = strip(F.regexp_replace(unescape(F.regexp_replace(_first(html, patterns), "(?s)<[^>]+>", "")), r"\s+", " "))
    return F.nullif(text, F.lit(""))


def extract_body(html: ColumnLike, patterns=BODIES) -> Column:
    """The body container's text, without scripts, styles, navigation and adverts, a line per element."""
    inside = F.regexp_replace(_first(html, patterns), BOILERPLATE, "\n")
    return trim_lines(unescape(F.regexp_replace(inside, r"(?s)<[^>]+>", "\n")))


def extract_links(html: ColumnLike, base: ColumnLike) -> Column:
    """All hrefs as absolute urls, each once, in order; fragments and scripts are left out."""
    found = F.regexp_extract_all(col(html), F.lit(r'(?i)href\s*=\s*["\']([^"\']+)["\']'), F.lit(1))
    origin = F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(col(base), r"[?#].*$", ""), r"[^/]*$", "")

    def absolute(h: Column) -> Column:
        h = unescape(h)
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .otherwise(F.concat(folder, h))
        )

    wanted = F.filter(found, lambda h: ~h.rlike(r"(?i)^\s*(#|javascript:|mailto:|tel:)"))
    return F.array_distinct(F.transform(wanted, absolute))


def url_domain(url: ColumnLike, fallback: str = "") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1), F.lit("")), F.lit(fallback))


def classify_url(url: ColumnLike, article: str, listing: str, exclude: tuple[str, ...] = ()) -> Column:
    """excluded, article, listing or other; in this order."""
    out = F.when(F.lit(False), F.lit(""))
    for word in exclude:
        out = out.when(F.contains(col(url), F.lit(word)), "excluded")
    return out.when(col(url).rlike(article), "article").when(col(url).rlike(listing), "listing").otherwise("other")


_PAGE = (r"([?&]page=)(\d+)", r"(/page_)(\d+)", r"(/page/)(\d+)")


def next_page_url(url: ColumnLike) -> Column:
    """The url with its page number raised by one, or with page 2."""
    u = col(url)
    out = F.when(F.lit(False), u)
    for p in _PAGE:
        number = (F.regexp_extract(u, p, 2).cast("long") + 1).cast("string")
        out = out.when(u.rlike(p), F.concat(F.regexp_extract(u, "(?s)^(.*?)" + p, 1), F.regexp_extract(u, p, 1), number, F.regexp_extract(u, "(?s)" + p + "(.*)$", 3)))
    return out.otherwise(F.concat(u, F.when(F.contains(u, F.lit("?")), F.lit("&page=2")).otherwise(F.lit("?page=2"))))


def max_page(urls: DataFrame, url: str, by: Column | None = None, default: int = 1) -> DataFrame:
    """The largest page number of the urls, per ``by`` if given."""
    number = F.max(F.nullif(F.regexp_extract(url, r"page=(\d+)", 1), F.lit("")).cast("long"))
    grouped = urls.groupBy(by.alias("domain")) if by is not None else urls.groupBy()
    return grouped.agg(F.coalesce(number, F.lit(default)).alias("max_page"))


def extract_qa(pages: DataFrame, html: str, block: str, question: str, short_question: str, answer: str, doctor: str) -> DataFrame:
    """A row per question and answer container: question (full before short), answer (without the doctor's name), doctor, pos."""
    rows = pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(block), F.lit(0))).alias("pos", "__block"))
    text = lambda p: strip(unescape(F.regexp_replace(F.regexp_extract("__block", p, 1), "(?s)<[^>]+>", " ")))
    full, name = F.nullif(text(question), F.lit("")), text(doctor)
    out = rows.withColumn("question", F.coalesce(full, text(short_question))).withColumn("doctor", name)
    return out.withColumn("answer", strip(F.replace(text(answer), name, F.lit("")))).where("question <> '' and answer <> ''").drop("__block")


def strip_edges(c: ColumnLike, menu: str, call: str) -> Column:
    """Without the leading menu lines and the closing call-to-action block."""
    out = F.regexp_replace(col(c), rf"^(?:(?:{menu})[^\n]*\n)+", "")
    return F.regexp_replace(out, rf"(?s)\n(?:{call})\b.*$", "")


def assemble_content(description: ColumnLike, body: ColumnLike, author: ColumnLike, label: str = "Author: ") -> Column:
    part = lambda c: F.nullif(strip(col(c)), F.lit(""))
    return F.concat_ws("\n\n", part(description), part(body), F.when(part(author).isNotNull(), F.concat(F.lit(label), part(author))))


def topic_filter(df: DataFrame, title: Column, text: str, keywords, head: int = 500) -> DataFrame:
    """Rows whose title or first ``head`` characters hold a keyword, in any case."""
    sought = F.lower(F.concat_ws(" ", title, F.substring(text, 1, head)))
    return df.where(sought.rlike("(?u)" + "|".join(keywords)))


def crawl_stop(pages: DataFrame, category: str, order: str, n_items: str, max_pages: int, empty_run: int = 2) -> DataFrame:
    """The pages of a category that a crawl visits: to its second empty page in a row, or ``max_pages``."""
    w = Window.partitionBy(category).orderBy(order)
    empty = F.col(n_items) == 0
    run = empty
    for i in range(1, empty_run):
        run = run & F.coalesce(F.lag(empty, i).over(w), F.lit(False))
    out = pages.withColumn("__n", F.row_number().over(w)).withColumn("__stop", run.cast("int"))
    before = F.coalesce(F.max("__stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("__done", before).where((F.col("__done") == 0) & (F.col("__n") <= max_pages)).drop("__n", "__stop", "__done")
