"""Containers found with a stack of open elements, against a plain reader of trees and by hand."""

import random
from html.parser import HTMLParser

import pytest

from corpusflow.functions import containers
from corpusflow.functions.containers import Page, body_of, qa_of

QA = ("div.qa", "p.full", "p.short", "div.answer", "span.doctor")


class Plain(HTMLParser):
    """Elements of well-formed pages as (name, text inside)."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.found = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        one = [tag, ""]
        self.found.append(one)
        if tag not in containers.VOID:
            self.stack.append(one)

    def handle_endtag(self, tag):
        while self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        for one in self.stack:
            one[1] += data


def _tree(rng, depth):
    parts = []
    for _ in range(rng.randrange(4)):
        kind = rng.randrange(5)
        if kind == 0:
            parts.append(rng.choice(["word &amp; ", "<br>", "<!-- <div> -->", "a > b "]))
        elif depth:
            tag = rng.choice(["div", "section", "span", "b"])
            parts.append(f'<{tag} title="<p>">{_tree(rng, depth - 1)}</{tag}>')
        else:
            parts.append("x ")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_elements_of_well_formed_pages(seed):
    html = f"<html><body>{_tree(random.Random(seed), 6)}</body></html>"
    page = Page(html)
    starts = [r[0] for r in page.runs]
    got = [[e.name, containers._text(html, page, starts, e.start, e.end, [], "")] for e in page.elements]
    assert got == Plain(html).found


def _qa(q="", a="", name="", short="", more=""):
    return f'<div class="qa">{f"<p class=full>{q}</p>" if q else ""}{f"<p class=short>{short}</p>" if short else ""}<div class="answer x"><div>{a}</div> {f"<span class=doctor>{name}</span>" if name else ""}</div>{more}</div>'


def test_nested_and_unclosed_blocks():
    page = _qa("How?", "So <b>it</b> is.", "Dr A") + _qa(short="Why?", a="Because.")
    assert qa_of(page, *QA) == [(0, "How?", "So it is.", "Dr A"), (1, "Why?", "Because.", "")]
    # a block in a block: both rows, and the inner answer isn't the outer one's
    assert qa_of(_qa("Out?", "outer", more=_qa("In?", "inner")), *QA) == [(0, "Out?", "outer", ""), (1, "In?", "inner", "")]
    assert qa_of('<div class="qa">' + _qa("In?", "inner") + "<p class=full>Out?<div class=answer>outer</div></div>", *QA) == [(0, "Out?", "outer", ""), (1, "In?", "inner", "")]
    # unclosed paragraphs, an unclosed block at the page's end, stray end tags
    assert qa_of("</div><div class=qa><p class=full>How?<p class=other>no</b><div class=answer>So.", *QA) == [(0, "How?", "So.", "")]
    # without question or answer: no row, but counted
    assert qa_of(_qa("", "said") + _qa("asked", "") + _qa("q", "a"), *QA) == [(2, "q", "a", "")]
    assert qa_of("", *QA) == []


def test_bodies():
    assert body_of("<body><nav>menu<div>x</div></nav>a<div class='ad big'>buy<div>now</div> more</div><p>b &lt;<script>if (a < b) {'</p>'}</script>c</body>", ("article", "body"), ("nav", "div.ad")) == "a\nb <\nc"
    assert body_of("<article>one<article>two</article>three</article>four", ("article",), ()) == "one\ntwo\nthree"
    assert body_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ("li",), ()) == "a"
    assert body_of("<table><tr><td>a<td>b<tr><td>c</table>", ("tr",), ()) == "a\nb"
    assert body_of("no tags", ("body",), ()) is None
    assert body_of("<body>open <a href='x", ("body",), ()) == "open <a href='x"


def test_long_pages_take_linear_time():
    n = 100_000
    for html in ("<div>" * n + "x", "</p>" * n, "<a " * n, "<p>x" * n, '<a "' * n, "<b>" * n + "<div>" * 10, "<!-- " * n, "<div>" * n + "<li></li>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<p><ul>" + "<b>" * n + "<div></div>" * n):
        Page(html)


def test_rows(spark):
    df = spark.createDataFrame([(1, _qa("How?", "So.") * 2, "x"), (2, None, "y"), (3, "", "z")], "id int, html string, qa string")
    got = containers.extract_qa(df, "html", *QA).drop("html")
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0, "How?", "So.", ""), (1, "x", 1, "How?", "So.", "")]
    bodies = df.select("id", containers.container_body("html", ("div.answer",)).alias("b")).collect()
    assert {r.id: r.b for r in bodies} == {1: "So.", 2: None, 3: None}
    assert containers.extract_qa(df.limit(0), "html", *QA).collect() == []


def test_references(spark):
    cut = "<article><h1>Fish&amp;amp &eacute;&nbsp;</h1>a &lt;b &copy;&ltx&amp</article>"
    pairs = (("&nbsp;", " "), ("&lt;", "<"), ("&copy;", "©"), ("&amp;", "&"))
    assert body_of(cut, ("article",), (), pairs) == "Fish&amp &eacute;\na <b ©&ltx&amp"
    assert body_of(cut, ("article",), ()) == "Fish&amp é\na <b ©<x&"
    page = "<article><h1>Tea&amp;&am</h1><p>hot &amp</p></article>"
    assert qa_of(page, "article", "h1", "b", "p", "footer", pairs) == [(0, "Tea&&am", "hot &amp", "")]


@pytest.mark.parametrize("name", ["ext2_container_body", "ext8_qa_containers"])
def test_queries_decode_what_their_sql_does(spark, tmp_path, name):
    import duckdb

    from corpusflow.plans import oracle_sql, queries

    page = "<html><body><article><h1>Tea&amp;milk &ampx</h1><p>hot &lt;now&gt; &amp</p></article></body></html>"
    spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle_sql()[name]).fetchall()
    assert want and [tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()] == want
