"""Page layouts whose own text must stay on hosts with many pages, and a plain re-statement of the counting."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import html_text

KINDS = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


#: Pages in which {0}, {1} and {2} are texts of their own that stay and {x} is one that goes.
LAYOUTS = {
    "introduction": "<div class=intro><p>{0}</p></div><div class=text><p>{1}</p><p>{2}</p></div>",
    "introduction under a headline": "<h1>{0}</h1><div class=intro><p>{1}</p></div><div class=text><p>{2}</p><p>{2}</p></div>",
    "table behind the entry": "<div class=entry><p>{0}</p><p>{1}</p></div><table class=data><tr><td>{2}</td></tr></table>",
    "head without an end": "<html><head><title>T</title><body><p>{0}</p><div><p>{1}</p></div>{2}",
    "text right after the head": "<head><title>T</title>{0}<p>{1}</p><p>{2}</p>",
    "paragraph named related": "<article><p>{0}</p><p class='related'>{1}</p><p>{2}</p></article>",
    "box named alert": "<article><p>{0}</p><div class='alert'>{1}</div><p>{2}</p></article>",
    "cell named header": "<article><p>{0}</p><table><tr><td class='header'>{1}</td><td>{2}</td></tr></table></article>",
    "headline and lead before the article": "<h1>{0}</h1><p class=lead>{1}</p><article><p>{2}</p></article>",
    "article as comment": "<main><p>{0}</p><p>{1}</p><p>{2}</p><article class='comment'><p>{x}</p></article></main>",
    "comment longer than the text": "<article><p>{0}</p><p>{1}</p>{2}</article><div class=comments><p>{x}</p><p>{x}</p><p>{x}</p><p>{x}</p></div>",
    "menu, footer and form": "<nav>{x}</nav><div class=zz1><a>home</a><a>news</a></div><article><p>{0}</p><p>{1}</p>{2}<form>{x}</form></article><footer>{x}</footer>",
}


def made():
    rng, pages, want = random.Random(12), [], {}
    for h, (name, layout) in enumerate(LAYOUTS.items()):
        for i in range(40):
            own = [words(rng, rng.randrange(9, 30)) for _ in range(3)]
            n = h * 100 + i
            pages.append((n, f"http://host{h}/{i}", layout.format(*own, x=words(rng, 40))))
            want[n] = (name, own + own[2:] if "headline" == name[-8:] else own)
    return pages, want


def test_no_text_is_lost_on_large_hosts(spark):
    pages, want = made()
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, KINDS)).collect()}
    for n, (name, own) in want.items():
        assert got[n].split("\n") == own, name


@pytest.mark.parametrize("name", ["head without an end", "text right after the head", "article as comment", "comment longer than the text", "menu, footer and form"])
def test_no_text_is_lost_on_small_hosts(name):
    rng = random.Random(3)
    own = [words(rng, 20) for _ in range(3)]
    page = LAYOUTS[name].replace("<div class=zz1><a>home</a><a>news</a></div>", "").format(*own, x=words(rng, 40))
    assert [t for t, _ in html_text.parse(page)[0]] == own


def test_headlines_before_the_article_stay_on_small_hosts():
    parsed = lambda page: [t for t, _ in html_text.parse(page)[0]]
    assert parsed("<h1>The headline</h1><article><p>the text</p></article><p>beside</p>") == ["The headline", "the text"]


def plain(pages):
    """Texts of the pages by counting in one pass over all of them; headings that most pages share aside."""
    seen, hosts, parsed = defaultdict(set), defaultdict(set), []
    for n, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
        host = m[1].lower() if m else None
        a = html_text.analyse(html)
        parsed.append((n, host, a))
        hosts[host].add(a[6])
        for i, kind in ((4, False), (5, True)):
            for d in set(a[i]) - {0}:
                seen[host, d, kind].add(a[6])
    gone = {(h, d) for (h, d, shape), heads in seen.items() if len(heads) >= html_text.TEMPLATE_PAGES and (shape or len(heads) >= html_text.TEMPLATE_SHARE * len(hosts[h]))}
    out = {}
    for n, host, (blocks, at, goes, up, texts, shapes, _) in parsed:
        names, dead = len(hosts[host]) < html_text.COUNTED_PAGES, []
        for i, parent in enumerate(up):
            dead.append((host, texts[i]) in gone or (host, shapes[i]) in gone or (parent >= 0 and dead[parent]))
        out[n] = "\n".join(t for t, i, g in zip(blocks, at, goes) if not dead[i] and g != 1 and not (g == 2 and names))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_counting_against_a_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_DIGESTS", broadcast)
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    pages = [tuple(r) for r in table.collect()] + [(n + 10**6, u, h) for n, u, h in made()[0]]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, KINDS).withColumn("row", F.lit("x"))).collect()}
    assert got == plain(pages)
