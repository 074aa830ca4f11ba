"""Main text of saved pages, with site templates removed.

A page is parsed once into blocks of text and the element subtrees around them.  Every subtree has a digest of its levelled
text (case and white space don't count); subtrees outside the page's main part that are named, by class, id or role or as
landmarks, have one of their shape too: tags and names, without text, runs of like children as one.  Spark counts on how many different pages
of a host each digest occurs.  A text that recurs on many of them, or a shape outside the main part that does, is template, and the subtree is
deleted wherever it stands.  What has a shape and holds words of its own, unlinked, as introductions and tables do, counts by its text only, unless its name says what it is or
the page marks its article elsewhere.  Pages count as different by their heading, here and in the host's total, so copies of one page
add nothing and an article that was copied many times stays.  Where most pages of a host share one heading, those with enough
text of their own count by their text.

The main part is what a page marks as its article, or else the innermost element with most of its text.  Elements for menus, page headers and footers,
sidebars and forms are never the article, nor are readers' comments, whose texts can't recur.  On hosts with too few pages to count, names decide the
rest: what is named as a notice, advert, related matter or the like goes, unless it holds most of the article, and so does what lies beside a marked
article but for the headline.  Scripts, styles and the like are no text.

Null or empty html gives an empty text; so does a page without text.  A null url is a host of its own.  Repeated
rows and ids are extracted each.  Pages of any length and depth are parsed whole.  Extra columns are not
passed.  Ties don't arise: counts decide.  Unclosed and misnested markup is repaired by the nearest open element; nothing is dropped for length.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vec
from corpusflow.llm.shared import stored

#: A subtree is template on a host if at least this many different pages have it ...
TEMPLATE_PAGES = 10
#: ... and, by its text, at least this share of the host's different pages, as articles share passages.
TEMPLATE_SHARE = 0.25
#: On hosts with at least this many different pages names say nothing: what recurs there can be counted.
COUNTED_PAGES = 20
#: Unlinked words from which an element's own text says more than its shape; of tables and the like, one.
PROSE = 8
#: Digests that are template, and hosts that are counted, are sent to the tasks only up to this many.
BROADCAST_DIGESTS = 1_000_000
#: Below a heading that most pages share, a page is different if this share of its text stands on few pages.
OWN_SHARE = 1 / 3

# fixed values: elements by what they are for
UNSEEN = frozenset("script style noscript template iframe object embed svg math canvas audio video head title".split())
SKIP = frozenset("nav aside footer form button select textarea input label fieldset dialog menu".split())
LANDMARK = SKIP | {"header"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html"}
#: Elements whose texts are counted: blocks, as what recurs inside a line recurs with it or is the article's.
COUNTED = CLOSES_P | LANDMARK
# names of what is never the article, and of parts of a layout that may also name what lies around the article
NEVER = re.compile(r"ad|ads|advert\w*|adsense|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|related|recommended|breadcrumb|breadcrumbs|pagination|pager")
COMMENTS = re.compile(r"comment|comments|disqus|respond|replies")
LAYOUT = re.compile(r"banner|notice|alert|overlay|social|sidebar|side|aside|widget|menu|nav|navbar|navigation|header|masthead|topbar|footer|foot|toolbar|skip|copyright|legal|disclaimer")
#: After one of these in a compound the word says what the layout has or lacks: has-sidebar, layout-with-nav, no-comments.
ABOUT = frozenset("has with without no not hide hides".split())
#: Elements that hold no layout.
LEAF = frozenset("p li dd dt td th pre blockquote h1 h2 h3 h4 h5 h6 a b i em strong span".split())
#: Elements whose words are the article's even if few.
FILLED = frozenset("table pre blockquote figure dl".split())
#: What can be in a head; anything else ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: A header of one of these is a headline.
HEADED = frozenset("article entry post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADER_INSIDE = frozenset("article main".split())


_DIGITS = re.compile("[0-9]+")


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _named(attrs: dict, inside: bool) -> str:
    """What the class and id say of an element: "comments", "never" the article, "layout", "headline" or nothing."""
    found = set()
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        for i, word in enumerate(parts):
            if ABOUT.intersection(parts[:i]) or (word == "side" and "by" in parts):
                continue
            if word == "header" and (inside or HEADED.intersection(parts[:i])):
                found.add("headline")
            elif COMMENTS.fullmatch(word):
                found.add("comments")
            elif NEVER.fullmatch(word):
                found.add("never")
            elif LAYOUT.fullmatch(word):
                found.add("layout")
    return next((x for x in ("comments", "never", "layout", "headline") if x in found), "")


class _Node:
    __slots__ = ("tag", "drop", "by_name", "main", "named", "label", "parts", "text", "shape", "number")

    def __init__(self, tag: str, drop: bool, main: bool, named: str = "", label: str = ""):
        self.tag, self.drop, self.by_name, self.main, self.named, self.label, self.parts, self.text, self.shape, self.number = tag, drop, False, main, named, label, [], 0, 0, -1


class _Tree(HTMLParser):
    """Elements and texts as nested parts; no more repair than closing what a tag implies."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = _Node("", False, False)
        self.stack = [self.top]
        self.title = []

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        if tag not in HEAD:
            self._leave_head()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self._close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in peers:
                    self._close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tr" if tag in ("td", "th") else "table", "select"):
                    break
        if tag == "br" or tag == "hr":
            stack[-1].parts.append(" ")
        if tag in VOID:
            return
        attrs = {k: v or "" for k, v in attrs}
        label = " ".join(sorted(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split()))
        drop = tag in SKIP or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        named = _named(attrs, any(n.main for n in stack)) if "class" in attrs or "id" in attrs else ""
        if tag == "header" and named != "headline" and not any(n.tag in HEADER_INSIDE for n in stack):
            drop = True
        main = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        node = _Node(tag, bool(drop), main, "" if tag in ("html", "body") else named, _DIGITS.sub("0", label))
        stack[-1].parts.append(node)
        stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.stack) > 1 and self.stack[-1].tag == tag:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return
            if self.stack[i].tag in ("article", "main") and tag in ("p", "b", "i", "em", "strong", "span", "a", "li", "div", "section"):
                return
            if self.stack[i].tag in BLOCK and tag not in BLOCK and tag not in SKIP and tag not in UNSEEN:
                return

    def _close(self, i: int):
        del self.stack[i:]

    def _leave_head(self):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == "head":
                self._close(i)
                return
            if self.stack[i].tag != "html":
                return

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and not data.isspace():
            self._leave_head()
        self.stack[-1].parts.append(data)


def _levels(top: _Node) -> tuple[list[_Node], list[int]]:
    """The elements level by level, each after its parent, and their parents' places."""
    order, up, at = [top], [-1], 0
    while at < len(order):
        for part in order[at].parts:
            if not isinstance(part, str):
                order.append(part)
                up.append(at)
        at += 1
    return order, up


def _settle(top: _Node):
    """Mark the elements that go by their names, but none that holds most of the page's article; comments go on any host.

    The article is what lies in elements marked so that have no such name themselves, or else the text that nothing drops.
    What is never the article goes unless such a marked element in it holds most of that.
    """
    order, up = _levels(top)
    n = len(order)
    if not any(x.named for x in order):
        return
    never = [x.named in ("never", "comments") for x in order]
    marked = [x.main and not never[i] and x.named != "layout" for i, x in enumerate(order)]
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[up[i]] |= marked[i] or holds[i]
    gone, inside = [False] * n, [False] * n
    size, article = [0] * n, [0] * n
    for i, x in enumerate(order):
        parent = up[i]
        within = i > 0 and inside[parent]
        gone[i] = x.drop or (never[i] and (not x.main or within) and not holds[i]) or (i > 0 and gone[parent])
        inside[i] = marked[i] or within
        if not gone[i]:
            size[i] = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
            article[i] = size[i] if inside[i] else 0
    for i in range(n - 1, 0, -1):
        size[up[i]] += size[i]
        article[up[i]] += article[i]
    count = article if article[0] else size
    largest = [0] * n  # of the marked elements inside
    for i in range(n - 1, 0, -1):
        largest[up[i]] = max(largest[up[i]], largest[i], count[i] if marked[i] else 0)
    for i, x in enumerate(order):
        if not (never[i] or x.named == "layout") or (x.tag in ("article", "main") and not (never[i] and i > 0 and inside[up[i]])):
            continue
        if 2 * (largest[i] if never[i] else count[i]) <= count[0]:
            x.by_name = True
            x.drop = x.drop or x.named == "comments"


def _level(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _walk(top: _Node) -> tuple[list, str]:
    """The page's blocks in order, (text, the elements around it), and its heading; without recursion."""
    blocks: list = []
    run: list[str] = []
    heading: list[str] = []
    path: list[_Node] = []
    state = [(top, 0)]

    def flush():
        text = _level(run)
        run.clear()
        if text:
            blocks.append((text, path[:]))

    while state:
        node, at = state.pop()
        if at == 0:
            if not node.tag or node.tag in BLOCK or node.tag in LANDMARK or node.drop or node.by_name:
                flush()
            path.append(node)
        if at < len(node.parts):
            state.append((node, at + 1))
            part = node.parts[at]
            if isinstance(part, str):
                if not any(n.tag in UNSEEN for n in path[-3:]):
                    run.append(part)
                if node.tag in ("h1", "title") or any(n.tag == "h1" for n in path[-3:]):
                    heading.append(part)
            elif part.tag not in UNSEEN or part.tag in ("head", "title"):
                state.append((part, 0))
            continue
        if not node.tag or node.tag in BLOCK or node.tag in LANDMARK or node.drop or node.by_name:
            flush()
        path.pop()
    return blocks, _level(heading)


def _marked(order: list[_Node]) -> list[int]:
    return [i for i, x in enumerate(order) if x.main and x.named not in ("never", "comments", "layout")]


def _main(order: list[_Node], up: list[int], wanted: list) -> set[int]:
    """The numbers of the elements around, of and in the page's main part, whose shapes say nothing of the template."""
    marked = _marked(order)
    if not marked:
        size = [0] * len(order)
        for text, path in wanted:
            size[path[-1].number] += len(text)
        for i in range(len(order) - 1, 0, -1):
            size[up[i]] += size[i]
        marked = [max((i for i, x in enumerate(order) if 2 * size[i] >= size[0] and x.tag not in LEAF), default=0)]  # the last by levels lies deepest
    out = set(marked)
    for i in range(1, len(order)):
        if up[i] in out:
            out.add(i)
    for i in marked:
        while i > 0:
            i = up[i]
            out.add(i)
    return out


def analyse(html: str | None) -> tuple[list[str], list[int], list[int], list[int], list[int], list[int], int]:
    """A page's texts, the number of the element that each lies in, whether it goes (0: no, 1: by its element, 2: by names, where they count), the
    elements' parents, digests of their texts and of their shapes (0: none), and the digest of the heading."""
    if not html:
        return [], [], [], [], [], [], 0
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _settle(tree.top)
    order, up = _levels(tree.top)
    for i, x in enumerate(order):
        x.number = i
    blocks, heading = _walk(tree.top)
    left = [b for b in blocks if not any(n.drop for n in b[1])]
    wanted = [b for b in left if not any(n.by_name for n in b[1])]
    article = any(any(n.main for n in b[1]) for b in wanted)
    chosen = [b for b in wanted if not article or any(n.main or n.tag == "h1" for n in b[1])]
    left_, plain = {id(b) for b in left}, {id(b) for b in chosen}
    main, marked = _main(order, up, chosen), bool(_marked(order))
    free = [0] * len(order)  # unlinked words
    linked = [False] * len(order)
    for i, x in enumerate(order):
        linked[i] = x.tag == "a" or (i > 0 and linked[up[i]])
        if not linked[i]:
            free[i] = sum(len(p.split()) for p in x.parts if isinstance(p, str))
    for i in range(len(order) - 1, -1, -1):
        x = order[i]
        x.text = _digest(x.tag + "\x00" + "\x01".join(" ".join(p.lower().split()) if isinstance(p, str) else str(p.text) for p in x.parts))
        shapes = [p.shape for p in x.parts if not isinstance(p, str)]
        x.shape = _digest(f"{x.tag} {x.label}\x00" + ",".join(str(h) for j, h in enumerate(shapes) if not j or h != shapes[j - 1]))
        if i:
            free[up[i]] += free[i]
    heads = [False] * len(order)
    for i in range(len(order) - 1, 0, -1):
        heads[i] |= order[i].tag == "h1"
        heads[up[i]] |= heads[i]

    def prose(i: int, x: _Node) -> bool:
        if x.named in ("never", "comments", "layout") or x.tag in LANDMARK or (marked and x.tag != "p"):
            return False
        return free[i] >= (1 if x.tag in FILLED else PROSE)

    shapes = [x.shape if i not in main and not heads[i] and (x.label or x.tag in LANDMARK) and not prose(i, x) else 0 for i, x in enumerate(order)]
    texts = [x.text if x.tag in COUNTED else 0 for x in order]
    out = [b[0] for b in chosen]
    goes = [0 if id(b) in plain else 2 if id(b) in left_ else 1 for b in blocks]
    return [b[0] for b in blocks], [b[1][-1].number for b in blocks], goes, up, texts, shapes, _digest(heading or "\n".join(out))


def parse(html: str | None) -> tuple[list[tuple[str, int]], int]:
    """The blocks (text, element) that names alone leave of a page, as on a host too small to count, and the digest of its heading."""
    texts, at, named, _, _, _, head = analyse(html)
    return [(t, i) for t, i, n in zip(texts, at, named) if n == 0], head


def _parse(batches):
    ints = pa.list_(pa.int64())
    for part in vec.slices(batches, "html"):
        rows = list(zip(*map(analyse, part.column(2).to_pylist())))
        kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), ints, ints, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(rows, kinds))], ["page_id", "url", *_PARTS])


_PARTS = ("blocks", "at", "named", "up", "texts", "shapes", "head")
_TYPES = "blocks array<string>, at array<int>, named array<int>, up array<int>, texts array<long>, shapes array<long>, head long"


def _deleted(batch: pa.RecordBatch, gone, by_name) -> pa.RecordBatch:
    """Rows (page_id, url, the parts) to (page_id, url, text), given what is template on each page and whether names count."""
    out = []
    for (blocks, at, named, up, texts, shapes), own, names in zip(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _PARTS[:-1])), gone, by_name):
        dead = [False] * len(up)
        for i, parent in enumerate(up):
            dead[i] = texts[i] in own or shapes[i] in own or (parent >= 0 and dead[parent])
        out.append("\n".join(t for t, i, n in zip(blocks, at, named) if not dead[i] and n != 1 and not (n and names)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


#: Pages that are worked on at once.
ROWS = 64


def _delete_known(gone: dict[int, frozenset], counted: frozenset, names: bool):
    """With the digests of all hosts at hand."""
    none = frozenset()

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                hosts = b.column(b.schema.get_field_index("host")).to_pylist()
                yield _deleted(b, [gone.get(h, none) for h in hosts], [names and h not in counted for h in hosts])

    return run


def _delete_joined(names: bool):
    """With each page's own digests in its row."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                yield _deleted(b, [set(g or ()) for g in b.column(b.schema.get_field_index("gone")).to_pylist()], [names and not c for c in b.column(b.schema.get_field_index("counted")).to_pylist()])

    return run


def _different(parsed: DataFrame, template_pages: int) -> DataFrame:
    """``parsed`` with head told apart by the text on pages whose heading most texts of their host share.

    Copies of an article, edited ones too, have next to no text of their own and keep their heading.
    """
    parsed = parsed.withColumn("body", F.xxhash64("blocks"))
    bodies = parsed.groupBy("host", "head").agg(F.count_distinct("body").alias("n"))
    every = bodies.groupBy("host").agg(F.sum("n").alias("every"))
    # a row a host at most, stored so that the planner sees how few
    common = stored(bodies.where(F.col("n") >= template_pages).join(every, "host").where("2 * n > every").select("host", "head"), "headings")
    if common.isEmpty():
        return parsed.drop("body")
    block = parsed.join(common, ["host", "head"]).select("host", "head", "body", F.explode(F.array_distinct("blocks")).alias("b"))
    block = block.select("host", "head", "body", F.xxhash64("b").alias("b"), F.length("b").alias("long")).distinct()
    few = block.groupBy("host", "head", "b").agg(F.count("*").alias("n")).where(F.col("n") < template_pages).select("host", "head", "b", F.lit(1).alias("few"))
    share = block.join(few, ["host", "head", "b"], "left").groupBy("host", "head", "body").agg(F.sum(F.coalesce(F.col("few") * F.col("long"), F.lit(0))).alias("own"), F.sum("long").alias("all"))
    own = stored(share.where(F.col("own") >= OWN_SHARE * F.col("all")).select("host", "head", "body", F.lit(True).alias("apart")), "different")
    out = parsed.join(own, ["host", "head", "body"], "left")
    return out.withColumn("head", F.when(F.col("apart"), F.col("body")).otherwise(F.col("head"))).drop("body", "apart")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template_pages: int = TEMPLATE_PAGES, template_share: float = TEMPLATE_SHARE, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page; without ``names`` they count on no host."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = rows.mapInArrow(_parse, f"page_id {kind}, url string, {_TYPES}").withColumn("row", F.monotonically_increasing_id())
    parsed = stored(parsed, "pages")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("\x00"))
    parsed = parsed.withColumn("host", host)
    own = F.transform(F.filter(F.arrays_zip("blocks", "named"), lambda b: b["named"] == 0), lambda b: b["blocks"])
    told = _different(parsed.withColumn("blocks", own), template_pages).withColumn("host", F.xxhash64("host"))
    digests = F.concat(*(F.transform(F.array_distinct(c), lambda d: F.struct(d.alias("digest"), F.lit(c == "shapes").alias("shape"))) for c in ("texts", "shapes")))
    seen = told.select("host", "head", F.explode(digests).alias("x")).select("host", "head", "x.*").where("digest <> 0").withColumn("key", F.xxhash64("host", "digest"))
    # by pages first, which leaves few digests; then by different pages
    often = stored(seen.groupBy("key").count().where(F.col("count") >= template_pages).select("key"), "often")
    counted = seen.join(often, "key").select("host", "digest", "shape", "head").distinct().groupBy("host", "digest", "shape").agg(F.count("*").alias("pages"))
    total = stored(told.groupBy("host").agg(F.count_distinct("head").alias("all")), "hosts")
    template = counted.where(F.col("pages") >= template_pages).join(total, "host").where(F.col("shape") | (F.col("pages") >= template_share * F.col("all")))
    template = stored(template.select("host", "digest").distinct(), "template")
    large = total.where(F.col("all") >= COUNTED_PAGES).select("host")
    pages_ = parsed.withColumn("host", F.xxhash64("host"))
    schema = f"page_id {kind}, url string, text string"
    if template.count() + large.count() <= BROADCAST_DIGESTS:
        gone: dict[int, set] = {}
        for r in template.collect():  # at most BROADCAST_DIGESTS, like the hosts
            gone.setdefault(r["host"], set()).add(r["digest"])
        out = pages_.select("page_id", "url", "host", *_PARTS[:-1]).mapInArrow(_delete_known({h: frozenset(d) for h, d in gone.items()}, frozenset(r["host"] for r in large.collect()), names), schema)
    else:  # each page gets its own digests that are template
        of = pages_.select("row", "host", F.explode(F.array_distinct(F.concat("texts", "shapes"))).alias("digest")).where("digest <> 0")
        of = of.join(template, ["host", "digest"]).groupBy("row").agg(F.collect_list("digest").alias("gone"))
        verdicts = pages_.select("row", "host").join(large.withColumn("counted", F.lit(True)), "host", "left").drop("host").join(of, "row", "left")
        joined = pages_.join(verdicts, "row").withColumn("counted", F.coalesce("counted", F.lit(False)))
        out = joined.select("page_id", "url", *_PARTS[:-1], "gone", "counted").mapInArrow(_delete_joined(names), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
