import collections
import math
import random
import time
import tracemalloc

import pytest

from sluice.llm import sitetree

ARTICLE = "<article><header><h1>Title</h1></header><p>One &amp; two<p>Three <b>bo</b>ld\n\n &lt;x&gt;</p><form>Name</form><section class='comments'><p>nice!</p></section></article>"
PAGE = f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav>menu</nav><div class=\"cookie-notice\">We use</div><main>{ARTICLE}<aside>side</aside></main><div id=sidebar>s</div><div class=ad>buy</div><footer>f</footer><script>var a=\"</p>\";</script></body></html>"


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Title One & two Three bold <x>"),
    ("", ""),
    ("plain", "plain"),
    ("<div>a<div>b</div>c</div> < 5 & x <p>q", "a b c < 5 & x q"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>e<br>f</article>", "a b c d e f"),
    ("<body><p>x</p><!-- y --><script>z", "x"),
    ("<article>caf&eacute; &#8364;</article>", "café €"),
])
def test_main_text(page, text):
    assert sitetree.extract(page) == text


def site(n):
    return [(i, f"http://h.example/{i}", f"<html><body><div class='top'>Welcome to our site</div><div class='body'><p>Story number {i} with words {i * i}</p></div><div class='end'><p>All rights {'old' if i % 9 == 0 else 'new'}</p></div></body></html>") for i in range(n)]


def test_branches_alike_on_all_pages_go(spark):
    df = spark.createDataFrame(site(20), "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in sitetree.extract_pages(df).collect()}
    assert out == {i: f"Story number {i} with words {i * i}" for i in range(20)}
    salted = sitetree.extract_pages(df, broadcast_rows=0)
    assert out == {r["page_id"]: r["text"] for r in salted.collect()}


def entropy(values):
    counts = collections.Counter(values).values()
    return -sum(n / len(values) * math.log(n / len(values)) for n in counts) / math.log(len(values))


class Element:
    """An element of a made page: its name, and texts and elements in order."""

    def __init__(self, name, parts):
        self.name, self.parts = name, parts

    def source(self):
        tag, _, names = self.name.partition(".")
        return f"<{tag} class='{names}'>" + "".join(p if isinstance(p, str) else p.source() for p in self.parts) + f"</{tag}>"


def made_host(rng, pages):
    """Pages from one template whose leaves say the same everywhere, one of few things, or something of their own."""
    def template(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["same", "few", "own", "own long"])
        return children(depth)

    def children(depth):
        return [(f"{rng.choice(['div', 'section'])}.{rng.choice('abcd')}x", template(depth - 1)) for _ in range(rng.randint(1, 4))]

    def fill(name, inside):
        if isinstance(inside, str):
            n = {"same": sum(map(ord, name)), "few": rng.randrange(2)}.get(inside, rng.randrange(10**6))
            return Element(name, [f"w{n} x{n}" + " more of it" * (4 if inside == "own long" else 0)])
        return Element(name, [fill(n, i) for n, i in inside if rng.random() < 0.95])

    inside = children(3)
    return [fill("body", inside) for _ in range(pages)]


def by_hand(pages):
    """Texts under the verdicts of a tree of dictionaries on the distinct pages."""
    tree, words_of, total = collections.defaultdict(list), collections.defaultdict(int), 0

    def below(e, path, rows):
        own = [p for p in e.parts if isinstance(p, str)]
        texts, shape = [(path, t) for t in own], {("text",)} if own else set()
        for c in e.parts:
            if not isinstance(c, str):
                got = below(c, (*path, c.name), rows)
                texts += got
                if got:
                    shape.add(c.name)
        if texts:
            row = rows.setdefault(path, ([], set()))
            row[0].extend(texts)
            row[1].update(shape)
        return texts

    for e in {p.source(): p for p in pages}.values():
        rows = {}
        total += sum(len(t.split()) for _, t in below(e, ("body",), rows))
        for path, (texts, shape) in rows.items():
            tree[path].append((tuple(sorted(texts)), tuple(sorted(map(str, shape)))))
            words_of[path] += sum(len(t.split()) for _, t in texts)
    low, bulky, fixed = set(), set(), set()
    for path, seen in tree.items():
        if len(seen) >= 4:
            share, shape = words_of[path] / total, entropy([s for _, s in seen])
            important = 0.8 * entropy([c for c, _ in seen]) + 0.2 * shape >= 0.35
            if not important and share < 0.5:
                low.add(path)
            if important and share >= 0.5:
                bulky.add(path)
            if important and share < 0.05 and shape < 0.15:
                fixed.add(path)
    inner = bulky - {p[:-1] for p in bulky}

    def text(e, path, inside):
        if path in low or (path in fixed and inner and not inside):
            return []
        inside = inside or path in inner
        return [t for p in e.parts for t in ([p] if isinstance(p, str) else text(p, (*path, p.name), inside))]

    return [" ".join(text(e, ("body",), False)) for e in pages], len(low), len(fixed) if inner else 0


def test_verdicts_against_a_tree_by_hand(spark):
    rng, rows, want, lows, smalls = random.Random(11), [], [], 0, 0
    for h in range(14):
        pages = made_host(rng, rng.randint(3, 12))
        pages += [rng.choice(pages) for _ in range(rng.choice([0, 30]))]
        texts, n, k = by_hand(pages)
        lows, smalls = lows + n, smalls + k
        for e, t in zip(pages, texts):
            want.append(t)
            rows.append((len(rows), f"http://h{h}.example/", f"<html>{e.source()}</html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert lows > 10 and smalls > 2
    for few in (sitetree.BROADCAST_ROWS, 0):
        out = {r["page_id"]: r["text"] for r in sitetree.extract_pages(df, broadcast_rows=few).collect()}
        assert [out[i] for i in range(len(want))] == want


def test_furniture_without_a_name_and_bulk_with_a_bad_one(spark):
    """Meaningless names around and inside of the article; content beside it; an article under a name of furniture; copies and numbers in ids."""
    long = lambda i: f"story {i} " + " ".join(f"word{i}x{k}" for k in range(30))
    notice = "<div class='q7'>We changed our terms, read them</div>"
    hosts = {
        "in": lambda i: (f"<body><article><div class='k1'>{notice}<p>{long(i)}</p></div></article></body>", long(i)),
        "beside": lambda i: (f"<body><div class='zz'>Home Shop About</div><div class='yy'><p>{long(i)}</p></div><div class='xx'>All rights</div></body>", long(i)),
        "outside": lambda i: (f"<body><article><p>Teaser {i}</p></article><div class='rest'><p>{long(i)}</p></div><div class='u1'>Same for all</div></body>", f"Teaser {i} {long(i)}"),
        "name": lambda i: (f"<body><div class='post category-legal' id='post-{i}'>{long(i)}</div><div class='tags'>tag{i}</div></body>", long(i)),
        "ids": lambda i: (f"<body class='page-{i} about-{'abc'[i % 3]}'><div id='p{i}'><div class='zz'>Home Shop About</div><p>{long(i)}</p></div></body>", long(i)),
    }
    rows, want = [], {}
    for host, make in hosts.items():
        for i in range(8):
            page, text = make(i)
            for _ in range(33 if i == 0 else 1):  # four fifths of the host are copies of one page
                want[len(rows)] = text
                rows.append((len(rows), f"https://{host}.example/{i}", page))
    out = {r["page_id"]: r["text"] for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want


def test_the_tree_decides_every_page_of_the_table(spark):
    """With every branch of low importance nothing is left, in articles too."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        low = {p: sitetree.LOW for p in sitetree.style_nodes(r["html"]) if p}
        assert low and sitetree.extract(r["html"], 0, low) == "" != sitetree.extract(r["html"])


@pytest.mark.parametrize(("page", "text"), [
    ("<a " * 300_000, None),
    ("<a" * 300_000, None),
    ("</ " * 300_000, None),
    ("<! " * 300_000, None),
    ("<p>x</p><a title=\"" * 100_000, None),
    ("<a \">\"" * 200_000 + "'", None),
    ("<a '" * 300_001 + "<b>y</b>", None),
    ("<p>kept</p><!-- open " + "<p>x" * 300_000, "kept"),
    ("<!-- a" * 300_000, ""),
    ("kept <![CDATA[" * 200_000, None),
    ("<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, ""),
    ("x &#" + "9" * 300_000 + "; &#x" + "f" * 300_000 + "; &#0000065; y", "x \ufffd \ufffd A y"),
])
def test_broken_pages_take_time_in_proportion(page, text):
    began = time.perf_counter()
    found = sitetree.extract(page)
    assert time.perf_counter() - began < 10
    assert text is None or found == text


def test_time_grows_with_the_page():
    def seconds(n):
        began = time.perf_counter()
        sitetree.extract("<a " * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 40 * seconds(8_000) + 0.5


def test_what_is_left_open():
    assert sitetree.extract("<p>a</p><b title=\"x>y</b><p>c</p>") == "a y c"
    assert sitetree.extract("<p>1 < 2 <p>b <a href='x>y'>z</a> <") == "1 < 2 b z <"


def test_menu_and_advert_of_other_words_on_every_page(spark):
    """Without names or tags that tell: the tree drops what always looks the same and holds little."""
    words = lambda i, n: " ".join(f"w{i}n{k}x{n}" for k in range(n))
    rows = []
    for i in range(9):
        bulk = "".join(f"<p>{words(i, 60 + k)}</p>" + "<ul><li>one</li></ul>" * (i % 2) for k in range(3))
        menu = "<div class='qa'>" + "".join(f"<a href='/'>{words(i, 1)}</a>" for _ in range(3)) + "</div>"
        rows.append((i, f"http://a.example/{i}", f"<body>{menu}<h1>Title {i}</h1><div class='qb'>{words(i, 5)}</div><div class='qc'>{bulk}</div></body>"))
    out = {r["page_id"]: r["text"] for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert out[i].startswith(f"Title {i} w{i}n0x60") and f"w{i}n0x5 " not in out[i] and f"w{i}n0x1 " not in out[i]


def test_a_name_of_furniture_keeps_the_bulk_of_a_lone_page(spark):
    page = "<body><div class='post category-legal'>" + "long story " * 20 + "</div><div class='tags'>tag</div></body>"
    rows = [(1, "http://lone.example/", page)]
    assert sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["text"] == ("long story " * 20).strip()


def test_deep_pages_take_memory_in_proportion():
    tracemalloc.start()
    page = "<div class=a>" * 100_000 + "deep <li>" * 10
    assert sitetree.extract(page) == " ".join(["deep"] * 10) and len(sitetree.style_nodes(page)) > 100_000
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_a_single_page_and_copies_keep_their_text(spark):
    one = site(1)
    copies = [(100 + i, "http://copy.example/x", site(2)[1][2]) for i in range(6)]
    out = {r["page_id"]: r["text"] for r in sitetree.extract_pages(spark.createDataFrame(one + copies, "page_id long, url string, html string")).collect()}
    assert "Story number 0" in out[0] and all("Story number 1" in out[100 + i] for i in range(6))


def test_pages_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r for r in sitetree.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", article))).strip()
        assert out[r["page_id"]]["text"] == want and out[r["page_id"]]["n_chars"] == len(want)


def test_awkward_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>a"), (3, "http://X.example", ""), (4, "http://x.example", "<p>" + "long words " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as root", "2 as path", "3 as text")
    out = sitetree.extract_pages(df).collect()
    assert len(out) == 5 and {r["page_id"]: r["n_chars"] for r in out} == {1: 0, None: 1, 3: 0, 4: 549999}
    assert sitetree.extract_pages(df.where("false")).count() == 0
