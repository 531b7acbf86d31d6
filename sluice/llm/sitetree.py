"""Main text by site style trees.

Pages of one host are merged into a tree of styles: a node is a path of tags with their classes and
ids, and it gathers on how many distinct pages it occurs, how often each content stands there, which
child styles it shows and how many words it holds. The importance of a node is the entropy of its
contents over its pages (1: every page has its own, 0: the same everywhere), blended with the entropy
of the presentations its children show.

The tree holds every branch that is shown, inside and outside of ``article`` and ``main``, and decides
over it. A branch of low importance is taken out of each page of the host, unless it holds so many of
the host's words that it can't be furniture. So is a container beside the bulk of the host that always
shows the same child styles and has little of the host's words, though these be other ones on each
page: a menu, an advert. What a page's own markup says is a prior: elements whose tag, role or state
means menus, footers, sidebars, forms, scripts and the like go; names that suggest furniture, and
standing outside of a marked article, count against a branch until it is seen to be important and to
hold the bulk of the words, of its host or, where that has fewer distinct pages than say anything, of
its page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut
from sluice.llm.common import few, labelled, texts

#: A node must stand on so many pages of its host before its content says anything.
LEAST_PAGES = 4
#: Nodes of lower importance go.
LEAST_IMPORTANCE = 0.35
#: Share of the content's entropy in a node's importance; presentations have the rest.
CONTENT_SHARE = 0.8
#: A branch with this share of its host's words is never of low importance, and overrules names and a
#: place outside of the marked article if it is important.
BULK_SHARE = 0.5
#: A container with less than this share of its host's words and less than this entropy of its child styles is furniture.
SMALL_SHARE, FIXED_SHAPE = 0.05, 0.15
#: So many verdicts on all branches together are broadcast; more are joined to their pages.
BROADCAST_ROWS = 400_000
#: Paths that a worker remembers before it starts anew.
MEMORY = 200_000

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math object select".split())
UNSEEN = frozenset("head script style noscript template iframe svg math object canvas audio video xmp datalist".split())
SKIPPED = frozenset("head script style noscript template iframe svg math object select textarea button nav footer aside form dialog menu canvas audio video xmp option datalist label fieldset input".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion breadcrumb breadcrumbs "
    "comment comments commentlist respond disqus consent cookie cookies gdpr footer header masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification alert overlay pager pagination popup related recommended share sharing sidebar sidebars social "
    "subscribe subscription toolbar topbar widget widgets login signup search copyright legal disclaimer skip tags toc".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: What may hold much of its own and little of a page: not headings, nor paragraphs and what stands in them.
CONTAINERS = frozenset("div section ul ol menu nav aside footer header form table dl center details dialog".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_SIGN = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
_LEADING_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_NO_CHARACTER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
MAIN = frozenset(("article", "main"))
LOW, BULK, SMALL = 1, 2, 4
_MASK = (1 << 63) - 1


class Node:
    """An open element: the hash of its path, whether the prior is for or against it, and the verdict."""

    __slots__ = ("tag", "path", "parent", "unseen", "skipped", "main", "out", "bulk")

    def __init__(self, tag: str, path: int, parent: int, unseen: bool, skipped: bool, main: bool, out: bool, bulk: bool):
        self.tag, self.path, self.parent, self.unseen, self.skipped, self.main, self.out, self.bulk = tag, path, parent, unseen, skipped, main, out, bulk


class _Ends:
    """Where tags end, by forward scans of one page; what isn't there from some place on is looked for once."""

    def __init__(self, page: str):
        self.page, self.missing, self.quotes = page, {}, True

    def find(self, sign: str, at: int) -> int:
        if at >= self.missing.get(sign, len(self.page)):
            return -1
        found = self.page.find(sign, at)
        if found < 0:
            self.missing[sign] = at
        return found

    def tag(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``; 0 if it has none.

        A ``>`` in quotes is part of a value. Once a tag doesn't end that way, quotes mean nothing in
        the rest of the page.
        """
        place = at
        while self.quotes:
            m = _TAG_SIGN.search(self.page, place)
            if m is not None and m[0] == ">":
                return m.end()
            place = 0 if m is None else self.find(m[0], m.end()) + 1
            if not place:
                self.quotes = False
        return self.find(">", at) + 1


def unescape(text: str) -> str:
    """Character references of HTML; a number beyond Unicode, however long, is U+FFFD."""
    if "&#" in text:
        text = _NO_CHARACTER.sub("\ufffd", _LEADING_ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


_paths: dict[tuple[int, str], int] = {}


def path_hash(parent: int, style: str) -> int:
    found = _paths.get((parent, style))
    if found is None:
        if len(_paths) > MEMORY:
            _paths.clear()
        found = _paths[parent, style] = xxhash.xxh64_intdigest(style.encode("utf-8", "replace"), parent) & _MASK
    return found


def _names(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}


def _style(tag: str, names: str) -> str:
    """Tag and names; numbers in them are alike, so that ``post-17`` and ``post-18`` are one style. A body has no names: they are the page's."""
    return tag if tag in ("html", "body") else ".".join([tag, *sorted({_DIGITS.sub("#", n) for n in names.split()})])


def _open(tag: str, attributes: str, above: Node, verdicts: dict[int, int], prior: bool) -> Node:
    style, unseen, skipped, named = tag, tag in UNSEEN, tag in SKIPPED, False
    main = above.main or tag in MAIN
    if attributes.strip():
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        names = unescape(f"{found.get('class', '')} {found.get('id', '')}")
        if names.strip():
            style = _style(tag, names)
            named = tag not in ("html", "body", "article", "main") and bool(_names(names) & NOISE_WORDS)
        role = found.get("role", "").lower()
        unseen = unseen or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
        skipped = skipped or unseen or role in NOISE_ROLES
        if role == "main":
            main, style = True, style + "|main"
    # A header inside an article heads the article; one outside heads the page.
    skipped = skipped or (tag == "header" and not above.main)
    path = path_hash(above.path, style)
    verdict = verdicts.get(path, 0)
    against = unseen or (prior and (skipped or (named and not verdict & BULK)))
    out = above.out or against or verdict & LOW > 0 or (verdict & SMALL > 0 and not main and not above.bulk)
    return Node(tag, path, above.path, above.unseen or unseen, above.skipped or skipped, main, out, above.bulk or verdict & BULK > 0)


def walk(page: str, root: int = 0, verdicts: dict[int, int] | None = None, prior: bool = True) -> Iterator[tuple[str | None, Node | None]]:
    """Text runs with their element, ``("", node)`` where an element begins, and ``(None, None)`` wherever a block begins or ends.

    Broken markup is read as browsers do in the main: list items, cells and paragraphs close one
    another, an end tag without its start is ignored, everything is closed at the end, a comment
    that never ends hides the rest. A ``<`` after which no tag ends is text. Time and memory are in
    proportion to the page, however deep its elements are and whatever is left open.
    """
    verdicts = verdicts or {}
    bottom = Node("", root, root, False, False, False, False, False)
    stack: list[Node] = [bottom]
    standing: dict[str, list[int]] = {}
    ends = _Ends(page)
    at = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            standing[stack.pop().tag].pop()

    def top(tags: set[str]) -> int:
        return max((standing[t][-1] for t in tags if standing.get(t)), default=0)

    while at < len(page):
        if page[at] != "<":
            start, at = at, page.find("<", at)
            at = at if at >= 0 else len(page)
            yield unescape(page[start:at]), stack[-1]
            continue
        if page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)
            at = end.end() if end else len(page)
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            yield page[at + 9 : end if end >= 0 else len(page)], stack[-1]
            at = end + 3 if end >= 0 else len(page)
            continue
        close = ends.find(">", at)
        m = _TAG.match(page, at) if close >= 0 else None
        end = ends.tag(m.end()) if m else 0
        if not end:
            if m is None and close >= 0 and page[at + 1 : at + 2] in ("!", "?", "/"):
                at = close + 1
            else:
                yield "<", stack[-1]
                at += 1
            continue
        tag, attributes, at = m[2].lower(), page[m.end() : end - 1], end
        if m[1]:
            if standing.get(tag):
                pop_to(standing[tag][-1])
            elif tag == "p":
                yield None, None
            if tag in BLOCKS:
                yield None, None
            continue
        if tag in BLOCKS:
            yield None, None
            if tag != "br" and standing.get("p"):
                pop_to(standing["p"][-1])
        if tag in CLOSES:
            same, within = map(top, CLOSES[tag])
            if same > within:
                pop_to(same)
        if tag in VOID:
            continue
        if tag in RAW and tag not in ("svg", "math", "object", "select"):
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        if not attributes.endswith("/") or tag in BLOCKS:
            node = _open(tag, attributes, stack[-1], verdicts, prior)
            standing.setdefault(tag, []).append(len(stack))
            stack.append(node)
            yield "", node


def blocks(page: str, root: int = 0, verdicts: dict[int, int] | None = None, prior: bool = True) -> list[str]:
    """The page's kept blocks in order under the host's verdicts on its branches.

    Without ``prior`` the tree alone decides: tags, roles, names and marked articles mean nothing.
    """
    kept: list[tuple[str, bool]] = []
    run: list[str] = []
    inside = marked = False

    def close() -> None:
        nonlocal run
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            kept.append((text, inside))
        run = []

    for data, node in walk(page, root, verdicts, prior):
        if data is None:
            close()
            inside = False
        elif not data:
            marked = marked or (node.main and not node.skipped)
        elif not node.out:
            inside = inside or node.main or node.bulk
            run.append(data)
    close()
    # Where a page marks its article, standing outside counts against a text, unless it is in the bulk of its host.
    return [t for t, m in kept if m or not (marked and prior)] or [t for t, _ in kept]


def extract(page: str, root: int = 0, verdicts: dict[int, int] | None = None, prior: bool = True) -> str:
    """The page's main text; where nothing is known of its host, the innermost branch with half of the page's words is its bulk."""
    known = verdicts or {}
    if prior and root not in known:
        rows = style_nodes(page, root)
        if root in rows and not any(p in known for p in rows):
            bulky = {p for p, r in rows.items() if p != root and 2 * r[3] >= rows[root][3] > 0}
            known = {p: BULK for p in bulky - {rows[p][0] for p in bulky}}
    return " ".join(blocks(page, root, known, prior))


def style_nodes(page: str, root: int = 0) -> dict[int, list]:
    """``path: [parent, content, shape, words, container]`` of a page's style paths, the root's words last.

    Content is the sum of the hashes of all texts below a path, whatever their order; the shape is
    that of its distinct child styles and of its own text. Words of an article count for paths
    inside of it, not for those around it. Branches that aren't shown are not in it. A fifth number
    is 1 for containers outside of an article.
    """
    found: dict[int, list] = {root: [root, 0, 0, 0, 0]}
    inner: dict[int, bool] = {root: False}
    for data, node in walk(page, root):
        if data is None or node.unseen:
            continue
        row = found.get(node.path)
        if row is None:
            row = found[node.path] = [node.parent, 0, 0, 0, int(node.tag in CONTAINERS and not node.main)]
            inner[node.path] = node.main
        text = _SPACE.sub(" ", data).strip()
        if text:
            row[1] += xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            row[2] |= 1
            row[3] += text.count(" ") + 1
    everything = sum(r[3] for r in found.values())
    # A path comes after its parent, so going backwards every child is whole before it is added.
    for path in reversed(found):
        parent, content, shape, words, _ = found[path]
        above = found[parent] if path != root else None
        if above is None:
            continue
        if content:
            above[1] += xxhash.xxh64_intdigest((content & (2**64 - 1)).to_bytes(8, "little"), path)
            above[2] += xxhash.xxh64_intdigest(path.to_bytes(8, "little"), 2) & ~1
        if inner[path] == inner[parent]:
            above[3] += words
    found = {p: [r[0], r[1] & _MASK, r[2] & _MASK, *r[3:]] for p, r in found.items() if r[1]}
    if root in found:
        found[root][3] = everything
    return found


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def root_of(url: F.Column) -> F.Column:
    """The root of a host's tree: a hash of its name."""
    return F.xxhash64(host_of(url)).bitwiseAND(_MASK)


def page_styles(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``root, page, path, parent, content, shape, words, container``: the style nodes of every distinct page of a host.

    Pages of a host with the same source are one page, so copies have no weight of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, names = batch.column(0).to_pylist(), batch.column(1)
            for start, part in texts(batch.column(2)):
                rows: list[tuple] = []
                page_at: list[int] = []
                for i, page in enumerate(part, start):
                    nodes = style_nodes(page.decode("utf-8", "replace"), roots[i])
                    rows += [(roots[i], path, *row) for path, row in nodes.items()]
                    page_at += [i] * len(nodes)
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
                yield pa.record_batch([columns[0], names.take(pa.array(page_at, pa.int64())), *columns[1:]], ["root", "page", "path", "parent", "content", "shape", "words", "container"])

    made = pages.select(root_of(F.col(url_col)).alias("root"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    return made.mapInArrow(run, "root long, page long, path long, parent long, content long, shape long, words long, container long").dropDuplicates(["root", "path", "page"])


def verdicts(styles: DataFrame) -> DataFrame:
    """``path, verdict``: the branches of low importance (1), those that are important and hold the bulk of their host's words (2), and small containers of fixed presentation on hosts that have such a bulk (4).

    Contents and shapes are counted by value before entropies are taken, so no host goes to one task.
    Of bulky branches within one another the innermost counts.
    """
    each = styles.select("root", "path", "parent", "container", F.expr("stack(2, 0, content, words, 1, shape, 0L) as (kind, value, words)"))
    seen = each.groupBy("root", "path", "parent", "kind", "value").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("container").alias("container"))
    nlogn = F.col("n") * F.log("n")
    node = seen.groupBy("root", "path", "parent").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, nlogn)).alias("content"),
        F.sum(F.when(F.col("kind") == 1, nlogn)).alias("shape"),
        F.sum("words").alias("words"),
        F.max("container").alias("container"),
    )
    node = cut(node.where(F.col("pages") >= LEAST_PAGES))
    entropy = lambda c: 1 - F.col(c) / (F.col("pages") * F.log("pages"))
    hosts = node.where("path = root").select("root", F.col("words").alias("all_words"))
    rated = node.where("path <> root").join(hosts, "root").select(
        "root", "path", "parent", "container", entropy("shape").alias("shape"), (CONTENT_SHARE * entropy("content") + (1 - CONTENT_SHARE) * entropy("shape")).alias("importance"), (F.col("words") / F.greatest("all_words", F.lit(1))).alias("share")
    )
    low = (F.col("importance") < LEAST_IMPORTANCE) & (F.col("share") < BULK_SHARE)
    bulky = rated.where((F.col("importance") >= LEAST_IMPORTANCE) & (F.col("share") >= BULK_SHARE))
    innermost = cut(bulky.join(bulky.select(F.col("parent").alias("path")).distinct(), "path", "left_anti").select("root", "path"))
    small = rated.where((F.col("importance") >= LEAST_IMPORTANCE) & (F.col("container") == 1) & (F.col("share") < SMALL_SHARE) & (F.col("shape") < FIXED_SHAPE)).join(few(innermost.select("root").distinct()), "root", "left_semi")
    known = hosts.select(F.col("root").alias("path"), F.lit(BULK).alias("verdict"))
    return (
        rated.where(low).select("path", F.lit(LOW).alias("verdict"))
        .union(innermost.select("path", F.lit(BULK).alias("verdict")))
        .union(small.select("path", F.lit(SMALL).alias("verdict")))
        .union(known)
    )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Null and empty pages give an empty text. Pages without a host form one host of their own.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    styles = cut(page_styles(pages, url_col, html_col))
    decided = cut(verdicts(styles))
    kind = pages.schema[id_col].dataType.simpleString()
    page = F.xxhash64(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), root_of(F.col(url_col)).alias("root"), page.alias("page"))
    if decided.limit(broadcast_rows + 1).count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast({r["path"]: r["verdict"] for r in decided.collect()})
        rows = rows.select("page_id", "url", "html", "root")
    else:
        shared = None
        # Each distinct page gets the verdicts on its own paths, which its source bounds.
        own = labelled(styles.select("root", "page", "path"), decided, "path").where("verdict is not null").groupBy(F.struct("root", "page").alias("source")).agg(F.map_from_entries(F.collect_list(F.struct("path", "verdict"))).alias("own"))
        rows = labelled(rows.withColumn("source", F.struct("root", "page")), own, "source").select("page_id", "url", "html", "root", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = batch.column(3).to_pylist()
            for start, part in texts(batch.column(2)):
                found = []
                for i, p in enumerate(part, start):
                    known = shared.value if shared is not None else dict(batch.column(4)[i].as_py() or ())
                    found.append(extract(p.decode("utf-8", "replace"), roots[i], known))
                yield pa.record_batch([batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
