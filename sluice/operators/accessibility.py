"""What keeps readers out of web pages: elements by a small walk of each page, rules by Spark over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut

# Weights, words that say nothing, and the elements that rules look at.
WEIGHTS = {"critical": 10, "serious": 6, "moderate": 3, "minor": 1}
VAGUE_LINKS = ("click here", "here", "read more", "more", "link", "this", "learn more")
VAGUE_PICTURES = ("image", "photo", "picture", "img")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NAMED = ("a", "button", *HEADINGS)
CONTROLS = ("input", "select", "textarea")
LOOKED_AT = frozenset((*NAMED, *CONTROLS, "html", "title", "meta", "img", "label"))
OPERABLE = ("button", "a", "input", "select", "textarea", "form")
#: Elements that a task hands on at a time, and those of one more page.
ELEMENTS = 2000
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


class _Walk(HTMLParser):
    """Elements in the order in which they end; text belongs to the innermost open link, button or heading."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[list] = []
        self.feed(_HUGE.sub("�", page))
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in LOOKED_AT or "tabindex" in own or any(k.startswith("on") for k in own):
            element = [tag, own, ""]
            (self.open if tag in NAMED else self.found).append(element)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1][2] += data

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[-1][0] == tag:
            self.found.append(self.open.pop())


def elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``page, row, place, tag, attributes, text`` of the elements that rules look at.

    ``row`` tells rows of one id apart. Links, buttons and headings that are never closed are not
    among them. A page without elements still has one row, of a null tag. Null pages are empty.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=["page", "row", "place", "tag", "attributes", "text"])
        for part in parts:
            rows = []
            for page, row, html in zip(part["page"], part["row"], part["html"]):
                rows += [(page, row, i, *e) for i, e in enumerate(_Walk(html or "").found)] or [(page, row, 0, None, {}, None)]
                if len(rows) >= ELEMENTS:
                    yield made(rows)
                    rows = []
            yield made(rows)

    own = pages.select(F.col(id_col).alias("page"), F.xxhash64(html_col).alias("row"), F.col(html_col).alias("html"))
    return own.mapInPandas(walk, f"page {kind}, row long, place int, tag string, attributes map<string,string>, text string")


def _has(name: str) -> Column:
    return F.coalesce(F.try_element_at("attributes", F.lit(name)) != "", F.lit(False))


def findings(found: DataFrame) -> DataFrame:
    """``page, row, place, rule, severity, criterion`` of all faults of :func:`elements`; place is null for faults of the page.

    Repeated rows of one page are one page here.
    """
    each = found.dropDuplicates(["page", "row", "place"])
    value = lambda name: F.try_element_at("attributes", F.lit(name))
    text = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    level = F.when(F.col("tag").isin(*HEADINGS), F.substring("tag", 2, 1).cast("int"))
    before = F.last(level, ignorenulls=True).over(Window.partitionBy("page", "row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    labels = F.collect_set(F.when(F.col("tag") == "label", value("for"))).over(Window.partitionBy("page", "row"))
    whole = each.withColumns({"level": level, "before": before, "labels": labels})
    fault = lambda when, rule, severity, criterion: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(criterion).alias("criterion")))
    tag = F.col("tag")
    step = F.try_to_number(F.regexp_extract(value("tabindex"), r"^\++(\d{1,9})$|^(\d{1,9})$", 0), F.lit("S999999999"))
    own = F.array(
        fault((tag == "img") & ~F.map_contains_key("attributes", "alt"), "img-alt", "critical", "1.1.1"),
        fault((tag == "img") & F.lower(F.trim(value("alt"))).isin(*VAGUE_PICTURES), "img-alt-vague", "moderate", "1.1.1"),
        fault((tag == "a") & (text == "") & ~_has("aria-label"), "link-name", "critical", "2.4.4"),
        fault((tag == "a") & text.isin(*VAGUE_LINKS), "link-vague", "moderate", "2.4.4"),
        fault((tag == "button") & (text == "") & ~_has("aria-label"), "button-name", "critical", "4.1.2"),
        fault(tag.isin(*CONTROLS) & ~F.coalesce(value("type").isin("hidden", "submit", "button"), F.lit(False)) & ~F.coalesce(F.array_contains("labels", value("id")), F.lit(False)) & ~_has("aria-label") & ~_has("aria-labelledby"), "input-label", "critical", "3.3.2"),
        fault(F.col("level") > F.col("before") + 1, "heading-skip", "moderate", "1.3.1"),
        fault(step > 0, "tabindex", "serious", "2.4.3"),
        fault(F.exists(F.map_keys("attributes"), lambda k: k.startswith("on")) & ~tag.isin(*OPERABLE), "click-div", "serious", "2.1.1"),
    )
    each_fault = whole.select("page", "row", "place", F.explode(F.array_compact(own)).alias("f")).select("page", "row", "place", "f.*")
    seen = whole.groupBy("page", "row").agg(
        F.count_if((tag == "html") & (F.trim(value("lang")) != "")).alias("lang"), F.count_if(tag == "title").alias("title"), F.count_if((tag == "meta") & (F.lower(value("name")) == "viewport")).alias("viewport"),
        F.count("level").alias("headings"), F.count_if(F.col("level") == 1).alias("h1"),
    )
    of_page = F.array(
        fault(F.col("lang") == 0, "html-lang", "serious", "3.1.1"), fault(F.col("title") == 0, "page-title", "serious", "2.4.2"), fault(F.col("viewport") == 0, "viewport", "moderate", "1.4.10"),
        fault((F.col("h1") == 0) & (F.col("headings") > 0), "no-h1", "moderate", "1.3.1"), fault(F.col("h1") > 1, "multi-h1", "minor", "1.3.1"),
    )
    return each_fault.unionByName(seen.select("page", "row", F.lit(None).cast("int").alias("place"), F.explode(F.array_compact(of_page)).alias("f")).select("page", "row", "place", "f.*"))


def grades(found: DataFrame) -> DataFrame:
    """``page, row, faults, score, grade`` of every page of :func:`elements`: 100 less the weights of its faults, 0 at least.

    Pages are walked once: their elements are kept, as three aggregations read them.
    """
    found = cut(found)
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in WEIGHTS.items()])
    lost = findings(found).groupBy("page", "row").agg(F.count("*").alias("faults"), F.sum(weight).alias("lost"))
    pages = found.select("page", "row").distinct()
    own = pages.join(lost, pages["page"].eqNullSafe(lost["page"]) & (pages["row"] == lost["row"]), "left").select(pages["page"], pages["row"], F.coalesce("faults", F.lit(0)).alias("faults"), F.greatest(100 - F.coalesce("lost", F.lit(0)), F.lit(0)).alias("score"))
    score = F.col("score")
    return own.withColumn("grade", F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F"))
