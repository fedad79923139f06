"""HTML pages as element trees, and the matches, odds and links that are read from them.

A page becomes one array of its nodes in document order: each has its number, the number of the last node inside it, its tag (`#text`
for text), its attributes and its text, with character references decoded. Parsing is the only step in Python; what is looked for
in a tree are expressions over that array.
"""

from __future__ import annotations

import html as references
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import scalar as X

NODE = "struct<node:int,last:int,tag:string,attrs:map<string,string>,text:string>"
#: Elements that hold nothing, and those that an opening tag of the same kind ends.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDED |= {tag: {"p"} for tag in ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")}


class Tree(HTMLParser):
    """Nodes as lists of node, last, tag, attributes and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[list] = []

    def _add(self, tag: str, attrs: list[tuple[str, str]], text: str | None) -> list:
        node = [len(self.nodes), len(self.nodes), tag, attrs, text]
        self.nodes.append(node)
        return node

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            self.open.pop()[1] = len(self.nodes) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and self.open[-1][2] in ENDED.get(tag, ()):
            self._close(len(self.open) - 1)
        seen: dict[str, str] = {}
        for k, v in attrs:  # of attributes that repeat the first counts
            seen.setdefault(k, v or "")
        node = self._add(tag, list(seen.items()), None)
        if tag not in EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][2] == tag), None)
        if at is not None:
            self._close(at)

    def handle_data(self, data: str) -> None:
        self._add("#text", [], data)


def parsed(page: str | None) -> list[list]:
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    tree._close(0)
    return tree.nodes


def trees(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """keep... and tree, for each page; a null page has none. Pages are parsed in the tasks, one after the other."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                found = [[dict(zip(("node", "last", "tag", "attrs", "text"), n)) for n in parsed(p.as_py())] for p in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "tree"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, f"{kinds}tree array<{NODE}>")


def plain(markup: Column) -> Column:
    """Text without tags, character references decoded, white space made even."""
    return even(unescaped(F.regexp_replace(markup, r"<[^>]*>", "")))


def even(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescaped(text):  # noqa: ANN001, ANN201  a pandas UDF's types are read from its annotations
    """Named and numeric character references decoded."""
    return text.map(references.unescape, na_action="ignore")


def escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def inside(tree: Column, x: Column) -> Column:
    """The nodes inside a node."""
    return F.filter(tree, lambda y: (y["node"] > x["node"]) & (y["node"] <= x["last"]))


def text_of(tree: Column, x: Column) -> Column:
    """All text inside a node, white space made even."""
    return even(_raw_text(tree, x))


def _raw_text(tree: Column, x: Column) -> Column:
    return F.array_join(F.transform(F.filter(inside(tree, x), lambda y: y["tag"] == "#text"), lambda y: y["text"]), "")


def has_class(x: Column, *names: str) -> Column:
    have = F.split(F.coalesce(x["attrs"]["class"], F.lit("")), r"\s+")
    return F.forall(F.array(*(F.lit(n) for n in names)), lambda n: F.array_contains(have, n))


def _elements(tree: Column, tag: str) -> Column:
    return F.filter(tree, lambda x: x["tag"] == tag)


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links: key, href, label."""
    links = F.filter(_elements(F.col("tree"), "a"), lambda x: x["attrs"]["href"].isNotNull())
    found = F.transform(links, lambda x: F.struct(x["attrs"]["href"].alias("href"), text_of(F.col("tree"), x).alias("label")))
    return trees(pages, html, key).select(key, F.explode(found).alias("_l")).select(key, "_l.href", "_l.label")


def titles(pages: DataFrame, key: str, html: str, references: tuple[str, ...] | None = None) -> DataFrame:
    """(key, title), null where a page has none. references: names of the only character references that are decoded, each ended by
    its semicolon; other ampersands and white space beyond ASCII stay as they are written. Without it all are decoded as HTML does."""
    first = F.get(_elements(F.col("tree"), "title"), F.lit(0))
    if references is None:
        found = text_of(F.col("tree"), first)
    else:
        pages = pages.select(key, F.regexp_replace(html, f"&(?!(?:{'|'.join(references)});)", "&amp;").alias(html))
        found = F.trim(F.regexp_replace(_raw_text(F.col("tree"), first), r"[ \t\n\f\r]+", " "))
    return trees(pages, html, key).select(key, F.when(first.isNotNull() & (found != ""), found).alias("title"))


def outline(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, n, words): a page's elements by tag, and the words of text in all of them together."""
    tree = F.col("tree")
    each = F.transform(F.filter(tree, lambda x: x["tag"] != "#text"), lambda x: F.struct(x["tag"].alias("tag"), F.size(F.filter(F.split(text_of(tree, x), " "), lambda w: w != "")).alias("words")))
    rows = trees(pages, html, key).select(key, F.explode(each).alias("_e")).select(key, "_e.*")
    return rows.groupBy(key, "tag").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


def odds_rows(pages: DataFrame, html: str, now: Column) -> DataFrame:
    """Result tables with odds: each row has a link "Home - Away", a cell with a score d:d and one with a day d.m. or d.m.yyyy. A day
    without a year is of this year or, more than 30 days ahead, of the year before; a row without a day is of today; one whose day
    doesn't exist goes. Three odds or more are home, draw, away; fewer are none. Of rows that repeat a day and its teams one stays."""
    rows = trees(pages, html).select("tree", F.explode(_elements(F.col("tree"), "tr")).alias("_r")).select(inside(F.col("tree"), F.col("_r")).alias("tree"))
    tree = F.col("tree")
    texts = F.transform(F.filter(tree, lambda x: x["tag"] == "#text"), lambda x: even(x["text"]))
    numbers = lambda x, sign: F.transform(F.split(x, sign), lambda n: n.try_cast("int"))
    # a cell is a score or a day if nothing but its numbers and their sign are in it
    score = F.get(F.filter(F.transform(texts, lambda x: numbers(x, ":")), lambda n: (F.size(n) == 2) & F.forall(n, lambda v: v.isNotNull())), F.lit(0))
    parts = F.transform(F.filter(texts, lambda x: x.contains(".")), lambda x: F.split(x, r"\."))
    whole = lambda d: (F.size(d) == 3) & d[0].try_cast("int").isNotNull() & d[1].try_cast("int").isNotNull() & ((d[2] == "") | (F.length(d[2]) == 4) & d[2].try_cast("int").isNotNull())
    day = F.get(F.filter(parts, whole), F.lit(0))
    odds = F.filter(F.transform(tree, lambda x: x["attrs"]["data-odd"].try_cast("double")), lambda v: v.isNotNull())
    link = F.get(_elements(tree, "a"), F.lit(0))
    got = rows.select(F.split(text_of(tree, link), " - ").alias("_t"), score.alias("_s"), day.alias("_d"), odds.alias("_o"))
    dated = F.col("_d")[2] != ""
    year = F.when(dated, F.col("_d")[2].cast("int")).otherwise(F.year(now))
    found = F.try_make_timestamp(year, F.col("_d")[1].cast("int"), F.col("_d")[0].cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    past = F.when(~dated & (found > F.date_add(F.to_date(now), 30)), F.add_months(found, -12)).otherwise(found)
    price = lambda i: F.when(F.size("_o") >= 3, F.get("_o", F.lit(i)))
    out = got.select(
        F.when(F.col("_d").isNull(), F.to_date(now)).otherwise(past).alias("date"), F.get("_t", F.lit(0)).alias("home_team"), F.get("_t", F.lit(1)).alias("away_team"), F.get("_s", F.lit(0)).alias("home_score"), F.get("_s", F.lit(1)).alias("away_score"),
        *(price(i).alias(c) for i, c in enumerate(("odds_home", "odds_draw", "odds_away"))),
    )
    return out.where("away_team is not null and home_score is not null and date is not null").dropDuplicates(["date", "home_team", "away_team"])


# Classes by which the results archive marks a club's full name, a match's score and its goals, and where its pages are.
FULL_NAME, SCORE, GOALS = ("gsa-d-sm-md-none", "gsa-d-block"), "gsa-match-rounds-v2__match-score", ("gsa-text-yellow", "gsa-text-grey")
ARCHIVE = "https://globalsportsarchive.com/en/soccer/"


def _path(href: Column, kind: str) -> Column:
    """What follows the archive's address and the kind of page, in parts; null for other links."""
    start = F.lit(f"{ARCHIVE}{kind}/")
    return F.when(F.startswith(href, start), F.filter(F.split(F.substr(href, F.length(start) + 1), "/"), lambda p: p != ""))


def archive_rows(pages: DataFrame, html: str, season: Column | None = None) -> DataFrame:
    """(match_id, date, season, home_team, away_team, home_score, away_score, outcome) of the archive's pages of matches; those not
    played yet are left out, and a match that several links or pages show comes once. season: null to tell it by the date."""
    tree = F.col("tree")
    links = F.filter(F.transform(_elements(tree, "a"), lambda x: F.struct(x.alias("x"), _path(x["attrs"]["href"], "match").alias("p"))), lambda m: F.size(m["p"]) == 3)
    found = trees(pages, html).select("tree", F.explode(links).alias("_m")).select(F.col("_m.p").alias("p"), inside(tree, F.col("_m.x")).alias("tree"))
    divs = _elements(tree, "div")
    names = F.filter(F.transform(F.filter(divs, lambda x: has_class(x, *FULL_NAME)), lambda x: text_of(tree, x)), lambda n: n != "")
    score = F.get(F.filter(tree, lambda x: has_class(x, SCORE)), F.lit(0))
    marked = F.filter(inside(tree, score), lambda x: (x["tag"] == "div") & (has_class(x, GOALS[0]) | has_class(x, GOALS[1])))
    goals = F.transform(marked, lambda x: text_of(tree, x).try_cast("int"))
    rows = found.select(F.col("p")[2].alias("id"), F.to_date(F.try_to_timestamp(F.col("p")[0], F.lit("yyyy-MM-dd"))).alias("date"), names.alias("_n"), F.get(goals, F.lit(0)).alias("home_score"), F.get(goals, F.lit(1)).alias("away_score"))
    played = rows.where((F.size("_n") >= 2) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & F.col("date").isNotNull() & F.col("id").try_cast("long").isNotNull())
    one = played.groupBy("id").agg(F.min(F.struct("date", "_n", "home_score", "away_score")).alias("_m")).select("id", "_m.*")
    label = X.season_label(F.col("date"))
    return one.select(
        F.col("id").alias("match_id"), "date", (F.coalesce(season, label) if season is not None else label).alias("season"), F.col("_n")[0].alias("home_team"), F.col("_n")[1].alias("away_team"),
        "home_score", "away_score", X.outcome(F.col("home_score"), F.col("away_score")).alias("outcome"),
    )


def archive_clubs(pages: DataFrame, html: str) -> DataFrame:
    """(url) of the clubs' pages that the pages link to, each once, sorted."""
    links = F.transform(_elements(F.col("tree"), "a"), lambda x: _path(x["attrs"]["href"], "team"))
    parts = trees(pages, html).select(F.explode(F.filter(links, lambda p: (F.size(p) == 2) & p[1].try_cast("long").isNotNull())).alias("p"))
    return parts.select(F.concat(F.lit(f"{ARCHIVE}team/"), F.array_join("p", "/")).alias("url")).distinct().orderBy("url")
