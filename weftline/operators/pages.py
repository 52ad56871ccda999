"""Which pages of a site tell about what: keyword scores, the best pages for each target, and contexts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import spaced, url_path

# The keywords of each target, and how many pages it takes.
LEXICONS = {
    "basic": [
        "important dates", "dates", "deadline", "schedule", "call for papers", "call", "cfp", "submission", "submit", "papers",
        "venue", "location", "travel", "hotel", "accommodation", "publication", "proceedings", "indexing", "journal", "publisher",
        "topic", "track", "theme", "area", "scope", "about", "home", "overview",
    ],
    "speakers": ["keynote", "invited speaker", "invited", "speaker", "plenary", "program"],
    "committee": ["committee", "program committee", "tpc", "organizing", "organizer", "chair", "chairs", "reviewer", "board", "people", "team"],
}
LIMITS = {"basic": 6, "speakers": 3, "committee": 3}
OTHER_LIMIT = 5
LEAST = 1
HEAD = 500
WEIGHTS = {"path": 3, "title": 2, "head": 1}


def score(path: Column, title: Column, head: Column, words: list[str]) -> Column:
    """Weighted sum over the keywords that each part holds; the parts normalised by spaced()."""
    given = F.filter(F.transform(F.array(*map(F.lit, words)), spaced), lambda w: w != "")
    worth = lambda w: sum((F.contains(c, w).cast("int") * WEIGHTS[k] for k, c in (("path", path), ("title", title), ("head", head))), F.lit(0))
    return F.aggregate(F.transform(given, worth), F.lit(0), lambda a, x: a + x)


def with_scores(pages: DataFrame, lexicons: dict[str, list[str]] | None = None) -> DataFrame:
    """pages (site_url, url, title, text) with is_main and score_<target>; each part is normalised once."""
    parts = {"_path": spaced(url_path(F.col("url"))), "_title": spaced(F.col("title")), "_head": spaced(F.substring("text", 1, HEAD))}
    ready = pages.withColumns(parts)
    scores = {f"score_{t}": score(F.col("_path"), F.col("_title"), F.col("_head"), ws) for t, ws in (lexicons or LEXICONS).items()}
    return ready.withColumns({"is_main": F.col("url") == F.col("site_url"), **scores}).drop(*parts)


def by_target(scored: DataFrame, targets: list[str]) -> DataFrame:
    """A row for each page and target, with its score."""
    each = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"score_{t}").alias("score")) for t in targets))
    return scored.select("*", F.inline(each)).drop(*(f"score_{t}" for t in targets))


def select_pages(scored: DataFrame, targets: list[str] | None = None, limits: dict[str, int] | None = None, least: int = LEAST, include_main: bool = True) -> DataFrame:
    """The pages for each site and target, with rank.

    The first main page comes first, takes a place even of none, and is there
    whatever its score; others need the least score and come by score, then
    crawl_idx, up to the target's limit.
    """
    targets = targets or list(LEXICONS)
    limits = limits or LIMITS
    each = by_target(scored, targets)
    first_main = W.partitionBy("site_url", "target", "is_main").orderBy("crawl_idx")
    lead = F.col("is_main") & (F.row_number().over(first_main) == 1) if include_main else F.lit(False)
    each = each.withColumn("_lead", F.coalesce(lead, F.lit(False))).where(F.col("_lead") | (~F.coalesce("is_main", F.lit(False)) & (F.col("score") >= least)))
    order = W.partitionBy("site_url", "target").orderBy(F.desc("_lead"), F.desc("score"), "crawl_idx")
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in limits.items() for x in p)), F.col("target")), F.lit(OTHER_LIMIT))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("_lead") | (F.col("rank") <= limit)).drop("_lead")


def contexts(selected: DataFrame) -> DataFrame:
    """site_url, target and context: the selected pages' URLs, titles and texts, in rank."""
    page = F.concat(F.lit("=== PAGE: "), "url", F.lit(" ===\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    # A target takes a few pages of bounded length, so a context is bounded.
    parts = F.array_sort(F.collect_list(F.struct("rank", page.alias("page"))))
    return selected.groupBy("site_url", "target").agg(F.array_join(F.transform(parts, lambda p: p["page"]), "\n\n").alias("context"))


def describe(scored: DataFrame, targets: list[str] | None = None, top: int | None = None) -> DataFrame:
    """site_url, target, url, score and rank of all pages (or the first top), best first, in crawl order among equals."""
    order = W.partitionBy("site_url", "target").orderBy(F.desc("score"), "crawl_idx")
    out = by_target(scored, targets or list(LEXICONS)).withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= top) if top else out).select("site_url", "target", "url", "score", "rank")


def full_text(pages: DataFrame) -> DataFrame:
    """site_url and the texts of its pages in crawl order, as one."""
    page = F.struct("crawl_idx", F.concat(F.lit("=== PAGE: "), "url", F.lit(" ===\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("page"))
    return pages.groupBy("site_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["page"]), "\n\n").alias("full_text"))


def raw_html(pages: DataFrame) -> DataFrame:
    """site_url and the HTML of all its pages in crawl order: what values are verified against."""
    return pages.groupBy("site_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("crawl_idx", F.coalesce("html", F.lit("")).alias("html")))), lambda p: p["html"]), "\n").alias("source"))
