"""Pages fetched from the web: by Arrow batches on the executors, through a function that can be any."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.html import LINKS, PAGE_CHARS, parse_pages, subpages

TRIES, TIMEOUT = 3, 20
AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"


class Answer(NamedTuple):
    final_url: str
    status_code: int
    html: str


def over_http(url: str) -> Answer | None:
    """A page by the standard library: up to TRIES times at once, redirects followed; null for all that fails or is refused."""
    import urllib.request

    for _ in range(TRIES):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": AGENT})
            with urllib.request.urlopen(request, timeout=TIMEOUT) as got:  # noqa: S310
                charset = got.headers.get_content_charset() or "utf-8"
                return Answer(got.url, got.status, got.read().decode(charset, "replace"))
        except (OSError, ValueError, LookupError):
            continue
    return None


def fetch(urls: DataFrame, get: Callable[[str], Answer | None] = over_http, url: str = "url") -> DataFrame:
    """url, final_url, status_code and html of each row; nulls where it failed. Write the result down: a second reading fetches again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [get(u) if u else None for u in p[url]]
            rows = [(u, *(a or (None, None, None))) for u, a in zip(p[url], got)]
            yield pd.DataFrame(rows, columns=["url", "final_url", "status_code", "html"]).astype({"status_code": "Int32"})

    return urls.select(url).mapInPandas(run, "url string, final_url string, status_code int, html string")


def crawl(sites: DataFrame, fetched: DataFrame | Callable[[DataFrame], DataFrame], words: list[str] | None = None, limit: int = LINKS, chars: int = PAGE_CHARS) -> DataFrame:
    """site_url, crawl_idx, url, title, text and html: each site's page, then its useful subpages in the order of their links.

    fetched is a table of pages (url, html) or a function that makes one of
    URLs. Subpages that can't be had are left out, so is a site whose own page
    can't be; a page linked to itself or again comes once.
    """
    table = fetched if callable(fetched) else lambda urls: fetched.join(urls.distinct(), "url", "left_semi")
    main = sites.select(F.col("site_url").alias("url")).distinct()
    front = table(main).where("html is not null").select(F.col("url").alias("site_url"), "url", "html", F.lit(0).alias("crawl_idx"))
    parsed = parse_pages(front.withColumn("raw", F.col("html")), chars=chars)
    found = subpages(parsed, "url", words, limit)
    below = found.select("site_url", F.posexplode(F.array_except("subpages", F.array("site_url"))).alias("i", "url"))
    pages = table(below.select("url").distinct()).where("html is not null").select("url", "html")
    rest = below.join(pages, "url").select("site_url", "url", "html", (F.col("i") + 1).alias("crawl_idx"))
    rest = parse_pages(rest.withColumn("raw", F.col("html")), chars=chars)
    cols = ["site_url", "crawl_idx", "url", "title", "text", F.col("raw").alias("html")]
    return found.select(*cols).unionByName(rest.select(*cols))
