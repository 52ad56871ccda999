"""URL and text expressions. All but accents() and resolve() stay in the JVM."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's \s and str.strip see it (U+001C to U+001F are not among Java's).
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A(?U)[\s\x1c-\x1f]+", "")


def url_key(url: Column) -> Column:
    """The key on which URLs are joined: no scheme, one leading www. less, no slashes at the end, lower case."""
    bare = F.replace(F.replace(F.lower(strip(F.coalesce(url, F.lit("")))), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), "/+$", "")


def safe_name(s: Column) -> Column:
    """A name for a file or folder, of at most 80 characters."""
    bare = F.replace(F.replace(s, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.substring(F.regexp_replace(F.regexp_replace(bare, r"[/:.\-]+", "_"), "^_+|_+$", ""), 1, 80)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def url_authority(url: Column) -> Column:
    """Host, with the port and user where given."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def site_of(url: Column) -> Column:
    return F.replace(F.lower(url_authority(url)), F.lit("www."), F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    return site_of(a) == site_of(b)


def spaced(s: Column) -> Column:
    """Lower case, with hyphens, underscores, slashes and runs of white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[-_/]+", " "), f"{SPACE}+", " "))


def contains_any(s: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))


@F.pandas_udf(T.StringType())
def accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in lower case."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return s.map(lambda t: t if t is None else t.lower() if t.isascii() else plain(t))


def plain_letters(s: Column) -> Column:
    """accents(s), which only texts beyond ASCII need; s in lower case otherwise. Never null."""
    return F.coalesce(accents(s), F.lit(""))


# What names of events may begin with, and titles of persons.
NOISE = ["the ", "annual ", "international ", "conference on ", "conference of ", "proceedings of ", "ieee ", "acm ", "symposium on ", "workshop on "]
TITLES = r"(?i)\b(prof|professor|dr|mr|ms|mrs|sir|phd|ph\.d)\.?\b"


def _words_only(s: Column) -> Column:
    apart = F.regexp_replace(s, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(apart, f"{SPACE}+", " "))


def event_name(plain: Column) -> Column:
    """A text without accents (see plain_letters) as events are compared: no punctuation, no phrase of NOISE in front."""
    return F.trim(F.regexp_replace(_words_only(plain), "^(?:" + "|".join(NOISE) + ")+", ""))


def person_name(plain: Column) -> Column:
    """A text without accents as persons are compared: no titles, no punctuation."""
    return _words_only(F.regexp_replace(plain, TITLES, " "))


# Names of countries and their two letters.
COUNTRIES = {
    "usa": "us", "u.s.a": "us", "u.s.a.": "us", "united states": "us", "united states of america": "us", "america": "us",
    "uk": "gb", "u.k.": "gb", "united kingdom": "gb", "great britain": "gb", "england": "gb",
    "south korea": "kr", "korea": "kr", "republic of korea": "kr",
    "russia": "ru", "russian federation": "ru",
    "czech republic": "cz", "czechia": "cz",
    "uae": "ae", "united arab emirates": "ae",
}


def country_code(s: Column) -> Column:
    """Two letters, or null; a text of two letters stands for itself."""
    name = F.lower(strip(s))
    table = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.element_at(table, name), F.when(F.length(name) == 2, name))


def _resolve(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "").split("#")[0].split("?")[0]
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's URL without query and fragment; null where it can't be one."""
    return pd.Series([_resolve(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolve_all(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """resolve() for all links of a page."""
    return pd.Series([None if hs is None else [_resolve(b, h) for h in hs] for b, hs in zip(base, hrefs)], dtype=object)


def ordinal(day: Column) -> Column:
    suffix = F.when((day % 100).between(10, 20), "th").otherwise(F.element_at(F.array(*map(F.lit, ["th", "st", "nd", "rd", *["th"] * 6])), (day % 10 + 1).cast("int")))
    return F.concat(day.cast("string"), suffix)


def file_stem(pass_name: Column) -> Column:
    """A pass's name, as files of its prompts and answers are called."""
    return F.translate(pass_name, " ()", "_")


def percent(share: Column) -> Column:
    """One decimal, five wide, rounded as the exact binary value says."""
    return percent_text(share * 100)


@F.pandas_udf(T.StringType())
def percent_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else f"{v:5.1f}")
