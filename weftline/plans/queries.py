"""Every operator applied to whole tables, and DuckDB SQL that gives the same rows.

The tables' prose is invented, so page queries take keywords that occur in it in
place of the default lexicons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers, dates, similarity, text
from ..operators import batch, html, pages, records, scoring, verify
from . import evaluation

#: Keywords that occur in the tables' pages.
WORDS = {"basic": ["the", "tion-on", "er", "de"], "speakers": ["and", "une", "th of"], "committee": ["en/", "der", "la"]}
LINK_WORDS = ["th", "en", "la"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- model ranking over labelled documents ------------------------------------------------------------------------------

_GOLD = """
g AS (SELECT d.source AS model, CASE d.lang WHEN 'en' THEN 'dates' WHEN 'de' THEN 'location' WHEN 'fr' THEN 'topics' ELSE 'other' END AS category, 'f' || l.quality AS path, CASE WHEN l.toxic = 1 THEN NULL ELSE l.quality::VARCHAR END AS gold,
        CASE WHEN d.text LIKE '%***%' THEN '0' WHEN length(d.text) < 300 THEN NULL ELSE '1' END AS pred
      FROM labels l JOIN documents d USING (doc_id)),
o AS (SELECT model, category, path, CASE WHEN gold IS NULL AND pred IS NULL THEN 'tn' WHEN gold IS NULL THEN 'fp_halluc' WHEN pred IS NULL THEN 'fn'
        WHEN gold = pred THEN 'tp' ELSE 'fp_wrong' END AS outcome FROM g),
c AS (SELECT model, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(path) = 0 THEN 'field' ELSE 'overall' END AS grain,
        coalesce(category, path, 'all') AS name, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fn') AS fn,
        count(*) FILTER (outcome = 'fp_wrong') AS fp_wrong, count(*) FILTER (outcome = 'fp_halluc') AS fp_halluc, count(*) FILTER (outcome = 'tn') AS tn
      FROM o GROUP BY GROUPING SETS ((model), (model, category), (model, path))),
p AS (SELECT *, coalesce(tp / nullif(tp + fp_wrong + fp_halluc, 0), 0) AS precision_, coalesce(tp / nullif(tp + fn + fp_wrong, 0), 0) AS recall_ FROM c),
r AS (SELECT *, coalesce(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 0) AS f1 FROM p)
"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels as gold (none where toxic), a rule on the text as prediction, source as model, language as category, one of them none of the scored."""
    category = F.when(F.col("lang") == "en", "dates").when(F.col("lang") == "de", "location").when(F.col("lang") == "fr", "topics").otherwise("other")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("model"), category.alias("category"), F.when(F.contains("text", F.lit("***")), "0").when(F.length("text") >= 300, "1").alias("pred"))
    g = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("f"), "quality").alias("path"), F.when(F.col("toxic") != 1, F.col("quality").cast("string")).alias("gold"), F.lit("acronym").alias("matcher"))
    met = scoring.decide(g.join(d, "doc_id"))
    out = met.withColumn("outcome", scoring.outcome(F.col("gold"), F.col("pred"), F.col("matched")))
    return out.withColumns({c: (F.col("outcome") == c).cast("long") for c in scoring.COUNTS})


@query(f"WITH {_GOLD} SELECT model, round(avg(f1), 9) AS macro_f1 FROM r WHERE grain = 'category' AND name <> 'other' GROUP BY model")
def model_ranking(spark, sf):
    """Flagship: outcomes, counts at three grains, ratios, macro-F1."""
    macro = scoring.macro_f1(scoring.with_ratios(scoring.rollup(_outcomes(spark, sf))))
    return scoring.ranking(macro).withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"WITH {_GOLD} SELECT model, category, path, outcome, count(*) AS n FROM o GROUP BY ALL")
def scalar_outcomes(spark, sf):
    return _outcomes(spark, sf).groupBy("model", "category", "path", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT model, grain, name, tp, fn, fp_wrong, fp_halluc, tn FROM c")
def count_rollup(spark, sf):
    return scoring.rollup(_outcomes(spark, sf))


@query(f"""WITH {_GOLD} SELECT model, grain, name, round(precision_, 9) AS precision, round(recall_, 9) AS recall, round(f1, 9) AS f1, tp + fn
  + fp_wrong AS support, round(coalesce(fp_halluc / nullif(fp_halluc + tn, 0), 0), 9) AS hallucination_rate FROM r""")
def prf_metrics(spark, sf):
    out = scoring.with_ratios(scoring.rollup(_outcomes(spark, sf)))
    ratios = ("precision", "recall", "f1", "hallucination_rate")
    return out.select("model", "grain", "name", "support", *(F.round(c, 9).alias(c) for c in ratios))


# --- URLs and links ------------------------------------------------------------------------------------------------------

_PAGE_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_HOST = r"replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), 'www.', '')"


@query("SELECT page_id, rtrim(regexp_replace(replace(replace(lower(trim(url)), 'https://', ''), 'http://', ''), '^www\\.', ''), '/') AS url_key FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query(r"SELECT page_id, substr(trim(regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '[/:.\-]+', '_', 'g'), '_'), 1, 80) AS name FROM pages")
def url_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT a.page_id, a.host, a.host = b.host AS same FROM h a LEFT JOIN h b ON b.page_id = a.page_id + 1")
def url_same_domain(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return p.join(q, "page_id", "left").select("page_id", text.site_of(F.col("url")).alias("host"), text.same_site(F.col("url"), F.col("other")).alias("same"))


_LINKS = f"""
WITH a AS (SELECT page_id, url, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS href, unnest(t) AS t
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)),
f AS (SELECT page_id, i, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(href, '^[^?#]*') AS dest,
    regexp_matches(lower(href || ' ' || t), 'th|en|la') AS useful FROM a WHERE href LIKE '/%' AND NOT regexp_matches(href, '(\\.pdf|\\.zip|\\.docx)$')),
o AS (SELECT page_id, dest, min(i) AS i, arg_min(useful, i) AS useful FROM f GROUP BY page_id, dest),
n AS (SELECT page_id, dest, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth FROM o WHERE useful)
SELECT p.page_id, coalesce(string_agg(dest, ' ' ORDER BY nth), '') AS subpages FROM pages p LEFT JOIN n ON n.page_id = p.page_id AND nth <= 8 GROUP BY p.page_id
"""


@query(_LINKS)
def link_discovery(spark, sf):
    parsed = html.parse_pages(table(spark, sf, "pages").select("page_id", "url", "html"))
    return html.subpages(parsed, words=LINK_WORDS).select("page_id", F.array_join("subpages", " ").alias("subpages"))


# --- pages -----------------------------------------------------------------------------------------------------------------

_TEXT = r"trim(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_SPACED = "trim(regexp_replace(regexp_replace(lower({}), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _score_sql(words: list[str]) -> str:
    one = lambda w: f"3 * contains(path, '{w}')::INT + 2 * contains(title_, '{w}')::INT + contains(head, '{w}')::INT"
    return " + ".join(one(" ".join(w.replace("-", " ").replace("/", " ").split())) for w in words)


_SCORED = f"""
s AS (SELECT page_id, url, {_HOST} AS host, {_TITLE} AS title, {_TEXT} AS body FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS crawl_idx, first(url) OVER (PARTITION BY host ORDER BY page_id) AS site_url,
    {_SPACED.format(_PAGE_PATH)} AS path, {_SPACED.format("title")} AS title_, {_SPACED.format("substr(body, 1, 500)")} AS head FROM s),
sc AS (SELECT page_id, site_url, url, title, body, crawl_idx, url = site_url AS is_main, {", ".join(f"{_score_sql(w)} AS score_{t}" for t, w in WORDS.items())} FROM k),
t AS ({" UNION ALL ".join(f"SELECT page_id, site_url, url, title, body, crawl_idx, is_main, '{t}' AS target, score_{t} AS score, {pages.LIMITS[t]} AS most FROM sc" for t in WORDS)}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_url, target ORDER BY is_main DESC, score DESC, crawl_idx) AS rank FROM t WHERE is_main OR score >= 1) WHERE rank <= most)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts as sites, their first page as main, tags taken out by expression."""
    host = W.partitionBy("host").orderBy("page_id")
    body = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>", " "), r"\s+", " "))
    p = table(spark, sf, "pages").select("page_id", "url", text.site_of(F.col("url")).alias("host"), html.title_of(F.col("html")).alias("title"), body.alias("text"))
    p = p.withColumn("crawl_idx", F.row_number().over(host) - 1).withColumn("site_url", F.first("url").over(host))
    return pages.with_scores(p, WORDS)


@query(f"WITH {_SCORED} SELECT page_id, is_main, score_basic, score_speakers, score_committee FROM sc")
def page_scores(spark, sf):
    return _scored(spark, sf).select("page_id", "is_main", *(f"score_{t}" for t in WORDS))


@query(f"WITH {_SCORED} SELECT site_url, target, page_id, score, rank FROM top")
def page_topk(spark, sf):
    return pages.select_pages(_scored(spark, sf)).select("site_url", "target", "page_id", "score", "rank")


@query(f"""WITH {_SCORED} SELECT site_url, target, md5(string_agg('=== PAGE: ' || url || ' ===' || chr(10) || title || chr(10) || body, chr(10)
  || chr(10) ORDER BY rank)) AS context_md5 FROM top GROUP BY site_url, target""")
def page_context(spark, sf):
    return pages.contexts(pages.select_pages(_scored(spark, sf))).select("site_url", "target", F.md5("context").alias("context_md5"))


@query(f"WITH {_SCORED} SELECT site_url, target, url, score, row_number() OVER (PARTITION BY site_url, target ORDER BY score DESC, crawl_idx) AS rank FROM t")
def selection_describe(spark, sf):
    return pages.describe(_scored(spark, sf))


@query(f"""WITH {_SCORED} SELECT site_url, md5(string_agg('=== PAGE: ' || url || ' ===' || chr(10) || title || chr(10) || body, chr(10) || chr(10)
  ORDER BY crawl_idx)) AS text_md5 FROM sc GROUP BY site_url""")
def site_full_text(spark, sf):
    return pages.full_text(_scored(spark, sf)).select("site_url", F.md5("full_text").alias("text_md5"))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]
_DECODED = "{}"
for _entity, _sign in _ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, {_DECODED.format(_TITLE)} AS title, {_TITLE} AS raw_title FROM pages")
def html_title(spark, sf):
    """Titles by the parser, and by expression."""
    p = table(spark, sf, "pages").select("page_id", "html", html.title_of(F.col("html")).alias("raw_title"))
    return html.parse_pages(p).select("page_id", "title", "raw_title")


@query()
def html_clean(spark, sf):
    """Cleaned text, title and number of links by the parser."""
    parsed = html.parse_pages(table(spark, sf, "pages").select("page_id", "html"))
    return parsed.select("page_id", "title", "text", F.size("links").alias("n_links"))


# --- batches ---------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def resume_anti_join(spark, sf):
    """Customers without an urgent order, as sites without a result."""
    done = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return batch.remaining(table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND
  d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority)""")
def resume_by_two_keys(spark, sf):
    """Orders whose customer and priority have no finished order, as sites and models without a result."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return batch.remaining(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


@query("""SELECT count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE
  c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def append_new_results(spark, sf):
    """Earlier results and those of what had none, one behind the other."""
    earlier = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    new = batch.remaining(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), earlier.where("o_orderstatus = 'P'"), ["k"])
    return earlier.unionByName(new, allowMissingColumns=True).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT s_suppkey, coalesce(p, 0) AS pos FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_orderkey) AS p FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def input_order(spark, sf):
    inputs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("ord"))
    return batch.in_input_order(table(spark, sf, "supplier").select("s_suppkey"), inputs, "s_suppkey", "ord")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 40 OFFSET 25")
def input_slice(spark, sf):
    """The operator is the slice: offset and limit are what a user asks for."""
    return batch.part(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 25, 40)


@query("SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS ord, r_name AS model, n_name AS url FROM region CROSS JOIN nation")
def models_cross_urls(spark, sf):
    models = table(spark, sf, "region").select(F.col("r_name").alias("model"), F.col("r_regionkey").alias("model_ord"))
    urls = table(spark, sf, "nation").select(F.col("n_name").alias("url"), F.col("n_nationkey").alias("url_ord"))
    return batch.combinations(models, urls).select("ord", "model", "url")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def keep_last_dedupe(spark, sf):
    return batch.keep_last(table(spark, sf, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], ["event_id"]).select("user_id", "event_type", "value")


_ATTEMPTS = """
a AS (SELECT user_id, event_id, event_id % 5 = 0 AS failed, CASE WHEN event_id % 5 = 0 THEN 13 ELSE 12 - (event_id * 7 + user_id) % 12 END AS nulls FROM events),
g AS (SELECT user_id, min(event_id) FILTER (NOT failed AND nulls <= 4) AS stop, max(event_id) AS last, arg_min(event_id, {'f': failed, 'n': nulls, 'e': event_id}) AS least FROM a GROUP BY user_id)
"""


@query(f"""WITH {_ATTEMPTS} SELECT g.user_id, a.event_id AS attempt, CASE WHEN a.failed THEN NULL ELSE a.nulls END AS nulls, coalesce(stop, last)
  AS attempts FROM g JOIN a ON a.user_id = g.user_id AND a.event_id = coalesce(stop, least)""")
def best_attempt(spark, sf):
    """Each user's events as attempts, with more or fewer fields, some with no record at all."""
    keys = ["full_name", "acronym", "start_date", "end_date", "city", "country", "submission_deadline", "notification_date", "camera_ready_date", "publisher", "series"]
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("attempt"), ((F.col("event_id") * 7 + F.col("user_id")) % 12).cast("int").alias("n"))
    given = F.map_from_entries(F.transform(F.slice(F.array(*map(F.lit, keys)), F.lit(1), F.col("n")), lambda k: F.struct(k.alias("k"), F.lit("x").alias("v"))))
    none = F.lit(None).cast("string")
    rows = e.withColumn("record", F.when(F.col("attempt") % 5 != 0, records.merge(F.lit("u"), F.to_json(given), none, none))).drop("n")
    best = records.best_attempt(rows, ["user_id"])
    return best.select("user_id", "attempt", F.when(F.col("record").isNotNull(), records.null_fields(F.col("record"))["nulls"]).alias("nulls"), "attempts")


_CHECK = "CASE WHEN page_id % 7 = 0 THEN NULL ELSE 200 + (page_id % 3) * 101 END"


@query(f"""WITH f AS (SELECT url, {_CHECK} AS s, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN url || '/' ELSE url END AS f FROM
  pages) SELECT count(*) AS done, count(*) FILTER (s < 400) AS ok, count(*) FILTER (s IS NULL) AS errors, count(*) FILTER (s IS NOT
  NULL AND f <> url) AS redirects FROM f""")
def url_check_summary(spark, sf):
    """Pages as inputs, some of one address, each with an answer of its own."""
    p = table(spark, sf, "pages")
    ok = F.col("page_id") % 7 != 0
    fetched = p.select("page_id", "url", F.when(ok, F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))).alias("final_url"), F.when(ok, 200 + F.col("page_id") % 3 * 101).cast("int").alias("status_code"))
    return batch.check_totals(batch.checked(p.select("page_id", F.col("url").alias("website_url")), fetched, "page_id"))


_ENTRIES = """e AS (SELECT o_orderpriority AS model, o_orderstatus AS url, o_orderkey AS seq, CASE WHEN o_custkey % 11 = 0 THEN 'error' ELSE 'ok'
  END AS status, round_even(((o_orderkey % 17) / 16) * 100, 1) AS fill, (o_custkey % 4) AS low, o_totalprice AS t FROM orders), l AS
  (SELECT model, url, arg_max(status, seq) AS status, arg_max(fill, seq) AS fill, arg_max(low, seq) AS low, arg_max(t, seq) AS t FROM
  e GROUP BY model, url)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    low = F.slice(F.array(*(F.lit(x) for x in "abc")), F.lit(1), (F.col("o_custkey") % 4).cast("int"))
    return o.select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("url"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 11 == 0, "error").otherwise("ok").alias("status"),
        records.fill_percent(F.col("o_orderkey") % 17, F.lit(16)).alias("fill_pct"), low.alias("low_confidence_fields"), F.col("o_totalprice").alias("elapsed_sec"),
    )


@query(f"WITH {_ENTRIES} SELECT url, " + ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN CASE WHEN status <> 'ok' THEN 'ERR' ELSE fill::DOUBLE::VARCHAR || '% h:' || low END END), '-') AS \"{m}\"" for m in ("1-URGENT", "5-LOW")) + " FROM l GROUP BY url")
def fill_rate_pivot(spark, sf):
    return batch.summary_pivot(_entries(spark, sf), ["1-URGENT", "5-LOW"])


@query(f"""WITH {_ENTRIES} SELECT model, count(*) FILTER (status = 'ok') AS sites, count(*) AS all_sites, round(avg(fill) FILTER (status = 'ok'),
  6) AS avg_fill, round(avg(t) FILTER (status = 'ok'), 6) AS avg_time, sum(low) FILTER (status = 'ok')::BIGINT AS doubtful FROM l GROUP
  BY model""")
def fill_rate_avg(spark, sf):
    return batch.summary_averages(_entries(spark, sf)).withColumns({c: F.round(c, 6) for c in ("avg_fill", "avg_time")})


# --- dates -----------------------------------------------------------------------------------------------------------------

_DATES = """d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS sub, strftime(min(l_shipdate), '%Y-%m-%d') AS notif, CASE WHEN o_orderkey
  % 5 = 0 THEN NULL ELSE strftime(max(l_shipdate), '%Y-%m-%d') END AS cam, strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m-%d') AS start,
  strftime(o_orderdate + INTERVAL (o_orderkey % 100) DAY, '%Y-%m-%d') AS fin FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderdate)"""


@query(f"""WITH {_DATES} SELECT o_orderkey, concat_ws('; ', CASE WHEN start > fin THEN 'start_date (' || start || ') > end_date (' || fin || ')'
  END, CASE WHEN sub > notif THEN 'submission (' || sub || ') > notification (' || notif || ')' END, CASE WHEN notif > cam THEN 'notification ('
  || notif || ') > camera_ready (' || cam || ')' END, CASE WHEN cam > start THEN 'camera_ready (' || cam || ') > start_date (' || start
  || ')' END) AS warnings FROM d""")
def date_order_warnings(spark, sf):
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).join(ships, "o_orderkey", "left")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    k = F.col("o_orderkey")
    given = {"submission": iso("d"), "notification": iso("a"), "camera_ready": F.when(k % 5 != 0, iso("z")), "start_date": iso(F.date_add("d", 60)), "end_date": iso(F.date_add("d", (k % 100).cast("int")))}
    return d.select("o_orderkey", F.array_join(dates.order_warnings(given), "; ").alias("warnings"))


_WRITTEN = """
CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 4 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 5 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 6 THEN '2026-02-30' ELSE 'soon' END
"""


def _written(c: str = "o_orderdate"):
    k = F.col("o_orderkey") % 8
    out = F.lit("soon")
    for i, p in enumerate(["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MMMM dd, yyyy", "MMM dd, yyyy"]):
        out = F.when(k == i, F.date_format(c, p)).otherwise(out)
    return F.when(k == 6, "2026-02-30").otherwise(out)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed, {_WRITTEN} AS written FROM orders")
def date_multiformat(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _written().alias("written"))
    return o.select("o_orderkey", F.date_format(dates.any_date(F.col("written")), "yyyy-MM-dd").alias("parsed"), "written")


_FORMS = """
f AS (SELECT d, strftime(d, '%Y') AS y, lower(strftime(d, '%B')) AS m1, lower(strftime(d, '%b')) AS m2, day(d)::VARCHAR AS d1, strftime(d, '%d') AS d2,
    day(d)::VARCHAR || CASE WHEN day(d) BETWEEN 10 AND 20 THEN 'th' WHEN day(d) % 10 = 1 THEN 'st' WHEN day(d) % 10 = 2 THEN 'nd' WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END AS d3,
    strftime(d, '%m') AS mm, month(d)::VARCHAR AS m FROM days),
v AS (SELECT d, y, flatten(list_transform([m1, m2], lambda a: flatten(list_transform([d1, d2, d3], lambda b: [a || ' ' || b, b || ' ' || a, b || ' of ' || a])))) AS part,
    list_concat(flatten(list_transform([m1, m2], lambda a: flatten(list_transform([d1, d2, d3], lambda b: [a || ' ' || b || ', ' || y, a || ' ' || b || ' ' || y, b || ' ' || a || ' ' || y, b || ' ' || a || ', ' || y, b || ' of ' || a || ' ' || y, b || ' of ' || a || ', ' || y])))),
      flatten(list_transform(['-', '/', '.'], lambda s: [y || s || mm || s || d2, d2 || s || mm || s || y, mm || s || d2 || s || y, d1 || s || m || s || y, m || s || d1 || s || y]))) AS whole FROM f)
"""


@query(f"""WITH days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), {_FORMS} SELECT strftime(d, '%Y-%m-%d') AS d, array_to_string(list_sort(list_distinct(whole)),
  '|') AS full_forms, array_to_string(list_sort(list_distinct(part)), '|') AS partial_forms FROM v""")
def date_variants(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    shown = lambda c: F.array_join(F.array_sort(c), "|")
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("d"), shown(dates.full_forms(F.col("d"))).alias("full_forms"), shown(dates.partial_forms(F.col("d"))).alias("partial_forms"))


_SOURCE = """'Held ' || CASE l_linenumber % 5 WHEN 0 THEN strftime(l_shipdate, '%B ') || day(l_shipdate) || ', ' || year(l_shipdate) WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y')
  WHEN 2 THEN strftime(l_shipdate, '%B ') || greatest(day(l_shipdate) - 2, 1) || '-' || (day(l_shipdate) + 1) || ', ' || year(l_shipdate) WHEN 3 THEN year(l_shipdate) || ': ' || day(l_shipdate) || strftime(l_shipdate, ' %b') ELSE 'soon' END || '.'"""


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, (l_shipdate + INTERVAL (l_quantity::INT % 3) DAY)::DATE AS d, l_shipdate, {_SOURCE} AS src FROM lineitem), days AS (SELECT DISTINCT d FROM s), {_FORMS}
SELECT l_orderkey, l_linenumber, list_bool_or(list_transform(whole, lambda x: contains(lower(src), x))) OR (contains(lower(src), y) AND list_bool_or(list_transform(part, lambda x: contains(lower(src), x))))
  OR (l_linenumber % 5 = 2 AND month(s.d) = month(l_shipdate) AND year(s.d) = year(l_shipdate) AND day(s.d) BETWEEN greatest(day(l_shipdate) - 2, 1) AND day(l_shipdate) + 1) AS found
FROM s JOIN v ON v.d = s.d""")
def date_in_source(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    s, n = F.col("l_shipdate"), F.col("l_linenumber") % 5
    word = lambda c: c.cast("string")
    shown = (
        F.when(n == 0, F.concat(F.date_format(s, "MMMM "), word(F.dayofmonth(s)), F.lit(", "), word(F.year(s)))).when(n == 1, F.date_format(s, "dd/MM/yyyy"))
        .when(n == 2, F.concat(F.date_format(s, "MMMM "), word(F.greatest(F.dayofmonth(s) - 2, F.lit(1))), F.lit("-"), word(F.dayofmonth(s) + 1), F.lit(", "), word(F.year(s))))
        .when(n == 3, F.concat(word(F.year(s)), F.lit(": "), word(F.dayofmonth(s)), F.date_format(s, " MMM"))).otherwise("soon")
    )
    iso = F.date_format(F.date_add(s.cast("date"), (F.col("l_quantity").cast("int") % 3)), "yyyy-MM-dd")
    rows = l.select("l_orderkey", "l_linenumber", F.inline(F.array(F.struct(iso.alias("iso"), F.concat(F.lit("Held "), shown, F.lit(".")).alias("source"))))).withColumn("low", F.lower("source"))
    return rows.select("l_orderkey", "l_linenumber", dates.found_in(F.col("iso"), F.col("source"), F.col("low")).alias("found"))


# --- answers ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN '{\"topics\":[' || replace(props, ' ', '') || ']}' END ELSE replace(props, ' ', '') END AS found FROM events")
def json_tolerant_parse(spark, sf):
    """Properties as a model might answer them: bare, fenced, within words, cut off, and as a list with or without a key for it."""
    e = table(spark, sf, "events").select("event_id", "props")
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), "props", F.lit(" I think {"))).when(k == 3, F.concat(F.lit("} "), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    value = e.select("event_id", answers.json_of(said).alias("v"))
    return value.select("event_id", F.when(F.col("event_id") % 2 == 0, answers.object_of(F.col("v"), "topics")).otherwise(answers.object_of(F.col("v"))).alias("found"))


@query("""SELECT o_orderkey, (o_orderstatus = 'F')::INT + (o_orderpriority LIKE '1%')::INT + (o_custkey % 3 = 0)::INT + 9 AS nulls, 13 AS total,
  4 - (o_orderstatus = 'F')::INT - (o_orderpriority LIKE '1%')::INT - (o_custkey % 3 = 0)::INT + (o_custkey % 2)::INT AS filled, 16
  AS of FROM orders""")
def record_counts(spark, sf):
    """Records merged from answers with some members missing: empty fields, filled fields."""
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    basic = F.to_json(F.struct(name.alias("full_name"), F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")).alias("city"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("int")).alias("edition_number"), F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit("x"))).alias("topics")))
    none = F.lit(None).cast("string")
    r = o.select("o_orderkey", records.merge(F.col("o_orderkey").cast("string"), basic, none, none).alias("r"))
    return r.select("o_orderkey", records.null_fields(F.col("r"))["nulls"].alias("nulls"), records.null_fields(F.col("r"))["total"].alias("total"), records.filled_fields(F.col("r"))["filled"].alias("filled"), records.filled_fields(F.col("r"))["total"].alias("of"))


# --- matching --------------------------------------------------------------------------------------------------------------


def _lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence of two ASCII texts, row by row of the usual table."""
    inner = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({y}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN ascii({y}[j[1]])::BIGINT = c[1] THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], acc[j[1]]) END))"
    return f"list_reduce(list_prepend(list_transform(range(len({y}) + 1), lambda k: 0::BIGINT), list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT])), lambda old, c: {inner})[-1]"


def _token_set(x: str, y: str, source: str, keys: str) -> str:
    """Common table expressions ts0 and ts: keys and token_set of two columns of lower-case words."""
    return f"""
ts0 AS (SELECT {keys}, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared, array_to_string(list_sort(list_filter(a, lambda t: NOT list_contains(b, t))), ' ') AS p, array_to_string(list_sort(list_filter(b, lambda t: NOT list_contains(a, t))), ' ') AS q
  FROM (SELECT {keys}, list_distinct(string_split({x}, ' ')) AS a, list_distinct(string_split({y}, ' ')) AS b FROM {source})),
ts1 AS (SELECT *, (shared <> '')::INT AS gap, len(shared) AS size, {_lcs("p", "q")} AS m FROM ts0),
ts AS (SELECT {keys}, CASE WHEN gap = 1 AND (p = '' OR q = '') THEN 100 ELSE round_even(greatest(100 - 100.0 * (len(p) + len(q) - 2 * m) / (2 * (size + gap) + len(p) + len(q)),
    CASE WHEN gap = 1 THEN 100 - 100.0 * (1 + len(p)) / (2 * size + 1 + len(p)) END, CASE WHEN gap = 1 THEN 100 - 100.0 * (1 + len(q)) / (2 * size + 1 + len(q)) END), 0)::INT END AS token_set FROM ts1)"""


@query("""SELECT p_partkey, contains(lower(p_name), lower(o)) OR contains(lower(o), lower(p_name)) AS within, lower(p_brand) = lower('BRAND#' || p_size) AS same
FROM (SELECT *, split_part(p_name, ' ', 1 + (p_partkey % 2)::INT) || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS o FROM part)""")
def exact_match(spark, sf):
    """A word of a part's name, one in three with a letter more, within the name; brands by the acronym matcher."""
    p = table(spark, sf, "part").withColumn("o", F.concat(F.element_at(F.split("p_name", " "), (1 + F.col("p_partkey") % 2).cast("int")), F.when(F.col("p_partkey") % 3 == 0, "s").otherwise("")))
    name, other = text.event_name(F.lower("p_name")), text.event_name(F.lower("o"))
    return p.select("p_partkey", scoring.within(name, other).alias("within"), scoring.same_acronym(F.col("p_brand"), F.concat(F.lit("BRAND#"), "p_size")).alias("same"))


_NEXT = "nx AS (SELECT a.p_partkey, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT count(*) FROM part))"


@query(f"""WITH {_NEXT}, {_token_set("x", "y", "nx", "p_partkey")},
st AS (SELECT p_partkey, array_to_string(list_sort(string_split(x, ' ')), ' ') AS x, array_to_string(list_sort(string_split(y, ' ')), ' ') AS y FROM nx),
so AS (SELECT p_partkey, round_even(200.0 * {_lcs("x", "y")} / (len(x) + len(y)), 0)::INT AS token_sort FROM st),
sl AS (SELECT p_partkey, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS s, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS l FROM nx UNION ALL SELECT p_partkey, y, x FROM nx WHERE len(x) = len(y)),
w AS (SELECT DISTINCT p_partkey, s, substr(l, greatest(i, 1)::INT, (least(i + len(s) - 1, len(l)) - greatest(i, 1) + 1)::INT) AS w FROM (SELECT *, unnest(range(2 - len(s), len(l) + 1)) AS i FROM sl)),
pa AS (SELECT p_partkey, round_even(max(200.0 * {_lcs("s", "w")} / (len(s) + len(w))), 0)::INT AS partial FROM w GROUP BY p_partkey)
SELECT p_partkey, partial, token_sort, token_set FROM pa JOIN so USING (p_partkey) JOIN ts USING (p_partkey)""")
def fuzzy_match(spark, sf):
    """Each part's name against the next one's (the last against the first), by all three similarities."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    last = p.agg(F.count("*").alias("n"))
    following = p.join(F.broadcast(last)).select(F.pmod(F.col("p_partkey") - 1, F.col("n")).alias("p_partkey"), F.col("p_name").alias("other"))  # one row
    a, b = F.col("p_name"), F.col("other")
    return p.join(following, "p_partkey").select("p_partkey", similarity.partial_ratio(a, b).alias("partial"), similarity.token_sort_ratio(a, b).alias("token_sort"), similarity.token_set_ratio(a, b).alias("token_set"))


@query(f"""WITH nm AS (SELECT p_partkey, lower(p_name) || ' ' || replace(lower(p_brand), '#', ' ') AS g, split_part(lower(p_name), ' ', 2) || ' ' || split_part(lower(p_name), ' ', 1) || ' ' || replace(lower(p_brand), '#', ' ') AS r FROM part),
tx AS (SELECT a.p_partkey, k, CASE k WHEN 0 THEN a.g ELSE c.g END AS x, b.r AS y FROM nm a JOIN nm b ON b.p_partkey = a.p_partkey + 1 JOIN nm c ON c.p_partkey = a.p_partkey + 2, (VALUES (0), (1)) v(k)),
{_token_set("x", "y", "tx", "p_partkey, k")}
SELECT tx.p_partkey, bool_or(contains(x, y) OR contains(y, x) OR token_set >= 85) AS matched, max(token_set) >= 70 AS near FROM tx JOIN ts USING (p_partkey, k) GROUP BY tx.p_partkey""")
def string_match(spark, sf):
    """Names and brands by the string matcher, words in another order, with an alias; and which are alike at all."""
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("g"), F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" "), F.element_at(F.split("p_name", " "), 1), F.lit(" "), "p_brand").alias("r"))
    pred = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("r").alias("pred"))
    alias = p.select((F.col("p_partkey") - 2).alias("p_partkey"), F.array("g").alias("aliases"))
    rows = p.select("p_partkey", F.col("g").alias("gold"), F.lit("string").alias("matcher")).join(pred, "p_partkey").join(alias, "p_partkey")
    spaced = lambda c: F.lower(F.replace(c, F.lit("#"), F.lit(" ")))
    near = similarity.token_set_best(F.transform(F.concat(F.array("gold"), "aliases"), spaced), spaced(F.col("pred"))) >= 70
    return scoring.decide(rows, aliases="aliases").select("p_partkey", "matched", near.alias("near"))


@query(f"""SELECT o_orderkey, 'date' AS matcher, o_orderkey % 8 < 6 AS matched FROM orders UNION ALL SELECT o_orderkey, 'edition', o_orderkey % 4 < 2 FROM orders
UNION ALL SELECT o_orderkey, 'country', o_orderkey % 3 < 2 FROM orders UNION ALL SELECT o_orderkey, 'topic', o_orderkey % 4 < 3 FROM orders UNION ALL SELECT o_orderkey, 'speaker', o_orderkey % 4 <> 3 FROM orders""")
def matcher_kinds(spark, sf):
    """Pairs for the matchers of dates, editions, countries, topics and speakers, some the same in another form, some not."""
    k = F.col("o_orderkey")
    of = lambda *xs: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)), (k % len(xs) + 1).cast("int"))
    word = k.cast("string")
    pair = lambda m, g, p: F.struct(F.lit(m).alias("matcher"), g.alias("gold"), p.alias("pred"))
    rows = table(spark, sf, "orders").withColumn("written", _written()).select("o_orderkey", F.inline(F.array(
        pair("date", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("written")),
        pair("edition", word, of(word, F.concat(F.lit(" +"), word, F.lit(" ")), (k + 1).cast("string"), F.concat(word, F.lit(".5")))),
        pair("country", of("USA", "England", "Germany"), of("United States of America", "UK", "Greece")),
        pair("topic", F.lit("Deep learning systems"), of("systems, deep learning", "Deep Learning", "Deep learning system", "machine vision")),
        pair("speaker", F.lit("Prof. Dr. José Núñez"), of("Jose Nunez, PhD", "Núñez José", "José M. Núñez", "Maria Nuñes")),
    )))
    return scoring.decide(rows).select("o_orderkey", "matcher", "matched")


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey % 7) FILTER (l_linenumber % 2 = 0) AS g, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey % 7) FILTER (l_linenumber % 2 = 1) AS p FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, coalesce(g, []) AS g, coalesce(p, []) AS p FROM l),
u AS (SELECT *, list_reduce(list_prepend([]::BIGINT[], list_transform(g, lambda v: [v])), lambda used, v:
    CASE WHEN len(list_filter(range(1, len(p) + 1), lambda j: NOT list_contains(used, j) AND abs(p[j] - v[1]) <= 1)) = 0 THEN used
      ELSE list_append(used, list_filter(range(1, len(p) + 1), lambda j: NOT list_contains(used, j) AND abs(p[j] - v[1]) <= 1)[1]) END) AS used FROM s)
SELECT l_orderkey, len(used)::BIGINT AS tp, (len(p) - len(used))::BIGINT AS fp, (len(g) - len(used))::BIGINT AS fn FROM u""")
def greedy_list_match(spark, sf):
    """Parts of an order's even and odd lines matched one to one where their classes are neighbours, so that order tells; a list may be empty."""
    v = F.struct(F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 7).alias("v"))
    side = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == r, v))), lambda x: x["v"])
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(side(0).alias("g"), side(1).alias("p"))
    m = o.select("l_orderkey", scoring.greedy(F.transform("g", lambda a: F.transform("p", lambda b: F.abs(a - b) <= 1)), F.size("p")).alias("m"))
    return m.select("l_orderkey", *(F.col(f"m.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")))


# --- verification ----------------------------------------------------------------------------------------------------------


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records; their source names the customer, the date in an order in four, the publisher with a letter wrong or not at all, and of two speakers and members one."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Dealt out before records are made: a file of few row groups has few tasks, and a record takes far longer than a key.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), o.rdd.getNumPartitions())
    o = o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").repartition(tasks, "o_orderkey")
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    basic = F.to_json(F.struct(F.col("c_name").alias("full_name"), day.alias("start_date"), F.lit("Cambridge Press").alias("publisher")))
    people = lambda key, *names: F.to_json(F.struct(F.array(*(F.struct(n.alias("name")) for n in names)).alias(key)))
    speakers = people("keynote_speakers", F.lit("Ann Lee"), F.when(k % 5 == 0, "Qzx Vwk").otherwise("Ann Lea"), F.lit(""))
    committee = people("program_committee", F.lit("Bob Ray"), F.lit("Qzx Vwk"), F.lit(""))
    press = F.when(k % 3 == 0, " Cambridge Press").when(k % 3 == 1, " Cambridge Prass").otherwise(" 0123456789")
    source = F.concat(F.lit("For "), F.lower("c_name"), press, F.when(k % 4 == 0, F.concat(F.lit(" on "), F.date_format("o_orderdate", "dd MMMM yyyy"))).otherwise(""), F.lit(" with ANN LEE, bob ray"))
    r = o.select("o_orderkey", records.merge(F.lit("u"), basic, speakers, committee).alias("record"), source.alias("source"))
    return verify.validate(r)


_LEVELS = """
v AS (SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'high' ELSE 'low' END AS start_date, ['high', 'medium', 'low'][(o_orderkey % 3)::INT + 1] AS publisher,
    CASE WHEN o_orderkey % 5 = 0 THEN 'low' ELSE 'medium' END AS second FROM orders JOIN customer ON c_custkey = o_custkey)
"""


@query(f"""WITH {_LEVELS} SELECT o_orderkey, 'high' AS full_name, start_date, publisher, 'high' AS first_speaker, second AS second_speaker, 16 AS n,
  concat_ws('; ', CASE WHEN start_date = 'low' THEN '[source] low confidence: dates.start_date' END, CASE WHEN publisher = 'low' THEN '[source] low confidence: publication.publisher' END, CASE WHEN second = 'low' THEN '[source] low confidence: keynote_speakers[1].name' END,
    '[source] low confidence: program_committee[1].name', '[source] low confidence: program_committee[2].name') AS warnings FROM v""")
def confidence_levels(spark, sf):
    v = _verified(spark, sf)
    level = lambda p: F.element_at(F.map_from_entries("confidence"), p)
    return v.select(
        "o_orderkey", level("conference.full_name").alias("full_name"), level("dates.start_date").alias("start_date"), level("publication.publisher").alias("publisher"),
        level("keynote_speakers[0].name").alias("first_speaker"), level("keynote_speakers[1].name").alias("second_speaker"), F.size("confidence").alias("n"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query(f"""WITH {_LEVELS} SELECT o_orderkey, c_name AS full_name, CASE WHEN start_date = 'high' THEN day END AS start_date, CASE WHEN publisher <> 'low' THEN 'Cambridge Press' END AS publisher,
  CASE WHEN second = 'low' THEN 'Ann Lee|' ELSE 'Ann Lee|Ann Lea|' END AS speakers, 'Bob Ray' AS members FROM v""")
def nullify_low(spark, sf):
    names = lambda c: F.array_join(F.transform(F.col(f"record.{c}"), lambda x: x["name"]), "|")
    return _verified(spark, sf).select("o_orderkey", "record.conference.full_name", "record.dates.start_date", "record.publication.publisher", names("keynote_speakers").alias("speakers"), names("program_committee").alias("members"))


# --- evaluation of runs ----------------------------------------------------------------------------------------------------

_RUNS = """
e AS (SELECT o_orderkey AS seq, o_orderpriority AS model, 'HTTP://www.Site' || (o_custkey % 40) || '.org/' AS url, CASE WHEN o_orderkey % 13 = 0 THEN 'error' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'ok' END AS status,
    o_orderkey % 19 = 0 AS failed, (o_custkey % 7)::DOUBLE AS sec, (o_custkey % 3)::INT AS attempts, o_orderstatus AS backend FROM orders),
x AS (SELECT *, CASE WHEN replace(lower(url), 'http://www.', '') NOT IN (SELECT 'site' || n_nationkey || '.org/' FROM nation) THEN 'missing' WHEN status = 'error' THEN 'crashed' WHEN failed THEN 'fetch_failed' ELSE 'scored' END AS scored_as FROM e)
"""


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 13 == 0, "error").when(k % 17 != 0, "ok")
    said = F.when(k % 19 == 0, F.array(F.lit("Could not fetch any pages"))).otherwise(F.array().cast("array<string>"))
    e = o.select(k.alias("seq"), F.col("o_orderpriority").alias("model"), F.concat(F.lit("HTTP://www.Site"), c % 40, F.lit(".org/")).alias("url"), status.alias("status"), said.alias("warnings"), (c % 7).cast("double").alias("elapsed_sec"), (c % 3).cast("int").alias("attempts"), F.col("o_orderstatus").alias("backend"), F.array().cast("array<string>").alias("vllm_extra_args"))
    gold = table(spark, sf, "nation").select(text.url_key(F.concat(F.lit("https://site"), "n_nationkey", F.lit(".org"))).alias("url_key"))
    return e, gold


@query(f"WITH {_RUNS} SELECT model, scored_as, count(*) AS n FROM x GROUP BY ALL")
def entry_labels(spark, sf):
    return scoring.label(*_runs(spark, sf)).groupBy("model", "scored_as").agg(F.count("*").alias("n"))


@query(f"""WITH {_RUNS} SELECT model, count(*) AS n_entries, count(*) FILTER (status IS DISTINCT FROM 'ok') AS errors, count(*) FILTER (failed) AS fetch_failures,
  round(avg(sec) FILTER (status = 'ok'), 9) AS avg_latency_sec, round(avg(attempts) FILTER (status = 'ok'), 9) AS avg_attempts, arg_min(backend, seq) AS backend FROM x WHERE scored_as <> 'missing' GROUP BY model""")
def run_stats(spark, sf):
    out = scoring.run_stats(scoring.label(*_runs(spark, sf)).where("scored_as <> 'missing'"))
    return out.select("model", "n_entries", "errors", "fetch_failures", F.round("avg_latency_sec", 9).alias("avg_latency_sec"), F.round("avg_attempts", 9).alias("avg_attempts"), "backend")


@query("""SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_linenumber % 2 = 0 THEN '''acronym'' is a required property' END, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey || ' is not of type ''string''' END,
  CASE WHEN l_suppkey % 2 = 0 THEN '''publication'' is a required property' END, CASE WHEN l_suppkey % 5 = 0 THEN l_quantity::INT || ' is not of type ''string''' END) AS messages FROM lineitem""")
def record_shape(spark, sf):
    """Records as JSON, some without a member or section, some with numbers for texts."""
    part, n, s = F.col("l_partkey").cast("string"), F.col("l_linenumber"), F.col("l_suppkey")
    name = F.when(n % 3 == 0, part).otherwise(F.concat(F.lit('"'), part, F.lit('"')))
    acronym = F.when(n % 2 == 0, "").otherwise('"acronym":"a",')
    topic = F.when(s % 5 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise('"t"')
    last = F.when(s % 2 == 0, "").otherwise(',"publication":{"publisher":null}')
    doc = F.concat(F.lit('{"conference":{"full_name":'), name, F.lit(","), acronym, F.lit('"url":"u","edition_number":null},"dates":{},"venue":{},"deadlines":{},"topics":['), topic, F.lit('],"keynote_speakers":[],"program_committee":[]'), last, F.lit("}"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", doc.alias("doc"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(records.shape_errors(F.col("doc")), "; ").alias("messages"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS model, list(l_partkey % 4 ORDER BY l_linenumber) FILTER (l_linenumber % 2 = 0) AS g, list(l_partkey % 4 ORDER BY l_linenumber) FILTER (l_linenumber % 2 = 1) AS p FROM lineitem GROUP BY ALL),
t AS (SELECT k, model, coalesce(len(g), 0) AS n, coalesce(len(p), 0) AS m, list_sum(list_transform(range(0, 4), lambda v: least(len(list_filter(coalesce(g, []), lambda x: x = v)), len(list_filter(coalesce(p, []), lambda x: x = v))))) AS tp FROM l)
SELECT model, sum(tp)::BIGINT AS tp, sum(n - tp)::BIGINT AS fn, sum(m - tp)::BIGINT AS fp_wrong, count(*) FILTER (n = 0 AND m = 0) AS tn FROM t GROUP BY model""")
def list_scores(spark, sf):
    """Lists of speakers, by the whole scoring path: pairs decided, matched greedily, counted."""
    names = ["alpha", "beta", "gamma", "delta"]
    person = F.struct(F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 4 + 1).cast("int")).alias("name"))
    side = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == r, F.struct("l_linenumber", person.alias("p"))))), lambda x: x["p"])
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("model")).agg(side(0).alias("g"), side(1).alias("p"))
    none = F.array().cast("array<string>")
    record = lambda c: F.struct(none.alias("topics"), F.col(c).alias("keynote_speakers"), F.array().cast("array<struct<name:string>>").alias("program_committee"))
    scored = rows.select("k", "model", record("g").alias("ground_truth"), record("p").alias("data"))
    out = scoring.list_counts(scored, ["k", "model"]).where("path = 'keynote_speakers'")
    return out.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp_wrong", "tn")))


_EVALUATED = f"""
{_RUNS},
y AS (SELECT model, seq FROM x WHERE scored_as = 'scored'),
f AS (SELECT model, 'identity' AS category, 'conference.full_name' AS path, 'tp' AS o FROM y
  UNION ALL SELECT model, 'identity', 'conference.acronym', CASE WHEN seq % 5 = 1 THEN 'tp' ELSE 'fp_wrong' END FROM y
  UNION ALL SELECT model, 'identity', 'conference.edition_number', CASE WHEN seq % 2 = 0 THEN 'fp_halluc' ELSE 'tn' END FROM y
  UNION ALL SELECT model, 'dates', 'dates.start_date', CASE WHEN seq % 4 = 0 THEN 'fn' WHEN seq % 3 = 1 THEN 'tp' ELSE 'fp_wrong' END FROM y
  UNION ALL SELECT model, category, path, 'tn' FROM y, (VALUES ('dates', 'dates.end_date'), ('location', 'venue.city'), ('location', 'venue.country'), ('dates', 'deadlines.submission'), ('dates', 'deadlines.notification'),
    ('dates', 'deadlines.camera_ready'), ('publication', 'publication.publisher'), ('publication', 'publication.series'), ('speakers', 'keynote_speakers'), ('committee', 'program_committee')) v(category, path)
  UNION ALL SELECT model, 'topics', 'topics', o FROM y, (VALUES ('tp'), ('fp_wrong')) v(o) WHERE seq % 3 <> 0 UNION ALL SELECT model, 'topics', 'topics', 'fn' FROM y WHERE seq % 3 = 0),
c AS (SELECT model, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(path) = 0 THEN 'field' ELSE 'overall' END AS grain, coalesce(category, path, 'all') AS name, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fn') AS fn,
    count(*) FILTER (o = 'fp_wrong') AS fp_wrong, count(*) FILTER (o = 'fp_halluc') AS fp_halluc, count(*) FILTER (o = 'tn') AS tn FROM f GROUP BY GROUPING SETS ((model), (model, category), (model, path))),
r AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp_wrong + fp_halluc, 0), 0) AS p, coalesce(tp / nullif(tp + fn + fp_wrong, 0), 0) AS q FROM c))
"""


def _evaluated(spark: SparkSession, sf: str) -> evaluation.Evaluation:
    """Runs whose records have some fields right, wrong, missing or made up, against a gold record for each nation."""
    e, g = _runs(spark, sf)
    none, k = F.lit(None).cast("string"), F.col("seq")
    number = F.regexp_extract("url", r"(\d+)", 1)
    day = F.when(k % 4 != 0, F.concat(F.lit("2026-01-0"), (k % 3 + 1).cast("string")))
    topics = F.when(k % 3 != 0, F.array(F.lit("b a"), F.lit("zz yy"))).otherwise(F.array().cast("array<string>"))
    told = F.struct(F.concat(F.lit("Meeting "), number).alias("full_name"), F.concat(F.lit("m"), k % 5).alias("acronym"), day.alias("start_date"), F.when(k % 2 == 0, (k % 6).cast("int")).alias("edition_number"), topics.alias("topics"))
    entries = e.withColumn("data", records.merge(F.lit("u"), F.to_json(told), none, none))
    true = F.struct(F.concat(F.lit("The Meeting "), F.regexp_extract("url_key", r"(\d+)", 1)).alias("full_name"), F.lit("M1").alias("acronym"), F.lit("2 Jan 2026").alias("x"), F.lit("2026/1/2").alias("start_date"), F.array(F.lit("a b")).alias("topics"))
    gold = g.select("url_key", records.merge(F.lit("u"), F.to_json(true), none, none).alias("ground_truth"), F.lit(None).cast("map<string,array<string>>").alias("aliases"))
    return evaluation.evaluate(entries, gold)


@query(f"WITH {_EVALUATED} SELECT model, grain, name, tp, fn, fp_wrong, fp_halluc, tn, round(f1, 9) AS f1 FROM r")
def evaluate_fields(spark, sf):
    """The whole scoring path, as the command runs it: labels, matchers, lists, counts at three grains."""
    return _evaluated(spark, sf).counts.select("model", "grain", "name", *scoring.COUNTS, F.round("f1", 9).alias("f1"))


@query(f"""WITH {_EVALUATED}, m AS (SELECT model, avg(f1) AS macro_f1 FROM r WHERE grain = 'category' GROUP BY model), n AS (SELECT model, count(*) AS n FROM y GROUP BY model),
t AS (SELECT model, count(*) FILTER (status IS DISTINCT FROM 'ok') AS errors, count(*) FILTER (failed) AS fetch_failures FROM x WHERE scored_as <> 'missing' GROUP BY model)
SELECT model, n AS n_examples, errors, fetch_failures, round(macro_f1, 9) AS macro_f1 FROM n JOIN m USING (model) JOIN t USING (model)""")
def evaluate_models(spark, sf):
    return _evaluated(spark, sf).models.select("model", "n_examples", "errors", "fetch_failures", F.round("macro_f1", 9).alias("macro_f1"))
