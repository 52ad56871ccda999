"""Predictions scored against a gold set: matchers, outcomes, counts at three grains, and what follows from them.

Scalars and list items are compared as rows, so a matcher's similarity function
sees only pairs that no expression has decided. Counts are one aggregation over
grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import any_date
from ..functions.similarity import token_set_best, token_sort_ratio
from ..functions.text import country_code, event_name, person_name, plain_letters, strip, url_key
from ..schemas import CATEGORIES, LIST_FIELDS, SCALAR_FIELDS

# Least similarities, and the warning of a site without pages.
STRING, TOPIC, PERSON = 85, 78, 88
NO_PAGES = "Could not fetch any pages"
#: Stands between the texts of a row; none holds it.
_BETWEEN = "\x1f"
COUNTS = ["tp", "fn", "fp_wrong", "fp_halluc", "tn"]


def absent(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def same_edition(a: Column, b: Column) -> Column:
    whole = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$"), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("long"))
    return F.coalesce(whole(a) == whole(b), F.lit(False))


def same_date(a: Column, b: Column) -> Column:
    return F.coalesce(any_date(a) == any_date(b), F.lit(False))


def same_acronym(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def within(a: Column, b: Column) -> Column:
    """Neither is empty, and one holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def decide(pairs: DataFrame, matcher: str = "matcher", gold: str = "gold", pred: str = "pred", aliases: str | None = None) -> DataFrame:
    """pairs with matched: whether gold and pred are the same by the row's matcher (see schemas.Field).

    aliases names an array of other forms of gold, which strings and countries
    may match.
    """
    names = pairs.columns
    kind, g, p = F.col(matcher), F.col(gold), F.col(pred)
    none = F.array().cast("array<string>")
    texts = F.array(g) if aliases is None else F.concat(F.array(g), F.when(kind.isin("string", "country"), F.coalesce(F.col(aliases), none)).otherwise(none))
    early = F.when(kind == "date", same_date(g, p)).when(kind == "acronym", same_acronym(g, p)).when(kind == "edition", same_edition(g, p))
    early = early.when((kind == "country") & F.coalesce(country_code(g) == country_code(p), F.lit(False)), F.lit(True))
    rows = pairs.withColumn("_early", F.when(g.isNull() | p.isNull(), F.lit(False)).otherwise(early))
    # All of a row's texts go through the accents' function as one, so the row stays one.
    rows = rows.withColumn("_all", plain_letters(F.when(F.col("_early").isNull(), F.array_join(texts, _BETWEEN)))).withColumn("_one", plain_letters(F.when(F.col("_early").isNull(), p)))
    named = lambda c: F.when(kind == "speaker", person_name(c)).otherwise(event_name(c))
    rows = rows.withColumn("_gs", F.filter(F.transform(F.split("_all", _BETWEEN, -1), named), lambda t: t != "")).withColumn("_p", named(F.col("_one")))
    near = F.when(kind == "speaker", F.array_contains("_gs", F.col("_p"))).otherwise(F.exists("_gs", lambda t: within(t, F.col("_p"))))
    empty = (F.size("_gs") == 0) | (F.col("_p") == "")
    rows = rows.withColumn("_near", F.when(F.col("_early").isNotNull(), F.col("_early")).when(empty, F.lit(False)).when(near, F.lit(True)))
    # What is decided does not reach the similarity functions: they get nulls, which cost nothing.
    open_ = F.col("_near").isNull()
    rows = rows.withColumn("_set", token_set_best(F.when(open_ & (kind != "topic"), F.col("_gs")), F.when(open_ & (kind != "topic"), F.col("_p"))))
    rows = rows.withColumn("_sort", token_sort_ratio(F.when(open_ & (kind == "topic"), F.get("_gs", F.lit(0))), F.when(open_ & (kind == "topic"), F.col("_p"))))
    least = F.when(kind == "speaker", F.col("_set") >= PERSON).when(kind == "topic", F.col("_sort") >= TOPIC).otherwise(F.col("_set") >= STRING)
    return rows.select(*names, F.coalesce("_near", least, F.lit(False)).alias("matched"))


def greedy(matrix: Column, predictions: Column) -> Column:
    """tp, fp and fn of a list's matches: each gold item in turn takes the first prediction left that it matches.

    matrix is an array over gold items of arrays over predictions, of which there are so many.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))

    def take(a: Column, row: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: F.get(row, i) & ~F.array_contains(a["used"], i))
        free = F.when(F.size(row) > 0, free).otherwise(F.array().cast("array<int>"))
        hit = F.size(free) > 0
        return F.struct(F.when(hit, F.array_append(a["used"], F.get(free, F.lit(0)))).otherwise(a["used"]).alias("used"), (a["tp"] + hit.cast("int")).alias("tp"))

    return F.aggregate(matrix, start, take, lambda a: F.struct(a["tp"].alias("tp"), (predictions - a["tp"]).alias("fp"), (F.size(matrix) - a["tp"]).alias("fn")))


def label(entries: DataFrame, gold: DataFrame) -> DataFrame:
    """entries with url_key and scored_as: missing (no gold), crashed, fetch_failed or scored; gold has one row for each url_key.

    The gold set is a dimension: Spark broadcasts it where its size allows.
    """
    failed = F.coalesce(F.exists("warnings", lambda w: F.contains(w, F.lit(NO_PAGES))), F.lit(False))
    rows = entries.withColumn("url_key", url_key(F.coalesce("url", F.lit("?"))))
    met = rows.join(gold.drop("url").withColumn("_there", F.lit(True)), "url_key", "left")
    kind = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(F.col("status") == "error", F.lit(False)), "crashed").when(failed, "fetch_failed").otherwise("scored")
    return met.withColumn("scored_as", kind).drop("_there")


def scalar_rows(scored: DataFrame, keys: list[str], gold: str = "ground_truth", pred: str = "data") -> DataFrame:
    """keys, path, category, matcher, gold, pred and aliases: a row for each scalar field."""
    value = lambda r, path: F.col(r)[path.split(".")[0]][path.split(".")[1]].cast("string")
    names = F.col("aliases") if "aliases" in scored.columns else F.lit(None).cast("map<string,array<string>>")
    each = [F.struct(F.lit(f.path).alias("path"), F.lit(f.category).alias("category"), F.lit(f.matcher).alias("matcher"), value(gold, f.path).alias("gold"), value(pred, f.path).alias("pred"), F.element_at(names, F.lit(f.path)).alias("aliases")) for f in SCALAR_FIELDS]
    return scored.select(*keys, F.inline(F.array(*each)))


def outcome(gold: Column, pred: Column, matched: Column) -> Column:
    g, p = absent(gold), absent(pred)
    return F.when(g & p, "tn").when(g, "fp_halluc").when(p, "fn").when(matched, "tp").otherwise("fp_wrong")


def scalar_outcomes(rows: DataFrame) -> DataFrame:
    """rows (see scalar_rows) with outcome and its counts."""
    done = decide(rows, aliases="aliases").withColumn("outcome", outcome(F.col("gold"), F.col("pred"), F.col("matched")))
    return done.withColumns({c: (F.col("outcome") == c).cast("long") for c in COUNTS})


def list_counts(scored: DataFrame, keys: list[str], gold: str = "ground_truth", pred: str = "data") -> DataFrame:
    """keys, path, category and counts of each list: its extra predictions count as wrong ones, two empty lists as one tn."""
    parts = []
    for f in LIST_FIELDS:
        text = (lambda c: c) if f.path == "topics" else (lambda c: F.transform(c, lambda x: x["name"]))
        none = F.array().cast("array<string>")
        parts.append(F.struct(F.lit(f.path).alias("path"), F.lit(f.category).alias("category"), F.lit(f.matcher).alias("matcher"), F.coalesce(text(F.col(gold)[f.path]), none).alias("g"), F.coalesce(text(F.col(pred)[f.path]), none).alias("p")))
    lists = scored.select(*keys, F.inline(F.array(*parts)))
    pairs = lists.select(*keys, "path", "matcher", F.posexplode("g").alias("i", "gold"), "p").select(*keys, "path", "matcher", "i", "gold", F.posexplode("p").alias("j", "pred"))
    cells = decide(pairs).groupBy(*keys, "path", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "matched"))), lambda x: x["matched"]).alias("row"))
    matrix = cells.groupBy(*keys, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("matrix"))
    met = lists.join(matrix, [*keys, "path"], "left").withColumn("m", greedy(F.col("matrix"), F.size("p")))
    n_g, n_p = F.size("g"), F.size("p")
    tp = F.coalesce(F.col("m.tp"), F.lit(0))
    return met.select(
        *keys, "path", "category", tp.cast("long").alias("tp"), (n_g - tp).cast("long").alias("fn"), (n_p - tp).cast("long").alias("fp_wrong"),
        F.lit(0).cast("long").alias("fp_halluc"), ((n_g == 0) & (n_p == 0)).cast("long").alias("tn"),
    )


def rollup(results: DataFrame, by: str = "model") -> DataFrame:
    """Counts over all, for each category and each path, in one aggregation: grain, name and the sums."""
    grain = F.when(F.grouping("category") == 0, "category").when(F.grouping("path") == 0, "field").otherwise("overall")
    sets = results.groupingSets([[by], [by, "category"], [by, "path"]], by, "category", "path")
    out = sets.agg(grain.alias("grain"), *(F.sum(c).alias(c) for c in COUNTS))
    return out.select(by, "grain", F.coalesce("category", "path", F.lit("all")).alias("name"), *COUNTS)


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1, support and hallucination_rate; 0 where there is nothing to divide by."""
    tp, fn, wrong, made_up, tn = map(F.col, COUNTS)
    out = counts.withColumn("precision", share(tp, tp + wrong + made_up)).withColumn("recall", share(tp, tp + fn + wrong))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r)).withColumn("support", tp + fn + wrong).withColumn("hallucination_rate", share(made_up, made_up + tn))


def macro_f1(ratios: DataFrame, by: str = "model") -> DataFrame:
    """Mean F1 over the categories that there are, those without any support as 0."""
    return ratios.where((F.col("grain") == "category") & F.col("name").isin(*CATEGORIES)).groupBy(by).agg(F.avg("f1").alias("macro_f1"))


def run_stats(matched: DataFrame) -> DataFrame:
    """model, n_entries, errors (status is not ok), fetch_failures, mean seconds and attempts of runs that are ok; backend and arguments of the first."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    failed = F.coalesce(F.exists("warnings", lambda w: F.contains(w, F.lit(NO_PAGES))), F.lit(False))
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0))
    first = F.min_by(F.struct("backend", "vllm_extra_args"), F.col("seq"))
    out = matched.groupBy("model").agg(F.count("*").alias("n_entries"), F.count_if(~ok).alias("errors"), F.count_if(failed).alias("fetch_failures"), mean("elapsed_sec").alias("avg_latency_sec"), mean("attempts").alias("avg_attempts"), first.alias("_f"))
    return out.select("*", F.coalesce("_f.backend", F.lit("")).alias("backend"), F.col("_f.vllm_extra_args").alias("vllm_extra_args")).drop("_f")


def ranking(macro: DataFrame) -> DataFrame:
    return macro.orderBy(F.desc("macro_f1"), "model")
