"""Runs evaluated against a gold set: labelled, scored, rolled up, ranked and told."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..schemas import CATEGORIES


class Evaluation(NamedTuple):
    labelled: DataFrame
    fields: DataFrame
    counts: DataFrame
    models: DataFrame


def evaluate(entries: DataFrame, gold: DataFrame) -> Evaluation:
    """entries has ENTRY's columns and seq, gold url_key, ground_truth and aliases."""
    labelled = S.label(entries, gold)
    scored = labelled.where("scored_as = 'scored'").select("model", "url", "seq", "ground_truth", "aliases", "data")
    keys = ["model", "url", "seq"]
    scalars = S.scalar_outcomes(S.scalar_rows(scored, keys))
    lists = S.list_counts(scored, keys)
    shown = [*keys, "path", "category"]
    fields = scalars.select(*shown, "outcome", "gold", "pred", *S.COUNTS).unionByName(lists.select(*shown, *S.COUNTS), allowMissingColumns=True)
    counts = S.with_ratios(S.rollup(fields.select("model", "category", "path", *S.COUNTS)))
    n = scored.groupBy("model").agg(F.count("*").alias("n_examples"))
    models = entries.select("model").distinct().join(S.run_stats(labelled.where("scored_as <> 'missing'")), "model", "left")
    models = models.join(n, "model", "left").join(S.macro_f1(counts), "model", "left").fillna(0, ["n_examples", "errors", "fetch_failures", "avg_latency_sec", "avg_attempts", "macro_f1"])
    return Evaluation(labelled, fields, counts, models)


def differences(found: Evaluation) -> DataFrame:
    """Fields that are not as the gold set has them."""
    return found.fields.where("outcome not in ('tp', 'tn') or (outcome is null and (fp_wrong > 0 or fn > 0))")


def as_dicts(found: Evaluation) -> list[dict]:
    """One nested dict for each model, best first: small tables, collected for a report."""
    counts: dict[str, dict] = {}
    for r in found.counts.collect():
        c = {k: r[k] for k in [*S.COUNTS, "precision", "recall", "f1", "support", "hallucination_rate"]}
        place = counts.setdefault(r["model"], {"overall": {k: 0 for k in c}, "by_category": {}, "by_field": {}})
        if r["grain"] == "overall":
            place["overall"] = c
        else:
            place["by_" + r["grain"]][r["name"]] = c
    zero = {**{k: 0 for k in [*S.COUNTS, "support"]}, **{k: 0.0 for k in ("precision", "recall", "f1", "hallucination_rate")}}
    return [
        {
            "model": m["model"], "backend": m["backend"] or "", "vllm_extra_args": m["vllm_extra_args"] or [], "n_examples": m["n_examples"], "macro_f1_categories": m["macro_f1"],
            "avg_latency_sec": m["avg_latency_sec"], "avg_attempts": m["avg_attempts"], "errors": m["errors"], "fetch_failures": m["fetch_failures"],
            **counts.get(m["model"], {"overall": zero, "by_category": {}, "by_field": {}}),
        }
        for m in S.ranking(found.models).collect()
    ]


def model_line(m: dict) -> str:
    """A model on one line."""
    parts = [f"{c[:4]}={100 * m['by_category'][c]['f1']:5.1f}" if c in m["by_category"] else f"{c[:4]}=  -  " for c in CATEGORIES]
    return f"{m['model']:<40} macro_F1={100 * m['macro_f1_categories']:5.1f}  {'  '.join(parts)}  n={m['n_examples']}"


def report(models: list[dict]) -> str:
    """The models as a text: ranking, counts over all fields, and each category."""
    pct = lambda x: f"{100 * x:5.1f}"
    out = ["Evaluation summary", "", "By macro-F1 over categories"]
    out.append(f"{'model':<40} {'macro_F1':>9}  " + "  ".join(f"{c[:8]:>8}" for c in CATEGORIES) + f"  {'n':>3}")
    for m in models:
        cells = [f"{pct(m['by_category'][c]['f1']) if c in m['by_category'] else '-':>8}" for c in CATEGORIES]
        out.append(f"{m['model']:<40} {pct(m['macro_f1_categories']):>9}  " + "  ".join(cells) + f"  {m['n_examples']:>3}")
    out += ["", "All fields"]
    names = ["P", "R", "F1", "TP", "FN", "FPw", "FPh", "TN", "halluc%", "err", "fetch", "t,s"]
    out.append(f"{'model':<40} " + " ".join(f"{n:>7}" for n in names))
    for m in models:
        o = m["overall"]
        values = [pct(o["precision"]), pct(o["recall"]), pct(o["f1"]), o["tp"], o["fn"], o["fp_wrong"], o["fp_halluc"], o["tn"], pct(o["hallucination_rate"]), m["errors"], m["fetch_failures"], f"{m['avg_latency_sec']:.1f}"]
        out.append(f"{m['model']:<40} " + " ".join(f"{v!s:>7}" for v in values))
    out += ["(err: runs that broke; fetch: sites without pages; neither is scored)", "", "By category"]
    for m in models:
        out.append(f"  {m['model']}")
        for c in CATEGORIES:
            k = m["by_category"].get(c)
            if not k or not k["tp"] + k["fn"] + k["fp_wrong"] + k["fp_halluc"]:
                out.append(f"    {c:<12} (no data)")
            else:
                out.append(f"    {c:<12} P={pct(k['precision'])}  R={pct(k['recall'])}  F1={pct(k['f1'])}  TP={k['tp']} FN={k['fn']} FPw={k['fp_wrong']} FPh={k['fp_halluc']} TN={k['tn']}")
    return "\n".join(out)
