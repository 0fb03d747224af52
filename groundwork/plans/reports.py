"""Reports: aggregates in Spark, a few rows on the driver, Markdown."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import fixed
from groundwork.operators.sanitize import sanitation_report
from groundwork.sources.artifacts import Config, write_markdown

#: Above this ratio of mean chars the labels can be told apart by length.
MOST_RATIO = 1.15


def distribution(df: DataFrame, column: str) -> DataFrame:
    """zero, zero_share, median, mean, max."""
    x = F.col(column)
    return df.agg(F.count_if(x == 0).alias("zero"), (F.count_if(x == 0) / F.greatest(F.count("*"), F.lit(1))).alias("zero_share"), F.median(x).alias("median"), F.avg(x).alias("mean"), F.max(x).alias("max"))


def rows_of(df: DataFrame) -> list[str]:
    """A small table in Markdown."""
    data = df.collect()
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in data)]


def record_card(cfg: Config, parts: dict[str, DataFrame], path: str) -> str:
    main = parts["main"]
    n = {k: parts[k].count() for k in ("records", "labelled", "unresolved", "main")}
    folds = main.groupBy("split").pivot("label").count().fillna(0).orderBy("split")
    mode = "two rows of a gene and label" if cfg.paired else f"at most {cfg.cap} rows of a gene and label"
    lines = ["# Record set", "", f"Built {datetime.date.today().isoformat()}, assembly {cfg.assembly}.", "", f"- review status: {cfg.min_stars} stars or more", f"- types: {', '.join(cfg.types)}", f"- somatic records dropped: {cfg.drop_somatic}", f"- sampling: {mode}, seed {cfg.seed}",
             f"- passed the filters: {n['records']} ({n['labelled']} labelled, {n['unresolved']} unresolved)", f"- main set: {n['main']} over {main.select('gene').distinct().count()} genes", "", *rows_of(folds)]
    return write_markdown(lines, path)


def comment_report(records: DataFrame, raw: DataFrame, kept: DataFrame, path: str) -> str:
    s = sanitation_report(raw, "Description").first()
    per = kept.groupBy("VariationID").count()
    d = distribution(per, "count").first()
    lines = ["# Comments", "", f"- records: {records.count()}, with a usable comment: {per.count()}", f"- comments: {raw.count()}, kept after sanitation and near-dedup (exact similarity): {kept.count()}", f"- sentences: {s['sentences_in']}, kept {s['sentences_out']}, drop rate {s['drop_rate']:.1%}",
             f"- dropped by label {s['dropped_label']}, verdict {s['dropped_verdict']}, code {s['dropped_code']}", f"- comments a record: median {d['median']}, mean {d['mean']}, most {d['max']}"]
    return write_markdown(lines, path)


def budget_lines(report: DataFrame, path: str) -> str:
    rows = report.collect()
    ratio = rows[0]["char_ratio"] if rows else None
    verdict = "- no ratio: there are not two labels" if ratio is None else f"- ratio {ratio}: {'PASS' if ratio <= MOST_RATIO else 'WARN'}, the limit is {MOST_RATIO}"
    return write_markdown(["# Delivery", "", *rows_of(report), "", verdict], path)


def delivery_lines(pools: DataFrame, path: str) -> str:
    """The report on delivered pools: the table by label, and how far labels can be told apart by length."""
    rows = pools.selectExpr("label", "size(delivered) n", "aggregate(delivered, 0L, (s, e) -> s + length(e.text)) chars").where("n > 0")
    means = [r[0] for r in rows.groupBy("label").agg(F.round(F.avg("chars"), 1).alias("chars")).select("chars").collect()]  # a row for each label
    ratio = round(max(means) / min(means), 2) if len(means) == 2 and min(means) else None
    verdict = "- no ratio: there are not two labels" if ratio is None else f"- ratio {ratio}: {'PASS' if ratio <= MOST_RATIO else 'WARN'}, the limit is {MOST_RATIO}"
    return write_markdown(["# Delivery", "", *rows_of(delivery_report(pools)), "", verdict], path)


def delivery_report(pools: DataFrame) -> DataFrame:
    """Per label: means of pool size, passages, chars, and passages of the two nearest levels, to two places."""
    n = lambda level: F.size(F.filter("delivered", lambda e: e["level"] == level))
    chars = F.aggregate("delivered", F.lit(0), lambda s, e: s + F.length(e["text"]))
    mean = lambda c, name: F.round(F.avg(c), 2).alias(name)
    return pools.groupBy("label").agg(F.count("*").alias("n"), mean("pool_size", "pool"), mean(F.size("delivered"), "passages"), mean(chars, "chars"), mean(n("variant"), "record_level"), mean(n("gene"), "gene_level"))


def retrieval_report(score: DataFrame, verdict: str, path: str) -> str:
    return write_markdown(["# Retrieval", "", *rows_of(score), "", f"- {verdict}"], path)


def audit_report(parts: dict[str, DataFrame], path: str) -> str:
    a = parts["audit"].first()
    verdict = "- PASS: arms differ in their evidence alone" if not a["mismatches"] else f"- FAIL: {a['mismatches']} records"
    return write_markdown(["# Prompts", "", f"- records: {a['records']}, with every arm: {a['complete']}", verdict, "", *rows_of(parts["counts"]), "", *rows_of(parts["naming"]), "", "```", fixed.SYSTEM, "```"], path)


def preview(prompts: DataFrame, chars: int = 900) -> DataFrame:
    """The first prompt of each arm, shortened."""
    return prompts.groupBy("arm").agg(F.min_by(F.struct("variation_id", F.substring("user", 1, chars).alias("start")), "variation_id").alias("p")).select("arm", "p.variation_id", "p.start")


def coverage_report(covered: DataFrame, path: str) -> str:
    lines = ["# Corpus coverage", ""]
    for c in [x for x in covered.columns if x.endswith(("_passages", "_papers", "_variant", "_gene"))]:
        d = distribution(covered, c).first()
        lines.append(f"- {c}: zero {d['zero']} ({d['zero_share']:.0%}), median {d['median']}, mean {d['mean']}, most {d['max']}")
    return write_markdown(lines, path)
