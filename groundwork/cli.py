"""The pipelines' command line:  python -m groundwork.cli records|probe|comments|pools|recall|generate [options]

Each command reads and writes tables and reports by path. What asks a service is named by module:function: `--fetch` (a url's
chunks of bytes), `--transport` (the literature), `--factory` and `--batch-client` (generators other than echo).
"""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import fixed
from groundwork.operators import generate as g
from groundwork.operators import gold, sample
from groundwork.plans import literature, pipelines, reports
from groundwork.sources import artifacts, dumps

VARIANTS, COMMENTS, CACHE, POOLS = "data/processed/variants.parquet", "data/processed/comments.parquet", "data/interim/literature", "data/processed/evidence_pools.jsonl"


def named(what: str) -> Callable:
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def of_split(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split; `all` is every row."""
    return df if split == "all" else df.where(F.col("split") == split)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundwork", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, f: Callable, *names: str, **defaults: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for n in names:
            default = defaults.get(n.replace("-", "_"))
            p.add_argument(f"--{n}", default=default, type=type(default) if isinstance(default, int) else str)
        return p

    command("records", records, "config", "fetch", config="configs/data.json").add_argument("--skip-download", action="store_true")
    command("probe", probe, "variants", "split", "n", "pages", "cache", "out", "report", "transport", variants=VARIANTS, split="dev", n=25, pages=3, cache=CACHE, out="results/corpus_coverage.csv", report="results/corpus_coverage.md")
    command("comments", comments, "submissions", "variants", "out", "report", submissions="data/raw/submission_summary.txt.gz", variants=VARIANTS, out=COMMENTS, report="results/sanitation_report.md")
    command("pools", pools, "variants", "comments", "split", "n", "k", "max-chars", "variant-slots", "pages", "cache", "out", "report", "transport", variants=VARIANTS, comments=COMMENTS, split="dev", n=0, k=10, max_chars=6000, variant_slots=1, pages=3, cache=CACHE, out=POOLS, report="results/evidence_budget.md")
    command("recall", recall, "variants", "comments", "split", "n", "k", "pages", "cache", "report", "transport", variants=VARIANTS, comments=COMMENTS, split="dev", n=0, k=10, pages=3, cache=CACHE, report="results/retrieval_eval.md").add_argument("--cached-only", action="store_true")
    p = command("generate", generate, "variants", "pools", "split", "n", "backend", "model", "effort", "factory", "batch-client", "seed", "out", "report", variants=VARIANTS, pools=POOLS, split="dev", n=0, backend="echo", effort="medium", seed=0, out="results/generations.jsonl", report="results/prompt_audit.md")
    p.add_argument("--arms", nargs="+", default=list(fixed.ARMS))
    p.add_argument("--batch", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return top


def records(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """The record set from the dump: main and unresolved records, and a card."""
    sections = artifacts.sections(a.config)
    cfg, source = artifacts.Config.of(sections), next(x for x in sections.values() if isinstance(x, dict) and "raw_path" in x)
    out = sections["paths"]["processed"]
    if not a.skip_download:
        if a.fetch is None:
            raise SystemExit("name what fetches the dump (--fetch module:function), or use --skip-download")
        dumps.download(lambda: named(a.fetch)(source["url"]), source["raw_path"])
    if not os.path.exists(source["raw_path"]):
        raise SystemExit(f"{source['raw_path']} is not there")
    said = source.get("submissions_path")
    if cfg.require_comment and not (said and os.path.exists(said)):
        raise SystemExit(f"comments are required, and {said} is not there")
    parts = pipelines.record_set(dumps.read_records(spark, source["raw_path"]), dumps.read_comments(spark, said) if cfg.require_comment else None, cfg)
    main = written(spark, parts["main"], f"{out}/variants.parquet")
    rest = written(spark, parts["unresolved"].where("label = 'vus'"), f"{out}/variants_vus.parquet")
    reports.record_card(cfg, parts | {"main": main, "unresolved": rest}, f"{out}/variant_set_card.md")
    return {"main": main.count(), "unresolved": rest.count()}


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    artifacts.write_parquet(df, path)
    return artifacts.read_parquet(spark, path)


def probe(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """How much literature there is for a sample of records; a record whose requests fail has a row with the error."""
    chosen = sample.sample(of_split(artifacts.read_parquet(spark, a.variants), a.split), a.n, "variation_id")
    found = literature.corpus(spark, chosen, a.cache, a.transport, a.pages)
    covered = pipelines.corpus_coverage(chosen, found["passages"], a.n, errors=found["errors"]).persist()
    artifacts.write_csv(covered, a.out)
    reports.coverage_report(covered.where("error is null"), a.report)
    n = {"probed": covered.where("error is null").count(), "errors": covered.where("error is not null").count()}
    covered.unpersist()
    return n


def comments(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Comments on the records, sanitised, without near-duplicates."""
    variants = artifacts.read_parquet(spark, a.variants)
    raw = dumps.read_comments(spark, a.submissions, variants.select(F.col("variation_id").alias("VariationID")))
    kept = written(spark, pipelines.clean_comments(raw), a.out)
    reports.comment_report(variants, raw, kept, a.report)
    return {"comments": kept.count()}


def pools(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """What each record gets delivered of its literature and comments."""
    rows = sample.head(of_split(artifacts.read_parquet(spark, a.variants), a.split), a.n, ["variation_id"])
    found = literature.corpus(spark, rows, a.cache, a.transport, a.pages)
    rows = rows.join(found["errors"], "variation_id", "left_anti")
    made = pipelines.evidence_pools(rows, pipelines.evidence(rows, found["passages"], artifacts.read_parquet(spark, a.comments)), a.k, a.max_chars, a.variant_slots)
    artifacts.write_jsonl(made, a.out)
    back = artifacts.read_pools(spark, a.out)
    reports.delivery_lines(back, a.report)
    return {"pools": back.count(), "errors": found["errors"].count()}


def recall(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Recall of the papers that experts cite: gold from the raw comments."""
    said = artifacts.read_parquet(spark, a.comments)
    known = gold.build_gold(said, "VariationID", "Description").select(F.col("VariationID").alias("variation_id")).distinct()
    rows = of_split(artifacts.read_parquet(spark, a.variants), a.split).join(known, "variation_id", "left_semi")
    rows = sample.head(rows, a.n, ["variation_id"])
    found = literature.corpus(spark, rows, a.cache, None if a.cached_only else a.transport, a.pages)
    skipped = found["missing"] if a.cached_only else found["errors"].select("variation_id")
    rows = rows.join(skipped, "variation_id", "left_anti")
    papers = pipelines.papers(rows, found["passages"]).withColumn("source", F.lit("literature"))
    score = pipelines.evaluate_retrieval(rows, said, papers, a.k)
    reports.retrieval_report(score, pipelines.verdicts(score.first().asDict()), a.report)
    return {"records": rows.count(), "skipped": skipped.count()}


def generate(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Prompts for all arms, their audit, and, unless it is a dry run, answers."""
    rows = of_split(artifacts.read_parquet(spark, a.variants), a.split)
    parts = pipelines.prompts(rows, artifacts.read_pools(spark, a.pools), tuple(a.arms), a.seed, a.n)
    reports.audit_report(parts, a.report)
    n = {"prompts": parts["prompts"].count(), "missing": parts["missing"].count()}
    if a.dry_run:
        return n
    if a.batch:
        client = named(a.batch_client)()
        made = g.run_batch(parts["prompts"], client, g.ApiGenerator(lambda **_: {}, a.model, a.effort))
    else:
        made = pipelines.generations(parts["prompts"], a.backend, named(a.factory) if a.factory else None)
    artifacts.write_jsonl(made, a.out)
    ok, errors = g.outcome(spark.read.schema(g.SCHEMA).json(a.out)).first()
    return n | {"ok": ok, "errors": errors}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    a = parser().parse_args(args)
    out = a.run(spark or SparkSession.builder.getOrCreate(), a)
    print(", ".join(f"{k}: {v}" for k, v in out.items()))
    return out


if __name__ == "__main__":
    main()
