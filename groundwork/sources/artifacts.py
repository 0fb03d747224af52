"""Tables that pipelines hand to each other, and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.classify import first_wins

DELIVERED = "array<struct<doc_id: string, source: string, text: string, level: string, year: int>>"
POOLS = f"variation_id string, gene string, rsid string, label string, split string, pool_size bigint, delivered {DELIVERED}"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for summaries of a row a record at most."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; characters are written as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    """Pools by id; of repeated ids the last line counts."""
    rows = spark.read.schema(POOLS).json(path).withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    return first_wins(rows, ["variation_id"], [F.desc("line")]).drop("line")


def append_cache(rows: DataFrame, keys: DataFrame, path: str) -> None:
    """Adds rows (with `key`) to a cache: files for all keys together, and a list of the keys, also of those without rows.
    A key that is there already isn't added again, so a job that runs twice leaves one copy."""
    spark = rows.sparkSession
    new = keys.join(cached_keys(spark, path), "key", "left_anti")
    rows.join(new, "key", "left_semi").write.mode("append").parquet(f"{path}/rows")
    new.write.mode("append").parquet(f"{path}/keys")


def cached_keys(spark: SparkSession, path: str) -> DataFrame:
    return _read_if_there(spark, f"{path}/keys", "key string").distinct()


def read_cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cached rows of all listed keys."""
    return _read_if_there(spark, f"{path}/rows", f"key string, {schema}").join(cached_keys(spark, path), "key", "left_semi")


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_markdown(lines: list[str], path: str) -> str:
    text = "\n".join([*lines, ""])
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return text


def sections(path: str) -> dict:
    """A configuration file's sections: JSON or, where a parser is installed, YAML."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # optional

        return yaml.safe_load(text)


@dataclass(frozen=True)
class Config:
    """A pipeline's settings; sections are read from YAML where a parser is installed, or given as dicts."""

    min_stars: int = 2
    types: tuple[str, ...] = ("single nucleotide variant",)
    drop_somatic: bool = True
    assembly: str = "GRCh38"
    require_comment: bool = True
    target: int = 1000
    balance: bool = True
    cap: int = 5
    paired: bool = True
    seed: int = 20260922
    split_by: str = "gene"
    fractions: dict[str, float] = field(default_factory=lambda: {"train": 0.6, "dev": 0.15, "test": 0.25})
    holdout_after: str | None = None

    def __post_init__(self) -> None:
        if self.split_by != "gene":
            raise ValueError("records are split by gene, never at random")

    @classmethod
    def of(cls, sections: dict) -> Config:
        f, s, p = sections.get("filters", {}), sections.get("sampling", {}), sections.get("split", {})
        given = {
            "assembly": next((x["assembly"] for x in sections.values() if isinstance(x, dict) and "assembly" in x), None), "min_stars": f.get("min_review_stars"), "types": tuple(x.lower() for x in f["variant_types"]) if "variant_types" in f else None,
            "drop_somatic": f.get("drop_somatic"), "require_comment": f.get("require_submitter_comment"), "target": s.get("target_n"), "balance": s.get("balance"), "cap": s.get("max_variants_per_gene"), "paired": s.get("pair_by_gene"),
            "seed": s.get("seed"), "split_by": p.get("by"), "fractions": p.get("fractions"), "holdout_after": p.get("temporal_holdout_after"),
        }
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in given.items() if v is not None and k in known})

    @classmethod
    def read(cls, path: str) -> Config:
        return cls.of(sections(path))
