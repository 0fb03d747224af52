"""Annotated documents: unwrapping payloads, flattening passages, and preparing a record's pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import fixed
from groundwork.functions.text import bare_rs, passage_id, trim, year
from groundwork.operators.classify import first_wins

ANNOTATION = "struct<text: string, infons: struct<type: string, name: string, identifier: string, rsids: array<string>, rsid: string, hgvs: string>>"
DOCUMENT = f"struct<pmid: string, id: string, date: string, journal: string, passages: array<struct<infons: struct<type: string, year: string>, text: string, annotations: array<{ANNOTATION}>>>>"


def documents(payloads: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """payload_no (or the columns of `keep`), doc_no, doc: the documents of payloads of any of the shapes: under a wrapper's key, a bare list, one object, or lines of these."""
    wrapped = f"struct<{', '.join(f'{w}: array<{DOCUMENT}>' for w in fixed.WRAPPERS)}>"

    def unwrap(c: Column) -> Column:
        inside = F.from_json(c, wrapped)
        return F.when(c.startswith("["), F.from_json(c, f"array<{DOCUMENT}>")).otherwise(F.coalesce(*(inside[w] for w in fixed.WRAPPERS), F.array(F.from_json(c, DOCUMENT))))

    # lines of JSON begin with a line that is JSON by itself; one value over several lines doesn't
    each = F.filter(F.transform(F.split("p", r"\r\n|\r|\n"), trim), lambda x: x != "")
    parts = F.when(F.try_parse_json(F.element_at(each, 1)).isNotNull(), each).otherwise(F.array("p"))
    keep = keep or ["payload_no"]
    rows = payloads if "payload_no" in payloads.columns else payloads.withColumn("payload_no", F.monotonically_increasing_id())
    rows = rows.select(*keep, trim(payload).alias("p")).where("p <> ''")
    docs = rows.select(*keep, F.posexplode(F.flatten(F.transform(parts, unwrap))).alias("doc_no", "doc"))
    return docs.where("doc is not null")


def passages(docs: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """A row for each passage with text, beside the columns of `keep`. `order` counts blank passages too; annotation lists are sorted and distinct."""
    d = F.col(doc)
    keep = keep or []
    base = docs.select(*keep, F.coalesce(F.nullif(d["pmid"], F.lit("")), F.nullif(d["id"], F.lit("")), F.lit("")).alias("pmid"), d["journal"].alias("journal"), year(d["date"]).alias("doc_year"), F.posexplode(d["passages"]).alias("order", "p"))
    notes = F.coalesce(F.col("p.annotations"), F.array().cast(f"array<{ANNOTATION}>"))
    kind = lambda *names: F.filter(notes, lambda a: F.lower(F.coalesce(a["infons"]["type"], F.lit(""))).isin(*names))
    named = lambda xs: F.transform(xs, lambda a: F.coalesce(F.nullif(a["infons"]["name"], F.lit("")), trim(a["text"])))
    tidy = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (x != ""))))
    ids = F.flatten(F.transform(kind("gene"), lambda a: F.split(F.coalesce(a["infons"]["identifier"], F.lit("")), ";")))
    variants = kind(*fixed.VARIANT_KINDS)
    rs = F.flatten(F.transform(variants, lambda a: F.when(F.size(F.coalesce(a["infons"]["rsids"], F.array().cast("array<string>"))) > 0, a["infons"]["rsids"]).otherwise(F.array(a["infons"]["rsid"]))))
    section = F.lower(F.coalesce("p.infons.type", F.lit("abstract")))
    out = base.withColumns({
        "text": trim("p.text"), "section": section, "year": F.coalesce(year("p.infons.year"), "doc_year"), "genes": tidy(named(kind("gene"))), "gene_ids": tidy(F.filter(ids, lambda x: x.rlike(r"^\d+\z"))),
        "rsids": tidy(rs), "hgvs": tidy(F.transform(variants, lambda a: a["infons"]["hgvs"])), "diseases": tidy(named(kind("disease"))),
    })
    out = out.where("text is not null and text <> ''").withColumn("passage_id", passage_id(F.col("pmid"), F.col("section"), F.col("order")))
    return out.select(*keep, "passage_id", "pmid", "section", "text", "order", "year", "journal", "genes", "gene_ids", "rsids", "hgvs", "diseases")


def evidence_level(gene: Column, rsid: Column, gene_id: Column | None = None, hgvs: Column | None = None) -> Column:
    """variant if the passage names the record itself (rs number, then exact name), gene if it names its gene (id, then symbol), else other."""
    given = lambda c: c.isNotNull() & (c != "")
    out = F.when(given(rsid) & F.exists("rsids", lambda r: bare_rs(r) == bare_rs(rsid)), "variant")
    if hgvs is not None:
        out = out.when(given(hgvs) & F.array_contains("hgvs", hgvs), "variant")
    if gene_id is not None:
        out = out.when(given(gene_id) & F.array_contains("gene_ids", gene_id.cast("string")), "gene")
    return out.when(given(gene) & F.exists("genes", lambda g: F.upper(g) == F.upper(gene)), "gene").otherwise("other")


def prepare_pool(rows: DataFrame, level: Column, sections: tuple[str, ...] = fixed.ABSTRACT_SECTIONS, min_chars: int = 40, drop_unrelated: bool = True, pool: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Passages of the allowed sections (never of a reference list or heading), long enough and related, the first of each
    id in its pool; with `level`."""
    kept = rows.where(F.col("section").isin(*sections) & ~F.col("section").isin(*fixed.NEVER_SECTIONS) & ~F.col("section").rlike(fixed.HEADING_PATTERN))
    kept = kept.where(F.length("text") >= min_chars).withColumn("level", level)
    if drop_unrelated:
        kept = kept.where("level <> 'other'")
    return first_wins(kept, [*(pool or []), "passage_id"], order or ["pmid", "order"])


def pool_stats(rows: DataFrame, pool: list[str], level: str = "level", paper: str = "pmid") -> DataFrame:
    """Per pool: passages, distinct papers, and passages by level."""
    return rows.groupBy(*pool).agg(F.count("*").alias("passages"), F.countDistinct(paper).alias("papers"), *(F.count_if(F.col(level) == x).alias(x) for x in fixed.LEVELS))


def corpus_ids(hits: DataFrame, keys: list[str], priority: str = "priority", position: str = "position", paper: str = "pmid") -> DataFrame:
    """Each paper once, at its first place: by the query's priority (the record's own name before its gene's), then position."""
    return first_wins(hits, [*keys, paper], [priority, position])
