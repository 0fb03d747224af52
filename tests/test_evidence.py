"""Evidence operators: the behaviours that results rest on."""

import datetime
import gzip
import json
import math
import random

import pytest
from groundwork.functions import fixed
from groundwork.functions import text as T
from groundwork.operators import arms, budget, classify, dedupe, entities, generate, gold, rank, sample, sanitize, split
from groundwork.plans import harness, pipelines, reports
from groundwork.sources import artifacts, dumps, rest
from pyspark.sql import functions as F


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first()[0]


def column(spark, values, f, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_significance_and_stars(spark):
    texts = ["Pathogenic", "Pathogenic/Likely pathogenic", " Likely benign", "Benign", "Uncertain significance", "Conflicting classifications of pathogenicity", "Conflicting; uncertain significance", "Benign; Pathogenic", "drug response", None, "uncertain risk allele"]
    assert column(spark, texts, classify.significance) == ["pathogenic", "pathogenic", "benign", "benign", "vus", "other", "vus", "other", "other", "other", "vus"]
    assert column(spark, ["criteria provided, multiple submitters, no conflicts", " Criteria provided, single submitter ", "reviewed by expert panel", "x", None], classify.ordinal) == [2, 1, 3, -1, -1]


def test_rs_numbers_alleles_genes_texts(spark):
    assert column(spark, ["123", "-1", None, " 45 ", "rs7"], T.canonical_rs) == ["rs123", None, None, "rs45", None]
    assert column(spark, ["ACGT", "A\n", "na", "", None], classify.alleles) == [True, False, False, False, False]
    assert column(spark, ["A", "A;B", "-", "", None], classify.one_gene) == [True, False, False, False, False]
    assert column(spark, ["x" * 100, " " + "x" * 99 + " ", "-", None], classify.usable_text) == [True, False, False, False]
    assert column(spark, ["rs12", "RS12 ", "12", "rrss9"], T.bare_rs) == ["12", "12", "12", "9"]
    assert column(spark, ["2020-01-02", "20", "x020", None], T.year) == [2020, None, None, None]


def test_holdout_is_strict_and_false_without_a_date(spark):
    days = [datetime.datetime(2020, 1, 1), datetime.datetime(2025, 1, 1), None, datetime.datetime(2024, 1, 1)]
    assert column(spark, days, lambda c: classify.after(c, "2024-01-01"), "x timestamp_ntz") == [False, True, False, False]


def record_dump(path):
    rows = []
    for i, (vid, gene, sig, kw) in enumerate([
        ("1", "G1", "Pathogenic", {}), ("1", "G9", "Benign", {}), ("2", "A;B", "Benign", {}), ("2", "G2", "Benign", {}), ("3", "G3", "Benign", {"Assembly": "GRCh37"}), ("4", "G4", "Uncertain significance", {"Type": "Single Nucleotide VARIANT"}),
        ("5", "G5", "Benign", {"Origin": "germline;Somatic"}), ("6", "G6", "Benign", {"ReferenceAlleleVCF": "na"}), ("7", "G7", "Benign", {"ReviewStatus": "no assertion provided"}), ("8", "NA", "Benign", {}), ("9", "G8", 'Benign "quoted', {"LastEvaluated": "bad", "RS# (dbSNP)": "-1", "PositionVCF": "x"}), ("10", "G8", "drug response", {}),
    ]):
        row = {c: "" for c in fixed.RECORD_COLUMNS} | {"#AlleleID": str(i), "VariationID": vid, "GeneSymbol": gene, "ClinicalSignificance": sig, "Type": "single nucleotide variant", "Assembly": "GRCh38", "Origin": "germline", "ReferenceAlleleVCF": "A", "AlternateAlleleVCF": "G", "ReviewStatus": "practice guideline", "RS# (dbSNP)": str(100 + i), "LastEvaluated": "Jan 05, 2021", "PositionVCF": "77"} | kw
        rows.append("\t".join(row[c].replace('"', "") if c != "Name" else row[c] for c in fixed.RECORD_COLUMNS))
    with gzip.open(path, "wt") as f:
        f.write("\n".join(["\t".join(fixed.RECORD_COLUMNS), *rows]) + "\n")


def test_record_dump(spark, tmp_path):
    record_dump(f"{tmp_path}/r.tsv.gz")
    out = classify.filter_records(dumps.read_records(spark, f"{tmp_path}/r.tsv.gz"))
    rows = {r["variation_id"]: r for r in out.collect()}
    # the first row of a variation counts, even if its gene then drops it; NA is no gene
    assert set(rows) == {"1", "4", "9"} and rows["1"]["gene"] == "G1" and rows["4"]["label"] == "vus"
    assert rows["9"]["rsid"] is None and rows["9"]["pos"] is None and rows["9"]["last_evaluated"] is None
    assert rows["1"]["last_evaluated"] == datetime.datetime(2021, 1, 5) and rows["1"]["pos"] == 77 and rows["1"]["rsid"] == "rs100"
    assert len(out.columns) == 22 and len(classify.filter_records(dumps.read_records(spark, f"{tmp_path}/r.tsv.gz").limit(0)).columns) == 22
    with pytest.raises(dumps.MissingColumns, match="Nope"):
        dumps.read_records(spark, f"{tmp_path}/r.tsv.gz", (*fixed.RECORD_COLUMNS, "Nope"))


def test_comment_dump(spark, tmp_path):
    names = ["VariationID", "ClinicalSignificance", "Description", "SCV"]
    long = 'said "so \\ and ' + "x" * 100
    lines = ["##Overview", "#VariationID: the identifier, in prose", "#" + "\t".join(names), f"1\tBenign\t{long}\tS1", "1\tBenign\t-\tS2", f"2\tBenign\t{'y' * 99}\tS3", f" 3 \tNA\t{'y' * 100}\tS4"]
    (tmp_path / "c.txt").write_text("\n".join(lines) + "\n")
    out = dumps.read_comments(spark, f"{tmp_path}/c.txt").orderBy("SCV").collect()
    assert [r["VariationID"] for r in out] == ["1", "3"] and out[0]["Description"] == long and out[1]["ClinicalSignificance"] is None
    only = dumps.read_comments(spark, f"{tmp_path}/c.txt", spark.createDataFrame([(3,)], "VariationID int"))
    assert [r["SCV"] for r in only.collect()] == ["S4"]
    (tmp_path / "d.txt").write_text("#VariationID: prose\n")
    with pytest.raises(ValueError, match="no header"):
        dumps.comment_columns(spark, f"{tmp_path}/d.txt")


def test_download_keeps_what_is_there(tmp_path):
    dest = f"{tmp_path}/a/b"
    dumps.download(lambda: [b"x", b"y"], dest)
    dumps.download(lambda: [b"z"], dest)
    assert open(dest).read() == "xy"
    assert open(dumps.download(lambda: [b"z"], dest, force=True)).read() == "z"


def test_sanitize(spark):
    text = "Seen in two families. It is classified as benign. (PVS1) applies. This residue is conserved! In summary it matters. PM2_Supporting and pathogenicity stay."
    assert one(spark, text, sanitize.sanitized("x")) == "Seen in two families. This residue is conserved! PM2_Supporting and pathogenicity stay."
    for code in ("PVS1", "PS4", "PM6", "PP5", "BA1", "BS4", "BP7"):
        assert one(spark, f"Met {code} here.", sanitize.sanitized("x")) == ""
    r = sanitize.sanitation_report(spark.createDataFrame([(text,), ("",), (None,)], "x string"), "x").first()
    assert tuple(r) == (6, 3, 0.5, 1, 1, 1)
    assert tuple(sanitize.sanitation_report(spark.createDataFrame([], "x string"), "x").first()) == (0, 0, 0.0, 0, 0, 0)


def brute_keep(sets, t):
    kept = []
    for i, s in enumerate(sets):
        if all((len(s & sets[j]) / len(s | sets[j]) if s | sets[j] else 1.0) < t for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("t", [0.95, 0.6])
def test_greedy_dedupe(spark, t):
    rng = random.Random(int(t * 100))
    texts = []
    for g in range(3):
        base = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(60)] = "new" + str(rng.randrange(99))
            texts.append((g, len(texts), " ".join(w)))
    texts += [(0, 900, ""), (0, 901, None), (1, 902, "Few words"), (1, 903, "few  WORDS!"), (2, 904, "one")]
    df = spark.createDataFrame(texts, "g int, pos long, text string")
    got = {r[0] for r in dedupe.greedy_keep(df, ["g"], "pos", "text", t).select("pos").collect()}
    want = set()
    for g in range(3):
        own = [(p, (x or "").lower()) for h, p, x in texts if h == g]
        words = [[w for w in "".join(c if c.isalnum() or c == "_" else " " for c in x).split()] for _, x in own]
        sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
        want |= {own[i][0] for i in brute_keep(sets, t)}
    assert got == want


def test_minhash_agrees_with_jaccard(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(20, 80))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(T.shingles("a").alias("a"), T.shingles("b").alias("b"))
    r = df.select(T.jaccard(F.col("a"), F.col("b")), T.agreement(T.signature(F.col("a"), 128), T.signature(F.col("b"), 128))).first()
    assert abs(r[0] - r[1]) < 0.15


def test_tokens_and_query(spark):
    assert one(spark, "BRCA1 c.1067A>G, rs80357906 (p.Gln356Arg). x..y", T.tokens("x")) == ["brca1", "c.1067a>g", "rs80357906", "p.gln356arg", "x", "y"]
    df = spark.createDataFrame([("G", None, "", "p")], "a string, b string, c string, d string")
    assert df.select(rank.query_of("a", "b", "c", "d")).first()[0] == "G p"


def brute_bm25(texts, query):
    import re

    tok = lambda x: re.findall(r"[a-z0-9]+(?:[.>][a-z0-9]+)*", (x or "").lower())
    ds = [tok(x) for x in texts]
    n, mean = len(ds), sum(map(len, ds)) / len(ds)
    df = {w: sum(w in d for d in ds) for w in {w for d in ds for w in d}}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf) if idf else 0
    idf = {w: 0.25 * avg if x < 0 else x for w, x in idf.items()}
    return [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in tok(query) if w in d) for d in ds]


def test_bm25(spark):
    pools = {"a": ["gene one", "gene gene two two", "gene three", "other words here"], "b": ["x y", "x z"], "c": ["", None], "d": ["same", "same", "same"]}
    rows = [(p, f"{p}{i}", x, ["other", "gene", "variant", "?"][i]) for p, xs in pools.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "pool string, doc string, text string, level string")
    q = spark.createDataFrame([("a", "gene two two"), ("b", "y z"), ("c", "x"), ("d", "same")], "pool string, query string")
    got = {(r["pool"], r["doc"]): (r["score"], r["rank"]) for r in rank.bm25(df, q, "pool", "doc", "text", "level").collect()}
    assert len(got) == len(rows)
    for p, query in (("a", "gene two two"), ("b", "y z"), ("d", "same")):
        for i, s in enumerate(brute_bm25(pools[p], query)):
            assert math.isclose(got[p, f"{p}{i}"][0], s, abs_tol=1e-9)
    assert [got["b", "b0"][0], got["c", "c0"][0], got["c", "c1"][0]] == [0, 0, 0]
    assert [got["d", f"d{i}"][1] for i in range(3)] == [3, 2, 1]  # ties: the nearest level first


def brute_budget(items, k, most, slots):
    taken, used = [], 0

    def take(x):
        nonlocal used
        if len(taken) < k and used + x[2] <= most:
            taken.append(x[0])
            used += x[2]
            return True
        return False

    n = 0
    if slots:
        for x in items:
            if x[1] == "variant" and n < slots:
                n += take(x)
    for x in items:
        if x[0] not in taken and not (slots and x[1] == "variant"):
            take(x)
    return taken


def test_budget(spark):
    rng = random.Random(9)
    cases = [[(i, rng.choice(["variant", "gene", "other"]), rng.choice([1, 40, 100, 700])) for i in range(1, rng.randint(2, 25))] for _ in range(40)]
    rows = [(str(c), f"d{i}", "x" * n, level, i) for c, items in enumerate(cases) for i, level, n in items]
    df = spark.createDataFrame(rows, "pool string, doc string, text string, level string, rank int")
    for k, most, slots in ((10, 600, 1), (3, 1000, 2), (0, 600, 1), (5, 600, 0)):
        out = budget.apply_budget(df, "pool", "doc", "text", "level", k, most, slots).collect()
        for c, items in enumerate(cases):
            got = [r["rank"] for r in sorted((r for r in out if r["pool"] == str(c)), key=lambda r: r["delivered_at"])]
            assert got == brute_budget(items, k, most, slots)


def test_budget_report(spark):
    df = spark.createDataFrame([("1", "x" * 3000), ("2", "x" * 250), ("2", "x" * 250)], "pool string, text string")
    labels = spark.createDataFrame([("1", "p"), ("2", "b"), ("3", "b")], "pool string, label string")
    got = {r["label"]: tuple(r)[1:] for r in budget.budget_report(df, labels, "pool", "text").collect()}
    assert got == {"p": (1, 1.0, 3000.0, 6.0), "b": (1, 2.0, 500.0, 6.0)}
    alone = budget.budget_report(df, labels.where("label = 'p'"), "pool", "text").first()
    assert alone["char_ratio"] is None
    zero = budget.budget_report(spark.createDataFrame([("1", ""), ("2", "a")], "pool string, text string"), labels, "pool", "text").first()
    assert zero["char_ratio"] == math.inf


def variants(spark, n_genes=40, each=6):
    return spark.createDataFrame([(f"{g}-{i}", f"G{g}", ["pathogenic", "benign"][i % 2]) for g in range(n_genes) for i in range(each)], "variation_id string, gene string, label string")


def test_samples(spark):
    df = variants(spark)
    out = sample.balance(df, 60, ("pathogenic", "benign"), cap=2, seed=3).collect()
    assert len(out) == 60 and sum(r["label"] == "benign" for r in out) == 30
    assert sorted(map(tuple, out)) == sorted(map(tuple, sample.balance(df, 60, ("pathogenic", "benign"), cap=2, seed=3).collect()))
    with pytest.raises(sample.TooFew):
        sample.balance(df.where("gene = 'G1' or label = 'benign'"), 60, ("pathogenic", "benign"))
    pairs = sample.balance_paired(df, 42, ("pathogenic", "benign"), seed=3).groupBy("gene", "label").count().collect()
    assert len(pairs) == 20 and {r["count"] for r in pairs} == {2}
    with pytest.raises(sample.TooFew):
        sample.balance_paired(df.where("gene in ('G1', 'G2')"), 100, ("pathogenic", "benign"))
    assert sample.sample(df, 7, "variation_id").count() == 7 and sample.head(df, 0, ["variation_id"]).count() == 240


def test_split(spark):
    fractions = {"train": 0.6, "dev": 0.15, "test": 0.25}
    out = split.group_split(variants(spark, 100, 4), fractions)
    assert out.groupBy("gene").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert all(abs(sizes[f] / 400 - x) < 0.05 for f, x in fractions.items())
    lone = spark.createDataFrame([(f"{g}-{i}", f"G{g}", "pathogenic" if g % 2 else "benign") for g in range(60) for i in range(1 + g % 5)], "variation_id string, gene string, label string")
    rates = [r["rate"] for r in split.prevalence(split.group_split(lone, fractions), "pathogenic").collect()]
    assert max(rates) - min(rates) <= 0.05
    big = [(f"x{i}", "BIG", "pathogenic") for i in range(300)] + [(f"y{g}", f"G{g}", "benign") for g in range(20)]
    with pytest.raises(split.Uneven):
        split.group_split(spark.createDataFrame(big, "variation_id string, gene string, label string"), fractions)
    with pytest.raises(ValueError, match="sum"):
        split.check_fractions({"a": 0.5, "b": 0.4})


DOC = {"pmid": "7", "id": "8", "date": "2019-05-01", "journal": "J", "passages": [
    {"infons": {"type": "Title", "year": "2018"}, "text": "A title long enough to be kept as a passage of evidence", "annotations": [{"text": "BRCA1/2", "infons": {"type": "Gene", "name": "BRCA1", "identifier": "672;x;675"}}, {"text": "v", "infons": {"type": "DNAMutation", "rsids": ["rs2", "rs1"], "hgvs": "c.1A>G"}}, {"text": "s", "infons": {"type": "SNP", "rsid": "rs9"}}, {"text": " cancer ", "infons": {"type": "Disease"}}]},
    {"infons": {"type": "abstract"}, "text": "  "}, {"infons": {"type": "abstract_title_1"}, "text": "Methods and everything else that heads a section"}, {"infons": {"type": "ref"}, "text": "A reference of more than forty characters, which never is evidence"}, {"text": "An abstract without annotations, long enough to be kept"},
]}


def test_documents_and_pools(spark):
    two = {**DOC, "pmid": "", "id": "9"}
    payloads = [json.dumps({"PubTator3": [DOC]}), json.dumps({"documents": [DOC]}), json.dumps([DOC, two]), json.dumps(DOC), json.dumps(DOC) + "\n\n" + json.dumps({"documents": [two]}), " "]
    docs = entities.documents(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    assert sorted(r["doc"]["id"] for r in docs.collect()) == ["8", "8", "8", "8", "8", "9", "9"]
    rows = entities.passages(entities.documents(spark.createDataFrame([(payloads[0],)], "payload string"))).orderBy("order").collect()
    assert [r["passage_id"] for r in rows] == ["7:title:0", "7:abstract_title_1:2", "7:ref:3", "7:abstract:4"]
    t = rows[0]
    assert (t["year"], rows[3]["year"], t["genes"], t["gene_ids"], t["rsids"], t["hgvs"], t["diseases"]) == (2018, 2019, ["BRCA1"], ["672", "675"], ["rs1", "rs2", "rs9"], ["c.1A>G"], ["cancer"])
    df = spark.createDataFrame(rows)
    pool = entities.prepare_pool(df, entities.evidence_level(F.lit("brca1"), F.lit("RS9")))
    assert [(r["section"], r["level"]) for r in pool.collect()] == [("title", "variant")]
    every = entities.prepare_pool(df, entities.evidence_level(F.lit("brca1"), F.lit(None).cast("string")), drop_unrelated=False)
    assert {r["section"]: r["level"] for r in every.collect()} == {"title": "gene", "abstract": "other"}
    level = df.where("section = 'title'").select(entities.evidence_level(F.lit("x"), F.lit(""), F.lit("672"), F.lit("no")), entities.evidence_level(F.lit("x"), F.lit(""), F.lit("1"), F.lit("c.1A>G"))).first()
    assert tuple(level) == ("gene", "variant")
    assert tuple(entities.pool_stats(every, ["pmid"]).first()) == ("7", 2, 1, 0, 1, 1)


def test_papers_and_recall(spark):
    text = "PMID: 12345678, (PMID 1234567); PMIDs: 11111, 22222;33333 pmid:123456789 and 99999 alone"
    assert one(spark, text, T.cited_papers("x")) == ["11111", "12345678", "1234567", "22222", "33333"] or set(one(spark, text, T.cited_papers("x"))) == {"12345678", "1234567", "11111", "22222", "33333"}
    g = gold.build_gold(spark.createDataFrame([("1", "PMID: 11111"), ("1", "PMID 22222"), ("2", "none"), ("2", None)], "v string, t string"), "v", "t")
    assert sorted(map(tuple, g.collect())) == [("1", "11111"), ("1", "22222")]
    known = spark.createDataFrame([("a", "1"), ("a", "2")], "record string, pmid string")
    ranked = spark.createDataFrame([("a", "9", 1), ("a", "1", 2), ("a", "1", 3), ("b", "1", 1)], "record string, pmid string, rank int")
    r = gold.score(known, ranked, ks=(1, 2)).first()
    assert tuple(r) == (1, 2, 1, 0.5, 0.0, 1.0)
    assert math.isnan(gold.score(known.limit(0), ranked, ks=(1,)).first()["pool_recall"])
    rel = spark.createDataFrame([("q", "1"), ("q", "2")], "key string, doc string")
    top = spark.createDataFrame([("q", "1", 1), ("q", "3", 2), ("q", "2", 3)], "key string, doc string, rank int")
    assert [gold.recall_at_k(top, rel, ["key"], "doc", k).first()["recall"] for k in (None, 0, 1)] == [1.0, 1.0, 0.5]
    assert pipelines.verdicts({"pool_recall": 0.07, "recall_at_10": 0.3}) == "corpus-bound" and pipelines.verdicts({"pool_recall": 0.9, "recall_at_10": 0.3}) == "ranking-bound"


def prompt_set(spark):
    rows = [(f"{s}{g}{la[0]}{i}", f"G{g}", la, s, None if i else "rs1234", f"N:c.{g}A>G (p.Gly{g}Ala)", "1", 5, "A", "G", "x|y") for s in ("dev", "test") for g in range(3) for la in ("pathogenic", "benign") for i in range(2)]
    records = spark.createDataFrame(rows, "variation_id string, gene string, label string, split string, rsid string, Name string, chrom string, pos long, ref string, alt string, phenotypes string")
    item = F.struct(F.lit("literature").alias("source"), F.lit(2001).alias("year"), F.concat(F.lit("About rs1234 "), F.when(F.col("gene") == "G2", "same").otherwise(F.col("variation_id"))).alias("text"))
    return records, records.where("gene <> 'G1' or label = 'benign'").select("variation_id", F.array(item).alias("passages"))


def test_arms(spark):
    records, delivered = prompt_set(spark)
    assigned = arms.assign_donors(records)
    by = {r["variation_id"]: r for r in records.collect()}
    for r in assigned.collect():
        for name, same in (("same_gene", True), ("other_gene", False)):
            d, own = by[r[name]], by[r["variation_id"]]
            assert d["variation_id"] != own["variation_id"] and (d["gene"] == own["gene"]) == same and d["label"] == own["label"] and d["split"] == own["split"]
    assert sorted(map(tuple, arms.assign_donors(records).collect())) == sorted(map(tuple, assigned.collect()))
    lone = arms.assign_donors(records.where("variation_id = 'dev0p0'")).first()
    assert lone["same_gene"] is None and lone["other_gene"] is None
    assert tuple(arms.coverage(arms.assign_donors(records.limit(0))).first()) == (0, 0.0, 0.0)
    every = arms.all_arms(records, delivered, assigned)
    counts = {r["arm"]: r for r in arms.arm_counts(every).collect()}
    assert counts["ungrounded"]["built"] == 24 and counts["grounded"]["no_passages"] == 4 and counts["distractor_same_gene"]["identical"] == 8
    built = arms.build_prompts(records, delivered, assigned)
    audit = arms.audit(built, 4).first()
    assert audit["records"] == 24 and audit["mismatches"] == 0
    p = built.where("variation_id = 'dev0p0' and arm = 'grounded'").first()["user"]
    assert "Gene: G0\nHGVS: N:c.0A>G (p.Gly0Ala)\ndbSNP: rs1234\n" in p and "x; y" in p and "[1] (literature, 2001) About rs1234 dev0p0" in p and "level" not in p and "Pathogenic / Likely pathogenic" in p
    assert fixed.NO_EVIDENCE in built.where("arm = 'ungrounded'").first()["user"]
    named = {r["arm"]: r for r in arms.naming_report(built).collect()}
    assert named["distractor_same_gene"]["names_a_variant"] == named["distractor_same_gene"]["n"]
    with pytest.raises(ValueError, match="unknown"):
        arms.all_arms(records, delivered, assigned, ("nope",))
    assert one(spark, "rs5", T.donor_keys(F.col("x"), F.lit("NM_1(B):c.5A>G (p.Ala2Gly)"))) == ["rs5", "p.Ala2Gly", "c.5A>G"]
    assert reports.preview(built).count() == 4


class Client:
    def __init__(self):
        self.asked, self.polls = [], 0

    def submit(self, requests):
        self.asked = list(requests)
        return "b1"

    def status(self, batch):
        self.polls += 1
        return "ended" if self.polls > 2 else "running"

    def results(self, batch):
        for i, r in enumerate(reversed(self.asked)):
            yield {"id": r["id"], "error": "refused"} if i == 0 else {"id": r["id"], "message": {"content": [{"type": "text", "text": r["user"]}, {"type": "other"}], "usage": {"input_tokens": 3}, "stop_reason": "end_turn"}}


def test_generation(spark):
    df = spark.createDataFrame([("1", "grounded", "s", "VARIANT\nGene: BRCA1 \nx"), ("2", "ungrounded", "s", "no gene")], "variation_id string, arm string, system string, user string")
    out = {(r["variation_id"], r["replicate"]): r for r in generate.echo(df, 2).collect()}
    assert len(out) == 4 and "lies in BRCA1. It" in out["1", 1]["text"] and "lies in the gene." in out["2", 0]["text"]
    ids = df.select(generate.parse_request_id(generate.request_id(F.col("variation_id"), F.col("arm"), F.lit("m" * 99), F.lit(4))).alias("p")).first()["p"]
    assert (ids["variation_id"], ids["arm"], ids["replicate"], len(ids["model_tag"])) == ("1", "grounded", 4, 8)

    def send(model, system, user, max_tokens, effort):
        if "BRCA1" in user:
            raise ConnectionError("down")
        return {"content": [{"type": "text", "text": "ok"}], "usage": {"output_tokens": 2}, "stop_reason": "end_turn"}

    got = {r["variation_id"]: r for r in generate.generate(df, lambda: generate.ApiGenerator(send, "m")).collect()}
    assert got["1"]["error"] == "ConnectionError: down" and got["2"]["text"] == "ok" and got["2"]["usage"] == {"output_tokens": 2}
    assert "temperature" not in generate.ApiGenerator(send, "m").parameters("s", "u")
    client = Client()
    rows = {r["variation_id"]: r for r in generate.run_batch(df, client, generate.ApiGenerator(send, "m"), sleep=lambda s: None).collect()}
    assert client.polls == 3 and sorted(r["error"] is None for r in rows.values()) == [False, True]
    assert tuple(generate.outcome(spark.createDataFrame([("a",), (None,)], "error string")).first()) == (1, 1)
    with pytest.raises(TimeoutError):
        generate.wait(type("C", (), {"status": lambda self, b: "running"})(), "b", 1, 0, sleep=lambda s: None)
    with pytest.raises(ValueError, match="factory"):
        pipelines.generations(df, "api")


def test_literature_client():
    calls, slept, now = [], [], [0.0]

    def transport(path, parameters):
        calls.append((path, parameters))
        if path == "export":
            return 200, parameters["pmids"]
        if len(calls) == 1:
            return 503, ""
        return 200, json.dumps({"results": [{"pmid": parameters["page"]}, {}], "total_pages": 2})

    def sleep(s):
        slept.append(s)
        now[0] += s

    client = rest.Client(transport, sleep=sleep, clock=lambda: now[0])
    assert list(client.search("q", 5)) == ["1", "2"] and slept[0] == 1 and any(abs(s - 0.34) < 1e-9 for s in slept)
    assert [len(x.split(",")) for x in client.fetch([str(i) for i in range(250)])] == [100, 100, 50]
    with pytest.raises(rest.RequestFailed):
        rest.Client(lambda p, q: (404, ""), sleep=sleep).get("x", {})
    with pytest.raises(rest.RequestFailed):
        rest.Client(lambda p, q: (500, ""), sleep=sleep).get("x", {})


def fixture_transport(path, parameters):
    return (200, json.dumps({"results": [{"pmid": 5}], "total_pages": 1})) if path == "search" else (200, json.dumps({"documents": [DOC]}))


def test_literature_source(spark):
    import sys

    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    assert rest.Literature({"query": "q"}).schema() == "position int, pmid string"
    reader = rest.Literature({"query": "q", "transport": f"{__name__}:fixture_transport", "gap_s": "0"}).reader(None)
    assert len(reader.partitions()) == 1 and list(reader.read(reader.partitions()[0])) == [(0, "5")]
    docs = rest.Literature({"ids": "7", "transport": f"{__name__}:fixture_transport", "gap_s": "0"}).reader(None)
    payloads = spark.createDataFrame(list(docs.read(docs.partitions()[0])), "payload_no int, payload string")
    assert entities.passages(entities.documents(payloads)).count() == 4


def test_config():
    cfg = artifacts.Config.of({"filters": {"variant_types": ["A"], "min_review_stars": 3}, "split": {"by": "gene", "temporal_holdout_after": None}, "source": {"assembly": "x"}})
    assert (cfg.types, cfg.min_stars, cfg.assembly, cfg.holdout_after) == (("a",), 3, "x", None)
    with pytest.raises(ValueError, match="gene"):
        artifacts.Config(split_by="random")


def test_pipelines_end_to_end(spark, tmp_path):
    raw = spark.createDataFrame([(i, str(i), f"G{i % 12}", ["Pathogenic", "Benign"][i // 12 % 2], str(1000 + i)) for i in range(96)], "ordinal long, vid string, gene string, sig string, rs string")
    names = {"VariationID": "vid", "GeneSymbol": "gene", "ClinicalSignificance": "sig", "RS# (dbSNP)": "rs"}
    same = {"Type": "single nucleotide variant", "Assembly": "GRCh38", "Origin": "germline", "ReferenceAlleleVCF": "A", "AlternateAlleleVCF": "G", "ReviewStatus": "practice guideline"}
    raw = raw.select("ordinal", *(F.col(names[c]).alias(c) if c in names else F.lit(same.get(c)).cast("string").alias(c) for c in fixed.RECORD_COLUMNS))
    text = F.concat(F.lit("Family "), F.col("vid"), F.lit(" was seen with PMID: 1234"), F.col("vid"), F.lit(" and segregates. It is classified as benign."))
    comments = raw.select("ordinal", F.col("VariationID").alias("vid")).select("ordinal", F.col("vid").alias("VariationID"), text.alias("Description"), F.concat(F.lit("S"), "vid").alias("SCV"), F.lit(None).cast("timestamp").alias("DateLastEvaluated"))
    comments = comments.unionByName(comments.withColumn("ordinal", F.col("ordinal") + 1000).withColumn("SCV", F.concat("SCV", F.lit("b"))))
    cfg = artifacts.Config(target=48, fractions={"train": 0.5, "test": 0.5})
    parts = pipelines.record_set(raw, comments, cfg)
    keep = lambda df, name: (artifacts.write_parquet(df, f"{tmp_path}/{name}"), artifacts.read_parquet(spark, f"{tmp_path}/{name}"))[1]
    main = keep(parts["main"], "main")
    assert main.count() == 48 and "is_holdout" in main.columns
    clean = keep(pipelines.clean_comments(comments), "comments")
    assert clean.count() == 96 and clean.where("sanitized like '%classified%'").count() == 0
    passages = main.select("variation_id", "gene").join(entities.passages(entities.documents(spark.createDataFrame([(json.dumps([DOC]),)], "payload string")))).withColumn("genes", F.array("gene")).drop("gene").withColumn("position", F.col("order"))
    pool = keep(pipelines.evidence(main, passages, clean), "evidence")
    pools = pipelines.evidence_pools(main, pool)
    artifacts.write_jsonl(pools, f"{tmp_path}/pools")
    back = artifacts.read_pools(spark, f"{tmp_path}/pools").persist()
    assert back.count() == 48 and back.selectExpr("min(pool_size)", "min(size(delivered))").first()[0] >= 2
    assert back.first()["delivered"][0]["level"] == "variant"
    assert reports.delivery_report(back).count() == 2
    r = pipelines.evaluate_retrieval(main, comments, pool).first()
    assert r["records"] == 48 and r["pool_recall"] == 0.0
    out = pipelines.prompts(main, back)
    assert out["audit"].first()["mismatches"] == 0 and out["missing"].count() == 0
    assert pipelines.generations(out["prompts"]).where("error is null").count() == out["prompts"].count()
    covered = pipelines.corpus_coverage(main, passages, 5)
    assert covered.count() == 5 and covered.agg(F.min("abstract_passages")).first()[0] == 2
    assert "PASS" in reports.audit_report(out, f"{tmp_path}/audit.md") and "main set: 48" in reports.record_card(cfg, parts, f"{tmp_path}/card.md")
    assert "sentences" in reports.comment_report(main, comments, clean, f"{tmp_path}/c.md") and "median" in reports.coverage_report(covered, f"{tmp_path}/v.md")
    artifacts.write_csv(covered, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 5


def test_prompts_take_all_documents_and_whole_texts(spark, tmp_path, monkeypatch):
    late = "x" * 200 + " rs12345"
    spark.createDataFrame([(1, "short", "s"), (1201, late, "s"), (2, "other gene", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(harness, "main_set", lambda spark, _: spark.createDataFrame([("v", "G1", "benign", "train")], "variation_id string, gene string, label string, split string"))
    _, delivered, _ = harness.prompt_parts(spark, str(tmp_path))
    assert [(p["doc_id"], p["text"]) for r in delivered.collect() for p in r["passages"]] == [(1, "short"), (1201, late)]


def test_null_groups_and_membership(spark):
    rows = [(None, 1, "a b c d e f"), (None, 2, "A b c d e f"), (None, 3, "a b c d e f g"), ("x", 4, "a b c d e f"), ("x", 5, "other words")]
    df = spark.createDataFrame(rows, "g string, pos long, text string")
    assert [tuple(r)[:3] for r in dedupe.similar_pairs(df, ["g"], "pos", "text", 0.6).collect()] == [(None, 1, 3)]
    assert sorted(r["pos"] for r in dedupe.greedy_keep(df, ["g"], "pos", "text", 0.6).collect()) == [1, 4, 5]
    got = {r["pos"]: (r["g"], r["representative"], r["copies"]) for r in dedupe.membership(df, ["g"], "pos", "text").collect()}
    assert got == {1: (None, 1, 2), 2: (None, 1, 2), 3: (None, 3, 1), 4: ("x", 4, 1), 5: ("x", 5, 1)}


def gold_behind_a_comment(spark):
    pools = spark.createDataFrame([("v", "c1", "comment", "gene words of a comment", "variant", 2000), ("v", "111111:title:0", "literature", "gene", "other", 2000), ("v", "222222:title:0", "literature", "something else", "other", 2000)], "variation_id string, doc_id string, source string, text string, level string, year int")
    records = spark.createDataFrame([("v", "gene", None)], "variation_id string, gene string, rsid string")
    return records, spark.createDataFrame([("v", "PMID: 111111")], "VariationID string, Description string"), pools


def test_comments_take_no_ranks_and_k_is_reported(spark):
    records, comments, pools = gold_behind_a_comment(spark)
    r = pipelines.evaluate_retrieval(records, comments, pools, k=7).first().asDict()
    assert (r["records"], r["pool_recall"], r["recall_at_1"], r["recall_at_7"]) == (1, 1.0, 1.0, 1.0) and "recall_at_10" not in r


def test_folds_are_dealt_by_the_rule():
    import numpy as np

    # quotas 6 and 4 of the first label, 3 and 2 of the second: room decides, then excess, then the first of equals
    sizes = np.array([[4, 1], [3, 2], [2, 1], [1, 1]])
    assert split.dealt(sizes, np.array([0.6, 0.4])).tolist() == [0, 1, 0, 0]
    assert split.dealt(np.array([[1], [1], [1], [1]]), np.array([0.5, 0.5])).tolist() == [0, 1, 0, 1]
    assert split.dealt(np.array([[5], [1]]), np.array([0.5, 0.5])).tolist() == [0, 1]


#: A service in a module of its own, which workers import by name: searches find paper 5 by rs number, papers 6 and 5 by gene; G3's requests fail.
SERVICE = """
import json

DOC = json.loads({doc!r})


def answer(path, parameters):
    if path == "search":
        if "G3" in parameters["text"]:
            return 404, ""
        return 200, json.dumps({{"results": [{{"pmid": 5}}] if parameters["text"].startswith("rs") else [{{"pmid": 6}}, {{"pmid": 5}}], "total_pages": 1}})
    return 200, json.dumps({{"documents": [{{**DOC, "pmid": x}} for x in parameters["pmids"].split(",")]}})
"""


def test_command_line(spark, tmp_path):
    from groundwork import cli
    from groundwork.plans import literature

    doc = json.loads(json.dumps(DOC))
    doc["passages"][0]["annotations"] += [{"text": f"G{i}", "infons": {"type": "Gene", "name": f"G{i}"}} for i in range(12)]
    (tmp_path / "fixture_service.py").write_text(SERVICE.format(doc=json.dumps(doc)))
    spark.sparkContext.addPyFile(str(tmp_path / "fixture_service.py"))
    service = "fixture_service:answer"
    same = {"Type": "single nucleotide variant", "Assembly": "GRCh38", "Origin": "germline", "ReferenceAlleleVCF": "A", "AlternateAlleleVCF": "G", "ReviewStatus": "practice guideline"}
    rows = [{**same, "VariationID": str(i), "GeneSymbol": f"G{i % 12}", "ClinicalSignificance": ["Pathogenic", "Benign"][i // 12 % 2] if i < 96 else "Uncertain significance", "RS# (dbSNP)": str(1000 + i)} for i in range(100)]
    with gzip.open(tmp_path / "dump.gz", "wt") as f:
        f.write("\n".join("\t".join(x) for x in [fixed.RECORD_COLUMNS, *([r.get(c, "") for c in fixed.RECORD_COLUMNS] for r in rows)]))
    with gzip.open(tmp_path / "said.gz", "wt") as f:
        f.write("#VariationID: prose\n#" + "\t".join(fixed.COMMENT_COLUMNS) + "\n")
        f.write("\n".join("\t".join({"VariationID": str(i), "SCV": f"S{i}", "Description": f"Family {i} was seen with PMID: 1234{i:03d} in a long enough text of a comment that segregates. It is classified as benign here and elsewhere."}.get(c, "-") for c in fixed.COMMENT_COLUMNS) for i in range(100)))
    at = lambda name: str(tmp_path / name)
    cfg = {"source": {"raw_path": at("dump.gz"), "submissions_path": at("said.gz"), "assembly": "GRCh38"}, "sampling": {"target_n": 48, "pair_by_gene": True}, "split": {"by": "gene", "fractions": {"dev": 0.5, "test": 0.5}}, "paths": {"processed": at("out")}}
    (tmp_path / "cfg.json").write_text(json.dumps(cfg))
    run = lambda *args: cli.main(list(args), spark)
    assert run("records", "--config", at("cfg.json"), "--skip-download") == {"main": 48, "unresolved": 4}
    with pytest.raises(SystemExit):
        run("records", "--config", at("cfg.json"))
    v, common = at("out/variants.parquet"), ["--cache", at("cache"), "--transport", service, "--pages", "1"]
    assert run("comments", "--submissions", at("said.gz"), "--variants", v, "--out", at("comments"), "--report", at("c.md")) == {"comments": 48}
    found = literature.corpus(spark, artifacts.read_parquet(spark, v), at("other"), service, 1, 0)
    assert {r["error"] for r in found["errors"].collect()} == {"RequestFailed: search: status 404"} and found["errors"].count() == 4
    one_record = [r["pmid"] for r in found["passages"].where("section = 'title'").orderBy("variation_id", "position").limit(2).collect()]
    assert one_record == ["5", "6"]  # the rs number's paper first, once
    n = run("pools", "--variants", v, "--comments", at("comments"), "--split", "all", "--out", at("pools"), "--report", at("p.md"), *common)
    assert n == {"pools": 44, "errors": 4} and run("pools", "--variants", v, "--comments", at("comments"), "--split", "all", "--out", at("pools"), "--report", at("p.md"), *common) == n
    assert run("probe", "--variants", v, "--split", "all", "--n", "48", "--out", at("csv"), "--report", at("cov.md"), *common) == {"probed": 44, "errors": 4}
    dev = run("recall", "--variants", v, "--comments", at("comments"), "--report", at("r.md"), "--cached-only", "--cache", at("cache"), "--pages", "1")
    every = run("recall", "--variants", v, "--comments", at("comments"), "--split", "all", "--report", at("r.md"), "--cached-only", "--cache", at("cache"), "--pages", "1")
    assert every == {"records": 44, "skipped": 4} and 0 < dev["records"] < 44
    n = run("generate", "--variants", v, "--pools", at("pools"), "--split", "all", "--out", at("gen"), "--report", at("a.md"), "--arms", "grounded", "ungrounded")
    assert n == {"prompts": 88, "missing": 4, "ok": 88, "errors": 0}
    assert "ok" not in run("generate", "--variants", v, "--pools", at("pools"), "--report", at("a.md"), "--dry-run")


def test_greedy_keep_and_pairs_against_brute_force(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = f"x{rng.randrange(5)}"
        rows.append((i % 2, i, " ".join(w)))
    df = spark.createDataFrame(rows, "g int, pos long, text string")
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(36)} for _, i, t in rows}
    for t in (0.5, 0.8):
        want = set()
        for g in (0, 1):
            own = [i for h, i, _ in rows if h == g]
            want |= {own[k] for k in brute_keep([sets[i] for i in own], t)}
        assert {r["pos"] for r in dedupe.greedy_keep(df, ["g"], "pos", "text", t).collect()} == want


def test_entry_without_the_optional_libraries(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it could not be found
    for name in [x for x in sys.modules if x.startswith("groundwork.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.warns(UserWarning, match="left out"):
        entry = importlib.import_module("__spark_entry__")
    assert "h04_filter_records" in entry.queries() and not [x for x in entry.queries() if x.startswith("op")] and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def moved(df):
    """The columns of each exchange and broadcast in a plan: names, and names with types."""
    out = []

    def walk(p):
        if p.nodeName().endswith("Exchange"):
            cols = [p.output().apply(i) for i in range(p.output().size())]
            out.append({c.name() for c in cols} | {f"{c.name()}:{c.dataType().simpleString()}" for c in cols})
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        walk(df._jdf.queryExecution().executedPlan())
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return out


SMALL = "/root/testdata/sf0.001"
TEXTS = {"text", "passages", "own_passages", "donor_passages", "said", "evidence", "user", "e"}


def texts_stay(spark, query):
    for cols in moved(query(spark, SMALL)):
        assert not cols & TEXTS or not cols & {"variation_id", "donor", "arm", "same_gene", "other_gene"}, cols
        assert "text" not in cols or "delivered_at" in cols, cols


def test_h27_moves_no_texts_with_records(spark):
    """Texts move as what is delivered to a pool, once; with records they moved for every arm, and whole pools did to be ranked."""
    texts_stay(spark, harness.h27_prompts)


def test_h28_audit_moves_digests(spark):
    rows = [(v, f"head {v}\nEVIDENCE\n{arm}\nTASK\n{'other' if (v, arm) == ('b', 'y') else 'same'}") for v in "abc" for arm in "xy" if (v, arm) != ("c", "y")]
    prompts = spark.createDataFrame(rows, "variation_id string, user string").repartition(3, "user")
    assert tuple(arms.audit(prompts, 2).first()) == (3, 2, 1)
    for cols in moved(arms.audit(prompts, 2)):
        assert "user" in cols or not {c for c in cols if c.endswith(":string")} - {"variation_id:string"}, cols
    texts_stay(spark, harness.h28_audit)


def test_h30_echo_reads_what_stands_before_the_evidence(spark):
    prompts = spark.createDataFrame([("1", "grounded", "VARIANT\nGene: A\nx", "VARIANT\nGene: A\nx\nGene: B")], "variation_id string, arm string, opening string, user string")
    assert generate.echo(prompts).first()["text"] == generate.echo(prompts.drop("opening")).first()["text"]
    texts_stay(spark, harness.h30_echo)
    assert not [c for c in moved(harness.h30_echo(spark, SMALL)) if c & {"evidence", "user"}]


def test_h29_arm_counts_move_no_texts_with_records(spark):
    texts_stay(spark, harness.h29_arm_counts)


def test_h29_flags_move_no_texts_with_records(spark):
    texts_stay(spark, harness.h29_distractor_flags)


def test_h36_naming_moves_no_texts_with_records(spark):
    texts_stay(spark, harness.h36_naming_report)


def bytes_moved(df):
    """What the exchanges of a run wrote, before compression."""
    total = 0

    def walk(p):
        nonlocal total
        if p.nodeName() == "Exchange":
            total += p.metrics().apply("dataSize").value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        walk(df._jdf.queryExecution().executedPlan())
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return total


def bytes_a_record(spark, query, tmp_path):
    """What is moved for each further record: orders once and five times, the documents as they are."""
    found = []
    for n in (1, 5):
        (d := tmp_path / str(n)).mkdir()
        (d / "documents.parquet").symlink_to(f"{SMALL}/documents.parquet")
        orders = spark.read.parquet(f"{SMALL}/orders.parquet").crossJoin(spark.range(n))
        orders.selectExpr("o_orderkey + id * 1000000 o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.parquet(str(d / "orders.parquet"))
        found.append((harness.main_set(spark, str(d)).count(), bytes_moved(query(spark, str(d)))))
    (few, least), (many, most) = found
    assert many > 4 * few > 0
    return (most - least) / (many - few)


def test_h29_arm_counts_move_few_bytes_a_record(spark, tmp_path):
    assert (x := bytes_a_record(spark, harness.h29_arm_counts, tmp_path)) < 3000, x


def test_h29_flags_move_few_bytes_a_record(spark, tmp_path):
    assert (x := bytes_a_record(spark, harness.h29_distractor_flags, tmp_path)) < 3000, x


def test_h36_naming_moves_few_bytes_a_record(spark, tmp_path):
    assert (x := bytes_a_record(spark, harness.h36_naming_report, tmp_path)) < 3000, x
