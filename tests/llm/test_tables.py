"""Mixing, URL filters, components, the pipeline."""

import math
import random
import re

import pytest

pytest.importorskip("groundwork.llm")
import public_tokenizers as P  # noqa: E402
from groundwork.llm import bpe, graph, mixing, quality, simhash, urls  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    whole, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = whole - sum(2 * sizes[s] for s in capped)
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * rate for s in names}
        capped |= over


@pytest.mark.parametrize("buckets", [mixing.BUCKET_ROWS, 3])
def test_mix(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    rng = random.Random(buckets)
    rows = [(i, rng.choice(["a", "b", "ü", "c", None, "d"]), " ".join(["w"] * rng.randint(0, 30)), i % 3, 1) for i in range(120)]
    rows += [(200, "empty", None, 0, 1), (201, "big", "w " * 900, 0, 1), (3, "a", "repeat x", 0, 1), (3, "a", "repeat x", 0, 1), (None, "a", "n", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target long, before int")
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes = {}
    for _, s, t, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    got = mixing.mix(mixing.sizes(df)).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], abs_tol=1e-6) and r["source_size"] == sizes[s] for r in own)
        assert sum(r["taken"] for r in own) == math.floor(want[s] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, mixing.mix(mixing.sizes(df)).collect())) == sorted(map(key, got))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    assert taken == {s: math.floor(w + 0.5) for s, w in want.items() if math.floor(w + 0.5)}
    assert mixing.mix(mixing.sizes(df.limit(0))).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, x) for x in range(401, 480)] + [(i, i + 1) for i in range(500, 560)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for l in links for x in l if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    linked = {x for a, b in links for x in (a, b) if a is not None and a != b}
    assert got == {x: find(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    canonical = '<link href="{}" rel="canonical">'.format
    refresh = "<meta http-equiv='refresh' content='0; url={}'>".format
    rows = [
        (1, "https://A.Example.com/en/1?x#y", None), (2, "http://example.com/en/7a", ""), (3, "x.net/de/", None), (4, None, None), (5, "https://q.net/de/8", None), (6, "ftp://w.example.net/de/8#", None),
        (7, "http://org/es/", None), (8, "http://notorg/es/", None), (9, "http://alias.test/p", canonical("https://shop.com/en/x")), (10, "https://other.test/a", refresh("//alias.test/p")), (11, "http://free.test", canonical("/self")),
        (12, "http://example.com/en/70", canonical("http://shop.com/en/x")), (12, "http://example.com/en/70", canonical("http://shop.com/en/x")), (13, "http://", None), (14, "a://b://c/d", None), (15, "https://last.test/z", refresh("http://other.test/a")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule")
    for limit in (urls.RULES_IN_PLAN, 0):
        urls.RULES_IN_PLAN = limit
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
        assert got == {
            1: ("a.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/7a", "example.com/en/7", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("q.net", "/de/8", "net/de/", "block"),
            6: ("w.example.net", "/de/8", "example.net/de/8", "block"), 7: ("org", "/es/", "org/es/", "block"), 8: ("notorg", "/es/", None, "allow"), 9: ("alias.test", "/p", None, "block"), 10: ("other.test", "/a", None, "block"),
            11: ("free.test", "", None, "allow"), 12: ("example.com", "/en/70", "example.com/en/7", "allow"), 13: ("", "", None, "allow"), 14: ("b:", "//c/d", None, "allow"), 15: ("last.test", "/z", None, "block"),
        }
    urls.RULES_IN_PLAN = 256
    more = spark.createDataFrame([("http://free.test/", "http://org/es/1")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, links=more).collect()}[11] == "block"
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_of_equal_length(spark):
    df = spark.createDataFrame([(1, "http://b.a.com/xy", None), (2, "http://a.com/x", None)], "page_id long, url string, html string")
    for limit in (256, 0):
        urls.RULES_IN_PLAN = limit
        for verdicts in (("allow", "block"), ("block", "allow")):
            rules = ((verdicts[0], "a.com", "/x"), (verdicts[1], "a.com", "/x"))
            assert {r["verdict"] for r in urls.judge(df, rules).collect()} == {"allow"} == {r["verdict"] for r in urls.judge(df, rules[::-1]).collect()}
        rules = (("block", "b.a.com", "/x"), ("block", "a.com", "/xy"), ("block", "com", "/"))
        assert {r["page_id"]: r["rule"] for r in urls.judge(df, rules).collect()} == {1: "b.a.com/x", 2: "com/"}
    urls.RULES_IN_PLAN = 256


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(5, "s", f"{w} b c d", "x") for w in "abcdefgh"] + [(None, "s", f"{w} y", "x") for w in "mno"] + [(9, "t", "p q r s t u v w x y z", "x")]
    shown = []
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        df = spark.createDataFrame(order, "doc_id long, source string, text string, text_key string").repartition(3)
        shown.append(sorted(map(str, mixing.mixed_documents(df).collect())))
    assert shown[0] == shown[1] == shown[2] and shown[0]


def test_line_stage_with_clashing_names(spark):
    import corpus_pipeline

    run = "one two\nthree four\nfive six"
    rows = [(1, run, 20, 0), (2, run, 20, 0), (3, f"{run}\nown", 24, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_removed int").selectExpr("*", "7 as _n_removed", "8 as n_runs")
    out = corpus_pipeline.line_dedup(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, run, 20, 0, 7, 8), (3, "own", 3, 0, 7, 8)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda n: "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(20)) for _ in range(n))
    boiler = "shared line one two three\nshared line four five six\nshared line seven eight nine"
    rows = [(i, f"{text(5)}\n{boiler}\n{text(1)}", "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[4][1], "en", "s1"), (101, "too few", "en", "s0"), (102, None, None, None), (103, "### $$$ " * 60, "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert docs.columns == df.columns
        seen[name] = docs.collect()
    keep = [r for r in rows if r[1] and not quality.measure(r[1].encode())[0] < 50 and r[0] != 103]
    assert sorted(r["doc_id"] for r in seen["quality rules"]) == sorted(r[0] for r in keep)
    first = True
    for r in sorted(seen["line dedup"], key=lambda r: r["doc_id"]):
        if r["doc_id"] < 100:
            assert (boiler in r["text"]) == first and r["n_chars"] == len(r["text"])
            first = False
    assert sorted(r["doc_id"] for r in seen["SimHash near-dedup"]) == list(range(30))
    total = sum(len(r["text"].split()) for r in seen["SimHash near-dedup"])
    assert abs(sum(len(r["text"].split()) for r in seen["mixing"]) - 1.5 * total) <= 3
    encoding, _ = bpe.build(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["ids"] for r in out) == sorted(encoding.encode_ordinary(r["text"]) for r in seen["mixing"])
    assert simhash.WORDS == 3
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
