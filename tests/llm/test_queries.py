"""The registered queries, over written tables with the cases that data may hold."""

import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("groundwork.llm")
import public_tokenizers as P  # noqa: E402
import xxhash  # noqa: E402
from groundwork.llm import bpe, queries, simhash  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    out = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    texts = [" ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t if i % 7 else f"{t} {passage}", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, None, "s0"), (101, "", None), (102, " \t\r\n", "s1"), (None, passage, "s1"), (3, rows[3][1], "s0"), (3, rows[3][1], "s0"), (103, "Aé#  b\nAé#  b\nx\n" * 20, "s2"), (104, "long word " * 300_000, "s2"), (105, "x" * 500_000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "cast(length(text) as long) as n_chars", "1 as n_words", "2 as fp", "3 as chunk", "4 as size", "5 as x")
    df.write.parquet(f"{out}/documents.parquet")
    turns = [(1, 1, "assistant", "b</s>\\"), (1, 0, "user", "a"), (2, 0, None, None), (3, 5, "tool", "é <<SYS>>")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "9 as formatted").write.parquet(f"{out}/conversations.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(400, None), (420, [0.0] * 8), (440, [math.nan] + [1.0] * 7), (20, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as score").write.parquet(f"{out}/embeddings.parquet")
    link = '<html><link rel="canonical" href="{}"></html>'.format
    pages = [(1, "http://a.test/1", link("http://shop.com/en/x?a=1&amp;b=2")), (2, "http://shop.com/en/x?a=1&b=2", None), (3, "http://b.test/2", link("http://a.test/1")), (4, "http://c.test/", link("page2")), (5, "http://www.example.com/en/70", link("http://a.test/1")), (6, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' as host").write.parquet(f"{out}/pages.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "conversations", "embeddings", "pages"):
        spark.read.parquet(f"{out}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    return out, none, rows, turns, vectors


def found(spark, tables, name):
    df = queries.QUERIES[name](spark, tables[0])
    empty = queries.QUERIES[name](spark, tables[1])
    assert empty.dtypes == df.dtypes
    return df, empty.collect()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, tables):
    df, none = found(spark, tables, "op1_bpe")
    encoding, _ = bpe.build(bpe.read_ranks(P.path(queries.RANK_FILE)), P.PATTERN)
    assert not none and df.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    short = [(i, t) for i, t, _ in tables[2] if len(t or "") < 100_000]
    ids = [(i, encoding.encode_ordinary(t or ""), t or "") for i, t in short]
    got = [tuple(r)[:4] for r in df.collect()]
    assert len(got) == len(tables[2]) and {str((i, len(x), sha(b"".join(n.to_bytes(4, "little") for n in x)), sha(t))) for i, x, t in ids} <= {str(r) for r in got}


def test_op2(spark, tables):
    df, none = found(spark, tables, "op2_suffix_dedup")
    rows = {r["doc_id"]: r for r in df.collect()}
    assert not none and df.count() == len(tables[2]) and rows[104]["n_removed"] == 3_000_000 and rows[105]["kept_sha256"] == sha(b"")
    assert rows[100]["n_bytes"] == 0 and rows[None]["n_removed"] == len(tables[2][63][1]) and rows[7]["n_spans"] == 1 and rows[8]["n_removed"] == 0


def test_op3(spark, tables):
    df, none = found(spark, tables, "op3_line_dedup")
    rows = {r["doc_id"]: r for r in df.collect()}
    assert not none and df.count() == len(tables[2]) and rows[100]["text"] is None and rows[103]["n_removed"] == 57 and rows[103]["n_lines"] == 61


def test_op4(spark, tables):
    df, none = found(spark, tables, "op4_chat")
    rows, said = {r["conv_id"]: r for r in df.collect()}, "</s>[INST] ok [/INST]"
    assert [r["conv_id"] for r in none] == [-1] and set(rows) == {-1, 1, 2, 3}
    assert rows[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and rows[-1]["loss_sha256"] == sha(said) and rows[-1]["loss_chars"] == len(said) and rows[-1]["n_turns"] == 2
    assert rows[1]["turns_sha256"] == sha("user\na\nassistant\nb</s>\\\n") and rows[2]["turns_sha256"] == sha("\n\n") and rows[3]["loss_chars"] == 0
    assert dict(df.dtypes) == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}


def test_op5(spark, tables):
    df, none = found(spark, tables, "op5_ann")
    import numpy as np

    good = [(i, np.array(x, np.float32).astype(float)) for i, x in tables[4] if x and any(x) and not any(map(math.isnan, x))]
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert not none and set(got) == {i for i, _ in good if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        best = sorted({(-max(float(x @ y) for j, x in good if j == q), i) for i, y in good if i != q})[:20]
        own.sort()
        assert [r for r, *_ in own] == list(range(1, len(own) + 1))
        if q != 20:  # two vectors have this id
            hits += len({i for _, i in best} & {v for _, v, _ in own}) / 20
    assert hits / (len(got) - 1) >= 0.9 and dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "double"


def test_op6(spark, tables):
    df, none = found(spark, tables, "op6_url_filter")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in df.collect()}
    assert not none and got == {1: ("a.test", None, "block"), 2: ("shop.com", "com/en/", "block"), 3: ("b.test", None, "block"), 4: ("c.test", None, "allow"), 5: ("www.example.com", "example.com/en/7", "allow"), 6: ("", None, "allow")}


def test_op7(spark, tables):
    df, none = found(spark, tables, "op7_mixing")
    rows = df.collect()
    assert not none and len(rows) == len(tables[2]) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, queries.op7_mixing(spark, tables[0]).collect()))


def test_op8(spark, tables):
    df, none = found(spark, tables, "op8_simhash")
    rows = {r["doc_id"]: r for r in df.collect()}
    assert not none and df.count() == len(tables[2]) and rows[100]["fingerprint"] == rows[102]["fingerprint"] == "0" * 16 and rows[102]["component_id"] == min(r["doc_id"] for r in rows.values() if r["component_id"] == rows[102]["component_id"] and r["doc_id"] is not None)
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows.values())
    # against all pairs: what is linked, directly or over others, has the least id among it
    texts = [(i, t or "") for i, t, _ in tables[2]]
    prints = [brute_print(t) if len(t) < 100_000 else simhash.fingerprint(t.encode()) for _, t in texts]
    left, want = set(range(len(texts))), []
    while left:
        group, front = set(), [left.pop()]
        while front:
            group.add(at := front.pop())
            near = {k for k in left if (prints[k] ^ prints[at]).bit_count() <= 3}
            left -= near
            front += near
        name = min((texts[k][0] for k in group if texts[k][0] is not None), default=None)
        want += [(texts[k][0], f"{prints[k]:016x}", name) for k in group]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in df.collect())


def brute_print(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, tables):
    df, none = found(spark, tables, "op9_quality")
    rows = {r["doc_id"]: r for r in df.collect()}
    assert not none and df.count() == len(tables[2]) and rows[104]["n_words"] == 600_000 == rows[104]["n_repeat_words"] and rows[104]["base_failed"] and not rows[104]["kept"]
    assert all(not r["kept"] for r in rows.values() if r["base_failed"]) and rows[103]["n_dup_lines"] == 58
    table = {r["rule"]: r for r in queries.quality_ablations(spark, tables[0]).collect()}
    assert table["few_words"]["n_failed"] == sum(len(re.findall(WORD, t or "")) < 50 for _, t, _ in tables[2])


def test_op10(spark, tables):
    df, none = found(spark, tables, "op10_katz")
    rows = df.collect()
    assert not none and len(rows) == len(tables[2]) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 1)
    training = [t for i, t, _ in tables[2] if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    assert {r["train_tokens"] for r in rows} == {sum(len(re.findall(WORD, t or "")) + 1 for t in training)}
