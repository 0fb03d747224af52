"""BPE, chat, quality, SimHash, Katz, suffix arrays: against brute force and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("groundwork.llm")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
import xxhash  # noqa: E402
from groundwork.llm import ann, bpe, chat, exchange, jaccard, katz, lines, quality, repeats, sais, simhash  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, "Hello  world'll\n\n  x 12ab!"), (2, None), (3, ""), (None, "<|endoftext|> été 🎉"), (3, "same"), (3, "same"), (4, "word " * 30_000), (5, "x" * 70_000 + " y\u2003\x1c z"), (6, " \t\r\n")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'s' as source", "1 as n_words", "2 as Score", "3 as runs", "4 as line_doc", "5 as n", "6 as kept_id") if extra else df


def test_bpe_equals_the_library_and_decodes(spark):
    merge, _ = bpe.build(bpe.read_ranks(RANKS), P.PATTERN)
    want = [(i, ids := tiktoken.Encoding.encode_ordinary(merge, t or ""), (t or "").encode()) for i, t in ODD]
    want = sorted((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest()) for i, ids, b in want)
    got = bpe.encode(spark, docs(spark, ODD), RANKS, P.PATTERN, with_ids=True)
    assert sorted((str(r[0]), *r[1:4]) for r in got.collect()) == want
    back = bpe.decode(spark, got, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.encode(spark, docs(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bpe_pieces_join_to_the_same_ids(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "\x1c", "\u2003", "'s", "1", "!", "\t"]) for _ in range(3000))
    encoding, _ = bpe.build(bpe.read_ranks(RANKS), P.PATTERN)
    pieces = list(bpe.safe_pieces(text, 50))
    assert "".join(pieces) == text and len(pieces) > 5
    assert [i for p in pieces for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_bpe_cuts_no_text_under_another_pattern(spark):
    pattern = r"\S+\n*|\s+"  # takes line feeds along, which the boundary would part
    text = "word\nword\n" * 20_000
    encoding, _ = bpe.build(bpe.read_ranks(RANKS), pattern)
    got = bpe.encode(spark, docs(spark, [(1, text)]), RANKS, pattern, with_ids=True).first()
    assert got["ids"] == encoding.encode_ordinary(text)


def test_chat_round_trip_of_random_control_strings():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["</s>", "[INST]", "[/INST]", " ", "\\", "<", "<<", "<s>", "a", "\n", "<</SYS>>", "]"]) for _ in range(rng.randint(0, 14)))
        for role in ("user", "assistant", "tool", "", "x\n\\<"):
            whole = chat.render(role, text) + chat.render("user", "q") + chat.render(role, text)
            assert list(chat.parse(whole)) == [(role, text), ("user", "q"), (role, text)]
    with pytest.raises(chat.GrammarError):
        list(chat.parse("no turn"))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, None, None), (2, 0, "assistant", "x\\"), (2, 0, "assistant", "x\\"), (2, 5, "tool", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = [x for _, r, x in turns if r == "assistant"]
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == sum(map(len, said))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, x)) for _, r, x in turns)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def brute_quality(t):
    w, ls = re.findall(WORD, t or ""), [x for x in (t or "").split("\n") if re.search(WORD, x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    rep = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(rep), len(ls)


def test_quality_ledger_policies_and_ablations(spark):
    rows = [*ODD, (7, "a b c a b c\nx y\nx y\n \nx y"), (8, "é# &b " * 60), (9, "a a a a"), (10, " ".join(f"word{i}" for i in range(60)))]
    got = quality.ledger(docs(spark, rows)).collect()
    assert sorted(map(str, [(r[0], *r[1:7]) for r in got])) == sorted(map(str, [(i, *brute_quality(t)) for i, t in rows]))
    kept = quality.ledger(docs(spark, rows)).where(quality.keeps(quality.F.col("failed_mask"), "v1"))
    assert [r["doc_id"] for r in kept.collect()] == [10]
    table = {r["rule"]: r for r in quality.ablations(quality.ledger(docs(spark, rows)), "v1").collect()}
    assert set(table) == set(quality.RULES) and table["few_words"]["n_failed"] == sum(brute_quality(t)[0] < 50 for _, t in rows)
    # of each version every rule can decide: alone if it is fatal or nothing is tolerated, beside another if one is
    for name, p in quality.POLICIES.items():
        kept = lambda *rules, name=name: spark.range(1).select(quality.keeps(quality.F.lit(quality.bits(rules)), name)).first()[0]
        assert kept() and all(not kept(x) for x in p["fatal"])
        assert all(kept(x) == bool(p["tolerated"]) and any(not kept(x, y) for y in quality.RULES) for x in p["soft"])
    out = quality.kept_documents(docs(spark, rows), "v1")
    assert out.columns == docs(spark, rows).columns and [r["doc_id"] for r in out.collect()] == [10]
    assert quality.ledger(docs(spark, [])).count() == 0


def test_quality_of_long_texts_in_slices(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(quality, "SLICE", 9)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b", "é", "#", " ", "\n", "\t", "ab"]) for _ in range(rng.randint(0, 60)))
        assert quality.measure(t.encode()) == brute_quality(t)


def brute_fp(t):
    w = re.findall(WORD, lower(t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_fingerprints():
    rng = random.Random(2)
    texts = [*(t or "" for _, t in ODD), "A b", "a", "q" * 40 + " r s t", *(" ".join(rng.choice(["Ab", "cé", "d", "efghijklmnop"]) for _ in range(n)) for n in range(40))]
    assert simhash.fingerprints([t.encode() for t in texts]) == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("limit", [simhash.KEY_LIMIT, 5])
def test_simhash_classes_lose_no_link(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(12)]
    fps = sorted({*base, *near, 0})
    want = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    work = simhash.Workspace(spark, "t")
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    links = [(r[0] % 2**64, r[1] % 2**64) for r in simhash.links_within(df, work, limit).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert components(fps, links) == want


def test_simhash_one_of_each(spark):
    rows = [(5, "a b c d e f g h"), (2, "A b c d e f g h"), (9, None), (4, " "), (None, "zz yy xx"), (7, "other words stand here now"), (7, "other words stand here now")]
    out = simhash.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {5: 2, 2: 2, 9: 4, 4: 4, None: None, 7: 7} and len(out) == 7
    left = simhash.one_of_each(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "4", "7", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def good_turing(counts):
    """d of each count of these n-grams: of an independent form of the rule, r* / r after the mass of counts above the limit is taken out."""
    n = Counter(counts)
    for k in (5, 4, 3, 2, 1):
        if any(n[r] == 0 for r in range(1, k + 1)):
            continue
        top = (k + 1) * n[k + 1] / n[1]
        if top >= 1:
            continue
        d = {r: ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) for r in range(1, k + 1)}
        if all(0 < x <= 1 for x in d.values()) and min(d.values()) < 1:
            return d
    return {}


class BruteKatz:
    """p(word | history) by the definition, from whole dictionaries of counts."""

    def __init__(self, texts):
        self.counts = {o: Counter() for o in (1, 2, 3)}
        for x in texts:
            padded = ["^", "^", *x]
            for i in range(2, len(padded)):
                for o in (1, 2, 3):
                    self.counts[o][tuple(padded[i - o + 1 : i + 1])] += 1
        self.d = {o: good_turing(c.values()) for o, c in self.counts.items()}
        self.after = {o: defaultdict(dict) for o in (1, 2, 3)}
        for o, c in self.counts.items():
            for g, n in c.items():
                self.after[o][g[:-1]][g[-1]] = n
        self.known, self.weights = set(self.after[1][()]), {}

    def left(self, history):
        """What a history has for words not seen after it, and by what its counts are divided."""
        seen, d = self.after[len(history) + 1].get(history), self.d[len(history) + 1]
        if not seen:
            return 1.0, 1
        total = sum(seen.values())
        lost = sum((1 - d.get(n, 1.0)) * n for n in seen.values())
        return (lost / total, total) if lost > 0 else (1 / (total + 1), total + 1)

    def p(self, word, history):
        o = len(history) + 1
        seen, (left, total) = self.after[o].get(history, {}), self.left(history)
        if word in seen:
            return self.d[o].get(seen[word], 1.0) * seen[word] / total
        if o == 1:
            return left  # the one unknown word
        if history not in self.weights:
            self.weights[history] = left / (1 - sum(self.p(w, history[1:]) for w in seen))
        return self.weights[history] * self.p(word, history[1:])


def brute_katz(rows):
    tok = lambda t: [*re.findall(WORD, lower(t or "")), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    model = BruteKatz([tok(t) for i, t in rows if not held(i)])
    uni = Counter({w: n for (w,), n in model.counts[1].items()})
    n, v = sum(uni.values()), len(uni)
    for o in (1, 2, 3):  # every history's probabilities sum to one
        for h in sorted(model.after[o])[:25] + [("no", "such")[: o - 1]]:
            assert math.isclose(sum(model.p(w, h) for w in model.known) + model.p(None, h), 1)
    for i, t in rows:
        x = tok(t)
        padded = ["^", "^", *x]
        score = sum(math.log10(model.p(padded[k], (padded[k - 2], padded[k - 1]))) for k in range(2, len(padded)))
        yield i, held(i), len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), score


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 20_000)


@pytest.mark.parametrize(("fan", "share"), [(exchange.FAN, katz.HOT_SHARE), (2, 200)])
def test_katz(spark, monkeypatch, small_chunks, fan, share):
    """fan 2: answers come over several relays; share 200: most contexts are in pieces."""
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    many = [(i, " ".join(rng.choice(words[: 2 + rng.randrange(58)]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    cases = (many + [(500, None), (None, "a A"), (3, "x y"), (3, "x y"), (501, "new words only")], [(5, "q r s")], [(0, "h e l d")], [])
    for rows in cases if fan > 2 else cases[:1]:
        got = sorted((tuple(r) for r in katz.score(docs(spark, rows)).collect()), key=lambda r: (str(r[0]), r[2:]))
        want = sorted(brute_katz(rows), key=lambda r: (str(r[0]), r[2:])) if rows else []
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-6) and math.isclose(g[6], w[6], abs_tol=1e-6)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("groundwork_chunks")]


def test_exchange_hops():
    assert [exchange.spans_of(n) for n in (1, 128, 129, 16384, 16385, 10**7)] == [[1], [1], [2, 1], [128, 1], [129, 2, 1], [78125, 611, 5, 1]]


@pytest.mark.parametrize("alphabet", [0, 1024])
def test_suffix_arrays(monkeypatch, alphabet):
    monkeypatch.setattr(sais, "ALPHABET", alphabet)
    rng = random.Random(alphabet)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 8])
        b = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        order = sais.suffix_array(np.array(b, np.uint8), k + 1).tolist()
        assert order == sorted(range(len(b)), key=lambda i: b[i:])
        prefix = sais.permuted_lcp(bytes(b), np.array(order), 20)
        for x, y in zip(order, order[1:], strict=False):
            n = 0
            while x + n < len(b) and y + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert prefix[y] == min(n, 20)


def brute_repeats(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(b[s : s + 200] for _, b in texts for s in range(len(b) - 199))
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if c[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats(spark, small_chunks, hot):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(700))
    rows = [(k, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 400))) + passage[rng.randint(0, 200) : rng.randint(300, 700)] + "".join(rng.choice("xyzé") for _ in range(300))) for k in range(60)]
    rows += [(1000, None), (1001, ""), (None, "z" * 1000), (1002, "ab" * 300), (3, rows[3][1]), (3, rows[3][1]), (1003, "q" * 199), (1004, "q" * 200)]
    got = repeats.find(docs(spark, rows), hot, with_spans=True).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, brute_repeats(rows)))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert repeats.find(docs(spark, [])).count() == 0


def brute_lines(rows, m):
    split = [(i, t, t.split("\n")) for i, t in sorted(set((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0))]
    seen, gone = set(), defaultdict(set)
    for i, t, ls in split:
        for a in range(len(ls) - m + 1):
            run = tuple(ls[a : a + m])
            if run in seen:
                gone[i, t].update(range(a, a + m))
            seen.add(run)
    for i, t in rows:
        if t is None:
            yield i, None, 0, 0
        else:
            ls = t.split("\n")
            yield i, "\n".join(x for j, x in enumerate(ls) if j not in gone[i, t]), len(ls), len(gone[i, t])


@pytest.mark.parametrize("fan", [exchange.FAN, 2])
def test_similarity_classes_and_the_pipelines_stage(spark, monkeypatch, fan):
    import corpus_pipeline

    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 8_000)
    rng = random.Random(8)
    texts = []
    for size in (120, 120, 40, 700):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for k in (0, 0, 1, 1, 2, 3, 4, 6, 2, 3, 1, 5, 8, 12):
            w = list(base)
            for _ in range(k * max(1, size // 120)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(12)}"
            texts.append(" ".join(w[: rng.choice([len(w), len(w), size - 3])]) + " common words that all of them have at their end")
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "one two"), (903, "One  two"), (None, texts[0]), (3, texts[3]), (3, texts[3]), (900, "")]
    w = [re.findall(WORD, lower(t or "")) for _, t in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) / len(a | b) >= 0.8]
    assert len(near) > 60 and any(sets[i] != sets[j] for i, j in near)
    root, named = components(range(len(rows)), near), {}
    for k, r in root.items():
        named.setdefault(r, []).append(rows[k][0])
    want = sorted((str(rows[k][0]), min(x for x in named[r] if x is not None)) for k, r in root.items())
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.classes_of(docs(spark, rows)).collect()) == want
    if fan > 2:
        assert any((simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode())).bit_count() > 3 for i, j in near if rows[i][1] and rows[j][1])
        kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), "")
        assert kept.columns == docs(spark, rows).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for _, i in want})
        assert simhash.one_of_each(docs(spark, []), words=5, similarity=0.8).count() == 0


def test_odd_sketches_never_exceed_the_difference(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(60):
        n = int(rng.integers(1, 3000))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        pairs.append((np.unique(x), np.unique(np.concatenate((x[: int(n * rng.uniform(0.4, 1))], rng.integers(0, 2**63, int(rng.integers(0, 300))).astype(np.uint64))))))
    df = spark.createDataFrame([(i, *(jaccard.odd_sketch(s).view(np.int64).tolist() for s in p)) for i, p in enumerate(pairs)], "i int, a array<long>, b array<long>")
    got = dict(df.select("i", jaccard.apart(jaccard.F.col("a"), jaccard.F.col("b"))).collect())
    for i, (x, y) in enumerate(pairs):
        assert got[i] <= len(np.setxor1d(x, y))
    assert got[0] > 0 and all(len(jaccard.odd_sketch(x)) <= jaccard.MOST_LONGS for x, _ in pairs)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))) for k in range(25)] + [(30, None), (31, ""), (None, "a\nb\nc\nd\na"), (32, "z\n" * 12), (7, "a\nb\nc"), (33, "\n".join(f"u{i}" for i in range(50)))]
    rows.append(rows[4])
    got = lines.dedup_lines(docs(spark, rows), m)
    assert got.columns == [*docs(spark, rows).columns, "n_lines", "n_removed", "n_runs"]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()))) == sorted(map(str, brute_lines(rows, m)))
    if m == 3:
        assert lines.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("m", [1, 3, 4])
def test_line_dedup_by_words(spark, m):
    rng = random.Random(m)
    pool = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefg", (1, 2, 3, 5, 6, 9, 0), strict=True)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for k in range(30)] + [(40, pool[5]), (41, f"new\n{pool[5]}"), (42, None)]
    seen, want = set(), []
    for i, t in rows:
        ls, gone = [] if t is None else t.split("\n"), set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if run in seen and (b - a >= m or sum(len(x.split()) for x in run) >= 8):
                    gone.update(range(a, b))
                seen.add(run)
        want.append((i, t if t is None else "\n".join(x for j, x in enumerate(ls) if j not in gone), len(ls), len(gone)))
    got = lines.dedup_lines(docs(spark, rows), m, min_words=8)
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()))) == sorted(map(str, want))


def test_registered_line_dedup_removes_a_long_line(spark, tmp_path):
    from groundwork.llm import queries

    long = " ".join(f"w{i}" for i in range(50))
    spark.createDataFrame([(1, long), (2, f"own\n{long}"), (3, "own")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()} == {1: long, 2: "own", 3: "own"}


def test_nearest(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (None, [3.0, 3.0]), (8, [9.0, 1.0]), (8, [9.0, 1.0]), (40, [1.0, 2.0, 3.0]), (9, [1.0, 1.0, 1.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as query", "3 as x")
    good = {(i, tuple(x)) for i, x in rows if i is not None and x and None not in x and nan not in x and not any(map(math.isnan, x)) and any(x)}
    want = []
    for i, x in sorted(q for q in good if q[0] % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in good if j != i and len(y) == len(x))[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, "vec_id", "embedding").orderBy("query_id", "rank")
    assert [tuple(r) for r in got.collect()] == want
    assert ann.nearest(df.limit(0), df.limit(0), 20, "vec_id", "embedding").count() == 0


def lengths_of(kind, rng, n):
    out = {"noise": np.ones(n), "uniform": rng.uniform(0.5, 2, n), "log-normal": rng.lognormal(size=n), "long": np.ones(n), "very long": np.ones(n)}[kind]
    out[::100] *= {"long": 5, "very long": 10}.get(kind, 1)
    return out


@pytest.mark.parametrize("kind", ["noise", "uniform", "log-normal", "long", "very long"])
def test_recall_within_a_shard(kind):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(3000, 64)) * lengths_of(kind, rng, 3000)[:, None]).astype(np.float32)
    order, bands = ann.build_bands(x, 21)
    found, scores = ann.search_bands(x[order], bands, x[::20], 21)
    true = -np.sort(-(x[::20].astype(float) @ x.astype(float).T), axis=1)[:, 19:20]
    assert (-np.sort(-scores, axis=1)[:, :20] >= true - 1e-9).mean() >= 0.95
    assert all(len(set(f[f >= 0])) == (f >= 0).sum() for f in found)


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2400, 32)) * lengths_of("uniform", rng, 2400)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, "vec_id", "embedding", shard_rows=500).toPandas()
    every = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, own in got.groupby("query_id"):
        want = [j for j in np.lexsort((np.arange(2400), -every[q])).tolist() if j != q][:20]
        assert len(own) == 20 and (own.sort_values("rank")["score"].diff().dropna() <= 0).all() and q not in own["vec_id"].tolist()
        hits += len(set(want) & set(own["vec_id"]))
    assert hits / (20 * 120) >= 0.95
    wide = df.selectExpr("vec_id", "cast(embedding as array<double>) embedding").limit(50)
    r = ann.nearest(wide, wide.where("vec_id = 0"), 1, "vec_id", "embedding").first()
    assert r["score"] == max(float(np.dot(x[0].astype(float), x[j].astype(float))) for j in range(1, 50)) or abs(r["score"] - max(every[0, 1:50])) < 1e-12
