"""LM scoring: a trigram model with Katz backoff.

Counts with r <= 5 are discounted by Good-Turing, and what a context loses goes to the words not seen after it, in
proportion to their probabilities after the context without its first word, by a weight that makes the context's
probabilities sum to one; and so on, recursively, down to unigrams. Unigrams are discounted alike; what they lose is the
probability of the one unknown word. Where the counts of counts allow no discount for some r, the limit is lowered; a
context (or the unigrams) that loses nothing, all its counts being above the limit, gives its unseen words one count:
c / (total + 1). The log-probability of a text is the sum, over its words and its end, of log10 p(token | the two before);
before the first word stand two starts.

Documents are tokenised once, into chunks. The counts of each order live in a table partitioned by context (a context that
has more than its share of all tokens: by context and word, in as many pieces as it has shares), and are formed from one
item per chunk and distinct n-gram. The tables answer each chunk with the counts of its own n-grams, and with the sums over
a context's words where the chunk has a word after it that the model hasn't seen there. The sums of a context in pieces
are added up in one part, and asked for along with the next order. Then every token is evaluated, order by order.
Words are told apart by 64 bits of hash, n-grams by the words' numbers.

Defined cases: a null text is empty, and has one token, its end; a null doc_id counts as the empty string in the choice
of training documents; repeated rows are documents of their own; without training tokens every token is unknown, with
probability one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import Workspace, map_batches
from groundwork.llm.exchange import Chunks, Table, added, mixed, pack, packed, part_of, received, runs, small, unpack, unpacked
from groundwork.llm.simhash import in_slices, xxh64

LIMIT, SEED = 5, 0
#: Folds by crc32 of the doc_id's text; this one is held out.
FOLDS, HELD_OUT = 5, 1
END = b"\n"  # no word
#: A context with more tokens than 1 / HOT_SHARE of a part's is dealt out in pieces.
HOT_SHARE = 1
#: Of a context: words seen after it 1, 2, ... LIMIT times, and the sum of what all of them have without its first word.
SUMS = [*(f"n{r}" for r in range(1, LIMIT + 1)), "lower"]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of all texts' tokens, each text's end included, and numbers of tokens."""
    tokens = [x.lower().split() + [END] for x in texts]  # bytes.lower() changes A-Z only
    data = b" ".join([b" ".join(x) for x in tokens]) + b" "
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], spaces[:-1] + 1))
    return xxh64(data, starts, spaces - starts, SEED), [len(x) for x in tokens]


def build(ids: list, texts: list[bytes]) -> dict[str, object]:
    """A chunk: its vocabulary, most frequent first, and its documents as indices into it."""
    parts = [token_hashes(group) for group in in_slices(texts)]
    words, index, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {"doc_ids": ids, "lengths": [n for p in parts for n in p[1]], "words": pack(words[order]), "tokens": pack(small(place[index]))}


TYPES = {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "words": pa.binary(), "tokens": pa.binary()}
SCHEMA = "doc_ids array<long>, lengths array<long>, words binary, tokens binary"


def discounts(n: list[int], limit: int = LIMIT) -> np.ndarray:
    """d[r] for r = 0 to limit, from n[r] n-grams counted r times (n[0] unused): the highest limit at which each is in (0, 1]."""
    for k in range(limit, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 1)):
            drop = (k + 1) * n[k + 1] / n[1]
            if drop < 1:
                d = np.array([1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - drop) / (1 - drop) for r in range(1, k + 1)])
                if (d > 0).all() and (d <= 1).all() and d[1:].min() < 1:
                    return d
    return np.ones(1)


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1.0) * count


def losing(d: np.ndarray) -> int:
    """The counts that lose something, as bits."""
    return sum(1 << r for r in range(1, len(d)) if d[r] < 1)


class Unigrams:
    """p of a word by its count, and of the unknown word."""

    def __init__(self, n: list[int], total: int):
        self.total, self.d = total, discounts(n)
        lost = sum((1 - self.d[r]) * r * n[r] for r in range(1, len(self.d)))
        self.plus = 0 if lost > 0 or not total else 1
        self.unknown = lost / total if lost > 0 else (1 / (total + 1) if total else 1.0)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(self.d, count) / max(1, self.total + self.plus), self.unknown)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each key its place among them."""
    order = np.argsort(keys)
    begin = runs(keys[order])
    index = np.empty(len(keys), np.int64)
    index[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    return keys[order[begin]], index


#: What requests for the sums of contexts in pieces have as `o`, above the order.
REQUEST = 10


class Order:
    """A chunk's distinct n-grams of one order, and what is known of them so far.

    context, word: of each n-gram, as places among the chunk's contexts and words, both in the order of numbers; index: the
    n-gram of each token; low: the n-gram without its first word; a, b: numbers of a context's words; total, count: in
    training, of contexts and n-grams.
    """

    def __init__(self, order: int, context: np.ndarray, tokens: np.ndarray, low: np.ndarray, train: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, number: np.ndarray, low_count: np.ndarray, hot: int, parts: int):
        keys, index = distinct(context.astype(np.int64) * len(number) + tokens)
        self.index, self.context, self.word = index.astype(np.int32), (keys // len(number)).astype(np.int32), (keys % len(number)).astype(np.int32)
        self.low = np.empty(len(keys), np.int32)
        self.low[self.index] = low
        del keys, index
        self.order, self.a, self.b, self.total, self.parts = order, a, b, total, parts
        self.pieces = np.maximum(1, -(-total // hot))  # of a context
        known = total[self.context] > 0
        can = known & (low_count[self.low] > 0)  # others can't have been seen
        self.asked = np.flatnonzero(can)
        blind = np.zeros(len(total), bool)
        blind[self.context[known & ~can]] = True
        # a context that is known, before a word that can't have been seen there: its sums are asked for under word 0
        self.marks = np.flatnonzero(blind & (self.pieces == 1))
        self.of = of = np.concatenate((self.marks, self.context[self.asked]))
        self.w = w = np.concatenate((np.zeros(len(self.marks), np.int64), number[self.word[self.asked]]))
        by = np.argsort(of, kind="stable")
        piece = np.where(self.pieces[of] > 1, mixed(w) % self.pieces[of].astype(np.uint64), 0)
        self.part = part_of(mixed(a[of], b[of], piece), parts)
        self.sent = by[np.argsort(self.part[by].astype(np.min_scalar_type(parts)), kind="stable")]
        self.train, self.low_count = train, low_count

    @property
    def question(self) -> Table:
        i, of, none = self.sent, self.of, np.zeros(len(self.marks), np.int64)
        n = np.concatenate((none, np.bincount(self.index[self.train], minlength=len(self.word))[self.asked]))
        x = np.concatenate((none, self.low_count[self.low[self.asked]]))
        return {"part": self.part[i], "o": np.full(len(i), self.order), "a": self.a[of][i], "b": self.b[of][i], "w": self.w[i], "n": n[i], "x": x[i], "s": self.pieces[of][i]}

    def take(self, got: Table) -> None:
        """The answers to the question. A context in one piece that an unseen word follows comes with its sums."""
        self.count, self.mask = np.zeros(len(self.word), np.int64), np.zeros(len(self.total), np.int64)
        self.sums = {k: np.zeros(len(self.total), np.float64 if k == "lower" else np.int32) for k in SUMS}
        self.summed = np.zeros(len(self.total), bool)
        if len(self.sent):
            of, n = self.of[self.sent], got["n"].astype(np.int64)
            np.bitwise_or.at(self.mask, of, np.where((n > 0) & (n <= LIMIT), 1 << np.minimum(n, LIMIT), got["mask"].astype(np.int64)))
            back = np.empty(len(n), np.int64)
            back[self.sent] = n
            self.count[self.asked] = back[len(self.marks) :]
            zero = np.flatnonzero((n == 0) & (self.pieces[of] == 1))[::-1]  # the first of a context has the sums
            for k in SUMS:
                self.sums[k][of[zero]] = got[k][zero]
            self.summed[of[zero]] = True
        self.of = self.w = self.part = self.sent = None  # no longer needed

    def hot(self) -> np.ndarray:
        return np.flatnonzero(self.pieces > 1)

    def requests(self) -> Table:
        """The question for the sums of contexts in pieces."""
        a, b = self.a[self.hot()], self.b[self.hot()]
        none = np.zeros(len(a), np.int64)
        part = part_of(mixed(a, b, none), self.parts)
        self.hot_sent = np.argsort(part, kind="stable")
        t = {"part": part, "o": none + REQUEST + self.order, "a": a, "b": b, "w": none, "n": none, "x": none, "s": none + 1}
        return {k: v[self.hot_sent] for k, v in t.items()}

    def take_hot(self, got: Table) -> None:
        self.requests()
        which = self.hot()[self.hot_sent]
        for k in SUMS:
            self.sums[k][which] = got[k]
        self.summed[which] = True

    def evaluate(self, d: np.ndarray, below: np.ndarray, under: np.ndarray | float) -> np.ndarray:
        """p of each n-gram. below: p of the n-grams without the first word; under: what the sums of `lower` are still to
        be divided by, for each context. Keeps what `total` grows by, as `plus`."""
        lost = np.zeros(len(self.total))
        for r in range(1, len(d)):
            lost += (1 - d[r]) * r * self.sums[SUMS[r - 1]]
        gains = np.where(self.summed, lost > 0, (self.mask & losing(d)) > 0)
        self.plus = np.where(gains, 0, 1)
        total = np.maximum(self.total + self.plus, 1)
        weight = np.where(self.total > 0, np.where(gains, lost, 1.0) / total / (1 - self.sums["lower"] / under), 1.0)
        return np.where(self.count > 0, discounted(d, self.count) / total[self.context], weight[self.context] * below[self.low])


class Loaded:
    """A chunk, with what the answers so far say about its n-grams, up to those of order `known`."""

    def __init__(self, row: dict, answers: list[dict], parts: int, hot: int = 1, known: int = 0):
        self.ids, self.lengths, tokens = row["doc_ids"], np.array(row["lengths"], np.int64), unpack(row["tokens"]).astype(np.int64)
        self.held = np.array([held_out(i) for i in self.ids])
        train = np.repeat(~self.held, self.lengths)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        if known < 1:
            words = unpack(row["words"])
            by_hash = np.argsort(words)
            self.question = {"part": part_of(words[by_hash], parts), "h": words[by_hash], "n": np.bincount(tokens[train], minlength=len(words))[by_hash]}
            return
        number, count = unpack(row["numbers"]).astype(np.int64), unpack(row["counts"]).astype(np.int64)
        by_number = np.argsort(number)
        number, self.count = number[by_number], count[by_number]
        rank = np.empty(len(number), np.int64)
        rank[by_number] = np.arange(len(number))
        self.tokens = rank[tokens]
        end = self.count[self.tokens[-1]]  # every text ends with it, and starts as often
        first = lambda at_start, x: np.concatenate(([at_start], x))
        before = first(0, self.tokens[:-1] + 1)
        before[self.starts] = 0  # the start
        self.two = Order(2, before, self.tokens, self.tokens, train, np.zeros(len(number) + 1, np.int64), first(0, number), first(end, self.count), number, self.count, hot, parts)
        if known < 2:
            return
        two = self.two
        two.take(received(answers, "bigrams"))
        context = first(0, two.index[:-1] + 1)
        context[self.starts] = 0  # the two starts
        self.context, self.train, self.number, self.args = context, train, number, (first(0, two.b[two.context]), first(0, number[two.word]), first(end, two.count))
        self.second = first(0, two.word + 1)  # the contexts without their first word, as contexts of bigrams
        self.parts, self.most = parts, hot

    def three(self) -> Order:
        return Order(3, self.context, self.tokens, self.two.index, self.train, *self.args, self.number, self.two.count, self.most, self.parts)


NUMBERED = "chunk long, doc_ids array<long>, lengths array<long>, tokens binary, numbers binary, counts binary"


def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk with its words' numbers and counts in training in place of their hashes."""
    row, got = left.to_pylist()[0], received(right.to_pylist(), "words")
    by_hash = np.argsort(unpack(row["words"]))
    own = {k: np.empty(len(by_hash), np.int64) for k in ("number", "n")}
    for k, v in own.items():
        v[by_hash] = got[k]
    return left.drop_columns("words").append_column("numbers", pa.array([pack(small(own["number"]))], pa.binary())).append_column("counts", pa.array([pack(small(own["n"]))], pa.binary()))


def number_words(at: int, words: Table, parts: int) -> dict[str, Table]:
    """Counts of a part's words, and their numbers, the most frequent first."""
    total = words["n"]
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    answer = {"n": total, "number": rank * parts + at + 1}
    of = np.bincount(np.minimum(total, LIMIT + 2), minlength=LIMIT + 3)
    return {"answer": answer, "table": {"h": words["h"], "n": total}, "totals": {"n": np.array([total.sum(), (total > 0).sum(), *of[1 : LIMIT + 2]], np.int64)}}


def sums_of(rows: Table, lower: np.ndarray) -> tuple[np.ndarray, Table]:
    """Of each context (a, b) of rows in its order: where it begins, how many words were seen after it 1, 2, ... LIMIT times, and the sum of `lower` of what was seen."""
    begin = runs(rows["a"], rows["b"])
    add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
    return begin, {**{k: add((rows["n"] == r).astype(np.int64)) for r, k in enumerate(SUMS[:LIMIT], 1)}, "lower": add(np.where(rows["n"] > 0, lower, 0.0))}


def rounded(x: np.ndarray) -> np.ndarray:
    """To 28 binary places, relatively: the other bits don't compress."""
    return ((x.view(np.int64) + (1 << 23)) & ~np.int64((1 << 24) - 1)).view(np.float64)


def count_ngrams(order: int, rows: Table, low_share: Callable[[np.ndarray], np.ndarray], have: list[Table]) -> dict[str, Table]:
    """Counts of a part's n-grams, which counts occur after their contexts, sums where a word is unseen; the table to keep,
    and the sums of contexts in pieces. Requests for such sums of the order below are answered from what was kept of them."""
    size, asked = len(rows["n"]), np.flatnonzero(rows["o"] == order)
    own = {k: v[asked] for k, v in rows.items()}
    n = own["n"]
    begin, sums = sums_of(own, low_share(own.pop("x").astype(np.int64)))
    sums["lower"] = rounded(sums["lower"])
    width = np.diff(np.append(begin, len(n)))
    mask = np.bitwise_or.reduceat(np.where((n > 0) & (n <= LIMIT), 1 << np.minimum(n, LIMIT), 0), begin) if len(begin) else n
    answer = {"n": np.zeros(size, np.int64), "mask": np.zeros(size, np.int64), **{k: np.zeros(size, v.dtype) for k, v in sums.items()}}
    answer["n"][asked], answer["mask"][asked] = n, np.repeat(mask, width)
    zero = n == 0
    for k, v in sums.items():
        answer[k][asked[zero]] = np.repeat(v, width)[zero]
    requests = np.flatnonzero(rows["o"] > REQUEST)
    for t in have:
        at = places_in(t["a"], t["b"], rows["a"][requests], rows["b"][requests])
        for k in sums:
            answer[k][requests[at >= 0]] = t[k][at[at >= 0]]
    hot = np.flatnonzero(own["s"][begin] > 1)
    out = {
        "answer": answer, "table": {k: own[k][~zero] for k in ("a", "b", "w", "n")},
        "totals": {"n": np.append(np.bincount(np.minimum(n, LIMIT + 2), minlength=LIMIT + 3)[1 : LIMIT + 2], len(hot))},
    }
    if len(hot):
        out["hot"] = {"a": own["a"][begin[hot]], "b": own["b"][begin[hot]], **{k: v[hot] for k, v in sums.items()}}
    return out


def tidied(asked: Table, answer: Table) -> Table:
    """Sums are left with the first unseen word of a context, and which counts occur with words counted too often to tell."""
    own = asked["o"] < REQUEST
    zero = np.flatnonzero(own & (answer["n"] == 0))
    first = zero[runs(asked["a"][zero], asked["b"][zero])]
    keep = ~own
    keep[first] = True
    return {k: np.where(keep, v, 0) if k in SUMS else np.where(answer["n"] > LIMIT, v, 0) if k == "mask" else v for k, v in answer.items()}


def places_in(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """For each pair (of_a, of_b) its place among the distinct pairs (a, b), -1 if it isn't there."""
    first, second = np.concatenate((a, of_a)).astype(np.uint64), np.concatenate((b, of_b)).astype(np.uint64)
    order = np.lexsort((np.arange(len(first)), second, first))
    begin = runs(first[order], second[order])
    head = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    out = np.empty(len(first), np.int64)
    out[order] = np.where(head < len(a), head, -1)
    return out[len(a) :]


def whole_sums(hot: DataFrame, parts: int) -> DataFrame:
    """at, blob: the sums of contexts in pieces, added up over the pieces, in the parts that are asked for them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in map(unpacked, b.column("blob").to_pylist()):
                at = part_of(mixed(t["a"], t["b"], np.zeros(len(t["a"]), np.int64)), parts)
                yield pa.RecordBatch.from_pydict({"at": pa.array(at), **{k: pa.array(t[k].astype(np.int64)) for k in ("a", "b", *SUMS[:LIMIT])}, "lower": pa.array(t["lower"].astype(np.float64))})

    def gathered(rows: pa.Table) -> pa.Table:
        return pa.table({"at": pa.array([rows.column("at")[0].as_py()], pa.int64()), "blob": pa.array([packed({k: rows.column(k).to_numpy() for k in ("a", "b", *SUMS)})], pa.binary())})

    rows = map_batches(hot, each, ", ".join(f"{x} long" for x in ("at", "a", "b", *SUMS[:LIMIT])) + ", lower double")
    return rows.groupBy("at", "a", "b").agg(*(F.sum(x).alias(x) for x in SUMS)).groupBy("at").applyInArrow(gathered, "at long, blob binary")


def both(x: Table, y: Table) -> Table:
    """Two tables sorted by part as one."""
    t = {k: np.concatenate((x[k], y[k])) for k in x}
    order = np.argsort(t["part"], kind="stable")
    return {k: v[order] for k, v in t.items()}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    work = Workspace(docs.sparkSession, "katz")
    with Chunks(docs, work, build, TYPES, SCHEMA) as chunks:
        return _score(work, chunks)


def _score(work: Workspace, chunks: Chunks) -> DataFrame:
    parts, ngrams = chunks.parts, added(("o", "a", "b", "w"), ("n",))
    total = lambda asked, size: sum((x["n"].astype(np.int64) for x in asked.totals()), np.zeros(size, np.int64)).tolist()
    words = chunks.ask(None, lambda row, _: Loaded(row, [], parts).question, added(("h",), ("n",)), lambda at, rows, _: number_words(at, rows, parts), "words")
    n_train, n_distinct, *of = total(words, LIMIT + 3)
    unigrams, hot = Unigrams([0, *of], n_train), max(1, n_train // (HOT_SHARE * parts))

    chunks.replace(words.answers, numbered, NUMBERED)
    work.drop("words/kind=answer")
    bigrams = chunks.ask(None, lambda row, got: Loaded(row, got, parts, hot, 1).two.question, ngrams, lambda _, rows, have: count_ngrams(2, rows, unigrams.p, have), "bigrams", tidy=tidied)
    *of, hot_2 = total(bigrams, LIMIT + 2)
    d2 = discounts([0, *of])
    known = bigrams.answers

    def ask_trigrams(row: dict, got: list[dict]) -> Table:
        x = Loaded(row, got, parts, hot, 2)
        return both(x.three().question, x.two.requests())

    trigrams = chunks.ask(known, ask_trigrams, ngrams, lambda _, rows, have: count_ngrams(3, rows, lambda x: discounted(d2, x), have), "trigrams", whole_sums(bigrams.kept("hot"), parts) if hot_2 else None, tidied)
    *of, hot_3 = total(trigrams, LIMIT + 2)
    d3 = discounts([0, *of])

    if hot_3:
        def requests(row: dict, got: list[dict]) -> Table:
            x = Loaded(row, got, parts, hot, 2)
            return hot_trigrams(x).requests()

        sums = chunks.ask(known, requests, ngrams, lambda _, rows, have: count_ngrams(3, rows, lambda x: discounted(d2, x), have), "sums", whole_sums(trigrams.kept("hot"), parts))
        known = known.union(sums.answers)
    known = known.union(trigrams.answers)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], right.to_pylist()
        x = Loaded(row, answers, parts, hot, 2)
        two, three = x.two, x.three()
        said, cut = received(answers, "trigrams"), len(three.sent)
        order = np.argsort(np.concatenate((three.part[three.sent], two.requests()["part"])), kind="stable")  # as `both` put them
        got = {k: np.empty(len(order), v.dtype) for k, v in said.items()}
        for k, v in said.items():
            got[k][order] = v
        more = len(order) > cut
        del said, order
        three.take({k: v[:cut] for k, v in got.items()})
        if more:
            two.take_hot({k: v[cut:] for k, v in got.items()})
        if len(three.hot()):
            three.take_hot(received(answers, "sums"))
        p = two.evaluate(d2, unigrams.p(x.count), 1.0)
        under = np.maximum(two.total + two.plus, 1)[x.second]
        log_p = np.log10(three.evaluate(d3, p, under))
        base = np.log10((x.count + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
        summed = lambda v: np.add.reduceat(v, x.starts)
        return pa.table({
            "doc_id": pa.array(x.ids, pa.int64()), "held_out": pa.array(x.held), "n_tokens": pa.array(x.lengths), "n_known": pa.array(summed((x.count > 0).astype(np.int64)[x.tokens])),
            "train_tokens": pa.array(np.full(len(x.ids), n_train, np.int64)), "base_score": pa.array(summed(base[x.tokens])), "score": pa.array(summed(log_p[three.index])),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = work.write(chunks.with_answers(known, evaluate, schema), "scores")
    work.drop("words", "bigrams", "trigrams", "sums")
    return out


def hot_trigrams(x: Loaded) -> Order:
    """The order of trigrams with no n-grams: its contexts alone are asked about."""
    none = np.empty(0, np.int64)
    return Order(3, none, none, none, np.empty(0, bool), *x.args, x.number, x.two.count, x.most, x.parts)
