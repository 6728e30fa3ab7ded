"""Scores of texts under an n-gram model with Katz backoff.

Counts of n-grams are Good-Turing discounted for each n; a history that was seen with a word gives the discounted
share, else its backoff weight times the word's probability after the history without its first word, and so on down
to the word alone, whose probability in turn leaves the rest to unknown words. Backoff weights are normalised exactly:
after each history the probabilities of all words seen in training and of the unknown word sum to one.

    P(w)     = d(c(w)) c(w) / N,            unknown: what is left
    P(w | h) = d(c(h w)) c(h w) / C(h)      if the n-gram was seen; C(h) = c(h) + RESERVE
             = alpha(h) P(w | h')           if the history was; h' is h without its first word
             = P(w | h')                    otherwise
    alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h') over the same w)

A text is its words, then one end; the first word's history is a begin mark alone, the second's that and the first
word. Counts and weights are tables in ranges of the key space (:mod:`.blocks`), which also tell each block of texts
what it asks for: first the totals of its n-grams, then, for each length of a history, the weights, for which each
seen n-gram is added by one of the blocks that hold it. In P(w | h') above the n-gram h' w was seen, as h w was, so no
weight is needed for weights. A weight is needed where a text has an n-gram that was not seen, so only in texts that
are held out; histories that no such text has take no part. The driver gets the counts of counts up to ``DISCOUNTED + 1``
and no key.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .arrays import begins, mix64, per_doc, ranked
from .common import cleans_up, materialise, new_path, on_exit, remove

#: Words of the longest n-gram.
ORDER = 3
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Of a count, what each history leaves to unseen words besides what discounts leave, which for frequent words is nothing.
RESERVE = 0.01
_BEGIN, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_STATS = DISCOUNTED + 3

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def count_kind(n: int) -> int:
    """Answers about n-grams: their counts."""
    return 2 * n


def weight_kind(n: int) -> int:
    """Answers about histories of n words: their weights."""
    return 2 * n + 1


def discounts(n: list[int], total: int) -> tuple[list[float], float]:
    """Good-Turing factors of the counts 1 to ``DISCOUNTED``, from the numbers ``n[r]`` of keys with count r + 1.

    Katz's formula with the largest limit for which all factors are in (0, 1); where there is none, the absolute
    discount n1 / (n1 + 2 n2), or 0.75 if n2 is 0. Second: the mass that is left of ``total``, zero where nothing is discounted.
    """
    factors = None
    for k in range(DISCOUNTED, 0, -1):
        if n[0] and all(n[: k + 1]):
            tail = (k + 1) * n[k] / n[0]
            if tail >= 1:
                continue
            tried = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in tried):
                factors = tried + [1.0] * (DISCOUNTED - k)
                break
    if factors is None:
        less = (n[0] / (n[0] + 2 * n[1]) if n[1] else 0.75) if n[0] else 0.0
        factors = [(r - less) / r for r in range(1, DISCOUNTED + 1)]
    left = sum((1 - d) * r * n[r - 1] for r, d in enumerate(factors, 1))
    return factors, left


@dataclass
class Numbers:
    """Training tokens and texts, distinct words, discounts by n, and the probability of unknown words."""

    stats: dict[int, list[int]]
    texts: int
    order: int
    factors: dict[int, list[float]] = field(init=False)

    def __post_init__(self):
        # for each n: tokens, types, then the numbers of keys with count 1, 2, ...
        found = {n: discounts(s[2:], s[0]) for n, s in self.stats.items()}
        self.factors, left = {n: f for n, (f, _) in found.items()}, found[1][1]
        self.tokens, self.types = self.stats[1][:2]
        # with nothing left for unknown words they get the weight of one token
        self.total = self.tokens if left > 0 else self.tokens + 1
        self.unknown = (left if left > 0 else 1) / max(self.total, 1)

    def taken(self, n: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams."""
        table = np.array([0.0, *[d * r for r, d in enumerate(self.factors[n], 1)]])
        out, whole = table.take(counts, mode="clip"), np.flatnonzero(counts > DISCOUNTED)
        out[whole] = counts[whole]
        return out

    def of_word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.taken(1, counts) / max(self.total, 1), self.unknown)


@dataclass
class Grams:
    """The distinct n-grams of a block: keys ascending; where each first ends; the place of each token's, or -1; of each
    n-gram the place without its first word, and the place of its history (one beyond the words: the begin mark)."""

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray
    low: np.ndarray
    history: np.ndarray


class Events:
    """The tokens of a block and their n-grams up to an order."""

    def __init__(self, b: B.Block):
        self.block, sizes = b, b.sizes + 1
        end = np.cumsum(sizes)
        self.last = np.zeros(len(b.tokens) + len(sizes), bool)
        self.last[end - 1] = True
        self.place = np.arange(len(self.last), dtype=np.int32) - np.repeat((end - sizes).astype(np.int32), sizes)
        self.train = np.repeat(~b.marks, sizes)
        # the end among the words, which ascend
        rank = int(np.searchsorted(b.vocab, _END, "right"))
        words, at = np.insert(b.vocab, rank, _END), np.empty(len(self.last), np.int32)
        at[~self.last] = b.tokens + (b.tokens >= rank)
        at[self.last] = rank
        none = np.zeros(0, np.int64)
        self.made = {1: Grams(words, none, at, none, none)}
        self.hashed = {1: words[at]}

    @cached_property
    def doc(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.block.sizes)), self.block.sizes + 1)

    def _hashes(self, n: int) -> np.ndarray:
        """The key of the n-gram that ends at each token, where there is one."""
        if n not in self.hashed:
            before = np.roll(self._hashes(n - 1), 1)
            if n == 2:
                before = np.where(self.place == 0, _BEGIN, before)
            with np.errstate(over="ignore"):
                self.hashed[n] = mix64(mix64(before) + self.hashed[1] * np.uint64(0x9E3779B97F4A7C15))
        return self.hashed[n]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of n-grams, how often each occurs in training, and how often as a history in texts that are held out."""
        after = ~(self.train | self.last)
        if n == 1:
            g = self.made[1]
            count = lambda which: np.bincount(g.at[which], minlength=len(g.keys)).astype(np.uint64)
            return g.keys, count(self.train), count(after)
        there = self.place >= n - 2
        order, keys = ranked(self._hashes(n)[there])
        start = np.append(np.flatnonzero(begins(keys)), len(keys))
        total = np.zeros(len(keys) + 1, np.uint64)

        def sums(x: np.ndarray) -> np.ndarray:
            np.cumsum(x[there][order], out=total[1:])
            return np.diff(total[start])

        return keys[start[:-1]], sums(self.train), sums(after)

    def grams(self, n: int) -> Grams:
        if n not in self.made:
            lower, where = self.grams(n - 1), np.flatnonzero(self.place >= n - 2)
            order, found = ranked(self._hashes(n)[where])
            new, where = begins(found), where[order]
            keys, first, at = found[new], where[new], np.full(len(self.place), -1, np.int32)
            at[where] = np.cumsum(new, dtype=np.int32) - 1
            history = lower.at[first - 1]
            if n == 2:
                history = np.where(self.place[first] == 0, len(lower.keys), history)
            self.made[n] = Grams(keys, first, at, lower.at[first], history)
        return self.made[n]


def _counts_asked(n: int, bits: int):
    def run(b: B.Block) -> list[dict]:
        keys, counts, needed = Events(b).keys(n)
        return B.requests(b.home, b.number, keys, [counts, np.ones(len(keys), np.uint64), np.minimum(needed, 1)], bits)

    return run


def _count(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    """Totals of a range's keys (times two, and one if a text that is held out has the key as a history), who adds them to
    weights, and whether no other block has the key; it leaves the seen keys with their counts, and counts of counts."""
    counts, holders, needed = sums
    seen = counts > 0
    held = counts[seen]
    stats = [int(held.sum()), len(held), *[int((held == r).sum()) for r in range(1, DISCOUNTED + 2)]]
    return [2 * counts + (needed > 0), np.ones(len(keys), bool), holders == 1], [B.pack_sorted(keys[seen]), B.pack(held), *[s.to_bytes(8, "big") for s in stats]]


def _count_alone(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    """The same without a table of counts."""
    found, left = _count(part, keys, sums)
    return found, [b"", b"", *left[2:]]


class Known:
    """What answers tell a block: counts and weights by place, and probabilities from them.

    A history that no other block has gets its weight here, unless ``whole`` says that all weights are asked for.
    """

    def __init__(self, b: B.Block, answers: list[dict], numbers: Numbers, upto: int, whole: bool):
        self.e, self.numbers, self.whole = Events(b), numbers, whole
        self.count, self.needed, self.owner, self.alone, self.weight, self.share, told = {}, {}, {}, {}, {}, {}, {}
        for r in answers:
            told.setdefault(r["kind"], []).append(r)
        for n in range(1, upto + 1):
            keys = self.e.grams(n).keys
            found = B.gathered(told.get(count_kind(n), []))
            count = found[0].astype(np.int64) if found else np.zeros(len(keys), np.int64)
            self.count[n], self.needed[n] = count >> 1, (count & 1) > 0
            self.owner[n], self.alone[n] = found[1:] if len(found) > 1 else np.zeros((2, len(keys)), bool)
        for n in range(1, upto):
            self.weight[n] = np.ones(len(self.history_keys(n)))
            if not whole:
                here = self.local(n) & self.wanted(n)
                taken, covered = self.sums(n, here)
                self.weight[n][here] = weigh(taken[here], covered[here])
            if weight_kind(n) in told:
                self.weight[n][self.histories(n)[1]] = B.gathered(told[weight_kind(n)])[0]

    def history_keys(self, n: int) -> np.ndarray:
        keys = self.e.grams(n).keys
        return np.append(keys, _BEGIN) if n == 1 else keys

    def history_count(self, n: int) -> np.ndarray:
        return np.append(self.count[1], self.numbers.texts) if n == 1 else self.count[n]

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the histories of n words that were seen in training and whose weight is asked for, ascending, and their places."""
        keys, used = self.history_keys(n), np.zeros(len(self.history_keys(n)), bool)
        used[self.e.grams(n + 1).history] = True
        used &= self.history_count(n) > 0
        if not self.whole:
            used &= self.wanted(n) & ~self.local(n)
        asked = np.flatnonzero(used)
        asked = asked[np.argsort(keys[asked], kind="stable")]
        return keys[asked], asked

    def wanted(self, n: int) -> np.ndarray:
        """Histories of n words that a text which is held out has; an n-gram that was not seen has no other."""
        return np.append(self.needed[1], True) if n == 1 else self.needed[n]

    def local(self, n: int) -> np.ndarray:
        """Histories of n words that were seen in training and that no other block has."""
        here = self.alone[n] & (self.count[n] > 0)
        return np.append(here, False) if n == 1 else here

    def sums(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each history of n words in ``which``, what the seen words for which this block answers take of it and of the shorter one."""
        g, size = self.e.grams(n + 1), len(which)
        mine = np.flatnonzero(self.owner[n + 1] & (self.count[n + 1] > 0) & which[g.history])
        history = g.history[mine]
        taken = np.bincount(history, weights=self.numbers.taken(n + 1, self.count[n + 1][mine]), minlength=size)
        covered = np.bincount(history, weights=self.direct(n, g.low[mine]), minlength=size)
        return taken / (self.history_count(n) + RESERVE), covered

    def direct(self, n: int, which: np.ndarray) -> np.ndarray:
        """The discounted shares of some n-grams in their histories, 0 for those not seen."""
        if n == 1:
            if 1 not in self.share:
                self.share[1] = self.numbers.of_word(self.count[1])
            return self.share[1][which]
        return self.numbers.taken(n, self.count[n][which]) / (self.history_count(n - 1)[self.e.grams(n).history[which]] + RESERVE)

    def probability(self, n: int, which: np.ndarray) -> np.ndarray:
        """P of the last word of some n-grams after the others."""
        p = self.direct(n, which)
        if n > 1:
            g, unseen = self.e.grams(n), np.flatnonzero(self.count[n][which] == 0)
            which = which[unseen]
            p[unseen] = self.weight[n - 1][g.history[which]] * self.probability(n - 1, g.low[which])
        return p


def weigh(taken: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Weights of histories, by the shares that their seen words take of them and of the shorter ones."""
    return (1 - taken) / np.maximum(1 - covered, 1e-300)


def _weights_asked(n: int, numbers: Numbers, bits: int, whole: bool):
    """For each history of n words: what its seen words take, of one and of the shorter history, and whether the block needs its weight."""

    def run(b: B.Block, answers: list[dict]) -> pa.Table:
        k = Known(b, answers, numbers, n + 1, whole)
        keys, asked = k.histories(n)
        which, wanted = np.zeros((2, len(k.history_keys(n))), bool)
        which[asked] = True
        taken, covered = k.sums(n, which)
        wanted[k.e.grams(n + 1).history[k.count[n + 1] == 0]] = True
        return B.request_table(B.requests(b.home, b.number, keys, [taken[asked], covered[asked], wanted[asked]], bits))

    return run


def _weigh(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    weight = weigh(*sums)
    return [weight], [B.pack_sorted(keys), B.pack(weight)]


def _weigh_alone(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], None]:
    return [weigh(*sums)], None


def _score(numbers: Numbers, whole: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(b: B.Block, answers: list[dict]) -> pa.Table:
        k = Known(b, answers, numbers, numbers.order, whole)
        e, docs, words = k.e, len(b.sizes), k.e.made[1].at
        p, left = np.ones(len(words)), np.arange(len(words))
        for n in range(numbers.order, 0, -1):  # the longest n-gram that ends at each token
            at = e.grams(n).at[left]
            p[left[at >= 0]] = k.probability(n, at[at >= 0])
            left = left[at < 0]
        sums = lambda x: np.bincount(e.doc, weights=x, minlength=docs) if len(x) else np.zeros(docs)
        base = np.log10((k.count[1] + 0.5) / (numbers.tokens + 0.5 * (numbers.types + 1)))
        columns = [
            b.ids,
            pa.array(b.marks),
            pa.array(b.sizes + 1),
            pa.array(per_doc((k.count[1][words] > 0).astype(np.int64), e.doc, docs)),
            pa.array(np.full(docs, numbers.tokens, np.int64)),
            pa.array(sums(base[words])),
            pa.array(sums(np.log10(p))),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _stored(spark: SparkSession, make: Callable[[], DataFrame], kind: int, lasting: bool) -> tuple[DataFrame, DataFrame]:
    """The answers that ``make`` plans, and what ranges leave, as tables; the latter are the model's.

    Nothing refers to the plan when it is written, so the shuffle files of one exchange go before the next.
    """
    path = new_path(spark, f"katz-{kind}")
    on_exit(lambda: remove(spark, f"{path}/left=false"))
    on_exit(lambda: remove(spark, path), lasting)
    make().withColumn("left", F.col("block") < 0).write.partitionBy("left").parquet(path)
    for _ in range(2):  # the driver's handles go first, then what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    read = spark.read.schema(f"{B.ANSWER}, left boolean").parquet(path)
    return read.where("not left").drop("left").withColumn("kind", F.lit(kind)), read.where("left").select("part", "values")


@dataclass
class KatzModel:
    """A trained model: ``counts`` by n and ``weights`` by the length of a history, tables of one row for each range of
    keys (``values``: the keys, then their counts or weights)."""

    numbers: Numbers
    parts: int
    counts: dict[int, DataFrame]
    weights: dict[int, DataFrame]

    @cleans_up
    def score(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
        """``RESULT`` for each row of any table; no row counts as held out. See ``katz_scores``."""
        rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), F.lit(True).alias("mark"))
        packed = B.pack_blocks(rows, lower=True, block_bytes=block_bytes)
        blocks, bits, numbers, spark = packed.count(), B.levels(self.parts)[0], self.numbers, docs.sparkSession
        told = []

        def counts_of(n: int):
            return lambda b: B.requests(b.home, b.number, Events(b).keys(n)[0], [], bits)

        def weights_of(n: int):
            def run(b: B.Block, answers: list[dict]) -> pa.Table:
                return B.request_table(B.requests(b.home, b.number, Known(b, answers, numbers, n + 1, True).histories(n)[0], [], bits))

            return run

        for n, table in self.counts.items():
            told.append(_stored(spark, lambda: B.exchange(B.each_block(packed, counts_of(n)), self.parts, blocks, _looked_up, table), count_kind(n), False)[0])  # noqa: B023
        for n, table in self.weights.items():
            known = reduce(DataFrame.unionAll, told)
            told.append(_stored(spark, lambda: B.exchange(B.with_answers(packed, known, weights_of(n), B.REQUEST), self.parts, blocks, _looked_up, table), weight_kind(n), False)[0])  # noqa: B023
        scored = B.with_answers(packed, reduce(DataFrame.unionAll, told), _score(numbers, True), RESULT)
        return materialise(scored.withColumn("held_out", F.lit(False)), "scores", lasting=True)


def _looked_up(part: int, keys: np.ndarray, sums: list[np.ndarray], held: list[list[bytes]]) -> tuple[list[np.ndarray], None]:
    """Counts or weights of the keys that a range of the model has, 0 for others."""
    out = None
    for values in held:
        known, found = B.unpack_sorted(values[0]), B.unpack(values[1])
        found = 2 * found if found.dtype == np.uint64 else found
        out = np.zeros(len(keys), found.dtype) if out is None else out
        if len(known):
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            out = np.where(known[at] == keys, found[at], out)
    return [np.zeros(len(keys), np.uint64) if out is None else out], None


def _fit(docs: DataFrame, held_out: Column, ident: str, text: str, order: int, block_bytes: int, whole: bool) -> tuple[KatzModel, DataFrame, DataFrame]:
    """The model of the rows that are not held out, the blocks of all rows, and the answers to these. ``whole``: with its tables."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("mark"))
    parts = B.part_count(B.size_of(docs, text))
    bits, packed = B.levels(parts)[0], B.pack_blocks(rows, lower=True, block_bytes=block_bytes)
    blocks, told, counts, weights, stats = packed.count(), {}, {}, {}, {}
    spark = docs.sparkSession
    for n in range(1, order + 1):
        asked = lambda: B.exchange(B.each_block(packed, _counts_asked(n, bits)), parts, blocks, _count if whole else _count_alone)  # noqa: B023, E731
        told[count_kind(n)], counts[n] = _stored(spark, asked, count_kind(n), whole)
        number = [F.coalesce(F.sum(F.conv(F.hex(F.get("values", F.lit(i + 2))), 16, 10).cast("long")), F.lit(0)) for i in range(_STATS)]
        stats[n] = [int(x) for x in counts[n].agg(*number).first()]
    numbers = Numbers(stats, rows.where(~F.col("mark")).count(), order)
    for n in range(1, order):
        known = reduce(DataFrame.unionAll, [told[k] for k in (*map(count_kind, range(1, n + 2)), *map(weight_kind, range(1, n)))])
        asked = lambda: B.exchange(B.with_answers(packed, known, _weights_asked(n, numbers, bits, whole), B.REQUEST), parts, blocks, _weigh if whole else _weigh_alone)  # noqa: B023, E731
        told[weight_kind(n)], weights[n] = _stored(spark, asked, weight_kind(n), whole)
    return KatzModel(numbers, parts, counts, weights), packed, reduce(DataFrame.unionAll, told.values())


@cleans_up
def katz_model(docs: DataFrame, held_out: Column | None = None, ident: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = B.BLOCK_BYTES) -> KatzModel:
    """The model learnt from the rows of ``docs`` for which ``held_out`` is not true; its tables stay in the shared folder."""
    return _fit(docs, F.lit(False) if held_out is None else held_out, ident, text, order, block_bytes, True)[0]


@cleans_up
def katz_scores(docs: DataFrame, held_out: Column, ident: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Scores of all rows of ``docs`` by the model of ``order`` words learnt from those for which ``held_out`` is not true.

    One row for each row: ``RESULT``. A-Z count as lower case; a null or empty text is its end alone. Identifiers may
    be null or repeat. With nothing to learn from, every token has probability 1. Other columns are not read. An
    empty table gives an empty result. Blocks and answers are tables in the shared folder until all is scored; the
    model's own tables, which other texts would need, are not written: ``katz_model`` does that.
    """
    model, packed, told = _fit(docs, held_out, ident, text, order, block_bytes, False)
    return materialise(B.with_answers(packed, told, _score(model.numbers, False), RESULT), "scores", lasting=True)
