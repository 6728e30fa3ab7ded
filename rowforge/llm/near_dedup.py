"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five words (a shorter text is one shingle). Its weight in a text is its count there times an inverse
document frequency over all rows. Signatures are improved consistent weighted samples (Ioffe), so two texts agree
in a sample with the probability of their weighted Jaccard similarity; bands of samples name buckets, and texts
that share a bucket are compared by the similarity itself.

Only a text whose shingles with a document frequency over one hold the threshold's share of its weight can be
that similar to any other, as nothing else is shared: the others are alone, exactly, and need no signature.

No pairs within a bucket are made. First each node is compared with the least pivot of its buckets, which settles all
buckets whose members are then linked. In an unsettled bucket all members are compared with one pivot; those that
are linked to it leave, unless one that is not is so near to the pivot that, by the triangle inequality of the
weighted Jaccard distance, it might be linked to them. This goes on, in one task where a bucket's sets fit and else in
rounds over all large buckets, with more pivots in each round than in the one before, until no bucket has members that
are neither compared nor linked: no link that the buckets hold is lost. Copies with equal shingles are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .arrays import mix64, runs, stream
from .common import cleans_up, fresh, materialise

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Weight of a shingle of one document is 1 + IDF, of one that all have 1; in between by the logarithm of the frequency.
IDF = 0.25

_SIGNED = "doc_id long, node binary, buckets array<long>, keys binary, weights binary"
_TABLE_BITS = 16
#: Bytes of the sets of a bucket up to which one task finishes it; larger buckets are taken apart by pivots first.
IN_A_TASK = 24 << 20
#: Pivots of such a bucket in one round at most.
PIVOTS = 32
#: Identifiers to drop that are broadcast, 8 bytes each.
FEW_GONE = 1_000_000
#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 3 << 20


class Shingles:
    """The distinct shingles of each text of a block: keys ascending within a text, and how often each occurs."""

    def __init__(self, b: B.Block, size: int = SHINGLE):
        word = b.vocab[b.tokens] if len(b.tokens) else np.zeros(0, np.uint64)
        first = np.cumsum(b.sizes) - b.sizes
        where = np.flatnonzero(b.doc[: max(0, len(word) - size + 1)] == b.doc[size - 1 :]) if len(word) >= size else np.zeros(0, np.int64)
        keys, docs = [runs(word, where, size)], [b.doc[where]]
        for n in range(1, size):
            short = np.flatnonzero(b.sizes == n)
            keys.append(runs(word, first[short], n))
            docs.append(short)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        self.key, self.doc = key[new], doc[new]
        self.count = np.diff(np.append(new, len(key)))
        self.keys, self.at = np.unique(self.key, return_inverse=True)


def _requests(bits: int, size: int):
    def run(b: B.Block) -> list[dict]:
        s = Shingles(b, size)
        held = np.bincount(s.at, minlength=len(s.keys)).astype(np.uint64)
        return B.requests(b.home, b.number, s.keys, [held], bits, empty=True)

    return run


def _frequencies(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], None]:
    return [sums[0]], None


def weights(count: np.ndarray, frequency: np.ndarray, rows: int, idf: float = IDF) -> np.ndarray:
    scale = np.log(max(rows, 2))
    return (count * (1 + idf * (1 - np.log(np.maximum(frequency, 1)) / scale))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: for each sample k a shingle has fixed r, c ~ Gamma(2, 1) and b ~ U(0, 1),
    looked up by its hash in a table of 65,536 draws, which a turn of its own shuffles for each k; with t = floor(ln w / r + b) the shingle of the least ln c - r (t - b + 1) is drawn, and
    the sample is that shingle with its t.

    In a text of more shingles than the table has draws, some share theirs. Of those that are drawn together the one of
    the least turned key is taken, in every text, so samples stay consistent: the least draw names a set of shingles, and
    a permutation of that sample's own takes one of the set.
    """

    def __init__(self, samples: int):
        n = 1 << _TABLE_BITS
        u = (stream(5 * n, 11) >> np.uint64(11)).astype(np.float64).reshape(5, n) / (1 << 53) + 1e-18
        self.r = (-np.log(u[0] * u[1])).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.b = u[4].astype(np.float32)
        self.turn = stream(samples, 12) | np.uint64(1)

    def signatures(self, key: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row for each text (shingles from each of ``starts`` on, none empty), one column for each sample."""
        sizes = np.diff(np.append(starts, len(key)))
        mixed, log_w = mix64(key), np.log(weight)
        out = np.empty((len(starts), len(self.turn)), np.uint64)
        with np.errstate(over="ignore"):
            for k, turn in enumerate(self.turn):
                turned = mixed * turn
                at = turned >> np.uint64(64 - _TABLE_BITS)
                r, b = self.r[at], self.b[at]
                t = np.floor(log_w / r + b)
                value = self.log_c[at] - r * (t - b + 1)
                least = np.minimum.reduceat(value, starts)
                hit = np.flatnonzero(value == np.repeat(least, sizes))
                if len(hit) > len(starts):  # of equals the one of the least turned key, another for each sample
                    first = np.searchsorted(hit, starts)
                    tied = np.repeat(np.minimum.reduceat(turned[hit], first), np.diff(np.append(first, len(hit))))
                    hit = hit[turned[hit] == tied]
                drawn = hit
                out[:, k] = mix64(key[drawn] + t[drawn].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def buckets(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket name for each band."""
    out = np.empty((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            name = np.full(len(signatures), band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                name = mix64(name * np.uint64(0xD6E8FEB86659FD93) + signatures[:, k])
            out[:, band] = name
    return out


def _sign(rows_in_all: int, size: int, similarity: float, bands: int, rows: int, idf: float):
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("buckets", pa.list_(pa.int64())), ("keys", pa.binary()), ("weights", pa.binary())])

    def run(b: B.Block, answers: list[dict]) -> pa.Table:
        s = Shingles(b, size)
        frequency = B.gathered(answers)[0].astype(np.int64)[s.at] if len(s.at) else np.zeros(0, np.int64)
        w = weights(s.count, frequency, rows_in_all, idf)
        n = len(b.sizes)
        whole = np.bincount(s.doc, weights=w, minlength=n)
        shared = np.bincount(s.doc, weights=np.where(frequency > 1, w, 0), minlength=n)
        may = np.flatnonzero((whole > 0) & (shared >= (similarity - 1e-6) * whole))
        node, names, keys, held = [None] * n, [None] * n, [None] * n, [None] * n
        if len(may):
            pick = np.isin(s.doc, may)
            key, weight, doc = s.key[pick], w[pick], s.doc[pick]
            starts = np.searchsorted(doc, may)
            named = buckets(Sampler(bands * rows).signatures(key, weight, starts), bands, rows).view(np.int64)
            with np.errstate(over="ignore"):
                one = mix64(key * np.uint64(3) + (s.count[pick].astype(np.uint64) << np.uint64(53)))
                sums = np.add.reduceat(one, starts), np.add.reduceat(mix64(one), starts)
            for i, d in enumerate(may):
                lo, hi = starts[i], starts[i + 1] if i + 1 < len(may) else len(key)
                node[d] = sums[0][i].tobytes() + sums[1][i].tobytes()
                names[d], keys[d], held[d] = named[i], B.pack_sorted(key[lo:hi]), weight[lo:hi].tobytes()
        return pa.Table.from_arrays([b.ids, *[pa.array(x, type=f.type) for x, f in zip((node, names, keys, held), list(schema)[1:], strict=True)]], schema=schema)

    return run


def similarity_of(keys_a: np.ndarray, w_a: np.ndarray, keys_b: np.ndarray, w_b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two ascending weighted sets."""
    at = np.searchsorted(keys_a, keys_b)
    at[at == len(keys_a)] = 0
    same = keys_a[at] == keys_b if len(keys_a) else np.zeros(len(keys_b), bool)
    both = np.minimum(w_a[at[same]], w_b[same]).sum(dtype=np.float64)
    either = w_a.sum(dtype=np.float64) + w_b.sum(dtype=np.float64) - both
    return float(both / either) if either else 0.0


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, node) with their similarity."""
    left = sets.select(F.col("node").alias("pivot"), F.col("keys").alias("pk"), F.col("weights").alias("pw"))
    joined = pairs.join(sets, "node").join(left, "pivot").select("pivot", "node", "pk", "pw", "keys", "weights")
    schema = pa.schema([("pivot", pa.binary()), ("node", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                pivot, _, pk, pw, k, w = (batch.column(j)[i] for j in range(6))
                if (name := pivot.as_py()) != last[0]:
                    last = (name, B.unpack_sorted(pk.as_py()), np.frombuffer(pw.as_py(), np.float32))
                out.append(similarity_of(last[1], last[2], B.unpack_sorted(k.as_py()), np.frombuffer(w.as_py(), np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], schema=schema)

    return joined.mapInArrow(run, "pivot binary, node binary, similarity double")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): the least node of each connected component.

    Alternating large-star and small-star; each step is a minimum by node and a join, both of which spread a hot node.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = materialise(small.select("e.a", "e.b").where("a != b").distinct(), "edges", rows)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _first_links(members: DataFrame, sets: DataFrame, similarity: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """Links of each node to the least pivot of its buckets, where they are similar; and the members' roots by these.

    A bucket's pivot is its least node, so the least node of a group of copies is the pivot of nearly all of them,
    and one comparison for each node settles most buckets.
    """
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"))
    least = members.join(pivots, "bucket").groupBy("node").agg(F.min("pivot").alias("pivot")).where("pivot != node")
    compared = materialise(_compare(least, sets), "compared", rows, 20_000)
    links = compared.where(F.col("similarity") >= similarity).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    up = links.select(F.col("b").alias("node"), F.col("a").alias("r1"))
    over = links.select(F.col("b").alias("r1"), F.col("a").alias("r2"))
    roots = materialise(up.join(over, "r1", "left").select("node", F.coalesce("r2", "r1").alias("root")), "roots", rows)
    return links, members.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of buckets with several roots, with the bytes of all sets of the bucket; of buckets with the same members one."""
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    open_ = members.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("size").alias("bytes"), *same).where("r0 != r1")
    one = open_.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("bytes").alias("bytes"))
    return members.join(one.select("bucket", "bytes"), "bucket")


def join_similar(keys: list[np.ndarray], weights: list[np.ndarray], roots: list, similarity: float) -> list[tuple[int, int]]:
    """Links that join all similar sets, directly or through others, beyond what equal ``roots`` say.

    A set whose shingles that no other set has hold too much of its weight can have no link here and is left out, as
    often as this leaves out more. Then one set after the other is compared with all that are left, in one go.
    """
    sizes = np.array([len(k) for k in keys])
    _, token = np.unique(np.concatenate(keys), return_inverse=True)
    weight, owner = np.concatenate(weights).astype(np.float64), np.repeat(np.arange(len(keys)), sizes)
    whole = np.bincount(owner, weights=weight, minlength=len(keys))
    while True:
        held = np.bincount(token)
        shared = np.bincount(owner, weights=np.where(held[token] > 1, weight, 0), minlength=len(keys))
        stay = (shared >= (similarity - 1e-6) * whole)[owner]
        if stay.all():
            break
        token, weight, owner = token[stay], weight[stay], owner[stay]
    up = {r: r for r in roots}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    out, far, mine = [], 1 - similarity, np.zeros(int(token.max(initial=0)) + 1)
    todo = np.unique(owner)
    while len(todo) > 1 and len({root(roots[i]) for i in todo}) > 1:
        pivot, rest = todo[0], todo[1:]
        own = owner == pivot
        mine[token[own]] = weight[own]
        both = np.bincount(owner, weights=np.minimum(mine[token], weight), minlength=len(keys))[rest]
        mine[token[own]] = 0
        away = 1 - both / (whole[pivot] + whole[rest] - both)
        for i in rest[away <= far + 1e-9]:
            a, b = root(roots[pivot]), root(roots[i])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(pivot), int(i)))
        beyond = away[away > far]
        todo = rest[(away > far) | (away >= beyond.min() - far)] if len(beyond) else rest[:0]
        left = np.zeros(len(keys), bool)
        left[todo] = True
        left = left[owner]
        token, weight, owner = token[left], weight[left], owner[left]
    return out


def _finish(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join what is similar in buckets whose sets fit in a task, each bucket worked off at once."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        links = join_similar([B.unpack_sorted(r["keys"]) for r in rows], [np.frombuffer(r["weights"], np.float32) for r in rows], [r["root"] for r in rows], similarity)
        return pa.Table.from_pylist([{"a": rows[i]["node"], "b": rows[j]["node"]} for i, j in links], schema=schema)

    return members.join(sets, "node").groupBy("bucket").applyInArrow(run, "a binary, b binary")


def _links(members: DataFrame, sets: DataFrame, similarity: float, rows: int) -> DataFrame:
    """Links (a, b) that join all members of a bucket that are similar, directly or through others."""
    far = 1 - similarity
    first, open_ = _first_links(members, sets, similarity, rows)
    found = [first]
    open_ = materialise(_unsettled(open_), "members", rows)
    turn, wide = 0, 1
    while True:
        found.append(materialise(_finish(open_.where(F.col("bytes") <= IN_A_TASK).drop("bytes", "size"), sets, similarity), "links", rows, 20_000))
        large = open_.where(F.col("bytes") > IN_A_TASK).drop("bytes")
        if large.isEmpty():
            break
        # one pivot, after some rounds more: so that buckets of many sets that are near but not similar take few rounds
        slot = F.pmod(F.xxhash64("node", F.lit(wide)), F.lit(wide))
        least = F.min(F.struct((F.col("root") != F.col("node")).alias("old"), "node"))
        pivots = large.groupBy("bucket", slot.alias("slot")).agg(least.alias("p")).select("bucket", F.col("p.node").alias("pivot"))
        turn += 1
        wide = min(1 + turn // 4, PIVOTS)
        held = materialise(large.join(pivots, "bucket"), "members", rows)
        compared = materialise(_compare(held.where("node != pivot").select("pivot", "node").distinct(), sets), "compared", rows, 20_000)
        found.append(compared.where(F.col("similarity") >= similarity).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        judged = held.join(compared, ["pivot", "node"], "left").withColumn("d", F.coalesce(1 - F.col("similarity"), F.lit(0.0)))
        nearest = judged.where(F.col("d") > far).groupBy("bucket", "pivot").agg(F.min("d").alias("next"))
        # a member is settled by a pivot that it is linked to, if all that might be linked to it are linked to that pivot too
        settled = (F.col("d") <= far) & (F.col("next").isNull() | (F.col("d") < F.col("next") - far)) | (F.col("node") == F.col("pivot"))
        judged = judged.join(nearest, ["bucket", "pivot"], "left").withColumn("root", F.when(F.col("d") <= far, F.least("pivot", "root")).otherwise(F.col("root")))
        after = judged.groupBy("bucket", "node", "size").agg(F.min("root").alias("root"), F.bool_or(settled).alias("settled"))
        open_ = materialise(_unsettled(after.where(~F.col("settled")).drop("settled")), "members", rows)
    return reduce(DataFrame.unionAll, found)


@cleans_up
def near_classes(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    idf: float = IDF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, class_id, class_size for each row: rows that are linked, directly or through others, share a class.

    Two texts are linked if their weighted Jaccard similarity is at least ``similarity`` and they share a bucket,
    which at 0.8 fails for fewer than 4 of 10,000 pairs. The class is named by its smallest identifier (null if
    all are null). Texts without words, null ones too, are in classes of their own. Identifiers may be null or
    repeat: rows are told apart by what they hold. Other columns are not read; an empty table gives an empty result.
    """
    plain = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), F.lit(False).alias("mark"))
    n, parts = docs.count(), B.part_count(B.size_of(docs, text))
    packed = B.pack_blocks(plain, block_bytes=block_bytes)
    asked = B.each_block(packed, _requests(B.levels(parts)[0], shingle))
    told = B.exchange(asked, parts, packed.count(), _frequencies)
    signed = materialise(B.with_answers(packed, told, _sign(n, shingle, similarity, bands, rows, idf), _SIGNED), "signed", n, 5_000)
    may = signed.where("node is not null")
    members = may.select("node", F.explode("buckets").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialise(members.join(shared, "bucket"), "members", n)
    nodes = members.select("node").distinct()
    sets = may.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("keys").alias("keys"), F.min("weights").alias("weights"))
    sets = materialise(sets, "sets", n, 20_000)
    sizes = sets.select("node", (F.length("keys") + F.length("weights")).cast("long").alias("size"))
    roots = components(_links(members.join(sizes, "node"), sets, similarity, n), n)
    rows_of = may.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    classes = rows_of.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    linked = rows_of.join(classes, F.col("root") == F.col("r")).select("doc_id", "class_id", "class_size")
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return materialise(linked.unionAll(alone), "classes", n, lasting=True)


def drop_near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest identifier; its own columns.

    Rows with a null identifier are never dropped. Of rows that repeat the identifier that stays, all stay (exact
    deduplication comes before).
    """
    found = near_classes(docs, ident, text, **options)
    (drop,) = fresh(docs, "drop")
    gone = materialise(found.where("class_size > 1 and doc_id != class_id").select(F.col("doc_id").alias(drop)).distinct(), "near-copies", lasting=True)
    gone = F.broadcast(gone) if gone.count() <= FEW_GONE else gone  # else texts move with their identifiers
    return docs.join(gone, F.col(f"`{ident}`") == F.col(drop), "left_anti")
