"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Each source's share of all words follows its weight; a target stops at ``most`` times the source's
   size and the excess goes to the others by weight, until none is above.
2. Blocks. A source's rows are ordered by a hash and cut into blocks, runs of that order.
3. Draw. A source is taken whole as often as its target holds it, and once more in part: its blocks are taken in order
   until the next one would pass the target. From there on rows are taken in order if they still fit in what is left;
   these are one block more, the remainder.
4. Split. The number of blocks each source gives is an exact quota. A binary tree over the output shards splits
   the quotas: at each node a multivariate hypergeometric draw says how many blocks of each source go left. Then
   the permuted blocks of a source are cut by its quotas, so the shards' blocks are disjoint and each has one shard.
5. Shuffle. Each copy of a document has a random key, by which its shard is sorted when it is written.

Rows move only to be counted by block and to learn their block's shard. The driver holds one row for each source
and shard, and for each step of the draw. A hot source is dealt to blocks like any other; no window holds more than
``FAN`` blocks of a source. Rows that agree in source, identifier and size are counted together and drawn one by one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialise, scratch

#: Blocks of a level at most; a power of two.
FAN = 4096
#: Documents in order of their hash are split until a block has about this many, and no more than twice as many.
BLOCK_ROWS = 128


def targets(sizes: list[tuple[str | None, int]], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets of sources that share all sizes by weight, none above ``most`` times its own size."""
    total = float(sum(s for _, s in sizes))
    out = [0.0] * len(sizes)
    free = [i for i, (_, s) in enumerate(sizes) if s > 0]
    left = total
    while free:
        by_weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / by_weight for i in free}
        above = [i for i in free if share[i] > most * sizes[i][1]]
        if not above:
            for i in free:
                out[i] = share[i]
            break
        for i in above:
            out[i] = most * sizes[i][1]
            left -= out[i]
        free = [i for i in free if i not in set(above)]
    return out


def by_code_point(names: list[str | None]) -> list[str | None]:
    """Names in order of their code points, null last."""
    return sorted((n for n in names if n is not None)) + [None] * sum(n is None for n in names)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good."""
    if max(good, bad) < 10**9:  # the library's limit
        return int(rng.hypergeometric(good, bad, draws))
    hits = 0
    for _ in range(draws):
        if rng.random() * (good + bad) < good:
            good, hits = good - 1, hits + 1
        else:
            bad -= 1
    return hits


def split_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source (outer list) for each shard: a binary tree of multivariate hypergeometric draws.

    Shards get equal numbers of blocks, one more or less. A node's draw is a chain of univariate draws, one for
    each source, and depends on the seed and the node alone.
    """
    total = sum(quotas)
    edges = [total * j // shards for j in range(shards + 1)]
    out = [[0] * shards for _ in quotas]

    def node(lo: int, hi: int, counts: list[int]) -> None:
        if hi - lo == 1:
            for i, c in enumerate(counts):
                out[i][lo] = c
            return
        mid = (lo + hi) // 2
        rng, rest, draws, left = np.random.default_rng([seed, lo, hi]), sum(counts), edges[mid] - edges[lo], []
        for c in counts:
            rest -= c
            got = hypergeometric(rng, c, rest, draws)
            draws -= got
            left.append(got)
        node(lo, mid, left)
        node(mid, hi, [c - x for c, x in zip(counts, left, strict=True)])

    if quotas:
        node(0, shards, list(quotas))
    return out


#: Sources up to which their figures are broadcast, a row each; beyond, joins on the source are left to Spark.
FEW_SOURCES = 20_000


def _figures(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each source."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= FEW_SOURCES else frame


#: Bits of a document's place in its source's order.
PLACE_BITS = 60
_LAST = (1 << PLACE_BITS) - 1


def place(seed: int, ident: list[Column], size: Column) -> Column:
    """The first 60 bits of the md5 of seed, identifier and size."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in ident], size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _blocks(rows: int) -> int:
    """Blocks of a source: about 32 rows each, FAN at most."""
    return max(1, min(FAN, rows // 32))


_FAN_BITS = FAN.bit_length() - 1


def _block(h: Column, blocks: Column) -> Column:
    """The block of a place, of ``blocks`` equal parts of the order."""
    return F.shiftright(F.shiftright(h, PLACE_BITS - _FAN_BITS) * blocks, _FAN_BITS).cast("int")


def _begin(block: int, blocks: int) -> int:
    """The first place of a block."""
    return -(-block * FAN // blocks) << (PLACE_BITS - _FAN_BITS)


def _finer(rows: int) -> int:
    """Bits that split ``rows`` rows into blocks of about BLOCK_ROWS, FAN blocks at most."""
    return max(1, min(_FAN_BITS, (-(-rows // BLOCK_ROWS) - 1).bit_length()))


def _fill(spark: SparkSession, small: DataFrame, rest: dict[str, tuple[int, int]]) -> tuple[dict[str, list[tuple]], DataFrame]:
    """The remainders: of each source (its first place, room) the rows of ``small`` (key, h, n, rows) that are taken in
    order as long as they fit.

    Ranges (from, to, most) of each source, in which rows of 1 to ``most`` words are all taken, and (k2, h2, n2, took)
    that are taken besides. A round narrows down to the few rows where the room ends, level by level, and goes through
    them one by one. The next one goes on behind them with the rows that fit in what is left: less than the smallest
    that was passed over, so rounds are few. Nothing that fits is left out.
    """
    ranges: dict[str, list[tuple]] = {k: [] for k in rest}
    picked = []
    open_ = {k: x for k, x in rest.items() if x[1] > 0}

    def inside(ways: list[tuple]) -> DataFrame:
        """The rows of 1 to ``most`` words in each source's way (from, to, most, room, bits of a part's width)."""
        figures = _figures(spark, ways, "k string, lo long, hi long, most long, room long, width int")
        found = small.join(figures, F.col("key") == F.col("k"))
        return found.where(F.col("h").between(F.col("lo"), F.col("hi")) & F.col("n").between(F.lit(1), F.col("most")))

    words = F.sum(F.col("n") * F.col("rows")).alias("n")
    while open_:
        ways = [(k, lo, _LAST, room, room, PLACE_BITS) for k, (lo, room) in sorted(open_.items())]
        left = inside(ways).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), words).collect()
        few, wide = {}, {}
        for r in left:
            lo, room = open_[r["key"]]
            if r["n"] <= room:  # everything fits
                ranges[r["key"]].append((lo, _LAST, room))
            elif r["rows"] <= 2 * BLOCK_ROWS:
                few[r["key"]] = (lo, _LAST, room)
            else:
                wide[r["key"]] = (lo, _LAST, room, PLACE_BITS - _finer(r["rows"]))
        while wide:
            ways = [(k, lo, hi, open_[k][1], room, width) for k, (lo, hi, room, width) in sorted(wide.items())]
            sums = inside(ways).groupBy("key", "room", F.expr("shiftright(h, width)").alias("d")).agg(words, F.count(F.lit(1)).alias("rows"))
            upto = F.sum("n").over(Window.partitionBy("key").orderBy("d"))  # FAN rows for each source at most
            stop = sums.withColumn("upto", upto).where(F.col("upto") > F.col("room"))
            narrowed = {}
            for r in stop.groupBy("key").agg(F.min(F.struct("d", "upto", "n", "rows")).alias("b")).collect():
                b, (lo, hi, room, width) = r["b"], wide[r["key"]]
                begin, room = max(lo, b["d"] << width), room - (b["upto"] - b["n"])
                if begin > lo:
                    ranges[r["key"]].append((lo, begin - 1, open_[r["key"]][1]))
                hi = min(hi, ((b["d"] + 1) << width) - 1)
                if b["rows"] > 2 * BLOCK_ROWS and width > 0:
                    narrowed[r["key"]] = (begin, hi, room, max(0, width - _finer(b["rows"])))
                else:
                    few[r["key"]] = (begin, hi, room)
            wide = narrowed
        open_ = {}
        if few:
            # a few hundred rows; at one place there is one size, but for clashes of 60 bits
            rows = inside([(k, lo, hi, room, room, PLACE_BITS) for k, (lo, hi, room) in sorted(few.items())])
            filled = rows.groupBy("key", "room").agg(F.array_sort(F.collect_list(F.struct("h", "n", "rows"))).alias("found"))
            filled = materialise(filled.select("key", _in_order(F.col("found"), F.col("room")).alias("fit")), "mix-fit", len(few))
            picked.append(filled.select("key", F.explode("fit.taken").alias("x")))
            after = {k: room for k, (_, _, room) in few.items()}  # where nothing fits there is no row
            after |= {r["key"]: r["room"] for r in filled.select("key", "fit.room").collect()}
            open_ = {k: (few[k][1] + 1, room) for k, room in after.items() if room > 0 and few[k][1] < _LAST}
    none = spark.createDataFrame([], "key string, x struct<h: long, n: long, took: long>")
    chosen = reduce(DataFrame.unionAll, picked) if picked else none
    return ranges, chosen.select(F.col("key").alias("k2"), F.col("x.h").alias("h2"), F.col("x.n").alias("n2"), F.col("x.took").alias("took"))


def _in_order(found: Column, room: Column) -> Column:
    """Of (h, n, rows) in order, as many rows of each as still fit in the room: what is left of it, and (h, n, took)."""
    start = F.struct(room.alias("room"), F.array().cast("array<struct<h: long, n: long, took: long>>").alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        took = F.least(r["rows"], F.floor(acc["room"] / r["n"]))
        one = F.struct(r["h"].alias("h"), r["n"].alias("n"), took.alias("took"))
        return F.when(r["n"] <= acc["room"], F.struct((acc["room"] - took * r["n"]).alias("room"), F.concat(acc["taken"], F.array(one)).alias("taken"))).otherwise(acc)

    return F.aggregate(found, start, step)


def _shards_of_blocks(blocks: DataFrame, plan: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """(k, b, dealt): the shard of each copy of each block. The permuted blocks of a source are cut by its quotas."""
    units = (
        blocks.join(plan, F.col("key") == F.col("k"))
        .withColumn("copies", F.col("whole") + (F.col("block") < F.col("stop")).cast("int") + (F.col("block") == F.col("blocks")).cast("int"))
        .where("copies > 0")
        .select("key", "block", F.explode(F.when(F.col("block") == F.col("blocks"), F.array(F.col("whole"))).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))).alias("epoch"))
    )
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), "key", "block", "epoch"))
    # a source has FAN blocks at most for each of its few copies
    place = F.row_number().over(Window.partitionBy("key").orderBy(shuffled, "block", "epoch")) - 1
    return (
        units.withColumn("place", place)
        .join(cuts, F.col("key") == F.col("k"))
        .select("key", "block", "epoch", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))
        .groupBy("key", "block")
        .agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("dealt"))
        .select(F.col("key").alias("k"), F.col("block").alias("b"), F.transform("dealt", lambda x: x["shard"]).alias("dealt"))
    )


def plan_mix(
    docs: DataFrame,
    source: str,
    size: Column,
    ident: list[Column],
    weights=(1, 2, 3),
    most: float = 3.0,
    shards: int = 8,
    seed: int = 8,
    names=("size", "source_size", "target", "copies", "taken", "shards"),
) -> DataFrame:
    """``docs`` with its size, its source's size and target, the copies the mix takes, and each copy's shard.

    ``ident`` are the columns that tell documents apart and so order the draw. Rows that agree in source, identifier
    and size, as rows without an identifier may, are drawn one by one all the same: any of them, as many as fit. A
    null source is a source of its own, the last. Sizes of 0 cost nothing; they are taken with their block and never
    with a remainder. Columns of ``docs`` named like ``names`` are replaced, others pass through. An empty table gives
    an empty result. The plan is a table in the shared folder that stays, without texts.
    """
    with scratch():
        return _plan_mix(docs, source, size, ident, weights, most, shards, seed, names)


def _plan_mix(docs, source, size, ident, weights, most, shards, seed, names) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names} and c != source])
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    n_, key, h = fresh(docs, "n", "key", "h")
    named = F.when(F.col(f"`{source}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(f"`{source}`")))
    sized_docs = docs.withColumns({n_: F.coalesce(size.cast("long"), F.lit(0)), key: named})
    keyed = sized_docs.withColumn(h, place(seed, ident, F.col(n_)))
    small = keyed.groupBy(F.col(key).alias("key"), F.col(h).alias("h"), F.col(n_).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    small = materialise(small, "mix-sizes")
    words = F.sum(F.col("n") * F.col("rows")).alias("words")
    stats = {r["key"]: (r["rows"], r["words"]) for r in small.groupBy("key").agg(F.sum("rows").alias("rows"), words).collect()}
    order = [k for k in sorted(stats) if k != "n"] + ["n"] * ("n" in stats)
    goal = dict(zip(order, targets([(k, stats[k][1]) for k in order], [weights[i % len(weights)] for i in range(len(order))], most), strict=True))
    whole, rest, blocks = {}, {}, {k: _blocks(stats[k][0]) for k in order}
    for k in order:
        total = stats[k][1]
        whole[k] = min(int(most), int(goal[k] // total)) if total else 0
        rest[k] = max(0, round(goal[k] - whole[k] * total)) if total and whole[k] < most else 0

    # whole blocks of the partial copy: those before the one in which the rest ends
    figures = _figures(spark, [(k, rest[k], blocks[k]) for k in order], "k string, rest long, blocks int")
    by_block = small.join(figures, F.col("key") == F.col("k")).groupBy("key", _block(F.col("h"), F.col("blocks")).alias("block"), "rest").agg(words)
    by_block = materialise(by_block, "mix-blocks", sum(blocks.values()))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("block"))  # FAN rows for each source at most
    passed = by_block.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("key", "rest").agg(F.min(F.struct("block", "upto", "words")).alias("b"))
    stop, open_ = {k: blocks[k] if rest[k] else 0 for k in order}, {}
    for r in passed.where("rest > 0").collect():
        k, b = r["key"], r["b"]
        stop[k], open_[k] = b["block"], (_begin(b["block"], blocks[k]), rest[k] - (b["upto"] - b["words"]))
    ranges, picks = _fill(spark, small, open_)

    plan = _figures(
        spark,
        [(k, stats[k][1], float(goal[k]), whole[k], blocks[k], stop[k], ranges.get(k, [])) for k in order],
        "k string, source_words long, goal double, whole int, blocks int, stop int, ranges array<struct<lo: long, hi: long, most: long>>",
    )
    ranged = F.exists("ranges", lambda x: F.col("h").between(x["lo"], x["hi"]) & F.col("n").between(F.lit(1), x["most"]))
    same = (F.col("key") == F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("n") == F.col("n2"))
    drawn = small.join(plan, F.col("key") == F.col("k")).drop("k").withColumn("block", _block(F.col("h"), F.col("blocks"))).join(picks, same, "left")
    before = F.col("block") < F.col("stop")
    drawn = drawn.select(
        "key", "h", "n", "rows", "source_words", "goal", "whole", "block", before.alias("before"), "blocks",
        F.when(before | ranged, F.col("rows")).otherwise(F.coalesce("took", F.lit(0))).alias("more"),
    )
    drawn = materialise(drawn, "mix-drawn", sum(r for r, _ in stats.values()))

    remainder = drawn.where("not before and more > 0").select("key", F.col("blocks").alias("block")).distinct()
    given = by_block.select("key", "block").unionAll(remainder)
    few = plan.select("k", "whole", "stop", "blocks")
    quota = F.sum(F.when(F.col("block") == F.col("blocks"), 1).otherwise(F.col("whole") + (F.col("block") < F.col("stop")).cast("int"))).alias("quota")
    quotas = {r["key"]: r["quota"] for r in given.join(few, F.col("key") == F.col("k")).groupBy("key").agg(quota).collect() if r["quota"]}
    sources = [k for k in order if k in quotas]
    split = split_tree([quotas[k] for k in sources], shards, seed)
    cuts = _figures(spark, [(k, np.cumsum(row).tolist()) for k, row in zip(sources, split, strict=True)], "k string, ends array<long>")
    dealt = _shards_of_blocks(given, few, cuts, seed)
    last = dealt.join(plan.select(F.col("k").alias("k3"), F.col("blocks").alias("b3")), (F.col("k") == F.col("k3")) & (F.col("b") == F.col("b3"))).select(F.col("k").alias("k4"), F.get("dealt", F.lit(0)).alias("spare"))
    last = F.broadcast(last) if len(order) <= FEW_SOURCES else last
    per_row = (
        drawn.join(dealt, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left")
        .join(last, F.col("key") == F.col("k4"), "left")
        .select(
            F.col("key").alias("k"), F.col("h").alias("h2"), F.col("n").alias("n2"), "rows", "more", "source_words", "goal", "whole",
            F.when(F.col("whole") > 0, F.slice("dealt", F.lit(1), F.col("whole"))).otherwise(F.array().cast("array<int>")).alias("shards"),
            F.when(F.col("before"), F.get("dealt", F.col("whole"))).otherwise(F.col("spare")).alias("spare"),
        )
    )
    per_row = materialise(per_row, "mix-plan", sum(r for r, _ in stats.values()), lasting=True)
    a, b, c, d, e, f, g, i, j, k = fresh(keyed, *per_row.columns)
    split_groups = not per_row.where("more > 0 and more < rows").isEmpty()
    per_row = per_row.toDF(a, b, c, d, e, f, g, i, j, k)
    out = keyed.join(per_row, (F.col(key) == F.col(a)) & (F.col(h) == F.col(b)) & (F.col(n_) == F.col(c)))

    def result(rows: DataFrame, more: Column) -> DataFrame:
        copies = F.col(i) + more.cast("int")
        dealt_to = F.when(more, F.concat(F.col(j), F.array(F.col(k)))).otherwise(F.col(j))
        return rows.select(
            *keep, F.col(n_).alias(names[0]), F.col(f).alias(names[1]), F.col(g).alias(names[2]), copies.alias(names[3]), (F.col(n_) * copies).alias(names[4]), dealt_to.alias(names[5])
        )

    parted = (F.col(e) > 0) & (F.col(e) < F.col(d))
    if not split_groups:
        return result(out, F.col(e) > 0)
    # of a few groups of equal rows some are taken: number the rows of these
    at, in_part, start = fresh(out, "at", "in_part", "start")
    held = materialise(out.where(parted).withColumn(at, F.monotonically_increasing_id()), "mix-equal", lasting=True)
    group = [a, b, c]
    counted = held.groupBy(*group, F.shiftright(at, 33).alias(in_part)).agg(F.count(F.lit(1)).alias(start))
    offsets = counted.withColumn(start, F.sum(start).over(Window.partitionBy(*group).orderBy(in_part)) - F.col(start))  # a row for each partition
    offsets = offsets.toDF(*[f"{x}_" for x in offsets.columns])
    same = reduce(lambda x, y: x & y, [F.col(x) == F.col(f"{x}_") for x in group], F.shiftright(at, 33) == F.col(f"{in_part}_"))
    number = F.row_number().over(Window.partitionBy(*group, F.shiftright(at, 33)).orderBy(at)) - 1
    ranked = held.withColumn(in_part, number).join(offsets, same)
    return result(out.where(~parted), F.col(e) > 0).unionByName(result(ranked, F.col(in_part) + F.col(f"{start}_") < F.col(e)))


def mixed_documents(docs: DataFrame, source: str, size: Column, ident: list[Column], seed: int = 8, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` alone.

    Rows are dealt to their shards and shuffled in them, so a written table has a file or more for each shard.
    """
    names = fresh(docs, "size", "source_size", "target", "copies", "taken", "shards")
    planned = plan_mix(docs, source, size, ident, seed=seed, names=tuple(names), **options)
    epoch, shard, key = fresh(planned, "epoch", "shard", "key")
    copies = planned.select("*", F.posexplode(names[5]).alias(epoch, shard)).withColumn(key, F.xxhash64(F.lit(seed), F.col(epoch), *ident))
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = copies.repartition(spread, shard, F.pmod(F.col(key), F.lit(max(1, spread // 4)))).sortWithinPartitions(shard, key)
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])
