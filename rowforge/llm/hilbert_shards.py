"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits, the cell's index on the Hilbert curve orders the rows, and runs of the
order become the shards. Rows that are near in all dimensions share a shard, so a reader that filters by any of
the dimensions can skip most files by their minima and maxima.

The order is total (curve, then the text's checksum, then identifier), so equal rows of metadata are spread by
range partitions like all others and a hot cell costs nothing. No window and no single task sees all rows: a
range exchange sorts them, each row's rank is its partition's offset and its position there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell, whose coordinates are integers in [0, 2 ** bits).

    The transposition method: from the highest bit down, each axis inverts or exchanges the low bits of the first;
    then the axes are Gray-coded and their bits interleaved. It is a fold over the levels.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("at most 62 bits in all")
    axes = F.array(*[c.cast("long") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        low, at = s["q"] - 1, s["i"]
        mine, first = F.get(x, at), F.get(x, F.lit(0))
        flip = mine.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        new_first = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_mine = F.when(flip, mine).otherwise(mine.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == at, new_mine).otherwise(v))

    turned = F.aggregate(steps, axes, step) if bits > 1 else axes
    return _let(turned, lambda x: _let(_gray(x), lambda g: _interleaved(g, n, bits)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gray(axes: Column) -> Column:
    """Each axis is the exclusive or of itself and all before it."""
    return F.transform(axes, lambda v, k: F.aggregate(F.slice(axes, 1, k + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))


def _interleaved(coded: Column, n: int, bits: int) -> Column:
    """The bits of all axes, highest first, after the last axis has inverted the low bits of all."""
    last = F.get(coded, F.lit(n - 1))
    mask = reduce(
        lambda a, b: a.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long")),
        range(bits - 1, 0, -1),
        F.lit(0).cast("long"),
    )

    def spread(flipped: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out * 2 + F.shiftright(F.get(flipped, F.lit(i)), b).bitwiseAND(F.lit(1).cast("long"))
        return out

    return _let(_let(mask, lambda m: F.transform(coded, lambda v: v.bitwiseXOR(m))), spread)


def quantise(value: Column, low, high, bits: int) -> Column:
    """Equal parts of [low, high], numbered from 0; null is in the first."""
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    part = F.floor((value.cast("double") - F.lit(float(low))) / F.lit((float(high) - float(low)) or 1.0) * (1 << bits))
    return F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def quantise_name(value: Column, bits: int) -> Column:
    """Cell of a category, by its md5: any hash will do, as a file's few names are still near together; null is in the first."""
    number = F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(1 << bits)), F.lit(0).cast("long"))


def quantise_size(value: Column, bits: int) -> Column:
    """Cell of a positive whole number: two for each power of two, counted from 1; the last has all that is greater."""
    binary = F.bin(value)
    return F.least(2 * (F.length(binary) - 1) + (F.substring(binary, 2, 1) == "1").cast("int"), F.lit((1 << bits) - 1)).cast("long")


def curve_shards(docs: DataFrame, cells: list[Column], bits: int, ties: list[Column], shards: int, names=("curve", "shard", "slot")) -> DataFrame:
    """``docs`` with the curve's index, the shard (0 up) and the gapless slot in it.

    Shards are runs of the order (curve, ``ties``); their row counts differ by one at most. Rows that agree in all
    of these are dealt in the order in which they were read. Columns of ``docs`` named like ``names`` are
    replaced; the others pass through. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    keep = [F.col(f"`{c}`") for c in docs.columns]
    curve, *tie, at = fresh(docs, "curve", *[f"tie{i}" for i in range(len(ties))], "at")
    keyed = docs.select("*", hilbert_index(cells, bits).alias(curve), *[t.alias(n) for t, n in zip(ties, tie, strict=True)])
    order = [curve, *tie]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn(at, F.monotonically_increasing_id()), "curve", lasting=True)
    # the identifier holds the partition above bit 33 and the position in it below
    counts = ranged.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each partition
    total, starts = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        starts.append((part, total))
        total += n
    frame = docs.sparkSession.createDataFrame(starts or [(0, 0)], "part long, start long")
    p2, s2 = fresh(ranged, "part", "start")
    frame = frame.toDF(p2, s2)
    rank = F.col(s2) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    small, extra = divmod(total, shards)
    # the first `extra` shards have one row more
    edge = extra * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - edge) / max(small, 1)))
    slot = F.when(rank < edge, rank % (small + 1)).otherwise((rank - edge) % max(small, 1))
    # one row for each partition of the exchange above: as many as `spark.sql.shuffle.partitions`
    joined = ranged.join(F.broadcast(frame), F.shiftright(at, 33) == F.col(p2))
    return joined.select(*keep, F.col(curve).alias(names[0]), shard.cast("int").alias(names[1]), slot.cast("long").alias(names[2]))
