"""Exact deduplication with a log-structured merge index of text digests.

The index takes batches of rows in memtables. A memtable is flushed as a *run*: one row for each digest with the smallest
identifier (by the index's order) and the number of rows, sorted by digest; a batch's runs come with a filter, a bit map of
their digests. Compaction merges all runs and keeps, for each digest, the smallest identifier and the sum of rows.

A new batch is looked up against what is stored: its rows probe each filter, and only those that hit are joined with
those runs; no text that came before is read. A classification of the rows that the index took reads them again: a
filter of the digests with more than one row decides whose bytes are looked at; if all texts of a digest are the
same bytes, the index's entry is the answer, else equal bytes make the groups, whatever the digest says.

Everything is DataFrame code. What moves between machines is some 60 bytes a row, and the texts of possible copies. A
digest with a large share of all rows is answered by a broadcast of at most ``HOT`` entries, so its rows stay spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, new_path, on_exit, power_of_two, remove, scratch

#: Bits of the copy filter: 16 for each copied digest, up to 8 MB. A fuller filter lets more texts through; the result is the same.
FILTER_BITS = (1 << 16, 1 << 26)

#: Entries at most that count as hot: those with a ``HOT``-th of all rows or more, of some 100 bytes each.
HOT = 10_000

DIGESTS = {
    "sha256": lambda text: F.unhex(F.sha2(text, 256)),
    "xxhash64": lambda text: F.unhex(F.hex(F.xxhash64(text))),
    "length": lambda text: F.unhex(F.hex(F.octet_length(text))),  # many collisions, for tests of the verification
}


#: Columns that a classification adds.
DECISION = ("digest", "keep_id", "group_size", "kept")


def _bit(at: str) -> Column:
    """The bit of a 64-bit word that a position sets."""
    return F.expr(f"shiftleft(1L, cast(pmod(`{at}`, 64) as int))")


class DigestIndex:
    """``keep``: "max" or "min", the identifier of a group that stays. ``digest``: a name in ``DIGESTS``.

    ``root`` is a folder of the shared file system; an index that was stored there is opened.
    """

    RUN = "digest binary, best struct<nil: boolean, ord: long, ties: long>, n long, size long, run int"
    FILTER = "bits long, map array<long>"

    def __init__(self, spark: SparkSession, root: str | None = None, keep: str = "max", digest: str = "sha256"):
        if keep not in ("max", "min"):
            raise ValueError("keep must be 'max' or 'min'")
        self.spark, self.keep, self.root = spark, keep, root or new_path(spark, "lsm")
        self.digest = DIGESTS[digest]
        self.levels = self._stored()

    def _stored(self) -> list[str]:
        """Batches and compactions that are there in full, in their order; what a compaction took in is left out."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "filter/_SUCCESS"))
        found = sorted(s.getPath().getName() for s in fs.listStatus(where) if done(s.getPath()))
        merged = [i for i, name in enumerate(found) if name.endswith("-merged")]
        return [f"{self.root}/{name}" for name in found[merged[-1] if merged else 0 :]]

    def _order(self, ident: Column) -> Column:
        """The index keeps the smallest; for "max" identifiers count backwards. ``~x`` has no overflow."""
        return F.bitwise_not(ident) if self.keep == "max" else ident

    def _write(self, runs: DataFrame, name: str) -> str:
        """Runs sorted by digest, then their filter, whose marker makes them part of the index."""
        last = int(self.levels[-1].rsplit("/", 1)[1].split("-")[0]) if self.levels else 0
        path = f"{self.root}/{last + 1:06d}-{name}"
        runs.sortWithinPartitions("run", "digest").write.mode("overwrite").partitionBy("run").parquet(f"{path}/runs")
        bitmap, bits = _bitmap(self._read(path).select("digest"))
        bitmap.select(F.lit(bits).cast("long").alias("bits"), "map").write.mode("overwrite").parquet(f"{path}/filter")
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.RUN).parquet(f"{path}/runs")

    def insert(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", memtables: int = 4) -> None:
        """Flush ``memtables`` sorted runs with the rows of ``docs``: rows of an identifier are in the same."""
        key = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        number = F.col(f"`{ident}`").cast("long")
        rows = docs.select(
            F.pmod(F.xxhash64(number), F.lit(memtables)).cast("int").alias("run"),
            self.digest(key).alias("digest"),
            number.isNull().alias("nil"),
            F.coalesce(self._order(number), F.lit(0)).alias("ord"),
            F.octet_length(key).cast("long").alias("size"),
        )
        by_id = rows.groupBy("run", "digest", "nil", "ord").agg(F.count(F.lit(1)).alias("ties"), F.max("size").alias("size"))
        best = F.min(F.struct("nil", "ord", "ties")).alias("best")
        flushed = by_id.groupBy("digest", "run").agg(best, F.sum("ties").alias("n"), F.max("size").alias("size"))
        self.levels.append(self._write(flushed.repartitionByRange("run", "digest"), "batch"))

    def _runs(self) -> DataFrame:
        none = self.spark.createDataFrame([], self.RUN)
        return reduce(DataFrame.unionAll, map(self._read, self.levels), none)

    def compact(self) -> None:
        """Merge all runs into one: for each digest the smallest identifier and the sum of rows."""
        merged = self._runs().groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.max("size").alias("size"))
        self.levels = [self._write(merged.withColumn("run", F.lit(0)), "merged")]

    def entries(self) -> DataFrame:
        """digest, id that stays, rows: of all that was inserted."""
        merged = self._runs().groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        return merged.select("digest", self._identifier("best").alias("keep_id"), "n", F.col("best.ties").alias("ties"))

    def _identifier(self, best: str) -> Column:
        return F.when(~F.col(best)["nil"], self._order(F.col(best)["ord"]))

    def lookup(self, docs: DataFrame, text: str = "text", names=("digest", "keep_id", "seen")) -> DataFrame:
        """``docs`` with their digest, the identifier that the index keeps for it, and whether it has it at all.

        Reads the texts of ``docs`` alone: filters decide which rows are joined with which runs, and a hit is an entry
        of the same digest and size in bytes. A column of ``docs`` that is named like one of ``names`` is replaced.
        """
        docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
        digest, size, d2, s2, best = fresh(docs, "digest", "size", "digest_2", "size_2", "best")
        key = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        rows = docs.withColumns({digest: self.digest(key), size: F.octet_length(key).cast("long")})
        mine = [F.col(f"`{c}`") for c in docs.columns]
        found = []
        for path in self.levels:
            held = self.spark.read.schema(self.FILTER).parquet(f"{path}/filter")
            hits = rows.where(_hit(held, digest, held.first()["bits"])).select(digest, size).distinct()
            run = self._read(path).select(F.col("digest").alias(d2), F.col("size").alias(s2), F.col("best").alias(best))
            found.append(hits.join(run, (F.col(digest) == F.col(d2)) & (F.col(size) == F.col(s2))).select(d2, s2, best))
        none = self.spark.createDataFrame([], f"`{d2}` binary, `{s2}` long, `{best}` struct<nil: boolean, ord: long, ties: long>")
        known = reduce(DataFrame.unionAll, found, none).groupBy(d2, s2).agg(F.min(best).alias(best))
        out = rows.join(known, (F.col(digest) == F.col(d2)) & (F.col(size) == F.col(s2)), "left")
        return out.select(*mine, F.col(digest).alias(names[0]), self._identifier(best).alias(names[1]), F.col(best).isNotNull().alias(names[2]))

    def classify(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", names=DECISION) -> DataFrame:
        """For each row of ``docs``: all its columns, then digest, keep_id, group_size and kept under ``names``.

        Rows are equal when their texts have the same bytes; null is the empty text. Of each group one row stays,
        that with the largest (or smallest) identifier; null identifiers lose to all others, and of rows that
        repeat identifier and text one stays. ``docs`` must be what the index took. A column of ``docs`` that is
        named like one of ``names`` is replaced. Rows that the filter clears never move; the others are written
        once, their bytes compared, and joined with their digest's entry.
        """
        copied = materialise(self._runs().groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")).where("n > 1"), "copied")
        bitmap, bits = _bitmap(copied.select("digest"))
        shown = materialise(bitmap, "copy-filter", lasting=True)  # the clear rows of the result read it
        docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
        digest, row, best, n, d2, t2, first = fresh(docs, "digest", "row", "best", "n", "digest_g", "text_g", "first")
        key = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        marked = docs.withColumn(digest, self.digest(key))
        hit = _hit(shown, digest, bits)
        mine, other = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{ident}`").cast("long")
        clear = marked.where(~hit).select(
            *mine, F.col(digest).alias(names[0]), other.alias(names[1]), F.lit(1).cast("long").alias(names[2]), F.lit(True).alias(names[3])
        )
        suspects = materialise(marked.where(hit).withColumn(row, F.monotonically_increasing_id()), "suspects", lasting=True)
        # bytes are compared here: a task sends the least and the greatest text of a digest, however many copies it has
        spread = suspects.groupBy(digest).agg(F.min(key).alias("least"), F.max(key).alias("most"))
        clash = materialise(spread.where("least <> most").select(F.col(digest).alias("digest")), "clash", lasting=True)
        order = F.struct(other.isNull().alias("nil"), F.coalesce(self._order(other), F.lit(0)).alias("ord"))
        own = F.struct(F.col(best)["nil"].alias("nil"), F.col(best)["ord"].alias("ord"))
        clashes = not clash.isEmpty()
        entries = copied.join(clash, "digest", "left_anti") if clashes else copied
        found = [self._judged(suspects.join(clash.toDF(d2), F.col(digest) == F.col(d2), "left_anti") if clashes else suspects, entries, ident, digest, best, n)]
        if clashes:
            # the bytes decide: groups of (digest, text)
            of = suspects.join(clash.toDF(d2), F.col(digest) == F.col(d2), "left_semi")
            least = F.min(F.struct(order["nil"].alias("nil"), order["ord"].alias("ord"), F.lit(2).cast("long").alias("ties"))).alias(best)
            groups = of.groupBy(F.col(digest).alias(d2), key.alias(t2)).agg(least, F.count(F.lit(1)).alias(n))
            found.append(of.join(groups, (F.col(digest) == F.col(d2)) & (key == F.col(t2))).drop(d2, t2))
        judged = reduce(DataFrame.unionByName, found)
        # rows that repeat identifier and text: the one that was read first stays
        stays = own == order
        if clashes or not entries.where("best.ties > 1").isEmpty():
            tied = judged.where((F.col(best)["ties"] > 1) & stays)
            firsts = materialise(tied.groupBy(F.col(digest).alias(d2), key.alias(t2)).agg(F.min(row).alias(first)), "first", lasting=True)
            judged = judged.join(firsts, (F.col(digest) == F.col(d2)) & (key == F.col(t2)), "left")
            stays = stays & (F.col(first).isNull() | (F.col(row) == F.col(first)))
        out = judged.select(*mine, F.col(digest).alias(names[0]), self._identifier(best).alias(names[1]), F.col(n).alias(names[2]), stays.alias(names[3]))
        return clear.unionByName(out)

    def _judged(self, suspects: DataFrame, entries: DataFrame, ident: str, digest: str, best: str, n: str) -> DataFrame:
        """All rows, with their digest's entry; a row without one, which the filter let through by chance, is its own group.

        Hot digests are answered by broadcast; their rows' keys in the join are their own.
        """
        total = suspects.count()
        entries = materialise(entries.withColumn("hot", F.col("n") * HOT >= max(total, 1)), "entries", lasting=True)
        hot, cold = entries.where("hot"), entries.where("not hot")
        a, b, c, d, e, f, at = fresh(suspects, "hot_digest", "hot_best", "hot_n", "cold_digest", "cold_best", "cold_n", "at")
        cold = cold.select(F.col("digest").alias(d), F.col("best").alias(e), F.col("n").alias(f))
        number = F.col(f"`{ident}`").cast("long")
        alone = F.struct(number.isNull().alias("nil"), F.coalesce(self._order(number), F.lit(0)).alias("ord"), F.lit(1).cast("long").alias("ties"))
        one = F.lit(1).cast("long")
        if hot.isEmpty():
            found = suspects.join(cold, F.col(digest) == F.col(d), "left")
            return found.withColumns({best: F.coalesce(F.col(e), alone), n: F.coalesce(F.col(f), one)}).drop(d, e, f)
        hot = hot.select(F.col("digest").alias(a), F.col("best").alias(b), F.col("n").alias(c))
        known = suspects.join(F.broadcast(hot), F.col(digest) == F.col(a), "left")
        known = known.withColumn(at, F.when(F.col(a).isNull(), F.col(digest)).otherwise(F.unhex(F.hex(F.monotonically_increasing_id()))))
        found = known.join(cold, F.col(at) == F.col(d), "left")
        entry = {best: F.coalesce(F.col(b), F.col(e), alone), n: F.coalesce(F.col(c), F.col(f), one)}
        return found.withColumns(entry).drop(a, b, c, d, e, f, at)


def _bitmap(digests: DataFrame) -> tuple[DataFrame, int]:
    """One row with a bit map, as an array of longs, of the digests; and its bits."""
    spark = digests.sparkSession
    bits = power_of_two(16 * digests.count(), *FILTER_BITS)
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    words = digests.select(at.alias("at")).select(F.shiftright("at", 6).alias("slot"), _bit("at").alias("bit"))
    slots = words.groupBy("slot").agg(F.bit_or("bit").alias("word"))
    empty = spark.range(bits // 64).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("word"))
    whole = slots.unionAll(empty).groupBy("slot").agg(F.bit_or("word").alias("word"))
    rows = whole.agg(F.array_sort(F.collect_list(F.struct("slot", "word"))).alias("rows"))  # FILTER_BITS at most
    return rows.select(F.transform("rows", lambda x: x["word"]).alias("map")), bits


def _hit(held: DataFrame, digest: str, bits: int) -> Column:
    """Whether a filter, a table of one row, has a digest."""
    at = F.pmod(F.xxhash64(F.col(digest)), F.lit(bits))
    bit = F.element_at(held.select("map").scalar(), (F.shiftright(at, 6) + 1).cast("int"))
    return bit.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0


def exact_groups(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    keep: str = "max",
    digest: str = "sha256",
    memtables: int = 4,
    names=DECISION,
) -> DataFrame:
    """``docs`` with digest, keep_id, group_size and kept, by an index built for this call.

    ``docs`` may have other columns of any name; they pass through. An empty table gives an empty result.
    """
    with scratch():
        index = DigestIndex(docs.sparkSession, keep=keep, digest=digest)
        on_exit(lambda: remove(index.spark, index.root))
        index.insert(docs, ident, text, memtables)
        index.compact()
        return index.classify(docs, ident, text, names)


def drop_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns."""
    names = fresh(docs, *DECISION)
    found = exact_groups(docs, ident, text, names=names, **options)
    return found.where(F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])
