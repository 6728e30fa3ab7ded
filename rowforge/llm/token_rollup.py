"""Token counts as rollups that are kept by deltas.

Each batch of changes (inserts, deletes, revisions) becomes signed rows: a ledger of what each document adds or takes
away, and their sums by source, language and tokenizer. Totals are the sums of all committed batches' sums; no text
is counted twice and no total is rewritten. A batch is committed by the marker of its last write: writing it again
is a no-op after that, and starts over before. A batch with deletes or revisions reads the ledgers' parts of their
identifiers; totals are the sum of the batches' sums, which ``compact`` makes one.

Texts are counted exactly as the tokenizer would, unit by unit: its pattern never lets a token cross from a
character that is not white space to one that is, so each different unit of a batch is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import _SPACE, Texts, chunks, span_hashes
from .common import new_path

#: Bytes of text whose units are looked up at once, and units that a worker remembers between, for each tokenizer.
BATCH, REMEMBERED = 3 << 20, 1_500_000
# Fixed value: the pattern that both vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary file of base64 tokens and ranks, by name and version."""

    name: str
    path: str

    def read(self) -> bytes:
        """The file, for the driver alone: workers get what it holds."""
        with open(self.path, "rb") as f:
            return f.read()

    def load(self, held: bytes | None = None):
        import tiktoken

        lines = (self.read() if held is None else held).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TOKENIZERS = (
    Tokenizer("byte_bpe_50k", "/opt/tokenizers/byte_bpe_50k.tiktoken"),
    Tokenizer("byte_bpe_multi_50k", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"),
)


def units(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that no token crosses: white space with what follows, cut before ASCII white space that follows
    another character. A character that may be white space outside ASCII does not end a unit."""
    n = len(t.data)
    cut = np.zeros(n, bool)
    begins = t.offsets[:-1]
    cut[begins[begins < n]] = True
    if n:
        d, blank = t.data, _SPACE[t.data]
        maybe = np.zeros(n, bool)
        maybe[1:] |= (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
        maybe[2:] |= ((d[:-2] == 0xE1) & (d[1:-1] == 0x9A)) | ((d[:-2] == 0xE2) & ((d[1:-1] == 0x80) | (d[1:-1] == 0x81))) | ((d[:-2] == 0xE3) & (d[1:-1] == 0x80))
        cut[1:] |= blank[1:] & ~blank[:-1] & ~maybe[:-1]
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], n)[: len(begin)]


class Units:
    """The units of some texts, and the different ones among them."""

    def __init__(self, t: Texts):
        self.begin, self.end = units(t)
        self.names, self.first, self.which = np.unique(span_hashes(t.data, self.begin, self.end, seed=5), return_index=True, return_inverse=True)


class Counter:
    """Token counts of batches of texts by one tokenizer."""

    def __init__(self, tokenizer: Tokenizer, held: bytes | None = None):
        self.encoding = tokenizer.load(held)
        self.length = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)], np.int64)
        self.names, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, t: Texts, cut: Units | None = None) -> np.ndarray:
        """Tokens of each text. ``cut``: its units, where they are known."""
        cut = cut or Units(t)
        if not len(cut.begin):
            return np.zeros(len(t), np.int64)
        begin, end, names, first, which = cut.begin, cut.end, cut.names, cut.first, cut.which
        if len(self.names) > REMEMBERED:
            self.names, self.count = self.names[:0], self.count[:0]
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        new = np.flatnonzero(self.names[at] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            got = self._encode([t.data[begin[i] : end[i]].tobytes() for i in first[new]])
            every, count = np.concatenate([self.names, names[new]]), np.concatenate([self.count, got])
            order = np.argsort(every, kind="stable")
            self.names, self.count = every[order], count[order]
            at = np.searchsorted(self.names, names)
        total = np.concatenate([[0], np.cumsum(self.count[at][which])])
        edge = np.searchsorted(begin, t.offsets)
        return total[edge[1:]] - total[edge[:-1]]


    def _encode(self, found: list[bytes]) -> np.ndarray:
        """Token counts of units. Those that begin with ASCII white space and end otherwise are encoded in one go:
        laid end to end they are still units, and the tokens' lengths say where each ends."""
        ordinary = np.array([_SPACE[u[0]] and u[-1] < 128 and not _SPACE[u[-1]] for u in found])
        got = np.empty(len(found), np.int64)
        for i in np.flatnonzero(~ordinary):
            got[i] = len(self.encoding.encode_ordinary(found[i].decode()))
        which = np.flatnonzero(ordinary)
        if len(which):
            joined = [found[i] for i in which]
            tokens = np.array(self.encoding.encode_ordinary(b"".join(joined).decode()), np.int64)
            ends = np.searchsorted(np.cumsum(self.length[tokens]), np.cumsum([len(u) for u in joined]), "right")
            got[which] = np.diff(ends, prepend=0)
        return got


_counters: dict[Tokenizer, Counter] = {}


def count_tokens(docs: DataFrame, text: str = "text", name: str = "tokens", tokenizers=TOKENIZERS, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (all of ``docs`` if None), then ``name``: tokens by tokenizer, in their order, as an array.

    A null or empty text has none. No shuffle. A column of ``docs`` named like ``name`` is replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != name.lower()]
    docs = docs.select(*[f"`{c}`" for c in [*carry, *[text] * (text not in carry)]])
    at, held, tokenizers = docs.columns.index(text), len(carry), tuple(tokenizers)
    files = docs.sparkSession.sparkContext.broadcast([k.read() for k in tokenizers])  # vocabularies, a megabyte or two each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, file in zip(tokenizers, files.value, strict=True):
            if k not in _counters:
                _counters[k] = Counter(k, file)
        for batch in batches:
            for t in chunks(batch.column(at), BATCH):
                cut = Units(t)
                counts = np.column_stack([_counters[k](t, cut) for k in tokenizers]).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * len(tokenizers), pa.int32()), pa.array(counts, pa.int64()))
                rows = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([*rows.columns[:held], lists], schema=pa.schema([*list(rows.schema)[:held], pa.field(name, lists.type)]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:held], T.StructField(name, T.ArrayType(T.LongType()))]))


_ROW = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, part int"
#: Folders of a batch's ledger, by a hash of the identifier: a batch reads those of the identifiers that it changes.
PARTS = 64


def _part(ident: str):
    return F.pmod(F.xxhash64(ident), F.lit(PARTS)).cast("int")


_SUM = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Totals in a folder of the shared file system: ``ledger/`` and ``sums/``, a folder for each batch in both."""

    def __init__(self, spark: SparkSession, root: str | None = None, tokenizers=TOKENIZERS):
        self.spark, self.root, self.tokenizers = spark, root or new_path(spark, "rollup"), tuple(tokenizers)

    def _committed(self) -> list[str]:
        jvm, path = self.spark._jvm, f"{self.root}/sums"
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        if paths := [f"{self.root}/{kind}/{b}" for b in self._committed()]:
            out = self.spark.read.option("basePath", f"{self.root}/{kind}").schema(f"{schema}, batch string").parquet(*paths).drop("batch")
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (op, doc_id, source, lang, text); False if it had been committed before.

        ``insert`` adds a row's tokens, whatever its identifier. ``delete`` takes away all that stands for its
        identifier, ``revise`` does so and adds the row; of an identifier with nothing standing, delete does nothing.
        Within a batch, deletes and revisions refer to what stood before it. Null identifiers are only inserted;
        null sources and languages are groups of their own.
        """
        name = f"batch={batch}"
        if name in self._committed():
            return False
        counted = count_tokens(changes.where("op <> 'delete'"), carry=["doc_id", "source", "lang"], tokenizers=self.tokenizers)
        kinds = F.array(*[F.lit(k.name) for k in self.tokenizers])
        added = counted.select("doc_id", "source", "lang", F.explode(F.arrays_zip(kinds.alias("k"), F.col("tokens").alias("n"))).alias("x")).select(
            "doc_id", "source", "lang", F.col("x.k").alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col("x.n").alias("tokens")
        )
        rows = added
        if self._committed():
            gone = changes.where("op <> 'insert' and doc_id is not null").select("doc_id").distinct()
            parts = [r["part"] for r in gone.select(_part("doc_id").alias("part")).distinct().collect()]  # PARTS at most
            stands = (
                self._read("ledger", _ROW)
                .where(F.col("part").isin(parts))
                .join(gone, "doc_id", "left_semi")
                .groupBy("doc_id", "source", "lang", "tokenizer")
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 or tokens <> 0")
            )
            rows = rows.unionByName(stands.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
        # a file or a few for each part, however many tasks there were
        spread = rows.withColumn("part", _part("doc_id")).repartition("part", F.pmod(F.hash("doc_id", "tokens"), F.lit(4)))
        spread.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/ledger/{name}")
        ledger = self.spark.read.schema(_ROW).parquet(f"{self.root}/ledger/{name}")
        sums = ledger.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sums/{name}")  # its marker commits the batch
        return True

    def compact(self) -> None:
        """Add up the sums of all committed batches in one folder, which then stands for them; their ledgers stay."""
        names = self._committed()
        if len(self._folded()) < len(names):
            marks = self.spark.createDataFrame([(n,) for n in names], "batch string")
            at = f"{self.root}/folded/{len(names):09d}"
            self._summed().write.mode("overwrite").parquet(f"{at}/sums")
            marks.coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")  # its marker makes it count

    def _folded(self) -> list[str]:
        """Batches whose sums are folded, by the last folding that is there in full."""
        at = self._last_fold()
        return [r["batch"] for r in self.spark.read.parquet(f"{at}/batches").collect()] if at else []

    def _last_fold(self) -> str | None:
        jvm, path = self.spark._jvm, f"{self.root}/folded"
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "batches/_SUCCESS")))
        return f"{path}/{done[-1]}" if done else None

    def _summed(self) -> DataFrame:
        folded = set(self._folded())
        paths = [f"{self.root}/sums/{b}" for b in self._committed() if b not in folded] + [f"{self._last_fold()}/sums"] * bool(folded)
        sums = self.spark.read.schema(_SUM).parquet(*paths) if paths else self.spark.createDataFrame([], _SUM)
        return sums.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens: as of the committed batches; groups with nothing left are left out. Without
        batches, or with batches of no rows, it is empty."""
        return self._summed().where("docs <> 0 or tokens <> 0")
