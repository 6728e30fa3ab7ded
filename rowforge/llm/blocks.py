"""Packed blocks of documents, and sums over keys across blocks without a row for each key.

Corpus statistics of n-grams have more keys than documents have words. Here a *block* (some megabytes of text) is one
row: its identifiers, its sorted vocabulary of word hashes and its words as places in it. A block asks for sums over
all blocks by sending, to each of some *ranges* of the key space, one row with its ascending keys and its own values; a
range adds up and sends back what it found in the order asked. Every key of every document takes part; a key that is
in every document is one entry a block, and keys are hashes, so ranges are even. What is shuffled is a few bytes a
key instead of a row.

A block asks ``FAN`` ranges at most, whatever the size of the input. Where more are needed for ranges to stay small,
*relays* stand between: a relay speaks for up to ``FAN`` blocks in one range, merges their requests into one and asks
the ``FAN`` ranges within it, and so on. So there are ``FAN`` rows a block and level at most, each with some thousands of
keys, and levels grow as the logarithm of the input.

Keys are 64-bit hashes: among n keys one shares its hash with another with a probability of n / 2 ** 64, a millionth
for the n-grams of 100 TB; such keys are counted as one.

Blocks are a table bucketed by their home, a few of which a task packs, so that they stay where they are when answers
come and a task writes a few files, whatever it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK, begins, chunks, ranked, span_hashes, words
from .common import new_path, on_exit, power_of_two, remove, text_bytes

#: UTF-8 bytes of the texts in a block; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: UTF-8 bytes of the input for which there is a range of keys.
RANGE_BYTES = 12 << 20
#: Homes of the blocks of a task.
HOMES = 8
#: Bits of the ranges that a block or relay asks at once, and so of the blocks that a relay speaks for.
FAN_BITS = 8

BLOCK_SCHEMA = "home int, block long, ids array<long>, marks binary, sizes binary, vocab binary, tokens binary"
REQUEST = "part long, home int, block long, keys binary, values array<binary>"
#: ``block`` -1: not an answer but what a range leaves.
ANSWER = "part long, home int, block long, values array<binary>"
_REQUEST = pa.schema([("part", pa.int64()), ("home", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
_ANSWER = pa.schema([("part", pa.int64()), ("home", pa.int32()), ("block", pa.int64()), ("values", pa.list_(pa.binary()))])
_FLOATS, _BITS = 255, 254
#: Below so many values a call for each byte plane costs more than it saves.
_FEW = 512


def _planes(values: np.ndarray, width: int) -> bytes:
    if len(values) < _FEW:
        return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return b"".join((values >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(width))


def _of_planes(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    if len(out) < _FEW:
        out[:, : len(planes)] = planes.T
    else:
        for i, plane in enumerate(planes):
            out[:, i] = plane
    return out.view(np.uint64).ravel()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, low bytes first, as many as the largest needs; floats likewise, but zeros
    are bits alone, and booleans as bits."""
    if values.dtype == np.float64:
        some = values != 0
        return bytes([_FLOATS]) + len(values).to_bytes(8, "little") + np.packbits(some).tobytes() + _planes(values[some].view(np.uint64), 8)
    if values.dtype == bool:
        return bytes([_BITS]) + len(values).to_bytes(8, "little") + np.packbits(values).tobytes()
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + _planes(values, width)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    if width == _FLOATS:
        n = int.from_bytes(data[1:9], "little")
        out, at = np.zeros(n), 9 + (n + 7) // 8
        some = np.unpackbits(np.frombuffer(data[9:at], np.uint8), count=n).astype(bool)
        out[some] = _of_planes(np.frombuffer(data, np.uint8, offset=at).reshape(8, -1)).view(np.float64)
        return out
    if width == _BITS:
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=9), count=int.from_bytes(data[1:9], "little")).astype(bool)
    return _of_planes(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0))) if len(keys) else pack(keys)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """``df`` as a table bucketed by a column, for as long as the running operator runs."""
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def undo() -> None:
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        remove(spark, path)

    on_exit(undo)
    df.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def pack_blocks(rows: DataFrame, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``rows`` (id long, text string, mark boolean), as a table bucketed by home. No shuffle.

    ``lower`` folds A-Z. A null text is empty; a null mark is false; identifiers may be null or repeat.
    """
    kinds = [("home", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("marks", "sizes", "vocab", "tokens")]]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held, have = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal seq, held, have
            ids = pa.concat_arrays([h[0] for h in held])
            marks = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            order, found = ranked(np.concatenate([h[3] for h in held]))
            new = begins(found)
            vocab, tokens = found[new], np.empty(len(found), np.int64)
            tokens[order] = np.cumsum(new) - 1
            row = [
                [task * HOMES + seq % HOMES],
                [(task << 32) | seq],
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                [pack(marks)],
                [pack(sizes)],
                [pack_sorted(vocab)],
                [pack(tokens)],
            ]
            seq, held, have = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) if isinstance(x, list) else x for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            ids, texts, marks = batch.columns
            marks = np.asarray(marks.fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            for t in chunks(texts, min(CHUNK, block_bytes)):
                if held and have + len(t.data) > block_bytes:
                    yield block()
                if lower:
                    t.data = _LOWER[t.data]
                w = words(t)
                here = slice(t.first, t.first + len(t))
                held.append((ids[here].cast(pa.int64()), marks[here], np.bincount(w.doc, minlength=len(t)), span_hashes(t.data, w.start, w.end)))
                have += len(t.data)
        if held:
            yield block()

    return bucketed(rows.mapInArrow(run, BLOCK_SCHEMA), "blocks", "home")


class Block:
    """A row of ``BLOCK_SCHEMA``: word hashes of the vocabulary, and the words of all texts as places in it."""

    def __init__(self, row: dict):
        self.home, self.number, self.ids = row["home"], row["block"], pa.array(row["ids"], pa.int64())
        self.marks, self.sizes = unpack(row["marks"]), unpack(row["sizes"]).view(np.int64)
        self.vocab, self.tokens = unpack_sorted(row["vocab"]), unpack(row["tokens"]).view(np.int64)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def part_count(bytes_of_text: int) -> int:
    """Ranges of the key space, a power of two: one for each ``RANGE_BYTES`` of text, 32 at least."""
    return power_of_two(bytes_of_text / RANGE_BYTES, 32)


def levels(parts: int) -> list[int]:
    """Bits of the ranges that are told apart at each level: by blocks, then by relays."""
    bits = parts.bit_length() - 1
    return [min(FAN_BITS, bits - b) for b in range(0, bits, FAN_BITS)] or [0]


def cut(keys: np.ndarray, before: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending keys that agree in their first ``before`` bits, by the ``bits`` that follow too."""
    if not len(keys):
        return []
    which = (keys >> np.uint64(64 - before - bits)).astype(np.int64) if before + bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.diff(which)) + 1
    lo, hi = np.concatenate([[0], at]), np.concatenate([at, [len(keys)]])
    return [(int(which[a]), int(a), int(b)) for a, b in zip(lo, hi, strict=True)]


def requests(home: int, block: int, keys: np.ndarray, values: list[np.ndarray], bits: int, before: int = 0, empty: bool = False) -> list[dict]:
    """A row for each range of the keys. ``empty``: without keys one row, for which there will be an answer."""
    ranges = cut(keys, before, bits) or ([(0, 0, 0)] if empty else [])
    return [{"part": p, "home": home, "block": block, "keys": pack_sorted(keys[i:j]), "values": [pack(v[i:j]) for v in values]} for p, i, j in ranges]


class Merged:
    """Several requests as one. ``keys``: all, distinct and ascending; ``sums``: of each value by key.

    A boolean value says of which keys the sender wants the floats of the answer; it is not summed. For others it gets 0.
    """

    def __init__(self, rows: list[dict]):
        held = [unpack_sorted(r["keys"]) for r in rows]
        self.sizes = [len(k) for k in held]
        every = np.concatenate(held)
        values = [np.concatenate(v) for v in zip(*[[unpack(v) for v in r["values"]] for r in rows], strict=True)]
        self.wants = next((v for v in values if v.dtype == bool), None)
        values = [v for v in values if v.dtype != bool]
        order, found = ranked(every)
        new = begins(found)
        place = np.cumsum(new) - 1
        self.which = np.empty(len(every), np.int64)
        self.which[order] = place
        self.keys = found[new]
        starts = np.flatnonzero(new)
        values = [v[order] for v in values]
        self.sums = [np.add.reduceat(v, starts) if len(v) else v for v in values]
        # of equal keys the first that has a count answers for the key
        some = np.flatnonzero(values[0]) if values else np.arange(len(every))
        self.first = np.zeros(len(every), bool)
        self.first[order[some[begins(place[some])]]] = True

    def share(self, found: list[np.ndarray]) -> list[list[bytes]]:
        """What was found for ``keys``, cut back to the requests. Of booleans only the first sender of a key gets true."""
        out = []
        for f in found:
            f = f[self.which]
            if f.dtype == bool:
                f = f & self.first
            elif f.dtype == np.float64 and self.wants is not None:
                f = np.where(self.wants, f, 0.0)
            out.append([pack(x) for x in np.split(f, np.cumsum(self.sizes)[:-1])])
        return [list(x) for x in zip(*out, strict=True)]

    def wanted(self) -> list[np.ndarray]:
        """The boolean value of the merged request, if there is one."""
        if self.wants is None:
            return []
        out = np.zeros(len(self.keys), bool)
        out[self.which[self.wants]] = True
        return [out]


#: What a range does with its keys and sums: what it found for each key, and what it leaves (for ``block`` -1) if anything.
Leaf = Callable[..., tuple[list[np.ndarray], list[bytes] | None]]


def exchange(asked: DataFrame, parts: int, blocks: int, leaf: Leaf, held: DataFrame | None = None) -> DataFrame:
    """Answers to the requests ``asked`` of ``blocks`` blocks, cut by the first of ``levels(parts)``.

    ``held``: a table (part, values) of what ranges know; ``leaf`` then gets its range's values too.
    """
    return _exchange(asked, levels(parts), 0, blocks, leaf, held)


def _exchange(asked: DataFrame, bits: list[int], before: int, senders: int, leaf: Leaf, known: DataFrame | None) -> DataFrame:
    if len(bits) == 1:

        def answer(table, *extra):
            rows = list(_rows(table))
            if not rows:  # a range that nobody asks
                return _ANSWER.empty_table()
            m = Merged(rows)
            found, left = leaf(rows[0]["part"], m.keys, m.sums, *extra)
            out = [{"part": r["part"], "home": r["home"], "block": r["block"], "values": v} for r, v in zip(rows, m.share(found), strict=True)]
            if left is not None:
                out.append({"part": rows[0]["part"], "home": -1, "block": -1, "values": left})
            return pa.Table.from_pylist(out, schema=_ANSWER)

        if known is not None:

            def informed(table: pa.Table, of_range: pa.Table) -> pa.Table:
                return answer(table, [r["values"] for r in _rows(of_range)])

            return asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(informed, ANSWER)

        def alone(table: pa.Table) -> pa.Table:
            return answer(table)

        return asked.groupBy("part").applyInArrow(alone, ANSWER)

    done, after = before + bits[0], bits[1]
    groups = -(-senders >> FAN_BITS) if senders > 0 else 1
    held = bucketed(asked.withColumn("relay", F.col("part") * groups + F.pmod(F.xxhash64("home", "block"), F.lit(groups))), "relays", "relay")

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table), key=lambda r: (r["home"], r["block"]))
        m = Merged(rows)
        return pa.Table.from_pylist(requests(-2, rows[0]["relay"], m.keys, [*m.sums, *m.wanted()], after, done, True), schema=_REQUEST)

    def shared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # what ranges leave
            return right.select(_ANSWER.names).cast(_ANSWER)
        rows = sorted(_rows(left), key=lambda r: (r["home"], r["block"]))
        out = Merged(rows).share(gathered(list(_rows(right))))
        return pa.Table.from_pylist([{"part": r["part"], "home": r["home"], "block": r["block"], "values": v} for r, v in zip(rows, out, strict=True)], schema=_ANSWER)

    told = _exchange(held.groupBy("relay").applyInArrow(merged, REQUEST), bits[1:], done, groups, leaf, known)
    return held.groupBy("relay").cogroup(told.groupBy("block")).applyInArrow(shared, ANSWER)


def gathered(rows: list[dict]) -> list[np.ndarray]:
    """The values of one asker's answers, in the order of its keys."""
    rows = sorted(rows, key=lambda r: r["part"])
    return [np.concatenate([unpack(x) for x in v]) for v in zip(*[r["values"] for r in rows], strict=True)]


def each_block(blocks: DataFrame, run: Callable[[Block], list[dict]]) -> DataFrame:
    """The requests that ``run`` makes of each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(pa.Table.from_batches([batch])):
                yield from pa.Table.from_pylist(run(Block(r)), schema=_REQUEST).to_batches()

    return blocks.mapInArrow(rows, REQUEST)


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[Block, list[dict]], pa.Table], schema: str) -> DataFrame:
    """``run`` on each block with its answers. The blocks are not shuffled, the answers are."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        told: dict[int, list[dict]] = {}
        for r in _rows(right):
            told.setdefault(r["block"], []).append(r)
        return pa.concat_tables([run(Block(r), told.pop(r["block"], [])) for r in _rows(left)])

    return blocks.groupBy("home").cogroup(answers.where("block >= 0").groupBy("home")).applyInArrow(both, schema)


def request_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_REQUEST)


def size_of(docs: DataFrame, text: str) -> int:
    return text_bytes(docs, text)
