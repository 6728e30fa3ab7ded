"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A text is cut into units that no piece crosses (a run of spaces with what follows it, or a line break), and each
different unit of a batch is worked off once. The units' bytes are laid end to end and their suffixes sorted; every
piece is looked up in the suffix array by binary search, which gives a range of occurrences; the occurrences are
edges of a graph over byte positions. The edges are sorted by position and relaxed from the left.

What an edge relaxes is not a sum of scores: a BPE model merges pairs by rank, and the best path by score is another
segmentation. But of all edges into a position exactly one is the last piece of the text up to it, and whether it is
can be told from it and the last piece before it alone: undo both pieces' merges, latest first, and see whether a
merge across the border would have come earlier. So relaxing gives the model's own segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import Texts, chunks, give_back, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that share a suffix array, and units that a worker remembers between batches.
BATCH, REMEMBERED = 2 << 20, 250_000
#: Bytes of different units that share a suffix array: an index has about five edges a byte.
INDEXED = 128 << 10
#: Pieces whose bytes are put together at a time: each byte takes some 30 while that is done.
DECODED = 64 << 10
#: Pairs of pieces of which a worker remembers whether they are compatible.
REMEMBERED_PAIRS = 1_500_000
_MARK = "▁"
_FAR, _ALL = np.int64(1) << 40, 1 << 62


@dataclass
class Pieces:
    """A model as arrays. ``rank``: 0 for a character or byte, else the order of its merge; ``pairs``: ascending
    left * n + right of all pairs that make a piece, and ``made``, the rank of that piece."""

    texts: list[bytes]
    byte_ids: np.ndarray
    usable: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    ids: dict[bytes, int]
    score: np.ndarray
    prefix: bool
    breaks: bool


def load(path: str = MODEL) -> Pieces:
    """Read a model; ``ValueError`` for one that is not BPE with byte fallback or that rewrites its input."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback is needed")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("a model that takes texts as they are is needed")
    normal, byte = 1, 6
    n = len(model.pieces)
    texts, ids, byte_ids = [b""] * n, {}, np.full(256, -1, np.int64)
    score = np.array([p.score for p in model.pieces], np.float64)
    for i, p in enumerate(model.pieces):
        if p.type == normal:
            texts[i] = p.piece.replace(_MARK, " ").encode()
            ids[texts[i]] = i
        elif p.type == byte:
            texts[i] = bytes([int(p.piece[3:5], 16)])
            byte_ids[texts[i][0]] = i
    rank, left, right = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    usable = np.zeros(n, bool)
    order = sorted(ids.values(), key=lambda i: (-score[i], i))
    for at, i in enumerate(order, 1):
        parts = texts[i].decode()
        if len(parts) > 1:
            rank[i] = at
    pair_keys, pair_rank = [], []
    for text, i in ids.items():
        chars = text.decode()
        if len(chars) == 1:
            usable[i] = True
            continue
        for k in range(1, len(chars)):
            a, b = ids.get(chars[:k].encode()), ids.get(chars[k:].encode())
            if a is not None and b is not None:
                pair_keys.append(a * n + b)
                pair_rank.append(rank[i])
        got, last = merge(text, ids, score)
        if got == [i]:
            usable[i], left[i], right[i] = True, *last
    by = np.argsort(np.array(pair_keys, np.int64))
    breaks = all(b"\n" not in t for t in ids) and all(b" " not in t.lstrip(b" ") for t in ids)
    return Pieces(texts, byte_ids, usable, rank, left, right, np.array(pair_keys, np.int64)[by], np.array(pair_rank, np.int64)[by], ids, score, spec.add_dummy_prefix, breaks)


def merge(text: bytes, ids: dict[bytes, int], score: np.ndarray) -> tuple[list[int], tuple[int, int] | None]:
    """Plain BPE of a few characters: merge the neighbours whose piece scores highest, of equals the leftmost.

    The pieces (-1 - byte for bytes of characters without a piece), and the last merge's pieces.
    """
    parts: list[bytes | None] = [c.encode() for c in text.decode("utf-8", "surrogateescape")] if text else []
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if i >= 0 and j < len(parts) and (k := ids.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-score[k], i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    last = None
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        last = (ids.get(a, -1), ids.get(b, -1))
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    out: list[int] = []
    for p in parts:
        if p is not None:
            out += [ids[p]] if p in ids else [-1 - x for x in p]
    return out, last


class Matcher:
    """Suffix-array matching of distinct units against all pieces."""

    def __init__(self, pieces: Pieces):
        self.p = p = pieces
        self.n = len(p.texts)
        matched = [i for i in range(self.n) if p.usable[i]]
        self.piece = np.array(matched, np.int64)
        self.length = np.array([len(x) for x in p.texts], np.int64)
        deep = (int(self.length[self.piece].max()) + 7) // 8
        padded = b"".join(p.texts[i].ljust(8 * deep, b"\0") for i in matched)
        self.low = np.frombuffer(padded, ">u8").reshape(len(matched), deep).astype(np.uint64)
        filled = b"".join(p.texts[i].ljust(8 * deep, b"\xff") for i in matched)
        self.high = np.frombuffer(filled, ">u8").reshape(len(matched), deep).astype(np.uint64)
        self.words = np.maximum(1, (self.length[self.piece] + 7) // 8)
        self.single = np.zeros(self.n, bool)
        self.single[[i for i in matched if p.rank[i] == 0]] = True
        self.known = np.zeros(0, np.int64)
        self.valid = np.zeros(0, bool)

    def suffixes(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array, as deep as the longest piece, and each suffix's words of 8 bytes in its order.

        A suffix ends with its unit (``end`` of each position): bytes beyond count as 0.
        """
        n, deep = len(data), self.low.shape[1]
        padded = np.concatenate([data, np.zeros(8 * deep, np.uint8)]).astype(np.uint64)
        room = (end - np.arange(n)).astype(np.int64)
        words = []
        for w in range(deep):
            word = np.zeros(n, np.uint64)
            for k in range(8 * w, 8 * w + 8):
                word = (word << np.uint64(8)) | np.where(room > k, padded[k : k + n], np.uint64(0))
            words.append(word)
            if (room <= 8 * w + 8).all():
                break
        order = np.lexsort(words[::-1])
        return order, [w[order] for w in words]

    def ranges(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For every piece, the range of the suffix array that begins with it."""
        first = np.searchsorted(words[0], self.low[:, 0])
        last = np.searchsorted(words[0], self.high[:, 0], "right")
        for w in range(1, self.low.shape[1]):
            more = np.flatnonzero((self.words > w) & (first < last))
            if w >= len(words):
                last[more] = first[more]
                continue
            a, b = first[more], last[more]
            first[more] = _bisect(words[w], a, b, self.low[more, w], False)
            last[more] = _bisect(words[w], a, b, self.high[more, w], True)
        return first, last

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model leaves piece ``a`` before piece ``b`` as they are; remembered by pair."""
        key = a * self.n + b
        want, at = np.unique(key, return_inverse=True)
        where = np.searchsorted(self.known, want)
        where[where == len(self.known)] = 0
        have = self.known[where] == want if len(self.known) else np.zeros(len(want), bool)
        out = np.zeros(len(want), bool)
        out[have] = self.valid[where[have]]
        new = want[~have]
        if len(new):
            fresh = self._undo(new // self.n, new % self.n)
            out[~have] = fresh
            if len(self.known) > REMEMBERED_PAIRS:
                self.known, self.valid = self.known[:0], self.valid[:0]
            keys = np.concatenate([self.known, new])
            order = np.argsort(keys, kind="stable")
            self.known, self.valid = keys[order], np.concatenate([self.valid, fresh])[order]
        return out[at]

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, out = self.p, np.ones(len(a), bool)
        limit, live = np.full(len(a), _FAR), np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(p.pairs, x * self.n + y)
            at[at == len(p.pairs)] = 0
            crossed = (p.pairs[at] == x * self.n + y) & (p.made[at] < limit[live])
            out[live[crossed]] = False
            rx, ry = p.rank[x], p.rank[y]
            go = ~crossed & ((rx > 0) | (ry > 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            limit[live] = np.where(undo, rx, ry + 1)
            a[live], b[live] = np.where(undo, p.right[x], x), np.where(undo, y, p.left[y])
        return out

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of distinct units, end to end, and how many each has."""
        p = self.p
        data = np.frombuffer(b"".join(units), np.uint8)
        sizes = np.array([len(u) for u in units], np.int64)
        start = np.cumsum(sizes) - sizes
        begin = np.repeat(start, sizes)
        end = begin + np.repeat(sizes, sizes)
        order, words = self.suffixes(data, end)
        first, last = self.ranges(words)
        count = last - first
        # every occurrence is an edge: position, piece
        which = np.repeat(np.arange(len(self.piece)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        piece = self.piece[which]
        # characters without a piece: an edge for each byte
        lone = (data & 0xC0) != 0x80
        lone[at[self.single[piece]]] = False
        heads = np.flatnonzero(lone)
        bounds = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        tails = bounds[np.searchsorted(bounds, heads, "right")] if len(heads) else heads
        width = tails - heads
        raw = np.repeat(heads - (np.cumsum(width) - width), width) + np.arange(width.sum())
        at, piece = np.concatenate([at, raw]), np.concatenate([piece, p.byte_ids[data[raw]]])
        # sort by distance from the unit's begin, relax all units at once
        away = at - begin[at]
        by = np.argsort(away, kind="stable")
        at, piece, away = at[by], piece[by], away[by]
        reached = np.full(len(data) + 1, -1, np.int64)  # the last piece of the unit up to here, by end less one
        edges = np.searchsorted(away, np.arange(int(sizes.max(initial=0)) + 1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            a, x = at[lo:hi], piece[lo:hi]
            if away[lo]:
                prior = reached[a - 1]
                ok = prior >= 0
                a, x, prior = a[ok], x[ok], prior[ok]
                ok = self.compatible(prior, x)
                a, x = a[ok], x[ok]
            reached[a + self.length[x] - 1] = x
        # walk back from the ends
        back, here, live = [], start + sizes, np.arange(len(units))
        while len(live):
            x = reached[here[live] - 1]
            back.append((live, x))
            here[live] -= self.length[x]
            live = live[here[live] > start[live]]
        counts = np.zeros(len(units), np.int64)
        for who, _ in back:
            counts[who] += 1
        flat, put = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        for step, (who, x) in enumerate(back):
            flat[put[who] - 1 - step] = x
        return flat, counts


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted value in its own range."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        below = open_ & ((v <= wanted) if right else (v < wanted))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


class Codec:
    """Encodes and decodes batches; remembers the pieces of units it has seen, up to a bound."""

    def __init__(self, pieces: Pieces):
        self.p, self.match = pieces, Matcher(pieces)
        self._forget()
        size = self.match.length
        self.bytes = np.frombuffer(b"".join(pieces.texts), np.uint8)
        self.byte_at = np.cumsum(size) - size

    def _forget(self) -> None:
        self.names, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _units(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes with the model's leading space, and where units begin and end."""
        filled = np.flatnonzero(np.diff(t.offsets) > 0)
        lead = 1 if self.p.prefix else 0
        data = np.insert(t.data, t.offsets[filled], 0x20) if lead else t.data
        starts = t.offsets[filled] + lead * np.arange(len(filled))
        cut = np.zeros(len(data), bool)
        cut[starts] = True
        if self.p.breaks and len(data):
            space, line = data == 0x20, data == 0x0A
            cut[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begin = np.flatnonzero(cut)
        return data, begin, np.append(begin[1:], len(data))

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts end to end, and how many each text has."""
        data, begin, end = self._units(t)
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(len(t), np.int64)
        names = span_hashes(data, begin, end, seed=3)
        unique, first, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.names, unique)
        at[at == len(self.names)] = 0
        new = np.flatnonzero(self.names[at] != unique) if len(self.names) else np.arange(len(unique))
        if len(new):
            self._learn(unique[new], [data[begin[i] : end[i]].tobytes() for i in first[new]])
            at = np.searchsorted(self.names, unique)
        at = at[which]
        count = self.count[at]
        total = np.cumsum(count)
        flat = self.flat[np.repeat(self.at[at] - (total - count), count) + np.arange(total[-1])]
        # texts by where their bytes end
        ends = t.offsets[1:] + np.cumsum((np.diff(t.offsets) > 0) * (1 if self.p.prefix else 0))
        upto = np.concatenate([[0], total])[np.searchsorted(end, ends, "right")]
        return flat, np.diff(upto, prepend=0)

    def _learn(self, names: np.ndarray, units: list[bytes]) -> None:
        # runs of spaces are merged from the left at equal scores, which ranks cannot say: those few units are merged plainly
        odd = np.array([u.startswith(b"  ") or (not self.p.breaks and b"  " in u) for u in units])
        counts = np.zeros(len(units), np.int64)
        plain = np.flatnonzero(~odd)
        group = np.cumsum([len(units[i]) for i in plain]) // INDEXED  # so that an index and its edges stay small
        parts = [self.match.encode([units[i] for i in plain[group == g]]) for g in np.unique(group)]
        flat = np.concatenate([np.zeros(0, np.int64), *[f for f, _ in parts]])
        counts[plain] = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
        extra = []
        for i in np.flatnonzero(odd):
            got = [x if x >= 0 else int(self.p.byte_ids[-1 - x]) for x in merge(units[i], self.p.ids, self.p.score)[0]]
            counts[i] = len(got)
            extra += got
        order = np.concatenate([plain, np.flatnonzero(odd)])
        start = np.empty(len(units), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, flat, np.array(extra, np.int64)])
        names, at, count = np.concatenate([self.names, names]), np.concatenate([self.at, start + base]), np.concatenate([self.count, counts])
        by = np.argsort(names, kind="stable")
        self.names, self.at, self.count = names[by], at[by], count[by]

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes end to end, and how many each has; the model's leading space is taken off."""
        size = self.match.length[flat]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        data = np.empty(n, np.uint8)
        for lo in range(0, len(flat), DECODED):
            part, s, t = flat[lo : lo + DECODED], size[lo : lo + DECODED], total[lo : lo + DECODED]
            begin = t[0] - s[0]
            data[begin : t[-1]] = self.bytes[np.repeat(self.byte_at[part] - (t - s), s) + np.arange(begin, t[-1])]
        ends = np.concatenate([[0], total])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(counts) else ends
        sizes = ends - starts
        if self.p.prefix:
            drop = starts[sizes > 0]
            drop = drop[data[drop] == 0x20]
            sizes[np.searchsorted(starts, drop, "right") - 1] -= 1
            data = np.delete(data, drop)
        return data, sizes


_codec_of: dict[bytes, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a worker process: one, of the model that was used last."""
    if shared.digest not in _codec_of:
        _codec_of.clear()
        _codec_of[shared.digest] = Codec(shared.held.value)
    return _codec_of[shared.digest]


class _Shared:
    """A model on its way to the workers: its size is the vocabulary's, some megabytes at most."""

    def __init__(self, spark, pieces: Pieces):
        self.held = spark.sparkContext.broadcast(pieces)
        self.digest = hashlib.sha256(b"\0".join(pieces.texts) + pieces.score.tobytes() + bytes([pieces.prefix])).digest()


def _plain(texts: pa.Array) -> pa.Array:
    """The mark that stands for a space is read as one, as by the model."""
    return pc.replace_substring(texts.cast(pa.large_string()), _MARK, " ")


def encode(docs: DataFrame, text: str = "text", names=("ids", "n_ids", "round_trip"), carry: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """The columns of ``carry`` (all of ``docs`` if None), then the text's piece ids, their number, and whether
    decoding them gives the text back.

    A null or empty text has no ids. Texts are encoded whole, row by row, so repeated rows get equal ids and an
    empty table an empty one. The character U+2581 is read as a space. Columns of ``docs`` named like ``names`` are
    replaced. No shuffle; the model is broadcast, its size is the vocabulary's.
    """
    shared = _Shared(docs.sparkSession, load(model))
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {n.lower() for n in names}]
    docs = docs.select(*[f"`{c}`" for c in [*carry, *[text] * (text not in carry)]])
    at, held = docs.columns.index(text), len(carry)
    tail = [pa.field(names[0], pa.list_(pa.int32())), pa.field(names[1], pa.int32()), pa.field(names[2], pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the stage before has left
        codec = _codec(shared)
        for batch in batches:
            for part in chunks(batch.column(at), BATCH):
                rows = batch.slice(part.first, len(part))
                (t,) = chunks(_plain(rows.column(at)), _ALL)
                flat, counts = codec.encode(t)
                data, sizes = codec.decode(flat, counts)
                ends = np.cumsum(sizes)
                same = sizes == np.diff(t.offsets)
                if same.all():
                    bad = np.flatnonzero(data != t.data)
                    same[np.searchsorted(ends, bad, "right")] = False
                else:
                    same = np.array([data[e - s : e].tobytes() == t.data[a:b].tobytes() for e, s, a, b in zip(ends, sizes, t.offsets[:-1], t.offsets[1:], strict=True)])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:held], ids, pa.array(counts.astype(np.int32)), pa.array(same)], schema=pa.schema([*list(rows.schema)[:held], *tail]))
                give_back()

    extra = [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:held], *extra]))


def decode(rows: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of a column of piece ids under ``name``; null ids and an empty list give an empty text.

    Bytes that are not UTF-8 become U+FFFD. A column of ``rows`` named like ``name`` is replaced. No shuffle.
    """
    shared = _Shared(rows.sparkSession, load(model))
    rows = rows.drop(*[c for c in rows.columns if c.lower() == name.lower()])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)
                data, sizes = codec.decode(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64), counts)
                raw, ends = data.tobytes(), np.cumsum(sizes)
                texts = [raw[e - s : e].decode("utf-8", "replace") for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=pa.schema([*list(part.schema), pa.field(name, pa.string())]))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
