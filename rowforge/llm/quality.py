"""Quality rules: how much of a text stands in repeated n-grams and repeated lines.

All in numpy over Arrow batches: words are hashed from the text's bytes, rolling hashes give the n-grams of each
length, and characters inside an n-gram that occurs twice or more are counted once, however many n-grams cover
them. A repeated run of n words holds repeated runs of n-1, so each length looks only where the one before left
a repeat.

The base rule takes texts with a fifth of their words in repeated windows. The method's limits are stricter for n-grams
that occur ``OFTEN`` times or more: one line or passage that a text says again is no fault, a refrain is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import Texts, chunks, code_points, mix64, per_doc, repeated, runs, span_hashes, words
from .common import fresh

#: Times that an n-gram occurs to count for the limits.
OFTEN = 3
#: Share of the words' characters inside such n-grams, by n, above which a text is rejected.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Share of the words' characters in lines that repeat an earlier one.
LINE_LIMIT = 0.25
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_ngram_share", "often_ngram_share")
_TYPES = ("long", "long", "long", "long", "long", "boolean", "boolean", "double", "double", "double")
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def measure(t: Texts, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The columns of ``COLUMNS`` for each text."""
    n = len(t)
    w = words(t)
    at = code_points(t.data)
    chars = at[w.end] - at[w.start]
    hashed = span_hashes(t.data, w.start, w.end)
    n_words = np.bincount(w.doc, minlength=n).astype(np.int64)
    word_chars = per_doc(chars, w.doc, n)
    marks = np.flatnonzero(_SYMBOL[t.data])
    n_symbols = np.bincount(np.searchsorted(t.offsets, marks, "right") - 1, minlength=n).astype(np.int64)

    # lines: from a text's begin or after \n, up to \n or its end; those with a word count
    breaks = np.flatnonzero(t.data == 10)
    begin = np.concatenate([t.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, t.offsets[1:]])
    begin.sort()
    end.sort()
    inner = np.searchsorted(w.start, end) - np.searchsorted(w.start, begin)
    begin, end = begin[inner > 0], end[inner > 0]
    doc = np.searchsorted(t.offsets, begin, "right") - 1
    line = span_hashes(t.data, begin, end, seed=7) if len(begin) else np.zeros(0, np.uint64)
    line = mix64(line ^ mix64(doc + 1))
    _, earliest, which = np.unique(line, return_index=True, return_inverse=True)
    again = earliest[which] < np.arange(len(line))
    n_dup_lines = per_doc(again.astype(np.int64), doc, n)
    starts, stops = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = per_doc(np.where(again, total[stops] - total[starts], 0), doc, n)
    line_share = line_chars / np.maximum(word_chars, 1)

    n_repeat = np.zeros(n, np.int64)
    worst, often = np.zeros(n), np.zeros(n)
    bad = line_share > line_limit
    alive = None
    salt = w.doc.astype(np.uint64)

    def covered(hit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words inside the runs that begin at ``hit``, and their share of each text's characters."""
        cover = np.zeros(len(hashed) + 1, np.int64)
        cover[: len(hit)] += hit
        cover[size : size + len(hit)] -= hit
        inside = np.cumsum(cover[:-1]) > 0
        return inside, per_doc(np.where(inside, chars, 0), w.doc, n) / np.maximum(word_chars, 1)

    for size in sorted(limits):
        m = len(hashed) - size + 1
        if m <= 0:
            break
        hit, thrice = np.zeros(m, bool), np.zeros(m, bool)
        where = np.flatnonzero(w.doc[:m] == w.doc[size - 1 :]) if alive is None else np.flatnonzero(alive[:m])
        if alive is not None:
            where = where[w.doc[where] == w.doc[where + size - 1]]
        keys = runs(hashed, where, size) ^ ((salt[where] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        hit[where[repeated(keys)]] = True
        thrice[where[repeated(keys, OFTEN)]] = True
        inside, share = covered(hit, size)
        if size == min(limits):
            n_repeat = per_doc(inside.astype(np.int64), w.doc, n)
        worst = np.maximum(worst, share)
        if thrice.any():
            share = covered(thrice, size)[1]
            often = np.maximum(often, share)
            bad |= share > limits[size]
        # a longer run repeats only if it begins and ends with repeats of this length
        alive = np.zeros(m, bool)
        alive[: m - 1] = hit[:-1] & hit[1:]
        if not alive.any():
            break
    base = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    return dict(
        zip(COLUMNS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base, ~(base | bad), line_share, worst, often), strict=True)
    )


def quality(
    docs: DataFrame, text: str = "text", names=COLUMNS, limits=None, line_limit: float = LINE_LIMIT, carry: list[str] | None = None
) -> DataFrame:
    """The columns of ``carry`` (all of ``docs`` if None), then the columns of ``COLUMNS`` under ``names``.

    A null or empty text has no words, fails the base rule (fewer than 10 words) and is not kept. Rows are judged
    one by one, so ties and repeated rows get equal results and an empty table an empty one. Columns of ``docs``
    named like one of ``names`` are replaced. No shuffle.
    """
    limits = dict(limits or NGRAM_LIMITS)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {x.lower() for x in names}]
    docs = docs.select(*[f"`{c}`" for c in [*carry, *[text] * (text not in carry)]])
    at, held = docs.columns.index(text), len(carry)
    tail = [pa.field(x, _ARROW[k]) for x, k in zip(names, _TYPES, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch.column(at)):
                found = measure(t, limits, line_limit)
                rows = batch.slice(t.first, len(t))
                values = [pa.array(found[c], type=f.type) for c, f in zip(COLUMNS, tail, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:held], *values], schema=pa.schema([*list(rows.schema)[:held], *tail]))

    kinds = ", ".join(f"`{x}` {k}" for x, k in zip(names, _TYPES, strict=True))
    schema = T.StructType([*docs.schema.fields[:held], *T.StructType.fromDDL(kinds).fields])
    return docs.mapInArrow(run, schema)


def drop_poor(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    names = fresh(docs, *COLUMNS)
    return quality(docs, text, names, **options).where(f"`{names[6]}`").select(*[f"`{c}`" for c in docs.columns])
