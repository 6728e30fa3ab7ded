"""Secrets in texts: certain patterns, and weak candidates that count only together.

Certain spans (``assign``, ``access``, ``hex``) are found by pattern and length alone. Weak candidates are the
parts a credential is made of: identifiers, secrets and endpoints. An interval join with the scopes (paragraphs of the
text) links parts of different roles in the same scope, or, where a window is given, within it. A weak candidate is
reported only if what it needs is linked to it:

* a weak secret needs an identifier or an endpoint (certain ``access`` spans are identifiers),
* a weak identifier needs a secret, certain or weak,
* an endpoint needs a secret and an identifier,
* a bare secret, forty characters of base64 with no word that says so, needs a certain ``access`` span.

The join sorts the parts' starts and finds each part's scope by binary search, so it is linear in the parts; a
part that needs a role asks whether its scope holds any interval of it, and no pairs are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint", "bare_secret")
BASE = KINDS[:3]
#: Code points around a part in which complementary parts are linked to it; None: the whole scope.
WINDOW = None

# The certain patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_WEAK = {
    "weak_secret": re.compile(
        r"""(?<![A-Za-z0-9])(?:pwd|passphrase|pass|private_?key|access_?key|auth|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}"""
        r"|(?<=://)[^\s/:@]+:[^\s/@]{3,}(?=@)",
        re.IGNORECASE | re.ASCII,
    ),
    "identifier": re.compile(
        r"""(?<![A-Za-z0-9])(?:user_?name|user|login|account|client_?id|key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
        re.IGNORECASE | re.ASCII,
    ),
    "endpoint": re.compile(
        r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}|(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""",
        re.IGNORECASE | re.ASCII,
    ),
}
_WEAK_WORDS = ("pwd", "pass", "privatekey", "private_key", "accesskey", "access_key", "auth", "credential", "://")
# with an upper and a lower letter and a digit
_BARE = re.compile(r"(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def certain(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the certain kinds: leftmost, not overlapping within a kind, long enough."""
    low = text.lower()
    found = []
    if any(x in low for x in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def linked(text: str, known: list[tuple[int, int, str]], window: int | None = WINDOW) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts are in the same scope (and window, where one is given)."""
    low = text.lower()
    if not known and not any(x in low for x in _WEAK_WORDS):
        return []
    secrets = _apart(_WEAK["weak_secret"].finditer(text), known)
    if not secrets and not known:
        return []
    edges = np.array([0, *[m.end() for m in _BLANK.finditer(text)], len(text) + 1])
    access, bare = [x[:2] for x in known if x[2] == "access"], []
    if access:
        held = known + [(*x, "") for x in secrets]
        bare = _apart(_BARE.finditer(text), held)
        bare = [x for x, yes in zip(bare, _join(bare, access, edges, window), strict=True) if yes]
    parts = {"weak_secret": secrets}
    for kind in ("identifier", "endpoint"):
        parts[kind] = _apart(_WEAK[kind].finditer(text), known)
    if not any(parts.values()) and not bare:
        return []
    role = {
        "secret": secrets + bare + [x[:2] for x in known if x[2] != "access"],
        "identifier": parts["identifier"] + access,
        "endpoint": parts["endpoint"],
    }
    near = {}
    for kind, spans in parts.items():
        near[kind] = {r: _join(spans, role[r], edges, window) for r in role}
    out = [(*x, "bare_secret") for x in bare]
    for kind, spans in parts.items():
        n = near[kind]
        ok = {
            "weak_secret": n["identifier"] | n["endpoint"],
            "identifier": n["secret"],
            "endpoint": n["secret"] & n["identifier"],
        }[kind]
        out += [(*span, kind) for span, yes in zip(spans, ok, strict=True) if yes]
    return out


def _apart(matches, known) -> list[tuple[int, int]]:
    """Spans of matches that touch no known span."""
    spans = [m.span() for m in matches]
    if not known or not spans:
        return spans
    starts = np.sort([k[0] for k in known])
    ends = np.sort([k[1] for k in known])
    return [s for s in spans if np.searchsorted(starts, s[1]) == np.searchsorted(ends, s[0], "right")]


def _join(left: list[tuple[int, int]], right: list[tuple[int, int]], edges: np.ndarray, window: int | None) -> np.ndarray:
    """Whether the scope of each left interval, or what is within the window of it there, meets a right interval.

    Starts below the scope's end less ends at or before its begin: how many intervals meet it.
    """
    if not left or not right:
        return np.zeros(len(left), bool)
    a = np.array(left)
    scope = np.searchsorted(edges, a[:, 0], "right") - 1
    lo, hi = edges[scope], edges[scope + 1]
    if window is not None:
        lo, hi = np.maximum(a[:, 0] - window, lo), np.minimum(a[:, 1] + window, hi)
    b = np.array(right)
    return np.searchsorted(np.sort(b[:, 0]), hi) > np.searchsorted(np.sort(b[:, 1]), lo, "right")


def find(text: str | None, window: int | None = WINDOW) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    known = certain(text)
    return sorted(known + linked(text, known, window), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(docs: DataFrame, text: str = "text", name: str = "spans", carry: list[str] | None = None, window: int | None = WINDOW) -> DataFrame:
    """The columns of ``carry`` (all of ``docs`` if None), then ``name``: the text's spans, in code points, end exclusive.

    A null or empty text has none. Rows are scanned one by one and whole, so repeated rows get equal spans and an
    empty table an empty one. A column of ``docs`` named like ``name`` is replaced. No shuffle.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != name.lower()]
    docs = docs.select(*[f"`{c}`" for c in [*carry, *[text] * (text not in carry)]])
    at, held = docs.columns.index(text), len(carry)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t, window)] for t in rows.column(at).to_pylist()]
                schema = pa.schema([*list(rows.schema)[:held], pa.field(name, kind)])
                yield pa.RecordBatch.from_arrays([*rows.columns[:held], pa.array(found, type=kind)], schema=schema)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:held], T.StructField(name, SPANS)]))
