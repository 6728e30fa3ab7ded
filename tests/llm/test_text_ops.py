"""Near duplicates, token rollups, piece ids, pipeline: against slow plain versions and the libraries."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowforge.llm import blocks as B
from rowforge.llm import near_dedup as N
from rowforge.llm import sentencepiece_match as S
from rowforge.llm import token_rollup as R
from rowforge.llm.arrays import chunks, give_back
from rowforge.llm.common import scratch
from rowforge.llm.queries import QUERIES, op6_token_rollup, op7_piece_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HERE = os.path.dirname(os.path.abspath(__file__))


def plain_classes(texts: dict):
    """Brute force: classes of the graph of all pairs with weighted Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(k for s in sets.values() for k in s)
    n = len(sets)
    weight = {i: {k: float(N.weights(np.array([c]), np.array([df[k]]), n)[0]) for k, c in s.items()} for i, s in sets.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for k in s:
            holders[k].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}:
        wa, wb = weight[a], weight[b]
        both = sum(min(v, wb[k]) for k, v in wa.items() if k in wb)
        if both / (sum(wa.values()) + sum(wb.values()) - both) >= 0.8:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


def test_near_classes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = plain_classes({r["doc_id"]: r["text"] for r in docs.collect()})
    got = N.near_classes(docs, block_bytes=1 << 16).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    size = Counter(want.values())
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def family(base, n, edits, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(len(w), edits, replace=False):
            w[at] = f"e{rng.integers(1 << 40)}"
        out.append(" ".join(w))
    return out


def test_near_classes_of_large_groups(spark, monkeypatch):
    """Many near copies, chains of copies, families that share half of their text, short and empty texts."""
    rng = np.random.default_rng(1)
    half = [f"s{i}" for i in range(100)]
    texts = family([f"a{i}" for i in range(300)], 60, 3, 2)
    texts += family(half + [f"b{i}" for i in range(150)], 15, 2, 3) + family(half + [f"c{i}" for i in range(150)], 15, 2, 4)
    chain = [f"d{i}" for i in range(200)]
    for step in range(12):  # each link is near to the next, the ends are far apart
        chain = chain[6:] + [f"d{200 + step * 6 + i}" for i in range(6)]
        texts.append(" ".join(chain))
    texts += ["one two three", "one two three", "one two", "", None, " "] + [" ".join(f"u{rng.integers(1 << 30)}" for _ in range(50)) for _ in range(20)]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), texts[j]) for i, j in enumerate(order)], "doc_id long, text string")
    want = plain_classes({int(i): texts[j] for i, j in enumerate(order)})
    got = {r["doc_id"]: r["class_id"] for r in N.near_classes(docs).collect()}
    assert got == want
    # every bucket by rounds of pivots, none at once
    monkeypatch.setattr(N, "IN_A_TASK", -1)
    assert {r["doc_id"]: r["class_id"] for r in N.near_classes(docs, bands=8, rows=2).collect()} == want
    monkeypatch.undo()
    # few bands of one sample: buckets with members that are far apart, several pivots each
    many = {r["doc_id"]: r["class_id"] for r in N.near_classes(docs, bands=40, rows=1).collect()}
    assert many == want


def test_near_odd(odd_docs, no_docs):
    assert N.near_classes(no_docs).count() == 0
    rows = N.near_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r["class_size"] == 3 and r["class_id"] == 4 for r in rows) == 3
    out = N.drop_near_copies(odd_docs)
    assert out.columns == odd_docs.columns


def test_sampling_agrees_with_similarity():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice(1 << 50, 400, replace=False).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 3, 300).astype(np.float32), rng.uniform(0.5, 3, 300).astype(np.float32)
    a, b = keys[:300], keys[100:]
    wb[:150] = wa[100:250]
    want = N.similarity_of(a, wa, b, wb)
    s = N.Sampler(4000)
    x, y = (s.signatures(k, w, np.array([0])) for k, w in ((a, wa), (b, wb)))
    assert abs((x == y).mean() - want) < 0.03


def test_sampling_of_more_shingles_than_draws():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 63, 150_000).astype(np.uint64))
    a, b = keys[:120_000], keys[20_000:140_000]
    s = N.Sampler(600)
    x, y = (s.signatures(k, np.ones(len(k), np.float32), np.array([0])) for k in (a, b))
    assert abs((x == y).mean() - 100_000 / 140_000) < 0.06  # three standard deviations of 600 samples


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([90])), (bytes([100]), bytes([95])), (bytes([7]), bytes([7]))]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert {bytes(k)[0]: bytes(v)[0] for k, v in got.items()} == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_packing():
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.uint64), np.array([0, 1, 255, 256, (1 << 64) - 1], np.uint64), rng.integers(0, 1 << 40, 1000).astype(np.uint64)):
        assert (B.unpack(B.pack(v)) == v).all() and len(B.unpack(B.pack(v))) == len(v)
        assert (B.unpack_sorted(B.pack_sorted(np.sort(v))) == np.sort(v)).all()
    bits = rng.random(13) < 0.5
    assert (B.unpack(B.pack(bits)) == bits).all()
    x = rng.random(7)
    assert (B.unpack(B.pack(x)) == x).all()


def _ask(bits):
    def run(b):
        keys, at = np.unique(b.vocab[b.tokens], return_inverse=True) if len(b.tokens) else (np.zeros(0, np.uint64), np.zeros(0, int))
        return B.requests(b.home, b.number, keys, [np.bincount(at, minlength=len(keys)).astype(np.uint64)], bits, empty=True)

    return run


def _told(b, answers):
    total, owner = B.gathered(answers)
    keys = np.unique(b.vocab[b.tokens]) if len(b.tokens) else np.zeros(0, np.uint64)
    return pa.table({"key": keys.view(np.int64), "total": total.astype(np.int64), "owner": owner})


def test_sums_over_keys_by_relays(spark, sf_dir, monkeypatch):
    """Every block learns the sum of each of its keys, and one block of each key that it answers for it, by any number of levels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text", "false AS mark").unionByName(spark.createDataFrame([(-1, None, None)], "id long, text string, mark boolean")).repartition(4)
    want = Counter(w for r in docs.collect() for w in WORD.findall(r["text"] or ""))
    leaf = lambda part, keys, sums: ([sums[0], np.ones(len(keys), bool)], [B.pack(sums[0])])
    for fan_bits, parts in ((8, 32), (2, 64), (1, 8)):
        monkeypatch.setattr(B, "FAN_BITS", fan_bits)
        with scratch():
            packed = B.pack_blocks(docs, block_bytes=1 << 13)
            asked = B.each_block(packed, _ask(B.levels(parts)[0]))
            told = B.exchange(asked, parts, packed.count(), leaf)
            rows = B.with_answers(packed, told, _told, "key long, total long, owner boolean").collect()
            left = [int(B.unpack(r["values"][0]).sum()) for r in told.where("block = -1").collect()]
        assert sum(left) == sum(want.values())
        assert len({r["key"] for r in rows}) == len(want) and sum(r["owner"] for r in rows) == len(want)
        assert sorted({r["key"]: r["total"] for r in rows}.values()) == sorted(want.values())


def test_request_rows_grow_with_the_input(spark, monkeypatch):
    """Rows of requests for a block stay the same when blocks and ranges grow together."""
    monkeypatch.setattr(B, "FAN_BITS", 2)
    each = []
    for n in (16, 64, 256):
        docs = spark.range(n, numPartitions=4).selectExpr("id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('w', id * 100 + i))) AS text", "false AS mark")
        with scratch():
            packed = B.pack_blocks(docs, block_bytes=1)
            assert packed.count() == n
            parts = B.power_of_two(n, 4)
            rows, asked, real = [], B.each_block(packed, _ask(B.levels(parts)[0])), B.bucketed
            rows.append(asked.count())
            monkeypatch.setattr(B, "bucketed", lambda df, name, by: (out := real(df, name, by), rows.append(out.count()))[0])
            B.exchange(asked, parts, n, lambda part, keys, sums: ([sums[0]], None)).count()
            monkeypatch.setattr(B, "bucketed", real)
        each.append(max(rows) / n)
    assert max(each) <= 4 and each[2] <= each[0] * 1.01


ODD_TEXTS = [
    "", None, "a", " ", "  ", "   x  y", "\n\n a\n", "▁x ▁▁", "\U0001f600 \x00a\x01", "ünï ñ 日本語 梦梦", "word" * 300, "a    b\t c", "        \n   \n",
    "it's we'll 12 3.5% a  b　 c  \n x\u0085 y", "\r\n\r\n  \t x", "é " * 20,
]


def test_pieces_equal_the_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    codec = S.Codec(S.load())
    i = 0
    for t in chunks(S._plain(pa.array(texts, pa.string())), 1 << 18):
        flat, counts = codec.encode(t)
        for ids in np.split(flat, np.cumsum(counts)[:-1]):
            assert ids.tolist() == library.encode(texts[i] or ""), texts[i]
            i += 1
    assert i == len(texts)


def test_encode_and_decode(spark, sf_dir, odd_docs, no_docs):
    docs = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string")
    back = S.decode(S.encode(docs).withColumnRenamed("text", "was"))
    for r in back.collect():
        assert r["text"] == (r["was"] or "").replace("▁", " ") and r["round_trip"] and r["n_ids"] == len(r["ids"])
    assert op7_piece_ids(spark, sf_dir).where("round_trip").count() == 200
    assert S.encode(no_docs).count() == 0 and S.encode(odd_docs, names=("key", "n", "ok")).count() == odd_docs.count()


def test_memory_follows_the_chunk_of_a_batch(spark, monkeypatch):
    """A batch is not copied whole, and what takes eight bytes or more for each byte of text is made piece by piece."""
    import tracemalloc

    held = {}
    docs = spark.createDataFrame([("",)], "text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: held.update(run=run))
    S.encode(docs)
    monkeypatch.undo()
    text = "something wonderful happened yesterday ▁ and nobody noticed before the evening " * 100
    batch, pool = pa.RecordBatch.from_pydict({"text": [text] * 1600}), pa.default_memory_pool()
    base, most, rows = pool.bytes_allocated(), 0, 0
    for out in held["run"](iter([batch])):
        rows, most = rows + out.num_rows, max(most, pool.bytes_allocated() - base)
        assert all(out.column(2).to_pylist())
    assert batch.nbytes > 12 << 20 and rows == 1600 and most < 8 << 20

    codec = S.Codec(S.load())
    (t,) = chunks(S._plain(pa.array([text] * 500)), 1 << 30)
    flat, counts = codec.encode(t)
    tracemalloc.start()
    data, _ = codec.decode(flat, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.tobytes() == t.data.tobytes() and peak < 16 * len(data)


def test_freed_memory_goes_back():
    def mine() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) << 10

    arrays = [np.ones(8 << 10) for _ in range(1600)]  # 100 MB, small enough for the heap
    last = arrays.pop()
    arrays.clear()
    give_back()
    base = mine()
    arrays = [np.ones(8 << 10) for _ in range(1600)]
    last = arrays.pop()
    assert mine() > base + (80 << 20)
    arrays.clear()
    give_back()
    assert mine() < base + (20 << 20) and last[0] == 1


def test_one_codec_for_a_worker():
    class Held:
        def __init__(self, pieces):
            self.held, self.value = self, pieces
            self.digest = bytes([pieces.prefix])

    import dataclasses

    pieces = S.load()
    first = S._codec(Held(pieces))
    assert S._codec(Held(pieces)) is first
    other = S._codec(Held(dataclasses.replace(pieces, prefix=not pieces.prefix)))
    assert other is not first and len(S._codec_of) == 1


def test_token_counts_equal_the_library(spark, sf_dir):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = R.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for k, tokenizer in enumerate(R.TOKENIZERS):
        library = tokenizer.load()
        for r in rows:
            assert r["tokens"][k] == len(library.encode_ordinary(r["text"] or "")), r["text"]


def test_rollup_deltas(spark, odd_docs):
    one = R.TOKENIZERS[:1]
    n = lambda t: len(one[0].load().encode_ordinary(t))
    schema = "op string, doc_id long, source string, lang string, text string"
    store = R.TokenRollup(spark, tokenizers=one)
    first = spark.createDataFrame([("insert", 1, "a", "en", "one two"), ("insert", 2, "a", "en", "three"), ("insert", 3, None, "de", "vier fünf")], schema)
    assert store.commit("1", first) and not store.commit("1", first)
    totals = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
    assert totals() == {("a", "en"): (2, n("one two") + n("three")), (None, "de"): (1, n("vier fünf"))}
    second = spark.createDataFrame([("delete", 2, None, None, None), ("revise", 3, "b", "de", "sechs"), ("delete", 99, None, None, None), ("insert", None, "a", "en", None)], schema)
    assert store.commit("2", second) and not store.commit("2", first)
    assert totals() == {("a", "en"): (2, n("one two")), ("b", "de"): (1, n("sechs"))}
    # a batch that broke off before its marker is written anew
    again = R.TokenRollup(spark, store.root, one)
    os.remove(f"{store.root}/sums/batch=2/_SUCCESS")
    assert again.totals().count() == 2 and again.commit("2", second)
    assert totals() == {("a", "en"): (2, n("one two")), ("b", "de"): (1, n("sechs"))}
    # folded sums stand for their batches, and later batches are added to them
    again.compact()
    again.compact()
    assert totals() == {("a", "en"): (2, n("one two")), ("b", "de"): (1, n("sechs"))} and len(os.listdir(f"{store.root}/folded")) == 1
    assert again.commit("3", spark.createDataFrame([("delete", 1, None, None, None), ("revise", 3, "b", "de", "sieben acht")], schema))
    assert totals() == {("a", "en"): (1, 0), ("b", "de"): (1, n("sieben acht"))} and not again.commit("2", second)
    fresh = R.TokenRollup(spark, tokenizers=one)
    assert fresh.totals().count() == 0
    fresh.commit("odd", odd_docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", "text"))
    assert fresh.totals().agg(F.sum("docs")).first()[0] == odd_docs.count()


def test_rollup_query(spark, sf_dir):
    rows = op6_token_rollup(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for tokenizer in R.TOKENIZERS:
        library, want = tokenizer.load(), defaultdict(lambda: [0, 0])
        for d in docs:
            want[d["source"], d["lang"]][0] += 1
            want[d["source"], d["lang"]][1] += len(library.encode_ordinary(d["text"]))
        assert {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in rows if r["tokenizer"] == tokenizer.name} == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    from rowforge.llm.quality import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, texts = [docs], {r["doc_id"]: r["text"] for r in docs.collect()}
    for _, stage in P.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[1]) == {r["doc_id"] for r in quality(docs).where("kept").collect()}
    by_text = defaultdict(list)
    for i in ids[1]:
        by_text[texts[i]].append(i)
    assert set(ids[2]) == {max(v) for v in by_text.values()}
    classes = plain_classes({i: texts[i] for i in ids[2]})
    assert set(ids[3]) == set(classes.values())
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    last = QUERIES["pipeline"](spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in last) == ids[4]
    assert all(r["round_trip"] for r in last)
