"""Exact dedup, shards, mixing, language model: against slow plain versions."""

import math
import os
import re
import shutil
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm import blocks as B
from rowforge.llm import exact_dedup as X
from rowforge.llm import hilbert_shards as H
from rowforge.llm import katz as K
from rowforge.llm.arrays import ranked
from rowforge.llm import mixing as M
from rowforge.llm.common import word_count
from rowforge.llm.queries import ORACLE, op5_hilbert_shards, op8_source_mix, op9_lsm_exact_dedup, op10_katz_scores
from tests.conftest import MEDIUM


@pytest.mark.parametrize("digest", ["sha256", "length"])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(spark, sf_dir, odd_docs, digest, keep):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    names = ("d", "keep_id", "n", "kept")
    rows = X.exact_groups(docs, keep=keep, digest=digest, names=names).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(rows) == docs.count()
    kept = Counter()
    for r in rows:
        ids = groups[r["text"] or ""]
        best = (max if keep == "max" else min)(i for i in ids if i is not None)
        assert (r["keep_id"], r["n"]) == (best, len(ids))
        if r["kept"]:
            kept[r["text"] or ""] += 1
            assert r["doc_id"] == best
    assert all(v == 1 for v in kept.values()) and len(kept) == len(groups)


@pytest.mark.parametrize("hot", [1, 2, 10_000])
@pytest.mark.parametrize("digest", ["sha256", "length"])
def test_rows_that_the_filter_lets_through_stay(spark, monkeypatch, hot, digest):
    """A full filter clears few rows: most come back without an entry, with no digest hot, with one, and with all."""
    monkeypatch.setattr(X, "FILTER_BITS", (64, 64))
    monkeypatch.setattr(X, "HOT", hot)
    texts = [(i, f"copy {i % 100}", i) for i in range(300)] + [(i, "hot", i) for i in range(300, 800)] + [(i, f"alone {i}", i) for i in range(800, 1000)]
    docs = spark.createDataFrame([*texts, (None, "alone too", 0)], "doc_id long, text string, _d long")
    ids = defaultdict(list)
    for i, t, _ in texts:
        ids[t].append(i)
    want = {(i, t, x, max(ids[t]), len(ids[t]), i == max(ids[t])) for i, t, x in texts} | {(None, "alone too", 0, None, 1, True)}
    out = X.exact_groups(docs, digest=digest)
    got = [tuple(r) for r in out.drop("digest").collect()]
    assert len(got) == len(want) and set(got) == want


def test_exact_groups_against_sql_on_more_rows(spark):
    """The table of ``test_oracle`` is too small for the copy filter to let a text through that has no copy."""
    sql = f"WITH documents AS (FROM '{MEDIUM}/documents.parquet') {ORACLE['op9_lsm_exact_dedup']}"
    got = [tuple(r) for r in op9_lsm_exact_dedup(spark, MEDIUM).collect()]
    assert sorted(got) == sorted(duckdb.sql(sql).fetchall())


def test_index_takes_several_batches(spark):
    index = X.DigestIndex(spark, keep="min")
    a = spark.createDataFrame([(5, "x"), (6, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "x"), (9, "z")], "doc_id long, text string")
    for batch in (a, b):
        index.insert(batch)
    index.compact()
    assert sorted((r["keep_id"], r["n"]) for r in index.entries().collect()) == [(3, 2), (6, 1), (9, 1)]
    assert {r["doc_id"]: r["kept"] for r in index.classify(a.unionByName(b)).collect()} == {5: False, 6: True, 3: True, 9: True}


def test_a_new_batch_is_looked_up_without_old_texts(spark, tmp_path):
    """Old texts are gone when the second batch comes; runs that broke off count for nothing, compaction loses nothing."""
    texts = [(i, f"text {i % 700}") for i in range(1000)] + [(None, None), (7, "text 7")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/old")
    index = X.DigestIndex(spark, f"{tmp_path}/index")
    index.insert(spark.read.parquet(f"{tmp_path}/old"))
    shutil.rmtree(f"{tmp_path}/old")
    new = spark.createDataFrame([(2000, "text 5"), (2001, "text 650"), (2002, "text 701"), (2003, ""), (2004, "text 701")], "doc_id long, text string")
    want = {2000: (705, True), 2001: (650, True), 2002: (None, False), 2003: (None, True), 2004: (None, False)}
    seen = lambda i: {r["doc_id"]: (r["keep_id"], r["seen"]) for r in i.lookup(new).collect()}
    assert seen(index) == want
    os.makedirs(f"{tmp_path}/index/000002-batch/runs")
    again = X.DigestIndex(spark, f"{tmp_path}/index")
    assert again.levels == index.levels and seen(again) == want
    again.insert(new.where("doc_id = 2002"))
    assert seen(again) == {**want, 2002: (2002, True), 2004: (2002, True)}
    again.compact()
    assert X.DigestIndex(spark, f"{tmp_path}/index").levels == again.levels and len(again.levels) == 1
    assert seen(again) == {**want, 2002: (2002, True), 2004: (2002, True)}
    assert X.DigestIndex(spark).lookup(new).where("seen").count() == 0


def test_drop_copies_keeps_columns(odd_docs, no_docs):
    out = X.drop_copies(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 8
    assert X.drop_copies(no_docs).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_walks_to_neighbours(spark, n, bits):
    cells = [F.floor(F.col("id") / (1 << (bits * i))) % (1 << bits) for i in range(n)]
    rows = spark.range(1 << (n * bits)).select(H.hilbert_index(cells, bits).alias("h"), F.array(*cells).alias("x")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p["x"], q["x"], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def test_shards(spark, sf_dir, odd_docs, no_docs):
    rows = op5_hilbert_shards(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())
        slots[r["shard"]].append((r["slot"], r["curve"]))
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    run = []
    for s in range(8):
        assert [x for x, _ in sorted(slots[s])] == list(range(len(slots[s])))
        run += [c for _, c in sorted(slots[s])]
    assert run == sorted(run)
    for docs, n in ((odd_docs, 11), (no_docs, 0)):
        out = H.curve_shards(docs, [H.quantise(F.col("doc_id"), 1, 9, 3), H.quantise_name(F.col("lang"), 3)], 3, [F.col("doc_id")], 8).collect()
        assert len(out) == n and len({(r["shard"], r["slot"]) for r in out}) == n


def test_shards_can_be_skipped(spark, sf_dir):
    """By their minima and maxima, a filter on any one dimension reads fewer shards than in the order of any other one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", (F.octet_length("text") + 1).alias("size"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = [H.quantise(F.col("doc_id"), low, high, 6), H.quantise_size(F.col("size"), 6), H.quantise_name(F.col("lang"), 6)]
    rows = H.curve_shards(docs, cells, 6, [F.col("doc_id")], 32).collect()
    ends = lambda key, of: {s: (min(r[key] for r in v), max(r[key] for r in v)) for s, v in of.items()}
    shards, by_id, by_size = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    for order, out in (("doc_id", by_id), ("size", by_size)):
        for i, r in enumerate(sorted(rows, key=lambda r: r[order])):
            out[32 * i // len(rows)].append(r)

    def read(key, of):
        """Shards that the mean point filter on ``key`` has to read."""
        return sum(a <= r[key] <= b for r in rows for a, b in ends(key, of).values()) / len(rows)

    for key in ("doc_id", "size"):
        other = by_size if key == "doc_id" else by_id
        assert read(key, shards) < 0.8 * read(key, other), key


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    """Nulls, empty and blank texts, repeated rows, clashing names, no rows: each stage ends, with the columns of documents."""
    import corpus_pipeline as P

    for docs in (odd_docs, no_docs, odd_docs.unionAll(odd_docs)):
        n = docs.count()
        for name, stage in P.STAGES:
            out = stage(spark, docs, "")
            want = [c for c in docs.columns if c != "text"] + ["ids", "n_ids", "round_trip"] if name == "piece_ids" else docs.columns
            assert out.columns == want and out.count() <= 3 * n, name
            if not n or name == "piece_ids":
                assert out.count() == n, name
    held = P.STAGES[1][1](spark, odd_docs.unionAll(odd_docs), "").select("text").collect()
    assert len(held) == len({r["text"] or "" for r in odd_docs.collect()})


def test_texts_of_several_megabytes(spark):
    """One text beyond every chunk and batch size among short ones; copies and near copies of it are found."""
    words = " ".join(f"w{i * 7919 % 200_003}" for i in range(600_000))  # 4 MB
    near = words.replace("w77 ", "other ")
    docs = spark.createDataFrame([(1, words, "a"), (2, words, "a"), (3, near, "b"), (4, "short text of a few words", "b"), (5, None, None)], "doc_id long, text string, source string")
    from rowforge.llm.near_dedup import near_classes
    from rowforge.llm.quality import quality
    from rowforge.llm.secrets import scan_secrets
    from rowforge.llm.sentencepiece_match import encode
    from rowforge.llm.token_rollup import TOKENIZERS, count_tokens

    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r["doc_id"]: r["n_words"] for r in quality(docs).collect()} == {1: 600_000, 2: 600_000, 3: 600_000, 4: 6, 5: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in K.katz_scores(docs, F.col("doc_id") == 2).collect()} == {1: 600_001, 2: 600_001, 3: 600_001, 4: 7, 5: 1}
    assert scan_secrets(docs).where("size(spans) > 0").count() == 0
    assert encode(docs).where("round_trip").count() == 5
    want = len(TOKENIZERS[0].load().encode_ordinary(words))
    assert {r["doc_id"]: r["tokens"][0] for r in count_tokens(docs, tokenizers=TOKENIZERS[:1]).collect()}[1] == want
    assert {r["doc_id"]: r["keep_id"] for r in X.exact_groups(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}


def test_targets():
    assert M.targets([("a", 10), ("b", 10)], [1, 1]) == [10, 10]
    assert M.targets([("a", 10), ("b", 90)], [9, 1]) == pytest.approx([30, 70])
    got = M.targets([("a", 1), ("b", 1), ("c", 98)], [1, 2, 3])
    assert got == pytest.approx([3, 3, 94])
    assert M.targets([("a", 0), (None, 5)], [1, 2]) == [0, 5]
    assert M.targets([], []) == []
    assert M.by_code_point(["b", None, "A", "é"]) == ["A", "b", "é", None]


def test_split_tree_is_exact():
    quotas = [1000, 37, 0, 5]
    out = M.split_tree(quotas, 8, 1)
    assert [sum(r) for r in out] == quotas
    columns = [sum(r[j] for r in out) for j in range(8)]
    assert max(columns) - min(columns) <= 1 and out == M.split_tree(quotas, 8, 1) != M.split_tree(quotas, 8, 2)
    mean = sum(M.split_tree([30, 30], 2, s)[0][0] for s in range(400)) / 400
    assert abs(mean - 15) < 0.6


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] and len(r["shards"]) == r["copies"]
    names = M.by_code_point(list(by))
    goal = M.targets([(n, sum(r["size"] for r in by[n])) for n in names], [1 + i % 3 for i in range(len(names))])
    for n, t in zip(names, goal, strict=True):
        assert by[n][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in by[n]) - t) <= max(r["size"] for r in by[n])
    return by


def test_mix(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    size = word_count(F.col("text"))
    check_mix(M.plan_mix(docs, "source", size, [F.col("doc_id")]).collect())
    big = docs.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"), "*").withColumn("source", F.expr("if(doc_id % 3 = 0, 'hot', source)"))
    by = check_mix(M.plan_mix(big, "source", size, [F.col("doc_id"), F.col("k")]).collect())
    for rows in by.values():  # larger sources come much nearer
        if len(rows) > 900:
            assert abs(sum(r["taken"] for r in rows) / rows[0]["target"] - 1) < 0.005
    once = {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in op8_source_mix(spark, sf_dir).collect()}
    assert once == {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in op8_source_mix(spark, sf_dir).collect()}
    odd = M.plan_mix(odd_docs, "source", size, [F.col("doc_id")])
    assert odd.count() == odd_docs.count()
    assert M.plan_mix(no_docs, "source", size, [F.col("doc_id")]).count() == 0
    mixed = M.mixed_documents(docs, "source", size, [F.col("doc_id")])
    plan = {r["doc_id"]: r["copies"] for r in M.plan_mix(docs, "source", size, [F.col("doc_id")]).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_mix_fills_the_room_past_a_long_document(spark):
    """Sources of 1,000 rows in which one document holds a third of the words still meet their targets."""
    rows = [(f"s{s:02}", i, 1 + (7 * i + s) % 9) for s in range(12) for i in range(999)]
    total = {s: sum(r[2] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    rows += [(s, 999, t // 2) for s, t in total.items()]
    docs = spark.createDataFrame(rows, "source string, doc_id long, words long")
    by = check_mix(M.plan_mix(docs, "source", F.col("words"), [F.col("source"), F.col("doc_id")]).collect())
    assert len(by) == 12
    for of in by.values():
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1
    # rows that agree in identifier and size are drawn one by one
    twice = docs.unionAll(docs)
    for of in check_mix(M.plan_mix(twice, "source", F.col("words"), [F.col("source"), F.col("doc_id")]).collect()).values():
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1


def test_mix_without_identifiers(spark, odd_docs, monkeypatch):
    """Null identifiers and repeated rows: what a source gives is as near to its target as with identifiers."""
    size = word_count(F.col("text"))
    check_mix(M.plan_mix(odd_docs, "source", size, [F.col("doc_id")]).collect())
    rows = [(f"s{s}", 1 + (7 * i + s) % 23) for s in range(3) for i in range(1000)] + [(None, 5)] * 500
    docs = spark.createDataFrame([(s, None, n) for s, n in rows], "source string, doc_id long, words long")
    for fan in (M.FAN, 4):  # the second: places are narrowed down in many levels
        monkeypatch.setattr(M, "FAN", fan)
        monkeypatch.setattr(M, "_FAN_BITS", fan.bit_length() - 1)
        for of in check_mix(M.plan_mix(docs, "source", F.col("words"), [F.col("doc_id")]).collect()).values():
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 5


def first_fit(rows, rest):
    """What a partial copy takes of (place, n): its blocks' order is that of the places."""
    out = []
    for h, n in sorted(rows):
        if 1 <= n <= rest:
            out.append(h)
            rest -= n
    return out


def test_blocks_of_the_mix_have_one_shard(spark, sf_dir):
    """Each copy of a block goes to one shard, shards get equal numbers of blocks, and the partial copy is drawn in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr("if(doc_id % 2 = 0, 'hot', source)").alias("source"), word_count(F.col("text")).alias("words"))
    docs = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("doc_id", F.col("doc_id") * 10 + F.col("k"))
    planned = M.plan_mix(docs, "source", F.col("words"), [F.col("doc_id")]).withColumn("h", M.place(8, [F.col("doc_id")], F.col("size")))
    by = check_mix(planned.collect())
    in_shard, units = Counter(), defaultdict(set)
    for name, rows in by.items():
        blocks, whole = M._blocks(len(rows)), min(r["copies"] for r in rows)
        block = lambda r: ((r["h"] >> 48) * blocks) >> 12  # noqa: E731, B023
        for r in rows:
            for epoch in range(whole):
                units[name, block(r), epoch].add(r["shards"][epoch])
        more = [r for r in rows if r["copies"] > whole]
        full = {b for b in range(blocks) if all(r["copies"] > whole for r in rows if block(r) == b)}
        stop = next(b for b in range(blocks + 1) if b not in full)
        for r in more:
            units[name, block(r) if block(r) < stop else blocks, whole].add(r["shards"][whole])
        rest = round(rows[0]["target"] - whole * rows[0]["source_size"])
        assert {r["h"] for r in more if r["size"]} == set(first_fit([(r["h"], r["size"]) for r in rows], rest))
    for at in units.values():
        in_shard[min(at)] += 1
    assert all(len(at) == 1 for at in units.values()) and max(in_shard.values()) - min(in_shard.values()) <= 1 and len(in_shard) == 8


def brute_katz(rows, order=K.ORDER, score=None):
    """Scores of ``score`` (else of ``rows``) by a model of the rows (identifier, text, held out), from the definition."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    stream = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"]
    grams = lambda s, n: [tuple(["<s>", *s][max(0, i + 2 - n) : i + 2]) if n > 1 else (s[i],) for i in range(len(s)) if i >= n - 2]
    train = [stream(t) for _, t, held in rows if not held]
    count = {n: Counter(g for s in train for g in grams(s, n)) for n in range(1, order + 1)}
    total = sum(count[1].values())
    stats = {n: [sum(c.values()), len(c), *[sum(v == r for v in c.values()) for r in range(1, 7)]] for n, c in count.items()}
    factor = {n: K.discounts(s[2:], s[0]) for n, s in stats.items()}
    taken = lambda n, c: factor[n][0][c - 1] * c if c <= 5 else c
    left = factor[1][1]
    all_, mass = (total, left) if left > 0 else (total + 1, 1)
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g, c in count[n].items():
            after[g[:-1]].append((g[-1], c))
    weight = {}

    def p(g):
        n = len(g)
        if n == 1:
            return taken(1, count[1][g]) / all_ if count[1][g] else mass / max(all_, 1)
        h = g[:-1]
        if h not in after:
            return p(g[1:])
        if h not in weight:
            seen = sum(c for _, c in after[h])
            got = sum(taken(n, c) for _, c in after[h])
            base = seen + K.RESERVE
            weight[h] = base, (1 - got / base) / (1 - sum(p((*h, w)[1:]) for w, _ in after[h]))
        base, alpha = weight[h]
        return taken(n, count[n][g]) / base if count[n][g] else alpha * p(g[1:])

    for h in [h for n in range(1, order) for h in [h for h in after if len(h) == n][:12]]:  # exactly normalised
        assert sum(p((*h, w)) for (w,) in count[1]) + p((*h, "\0unknown")) == pytest.approx(1)
    out = {}
    for i, t, held in rows if score is None else score:
        s = stream(t)
        base = sum(math.log10((count[1][w,] + 0.5) / (total + 0.5 * (len(count[1]) + 1))) for w in s)
        found = sum(math.log10(p(tuple(["<s>", *s][max(0, k + 2 - order) : k + 2]))) for k in range(len(s)))
        out[i] = (bool(held), len(s), sum(count[1][w,] > 0 for w in s), total, base, found)
    return out


def same_scores(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_katz(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    plain = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in docs.collect()]
    rows = op10_katz_scores(spark, sf_dir).collect()
    same_scores(rows, brute_katz(plain))
    held_out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)
    for order in (2, 4):
        same_scores(K.katz_scores(docs, held, order=order, block_bytes=1 << 15).collect(), brute_katz(plain, order))


def test_katz_model_scores_another_table(spark, sf_dir, monkeypatch):
    """A stored model, learnt in small blocks through relays, scores texts that it has not seen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(B, "FAN_BITS", 3)
    model = K.katz_model(docs.where("doc_id % 3 > 0"), block_bytes=1 << 16)
    other = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(-1, None), (-2, "zzz qqq ZZZ")], "doc_id long, text string"))
    plain = [(r["doc_id"], r["text"], False) for r in docs.where("doc_id % 3 > 0").collect()]
    want = brute_katz(plain, score=[(r["doc_id"], r["text"], False) for r in other.collect()])
    same_scores(model.score(other).collect(), want)
    words = sum(int((B.unpack(r["values"][1]) > 0).sum()) for r in model.counts[1].collect())
    assert words == model.numbers.types and model.score(docs.limit(0)).count() == 0


def test_katz_odd(odd_docs, no_docs, spark):
    rows = K.katz_scores(odd_docs, F.col("doc_id") == 3).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert K.katz_scores(no_docs, F.lit(False)).count() == 0
    nothing = K.katz_scores(odd_docs, F.lit(True)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in nothing)
    texts = ["A a a b", "b a c", "q b a", None, *["x y z w"] * 7, "x y z v y z"]
    for order in (2, 3):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        same_scores(K.katz_scores(frame, F.col("doc_id") == 2, order=order).collect(), brute_katz([(i, t, i == 2) for i, t in enumerate(texts)], order))


def one_block(texts, held):
    """A block of ``texts``, and what ranges tell it of its n-grams when no other block is there."""
    words = [t.split() for t in texts]
    hashed = np.array([zlib.crc32(w.encode()) << 30 for t in words for w in t], np.uint64)
    vocab, tokens = np.unique(hashed, return_inverse=True)
    row = {"home": 0, "block": 0, "ids": list(range(len(texts))), "marks": B.pack(np.array(held)), "sizes": B.pack(np.array([len(t) for t in words]))}
    block, told = B.Block(row | {"vocab": B.pack_sorted(vocab), "tokens": B.pack(tokens)}), []
    for n in (1, 2, 3):
        m = B.Merged(K._counts_asked(n, 0)(block))
        told.append({"part": 0, "kind": K.count_kind(n), "values": m.share(K._count_alone(0, m.keys, m.sums)[0])[0]})
    return block, told


def test_katz_works_on_histories_that_held_out_texts_have(monkeypatch):
    """What seen words take of a history is added up only where a weight is needed; histories that other texts have cost nothing."""
    texts, took = [" ".join(f"w{(i * k) % 97}" for i in range(200)) for k in range(1, 20)], []
    numbers = K.Numbers({n: [4000, 900, 300, 200, 100, 80, 70, 60] for n in (1, 2, 3)}, len(texts), 3)
    plain = K.Numbers.taken
    monkeypatch.setattr(K.Numbers, "taken", lambda self, n, counts: (took.append((n, len(counts))), plain(self, n, counts))[1])

    def work(texts, held):
        took.clear()
        known = K.Known(*one_block(texts, held), numbers, 3, False)
        return sum(k for n, k in took if n > 1), known

    assert work(texts, [False] * len(texts))[0] == 0
    few, known = work([*texts, "w1 w2"], [False] * len(texts) + [True])
    every = sum(len(known.e.grams(n).keys) for n in (2, 3))
    assert 0 < few < every / 10


def test_ranked():
    """The stable order of keys, also where they differ in bits that places push out."""
    rng = np.random.default_rng(5)
    top = np.uint64((1 << 64) - 1)
    some = [np.zeros(0, np.uint64), np.array([7], np.uint64), np.full(9, top), np.array([3, 1, 3, 1, 2], np.uint64), np.array([top, 0, top, 0], np.uint64)]
    some += [rng.integers(0, 1 << 62, 5000).astype(np.uint64)[rng.integers(0, 5000, 9000)] << np.uint64(2)]
    some += [np.concatenate([np.arange(1000, 0, -1, np.uint64), [top]]), np.repeat(np.arange(500, 0, -1, np.uint64), 3) | np.uint64(1 << 63)]
    some += [np.append(rng.integers(0, 8, 3000).astype(np.uint64), top)]
    for keys in some:
        order, found = ranked(keys)
        want = np.argsort(keys, kind="stable")
        assert order.tolist() == want.tolist() and found.tolist() == keys[want].tolist()


def test_merged_requests_have_one_owner_for_each_key():
    """The first sender with a count answers for a key; a key that nobody counted has no owner."""
    ask = lambda keys, counts: B.requests(0, 0, np.array(keys, np.uint64), [np.array(counts, np.uint64)], 0)[0]
    m = B.Merged([ask([1, 2, 5], [0, 0, 3]), ask([1, 3, 5], [4, 0, 1]), ask([1, 2, 9], [2, 0, 1])])
    assert m.keys.tolist() == [1, 2, 3, 5, 9] and m.sums[0].tolist() == [6, 0, 0, 4, 1]
    owners, sums = zip(*[[B.unpack(x).tolist() for x in v] for v in m.share([np.ones(5, bool), m.sums[0]])], strict=True)
    assert list(owners) == [[False, False, True], [True, False, False], [False, False, True]] and list(sums) == [[6, 0, 4], [6, 0, 4], [6, 0, 1]]
