"""The queries of this package, by name, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, word_count
from .exact_dedup import exact_groups
from .hilbert_shards import curve_shards, quantise, quantise_name, quantise_size
from .katz import katz_scores
from .mixing import plan_mix
from .near_dedup import near_classes
from .quality import COLUMNS, quality
from .secrets import BASE, scan_secrets
from .sentencepiece_match import encode
from .token_rollup import TokenRollup
from .url_filter import filter_urls

#: Verdict and rule, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: certain spans and linked weak candidates."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, carry=["doc_id"])
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document: five-word shingles, similarity 0.8."""
    return near_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of each document, and whether it is kept."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, carry=["doc_id"]).select("doc_id", *COLUMNS)


def op4_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL, by the rules or else by the models of what they allow and block."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards along a Hilbert curve over identifier, size, source and language."""
    docs = _read(spark, sf_dir, "documents")
    text, bits = F.coalesce("text", F.lit("")), 6
    with scratch():
        # the texts are read once; the range exchange looks twice at what is written here
        rows = docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
        rows = materialise(rows, "curve-rows")
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        cells = [quantise(F.col("doc_id"), low, high, bits), quantise_size(F.col("size"), bits), quantise_name(F.col("source"), bits), quantise_name(F.col("lang"), bits)]
        out = curve_shards(rows, cells, bits, [F.col("text_crc32"), F.col("doc_id")], 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer, after three batches over all documents.

    The first inserts all in the state of a time before: some with half of their text and another source, and some more
    that are gone since. The second revises the former and the third deletes the latter. Each is committed twice; the
    second time changes nothing.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    older = docs.withColumns({"text": F.when(turn == 0, half).otherwise(F.col("text")), "source": F.when(turn == 0, F.lit("older")).otherwise(F.col("source"))})
    gone = docs.where(turn == 1).withColumns({"doc_id": -1 - F.col("doc_id"), "text": half})
    batches = {
        "1-insert": older.unionByName(gone).withColumn("op", F.lit("insert")),
        "2-revise": docs.where(turn == 0).withColumn("op", F.lit("revise")),
        "3-delete": gone.withColumn("op", F.lit("delete")),
    }
    rollup = TokenRollup(spark)
    for name, batch in batches.items():
        rollup.commit(name, batch)
        rollup.commit(name, batch)
    rollup.compact()
    return rollup.totals()


def op7_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and whether decoding gives the text back."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, carry=["doc_id"])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of sources by weights 1, 2, 3, repeating, takes."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = plan_mix(docs, "source", F.col("words"), [F.col("doc_id")])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op9_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under the Katz model learnt from four fifths of them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secret_links": op1_secret_links,
    "op2_weighted_minhash": op2_weighted_minhash,
    "op3_repetition": op3_repetition,
    "op4_url_ratio": op4_url_ratio,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_token_rollup": op6_token_rollup,
    "op7_piece_ids": op7_piece_ids,
    "op8_source_mix": op8_source_mix,
    "op9_lsm_exact_dedup": op9_lsm_exact_dedup,
    "op10_katz_scores": op10_katz_scores,
    "pipeline": pipeline,
}

def _url_sql() -> str:
    """The rules, the models of three characters' context, their calibration and the verdicts, in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fold = f"translate(translate(url, '{upper}', '{upper.lower()}'), '123456789', '000000000')"
    fits = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        on, _, under = rule.partition("/")
        fits.append((f"(host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '/{under}')", rule, verdict))
    named = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    judged = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    levels, smaller = [], "1.0 / 40"
    for k in range(4):
        levels.append(f"c{k} AS (SELECT substr(g, {4 - k}, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1)")
        levels.append(f"x{k} AS (SELECT substr(g, 1, {k}) AS x, sum(a) AS a, sum(b) AS b FROM c{k} GROUP BY 1)")
        lower = f" JOIN p{k - 1} q ON q.g = substr(c.g, 2, {k})" if k else ""
        qa, qb = ("q.a", "q.b") if k else (smaller, smaller)
        levels.append(f"p{k} AS (SELECT c.g, (c.a + 2.0::DOUBLE * {qa}) / (x.a + 2.0) AS a, (c.b + 2.0::DOUBLE * {qb}) / (x.b + 2.0) AS b FROM c{k} c JOIN x{k} x ON x.x = substr(c.g, 1, {k}){lower})")
    return rf"""
        WITH page AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        part AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
                        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                        '^^^' || regexp_replace({fold}, '[^abcdefghijklmnopqrstuvwxyz0/.:?=&_%#-]', '~', 'g') || '$' AS text FROM page),
        ruled AS (SELECT *, CASE {named} END AS rule, CASE {judged} END AS ruling FROM part),
        seen AS (SELECT text, ruling, count(*) AS n, ('0x' || substr(md5(text), 1, 4))::INT % 5 = 0 AS held FROM ruled GROUP BY ALL),
        gram AS (SELECT text, ruling, n, held, substr(text, i, 4) AS g FROM seen, unnest(range(1, length(text) - 2)) u(i)),
        counted AS (SELECT g, sum(CASE WHEN ruling = 'allow' AND NOT held THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN ruling = 'block' AND NOT held THEN n ELSE 0 END)::DOUBLE AS b FROM gram GROUP BY g),
        {", ".join(levels)},
        scored AS (SELECT text, sum(ln(a) - ln(b)) / count(*) AS score FROM (SELECT DISTINCT text FROM seen) s, unnest(range(1, length(text) - 2)) u(i) JOIN p3 ON p3.g = substr(text, i, 4) GROUP BY text),
        fold AS (SELECT ruling, n, score FROM seen JOIN scored USING (text) WHERE held AND ruling IS NOT NULL),
        ends AS (SELECT min(score) AS low, max(score) AS high, sum(n) FILTER (ruling = 'allow') AS good, sum(n) FILTER (ruling = 'block') AS bad FROM fold),
        bin AS (SELECT b, coalesce(sum(n) FILTER (ruling = 'allow'), 0) AS good, coalesce(sum(n) FILTER (ruling = 'block'), 0) AS bad
                FROM range(513) r(b) LEFT JOIN (SELECT *, floor((score - low) / ((high - low) / 512)) AS k FROM fold, ends WHERE high > low) ON k = b GROUP BY b),
        rate AS (SELECT b, round(1 - coalesce(sum(bin.good) OVER below, 0) / ends.good + coalesce(sum(bin.bad) OVER below, 0) / ends.bad, 9) AS sep FROM bin, ends
                 WINDOW below AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        cut AS (SELECT CASE WHEN NOT (SELECT coalesce(bool_or(ruling = 'allow'), false) AND coalesce(bool_or(ruling = 'block'), false) FROM seen WHERE NOT held) THEN '-inf'::DOUBLE
                            WHEN coalesce(good, 0) = 0 OR coalesce(bad, 0) = 0 OR high <= low THEN 0
                            ELSE low + (high - low) / 512 * (SELECT (min(b) + max(b)) / 2 FROM rate WHERE sep = (SELECT max(sep) FROM rate)) END AS least FROM ends)
        SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN score >= (SELECT least FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
        FROM ruled JOIN scored USING (text)
    """


def _shards_sql(bits: int = 6) -> str:
    """Checksums, cells, the curve's index step by step, and runs of its order, in SQL."""
    axes = [f"x{i}" for i in range(4)]
    table = "doc_id, size, text_crc32"
    name = "coalesce(('0x' || substr(md5({0}), 1, 8))::BIGINT % 64, 0)"
    size = "least(2 * (length(bin(size)) - 1) + (substr(bin(size), 2, 1) = '1')::INT, 63)"
    cell = "coalesce(CASE WHEN high > low THEN least(greatest(floor((doc_id::DOUBLE - low) / (high - low)::DOUBLE * 64), 0), 63)::BIGINT END, 0)"
    now = f"(SELECT {table}, {cell} AS x0, {size} AS x1, {name.format('source')} AS x2, {name.format('lang')} AS x3 FROM sized, ends)"
    for b in range(bits - 1, 0, -1):
        for i in range(4):
            q, low = 1 << b, (1 << b) - 1
            turned = [f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0"]
            turned += [f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}" if k == i else f"x{k}" for k in range(1, 4)]
            now = f"(SELECT {table}, {', '.join(turned)} FROM {now})"
    coded = f"(SELECT {table}, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2, xor(xor(xor(x0, x1), x2), x3) AS g3 FROM {now})"
    mask = "0"
    for b in range(bits - 1, 0, -1):
        mask = f"xor({mask}, CASE WHEN g3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    flipped = f"(SELECT {table}, {', '.join(f'xor(g{i}, mask) AS {a}' for i, a in enumerate(axes))} FROM (SELECT *, {mask} AS mask FROM {coded}))"
    bit = [f"(({a} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in range(bits - 1, -1, -1) for i, a in enumerate(axes)]
    return f"""
        WITH byte AS (SELECT range AS n, range AS c FROM range(256)),
        turn AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM byte)),
        text AS (SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
        sized AS (SELECT doc_id, source, lang, size, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM text, turn),
        ends AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents),
        placed AS (SELECT {table}, {' + '.join(bit)} AS curve FROM {flipped}),
        ranked AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id) - 1 AS r, count(*) OVER () // 8 AS small, count(*) OVER () % 8 AS extra FROM placed)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(CASE WHEN r < extra * (small + 1) THEN r // (small + 1) ELSE extra + (r - extra * (small + 1)) // greatest(small, 1) END AS INT) AS shard,
               CASE WHEN r < extra * (small + 1) THEN r % (small + 1) ELSE (r - extra * (small + 1)) % greatest(small, 1) END AS slot, CAST(NULL AS INT) AS grown_shard, curve
        FROM ranked
    """


ORACLE = {
    "op5_hilbert_shards": _shards_sql(),
    "op4_url_ratio": _url_sql(),
    # brute force over all pairs that share a shingle; what the buckets miss (4 of 10,000 pairs) would show here
    "op2_weighted_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        shingle AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) u(i)),
        tf AS (SELECT doc_id, g, count(*) AS c FROM shingle GROUP BY ALL),
        df AS (SELECT g, count(*) AS f FROM tf GROUP BY g),
        weight AS (SELECT doc_id, g, f, c * (1 + 0.25 * (1 - ln(f) / ln(greatest((SELECT count(*) FROM documents), 2)))) AS w FROM tf JOIN df USING (g)),
        whole AS (SELECT doc_id, sum(w) AS s FROM weight GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.w, b.w)) AS m FROM weight a JOIN weight b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.f > 1 GROUP BY ALL),
        link AS (SELECT x, y FROM pair JOIN whole p ON p.doc_id = x JOIN whole q ON q.doc_id = y WHERE m / (p.s + q.s - m) >= 0.8),
        way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN way ON b = x),
        class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM class
    """,
    "op3_repetition": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        word AS (SELECT doc_id, i, length(ws[i]) AS chars FROM w, unnest(range(1, len(ws) + 1)) u(i)),
        size AS (SELECT doc_id, count(*) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars FROM word GROUP BY doc_id),
        gram AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
                 FROM w, (VALUES (5), (6), (7), (8), (9), (10)) k(n), unnest(range(1, len(ws) - n + 2)) u(i)),
        twice AS (SELECT doc_id, n, i, c > 2 AS thrice FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM gram) WHERE c > 1),
        inside AS (SELECT doc_id, n, i + j AS i, bool_or(thrice) AS thrice FROM twice, unnest(range(0, n)) v(j) GROUP BY ALL),
        cover AS (SELECT doc_id, n, count(*) AS words, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(CASE WHEN thrice THEN chars ELSE 0 END) AS BIGINT) AS often
                  FROM inside JOIN word USING (doc_id, i) GROUP BY doc_id, n),
        share AS (SELECT doc_id, max(CASE WHEN n = 5 THEN words END) AS n_repeat_words, max(chars / word_chars) AS dup_ngram_share, max(often / word_chars) AS often_ngram_share,
                         bool_or(often / word_chars > CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END) AS bad
                  FROM cover JOIN size USING (doc_id) GROUP BY doc_id),
        line AS (SELECT doc_id, pos, string_split(text, chr(10))[pos] AS l FROM w, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)),
        again AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS chars
                  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) AS k FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id),
        every AS (SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(again.chars / word_chars, 0) AS dup_line_share,
                         coalesce(dup_ngram_share, 0) AS dup_ngram_share, coalesce(often_ngram_share, 0) AS often_ngram_share, coalesce(bad, false) OR coalesce(again.chars / word_chars, 0) > 0.25 AS bad
                  FROM w LEFT JOIN size USING (doc_id) LEFT JOIN share USING (doc_id) LEFT JOIN again USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR bad) AS kept, dup_line_share, dup_ngram_share, often_ngram_share
        FROM every
    """,
    "op9_lsm_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
