"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import release, shared_dir, stash
from .decontaminate import find_contained
from .embedding_dedup import near_duplicate_vectors
from .hard_negatives import mine_hard_negatives
from .license_scan import scan_licenses
from .line_dedup import EXACT_CHARS, MIN_CHARS, removed_by_document
from .maxscore import top_k
from .ngram_join import ngram_components
from .periodic_runs import find_runs
from .quality_rules import fit_quality, score_quality
from .source_mix import mix_sources
from .substring_dedup import remove_repeats
from .token_counts import TokenRollup, count_tokens, count_words, revised, signed
from .toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


def _rolled_up(spark: SparkSession, docs: DataFrame, labels: DataFrame, other: DataFrame) -> DataFrame:
    """Totals after inserts under two tokenizer versions, the deletion of all
    documents that a label calls toxic, and revised counts of all documents
    without their digits; with retries before and after compaction."""
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    words, redacted = count_words(docs), count_words(docs, text=F.regexp_replace("text", "[0-9]", ""))
    rollup.commit("load", signed(words, 1))
    rollup.commit("load", signed(words, 1))  # a retry counts nothing twice
    rollup.commit("second version", signed(other, 1))
    rollup.compact()
    rollup.commit("load", signed(words, 1))  # final by now
    rollup.commit("redaction", revised(words, redacted))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollup.commit("takedown", signed(redacted.unionAll(other).join(toxic, "doc_id", "left_semi"), -1))
    rollup.compact()
    totals = stash(rollup.totals())
    rollup.drop()
    return totals


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of words and of tokens of a public tokenizer."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = stash(count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, "byte_bpe_50k"))
    totals = _rolled_up(spark, docs, table(spark, sf_dir, "labels"), counts)
    release(counts)
    return totals


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same course of batches with two versions that SQL can count: words
    and bytes."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    other = docs.select("doc_id", "source", "lang", F.lit("bytes").alias("tokenizer"), size.alias("tokens"))
    return _rolled_up(spark, docs, table(spark, sf_dir, "labels"), other)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("differences", F.to_json("differences"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def _lines_removed(docs: DataFrame, exact_chars: int) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = lines.join(removed_by_document(docs, exact_chars=exact_chars), ["doc_id", "mark"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines of every length, and nearly equal ones of 30 characters or more."""
    return _lines_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), EXACT_CHARS)


def long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 30 characters or more alone."""
    return _lines_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_CHARS)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def _repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12 is to take of a document: those of a tenth of the
    documents repeat a stretch of their own."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), 12, _repeated_words)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    out = found.withColumn("best", longest).withColumn("lines", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_counts": op5_token_counts,
    "token_rollup_words": token_rollup_words,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_source_mix": op8_source_mix,
    "op9_line_dedup": op9_line_dedup,
    "long_line_dedup": long_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_maxscore": op13_maxscore,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM x JOIN f USING (s) WHERE doc_id > least),
k AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
r AS (SELECT k.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY k.j) AS t FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.j = k.j WHERE g.j IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(r.kept, 0))::BIGINT AS n_removed, sha256(coalesce(r.t, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
    "op4_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c::BIGINT AS component_id, m.c = vec_id AS kept
FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "token_rollup_words": r"""
WITH k AS (SELECT * FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
c AS (SELECT source, lang, 'words' AS tokenizer, coalesce(len(regexp_extract_all(regexp_replace(text, '[0-9]', '', 'g'), '[^\x20\x09-\x0D]+')), 0) AS tokens FROM k
      UNION ALL SELECT source, lang, 'bytes', coalesce(octet_length(encode(text)), 0) FROM k)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens FROM c GROUP BY source, lang, tokenizer
""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.a = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op8_source_mix": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY skey),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS room FROM s),
u AS (SELECT *, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
        coalesce(sum(source_size) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
        coalesce(sum(weight) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone FROM r),
l AS (SELECT *, (all_size - 3.0::DOUBLE * used) / (all_weight - gone)::DOUBLE AS level FROM u),
f AS (SELECT level AS lam FROM l WHERE level <= room ORDER BY room, skey LIMIT 1),
t AS (SELECT skey, source_size, least((SELECT lam FROM f) * weight, 3.0::DOUBLE * source_size) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.skey ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
        sum(d.size) OVER (PARTITION BY d.skey, h)::BIGINT AS here
      FROM d JOIN g USING (skey))
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN upto - here / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x
""",
    "op10_decontaminate": r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, any_value(n.n_item)::BIGINT AS n_item
FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 4 * count(*) >= 3 * any_value(n.n_item)
""",
    "long_line_dedup": r"""
WITH c AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
l AS (
  SELECT row, doc_id, generate_subscripts(x, 1)::INT - 1 AS pos, trim(unnest(x), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT row, doc_id, string_split(text, chr(10)) AS x FROM c WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
e AS (SELECT * FROM l WHERE length(line) >= 30),
u AS (SELECT line, min(doc_id * 2147483648::HUGEINT + pos) AS rank, length(line) AS n FROM e GROUP BY line),
d AS (SELECT DISTINCT b.line FROM u a JOIN u b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.rank < b.rank WHERE levenshtein(a.line, b.line) <= 2),
r AS (SELECT e.row, e.pos FROM e JOIN u ON e.line = u.line LEFT JOIN d ON d.line = e.line
      WHERE d.line IS NOT NULL OR e.doc_id * 2147483648::HUGEINT + e.pos > u.rank)
SELECT c.doc_id, coalesce(len(string_split(c.text, chr(10))), 0)::BIGINT AS n_lines, count(r.pos)::BIGINT AS n_removed,
       coalesce(string_agg(r.pos::VARCHAR, ',' ORDER BY r.pos), '') AS removed_lines
FROM c LEFT JOIN r ON c.row = r.row GROUP BY c.row, c.doc_id, c.text
""",
    "op9_line_dedup": r"""
WITH c AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
l AS (
  SELECT row, doc_id, generate_subscripts(x, 1)::INT - 1 AS pos, trim(unnest(x), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT row, doc_id, string_split(text, chr(10)) AS x FROM c WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
e AS (SELECT * FROM l WHERE length(line) >= 1),
u AS (SELECT line, min(doc_id * 2147483648::HUGEINT + pos) AS rank, length(line) AS n FROM e GROUP BY line),
d AS (SELECT DISTINCT b.line FROM u a JOIN u b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.rank < b.rank WHERE a.n >= 30 AND b.n >= 30 AND levenshtein(a.line, b.line) <= 2),
r AS (SELECT e.row, e.pos FROM e JOIN u ON e.line = u.line LEFT JOIN d ON d.line = e.line
      WHERE d.line IS NOT NULL OR e.doc_id * 2147483648::HUGEINT + e.pos > u.rank)
SELECT c.doc_id, coalesce(len(string_split(c.text, chr(10))), 0)::BIGINT AS n_lines, count(r.pos)::BIGINT AS n_removed,
       coalesce(string_agg(r.pos::VARCHAR, ',' ORDER BY r.pos), '') AS removed_lines
FROM c LEFT JOIN r ON c.row = r.row GROUP BY c.row, c.doc_id, c.text
""",
    "op12_periodic_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
           [4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')]),
           lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) END AS h
  FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
t AS (SELECT row, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.row, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.row = y.row AND x.word = y.word AND x.i < y.i),
s AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS stretch FROM e),
r AS (SELECT row, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY row, q, stretch HAVING count(*) >= q AND count(*) + q >= 12),
u AS (SELECT row, start, length, min(q) AS period FROM r GROUP BY row, start, length),
b AS (SELECT row, count(*) AS n_runs, max(struct_pack(n := length, s := -start, p := -period)) AS best,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM u GROUP BY row),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM t
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.row = t.row AND t.i >= u.start + u.period AND t.i < u.start + u.length) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.n::BIGINT AS length, (-best.p)::BIGINT AS period,
       (1000 * best.n // -best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.row = d.row LEFT JOIN k ON k.row = d.row
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score, b.row AS other_row
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.row, p.other_row ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.row = p.row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op13_maxscore": r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.row <> b.row AND len(a.e) = len(b.e))
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
""",
}
