"""The registered queries of the operators, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import count_tokens
from .decontaminate import find_leaks
from .jaccard import jaccard_join
from .language import label_languages
from .language import train as train_languages
from .manifest import fold, merkle_manifest, row_digest, siblings_text
from .mixing import mix, n_words
from .quality import quality_scores
from .sharding import LAW, histogram_shards
from .spelling import spelling_variants, word_counts
from .substrings import remove_repeats
from .tokens import read_tokens, token_files
from .urls import judge_urls
from .vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Table of the CRC-32 of one byte, as a list; the checksum of a list of bytes folds over it.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def _crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of an expression's UTF-8 bytes; ``t`` of the table above must be in scope."""
    hexed = f"hex(encode({text}))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(strlen({text})), lambda b: ('0x' || substr({hexed}, 2 * b + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])), 4294967295)"


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(id_col: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op1_pareto_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Chances grow with the square root of a text's length.
    docs = _table(spark, sf_dir, "documents")
    taken = mix(docs.withColumn("liking", F.sqrt(n_words(F.col("text")))), preference="liking")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_language_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_held(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train_languages(docs.where(~held_out))
    said = docs.select("doc_id", held_out.alias("held_out"), label_languages(model, F.col("text"), with_spans=False).alias("said"))
    return said.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


@query("op3_token_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    folder, manifest = token_files(_table(spark, sf_dir, "documents"), str(path("byte_bpe_50k.json")))
    return read_tokens(spark, folder, manifest, with_ids=False)




@query(
    "op4_alias_urls",
    r"""
WITH RECURSIVE raw AS (
  SELECT page_id, url, html,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS after
  FROM pages
), part AS (
  SELECT page_id, url, html,
    translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '^[^#?]*(\?[^#]*)', 1) AS q
  FROM raw
), link AS (
  SELECT DISTINCT host || path || q AS a, regexp_replace(unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)(<link\s[^>]*>)', 1), lambda t: regexp_matches(t, '(?is)\srel\s*=\s*["'']?canonical["''\s/>]')),
      lambda t: regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^\s"''>]*)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)(<meta\s[^>]*>)', 1), lambda t: regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?refresh["''\s]')),
      lambda t: regexp_extract(t, '(?is)url\s*=\s*["'']?([^"'']*)', 1)))), '#.*$', '') AS target
  FROM part WHERE host <> ''
), target AS (
  SELECT a, target, translate(regexp_extract(target, '^[^:/?#]*://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(target, '^[^:/?#]*://[^/?#]*(.*)$', 1) AS rest, regexp_extract(a, '^([^/?]*)', 1) AS own
  FROM link WHERE target <> ''
), edge AS (
  SELECT a, CASE WHEN h <> '' THEN h || rest WHEN target LIKE '/%' THEN own || target END AS b FROM target
), both_ways AS (
  SELECT a, b FROM edge WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM edge WHERE b IS NOT NULL AND a <> b
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), node AS (
  SELECT DISTINCT n, regexp_extract(n, '^([^/?]*)', 1) AS host, regexp_extract(n, '^[^/?]*([^?]*)', 1) AS path
  FROM (SELECT host || path || q AS n FROM part WHERE host <> '' UNION SELECT a FROM both_ways)
), said AS (
  SELECT x.*, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM node x
), passed AS (
  SELECT r.a AS n, bool_or(s.rule IN ('org/', 'com/fr/')) AS allowed, bool_or(s.rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')) AS blocked
  FROM reach r JOIN said s ON s.n = r.b GROUP BY 1
)
SELECT p.page_id, p.host, p.path, s.rule,
  CASE WHEN s.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN s.rule IS NOT NULL THEN 'block'
       WHEN a.allowed THEN 'allow' WHEN a.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM part p LEFT JOIN said s ON p.host <> '' AND s.n = p.host || p.path || p.q LEFT JOIN passed a ON a.n = s.n
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op5_pivot_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query(
    "op6_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN link ON u = r
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op8_quality_gam")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = labels.where(_held(F.col("doc_id"), 3) != 1)
    scored, _ = quality_scores(_table(spark, sf_dir, "documents"), learned)
    held_out = F.coalesce(_held(F.col("id"), 3) == 1, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_histogram_sort")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = histogram_shards(docs.withColumn("text_crc32", crc))
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op10_doubled_windows",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), run AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM run, range(0, 35) r(j) WHERE k IN (SELECT k FROM run GROUP BY k HAVING count(*) > 1)
), word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _FIELDS) + ")"


@query(
    "op11_merkle_manifest",
    rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), doc AS (
  SELECT *, {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 AS hit FROM documents, crc
), leaf AS (
  SELECT doc_id, lang, {_LEAF_SQL} AS h FROM doc
), changed AS (
  SELECT doc_id, {_LEAF_SQL} AS h FROM (SELECT * REPLACE (CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text) FROM doc)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), node(lang, level, i, n, h) AS (
  SELECT lang, 0, i, n, h FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, i // 8
), subroot AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), upper(level, i, n, h) AS (
  SELECT 0, i, n, h FROM subroot
  UNION ALL
  SELECT any_value(level) + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 8
), run AS (
  SELECT false AS up, lang, level, i // 8 AS r, string_agg(h, '' ORDER BY i) AS s FROM node WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT true, NULL, level, i // 8, string_agg(h, '' ORDER BY i) FROM upper WHERE n > 1 GROUP BY ALL
), walk(doc_id, lang, up, level, i, n, proof, cur) AS (
  SELECT p.doc_id, p.lang, p.n = 1, 0, CASE WHEN p.n = 1 THEN s.i ELSE p.i END, CASE WHEN p.n = 1 THEN s.n ELSE p.n END, '', c.h
  FROM placed p JOIN changed c USING (doc_id) JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.up OR w.n <= 8, CASE WHEN NOT w.up AND w.n <= 8 THEN 0 ELSE w.level + 1 END,
    CASE WHEN NOT w.up AND w.n <= 8 THEN s.i ELSE w.i // 8 END, CASE WHEN NOT w.up AND w.n <= 8 THEN s.n ELSE (w.n + 7) // 8 END,
    w.proof || substr(r.s, 1, (w.i % 8 * 64)::BIGINT) || substr(r.s, (w.i % 8 * 64 + 65)::BIGINT),
    sha256(substr(r.s, 1, (w.i % 8 * 64)::BIGINT) || w.cur || substr(r.s, (w.i % 8 * 64 + 65)::BIGINT))
  FROM walk w JOIN run r ON r.up = w.up AND (w.up OR r.lang IS NOT DISTINCT FROM w.lang) AND r.level = w.level AND r.r = w.i // 8
  JOIN subroot s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n > 1
), done AS (
  SELECT doc_id, proof, cur FROM walk WHERE up AND n = 1
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, u.h AS root, sha256(d.proof) AS proof_sha256, d.cur AS folded_root, d.cur = u.h AS verified
FROM leaf l JOIN done d USING (doc_id) JOIN subroot s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper u ON u.n = 1
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(F.coalesce(_held(F.col("doc_id"), 3) == 0, F.lit(False)), F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    changed = row_digest(*[text if c == "text" else F.col(c) for c in _FIELDS])
    found = merkle_manifest(docs, _FIELDS, keep={"changed": changed})
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(
    "op12_permuterm_variants",
    rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), hashed AS (
  SELECT run, {_crc32_sql("(doc_id::VARCHAR || ':' || run)")} AS h FROM run, crc WHERE length(run) >= 6
), counted AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counted)
), pair AS (
  SELECT a.word AS u, b.word AS v FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, d FROM less WHERE d IN (SELECT word FROM counted)
  UNION SELECT d, word FROM less WHERE d IN (SELECT word FROM counted)
), near AS (
  SELECT u, v, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS nth, count(*) OVER (PARTITION BY u) AS n_near FROM pair JOIN counted ON word = v
), formed AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 5 * c.n THEN v END AS form, CASE WHEN x.n >= 5 * c.n THEN x.n END AS form_n
  FROM counted c LEFT JOIN near x ON x.u = c.word AND nth = 1
), chain(word, here) AS (
  SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c USING (word) JOIN formed g ON g.word = c.here WHERE g.form IS NULL
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents")))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    found = count_tokens(_table(spark, sf_dir, "documents"), str(path("word_bpe_49k.json")))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
