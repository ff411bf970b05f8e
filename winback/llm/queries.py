"""The registered queries of this subpackage, with production parameters on whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winback.llm import bpe, infill, langid, licenses, mixing, negatives, packing, pages, quality, simhash, suffix, urls, vectors
from winback.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(vecs, F.col("vec_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.restored(infill.transformed(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_embedding_dedup, op2_license_scan, op3_language_id, op4_suffix_dedup, op5_quality_rules, op6_html_extraction, op7_url_filter, op8_mixing, op9_packing, op10_simhash,
                                                     op11_hard_negatives, op12_fill_in_middle, op13_byte_bpe)}

OP8 = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, source IS NULL AS unnamed, md5('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS draw,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, unnamed, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, (row_number() OVER (ORDER BY unnamed, source) - 1) % 3 + 1 AS weight FROM sums),
leveled AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, unnamed, source)),
plan AS (SELECT source, unnamed, source_size, LEAST(3.0::DOUBLE * source_size, weight * MAX(level) OVER ()) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, COALESCE(FLOOR(p.target / NULLIF(p.source_size, 0)), 0) AS whole,
         SUM(s.size) OVER (PARTITION BY s.unnamed, s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2 AS middle
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP1 = r"""
WITH RECURSIVE good AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS MATERIALIZED (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM good),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM normed a JOIN normed b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.95),
reach AS (SELECT va AS n, vb AS m FROM links UNION SELECT reach.n, links.vb FROM reach JOIN links ON reach.m = links.va),
least AS (SELECT n, MIN(m) AS m FROM reach GROUP BY n),
counted AS (SELECT va AS vec_id, COUNT(*) AS others FROM links GROUP BY va)
SELECT vec_id, CAST(COALESCE(others, 0) AS BIGINT) AS n_links, LEAST(vec_id, COALESCE(m, vec_id)) AS component_id, vec_id <= COALESCE(m, vec_id) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least ON least.n = vec_id
"""

_TEMPLATES = ", ".join(f"({n}, '{label}', {phrase}, '{text}')" for n, (text, label, phrase) in enumerate(
    [(p, x, True) for p, x in licenses.PHRASES.items()] + [(t, x, False) for x, t in licenses.NOTICES]))

OP2 = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(template, label, phrase, t) AS (VALUES {_TEMPLATES}),
wanted AS (
  SELECT template, label, phrase, len(tw) - 1 AS size, i - 1 AS spot, tw[i] || ' ' || tw[i + 1] AS g
  FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM (SELECT *, string_split(t, ' ') AS tw FROM templates))),
hits AS MATERIALIZED (
  SELECT r, template, label, phrase, size, spot, i - 1 - spot AS diagonal
  FROM (SELECT r, w[i] || ' ' || w[i + 1] AS g, i FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs WHERE len(w) > 1)) JOIN wanted USING (g)),
steps AS (
  SELECT *, NOT phrase AND COALESCE(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {licenses.DRIFT}, FALSE) AS near
  FROM (SELECT DISTINCT r, template, phrase, diagonal FROM hits)),
spans AS (SELECT r, template, diagonal, SUM(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM steps),
good AS (
  SELECT r, template, label, phrase, MIN(diagonal) AS start, COUNT(DISTINCT spot) / size AS share
  FROM hits JOIN spans USING (r, template, diagonal) GROUP BY r, template, label, phrase, size, span
  HAVING CASE WHEN phrase THEN COUNT(DISTINCT spot) = size ELSE COUNT(DISTINCT spot) / size >= {licenses.SHARE} END),
found AS (
  SELECT r, COUNT(*) FILTER (phrase) AS n_base, MIN(start) FILTER (phrase) AS first_word, MAX(start) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(share) AS score
  FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)
"""

OP4 = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(doc_id, 9223372036854775807) AS d, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
windows AS MATERIALIZED (SELECT r, d, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, d, h, unnest(range(0, n - 49)) AS i FROM docs WHERE n >= 50)),
firsts AS (SELECT g, MIN(d) AS m FROM windows GROUP BY g HAVING COUNT(DISTINCT d) > 1),
bad AS (SELECT r, i FROM windows JOIN firsts USING (g) WHERE m < d),
steps AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM bad),
spans AS (SELECT r, MIN(i) AS s, MAX(i) + 50 AS e FROM (SELECT r, i, SUM(new) OVER (PARTITION BY r ORDER BY i) AS span FROM steps) GROUP BY r, span),
pieces AS (
  SELECT r, COALESCE(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT r, MAX(e), n FROM spans JOIN docs USING (r) GROUP BY r, n
  UNION ALL SELECT r, 0, n FROM docs WHERE r NOT IN (SELECT r FROM spans)),
kept AS (SELECT r, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM pieces JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, SUM(e - s) AS n_removed, COUNT(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

OP5 = r"""
WITH found AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM found WHERE len(w) >= 5)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING COUNT(*) > 1),
repeated AS (SELECT r, COUNT(DISTINCT i + k) AS n_repeat_words FROM grams JOIN twice USING (r, g), range(5) AS t(k) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM found) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
base AS MATERIALIZED (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(COALESCE(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(COALESCE(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM found LEFT JOIN repeated USING (r) LEFT JOIN dups USING (r)),
ratios AS MATERIALIZED (
  SELECT r, lang, source, unnest([
    {'ratio': 'word_length', 'value': 1000 * word_chars // n_words, 'slack': 2000}, {'ratio': 'symbols', 'value': 1000 * n_symbols // n_words, 'slack': 1000},
    {'ratio': 'dup_lines', 'value': 1000 * n_dup_lines // n_words, 'slack': 200}, {'ratio': 'repeats', 'value': 1000 * n_repeat_words // n_words, 'slack': 200}], recursive := true)
  FROM base WHERE n_words > 0),
rounded AS (SELECT *, (value >> GREATEST(length(bin(value)) - 5, 0)) << GREATEST(length(bin(value)) - 5, 0) AS v FROM ratios),
levels AS (SELECT 2 AS level, lang, source, ratio, slack, v FROM rounded UNION ALL SELECT 1, lang, NULL, ratio, slack, v FROM rounded UNION ALL SELECT 0, NULL, NULL, ratio, slack, v FROM rounded),
sketch AS (SELECT level, lang, source, ratio, slack, v, COUNT(*) AS n FROM levels GROUP BY ALL),
ranked AS (SELECT *, SUM(n) OVER (p ORDER BY v) AS upto, SUM(n) OVER p AS total FROM sketch WINDOW p AS (PARTITION BY level, lang, source, ratio)),
quartiles AS (
  SELECT level, lang, source, ratio, slack, CAST(MAX(total) AS BIGINT) AS n, MIN(v) FILTER (upto * 4 >= total) AS q1, MIN(v) FILTER (upto * 4 >= total * 3) AS q3 FROM ranked GROUP BY ALL),
own AS (
  SELECT level, lang, source, ratio, n, q3 + 3 * (q3 - q1) + slack AS high, CASE ratio WHEN 'word_length' THEN GREATEST(q1 - 3 * (q3 - q1) - slack, 0) ELSE 0 END AS low FROM quartiles),
middle AS (
  SELECT o.lang, o.ratio, (o.n * o.high + 200 * p.high) // (o.n + 200) AS high, (o.n * o.low + 200 * p.low) // (o.n + 200) AS low
  FROM own o JOIN own p ON o.level = 1 AND p.level = 0 AND o.ratio = p.ratio),
fine AS (
  SELECT o.lang, o.source, o.ratio, (o.n * o.high + 200 * p.high) // (o.n + 200) AS high, (o.n * o.low + 200 * p.low) // (o.n + 200) AS low
  FROM own o JOIN middle p ON o.level = 2 AND o.lang IS NOT DISTINCT FROM p.lang AND o.ratio = p.ratio),
verdicts AS (
  SELECT t.r, bool_and(t.value BETWEEN f.low AND f.high) AS ok
  FROM ratios t JOIN fine f ON t.ratio = f.ratio AND t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source GROUP BY t.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND COALESCE(ok, TRUE) AS kept
FROM base LEFT JOIN verdicts USING (r)
"""

OP7 = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(COALESCE(rest, ''), '^[^/?#]*') AS raw_host, regexp_extract(regexp_replace(COALESCE(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max({'rule': h || p, 'verdict': verdict}, 1000 * length(h) + length(p)) AS found
  FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, found.rule AS rule, COALESCE(found.verdict, 'allow') AS verdict FROM hosts LEFT JOIN best USING (page_id)
"""

OP11 = """
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS k FROM scores WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.other) AS INTEGER) AS rank, n.other AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""

OP12 = """
WITH drawn AS (SELECT doc_id, COALESCE(text, '') AS t, CAST(length(COALESCE(text, '')) AS BIGINT) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 8) AS BIGINT)) AS x FROM drawn),
planned AS (
  SELECT *, LEAST(x[1] % (n + 1), x[2] % (n + 1)) AS one, GREATEST(x[1] % (n + 1), x[2] % (n + 1)) AS two,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substr(t, 1, one) AS prefix, substr(t, one + 1, two - one) AS middle, substr(t, two + 1) AS suffix FROM planned)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars, CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1, "op2_license_scan": OP2, "op4_suffix_dedup": OP4, "op5_quality_rules": OP5, "op7_url_filter": OP7, "op8_mixing": OP8,
                           "op11_hard_negatives": OP11, "op12_fill_in_middle": OP12}
