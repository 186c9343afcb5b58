"""Registered queries of the training-data operators: ``opN_<name>`` over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import licenses
from gaugeline.llm.decontaminate import contaminated
from gaugeline.llm.embedding_dedup import embedding_duplicates
from gaugeline.llm.filter_audit import audit, orders
from gaugeline.llm.html_extract import extract_text
from gaugeline.llm.licenses import known_licenses, scan_licenses
from gaugeline.llm.minhash_dedup import near_duplicates
from gaugeline.llm.mixing import mix
from gaugeline.llm.ppm import score_texts
from gaugeline.llm.quality import quality_scores
from gaugeline.llm.secrets import digest_columns, find_secrets
from gaugeline.llm.token_counts import count_tokens
from gaugeline.llm.toxicity import toxicity
from gaugeline.llm.vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes
from gaugeline.session import scratch_path

#: The tokenizer of the token counts: a file of the public vocabulary package.
TOKENIZER = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingled(size: int) -> str:
    """SQL of a document's (or item's) distinct shingles: one list per id."""
    return (f"list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [list_aggregate(w, 'string_agg', ' ')] "
            f"ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: list_aggregate(w[i:i+{size - 1}], 'string_agg', ' ')) END)")


@_query("op1_minhash_dedup", f"""
WITH RECURSIVE ws AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, {_shingled(4)} AS s FROM ws),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least ON a = doc_id""")
def op1_minhash_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80).withColumnRenamed("id", "doc_id")


@_query("op2_source_mix", f"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|42|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, sum(size) AS n FROM r GROUP BY source),
w AS (SELECT source, n, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, 3.0 * n / w AS fill, sum(n) OVER () AS total,
             sum(3 * n) OVER (ORDER BY 3.0 * n / w, encode(source) NULLS LAST) - 3 * n AS spent,
             sum(w) OVER () - sum(w) OVER (ORDER BY 3.0 * n / w, encode(source) NULLS LAST) + w AS open FROM w),
level AS (SELECT arg_min((total - spent) / open, fill) AS level FROM o WHERE (total - spent) / open * w <= 3 * n),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, CAST(least(3.0 * n, level * w) AS DOUBLE) AS target FROM o, level),
p AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(budget // greatest(source_size, 1) * size
            + least(greatest(budget - budget // greatest(source_size, 1) * source_size - start, 0), size) AS BIGINT) AS taken
FROM p""")
def op2_source_mix(spark, sf_dir):
    return (mix(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken"))


@_query("op5_decontamination", f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest({_shingled(5)}) AS g FROM dw),
i AS (SELECT item_id, {_shingled(5)} AS s FROM iw),
g AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, count(*) AS n_shared
FROM g JOIN d USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""")
def op5_decontamination(spark, sf_dir):
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared")


@_query("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    return digest_columns(find_secrets(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@_query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def _bare_sql(text):
    return f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', '', 'g')"


def _canonical_sql(bare):
    t = f"('  ' || regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  ')"
    for written, read in licenses.EQUIVALENT.items():
        t = f"replace({t}, ' {written.replace(' ', '  ')} ', ' {read.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.statement_rows() + licenses.text_rows())
_TRIMMED = r"regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
_BREAK = f"'{licenses.BLOCK_BREAK}'"


@_query("op3_license_scan", f"""
WITH given AS (SELECT license, {_bare_sql('text')} AS t FROM (VALUES {_KNOWN}) k(license, text)),
spelled AS (SELECT license, t, {_canonical_sql('t')} AS c FROM given),
known AS (SELECT c, min(license) AS license FROM spelled WHERE c <> '' GROUP BY c),
layouts AS (SELECT c, list_transform(string_split_regex({_TRIMMED}, {_BREAK}), lambda b: {_canonical_sql('b')}) AS blocks FROM spelled WHERE c <> ''),
runs AS (SELECT DISTINCT c, blocks, blocks[1] AS first, len(blocks) AS size FROM layouts),
whole AS (SELECT doc_id, rid, t, {_canonical_sql('t')} AS c FROM (SELECT doc_id, row_number() OVER () AS rid, {_bare_sql("coalesce(text, '')")} AS t FROM documents) d),
lines AS (SELECT rid, {_canonical_sql('line')} AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM whole) p),
stated AS (SELECT rid, license FROM lines JOIN known USING (c)),
parts AS (SELECT rid, string_split_regex(t, {_BREAK}) AS raw FROM whole),
blocked AS (SELECT rid, list_transform(raw, lambda b: {_canonical_sql('b')}) AS blocks, raw FROM parts),
placed AS (SELECT rid, blocks, raw, unnest(range(1, len(blocks) + 1)) AS at, unnest(blocks) AS first FROM blocked),
texts AS (SELECT p.rid, p.at + r.size AS ends, known.license FROM placed p JOIN runs r USING (first) JOIN known ON known.c = r.c
          WHERE p.blocks[p.at : p.at + r.size - 1] = r.blocks AND (r.size > 1 OR regexp_matches(p.raw[p.at], '{licenses.SEVERAL_LINES}'))),
found AS (SELECT rid, license FROM stated UNION SELECT rid, license FROM whole JOIN known USING (c) UNION SELECT rid, license FROM texts),
names AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS licenses FROM found GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM stated GROUP BY rid), m AS (SELECT rid, count(DISTINCT ends) AS m FROM texts GROUP BY rid)
SELECT doc_id, sha256(whole.c) AS digest, known.license AS whole_license, coalesce(n.n, 0) AS n_statements, coalesce(m.m, 0) AS n_texts,
       coalesce(names.licenses, '') AS licenses
FROM whole LEFT JOIN known USING (c) LEFT JOIN names USING (rid) LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)""")
def op3_license_scan(spark, sf_dir):
    return scan_licenses(_table(spark, sf_dir, "documents"), known_licenses(spark)).withColumnRenamed("id", "doc_id")


@_query("op4_ppm_scores")
def op4_ppm_scores(spark, sf_dir):
    return score_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query("op6_quality")
def op6_quality(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@_query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """A cache of its own per run: every distinct text is encoded, none is taken from an earlier run."""
    return (count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch_path(spark, "llm-token-cache"))
            .withColumnRenamed("id", "doc_id"))


@_query("op8_embedding_dedup")
def op8_embedding_dedup(spark, sf_dir):
    return embedding_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _rounds_sql() -> str:
    """CTEs ``a0, c1, a1, ... `` of the codebook rounds over ``p(vec_id, pos, x)`` and ``c0(pos, e, c)``."""
    assign = ("a{r} AS MATERIALIZED (SELECT vec_id, pos, x, min(ROW(d, e)) AS best FROM (SELECT vec_id, pos, x, e, "
              "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} USING (pos)) GROUP BY vec_id, pos, x)")
    update = ("c{s} AS MATERIALIZED (SELECT c{r}.pos, c{r}.e, coalesce(u.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT pos, e, list(m ORDER BY i) AS c FROM ("
              "SELECT pos, best[2] AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 1 + w) t(i) GROUP BY pos, e, i) GROUP BY pos, e) u "
              "ON u.pos = c{r}.pos AND u.e = c{r}.e)")
    lines = []
    for r in range(ROUNDS):
        lines += [assign.format(r=r), update.format(r=r, s=r + 1)]
    return ",\n".join([*lines, assign.format(r=ROUNDS)])


@_query("op11_vector_codes", f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, pos, len(v) // {PARTS} AS w, v[pos * (len(v) // {PARTS}) + 1 : (pos + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(pos)),
c0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {ENTRIES}),
{_rounds_sql().replace("range(1, 1 + w)", "range(1, 1 + (SELECT max(w) FROM p))")},
z AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY pos) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY pos, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM z JOIN k USING (vec_id)""")
def op11_vector_codes(spark, sf_dir):
    return vector_codes(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


_ORDERS = ", ".join(f"('{o}')" for o in orders())


@_query("op13_filter_audit", f"""
WITH l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS g, max(CAST(coalesce(toxic = 1, false) AS INT)) AS x
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(g) AS g, sum(x) AS x FROM m GROUP BY part, mask),
s AS (SELECT o, step, 1 << (ascii(o[step]) - 65) AS bit,
             coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0) AS earlier FROM (VALUES {_ORDERS}) v(o), range(1, 6) r(step)),
f AS (SELECT part, o, step, bit, n, g, x, mask, mask & earlier = 0 AS alive, mask & bit <> 0 AS fails FROM c, s),
a AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step, bit, CAST(coalesce(sum(n) FILTER (alive AND NOT fails), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (alive AND fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (NOT alive AND fails), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(g) FILTER (alive AND fails), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(x) FILTER (alive AND fails), 0) AS BIGINT) AS toxic_lost FROM f GROUP BY part, o, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a""")
def op13_filter_audit(spark, sf_dir):
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The SQL reads what the markup of the given pages amounts to: one article element, whose blocks end at p, br and h1.
@_query("op12_html_extraction", r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|br|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""")
def op12_html_extraction(spark, sf_dir):
    return extract_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
