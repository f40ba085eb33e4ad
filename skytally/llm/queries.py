"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm.bpe import digests, read_spec
from skytally.llm.decontaminate import leaks
from skytally.llm.fim import fill_in_middle, restored
from skytally.llm.language import language_of
from skytally.llm.lines import fuzzy_lines
from skytally.llm.minhash import near_duplicates
from skytally.llm.mixing import mix_sizes
from skytally.llm.neighbours import near_vectors
from skytally.llm.quality import quality_of
from skytally.llm.sharding import sharded
from skytally.llm.urls import judge
from skytally.llm.warc import round_trip
from skytally.llm.whiten import components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_benchmark_decontamination")
def op1(spark, sf_dir):
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    return fuzzy_lines(read(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return language_of(read(spark, sf_dir, "documents"))


@query("op4_embedding_near_dedup", sql="""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
part AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN part p ON p.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""")
def op4(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query("op5_warc", sql="""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.*, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op5(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "pages"))


@query("op6_mixing", sql=r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w,
  (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(w) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM w),
c AS (SELECT *, w * (150 * total - 100 * before) >= 200 * source_size * rest AS capped FROM f),
l AS (SELECT *, (sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())::BIGINT AS spent, (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS open FROM c),
goal AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (w * (150 * total - 100 * spent))::DOUBLE / (100 * open)::DOUBLE END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
d AS (SELECT z.*, source_size, target, whole, target - whole * source_size AS cut, place >> 48 AS cell
  FROM sized z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
cells AS (SELECT source, cell, any_value(cut) AS cut, sum(size) AS s, count(*) AS n FROM d GROUP BY 1, 2),
run AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY source ORDER BY cell) AS cnt FROM cells),
edge AS (SELECT source, min(cell) AS edge, min(cnt - n) AS c0, min(upto - s) AS s0 FROM run WHERE upto > cut GROUP BY 1),
state AS (SELECT r.source, r.cell, CASE WHEN edge IS NULL OR cell < edge THEN 1 WHEN cnt - n < c0 + 512 THEN 2 ELSE 0 END AS state, cut - s0 AS r0
  FROM run r LEFT JOIN edge e ON r.source IS NOT DISTINCT FROM e.source),
p0 AS (SELECT d.*, state, r0, 0 AS more FROM d JOIN state t ON d.source IS NOT DISTINCT FROM t.source AND d.cell = t.cell),
""" + "".join(f"""
a{i} AS (SELECT *, CASE WHEN state = 2 AND more = 0 AND size <= r{i - 1} AND sum(CASE WHEN more = 0 AND size <= r{i - 1} THEN size ELSE 0 END)
  OVER (PARTITION BY source, state ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) <= r{i - 1} THEN 1 ELSE 0 END AS new{i} FROM p{i - 1}),
p{i} AS (SELECT * REPLACE (more + new{i} AS more), r{i - 1} - sum(new{i} * size) OVER (PARTITION BY source, state) AS r{i} FROM a{i})""" + ("," if i < 4 else "") for i in range(1, 5)) + """
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN state = 2 THEN more ELSE state END))::BIGINT AS taken FROM p4""")
def op6(spark, sf_dir):
    return mix_sizes(read(spark, sf_dir, "documents"))


@query("op7_sharding", sql=r"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
depths AS (SELECT unnest(range(0, 61)) AS depth),
nodes AS (SELECT depth, key >> (60 - depth) AS prefix, sum(b)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM d CROSS JOIN depths GROUP BY 1, 2 HAVING sum(b) <= 1048576 OR min(key) = max(key)),
leaf AS (SELECT doc_id, min(depth) AS depth, any_value(key) AS key FROM d JOIN nodes n ON n.prefix = key >> (60 - depth) GROUP BY 1)
SELECT doc_id, l.depth::VARCHAR || '/' || prefix::VARCHAR AS shard_id, l.depth::INTEGER AS shard_depth, 0::BIGINT AS shard_page, shard_bytes, shard_docs
FROM leaf l JOIN nodes n ON n.depth = l.depth AND n.prefix = l.key >> (60 - l.depth)""")
def op7(spark, sf_dir):
    return sharded(read(spark, sf_dir, "documents")).select("doc_id", "shard_id", "shard_depth", "shard_page", "shard_bytes", "shard_docs")


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    return quality_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_url_filters", sql=r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM r),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (SELECT p.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1""")
def op9(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"))


@query("op10_minhash_near_dedup", sql=r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
part AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN part ON d.doc_id = x LEFT JOIN sizes z ON z.doc_id = d.doc_id""")
def op10(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op11_bpe_encoding")
def op11(spark, sf_dir):
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("byte_bpe_50k.json")))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return components(read(spark, sf_dir, "embeddings"))


@query("op13_fill_in_middle", sql=r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS u, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
  ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""")
def op13(spark, sf_dir):
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored(F.col("output"), F.col("form")))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))
