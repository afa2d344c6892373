"""Catalogue, join, set and audit queries over the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.sql import both, query
from tracewell.session import table

TEXTS = {
    "q_domain_completion": """
WITH k AS (SELECT DISTINCT o_orderstatus FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders),
n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)
SELECT k.o_orderstatus, p.o_orderpriority, coalesce(n.n, 0) AS n, CASE WHEN n.n IS NULL THEN 'MODEL_OR_EVENT_RESULT_MISSING' END AS reason
FROM k CROSS JOIN p LEFT JOIN n ON n.o_orderstatus = k.o_orderstatus AND n.o_orderpriority = p.o_orderpriority""",
    # Totals with unknown sums kept unknown, and a sum of nothing made 0 where the catalogue says so.
    "q_catalog_totals": """
SELECT count(*) AS recordings, @count_if(o_orderstatus = 'F') AS qualified,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS qualified_sum,
       round(coalesce(sum(CASE WHEN o_orderstatus = 'none' THEN o_totalprice END), 0), 2) AS absent_bytes,
       round(sum(o_totalprice), 2) AS bytes FROM orders""",
    "q_duplicate_payloads": """
SELECT @sha(text) AS digest, count(*) AS files, min(doc_id) AS first_file FROM documents
GROUP BY @sha(text) HAVING count(*) > 1""",
    "q_distinct_people": """
SELECT count(*) AS people FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) AS d""",
    # Aggregated before joining, so that a bridge doesn't multiply sizes.
    "q_experiment_recordings": """
WITH per AS (SELECT l_orderkey, l_suppkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_suppkey)
SELECT s_nationkey, o_orderstatus, count(*) AS pairs, count(DISTINCT o_orderkey) AS recordings, sum(lines) AS lines, round(sum(quantity), 2) AS quantity
FROM per JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, o_orderstatus""",
    "q_left_missing": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "q_anti_missing": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "q_semi_present": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "q_null_safe_join": """
WITH a AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT quality, count(*) AS n FROM a GROUP BY quality)
SELECT a.doc_id, k.n AS peers FROM a JOIN k ON a.quality IS NOT DISTINCT FROM k.quality""",
    "q_full_outer_census": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN 'UNEXPECTED' WHEN l.doc_id IS NULL THEN 'MISSING' ELSE 'BOTH' END AS member
FROM documents d FULL OUTER JOIN (SELECT doc_id + 100 AS doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "q_reason_array": """
SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n,
       concat_ws('|', max(CASE WHEN l_quantity > 45 THEN 'HIGH_AMPLITUDE' END), max(CASE WHEN l_discount > 0.08 THEN 'LINE_DOMINATED' END),
                 max(CASE WHEN l_tax = 0 THEN 'FLAT' END)) AS reasons
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey""",
    "q_reason_histogram": """
SELECT reason, count(*) AS windows FROM (SELECT @given(CASE WHEN l_quantity > 45 THEN 'HIGH_AMPLITUDE' END, CASE WHEN l_discount > 0.08 THEN 'LINE_DOMINATED' END,
  CASE WHEN l_tax = 0 THEN 'FLAT' END) AS reason FROM lineitem) AS r GROUP BY reason""",
    "q_status_projection": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 200000 THEN 'ELIGIBLE' WHEN o_orderstatus = 'F' THEN 'QUALIFIED_UNSELECTED' ELSE 'REJECTED' END AS status,
       CASE WHEN o_custkey % 2 = 0 THEN 'external-exposed' ELSE 'external-new' END AS split FROM orders""",
    "q_status_filters": """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority LIKE '%-HIGH' AND o_orderdate IS NOT NULL GROUP BY o_orderstatus""",
    "q_union_harmonised": """
SELECT kind, count(*) AS n, count(amount) AS known, round(sum(amount), 2) AS amount FROM (
  SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
  UNION ALL SELECT 'nation', n_nationkey, CAST(NULL AS double) FROM nation) AS u GROUP BY kind""",
    "q_set_ops": """
SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) AS i
UNION ALL SELECT 'only_documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AS e
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) AS u""",
    "q_coalesce_files": """
SELECT @sha(text) AS digest, min(source) AS source, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS sizes,
       CASE WHEN count(DISTINCT n_chars) > 1 THEN 'CONFLICT' ELSE 'OK' END AS state, min(doc_id) AS file_id FROM documents GROUP BY @sha(text)""",
    "q_pk_audit": """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "q_fk_audit": """
SELECT 'lineitem.l_orderkey' AS reference, count(*) AS violations FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'labels.doc_id', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""",
    "q_census_audit": """
SELECT c_custkey, coalesce(n, 0) AS sessions, CASE WHEN coalesce(n, 0) >= 3 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS o ON c_custkey = o_custkey""",
    "q_order_audit": """
SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) AS w
WHERE before IS NOT NULL AND turn <> before + 1""",
    # One digest per row in a fixed text form; the table's digest sorts them, so layout plays no part.
    # Sums of the rows' hashes, in four parts: any changed, lost or repeated row changes them, in whatever order rows come.
    "q_logical_digest": """
WITH r AS (SELECT @sha(concat_ws('|', @text(o_orderkey), @text(o_custkey), o_orderstatus, o_orderpriority, @text(@us(o_orderdate)))) AS h FROM orders)
SELECT substr(h, 1, 2) AS bucket, count(*) AS n, @text(sum(@hex(substr(h, 1, 15)))) AS a, @text(sum(@hex(substr(h, 16, 15)))) AS b,
       @text(sum(@hex(substr(h, 31, 15)))) AS c, @text(sum(@hex(substr(h, 46, 15)))) AS d FROM r GROUP BY substr(h, 1, 2)""",
    "q_recording_id": "SELECT doc_id, substr(@sha(concat_ws(':', source, lang, @text(doc_id))), 1, 24) AS recording_id FROM documents",
    # A path leaves its root by a step up, a start at the root, a drive, or a part that names a device, whatever its ending.
    "q_path_confined": """
WITH p AS (SELECT page_id, url, replace(lower(url), @backslash(), '/') AS path FROM pages)
SELECT page_id, url, CASE WHEN @matches(path, '(^|/)[.][.](/|$)') OR path LIKE '/%' OR @matches(path, '^[a-z]:/[^/]') THEN 'ESCAPES'
       WHEN @matches(path, '(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])([.][^/]*)?(/|$)') THEN 'RESERVED_NAME' ELSE 'CONFINED' END AS state FROM p""",
    "q_annex_parse": """
SELECT doc_id, pointer, CASE WHEN length(digest) = 64 THEN 'SHA256' WHEN length(digest) = 32 THEN 'MD5' ELSE 'INVALID' END AS algorithm, digest
FROM (SELECT doc_id, pointer, regexp_extract(pointer, 's[0-9]+--([0-9a-f]+)', 1) AS digest FROM (
  SELECT doc_id, concat('SHA256E-s', @text(n_chars), '--', CASE WHEN doc_id % 7 = 0 THEN md5(text) ELSE @sha(text) END, '.set') AS pointer FROM documents) AS p) AS q""",
    "q_tsv_clean": """
SELECT conv_id, turn, regexp_replace(upper(trim(role)), '[^A-Z]', '', 'g') AS name, length(replace(text, chr(10), '')) AS clean_length FROM conversations""".replace(", 'g')", ")"),
    # Values that JSON cannot hold (not a number, infinities) become null; what is finite stays.
    "q_json_fields": """
SELECT event_id, @json(props, '$.k') AS k, CASE WHEN @finite(x) AND abs(x) < 1e300 THEN round(x, 9) END AS value
FROM (SELECT event_id, props, CASE WHEN @json(props, '$.k') = 0 THEN @float('inf') WHEN @json(props, '$.k') = 1 THEN @float('nan') ELSE value / @json(props, '$.k') END AS x FROM events) AS e""",
    "q_manifest_verify": """
WITH files AS (SELECT doc_id AS path, @sha(text) AS digest, n_chars AS bytes FROM documents),
manifest AS (SELECT path, CASE WHEN path % 50 = 0 THEN 'changed' ELSE digest END AS digest, bytes FROM files WHERE path % 40 <> 1)
SELECT coalesce(f.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'UNLISTED' WHEN f.path IS NULL THEN 'ABSENT' WHEN f.digest <> m.digest THEN 'CHANGED' END AS problem
FROM files f FULL OUTER JOIN manifest m ON f.path = m.path WHERE m.path IS NULL OR f.path IS NULL OR f.digest <> m.digest""",
    "q_capacity_census": """
SELECT c_mktsegment AS acquisition, count(*) AS people, @count_if(n IS NULL) AS without_sessions, coalesce(sum(n), 0) AS sessions, round(coalesce(sum(b), 0), 2) AS bytes
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS b FROM orders GROUP BY o_custkey) AS o ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "q_seed_arithmetic": "SELECT event_id, 9009 + user_id * 1000003 + event_id * 17 AS seed FROM events",
}
#: Texts for Spark alone; the checking engine has its own below.
BY_DIALECT = {
    # A key has at most 40 digits in base 3, so 40 steps reach the root from any; 0 is the root and has no ancestors.
    "q_lineage_closure": """
WITH a AS (SELECT doc_id AS child, aggregate(sequence(1, 40), array(doc_id), (a, i) -> CASE WHEN element_at(a, -1) > 0 THEN concat(a, array(element_at(a, -1) div 3L)) ELSE a END) AS way FROM documents WHERE doc_id > 0)
SELECT child, max(size(way) - 1) AS depth, sum(size(way) - 1) AS ancestors, min(array_min(way)) AS root FROM a GROUP BY child""",
}


def q_lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a benchmark text whole, with the first such text.

    A text's words without its first and last, which may be parts of longer words in a document, stand there as words.
    Windows of up to four of them are joined by hash, and the pairs found are verified on the texts.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("item"))
    words = F.split("item", r"\s+")
    inner = F.least(F.lit(4), F.size(words) - 2)
    keys = items.where(inner > 0).select("item_id", inner.alias("width"), F.xxhash64(F.slice(words, F.lit(2), inner)).alias("key"))

    def windows(w):
        last = F.size(w) - F.col("width") + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, F.col("width"))))).otherwise(F.array().cast("array<bigint>"))

    wide = docs.where("text IS NOT NULL").crossJoin(F.broadcast(keys.select("width").distinct()))  # four rows at most
    split = F.transform(F.array(F.split("text", r"\s+")), windows)  # bound once: a column would be split anew for each window
    found = wide.select("doc_id", "width", F.explode(F.array_distinct(F.flatten(split))).alias("key"))
    pairs = found.join(keys, ["width", "key"]).select(F.col("doc_id").alias("child"), "item_id").distinct()
    near = pairs.join(items, "item_id").join(docs, F.col("child").eqNullSafe(F.col("doc_id")))
    short = docs.join(items.where(inner < 1), F.contains("text", "item")).select(F.col("doc_id").alias("child"), "item_id")
    every = near.where(F.contains("text", "item")).select("child", "item_id").unionByName(short)
    return every.groupBy("child").agg(F.min("item_id").alias("parent")).select("child", "parent", F.lit("reads").alias("relation"))


QUERIES, ORACLES = both(TEXTS)
QUERIES |= {k: query(v) for k, v in BY_DIALECT.items()} | {"q_lineage_edges": q_lineage_edges}
ORACLES |= {
    "q_lineage_edges": """
SELECT d.doc_id AS child, min(b.item_id) AS parent, 'reads' AS relation FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text) GROUP BY d.doc_id""",
    "q_lineage_closure": """
WITH RECURSIVE closure AS (
  SELECT doc_id AS child, doc_id // 3 AS ancestor, 1 AS depth FROM documents WHERE doc_id > 0
  UNION ALL SELECT c.child, c.ancestor // 3, c.depth + 1 FROM closure c WHERE c.ancestor > 0)
SELECT child, max(depth) AS depth, count(*) AS ancestors, min(ancestor) AS root FROM closure GROUP BY child""",
}
