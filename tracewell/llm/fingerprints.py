"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

A text is cut into sections after blank lines, into paragraphs after line ends, and into phrases after words chosen by
their hash; the cuts keep every character. A phrase's node, a leaf, is the MD5 of its text; a paragraph's node is the
SHA-256 of its phrases' nodes, a section's that of its paragraphs' nodes, the root's that of the sections' nodes. Roots are
equal if and only if texts are (up to collisions), where two trees differ the differing branches locate the edit, and as
phrases are cut by content, the leaves that two trees share tell how much of their text they share.

Defined cases: a null text counts as the empty text; likeness is 1 for equal roots, else the share of leaves in both trees
among those in either; repeated keys are ordered by text; null keys come last; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import partitions, range_bounds, range_bucket
from tracewell.session import table

CUT = "\u0001"
#: A phrase ends after each word whose MD5 begins with a smaller digit than this: about every fifth word.
PHRASE_END = "3"


def sections(text: Column) -> Column:
    """array<array<string>>: paragraphs of sections; joined they give the text back (CUT escaped)."""
    escaped = F.replace(text, F.lit(CUT), F.lit(CUT + "\u0002"))
    parts = F.split(F.replace(escaped, F.lit("\n\n"), F.lit("\n\n" + CUT)), CUT)
    return F.transform(parts, lambda s: F.split(F.replace(s, F.lit("\n"), F.lit("\n" + CUT)), CUT))


def phrases(paragraph: Column) -> Column:
    """array<string>: runs of words that end at words chosen by their hash; joined they give the paragraph back."""
    ended = F.transform(F.split(paragraph, " "), lambda w: F.when(F.substring(F.md5(w), 1, 1) < PHRASE_END, F.concat(w, F.lit(CUT))).otherwise(w))
    return F.filter(F.split(F.array_join(ended, " "), CUT), lambda p: p != "")


def tree(text: Column) -> Column:
    """struct<sections: array<struct<node, paragraphs: array<struct<node, phrases: array<string>>>>>, leaves: array<string>>."""
    over = lambda nodes: F.sha2(F.array_join(nodes, ""), 256)
    leaves = F.transform(sections(F.coalesce(text, F.lit(""))), lambda s: F.transform(s, lambda p: F.transform(phrases(p), lambda q: F.md5(q))))

    def grow(nodes: Column) -> Column:
        paragraphs = F.transform(nodes, lambda s: F.transform(s, lambda p: F.struct(over(p).alias("node"), p.alias("phrases"))))
        branches = F.transform(paragraphs, lambda s: F.struct(over(F.transform(s, lambda p: p["node"])).alias("node"), s.alias("paragraphs")))
        return F.struct(branches.alias("sections"), F.array_distinct(F.flatten(F.flatten(nodes))).alias("leaves"))

    return F.get(F.transform(F.array(leaves), grow), F.lit(0))  # bound once: used twice, it would be made twice


def root(tree_column: Column) -> Column:
    return F.sha2(F.array_join(F.transform(tree_column["sections"], lambda s: s["node"]), ""), 256)


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """1 for equal roots; else shared leaves over all leaves."""
    both = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    either = F.size(a["leaves"]) + F.size(b["leaves"]) - both
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, either), F.lit(0.0))).cast("double")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns `tree` and `fingerprint` (the root)."""
    return docs.withColumn("tree", tree(F.col(text))).withColumn("fingerprint", root(F.col("tree")))


def locate_edits(pairs: DataFrame, a: str = "tree_a", b: str = "tree_b") -> DataFrame:
    """pairs with `edits`: array<struct<section, paragraph>> of a's paragraphs whose node is not in b's section there.

    Sections with equal nodes are passed over whole: only differing branches are walked.
    """
    at = lambda t, i: F.get(F.col(t)["sections"], i)
    n = F.greatest(F.size(F.col(a)["sections"]), F.size(F.col(b)["sections"]))
    differing = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~at(a, i)["node"].eqNullSafe(at(b, i)["node"]))

    def inside(i: Column) -> Column:
        x, y = (F.coalesce(F.transform(at(t, i)["paragraphs"], lambda p: p["node"]), F.array().cast("array<string>")) for t in (a, b))
        last = F.greatest(F.size(x), F.size(y)) - 1
        changed = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.transform(changed, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return pairs.withColumn("edits", F.flatten(F.transform(differing, inside)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending key order; after the last comes the first.

    Rows are dealt to ranges of the key, and the first row of each range also visits the range before it, so every
    window is a bounded range and no row passes through a single task.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", 3 * partitions(docs.sparkSession))
    if not bounds:  # no row has a key
        bounds = [0]
    last = len(bounds)  # null keys get a range of their own, after the smallest keys
    at = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(last - 1) - range_bucket(F.col("doc_id"), bounds))
    rows = rows.withColumn("range", at.cast("int"))
    heads = rows.where(F.col("doc_id").isNull()).limit(1).count()
    ranges = last + (1 if heads else 0)
    # A bound is the largest key of its range: its rows are the range's first ones.
    is_head = F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(
        F.col("doc_id") == F.get(F.split(F.lit(",".join(map(str, reversed(bounds)))), ",").cast("array<bigint>"), F.col("range"))
    )
    before = (F.col("range") + (ranges - 1)) % ranges
    visits = F.when(is_head, F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest")), F.struct(before.cast("int").alias("at"), F.lit(1).alias("guest"))))
    visits = visits.otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest"))))
    dealt = rows.withColumn("visit", F.explode(visits)).select("doc_id", "text", "visit.at", "visit.guest")
    order = W.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    trees = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("changed"), tree(F.col("next_text")).alias("next"),
    )
    roots = trees.withColumns({"fingerprint": root(F.col("own")), "edited_fingerprint": root(F.col("changed")), "next_root": root(F.col("next"))})
    return roots.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("fingerprint"), F.col("next_root")).alias("near_next"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, length(text)::BIGINT AS n_chars FROM d
      WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n),
v AS (SELECT doc_id, n_chars, 1 AS k, text AS t FROM e UNION ALL SELECT doc_id, n_chars, 2, edited FROM e UNION ALL SELECT doc_id, n_chars, 3, next_text FROM e),
p AS (SELECT doc_id, n_chars, k, t,
        list_transform(string_split(replace(replace(t, chr(1), chr(1) || chr(2)), chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1)),
          lambda s: list_transform(string_split(replace(s, chr(10), chr(10) || chr(1)), chr(1)),
            lambda p: list_transform(list_filter(string_split(array_to_string(list_transform(string_split(p, ' '),
              lambda w: CASE WHEN substr(md5(w), 1, 1) < '3' THEN w || chr(1) ELSE w END), ' '), chr(1)), lambda q: q <> ''), lambda q: md5(q)))) AS nodes
      FROM v),
f AS (SELECT doc_id, n_chars, k, t,
        sha256(array_to_string(list_transform(nodes, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), '')) AS root,
        list_distinct(flatten(flatten(nodes))) AS leaves FROM p),
g AS (SELECT a.doc_id, a.n_chars, sha256(b.t) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint, c.root AS next_root,
             a.leaves AS la, len(list_intersect(a.leaves, b.leaves)) AS ib, len(list_intersect(a.leaves, c.leaves)) AS ic, len(b.leaves) AS lb, len(c.leaves) AS lc
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2 JOIN f c ON a.doc_id = c.doc_id AND c.k = 3)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE coalesce(ib::DOUBLE / nullif(len(la) + lb - ib, 0), 0) END AS near_edited,
       CASE WHEN fingerprint = next_root THEN 1.0::DOUBLE ELSE coalesce(ic::DOUBLE / nullif(len(la) + lc - ic, 0), 0) END AS near_next
FROM g
"""
