"""Cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.functions.text import largest_part
from riftsplit.operators import clean
from riftsplit.queries.base import labelled_documents, query, table

KEY = r"nullif(lower(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))), '')"


def _keyed(spark, sf_dir):
    return clean.with_canonical_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("b1_canonical_key", f"SELECT doc_id, md5({KEY}) AS key_md5, CAST(length(text) AS INTEGER) AS key_length FROM documents")
def canonical_key(spark, sf_dir):
    return _keyed(spark, sf_dir).select("doc_id", F.md5("key").alias("key_md5"), "key_length")


@query("b2_drop_without_key", f"SELECT doc_id FROM documents WHERE {KEY} IS NOT NULL")
def without_key(spark, sf_dir):
    return clean.drop_without_key(_keyed(spark, sf_dir)).select("doc_id")


@query(
    "b3_drop_conflicting",
    f"""WITH d AS (SELECT doc_id, {KEY} AS k, toxic FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, toxic FROM d WHERE k IN (SELECT k FROM d WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT toxic) = 1)""",
)
def conflicting(spark, sf_dir):
    d = clean.drop_without_key(clean.with_canonical_key(labelled_documents(spark, sf_dir), "text"))
    return clean.drop_conflicting(d, "key", "toxic").select("doc_id", "toxic")


@query(
    "b4_first_per_key",
    f"""SELECT min(doc_id) AS doc_id, md5(k) AS key_md5, arg_min(source, doc_id) AS source
        FROM (SELECT *, {KEY} AS k FROM documents) WHERE k IS NOT NULL GROUP BY k""",
)
def first_rows(spark, sf_dir):
    d = clean.with_canonical_key(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text")
    d = clean.drop_without_key(d).select("key", "doc_id", "source")
    return clean.first_per_key(d, "key", "doc_id").select("doc_id", F.md5("key").alias("key_md5"), "source")


@query(
    "b5_standardize",
    f"""WITH d AS (SELECT doc_id, {KEY} AS k, toxic FROM documents JOIN labels USING (doc_id))
        SELECT min(doc_id) AS doc_id, md5(k) AS item_md5, arg_min(toxic, doc_id) AS label
        FROM d WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT toxic) = 1""",
)
def standardized(spark, sf_dir):
    out = clean.standardize(labelled_documents(spark, sf_dir), "text", "toxic", "doc_id")
    return out.select("doc_id", F.md5("item").alias("item_md5"), "label")


@query(
    "b6_largest_part",
    r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, len(regexp_extract_all(part, '[A-Za-z]')) AS t FROM p)
        SELECT doc_id, md5(part) AS part_md5 FROM s
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, length(part) DESC, i) = 1""",
)
def largest_line(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(largest_part(F.col("text"), "\n", "[A-Za-z]")).alias("part_md5"))


@query(
    "b7_downsample_majority",
    """WITH n AS (SELECT least(count_if(toxic = 0), CAST(floor(1.5 * count_if(toxic = 1)) AS BIGINT)) AS keep FROM labels)
       SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5('42:0:' || doc_id)) AS rk FROM labels WHERE toxic = 0)
       WHERE rk <= (SELECT keep FROM n) UNION ALL SELECT doc_id, toxic FROM labels WHERE toxic = 1""",
)
def downsampled(spark, sf_dir):
    return clean.downsample_majority(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("b8_union_distinct", "SELECT p_name AS item FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part")
def union_of_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return clean.union_distinct([p.select(F.col(c).alias("item")) for c in ("p_name", "p_type", "p_brand")], "item")


@query(
    "b9_drop_missing_metrics",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS metric_a,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS metric_b FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'""",
)
def complete_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("metric_a"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("metric_b"),
    )
    return clean.drop_missing(o, ["metric_a", "metric_b"])
