"""Queries of the training-text problems, with their SQL where SQL can tell."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ids import ACCESSION_SQL, GO_SQL, canonical_accession, canonical_go
from seqweave.llm.cooccurrence import PairTable
from seqweave.llm.leaks import leaked_items
from seqweave.llm.packing import pack, token_counts
from seqweave.llm.shared_spans import shared_spans
from seqweave.llm.spam import incoherent_documents
from seqweave.session import new_path, written

#: Folder of the public tokenizers' files; a parameter of the environment.
TOKENIZERS = os.environ.get("SEQWEAVE_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    """The annotations as two deliveries: what came before the middle of the time
    they were loaded in, and the rest."""
    rows = _table(spark, d, "uniprot_quickgo_annotations").select(canonical_accession("uniprot_id").alias("basket"), canonical_go("go_id").alias("item"), "loaded_at")
    low, high = rows.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    pairs = PairTable(spark, new_path(spark, "pairs"))
    late = F.lit(True) if low is None else F.coalesce(F.col("loaded_at") > F.lit(low + (high - low) / 2), F.lit(True))
    for part in (~late, late):
        pairs.rescore(pairs.update(rows.filter(part).select("basket", "item")))
    return pairs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pair_table(spark, d)
    strong = pairs.scores(min_joint=6).filter(F.col("joint") * F.col("n_baskets") >= 6 * F.col("n_a") * F.col("n_b"))
    return strong.select(F.col("a").alias("go_id_a"), F.col("b").alias("go_id_b"))


def p4_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _pair_table(spark, d).scores()
    return s.select(F.col("a").alias("go_id_a"), F.col("b").alias("go_id_b"), F.col("joint").alias("n_both"), "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


_P4 = f"""
WITH t AS (SELECT DISTINCT {ACCESSION_SQL.format(c="uniprot_id")} AS u, {GO_SQL.format(c="go_id")} AS g FROM uniprot_quickgo_annotations WHERE uniprot_id IS NOT NULL),
n AS (SELECT count(DISTINCT u) AS n FROM t), m AS (SELECT g, count(*) AS c FROM t WHERE g IS NOT NULL GROUP BY 1),
j AS (SELECT x.g AS a, y.g AS b, count(*) AS j FROM t x JOIN t y ON x.u = y.u AND x.g < y.g GROUP BY 1, 2),
s AS (SELECT a AS go_id_a, b AS go_id_b, j, ma.c AS n_a, mb.c AS n_b, n.n FROM j JOIN m ma ON ma.g = a JOIN m mb ON mb.g = b CROSS JOIN n)
"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    named = lambda t, k: _table(spark, d, t).select(F.lit(t).alias("src_table"), F.col(k).alias("record_id"), "sequence")
    return named("proteins", "entry").unionByName(named("uniref50_representatives", "id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(_sequences(spark, d), "src_table", "record_id", "sequence", span=40).select(F.col("src").alias("src_table"), F.col("id").alias("record_id"), "span_start", "span_end")


def p6_shared_share(spark: SparkSession, d: str) -> DataFrame:
    """Per record with a shared span: how much of it stands elsewhere."""
    spans = p6_found(spark, d).groupBy("src_table", "record_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared"))
    lengths = _sequences(spark, d).filter("sequence IS NOT NULL").groupBy("src_table", "record_id").agg(F.max(F.length("sequence")).alias("length"))
    return spans.join(lengths, ["src_table", "record_id"]).select("src_table", "record_id", "n_spans", "shared", "length", F.round(F.col("shared") / F.col("length"), 6).alias("share"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return written(token_counts(_table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), "sizes")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    out, _ = pack(_sizes(spark, d), capacity=2048)
    return out.withColumnRenamed("id", "doc_id")


def p7_certificate(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), capacity=2048)[1]


def _leaks(spark: SparkSession, d: str, **args) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="text", **args)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, min_match=12).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, min_match=5, min_coverage=0.2)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return incoherent_documents(_table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).filter(F.col("n_spam_words") * 2 > F.col("n_words")).select("doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_pair_scores, p6_found, p6_shared_share, p7_containers, p7_certificate, p8_found, p8_coverage, p9_found, p9_shares)}

_P6 = """
WITH r AS (SELECT 'proteins' AS src_table, entry AS record_id, max(sequence) AS s FROM proteins WHERE sequence IS NOT NULL GROUP BY 1, 2
           UNION ALL SELECT 'uniref50_representatives', id, max(sequence) FROM uniref50_representatives WHERE sequence IS NOT NULL GROUP BY 1, 2),
w AS (SELECT src_table, record_id, k, s[k : k + 39] AS g FROM (SELECT *, unnest(range(1, length(s) - 38)) AS k FROM r)),
m AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT src_table || ' ' || record_id) > 1),
h AS (SELECT src_table, record_id, k FROM w JOIN m USING (g)),
l AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY src_table, record_id ORDER BY k) <= 40 THEN 0 ELSE 1 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY src_table, record_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM l),
f AS (SELECT src_table, record_id, min(k)::BIGINT AS span_start, (max(k) + 39)::BIGINT AS span_end FROM i GROUP BY src_table, record_id, isl)
"""

_WORD_LIST = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

SQL = {
    "p4_found": _P4 + "SELECT go_id_a, go_id_b FROM s WHERE j >= 6 AND j * n >= 6 * n_a * n_b",
    "p4_pair_scores": _P4 + "SELECT go_id_a, go_id_b, j AS n_both, n_a, n_b, round(j * n / (n_a * n_b)::DOUBLE, 6) AS lift, round(ln(j * n / (n_a * n_b)::DOUBLE), 6) AS pmi, round(j / (n_a + n_b - j)::DOUBLE, 6) AS jaccard FROM s",
    "p6_found": _P6 + "SELECT * FROM f",
    "p6_shared_share": _P6 + "SELECT src_table, record_id, count(*) AS n_spans, sum(span_end - span_start + 1)::BIGINT AS shared, any_value(length(s)) AS length, round(sum(span_end - span_start + 1) / any_value(length(s))::DOUBLE, 6) AS share FROM f JOIN r USING (src_table, record_id) GROUP BY 1, 2",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORD_LIST} AS w FROM eval_items WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
t AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM t JOIN s USING (g)""",
}
