"""Queries of the general data problems 1, 2, 3 and 5, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ids import ACCESSION_SQL, GO_SQL, canonical_accession, canonical_go
from seqweave.operators.heavy_keys import per_key_totals
from seqweave.operators.hierarchy import Resolved, descendants, forest_paths, ring_members
from seqweave.operators.intervals import islands_and_gaps
from seqweave.operators.references import orphan_references
from seqweave.plans.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for name, col, rule, parent, key in (
        ("prosite_entries", "uniprot_id", canonical_accession, "proteins", "entry"),
        ("uniprot_quickgo_annotations", "uniprot_id", canonical_accession, "proteins", "entry"),
        ("interpro_go_mapping", "go_id", canonical_go, "go_terms", "go_id"),
    ):
        refs = table(spark, d, name).select(F.lit(name).alias("src_table"), F.date_format("loaded_at", "yyyy-MM").alias("period"), "row_id", rule(col).alias("ref"), "loaded_at")
        out.append((refs, table(spark, d, parent), key))
    proteins = out[0][0].unionByName(out[1][0])
    spec = dict(ref_key="ref", ref_time="loaded_at", parent_first="loaded_at", parent_gone="deleted_at", carry=["src_table", "period", "row_id"])
    return orphan_references(proteins, out[0][1], parent_key="entry", **spec).unionByName(orphan_references(out[2][0], out[2][1], parent_key="go_id", **spec))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "period", "row_id")


def p1_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("src_table", "period", "reason").agg(F.count("*").alias("n_rows"))


_P1_ROWS = f"""
WITH prot AS (SELECT entry AS k, min(loaded_at) AS first, min(deleted_at) AS gone FROM proteins GROUP BY 1),
     term AS (SELECT go_id AS k, min(loaded_at) AS first, min(deleted_at) AS gone FROM go_terms GROUP BY 1),
     refs AS (
  SELECT 'prosite_entries' AS src_table, row_id, loaded_at, {ACCESSION_SQL.format(c="uniprot_id")} AS k, 0 AS kind FROM prosite_entries UNION ALL
  SELECT 'uniprot_quickgo_annotations', row_id, loaded_at, {ACCESSION_SQL.format(c="uniprot_id")}, 0 FROM uniprot_quickgo_annotations UNION ALL
  SELECT 'interpro_go_mapping', row_id, loaded_at, {GO_SQL.format(c="go_id")}, 1 FROM interpro_go_mapping),
     parents AS (SELECT 0 AS kind, * FROM prot UNION ALL SELECT 1, * FROM term),
     judged AS (
  SELECT r.src_table, strftime(r.loaded_at, '%Y-%m') AS period, r.row_id,
         CASE WHEN p.k IS NULL THEN 'absent' WHEN r.loaded_at >= p.gone THEN 'withdrawn' WHEN r.loaded_at < p.first THEN 'not_yet' END AS reason
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.k = r.k WHERE r.k IS NOT NULL)
"""


def _key_totals(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    go, ipr = table(spark, d, "uniprot_quickgo_annotations"), table(spark, d, "interpro_entries")
    return [
        ("uniprot_quickgo_annotations", go, per_key_totals(go.select(canonical_go("go_id").alias("key_id")), "key_id")),
        ("interpro_entries", ipr, per_key_totals(ipr.select("interpro_id", (F.col("end_index").cast("long") - F.col("start_index") + 1).alias("residues")), "interpro_id", "residues")),
    ]


def p2_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("src_table"), "key_id", "n_rows", F.col("total").cast("long").alias("total_residues")) for n, _, t in _key_totals(spark, d)])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.filter(F.col("n_rows") * 50 >= df.count()).select(F.lit(n).alias("src_table"), "key_id") for n, df, t in _key_totals(spark, d)])


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = forest_paths(table(spark, d, "vocab_entries"), "config_id", "token_id", "token", "parent")
    below = descendants(paths).groupBy("g", F.col("ancestor").alias("name")).agg(F.count("*").alias("n"))
    return paths.join(below, ["g", "name"], "left").select(F.col("g").alias("config_id"), F.col("id").cast("int").alias("token_id"), F.col("name").alias("token"), F.col("depth").cast("int").alias("depth"), "root", F.array_join("path", " > ").alias("path"), F.when(F.col("path").isNotNull(), F.coalesce("n", F.lit(0))).alias("n_descendants"), "status")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    paths = forest_paths(table(spark, d, "vocab_entries"), "config_id", "token_id", "token", "parent")
    return descendants(paths).select(F.col("g").alias("config_id"), "ancestor", "descendant", F.col("distance").cast("int").alias("distance"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab_entries")
    known = Resolved(v, "config_id", "token_id", "token", {"parent": [v["parent"]], "pair": [F.get("pair", F.lit(0)), F.get("pair", F.lit(1))]})
    return ring_members(known).select(F.col("g").alias("config_id"), F.col("kind").alias("link_kind"), F.col("id").cast("int").alias("token_id"))


_P3_WALK = """
WITH RECURSIVE v AS (SELECT config_id, token, min(token_id) AS token_id, min(parent) AS parent FROM vocab_entries GROUP BY 1, 2),
e AS (SELECT c.config_id, c.token, c.token_id, p.token AS up FROM v c LEFT JOIN v p ON p.config_id = c.config_id AND p.token = c.parent),
down AS (
  SELECT config_id, token, token_id, token AS root, 0 AS depth, [token] AS path FROM e WHERE up IS NULL
  UNION ALL
  SELECT e.config_id, e.token, e.token_id, d.root, d.depth + 1, list_append(d.path, e.token) FROM e JOIN down d ON e.config_id = d.config_id AND e.up = d.token),
climb AS (
  SELECT config_id, token AS start, up AS here FROM e WHERE up IS NOT NULL AND (config_id, token) NOT IN (SELECT config_id, token FROM down)
  UNION
  SELECT c.config_id, c.start, e.up FROM climb c JOIN e ON e.config_id = c.config_id AND e.token = c.here WHERE e.up IS NOT NULL),
below AS (SELECT config_id, a AS token, count(*) AS n FROM (SELECT config_id, token, unnest(path) AS a FROM down) WHERE a <> token GROUP BY 1, 2)
"""

_P5 = f"""
WITH i AS (SELECT {ACCESSION_SQL.format(c="uniprot_id")} AS uniprot_id, start_index::BIGINT AS s, end_index::BIGINT AS t FROM interpro_entries
           WHERE uniprot_id IS NOT NULL AND start_index >= 1 AND end_index >= start_index),
m AS (SELECT *, max(t) OVER (PARTITION BY uniprot_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM i),
l AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY uniprot_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS isl FROM m),
c AS (SELECT uniprot_id, isl, min(s) AS s, max(t) AS t FROM l GROUP BY 1, 2),
g AS (SELECT uniprot_id, t + 1 AS s, lead(s) OVER (PARTITION BY uniprot_id ORDER BY s) - 1 AS t FROM c),
r AS (SELECT uniprot_id, 'covered' AS kind, s AS start_index, t AS end_index FROM c UNION ALL SELECT uniprot_id, 'gap', s, t FROM g WHERE t IS NOT NULL)
"""


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "interpro_entries").select(canonical_accession("uniprot_id").alias("uniprot_id"), "start_index", "end_index")
    return islands_and_gaps(i, "uniprot_id", "start_index", "end_index", min_start=1).withColumnRenamed("entity_id", "uniprot_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d)


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end_index") - F.col("start_index") + 1
    covered = F.col("kind") == "covered"
    return _stretches(spark, d).groupBy("uniprot_id").agg(F.count_if(covered).alias("n_stretches"), F.count_if(~covered).alias("n_gaps"), F.sum(F.when(covered, length).otherwise(0)).alias("covered_residues"), F.sum(F.when(~covered, length).otherwise(0)).alias("gap_residues"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_period, p2_found, p2_key_totals, p3_found, p3_paths, p3_descendants, p5_found, p5_coverage)}

_COUNTS = f"""
WITH k AS (
  SELECT 'uniprot_quickgo_annotations' AS src_table, {GO_SQL.format(c="go_id")} AS key_id, 0 AS r FROM uniprot_quickgo_annotations UNION ALL
  SELECT 'interpro_entries', interpro_id, coalesce(end_index::BIGINT - start_index + 1, 0) FROM interpro_entries),
n AS (SELECT src_table, count(*) AS n FROM k GROUP BY 1)
"""

SQL = {
    "p1_found": _P1_ROWS + "SELECT src_table, period, row_id FROM judged WHERE reason IS NOT NULL",
    "p1_orphans_by_period": _P1_ROWS + "SELECT src_table, period, reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p2_found": _COUNTS + "SELECT k.src_table, key_id FROM k JOIN n USING (src_table) WHERE key_id IS NOT NULL GROUP BY 1, 2, n.n HAVING count(*) * 50 >= n.n",
    "p2_key_totals": _COUNTS + "SELECT src_table, key_id, count(*) AS n_rows, sum(r)::BIGINT AS total_residues FROM k WHERE key_id IS NOT NULL GROUP BY 1, 2",
    "p3_found": """
WITH RECURSIVE v AS (SELECT DISTINCT config_id, token_id, token, parent, pair FROM vocab_entries),
l AS (SELECT config_id, 'parent' AS link_kind, token_id, parent AS name FROM v UNION ALL
      SELECT config_id, 'pair', token_id, unnest(pair) FROM v),
e AS (SELECT DISTINCT l.config_id, l.link_kind, l.token_id AS a, v.token_id AS b FROM l JOIN v ON v.config_id = l.config_id AND v.token = l.name),
up AS (SELECT config_id, link_kind, a, b FROM e WHERE b >= a),
reach AS (SELECT config_id, link_kind, a AS start, b AS here FROM up
          UNION SELECT r.config_id, r.link_kind, r.start, e.b FROM reach r JOIN e ON e.config_id = r.config_id AND e.link_kind = r.link_kind AND e.a = r.here),
ringed AS (SELECT DISTINCT config_id, link_kind, start FROM reach WHERE here = start),
back AS (SELECT config_id, link_kind, start, start AS here FROM ringed
         UNION SELECT k.config_id, k.link_kind, k.start, e.a FROM back k JOIN e ON e.config_id = k.config_id AND e.link_kind = k.link_kind AND e.b = k.here)
SELECT DISTINCT k.config_id, k.link_kind, k.here AS token_id FROM back k
JOIN (SELECT config_id, link_kind, start, here FROM reach UNION SELECT config_id, link_kind, start, start FROM ringed) r
  ON r.config_id = k.config_id AND r.link_kind = k.link_kind AND r.start = k.start AND r.here = k.here""",
    "p3_paths": _P3_WALK
    + """
SELECT d.config_id, d.token_id, d.token, d.depth, d.root, array_to_string(d.path, ' > ') AS path, coalesce(b.n, 0) AS n_descendants, 'tree' AS status
FROM down d LEFT JOIN below b ON b.config_id = d.config_id AND b.token = d.token
UNION ALL
SELECT e.config_id, e.token_id, e.token, NULL, NULL, NULL, NULL,
       CASE WHEN (e.config_id, e.token) IN (SELECT config_id, start FROM climb WHERE here = start) THEN 'ring' ELSE 'leads_to_ring' END
FROM e WHERE (e.config_id, e.token) NOT IN (SELECT config_id, token FROM down)""",
    "p3_descendants": _P3_WALK + "SELECT config_id, a AS ancestor, token AS descendant, depth - i AS distance FROM (SELECT config_id, token, depth, unnest(path) AS a, generate_subscripts(path, 1) - 1 AS i FROM down) WHERE i < depth",
    "p5_found": _P5 + "SELECT * FROM r",
    "p5_coverage": _P5
    + "SELECT uniprot_id, count(*) FILTER (kind = 'covered') AS n_stretches, count(*) FILTER (kind = 'gap') AS n_gaps, coalesce(sum(end_index - start_index + 1) FILTER (kind = 'covered'), 0)::BIGINT AS covered_residues, coalesce(sum(end_index - start_index + 1) FILTER (kind = 'gap'), 0)::BIGINT AS gap_residues FROM r GROUP BY 1",
}
