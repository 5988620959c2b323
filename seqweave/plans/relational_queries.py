"""Scans, filters, joins, aggregations, windows, sorts, set and nested operators
over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.functions.ids import ACCESSION_SQL, GO_SQL, canonical_accession, canonical_go
from seqweave.functions.sequences import config_name, config_parts, features, hashed_number, interval_list, kmers, symbols
from seqweave.operators import corpus as C
from seqweave.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources, projections, filters


@query("SELECT entry AS uniprot_id, seq_length AS n FROM proteins WHERE organism_id = 9000000")
def scan_projection_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "proteins").filter("organism_id = 9000000").select(F.col("entry").alias("uniprot_id"), F.col("seq_length").alias("n"))


_LETTERS = " AND ".join(f"length(sequence) - length(replace(sequence, '{x}', '')) <= 1" for x in C.RARE)


@query(f"SELECT entry, length(sequence) AS n FROM proteins WHERE length(sequence) BETWEEN 1 AND 3000 AND {_LETTERS}")
def corpus_quality_filter(s: SparkSession, d: str) -> DataFrame:
    return C.quality_filter(table(s, d, "proteins").select("entry", "sequence"), "sequence").select("entry", F.length("sequence").alias("n"))


@query(f"SELECT row_id FROM prosite_entries WHERE {ACCESSION_SQL.format(c='uniprot_id')} NOT IN (SELECT entry FROM proteins WHERE length(sequence) > 800)")
def sliced_corpus_filter(s: SparkSession, d: str) -> DataFrame:
    slices = table(s, d, "prosite_entries").select("row_id", canonical_accession("uniprot_id").alias("entry"))
    return C.without_long_parents(slices, "entry", table(s, d, "proteins"), "entry", "sequence", 800).select("row_id")


@query("SELECT entry, CASE WHEN length(sequence) < 1000 AND length(sequence) > 0 THEN 'experiment' WHEN length(sequence) < 3000 THEN 'export' WHEN length(sequence) = 3000 THEN 'train' ELSE 'none' END AS use_class, coalesce(sequence LIKE '%XX%', false) AS has_gap, coalesce(starts_with(protein_names, 'Gly'), false) AS named FROM proteins")
def length_classes(s: SparkSession, d: str) -> DataFrame:
    n = F.length("sequence")
    use = F.when((n < 1000) & (n > 0), "experiment").when(n < 3000, "export").when(n == 3000, "train").otherwise("none")
    return table(s, d, "proteins").select("entry", use.alias("use_class"), F.coalesce(F.contains("sequence", F.lit("XX")), F.lit(False)).alias("has_gap"), F.coalesce(F.startswith("protein_names", F.lit("Gly")), F.lit(False)).alias("named"))


#: Experimental evidence codes (fixed values).
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")


@query(f"SELECT row_id, go_evidence FROM uniprot_quickgo_annotations WHERE go_evidence IN {EXPERIMENTAL} AND qualifier IS NOT NULL")
def experimental_evidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "uniprot_quickgo_annotations").filter(F.col("go_evidence").isin(*EXPERIMENTAL)).dropna(subset=["qualifier"]).select("row_id", "go_evidence")


@query("SELECT row_id, score FROM prosite_entries WHERE NOT coalesce(score > 20 OR score < 5, false)")
def score_outliers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prosite_entries").filter(~F.coalesce((F.col("score") > 20) | (F.col("score") < 5), F.lit(False))).select("row_id", "score")


@query("SELECT entry, split_part(protein_names, ' ', 1) AS first_word, split_part(protein_names, ' ', -1) AS last_word, regexp_extract(protein_names, '([0-9]+)$', 1) AS number, regexp_replace(protein_names, 'ase\\b', 'ASE', 'g') AS marked, len(string_split(protein_names, ' '))::INT AS words FROM proteins WHERE protein_names IS NOT NULL")
def name_parts(s: SparkSession, d: str) -> DataFrame:
    c = F.col("protein_names")
    return table(s, d, "proteins").filter(c.isNotNull()).select("entry", F.split_part(c, F.lit(" "), F.lit(1)).alias("first_word"), F.split_part(c, F.lit(" "), F.lit(-1)).alias("last_word"), F.regexp_extract(c, "([0-9]+)$", 1).alias("number"), F.regexp_replace(c, r"ase\b", "ASE").alias("marked"), F.size(F.split(c, " ")).alias("words"))


_CONFIG_SQL = "^([^_]+)_([^_]+)_(mutbpe|bpe)_(?:([0-9.]+)_([0-9]+)_([0-9]+)_([0-9.]+)_)?([0-9]+)(?:_(.*))?$"


@query(
    "SELECT DISTINCT config_id, "
    + ", ".join(f"{e} AS {n}" for n, e in (("corpus", f"regexp_extract(config_id, '{_CONFIG_SQL}', 1)"), ("matrix", f"regexp_extract(config_id, '{_CONFIG_SQL}', 2)"), ("is_bpe", f"regexp_extract(config_id, '{_CONFIG_SQL}', 3) = 'bpe'"), ("sim_cutoff", f"nullif(regexp_extract(config_id, '{_CONFIG_SQL}', 4), '')::DOUBLE"), ("freq_cutoff", f"nullif(regexp_extract(config_id, '{_CONFIG_SQL}', 7), '')::DOUBLE"), ("v_size", f"nullif(regexp_extract(config_id, '{_CONFIG_SQL}', 8), '')::INT")))
    + ", regexp_replace(config_id, '_r[0-9]+$', '') AS label FROM vocab_entries"
)
def config_name_parse(s: SparkSession, d: str) -> DataFrame:
    p = config_parts("config_id")
    return table(s, d, "vocab_entries").select("config_id").distinct().select("config_id", p["corpus"].alias("corpus"), p["matrix"].alias("matrix"), p["is_bpe"].alias("is_bpe"), p["sim_cutoff"].alias("sim_cutoff"), p["freq_cutoff"].alias("freq_cutoff"), p["v_size"].alias("v_size"), F.regexp_replace("config_id", "_r[0-9]+$", "").alias("label"))


@query("SELECT 'uniref50_' || m || CASE WHEN c IS NULL THEN '_bpe_' || z ELSE '_mutbpe_' || c || '_3_12_' || f || '_' || z END AS config FROM (VALUES ('blosum62'), ('pam70')) a(m) CROSS JOIN (VALUES ('0.7', '0.05'), ('0.8', '0.1'), (NULL, NULL)) b(c, f) CROSS JOIN (SELECT 800 * 2 ** k::INT AS z0, CAST(800 * pow(2, k) AS INT)::VARCHAR AS z FROM range(7) r(k))")
def config_grid(s: SparkSession, d: str) -> DataFrame:
    mats = s.createDataFrame([("blosum62",), ("pam70",)], "m string")
    cuts = s.createDataFrame([("0.7", "0.05"), ("0.8", "0.1"), (None, None)], "c string, f string")
    sizes = s.range(7).select((F.lit(800) * F.pow(F.lit(2), "id")).cast("int").cast("string").alias("z"))
    grid = mats.crossJoin(cuts).crossJoin(sizes)  # parameter grid of fixed size
    plain = config_name(F.lit("uniref50"), F.col("m"), F.col("z"))
    full = config_name(F.lit("uniref50"), F.col("m"), F.col("z"), F.col("c"), F.lit("3"), F.lit("12"), F.col("f"))
    return grid.select(F.when(F.col("c").isNull(), plain).otherwise(full).alias("config"))


@query(
    r"""SELECT entry, a::INT AS start_index, b::INT AS end_index, nullif(regexp_extract(attrs, '/note="([^"]*)"', 1), '') AS note, nullif(regexp_extract(attrs, '/evidence="([^"]*)"', 1), '') AS evidence
FROM (SELECT entry, unnest(regexp_extract_all(region_ft, 'REGION ([0-9]+)\.\.([0-9]+)((?:; /[a-z]+="[^"]*")*)', 1)) AS a, unnest(regexp_extract_all(region_ft, 'REGION ([0-9]+)\.\.([0-9]+)((?:; /[a-z]+="[^"]*")*)', 2)) AS b,
             unnest(regexp_extract_all(region_ft, 'REGION ([0-9]+)\.\.([0-9]+)((?:; /[a-z]+="[^"]*")*)', 3)) AS attrs FROM proteins)"""
)
def feature_string_explode(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "proteins").select("entry", F.inline(features("region_ft", "REGION")))


@query("SELECT row_id, CAST(split_part(x, '-', 1) AS INT) AS start_index, CAST(split_part(x, '-', 2) AS INT) AS end_index FROM (SELECT row_id, unnest(string_split(sequence_start || '-' || (sequence_start + 4) || '_' || (sequence_end - 3) || '-' || sequence_end, '_')) AS x FROM prosite_entries WHERE sequence_start IS NOT NULL AND sequence_end IS NOT NULL)")
def interval_split(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("sequence_start"), F.col("sequence_end")
    chop = F.concat_ws("_", F.concat_ws("-", a, a + 4), F.concat_ws("-", b - 3, b))
    return table(s, d, "prosite_entries").dropna(subset=["sequence_start", "sequence_end"]).select("row_id", F.inline(interval_list(chop)))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k IS NOT NULL")


@query("SELECT uniprot_id, interpro_id, start_index, db, entry_type, array_length(member_databases)::INT AS n_db FROM (SELECT *, unnest(member_databases) AS db FROM interpro_entries) WHERE entry_type IS NOT NULL")
def nested_member_databases(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "interpro_entries").filter("entry_type IS NOT NULL")
    return i.select("uniprot_id", "interpro_id", "start_index", F.explode("member_databases").alias("db"), "entry_type", F.size("member_databases").alias("n_db"))


# ---------------------------------------------------------------- joins


@query("SELECT entry FROM proteins WHERE entry IN (SELECT unique_identifier FROM uniref50_representatives WHERE members > 1)")
def semi_join_distilled(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "uniref50_representatives").filter("members > 1").select(F.col("unique_identifier").alias("entry"))
    return table(s, d, "proteins").join(u, "entry", "left_semi").select("entry")


@query(f"SELECT entry FROM proteins WHERE entry NOT IN (SELECT {ACCESSION_SQL.format(c='uniprot_id')} FROM uniprot_quickgo_annotations WHERE uniprot_id IS NOT NULL)")
def anti_join_unannotated(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").select(canonical_accession("uniprot_id").alias("entry"))
    return table(s, d, "proteins").join(q, "entry", "left_anti").select("entry")


@query(f"SELECT p.entry, q.go, q.n FROM (SELECT DISTINCT entry FROM proteins) p JOIN (SELECT {ACCESSION_SQL.format(c='uniprot_id')} AS entry, {GO_SQL.format(c='go_id')} AS go, count(*) AS n FROM uniprot_quickgo_annotations GROUP BY 1, 2) q USING (entry)")
def inner_join_annotations(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").groupBy(canonical_accession("uniprot_id").alias("entry"), canonical_go("go_id").alias("go")).agg(F.count("*").alias("n"))
    return table(s, d, "proteins").select("entry").distinct().join(q, "entry")


# ---------------------------------------------------------------- aggregations


@query("SELECT DISTINCT unnest(string_split(sequence, '')) AS symbol FROM proteins WHERE sequence <> ''")
def alphabet(s: SparkSession, d: str) -> DataFrame:
    return C.alphabet(table(s, d, "proteins"), "sequence")


_PAIRS = "SELECT substr(sequence, i, 1) AS \"left\", substr(sequence, i + 1, 1) AS \"right\", count(*) AS cnt FROM (SELECT sequence, unnest(range(1, length(sequence))) AS i FROM {t}) GROUP BY 1, 2"


@query(_PAIRS.format(t="uniref50_representatives"))
def adjacent_pair_counts(s: SparkSession, d: str) -> DataFrame:
    return C.adjacent_pairs(table(s, d, "uniref50_representatives"))


@query(f"SELECT * FROM ({_PAIRS.format(t='uniref50_representatives')}) ORDER BY cnt DESC, 1, 2 LIMIT 25")
def top_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.adjacent_pairs(table(s, d, "uniref50_representatives")).orderBy(F.desc("cnt"), "left", "right").limit(25)


@query("SELECT k, token, count(*) AS cnt FROM (SELECT k, unnest(list_transform(range(1, length(sequence) + 1, k), lambda i: substr(sequence, i, k))) AS token FROM proteins CROSS JOIN (VALUES (3), (4)) v(k) WHERE length(sequence) > 0) GROUP BY 1, 2")
def kmer_token_frequency(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "proteins")
    of = lambda k: F.transform(kmers("sequence", k), lambda x: F.struct(F.lit(k).alias("k"), x.alias("token")))
    both = F.concat(of(3), of(4))
    return p.select(F.explode(both).alias("t")).groupBy("t.k", "t.token").agg(F.count("*").alias("cnt"))


@query(
    """WITH t AS (SELECT unnest(list_transform(range(1, length(sequence) + 1, 3), lambda i: substr(sequence, i, 3))) AS token FROM proteins WHERE length(sequence) > 0), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
SELECT count(*) AS v_size, count(*) FILTER (n > 10) AS used10, count(*) FILTER (n > 30) AS used30, count(*) FILTER (n > 50) AS used50, round(count(*) FILTER (n > 10) / count(*)::DOUBLE, 9) AS util10, round(avg(length(token)), 9) AS ulength_mean, round(stddev_samp(length(token)), 9) AS ulength_std, round(sum(n * length(token)) / sum(n)::DOUBLE, 9) AS used_ulength_mean FROM c"""
)
def utilisation(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "proteins").select(F.explode(kmers("sequence", 3)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    used = {k: F.count_if(F.col("n") > k) for k in (10, 30, 50)}
    size = F.length("token")
    return c.agg(F.count("*").alias("v_size"), *(x.alias(f"used{k}") for k, x in used.items()), F.round(used[10] / F.count("*"), 9).alias("util10"), F.round(F.avg(size), 9).alias("ulength_mean"), F.round(F.stddev_samp(size), 9).alias("ulength_std"), F.round(F.sum(F.col("n") * size) / F.sum("n"), 9).alias("used_ulength_mean"))


@query("SELECT reviewed, organism_id % 5 AS g, count(*) AS n, round(avg(length(sequence)), 6) AS mean_len, round(stddev_samp(length(sequence)), 4) AS sd_len, count(DISTINCT organism_id) AS organisms FROM proteins GROUP BY 1, 2")
def group_mean_std(s: SparkSession, d: str) -> DataFrame:
    n = F.length("sequence")
    return table(s, d, "proteins").groupBy("reviewed", (F.col("organism_id") % 5).alias("g")).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_len"), F.round(F.stddev_samp(n), 4).alias("sd_len"), F.countDistinct("organism_id").alias("organisms"))


@query("SELECT entry_type, q[1] AS q25, q[2] AS median, q[3] AS q75, q[3] - q[1] AS iqr, n FROM (SELECT entry_type, quantile_cont(end_index - start_index, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM interpro_entries WHERE end_index IS NOT NULL AND start_index IS NOT NULL GROUP BY 1)")
def iqr_by_group(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "interpro_entries").dropna(subset=["start_index", "end_index"])
    q = F.percentile(F.col("end_index") - F.col("start_index"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return i.groupBy("entry_type").agg(q.alias("q"), F.count("*").alias("n")).select("entry_type", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n")


_ASPECTS = ("biological_process", "cellular_component", "molecular_function")


@query("SELECT assigned_by, " + ", ".join(f"count(*) FILTER (go_aspect = '{a}') AS {a}" for a in _ASPECTS) + " FROM uniprot_quickgo_annotations GROUP BY 1")
def pivot_aspects(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "uniprot_quickgo_annotations").groupBy("assigned_by").pivot("go_aspect", list(_ASPECTS)).agg(F.count(F.lit(1)))
    return p.select("assigned_by", *(F.coalesce(a, F.lit(0)).alias(a) for a in _ASPECTS))


@query(f"""WITH r AS (SELECT config_id, sum(CASE WHEN parent IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE AS m FROM (SELECT DISTINCT config_id, token, parent FROM vocab_entries) GROUP BY 1),
l AS (SELECT regexp_replace(config_id, '_r[0-9]+$', '') AS label, m FROM r)
SELECT label, count(*) AS n, round(avg(m), 9) AS mutated_ratio FROM l GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(m), 9) FROM l""")
def collapse_repeats(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "vocab_entries").select("config_id", "token", "parent").distinct().groupBy(F.regexp_replace("config_id", "_r[0-9]+$", "").alias("label"), "config_id").agg((F.count("parent") / F.count("*")).alias("m"))
    mean = [F.count("*").alias("n"), F.round(F.avg("m"), 9).alias("mutated_ratio")]
    return r.groupBy("label").agg(*mean).unionByName(r.agg(*mean).select(F.lit("all").alias("label"), "n", "mutated_ratio"))


@query(f"SELECT row_id FROM uniprot_quickgo_annotations WHERE {GO_SQL.format(c='go_id')} IN (SELECT {GO_SQL.format(c='go_id')} FROM uniprot_quickgo_annotations GROUP BY 1 HAVING count(*) >= 50)")
def frequent_terms(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").select("row_id", canonical_go("go_id").alias("go"))
    return q.join(q.groupBy("go").count().filter("count >= 50"), "go", "left_semi").select("row_id")


@query(f"SELECT {GO_SQL.format(c='go_id')} AS go, count(*) AS n, array_to_string(list_sort(list(DISTINCT go_evidence) FILTER (go_evidence IS NOT NULL)), ',') AS evidence FROM uniprot_quickgo_annotations GROUP BY 1")
def collect_evidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "uniprot_quickgo_annotations").groupBy(canonical_go("go_id").alias("go")).agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("go_evidence")), ","), F.lit("")).alias("evidence"))


@query("SELECT label, pos::INT AS pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def class_mean_embedding(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# ---------------------------------------------------------------- windows, sorts, sets


@query(f"SELECT row_id, row_number() OVER (PARTITION BY {ACCESSION_SQL.format(c='uniprot_id')} ORDER BY row_id) AS occurrence FROM prosite_entries")
def occurrence_number(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prosite_entries").select("row_id", canonical_accession("uniprot_id").alias("u"))
    return C.occurrence_number(p, ["u"], ["row_id"]).select("row_id", F.col("occurrence").cast("long").alias("occurrence"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY id, loaded_at) AS n FROM uniref50_representatives WHERE members > 1), m AS (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY id, loaded_at) AS n FROM uniref50_representatives WHERE NOT members > 1) SELECT id, cluster_name, 'shared' AS part FROM k WHERE n = 1 UNION ALL SELECT id, cluster_name, 'single' FROM m WHERE n = 1 AND (cluster_name IS NULL OR cluster_name NOT IN (SELECT cluster_name FROM k WHERE cluster_name IS NOT NULL))")
def distil_representatives(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "uniref50_representatives")
    shared = C.first_rows(u.filter("members > 1"), ["cluster_name"], ["id", "loaded_at"])
    single = C.first_rows(u.filter("NOT members > 1"), ["cluster_name"], ["id", "loaded_at"]).join(shared, "cluster_name", "left_anti")
    pick = lambda df, n: df.select("id", "cluster_name", F.lit(n).alias("part"))
    return pick(shared, "shared").unionByName(pick(single, "single"))


_INSERT = f"WITH r AS (SELECT row_id, {ACCESSION_SQL.format(c='uniprot_id')} AS u, {GO_SQL.format(c='go_id')} AS g, loaded_at FROM uniprot_quickgo_annotations), n AS (SELECT *, row_number() OVER (PARTITION BY u, g ORDER BY loaded_at, row_id) AS n, (u, g) IN (SELECT u, g FROM r WHERE row_id % 7 = 0) AS have FROM r)"


def _insert(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(s, d, "uniprot_quickgo_annotations").select("row_id", canonical_accession("uniprot_id").alias("u"), canonical_go("go_id").alias("g"), "loaded_at")
    return C.insert_or_ignore(r.filter("row_id % 7 = 0"), r, ["u", "g"], ["loaded_at", "row_id"], required=("u", "g"))


@query(_INSERT + " SELECT row_id FROM n WHERE n = 1 AND NOT have")
def idempotent_insert(s: SparkSession, d: str) -> DataFrame:
    return _insert(s, d)[0].select("row_id")


@query(_INSERT + " SELECT row_id FROM n WHERE n > 1 OR have")
def rejected_duplicates(s: SparkSession, d: str) -> DataFrame:
    return _insert(s, d)[1].select("row_id")


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {GO_SQL.format(c='go_id')} ORDER BY md5('42|' || row_id), row_id) AS n FROM uniprot_quickgo_annotations) WHERE n <= 20")
def undersampled_terms(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").select("row_id", canonical_go("go_id").alias("g"))
    return C.undersampled(q, "g", F.col("row_id"), 20).select("row_id")


@query("SELECT row_id FROM prosite_entries ORDER BY md5('42|' || row_id), row_id LIMIT 100")
def hash_sample(s: SparkSession, d: str) -> DataFrame:
    return C.hash_sample(table(s, d, "prosite_entries").select("row_id"), F.col("row_id"), 100)


@query("SELECT config_id, z AS v_size, count(*) AS kept, max(token_id) AS last_id FROM (SELECT DISTINCT config_id, token_id FROM vocab_entries) CROSS JOIN (SELECT CAST(800 * pow(2, k) AS INT) AS z FROM range(6) r(k)) WHERE token_id < z GROUP BY 1, 2")
def vocab_downsample(s: SparkSession, d: str) -> DataFrame:
    sizes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (F.lit(800) * F.pow(F.lit(2), k)).cast("int")))
    v = table(s, d, "vocab_entries").select("config_id", "token_id").distinct().select("*", sizes.alias("v_size"))
    return v.filter("token_id < v_size").groupBy("config_id", "v_size").agg(F.count("*").alias("kept"), F.max("token_id").alias("last_id"))


@query("WITH a AS (SELECT DISTINCT token FROM vocab_entries WHERE config_id LIKE '%blosum62%'), b AS (SELECT DISTINCT token FROM vocab_entries WHERE config_id LIKE '%pam70%') SELECT token, CASE WHEN token IN (SELECT token FROM b) THEN 'both' ELSE 'first' END AS side FROM a UNION ALL SELECT token, 'second' FROM b WHERE token NOT IN (SELECT token FROM a)")
def vocab_set_operations(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vocab_entries")
    a, b = (v.filter(F.contains("config_id", F.lit(m))).select("token").distinct() for m in ("blosum62", "pam70"))
    side = lambda df, n: df.select("token", F.lit(n).alias("side"))
    return side(a.intersect(b), "both").unionByName(side(a.exceptAll(b), "first")).unionByName(side(b.join(a, "token", "left_anti"), "second"))


@query("SELECT token FROM (SELECT DISTINCT config_id, token FROM vocab_entries) GROUP BY token HAVING count(*) = (SELECT count(DISTINCT config_id) FROM vocab_entries)")
def tokens_in_all(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vocab_entries")
    return v.groupBy("token").agg(F.countDistinct("config_id").alias("n")).join(v.agg(F.countDistinct("config_id").alias("n")), "n", "left_semi").select("token")


@query("SELECT item, n FROM (SELECT k AS item, count(*) AS n, rank() OVER (PARTITION BY length(k) ORDER BY count(*) DESC, k) AS r FROM (SELECT token AS k FROM (SELECT DISTINCT config_id, token FROM vocab_entries)) GROUP BY 1) WHERE r <= 3")
def top_tokens_by_length(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "vocab_entries").select("config_id", F.col("token").alias("item")).distinct().groupBy("item").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy(F.length("item")).orderBy(F.desc("n"), "item"))).filter("r <= 3").select("item", "n")


@query("SELECT symbol, cast(('0x' || substr(md5('7|' || symbol), 1, 7)) AS INT) AS number FROM (SELECT DISTINCT unnest(string_split(sequence, '')) AS symbol FROM proteins WHERE sequence <> '')")
def hashed_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "proteins").select(F.explode(symbols("sequence")).alias("symbol")).distinct().select("symbol", hashed_number(F.lit("7"), F.col("symbol")).alias("number"))
