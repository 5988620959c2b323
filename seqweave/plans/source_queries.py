"""Readers, writers and stored tables as round trips over whole test tables, with the SQL
of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ids import ACCESSION_SQL, GO_SQL, canonical_accession, canonical_go
from seqweave.operators.corpus import said_true
from seqweave.operators.substitution import class_matrix, matrix_frame, matrix_values
from seqweave.plans.domain_queries import SQL as DOMAIN_SQL
from seqweave.plans.domain_queries import VOCAB, vocab, vocabulary_stats
from seqweave.plans.tables import table
from seqweave.session import new_path, open_output, written
from seqweave.sources import readers as R
from seqweave.sources import sinks as K

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _text(df: DataFrame, value, name: str) -> str:
    """The records of a table as text files; rows without one are left out."""
    path = new_path(df.sparkSession, name)
    df.select(value.alias("value")).filter("value IS NOT NULL").write.text(path)
    return path


# ---------------------------------------------------------------- catalog


def _database(s: SparkSession) -> str:
    name = f"seqweave_{uuid.uuid4().hex[:12]}"
    s.sql(f"CREATE DATABASE {name} LOCATION '{new_path(s, 'catalog')}'")
    return name


@query(f"SELECT unnest({sorted([*K.TABLES, 'go_terms_copy'])}) AS name")
def catalog_tables(s: SparkSession, d: str) -> DataFrame:
    """The annotation tables made anew, a table of query results beside them, and the list of both."""
    base = _database(s)
    K.create_tables(s, base)
    K.create_tables(s, base)
    K.overwrite_table(table(s, d, "go_terms"), f"{base}.go_terms_copy")
    names = K.tables(s, base)
    s.sql(f"DROP DATABASE {base} CASCADE")
    return s.createDataFrame([(n,) for n in names], "name string")


@query("SELECT go_id, go_name FROM go_terms WHERE go_aspect = 'molecular_function'")
def table_overwrite(s: SparkSession, d: str) -> DataFrame:
    """A table of the catalog written twice: only the second content is left."""
    base, g = _database(s), table(s, d, "go_terms")
    K.overwrite_table(g.select("go_id", "go_name"), f"{base}.terms")
    K.overwrite_table(g.filter("go_aspect = 'molecular_function'").select("go_id", "go_name"), f"{base}.terms")
    out = written(s.table(f"{base}.terms"), "terms")
    s.sql(f"DROP DATABASE {base} CASCADE")
    return out


# ---------------------------------------------------------------- CSV


@query("SELECT row_id, prosite_id, score FROM prosite_entries WHERE score IS NOT NULL")
def csv_tree(s: SparkSession, d: str) -> DataFrame:
    """Rows with a score below a folder HUMAN, the others elsewhere; the former are read back."""
    p, root = table(s, d, "prosite_entries").select("row_id", "prosite_id", "score"), new_path(s, "csv")
    K.write_csv(p.filter("score IS NOT NULL"), f"{root}/a/HUMAN")
    K.write_csv(p.filter("score IS NULL"), f"{root}/b/MOUSE")
    return R.read_csv_tree(s, root, "row_id long, prosite_id string, score double", "HUMAN").drop("path")


@query(DOMAIN_SQL["vocabulary_stats"])
def csv_results(s: SparkSession, d: str) -> DataFrame:
    """Results of another query stored as CSV and read with inferred types."""
    path = new_path(s, "results")
    K.write_csv(vocabulary_stats(s, d), path)
    return R.read_results(s, path)


@query("SELECT config_id, token, frequency FROM (SELECT DISTINCT config_id, token, frequency, is_parent FROM vocab_entries) WHERE is_parent")
def string_booleans(s: SparkSession, d: str) -> DataFrame:
    """Truth values that arrive as the texts True and False."""
    v = table(s, d, "vocab_entries").select("config_id", "token", "frequency", "is_parent").distinct()
    text = v.withColumn("is_parent", F.initcap(F.col("is_parent").cast("string")))
    return text.filter(said_true("is_parent")).drop("is_parent")


# ---------------------------------------------------------------- vocabularies


@query(f"WITH {VOCAB} SELECT config_id, (row_number() OVER (PARTITION BY config_id ORDER BY token_id, token) - 1)::INT AS token_id, token, frequency, merge_order, array_to_string(pair, ' ') AS pair, parent, round(similarity, 9) AS similarity, is_parent FROM v")
def tokenizer_export(s: SparkSession, d: str) -> DataFrame:
    """Every vocabulary of the table written as JSON and read back."""
    path = new_path(s, "vocab")
    K.write_vocabularies(vocab(s, d), path)
    return R.read_vocabularies(s, path).withColumns({"pair": F.array_join("pair", " "), "similarity": F.round("similarity", 9)})


def _stored(s: SparkSession, d: str) -> str:
    path = new_path(s, "configs")
    table(s, d, "vocab_entries").select("config_id", "token_id", "token").distinct().write.partitionBy("config_id").parquet(path)
    return path


@query("SELECT DISTINCT config_id, token_id, token FROM vocab_entries WHERE regexp_matches(config_id, '_blosum62_mutbpe_0\\.(8|9)_') OR regexp_matches(config_id, '_pam70_')")
def vocabulary_grid(s: SparkSession, d: str) -> DataFrame:
    """Options to names to folders: only the configurations asked for are read."""
    return R.load_grid(s, _stored(s, d), [{"matrix": "blosum62", "is_bpe": False, "sim_cutoff": [0.8, 0.9]}, {"matrix": ["pam70"]}])


@query("SELECT DISTINCT 'config_id=' || config_id AS name FROM vocab_entries WHERE starts_with(config_id, 'uniref50_') AND config_id NOT LIKE '%pam70%' AND config_id NOT LIKE '%\\_bpe\\_%' ESCAPE '\\'")
def configuration_files(s: SparkSession, d: str) -> DataFrame:
    names = R.config_files(s, _stored(s, d), "config_id=uniref50_", without=("pam70",), plain=False)
    return s.createDataFrame([(n,) for n in names], "name string")


# ---------------------------------------------------------------- formats of annotation data

_ACC, _GO = ACCESSION_SQL.format(c="uniprot_id"), GO_SQL.format(c="go_id")


@query(f"SELECT uniprot_name, {_ACC} AS uniprot_id, sequence_start, sequence_end, prosite_name, prosite_id, score, upper(replace(replace(aligned_sequence, '-', ''), '.', '')) AS sequence, aligned_sequence FROM prosite_entries WHERE uniprot_id IS NOT NULL AND uniprot_name IS NOT NULL AND prosite_name IS NOT NULL AND prosite_id IS NOT NULL AND sequence_start IS NOT NULL AND sequence_end IS NOT NULL AND aligned_sequence IS NOT NULL")
def alignment_file(s: SparkSession, d: str) -> DataFrame:
    """Pattern matches as an alignment file with wrapped sequences, and back."""
    score = F.coalesce(F.concat(F.lit("/"), F.col("score").cast("string")), F.lit(""))
    head = F.concat(F.lit(">"), "uniprot_name", F.lit("|"), canonical_accession("uniprot_id"), F.lit("/"), "sequence_start", F.lit("-"), "sequence_end", F.lit(": "), "prosite_name", F.lit("|"), "prosite_id", score)
    body = F.regexp_replace("aligned_sequence", "(.{60})(?=.)", "$1\n")
    return R.read_prosite_msa(s, _text(table(s, d, "prosite_entries"), F.concat(head, F.lit("\n"), body), "msa"))


@query("SELECT n AS prosite_name, prosite_id, 'JAN-2024.' AS date, n || ' signature' AS description, substr(q, 1, 3) || '-' || substr(q, 4, 3) AS pattern FROM (SELECT prosite_id, min(prosite_name) AS n, min(sequence) AS q FROM prosite_entries GROUP BY 1) WHERE n IS NOT NULL AND q IS NOT NULL")
def pattern_file(s: SparkSession, d: str) -> DataFrame:
    """A record per pattern, its pattern on two lines, matrices between them."""
    p = table(s, d, "prosite_entries").groupBy("prosite_id").agg(F.min("prosite_name").alias("n"), F.min("sequence").alias("q"))
    three = lambda k: F.substr("q", F.lit(k), F.lit(3))
    lines = ["ID   ", "n", "; PATTERN.\nAC   ", "prosite_id", ";\nDT   JAN-2024.\nDE   ", "n", " signature.\nPA   ", three(1), "-\nPA   ", three(4), ".\n//\nID   ", "n", "; MATRIX.\nAC   ", "prosite_id", ";\n//"]
    text = F.concat(*(F.lit(x) if k % 2 == 0 else x for k, x in enumerate(lines)))
    return R.read_prosite_dat(s, _text(p, text, "dat"))


@query(f"SELECT interpro_id AS entry_id, trim(interpro_description) AS description, {_GO} AS go_id, trim(go_name) AS go_name FROM interpro_go_mapping WHERE trim(interpro_description) <> '' AND trim(go_name) <> '' AND regexp_matches({_GO}, '^GO:[0-9]+$') AND regexp_matches(interpro_id, '^IPR[0-9]+$')")
def mapping_file(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("InterPro:"), "interpro_id", F.lit(" "), "interpro_description", F.lit(" > GO:"), "go_name", F.lit(" ; "), canonical_go("go_id"))
    return R.read_go_mapping(s, _text(table(s, d, "interpro_go_mapping"), F.concat(F.lit("!a remark\n\n"), line), "mapping"))


@query(f"SELECT {_ACC} AS uniprot_id, interpro_id, description, entry_type, array_to_string(list_sort(list_distinct(list_transform(member_databases, lambda x: upper(x)))), ' ') AS member_databases, start_index, end_index FROM interpro_entries")
def interpro_dumps(s: SparkSession, d: str) -> DataFrame:
    """Matches as JSON dumps, nested as the service gives them, and taken apart again."""
    i, t = table(s, d, "interpro_entries"), F.struct
    inner = F.map_from_entries(F.transform(F.array_distinct("member_databases"), lambda x: t(x.alias("k"), F.create_map(F.upper(x), F.lit("a name")).alias("v"))))
    meta = t(F.col("interpro_id").alias("accession"), F.col("description").alias("name"), F.col("entry_type").alias("type"), inner.alias("member_databases"))
    places = F.array(t(F.array(t(F.array(t(F.col("start_index").alias("start"), F.col("end_index").alias("end"))).alias("fragments"))).alias("entry_protein_locations")))
    dumps = i.select(canonical_accession("uniprot_id").alias("uniprot_id"), F.to_json(t(F.array(t(meta.alias("metadata"), places.alias("proteins"))).alias("results"))).alias("dump"))
    rows = R.interpro_rows(dumps.select("uniprot_id", F.from_json("dump", R.INTERPRO_JSON)["results"].alias("results")))
    return rows.withColumn("member_databases", F.array_join(F.array_sort("member_databases"), " "))


@query("SELECT go_id, min(go_name) AS go_name, min(go_aspect) AS go_aspect, array_to_string(list_sort(list_distinct(flatten(list(is_a)))), ' ') AS is_a, count(deleted_at) > 0 AS obsolete FROM go_terms GROUP BY 1")
def ontology_file(s: SparkSession, d: str) -> DataFrame:
    """The terms as OBO text, and back."""
    g = table(s, d, "go_terms").groupBy("go_id").agg(F.min("go_name").alias("n"), F.min("go_aspect").alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("is_a")))).alias("up"), (F.count("deleted_at") > 0).alias("gone"))
    lines = F.array(F.concat(F.lit("id: "), "go_id"), F.concat(F.lit("name: "), "n"), F.concat(F.lit("namespace: "), "a"))
    lines = F.concat(lines, F.transform("up", lambda x: F.concat(F.lit("is_a: "), x, F.lit(" ! a name"))), F.array(F.when(F.col("gone"), "is_obsolete: true")))
    terms = R.read_obo(s, _text(g, F.concat(F.lit("[Term]\n"), F.array_join(lines, "\n"), F.lit("\n")), "obo"))
    return terms.withColumn("is_a", F.array_join(F.array_sort("is_a"), " "))


@query(f"SELECT a, b, score::DOUBLE AS score FROM (VALUES {matrix_values(class_matrix())}) v(a, b, score)")
def matrix_file(s: SparkSession, d: str) -> DataFrame:
    """A substitution matrix in NCBI's text format; public matrices are read the same way."""
    m, path = class_matrix(), f"{new_path(s, 'matrix')}/CLASSES"
    letters = sorted({a for a, _ in m})
    with open_output(s, path) as out:
        out.write(("# by classes\n   " + "  ".join(letters) + "\n" + "".join(f"{a} " + " ".join(f"{m[a, b]:2d}" for b in letters) + "\n" for a in letters)).encode())
    return matrix_frame(s, R.read_matrix(s, path))


# ---------------------------------------------------------------- services


@query("SELECT DISTINCT go_id AS id, k FROM go_terms, range(0, 10) r(k) WHERE k < CAST(right(go_id, 1) AS INT)")
def paged_service(s: SparkSession, d: str) -> DataFrame:
    """A service that gives each term as many rows as its last digit says, in pages of 50."""

    def fetch(ids: list, page: int) -> list[dict]:
        rows = [{"id": i, "k": k} for i in ids for k in range(int(i[-1]))]
        return rows[(page - 1) * 50 : page * 50]

    return R.fetch_pages(table(s, d, "go_terms"), "go_id", fetch, "id string, k long", batch=40, page_rows=50)


@query("SELECT n_nationkey, n_name FROM nation")
def downloaded_table(s: SparkSession, d: str) -> DataFrame:
    """A file fetched by its address into the shared folder, then read."""
    (path,) = R.download(s, ("" if "://" in d else "file://") + f"{d}/nation.parquet", new_path(s, "download"))
    return s.read.parquet(path).select("n_nationkey", "n_name")
