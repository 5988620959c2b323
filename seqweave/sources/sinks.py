"""Writers: tables, FASTA, vocabularies and tokenizer files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.encoding import export
from seqweave.session import open_output


def overwrite_table(df: DataFrame, name: str) -> None:
    """Replace a table of the catalog; Spark commits it as a whole."""
    df.write.mode("overwrite").saveAsTable(name)


#: Annotation tables, and the columns that tell their rows apart (see ``insert_or_ignore``).
#: Names and columns are fixed values.
TABLES = {
    "uniprot_quickgo_annotations": ("uniprot_id STRING NOT NULL, go_id STRING NOT NULL, go_name STRING, go_aspect STRING, go_evidence STRING, evidence_code STRING, qualifier STRING, assigned_by STRING, date_created STRING", ["uniprot_id", "go_id"]),
    "interpro_go_mapping": ("interpro_id STRING NOT NULL, interpro_description STRING, go_id STRING NOT NULL, go_name STRING", ["interpro_id", "go_id"]),
    "prosite_entries": ("prosite_id STRING NOT NULL, uniprot_id STRING NOT NULL, prosite_name STRING, uniprot_name STRING, sequence_start INT, sequence_end INT, score DOUBLE, sequence STRING, aligned_sequence STRING", ["prosite_id", "uniprot_id", "sequence_start", "sequence_end"]),
    "prosite_go_mapping": ("prosite_id STRING NOT NULL, prosite_description STRING, go_id STRING NOT NULL, go_name STRING", ["prosite_id", "go_id"]),
    "prosite_patterns": ("prosite_name STRING, prosite_id STRING NOT NULL, date STRING, description STRING, pattern STRING", ["prosite_id"]),
}


def create_tables(spark, database: str = "default") -> None:
    """The annotation tables, where they do not exist yet."""
    for name, (columns, _) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def tables(spark, database: str = "default") -> list[str]:
    """The tables of a database of the catalog."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def fasta_records(ident: str, seq: str, description: list[str] | None = None, wrap: int | None = None) -> Column:
    """``>id k=v | k=v`` and the sequence, whole or wrapped; null values are left out."""
    named = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in description or []))
    body = F.regexp_replace(seq, f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else F.col(seq)
    return F.concat(F.lit(">"), F.trim(F.concat_ws(" ", F.col(ident).cast("string"), named)), F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, ident: str = "uniprot_id", seq: str = "sequence", description: list[str] | None = None, wrap: int | None = None) -> None:
    """One part file per partition; rows without id or sequence are left out."""
    df.select(fasta_records(ident, seq, description, wrap).alias("value")).filter("value IS NOT NULL").write.mode("overwrite").text(path)


def write_vocabularies(v: DataFrame, path: str) -> None:
    """A JSON object per configuration, units in order of their ids, absent properties
    left out; a folder per configuration."""
    value = F.struct("frequency", F.col("merge_order").alias("order"), "pair", "parent", "similarity", "is_parent")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token", value.alias("value")))), lambda x: F.struct(x["token"].alias("key"), x["value"].alias("value")))
    v.groupBy("config_id").agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").partitionBy("config_id").text(path)


def write_tokenizer(v: DataFrame, config: str, path: str) -> None:
    """One configuration as a tokenizer file, on any file system Spark knows. A
    vocabulary has some ten thousand units at most, so the driver writes it."""
    rows = v.filter(F.col("config_id") == config).select("token_id", "token", "merge_order", "pair").collect()
    with open_output(v.sparkSession, path) as f:
        f.write(json.dumps(export([r.asDict() for r in rows])).encode())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
