"""Readers of the text formats that sequence and annotation data come in.

All give DataFrames over splittable or whole-file text scans; malformed records are
left out, and ``rejected=True`` gives those instead where the format allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.sequences import config_parts
from seqweave.session import open_output


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, description, sequence``; bodies of one or many lines."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    head = F.trim(F.split_part("v", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.substr("v", F.length(F.split_part("v", F.lit("\n"), F.lit(1))) + 1), r"\s", "")
    return raw.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.nullif(F.trim(F.regexp_replace(head, r"^\S+", "")), F.lit("")).alias("description"), body.alias("sequence"))


def read_csv_tree(spark: SparkSession, path: str, schema: str, containing: str | None = None) -> DataFrame:
    """All CSV files below a folder, with their path; ``containing`` keeps files whose
    path holds the text."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path).withColumn("path", F.col("_metadata.file_path"))
    return df.filter(F.contains("path", F.lit(containing))) if containing else df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results: CSV with a header, types found by reading."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


VOCAB_JSON = "map<string,struct<frequency:bigint,order:int,pair:array<string>,parent:string,similarity:double,is_parent:boolean>>"


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary files (one JSON object each, unit to properties) as a vocabulary
    table; the configuration is the name of the file, or of its folder where that is
    ``config_id=...``, the id the unit's place in the file."""
    folder = F.regexp_extract("_metadata.file_path", r"/config_id=([^/]+)/[^/]+$", 1)
    config = F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(config.alias("config_id"), F.from_json("value", VOCAB_JSON).alias("m"))
    rows = raw.select("config_id", F.posexplode(F.map_entries("m")).alias("token_id", "e"))
    return rows.select("config_id", "token_id", F.col("e.key").alias("token"), F.col("e.value.frequency").alias("frequency"), F.col("e.value.order").alias("merge_order"), "e.value.pair", "e.value.parent", "e.value.similarity", "e.value.is_parent")


#: Lines of a matrix file, letters and remarks together; more than that is no matrix.
MATRIX_LINES = 1000


def read_matrix(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in NCBI's text format: comments by #, a line of column
    letters, a line of scores per letter. A few hundred cells, so a dict; a file of
    more than ``MATRIX_LINES`` lines, or with lines of another length, is refused."""
    lines = [r["value"].split() for r in spark.read.text(path).filter("value NOT LIKE '#%' AND trim(value) <> ''").limit(MATRIX_LINES + 1).collect()]
    if not 1 < len(lines) <= MATRIX_LINES or any(len(x) != len(lines[0]) + 1 for x in lines[1:]):
        raise ValueError(f"{path} holds no substitution matrix")
    return {(row[0], c): float(x) for row in lines[1:] for c, x in zip(lines[0], row[1:])}


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``head, body`` of records that begin with > at the start of a line."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    head = F.split_part("v", F.lit("\n"), F.lit(1))
    return raw.select(F.rtrim(head).alias("head"), F.regexp_replace(F.substr("v", F.length(head) + 1), r"\s", "").alias("body"))


def read_prosite_msa(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """Matches of PROSITE alignment files. A header has two halves parted by the first
    colon, each ``name|identifier/details``: the details are the match's bounds, and the
    score, which may be missing. ``sequence`` is the aligned one without gaps, in upper
    case. ``rejected`` gives the headers that lack a part."""
    cell = lambda c, by, k: F.trim(F.split_part(c, F.lit(by), F.lit(k)))
    r = _records(spark, path).select("head", "body", cell(F.col("head"), ":", 1).alias("match"), F.trim(F.substr("head", F.instr("head", ":") + 1)).alias("profile"))
    r = r.select("*", cell(F.col("match"), "|", 2).alias("place"), cell(F.col("profile"), "|", 2).alias("entry")).withColumn("bounds", cell(F.col("place"), "/", 2))
    parts = {
        "uniprot_name": cell(F.col("match"), "|", 1),
        "uniprot_id": cell(F.col("place"), "/", 1),
        "sequence_start": cell(F.col("bounds"), "-", 1).try_cast("int"),
        "sequence_end": cell(F.col("bounds"), "-", 2).try_cast("int"),
        "prosite_name": cell(F.col("profile"), "|", 1),
        "prosite_id": cell(F.split_part("entry", F.lit(" "), F.lit(1)), "/", 1),
    }
    r = r.withColumns(parts).withColumn("score", cell(F.col("entry"), "/", 2).try_cast("double"))
    good = F.contains("head", F.lit(":"))
    for name in parts:
        good = good & F.coalesce(F.col(name).cast("string") != "", F.lit(False))
    if rejected:
        return r.filter(~good).select(F.col("head").alias("header"))
    return r.filter(good).select(*parts, "score", F.upper(F.translate("body", "-.", "")).alias("sequence"), F.col("body").alias("aligned_sequence"))


def read_prosite_dat(spark: SparkSession, path: str) -> DataFrame:
    """Pattern records of a PROSITE data file; several PA lines are one pattern, the
    last character of pattern and description is dropped, a last record needs no end
    mark. Of other repeated lines the last counts."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.split("value", "\n").alias("l"))
    tagged = lambda t: F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(f"{t}   "))), lambda x: F.trim(F.substr(x, F.lit(6))))
    last = lambda t: F.try_element_at(tagged(t), F.lit(-1))
    cut = lambda c: F.substr(c, F.lit(1), F.greatest(F.length(c) - 1, F.lit(0)))
    rows = raw.select(last("ID").alias("id"), last("AC").alias("ac"), last("DT").alias("dt"), last("DE").alias("de"), F.array_join(tagged("PA"), "").alias("pa")).filter(F.contains("id", F.lit("; PATTERN.")))
    none = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(F.trim(F.replace("id", F.lit("; PATTERN."), F.lit(""))).alias("prosite_name"), F.trim(F.replace(none(F.col("ac")), F.lit(";"), F.lit(""))).alias("prosite_id"), none(F.col("dt")).alias("date"), cut(none(F.col("de"))).alias("description"), cut(F.col("pa")).alias("pattern"))


def read_go_mapping(spark: SparkSession, path: str, source: str = "InterPro", id_form: str = r"IPR\d+", rejected: bool = False) -> DataFrame:
    """Lines ``Source:ID name > GO:term ; GO:0000000``; comments and blanks are skipped. The
    last `` > `` parts entry and term, the last `` ; `` the term's name and its id.
    ``rejected`` gives the lines in which a part is missing."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND line NOT LIKE '!%'")
    term = F.substring_index("line", " > ", -1)
    entry = F.trim(F.substr("line", F.lit(1), F.greatest(F.length("line") - F.length(term) - 3, F.lit(0))))
    rows = rows.select("line", entry.alias("entry"), term.alias("term"))
    first = F.split_part("entry", F.lit(" "), F.lit(1))
    go = F.substring_index("term", " ; ", -1)
    name = F.trim(F.substr("term", F.lit(1), F.greatest(F.length("term") - F.length(go) - 3, F.lit(0))))
    rows = rows.select("line", first.alias("key"), F.trim(F.substr("entry", F.length(first) + 1)).alias("description"), name.alias("name"), F.trim(go).alias("go_id"))
    entry_id = F.substr("key", F.lit(len(source) + 2))
    good = F.startswith("key", F.lit(f"{source}:")) & entry_id.rlike(f"^(?:{id_form})$") & (F.col("description") != "") & F.startswith("name", F.lit("GO:")) & (F.length("name") > 3) & F.col("go_id").rlike("^GO:[0-9]+$") & F.contains("line", F.lit(" ; "))
    if rejected:
        return rows.filter(~good).select("line")
    return rows.filter(good).select(entry_id.alias("entry_id"), "description", "go_id", F.trim(F.substr("name", F.lit(4))).alias("go_name"))


INTERPRO_JSON = "results array<struct<metadata:struct<accession:string,name:string,type:string,member_databases:map<string,map<string,string>>>,proteins:array<struct<entry_protein_locations:array<struct<fragments:array<struct<start:int,end:int>>>>>>>>"


def read_interpro_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of per-protein JSON dumps, one row per fragment (one with nulls for an
    entry without); the protein is the file's name."""
    return interpro_rows(spark.read.schema(INTERPRO_JSON).option("multiLine", True).json(path).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("uniprot_id"), "results"))


def interpro_rows(dumps: DataFrame) -> DataFrame:
    """The same of parsed dumps ``uniprot_id, results`` (see ``INTERPRO_JSON``), wherever they
    were stored."""
    raw = dumps.select("uniprot_id", F.explode("results").alias("r"))
    locations = F.flatten(F.transform(F.coalesce("r.proteins", F.array()), lambda p: F.coalesce(p["entry_protein_locations"], F.array())))
    fragments = F.flatten(F.transform(locations, lambda x: F.coalesce(x["fragments"], F.array())))
    first = F.transform(F.map_values("r.metadata.member_databases"), lambda m: F.get(F.map_keys(m), F.lit(0)))
    m = "r.metadata"
    return raw.select("uniprot_id", F.col(f"{m}.accession").alias("interpro_id"), F.col(f"{m}.name").alias("description"), F.col(f"{m}.type").alias("entry_type"), first.alias("member_databases"), F.explode_outer(fragments).alias("f")).select("uniprot_id", "interpro_id", "description", "entry_type", "member_databases", F.col("f.start").alias("start_index"), F.col("f.end").alias("end_index"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an ontology in OBO text: ``go_id, go_name, go_aspect, is_a, obsolete``."""
    raw = spark.read.option("lineSep", "\n[").text(path).select(F.regexp_replace("value", r"^\[", "").alias("v")).filter(F.startswith("v", F.lit("Term]"))).select(F.split("v", "\n").alias("l"))
    named = lambda t: F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(f"{t}: "))), lambda x: F.trim(F.substr(x, F.lit(len(t) + 3))))
    one = lambda t: F.get(named(t), F.lit(0))
    return raw.select(one("id").alias("go_id"), one("name").alias("go_name"), one("namespace").alias("go_aspect"), F.transform(named("is_a"), lambda x: F.split_part(x, F.lit(" "), F.lit(1))).alias("is_a"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"))


def config_files(spark: SparkSession, path: str, prefix: str, without: tuple = ("512000",), plain: bool = True) -> list[str]:
    """Names of a folder's files by prefix, leaving out those that hold a text of
    ``without`` and, if not ``plain``, those of plain vocabularies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(n for n in names if n.startswith(prefix) and not any(w in n for w in without) and (plain or "_bpe_" not in n))


def load_vocabularies(spark: SparkSession, path: str, configs: list[str]) -> DataFrame:
    """Some configurations of a vocabulary table stored by ``config_id``: only their
    folders are read."""
    return spark.read.parquet(path).filter(F.col("config_id").isin(*configs))


def load_grid(spark: SparkSession, path: str, options: list[dict]) -> DataFrame:
    """The configurations of a stored vocabulary table that any of the ``options`` names: each
    gives values, or lists of them, for parts of the name (see ``config_parts``). Names
    that are not in the folder have no row; only the folders wanted are read."""
    there = [n.removeprefix("config_id=") for n in config_files(spark, path, "config_id=", without=())]
    names = spark.createDataFrame([(n,) for n in there], "n string").select(F.url_decode("n").alias("n")).withColumn("p", config_parts("n"))
    wanted = F.lit(False)
    for option in options:
        fits = F.lit(True)
        for part, value in option.items():
            fits = fits & F.coalesce(F.col(f"p.{part}").isin(*(value if isinstance(value, (list, tuple)) else [value])), F.lit(False))
        wanted = wanted | fits
    # one row per stored configuration, as many as there are folders
    return load_vocabularies(spark, path, [r["n"] for r in names.filter(wanted).select("n").collect()])


def fetch_pages(ids: DataFrame, ident: str, fetch: Callable[[list, int], list[dict]], schema: str, *, batch: int = 100, page_rows: int = 200) -> DataFrame:
    """Rows of a paged service: ids are asked for in batches, page by page from 1, until a
    page comes short. ``fetch(ids, page)`` makes one call and does its own waiting and
    repeating; batches are spread over the tasks, so it should be safe to repeat."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.strip().split()[0] for c in schema.split(",")]
        for f in frames:
            names = list(f[ident])
            for i in range(0, len(names), batch):
                page = 1
                while True:
                    rows = fetch(names[i : i + batch], page)
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)
                    if len(rows) < page_rows:
                        break
                    page += 1

    return ids.select(ident).filter(F.col(ident).isNotNull()).distinct().mapInPandas(run, schema)


def download(spark: SparkSession, url: str, path: str, chunk: int = 1 << 20) -> list[str]:
    """A file of the network written to the folder ``path`` of any file system Spark knows,
    an archive unpacked on the way; in chunks, so nothing is held whole. Gives the
    paths written. The driver is the one reader, as a stream has no parts to share out."""
    import os
    import tarfile
    import urllib.request

    def put(source, name: str) -> str:
        target = f"{path.rstrip('/')}/{name}"
        with open_output(spark, target) as out:
            while block := source.read(chunk):
                out.write(block)
        return target

    with urllib.request.urlopen(url, timeout=60) as src:
        name = os.path.basename(urllib.request.urlparse(url).path)
        if not name.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            return [put(src, name)]
        with tarfile.open(fileobj=src, mode="r|*") as archive:
            # names that lead out of the folder are not followed
            return [put(archive.extractfile(m), m.name) for m in archive if m.isfile() and not os.path.isabs(m.name) and ".." not in m.name.split("/")]
