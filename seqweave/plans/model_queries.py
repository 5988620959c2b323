"""Queries that learn, encode or stream: most have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators import masked as M
from seqweave.operators import variants as V
from seqweave.operators.encoding import cuts_compared, encode, export
from seqweave.operators.genealogy import families
from seqweave.operators.substitution import class_matrix, first_alternatives
from seqweave.operators.trainer import Rules, train
from seqweave.plans.domain_queries import _MUT, _mutated, proteins
from seqweave.plans.tables import table
from seqweave.session import new_path, written
from seqweave.sources import readers as R
from seqweave.sources import sinks as K
from seqweave.streaming.units import pair_counts, run_once, run_to_table, windowed_counts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# of the reference's grid, at the smallest size that it publishes
_RULES = {"plain": Rules("vocab_size", 800), "family": Rules("vocab_size", 800, mutated=True, matrix=class_matrix(), mutation_cutoff=0.8, min_mutation_freq=0.05, min_mutation_len=3)}


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "uniref50_representatives").groupBy("id").agg(F.min("sequence").alias("s"))


def _plain(s: SparkSession, d: str) -> DataFrame:
    return train(_corpus(s, d), "s", {"plain": _RULES["plain"]})


def _family(s: SparkSession, d: str) -> DataFrame:
    return train(_corpus(s, d), "s", {"family": _RULES["family"]})


@query()
def train_default(s: SparkSession, d: str) -> DataFrame:
    return _plain(s, d)


@query()
def train_mutated(s: SparkSession, d: str) -> DataFrame:
    return _family(s, d)


def _model(v: DataFrame) -> dict:
    return export([r.asDict() for r in v.collect()])


@query()
def encode_proteins(s: SparkSession, d: str) -> DataFrame:
    e = encode(proteins(s, d), "s", _model(_plain(s, d)))
    return e.select("entry", F.inline("encoding")).groupBy("entry").agg(F.count("*").alias("tokens"), F.max("end").alias("letters"))


@query()
def token_usage(s: SparkSession, d: str) -> DataFrame:
    """Use of the learned units over the corpus: counts, and their weighted length."""
    v = _plain(s, d)
    used = encode(proteins(s, d), "s", _model(v)).select(F.explode("encoding.token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return v.select("token", "frequency").join(used, "token", "left").select("token", "frequency", F.coalesce("n", F.lit(0)).alias("n"), F.length("token").alias("unit_length"))


@query()
def variant_siblings(s: SparkSession, d: str) -> DataFrame:
    """Random variants under a learned family vocabulary."""
    v = _family(s, d)
    m = _mutated(s, d).select("entry", "s", "mutated", "pos").withColumn("config_id", F.lit("family"))
    # read twice below, so it is encoded once before
    judged = written(cuts_compared(m, "s", "mutated", "pos", _model(v)).drop("entry", "pos"), "judged")
    return V.sibling_rates(V.with_siblings(judged, families(v)), "config_id")


@query("SELECT entry AS id, any_value(sequence) AS sequence FROM proteins WHERE sequence <> '' GROUP BY 1")
def fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "fasta")
    K.write_fasta(proteins(s, d), path, "entry", "s", wrap=60)
    return R.read_fasta(s, path).select("id", "sequence")


_NEAR = """n AS (SELECT substr(t, i, 1) AS prev, substr(t, i + 1, 1) AS letter, substr(t, i + 2, 1) AS next, count(*) AS n FROM (SELECT '^' || s || '^' AS t, unnest(range(1, length(s) + 1)) AS i FROM p) GROUP BY 1, 2, 3)"""


@query(f"WITH p AS (SELECT entry, any_value(sequence) AS s FROM proteins WHERE sequence <> '' GROUP BY 1), {_NEAR} SELECT * FROM n")
def neighbour_scores(s: SparkSession, d: str) -> DataFrame:
    return M.neighbour_scores(proteins(s, d), "s")


def _four(s: SparkSession, d: str) -> DataFrame:
    m = _mutated(s, d)
    others = F.filter(F.array(*(F.lit(x) for x in V.LETTERS)), lambda x: x != F.col("orig"))
    from seqweave.functions.sequences import hashed_number, with_letter

    k = hashed_number(F.lit("25"), F.lit("letter"), F.col("entry"))
    other = lambda i: with_letter("s", F.col("pos"), F.get(others, F.pmod(k + i, F.size(others))))
    return m.select("entry", F.col("s").alias("original"), "mutated", other(1).alias("alternative"), other(2).alias("baseline"))


_WINS = [("orig", "mut"), ("orig", "alt"), ("orig", "base"), ("mut", "alt"), ("mut", "base"), ("alt", "base")]


@query(
    f"""WITH {_MUT}, {_NEAR}, q AS (SELECT CASE WHEN pos = 0 THEN '^' ELSE substr(s, pos, 1) END AS prev, CASE WHEN pos + 2 > length(s) THEN '^' ELSE substr(s, pos + 2, 1) END AS next, orig, mut, others[(k + 1) % len(others) + 1] AS alt, others[(k + 2) % len(others) + 1] AS base FROM m JOIN o USING (entry, s, pos, orig)),
w AS (SELECT {", ".join(f"coalesce((SELECT n FROM n WHERE n.prev = q.prev AND n.next = q.next AND n.letter = q.{x}), 0) AS {x}" for x in ("orig", "mut", "alt", "base"))} FROM q)
SELECT count(*) AS positions, {", ".join(f"round(count(*) FILTER ({a} > {b}) / count(*)::DOUBLE, 9) AS {a}_wins_vs_{b}" for a, b in _WINS)} FROM w"""
)
def win_rates(s: SparkSession, d: str) -> DataFrame:
    x = M.win_rates(_four(s, d), M.neighbour_scores(proteins(s, d), "s"))
    return x.select("positions", *(F.round(f"{a}_wins_vs_{b}", 9).alias(f"{a}_wins_vs_{b}") for a, b in _WINS))


@query()
def unit_replacement_experiment(s: SparkSession, d: str) -> DataFrame:
    """The learned family vocabulary's replacements over all proteins, scored."""
    v = _family(s, d)
    e = encode(proteins(s, d), "s", _model(v)).select(F.lit("family").alias("config_id"), F.col("entry").alias("seq_id"), F.col("encoding.token").alias("tokens"))
    changed = M.replaced_sequences(e, first_alternatives(v, class_matrix()))
    return changed.groupBy("config_id").agg(F.count("*").alias("sequences"), F.sum("changes").alias("changes"), F.sum("score").alias("score"))


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS key, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2, 3")
def streaming_event_counts(s: SparkSession, d: str) -> DataFrame:
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = new_path(s, "stream")
    counts = windowed_counts(stream, "ts", "event_type", window="1 hour", late="1 hour").select(F.col("start"), F.col("end"), "key", "n")
    run_once(counts, path, path + "-checkpoint")
    return s.read.schema("start timestamp, end timestamp, key string, n long").parquet(path)


@query('SELECT substr(sequence, i, 1) AS "left", substr(sequence, i + 1, 1) AS "right", count(*) AS cnt FROM (SELECT sequence, unnest(range(1, length(sequence))) AS i FROM uniref50_representatives) GROUP BY 1, 2')
def streaming_pair_counts(s: SparkSession, d: str) -> DataFrame:
    """Running counts of adjacent pairs over sequences as they arrive."""
    stream = s.readStream.schema(table(s, d, "uniref50_representatives").schema).parquet(f"{d}/uniref50_representatives.parquet*")
    path = new_path(s, "stream")
    run_to_table(pair_counts(stream, "sequence"), path, path + "-checkpoint")
    return s.read.schema("left string, right string, cnt long").parquet(path)
