"""Vocabulary, segmentation, variant, topic and ontology operators with their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ids import ACCESSION_SQL, GO_SQL, canonical_accession, canonical_go
from seqweave.functions.sequences import differing_positions, kmers, mutation_code, tokens_over, with_letter
from seqweave.operators import genealogy as G
from seqweave.operators import ontology as O
from seqweave.operators import segmentation as S
from seqweave.operators import substitution as B
from seqweave.operators import topics as T
from seqweave.operators import variants as V
from seqweave.operators.corpus import adjacent_pairs, undersampled
from seqweave.plans.tables import table
from seqweave.session import written

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@lru_cache
def matrix() -> dict:
    return B.class_matrix()


SUBST = f"subst(a, b, score) AS (VALUES {B.matrix_values(B.class_matrix())})"
VOCAB = "v AS (SELECT config_id, token, x.* FROM (SELECT config_id, token, min({'token_id': token_id, 'frequency': frequency, 'merge_order': merge_order, 'pair': pair, 'parent': parent, 'similarity': similarity, 'is_parent': is_parent}) AS x FROM vocab_entries GROUP BY 1, 2))"
PROTEINS = "p AS (SELECT entry, any_value(sequence) AS s FROM proteins WHERE sequence <> '' GROUP BY 1)"


def vocab(s: SparkSession, d: str) -> DataFrame:
    return G.vocabulary(table(s, d, "vocab_entries"))


def proteins(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "proteins").filter("sequence <> ''").groupBy("entry").agg(F.min("sequence").alias("s"))


# ---------------------------------------------------------------- substitution

_CUT = 0.8


@query(
    f"""WITH RECURSIVE {SUBST}, t AS (SELECT DISTINCT token FROM vocab_entries WHERE length(token) BETWEEN 3 AND 12),
own AS (SELECT a, score AS s FROM subst WHERE a = b AND a <> 'X'),
n AS (SELECT token, sum(s) AS total FROM (SELECT token, unnest(string_split(token, '')) AS a FROM t) JOIN own USING (a) GROUP BY 1),
c AS (SELECT o.a, x.b AS c, o.s - x.score AS loss FROM own o JOIN subst x USING (a) WHERE x.score >= 0),
w AS (SELECT token, total, '' AS m, 0 AS lost, 0 AS i FROM n
      UNION ALL
      SELECT w.token, total, m || coalesce(c.c, substr(w.token, i + 1, 1)), lost + coalesce(c.loss, 0), i + 1 FROM w LEFT JOIN c ON c.a = substr(w.token, i + 1, 1)
      WHERE i < length(w.token) AND (c.loss IS NULL OR c.loss = 0 OR c.loss < {1 - _CUT} * total - 1e-9) AND lost + coalesce(c.loss, 0) <= {1 - _CUT} * total + 1e-9)
SELECT token, m AS mutated, round(1 - lost / total::DOUBLE, 9) AS similarity FROM w WHERE i = length(token) AND m <> token"""
)
def mutation_neighbours(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "vocab_entries").select("token").distinct().filter(F.length("token").between(3, 12))
    return t.select("token", F.inline(B.mutations("token", matrix(), _CUT))).select("token", "mutated", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {SUBST} SELECT m.a AS orig, m.b AS mut, x.b AS alt, (x.score - m.score)::DOUBLE AS gain FROM subst m JOIN subst x ON x.a = m.a AND x.score >= m.score AND x.b NOT IN (m.a, m.b) WHERE m.a <> m.b AND 'X' NOT IN (m.a, m.b, x.b)")
def substitution_alternatives(s: SparkSession, d: str) -> DataFrame:
    m = B.matrix_frame(s, {k: v for k, v in matrix().items() if "X" not in k})
    x = m.select("a", F.col("b").alias("alt"), F.col("score").alias("alt_score"))
    return m.filter("a <> b").join(x, "a").filter("alt_score >= score AND alt <> a AND alt <> b").select(F.col("a").alias("orig"), F.col("b").alias("mut"), "alt", (F.col("alt_score") - F.col("score")).alias("gain"))


@query(
    f"""WITH {VOCAB}, {SUBST}, alt AS (SELECT m.a AS o, m.b AS mu, x.b AS al, x.score - m.score AS gain FROM subst m JOIN subst x ON x.a = m.a AND x.score >= m.score AND x.b NOT IN (m.a, m.b) WHERE m.a <> m.b AND 'X' NOT IN (m.a, m.b, x.b)),
k AS (SELECT * FROM v WHERE parent IS NOT NULL),
pr AS (SELECT a.config_id, a.parent, a.token, b.token AS mutation, b.token_id AS pool_id, b.merge_order AS mo FROM k a JOIN k b ON a.config_id = b.config_id AND a.parent = b.parent AND a.token <> b.token AND length(a.token) = length(b.token)),
cand AS (SELECT pr.*, v.token AS alternative, v.parent AS ap, unnest(range(1, length(pr.token) + 1)) AS i FROM pr JOIN v ON v.config_id = pr.config_id AND length(v.token) = length(pr.token) AND v.merge_order > pr.mo AND v.token <> pr.token AND v.token <> pr.parent),
sc AS (SELECT config_id, token, mutation, pool_id, alternative, sum(CASE WHEN substr(token, i, 1) = substr(mutation, i, 1) THEN CASE WHEN substr(alternative, i, 1) = substr(token, i, 1) THEN 0 END ELSE alt.gain END) AS score,
       count(CASE WHEN substr(token, i, 1) = substr(mutation, i, 1) THEN CASE WHEN substr(alternative, i, 1) = substr(token, i, 1) THEN 1 END ELSE alt.gain END) AS ok, count(*) AS n
       FROM cand LEFT JOIN alt ON o = substr(token, i, 1) AND mu = substr(mutation, i, 1) AND al = substr(alternative, i, 1) WHERE NOT coalesce(ap = parent, false) GROUP BY 1, 2, 3, 4, 5)
SELECT config_id, token, mutation, alternative, score::DOUBLE AS score FROM sc WHERE ok = n QUALIFY row_number() OVER (PARTITION BY config_id, token ORDER BY pool_id, score DESC, alternative) = 1"""
)
def alternative_replacement(s: SparkSession, d: str) -> DataFrame:
    return B.first_alternatives(vocab(s, d), matrix())


# ---------------------------------------------------------------- genealogy


@query(f"WITH {VOCAB} SELECT config_id, token AS family, token AS member, true AS is_head FROM v WHERE is_parent UNION ALL SELECT config_id, parent, token, false FROM v WHERE parent IS NOT NULL")
def family_members(s: SparkSession, d: str) -> DataFrame:
    return G.families(vocab(s, d))


_ROLES = f"""{VOCAB}, m AS (SELECT config_id, token_id, token AS child, pair[1] AS l, pair[2] AS r FROM v WHERE pair[1] IS NOT NULL AND pair[2] IS NOT NULL),
ro AS (SELECT config_id, token_id, l AS token, 'child' AS kind, child AS other FROM m UNION ALL SELECT config_id, token_id, r, 'child', child FROM m WHERE l <> r
       UNION ALL SELECT config_id, token_id, l, 'right', r FROM m WHERE l <> r UNION ALL SELECT config_id, token_id, r, 'left', l FROM m WHERE l <> r
       UNION ALL SELECT config_id, token_id, l, 'self', child FROM m WHERE l = r UNION ALL SELECT config_id, token_id, parent, 'mutation', token FROM v WHERE parent IS NOT NULL),
ag AS (SELECT config_id, token, {", ".join(f"array_to_string(list(other ORDER BY token_id, other) FILTER (kind = '{k}'), ' ') AS {n}" for k, n in (("child", "child_pair"), ("mutation", "child_mutation"), ("left", "partner_left"), ("right", "partner_right")))}, bool_or(kind = 'self') AS partner_self FROM ro GROUP BY 1, 2)"""


@query(f"WITH {_ROLES} SELECT config_id, token, v.token_id, frequency, merge_order, parent, {', '.join(f'coalesce({n}, {chr(39)}{chr(39)}) AS {n}' for n in ('child_pair', 'child_mutation', 'partner_left', 'partner_right'))}, coalesce(partner_self, false) AS partner_self FROM v LEFT JOIN ag USING (config_id, token)")
def lineage(s: SparkSession, d: str) -> DataFrame:
    x = G.lineage(vocab(s, d))
    return x.select("config_id", "token", "token_id", "frequency", "merge_order", "parent", *(F.array_join(c, " ").alias(c) for c in ("child_pair", "child_mutation", "partner_left", "partner_right")), "partner_self")


@query(f"WITH {VOCAB} SELECT config_id, count(*) AS v_size, round(count(*) FILTER (is_parent) / count(*)::DOUBLE, 9) AS p_ratio, round(count(parent) / count(*)::DOUBLE, 9) AS m_ratio, round(avg(length(token)), 9) AS ulength_mean, round(stddev_samp(length(token)), 9) AS ulength_std FROM v GROUP BY 1")
def vocabulary_stats(s: SparkSession, d: str) -> DataFrame:
    x = G.vocabulary_stats(vocab(s, d)).orderBy("config_id")
    return x.select("config_id", "v_size", *(F.round(c, 9).alias(c) for c in ("p_ratio", "m_ratio", "ulength_mean", "ulength_std")))


_USE = "u AS (SELECT CASE WHEN organism_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, unnest(list_transform(range(1, length(sequence) + 1, 4), lambda i: substr(sequence, i, 4))) AS token FROM proteins WHERE sequence <> ''), a AS (SELECT token, count(*) AS n FROM u WHERE side = 'a' GROUP BY 1), b AS (SELECT token, count(*) AS n FROM u WHERE side = 'b' GROUP BY 1)"


def _shared(s: SparkSession, d: str, compat: bool) -> DataFrame:
    p = table(s, d, "proteins").filter("sequence <> ''").select((F.col("organism_id") % 2).alias("side"), F.explode(kmers("sequence", 4)).alias("token"))
    a, b = (p.filter(F.col("side") == k).groupBy("token").agg(F.count("*").alias("n")) for k in (0, 1))
    x = G.shared_units(a, b, compat)
    return x.select("shared", *(F.round(c, 9).alias(c) for c in ("shared_ratio", "used_ratio_a", "used_ratio_b")))


@query(f"WITH {_USE} SELECT count(b.n) AS shared, round(count(b.n) / count(*)::DOUBLE, 9) AS shared_ratio, round(sum(a.n) FILTER (b.n IS NOT NULL) / sum(a.n)::DOUBLE, 9) AS used_ratio_a, round(sum(b.n) / (SELECT sum(n) FROM b)::DOUBLE, 9) AS used_ratio_b FROM a LEFT JOIN b USING (token)")
def shared_unit_ratio(s: SparkSession, d: str) -> DataFrame:
    return _shared(s, d, False)


@query(f"WITH {_USE} SELECT count(b.n) AS shared, round(count(b.n) / count(*)::DOUBLE, 9) AS shared_ratio, round(sum(a.n) FILTER (b.n IS NOT NULL) / (SELECT sum(n) FROM b)::DOUBLE, 9) AS used_ratio_a, round(sum(b.n) / sum(a.n)::DOUBLE, 9) AS used_ratio_b FROM a LEFT JOIN b USING (token)")
def shared_unit_ratio_compat(s: SparkSession, d: str) -> DataFrame:
    return _shared(s, d, True)


@query(
    f"""WITH {VOCAB}, i AS (SELECT x.config_id AS a, y.config_id AS b, count(*) AS shared FROM v x JOIN v y USING (token) GROUP BY 1, 2), z AS (SELECT config_id AS a, count(*) AS size FROM v GROUP BY 1),
c AS (SELECT regexp_extract(a, '_([a-z]+[0-9]+)_', 1) AS class_a, regexp_extract(b, '_([a-z]+[0-9]+)_', 1) AS class_b, shared / size::DOUBLE AS identity FROM i JOIN z USING (a) WHERE a <> b)
SELECT class_a, class_b, count(*) AS n, round(avg(identity), 9) AS mean_identity, round(stddev_pop(identity), 9) AS sd_identity FROM c WHERE class_a <= class_b GROUP BY 1, 2"""
)
def vocab_identity(s: SparkSession, d: str) -> DataFrame:
    i = G.vocabulary_identity(vocab(s, d)).filter("config_a <> config_b")
    kind = lambda c: F.regexp_extract(c, "_([a-z]+[0-9]+)_", 1)
    return i.select(kind("config_a").alias("class_a"), kind("config_b").alias("class_b"), "identity").filter("class_a <= class_b").groupBy("class_a", "class_b").agg(F.count("*").alias("n"), F.round(F.avg("identity"), 9).alias("mean_identity"), F.round(F.stddev_pop("identity"), 9).alias("sd_identity"))


@query()
def random_vocabulary_clone(s: SparkSession, d: str) -> DataFrame:
    return G.random_clone(vocab(s, d), V.LETTERS)


_GRID = "SELECT 0.0001 + k * (40 - 0.0001) / 999 AS x FROM range(0, 1000) r(k)"


@query(
    f"""WITH {VOCAB}, f AS (SELECT config_id, parent, count(*) AS size FROM v WHERE parent IS NOT NULL GROUP BY 1, 2), h AS (SELECT config_id, stddev_samp(size) * pow(count(*), -0.2) AS h, count(*) AS n FROM f GROUP BY 1), g AS ({_GRID})
SELECT config_id, round(x, 6)::DOUBLE AS x, round(sum(exp(-pow((x - size) / h, 2) / 2)) / any_value(n * h * sqrt(2 * 3.141592653589793)), 6) AS density FROM f JOIN h USING (config_id) CROSS JOIN g WHERE h > 0 GROUP BY 1, 2"""
)
def family_size_density(s: SparkSession, d: str) -> DataFrame:
    f = vocab(s, d).filter("parent IS NOT NULL").groupBy("config_id", "parent").agg(F.count("*").alias("size"))
    grid = s.range(1000).select((F.lit(0.0001) + F.col("id") * (40 - 0.0001) / 999).alias("x"))
    return G.gaussian_density(f, "config_id", "size", grid).select("config_id", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query(f"WITH {VOCAB}, f AS (SELECT config_id, parent, count(*) + 1 AS size FROM v WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT config_id, count(*) AS families, round(avg(size), 9) AS mean_size, max(size) AS max_size, min(size) AS min_size, sum(size)::BIGINT AS members, quantile_cont(size, 0.5) AS median_size FROM f GROUP BY 1")
def family_size_stats(s: SparkSession, d: str) -> DataFrame:
    f = vocab(s, d).filter("parent IS NOT NULL").groupBy("config_id", "parent").agg((F.count("*") + 1).alias("size"))
    return f.groupBy("config_id").agg(F.count("*").alias("families"), F.round(F.avg("size"), 9).alias("mean_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.sum("size").alias("members"), F.percentile("size", F.lit(0.5)).alias("median_size"))


# ---------------------------------------------------------------- segmentation

_CUTS = f"""{PROTEINS}, c AS (SELECT entry, length(s) AS n, list_distinct(list_append(range(0, length(s), 3), length(s))) AS x, list_distinct(list_append(range(0, length(s), 4), length(s))) AS y, list_distinct(list_append(range(0, length(s), 5), length(s))) AS z FROM p)"""


def _three(s: SparkSession, d: str) -> DataFrame:
    return proteins(s, d).select("entry", *(kmers("s", k).alias(f"t{k}") for k in (3, 4, 5)))


@query(f"WITH {_CUTS} SELECT entry, round(2 * len(list_intersect(x, y)) / (len(x) + len(y))::DOUBLE, 9) AS dice, round((n + 1 - len(x) - len(y) + 2 * len(list_intersect(x, y))) / (n + 1)::DOUBLE, 9) AS accuracy, round(3 * len(list_intersect(list_intersect(x, y), z)) / (len(x) + len(y) + len(z))::DOUBLE, 9) AS kway FROM c")
def boundary_agreement(s: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("t3"), F.col("t4"), F.col("t5")
    return _three(s, d).select("entry", F.round(S.boundary_dice(a, b), 9).alias("dice"), F.round(S.boundary_accuracy(a, b), 9).alias("accuracy"), F.round(S.kway_dice(a, b, c), 9).alias("kway"))


@query(
    f"""WITH {PROTEINS}, r AS (SELECT entry, length(s) AS n, unnest(range(0, length(s))) AS i FROM p), a AS (SELECT entry, i // 3 AS u, i // 4 AS w, any_value(n) AS n, count(*) AS m FROM r GROUP BY 1, 2, 3),
t AS (SELECT entry, any_value(n) AS n, sum(m * (m - 1) / 2)::BIGINT AS tp FROM a GROUP BY 1), ia AS (SELECT entry, sum(m * (m - 1) / 2)::BIGINT AS v FROM (SELECT entry, u, sum(m) AS m FROM a GROUP BY 1, 2) GROUP BY 1), ib AS (SELECT entry, sum(m * (m - 1) / 2)::BIGINT AS v FROM (SELECT entry, w, sum(m) AS m FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT entry, tp, ia.v - tp AS fp, ib.v - tp AS fn, round((n * (n - 1) // 2 + 2 * tp - ia.v - ib.v) / nullif(n * (n - 1) // 2, 0)::DOUBLE, 9) AS rand, round(2 * tp / (ia.v + ib.v + 1e-10), 9) AS dice, round(tp / (ia.v + ib.v - tp + 1e-10), 9) AS jaccard FROM t JOIN ia USING (entry) JOIN ib USING (entry)"""
)
def pair_rand_dice_jaccard(s: SparkSession, d: str) -> DataFrame:
    x = _three(s, d).select("entry", S.pair_indices(F.col("t3"), F.col("t4")).alias("x"))
    return x.select("entry", "x.tp", "x.fp", "x.fn", *(F.round(f"x.{c}", 9).alias(c) for c in ("rand", "dice", "jaccard")))


# ---------------------------------------------------------------- variants

_HASH = "cast(('0x' || substr(md5({}), 1, 7)) AS INT)"
_MUT = f"""{PROTEINS}, r AS (SELECT entry, s, {_HASH.format("'25|pos|' || entry")} % length(s) AS pos, {_HASH.format("'25|letter|' || entry")} AS k FROM p),
o AS (SELECT *, substr(s, pos + 1, 1) AS orig, list_filter(string_split('{V.LETTERS}', ''), lambda x: x <> substr(s, pos + 1, 1)) AS others FROM r),
m AS (SELECT entry, s, pos, orig, others[k % len(others) + 1] AS mut, substr(s, 1, pos) || others[k % len(others) + 1] || substr(s, pos + 2) AS mutated FROM o)"""


def _mutated(s: SparkSession, d: str) -> DataFrame:
    return V.random_mutations(proteins(s, d), "entry", "s")


@query(f"WITH {_MUT} SELECT entry, pos, orig, mut, md5(mutated) AS digest FROM m")
def random_point_mutations(s: SparkSession, d: str) -> DataFrame:
    return _mutated(s, d).select("entry", "pos", "orig", "mut", F.md5("mutated").alias("digest"))


_CODE = f"WITH {_MUT}, c AS (SELECT entry, mutated, orig || (pos + 1) || mut AS code FROM m)"


@query(_CODE + " SELECT entry, code, md5(substr(mutated, 1, CAST(regexp_extract(code, '[0-9]+') AS INT) - 1) || substr(code, 1, 1) || substr(mutated, CAST(regexp_extract(code, '[0-9]+') AS INT) + 1)) AS original FROM c")
def reversed_mutation_codes(s: SparkSession, d: str) -> DataFrame:
    m = _mutated(s, d).select("entry", "mutated", F.concat("orig", F.col("pos") + 1, "mut").alias("code")).withColumn("c", mutation_code("code"))
    # letters outside A to Z give no code; the test data have none
    return m.select("entry", "code", F.md5(with_letter("mutated", F.col("c.pos"), F.col("c.orig"))).alias("original"))


@query(f"WITH {_MUT} SELECT entry, l::INT AS n, i::INT AS start, substr(s, i + 1, l) AS token FROM m CROSS JOIN range(1, 11) a(l), range(0, length(s)) b(i) WHERE i <= pos AND i + l > pos AND i + l <= length(s)")
def tokens_over_position(s: SparkSession, d: str) -> DataFrame:
    m = _mutated(s, d)
    toks = tokens_over(F.col("pos"), "s", 10)
    return m.select("entry", "pos", F.posexplode(toks).alias("k", "token"), F.length("s").alias("len")).withColumn("n", F.length("token")).select("entry", "n", "token", "pos", "len", "k").withColumn("first", F.greatest(F.lit(0), F.col("pos") - F.col("n") + 1)).withColumn("start", F.col("first") + F.rank().over(_by_token()) - 1).select("entry", "n", "start", "token")


def _by_token():
    from pyspark.sql import Window as W

    return W.partitionBy("entry", "n").orderBy("k")


#: A segmentation any engine can make: a cut after each K or R.
_TRYPTIC = "[^KR]*[KR]|[^KR]+$"
_KIN = {x: str(i) for i, c in enumerate(B.CLASSES) for x in c}
_FROM, _TO = "".join(sorted(_KIN)), "".join(_KIN[x] for x in sorted(_KIN))
_JUDGED = f"""{_MUT}, t AS (SELECT *, regexp_extract_all(s, '{_TRYPTIC}') AS a, regexp_extract_all(mutated, '{_TRYPTIC}') AS b FROM m),
j AS (SELECT *, list_transform(a, lambda x: length(x)) = list_transform(b, lambda x: length(x)) AS same, len(regexp_extract_all(substr(s, 1, pos), '[KR]')) + 1 AS ia FROM t),
k AS (SELECT *, same AND translate(a[ia], '{_FROM}', '{_TO}') = translate(b[ia], '{_FROM}', '{_TO}') AS is_sibling, {_HASH.format("'bin|' || entry")} % 3 AS bin FROM j)"""


def _judged_variants(s: SparkSession, d: str) -> DataFrame:
    cut = lambda c: F.regexp_extract_all(c, F.lit(_TRYPTIC), F.lit(0))
    kin = lambda x: F.translate(x, _FROM, _TO)
    m = _mutated(s, d).withColumn("a", cut("s")).withColumn("b", cut("mutated"))
    from seqweave.functions.sequences import hashed_number

    return V.judged(m, "a", "b", "pos", lambda x, y: kin(x) == kin(y)).withColumn("bin", hashed_number(F.lit("bin"), F.col("entry")) % 3)


@query(f"WITH {_JUDGED} SELECT bin, count(*) AS n, round(count(*) FILTER (same) / count(*)::DOUBLE, 9) AS same_idx, round(count(*) FILTER (is_sibling) / nullif(count(*) FILTER (same), 0)::DOUBLE, 9) AS sibling_rate FROM k GROUP BY 1")
def same_index_sibling_rate(s: SparkSession, d: str) -> DataFrame:
    x = V.sibling_rates(_judged_variants(s, d), "bin")
    return x.select("bin", "n", F.round("same_idx", 9).alias("same_idx"), F.round("sibling_rate", 9).alias("sibling_rate"))


@query(f"WITH {_JUDGED} SELECT count(*) FILTER (same AND bin = 1) AS same_count_pos, count(*) FILTER (same AND bin <> 1) AS same_count_neg, count(*) FILTER (is_sibling AND bin = 1) AS sibling_count_pos, count(*) FILTER (is_sibling AND bin <> 1) AS sibling_count_neg FROM k")
def variant_bins(s: SparkSession, d: str) -> DataFrame:
    return V.bin_counts(_judged_variants(s, d), "bin")


@query(
    f"""WITH {_MUT}, z AS (SELECT entry, s, mutated, reverse(s) AS alt FROM m), i AS (SELECT *, unnest(range(0, length(s))) AS i FROM z)
SELECT entry, count(*) AS n, sum(i)::BIGINT AS total FROM i WHERE substr(s, i + 1, 1) <> substr(mutated, i + 1, 1) AND substr(s, i + 1, 1) <> substr(alt, i + 1, 1) GROUP BY 1"""
)
def differing_position_finder(s: SparkSession, d: str) -> DataFrame:
    x = _mutated(s, d).select("entry", F.explode(differing_positions(F.col("s"), F.col("mutated"), F.reverse("s"))).alias("i"))
    return x.groupBy("entry").agg(F.count("*").alias("n"), F.sum("i").alias("total"))


# ---------------------------------------------------------------- topics and graph

_CC = "x AS (SELECT subcellular_location AS class, term, count(*) AS n FROM (SELECT subcellular_location, unnest(list_transform(range(1, length(sequence) + 1, 3), lambda i: substr(sequence, i, 3))) AS term FROM proteins WHERE sequence <> '' AND subcellular_location IS NOT NULL) GROUP BY 1, 2)"
_DF = "f AS (SELECT * FROM x WHERE term IN (SELECT term FROM x GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(DISTINCT class) FROM x)))"
_TFIDF = "SELECT class, term, sqrt(n / sum(n) OVER (PARTITION BY class)) * ln(1 + trunc((SELECT avg(t) FROM (SELECT sum(n) AS t FROM {t} GROUP BY class))) / sum(n) OVER (PARTITION BY term)) AS weight FROM {t}"


def _class_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "proteins").filter("sequence <> ''").select("subcellular_location", kmers("sequence", 3).alias("t"))
    return T.df_filtered(T.class_counts(p, "subcellular_location", "t"), max_df=0.9, min_df=2)


@query(f"WITH {_CC}, {_DF} SELECT class, term, round(weight, 8) AS weight FROM ({_TFIDF.format(t='f')})")
def ctfidf_standard(s: SparkSession, d: str) -> DataFrame:
    return T.class_tfidf(_class_counts(s, d)).select("class", "term", F.round("weight", 8).alias("weight"))


@query(f"WITH {_CC}, {_DF}, w AS (SELECT class, term, round(weight, 8) AS weight FROM ({_TFIDF.format(t='f')})) SELECT class, term, row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS rank FROM w QUALIFY rank <= 10")
def topic_top_terms(s: SparkSession, d: str) -> DataFrame:
    return T.top_terms(T.class_tfidf(_class_counts(s, d)).select("class", "term", F.round("weight", 8).alias("weight")), 10).select("class", "term", F.col("rank").cast("long").alias("rank"))


_EDGES = f"""{VOCAB}, e AS (SELECT DISTINCT config_id, src, dst, kind FROM (SELECT config_id, unnest(pair) AS src, token AS dst, 'pair' AS kind FROM v UNION ALL SELECT config_id, parent, token, 'mutation' FROM v) WHERE src IS NOT NULL AND src <> dst),
k AS (SELECT * FROM e WHERE kind = 'mutation'),
l AS (SELECT config_id, src AS a, dst AS b, 1 AS r, 1.0 AS w FROM e WHERE kind = 'pair' UNION ALL SELECT config_id, dst, src, 1, 1.0 FROM e WHERE kind = 'pair' UNION ALL SELECT config_id, src, dst, 2, 2.0 FROM k UNION ALL SELECT config_id, dst, src, 2, 2.0 FROM k
      UNION ALL SELECT x.config_id, x.dst, y.dst, 3, 3.0 FROM k x JOIN k y ON x.config_id = y.config_id AND x.src = y.src AND x.dst <> y.dst),
g AS (SELECT config_id, a, b, max_by(w, r)::DOUBLE AS weight FROM l GROUP BY 1, 2, 3)"""
_EACH = ("config_id",)


def _graph(s: SparkSession, d: str) -> DataFrame:
    return T.unit_graph(G.edges(vocab(s, d)), by=_EACH)


@query(f"WITH {_EDGES} SELECT config_id, a, b, weight FROM g")
def unit_graph(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)


_SMOOTH = _EDGES + """, u AS (SELECT DISTINCT config_id, a AS unit FROM g UNION SELECT config_id, token FROM v), sm AS (SELECT config_id, a, b, sum(value) AS value FROM (SELECT config_id, a, b, 0.5 * weight / sum(weight) OVER (PARTITION BY config_id, b) AS value FROM g UNION ALL SELECT config_id, unit, unit, 0.5 FROM u) GROUP BY 1, 2, 3)"""


def _smoothing(s: SparkSession, d: str) -> DataFrame:
    g = _graph(s, d)
    units = g.select("config_id", F.col("a").alias("unit")).union(table(s, d, "vocab_entries").select("config_id", "token")).distinct()
    return T.smoothing(g, units, 0.5, by=_EACH)


@query(f"WITH {_SMOOTH} SELECT config_id, a, b, round(value, 9) AS value FROM sm")
def smoothing_matrix(s: SparkSession, d: str) -> DataFrame:
    return _smoothing(s, d).select("config_id", "a", "b", F.round("value", 9).alias("value"))


_AWARE = "y AS (SELECT config_id, class, b AS term, sum(n * value) AS n FROM c JOIN sm ON term = a GROUP BY 1, 2, 3) SELECT config_id, class, term, round(sqrt(n / sum(n) OVER (PARTITION BY config_id, class)) * ln(1 + trunc(sum(n) OVER (PARTITION BY config_id) / classes) / sum(n) OVER (PARTITION BY config_id, term)), 7) AS weight FROM y JOIN (SELECT config_id, count(DISTINCT class) AS classes FROM y GROUP BY 1) USING (config_id)"


def _aware(s: SparkSession, d: str, p: DataFrame) -> DataFrame:
    counts = T.smoothed_counts(T.class_counts(p, "class", "t"), _smoothing(s, d), by=_EACH)
    return T.class_tfidf(counts, by=_EACH).select("config_id", "class", "term", F.round("weight", 7).alias("weight"))


@query(f"WITH {_SMOOTH}, {_CC.replace('x AS', 'c AS', 1)}, {_AWARE}")
def ctfidf_graph_aware(s: SparkSession, d: str) -> DataFrame:
    """Term weights of the classes as the graph of each tokenizer spreads the counts."""
    p = table(s, d, "proteins").filter("sequence <> ''").select(F.col("subcellular_location").alias("class"), kmers("sequence", 3).alias("t"))
    return _aware(s, d, p)


_DEALT = f"""{PROTEINS}, lab AS (SELECT entry, min(subcellular_location) AS class FROM proteins GROUP BY 1), q AS (SELECT entry, s, class FROM p JOIN lab USING (entry) WHERE class IS NOT NULL),
o AS (SELECT s, row_number() OVER (ORDER BY md5('42|' || entry), entry) AS n FROM q), w AS (SELECT class, row_number() OVER (ORDER BY class, entry) AS n FROM q),
c AS (SELECT class, term, count(*) AS n FROM (SELECT class, unnest(list_transform(range(1, length(s) + 1, 3), lambda i: substr(s, i, 3))) AS term FROM o JOIN w USING (n)) GROUP BY 1, 2)"""


@query(f"WITH {_SMOOTH}, {_DEALT}, {_AWARE}")
def ctfidf_permuted(s: SparkSession, d: str) -> DataFrame:
    """The same with the labels dealt anew among the proteins: the null model."""
    p = table(s, d, "proteins").filter("sequence <> ''").groupBy("entry").agg(F.min("sequence").alias("s"))
    lab = table(s, d, "proteins").groupBy("entry").agg(F.min("subcellular_location").alias("class"))
    q = T.permuted(p.join(lab.filter("class IS NOT NULL"), "entry"), "entry", "class")
    return _aware(s, d, q.select("class", kmers("s", 3).alias("t")))


_MEAN = "e AS (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2), c AS (SELECT x.label AS a, y.label AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS cosine FROM e x JOIN e y USING (pos) WHERE x.label < y.label GROUP BY 1, 2)"


def _cosines(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("label").alias("id"), F.posexplode("embedding").alias("dim", "v"))
    return T.cosine_pairs(e.groupBy("id", "dim").agg(F.avg(F.col("v").cast("double")).alias("v")))


@query(f"WITH {_MEAN} SELECT a, b, round(cosine, 6) AS cosine FROM c")
def cosine_matrix(s: SparkSession, d: str) -> DataFrame:
    return _cosines(s, d).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_MEAN} SELECT a, b, round((cosine - min(cosine) OVER ()) / (max(cosine) OVER () - min(cosine) OVER ()), 6) AS scaled FROM c")
def scale_lower_triangle(s: SparkSession, d: str) -> DataFrame:
    return T.scaled(_cosines(s, d), "cosine").select("a", "b", F.round("scaled", 6).alias("scaled"))


@query(
    """WITH d AS (SELECT end_index - start_index AS x, length(description) AS y FROM interpro_entries WHERE start_index IS NOT NULL AND end_index IS NOT NULL AND description IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r"""
)
def spearman_similarity(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "interpro_entries").select((F.col("end_index") - F.col("start_index")).alias("x"), F.length("description").alias("y"))
    return T.spearman(i, "x", "y").select("n", F.round("rho", 8).alias("rho"))


_GO = f"q AS (SELECT row_id, {GO_SQL.format(c='go_id')} AS g, {ACCESSION_SQL.format(c='uniprot_id')} AS u FROM uniprot_quickgo_annotations)"


@query(f"WITH {_GO}, c AS (SELECT g, count(*) AS n FROM q GROUP BY 1), t AS (SELECT avg(n)::DOUBLE AS a FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= (SELECT count(*) // 4 FROM c)) SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY g ORDER BY md5('42|' || row_id), row_id) AS n FROM q) WHERE n <= (SELECT trunc(a) FROM t)")
def class_balance(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").select("row_id", canonical_go("go_id").alias("g"))
    t = T.balance_threshold(q.groupBy("g").agg(F.count("*").alias("n")), "n", 4)
    return undersampled(q, "g", F.col("row_id"), t).select("row_id")


_UP = "e AS (SELECT DISTINCT go_id AS child, unnest(is_a) AS parent FROM go_terms), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.ancestor)"


def _isa(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "go_terms").select(F.col("go_id").alias("child"), F.explode("is_a").alias("parent")).distinct()


@query(f"WITH RECURSIVE {_UP} SELECT child, ancestor FROM c")
def term_closure(s: SparkSession, d: str) -> DataFrame:
    return O.closure(_isa(s, d))


@query(f"WITH RECURSIVE {_UP}, {_GO}, h AS (SELECT DISTINCT u, g FROM q) SELECT DISTINCT h.u, h.g FROM h WHERE NOT EXISTS (SELECT 1 FROM h k JOIN c ON c.child = k.g AND c.ancestor = h.g AND c.child <> c.ancestor WHERE k.u = h.u)")
def closure_prune(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "uniprot_quickgo_annotations").select(canonical_accession("uniprot_id").alias("u"), canonical_go("go_id").alias("g")).distinct()
    return O.without_ancestors(q, "u", "g", O.closure(_isa(s, d)))


_SLIM = "sl AS (SELECT DISTINCT parent AS term FROM e WHERE parent IN (SELECT parent FROM e GROUP BY 1 HAVING count(*) >= 40))"


@query(
    f"""WITH RECURSIVE {_UP}, {_SLIM}, t AS (SELECT child AS t FROM e UNION SELECT parent FROM e), up AS (SELECT t AS term, t AS slim FROM t UNION SELECT child, ancestor FROM c), h AS (SELECT DISTINCT up.term, up.slim FROM up JOIN sl ON sl.term = up.slim)
SELECT term, slim FROM h WHERE NOT EXISTS (SELECT 1 FROM h k JOIN c ON c.child = k.slim AND c.ancestor = h.slim AND c.child <> c.ancestor WHERE k.term = h.term)"""
)
def slim_mapping(s: SparkSession, d: str) -> DataFrame:
    e = _isa(s, d)
    slim = e.groupBy("parent").count().filter("count >= 40").select(F.col("parent").alias("term"))
    return O.nearest_in(e, slim)


@query(
    f"""WITH {VOCAB}, m AS (SELECT config_id, regexp_extract(config_id, '_([a-z]+[0-9]+)_', 1) AS mat, regexp_extract(config_id, 'mutbpe_([0-9.]+)_', 1) AS cut, avg(length(token)) AS x FROM v GROUP BY 1), g AS (SELECT mat, cut, avg(x) AS x FROM m GROUP BY 1, 2)
SELECT a.mat, round(a.x - b.x, 9) AS diff FROM g a JOIN g b ON a.mat = b.mat AND a.cut = '0.8' AND b.cut = '0.9'"""
)
def cutoff_difference(s: SparkSession, d: str) -> DataFrame:
    m = vocab(s, d).groupBy("config_id").agg(F.avg(F.length("token")).alias("x"))
    g = m.groupBy(F.regexp_extract("config_id", "_([a-z]+[0-9]+)_", 1).alias("mat"), F.regexp_extract("config_id", "mutbpe_([0-9.]+)_", 1).alias("cut")).agg(F.avg("x").alias("x"))
    a, b = (g.filter(F.col("cut") == c).select("mat", F.col("x").alias(f"x{c[-1]}")) for c in ("0.8", "0.9"))
    return a.join(b, "mat").select("mat", F.round(F.col("x8") - F.col("x9"), 9).alias("diff"))


@query("SELECT entry, array_to_string(list_filter(list_transform(range(1, length(s) + 1, 4), lambda i: substr(s, i, 4)), lambda t: length(t) >= 4), ' ') AS document, s AS rebuilt FROM (SELECT entry, any_value(sequence) AS s FROM proteins WHERE sequence <> '' GROUP BY 1)")
def unit_documents(s: SparkSession, d: str) -> DataFrame:
    return proteins(s, d).select("entry", T.unit_documents(kmers("s", 4), 4).alias("document"), F.array_join(kmers("s", 4), "").alias("rebuilt"))


@query(
    f"""WITH {SUBST}, t AS (SELECT DISTINCT token FROM vocab_entries WHERE length(token) = 2 AND NOT regexp_matches(token, '[^A-IK-NP-TV-Z]')),
x AS (SELECT token, a1.b || a2.b AS mutated FROM t JOIN subst a1 ON a1.a = substr(token, 1, 1) JOIN subst a2 ON a2.a = substr(token, 2, 1) WHERE a1.score >= 0 AND a2.score >= 0 AND (a1.b = a1.a OR a2.b = a2.a)),
p AS (SELECT substr(sequence, i, 1) AS l, substr(sequence, i + 1, 1) AS r, count(*) AS cnt FROM (SELECT sequence, unnest(range(1, length(sequence))) AS i FROM proteins) GROUP BY 1, 2)
SELECT token, l AS "left", r AS "right", cnt FROM x JOIN p ON mutated = l || r"""
)
def pairs_spelling_mutations(s: SparkSession, d: str) -> DataFrame:
    """Adjacent pairs that spell a one-letter variant of a two-letter unit, or itself."""
    t = table(s, d, "vocab_entries").select("token").distinct().filter("length(token) = 2 AND NOT token RLIKE '[^A-IK-NP-TV-Z]'")
    m = B.matrix_frame(s, matrix()).filter("score >= 0")
    x, y = (m.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
    v = t.join(x, F.substr("token", F.lit(1), F.lit(1)) == F.col("a1")).join(y, F.substr("token", F.lit(2), F.lit(1)) == F.col("a2")).filter("a1 = b1 OR a2 = b2")
    p = adjacent_pairs(table(s, d, "proteins"))
    return v.select("token", F.concat("b1", "b2").alias("mutated")).join(p, F.col("mutated") == F.concat("left", "right")).select("token", "left", "right", "cnt")


@query(f"WITH RECURSIVE {_UP}, {_SLIM}, i AS (SELECT DISTINCT child, parent FROM e WHERE child IN (SELECT term FROM sl) AND parent IN (SELECT term FROM sl)) SELECT child, parent FROM i UNION ALL SELECT term, 'root' FROM sl WHERE term NOT IN (SELECT child FROM i)")
def slim_graph(s: SparkSession, d: str) -> DataFrame:
    e = _isa(s, d)
    return O.slim_graph(e, e.groupBy("parent").count().filter("count >= 40").select(F.col("parent").alias("term")))


_GC = "x AS (SELECT organism_id % 10 AS class, term, count(*) AS n FROM (SELECT organism_id, unnest(list_transform(range(1, length(sequence) + 1, 3), lambda i: substr(sequence, i, 3))) AS term FROM proteins WHERE sequence <> '' AND organism_id IS NOT NULL) GROUP BY 1, 2)"


_P_VALUE = """CASE WHEN abs(rho) < 1 AND n > 2 THEN round(greatest(0, 1 - 2 * (SELECT t / 6000 * sum(exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + pow(i * t / 2000, 2) / (n - 2), -(n - 1) / 2.0) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) FROM range(0, 2001) r(i))), 6) ELSE 0 END"""


@query(
    f"""WITH {_GC}, {_MEAN}, w AS ({_TFIDF.format(t='x')}), u AS (SELECT DISTINCT term FROM (SELECT term, row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 200),
rd AS (SELECT term FROM (SELECT DISTINCT term FROM w) ORDER BY md5('42|' || term), term LIMIT (SELECT count(*) FROM u)),
z AS (SELECT 'all' AS strategy, * FROM w UNION ALL SELECT 'top', * FROM w WHERE term IN (SELECT term FROM u) UNION ALL SELECT 'random', * FROM w WHERE term IN (SELECT term FROM rd)),
nn AS (SELECT strategy, class, sqrt(sum(weight * weight)) AS norm FROM z GROUP BY 1, 2), k AS (SELECT a.strategy, a.class AS a, b.class AS b, sum(a.weight * b.weight) AS dot FROM z a JOIN z b USING (strategy, term) WHERE a.class < b.class GROUP BY 1, 2, 3),
q AS (SELECT k.strategy, dot / n1.norm / n2.norm AS x, cosine AS y FROM k JOIN nn n1 ON n1.strategy = k.strategy AND n1.class = k.a JOIN nn n2 ON n2.strategy = k.strategy AND n2.class = k.b JOIN c ON c.a = k.a AND c.b = k.b),
r AS (SELECT strategy, rank() OVER (PARTITION BY strategy ORDER BY x) + (count(*) OVER (PARTITION BY strategy, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY strategy ORDER BY y) + (count(*) OVER (PARTITION BY strategy, y) - 1) / 2.0 AS ry FROM q),
f AS (SELECT strategy, count(*) AS n, corr(rx, ry) AS rho, abs(corr(rx, ry)) * sqrt((count(*) - 2) / (1 - corr(rx, ry) * corr(rx, ry))) AS t FROM r GROUP BY 1)
SELECT strategy, n, round(rho, 6) AS rho, {_P_VALUE} AS p FROM f"""
)
def profile_correlation(s: SparkSession, d: str) -> DataFrame:
    """Similarity of classes by their units against that by another profile: over all units, the
    heaviest, and as many drawn at random; with the probability of a rank correlation so far from 0."""
    p = table(s, d, "proteins").filter("sequence <> ''").select((F.col("organism_id") % 10).alias("g"), kmers("sequence", 3).alias("t"))
    e = table(s, d, "embeddings").select(F.col("label").alias("id"), F.posexplode("embedding").alias("dim", "v")).groupBy("id", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    w, e, rows = written(T.class_tfidf(T.class_counts(p, "g", "t")), "weights"), written(e, "profile"), []
    for strategy in ("all", "top", "random"):
        x = T.similarity_correlation(w, e, strategy=strategy, n=200).first()  # one row
        rows.append((strategy, x["n"], round(x["rho"], 6), round(T.spearman_p(x["n"], x["rho"]), 6)))
    return s.createDataFrame(rows, "strategy string, n long, rho double, p double")
