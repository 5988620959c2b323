"""Readers and writers on small files."""

import json

import pytest

from seqweave.operators.genealogy import random_clone, vocabulary
from seqweave.sources import readers as R
from seqweave.sources import sinks as K


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fasta", ">P1 one two\nACD\nEF\n>P2\n\n>P3 x\nAC DE\n")
    assert [tuple(r) for r in R.read_fasta(spark, p).orderBy("id").collect()] == [("P1", "one two", "ACDEF"), ("P2", None, ""), ("P3", "x", "ACDE")]
    df = spark.createDataFrame([("a", "ACDEFGH", 7, None), ("b", None, 1, "x"), ("c", "AC", 2, "y")], "uniprot_id string, sequence string, n int, note string")
    K.write_fasta(df, str(tmp_path / "out"), description=["n", "note"], wrap=3)
    back = R.read_fasta(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a", "n=7", "ACDEFGH"), ("c", "n=2 | note=y", "AC")]


def test_prosite_msa(spark, tmp_path):
    p = put(tmp_path / "x.msa", ">GIT_R|Q1/1-12: ARF|PS50/23.341\nAC--d\nE.F\n>MIC|Q9/2-4: ASX|PS10\nACD\n>broken header\nAAA\n")
    rows = R.read_prosite_msa(spark, p).orderBy("uniprot_id").collect()
    assert [tuple(r) for r in rows] == [("GIT_R", "Q1", 1, 12, "ARF", "PS50", 23.341, "ACDEF", "AC--dE.F"), ("MIC", "Q9", 2, 4, "ASX", "PS10", None, "ACD", "ACD")]
    assert [r["header"] for r in R.read_prosite_msa(spark, p, rejected=True).collect()] == ["broken header"]
    bad = ["", "a|b/1-2", "a|b/1-x: c|d", "a|b: c|d", "|b/1-2: c|d", "a|b/1-2: c", "a|b/1-2: |d/3"]
    p = put(tmp_path / "y.msa", "".join(f">{h}\nAC\n" for h in [*bad, "a|b/1-2: c|d/x: left"]))
    assert sorted(r["header"] for r in R.read_prosite_msa(spark, p, rejected=True).collect()) == sorted(bad)
    assert [r["score"] for r in R.read_prosite_msa(spark, p).collect()] == [None]


def test_prosite_dat(spark, tmp_path):
    text = "CC   head\n//\nID   ASN; PATTERN.\nAC   PS00001;\nDT   APR-1990.\nDE   N-site.\nPA   N-{P}-\nPA   [ST].\n//\nID   MAT; MATRIX.\nAC   PS2;\n//\nID   LAST; PATTERN.\nAC   PS3;\nDE   End.\nPA   A."
    rows = R.read_prosite_dat(spark, put(tmp_path / "p.dat", text)).orderBy("prosite_id").collect()
    assert [tuple(r) for r in rows] == [("ASN", "PS00001", "APR-1990.", "N-site", "N-{P}-[ST]"), ("LAST", "PS3", "", "End", "A")]


def test_go_mapping(spark, tmp_path):
    p = put(tmp_path / "m", "!note\n\nInterPro:IPR000003 Retinoid X > GO:DNA binding ; GO:0003677\nbad line\n")
    assert [tuple(r) for r in R.read_go_mapping(spark, p).collect()] == [("IPR000003", "Retinoid X", "GO:0003677", "DNA binding")]
    assert [r["line"] for r in R.read_go_mapping(spark, p, rejected=True).collect()] == ["bad line"]
    bad = ["InterPro:IPR1 > GO:x ; GO:1", "InterPro:PS1 x > GO:x ; GO:1", "Pfam:IPR1 x > GO:x ; GO:1", "InterPro:IPR1 x > x ; GO:1", "InterPro:IPR1 x > GO:x ; 1", "InterPro:IPR1 x > GO:x GO:1"]
    p = put(tmp_path / "n", "\n".join([*bad, "InterPro:IPR1 a > b > GO:c ; d ; GO:2"]))
    assert sorted(r["line"] for r in R.read_go_mapping(spark, p, rejected=True).collect()) == sorted(bad)
    assert [tuple(r) for r in R.read_go_mapping(spark, p).collect()] == [("IPR1", "a > b", "GO:2", "c ; d")]


def test_interpro_json(spark, tmp_path):
    entry = {"metadata": {"accession": "IPR1", "name": "n", "type": "family", "member_databases": {"pfam": {"PF1": "a"}, "smart": {"SM1": "b"}}}, "proteins": [{"entry_protein_locations": [{"fragments": [{"start": 1, "end": 9}, {"start": 20, "end": 30}]}]}]}
    put(tmp_path / "d" / "P1.json", json.dumps({"results": [entry, {"metadata": {"accession": "IPR2"}}]}))
    put(tmp_path / "d" / "P2.json", json.dumps({"count": 0}))
    rows = R.read_interpro_json(spark, str(tmp_path / "d")).orderBy("interpro_id", "start_index").collect()
    assert [tuple(r) for r in rows] == [("P1", "IPR1", "n", "family", ["PF1", "SM1"], 1, 9), ("P1", "IPR1", "n", "family", ["PF1", "SM1"], 20, 30), ("P1", "IPR2", None, None, None, None, None)]


def test_obo(spark, tmp_path):
    text = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: root\nnamespace: bp\n\n[Term]\nid: GO:2\nname: leaf\nnamespace: bp\nis_a: GO:1 ! root\nis_obsolete: true\n\n[Typedef]\nid: part_of\n"
    rows = R.read_obo(spark, put(tmp_path / "o.obo", text)).orderBy("go_id").collect()
    assert [tuple(r) for r in rows] == [("GO:1", "root", "bp", [], False), ("GO:2", "leaf", "bp", ["GO:1"], True)]


def test_matrix_and_csv(spark, tmp_path):
    m = R.read_matrix(spark, put(tmp_path / "M", "# c\n   A  R\nA  4 -1\nR -1  5\n"))
    assert m == {("A", "A"): 4.0, ("A", "R"): -1.0, ("R", "A"): -1.0, ("R", "R"): 5.0}
    for text in ("", "A R\n", "A R\nA 1 2\nR 1\n", "A\n" + "A 1\n" * 1000):
        with pytest.raises(ValueError):
            R.read_matrix(spark, put(tmp_path / "no", text))
    put(tmp_path / "t" / "HUMAN" / "a.csv", "mutant,score\nA1C,0.5\n")
    put(tmp_path / "t" / "b.csv", "mutant,score\nA2C,\n")
    assert R.read_csv_tree(spark, str(tmp_path / "t"), "mutant string, score double").count() == 2
    assert [r["mutant"] for r in R.read_csv_tree(spark, str(tmp_path / "t"), "mutant string, score double", "HUMAN").collect()] == ["A1C"]
    K.write_csv(spark.createDataFrame([("x", 1)], "a string, b int"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0]["a"] == "x"


def test_vocabulary_files(spark, tmp_path):
    v = {"A": {"frequency": 0, "order": 0}, "B": {"frequency": 0, "order": 0}, "AB": {"frequency": 3, "order": 1, "pair": ["A", "B"], "is_parent": True}, "AA": {"frequency": 2, "order": 2, "pair": ["A", "A"], "parent": "AB", "similarity": 0.9}}
    put(tmp_path / "v" / "cfg_bpe_4.json", json.dumps(v))
    put(tmp_path / "v" / "cfg_512000.json", "{}")
    df = R.read_vocabularies(spark, str(tmp_path / "v" / "cfg_bpe_4.json"))
    rows = df.orderBy("token_id").collect()
    assert [r["token"] for r in rows] == list(v) and rows[3]["parent"] == "AB" and rows[2]["pair"] == ["A", "B"] and rows[2]["is_parent"]
    assert R.config_files(spark, str(tmp_path / "v"), "cfg") == ["cfg_bpe_4.json"] and R.config_files(spark, str(tmp_path / "v"), "cfg", plain=False) == []
    tokenizers = pytest.importorskip("tokenizers")
    K.write_tokenizer(df, "cfg_bpe_4", str(tmp_path / "hf.json"))
    assert tokenizers.Tokenizer.from_file(str(tmp_path / "hf.json")).encode("AABAA").tokens == ["A", "AB", "AA"]


def test_random_clone_has_no_collisions(spark):
    rows = [("c", i, t, None, None, None, None, None, None) for i, t in enumerate(["A", "C", *(f"A{x}" for x in "CDEFGHIK")])] * 2
    df = spark.createDataFrame(rows, "config_id string, token_id int, token string, frequency long, merge_order int, pair array<string>, parent string, similarity double, is_parent boolean")
    got = random_clone(vocabulary(df), "ACD", tries=40).collect()
    names = [r["token"] for r in got]
    assert len(set(names)) == len(names) and {"A", "C"} <= set(names) and all(len(r["token"]) == (1 if r["token_id"] < 2 else 2) for r in got)


def test_paged_source(spark):
    def fetch(ids, page):
        rows = [{"id": i, "n": k} for i in ids for k in range(5)]
        return rows[(page - 1) * 4 : page * 4]

    ids = spark.createDataFrame([(f"a{i}",) for i in range(7)] + [(None,), ("a1",)], "id string").coalesce(1)
    got = R.fetch_pages(ids, "id", fetch, "id string, n long", batch=3, page_rows=4).collect()
    assert sorted(map(tuple, got)) == sorted((f"a{i}", k) for i in range(7) for k in range(5))


def test_download_and_tables(spark, tmp_path):
    import tarfile

    (tmp_path / "src").mkdir()
    put(tmp_path / "src" / "inner.txt", "x")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "src" / "inner.txt", arcname="inner.txt")
    (tmp_path / "to").mkdir()
    R.download(spark, (tmp_path / "a.tar").as_uri(), str(tmp_path / "to"))
    assert (tmp_path / "to" / "inner.txt").read_text() == "x"
    (one,) = R.download(spark, (tmp_path / "src" / "inner.txt").as_uri(), str(tmp_path / "far" / "away"), chunk=1)
    assert open(one).read() == "x"
    assert set(K.TABLES) >= {"prosite_entries", "prosite_patterns"}
    spark.createDataFrame([("c1", "A"), ("c2", "B")], "config_id string, token string").write.partitionBy("config_id").parquet(str(tmp_path / "v"))
    df = R.load_vocabularies(spark, str(tmp_path / "v"), ["c2"])
    assert [r["token"] for r in df.collect()] == ["B"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "config_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_random_clone_fills_every_length(spark):
    # all 16 and all 64 words asked for, but for two of three letters; 17 units for 16 words in b
    rows = [(c, i, "ACDE"[i] if i < 4 else ("xx" if i < two else "yyy") + str(i)) for c, two, n in (("a", 20, 82), ("b", 21, 30)) for i in range(n)]
    cut = [(c, i, t if len(t) == 1 else t[: 2 if t[0] == "x" else 3]) for c, i, t in rows]
    df = spark.createDataFrame(cut, "config_id string, token_id int, token string")
    for tries in (1, 3):
        got = random_clone(df, "ACDE", tries=tries).collect()
        assert len({(r["config_id"], r["token"]) for r in got}) == len(got) == len({(r["config_id"], r["token_id"]) for r in got})
        length = {(c, i): len(t) for c, i, t in cut}
        assert all(len(r["token"]) == length[r["config_id"], r["token_id"]] and set(r["token"]) <= set("ACDE") for r in got)
        assert sum(r["config_id"] == "a" for r in got) == 82 and sum(r["config_id"] == "b" for r in got) == 29
