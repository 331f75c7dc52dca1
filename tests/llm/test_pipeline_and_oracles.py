"""The registered queries against DuckDB, and the pipeline stage by stage against plain definitions."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
import corpus_pipeline
from ledgerlens.llm import pii
from ledgerlens.llm.piece_sampling import Vocabulary, decode
from ledgerlens.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.test_archives_pieces_shingles import _plain_components
from tests.test_contract import _norm


def test_every_query_is_registered():
    names = set(entry_mod.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q[:q.index("_") + 1] for q in names if q.startswith("op")}
    assert "pipeline" in names and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(_norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want


ODD = [(9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, "123 456", None, "src1", 7), (9004, "漢字", "en", "src1", 2)]


def test_pipeline_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame(ODD, source.schema)
    source.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        seen.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{i}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{i}")

    before, after = seen[0]  # language ID: only texts without letters or known n-grams go
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {9001, 9002, 9003} <= gone <= {9001, 9002, 9003, 9004}

    before, after = seen[1]  # near-duplicates
    want = {i for i, _, c in _plain_components([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want)

    before, after = seen[2]  # personal data
    text = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        if pii.base_spans(r.text):
            assert not pii.base_spans(text[r.doc_id].text)
            assert text[r.doc_id].n_chars == len(text[r.doc_id].text)
        else:
            assert text[r.doc_id] == r

    before, after = seen[3]  # mix: whole documents, at most twice
    times = collections.Counter(r.doc_id for r in after)
    words = {r.doc_id: len(r.text.encode().split()) for r in before}
    assert max(times.values()) <= 2 and set(times) <= set(words)
    total = sum(words.values())
    assert abs(sum(words[i] * n for i, n in times.items()) - 1.5 * total) < 0.1 * total

    before, after = seen[4]  # pieces: two rows a text (one where there is one segmentation), decoded to it
    texts = {r.doc_id: r.text for r in before}
    vocabulary = Vocabulary()
    assert {r.doc_id for r in after} == set(texts) and len(before) <= len(after) <= 2 * len(before)
    assert all(decode(vocabulary, r.ids) == texts[r.doc_id] for r in after)


def test_texts_of_no_learned_script_go(spark):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = [*ODD, (9005, "Это русский текст, которого никто не учил. " * 20, None, "src1", 2)]
    out = corpus_pipeline.language_id(spark, source.unionByName(spark.createDataFrame(odd, source.schema)), SF_SMALL)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in source.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_run_follows_the_stages(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() == got.where(F.size("ids") > 0).count() > 0


def test_near_duplicates_of_repeated_ids(spark):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    long = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    rows = [(1, long("a"), "en", "s", 1), (1, long("b"), "en", "s", 2),  # two texts under one id
            (5, long("a") + " end", "en", "s", 3), (5, long("c"), "en", "s", 4),  # one is a near copy of a text of id 1
            (7, long("d"), "en", "s", 6), (7, long("d"), "en", "s", 5), (7, long("d"), "en", "s", 5),  # one document thrice
            (9, long("b"), "de", "t", 7), (None, long("a"), "en", "s", 8), (None, None, None, None, None), (11, None, "en", "s", 0), (11, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, source.schema)
    got = sorted(((r.doc_id, r.n_chars) for r in corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 2), (5, 4), (7, 5), (None, 8), (None, None), (11, 0), (11, 0)], key=repr)
    unique = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    out = corpus_pipeline.near_duplicates(spark, unique, SF_SMALL)
    assert out.columns == docs.columns
