"""The pipeline and the registered queries, stage by stage against brute force."""

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from gridloom.llm import bpe, minhash, packing, queries, secrets, toxicity
from tests.llm.test_operators import brute_components, brute_spans, frame, toxic_corpus, varied

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, near copies and secrets."""
    at = str(tmp_path_factory.mktemp("tables"))
    texts, toxic = toxic_corpus(250)
    copies = varied(7, 4, 6)
    leaky = [f"note {i} of some length here password = hunter{i}{i}{i} and then {'0123456789abcdef' * 2} end" for i in range(8)]
    rows = [*texts, *copies, *leaky, copies[0], None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], TABLE).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic) if i < 200], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(0)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_stages_take_effect_one_after_the_other(spark, folder, tmp_path):
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), TABLE.replace(" long", "").replace(" string", "").split(", ")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            scored = toxicity.score(spark.createDataFrame([*before.values()], TABLE), spark.read.parquet(f"{folder}/labels.parquet"))
            assert {r.doc_id for r in after} == {r.doc_id for r in scored.collect() if not r.toxic}
            assert 0 < len(after) < len(before)
        elif name == "minhash":
            want = brute_components([(i, r.text) for i, r in before.items()], 5, 4, 5)
            assert {r.doc_id for r in after} == {i for i, (_, top) in want.items() if i == top}
            assert len(after) < len(before)
        elif name == "secrets":
            assert {r.doc_id for r in after} == set(before)
            for r in after:
                assert brute_spans(r.text) == ""
                spans = brute_spans(before[r.doc_id].text)
                assert r.text == (secrets._cut(before[r.doc_id].text, spans) if spans else before[r.doc_id].text)
            assert any("[SECRET]" in (r.text or "") for r in after)
        else:
            from tokenizers import Tokenizer

            model, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(dict)
            for r in after:
                pieces[r.doc_id][r.start] = r
            assert set(pieces) == set(before)
            for i, own in pieces.items():
                ids, at = np.array([*model.encode(before[i].text or "", add_special_tokens=False).ids, 2], "<u4"), 0
                while at < len(ids):
                    r = own.pop(at)
                    assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                    at += r.length
                assert not own and at == len(ids)


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).select("doc_id").distinct().count()
    assert got > 0 and len(corpus_pipeline.STAGES) == 4


def test_every_query_is_registered_and_runs(spark, folder):
    plans = __spark_entry__.queries()
    for n in range(1, 11):
        (name,) = [q for q in plans if q.startswith(f"op{n}_")]
        assert name in queries.QUERIES
        assert plans[name](spark, folder).count() > 0
    assert "pipeline" in plans


def test_queries_agree_with_their_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, folder), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        place = [want.columns.index(c) for c in got.columns]
        key = lambda r: tuple((v is None, v) for v in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=key)


def test_near_duplicates_of_one_text_many_times(spark):
    from gridloom.llm.minhash import near_duplicates

    got = near_duplicates(frame(spark, ["same text of some words here"] * 300 + ["another text of some words here"]), 3, Fraction(85, 100)).collect()
    assert {r.component_id for r in got if r.doc_id < 300} == {0} and sum(r.kept for r in got) == 2


@pytest.mark.parametrize("task", [minhash._sign(5, 2, 2), minhash._sets(5), secrets._scan])
def test_a_task_drops_what_other_operators_left_in_its_worker(task):
    caches = (packing.word_encoder, "word_bpe_49k.json"), (bpe.worker_encoder, "byte_bpe_50k.json")
    for make, file in caches:
        make(public_tokenizers.path(file))
        assert make.cache_info().currsize == 1
    assert [*task(iter(()))] == []
    assert [make.cache_info().currsize for make, _ in caches] == [0, 0]
