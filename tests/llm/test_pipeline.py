"""Registered queries and the pipeline, over the given tables."""

import os
import sys
import zlib

import brute
import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from dwelltrace.llm import registry, secret_scan

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts():
    return {d: t or "" for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def rows(df):
    return {row.doc_id: row for row in df.collect()}


def test_every_operator_is_registered():
    numbers = [int(name[2:].split("_")[0]) for name in registry.QUERIES if name[:2] == "op"]
    assert sorted(numbers) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        found = connection.execute(registry.ORACLE[name])
        names = [column[0] for column in found.description]
        expected = sorted(found.fetchall())
    result = registry.QUERIES[name](spark, DATA)
    assert sorted(tuple(r) for r in result.select(*names).collect()) == expected


def test_queries_against_brute_force(spark, texts):
    out = rows(registry.op2_repeated_spans(spark, DATA))
    expected = brute.repeats(texts, 100)
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in out.items()} == expected
    out = rows(registry.op3_token_files(spark, DATA))
    assert {d: (r.start, r.n_tokens, r.ids_crc32) for d, r in out.items()} == brute.token_file(texts)
    out = rows(registry.op7_simhash_near_dedup(spark, DATA))
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    groups = brute.components(prints)
    assert {d: (r.fingerprint, r.component_id) for d, r in out.items()} == {d: (f"{prints[d]:016x}", groups[d]) for d in texts}
    out = rows(registry.op9_bpe_codec(spark, DATA))
    assert {d: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for d, r in out.items()} == brute.bpe(texts)
    out = rows(registry.op8_secret_scans(spark, DATA))
    for doc, row in out.items():
        spans = brute.secrets(texts[doc])
        assert row.base_sha256 == brute.sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans))
        assert {f"{kind}:{a}:{b}" for a, _, kind, b in spans} <= set(row.spans.split(","))
    assert len(secret_scan.BASE_RULES) == 3
    out = rows(registry.op11_periodic_runs(spark, DATA))
    found = {d: tuple(r)[1:] for d, r in out.items()}
    assert found == {d: brute.run_digest(brute.planted(d, brute.WORD.findall(t))) for d, t in texts.items()}
    out = registry.op12_sharding(spark, DATA).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out} == set(brute.shards(list(texts.items())))
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    out = registry.op13_spelling_variants(spark, DATA).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute.variants(texts)


def test_learned_queries(spark, texts):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    # The smallest data set has a dozen bad labels, from which few rules can be learned.
    for query, share in ((registry.op1_quality_classifier, 0.7), (registry.op4_quality_rules, 0.3)):
        out = rows(query(spark, DATA))
        assert set(out) == set(texts)
        junk = [d for d, q in labels.items() if q == 0]
        assert sum(not out[d].kept for d in junk) >= share * len(junk)
    out = rows(registry.op10_toxicity(spark, DATA))
    for doc, row in out.items():
        assert row.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert row.predicted == int(row.score >= 0.7)
    out = registry.op5_source_mix(spark, DATA).toPandas()
    assert (out.groupby("source")["taken"].sum() - out.groupby("source")["target"].first()).abs().max() < 30


@pytest.mark.parametrize("name", ["nothing", "no_ids", "documents"])
def test_pipeline_on_odd_tables(spark, request, tmp_path, name):
    """Empty tables, rows without ids or with repeated ones, columns with the names of the operators' own."""
    docs = request.getfixturevalue(name)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [] if name == "nothing" else [(1, 1, 0), (None, 0, 1), (4, None, None), (7, 0, 1), (7, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert bool(ids) == (name != "nothing")
    assert registry.op1_quality_classifier(spark, str(tmp_path)).count() == docs.count()


def test_stages(spark, texts):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{os.getpid()}"
        stage(spark, docs, DATA).write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "tokenize":
            assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
        given = {r.doc_id: r.text or "" for r in before.collect()}
        if name == "exact_dedup":
            groups = brute.exact_groups(list(given.items()))
            assert sorted(kept[name]) == sorted(min(ids) for ids in groups.values())
        if name == "near_dedup":
            groups = brute.components({d: brute.fingerprint(t) for d, t in given.items()})
            assert sorted(kept[name]) == sorted(set(groups.values()))
        if name == "tokenize":
            expected = brute.bpe(given)
            assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected[r.doc_id] for r in docs.collect())
    assert len(kept["toxicity"]) <= len(texts)
    assert sorted(kept["tokenize"]) == sorted(kept["source_mix"])
    assert corpus_pipeline.run(spark, DATA).count() == len(kept["tokenize"])
