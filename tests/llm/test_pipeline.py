"""The pipeline's stages, the registered queries, and the SQL checks."""

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from factsieve.llm import decontam, language, quality, queries, simhash

QUERIES = queries.queries()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_equals_duckdb(spark, key):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    frame = QUERIES[key](spark, folder)
    answer = con.execute(queries.oracle_sql()[key])
    names = [d[0] for d in answer.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(str, answer.fetchall()))
    assert sorted(names) == sorted(frame.columns)


def test_stages_keep_the_columns_and_take_effect(spark, folder, odd, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema.names == docs.schema.names, name
        assert 0 < kept.count() <= docs.count(), name
        assert stage(spark, none, folder).count() == 0, name
        assert set(stage(spark, odd, folder).columns) == set(odd.columns), name


def test_pipeline_equals_the_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    drawn = {r["doc_id"] for r in quality.resample(docs, labels).filter("sampled").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in drawn]
    left = spark.createDataFrame(rows, docs.schema)
    answer = language.judge(language.learn(left))
    rows = [r for r in rows if (a := answer(r["text"]))[0] != "und" and a[1] >= language.MARGIN]
    # near-duplicates by comparing all fingerprints
    codes = [simhash.fingerprint(r["text"].encode()) for r in rows]
    label = {r["doc_id"]: r["doc_id"] for r in rows}
    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3:
                x, y = label[rows[i]["doc_id"]], label[rows[j]["doc_id"]]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    patterns = decontam.Patterns([(r["item_id"], r["text"].encode()) for r in bench.collect()])
    rows = [r for r in rows if not list(patterns.search(decontam.plain_words(r["text"].encode())))]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == {r["doc_id"] for r in rows}
