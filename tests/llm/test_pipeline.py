"""The queries of this subpackage and the pipeline, on the smallest given tables."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from songloom.llm.queries import ORACLES, QUERIES

from .test_exact import plain as exact_plain
from .test_near import plain as near_plain
from .test_near import shingles
from .test_packing import check
from .test_packing import tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(row[names.index(c)] for c in df.columns) for row in result.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_stages_one_after_the_other(spark, tokenizer, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "best-fit packing":
            used = check(after.collect(), rows, tokenizer, 2048)
            assert used <= 1.05 * after.groupBy().sum("length").first()[0] / 2048 + 1
            break
        assert after.columns == columns
        kept = [(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()]
        if name == "toxicity":
            judged = {r.doc_id: r.predicted for r in QUERIES["op5_toxicity"](spark, SF).collect()}
            assert sorted(kept) == sorted(r for r in rows if not judged[r[0]])
        elif name == "exact dedup":
            assert sorted(kept) == sorted({max(r for r in rows if r[1] == t) for _, t in rows})
            assert len(kept) == exact_plain(rows)[1]
        elif name == "near dedup":
            component = {i: c for i, _, c in near_plain(rows)}
            assert sorted(kept) == sorted(r for r in rows if component[r[0]] == r[0] or not shingles(r[1]))
        else:
            times = {r: kept.count(r) for r in rows}
            assert set(kept) <= set(rows) and max(times.values()) <= 3
        before = after
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing sources", "best-fit packing"]


def test_stages_hand_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "bytes"])

    docs = spark.range(0, 6, 1, 1).selectExpr("repeat('word ', if(id = 3, 1600000, 300000)) text")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        found = corpus_pipeline.in_small_batches(lambda s, d, _: d.mapInArrow(sizes, "n long, bytes long"))(spark, docs, SF).collect()
    finally:
        spark.conf.set(setting, before)
    assert sum(row.n for row in found) == 6 and len(found) > 1
    # A batch ends with the text that fills it, and no text is cut.
    assert sum(row.bytes for row in found) >= 5 * (5 * 300_000 + 1_600_000)
    assert max(row.n for row in found) <= corpus_pipeline.BATCH_BYTES // 1_500_000 + 1
