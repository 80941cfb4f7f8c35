import corpus_pipeline as cp
from tests.llm.helpers import ROWS, documents, empty

NAMES = ["toxicity", "near-duplicates", "decontamination", "mixture", "tokens"]


def _tables(spark, tmp, docs):
    path = str(tmp)
    docs.write.parquet(f"{path}/documents.parquet")
    marks = [(r[0], 1, int((r[0] or 0) % 3 == 0)) for r in ROWS]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ROWS[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns(spark, tmp_path):
    for name, docs in (("rows", documents(spark)), ("none", empty(spark))):
        path = _tables(spark, tmp_path / name, docs)
        now = spark.read.parquet(f"{path}/documents.parquet")
        columns, n = now.columns, now.count()
        assert [s for s, _ in cp.STAGES] == NAMES
        for k, (stage, run) in enumerate(cp.STAGES):
            run(spark, now, path).write.parquet(f"{tmp_path}/{name}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert now.count() <= n
            n = now.count()
            if stage != "tokens":
                assert now.columns == columns
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run_over_the_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    steps, now = [docs.count()], docs
    for _, stage in cp.STAGES:
        now = cp.saved(stage(spark, now, sf001), "test-pipeline")
        steps.append(now.count())
    got, again = cp.run(spark, sf001), now
    assert steps == sorted(steps, reverse=True) and steps[-1] > 0.4 * steps[0] and steps[4] == steps[5]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert cp.ORACLE_SQL is None
