"""Python gets few rows at a time, in the pipeline's stages too, and gives back what it does not need."""

import pyarrow as pa

import corpus_pipeline
from quaero.llm.arrow import BATCH, ROWS, slices


def test_the_pipeline_is_written_in_small_batches(spark, sf_dir, monkeypatch):
    before, seen = spark.conf.get(BATCH), []

    def told(stage):
        def run(*given):
            spark.conf.set(BATCH, "9999")
            rows = stage(*given)
            seen.append(spark.conf.get(BATCH))
            return rows

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality_rules", told(corpus_pipeline.quality_rules))])
    spark.conf.set(BATCH, "7777")
    try:
        assert corpus_pipeline.run(spark, sf_dir).count() and seen == [str(ROWS)]
        assert spark.conf.get(BATCH) == "7777"
    finally:
        spark.conf.set(BATCH, before)


def test_a_task_gives_arrow_memory_back(monkeypatch):
    from quaero.llm import arrow

    gone = []
    monkeypatch.setattr(arrow, "give_back", lambda: gone.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a"] * 1200})
    assert [b.num_rows for b in slices(iter([batch, batch]))] == [500, 500, 200] * 2 and gone == [1]
