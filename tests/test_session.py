"""Stored steps: which stay, which go."""

import pytest

from tidewire import session as S


def test_scratch_deletes_its_steps_alone(spark):
    before = S.materialize(spark.range(3), "before")
    path = S.step_path(spark, "result")
    with S.scratch(spark):
        inner = S.materialize(spark.range(5), "inner")
        table = S.materialize_bucketed(inner, "table", "id", 4)
        assert table.count() == 5
        with S.scratch(spark):
            deep = S.step_path(spark, "deep")
            spark.range(2).write.parquet(deep)
        assert not S.exists(spark, deep) and inner.count() == 5
        table.write.parquet(path)
        files = inner.inputFiles() + table.inputFiles()
    assert not any(S.exists(spark, f) for f in files)
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("table_")]
    assert spark.read.parquet(path).count() == 5 and before.count() == 3


def test_scratch_deletes_after_an_error(spark):
    with pytest.raises(ValueError):
        with S.scratch(spark):
            files = S.materialize(spark.range(5), "inner").inputFiles()
            raise ValueError
    assert not any(S.exists(spark, f) for f in files)


def test_bucketed_table_is_not_shuffled_by_a_join(spark):
    with S.scratch(spark):
        table = S.materialize_bucketed(spark.range(1000), "table", "id", S.shuffle_width(spark))
        plan = table.hint("merge").join(spark.range(10).hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
