import os
from types import SimpleNamespace

import pytest

from newsignal import session


class Settings:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


def fake(master, folder=None, **settings):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, getConf=lambda: Settings())
    return SimpleNamespace(sparkContext=context, conf=Settings(**settings))


def test_shared_folder_follows_the_cluster():
    assert session.shared_folder(fake("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert session.shared_folder(fake("yarn", **{"spark.checkpoint.dir": "s3://b/y"})) == "s3://b/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_materialised_table_is_read_back(spark):
    df = spark.range(10).repartition(3)
    kept = session.materialise(df)
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def test_steps_keep_their_order(spark):
    steps = [lambda n=n: spark.range(n) for n in (3, 1, 2)]
    assert [df.count() for df in session.at_once(spark, steps)] == [3, 1, 2]


def test_scratch_deletes_what_it_wrote_but_what_is_kept(spark):
    def files():
        return set(os.listdir(session.shared_folder(spark).removeprefix("file:")))

    before = files()
    with session.scratch(spark) as keep:
        session.materialise(spark.range(3))
        session.at_once(spark, [lambda: session.materialise(spark.range(4))] * 2)
        with session.scratch(spark) as keep_inner:
            session.materialise(spark.range(5))
            inner = keep_inner(spark.range(6))
        assert inner.count() == 6 and len(files() - before) == 4
        out = keep(inner.where("id > 2"))
    assert out.count() == 3 and len(files() - before) == 1
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.materialise(spark.range(3))
        1 / 0
    assert len(files() - before) == 1


def test_batches_for_python_end_at_a_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def rows(batches):
        for batch in batches:
            yield batch.from_arrays([[batch.num_rows]], ["rows"])

    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 10000) as text")
    before = spark.conf.get(name)
    with session.arrow_batches(spark, 100_000):
        sizes = [r.rows for r in texts.mapInArrow(rows, "rows long").collect()]
    assert sum(sizes) == 200 and max(sizes) <= 20
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), session.arrow_batches(spark, 1):
        1 / 0
    assert spark.conf.get(name) == before
