import re
from pathlib import Path

import pytest

from waxgraph import session


def test_settings_are_run_time_settings(spark):
    for key, value in session.SETTINGS.items():
        assert spark.conf.get(key) == value


def test_the_folder_named_by_the_cluster_is_used(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_folder(spark) == named

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "local[8]"
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Unset:
        conf = Conf()
        sparkContext = Context()

    assert session.shared_folder(Unset()).startswith("/") and session.shared_folder(Unset()) == session.shared_folder(Unset())
    Context.folder = "/shared/checkpoints"
    assert session.shared_folder(Unset()) == "/shared/checkpoints"
    Context.folder, Context.master = None, "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.shared_folder(Unset())


def test_a_scope_deletes_its_tables(spark):
    with session.scope(spark):
        kept = session.settle(spark.range(3).toDF("id"))
        assert kept.count() == 3
        path = kept.inputFiles()[0]
    assert not Path(path.removeprefix("file://")).exists()
    assert session.settle(spark.range(3).toDF("id")).count() == 3


def test_settle_keeps_rows_and_schema_and_cuts_the_plan(spark):
    df = spark.range(100).selectExpr("id", "array(id, null) AS list", "struct(id AS x) AS s", "CAST(NULL AS STRING) AS t")
    kept = session.settle(df.repartition(3))
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()


def test_contract_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    plain = set(entry.queries()) - set(entry.oracle_sql())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in plain)


def test_shuffled_rows_are_let_go_and_a_query_can_run_again(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    counts = spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count()
    assert sorted(counts.collect()) == sorted(counts.collect())
