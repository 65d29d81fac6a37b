from types import SimpleNamespace

import pytest

from stalemark import session


def stub(configured=None, set_by_call=None, master="local[2]"):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_by_call)
    conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": configured}[name] or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_is_the_configured_one():
    paths = {session.shared_folder(stub("hdfs://cluster/kept/", "file:/other"), "states") for _ in range(2)}
    assert len(paths) == 2 and all(p.startswith("hdfs://cluster/kept/states-") for p in paths)
    assert session.shared_folder(stub(None, "hdfs://set/x", "spark://host:1"), "states").startswith("hdfs://set/x/states-")
    assert "/stalemark-" in session.shared_folder(stub(), "states")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_shared_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(stub(master=master), "states")


def test_write_through(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a", "struct(id as x) as s")
    kept = session.write_through(df, "test")
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "parquet" in kept._jdf.queryExecution().executedPlan().toString().lower()


def test_remove_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    kept = session.write_through(spark.range(3), "one")
    assert kept.count() == 3 and session.written_tables() == [str(tmp_path / "one")]
    session.remove_written(spark)
    assert not (tmp_path / "one").exists() and session.written_tables() == []


def test_configure(spark):
    spark.conf.unset("spark.sql.adaptive.forceOptimizeSkewedJoin")
    assert session.configure(spark) is spark
    assert all(spark.conf.get(name) == value for name, value in session.SETTINGS.items())
