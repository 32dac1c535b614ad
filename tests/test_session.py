import os
from types import SimpleNamespace

import pytest

from tidemark import session


def fake(master, setting=None, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoint)
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_a_cluster_names_its_folder():
    assert session.shared_folder(fake("yarn", "hdfs:///cp/")) == "hdfs:///cp/tidemark/app-1"
    assert session.shared_folder(fake("yarn", None, "hdfs:///x")) == "hdfs:///x/tidemark/app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))


def test_a_local_session_has_a_folder_of_its_own():
    folder = session.shared_folder(fake("local[4]"))
    assert os.path.isdir(os.path.dirname(os.path.dirname(folder)))
    assert session.shared_folder(fake("local[4]")) == folder


def test_discard_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"{tmp_path}/mine")
    path = session.staging_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert session.holds_parquet(spark, path) and not session.is_file(spark, path)
    session.discard_staged(spark)
    assert not session.path_exists(spark, path) and os.path.isdir(tmp_path)
