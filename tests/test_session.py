import os

from types import SimpleNamespace

import pytest

from tidemark.session import drop_scratch, job_scope, materialise, scratch_path, shared_dir


def test_a_job_leaves_nothing(spark):
    kept = materialise(spark.range(3), "kept")
    with job_scope(spark) as folder:
        inner = materialise(spark.range(5), "inner")
        assert inner.inputFiles()[0].startswith("file://" + folder)
        with job_scope(spark) as nested:
            assert nested.startswith(folder) and materialise(spark.range(2), "x").count() == 2
        assert not os.path.exists(nested) and inner.count() == 5
    assert not os.path.exists(folder) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    nothing = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(nothing)


def test_scratch_lives_in_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    frame = materialise(spark.range(5), "numbers")
    assert frame.count() == 5 and frame.inputFiles()[0].startswith("file://" + shared_dir(spark))
    folder = os.path.dirname(scratch_path(spark, "x"))
    assert os.listdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
