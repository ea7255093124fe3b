import pytest

from kestrel.session import ensure_checkpoint_dir, shared_path


def test_shared_folder_is_the_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert shared_path(spark, "x").startswith(base.rstrip("/"))
    assert shared_path(spark, "x", unique=True) != shared_path(spark, "x", unique=True)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
