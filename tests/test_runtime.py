import os

import pytest

from sparkquarry import runtime


class Cluster:
    """A session as far as ``shared_dir`` looks at it."""

    def __init__(self, **settings):
        self.conf = settings | {"get": None}
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: settings.get(name.replace(".", "_"), default))})


def test_a_cluster_names_its_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            runtime.shared_dir(Cluster(spark_master=master))
    assert runtime.shared_dir(Cluster(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"


def test_scratch_drops_its_own_tables(spark):
    kept = runtime.materialize(spark.range(3), "kept")
    with runtime.scratch():
        inner = runtime.materialize(spark.range(4), "inner")
        assert inner.count() == 4
        place = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(place)
    assert not os.path.exists(place) and kept.count() == 3
