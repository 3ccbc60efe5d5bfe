from types import SimpleNamespace

import pytest

from sieveline import session


def fake(master, named=None):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: named))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,4,6000]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake(master))
    assert session.ensure_checkpoint_dir(fake(master, "hdfs://shared")) == "hdfs://shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[4,2]"])
def test_one_machine_gets_a_temporary_folder(master):
    assert session.ensure_checkpoint_dir(fake(master)).startswith("/tmp/spark-")
