"""Working folders: shared, per application, gone afterwards."""

import glob
import os
import zipfile

import pytest

from quaymark import session


def test_settled_files_go_with_their_run(spark):
    frame = session.settle(spark.range(10))
    folder = session._run_folder(spark).removeprefix("file:")
    assert frame.count() == 10 and glob.glob(f"{folder}/settled-*/*.parquet")
    session.clear_work(spark)
    assert not os.path.exists(folder)
    assert session.settle(spark.range(3)).count() == 3


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_package_is_shipped_once(spark):
    session.ship(spark)
    before = spark.sparkContext.listFiles
    session.ship(spark)
    assert list(before) == list(spark.sparkContext.listFiles)
    sent = [f for f in spark.sparkContext._python_includes if f == "quaymark.zip"]
    assert sent == ["quaymark.zip"]
    with zipfile.ZipFile(os.path.join(__import__("pyspark").SparkFiles.getRootDirectory(), "quaymark.zip")) as archive:
        assert "quaymark/session.py" in archive.namelist()
