import pytest


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """A checkpoint folder where the session names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return sc.getCheckpointDir()
