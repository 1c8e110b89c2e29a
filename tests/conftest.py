import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quill.session import local_session

    session = local_session(4, "tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def empty_folder(spark, folder, tmp_path_factory):
    """The tables without rows."""
    import glob

    out = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{folder}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(out / os.path.basename(path)))
    return str(out)
