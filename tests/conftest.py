import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from dumplake.session import local_session

    session = local_session(4, "dumplake-tests", "6g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="dumplake-test-")


@pytest.fixture()
def dump(folder):
    """Write named files into a fresh folder and return the folder."""

    def write(**files):
        for name, data in files.items():
            path = os.path.join(folder, name.replace("__", "."))
            with open(path, "wb") as out:
                out.write(data if isinstance(data, bytes) else data.encode())
        return folder

    return write
