"""Where intermediate data goes."""

import pytest

from lumenfold import session


class Named:
    """A session with a master and, perhaps, a checkpoint folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.taken = master, folder, None
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.taken

    def setCheckpointDir(self, folder):
        self.taken = folder

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.folder or default


def test_folder_of_the_session():
    assert session.shared_folder(Named("yarn", "hdfs:///x")) == "hdfs:///x"
    assert session.shared_folder(Named("local[4]", "/y")) == "/y"
    assert "spark-cp-" in session.shared_folder(Named("local[4]"))
    for master in ("yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Named(master))
