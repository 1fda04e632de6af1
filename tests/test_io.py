"""Written tables are read back whole, and go away when asked to."""

import os
from types import SimpleNamespace

from auricle import io


def test_materialize_and_clean(spark):
    df = io.materialize(spark.range(5))
    path = io._WRITTEN[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert io.clean(spark) >= 1 and not os.path.isdir(path)
    assert io.materialize(spark.range(0)).count() == 0


def test_shared_folder_of_the_session_wins():
    conf = SimpleNamespace(get=lambda key, default=None: "/shared" if key == "spark.checkpoint.dir" else default)
    assert io.shared_dir(SimpleNamespace(conf=conf)) == "/shared"
