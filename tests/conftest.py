import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groundspark.session import get_session

    s = get_session("tests", "local[8]", **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "6g", "spark_checkpoint_dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
