from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from haulgrid.session import build_session

    home = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", f"local[{os.environ.get('TEST_CPUS', '6')}]", spark_sql_shuffle_partitions="6", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="6g",
        spark_checkpoint_dir=f"file://{home}/shared", spark_sql_warehouse_dir=f"{home}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
