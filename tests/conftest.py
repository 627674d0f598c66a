import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    s = session("local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
