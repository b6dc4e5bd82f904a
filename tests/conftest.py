import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logsieve.session import session
    from logsieve.ship import to_workers

    s = session("local[4]", shuffle_partitions=4, **{"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    to_workers(s)
    yield s
    s.stop()
