import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geopulse.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", 4, spark__ui__enabled="false", spark__driver__memory="8g",
        # Tests that count jobs need the records of all of them; Spark drops those beyond a thousand.
        spark__ui__retainedJobs="100000",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
