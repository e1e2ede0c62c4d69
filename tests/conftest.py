import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from survspark.session import local_session

    s = local_session(4, 4, app="survspark-tests")
    # tiny tables must still exercise the multi-bucket scan path
    s.conf.set("survspark.scan.rowsPerBucket", "3")
    yield s
    s.stop()
