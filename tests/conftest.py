import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from holdline.session import MAX_ROWS_CONF, local_session


@pytest.fixture(scope="session")
def spark():
    # On a few rows, compiling the stages takes longer than running them.
    s = local_session(
        8, **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": os.environ.get("TEST_CODEGEN", "false")}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(params=["plain", "hot"])
def split(request, spark):
    """Run once with plain windows, once with nearly every key cut in chunks."""
    if request.param == "hot":
        spark.conf.set(MAX_ROWS_CONF, "25")
    yield request.param
    spark.conf.unset(MAX_ROWS_CONF)
