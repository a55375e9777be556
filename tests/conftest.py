import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kiln.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# folder holding the statistics-homework CSVs (FIXTURES.md §8); the golden
# tests are skipped when it is not given
R_DATA = os.environ.get("KILN_GOLDEN_DIR", "")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("kiln-tests", master="local[*]", shuffle_partitions=8, extra={
        "spark.driver.memory": "8g",
        # generated code that does not compile raises instead of running interpreted
        "spark.sql.codegen.fallback": "false"})
    yield s
