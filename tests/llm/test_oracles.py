import os

import pytest
from busloom.llm.queries import QUERIES, SQL

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), SQL[name])
