import os

import pytest

from gridspark.llm.mixing import TOKENIZER
from gridspark.llm.registry import oracle_sql, queries
from tests.util import rows, run_sql


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    if name.startswith("p8") and not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    got = queries()[name](spark, sf_dir).toPandas()
    if name in oracle_sql():
        assert rows(got) == rows(run_sql(oracle_sql()[name], sf_dir))
    assert len(got)
    if name.endswith("_found"):
        assert not got.duplicated().any()
