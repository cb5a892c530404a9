"""Every query of the package that SQL can express gives the rows DuckDB gives."""
import pytest

from compare import compare, duck
from modelscout import llm

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_matches_sql(spark, name):
    rows, problems = compare(llm.QUERIES[name](spark, SF), duck(SF), llm.ORACLE[name])
    assert rows and not problems
