"""Registered queries of the subpackage run on the smallest tables; SQL agrees where there is some."""

from pathlib import Path

import pytest

from sightline.llm import queries
from tests.test_queries import DATA, agree

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

COLUMNS = {
    "p1_found": {"cluster_id": "bigint", "entry_id": "bigint"}, "p2_found": {"video_hash": "string", "match_id": "bigint"},
    "p3_found": {"field": "string", "entry_a": "bigint", "entry_b": "bigint"}, "p4_found": {"first_id": "bigint", "again_id": "bigint"},
    "p5_found": {"group_path": "string", "path": "string"}, "p6_found": {"doc_id": "bigint"}, "p7_found": {"source": "string"}, "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    from sightline.llm.sql import SQL

    df = queries.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    if name in SQL:
        agree(df, SQL[name])
    else:
        df.count()
