import re
from pathlib import Path

import pytest

import __spark_entry__
from siftwell.llm import catalogue

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field", "id_a", "id_b"], "p2_found": ["accepted_id", "id"], "p3_found": ["id_a", "id_b"], "p5_found": ["cluster_key", "field", "id"], "p6_found": ["id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_runs_with_the_columns_given(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    assert df.count() >= 0 and (name not in COLUMNS or df.columns == COLUMNS[name])


def test_nothing_outside_imports_this_package():
    root = Path(catalogue.__file__).resolve().parents[2]
    for path in [*root.glob("siftwell/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) siftwell\.llm", path.read_text(), re.M), path
