import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.count() == 2 and "accuracy" in df.columns


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Without the training-data subpackage the entry still imports, with the core queries."""
    code = "import sys; sys.modules['quillstone.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'eval_metrics_ci' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    hits = subprocess.run(["grep", "-rl", "quillstone.llm", "quillstone", "--include=*.py"], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert all(h.startswith("quillstone/llm/") for h in hits)
