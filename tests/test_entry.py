import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_flagship_query_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {n for n in names if not n.startswith("op") and n != "pipeline"} <= set(entry.oracle_sql())


def test_entry_without_a_module_that_the_corpus_operators_need(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('taken out')")
    code = "import __spark_entry__ as e; print(len(e.queries()), 'op1_lm_scoring' in e.queries(), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    root = Path(entry.__file__).parent
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PYTHONPATH": f"{tmp_path}:{root}", "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    n, op1, pipeline, sql = ran.stdout.split()
    assert int(n) == int(sql) > 40 and op1 == pipeline == "False", ran.stderr
