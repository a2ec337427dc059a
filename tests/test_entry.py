import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0


def test_entry_works_without_the_optional_parts(tmp_path):
    """With the subpackage and the pipeline gone, or a folder of it left empty, the core's queries stay."""
    for leave_folder in (False, True):
        there = tmp_path / str(leave_folder)
        shutil.copytree(os.path.join(ROOT, "lexivane"), there / "lexivane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), there)
        if leave_folder:
            (there / "lexivane" / "llm" / "__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=there, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()
        assert int(out[0]) > 50 and out[1] == "False"
