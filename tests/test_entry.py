"""The entry module works where the training-data subpackage was left out."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_subpackage():
    code = ("import sys; sys.modules['rillwork.llm'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 150 and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_queries_without_a_library_that_only_the_subpackage_needs():
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['zstandard'] = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 150 and not any(k.startswith('op') for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
