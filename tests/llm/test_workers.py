"""Every operator runs on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_operators_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from emberline.session import local_session
from emberline.llm.catalog import LLM_QUERIES
spark = local_session(4)
for name, query in LLM_QUERIES.items():
    print("ROWS", name, query(spark, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ROWS") == 13, done.stderr[-3000:]
