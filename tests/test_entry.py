"""The entry without its optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1') for k in q))"


def _loads(tmp_path, *left_out):
    def skip(folder, names):
        here = os.path.relpath(folder, ROOT)
        return [n for n in names if n in ("__pycache__", ".git") or os.path.normpath(os.path.join(here, n)) in left_out]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=skip)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_loads_without_the_training_data_operators(tmp_path):
    n, pipeline, ops = _loads(tmp_path, "quillmark/llm", "tests/llm")
    assert int(n) > 80 and pipeline == ops == "False"


def test_entry_loads_without_the_pipeline_file_too(tmp_path):
    n, pipeline, ops = _loads(tmp_path, "quillmark/llm", "tests/llm", "corpus_pipeline.py")
    assert int(n) > 80 and pipeline == ops == "False"
