"""Nothing but the entry module knows of the corpus operators: without them, the rest works."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sedira"), tmp_path / "sedira", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "sedira")):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"sedira\.llm|corpus_pipeline", f.read()), n
