"""The driver's contract, with and without the corpus package."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_imports_without_the_corpus_package(tmp_path):
    for p in ("__spark_entry__.py", "stratagraph"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "stratagraph/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'pagerank' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_outside_imports_the_corpus_package():
    for p in (ROOT / "stratagraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())
