import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_corpus_operators():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, operators, pipeline = out.stdout.split()
    assert int(n) > 50 and operators == pipeline == "False"


def test_nothing_else_imports_them():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["symbol", "direction", "posts", "first_ts", "last_ts"]
