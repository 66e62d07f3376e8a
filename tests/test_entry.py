import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["succ", "lvl", "pre", "post", "leaf"] and df.count() > 0


def test_works_without_the_optional_parts(tmp_path):
    """The entry module imports where the corpus pipeline and its subpackage are gone."""
    root = Path(entry.__file__).parent
    (tmp_path / "arbordf").mkdir()
    for p in (root / "arbordf").rglob("*.py"):
        if "llm" not in p.parts:
            q = tmp_path / p.relative_to(root)
            q.parent.mkdir(parents=True, exist_ok=True)
            q.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text(Path(entry.__file__).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert importlib.util.find_spec("arbordf") is not None
