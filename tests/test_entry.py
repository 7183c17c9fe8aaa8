"""The driver's entry, with and without the optional part."""

import importlib
import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    if importlib.util.find_spec("tidewheel.llm"):
        assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries


def test_without_the_optional_part(tmp_path):
    for name in ("tidewheel", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _linked(ROOT / name, tmp_path / name)
    code = textwrap.dedent("""
        import __spark_entry__ as e
        names = e.queries()
        assert len(names) > 50 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
        assert set(e.oracle_sql()) == set(names)
    """)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def _linked(source, target):
    target.mkdir()
    for part in source.iterdir():
        if part.name not in ("llm", "__pycache__"):
            (target / part.name).symlink_to(part)
