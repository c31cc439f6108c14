import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    for item in ("tideline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path / item)], check=True)
    moved = tmp_path / "tideline" / "llm"
    if moved.exists():
        moved.rename(tmp_path / "away")
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 50 and said[1] == "False"


def test_nothing_else_imports_llm():
    for p in (ROOT / "tideline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tideline").parts:
            assert not re.search(r"(from|import) tideline\.llm|from tideline import llm", p.read_text()), p


def test_other_missing_modules_are_not_swallowed(tmp_path):
    for item in ("tideline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / item).exists():
            subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path / item)], check=True)
    queries = tmp_path / "tideline" / "llm" / "queries.py"
    if queries.exists():
        queries.write_text(queries.read_text() + "\nimport no_such_module\n")
        ran = subprocess.run([sys.executable, "-c", "import sys; sys.path.insert(0, '.'); import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False)
        assert ran.returncode and "no_such_module" in ran.stderr


def test_local_masters():
    from types import SimpleNamespace

    from tideline.session import is_local

    told = {m: is_local(SimpleNamespace(sparkContext=SimpleNamespace(master=m))) for m in ("local", "local[*]", "local[4]", "local-cluster[2,1,1024]", "yarn")}
    assert told == {"local": True, "local[*]": True, "local[4]": True, "local-cluster[2,1,1024]": False, "yarn": False}
