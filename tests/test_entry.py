"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_of_the_engine_has_sql_or_is_known_to_have_none():
    from factloom.plans import registry

    without = {"evaluation_checks"}
    assert set(registry.queries()) - set(registry.oracle_sql()) == without and set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_imports_without_the_subpackage(tmp_path):
    """A copy without the folders and the pipeline still gives its queries."""
    import shutil

    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_combined' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_imports_with_an_empty_folder_left(tmp_path):
    import shutil

    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "factloom" / "llm").mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'pipeline' not in e.queries()"], cwd=tmp_path, check=True, timeout=120)


def test_errors_within_the_subpackage_are_raised(tmp_path):
    import shutil

    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "factloom" / "llm").mkdir()
    (tmp_path / "factloom" / "llm" / "registry.py").write_text("import no_such_module\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns[:2] == ["id", "entity"] and rows.count() >= 0


def test_a_cluster_with_a_local_warehouse_is_refused(monkeypatch):
    """Without a shared folder, a warehouse on a machine's own disk is no place for intermediate tables."""
    from types import SimpleNamespace

    import pytest

    from factloom import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    for warehouse in ("file:/tmp/warehouse", "/tmp/warehouse"):
        conf = SimpleNamespace(get=lambda key, *default, w=warehouse: w if key == "spark.sql.warehouse.dir" else None)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
