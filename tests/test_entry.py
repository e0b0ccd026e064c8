"""The driver's contract."""

import importlib
import os
import subprocess
import sys
import textwrap

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq", "status", "error_type", "total_score", "previous_score", "message"] and df.count() > 0


def test_every_query_of_the_library_has_its_sql():
    from scoresheet_spark.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_parts(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("scoresheet_spark.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("scoresheet_spark.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    parent = importlib.import_module("scoresheet_spark")
    monkeypatch.delattr(parent, "llm", raising=False)
    names = set(entry.queries())
    assert "group_counts" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names


def test_workers_get_the_package_wherever_the_driver_runs(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as e
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        print("ROWS", e.queries()["label_format"](spark, "/root/testdata/sf0.001").count(), len(e.queries()["label_format"](spark, "/root/testdata/sf0.001").collect()))
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in out.stdout, out.stderr[-800:]
