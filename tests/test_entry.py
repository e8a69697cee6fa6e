import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_part():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in x for x in names), path


def test_entry_stands_without_the_optional_part(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) == set(e.queries()); assert not any(x.startswith('op') for x in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_graph_queries_run_without_a_checkpoint_folder(small_tables):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
assert e.queries()['nation_trade_components'](spark, {small_tables!r}).count() and e.queries()['customer_order_hops'](spark, {small_tables!r}).count()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300, capture_output=True)


def test_no_folder_of_one_machine_is_used_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from quern.operators.checkpoints import ready

    unset = SimpleNamespace(isDefined=lambda: False)
    taken = []
    context = SimpleNamespace(master="spark://host:7077", setCheckpointDir=taken.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = lambda folder: SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))
    with pytest.raises(ValueError):
        ready(session(None))
    ready(session("hdfs://shared/checkpoints"))
    assert taken == ["hdfs://shared/checkpoints"]
