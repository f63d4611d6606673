"""Driver contract: entry() runs on sf0.001, every oracle key is a query."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {"train_score", "train_score_weather", "presence_model_scores", "model_metrics_region"} <= set(q) - set(o)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["species", "stateProvince", "year", "week_of_year"]


def test_queries_of_this_library_run_small(spark):
    """Columns and rows as the SQL says, where there is SQL; the queries of
    ``tessera.llm`` have their own tests."""
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    slow = {"train_score", "train_score_weather", "presence_model_scores", "model_metrics_region", "model_evaluation", "model_class_report"}
    for name, fn in E.QUERIES.items():
        if name in slow:
            continue
        df = fn(spark, SF_SMALL)
        rows = df.collect()
        sql = con.sql(E.ORACLE[name])
        assert sorted(df.columns) == sorted(sql.columns), name
        assert len(rows) == len(sql.fetchall()), name


def test_entry_works_without_the_training_data_operators(tmp_path):
    """With the subpackage and the pipeline away the rest is still offered; a
    broken import inside them is not swallowed."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(E.QUERIES)), str(len(E.ORACLE))], out.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr
