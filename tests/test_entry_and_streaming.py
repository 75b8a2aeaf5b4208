import re
import subprocess
import sys
import tempfile
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

from ravelin.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf001):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf001}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, sf001, name):
    df = catalogue.QUERIES[name](spark, sf001)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    made = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(made.columns) == sorted(df.columns)
    at = [made.columns.index(c) for c in df.columns]
    assert sorted(rows, key=repr) == sorted((tuple(r[k] for k in at) for r in made.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_without_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    for file in (root / "ravelin").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"import corpus_pipeline|ravelin\.llm|from ravelin import llm", file.read_text())
    code = "import sys; sys.modules['ravelin.llm'] = None; import __spark_entry__ as e; assert 'citations' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_changed_files_make_new_tables(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = lambda text: spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    made("one two")
    assert catalogue.QUERIES["chunk_approx_tokens"](spark, folder).first().approx_tokens == 2
    made("one two three four")
    assert catalogue.QUERIES["chunk_approx_tokens"](spark, folder).first().approx_tokens == 4


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from ravelin.scratch import shared_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(away)
