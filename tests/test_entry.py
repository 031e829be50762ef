"""The driver contract: every query with an oracle matches DuckDB on the smallest data, the others run."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspan.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        at = [got.columns.index(c) for c in want.columns]
        assert sorted(([r[i] for i in at] for r in rows), key=repr) == sorted(map(list, want.fetchall()), key=repr)


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline"])
def test_entry_works_without_the_training_data_subpackage(tmp_path, left):
    root = Path(__file__).resolve().parent.parent
    for p in root.iterdir():
        if p.name not in ("quillspan", ".git", "tests") and (p.name != "corpus_pipeline.py" or left == "the pipeline"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "quillspan").mkdir()
    for p in (root / "quillspan").iterdir():
        if p.name != "llm":
            (tmp_path / "quillspan" / p.name).symlink_to(p)
    if left == "an empty folder":
        (tmp_path / "quillspan/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rank_topk' in q and not any(n.startswith(('op', 'pipeline')) for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_training_data_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "quillspan").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillspan.llm" not in p.read_text(), p
