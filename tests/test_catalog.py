"""Each query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from stanzaflow.plans import analyses, catalog, catalog_exact, catalog_io, catalog_more  # noqa: F401
from stanzaflow.plans.catalog import scored, units
from stanzaflow.plans.sample import CONTROL, KEEP, SIGNAL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [norm(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(set(names)) == len(names)
    ours = sorted(str([norm(r[c]) for c in names]) for r in got.collect())
    index = [want.columns.index(c) for c in names]
    assert ours == sorted(str([norm(r[i]) for i in index]) for r in want.fetchall())


def test_logistic_probe(spark):
    rows = catalog.QUERIES["logistic_probe"](spark, SF).collect()
    assert [r.fold for r in rows] == list(range(5)) and all(0 <= r.accuracy <= 1 for r in rows)


def test_entry_has_rows_and_every_sql_a_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_folder(tmp_path):
    """The entry module imports and lists its other queries where the subpackage and the pipeline are gone."""
    root = Path(__spark_entry__.__file__).parent
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    package = tmp_path / "stanzaflow"
    package.mkdir()
    for p in (root / "stanzaflow").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1') for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False", str(len(catalog.SQL))], out.stderr


def test_analyses_end_to_end(spark):
    s = scored(spark, SF)
    t = analyses.trajectory(s)
    assert len(t["eras"].first()) == 3 and t["changepoint"].count() == 1 and t["yearly"].count() > 50
    both = analyses.score(units(spark, SF), "text", SIGNAL, CONTROL, 0.8, 16, KEEP)
    assert analyses.crosssource({"a": both, "b": both.limit(0)}).collect()[0].n == both.count()
    assert analyses.equivalence(both, both, ["doc_id"], 50).first().verdict == "AGREE"
    v = analyses.validation(s, "source", "lang", "doc_id", {"en"}, {"de", "fr"}, 20)
    assert v["authors"].count() > 5 and 0 < v["permutation"].first().p <= 1 and len(v["groups"].first().group) > 0
