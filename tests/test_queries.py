"""Every query with SQL against DuckDB on the smallest tables, and the others for a stable schema."""

import glob
import os

import duckdb
import pytest

from inkstream.plans.registry import MODULES, gather

QUERIES, SQL = gather(MODULES)


def canon(rows):
    def value(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return round(v, 5) if isinstance(v, float) else v

    return sorted(repr([value(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, oracle, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    rows = canon(got.select(*columns).collect())
    if name in SQL:
        want = oracle.execute(SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == canon([[r[i] for i in order] for r in want.fetchall()])


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys, inkstream.plans.registry as r; r.gather(r.MODULES); assert not any(m.startswith('inkstream.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))


def test_entry_keeps_the_core_when_a_library_of_llm_is_missing():
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'p10_found' not in q and 'p7_found' in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[8]", True), ("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)])
def test_a_cluster_must_name_its_shared_folder(master, fine):
    from types import SimpleNamespace

    from inkstream.session import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert shared_dir(session).startswith("file:///")
    else:
        with pytest.raises(ValueError):
            shared_dir(session)
    session.conf.get = lambda name, default: "hdfs://shared/"
    assert shared_dir(session) == "hdfs://shared"
