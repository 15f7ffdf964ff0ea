import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """A function from (SQL, folder of tables) to rows and column names."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql, folder):
        con = duckdb.connect()
        for t in names:
            p = Path(folder, f"{t}.parquet")
            if p.exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
        cur = con.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()

    return run


@pytest.fixture(scope="session")
def graph(spark):
    """A function from node and edge shorthands to (nodes, edges).

    A node is (id, sort, more) with sort F for a file, X for an external or
    an entity's kind; an edge is (src, dst), with ``=`` before the target for
    one that contains.
    """
    from depweave.schema import EDGES, NODES

    fields = [f.split()[0] for f in NODES.split(", ")]

    def make(nodes, edges):
        rows = []
        for i, (id_, sort, *more) in enumerate(nodes):
            row = dict.fromkeys(fields) | {"id": id_, "ord": i, "external": sort == "X", "kind": None if sort in "FX" else sort}
            row |= more[0] if more else {}
            rows.append(tuple(row[f] for f in fields))
        links = [(i, s, d.lstrip("="), "contains" if d.startswith("=") else None, None if d.startswith("=") else "imports") for i, (s, d) in enumerate(edges)]
        return spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES)

    return make
