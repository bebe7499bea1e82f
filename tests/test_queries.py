"""Every registered query of the engine's own operators against its SQL on the smallest tables, and properties of those without SQL."""

import math

import duckdb
import pytest

from spanloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*cols).collect())
    r = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(normal(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def test_tiling_cover_covers_the_same_with_fewest(spark):
    from spanloom.operators import intervals
    from spanloom.plans.queries import _short

    ivals = [tuple(r) for r in _short(spark, DATA).collect()]
    got = [tuple(r) for r in QUERIES["tiling_cover"](spark, DATA).collect()]
    for seq in {r[0] for r in ivals}:
        own = sorted((b, e) for s, b, e in ivals if s == seq)
        out = sorted((b, e) for s, b, e in got if s == seq)
        points = lambda x: {p for b, e in x for p in range(b, e)}
        assert points(own) == points(out)
        n, at, i = 0, None, 0
        while i < len(own):  # a plain greedy cover
            if at is None or own[i][0] > at:
                at = max(e for b, e in own if b == own[i][0])
                n += 1
            reach = max((e for b, e in own if b <= at), default=at)
            if reach > at:
                at, n = reach, n + 1
            else:
                while i < len(own) and own[i][0] <= at:
                    i += 1
        assert len(out) == n
    assert intervals is not None


def test_forest_is_maximal_and_acyclic(spark):
    from spanloom.plans import adapters as ad

    edges = sorted(((r.w, -r.a, -r.b) for r in ad.edges(spark, DATA).collect()), reverse=True)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    want = []
    for w, a, b in edges:
        x, y = find(-a), find(-b)
        if x != y:
            root[x] = y
            want.append((-a, -b, w))
    got = [tuple(r) for r in QUERIES["spanning_forest"](spark, DATA).collect()]
    assert sum(x[2] for x in got) == sum(x[2] for x in want) and len(got) == len(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"tiling_cover", "spanning_forest", "forest_positions", "second_copies"}))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_flagship(spark):
    import __spark_entry__ as e

    assert sum(r.bases for r in e.entry(spark).collect()) == 20_000 * spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert set(ORACLE_SQL) <= set(e.queries())
