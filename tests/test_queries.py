"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from meridian import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    return None if v is None else round(v + 0.0, 9) if isinstance(v, float) else v if isinstance(v, (bool, int)) else str(v)


def rows_of(dicts):
    return sorted((tuple(cell(d[c]) for c in sorted(d)) for d in dicts), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = rows_of(dict(zip(names, r, strict=True)) for r in cursor.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(r.asDict() for r in df.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, (int, float)) and y is not None and x == pytest.approx(float(y), abs=2e-6, rel=1e-9)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_quantiles_are_all_there(spark):
    """every distribution's quantiles for all degrees of freedom of the table, those that tables print among them."""
    found = {r.name: r for r in queries.queries()["quantiles"](spark, SF).collect()}
    printed = {"normal 0.975": 1.959964, "chi2 0.95 10": 18.307038, "t 0.975 5": 2.570582, "f 0.95 3 10": 3.708265, "non-centrality": 4.132148, "chi2 0.05 10": 3.940299, "f 0.95 1 1": 161.447639, "t 0.95 1": 6.313752, "confidence 0.95 2": 2.447747, "confidence 0.95 1": 1.959964}
    assert {n: found[n].quantile for n in printed} == pytest.approx(printed, abs=1.1e-6)
    sizes = {r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    degrees = sizes | {2 * n for n in sizes}
    for kind in ("chi2 0.95", "chi2 0.05", "t 0.975", "t 0.95", "f 0.95 1", "f 0.95 2", "f 0.95 3", "confidence 0.95 1", "confidence 0.95 2"):
        assert {f"{kind} {n}" for n in degrees} <= set(found)
    assert all(r.chi2_95 == found[f"chi2 0.95 {r.dof}"].quantile for r in found.values() if r.dof)
    assert all(r.probability == (float(n.split()[1]) if n != "non-centrality" else 0.0) for n, r in found.items())
