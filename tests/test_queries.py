"""Every registered query of the pixel tables against the same statement in DuckDB."""

import duckdb
import pytest

from pixelloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
TABLES += ["embeddings"]


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows(names, data, columns):
    index = [names.index(c) for c in columns]
    return sorted(repr(tuple(plain(r[i]) for i in index)) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect(), sorted(names)) == rows(names, found.fetchall(), sorted(names))


QUICK = ["d9_inject_noise", "f15_match_psf", "g4_suppress_close", "g6_blend_structures", "i5_gaussian_psf_integrated", "i8_spergel_profile", "i9_point_source_model", "i11_random_components", "k12_bluer_disk", "l8_resize_components"]


@pytest.mark.parametrize("name", QUICK)
def test_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
