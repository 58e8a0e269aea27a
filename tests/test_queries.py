import pytest

from traceloom.plans import catalog

from . import compare

pytestmark = pytest.mark.skipif(not compare.there(), reason="needs the driver's tables and DuckDB")


@pytest.fixture(scope="module")
def con():
    return compare.oracle()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    compare.same(spark, catalog.queries()[name], con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, compare.SF).count() > 0


def test_the_sql_of_compaction_on_repeated_pairs():
    import random

    import duckdb

    from traceloom.operators.transfer import compact_pairs

    r, con = random.Random(2), duckdb.connect()
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice("ab")) for c in range(200) for t in range(r.randrange(1, 40))]
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = sorted(x[1:] for x in con.sql(catalog.COMPACTED_SQL).fetchall())
    want = []
    for c in range(200):
        m = [x[2:] for x in rows if x[0] == c]
        want += [(f"conv-{c}", k, *x) for k, x in enumerate(compact_pairs([x for k, x in enumerate(m) if not k or m[k - 1] != x]))]
    assert got == sorted(want) and any(x[-1] > 2 for x in want)
