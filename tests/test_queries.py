"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from maskwright import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def rows_of(frame):
    columns = sorted(frame.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in columns) for r in frame.collect()), key=repr)


def sql_rows(sql):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[k]) for k in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    assert rows_of(Q.FOUND[name](spark, str(DATA))) == sql_rows(Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.FOUND) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.FOUND[name](spark, str(DATA)).count() >= 0


def test_native_spans_in_documents(spark):
    """Single rules give what the Python rules give, on real documents."""
    from maskwright.operators.spans import trimmed
    from maskwright.rules import BY_NAME

    docs = Q.table(spark, str(DATA), "documents").where("text IS NOT NULL").collect()
    for query, rule in (("ip_spans", "IP_ADDRESS"), ("phone_spans", "PHONE")):
        rule = BY_NAME[rule]
        want = sorted((d.doc_id, *trimmed(d.text, *m.span(), rule.strip)) for d in docs for m in rule.regex.finditer(d.text))
        assert sorted((r.doc_id, r.start, r.end) for r in Q.FOUND[query](spark, str(DATA)).collect()) == want
