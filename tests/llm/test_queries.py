"""Every registered text query with SQL gives the same rows as DuckDB does; the others run and give all rows."""

import duckdb
import pytest

from tests.llm.conftest import SF
from tidemark.llm import oracles, queries

COUNTS = {"op3_simhash": "documents", "op6_quality_model": "documents", "op10_html_extract": "pages"}


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(r[n] for n in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(n)] for n in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_query_gives_every_row(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() == queries.table(spark, SF, COUNTS[name]).count()


def test_licences_of_whole_table(spark):
    found = queries.QUERIES["op2_license_scan"](spark, SF).collect()
    text = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in found:
        assert text[r.doc_id].split("\n")[r.line_no] == r.paragraph
    stated = sum(line in ("Released under the MIT License.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.") for t in text.values() for line in t.split("\n"))
    assert sum(r.confirmed for r in found) == stated
