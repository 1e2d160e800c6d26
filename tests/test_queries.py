"""Every checked query against its SQL on the small tables, with names and types of the columns."""

import math

import pytest

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(table):
    columns = sorted(table.column_names)
    return sorted((tuple(comparable(v) for v in row) for row in zip(*[table[c].to_pylist() for c in columns])), key=repr)


def type_of(table, column):
    return str(table.schema.field(column).type).replace("large_", "")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    found = QUERIES[name](spark, data).toArrow()
    if name not in ORACLES:
        assert found.num_rows > 0
        return
    wanted = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    for column in found.column_names:
        assert type_of(found, column) == type_of(wanted, column), column
    assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
