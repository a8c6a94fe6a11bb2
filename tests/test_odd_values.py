"""Queries against their SQL, to the last digit, on values that the given tables don't have."""

import os
from pathlib import Path

import duckdb
import pytest
from test_registry import SF, TABLES, rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives what its SQL does on the small tables, of which some are replaced by what SQL makes of them."""

    def check(name: str, **changed: str) -> bool:
        from signalspark.record_queries import QUERIES, SQL

        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW old_{t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        for t in TABLES:
            path = Path(tmp_path, f"{t}.parquet")
            if t in changed:
                c.execute(f"COPY ({changed[t]}) TO '{path}' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", path)
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
        df, answer = QUERIES[name](spark, str(tmp_path)), c.execute(SQL[name])
        got, want = rows(df.columns, df.collect()), rows([d[0] for d in answer.description], answer.fetchall())
        return len(want) > 0 and got == want

    return check


TINY = "SELECT * REPLACE (value / 10000000 AS value) FROM old_events"


def test_loudness_with_an_exponent(agrees):
    assert agrees("loudness_log", events=TINY)


def test_quality_with_an_exponent(agrees):
    assert agrees("quality_logs", events=TINY)


def test_entropy_of_an_empty_text(agrees):
    assert agrees("entropy_chars", documents="SELECT * REPLACE (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN text END AS text) FROM old_documents")


def test_a_leap_that_is_the_limit_but_for_its_last_bits(agrees):
    """Leaps of forty between values with two decimals."""
    assert agrees("flash_risk", events="SELECT * REPLACE ((2400 + event_id // 2 % 1000 + event_id % 2 * 4000) / 100.0::DOUBLE AS value, event_id // 2 AS user_id) FROM old_events")


def test_headline_of_more_than_a_day(agrees):
    assert agrees("headlines", supplier="SELECT * REPLACE (s_suppkey * 997 AS s_suppkey) FROM old_supplier")


def test_encoder_marks_behind_long_settings(agrees):
    assert agrees("encoder_marks", supplier="SELECT * REPLACE (s_suppkey * 97 AS s_suppkey) FROM old_supplier")


def test_a_mean_that_is_the_limit_is_not_over_it(spark, tmp_path):
    """The SQL's sum of doubles is over or under it by the order of the rows."""
    from signalspark.record_queries import QUERIES

    taxes = [0.08, 0.08, 0.06, 0.08, 0.07, 0.08, 0.07, 0.08, 0.1]
    for order, name in ((sorted(taxes), "a"), (sorted(taxes)[::-1], "b")):
        rows = [(1, 1.0, 0.0, t / 2, 1, "A", "O") for t in order]
        spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double, l_tax double, l_linenumber int, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert "recompress" not in [r.id for r in QUERIES["verdict_layer"](spark, f"{tmp_path}/{name}").collect()]
