"""Registered queries against their SQL twins on the smallest tables. RILLWORK_ALL_QUERIES=1 checks every one."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EVERY = sorted(entry.oracle_sql())
SOME = ["s4_header_matrix", "s7_pipe_positions", "s10_named_series", "s14_geojson", "s15_first_nonempty", "s18_week_windows", "s19_completeness", "c1_parse_number",
        "c9_entry_for_name", "j1_left_chain", "j7_substring_join", "a4_tenure_ratio", "a13_national_crops", "a28_price_snapshot", "d13_county_rollup", "m17_simulate",
        "w1_rank_pct", "w2_best_year", "w5_pareto", "w12_nested_top", "p1_low_hanging_fruit", "p3_dual_exposure", "t5_vulnerable_states", "e4_full_map", "e8_year_view",
        "m7_naive_effects", "m13_subgroup_effects", "x3_snapshot_upkeep", "flagship_state_rollup"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", EVERY if os.environ.get("RILLWORK_ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.columns, df.collect()) == table(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10  # the smallest tables have suppliers in ten states


def test_every_operator_is_registered():
    ids = {n.split("_")[0] for n in entry.queries()}
    want = ([f"s{i}" for i in range(1, 22)] + [f"c{i}" for i in range(1, 24)] + [f"j{i}" for i in range(1, 14)]
            + [f"a{i}" for i in range(1, 31) if i not in (26, 27)] + ["a26p", "a27p"] + [f"w{i}" for i in range(1, 13)] + [f"t{i}" for i in range(1, 13)]
            + [f"u{i}" for i in range(1, 5)] + [f"d{i}" for i in range(1, 16)] + [f"m{i}" for i in range(1, 18)] + [f"p{i}" for i in range(1, 6)]
            + [f"e{i}" for i in range(1, 9)] + ["x1", "x2", "x3", "r1", "w3b", "w7b"])
    assert [w for w in want if w not in ids] == []
