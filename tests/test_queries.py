"""Every registered query of the engine against its DuckDB twin, and expected figures of the fixture."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corrobora.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_duckdb(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert plain(map(tuple, df.collect())) == plain(rel.select(*[f'"{c}"' for c in df.columns]).fetchall())


@pytest.mark.parametrize("name, seconds", [("rate_window", 86400), ("rate_window_minute", 60)])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_windows_end_where_duckdb_ends_them(spark, tmp_path, name, seconds, zone):
    """Fractions, halves at even and odd seconds, times before 1970, nights when clocks change, times and users that are null."""
    con, s = duckdb.connect(), spark.newSession()
    s.conf.set("spark.sql.session.timeZone", zone)
    con.execute(f"""CREATE VIEW events AS SELECT row_number() OVER (ORDER BY ts, u) AS event_id, ts, u AS user_id, 'kind ' || u AS event_type FROM (
        SELECT day + to_seconds(past) + to_microseconds(part) AS ts, u
        FROM (VALUES (TIMESTAMP '2024-01-01 00:00:00'), ('1969-12-30 12:00:01'), ('2024-03-09 20:00:00'), ('2024-11-02 22:00:00')) a(day),
            (VALUES (0), (1), ({seconds - 3600}), ({seconds} - 1), ({seconds}), ({seconds} + 1), ({seconds} + 1800)) b(past), (VALUES (0), (400000), (500000), (600000)) c(part), (VALUES (1), (NULL)) d(u)
        UNION ALL SELECT NULL, u FROM (VALUES (1), (1), (NULL)) e(u))""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = catalogue.QUERIES[name](s, str(tmp_path))
    want = con.sql(catalogue.ORACLES[name])
    assert plain(map(tuple, df.collect())) == plain(want.select(*df.columns).fetchall())


def test_window_rounds_its_times(spark, tmp_path):
    times = [("00:00:00.4", "00:00:00.6", 1), ("00:00:00.6", "00:00:01.4", 2), ("00:00:00.5", "00:00:01.0", 1), ("00:00:01.5", "00:00:02.5", 2)]
    rows = ", ".join(f"({u}, {u}, TIMESTAMP '2024-01-01 {a}'), ({u + 10}, {u}, TIMESTAMP '2024-01-02 {b}')" for u, (a, b, _) in enumerate(times))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, user_id, ts)) TO '{tmp_path}/events.parquet'")
    got = {r["event_id"]: r["n_recent"] for r in catalogue.QUERIES["rate_window"](spark, str(tmp_path)).collect()}
    assert got == {u: 1 for u in range(4)} | {u + 10: n for u, (_, _, n) in enumerate(times)}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_others_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_expected_verdicts(spark):
    got = Counter()
    for r in entry.entry(spark).collect():
        got[r["verdict"], r["shift_type"]] += r["n"]
    assert got == {
        ("corroborated", "none"): 256 + 74 + 65 + 387, ("genuine_contradiction", "none"): 98, ("context_reconciled", "temporal_shift"): 2106,
        ("context_reconciled", "scope_shift"): 588, ("extraction_failure", "none"): 588 + 25, ("temporal_update", "temporal_shift"): 146,
    }


def test_expected_failures(spark):
    rows = catalogue.QUERIES["corpus_audit"](spark, SF).collect()
    got = Counter(r["failure_type"] for r in rows)
    assert got == {"BOUNDARY_ERROR": 2, "EXTRACTION_ERROR": 15, "QUALIFIER_DROPPED": 3, "LAYOUT_FLATTENING": 2, "EVIDENCE_MISSING": 2, "REASONING_ERROR": 10} and len(rows) == 34


def test_every_query_is_registered():
    assert catalogue.QUERIES.keys() <= entry.queries().keys() and catalogue.ORACLES.keys() <= entry.oracle_sql().keys()
