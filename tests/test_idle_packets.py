"""Packets of APID 2047 are idle fill, whoever sent them: queries and their SQL leave them out alike."""

import os

import check
import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Queries that hand on packets.
NAMES = ("export_summary", "link_stats", "reassembled", "recording_export", "recovered_packets", "stream_packets")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables with users enough for APID 2047, and one capture that ends with such a packet."""
    place = tmp_path_factory.mktemp("idle")
    for name in os.listdir(FOLDER):
        if name != "events.parquet":
            os.symlink(f"{FOLDER}/{name}", place / name)
    user = "CASE WHEN event_id % 7 = 2 OR event_id > (SELECT max(event_id) - 4 FROM e) THEN 2047 ELSE user_id END"
    rows = f"WITH e AS (SELECT * FROM '{FOLDER}/events.parquet') SELECT * REPLACE (CAST({user} AS BIGINT) AS user_id) FROM e"
    duckdb.sql(rows).write_parquet(str(place / "events.parquet"))
    return str(place)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    problem = check.compare(spark, check.connect(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None, problem
