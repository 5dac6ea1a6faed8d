import datetime
from pathlib import Path

import pytest

from checks.queries import QUERIES
from salesloom.session import shared_dir


@pytest.fixture
def tables(spark, tmp_path):
    """A few thousand rows, and files cut into splits of 16 kB."""
    kinds = ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"]
    parts = [(k, f"Brand#{k % 25}", f"item {k}", kinds[k % 6]) for k in range(60)]
    day = datetime.date(1995, 1, 1)
    lines = [(k // 4, k % 4 + 1, k % 60, float(k % 50 + 1), 900.0 + k % 97, day + datetime.timedelta(k % 900)) for k in range(4000)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate date").coalesce(
        1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16_384)
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_begin_with_blank_lines_are_read_in_splits(spark, tables):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(QUERIES["csv_scan_blank_first_lines"](spark, tables)) == key(QUERIES["csv_scan"](spark, tables))


def test_rewritten_files_keep_their_headers(spark, tables):
    got = {r["user_id"]: r for r in QUERIES["upload_quarantine"](spark, tables).collect()}
    assert {u: r["status"] for u, r in got.items() if u < 20} == {u: "stored" for u in [*range(5), *range(10, 15)]}
    assert sum(got[u]["stored_rows"] + got[u]["rejected_rows"] for u in range(5)) == 4000


def test_files_with_faults_are_written_once(spark, tables):
    """4,000 rows as CSV and as JSON, the files of the first owner twice more, with two and three lines for each of theirs; no other copy."""
    top = Path(shared_dir(spark).removeprefix("file:")) / "salesloom"
    before = set(top.glob("*"))
    QUERIES["upload_quarantine"](spark, tables).collect()
    made = [f for d in set(top.glob("*")) - before if not d.name.startswith("store-") for f in d.rglob("part-*") if f.suffix in (".csv", ".json", ".txt")]
    first = 800 + 1
    assert sum(len(f.read_text().splitlines()) for f in made) == 2 * 4000 + 5 + (2 + 3) * first
