"""Footers instead of scans; rows tagged with the rules that they break."""
from datetime import date, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from covenant.operators import checks as C, quarantine as Q
from covenant.operators.freshness import freshness_result
from covenant.sources import footers as FT
from covenant.sources.tables import TableSet, data_files
from covenant.streaming import gate as SG


def write(folder, name, values, kind=pa.timestamp("us"), statistics=True, column="at"):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({column: pa.array(values, kind), "v": list(range(len(values)))}), folder / name, write_statistics=statistics, row_group_size=2)


CONTRACT = {"table_name": "t", "columns": [{"name": "at"}], "freshness": {"timestamp_column": "at", "max_delay_minutes": 60}}
D = datetime(2024, 1, 31, 23, 30)


def judged(spark, folder):
    row = FT.freshness_from_footers(spark, str(folder), CONTRACT, "2024-02-01 00:00:00").first()
    whole = freshness_result(spark, spark.read.parquet(str(folder)), CONTRACT, "2024-02-01 00:00:00").first()
    assert [row[c] for c in whole.asDict()] == list(whole)
    return row["files"], row["files_scanned"], row["last_updated_at"]


def test_latest_time_from_statistics(spark, tmp_path):
    write(tmp_path / "t", "a.parquet", [D, None, datetime(2020, 1, 1), None, None])
    write(tmp_path / "t", "b c.parquet", [None, None])
    assert judged(spark, tmp_path / "t") == (2, 0, D)


def test_only_files_without_statistics_are_scanned(spark, tmp_path):
    write(tmp_path / "t", "a.parquet", [datetime(2020, 1, 1)])
    write(tmp_path / "t", "b.parquet", [D, datetime(2019, 1, 1)], statistics=False)
    write(tmp_path / "t", "c.parquet", [datetime(2023, 1, 1)])
    assert judged(spark, tmp_path / "t") == (3, 1, D)
    told = {r["path"].rpartition("/")[2]: r["known"] for r in FT.latest_values(data_files(spark, str(tmp_path / "t")), "at").collect()}
    assert told == {"a.parquet": True, "b.parquet": False, "c.parquet": True}


def test_dates_millis_and_files_without_the_column(spark, tmp_path):
    write(tmp_path / "d", "a.parquet", [date(2024, 1, 31), None, date(2024, 1, 2)], pa.date32())
    assert judged(spark, tmp_path / "d") == (1, 0, datetime(2024, 1, 31))
    write(tmp_path / "m", "a.parquet", [D], pa.timestamp("ms"))
    write(tmp_path / "m", "z.parquet", [1], pa.int64(), column="other")
    row = FT.latest_time(spark, str(tmp_path / "m"), "at")
    assert (row[0].first()[0], row[1], row[2]) == (D, 2, 0)


def test_empty_and_missing_tables(spark, tmp_path):
    write(tmp_path / "e", "a.parquet", [])
    assert judged(spark, tmp_path / "e") == (1, 0, None)
    row = FT.freshness_from_footers(spark, str(tmp_path / "none"), CONTRACT).first()
    assert row["status"] == "error"
    text = FT.freshness_from_footers(spark, str(tmp_path / "e"), {**CONTRACT, "freshness": {"timestamp_column": "v", "max_delay_minutes": 1}}).first()
    assert text["status"] == "error"


def test_catalog_of_many_tables(spark, tmp_path):
    write(tmp_path / "one", "a.parquet", [D])
    write(tmp_path / "one", "b.parquet", [1], pa.int32())  # the type has changed
    (tmp_path / "one" / "_temporary").mkdir()
    write(tmp_path / "one" / "_temporary", "x.parquet", [1], pa.int32(), column="half_written")
    spark.createDataFrame([(1, [1.5], {"a": 2})], "i int, l array<double>, m map<string,int>").coalesce(1).write.parquet(str(tmp_path / "two"))
    (tmp_path / "empty").mkdir()
    tables = spark.createDataFrame([("s", n, str(tmp_path / n)) for n in ("one", "two", "empty", "gone")], "table_schema string, table_name string, path string")
    got = sorted(tuple(r)[1:] for r in FT.catalog_scan(spark, tables).collect() if r["found"])
    assert got == [("one", True, 1, "at", "int", True, 2, 2, 2), ("one", True, 2, "v", "bigint", True, 2, 2, 1), ("two", True, 1, "i", "int", True, 1, 1, 1),
                   ("two", True, 2, "l", "array<double>", True, 1, 1, 1), ("two", True, 3, "m", "map<string,int>", True, 1, 1, 1)]
    assert sorted(r["table_name"] for r in FT.catalog_scan(spark, tables).filter("not found").collect()) == ["empty", "gone"]


def test_a_store_that_only_spark_opens(spark, tmp_path):
    """viewfs: pyarrow has no way to it; columns come from Spark, times from a scan."""
    write(tmp_path / "one", "a.parquet", [D])
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.given.link./in", f"file://{tmp_path}")
    path = "viewfs://given/in/one"
    tables = spark.createDataFrame([("s", "one", path), ("s", "gone", "viewfs://given/in/gone")], "table_schema string, table_name string, path string")
    got = sorted((r["table_name"], r["found"], r["column_name"] or "", r["data_type"] or "") for r in FT.catalog_scan(spark, tables).collect())
    assert got == [("gone", False, "", ""), ("one", True, "at", "timestamp_ntz"), ("one", True, "v", "bigint")]
    row = FT.freshness_from_footers(spark, path, CONTRACT, "2024-02-01 00:00:00").first()
    assert (row["last_updated_at"], row["files_scanned"], row["status"]) == (D, 1, "passed")


# ----------------------------------------------------------------- quarantine

RULES = [{"rule_type": "not_null", "column": "k"}, {"rule_type": "unique", "parameters": {"columns": ["k", "p"]}}, {"rule_type": "unique", "column": "k"},
         {"rule_type": "referential_integrity", "column": "k", "parameters": {"reference_table": "r", "reference_column": "id"}},
         {"rule_type": "max_value", "column": "v", "parameters": {"value": 5}}, {"rule_type": "max_value", "column": "v", "parameters": {"value": 7}},
         {"rule_type": "row_count_min", "parameters": {"min_count": 99}}, {"rule_type": "custom_sql", "parameters": {"sql": "SELECT 1 FROM {table}"}}]
ROWS = [(1, "a", 1), (1, "b", 2), (1, "b", 8), (2, "a", 6), (None, "a", 1), (None, "a", None), (7, None, 0), (3, None, 0), (3, None, 0)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, p string, v int")


def test_every_row_is_tagged_once(spark, rows):
    tagged = Q.tag(rows, RULES, TableSet({"r": spark.range(4)}))
    assert tagged.columns == ["k", "p", "v", "broken_rules"]
    got = sorted((str(r["k"]), str(r["p"]), str(r["v"]), ",".join(r["broken_rules"])) for r in tagged.collect())
    assert got == sorted([
        ("1", "a", "1", "unique_k"), ("1", "b", "2", "unique_k_p,unique_k"), ("1", "b", "8", "unique_k_p,unique_k,max_value_v_5,max_value_v_6"),
        ("2", "a", "6", "max_value_v_5"), ("None", "a", "1", "not_null_k"), ("None", "a", "None", "not_null_k"), ("7", "None", "0", "referential_integrity_k"),
        ("3", "None", "0", "unique_k"), ("3", "None", "0", "unique_k")])


def test_split_is_whole_and_replaced_when_written_again(spark, rows, tmp_path):
    tagged = Q.tag(rows, RULES, TableSet({"r": spark.range(4)}))
    for _ in range(2):
        Q.write_split(tagged, str(tmp_path / "run"))
    passed, failed = Q.read_split(spark, str(tmp_path / "run"), True), Q.read_split(spark, str(tmp_path / "run"), False)
    assert passed.count() + failed.count() == len(ROWS) and passed.columns == ["k", "p", "v"]
    assert {r["rule"]: r["n_rows"] for r in Q.broken_counts(failed).collect()}["unique_k"] == 5
    assert not Q.tag(rows, [], None).filter(F.size("broken_rules") > 0).count()


def test_a_hot_key_is_split(spark):
    """A key in most of the rows: the join back to the rows is not one task."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("k"), "id")
    tagged = Q.tag(df, [{"rule_type": "unique", "column": "k"}])
    assert tagged.filter(F.size("broken_rules") > 0).count() == C.violations(df, {"rule_type": "unique", "column": "k"}).first()["n_rows"]


def test_gate_with_quarantine(spark, rows, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = [RULES[0], RULES[4]]
    q, sink = SG.start_rule_gate(spark, str(tmp_path / "in"), rows.schema, "t", rules, base_dir=str(tmp_path / "g"), quarantine=True)
    q.awaitTermination()
    assert SG.gate_rows(spark, sink, True).count() == 5 and SG.gate_rows(spark, sink, False).count() == 4
    assert {r["rule"]: r["n_rows"] for r in Q.broken_counts(SG.gate_rows(spark, sink, False)).collect()} == {"not_null_k": 2, "max_value_v": 2}
