"""Readers, writers and fingerprints over files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contrail.operators import normalize as N
from contrail.sources import contracts as C
from contrail.sources import readers as S
from contrail.sources import writers as W


def test_csv_scan_keeps_text_and_finds_unknown_columns(spark, tmp_path):
    path = tmp_path / "crew.csv"
    path.write_text('crew_assignment_id,flight_id,extra\nC1,"F,1",\nC2,,x\n')
    df = S.scan_csv(spark, str(path), C.CREW_OPERATIONS)
    found = {r["crew_assignment_id"]: r for r in df.collect()}
    assert found["C1"]["flight_id"] == "F,1" and df.select("row_number").distinct().count() == 2
    findings = N.column_findings(df, C.CREW_OPERATIONS)
    rules = {(r["rule_id"], r["field_name"]) for r in findings.collect()}
    assert ("CR-002", "extra") in rules and ("CR-001", "duty_minutes") in rules


def test_csv_without_header_is_an_error(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("")
    with pytest.raises(S.SourceError):
        S.scan_csv(spark, str(path), C.CREW_OPERATIONS)


def test_jsonl_scan_skips_blanks_and_marks_bad_lines(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text('{"airport_code": "LHR", "severity": 3, "odd": true}\n\n[1]\nnot json\n')
    lines = S.scan_jsonl(spark, str(path))
    assert sorted(r["is_object"] for r in lines.collect()) == [False, False, True]
    good = S.jsonl_columns(lines.filter("is_object"), C.AIRPORT_EVENTS).first()
    assert good["airport_code"] == "LHR" and good["severity"] == "3"
    unknown = N.column_findings(
        lines.filter("is_object"), C.AIRPORT_EVENTS, observed_columns=F.map_keys("fields"), unknown_policy="warn"
    ).filter("rule_id = 'AE-002'")
    assert [(r["field_name"], r["severity"]) for r in unknown.collect()] == [("odd", "warning")]


def test_writers_order_columns(spark, tmp_path):
    df = spark.createDataFrame([(2, 1)], "b int, a int").coalesce(1)
    W.write_rows(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).columns == ["a", "b"]
    W.write_jsonl(df, str(tmp_path / "lines"))
    text = next((tmp_path / "lines").glob("*.json")).read_text()
    assert list(json.loads(text)) == ["a", "b"]


def test_processed_table_has_contract_order(spark, tmp_path):
    contract = C.DatasetContract("s", "S", "csv", ("k",), (C.text("k"), C.whole("v")))
    df = spark.createDataFrame([(1, "x", 9)], "v int, k string, row_number int").coalesce(1)
    W.write_processed(df, str(tmp_path / "out"), contract, fmt="csv")
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines() == ["k,v", "x,1"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    mark = S.content_fingerprint(df).first()
    assert S.content_fingerprint(df.orderBy(F.desc("id")).repartition(7)).first() == mark
    assert S.content_fingerprint(df.withColumn("x", F.col("x") + (F.col("id") == 5).cast("int"))).first() != mark
    declared = S.content_fingerprint(df)
    assert S.verify_table(df, declared, ["id", "x"]).first()["accepted"]
    assert not S.verify_table(df.filter("id > 0"), declared, ["id"]).first()["accepted"]
    assert not S.verify_table(df, declared, ["absent"]).first()["accepted"]


def test_checksums(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    big = b"\n".join(bytes(rng.choices(range(256), k=rng.randint(0, 60))) for _ in range(3000))
    (tmp_path / "part").mkdir()
    for name, data in {"a.bin": b"abc", "ends.bin": b"abc\n", "part/00.bin": big, "part/01 b.bin": big + b"\n\n", "none.bin": b""}.items():
        (tmp_path / name).write_bytes(data)

    def seen():
        return {r["file_name"]: (r["file_bytes"], r["sha256"]) for r in S.file_checksums(spark, str(tmp_path)).collect()}

    before = seen()
    assert set(before) == {"a.bin", "ends.bin", "part/00.bin", "part/01 b.bin"}  # an empty file has no line to read
    assert len({d for _, d in before.values()}) == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert seen() == before  # whatever the blocks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = big.split(b"\n")
    lines[5], lines[2500] = lines[2500], lines[5]
    for other in (big[:-1] + bytes([big[-1] ^ 1]), b"\n".join(lines)):
        (tmp_path / "part/00.bin").write_bytes(other)
        after = seen()
        assert after["part/00.bin"][1] != before["part/00.bin"][1] and after["a.bin"] == before["a.bin"]
    files = S.file_checksums(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a.bin", "bad"), ("b.bin", "x"), ("ends.bin", before["ends.bin"][1])], "file_name string, expected_sha256 string")
    got = {r["file_name"]: (r["present"], r["verified"]) for r in S.verify_checksums(files, wanted).collect()}
    assert got == {"a.bin": (True, False), "b.bin": (False, False), "ends.bin": (True, True)}


def test_row_numbers_are_those_of_the_source(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for part in range(3):
        rows = "\n".join(f"C{part}{i:04d},F" for i in range(700))
        (tmp_path / "csv" / f"p{part}.csv").write_text("crew_assignment_id,flight_id\n" + rows + "\n")
    (tmp_path / "lines.jsonl").write_text("\n".join('{"severity": %d}' % i if i % 7 else "" for i in range(900)))
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            scanned = S.scan_csv(spark, str(tmp_path / "csv"), C.CREW_OPERATIONS).repartition(5)
            got = sorted((r["row_number"], r["crew_assignment_id"]) for r in scanned.collect())
            assert got == [(2 + 700 * p + i, f"C{p}{i:04d}") for p in range(3) for i in range(700)]
            found = {r["row_number"]: r["fields"]["severity"] for r in S.scan_jsonl(spark, str(tmp_path / "lines.jsonl")).collect()}
            assert found == {i + 1: str(i) for i in range(900) if i % 7}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jsonl_objects_are_told_from_other_values(spark, tmp_path):
    lines = ['{"a": 1}', ' \t{"a": {"b": [2]}}', "[1]", '[{"a": 1}]', '"{"', "{", '{"a": 1', "null", "7", "{}", "a{}"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    found = {r["line"]: r["is_object"] for r in S.scan_jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert {line for line, yes in found.items() if yes} == {lines[0], lines[1], "{}"}
    assert len(found) == len(lines)


def test_scan_jsonl_query_reads_each_written_table_once(spark):
    plan = entry.queries()["scan_jsonl"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("] text") == 2
