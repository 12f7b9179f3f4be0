import builtins
import hashlib
import io

import pytest

from granary.contract import RawWritePermissionError
from granary.layout import deposit_raw_csv, enforce_raw_read_only, ensure_data_layout, is_under, raw_read_only_guard
from granary.sources.csv_files import ROW_INDEX, _breaks_in_quotes, extract_csv, read_text_csv, sha256_of_file, sha256_of_files
from granary.sources.parquet_files import export_parquet, read_panel


def put(tmp_path, text, name="a.csv"):
    path = ensure_data_layout(tmp_path).raw / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


def read(spark, path, **k):
    frame = read_text_csv(spark, path, **k)
    return [c for c in frame.columns if c != ROW_INDEX], [tuple(r)[:-1] for r in frame.orderBy(ROW_INDEX).collect()]


@pytest.mark.parametrize(
    ("text", "columns", "rows"),
    [
        ("a,b\n1,\n,\"\"\n", ["a", "b"], [("1", ""), ("", "")]),
        ("a,b\nNA,null\n", ["a", "b"], [("NA", "null")]),
        ("a,b,c\n1\n2,3\n", ["a", "b", "c"], [("1", "", ""), ("2", "3", "")]),
        ("a,b\n\n1,2\n\n", ["a", "b"], [("1", "2")]),
        ("a,a,a\n1,2,3\n", ["a", "a.1", "a.2"], [("1", "2", "3")]),
        ("Date,date\n1,2\n", ["Date", "date"], [("1", "2")]),
        (",b\n1,2\n", ["Unnamed: 0", "b"], [("1", "2")]),
        ("﻿a,b\n 1 ,\"x\ny\"\n\"q\"\"r\",2\n", ["a", "b"], [(" 1 ", "x\ny"), ('q"r', "2")]),
        ("a,b\n", ["a", "b"], []),
    ],
)
def test_csv_parity(spark, tmp_path, text, columns, rows):
    path = put(tmp_path, text)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert read(spark, path) == (columns, rows)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_malformed(spark, tmp_path):
    for text in ("a,b\n1,2\n1,2,3\n", "a,b\n1,2,3\n", ""):
        with pytest.raises(ValueError):
            read(spark, put(tmp_path, text))


def test_split_scan_keeps_positions(spark, tmp_path):
    path = put(tmp_path, "a\n" + "\n".join(str(i) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r[0] for r in read(spark, path, multiline=False)[1]] == [str(i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_breaks_in_quotes_are_found(spark, tmp_path):
    for text, whole in (('a,b\n"x\ny",1\n', True), ('a,b\n"x ""y"", z",1\n', False), ("a,b\n1,2\n", False)):
        assert _breaks_in_quotes(spark, put(tmp_path, text)) == whole
    path = put(tmp_path, "a,b\n" + "".join(f'"{i}, ""q""",\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = read_text_csv(spark, path)
        assert frame.rdd.getNumPartitions() > 4
        assert [tuple(r) for r in frame.orderBy(ROW_INDEX).collect()] == [(f'{i}, "q"', "", i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_rows_with_quoted_commas(spark, tmp_path):
    assert read(spark, put(tmp_path, 'a,b\n"1,2,3"\n"x,y",2\n'))[1] == [("1,2,3", ""), ("x,y", "2")]
    with pytest.raises(ValueError, match="4 fields"):
        read(spark, put(tmp_path, 'a,b\n1,2\n"x,y",2,3,\n'))


def test_extract(spark, tmp_path):
    path = put(tmp_path, "sku,qty\n" + "A,1\n" * 50_001)
    got = extract_csv(spark, path, data_root=tmp_path)
    assert got.row_count == 50_001 and got.sha256 == hashlib.sha256(path.read_bytes()).hexdigest() == sha256_of_file(path, 7)
    assert sha256_of_files(spark, str(path)).first()["sha256"] == got.sha256
    other = ensure_data_layout(tmp_path).staging / "a.csv"
    other.write_text("a\n1\n")
    for bad in (other, put(tmp_path, "a\n1\n", "a.txt")):
        with pytest.raises(ValueError):
            extract_csv(spark, bad, data_root=tmp_path)


def test_parquet_zones(spark, tmp_path):
    layout, frame = ensure_data_layout(tmp_path), spark.createDataFrame([("A", 1)], "`sku id` string, qty int")
    for single in (False, True, False):
        path = export_parquet(frame, layout.processed / "x" / "p.parquet", data_root=tmp_path, single_file=single)
        assert path.is_file() == single and spark.read.parquet(str(path)).columns == ["sku id", "qty"]
    with pytest.raises(RawWritePermissionError):
        export_parquet(frame, layout.raw / "p.parquet", data_root=tmp_path)
    for bad in (layout.processed / "p.csv", layout.staging / "p.parquet"):
        with pytest.raises(ValueError):
            export_parquet(frame, bad, data_root=tmp_path)


def test_nanosecond_files(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"sku_id": ["A"], "timestamp": pd.to_datetime(["2024-10-01"]).astype("datetime64[ns]"), "demand_qty": [1.0], "lead_time_days": [3]})
    frame.to_parquet(tmp_path / "n.parquet", coerce_timestamps=None, version="2.6")
    row = read_panel(spark, str(tmp_path / "n.parquet")).first()
    assert str(row["timestamp"]) == "2024-10-01 00:00:00"


@pytest.mark.parametrize("mode", ["w", "a", "x", "w+", "r+", "wb", "ab"])
def test_guard(tmp_path, mode):
    path, before = put(tmp_path, "a"), (builtins.open, io.open)
    with raw_read_only_guard(path.parent):
        assert open(path).read() == "a"
        for opener in (open, io.open):
            with pytest.raises(RawWritePermissionError) as e:
                opener(path if mode != "x" else path.parent / "new", mode)
        assert "test_guard" in e.value.caller
        (tmp_path / "out").write_text("fine")
    assert (builtins.open, io.open) == before

    @enforce_raw_read_only(path.parent)
    def write():
        path.write_text("b")

    with pytest.raises(RawWritePermissionError):
        write()
    assert (builtins.open, io.open) == before


def test_deposit(tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("a\n1\n")
    root = tmp_path / "data"
    first = deposit_raw_csv(source, data_root=root)
    assert deposit_raw_csv(source, data_root=root) == deposit_raw_csv(first, data_root=root) == first
    source.write_text("a\n2\n")
    with pytest.raises(RawWritePermissionError):
        deposit_raw_csv(source, data_root=root)
    with pytest.raises(FileNotFoundError):
        deposit_raw_csv(tmp_path / "none.csv", data_root=root)
    assert is_under(first, root) and not is_under(source, root) and not is_under("\0", root)


def test_files_of_tables_that_are_folders_keep_apart(spark, tmp_path):
    from granary.plans import queries

    files = {"a.parquet": b"1", "b.parquet/part-0000.parquet": b"2", "c.parquet/part-0000.parquet": b"3"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = queries.file_sha256(spark, str(tmp_path)).collect()
    assert {r["file"]: r["sha256"] for r in found} == {n: hashlib.sha256(c).hexdigest() for n, c in files.items()} and len(found) == 3
