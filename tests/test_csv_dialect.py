import csv
import io
import os

import pytest

from sluice.sources import csv_dialect as D


@pytest.mark.parametrize(("raw", "encoding"), [
    ("a,b\né,1\n".encode(), "utf-8"), ("a,b\né,1\n".encode("utf-8-sig"), "utf-8-sig"), ("a,b\n“é”,1\n".encode("cp1252"), "cp1252"), ("a;b\né;1\n".encode("utf-16"), "utf-16-le"),
    ("a,b\n日本,1\n".encode("shift_jis"), "undetermined"), (b"a,b\n\x81\x20,1\n", "undecodable"), (b"", "utf-8"),
])
def test_encodings(raw, encoding):
    assert D.encoding_of(raw)[0] == encoding


@pytest.mark.parametrize(("text", "want"), [
    ("a,b\n1,2\n3,4\n", (",", '"', 3, 2, "ok", "lf", "header")),
    ('a;b\n"x;y";2\n"l\n2";4\n', (";", '"', 3, 2, "ok", "lf", "header")),
    ("a\tb c\r\n1\td e\r\n2\tf g\r\n", ("\t", '"', 3, 2, "contested", "crlf", "header")),
    ("'a'|'b'\r'1'|'x|y'\r", ("|", "'", 2, 2, "ok", "cr", "header")),
    ("1,5;2,5\n3,5;4,5\n", (",", '"', 2, 3, "contested", "lf", "undetermined")),
    ("a,b\n1\n", (None, None, 0, 0, "undetermined", "lf", None)),
    ("2019,2020\n1,2\n", (",", '"', 2, 2, "ok", "lf", "undetermined")),
    ("x,y\r\n1,2\n", (",", '"', 2, 2, "ok", "mixed", "header")),
    ("a,b\n\n1,2\n\n", (",", '"', 2, 2, "ok", "lf", "header")),
])
def test_dialects(text, want):
    d = D.dialect_of(text.encode())
    assert (d["delimiter"], d["quote"], d["records"], d["fields"], d["status"], d["terminator"], d["header"]) == want


def test_files_of_many_dialects_read_back_equal(spark, tmp_path):
    rows = [(i, f"näme {i}" + ("; it's, \"so\"" if i % 3 == 0 else ""), i / 4) for i in range(60)]
    styles = [("utf-8", ",", '"', "\n", True), ("utf-8-sig", ";", '"', "\r\n", True), ("cp1252", "\t", '"', "\n", False), ("utf-16", "|", '"', "\n", True), ("utf-8", ";", "'", "\r", True), ("utf-8", ",", '"', "\r\n", False)]
    for k, (encoding, sep, quote, end, header) in enumerate(styles):
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=sep, quotechar=quote, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC)
        w.writerows(([("id", "name", "part")] if header else []) + rows[10 * k : 10 * k + 10])
        (tmp_path / f"f{k}.csv").write_bytes(out.getvalue().encode(encoding))
    found = {os.path.basename(r["path"]): r for r in D.dialects(spark, str(tmp_path), fallback="cp1252").collect()}
    assert [(found[f"f{k}.csv"]["delimiter"], found[f"f{k}.csv"]["quote"], found[f"f{k}.csv"]["header"] == "header") for k in range(6)] == [(s[1], s[2], s[4]) for s in styles]
    out = D.read_csv(spark, str(tmp_path), "id int, name string, part double", doubtful="preferred", fallback="cp1252")
    assert sorted(map(tuple, out.collect())) == rows


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,5;2,5\n3,5;4,5\n")
    with pytest.raises(ValueError, match="no dialect"):
        D.read_csv(spark, str(tmp_path), "a string, b string, c string")
    with pytest.raises(ValueError, match="no dialect"):
        D.read_csv(spark, str(tmp_path), "a string, b string", doubtful="preferred")
    assert D.read_csv(spark, str(tmp_path), "a string, b string, c string", doubtful="preferred").count() == 2
    with pytest.raises(Exception, match="too large"):
        D.dialects(spark, str(tmp_path), most_bytes=3).collect()


def test_files_without_rows_are_read_beside_the_others(spark, tmp_path):
    """A writer leaves a header alone, or nothing, for a partition without rows."""
    (tmp_path / "a.csv").write_text("id;name;part\n1;né;0.5\n2;b;1.5\n", encoding="cp1252")
    (tmp_path / "b.csv").write_text("id;name;part\n")
    (tmp_path / "c.csv").write_bytes("\ufeff".encode())
    found = {os.path.basename(r["path"]): (r["header"], r["basis"], r["status"]) for r in D.dialects(spark, str(tmp_path), "*.csv").collect()}
    assert found == {"a.csv": ("header", "text_over_nontext", "ok"), "b.csv": ("header", "other_files", "ok"), "c.csv": (None, None, "empty")}
    out = D.read_csv(spark, str(tmp_path), "id int, name string, part double", "*.csv")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "né", 0.5), (2, "b", 1.5)]


def test_csv_queries_over_tables_whose_first_split_has_no_rows(spark, tmp_path):
    from sluice.queries import loading

    rows = spark.range(40).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "id / 8D as c_acctbal", "'BUILDING' as c_mktsegment")
    home = str(tmp_path / "customer.parquet")
    rows.coalesce(1).write.option("compression", "none").parquet(home)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # Splits are smaller than the one row group, which belongs to the split of its middle.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.parquet(home).rdd.glom().map(len).first() == 0
        found = {(r["style"], r["delimiter"], r["encoding"], r["header"]) for r in loading.csv_dialects(spark, str(tmp_path)).collect()}
        assert found == {(0, ",", "utf-8", "header"), (1, ";", "cp1252", "header"), (2, "\t", "utf-16-be", "undetermined"), (3, "|", "utf-8", "header")}
        out = loading.csv_of_many_dialects(spark, str(tmp_path))
        assert sorted(r["c_custkey"] for r in out.collect()) == list(range(40))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
