import pytest

from tidymill.sources.reader import read_raw, read_rejected


def write(folder, files):
    for name, (text, encoding) in files.items():
        (folder / name).write_bytes(text.encode(encoding))
    return f"{folder}/*.csv"


FILES = {
    "a one.csv": ("id,name,note\n1,ann,x\n2,bob,y\n", "utf-8"),
    "b.csv": ("name,id\ncarl,3\ndora,4\n", "utf-8"),
    "c.csv": ("id;name;town\n5;\"e;f\";Köln\n6;gil;Bonn\n", "ISO-8859-1"),
    "d.csv": ("name,id\n\"two\nlines\",7\nover,8,many\nshort\n", "utf-8"),
    "e.csv": ("9,10\n11,12\n", "utf-8"),
    "f.csv": ("", "utf-8"),
    "g%+.csv": ("﻿id\tname\n13\tz\n", "utf-8"),
}
WANTED = {("1", "ann", "x", None, None, None), ("2", "bob", "y", None, None, None), ("3", "carl", None, None, None, None), ("4", "dora", None, None, None, None),
          ("5", "e;f", None, "Köln", None, None), ("6", "gil", None, "Bonn", None, None), ("7", "two\nlines", None, None, None, None), (None, "short", None, None, None, None),
          (None, None, None, None, "9", "10"), (None, None, None, None, "11", "12"), ("13", "z", None, None, None, None)}


def test_each_file_by_its_own_header(spark, tmp_path):
    path = write(tmp_path, FILES)
    got = read_raw(spark, path)
    assert got.columns == ["_rid", "id", "name", "note", "town", "col_0", "col_1"]
    rows = got.collect()
    assert {tuple(r)[1:] for r in rows} == WANTED and len(rows) == len(WANTED)
    rejected = read_rejected(spark, path).collect()
    assert [(r.line, r.file.endswith("d.csv")) for r in rejected] == [("over,8,many", True)]
    ids = [r[0] for r in rows] + [r[0] for r in rejected]
    assert len(set(ids)) == len(ids)
    order = [r.name for r in sorted(rows, key=lambda r: r[0]) if r.name]
    assert order == ["ann", "bob", "carl", "dora", "e;f", "gil", "two\nlines", "short", "z"]
    assert read_raw(spark, path).select("town").filter("town is not null").count() == 2


@pytest.mark.parametrize("size", ["64b", "1000b", "128m"])
def test_row_ids_do_not_follow_the_splits(spark, tmp_path, size):
    path = write(tmp_path, {f"{k}.csv": ("n,text\n" + "".join(f"{k * 1000 + i},{'w' * (i % 17)}\n" for i in range(300)), "utf-8") for k in range(3)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "8b")
        rows = read_raw(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r._rid: r.n for r in rows} == {(k << 40) + i: str(k * 1000 + i) for k in range(3) for i in range(300)}


def test_no_lines_at_all(spark, tmp_path):
    path = write(tmp_path, {"a.csv": ("", "utf-8")})
    assert read_raw(spark, path).count() == 0 and read_rejected(spark, path).count() == 0
