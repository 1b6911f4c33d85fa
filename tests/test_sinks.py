import random


from tidymill.sources.sinks import append_paged_audit, audit_page_of, page_files


def test_pages_against_the_whole_order(spark, tmp_path):
    path, rnd, want = str(tmp_path / "audit"), random.Random(3), []
    for job, at in ((1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, "2024-01-01 00:00:00"), (4, "2023-01-01 00:00:00")):
        rows = [(rnd.choice([None, *range(300)]), rnd.choice(["A-01", "B-02"]), rnd.choice("xyz"), None, str(k)) for k in range(rnd.choice([1, 250]))]
        append_paged_audit(spark.createDataFrame(rows, "_rid long, rule string, column string, old_value string, new_value string"), path, job, at)
        want += [(at, -1 if r[0] is None else r[0], r[2], r[1]) for r in rows]
    want.sort()
    for size in (1, 7, 100, 1000):
        for page in {0, 1, len(want) // size // 2, len(want) // size, len(want) // size + 3}:
            got = [(str(r.timestamp), -1 if r.row_index is None else r.row_index, r.column_name, r.formula_id) for r in audit_page_of(spark, path, page, size).collect()]
            assert got == want[page * size:(page + 1) * size], (page, size)


def test_a_page_reads_few_files():
    manifest = [(f"f{k:03d}", (k,), (k + 0.9,), 1000) for k in range(500)]
    files, skip = page_files(manifest, 12_345, 20)
    assert files == ["f246"] and skip == 900
    assert page_files(manifest, 49, 1001)[0] == ["f049", "f050"]
    assert page_files(manifest, 10 ** 9, 20) == ([], 0)
    overlapping = [("a", (0,), (5,), 10), ("b", (3,), (9,), 10), ("c", (10,), (11,), 10)]
    assert page_files(overlapping, 1, 10) == (["a", "b"], 10)
    assert page_files(overlapping, 2, 10) == (["c"], 0)
