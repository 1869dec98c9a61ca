"""References against targets: deleted, late, missing, and their notations."""

import datetime as dt

from lakeloom.operators import orphans

T = dt.datetime
CH = "id string, repo_name string, name string, module_path string, ingested_at timestamp_ntz, extra string"


def _tables(spark, chunks=(), large=(), notes=(), removed=()):
    return (
        spark.createDataFrame(list(chunks), CH),
        spark.createDataFrame(list(large), "id string, chunk_ids array<string>, ingested_at timestamp_ntz"),
        spark.createDataFrame(list(notes), "id string, repo_name string, related_symbols array<string>, related_files array<string>, created_at timestamp_ntz"),
        spark.createDataFrame(list(removed), "chunk_id string"),
    )


def _found(tables, share=500):
    return {tuple(r) for r in orphans.orphans(orphans.reference_parts(*tables), share).collect()}


CHUNKS = [
    ("A1", "r", "f", "src/a.py", T(2025, 1, 1), "x"),
    ("A1", "r", "f", "src/a.py", T(2025, 3, 1), "x"),
    ("b2", "r", "g", "src/b.py", T(2025, 5, 1), "x"),
    ("gone", "r", "h", "src/h.py", T(2025, 1, 1), "x"),
]


def test_all_kinds(spark):
    large = [("L1", ["a1", " A1 ", "b2", "GONE", "nope", None, " "], T(2025, 2, 1)), ("L1", ["a1", " A1 ", "b2", "GONE", "nope", None, " "], T(2025, 2, 1)), ("L2", [], T(2025, 2, 1)), ("L3", None, T(2025, 2, 1))]
    notes = [("N1", "r", [" f()", "src/a::f", "lib::f", "g", "h", "a::b::zz"], ["./src/a.py:12", "src\\a.py", "src/a.py#L3", "src/h.py", "src/b.py"], T(2025, 2, 2))]
    for share in (500, 1):  # with and without heavy keys
        got = _found(_tables(spark, CHUNKS, large, notes, [("Gone",), (None,)]), share)
        assert got == {
            ("large_chunks", "L1", "chunk_ids", "b2", "2025-02"), ("large_chunks", "L1", "chunk_ids", "GONE", "2025-02"), ("large_chunks", "L1", "chunk_ids", "nope", "2025-02"),
            ("notes", "N1", "related_symbols", "lib::f", "2025-02"), ("notes", "N1", "related_symbols", "g", "2025-02"), ("notes", "N1", "related_symbols", "h", "2025-02"), ("notes", "N1", "related_symbols", "a::b::zz", "2025-02"),
            ("notes", "N1", "related_files", "src/h.py", "2025-02"), ("notes", "N1", "related_files", "src/b.py", "2025-02"),
        }


def test_heavy_key_keeps_all_references(spark):
    large = [(f"L{i}", ["missing"] if i % 3 else ["a1"], T(2025, 2, 1)) for i in range(60)]
    got = _found(_tables(spark, CHUNKS, large), 10)
    assert len(got) == 40 and all(r[3] == "missing" for r in got)


def test_empty_tables(spark):
    assert _found(_tables(spark)) == set()
    assert orphans.orphan_report(orphans.reference_parts(*_tables(spark))).count() == 0


def test_counts_come_from_groups(spark):
    """Groups with and without targets, one with a target in the middle of the month, and one without a time."""
    large = [(f"L{i}", ["b2"], T(2025, 5, 1 + i)) for i in range(-0, 9)] + [(f"M{i}", ["missing", "a1"], T(2025, 2, 1)) for i in range(5)] + [("N", ["a1"], None), ("E", ["b2"], T(2025, 4, 30))]
    chunks = [*CHUNKS, ("b2", "r", "g", "src/b.py", T(2025, 5, 6), "x")][:2] + [("b2", "r", "g", "src/b.py", T(2025, 5, 4), "x")]
    tables = _tables(spark, chunks, large)
    for share in (500, 3, 1):
        parts = orphans.reference_parts(*tables)
        rows = {tuple(r) for r in orphans.orphans(parts, share).collect()}
        got = {(r["source_table"], r["ref_field"], r["period"]): (r["n_orphans"], r["n_sources"]) for r in orphans.orphan_report(parts, share).collect()}
        assert got == {("large_chunks", "chunk_ids", "2025-05"): (3, 3), ("large_chunks", "chunk_ids", "2025-04"): (1, 1), ("large_chunks", "chunk_ids", "2025-02"): (5, 5), ("large_chunks", "chunk_ids", None): (1, 1)}
        assert len(rows) == 10


def test_popular_name_in_parts(spark, monkeypatch):
    monkeypatch.setattr(orphans, "NAME_PART", 2)
    chunks = [(f"c{i}", "r", "new", f"src/m{i}.rs", T(2025, 1, 1), "x") for i in range(9)]
    notes = [(f"N{i}", "r", [f"m{i}::new"], None, T(2025, 2, 2)) for i in range(12)]
    assert {r[1] for r in _found(_tables(spark, chunks, notes=notes))} == {"N9", "N10", "N11"}
