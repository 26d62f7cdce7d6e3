import random

import pytest
from panelspark.llm import lines
from tests.llm.data import SCHEMA, awkward, frame, multiset


def brute(rows, run, long=lines.LONG):
    """Text of each distinct (key, text) without the later repeated windows of ``run`` lines or of one long line."""
    import xxhash

    order = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63))
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=order)
    first, kept = {}, {(r[0], None): (None, 0, 0) for r in rows if r[1] is None}
    for d, (key, text) in enumerate(docs):
        all_lines = text.split("\n")
        full = [(p, x.strip(" ")) for p, x in enumerate(all_lines) if x.strip(" ")]
        later = []
        windows = [(i, run) for i in range(len(full) - run + 1)] + [(i, 1) for i, (_, x) in enumerate(full) if run > 1 and len(x) >= long]
        for i, k in sorted(windows):
            window = tuple(x for _, x in full[i:i + k])
            fd, fi = first.setdefault(window, (d, i))
            if fd != d or i >= fi + k:
                later.append((i, k))
        gone, start, covered = set(), None, 0
        for i, k in later:
            if start is None or i >= covered:
                start, covered = i, i
            covered = max(covered, i + k)
            gone |= set(range(full[start][0], full[covered - 1][0] + 1))
        kept[key, text] = ("\n".join(x for p, x in enumerate(all_lines) if p not in gone), len(all_lines), len(gone))
    return kept


@pytest.mark.parametrize("run", [1, 2, 3])
def test_equals_brute_force(spark, run):
    rng = random.Random(run)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))), "en", "s", 0) for i in range(50)]
    rows += awkward() + [(900, "a\na\na\na\na", "en", "s", 0), (901, "b\n\nb\nb\n \nb", "en", "s", 0), (902, "\n".join(pool * 300), "en", "s", 0)]
    want = brute(rows, run, 7)
    got = lines.remove_repeated_runs(frame(spark, rows, extra=True), run, 7).select("doc_id", "text", "n_lines", "removed_lines", "n_chars").collect()
    expected = [(r[0], *want[r[0], r[1]], None if r[1] is None else len(want[r[0], r[1]][0])) for r in rows]
    assert multiset(map(tuple, got)) == multiset(expected)


def test_first_copy_stays_and_columns_stay(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(2, text, "en", "s", 13), (1, "x\n" + text + "\ny", "en", "s", 1)], SCHEMA)
    out = {r["doc_id"]: r for r in lines.remove_repeated_runs(docs).collect()}
    assert out[1]["text"] == "x\none\ntwo\nthree\ny" and out[2]["text"] == "" and out[2]["n_chars"] == 0 and out[2]["removed_lines"] == 3


def test_long_single_lines_go(spark):
    """A long line between different neighbours, and later copies of a text that is one long line."""
    long, short = " ".join(f"word{i}" for i in range(80)), "a short line"
    rows = [(1, long), (2, f"x\n{long} \ny"), (3, long), (4, f"{short}\nz"), (5, f"{short}\nv"), (6, f"{long}\n{long}\nw")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in lines.remove_repeated_runs(docs).collect()}
    assert out == {1: long, 2: "x\ny", 3: "", 4: f"{short}\nz", 5: f"{short}\nv", 6: "w"}


def test_oracle_agrees_on_mixed_windows(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    pool = [f"line {i}" for i in range(12)] + ["", "  "] + [f"line number {i} of the longer kind" for i in range(5)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))), "en", "s", 0) for i in range(80)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = {r[0]: r[3] for r in con.execute("SELECT doc_id, n_lines, removed_lines, kept_md5 FROM (" + lines.oracle(2, 20) + ")").fetchall()}
    got = lines.remove_repeated_runs(docs, 2, 20).selectExpr("doc_id", "md5(text) AS m").collect()
    assert {r["doc_id"]: r["m"] for r in got} == want


def test_empty(spark):
    assert lines.remove_repeated_runs(frame(spark, [])).count() == 0
