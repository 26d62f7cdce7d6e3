"""Line dedup by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage

#: Lines in a winnowing window: a repeated run of so many lines is always found.
RUN = 2
#: Characters from which on a single line is a run by itself: about a sentence of a dozen words.
LONG = 80


def _identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The text, the other columns as a struct, and what tells a document: its key and a hash of its text."""
    body = column_like(docs, text)
    rest = [column_like(docs, c) for c in docs.columns if c != text]
    return docs.select((F.struct(*rest) if rest else F.lit(None)).alias("_row"), body.alias("_text"), column_like(docs, key).alias("_key"), F.xxhash64(body).alias("_hash"))


def _windows(rows: DataFrame, run: int, long: int) -> DataFrame:
    """One row per window of ``run`` non-blank lines or of one long line: its place, line span, size, hash and winnowed anchor."""
    lines = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(F.xxhash64(F.trim(x)).alias("h"), i.alias("p"), F.length(F.trim(x)).alias("n")))
    full = rows.select("_key", "_hash", F.filter(lines, lambda x: x["n"] > 0).alias("_lines")).where("size(_lines) > 0")
    places = F.sequence(F.lit(0), F.size("_lines") - 1)

    def cut(chosen: Column, size: int) -> Column:
        return F.transform(chosen, lambda i: F.struct(i.alias("i"), F.slice("_lines", i + 1, size).alias("w")))

    found = cut(F.filter(places, lambda i: i <= F.size("_lines") - run), run)
    if run > 1:
        found = F.concat(found, cut(F.filter(places, lambda i: F.get(F.col("_lines"), i)["n"] >= long), 1))
    at = full.select("_key", "_hash", F.explode(found).alias("_f")).select("_key", "_hash", F.col("_f.i").alias("_i"), F.col("_f.w").alias("_w"))
    hashes = F.col("_w.h")
    least = F.array_min(hashes)
    return at.select("_key", "_hash", "_i", F.size("_w").alias("_size"), F.xxhash64(hashes).alias("_window"), least.alias("_anchor"),
                     (F.col("_i") + F.array_position(hashes, least) - 1).alias("_anchor_at"),
                     F.col("_w")[0]["p"].alias("_start"), (F.element_at("_w", -1)["p"] + 1).alias("_end"))


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Later repeated runs of lines: ``_key``, ``_hash`` (of the text), ``_start`` and ``_end`` (line numbers from 0).

    The least line hash of each window of ``run`` lines is its anchor, so equal windows have equal
    anchors at equal places: every repeated run of ``run`` lines or more holds an anchor that occurs at
    two positions or more.  Only such anchors go on.  Each is extended to the lines around it, by all
    windows that have it as their anchor; a window that occurred before, in the order (key, text hash,
    line) with NULL keys last, and does not overlap that first occurrence in its own document, is
    repeated, and overlapping repeated windows are one run.  A line of ``long`` characters or more is a window, and
    its own anchor, as well: it is a run without equal neighbours, so copies of one-line texts and paragraphs on one line are found.  Nothing is compared in pairs: positions meet by the minimum
    of a group, which is summed before the shuffle.

    Lines are compared, and measured, without spaces at their ends, and blank ones only count inside a run.  Rows equal in
    key and text are one document.  Texts that are NULL, empty or shorter than ``run`` lines, none of them long, have none.
    """
    rows = _identity(docs, key, text).select("_key", "_hash", "_text")
    windows = cut_lineage(_windows(rows, run, long), "line_windows")
    place = F.struct("_key", "_hash", "_anchor_at")
    positions = windows.groupBy("_anchor").agg(F.min(place).alias("_low"), F.max(place).alias("_high")).where("_low < _high").select("_anchor")
    # Both sides of these joins are stored tables, so a hot anchor or window can be split among tasks; they are merged at every size.
    found = cut_lineage(windows.join(cut_lineage(positions, "line_anchors").hint("merge"), "_anchor", "left_semi"), "anchored_windows")
    first = found.groupBy("_window").agg(F.min(F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_hash").alias("h"),
                                                        F.col("_i").alias("i"))).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    later = found.join(cut_lineage(first.drop("_times"), "first_windows").hint("merge"), "_window")
    same = F.col("_key").eqNullSafe(F.col("_first.k")) & (F.col("_hash") == F.col("_first.h"))
    later = later.where(~same | (F.col("_i") >= F.col("_first.i") + F.col("_size"))).select("_key", "_hash", "_i", "_size", "_start", "_end").distinct()
    doc = Window.partitionBy("_key", "_hash").orderBy("_i", "_size")
    covered = F.max(F.col("_i") + F.col("_size")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("_i") >= covered, F.lit(True)).cast("int")
    numbered = later.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_key", "_hash", "_run").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end")).drop("_run")


def _kept(lines: Column, runs: Column) -> Column:
    """Lines outside the runs: the slices between them, in one pass over the runs."""
    borders = F.concat(F.array(F.struct(F.lit(0).alias("_start"), F.lit(0).alias("_end"))), runs)
    parts = F.transform(borders, lambda r, i: F.slice(lines, r["_end"] + 1, F.coalesce(F.get(borders, i + 1)["_start"], F.size(lines)) - r["_end"]))
    return F.flatten(parts)


def remove_repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the runs of ``repeated_runs`` deleted from the text, and ``n_lines`` and ``removed_lines``.

    The first occurrence of a run stays.  No row goes: a text of which all is repeated becomes empty;
    NULL stays NULL with 0 lines.  An ``n_chars`` column follows the new text.  Input columns named as a
    result column are replaced.
    """
    runs = (repeated_runs(docs, run, long, key=key, text=text)
            .groupBy("_key", "_hash").agg(F.sort_array(F.collect_list(F.struct("_start", "_end"))).alias("_runs"))
            .withColumnRenamed("_key", "_k").withColumnRenamed("_hash", "_h"))
    rows = _identity(docs, key, text)
    joined = rows.join(runs.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    split = joined.withColumn("_lines", F.split("_text", "\n", -1))
    removed = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["_end"] - r["_start"])
    fresh = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(_kept(F.col("_lines"), F.col("_runs")), "\n"))
    out = split.withColumn("_fresh", fresh)
    names = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    changed = {text: F.col("_fresh"), "n_chars": F.length("_fresh").cast("long")}
    return out.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in names], F.coalesce(F.size("_lines"), F.lit(0)).alias("_lines_n"),
                      F.coalesce(removed, F.lit(0)).alias("removed_lines"), "_text") \
              .withColumn("n_lines", F.when(F.col("_text").isNull(), 0).otherwise(F.col("_lines_n"))).drop("_lines_n", "_text")


def oracle(run: int = RUN, long: int = LONG) -> str:
    """The same rows for DuckDB, from the lines themselves: a window is repeated if its lines occurred before."""
    parts = " || chr(10) || ".join(f"lead(l, {j}) OVER d" for j in range(1, run))
    alone = f"UNION ALL SELECT doc_id, i, 1 AS k, p AS s, p + 1 AS e, l AS win FROM x WHERE length(l) >= {long}" if run > 1 else ""
    return rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS p FROM t),
x AS (SELECT doc_id, trim(raw) AS l, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM p WHERE trim(raw) <> ''),
w AS (SELECT doc_id, i, {run} AS k, p AS s, lead(p, {run - 1}) OVER d + 1 AS e, l || chr(10) || {parts} AS win
  FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i) {alone}),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM w WHERE win IS NOT NULL
  WINDOW o AS (PARTITION BY win ORDER BY doc_id, i)),
r AS (SELECT DISTINCT doc_id, i, k, s, e FROM f WHERE doc_id <> fd OR i >= fi + k),
-- a line goes if the last repeated window that begins at it or before covers it, blank lines inside a run included
g AS (SELECT *, CASE WHEN i < max(i + k) OVER (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, k) AS run FROM g),
runs AS (SELECT doc_id, run, min(s) AS s, max(e) AS e FROM h GROUP BY ALL),
gone AS (SELECT doc_id, unnest(range(s, e)) AS p FROM runs),
kept AS (SELECT p.doc_id, count(*) - count(gone.p) AS n, count(gone.p) AS removed,
  coalesce(string_agg(CASE WHEN gone.p IS NULL THEN raw END, chr(10) ORDER BY p.p), '') AS body
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id)
SELECT t.doc_id, coalesce(k.n + k.removed, 0)::INTEGER AS n_lines, coalesce(k.removed, 0)::INTEGER AS removed_lines,
  CASE WHEN t.text IS NULL THEN NULL ELSE md5(coalesce(k.body, '')) END AS kept_md5
FROM t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
