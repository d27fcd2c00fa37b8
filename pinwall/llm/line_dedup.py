"""Line dedup: windows of three consecutive lines that occur earlier in the corpus are removed, covered lines merged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common

WINDOW = 3


def _occurrences(docs: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """w (hash of the window's lines), at = (key, row key, position from 0): every window of every document."""
    lines = F.split(F.col(text), "\n", -1)
    rows = docs.select(F.col(key).alias("k"), common.row_key(key, text).alias("rk"), F.transform(lines, F.md5).alias("lines"))
    windows = F.when(
        F.size("lines") >= window,
        F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)), lambda i: F.md5(F.array_join(F.slice("lines", i, window), ""))),
    )
    # generators drop rows whose array is null: short and null texts have no windows
    spread = rows.select("k", "rk", F.posexplode(windows).alias("pos", "h"))
    return spread.select(F.unhex("h").alias("w"), F.struct("k", "rk", "pos").alias("at"))


def _cutter(window: int):
    @F.pandas_udf("n_lines long, n_removed long, kept_text string")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, starts):
            if t is None:
                out.append((0, 0, None))
                continue
            lines = t.split("\n")
            covered = {i for p in (s if s is not None else ()) for i in range(p, p + window)}
            kept = [x for i, x in enumerate(lines) if i not in covered] if covered else lines
            out.append((len(lines), len(covered), "\n".join(kept) if covered else t))
        return pd.DataFrame(out, columns=["n_lines", "n_removed", "kept_text"])

    # a filter on its result would have it computed twice
    return cut.asNondeterministic()


def line_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (a struct of all input columns), n_lines, n_removed, kept_text: one row for each input row.

    Lines end at LF. Of each window of `window` consecutive lines, the occurrence with the
    smallest (key, row key, position) stays; every line that a later occurrence covers goes.
    Windows are judged on the input. Null texts have no lines and stay null, an empty text is
    one empty line, texts of fewer lines than a window lose nothing. Rows equal in key and
    text are one occurrence and keep the same lines. Null keys sort first.

    Counts per window are summed before the shuffle. The join that finds later occurrences
    reads the repeated windows from a written table, so Spark can split a window that most
    documents hold; positions are gathered by document.
    """
    at = _occurrences(docs, text, key, window)
    first = common.written(at.groupBy("w").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = at.join(first.hint("merge"), "w").where(F.col("at") > F.col("first"))
    starts = common.written(later.groupBy(F.col("at.rk").alias("rk")).agg(F.collect_set("at.pos").alias("starts")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.row_key(key, text).alias("rk"))
    cut = _cutter(window)(F.col(f"row.`{text}`"), F.col("starts"))
    done = rows.join(starts.hint("merge"), "rk", "left").select("row", cut.alias("cut"))
    return done.select("row", "cut.n_lines", "cut.n_removed", "cut.kept_text")


def op1_line_dedup(spark, sf_dir):
    """Lines of `documents` that are not later occurrences of a three-line window."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "row.doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM d WHERE len(ls) >= 3),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos], ls[pos + 1], ls[pos + 2] ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM o WHERE nth > 1),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
             string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
