"""Line dedup: repeated windows of three consecutive lines, removed everywhere but where they come first.

Method: a text's lines are its \\n-split parts, and only those that hold more than spaces, tabs, \\r, \\f and \\v count (the
others stay where they are unless they lie inside a removed window). Every three consecutive counted lines are a window, keyed by
128 bits of the hash of its lines, trimmed of those characters. A window that also starts earlier (smaller id, or same document and
earlier line) is repeated; the covered positions of a document's repeated windows are merged, and those lines go.

Windows are judged on the input. Equal windows of one batch of texts are combined before the shuffle: only the first goes to its
key, the others are done and dealt at random, so a window of a third of all documents is no hot key. Shuffled: a row for
each line, and the texts once, to meet their spans.

Defined results: null text has no lines and stays null; fewer than three counted lines have no
window; a null id sorts first; rows that share id and text share one result, and do not make
each other's windows repeated; texts that share an id only are ordered by start alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.common import Keyed, combined, span, table, unused

WINDOW = 3
_BLANK = " \t\r\f\x0b"
#: Windows that are combined at a time.
_CHUNK = 200_000


def windows(text: str | None, size: int = WINDOW) -> list[tuple[int, int, int]]:
    """(128-bit hash, first line, line behind the last) of each window."""
    if not text:
        return []
    own = [(i, t) for i, x in enumerate(text.split("\n")) if (t := x.strip(_BLANK))]
    return [(xxhash.xxh3_128_intdigest("\n".join([t for _, t in own[i : i + size]])), own[i][0], own[i + size - 1][0] + 1) for i in range(len(own) - size + 1)]


def _windows(slim: DataFrame, size: int) -> DataFrame:
    names = ["_k", "_h", "w1", "w2", "a", "n", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            k, h, w1, w2, a, n = (np.array(c, t) for c, t in zip(zip(*held, strict=True), (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64), strict=True))
            held.clear()
            order, done, w1 = combined(w1.view(np.int64), w2.view(np.int64), k, a)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[order], h[order], w1, w2.view(np.int64)[order], a[order].astype(np.int32), n[order].astype(np.int32), done)], names=names)

        for batch in batches:
            for text, k, h in zip(*batch.columns, strict=True):
                k, h = k.as_py(), h.as_py()
                held += [(k, h, w >> 64, w & 0xFFFFFFFFFFFFFFFF, a, b - a) for w, a, b in windows(text.as_py(), size)]
                if len(held) >= _CHUNK:
                    yield flush()
        if held:
            yield flush()

    return slim.mapInArrow(run, "_k long, _h long, w1 long, w2 long, a int, n int, done boolean")


def repeated_lines(slim: DataFrame, keys: list[str], size: int = WINDOW) -> DataFrame:
    """(*keys, spans): the line spans (not merged) of repeated windows, from (_t, _k, _h)."""
    first = F.min(F.struct("_k", "a")).over(Window.partitionBy("w1", "w2", "done"))
    later = _windows(slim, size).withColumn("first", first).where(F.col("done") | (F.struct("_k", "a") > F.col("first")))
    return later.select(*keys, span(F.col("a"), F.col("n")).alias("s")).groupBy(*keys).agg(F.collect_set("s").alias("spans"))


def without(text: str | None, spans: list[int]) -> tuple[str | None, int]:
    """(the lines outside the spans, number of lines that went)"""
    if not text or not spans:
        return text, 0
    own = text.split("\n")
    change = np.zeros(len(own) + 1, np.int64)
    for s in spans:
        change[s >> 32] += 1
        change[(s >> 32) + (s & 0xFFFFFFFF)] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return "\n".join([own[i] for i in np.flatnonzero(stays).tolist()]), int((~stays).sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """``docs`` with the lines of repeated windows gone from ``text_col``; ``removed_col`` gets their number."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != (removed_col or "").lower()])
    keyed = Keyed(docs, id_col, text_col)
    name = unused(keyed.docs.columns, "_spans")[0]
    both = keyed.with_spans(repeated_lines(keyed.slim, keyed.keys, size), name)
    where, names = docs.columns.index(text_col), [*docs.columns, *([removed_col] if removed_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [without(t.as_py(), s.as_py()) for t, s in zip(batch.column(where), batch.column(batch.num_columns - 1), strict=True)]
                cols = list(batch.columns[:-1])
                cols[where] = pa.array([t for t, _ in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([n for _, n in rows], pa.int64())] if removed_col else [])], names=names)

    return both.mapInArrow(run, (docs.withColumn(removed_col, F.lit(None).cast("long")) if removed_col else docs).schema)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the digest of what stays, of every document (a null text is empty)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_removed")
    # a text of which every line went is empty: it has no line
    left = F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("n_removed") > 0)), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), (left + F.col("n_removed")).cast("long").alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS pos FROM d),
c AS (SELECT r, doc_id, pos, trim(line, E' \t\r\f\v') AS line FROM l WHERE trim(line, E' \t\r\f\v') <> ''),
w AS (
  SELECT r, doc_id, pos AS a, lead(pos, 2) OVER o AS z, struct_pack(x := line, y := lead(line) OVER o, z := lead(line, 2) OVER o) AS win
  FROM c WINDOW o AS (PARTITION BY r ORDER BY pos)
),
f AS (SELECT win, min(struct_pack(k := doc_id, a := a)) AS first FROM w WHERE z IS NOT NULL GROUP BY win),
later AS (SELECT r, a, z FROM w JOIN f USING (win) WHERE z IS NOT NULL AND struct_pack(k := doc_id, a := a) > first),
gone AS (SELECT DISTINCT r, unnest(generate_series(a, z)) AS pos FROM later),
kept AS (SELECT r, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text FROM l LEFT JOIN gone g USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
