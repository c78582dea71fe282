"""Substring dedup: repeated windows of ``WINDOW`` words, by runs of windows around token k-mers.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, unchanged. A word goes if a window of ``WINDOW`` words that covers it
also starts earlier (smaller id, or same document and earlier start); windows are judged on the input.

Method. The dealt one is the compaction of a De Bruijn graph: every token k-mer an edge, degrees of its nodes, nonbranching paths grown
by joins. It was measured and is not affordable here (the README has the figures: 26 times the input is shuffled where 4 are allowed), so
minimizers, by which such graphs are partitioned, stand in for its edges, and runs for its paths. Each window carries one k-mer
(``KMER`` words), its minimizer; a maximal run of windows of a document with one minimizer is one row, keyed by (k-mer, hash of where
the run lies around it and of all its words). Joins on the k-mer compact over documents. A k-mer met once has no repeated window
and goes at once. Of equal runs the first by (id, start) stays, and the windows of the others repeat as a whole. If a k-mer has
different runs, the text branches there: the first run of each kind is read at its source coordinates, and its windows are
verified one by one against those of the other kinds.

The minimizer is the rarest k-mer of its window, by counts of hashed k-mers over all documents (a table of a fixed size), and of equally
rare ones that of the smallest hash. So a phrase that very many documents have in different surroundings is the key of few
windows, and no key holds a share of all rows. The counts decide what goes where, not what is found.

Equal windows have the same minimizer, so nothing is lost; hashes that are compared have 128 bits together (k-mer and run, k-mer and
window). Shuffled: one row for about 7 words, and the texts once, for both uses. Equal runs of one chunk of texts are combined before the
shuffle, so a passage that a third of all documents share sends one row a chunk to its k-mers; its other occurrences are done
and go anywhere. So do equal windows of branching runs, which are dealt by their own hash.

Defined results: null text has no words; fewer than ``WINDOW`` words have no window; null ids sort first; rows that share id and text share
one result; texts that share an id only are ordered by start alone; an id that is no whole number fails; further columns may bear any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.common import Keyed, WordHash, chunks, combined, id_of, mix, span, table, unused, written

WINDOW, KMER = 20, 6
#: Bits of the hash that counts of k-mers go by.
COUNT_BITS = 16
_U = np.uint64
_BASE, _SEED = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hashed:
    """Polynomial hashes of any run of words of an array of word hashes."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]))[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _SEED) * up)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words [a, b), which depends on the words alone."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _SEED)


def _counts(slim: DataFrame) -> np.ndarray:
    """The size class (binary logarithm) of how often k-mers of the documents fall on each value of ``COUNT_BITS`` bits of their hash."""
    mask = (1 << COUNT_BITS) - 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHash(), np.zeros(mask + 1, np.int64)
        for batch in batches:
            for _, raw in chunks(x.as_py() for x in batch.column(0)):
                # k-mers across two texts only blur the counts
                h = words.of(b" ".join(raw).split())
                if len(h) >= KMER:
                    at = np.arange(len(h) - KMER + 1)
                    total += np.bincount((Hashed(h).of(at, at + KMER) & _U(mask)).astype(np.int64), minlength=mask + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(mask + 1, np.int64)
    for r in slim.select("_t").mapInArrow(go, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return np.log2(out + 1).astype(np.uint64)


def runs(h: np.ndarray, lengths: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For the joined word hashes of several texts: (k-mer hash, text, start, windows, hash of the run) of each run. ``classes`` has the
    size class of k-mers by the lowest bits of their hash."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    if len(h) < WINDOW:
        return none
    hashed = Hashed(h)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(h) - KMER + 1)
    kmer = hashed.of(at, at + KMER)
    windows = np.flatnonzero(np.arange(len(h)) + WINDOW <= ends[text])
    if not len(windows):
        return none
    span = WINDOW - KMER + 1
    order = kmer if classes is None else (classes[(kmer & _U(len(classes) - 1)).astype(np.int64)] << _U(58)) | (kmer >> _U(6))
    least = windows + np.lib.stride_tricks.sliding_window_view(order, span)[windows].argmin(1)
    new = np.ones(len(windows), bool)
    new[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    start, pos = windows[first], least[first]
    run = hashed.of(start, start + count + WINDOW - 1)
    run = mix(run + (pos - start).astype(np.uint64) * _BASE)
    begin = ends - lengths
    return kmer[pos], text[start], start - begin[text[start]], count, run


def _runs(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(_k, _h, kmer, start, n, run, done) of each text, from (_t, _k, _h); done: an equal run of the same chunk comes first."""

    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHash(), sent.value
        for batch in batches:
            k, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, raw in chunks(x.as_py() for x in batch.column(0)):
                split = [r.split() for r in raw]
                lengths = np.array([len(s) for s in split])
                flat = np.concatenate([words.of(s) for s in split]) if len(split) else np.zeros(0, np.uint64)
                kmer, text, start, n, run = runs(flat, lengths, own)
                text = text + first
                order, done, kmer = combined(kmer.view(np.int64), run, k[text], start)
                text, start, n, run = (x[order] for x in (text, start, n, run))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[text]), pa.array(h[text]), pa.array(kmer), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.where(done, _U(0), run).view(np.int64)), pa.array(done)],
                    names=["_k", "_h", "kmer", "start", "n", "run", "done"],
                )

    return docs.mapInArrow(go, "_k long, _h long, kmer long, start int, n int, run long, done boolean")


def _windows(spans: DataFrame) -> DataFrame:
    """(kmer, w, _k, _h, start, done) of each window of the runs, from (text, _k, _h, runs: array of (kmer, start, n))."""
    names = ["kmer", "w", "_k", "_h", "start", "done"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kmer, w, k, h, start = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, done, kmer = combined(kmer, w, k, start)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (kmer, w[order], k[order], h[order], start[order].astype(np.int32), done)], names=names)

        for batch in batches:
            for text, k, h, own in zip(*batch.columns, strict=True):
                hashed = Hashed(words.of((text.as_py() or "").encode().split()))
                rows = own.as_py()
                n = np.array([r["n"] for r in rows])
                at = np.repeat(np.array([r["start"] for r in rows]) - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                kmer = np.repeat(np.array([r["kmer"] for r in rows], np.int64), n)
                held.append((kmer, hashed.of(at, at + WINDOW).view(np.int64), np.full(len(at), k.as_py(), np.int64), np.full(len(at), h.as_py(), np.int64), at))
                size += len(at)
                if size > 200_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return spans.mapInArrow(go, "kmer long, w long, _k long, _h long, start int, done boolean")


def repeated_spans(slim: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, spans): the word spans (not merged) that repeat what comes earlier, from (_t, _k, _h)."""
    # one exchange by k-mer serves all windows below: the finer ones need no other
    whole, equal = Window.partitionBy("kmer", "done"), Window.partitionBy("kmer", "done", "run")
    met = _runs(slim, _counts(slim)).repartition("kmer").withColumns({"c": F.count("*").over(whole), "low": F.min("run").over(whole), "high": F.max("run").over(whole)}).where("done or c > 1")
    met = met.withColumn("first", F.min(F.struct("_k", "start")).over(equal))
    later, branches = F.col("done") | (F.struct("_k", "start") > F.col("first")), ~F.col("done") & (F.col("low") != F.col("high"))
    found = written(met.where(later | branches).select(*keys, "start", "n", later.alias("later"), F.when(~later, F.col("kmer")).alias("kmer")))
    plain = found.where("later").select(*keys, span(F.col("start"), F.col("n") + F.lit(WINDOW - 1)).alias("s"))
    # the first run of each kind at a k-mer that branches is read at its source, and each of its windows looks for an earlier start
    sources = found.where("not later").groupBy(*keys).agg(F.collect_set(F.struct("kmer", "start", "n")).alias("runs"))
    read = slim.select("_t", *keys).join(sources, keys).select("_t", "_k", (F.col("_h") if "_h" in keys else F.lit(0).cast("long")).alias("_h"), "runs")
    first = F.min(F.struct("_k", "start")).over(Window.partitionBy("kmer", "w", "done"))
    each = _windows(read).repartition("kmer", "w").withColumn("first", first)
    branching = each.where(F.col("done") | (F.struct("_k", "start") > F.col("first"))).select(*keys, span(F.col("start"), F.lit(WINDOW)).alias("s"))
    return plain.unionByName(branching).groupBy(*keys).agg(F.collect_set("s").alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_words", counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, in ``out_col``, and the ``counts``."""
    names = [out_col, *counts]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    keyed = Keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed.slim, keyed.keys)
    # an id of this type comes back from its key, so the exchange of ids and texts is the one that the sources used
    same = {id_col: id_of(keyed.k)} if docs.schema[id_col].dataType.typeName() == "long" else {}
    name = unused(keyed.docs.columns, "_spans")[0]
    both = keyed.with_spans(spans, name, same)
    where, out_names = docs.columns.index(text_col), [*docs.columns, *names]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for text, own in zip(batch.column(where), batch.column(batch.num_columns - 1), strict=True):
                    rows.append(cut((text.as_py() or "").encode().split(), [(s >> 32, (s >> 32) + (s & 0xFFFFFFFF)) for s in own.as_py() or []]))
                kept, n, gone = zip(*rows, strict=True) if rows else ((),) * 3
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=out_names)

    return both.mapInArrow(go, docs.withColumns({out_col: F.lit(None).cast("string"), counts[0]: F.lit(None).cast("long"), counts[1]: F.lit(None).cast("long")}).schema)


def cut(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(words outside the spans joined by one space, number of words, number that went)"""
    if not spans:
        return b" ".join(words).decode(), len(words), 0
    change = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    stays = np.cumsum(change[:-1]) == 0
    left = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(left).decode(), len(words), len(words) - len(left)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what stays, of every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    """The same by a table of all windows, for tests."""
    key = lambda d: -(1 << 63) if d is None else d
    split = [(key(d), (t or "").encode().split()) for d, t in docs]
    first: dict[tuple, tuple[int, int]] = {}
    for d, w in split:
        for i in range(len(w) - WINDOW + 1):
            own = tuple(w[i : i + WINDOW])
            first[own] = min(first.get(own, (1 << 62, 0)), (d, i))
    out = []
    for d, w in split:
        spans = [(i, i + WINDOW) for i in range(len(w) - WINDOW + 1) if first[tuple(w[i : i + WINDOW])] < (d, i)]
        kept, n, gone = cut(w, spans)
        out.append((n, gone, hashlib.sha256(kept.encode()).hexdigest()))
    return out


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT win, min(struct_pack(k := doc_id, s := i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM w JOIN f USING (win) WHERE struct_pack(k := doc_id, s := i) > first),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM d),
kept AS (
  SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (g.p IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
