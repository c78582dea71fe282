"""Benchmark decontamination: which words of which documents lie in benchmark windows.

Method: prefix-filtered set join. A window's tokens are its 3-word shingles (shorter windows:
the whole). Shingles are ordered by rarity, that is by how often they occur in all documents;
since containment is exact, the prefix that must match is the rarest shingle alone. Documents
meet windows on those prefix shingles, length and positional bounds (the window must lie inside
the document at the offset of the shingle) drop what cannot match, and every candidate is
verified word by word.

The size of the benchmark is measured first. Up to ``BLOCK_BYTES`` its windows are broadcast, and all documents pass
them: two reads of the documents, no shuffle. Beyond, windows and documents meet in Spark joins, on the hash of the prefix
shingle (see ``_joined``): four reads of the documents, whatever the size. What is broadcast then are counts of hashed
shingles and a bitmap of the prefixes, both of a fixed size. Rarity comes from those counts; it decides what a candidate costs, not
what is found.

Words: A-Z lower-cased, then runs of bytes that are 0-9, a-z or beyond ASCII. Defined results:
null or wordless texts have no words and are not contaminated; items without words have no
window; items of fewer than ``window`` words are one window, items of any length are whole; repeated rows each get a row;
null item ids mark words but are not listed; columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import WordHash, mix, table, unused, written

WINDOW, SHINGLE, BLOCK_BYTES = 13, 3, 4 << 20
#: Bits of the hash that counts of shingles and the bitmap of prefixes go by.
COUNT_BITS, MAP_BITS = 16, 26
_U = np.uint64
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


class Windows:
    """The distinct windows of a block of items, with the items that each occurs in."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ws = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                own = found.setdefault(tuple(ws[i : i + window]), set())
                if item is not None:
                    own.add(str(item))
        self.base = len(self.ids) + 1
        self.size = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for k, w in enumerate(found):
            self.words[k, : len(w)] = w
        self.items = [sorted(x) for x in found.values()]
        #: shingle size -> sorted distinct shingles of the windows that use that size
        self.shingles: dict[int, np.ndarray] = {}
        for s in range(1, SHINGLE + 1):
            if len(at := self._using(s)):
                self.shingles[s] = np.unique(np.concatenate([self.keys(self.words[k, : self.size[k]], s) for k in at]))
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def _using(self, s: int) -> np.ndarray:
        return np.flatnonzero(np.minimum(self.size, SHINGLE) == s)

    def keys(self, ids: np.ndarray, s: int) -> np.ndarray:
        """One number for each s-word shingle; -1 where a word is not in the block."""
        n = len(ids) - s + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = ids[:n].copy(), ids[:n] >= 0
        for k in range(1, s):
            key = key * self.base + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        key[~known] = -1
        return key

    def of(self, text: str | None) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def meets(self, ids: np.ndarray, s: int, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions whose shingle is in the sorted table, its number there)"""
        key = self.keys(ids, s)
        at = np.minimum(np.searchsorted(table_, key), len(table_) - 1)
        pos = np.flatnonzero(table_[at] == key) if len(key) else np.zeros(0, np.int64)
        return pos, at[pos]

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Take the rarest shingle of each window as its prefix; the earliest of equals."""
        for s, known in self.shingles.items():
            rows = []
            for k in self._using(s):
                keys = np.searchsorted(known, self.keys(self.words[k, : self.size[k]], s))
                p = min(range(len(keys)), key=lambda i: (counts.get((s, int(keys[i])), 0), i))
                rows.append((int(known[keys[p]]), int(k), p))
            rows.sort()
            key, win, off = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            uniq, first, n = np.unique(key, return_index=True, return_counts=True)
            self.prefix[s] = (uniq, first, n, win, off)

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, starts) that occur in a document."""
        wins, starts = [], []
        for s, (uniq, first, n, win, off) in self.prefix.items():
            pos, at = self.meets(ids, s, uniq)
            for lo in range(0, len(pos), 20_000):
                p, a = pos[lo : lo + 20_000], at[lo : lo + 20_000]
                many = n[a]
                row = np.repeat(first[a] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                w, start = win[row], np.repeat(p, many) - off[row]
                fits = (start >= 0) & (start + self.size[w] <= len(ids))
                w, start = w[fits], start[fits]
                for k in range(self.words.shape[1]):
                    inside = k < self.size[w]
                    same = ~inside | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[w, k])
                    w, start = w[same], start[same]
                wins.append(w)
                starts.append(start)
        return (np.concatenate(wins), np.concatenate(starts)) if wins else (np.zeros(0, np.int64),) * 2


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Merged [start, end) spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _counted(texts: DataFrame, sent) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents; summed before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total = {s: np.zeros(len(t), np.int64) for s, t in w.shingles.items()}
        for batch in batches:
            for text in batch.column(0):
                ids = w.of(text.as_py())
                for s, known in w.shingles.items():
                    total[s] += np.bincount(w.meets(ids, s, known)[1], minlength=len(known))
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], names=["s", "k", "n"])

    rows = texts.mapInArrow(run, "s int, k int, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).collect()
    return {(r.s, r.k): r.n for r in rows}


def _scanned(docs: DataFrame, text_col: str, sent, out_col: str) -> DataFrame:
    where = docs.columns.index(text_col)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(where):
                ids = w.of(text.as_py())
                win, start = w.match(ids)
                spans = [{"a": a, "b": b} for a, b in spans_of(start, start + w.size[win])]
                rows.append({"n_words": len(ids), "spans": spans, "items": sorted({i for k in np.unique(win) for i in w.items[k]})})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(None).cast("struct<n_words: bigint, spans: array<struct<a: bigint, b: bigint>>, items: array<string>>")).schema)


def covered(spans: Column) -> Column:
    """Words inside any of the [a, b) spans."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(zero, x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
        lambda acc: acc["n"],
    )


def _hashes(h: np.ndarray, s: int) -> np.ndarray:
    """One number for each s-word shingle of word hashes."""
    n = len(h) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, s, np.uint64)
    for j in range(s):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : n + j])
    return out.view(np.int64)


def _digest(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(raw)
    return (d >> 64) - (1 << 63), (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(w1, w2, words, item) of each window of each item."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                item, ws = batch.column(0)[k].as_py(), words_of(batch.column(1)[k].as_py())
                for lo in range(0, max(1, len(ws) - window + 1) if ws else 0, 20_000):
                    raw = [b" ".join(ws[i : i + window]) for i in range(lo, min(lo + 20_000, max(1, len(ws) - window + 1)))]
                    a, b = zip(*map(_digest, raw), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(raw, pa.binary()), pa.array([item] * len(raw), pa.string())], schema=schema)

    return items.mapInArrow(run, "w1 long, w2 long, words binary, item string")


def _shingle_counts(texts: DataFrame, sizes: list[int]) -> np.ndarray:
    """How often shingles of the documents fall on each value of ``COUNT_BITS`` bits of their hash."""
    mask = (1 << COUNT_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHash(), np.zeros(mask + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                h = words.of(words_of(text.as_py()))
                for s in sizes:
                    total += np.bincount(_hashes(h, s) & mask, minlength=mask + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(mask + 1)), pa.array(total)], names=["at", "n"])

    out = np.zeros(mask + 1, np.int64)
    for r in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _prefixes(windows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, off, w1, w2, words): each window with its rarest shingle and the shingle's offset."""
    mask = (1 << COUNT_BITS) - 1
    sent = windows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHash(), sent.value
        for batch in batches:
            keys, offs = [], []
            for raw in batch.column(2):
                ws = raw.as_py().split()
                h = _hashes(words.of(ws), min(SHINGLE, len(ws)))
                off = int(np.argmin(own[h & mask]))
                keys.append(int(h[off]))
                offs.append(off)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(offs, pa.int32()), *batch.columns], names=["key", "off", "w1", "w2", "words"])

    return windows.mapInArrow(run, "key long, off int, w1 long, w2 long, words binary")


def _bitmap(prefixes: DataFrame) -> np.ndarray:
    """``MAP_BITS`` bits of the prefixes' hashes, as a bitmap; false hits only cost a row."""
    at = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    rows = prefixes.select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _meeting(texts: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(key, t1, t2, pos) of each shingle of the documents that may be a prefix; equal texts are one."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)
    mask = (1 << MAP_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHash(), sent.value
        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py()
                h = words.of(words_of(raw))
                for s in sizes:
                    key = _hashes(h, s)
                    at = np.flatnonzero((own[(key & mask) >> 6] >> (key & 63)) & 1)
                    if len(at):
                        a, b = _digest(raw.encode())
                        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.full(len(at), a)), pa.array(np.full(len(at), b)), pa.array(at.astype(np.int32))], names=["key", "t1", "t2", "pos"])

    return texts.mapInArrow(run, "key long, t1 long, t2 long, pos int").distinct()


def _digests(texts: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``texts`` with the two halves of the hash of their text; null texts have none."""
    where, columns = texts.columns.index(text_col), texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_digest(t.encode()) if (t := x.as_py()) is not None else (None, None) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([b[i] for b in both], pa.int64()) for i in (0, 1))], names=[*columns, *names])

    return texts.mapInArrow(run, texts.withColumns({n: F.lit(None).cast("long") for n in names}).schema)


def _verified(rows: DataFrame) -> DataFrame:
    """(t1, t2, a, b, w1, w2) of the candidates that are in the text word by word, from (t1, t2, text, own: array of (start, words, w1, w2))."""
    names = ["t1", "t2", "a", "b", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t1, t2, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = words_of(text)
                for c in own:
                    w, a = c["words"].split(), c["start"]
                    if a >= 0 and ws[a : a + len(w)] == w:
                        found.append((t1, t2, a, a + len(w), c["w1"], c["w2"]))
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, out_col: str) -> DataFrame:
    """``docs`` with what they have of a benchmark of any size: windows and documents meet on their prefix shingles."""
    spark = docs.sparkSession
    every = written(_item_windows(items, window))
    distinct = every.groupBy("w1", "w2").agg(F.first("words").alias("words"))
    longest = every.agg(F.max(F.size(F.split(F.decode("words", "UTF-8"), " "))).alias("n"), F.min(F.size(F.split(F.decode("words", "UTF-8"), " "))).alias("m")).first()
    # windows are whole items where those are short: only then are there shingles of fewer words
    sizes = [s for s in range(1, SHINGLE + 1) if longest["n"] and (s == SHINGLE and longest["n"] >= SHINGLE or s < SHINGLE and longest["m"] <= s)]
    texts = docs.select(F.col(f"`{text_col}`").alias("t")).where("t is not null")
    windows = written(_prefixes(distinct, _shingle_counts(texts, sizes)))
    met = _meeting(texts, _bitmap(windows), sizes).join(windows, "key")
    near = met.select("t1", "t2", F.struct((F.col("pos") - F.col("off")).alias("start"), "words", "w1", "w2").alias("c")).where("c.start >= 0")
    own = near.groupBy("t1", "t2").agg(F.collect_set("c").alias("own"))
    dated = _digests(texts, "t", ["t1", "t2"])
    hits = written(_verified(dated.join(own, ["t1", "t2"]).select("t1", "t2", "t", "own")).distinct())
    spans = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    listed = hits.select("t1", "t2", "w1", "w2").join(every.where("item is not null").select("w1", "w2", "item").distinct(), ["w1", "w2"]).groupBy("t1", "t2").agg(F.collect_set("item").alias("items"))
    t1, t2, s, i = unused([*docs.columns, out_col], "_t1", "_t2", "_spans", "_items")
    counted = _scanned(docs, text_col, spark.sparkContext.broadcast(Windows([], window)), out_col)
    both = spans.join(listed, ["t1", "t2"], "left").select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(s), F.col("items").alias(i))
    out = _digests(counted, text_col, [t1, t2]).join(both, [t1, t2], "left")
    none = F.col(f"`{out_col}`")
    return out.withColumn(out_col, F.struct(none["n_words"].alias("n_words"), F.coalesce(s, none["spans"]).alias("spans"), F.coalesce(i, none["items"]).alias("items"))).select(*[F.col(f"`{c}`") for c in counted.columns])


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out_col: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, the spans and items that hit, n_hit and contaminated."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()])
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where(F.col("t").isNotNull())
    if items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] <= block_bytes:
        w = Windows([(r.i, r.t) for r in items.collect()], window)
        sent = spark.sparkContext.broadcast(w)
        w.choose(_counted(docs.select(text_col), sent) if len(w.size) else {})
        out = _scanned(docs, text_col, spark.sparkContext.broadcast(w), out_col)
    else:
        out = _joined(docs, items, text_col, window, out_col)
    c = F.col(f"`{out_col}`")
    out = out.withColumn(out_col, F.struct(c["n_words"].alias("n_words"), c["spans"].alias("spans"), F.array_sort(c["items"]).alias("items"), covered(c["spans"]).alias("n_hit")))
    return out.withColumn(out_col, c.withField("contaminated", (c["n_hit"] > 0) & (20 * c["n_hit"] >= c["n_words"])))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, items and verdict of every document."""
    c = F.col("contamination")
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, list_slice(ws, i, i + least(13, len(ws)) - 1) AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)
),
dw AS (
  SELECT r, n, i, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
),
hit AS (SELECT DISTINCT r, n, i, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
