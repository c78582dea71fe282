"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The lexicon is learned: words, and word beginnings of ``PREFIXES`` letters (for inflected forms), that far more toxic
labelled texts have than others, weighted by log odds. Features of a whole text: densities of lexicon words and
beginnings, their largest and mean weight, lexicon words behind look-alike letters, words that mix letters with other
signs, second-person words and lexicon words near them, capitals, exclamation marks, other punctuation, length.

Labels are read only for rows whose crc32(id as text) mod 3 is not ``HELD_OUT``, and of those at most ``MOST_LABELLED``,
the first in the order of a hash of the id. Training is cross-fitted in ``FOLDS`` folds: a row's features come from a
lexicon that has not seen it, and the isotonic map is fitted to scores of trees that have not seen them. The labelled rows are
picked in one pass and written; only counts of words that stand out in them and their feature vectors reach the driver, which the
number of labelled rows bounds. Words of any length count. Scoring is one narrow
pass over all rows; id, language, source and labels are no inputs of a score.

Defined results: null text is empty and scored as such; a null id is the text "" for the remainder; repeated rows each
get a row; of contradicting labels the highest counts; without labels of both kinds every score is the share of toxic
labels (0 without any).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import table, written

HELD_OUT, MOST_LABELLED, FOLDS = 1, 20_000, 4
#: An entry needs so many toxic rows, and log odds that stay above this after a standard error.
LEAST_ROWS, LEAST_ODDS = 3, 1.8
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 32, 1.0
CUT = 0.7
#: Words that address the reader, in the languages of the tables.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
_PUNCT = np.frombuffer(b".,;:?()'\"-*_~#", np.uint8)
N_FEATURES = 14


def remainder(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def keys_of(core: str) -> list[str]:
    """The word, and its beginnings where they are shorter; a beginning is marked by an asterisk."""
    return [core, *(core[:k] + "*" for k in PREFIXES if len(core) > k)]


class Lexicon(dict):
    """raw token -> code: weight (0-255) << 5 | mixed << 4 | second person << 3 | kind (0 none, 1 word, 2 beginning, 3 look-alike)."""

    most = 150_000

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> int:
        code = self.code(token)
        if len(token) <= 64:  # longer ones hardly come again
            if len(self) >= self.most:
                self.clear()
            self[token] = code
        return code

    def code(self, token: str) -> int:
        core = token.strip(_STRIP)
        get = self.weights.get
        kind, w, mixed = 0, 0.0, 0
        if core and (v := get(core)) is not None:
            kind, w = 1, v
        elif core and (found := [v for k in PREFIXES if len(core) > k and (v := get(core[:k] + "*")) is not None]):
            kind, w = 2, max(found)
        if core and not core.isalpha() and not core.isdigit():
            mixed = int(any(c.isalpha() for c in core) and "-" not in core and "'" not in core)
            # a sign at the end may stand for a letter or for itself
            for form in (token, core) if not kind else ():
                plain = "".join(c for c in form.translate(_LOOKS) if c.isalpha())
                if len(plain) > 3 and (v := get(plain)) is not None:
                    kind, w = 3, v
                    break
        return min(255, int(w * 16)) << 5 | mixed << 4 | (core in SECOND) << 3 | kind


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    tokens = text.lower().split()
    n = len(tokens)
    code = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, n)
    hits = code[(code & 7) > 0]
    kind, weight = hits & 7, (hits >> 5) / 16
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    second = np.flatnonzero(code & 8)
    near = 0
    if len(second) and len(hits):
        at = np.flatnonzero((code & 7) > 0)
        right = np.searchsorted(second, at)
        gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - at), np.abs(second[np.maximum(right - 1, 0)] - at))
        near = int((gap <= 5).sum())
    per, chars = 100 / max(n, 1), max(len(text), 1)
    counts = [int((kind == k).sum()) for k in (1, 2, 3)]
    letters = int(raw[65:91].sum() + raw[97:123].sum())
    return [
        counts[0] * per, math.log1p(counts[0]), counts[1] * per, math.log1p(counts[1]), math.log1p(counts[2]),
        float(weight.max()) if len(hits) else 0.0, float(weight.mean()) if len(hits) else 0.0,
        int((code & 16 > 0).sum()) * per, len(second) * per, math.log1p(near),
        float(raw[65:91].sum()) / (letters + 30), float(raw[33]) / chars, float(raw[_PUNCT].sum()) / chars, math.log1p(n),
    ]


class Boosted:
    """Boosted regression trees for log odds: Newton steps, features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = self._bin(x)
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        self.trees: list[list[tuple]] = []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += step

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Nodes (feature or -1, bin, left child, value) and the step of each row."""
        nodes: list[tuple] = [(-1, 0, 0, 0.0)]
        out = np.zeros(len(g))
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            k, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if depth < DEPTH:
                for f in range(b.shape[1]):
                    size = len(self.cuts[f]) + 1
                    gl = np.cumsum(np.bincount(b[rows, f], weights=g[rows], minlength=size))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, f], weights=h[rows], minlength=size))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(hl < 0.05) | (hs - hl < 0.05)] = 0
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, i)
            _, f, cut = best
            if f < 0:
                value = float(-RATE * gs / (hs + RIDGE))
                nodes[k] = (-1, 0, 0, value)
                out[rows] = value
                continue
            nodes[k] = (f, cut, len(nodes), 0.0)
            left = b[rows, f] <= cut
            nodes += [(-1, 0, 0, 0.0)] * 2
            todo += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
        return nodes, out

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x) if len(x) else np.zeros((0, len(self.cuts)), np.int64)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            f, cut, child, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                step = child[at] + (b[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at])
                at = np.where(inner, step, at)
            score += value[at]
        return score


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising map from scores to shares of y, by pooling adjacent violators."""
    xs, at = np.unique(s, return_inverse=True)
    w = np.bincount(at).astype(float)
    v = np.bincount(at, weights=y) / w
    pool: list[list[float]] = []  # value, weight, first, last
    for i in range(len(xs)):
        pool.append([v[i], w[i], i, i])
        while len(pool) > 1 and pool[-2][0] >= pool[-1][0]:
            b, a = pool.pop(), pool.pop()
            pool.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    px, py = [], []
    for value, _, i, j in pool:
        px += [xs[int(i)], xs[int(j)]]
        py += [value, value]
    return np.array(px), np.array(py)


def _weights(counts: list[tuple[str, np.ndarray]], total: np.ndarray, without: int | None) -> dict[str, float]:
    """Log odds of the entries that stand out, from counts [fold, toxic] without one fold."""
    use = np.ones(len(total), bool)
    if without is not None:
        use[without] = False
    clean, toxic = total[use].sum(0)
    out = {}
    for key, c in counts:
        n0, n1 = c[use].sum(0)
        w = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
        # what stands out by chance in few rows does not count: a standard error below must still be far above none
        if n1 >= LEAST_ROWS and w - math.sqrt(1 / n1 + 1 / (n0 + 0.5)) > LEAST_ODDS:
            out[key] = w
    return out


def _scored(x: np.ndarray, model: dict) -> np.ndarray:
    if model["trees"] is None:
        return np.full(len(x), model["share"])
    s = model["trees"].odds(x)
    # a thousandth of the uncalibrated score orders what the isotonic map makes equal
    return 0.999 * np.interp(s, *model["map"]) + 0.001 / (1 + np.exp(-s))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> dict:
    """Lexicon weights, trees and calibration from at most ``most`` labelled rows that are not held out."""
    spark = docs.sparkSession
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) != HELD_OUT))
        .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most `most` rows of three integers: small enough to broadcast at any size of the input
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").select("y", "fold", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * (2 * FOLDS))

        def flush() -> pa.RecordBatch:
            keys, n = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r[i] for r in n], pa.int64()) for i in range(2 * FOLDS))], names=["key", *(f"n{i}" for i in range(2 * FOLDS))])

        for batch in batches:
            for y, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cell = 2 * fold + (y > 0)
                seen[""][cell] += 1
                cores = {c for t in set((text or "").lower().split()) if len(c := t.strip(_STRIP)) > 1}
                for key in {k for c in cores for k in keys_of(c)}:
                    seen[key][cell] += 1
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    cells = [f"n{i}" for i in range(2 * FOLDS)]
    counts = rows.mapInArrow(count, "key string, " + ", ".join(f"{c} long" for c in cells)).groupBy("key").agg(*[F.sum(c).alias(c) for c in cells])
    # every lexicon below leaves out one fold or none: what stands out in none of these counts is no entry of any
    per = counts.where(F.col("key") == "").select(*[F.col(c).alias(f"t{c}") for c in cells])
    keep = F.col("key") == ""
    for without in (None, *range(FOLDS)):
        own = [f for f in range(FOLDS) if f != without]
        n0, n1 = (sum(F.col(cells[2 * f + kind]) for f in own) for kind in (0, 1))
        t0, t1 = (sum(F.col(f"t{cells[2 * f + kind]}") for f in own) for kind in (0, 1))
        odds = F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))
        keep = keep | ((n1 >= LEAST_ROWS) & (odds - F.sqrt(1 / F.greatest(n1, F.lit(1)) + 1 / (n0 + 0.5)) > LEAST_ODDS - 1e-6))
    kept = counts.crossJoin(F.broadcast(per)).where(keep).orderBy("key").collect()  # one row of totals
    both = [(r.key, np.array([r[c] for c in cells]).reshape(FOLDS, 2)) for r in kept]
    total = next((c for k, c in both if k == ""), np.zeros((FOLDS, 2), np.int64))
    both = [(k, c) for k, c in both if k]
    n0, n1 = total.sum(0)
    model = {"weights": _weights(both, total, None), "trees": None, "map": None, "share": float(n1) / max(1, n0 + n1)}
    if not n0 or not n1:
        return model
    sent = spark.sparkContext.broadcast([_weights(both, total, k) for k in range(FOLDS)])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(w) for w in sent.value]
        for x in own:
            x.most = 40_000
        for batch in batches:
            x = [features(t, own[f]) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "fold", "x"])

    got = rows.mapInArrow(dense, "y int, fold int, x array<double>").orderBy("fold", "y", "x").limit(2 * most).collect()
    y, fold, x = np.array([float(r.y > 0) for r in got]), np.array([r.fold for r in got]), np.array([r.x for r in got])
    odds = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            odds[fold == k] = Boosted(x[fold != k], y[fold != k]).odds(x[fold == k])
    return model | {"trees": Boosted(x, y), "map": isotonic(odds, y)}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity (0 to 1) of each whole text in ``score_col``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c != score_col])
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lexicon = Lexicon(own["weights"])
        for batch in batches:
            x = np.array([features(t.as_py(), lexicon) for t in batch.column(where)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scored(x, own), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, docs.withColumn(score_col, F.lit(None).cast("double")).schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
