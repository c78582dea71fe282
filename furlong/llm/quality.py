"""Quality rules: rule statistics of every whole text, judged by an isolation forest.

Method: an isolation forest over all rule statistics, none of them cut. Each is put on a scale that
the clean labelled rows give: their quantiles inside their range, the logarithm of the distance
beyond it. Trees split samples of labelled rows, among them ``BAD_SHARE`` bad ones, at random, and
up to ``PAD`` beyond the rows as well, so that junk of a kind that no labelled row shows is isolated
too; a text whose statistics are isolated after few splits is anomalous. The score is 2 ** (-mean path / c(sample size)); the rejection threshold is the
one that makes the fewest errors on the labelled rows, a lost clean row counting ``COST`` times.

Fitting takes at most ``MOST_LABELLED`` labelled rows, the first in the order of a hash of the
id; only their statistics (``len(STATS)`` doubles each) reach the driver, and the forest that
is sent out has ``TREES * (2 * SAMPLE - 1)`` nodes at most. Scoring is one narrow pass over
all rows.

Defined results: null text has no words, fails the base rules and is not kept; repeated rows
each get a row; labels of null ids or null quality are ignored, of contradicting labels the
lowest counts; without labelled rows of both kinds the forest rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import WordHash, mix, table

MOST_LABELLED = 20_000
TREES, SAMPLE, SEED = 200, 256, 17
#: A threshold rejects at most this share of clean labelled rows.
CLEAN_LOST = 0.002
COST = 2
BAD_SHARE = 0.05
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees of a text.
STATS = ("mean_word", "longest_word", "n_words", "dup_lines", "repeat_words", "symbols", "capitals", "digits", "shouts", "bars", "beyond_ascii")
#: Splits go so far beyond the rows on the scale; steps of its quantiles; the least range of a statistic.
PAD, QUANTILES, LEAST_RANGE = 3.0, 64, 0.02
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = [9, 10, 11, 12, 13, 32]
_U = np.uint64


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a 3-word window that is found twice or more."""
    if len(hashes) < 4:
        return 0
    w = mix(mix(hashes[:-2] + _U(1)) * _U(3) + mix(hashes[1:-1] + _U(2)) * _U(5) + hashes[2:])
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    hit = n[at] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str | None, words: WordHash) -> tuple[tuple[int, ...], list[float]]:
    """(the BASE counts, the STATS that the forest sees) of one whole text."""
    text = text or ""
    raw = text.encode()
    found = raw.split()  # at \x20 and \x09-\x0D alone
    n = len(found)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    chars = len(text) - int(count[_SPACE].sum())
    symbols = int(count[_SYMBOLS].sum())
    lines = [x for x in text.split("\n") if x.encode().strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words.of(found))
    letters = int(count[65:91].sum() + count[97:123].sum())
    # a few characters, words or lines of nothing in particular keep short texts near the middle
    stats = (
        chars / max(1, n), math.log2(max(map(len, found), default=1)), math.log2(max(1, n)), dup / (len(lines) + 5), repeat / (n + 10),
        symbols / (chars + 30), count[65:91].sum() / (letters + 30), count[48:58].sum() / (chars + 30), count[33] / (chars + 30),
        count[124] / (n + 10), count[128:].sum() / (len(raw) + 30),
    )
    return (n, chars, symbols, dup, repeat), [float(x) for x in stats]


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


class Scale:
    """Strictly increasing: 0 to 1 by rank inside the range of the clean rows, and on by log distance beyond it."""

    def __init__(self, clean: np.ndarray) -> None:
        steps = np.linspace(0, 1, QUANTILES + 1)
        self.at = [np.unique(np.quantile(x, steps)) for x in clean.T]
        self.rank = [np.array([((x < v).mean() + (x <= v).mean()) / 2 for v in q]) for x, q in zip(clean.T, self.at, strict=True)]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape)
        for j, (q, rank) in enumerate(zip(self.at, self.rank, strict=True)):
            x, unit = rows[:, j], max(LEAST_RANGE, q[-1] - q[0]) / 4
            out[:, j] = np.interp(x, q, rank) + np.log1p(np.maximum(0, x - q[-1]) / unit) - np.log1p(np.maximum(0, q[0] - x) / unit)
        return out


class Forest:
    """Isolation trees in arrays: feature (-1 at a leaf), split value, left child, path length of a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, scale: Scale | None = None) -> None:
        rng = np.random.default_rng(seed)
        self.scale = scale
        rows = scale(rows) if scale else rows
        self.c = _path(min(sample, len(rows)))
        self.trees = [self._tree(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _tree(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        most = math.ceil(math.log2(max(len(rows), 2)))
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0, rows.min(0) - PAD, rows.max(0) + PAD)]
        while todo:
            at, own, depth, least, most_of = todo.pop()
            low, high = np.maximum(least, own.min(0) - PAD), np.minimum(most_of, own.max(0) + PAD)
            if len(own) < 2 or depth >= most:
                nodes[at][3] = depth + _path(len(own))
                continue
            wide = high - low
            f = int(rng.choice(len(wide), p=wide / wide.sum()))
            v = low[f] + wide[f] * rng.random()
            left = own[:, f] <= v
            nodes[at][:3] = [f, float(v), len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            for k, part in ((0, own[left]), (1, own[~left])):
                if len(part):
                    ends = [least.copy(), most_of.copy()]
                    ends[1 - k][f] = v
                    todo.append((len(nodes) - 2 + k, part, depth + 1, *ends))
                else:
                    nodes[len(nodes) - 2 + k][3] = depth + 1
        f, v, c, p = (np.array(x) for x in zip(*nodes, strict=True))
        return f.astype(np.int64), v.astype(float), c.astype(np.int64), p.astype(float)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the more anomalous."""
        rows = self.scale(rows) if self.scale else rows
        total = np.zeros(len(rows))
        for f, v, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            inner = np.flatnonzero(f[at] >= 0)
            while len(inner):
                n = at[inner]
                at[inner] = child[n] + (rows[inner, f[n]] > v[n])
                inner = inner[f[at[inner]] >= 0]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.c) if len(rows) else total


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 1e-9 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The score above which rows are rejected: fewest errors, of equals the highest; at most CLEAN_LOST of the clean rows lie above."""
    if not len(score) or good.all() or not good.any():
        return math.inf
    order = np.argsort(-score, kind="stable")
    lost, caught, ranked = np.cumsum(good[order]), np.cumsum(~good[order]), score[order]
    gain = np.where(lost <= CLEAN_LOST * good.sum(), caught - COST * lost, -math.inf)
    gain[np.append(ranked[:-1] == ranked[1:], False)] = -math.inf  # equal scores go one way
    k = int(np.argmax(gain))
    if gain[k] <= 0:
        return math.inf
    return float(ranked[k] + ranked[k + 1]) / 2 if k + 1 < len(ranked) else float(ranked[k]) - 1e-9


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> tuple[Forest | None, float]:
    """The forest and the threshold from at most ``most`` labelled rows."""
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            both = [(y, *statistics(t, words)) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(y, x) for y, base, x in both if not base_failed(base[0], base[4])]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["y", "x"])

    # at most `most` rows of two integers: small enough to broadcast at any size of the input
    found = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(picked), "doc_id").select("y", "text").mapInArrow(run, "y int, x array<double>").orderBy("x", "y").limit(2 * most).collect()
    )
    if not found:
        return None, math.inf
    y, x = np.array([r.y for r in found]) > 0, np.array([r.x for r in found])
    if y.sum() < 2 or y.all():
        return None, math.inf
    bad = np.random.default_rng(SEED).permutation(np.flatnonzero(~y))[: max(1, int(BAD_SHARE * y.sum()))]
    forest = Forest(np.vstack([x[y], x[bad]]), scale=Scale(x[y]))
    return forest, threshold(forest.score(x), y)


def judge(docs: DataFrame, model: tuple[Forest | None, float], text_col: str = "text", out_col: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct ``out_col``: the BASE counts, base_failed, score and kept of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c != out_col])
    where = docs.columns.index(text_col)
    kind = pa.struct([*((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, most = sent.value
        words = WordHash()
        for batch in batches:
            both = [statistics(t.as_py(), words) for t in batch.column(where)]
            base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
            x = np.array([s for _, s in both]).reshape(-1, len(STATS))
            score = forest.score(x) if forest else np.zeros(len(x))
            failed = np.asarray(base_failed(base[:, 0], base[:, 4]))
            cols = [*(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score <= most))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cols, fields=list(kind))], names=[*batch.schema.names, out_col])

    fields = ", ".join([*(f"{c}: bigint" for c in BASE), "base_failed: boolean", "score: double", "kept: boolean"])
    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(None).cast(f"struct<{fields}>")).schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "quality_rules.*")
