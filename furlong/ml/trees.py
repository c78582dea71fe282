"""Gradient-boosted trees on binned features, fitted to counts of equal rows.

Features are binned once: numbers by quantiles, categories by the share of positives that they have in the fitted rows, a missing
value into a bin of its own whose side each split learns. Rows of equal bins are one *cell* with its rows and positives, so the
sums that a split needs are exact sums over cells. Trees grow level by level from these sums.

The sums come from one of two places, and the trees are the same: if the cells fit ``CELL_BYTES`` (measured before anything is
collected) they are held as arrays by the driver; otherwise they stay a table of the cluster, every level is one job, and only a
sum for each (node, feature, bin) reaches the driver. In the second way scores are written to the checkpoint folder every
``CUT`` trees, so a lost executor costs at most those.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.session import ensure_checkpoint_dir

#: Bytes of cells that the driver may hold; trees between two writes of the scores in the other way.
CELL_BYTES, CUT = 256 << 20, 20
#: Categories of one feature that get a place of their own, the most frequent ones; the others share the place of a missing value.
CATEGORIES = 100_000


@dataclass(frozen=True)
class Params:
    trees: int = 1000
    depth: int = 5
    rate: float = 0.05
    least_rows: int = 100
    feature_share: float = 0.9
    bins: int = 63
    ridge: float = 1e-3
    seed: int = 42


@dataclass
class Binning:
    """How each feature becomes a bin: cut points of a number, or the bin of each category. Bin 0 is a missing value."""

    names: list[str]
    cuts: dict[str, list[float]] = field(default_factory=dict)
    places: dict[str, dict[str, int]] = field(default_factory=dict)

    def size(self, name: str) -> int:
        return 2 + (len(self.cuts[name]) if name in self.cuts else max(self.places[name].values(), default=0))

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """Rows by features."""
        out = np.zeros((len(columns[0]) if columns else 0, len(self.names)), np.uint8)
        for j, (name, c) in enumerate(zip(self.names, columns, strict=True)):
            if name in self.cuts:
                x = np.asarray(c.to_numpy(zero_copy_only=False), float)
                out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(self.cuts[name]), x, side="left"))
            else:
                get = self.places[name].get
                out[:, j] = [get(v, 0) for v in c.to_pylist()]
        return out


def _inputs(df: DataFrame, binning: Binning) -> list[Column]:
    """The features as doubles or texts, in order."""
    return [(F.col(n).cast("double") if n in binning.cuts else F.col(n).cast("string")).alias(n) for n in binning.names]


def fit_binning(df: DataFrame, features: list[str], label: str, bins: int) -> Binning:
    """Quantiles of numbers in one job; of each category its rows and positives, the most frequent first."""
    kinds = dict(df.dtypes)
    texts = [f for f in features if kinds[f] == "string"]
    numbers = [f for f in features if f not in texts]
    out = Binning(list(features))
    if numbers:
        at = [k / bins for k in range(1, bins)]
        row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 10_000).alias(c) for c in numbers]).first()
        out.cuts = {c: sorted(set(row[c] or [])) for c in numbers}
    for c in texts:
        per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("k"))
        rows = per.orderBy(F.desc("n"), "v").limit(CATEGORIES).collect()
        rows.sort(key=lambda r: ((r.k + 1) / (r.n + 2), r.v))
        total, done, out.places[c] = sum(r.n for r in rows), 0, {}
        few = len(rows) < bins
        for i, r in enumerate(rows):
            out.places[c][r.v] = 1 + (i if few else min(bins - 1, done * bins // max(1, total)))
            done += r.n
    return out


@dataclass
class Model:
    """Trees as arrays: feature (-1 at a leaf), last bin to the left, side of a missing value, left child, value."""

    binning: Binning
    base: float
    trees: list[dict[str, list]] = field(default_factory=list)

    def odds(self, codes: np.ndarray, trees: list[dict[str, list]] | None = None) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for t in self.trees if trees is None else trees:
            out += np.array(t["value"])[_leaf(t, codes)]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(codes)))

    def importance(self) -> dict[str, float]:
        """The gain of all splits by feature."""
        out = dict.fromkeys(self.binning.names, 0.0)
        for t in self.trees:
            for f, g in zip(t["feature"], t["gain"], strict=True):
                if f >= 0:
                    out[self.binning.names[f]] += g
        return out

    def to_json(self) -> str:
        return json.dumps({"binning": asdict(self.binning), "base": self.base, "trees": self.trees}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(Binning(**d["binning"]), d["base"], d["trees"])


def _leaf(tree: dict[str, list], codes: np.ndarray) -> np.ndarray:
    feature, cut, miss, child = (np.array(tree[k]) for k in ("feature", "cut", "miss", "child"))
    at = np.zeros(len(codes), np.int64)
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        n = at[inner]
        code = codes[inner, feature[n]]
        right = np.where(code == 0, miss[n] == 1, code > cut[n])
        at[inner] = child[n] + right
        inner = inner[feature[at[inner]] >= 0]
    return at


class _Growing:
    """One tree while it grows: which nodes are open, and what to do with their sums."""

    def __init__(self, params: Params, sizes: list[int], features: np.ndarray) -> None:
        self.p, self.sizes, self.features = params, sizes, features
        self.nodes: dict[str, list] = {"feature": [-1], "cut": [0], "miss": [0], "child": [0], "value": [0.0], "gain": [0.0]}
        self.open = [0]

    def split(self, sums: np.ndarray, totals: np.ndarray) -> None:
        """``sums`` [open node, feature, bin, (g, h, rows)], ``totals`` [open node, (g, h, rows)]: split what gains, close the rest."""
        p, later = self.p, []
        for k, node in enumerate(self.open):
            g, h, n = totals[k]
            best = (1e-9, -1, 0, 0, None, None)
            for f in self.features:
                s = sums[k, f, : self.sizes[f]]
                seen = np.cumsum(s[1:-1], axis=0) if self.sizes[f] > 2 else np.zeros((0, 3))
                for side, lost in ((1, np.zeros(3)), (0, s[0])):
                    left = seen + lost
                    if not len(left):
                        continue
                    right = totals[k] - left
                    gain = left[:, 0] ** 2 / (left[:, 1] + p.ridge) + right[:, 0] ** 2 / (right[:, 1] + p.ridge) - g**2 / (h + p.ridge)
                    gain[(left[:, 2] < p.least_rows) | (right[:, 2] < p.least_rows)] = 0
                    gain = np.round(gain, 8)  # equal gains stay equal, whatever the order of the sums was
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), int(f), i + 1, side, left[i], right[i])
            gain, f, cut, side, left, right = best
            if f < 0:
                self.close(node, g, h)
                continue
            first = len(self.nodes["feature"])
            for name, v in (("feature", f), ("cut", cut), ("miss", side), ("child", first), ("gain", gain)):
                self.nodes[name][node] = v
            for name, v in (("feature", -1), ("cut", 0), ("miss", 0), ("child", 0), ("value", 0.0), ("gain", 0.0)):
                self.nodes[name] += [v, v]
            later += [(first, left), (first + 1, right)]
        self.open = [node for node, _ in later]
        self.pending = [t for _, t in later]

    def close(self, node: int, g: float, h: float) -> None:
        self.nodes["value"][node] = float(-self.p.rate * g / (h + self.p.ridge))

    def close_all(self) -> None:
        for node, (g, h, _) in zip(self.open, self.pending, strict=True):
            self.close(node, g, h)
        self.open = []


def _sums(codes: np.ndarray, at: np.ndarray, opened: list[int], weights: np.ndarray, sizes: list[int]) -> np.ndarray:
    """[open node, feature, bin, (g, h, rows)] of rows with their node."""
    most, k = max(sizes), np.searchsorted(np.array(opened), at)
    hit = np.flatnonzero((k < len(opened)) & (np.array(opened)[np.minimum(k, len(opened) - 1)] == at))
    out = np.zeros((len(opened), len(sizes), most, 3))
    for f in range(len(sizes)):
        cell = k[hit] * most + codes[hit, f]
        for j in range(3):
            out[:, f, :, j] = np.bincount(cell, weights[hit, j], len(opened) * most).reshape(len(opened), most)
    return out


def _weights(score: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-score))
    return np.stack([n * p - k, n * p * (1 - p), n], axis=1)


def _loss(score: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """(sum of log losses, rows)"""
    soft = np.logaddexp(0, score)
    return float((n * soft - k * score).sum()), float(n.sum())


class _Held:
    """Cells as arrays of the driver."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, k: np.ndarray, held: np.ndarray, base: float) -> None:
        self.codes, self.n, self.k, self.held = codes, n, k, held
        self.score = np.full(len(n), base)
        self.own = np.flatnonzero(~held)

    def start(self) -> None:
        self.w = _weights(self.score[self.own], self.n[self.own], self.k[self.own])

    def sums(self, tree: dict[str, list], opened: list[int], sizes: list[int]) -> np.ndarray:
        return _sums(self.codes[self.own], _leaf(tree, self.codes[self.own]), opened, self.w, sizes)

    def add(self, tree: dict[str, list]) -> float | None:
        self.score += np.array(tree["value"])[_leaf(tree, self.codes)]
        total, rows = _loss(self.score[self.held], self.n[self.held], self.k[self.held])
        return total / rows if rows else None

    def done(self) -> None:
        pass


def _parts(batches: Iterator[pa.RecordBatch], features: int, new: list[dict[str, list]]) -> Iterator[tuple]:
    """(batch, codes, n, k, held, score with the new trees) of each batch of cells."""
    for b in batches:
        if b.num_rows:
            codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, features)
            score = b.column(4).to_numpy().copy()
            for t in new:
                score += np.array(t["value"])[_leaf(t, codes)]
            yield b, codes, b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(bool), score


class _Spread:
    """Cells as a table of the cluster: (codes, n, k, held, score)."""

    def __init__(self, cells: DataFrame, features: int, base: float) -> None:
        self.features, self.since = features, 0
        self.rows = cells.withColumn("score", F.lit(base)).persist()
        self.todo: list[dict[str, list]] = []

    def start(self) -> None:
        pass

    def sums(self, tree: dict[str, list], opened: list[int], sizes: list[int]) -> np.ndarray:
        features, new, most = self.features, list(self.todo), max(sizes)
        tree = {k: list(v) for k, v in tree.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(opened), features, most, 3))
            for _, codes, n, k, held, score in _parts(batches, features, new):
                own = np.flatnonzero(~held)
                total += _sums(codes[own], _leaf(tree, codes[own]), opened, _weights(score[own], n[own], k[own]), sizes)
            flat = total.reshape(-1, 3)
            at = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, j]) for j in range(3))], names=["at", "g", "h", "n"])

        found = self.rows.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
        out = np.zeros((len(opened) * features * most, 3))
        for r in found:
            out[r["at"]] = (r["g"], r["h"], r["n"])
        return out.reshape(len(opened), features, most, 3)

    def add(self, tree: dict[str, list]) -> float | None:
        self.todo.append(tree)
        features, new = self.features, list(self.todo)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, n, k, held, score in _parts(batches, features, new):
                total, rows = _loss(score[held], n[held], k[held])
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([rows])], names=["total", "n"])

        r = self.rows.mapInArrow(run, "total double, n double").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
        if len(self.todo) >= CUT:
            self._cut()
        return r["total"] / r["n"] if r["n"] else None

    def _cut(self) -> None:
        features, new, names = self.features, list(self.todo), self.rows.columns
        ensure_checkpoint_dir(self.rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, _, _, _, score in _parts(batches, features, new):
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(score)], names=names)

        old, self.todo = self.rows, []
        self.rows = old.mapInArrow(run, old.schema).checkpoint().persist()
        old.unpersist()

    def done(self) -> None:
        self.rows.unpersist()


def _cells(df: DataFrame, binning: Binning, label: str, held: Column) -> DataFrame:
    """(codes, n, k, held): rows of equal bins as one."""
    own = df.select(*_inputs(df, binning), F.col(label).cast("double").alias("_y"), held.alias("_held"))
    width = len(binning.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = binning.codes(b.columns[:width])
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, b.column(width), b.column(width + 1)], names=["codes", "y", "held"])

    rows = own.where("_y is not null").mapInArrow(run, "codes binary, y double, held boolean")
    return rows.groupBy("codes", "held").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k")).select("codes", "n", "k", "held")


def fit(df: DataFrame, features: list[str], label: str, params: Params, held: Column | None = None, patience: int = 0, cell_bytes: int = CELL_BYTES) -> tuple[Model, int]:
    """(model, trees that were best on the held rows): with ``held`` and ``patience``, fitting stops after that many trees without a gain,
    and the model keeps the trees up to the best one."""
    held = F.lit(False) if held is None else held
    binning = fit_binning(df.where(~held), features, label, params.bins)
    cells = _cells(df, binning, label, held).persist()
    try:
        size = cells.agg(F.count("*").alias("cells"), F.sum(F.when(~F.col("held"), F.col("n"))).alias("n"), F.sum(F.when(~F.col("held"), F.col("k"))).alias("k")).first()
        share = min(max((size["k"] or 0.0) / (size["n"] or 1.0), 1e-6), 1 - 1e-6)
        model = Model(binning, math.log(share / (1 - share)))
        if not size["n"]:
            return model, 0
        if size["cells"] * (len(features) + 32) <= cell_bytes:
            t = cells.toArrow().sort_by([("codes", "ascending"), ("held", "ascending")])
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, len(features))
            source = _Held(codes, t.column("n").to_numpy(), t.column("k").to_numpy(), t.column("held").to_numpy().astype(bool), model.base)
        else:
            source = _Spread(cells, len(features), model.base)
        best = _grow(model, source, params, patience)
        source.done()
        return model, best
    finally:
        cells.unpersist()


def _grow(model: Model, source: _Held | _Spread, params: Params, patience: int) -> int:
    sizes = [model.binning.size(n) for n in model.binning.names]
    rng = np.random.default_rng(params.seed)
    some = max(1, round(params.feature_share * len(sizes)))
    losses: list[float] = []
    for _ in range(params.trees):
        grow = _Growing(params, sizes, np.sort(rng.choice(len(sizes), some, replace=False)))
        source.start()
        for depth in range(params.depth):
            sums = source.sums(grow.nodes, grow.open, sizes)
            totals = sums[:, 0].sum(1) if depth == 0 else np.array(grow.pending)
            grow.split(sums, totals)
            if not grow.open:
                break
        grow.close_all()
        model.trees.append(grow.nodes)
        loss = source.add(grow.nodes)
        if patience and loss is not None:
            losses.append(loss)
            best = best_count(losses, patience)
            if best[1]:
                break
        if len(grow.nodes["feature"]) == 1 and grow.nodes["value"][0] == 0.0:
            break
    best = best_count(losses, patience)[0] if losses else len(model.trees)
    del model.trees[best:]
    return best


def best_count(losses: list[float], patience: int) -> tuple[int, bool]:
    """(trees up to the least loss, whether ``patience`` further trees brought none less)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def score(model: Model, df: DataFrame, out: str = "p_raw") -> DataFrame:
    """``df`` with the probability of each row; one narrow pass."""
    binning = model.binning
    df = df.select(*[c for c in df.columns if c != out])
    names, width = df.columns, len(df.columns)
    sent = df.sparkSession.sparkContext.broadcast(model)
    taken = set(names)
    inputs = []
    for i, c in enumerate(_inputs(df, binning)):
        name = f"_in{i}"
        while name in taken:
            name += "_"
        inputs.append(c.alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            p = own.probability(own.binning.codes(b.columns[width:])) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(p, pa.float64())], names=[*names, out])

    return df.select(*names, *inputs).mapInArrow(run, df.withColumn(out, F.lit(None).cast("double")).schema)
