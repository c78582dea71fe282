import zlib

import numpy as np

from furlong.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def auc(s, y):
    order = np.argsort(s)
    r = np.empty(len(s))
    r[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        r[s == v] = r[s == v].mean()
    p = y.sum()
    return (r[y].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in T.op8_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    rows = [(got[r.doc_id].score, r.toxic, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    s, y, p = (np.array(c) for c in zip(*rows, strict=True))
    assert auc(s, y == 1) > 0.97
    assert p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.01
    assert s.min() >= 0 and s.max() <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (None, "you idiot", "x"), (2, "a " * 200_000, "x"), (2, "b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1), (0, None), (2, 0)], "doc_id long, toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_isotonic_and_lookalikes():
    x, y = T.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]
    lex = T.Lexicon({"idiot": 3.0, "lowe*": 2.0})
    assert [lex[t] & 7 for t in ("idiot,", "id1ot", "i.d.i.o.t", "loweiä", "other", "1234")] == [1, 3, 3, 2, 0, 0]
    assert lex["you"] & 8


def test_no_cap_on_words():
    lex = T.Lexicon({"idiot": 3.0, "x" * 40: 2.0})
    assert lex["id1ot" + "!" * 70] & 7 == 3 and lex["x" * 40] & 7 == 1 and lex["X".lower() * 40 + "," * 90] & 7 == 1
    assert len(lex) <= 3  # what hardly comes again is not remembered


def test_long_words_and_many_entries_reach_the_lexicon(spark):
    long = "z" * 60
    docs = [(i, f"{long} plain" if i % 2 else "plain words") for i in range(600)]
    toxic = [(1000 + i, " ".join(f"bad{i % 2}x{j}" for j in range(3000))) for i in range(160)]
    d = spark.createDataFrame(docs + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000 or i % 2)) for i, _ in docs + toxic], "doc_id long, toxic int")
    model = T.fit(d, labels)
    assert long in model["weights"] and sum(k.startswith("bad") and not k.endswith("*") for k in model["weights"]) == 6000


def plain_features(text, weights):
    """The same features, counted one by one."""
    text = text or ""
    tokens = text.lower().split()
    kinds, seconds, mixed = [], [], 0
    for i, t in enumerate(tokens):
        core = t.strip(T._STRIP)
        kind, w = 0, 0.0
        starts = [weights[core[:k] + "*"] for k in T.PREFIXES if len(core) > k and core[:k] + "*" in weights]
        if core and core in weights:
            kind, w = 1, weights[core]
        elif core and starts:
            kind, w = 2, max(starts)
        if core and not core.isalpha() and not core.isdigit():
            mixed += any(c.isalpha() for c in core) and "-" not in core and "'" not in core
            looks = ["".join(c for c in x.translate(T._LOOKS) if c.isalpha()) for x in (t, core)]
            looks = [x for x in looks if len(x) > 3 and x in weights]
            if not kind and looks:
                kind, w = 3, weights[looks[0]]
        if kind:
            kinds.append((i, kind, min(255, int(w * 16)) / 16))
        if core in T.SECOND:
            seconds.append(i)
    n, raw = len(tokens), text.encode()
    per, chars = 100 / max(n, 1), max(len(text), 1)
    count = [sum(k == x for _, k, _ in kinds) for x in (1, 2, 3)]
    near = sum(any(abs(i - s) <= 5 for s in seconds) for i, _, _ in kinds)
    ws = [w for _, _, w in kinds]
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    return [
        count[0] * per, np.log1p(count[0]), count[1] * per, np.log1p(count[1]), np.log1p(count[2]), max(ws, default=0.0), float(np.mean(ws)) if ws else 0.0,
        mixed * per, len(seconds) * per, np.log1p(near), sum(65 <= b <= 90 for b in raw) / (letters + 30), raw.count(b"!") / chars,
        sum(raw.count(bytes([b])) for b in T._PUNCT.tolist()) / chars, np.log1p(n),
    ]


def test_scores_by_brute_force(spark):
    """Features counted one by one, trees walked node by node and the isotonic map read point by point give the same scores."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = T.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}

    def walk(x):
        b = [int(np.searchsorted(c, x[f], side="left")) for f, c in enumerate(model["trees"].cuts)]
        odds = model["trees"].base
        for tree in model["trees"].trees:
            k = 0
            while tree[k][0] >= 0:
                f, cut, child, _ = tree[k]
                k = child + (b[f] > cut)
            odds += tree[k][3]
        return odds

    for r in docs.collect():
        s = walk(plain_features(r.text, model["weights"]))
        want = 0.999 * np.interp(s, *model["map"]) + 0.001 / (1 + np.exp(-s))
        assert abs(got[r.doc_id] - want) < 1e-9, r.doc_id


def test_isotonic_is_the_max_min_of_means():
    rng = np.random.default_rng(2)
    s, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60).astype(float)
    px, py = T.isotonic(s, y)
    xs = np.unique(s)
    mean = lambda a, b: y[(s >= a) & (s <= b)].mean()
    want = [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]
    assert np.allclose(np.interp(xs, px, py), want)
