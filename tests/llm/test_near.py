import random

import numpy as np
from pyspark.sql import functions as F

from furlong.llm import common as C
from furlong.llm import near as N
from furlong.llm.common import WordHash, id_of
from furlong.llm.graph import components
from tests.llm.helpers import same_as_sql


def test_sql(spark):
    same_as_sql(spark, N.op3_near_duplicates, N.OP3_SQL)


def brute(docs, k):
    """[(id or None, text)] -> sorted (id, component), by all pairs."""
    key = lambda d: N.NULL_ID if d is None else d
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), 1 << 62), key(d))
    return sorted((key(d), len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus(rng):
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 10, 60])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(own).upper() if g % 2 else "\n".join(own)))
    return docs + [(None, "w1 w2 w3"), (2, None), (len(docs), ""), (len(docs) + 1, " \t"), (5, "other text of the id five"), (9_000, "q"), (9_001, "Q"), (9_002, "z " * 50_000)]


def test_brute_and_deep_branches(spark, monkeypatch):
    docs = corpus(random.Random(4))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, sig string")
    for k, node, group in ((2, 512, 1000), (5, 8, 12)):
        monkeypatch.setattr(N, "NODE", node)
        monkeypatch.setattr(N, "GROUP", group)
        monkeypatch.setattr(N, "REST", 4 * node)
        got = sorted((r._k, r.n_shingles, r.component) for r in N.near_duplicates(df, k=k).collect())
        assert got == brute(docs, k)
    kept = N.drop_near_duplicates(df, k=5).collect()
    assert all(r.sig == "x" for r in kept)
    assert {N.NULL_ID if r.doc_id is None else r.doc_id for r in kept} == {c for _, _, c in brute(docs, 5)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {i: i for e in edges for i in e}
    for _ in range(500):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in up.items() if any(a != b and i in (a, b) for a, b in edges)}


def test_sketch_estimates():
    w = WordHash()
    a = N.shingles(" ".join(f"x{i}" for i in range(500)), 1, w)
    b = N.shingles(" ".join(f"x{i}" for i in range(50, 550)), 1, w)
    agree = [(np.frombuffer(N.minwise(a)[1], np.uint8) == np.frombuffer(N.minwise(b)[1], np.uint8)).sum()]
    assert 40 <= agree[0] <= 62
    assert id_of("x") is not None


def templated(rng, n, shared, own):
    """Pages of ``shared`` words in common and ``own`` words of their own."""
    top = [f"t{i}" for i in range(shared)]
    return [" ".join(top + [f"p{d}x{i}" for i in range(own)]) for d in range(n)]


def test_templates_part_by_their_own_words(spark, monkeypatch):
    """Crowds at similarities of 0.5 to 0.79, a few linked pairs among them: as brute force says."""
    monkeypatch.setattr(N, "NODE", 32)
    monkeypatch.setattr(N, "GROUP", 40)
    monkeypatch.setattr(N, "REST", 64)
    monkeypatch.setattr(N, "REST_PAIRS", 500)
    rng = random.Random(8)
    texts = templated(rng, 120, 60, 30) + templated(rng, 120, 60, 20) + templated(rng, 100, 60, 8)
    for i in (3, 50, 130, 131, 260, 300):
        w = texts[i].split()
        texts.append(" ".join(w[:-3] + ["n1", "n2", f"n{i}"]))
    docs = list(enumerate(texts))
    got = sorted((r._k, r.n_shingles, r.component) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=1).collect())
    assert got == brute(docs, 1)


def test_intersections_are_counted_alike():
    rng = np.random.default_rng(1)
    for most, n in ((50, 80), (100_000, 30)):
        sets = [np.unique(rng.integers(0, most, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)]
        want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(i + 1, n)}
        assert {(i, i + 1 + k): int(x) for i, both in N._both(sets) for k, x in enumerate(both)} == want


def test_recall_near_the_threshold(spark):
    """Pairs at a similarity just above 0.8, each alone: all are found (missed with a probability of about 4e-6)."""
    docs = []
    for d in range(400):
        base = [f"a{d}x{i}" for i in range(100)]
        docs += [(2 * d, " ".join(base[:90])), (2 * d + 1, " ".join(base[10:]))]
    got = {r._k: r.component for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=1).collect()}
    assert all(got[2 * d + 1] == 2 * d for d in range(400))


def test_texts_without_candidates_are_not_shuffled(spark):
    """Two copies among texts of their own: only theirs, and a few that pass the sieve, meet their signatures."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(400)) for _ in range(1500)]
    texts[7] = texts[900] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jvm = spark.sparkContext._jsc.sc()

    def shuffled():
        spark.range(10).count()
        jvm.listenerBus().waitUntilEmpty()
        found = jvm.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    # each join exchanges its rows, as on large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = {r._k: r.component for r in N.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {k for k, c in got.items() if k != c} == {900} and got[900] == 7
    assert shuffled() - before < sum(map(len, texts)) / 2


def test_sieve(spark, monkeypatch):
    """No wanted row is lost, and few others pass; also where the sieve is far too small, and where nothing is wanted."""
    rows = spark.range(20_000).select("id", F.col("id").cast("string").cast("binary").alias("b"))
    for shards, most in ((1 << 16, 400), (1, 20_000)):
        monkeypatch.setattr(C, "SIEVE_SHARDS", shards)
        for key in ("id", "b"):
            wanted = rows.where("id % 7 = 3").select(F.col(key).alias("w"))
            got = {r.id for r in C.sieved(rows, F.col(key), wanted).collect()}
            assert set(range(3, 20_000, 7)) <= got and len(got) <= 2857 + most
    assert C.sieved(rows, F.col("id"), rows.where("id < 0").select("id")).count() == 0
