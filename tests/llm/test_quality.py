import re

import numpy as np

from furlong.llm import quality as Q
from furlong.llm.common import WordHash

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)} if len(wins) < 3000 else None
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, None if hit is None else len(hit)


TEXTS = [None, "", " \n\t", "a b c", "a b c a b c", "x\nx\n\nx y\n \n ", "é# ü|\xa0z", "one two three four " * 60, "a a a a a", "A!! B!! <p>"]


def test_counts():
    for t in TEXTS:
        assert Q.statistics(t, WordHash())[0] == brute(t)


def test_rows_and_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.op9_quality(spark, SF).collect()}
    assert len(got) == docs.count()
    y = {r.doc_id: r.quality for r in labels.collect()}
    for r in docs.collect():
        g, b = got[r.doc_id], brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == b[:4]
        if b[4] is not None and len(r.text) < 3000:
            assert g.n_repeat_words == b[4]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    judged = [(y[d], g.kept) for d, g in got.items() if d in y and not g.base_failed]
    assert sum(k for v, k in judged if v) >= 0.98 * sum(v for v, _ in judged)
    assert sum(not k for v, k in judged if not v) >= 0.8 * sum(not v for v, _ in judged)


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "x", None), (1, "", "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1), (7, 1)], "doc_id long, quality int")
    out = Q.judge(docs, Q.fit(docs, labels)).collect()
    assert len(out) == len(TEXTS) + 2 and out[0].score == "q"
    assert Q.judge(docs.limit(0), Q.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    x[:5] += 9
    s = Q.Forest(x).score(x)
    assert s[:5].min() > np.quantile(s[5:], 0.98)
    assert Q.threshold(s, np.arange(500) >= 5) < s[:5].max()


def test_junk_of_other_kinds(spark):
    """What no labelled row shows is rejected as well, and clean text of the same words is kept."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]

    def prose(n, line=8):
        ws = [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
        return "\n".join(" ".join(ws[i : i + line]).capitalize() + "." for i in range(0, n, line))

    clean = [prose(int(n)) for n in rng.integers(60, 500, 400)]
    signs = [" ".join("##|" if rng.random() < 0.4 else w for w in prose(200).split()) for _ in range(40)]
    kept = [prose(int(n)) for n in rng.integers(80, 400, 100)]
    junk = {
        "lines": [prose(160, 2) + "\nx y" * 60 for _ in range(5)],
        "words": [prose(120) + "\n" + " ".join(prose(40).split() * 2) for _ in range(5)],
        "endless": [" ".join("q" * 300 if i % 5 == 0 else w for i, w in enumerate(prose(100).split())) for _ in range(5)],
        "digits": [" ".join(str(rng.integers(10**6)) if i % 2 else w for i, w in enumerate(prose(200).split())) for _ in range(5)],
        "mojibake": [" ".join("Ã©Ã¨â€™" if i % 2 else w for i, w in enumerate(prose(200).split())) for _ in range(5)],
    }
    texts = clean + signs + kept + [t for own in junk.values() for t in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(clean))) for i in range(len(clean) + len(signs))], "doc_id long, quality int")
    got = {r.doc_id: r.quality_rules for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    first = len(clean) + len(signs)
    assert sum(got[first + i].kept for i in range(len(kept))) >= 0.97 * len(kept)
    assert not any(got[len(clean) + i].kept for i in range(len(signs)))
    for k, kind in enumerate(junk):
        own = [got[first + len(kept) + 5 * k + i] for i in range(5)]
        assert not any(r.base_failed for r in own), kind
        assert not any(r.kept for r in own), kind


def test_verdict_by_brute_force(spark):
    """Every path walked node by node in plain Python: the same rows are kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest, most = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = WordHash()
    for r in Q.judge(docs, (forest, most)).collect():
        base, stats = Q.statistics(r.text, words)
        x = forest.scale(np.array([stats]))[0].tolist()
        total = 0.0
        for f, v, child, path in forest.trees:
            k = 0
            while f[k] >= 0:
                k = int(child[k]) + (x[f[k]] > v[k])
            total += path[k]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        score = 2.0 ** (-total / len(forest.trees) / forest.c)
        assert abs(score - r.quality_rules.score) < 1e-9 and r.quality_rules.kept == (not failed and score <= most), r.doc_id


def test_verdict_is_no_set_of_limits(spark):
    """Rows inside the range of the kept rows in every statistic are rejected, and each statistic has a part in the scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest, most = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = WordHash()
    x = np.array([s for r in docs.collect() for b, s in [Q.statistics(r.text, words)] if not Q.base_failed(b[0], b[4])])
    score = forest.score(x)
    kept = x[score <= most]
    rng = np.random.default_rng(7)
    mixed = np.stack([rng.choice(kept[:, j], 3000) for j in range(kept.shape[1])], axis=1)
    extreme = np.where(rng.random(mixed.shape) < 0.5, np.where(rng.random(mixed.shape) < 0.5, kept.min(0), kept.max(0)), mixed)
    assert (forest.score(extreme) > most).any()
    for j in range(x.shape[1]):
        for new in (rng.permutation(x[:, j]), x[:, j].max() + 5 + x[:, j]):
            other = x.copy()
            other[:, j] = new
            if np.abs(new - x[:, j]).max():
                assert np.abs(forest.score(other) - score).max() > 1e-3, Q.STATS[j]
