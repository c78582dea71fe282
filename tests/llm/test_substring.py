import hashlib
import random

from furlong.llm import substring as S
from tests.llm.helpers import same_as_sql


def test_sql(spark):
    same_as_sql(spark, S.op5_substrings, S.OP5_SQL)


def test_brute(spark):
    rng = random.Random(8)
    vocab = ["a", "b", "C", "é"]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.choice([20, 25, 60]))) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        docs.append((i * 3 % 80, ("\n" if i % 2 else " ").join(parts)))
    docs += [(90, "x " * 500), (91, "x " * 19), (92, "x " * 20), (93, None), (94, ""), (None, passages[0]), (95, docs[0][1]), (95, docs[0][1])]
    docs.append((40, passages[1] + " tail of another row with the id"))
    df = spark.createDataFrame([(d, t, "v") for d, t in docs], "doc_id long, text string, n_words string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, hashlib.sha256(r.kept_words.encode()).hexdigest()) for r in S.dedup_substrings(df).collect())
    want = sorted((d if d is not None else -1, *b) for (d, _), b in zip(docs, S.brute(docs), strict=True))
    assert got == want
    assert S.dedup_substrings(df.limit(0)).count() == 0


def test_a_common_phrase_is_no_hot_key(spark):
    """A phrase of every document, in different surroundings, is the key of hardly a row, whatever its hash is."""
    rng = random.Random(2)
    for phrase in ("p q r s t u", "in the name of the law", "1 2 3 4 5 6"):
        word = lambda: f"w{rng.randrange(10**9)}"
        docs = [(i, " ".join([word() for _ in range(30)] + [phrase] + [word() for _ in range(30)])) for i in range(3000)]
        slim = spark.createDataFrame(docs, "_k long, _t string").selectExpr("_t", "_k", "0L as _h")
        rows = S._runs(slim, S._counts(slim))
        assert rows.groupBy("kmer").count().agg({"count": "max"}).first()[0] < 30
