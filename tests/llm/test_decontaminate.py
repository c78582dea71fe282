import random
import re

from furlong.llm import decontaminate as D
from tests.llm.helpers import same_as_sql


def brute(text, items, window):
    low = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    ws, hit, who = low(text), set(), set()
    for i, t in items:
        b = low(t)
        n = min(window, len(b))
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        for k in range(len(ws) - n + 1 if wins else 0):
            if tuple(ws[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                who |= {str(i)} if i is not None else set()
    return len(ws), len(hit), sorted(who)


def test_sql(spark):
    same_as_sql(spark, D.op4_decontamination, D.OP4_SQL)


def test_brute(spark):
    rng = random.Random(5)
    mk = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "d9"]) for _ in range(n))
    items = [(i, mk(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for i in range(30)] + [(None, "zz yy"), (99, None)]
    docs = [(i, mk(rng.randrange(60)), "x") for i in range(60)] + [(None, "zz, yy!", "x"), (7, None, "x"), (7, "", "x"), (61, "zz yy " * 3000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_BYTES, 60):
        got = D.contamination(d, b, window=4, block_bytes=block).collect()
        assert len(got) == len(docs)
        for r in got:
            n, h, who = brute(r.text, items, 4)
            c = r.contamination
            assert (c.n_words, c.n_hit, list(c["items"])) == (n, h, who)
            assert c.contaminated == (h > 0 and 20 * h >= n)
    assert D.contamination(d, b.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert D.contamination(d.limit(0), b).count() == 0


def test_item_larger_than_a_block(spark):
    rng = random.Random(6)
    mk = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "d9", "fffff"]) + str(rng.randrange(3)) for _ in range(n))
    long, unlisted, word = mk(300), mk(150), "w" * 500
    items = [(1, long), (None, unlisted), (2, f"{word} x"), (3, f"one {word} two three four {word}"), (4, "a0 b1"), (5, " . " * 300)]
    ws = long.split()
    docs = [(k, " ".join(ws[k : k + 4])) for k in range(297)] + [(400, long), (401, unlisted), (402, f"p {word} x q"), (403, f"{word} two three four"), (404, mk(80)), (405, "a0 b1"), (406, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in D.contamination(d, b, window=4, block_bytes=400).collect():
        c = r.contamination
        assert (c.n_words, c.n_hit, list(c["items"])) == brute(r.text, items, 4)
