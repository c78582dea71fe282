import random

from furlong.llm import lines as L
from tests.llm.helpers import same_as_sql


def brute(docs):
    """[(id, text)] -> kept texts; a None id sorts first."""
    def wins(t):
        c = [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate((t or "").split("\n") if t is not None else [])]
        c = [x for x in c if x[1]]
        return [((c[i][0], c[i + 2][0]), tuple(x for _, x in c[i : i + 3])) for i in range(len(c) - 2)]
    key = lambda d: -1 if d is None else d
    first = {}
    for d, t in docs:
        for (a, _), w in wins(t):
            first[w] = min(first.get(w, (1e9, 0)), (key(d), a))
    out = []
    for d, t in docs:
        gone = {i for (a, z), w in wins(t) if (key(d), a) > first[w] for i in range(a, z + 1)}
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return out


def test_sql(spark):
    same_as_sql(spark, L.op10_lines, L.OP10_SQL)


def test_brute(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", " c ", "", "é"]) for _ in range(rng.randrange(14)))) for i in range(50)]
    docs += [(None, "a\nb\nc\nd"), (3, None), (60, ""), (61, "x\n" * 2000), (62, "x\ny\nz"), (62, "x\ny\nz")]
    df = spark.createDataFrame([(i, t, "v") for i, t in docs], "doc_id long, text string, _spans string").drop("_spans").withColumnRenamed("text", "body")
    got = L.dedup_lines(df, text_col="body", removed_col="gone").collect()
    want = brute(docs)
    assert sorted(map(repr, ((r.doc_id, r.body) for r in got))) == sorted(map(repr, ((d, w) for (d, _), w in zip(docs, want, strict=True))))
    assert L.dedup_lines(df.limit(0), text_col="body").count() == 0
