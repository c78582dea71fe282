import hashlib
import random
from collections import defaultdict

from furlong.llm import shard as S
from tests.llm.helpers import same_as_sql


def test_sql(spark):
    same_as_sql(spark, S.op6_shards, S.OP6_SQL)


def split(rows, limit, depth=0):
    """Recursive reference: bucket of each (bits, bytes)."""
    if not rows:
        return {}
    if sum(n for _, n in rows) <= limit or depth == S.BITS:
        return {b: b[:depth] for b, _ in rows}
    out = {}
    for bit in "01":
        out |= split([r for r in rows if r[0][depth] == bit], limit, depth + 1)
    return out


def test_brute(spark):
    rng = random.Random(1)
    docs = [(i, "x" * rng.choice([0, 5, 40, 90])) for i in range(400)] + [(None, "q" * 50), (5, None)]
    docs += [(7, "y" * 30)] * 20 + [(8, "z" * 500)]
    df = spark.createDataFrame([(i, t, "v") for i, t in docs], "doc_id long, text string, shard string")
    bits = {i: format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b") for i, _ in docs}
    for limit in (100, 1000, 10**9):
        want = split([(bits[i], len(t or "")) for i, t in docs], limit)
        got = S.shard(df, limit).collect()
        assert len(got) == len(docs)
        sums = defaultdict(list)
        for r in got:
            assert r.shard == want[bits[r.doc_id]]
            sums[r.shard, r.page].append(len(r.text or ""))
        assert all(sum(v) <= limit or len(v) == 1 for k, v in sums.items()), limit
    assert S.shard(df.limit(0)).count() == 0
