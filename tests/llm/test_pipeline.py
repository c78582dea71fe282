import random

import corpus_pipeline as P
from furlong.llm import bpe, near, quality
from tests.llm import test_decontaminate, test_lines, test_near

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = P.quality_rules(spark, docs, SF)
    assert one.columns == names
    verdict = {r.doc_id for r in quality.op9_quality(spark, SF).where("kept").collect()}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == verdict and all(rows[d] == t for d, t in kept.items())
    two = P.line_dedup(spark, one, SF)
    assert two.columns == names
    got = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    want = dict(zip(kept, test_lines.brute(list(kept.items())), strict=True))
    assert got == {d: (t, len(t)) for d, t in want.items()}
    three = P.near_dedup(spark, two, SF)
    assert three.columns == names
    assert {r.doc_id for r in three.collect()} == {c for _, _, c in test_near.brute(list(want.items()), near.SHINGLE)}
    four = P.decontamination(spark, three, SF)
    assert four.columns == names
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = set()
    for r in three.collect():
        n, hit, _ = test_decontaminate.brute(r.text, items, 13)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    assert {r.doc_id for r in four.collect()} == clean
    import public_tokenizers
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    last = P.tokens(spark, four, SF).collect()
    assert len(last) == len(clean)
    assert all(codec.decode(r.token_ids).decode() == r.text and r.n_tokens == len(r.token_ids) for r in last)


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and out.columns[-2:] == ["token_ids", "n_tokens"]


def test_odd_rows(spark, tmp_path):
    rng = random.Random(0)
    words = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(n))
    rows = [(i, words(rng.choice([0, 10, 60, 200])), None, None, None, "k") for i in range(30)] + [(None, None, None, None, None, None), (3, "", "en", "s", 0, "k"), (None, words(80), None, None, 5, "k"), (40, words(30_000), "en", "s", 1, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(20)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert "kept" in P.run(spark, str(tmp_path)).columns
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
