"""Every operator on tables whose further columns bear the names that it might use inside, and on ids of other types."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from furlong.llm import bpe, common, decontaminate, lines, near, quality, shard, substring, toxicity

CLASHING = "spans _spans _k _h _x _t _prefix _sum _bits _bytes _key _items _part _number _big _cell0 _prefix0 _sum0 _n0 _c0 _t1 _t2 start run done node sig n c key w1 w2 y x fold own words off".split()
TEXTS = [" ".join(f"w{i % 7}" for i in range(80)), "a\nb\nc\nd", "a\nb\nc\nq", None, "", "you idiot " * 30]


def table(spark, kind="long"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc\nd"), (1, "a\nb\nc\nd")], "doc_id long, text string")
    return df.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def operators(spark):
    items = spark.createDataFrame([(1, "a b c d"), (None, "zz")], "item_id long, text string").withColumn("_key", F.lit("b"))
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return {
        "bpe": lambda d: bpe.encode(d, path, public_tokenizers.PATTERN),
        "near": near.drop_near_duplicates,
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "decontaminate joined": lambda d: decontaminate.contamination(d, items, block_bytes=1),
        "substring": substring.dedup_substrings,
        "shard": lambda d: shard.shard(d, 40),
        "shard of one bucket": shard.shard,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "quality": lambda d: quality.judge(d, quality.fit(d, labels)),
        "lines": lambda d: lines.dedup_lines(d, removed_col="removed"),
    }


def test_clashing_names(spark):
    df = table(spark)
    for name, op in operators(spark).items():
        out = op(df)
        rows = out.collect()
        assert rows, name
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        assert [c for c in out.columns if c in df.columns] == df.columns, name


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, kind):
    """Whole numbers in any type are ids; their columns keep their type."""
    df = table(spark, kind)
    for op in (near.drop_near_duplicates, substring.dedup_substrings, lines.dedup_lines, shard.shard):
        out = op(df)
        assert dict(out.dtypes)["doc_id"] == kind and out.count() >= 4


def test_an_id_that_is_no_number_is_named(spark):
    df = spark.createDataFrame([("x1", "a b c")], "doc_id string, text string")
    for op in (near.drop_near_duplicates, substring.dedup_substrings, lines.dedup_lines):
        with pytest.raises(Exception, match="doc_id: not a whole number: x1"):
            op(df).collect()


def test_unused_names_and_scratch(spark, monkeypatch):
    assert common.unused(["a", "_K", "_k_"], "_k", "b", "_k") == ["_k__", "b", "_k___"]

    class Far:
        master = "spark://far:7077"

        class _jsc:
            @staticmethod
            def sc():
                class C:
                    @staticmethod
                    def getCheckpointDir():
                        return type("O", (), {"isDefined": staticmethod(lambda: False)})

                return C

    session = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": Far})
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(session)
