import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import chat as C
from tests.llm.helpers import same_as_sql

BITS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<", "[", "n", "é", "|im_end|>", "user"]), max_size=8).map("".join)


def test_sql(spark):
    same_as_sql(spark, C.op7_chat, C.OP7_SQL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), max_size=4))
def test_round_trip(turns):
    out, a, b = C.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    raw = [x.as_py() for x in out]
    assert [C.parse(x) for x in raw] == turns
    # also from the concatenation, so no text can break out of its turn
    assert [(C._role_back(m[1].decode()), C.unescape(m[2].decode())) for m in C._TURN.finditer(b"".join(raw))] == turns
    for x, i, j, (_, t) in zip(raw, a, b, turns, strict=True):
        assert C.unescape(x[i:j].decode()) == t
        assert b"</s>" not in x and b"[INST]" not in x and b"[/INST]" not in x


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 1, "assistant", "q" * 3_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r._k: r for r in C.digests(C.format_turns(df)).collect()}
    assert len(got) == 3
    assert got[1].n_turns == 4 and got[1].loss_chars == 3 and got[1].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert got[2].loss_chars == 3_000_000
    assert C.digests(C.format_turns(df.limit(0))).count() == 0
