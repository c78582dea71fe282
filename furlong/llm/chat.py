"""Chat formatting by columnar byte assembly.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside a role or a text
(``<|im_start|>``, ``<|im_end|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first
character, and those that already have backslashes there one more, so that removing one is the exact
inverse. In a role, backslashes are doubled and line feeds written as a backslash and n before that.

Method: the pieces of a batch (header, content, footer of each turn) stay columns of bytes. Their
lengths give cumulative offsets, the offsets give scatter indices, and numpy copies all headers
and contents into one preallocated buffer, which becomes the Arrow column without a further copy.
The loss mask is the byte range of each assistant text inside its turn.

Formatting is narrow. Only who needs whole conversations deals their turns by id and sorts them (outside memory if
need be) by turn, before or after; they are then streamed: a conversation may span any number of batches,
and readers hold one batch and the digests so far, however long it is. Digests of one conversation are one task, as they are sequential.

Defined results: null text and null role are empty; a null conversation id is a conversation, before
all others; turns sort nulls first, and equal turns by role, then text; no conversation has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import id_key, id_of, table, unused

START, END = b"<|im_start|>", b"<|im_end|>"
LOSS_ROLE = "assistant"
_ESCAPE = r"(\[)(\\*/?INST\])|(<)(\\*(?:/?s>|\|im_(?:start|end)\|>))"
_UNESCAPE = re.compile(r"(\[)\\(\\*/?INST\])|(<)\\(\\*(?:/?s>|\|im_(?:start|end)\|>))")
_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END) + rb"\n", re.S)
#: Bytes of turns that one assembly takes at most, beyond a single turn.
CHUNK = 1 << 20


def escape(column: pa.Array) -> pa.Array:
    """The column with one more backslash in each control string."""
    return pc.replace_substring_regex(column, _ESCAPE, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\3\2\4", text) if "\\" in text else text


def _role(column: pa.Array) -> pa.Array:
    """Roles on one line: backslashes are doubled and line feeds written as a backslash and n, before the escape."""
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def _role_back(text: str) -> str:
    text = unescape(text)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns as binary, where each content begins in its turn, where it ends)."""
    n = len(roles)
    parts = [pa.array([START] * n, pa.binary()), _role(roles), pa.array([b"\n"] * n, pa.binary()), escape(texts), pa.array([END + b"\n"] * n, pa.binary())]
    both = [_bytes_of(p) for p in parts]
    lengths = np.stack([np.diff(o) for _, o in both], axis=1) if n else np.zeros((0, len(parts)), np.int64)
    at = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(at[-1], np.uint8)
    begin = at[:-1].reshape(n, len(parts))
    for k, (data, offsets) in enumerate(both):
        # scatter index of each source byte: its turn's place in the output, plus its place in the piece
        shift = begin[:, k] - offsets[:-1]
        out[np.repeat(shift, lengths[:, k]) + np.arange(len(data))] = data
    turns = np.append(begin[:, 0], at[-1]).astype(np.int64) if n else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(turns), pa.py_buffer(out)])
    content = begin[:, 3] - begin[:, 0]
    return formatted, content, content + lengths[:, 3]


def parse(turn: bytes) -> tuple[str, str]:
    """(role, text) back from a formatted turn."""
    m = _TURN.fullmatch(turn)
    if not m:
        raise ValueError("not a formatted turn")
    return _role_back(m[1].decode()), unescape(m[2].decode())


def _cut(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about CHUNK bytes of column ``at``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK)))
        hi = min(hi, lo + 20_000, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with each conversation whole in one partition, and its turns in order there."""
    same = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col)]
    key = unused(rows.columns, "_key")[0]
    return rows.withColumn(key, id_key(conv_col, rows)).repartition(key).sortWithinPartitions(key, f"`{turn_col}`", *same).drop(key)


def formatted(rows: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_k, formatted, loss_from, loss_to) of each turn, in the order in which the rows are; narrow, so a hot conversation costs nothing.

    ``formatted`` is the turn's bytes, [loss_from, loss_to) the byte range under the loss mask (empty but
    for assistant turns). The concatenation of a conversation's turns is its formatted text; see :func:`in_order`.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _cut(whole, 2):
                turns, a, b = assemble(batch.column(1), batch.column(2))
                masked = pc.equal(batch.column(1), LOSS_ROLE).to_numpy(zero_copy_only=False)
                a, b = np.where(masked, a, 0), np.where(masked, b, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), turns.cast(pa.binary()), pa.array(a), pa.array(b)], names=["_k", "formatted", "loss_from", "loss_to"])

    return rows.select(id_key(conv_col, rows).alias("_k"), role.alias("_role"), text.alias("_text")).mapInArrow(run, "_k long, formatted binary, loss_from long, loss_to long")


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`formatted` turns, each conversation whole in one partition and in order."""
    return formatted(in_order(rows, conv_col, turn_col, role_col, text_col), conv_col, role_col, text_col)


def digests(turns: DataFrame) -> DataFrame:
    """What :func:`format_turns` wrote, read back: counts and digests of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k, turn, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(turn)
                loss = unescape(turn[a:b].decode())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(turn.decode())
            yield flush()
        close()
        yield flush()

    return turns.mapInArrow(run, "_k long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    out = digests(format_turns(rows.unionByName(own)))
    return out.select(id_of("_k").alias("conv_id"), *out.columns[1:])


_ESC = r"regexp_replace(regexp_replace({0}, '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(<)(\\*(?:/?s>|\|im_(?:start|end)\|>))', '\1\\\2', 'g')"
OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(role) + 1 + length({_ESC.format('text')}) + length('<|im_end|>') + 1) AS chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM s
"""
