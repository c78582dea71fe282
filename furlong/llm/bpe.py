"""Byte-level BPE encoding and decoding.

Method: two-tier lookup. A minimal perfect hash (hash and displace: one 64-bit hash of the
bytes, a displacement per bucket, as many slots as tokens) resolves whole pre-tokens that
are in the vocabulary. Any other pre-token goes through a heap over linked bytes: the pair of
lowest rank, leftmost first, merges until no pair has a rank. Each worker keeps the ids of
pre-tokens that it saw lately (at most ``2 * MEMO`` of them), so a frequent one is resolved once.

The vocabulary (under 2 MB for 50k tokens; ``MOST_VOCABULARY`` is checked) is read on the
driver and broadcast. Documents are never shuffled: one narrow pass over the rows.

Defined results: null text is the empty text (no ids; the digests are those of the empty
string); repeated rows each give their row; null ids stay null; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import table

MOST_VOCABULARY = 64 << 20
MEMO = 300_000
_built: dict[str, Codec] = {}


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key)
    return h & 0xFFFFFFFF, (h >> 32) | 1


def perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, key number in each slot): n buckets and n slots for n distinct keys.

    A bucket of several keys stores the first displacement that sends all its keys to free
    slots; a bucket of one key stores its slot s as -s - 1; what is not met is 0.
    """
    n = len(keys)
    hashes = [_hash(k) for k in keys]
    buckets: dict[int, list[int]] = {}
    for i, (a, _) in enumerate(hashes):
        buckets.setdefault(a % n, []).append(i)
    displace, slots = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    single = []
    for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(members) == 1:
            single.append((b, members[0]))
            continue
        d = 1
        while True:
            at = [(hashes[i][0] + d * hashes[i][1]) % n for i in members]
            if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                break
            d += 1
            if d > 1 << 24:
                raise ValueError("two keys share one hash")
        displace[b] = d
        slots[at] = members
    free = iter(np.flatnonzero(slots < 0).tolist())
    for b, i in single:
        s = next(free)
        displace[b], slots[s] = -s - 1, i
    return displace, slots


class Codec:
    """Encodes texts to ids and ids to bytes, by ranks (list of token bytes by rank; None where free)."""

    def __init__(self, tokens: list[bytes | None], pattern: str, mph: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.tokens = tokens
        self.known = [i for i, t in enumerate(tokens) if t is not None]
        displace, slots = mph or perfect_hash([tokens[i] for i in self.known])
        self.displace, self.slots, self.n = displace.tolist(), [self.known[s] for s in slots.tolist()], len(slots)
        self.find = regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(len(tokens))]
        self.byte = [self.whole(bytes([b])) for b in range(256)]
        if None in self.byte or len(tokens) > 1 << 20:
            raise ValueError("the vocabulary lacks a single byte, or has over 2 ** 20 tokens")
        ranks = {tokens[i]: i for i in self.known}
        #: (left id, right id) -> id of their joined bytes
        self.pairs = {ranks[t[:k]] << 20 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.memo = _Memo(self)

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a whole piece, through the minimal perfect hash."""
        a, b = _hash(piece)
        d = self.displace[a % self.n]
        i = self.slots[-d - 1 if d < 0 else (a + d * b) % self.n]
        return i if self.tokens[i] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: a heap of mergeable pairs over the linked list of the piece's bytes."""
        get, byte = self.pairs.get, self.byte
        ids = [byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that begins at a byte, or -1; a heap entry is a rank and the place, in one number
        ranks = [get(x << 20 | y, -1) for x, y in zip(ids, ids[1:], strict=False)]
        ranks.append(-1)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, rank = entry & mask, entry >> bits
            if ranks[i] != rank:
                continue  # one of the two has merged with another meanwhile
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = ranks[i] = get(rank << 20 | ids[k], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks[h] = get(ids[h] << 20 | rank, -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """pre-token -> ids; the older half goes when it is full."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token)
        if ids is None:
            piece = token.encode()
            one = self.codec.whole(piece)
            ids = (one,) if one is not None else tuple(self.codec.merged(piece))  # no work for the garbage collector
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


def read_ranks(path: str) -> list[bytes | None]:
    """Token bytes by rank from a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY + 1)
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of over {MOST_VOCABULARY} bytes is not broadcast")
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, raw.splitlines())}
    return [ranks.get(i) for i in range(max(ranks) + 1)]


def _shared(spark: SparkSession, path: str, pattern: str):
    tokens = read_ranks(path)
    return uuid.uuid4().hex, spark.sparkContext.broadcast((tokens, pattern, perfect_hash([t for t in tokens if t is not None])))


def _codec(shared) -> Codec:
    """The worker's codec, built once from what was broadcast."""
    name, sent = shared
    if name not in _built:
        _built.clear()
        _built[name] = Codec(*sent.value)
    return _built[name]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", checked: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text (array<int>; empty for null) in ``ids_col``.

    ``checked`` decodes the ids again and fails the job if a text does not come back.
    """
    shared = _shared(docs.sparkSession, path, pattern)
    docs = docs.select(*[c for c in docs.columns if c != ids_col])
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(where).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                if checked and any(codec.decode(i) != t.encode() for i, t in zip(ids, texts, strict=True)):
                    raise ValueError("a text does not come back from its ids")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, ids_col])

    schema = docs.withColumn(ids_col, F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that the ids stand for; null ids decode to no bytes."""
    shared = _shared(df.sparkSession, path, r"(?s).")
    df = df.select(*[c for c in df.columns if c != bytes_col])
    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.large_binary() if batch.schema.field(where).type == pa.large_string() else pa.binary())], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, df.withColumn(bytes_col, F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both (ids never leave the worker)."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                joined = ",".join(map(codec.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document through the multi-language vocabulary and back."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
