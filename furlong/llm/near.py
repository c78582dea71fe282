"""Near-duplicate documents: chosen-path set similarity join on word shingles.

A document's set is its distinct k-word shingles (A-Z lower-cased; words are runs of bytes other than \\x20 and
\\x09-\\x0D; fewer than k words: the whole sequence is one shingle). Documents are linked if 100 * intersection >= 80 * union;
the result is the connected component of each.

Method. Documents of equal sets are one node of the search (``sig``, 128 bits of the sorted set). Each of ``TREES``
independent trees branches on minwise tokens: at the root by the smallest value of the tree's own hash of the set; a
branch of more than ``NODE`` documents branches again, on two coordinates that its own id chooses from a sketch of
``SKETCH`` minwise bytes. A pair of similarity s shares a root branch with probability s, and one of two children with
1 - (1 - s) ** 2, so at 0.8 ten trees miss 2e-7 of the pairs at the root and about 4e-6 at four more levels. Small branches
are compared exhaustively by sketch (what differs in over 29 of 64 bytes, or by a quarter in size, is no candidate:
0.8 falls below that with probability 4e-6). A branch that hardly shrinks holds near copies: it is dealt in random blocks,
compared inside. That links nearly all of true copies, and then what is not yet in its largest component (the rest) is compared
with the whole branch, block by block, where that takes ``REST_PAIRS`` comparisons at most. Where it takes more, as for
pages that share a template, the branch's documents branch once more, on their rarest tokens (see ``_rare``): a pair that is similar enough
shares one of those for certain, and pages with a fifth of their own no longer meet at all. So no bound on a branch drops a pair.
Only documents that share between 80 and 89 % of their tokens with a whole crowd (a similarity of 0.67 to 0.8) cost more than their number.

Candidates form groups. A group of at most ``GROUP`` sets meets once, with its whole texts; a larger one meets in the parts
that the branches found. There links are confirmed on full sets, by intersections that are counted for all sets of a part together, and
only edges that connect more than before come out, so no task and no table holds all pairs of a group. A part holds
``GROUP_SHINGLES`` shingles at most beyond its longest document. Components are found by star steps.

Shuffled: 24 bytes a document and tree; sketches of documents in branches of two or more; texts of the documents
that have candidates (once to meet their signatures, once a group), and of few others (see ``sieved``).

Defined results: texts without words (or null) have no shingles, are linked with nothing, and are their own component;
equal ids are told apart by their sets; null ids sort before others, a component whose smallest id is null is null; an id that is no
whole number fails; further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import NULL_ID, WordHash, drop_written, id_key, id_of, mix, shuffles_dropped, sieved, table, unused, written
from furlong.llm.graph import components

SHINGLE, PERCENT = 5, 80
TREES, SKETCH, NODE, GROUP, DEPTH = 10, 64, 512, 1000, 6
#: Documents of a block in which what a branch of near copies has not linked meets the branch; pairs that a branch may compare so.
REST, REST_PAIRS = 2048, 1 << 24
#: Sketch bytes that must agree, of SKETCH; and shingles that a group, a small branch or a block may hold in all.
AGREE, GROUP_SHINGLES = 35, 8_000_000
_U = np.uint64
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, TREES + SKETCH, dtype=np.uint64) * _U(2) + _U(1)
del _rng


def shingles(text: str | None, k: int, words: WordHash) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles."""
    h = words.of(text.encode().lower().split()) if text else np.zeros(0, np.uint64)
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


def signature(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def minwise(own: np.ndarray) -> tuple[list[int], bytes]:
    """(a root value for each tree, the sketch)"""
    low = np.full(TREES + SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        low = np.minimum(low, (own[i : i + 1024, None] * _MULTIPLY).min(0))
    low = mix(low)
    return low[:TREES].astype(np.int64).tolist(), (low[TREES:] >> _U(56)).astype(np.uint8).tobytes()


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows = []
                for text in batch.column(1):
                    own = shingles(text.as_py(), k, words)
                    rows.append((len(own), signature(own), *minwise(own)) if len(own) else (0, None, None, None))
                n, sig, roots, sketch = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["_k", "_x", "n", "sig", "roots", "sketch"],
                )

    return docs.select(id_key(id_col, docs).alias("_k"), F.col(f"`{text_col}`").alias("_t"), F.xxhash64(f"`{text_col}`").alias("_x")).mapInArrow(run, "_k long, _x long, n long, sig binary, roots array<long>, sketch binary")


def _node(kind: str, *cols) -> Column:
    return F.xxhash64("node", F.lit(kind), *cols).alias("node")


def _branches(sets: DataFrame) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(node, sig) of the branches that are compared exhaustively, and (node, sig, n, c, all) of those of near copies that are too large for it."""
    nodes = sets.select("sig", "n", F.posexplode("roots").alias("tree", "value")).select(F.xxhash64("tree", "value").alias("node"), "sig", "n")
    out, stuck, kept = None, None, []
    for depth in range(DEPTH + 1):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("all")).where("c > 1")
        met = written(nodes.join(sizes, "node").select("node", "sig", "n", "c", "all"))
        kept.append(met)
        is_small = (F.col("c") <= NODE) & (F.col("all") <= GROUP_SHINGLES)
        small = met.where(is_small).select("node", "sig")
        out = small if out is None else out.unionByName(small)
        large = met.where(~is_small)
        if large.isEmpty():
            break
        own = large
        if depth < DEPTH:
            first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(SKETCH)).cast("int")
            second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit("second")), F.lit(SKETCH - 1)), F.lit(SKETCH)).cast("int")
            both = large.join(sets.select("sig", "sketch"), "sig").select("sig", "n", "node", "c", "sketch", F.explode(F.array(first, second)).alias("j"))
            split = written(both.select("sig", "n", "node", "c", F.xxhash64("node", "j", F.expr("substring(sketch, j + 1, 1)")).alias("child")))
            kept.append(split)
            # a branch whose child keeps half of it holds near copies: further branches would only repeat it
            copies = split.groupBy("node", "child").agg(F.count("*").alias("m"), F.first("c").alias("c")).where("2 * m >= c").select("node").distinct()
            own = large.join(copies, "node", "left_semi")
            nodes = split.join(copies, "node", "left_anti").select(F.col("child").alias("node"), "sig", "n")
        stuck = own if stuck is None else stuck.unionByName(own)
        if depth == DEPTH:
            break
    return out, None if stuck is None or stuck.isEmpty() else stuck, kept


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("sig", "node"), n).cast("int")


def _dealt(count: Column, shingles_: Column, size: int) -> Column:
    """Blocks for so many documents, with so many shingles in all, of which a pair of blocks must fit a worker."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size)), F.ceil(shingles_ / F.lit(GROUP_SHINGLES // 2))).cast("int")


def _per_node(rows: DataFrame) -> DataFrame:
    """(node, main, and documents and shingles of the main component and of the rest), where there is a rest; from (node, sig, n, root)."""
    sizes = rows.groupBy("node", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per = sizes.groupBy("node").agg(F.max(F.struct("c", "w", "root")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    top = F.col("top")
    out = per.select("node", top["root"].alias("main"), top["c"].alias("mc"), top["w"].alias("mw"), (F.col("c") - top["c"]).alias("rc"), (F.col("w") - top["w"]).alias("rw"))
    return out.where("rc > 0")


def _rest(rows: DataFrame, per: DataFrame) -> DataFrame:
    """(node, sig, root): blocks in which what is outside of the largest component of a branch meets the whole branch."""
    per = per.select("node", "main", _dealt(F.col("mc"), F.col("mw"), REST).alias("mains"), _dealt(F.col("rc"), F.col("rw"), REST).alias("rests"))
    both = rows.join(per, "node").select("node", "sig", "root", (F.col("root") == F.col("main")).alias("is_main"), "mains", "rests")
    main = both.where("is_main").select("node", "sig", "root", _block(F.col("mains")).alias("b"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("o"))
    rest = both.where(~F.col("is_main")).withColumn("b", _block(F.col("rests")))
    across = rest.select("node", "sig", "root", "b", F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("o"))
    among = rest.select("node", "sig", "root", "b", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("o"))
    return main.select(_node("across", "b", "o"), "sig", "root").unionByName(across.select(_node("across", "o", "b"), "sig", "root")).unionByName(among.select(_node("among", F.least("b", "o"), F.greatest("b", "o")), "sig", "root"))


def _rare(pool: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, sig, n, root): branches on the rarest tokens of documents that minwise tokens do not part, from (sig, n, root).

    Two sets that are similar enough share one of the rarest tokens of each, as many as the other set may lack and one more;
    any order of the tokens will do if it is the same for all. Tokens of one document alone branch nothing. So pages that share
    a template part by what is their own, and only what has too little of its own meets the rest of its kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        done = None
        for batch in batches:
            for i in range(batch.num_rows):
                sig = batch.column(0)[i].as_py()
                if sig == done:
                    continue
                own = shingles(batch.column(1)[i].as_py(), k, words)
                if signature(own) != sig:  # another text of the same id
                    continue
                done, own = sig, own.view(np.int64)
                for at in range(0, len(own), 100_000):
                    part = own[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([sig] * len(part), pa.binary()), pa.array(part)], names=["sig", "token"])

    own_texts = pool.select("sig").join(sieved(texts, F.col("sig"), pool.select("sig")), "sig").select("sig", "_t")
    tokens = written(own_texts.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "sig binary, token long"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    met = tokens.join(shared, "token").groupBy("sig").agg(F.count("*").alias("s"), F.array_sort(F.collect_list(F.struct("m", "token"))).alias("own"))
    # of the n tokens the n - s of one document come first in the order; what is left of the prefix are the rarest shared ones
    prefix = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / 100) + 1 - (F.col("n") - F.col("s"))
    rows = pool.join(met, "sig").where(prefix > 0).select("sig", "n", "root", F.explode(F.slice("own", F.lit(1), prefix.cast("int"))).alias("x")).select(F.col("x")["token"].alias("node"), "sig", "n", "root")
    # tokens that always come together make one branch, and branches of one component nothing new
    alike_ = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("c > 1 and lo <> hi")
    one = alike_.groupBy("c", "h").agg(F.min("node").alias("node")).select("node")
    return rows.join(one, "node")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        last = key[batch.num_rows - 1]
        lo, hi = 0, batch.num_rows  # first row of the last group
        while lo < hi:
            mid = (lo + hi) // 2
            if key[mid] == last:
                hi = mid
            else:
                lo = mid + 1
        if held and held[-1].column(0)[0] == key[0] and lo == 0:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def alike(node: np.ndarray, n: np.ndarray, sketch: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one node (rows are sorted by node) that may be similar enough, and do not share a root."""
    left, right = [], []
    for d in range(1, len(node)):
        at = np.flatnonzero(node[:-d] == node[d:])
        if not len(at):
            break
        a, b = n[at], n[at + d]
        at = at[100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)]
        if root is not None:
            at = at[root[at] != root[at + d]]
        for lo in range(0, len(at), 50_000):
            i = at[lo : lo + 50_000]
            i = i[(sketch[i] == sketch[i + d]).sum(1) >= AGREE]
            left.append(i)
            right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _candidates(nodes: DataFrame) -> DataFrame:
    """(part, root, sig) of the groups of candidates in each branch, from (node, sig, n, sketch[, a hash of the root])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            node, n = t.column(0).to_numpy(), t.column(2).to_numpy()
            sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            i, j = alike(node, n, sketch, t.column(4).to_numpy() if t.num_columns > 4 else None)
            if not len(i):
                continue
            sig = t.column(1).to_pylist()
            union = _Union(len(sig))
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                union.join(a, b)
            groups: dict[int, list[bytes]] = {}
            for a in np.unique(np.concatenate([i, j])).tolist():
                groups.setdefault(union.root(a), []).append(sig[a])
            rows = []
            for own in groups.values():
                own = sorted(set(own))
                part = xxhash.xxh3_128_digest(b"".join(own))
                rows += [(part, own[0], s) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["part", "root", "sig"])

    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "part binary, root binary, sig binary").distinct()


def _both(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sizes of the intersections of set i with sets i + 1..) of each i, for consumers that may skip some by sending nothing."""
    n = len(sets)
    flat, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[at] > 1
    row, at = row[shared], np.unique(at[shared], return_inverse=True)[1]
    wide = int(at.max()) + 1 if len(at) else 0
    if n * wide <= 50 * len(row) or n * n * wide <= 4_000_000_000:
        # products of dense blocks of columns: the tokens in common are few or common to many
        out = np.zeros((n, n), np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for lo in range(0, wide, 4096):
            a, b = np.searchsorted(at, (lo, min(wide, lo + 4096)))
            block = np.zeros((n, min(4096, wide - lo)), np.float32)
            block[row[a:b], at[a:b] - lo] = 1
            out += block @ block.T
        for i in range(n):
            yield i, out[i, i + 1 :].astype(np.int64)
        return
    ends = np.searchsorted(row, np.arange(n + 1))
    mark = np.zeros(wide, bool)
    for i in range(n):
        own = at[ends[i] : ends[i + 1]]
        mark[own] = True
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mark[at[ends[i + 1] :]])])
        yield i, np.diff(total[ends[i + 1 :] - ends[i + 1]])
        mark[own] = False


def link(members: list[tuple[bytes, np.ndarray]], percent: int = PERCENT) -> list[tuple[bytes, bytes]]:
    """Edges that connect what is linked among (sig, set), by the sizes of the intersections of the full sets.

    Two sets that are near copies of a third are usually connected through it, so sets are first compared with the largest group's first one.
    """
    n = len(members)
    union, edges = _Union(n), []
    if n < 2:
        return edges
    sets = [s for _, s in members]
    size = np.array([len(s) for s in sets])
    # near copies of the first set and of each following one that is left connect at once
    left = np.arange(n)
    while len(left) > 64:
        i, left = int(left[0]), left[1:]
        both = np.array([_common(sets[i], sets[j]) for j in left.tolist()])
        hit = 100 * both >= percent * (size[i] + size[left] - both)
        for j in left[hit].tolist():
            union.join(i, j)
        if 4 * hit.sum() < len(left):
            break
        left = left[~hit]
    roots = np.array([union.root(i) for i in range(n)])
    if len(np.unique(roots)) > 1:
        for i, both in _both(sets):
            j = i + 1 + np.flatnonzero(100 * both >= percent * (size[i] + size[i + 1 :] - both))
            for x in j.tolist():
                union.join(i, x)
    for i in range(n):
        if (r := union.root(i)) != i:
            edges.append((members[r][0], members[i][0]))
    return edges


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(y.searchsorted(x), len(y) - 1)
    return int((y[at] == x).sum())


def _confirmed(groups: DataFrame, k: int) -> DataFrame:
    """(a, b): confirmed edges, from (g, sig, _t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        group, members, seen, edges = None, [], set(), []

        def flush() -> pa.RecordBatch:
            a, b = zip(*edges, strict=True) if edges else ((), ())
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                g, sig = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if g != group:
                    edges += link(members) if len(members) > 1 else []
                    group, members, seen = g, [], set()
                if sig in seen:
                    continue
                own = shingles(batch.column(2)[i].as_py(), k, words)
                if signature(own) == sig:
                    seen.add(sig)
                    members.append((sig, own))
            yield flush()
        edges += link(members) if len(members) > 1 else []
        yield flush()

    return groups.select("g", "sig", "_t").repartition("g").sortWithinPartitions("g", "sig").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(_k, _x, n_shingles, sig, component): a row for each row of ``docs``; component is an id key (see ``id_of``), _x a hash of the text."""
    with shuffles_dropped(docs.sparkSession):
        rows, sets, linked = _linked(docs, id_col, text_col, k)
    own = linked.join(sets.select(F.col("sig").alias("node"), "label"), "node")
    least = own.groupBy("root").agg(F.min("label").alias("component"))
    label = own.join(least, "root").select(F.col("node").alias("sig"), "component")
    final = sets.select("sig", "label").join(label, "sig", "left").select("sig", F.coalesce("component", "label").alias("component"))
    return rows.select("_k", "_x", F.col("n").alias("n_shingles"), "sig").join(final, "sig", "left").select("_k", "_x", "n_shingles", "sig", F.coalesce("component", "_k").alias("component"))


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (_k, _x, n, sig), the sets (sig, label), and (node, root) of the signatures that are linked."""
    rows = written(_sketches(docs, id_col, text_col, k))
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal sets have equal sketches
    sets = written(rows.where("n > 0").groupBy("sig").agg(F.min("_k").alias("label"), first("n"), first("roots"), first("sketch")))
    sketched = sets.select("sig", "n", "sketch")
    nodes, stuck, kept = _branches(sets.select("sig", "n", "roots", "sketch"))
    if stuck is not None:
        nodes = nodes.unionByName(stuck.select(_node("block", _block(_dealt(F.col("c"), F.col("all"), NODE // 2))), "sig"))
    parts = written(_candidates(nodes.join(sketched, "sig").select("node", "sig", "n", "sketch")))
    of = components(parts.select(F.col("root").alias("a"), F.col("sig").alias("b")))
    sized = of.join(sets.select(F.col("sig").alias("node"), "n"), "node")
    group = sized.groupBy("root").agg((F.count("*") <= GROUP).alias("few"), (F.sum("n") <= GROUP_SHINGLES).alias("short")).select("root", (F.col("few") & F.col("short")).alias("fits"))
    of = written(of.join(group, "root").select(F.col("node").alias("sig"), F.col("root").alias("g"), "fits"))
    members = of.where("fits").select("g", "sig").unionByName(parts.select(F.col("part").alias("g"), "sig").join(of.where(~F.col("fits")).select("sig"), "sig").select("g", "sig"))
    # the texts that any group may need meet their signatures and groups once; no other text is shuffled
    needed = of.select("sig") if stuck is None else of.select("sig").unionByName(stuck.select("sig")).distinct()
    met = needed.join(members.groupBy("sig").agg(F.collect_list("g").alias("gs")), "sig", "left")
    wanted = written(met.join(sets.select("sig", F.col("label").alias("_k")), "sig").select("sig", "_k", "gs"))
    keyed = docs.select(id_key(id_col, docs).alias("_k"), F.col(f"`{text_col}`").alias("_t"))
    texts = sieved(keyed, F.col("_k"), wanted.select("_k")).join(wanted, "_k").select("sig", "gs", "_t")
    grouped = lambda t: t.select(F.explode("gs").alias("g"), "sig", "_t")
    if stuck is None:
        linked = components(_confirmed(grouped(texts), k))
        drop_written(*kept)
    else:
        texts = written(texts)
        edges = written(_confirmed(grouped(texts), k))
        so_far = components(edges).select(F.col("node").alias("sig"), "root")
        left = written(stuck.select("node", "sig", "n").join(so_far, "sig", "left").select("node", "sig", "n", F.coalesce("root", "sig").alias("root")))
        drop_written(*kept)
        per = written(_per_node(left))
        heavy = F.col("rc") * (F.col("rc") + F.col("mc")) > REST_PAIRS
        again = _rest(left, per.where(~heavy))
        if not (many := per.where(heavy).select("node")).isEmpty():
            # a document of such a branch may lie in several: from here on it is dealt by its own tokens, once
            pool = written(left.join(many, "node").select("sig", "n", "root").distinct())
            rare = written(_rare(pool, texts, k))
            again = again.unionByName(_rest(rare, _per_node(rare)))
        again = again.join(sketched, "sig").select("node", "sig", "n", "sketch", F.xxhash64("root").alias("r"))
        more = written(_candidates(again).select(F.col("part").alias("g"), "sig"))
        linked = components(edges.unionByName(written(_confirmed(more.join(sieved(texts.select("sig", "_t"), F.col("sig"), more.select("sig")), "sig"), k))))
        drop_written(texts)
    return rows, sets, linked


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: the rows of its smallest id stay. Columns of any name stay as they are."""
    key, hashed = unused(docs.columns, "_k", "_x")
    gone = near_duplicates(docs.select(id_col, text_col), id_col, text_col, k).where(F.col("_k") != F.col("component")).select(F.col("_k").alias(key), F.col("_x").alias(hashed)).distinct()
    return docs.join(gone, (id_key(id_col, docs) == F.col(key)) & (F.xxhash64(f"`{text_col}`") == F.col(hashed)), "left_anti")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under sets of 2-word shingles."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
    return out.select(id_of("_k").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"), (F.col("_k") == F.col("component")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 1) AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT list(hash(sh) ORDER BY hash(sh)) AS x, doc_id FROM s GROUP BY doc_id),
reps AS (SELECT min(doc_id) AS doc_id, list(doc_id) AS ids FROM sig GROUP BY x),
rs AS (SELECT s.doc_id, sh FROM s JOIN reps USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM rs a JOIN rs b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
own AS (SELECT unnest(ids) AS doc_id, c FROM reps JOIN comp ON a = reps.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(own.c, w.doc_id) AS component_id, coalesce(own.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN own USING (doc_id)
"""
