"""Operator 6, SimHash near-dedup: a binary trie of fingerprints joined with itself.

Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of three words,
repeats included; a fingerprint bit is set where over half the shingles' XXH64 (seed 42) have it.
Fingerprints that differ in two bits or fewer are linked; components are closed under links.

Trie: two 64-bit strings that differ in at most two places agree in one of three blocks of 22, 21
and 21 bits. Each block in turn is put first, and in the trie of such rotated strings only pairs
of one node with itself are alive at the depth where the block ends. Those nodes are the groups
that Spark deals out. From there on pairs of nodes go down together, add up the bits in which they
differ and are pruned beyond two. A group that is too large for one task goes four levels further
down as rows (every pair of nodes within the budget becomes a group of its own), again and again
until it fits; what fits goes down to the leaves inside the task, for all groups of a batch at
once. A task sends a spanning forest of the links it finds, never all pairs of a group.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero, linked like
any other; fewer than three words make one shingle; a null doc_id keeps its row, and component_id
is the smallest id that isn't null (null if there is none); repeated rows each give a row; an
empty table gives an empty result; other columns are not read.

Equal fingerprints are one entry of the trie, so copies never meet pairwise.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidelog.llm.common import as_bytes, checkpointed, id_text, slices
from tidelog.llm.components import connected

SHINGLE, SEED, BUDGET = 3, 42, 2
#: First bit (from the top) and width of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that a task joins as one group, at most; levels that a larger one goes down.
LEAF, STEP = 8192, 4
#: Pairs of nodes that a task holds at a time.
FRONTIER = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GROUP = "path string, depth int, used int, side int, value long, fp long"


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]  # noqa: B905
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_key) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64)), part.column("text_key")], ["doc_id", "fp", "text_key"])

    rows = id_text(docs).select("doc_id", "text", _text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(work, "doc_id long, fp long, text_key binary")


def _descend(batches):
    """Rows of large groups, four levels further down: one row for each pair of nodes alive."""
    near = [[b for b in range(1 << STEP) if (a ^ b).bit_count() <= BUDGET] for a in range(1 << STEP)]
    for batch in batches:
        rows = []
        for path, depth, used, side, value, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = ((value & (2**64 - 1)) >> (64 - depth - STEP)) & ((1 << STEP) - 1)
            for other in near[own]:
                cost = used + (own ^ other).bit_count()
                if cost > BUDGET:
                    continue
                if side:
                    pair, new = ((own, other) if side == 1 else (other, own)), side
                else:
                    pair, new = (min(own, other), max(own, other)), 0 if own == other else 1 if own < other else 2
                rows.append((f"{path}/{pair[0]:x}{pair[1]:x}", depth + STEP, cost, new, value, fp))
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, batch.schema.types, strict=True)], batch.schema.names)


def _alive(groups: DataFrame) -> DataFrame:
    """Adds the size of each group, and drops groups that can't hold a pair."""
    sizes = groups.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("most"), F.min("side").alias("least"))
    sizes = sizes.where("(most = 0 AND n > 1) OR (most = 2 AND least = 1)")
    return groups.join(sizes.select("path", "n"), "path").select("path", "depth", "used", "side", "value", "fp", "n")


def join_nodes(value: np.ndarray, a: np.ndarray, b: np.ndarray, used: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``value`` (sorted within each range) that differ in two bits at most.

    a, b: [start, end) of the nodes of each pair (equal ranges: a node with itself); used: the
    bits in which they differ above; depth: levels gone so far.
    """
    found_a, found_b = [], []
    stack = [(a, b, used, depth)]
    while stack:
        a, b, used, depth = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(a[:half], b[:half], used[:half], depth[:half]), (a[half:], b[half:], used[half:], depth[half:])]
            continue
        size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        same = a[:, 0] == b[:, 0]
        alive = (size_a > 0) & (size_b > 0) & ~(same & (size_a < 2))
        leaf = alive & (size_a == 1) & (size_b == 1)
        i, j = a[leaf, 0], b[leaf, 0]
        hit = np.bitwise_count(value[i] ^ value[j]) <= BUDGET
        found_a.append(i[hit])
        found_b.append(j[hit])
        go = alive & ~leaf & (depth < 64)
        if not go.any():
            continue
        a, b, used, depth, same = a[go], b[go], used[go], depth[go], same[go]
        mid_a, mid_b = _split(value, a, depth), _split(value, b, depth)
        a0, a1 = np.stack((a[:, 0], mid_a), 1), np.stack((mid_a, a[:, 1]), 1)
        b0, b1 = np.stack((b[:, 0], mid_b), 1), np.stack((mid_b, b[:, 1]), 1)
        more, cross = used < BUDGET, ~same & (used < BUDGET)
        stack.append((np.concatenate((a0, a1, a0[more], a1[cross])), np.concatenate((b0, b1, b1[more], b0[cross])), np.concatenate((used, used, used[more] + 1, used[cross] + 1)), np.concatenate((depth, depth, depth[more], depth[cross])) + 1))
    return np.concatenate(found_a), np.concatenate(found_b)


def _split(value: np.ndarray, ranges: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the bit at each node's depth turns to 1: a binary search in all ranges at once."""
    lo, hi = ranges[:, 0].copy(), ranges[:, 1].copy()
    shift = (63 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (value[np.minimum(mid, len(value) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Of links between 0..n-1, a spanning forest."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return [i for i, _ in kept], [j for _, j in kept]


def _links_of(table: pa.Table) -> pa.RecordBatch:
    """Links inside whole groups; rows come sorted by path, side and value."""
    path = table.column("path").combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, np.int64)
    side, depth, used = (table.column(c).to_numpy() for c in ("side", "depth", "used"))
    value, fp = table.column("value").to_numpy().view(np.uint64), table.column("fp").to_numpy()
    order = np.lexsort((value, side, path))
    path, side, depth, used, value, fp = (x[order] for x in (path, side, depth, used, value, fp))
    starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[starts[1:], len(path)]
    ranges, sides = np.stack((starts, ends), 1), side[starts]
    own, left, right = ranges[sides == 0], ranges[sides == 1], ranges[sides == 2]
    # Groups of two different nodes hold both sides; the budget spent is the same in all rows.
    a, b = np.concatenate((own, left)), np.concatenate((own, right))
    i, j = join_nodes(value, a, b, used[a[:, 0]].astype(np.int64), depth[a[:, 0]].astype(np.int64))
    i, j = _forest(i, j, len(fp))
    return pa.RecordBatch.from_arrays([pa.array(fp[i], pa.int64()), pa.array(fp[j], pa.int64())], ["a", "b"])


def _whole_groups(batches):
    """Joins all groups that are complete, and carries an open one over to the next batch."""
    rest, size = [], 0
    for batch in batches:
        path = batch.column("path")
        last = path[batch.num_rows - 1].as_py()
        first_open = path.index(last).as_py()
        if first_open and size + first_open >= LEAF:
            rest.append(batch.slice(0, first_open))
            yield _links_of(pa.Table.from_batches(rest))
            rest, size = [batch.slice(first_open)], batch.num_rows - first_open
        else:
            rest.append(batch)
            size += batch.num_rows
    if rest:
        yield _links_of(pa.Table.from_batches(rest))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within two bits of each other."""
    turns = [
        F.struct(
            F.concat(F.lit(f"{k}:"), F.hex(F.shiftrightunsigned(_turned(at), 64 - width))).alias("path"),
            F.lit(width).alias("depth"),
            F.lit(0).alias("used"),
            F.lit(0).alias("side"),
            _turned(at).alias("value"),
            F.col("fp"),
        )
        for k, (at, width) in enumerate(BLOCKS)
    ]
    groups = checkpointed(_alive(fps.select("fp").distinct().select(F.explode(F.array(*turns)).alias("g")).select("g.*")))
    fit = [groups.where(F.col("n") <= LEAF)]
    while (large := groups.where((F.col("n") > LEAF) & (F.col("depth") + STEP <= 64))).take(1):
        groups = checkpointed(_alive(large.drop("n").mapInArrow(_descend, _GROUP)))
        fit.append(groups.where((F.col("n") <= LEAF) | (F.col("depth") + STEP > 64)))
    found = []
    for part in fit:
        dealt = part.drop("n").repartition("path").sortWithinPartitions("path")
        found.append(dealt.mapInArrow(_whole_groups, "a long, b long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _turned(at: int):
    """The fingerprint with its bit number ``at`` (from the top) turned to the top."""
    if not at:
        return F.col("fp")
    return F.shiftleft(F.col("fp"), at).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 64 - at))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, fp (long), component_id, root (least fp), text_key."""
    fps = checkpointed(fingerprints(docs))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = checkpointed(connected(checkpointed(near_links(fps))))
    # Both sides of a join by a key that may be hot are tables, so that Spark may split that key.
    linked = checkpointed(roots.join(least, roots["node"] == least["fp"]).select("node", "root", "first_id"))
    smallest = checkpointed(linked.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_linked = linked.join(smallest, "root").select("node", "root", "component_id")
    every = checkpointed(
        least.join(of_linked, least["fp"] == of_linked["node"], "left").select(
            F.col("fp").alias("key"),
            F.coalesce("root", "fp").alias("root"),
            F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    return fps.join(every, fps["fp"] == every["key"]).select("doc_id", "fp", "component_id", "root", "text_key")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group with all its columns: the smallest id (null last), then any text."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    firsts = checkpointed(near_groups(docs).groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.key"))
    rows = docs.select(F.struct(F.col("*")).alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("row_id"), _text_key(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("row_key"))
    out = keyed.join(firsts, keyed["row_id"].eqNullSafe(firsts["id"]) & (keyed["row_key"] == firsts["key"]), "left_semi")
    if id_text(docs).groupBy("doc_id").count().where("count > 1").take(1):
        out = out.dropDuplicates(["row_id", "row_key"])
    return out.select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
