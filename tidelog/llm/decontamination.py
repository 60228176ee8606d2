"""Operator 8, benchmark decontamination: a broadcast hash set of the normalised test n-grams.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is 13
consecutive words of a benchmark item; an item with fewer words, but some, is one window. Every
word of a document inside an occurrence of a window is hit.

Defined cases: a null text has no words, so it is never hit; a document without words is clean; a
benchmark row with a null text, or without words, has no window; a null item_id still hits words
but is listed nowhere; repeated benchmark rows count once per item_id; repeated documents each
give a row; empty tables give an empty result or clean documents; texts and items of any length are
taken whole; extra columns are not read.

The benchmark is broadcast only in blocks of ``BLOCK_WORDS`` words, a fixed bound: executors cut
longer items into pieces that overlap by a window less one word, so that a block has every window
and none is larger than that. A larger benchmark takes one scan of the documents for each block;
its hits are written to a checkpoint and its broadcast is destroyed before the next block is made,
and the hits are then merged by document. Scanning is one pass without a shuffle. Words are found
in the benchmark's vocabulary, windows by a rolling 64-bit hash, and each hit is verified by
comparing the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, checkpointed, id_text, slices

WIDTH = 13
#: Words of benchmark text in one broadcast, at most.
BLOCK_WORDS = 2_000_000
_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "row_key string, doc_id long, n_words long, hits array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


class WindowSet:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int) -> None:
        owners: dict[tuple[bytes, ...], set] = {}
        for item, words in items:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + width]), set()).update([] if item is None else [item])
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for win in owners for w in win}), 1)}
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        #: 0 stands for a word that no window has.
        self.value = np.array([0, *(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in self.vocabulary)], dtype=np.uint64)
        for n in sorted({len(win) for win in owners}):
            found: dict[int, list] = {}
            for win, own in owners.items():
                if len(win) == n:
                    ids = np.array([self.vocabulary[w] for w in win])
                    found.setdefault(int(self._rolled(ids, n)[0]), []).append((ids, own))
            self.by_length[n] = (np.array(sorted(found), dtype=np.uint64), found)

    def _rolled(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of n words, by Horner's rule."""
        values, out = self.value[ids], np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * _ODD + values[k : k + len(out)]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and by which items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edge, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, (hashes, found) in self.by_length.items():
            if n > len(ids) or not (known[n:] - known[:-n] == n).any():
                continue
            rolled = self._rolled(ids, n)
            for i in np.flatnonzero((known[n:] - known[:-n] == n) & np.isin(rolled, hashes)):
                for own_ids, own in found[int(rolled[i])]:
                    if np.array_equal(ids[i : i + n], own_ids):
                        edge[i] += 1
                        edge[i + n] -= 1
                        items |= own
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


def _pieces(benchmark: DataFrame, width: int, block_words: int) -> DataFrame:
    """(item_id, n, words): items in pieces of bounded size that have all windows of the item."""
    most = max(block_words, 2 * width)

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                for item, text in zip(part.column("item_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    words = words_of(text)
                    for at in range(0, max(1, len(words) - width + 1), most - width + 1):
                        some = words[at : at + most]
                        yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([len(some)], pa.int64()), pa.array([b" ".join(some)], pa.binary())], ["item_id", "n", "words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item_id string, n long, words binary")


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Benchmark items in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    for row in _pieces(benchmark, width, block_words).toLocalIterator():
        if block and size + row["n"] > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], bytes(row["words"]).split()))
        size += row["n"]
    yield block


def _scanned(docs: DataFrame, windows) -> DataFrame:
    """The hits of a broadcast set of windows."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                columns = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    words = words_of(text)
                    hits, items = windows.value.scan(words)
                    key = hashlib.md5(text).hexdigest()
                    for out, value in zip(columns, (key, doc, len(words), hits.astype(np.int32), sorted(items)), strict=True):
                        out.append(value)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row_key", "doc_id", "n_words", "hits", "items"])

    return id_text(docs).mapInArrow(scan, _SCHEMA)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, keep_key: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, hits (positions of words), items (sorted ids)."""
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, width, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _scanned(docs, context.broadcast(WindowSet(first, width)))
        return found if keep_key else found.drop("row_key")
    parts = []
    for block in chain((first, second), blocks):
        shared = context.broadcast(WindowSet(block, width))
        # Equal rows of one block are folded first, so that each part holds a document once.
        folded = _scanned(docs, shared).groupBy("row_key", "doc_id", "n_words", "hits", "items").agg(F.count(F.lit(1)).cast("int").alias("copies"))
        parts.append(checkpointed(folded if not parts else folded.where("size(hits) > 0")))
        shared.destroy()
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("row_key", "doc_id", "n_words", "copies")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    unfolded = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
    return unfolded if keep_key else unfolded.drop("row_key")


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return benchmark_hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", _contaminated())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    With a benchmark of one block each row is tested where it is, and nothing is shuffled. Beyond
    that the hits of all blocks are merged first, and rows are then joined to the verdicts.
    """
    blocks = _blocks(benchmark, WIDTH, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _without(docs, WindowSet(first, WIDTH))
    hits = benchmark_hits(docs, benchmark, WIDTH, block_words, keep_key=True).withColumn("n_hit", F.size("hits"))
    bad = hits.where(_contaminated()).select(F.col("row_key").alias("bad_key")).distinct()
    rows = docs.select(F.struct(F.col("*")).alias("row"))
    keyed = rows.select("row", F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")).alias("key"))
    return keyed.join(bad, keyed["key"] == bad["bad_key"], "left_anti").select("row.*")


def _without(docs: DataFrame, windows: WindowSet) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def clean(batches):
        for batch in batches:
            keep = []
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                n = len(shared.value.scan(words)[0])
                keep.append(not (n and 20 * n >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
