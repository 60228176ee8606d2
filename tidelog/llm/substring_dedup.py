"""Operator 7, substring dedup: difference-cover anchors.

A word goes if a window of 20 consecutive words covers it whose word sequence also starts earlier
(smaller doc_id, or the same document further left). Windows are judged on the input.

Anchors: {0, 1, 3, 9} covers all differences modulo 13, so two equal windows, wherever they
start, have some offset below 13 at which both are at a cover position of their own documents, and
the 8 words there are the same. Hence only windows that hold a repeated anchor can be repeated.

1. Texts are dealt into blocks of a few MB by a hash of their id and contents.
2. Each block hashes 8 words at its cover positions only, and sends each distinct hash once, in
   one row per range of hashes. What meets there from two blocks is sent back.
3. Anchors that are repeated (there, or within the block) are extended: the 20-word windows that
   hold one get a 128-bit key of their words. Each block settles the repeats within itself and
   sends the first place of each key, in one row per range of keys. The earliest place of all
   wins; the others are sent back.
4. Each block drops the words that its repeated windows cover.

A passage that a third of all texts share is thus one row per block, never one per text, and no
pairs are made. Blocks and ranges are of bounded size at any size of the input. As ranges grow in
number, a block's row for a range holds fewer hashes: plain arrays of numbers, made and taken apart
whole, so what is left of a row with one hash is a row of Spark's with one number.

Windows are equal when their 128-bit keys are (two rolling 64-bit hashes over independent halves of
the words' 128-bit hashes); words themselves don't travel. Among 10**13 windows two different ones
share a key with a probability below 10**-12.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null doc_id
sorts last; rows with the same id are ordered by the MD5 of their text; equal rows are folded into
the first of them before texts are dealt (the others lose all their words if they have a window),
so that neither a null id nor a repeated row is one task's load; a very long text is a block of
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from tidelog.llm.common import as_bytes, checkpointed, id_text

WIDTH, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)
#: Bytes of text in a block, and anchors or windows in a range, about.
BLOCK, RANGE = 4 << 20, 1 << 20
#: Words whose hashes a worker remembers; then it starts anew.
CACHE = 600_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_LAST = np.iinfo(np.int64).max
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_INVERSE = np.array([pow(int(x), -1, 2**64) for x in _ODD], dtype=np.uint64)


class WordHashes(dict):
    """Words to rows of a table of 128-bit hashes."""

    def __init__(self) -> None:
        self.table = np.zeros((1 << 16, 2), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        whole = xxh3_128_intdigest(word)
        self.table[at] = whole >> 64, whole & (2**64 - 1)
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[at]


@cache
def word_hashes() -> WordHashes:
    """One for each Python worker."""
    return WordHashes()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolled(hashes: np.ndarray, width: int, lane: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, modulo 2**64."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes[:, lane] * _powers(_ODD[lane], n))))
    return (sums[width:] - sums[:-width]) * _powers(_INVERSE[lane], n - width + 1)


class Block:
    """The texts of a block in order, with the hashes of all their words."""

    def __init__(self, table: pa.Table, known: WordHashes | None = None) -> None:
        rows = zip(table.column("doc_id").to_pylist(), table.column("tie").to_pylist(), as_bytes(table.column("text")), strict=True)
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
        self.doc_ids, self.ties = [r[0] for r in rows], [r[1] for r in rows]
        self.words = [r[2].split() for r in rows]
        self.starts = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        self.known = known

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position in the block) of all anchors."""
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, words in zip(self.starts[:-1].tolist(), self.words, strict=True):
            if len(words) < WIDTH:
                continue
            all_ = rolled(self.known.of(words), ANCHOR, 0)
            at = np.arange(len(all_))
            at = at[_IN_COVER[at % PERIOD]]
            hashes.append(all_[at])
            places.append(start + at)
        return np.concatenate(hashes), np.concatenate(places)

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, second key, text, word) of windows that hold a repeated anchor, in order.

        repeated: positions in the block of repeated anchors, ascending.
        """
        edge = np.zeros(int(self.starts[-1]) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(repeated - (WIDTH - ANCHOR), 0), 1)
        np.add.at(edge, repeated + 1, -1)
        alive = np.cumsum(edge)[:-1] > 0
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for k, (start, words) in enumerate(zip(self.starts[:-1].tolist(), self.words, strict=True)):
            n = len(words) - WIDTH + 1
            if n < 1:
                continue
            at = np.flatnonzero(alive[start : start + n])
            if len(at):
                hashes = self.known.of(words)
                for column, values in zip(out, (rolled(hashes, WIDTH, 0)[at], rolled(hashes, WIDTH, 1)[at], np.full(len(at), k), at), strict=True):
                    column.append(values)
        first, second, text, word = (np.concatenate(c) for c in out)
        return first, second, text, word


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of an array, of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and which row each is of."""
    sizes = pc.list_value_length(column).to_numpy()
    return pc.list_flatten(column).to_numpy().view(kind), np.repeat(np.arange(len(column)), sizes)


def _by_range(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which range each hash is in, and the 32 bits that follow."""
    top = hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)
    return top.astype(np.int64), ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _codes(ranges: np.ndarray, short: np.ndarray) -> np.ndarray:
    return ranges.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64)


def _twice(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ANCHORS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("hashes", _INTS)])
_PLACES = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("inner", pa.bool_()), ("key", _LONGS), ("second", _LONGS), ("doc_id", _LONGS), ("tie", _LONGS), ("place", _INTS)])
_REPEATS = pa.schema([("block", pa.int64()), ("place", _INTS)])
_KEPT = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """Of the anchors in one range, those that more than one block has, for each such block."""
    hashes, owner = _flat(table.column("hashes"), "<u4")
    mine = np.isin(hashes, _twice(hashes))
    rows, sizes = np.unique(owner[mine], return_counts=True)
    kept = table.select(["range", "block"]).take(pa.array(rows))
    return kept.append_column("hashes", _lists(hashes[mine].view("<i4"), sizes, pa.int32())).cast(_ANCHORS)


def _later_places(table: pa.Table) -> pa.Table:
    """Of the first places of keys in one range, all but the earliest of each key."""
    inner, outer = (table.filter(c) for c in (table.column("inner"), pc.invert(table.column("inner"))))
    key, owner = _flat(outer.column("key"), "<u8")
    second, doc, place = (_flat(outer.column(c), k)[0] for c, k in (("second", "<u8"), ("doc_id", "<i8"), ("place", "<i4")))
    tie, block = _flat(outer.column("tie"), "<i8")[0], outer.column("block").to_numpy()[owner]
    order = np.lexsort((place, block, tie if len(tie) else place, doc, second, key))
    key, second = key[order], second[order]
    found = order[np.r_[False, (key[1:] == key[:-1]) & (second[1:] == second[:-1])][: len(key)]]
    found = found[np.lexsort((place[found], owner[found]))]
    rows, sizes = np.unique(owner[found], return_counts=True)
    later = outer.select(["block"]).take(pa.array(rows)).append_column("place", _lists(place[found], sizes, pa.int32()))
    return pa.concat_tables([later.cast(_REPEATS), inner.select(["block", "place"]).cast(_REPEATS)])


def _with_ties(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their order among those of the same id; and (id, tie, copies) of repeated rows, of
    which one each is left. ids: that more than one row has."""
    if not ids.take(1):
        return rows.withColumn("tie", F.lit(0).cast("long")), None
    # The first 60 bits, in the order of the hexadecimal digits.
    rows = rows.withColumn("tie", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long"))
    copies = checkpointed(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    named = copies.select(F.col("doc_id").alias("id"), F.col("tie").alias("of"))
    same = rows["doc_id"].eqNullSafe(named["id"]) & (rows["tie"] == named["of"])
    once = rows.join(named, same, "left_semi").groupBy("doc_id", "tie").agg(F.first("text").alias("text")).select("doc_id", "text", "tie")
    return rows.join(named, same, "left_anti").unionByName(once), copies


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK, range_size: int = RANGE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept (the words left, by one space)."""
    rows = id_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = checkpointed(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    n_blocks = int(total // block_bytes) + 1
    # About six bytes a word: four anchors in thirteen words, and windows at most one a word.
    anchor_bits, window_bits = (max(4, int(total // (6 * each * range_size) + 1).bit_length()) for each in (3, 1))
    rows, copies = _with_ties(rows, ids)
    texts = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n_blocks)))
    tied = copies is not None

    def send_anchors(key, table):
        block, number = Block(table, word_hashes()), key[0].as_py()
        code = np.unique(_codes(*_by_range(block.anchors()[0], anchor_bits)))
        ranges, sizes = np.unique(code >> np.uint64(32), return_counts=True)
        short = (code & np.uint64(0xFFFFFFFF)).astype("<u4").view("<i4")
        return pa.Table.from_arrays([pa.array(ranges.astype("<i4")), pa.array(np.full(len(ranges), number)), _lists(short, sizes, pa.int32())], schema=_ANCHORS)

    def send_windows(key, table, shared):
        block, number = Block(table, word_hashes()), key[0].as_py()
        hashes, places = block.anchors()
        code = _codes(*_by_range(hashes, anchor_bits))
        theirs, row = _flat(shared.column("hashes"), "<u4")
        theirs = _codes(shared.column("range").to_numpy()[row], theirs)
        repeated = places[np.isin(code, np.concatenate((_twice(code), theirs)))]
        first, second, text, word = block.windows(np.sort(repeated))
        doc, tie = np.array([_LAST if d is None else d for d in block.doc_ids], dtype=np.int64), np.array(block.ties, dtype=np.int64)
        order = np.lexsort((np.arange(len(first)), second, first))
        f, s = first[order], second[order]
        again = np.r_[False, (f[1:] == f[:-1]) & (s[1:] == s[:-1])] if len(f) else np.zeros(0, bool)
        place = (block.starts[text] + word).astype("<i4")
        inner, outer = np.sort(place[order[again]]), order[~again]
        outer = outer[np.lexsort((place[outer], _by_range(first[outer], window_bits)[0]))]
        ranges, sizes = np.unique(_by_range(first[outer], window_bits)[0], return_counts=True)
        # The last row is the block's own repeats, which only pass through.
        sizes, own = np.append(sizes, 0), np.append(np.zeros(len(ranges), bool), True)
        longs = [first[outer].view("<i8"), second[outer].view("<i8"), doc[text[outer]], tie[text[outer]] if tied else np.zeros(0, np.int64)]
        columns = [pa.array(np.append(ranges, number % (1 << window_bits)).astype("<i4")), pa.array(np.full(len(sizes), number)), pa.array(own)]
        columns += [_lists(x, sizes if len(x) else sizes * 0, pa.int64()) for x in longs]
        columns.append(_lists(np.concatenate((place[outer], inner)), np.append(sizes[:-1], len(inner)), pa.int32()))
        return pa.Table.from_arrays(columns, schema=_PLACES)

    def drop_words(key, table, repeats):
        block = Block(table)
        edge = np.zeros(int(block.starts[-1]) + WIDTH + 1, dtype=np.int64)
        at = _flat(repeats.column("place"), "<i4")[0]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WIDTH, -1)
        gone = np.cumsum(edge) > 0
        columns: list[list] = [[], [], [], [], []]
        for doc, tie, start, words in zip(block.doc_ids, block.ties, block.starts[:-1].tolist(), block.words, strict=True):
            lost = gone[start : start + len(words)]
            kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x] if lost.any() else words
            for column, value in zip(columns, (doc, tie, len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT, strict=True)], schema=_KEPT)

    anchors = texts.groupBy("block").applyInArrow(send_anchors, "range int, block long, hashes array<int>")
    shared = anchors.groupBy("range").applyInArrow(_repeated_anchors, "range int, block long, hashes array<int>")
    places = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send_windows, "range int, block long, inner boolean, key array<long>, second array<long>, doc_id array<long>, tie array<long>, place array<int>"
    )
    repeats = places.groupBy("range").applyInArrow(_later_places, "block long, place array<int>")
    kept = texts.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(drop_words, "doc_id long, tie long, n_words long, n_removed long, kept binary")
    return _unfolded(kept, copies).select("doc_id", "n_words", "n_removed", "kept")


def _unfolded(kept: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Repeated rows again as often as they came: all but the first have each of their windows twice."""
    if copies is None:
        return kept
    named = copies.select(F.col("doc_id").alias("id"), F.col("tie").alias("of"), "copies")
    joined = kept.join(named, kept["doc_id"].eqNullSafe(named["id"]) & (kept["tie"] == named["of"]), "left")
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    emptied = (F.col("copy") > 1) & (F.col("n_words") >= WIDTH)
    return every.withColumns({"n_removed": F.when(emptied, F.col("n_words")).otherwise(F.col("n_removed")), "kept": F.when(emptied, F.lit("").cast("binary")).otherwise(F.col("kept"))})


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM win) WHERE k > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM rep),
gone AS (SELECT r, list(p) AS ps FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(CAST(len(gone.ps) AS BIGINT), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone.ps IS NULL THEN d.w ELSE list_filter(d.w, lambda v, k: NOT list_contains(gone.ps, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
