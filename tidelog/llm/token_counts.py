"""Operator 1, token counts: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the word after it, or a run of line feeds with the word after
it. No piece of the vocabulary goes across such a boundary (checked when the model is loaded), so
a text has as many pieces as its pre-tokens have together.

1. The scan makes blocks of a few MB of texts. A block has its distinct pre-tokens, numbered, and
   for each text their frequencies.
2. Pre-tokens of all blocks are sorted together, so that the library counts each distinct one
   once, for all blocks that have it.
3. Counts and frequencies are joined by block and number, and added up by text. Ids are never
   made.

What moves is one row for each pre-token of a block (a word that every text has is one row per
block, so no key is hot), twice: as text, and as a number with its count. Neither gets larger with
the number of blocks. A block's frequencies are one row of bounded size; texts don't move.

Defined cases: a null text is empty and has no tokens; repeated rows each give a row; an empty
table gives an empty result; a very long text is a block of its own; a run without white space is
one pre-token, however long, and moves whole; other columns are not read. The input must give its rows in the same
order when it is read twice, as files and checkpoints do: blocks are named by their contents, and
a block that comes out otherwise the second time is an error, not a wrong count.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_text, id_text, slices

LIMIT = 4096
#: Bytes of text in a block, about.
BLOCK = 32 << 20
#: Spaces (the vocabulary writes one as U+2581) and line feeds start a pre-token.
_SPACE = "▁"
_PRE_TOKEN = re.compile(f"[ {_SPACE}]+[^ {_SPACE}\n]*|\n+[^ {_SPACE}\n]*|[^ {_SPACE}\n]+")


class Counter:
    """The library's number of pieces of a pre-token, as it stands within a text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}|.\n|\n.", p, re.DOTALL) for p in pieces):
            raise ValueError("this vocabulary has pieces across pre-tokens")
        marked = self.model.encode("a", out_type=str)[0].startswith(_SPACE)
        if not marked or self.model.encode("  a b ", out_type=str) != [_SPACE * 2, f"{_SPACE}a", f"{_SPACE}b", _SPACE]:
            raise ValueError("this model changes white space, or adds no mark in front")

    def count(self, tokens: list[str]) -> list[int]:
        """The library puts a mark in front of what it gets. It takes the place of a leading
        space; in front of a line feed it is a piece of its own, which doesn't count."""
        asked = [t[1:] if t[0] in (" ", _SPACE) else t for t in tokens]
        sizes = [len(x) for x in self.model.encode(asked, num_threads=1)]
        # A lone space leaves nothing, for which the library gives nothing.
        return [n - (t[0] == "\n") if a else 1 for n, t, a in zip(sizes, tokens, asked, strict=True)]


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


class _Numbers(dict):
    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def pre_tokens(text: str) -> list[str]:
    """A text's first pre-token gets the mark that the library puts in front of the text."""
    return _PRE_TOKEN.findall(f"{_SPACE}{text}") if text else []


def _blocks(batches, size: int):
    """(name, ids, bytes, texts) of each block; the name is made of place and contents."""
    part, seq = TaskContext.get().partitionId(), 0
    ids, raw, total = [], [], 0

    def close():
        seen = xxhash.xxh64(f"{part} {seq} {ids}")
        for t in raw:
            seen.update(t)
            seen.update(b"\0")
        return seen.intdigest() - (1 << 63), ids, [len(t) for t in raw], raw

    for batch in batches:
        for piece in slices(batch):
            for doc, text in zip(piece.column("doc_id").to_pylist(), as_text(piece.column("text")), strict=True):
                ids.append(doc)
                raw.append(text.encode())
                total += len(raw[-1])
                if total >= size:
                    yield close()
                    ids, raw, total, seq = [], [], 0, seq + 1
    if ids:
        yield close()


def _vocabulary(batches, size: int):
    for name, _, _, raw in _blocks(batches, size):
        numbers = _Numbers()
        for text in raw:
            for token in pre_tokens(text.decode()):
                numbers[token]
        tokens = list(numbers)
        for at in range(0, len(tokens), 20_000):
            some = tokens[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string())], ["block", "number", "token"])


def _frequencies(batches, size: int):
    packer = zstandard.ZstdCompressor(level=3)
    for name, ids, n_bytes, raw in _blocks(batches, size):
        numbers, found = _Numbers(), []
        for k, text in enumerate(raw):
            tokens = pre_tokens(text.decode())
            at, times = np.unique(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)), return_counts=True)
            found.append((np.full(len(at), k, np.int32), at, times.astype(np.int32)))
        text_of, token, times = (np.concatenate(c) for c in zip(*found, strict=True))
        # By token, then text: steps between neighbours are small.
        order = np.argsort(token, kind="stable")
        text_of, token, times = text_of[order], token[order], times[order]
        steps = np.diff(text_of, prepend=np.int32(0))
        per_token = np.bincount(token, minlength=len(numbers))
        packed = [_pack(packer, x) for x in (steps, per_token, times)]
        columns = [[name], [ids], [n_bytes], *([p] for p in packed)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "n_bytes", "steps", "per_token", "times"])


def _pack(packer: zstandard.ZstdCompressor, values: np.ndarray) -> bytes:
    """Bytes of the same weight side by side compress best."""
    return packer.compress(np.frombuffer(values.astype("<i4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(4, -1).T.tobytes(), "<i4") if raw else np.zeros(0, np.int32)


def _add_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    if texts.num_rows != 1:
        raise RuntimeError("a block changed between two reads: write or checkpoint the input first")
    row = texts.to_pylist()[0]
    per_token, times, text_of = _unpack(row["per_token"]), _unpack(row["times"]), np.cumsum(_unpack(row["steps"]))
    pieces = np.zeros(len(per_token), np.int64)
    counted = counts.column("counted").to_numpy()
    if len(counted) != len(pieces):
        raise RuntimeError("a block changed between two reads: write or checkpoint the input first")
    pieces[counted >> 32] = counted & 0xFFFFFFFF
    sums = np.zeros(len(row["ids"]), np.int64)
    np.add.at(sums, text_of, times * np.repeat(pieces, per_token))
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": sums})


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_tokens, over_limit."""
    rows = id_text(docs)

    def count(batches):
        own, carried = counter(path), ("", 0)
        for batch in (b for b in batches if b.num_rows):
            tokens = as_text(batch.column("token"))
            new = [t for t in dict.fromkeys(tokens) if t != carried[0]]
            known = dict(zip(new, own.count(new), strict=True)) | dict([carried])
            carried = (tokens[-1], known[tokens[-1]])
            pieces = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            block, counted = batch.column("block").to_numpy(), batch.column("number").to_numpy().astype(np.int64) << 32 | pieces
            order = np.lexsort((counted, block))  # neighbours that are alike compress
            yield pa.RecordBatch.from_arrays([pa.array(block[order]), pa.array(counted[order])], ["block", "counted"])

    # Sorted, so that equal pre-tokens of all blocks stand together: each is counted once.
    dealt = rows.mapInArrow(lambda b: _vocabulary(b, block), "block long, number int, token string").repartition("token").sortWithinPartitions("token")
    counted = dealt.mapInArrow(count, "block long, counted long")
    texts = rows.mapInArrow(lambda b: _frequencies(b, block), "block long, ids array<long>, n_bytes array<long>, steps binary, per_token binary, times binary")
    summed = texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_add_up, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def digest(docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(docs, path)
