"""Operator 9, byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens from its own first
character, wherever that falls, and each pre-token is encoded. Where a pre-token boundary of one
chunk is also a boundary of the next, both go on alike from there, since the pattern looks only
ahead; so the chunks are stitched at the first such boundary of their overlap. Where an overlap
has none (one run longer than the overlap), the text from the last trusted boundary on is
pre-tokenised again across the chunks. Decoding concatenates the raw bytes of the ids.

Texts of one chunk are done in the scan, without a shuffle. Longer ones have their chunks dealt
over all tasks and are put together by document: a group is as large as one text. A round trip
decodes in the worker that has just made a text's ids.

Defined cases: a null text is empty and has no ids; repeated rows each give a row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_text, id_text, slices

#: Code points that a chunk owns, and that it shares with the next.
CHUNK, OVERLAP = 16_384, 512
#: Pre-tokens that a worker remembers with their ids; then it starts anew.
CACHE = 250_000
#: A pre-token is decided by what stands up to this far from its start (contractions) or its end.
_AHEAD_START, _AHEAD_END = 3, 1
_SCHEMA = "doc_id long, n_tokens long, ids binary"
_BOTH = f"{_SCHEMA}, decoded binary"
#: Neither letter, digit nor white space in any version of Unicode.
_STAND_IN = "\ue000"


class Codec:
    """Ranks of one vocabulary; encodes pre-tokens, each on its own."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._known: dict[str, bytes] = {}
        self.newer = self._newer()

    def _newer(self) -> frozenset[str]:
        """Letters and digits that only this side's later version of Unicode knows.

        The library shows what it takes a character for by where it cuts a contraction after it.
        """
        unassigned = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
        after_letter = self.encoding.encode_ordinary("a's")[1:]
        return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if self.encoding.encode_ordinary(f"{c}'s")[-len(after_letter) :] != after_letter)

    def ids(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        found = self._known.get(piece)
        if found is None:
            if len(self._known) >= CACHE:
                self._known.clear()
            found = np.array(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
            if len(piece) <= 64:
                self._known[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        plain = "".join(_STAND_IN if c in self.newer else c for c in text)
        ends = [m.end() for m in self.pattern.finditer(plain)]
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


class Chunk(NamedTuple):
    """Trusted boundaries (absolute; one more than there are pre-tokens) and the ids between them."""

    bounds: np.ndarray
    counts: np.ndarray
    ids: bytes
    text: str


def pack(chunk: Chunk) -> bytes:
    """What a chunk sends: pre-tokens' lengths and counts, the ids and the text, compressed."""
    parts = [np.diff(chunk.bounds).astype("<u4").tobytes(), chunk.counts.astype("<u4").tobytes(), chunk.ids, chunk.text.encode()]
    # Bytes of the same weight side by side compress best.
    parts = [np.frombuffer(p, np.uint8).reshape(-1, 4).T.tobytes() for p in parts[:3]] + parts[3:]
    sizes = np.array([len(p) for p in parts], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def unpack(start: int, data: bytes) -> Chunk:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum([16, *np.frombuffer(raw, "<u4", 4).tolist()]).tolist()
    parts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    lengths, counts, ids = (np.frombuffer(p, np.uint8).reshape(4, -1).T.tobytes() for p in parts[:3])
    bounds = start + np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))))
    return Chunk(bounds, np.frombuffer(counts, "<u4").astype(np.int64), ids, parts[3].decode())


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def encode_chunk(coder: Codec, start: int, text: str, last: bool) -> Chunk:
    pieces = coder.pieces(text)
    ends = np.cumsum([0, *map(len, pieces)])
    n = len(pieces)
    if not last:
        safe = (ends[1:] + _AHEAD_END <= len(text)) & (ends[:-1] + _AHEAD_START <= len(text))
        n = int(np.argmin(safe)) if not safe.all() else n
    ids = [coder.ids(p) for p in pieces[:n]]
    return Chunk(start + ends[: n + 1], np.array([len(i) // 4 for i in ids], dtype=np.int64), b"".join(ids), text)


def stitch(coder: Codec, chunks: list[tuple[int, Chunk]]) -> bytes:
    """Ids of the whole text from its chunks in order, each with its start."""
    out, done = [], 0  # all before ``done``, a true boundary, is encoded
    pending = ""  # text from ``done`` on that the next chunk must continue
    for k, (start, chunk) in enumerate(chunks):
        text_end = start + len(chunk.text)
        if done >= text_end and k:
            continue
        at = int(np.searchsorted(chunk.bounds, done))
        if k and (at >= len(chunk.bounds) or chunk.bounds[at] != done):
            # Not in step: go on from the last true boundary until a boundary of this chunk is met.
            joined = pending + chunk.text[max(0, done + len(pending) - start) :]
            redo = encode_chunk(coder, done, joined, k + 1 == len(chunks))
            meet = np.intersect1d(redo.bounds, chunk.bounds)
            meet = meet[meet > done]
            stop = int(meet[0]) if len(meet) else int(redo.bounds[-1])
            n = int(np.searchsorted(redo.bounds, stop))
            out.append(redo.ids[: 4 * int(redo.counts[:n].sum())])
            if not len(meet):
                done, pending = stop, joined[stop - done :]
                continue
            done, at = stop, int(np.searchsorted(chunk.bounds, stop))
        end = len(chunk.counts)
        if k + 1 < len(chunks):  # hand over at the first boundary that both have, if there is one
            both = np.intersect1d(chunk.bounds[at:], chunks[k + 1][1].bounds)
            end = int(np.searchsorted(chunk.bounds, both[0])) if len(both) else end
        skip = 4 * int(chunk.counts[:at].sum())
        out.append(chunk.ids[skip : skip + 4 * int(chunk.counts[at:end].sum())])
        done = int(chunk.bounds[end])
        pending = chunk.text[done - start :]
    return b"".join(out)


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (binary, little-endian unsigned 32 bit) and,
    with ``decode``, what the ids decode to (``decoded``, binary)."""
    rows = id_text(docs)
    limit, schema = chunk + overlap, _BOTH if decode else _SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]

    def short(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [coder.encode(t) for t in as_text(part.column("text"))]
                more = [pa.array(map(coder.decode, ids), pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), *more], names)

    def cut_rows(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = as_text(batch.column("text").slice(row, 1))[0]
                parts = cut(text, chunk, overlap)
                key, n = hashlib.sha256(text.encode()).digest(), len(parts)
                for at in range(0, n, 64):
                    some = parts[at : at + 64]
                    columns = [batch.column("doc_id").slice(row, 1).to_pylist() * len(some), [key] * len(some), [p[0] for p in some], [at + i + 1 == n for i in range(len(some))], [p[1] for p in some]]
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "key", "start", "last", "text"])

    def encode_cut(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 64):
                done = [encode_chunk(coder, s, t, e) for s, e, t in zip(part.column("start").to_pylist(), part.column("last").to_pylist(), as_text(part.column("text")), strict=True)]
                kept = ["doc_id", "key", "copies", "start"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(map(pack, done), pa.binary())], [*kept, "chunk"])

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        coder, pdf = codec(path, pattern), pdf.sort_values("start")
        ids, n = stitch(coder, [(r.start, unpack(r.start, r.chunk)) for r in pdf.itertuples()]), int(pdf["copies"].iloc[0])
        doc = pdf["doc_id"].iloc[0]
        out = {"doc_id": pd.array([None if pd.isna(doc) else int(doc)], dtype="Int64"), "n_tokens": [len(ids) // 4], "ids": [ids]}
        return pd.DataFrame(out | ({"decoded": [coder.decode(ids)]} if decode else {}) | {"copies": [n]})

    # Repeated rows are folded by the shuffle that deals the chunks out.
    long = (
        rows.where(F.char_length("text") > limit)
        .mapInArrow(cut_rows, "doc_id long, key binary, start long, last boolean, text string")
        .groupBy("doc_id", "key", "start", "last", "text").agg(F.count(F.lit(1)).alias("copies"))
        .mapInArrow(encode_cut, "doc_id long, key binary, copies long, start long, chunk binary")
        .groupBy("doc_id", "key").applyInPandas(put_together, f"{schema}, copies long")
        .select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*names)
    )
    return rows.where(F.char_length("text") <= limit).mapInArrow(short, schema).unionByName(long)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, one after another."""

    def work(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                raw = [coder.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(work, _BOTH)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encode_documents(docs, path, pattern, decode=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
