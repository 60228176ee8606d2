"""Operator 3, token ids in files: one wavelet matrix per shard.

Documents are dealt out in ascending order of their ids, encoded, and written as shards of about
``SHARD`` tokens. A shard's file is one compressed byte string: bit-planes of a wavelet matrix
with a rank directory, the documents' ids and their lengths. Token access, counting and the
places of a token are answered from it without decoding it whole. Files are stored as the
``file`` column of a Parquet table that Spark's writer commits, so a lost executor leaves neither
half a file nor two.

A shard holds how many tokens of its task stand before it, so that reading adds only the totals of
the tasks (a row for each task that wrote) and shuffles no ids.

Defined cases: a null text is empty and has the end id only; null ids come first; rows with the
same id are ordered by a hash of their text, and equal rows by their place in the input, so that
they are dealt to several tasks too; a long text is a shard of its own, in one task; an empty table
makes no shard and reads back as no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import id_text, scratch_folder, slices

#: Tokens of a shard (the document that crosses the line is its last).
SHARD = 1 << 18
END = 2
#: Words that a worker remembers with their ids; then it starts anew.
CACHE = 600_000
#: Tasks whose totals are broadcast (16 bytes each), at most; beyond that they are joined.
TASKS = 1_000_000
_MAGIC, _BLOCK = b"WVM1", 512
_FILES = "part int, seq int, n_docs long, n_tokens long, before long, file binary"
_HEAD = struct.Struct("<4sBqq")
#: Punctuation at a word's end, without apostrophes, and what it may stand after.
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
_ENDED = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz0123456789")


class WaveletMatrix:
    """A sequence of integers below 2**width as bit-planes, most significant first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.width = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, ranks, n = [], [], [], len(ids)
        for level in range(width):
            ones = (ids & ids.dtype.type(1 << (width - 1 - level))).astype(bool)
            planes.append(np.packbits(ones))
            padded = np.concatenate((planes[-1], np.zeros(-len(planes[-1]) % (_BLOCK // 8), np.uint8)))
            per_block = np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(per_block))).astype("<u4"))
            zeros.append(n - int(ranks[-1][-1]))
            below = np.empty_like(ids)
            np.compress(~ones, ids, out=below[: zeros[-1]])
            np.compress(ones, ids, out=below[zeros[-1] :])
            ids = below
        return cls(n, planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        zeros = np.array(self.zeros, dtype="<i8").tobytes()
        return zeros + b"".join(r.tobytes() for r in self.ranks) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes, n: int, width: int) -> WaveletMatrix:
        blocks, size = -(-n // _BLOCK) + 1, -(-n // 8)
        zeros = np.frombuffer(data, "<i8", width).tolist()
        ranks = np.frombuffer(data, "<u4", width * blocks, 8 * width).reshape(width, blocks)
        planes = np.frombuffer(data, np.uint8, width * size, 8 * width + 4 * width * blocks).reshape(width, size)
        return cls(n, list(planes), zeros, list(ranks))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before position i."""
        block = i // _BLOCK
        part = self.planes[level][block * _BLOCK // 8 : i >> 3]
        last = int(self.planes[level][i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + last.bit_count()

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where occurrences before ``end`` lie under the last plane."""
        start = 0
        for level in range(self.width):
            if token >> (self.width - 1 - level) & 1:
                start, end = (self.zeros[level] + self._ones(level, x) for x in (start, end))
            else:
                start, end = (x - self._ones(level, x) for x in (start, end))
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences before position ``end``."""
        start, stop = self._range(token, min(end, self.n))
        return stop - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        start, stop = self._range(token, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th bit of that value in a plane."""
        lo, hi = 0, len(self.ranks[level]) - 1
        while hi - lo > 1:  # the block that holds it
            mid = (lo + hi) // 2
            ones = int(self.ranks[level][mid])
            lo, hi = (mid, hi) if (ones if bit else mid * _BLOCK - ones) <= k else (lo, mid)
        before = int(self.ranks[level][lo])
        k -= before if bit else lo * _BLOCK - before
        bits = np.unpackbits(self.planes[level][lo * _BLOCK // 8 : (lo + 1) * _BLOCK // 8])
        return lo * _BLOCK + int(np.flatnonzero(bits == bit)[k])

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def sequence(self) -> np.ndarray:
        """All tokens: the planes' stable partitions undone, from the last to the first."""
        out = np.zeros(self.n, dtype=np.uint32 if self.width > 16 else np.uint16)
        for level in range(self.width - 1, -1, -1):
            ones, zeros = np.unpackbits(self.planes[level], count=self.n).view(bool), self.zeros[level]
            out[zeros:] |= out.dtype.type(1 << (self.width - 1 - level))
            above = np.empty_like(out)
            above[np.flatnonzero(~ones)], above[np.flatnonzero(ones)] = out[:zeros], out[zeros:]
            out = above
        return out


class Shard:
    """A file's contents: which documents, how long, and their tokens."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, tokens: WaveletMatrix) -> None:
        self.doc_ids, self.lengths, self.tokens = doc_ids, lengths, tokens

    def to_bytes(self) -> bytes:
        known = np.packbits([d is not None for d in self.doc_ids])
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        head = _HEAD.pack(_MAGIC, self.tokens.width, len(ids), self.tokens.n)
        return head + known.tobytes() + ids.tobytes() + self.lengths.astype("<i8").tobytes() + self.tokens.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, width, docs, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        known = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs)
        at += -(-docs // 8)
        ids, lengths = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<i8", docs, at + 8 * docs)
        named = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        return cls(named, lengths, WaveletMatrix.from_bytes(data[at + 16 * docs :], n, width))


class WordEncoder:
    """The tokenizers library, asked once for each distinct word between ASCII white space.

    No pre-token of the vocabulary's pattern spans white space, so the words' ids one after
    another are the text's. Words are asked for in lower case and without punctuation at their end
    (a pre-token of its own, if it follows a letter or digit and has no apostrophe), but for those
    that may hold a special token. Words of Latin letters only are one pre-token each: the model
    itself is asked for those of a to z, and others are asked for together, as an id that ends a
    pre-token ends a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any("<|" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("this vocabulary has special strings without <|")
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        cases = ["ABC xyz", "ÀB ΣΑΣ İ", "It'S WE'LL", "X9Y.Z"]
        lowered = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
        if any(one(t) != one(t.translate(lowered)) for t in cases) or one("a\n b\t\tc") != one("a b c"):
            raise ValueError("this tokenizer tells letters' cases or kinds of white space apart")
        if one("a b, c") != one("a") + one("b") + one(",") + one("c"):
            raise ValueError("this tokenizer's pieces go across white space or from letters into punctuation")
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(1 << self.width, dtype=bool)
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        # Letters that the model takes as they are needn't go through the other steps.
        self._direct = all(one(w) == self._pieces(w) for w in ("abcdefghijklmnopqrstuvwxyz", "the", "quick", "brown", "fox", "jumps", "over", "a", "lazy", "dog"))
        self._forget()

    def _pieces(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _forget(self) -> None:
        self._cores: dict[bytes, bytes] = {}
        self._numbers: dict[bytes, int] = {}
        #: Ids of all words known, one after another, and where those of each number start and end.
        self._ids, self._bounds = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.binary()).view(pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's end.

        Arrow cuts the texts and numbers their distinct words, new ones are learned together, and
        ids are put together by number: no object is made for a word that is repeated.
        """
        if len(self._numbers) > CACHE:
            self._forget()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return self._ids[:0], np.zeros(len(texts), np.int64)
        # As one value and cut again, since objects made one by one take most of the time.
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_buffer().to_pybytes().split(b"\n")
        known = np.fromiter(map(self._numbers.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = np.arange(len(self._numbers), len(self._numbers) + len(new))
            self._learn([words[k] for k in new.tolist()])
        numbers = known[coded.indices.to_numpy()]
        starts, lengths = self._bounds[numbers], self._bounds[numbers + 1] - self._bounds[numbers]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self._ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        return ids, ends[np.cumsum(pc.list_value_length(split).to_numpy())]

    def _keep(self, cores: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        self._cores.update(zip(cores, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        whole = b"\n".join(words)
        lowered = whole.lower().split(b"\n")
        heads = [w.rstrip(_MARKS) for w in lowered]
        tails = [w[len(h) :] for w, h in zip(lowered, heads, strict=True)]
        for k in [k for k, (h, t) in enumerate(zip(heads, tails, strict=True)) if t and h[-1:] not in _ENDED]:
            heads[k], tails[k] = lowered[k], b""
        if b"<|" in whole:
            for k in [k for k, w in enumerate(words) if b"<|" in w]:
                heads[k], tails[k] = words[k], b""
        cores = {*heads, *tails}.difference(self._cores)
        if self._direct:
            letters = [c for c in cores if c.isalpha()]
            pieces = [self._pieces(c.decode()) for c in letters]
            self._keep(letters, np.fromiter(chain.from_iterable(pieces), self.dtype), np.cumsum(list(map(len, pieces)), dtype=np.int64))
            cores = cores.difference(letters)
        plain = [c for c in cores if c.isalpha() or not c.isascii() and (t := c.decode("utf-8", "replace")).isalpha() and max(t) < "\u0250"]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                self._keep(plain, ids, ends)
        rest = [c for c in cores if c not in self._cores]
        coded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in rest], add_special_tokens=False)
        self._cores.update(zip(rest, (np.array(c.ids, dtype=self.dtype).tobytes() for c in coded), strict=True))
        known = self._cores.__getitem__
        found = list(map(bytes.__add__, map(known, heads), map(known, tails)))
        self._numbers.update(zip(words, range(len(self._numbers), len(self._numbers) + len(words)), strict=True))
        self._ids = np.concatenate((self._ids, np.frombuffer(b"".join(found), self.dtype)))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        self._bounds = np.concatenate((self._bounds, self._bounds[-1] + np.cumsum(lengths)))


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, out: str, shard: int = SHARD) -> None:
    """Encodes the texts in ascending order of doc_id and writes shards to the folder ``out``."""

    def build(batches):
        coder, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END], dtype=coder.dtype)
        ids, lengths, coded, n, before = [], [], [], 0, 0

        def close():
            tokens = WaveletMatrix.build(np.concatenate(coded), coder.width)
            made = Shard(ids, np.array(lengths, dtype=np.int64), tokens)
            columns = [[part], [seq], [len(ids)], [n], [before], [made.to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "before", "file"])

        for batch in batches:
            for piece in slices(batch):
                found, ends = coder.encode_column(piece.column("text"))
                start = 0
                for doc, stop in zip(piece.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    coded += [found[start:stop], end]
                    ids.append(doc)
                    lengths.append(stop - start + 1)
                    start, n = stop, n + lengths[-1]
                    if n >= shard:
                        yield close()
                        ids, lengths, coded, n, seq, before = [], [], [], 0, seq + 1, before + n
        if ids:
            yield close()

    # The last key only splits equal rows, which are the same in any order.
    keys = ["doc_id", "tie", "row"]
    ordered = id_text(docs).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    shards = ordered.select("doc_id", "text").mapInArrow(build, _FILES)
    shards.write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, out: str, checksums: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, and ids (binary, little-endian
    unsigned 32 bit) or, with ``checksums``, ids_crc32, so that ids aren't shuffled."""
    value, kind = ("ids_crc32 long", pa.int64()) if checksums else ("ids binary", pa.binary())

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, data = (batch.column(c)[row].as_py() for c in ("part", "before", "file"))
                shard = Shard.from_bytes(data)
                tokens, ends = shard.tokens.sequence(), np.cumsum(shard.lengths)
                for at in range(0, len(ends), 512):
                    some = slice(at, at + 512)
                    ids = [tokens[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[some].tolist(), shard.lengths[some].tolist(), strict=True)]
                    values = list(map(zlib.crc32, ids)) if checksums else ids
                    columns = [[part] * len(ids), shard.doc_ids[some], before + ends[some] - shard.lengths[some], shard.lengths[some], values]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "doc_id", "at", "n_tokens", value.split()[0]])

    files = spark.read.schema(_FILES).parquet(out)
    # Tokens of the tasks before, over a row for each task.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    if (files.agg(F.max("part")).first()[0] or 0) < TASKS:
        starts = F.broadcast(starts)
    found = files.select("part", "before", "file").mapInArrow(decode, f"part int, doc_id long, at long, n_tokens long, {value}")
    return found.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", value.split()[0])


def digest(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    out = scratch_folder(spark, "tokens")
    write_tokens(docs, path, out)
    return read_tokens(spark, out, checksums=True)
