"""Operator 4, language ID: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed n-grams of one to three characters, scaled to length one.
Weights are trained by follow-the-regularised-leader (proximal, per coordinate) with L1 and L2
penalties, so that most are exactly zero; a temperature fitted on a part kept aside calibrates the
probabilities.

Learning uses text and non-null lang only, of documents whose crc32(doc_id) mod 3 is not 1.
Document frequencies count all of these. The weights see at most ``PER_LANGUAGE`` documents of each
language, those with the smallest hash of their id, and of these as many as have ``PAIRS`` distinct
n-grams together (each language its share): documented bounds. So that the driver can hold them,
documents are fewer, but no less than one, where there are more than ``SAMPLE`` / ``PER_LANGUAGE``
languages. Every language is learned, from at least one document, whose n-grams are at most
``SIZE`` however long it is. Prediction covers all rows and whole texts in one scan without a
shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if
there is nothing to learn from; a null doc_id is neither learned from nor held out; repeated rows
each give a row, and one of them is learned from; ties go to the language that sorts first; other
columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import as_text, id_text, remainder, slices

HELD_OUT, FOLDS = 1, 3
PER_LANGUAGE, SAMPLE, PAIRS = 1000, 200_000, 8_000_000
SHARES = 64
BITS = 15
SIZE = 1 << BITS
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
#: Every so manieth sampled text sets the temperature and no weights, if its language has others.
ASIDE = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_PLAIN = np.array([ord(" ") if c < 0x80 and not chr(c).isalpha() else c for c in range(0x80)], dtype=np.uint32)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature, language
    bias: np.ndarray
    temperature: float


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, times) of a text's n-grams."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.where(codes < 0x80, _PLAIN[np.minimum(codes, 0x7F)], codes).astype(np.uint64)
    runs, found = codes * _MIX[0], []
    for n in range(1, 4):
        if n > 1:
            runs = runs[: len(codes) - n + 1] * _MIX[1] + codes[n - 1 :] * _MIX[0]
        found.append(((runs + np.uint64(n)) * _MIX[2]) >> np.uint64(64 - BITS))
    times = np.bincount(np.concatenate(found).astype(np.int64), minlength=SIZE)
    at = np.flatnonzero(times)
    return at, times[at]


def weigh(at: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(sample: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> Model:
    """From (features, times, language) of each text, in a fixed order."""
    languages = sorted({y for *_, y in sample})
    if not languages:
        return Model([], idf, np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    rows = [(at, weigh(at, times, idf), languages.index(y)) for at, times, y in sample]
    train, aside = [r for k, r in enumerate(rows) if k % ASIDE], rows[::ASIDE]
    known = {y for *_, y in train}
    train, aside = train + [r for r in aside if r[2] not in known], [r for r in aside if r[2] in known]
    # The last row stands for the bias, which isn't penalised.
    z, n = np.zeros((SIZE + 1, len(languages))), np.zeros((SIZE + 1, len(languages)))

    def solved(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        l1, l2 = np.where(at == SIZE, 0, L1)[:, None], np.where(at == SIZE, 0, L2)[:, None]
        return np.where(np.abs(pull) <= l1, 0, -(pull - np.sign(pull) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            at, x, y = train[k]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = solved(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    whole = solved(np.arange(SIZE + 1))
    weights, bias = whole[:SIZE], whole[SIZE]
    scores = [(x @ weights[at] + bias, y) for at, x, y in aside]
    scale = np.geomspace(0.05, 5, 80)
    loss = [-sum(np.log(softmax(s / t)[y] + 1e-12) for s, y in scores) for t in scale]
    return Model(languages, idf, weights, bias, float(scale[int(np.argmin(loss))]) if scores else 1.0)


def predict(text: str, model: Model) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return "und", 0.0
    at, times = frequencies(text)
    p = softmax((weigh(at, times, model.idf) @ model.weights[at] + model.bias) / model.temperature)
    k = int(p.argmax())
    return model.languages[k], float(p[k])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE, pairs: int = PAIRS) -> Model:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))

    def count(batches):
        seen, total = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for text in as_text(part.column("text")):
                    seen[frequencies(text)[0]] += 1
                    total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([total, *seen[at].tolist()], pa.int64())], ["feature", "n"])

    # One row for each hashed feature, at most SIZE + 1.
    found = dict(usable.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect())
    total, df = found.pop(-1, 0), np.zeros(SIZE)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    languages = usable.select("lang").distinct().count()
    most = min(per_language, max(1, sample_rows // max(1, languages)))
    # Ranked within shares of a language first, so that a frequent one isn't one task's load.
    keys = usable.select("doc_id", "lang").withColumn("hash", F.xxhash64(F.col("doc_id"), F.lit(4)))
    keys = keys.withColumn("share", F.pmod(F.col("hash"), F.lit(SHARES)))
    for by in (["lang", "share"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("hash", "doc_id"))
        keys = keys.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    # At most sample_rows ids, or one of each language.
    chosen = F.broadcast(keys.select("doc_id", "lang").distinct())

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                made = [frequencies(t) for t in as_text(part.column("text"))]
                columns = [pa.array([x.astype("<i4").tobytes() for x in c], pa.binary()) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *columns], ["doc_id", "lang", "at", "times"])

    made = usable.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(features, "doc_id long, lang string, at binary, times binary")
    # One row of each id, however often it is repeated; in the order of the ids' hashes they are
    # taken while their language has pairs left.
    single = made.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "times")).alias("least")).select("doc_id", "lang", "least.*")
    sample, used, share = [], {}, pairs // max(1, languages)
    for row in single.orderBy("lang", F.xxhash64(F.col("doc_id"), F.lit(4)), "doc_id").toLocalIterator():
        n, so_far = len(row["at"]) // 4, used.get(row["lang"], 0)
        if not so_far or so_far + n <= share:
            used[row["lang"]] = so_far + n
            sample.append((row["doc_id"], row["lang"], bytes(row["at"]), bytes(row["times"])))
    sample.sort()
    order = np.random.default_rng(0).permutation(len(sample))
    return fit([(np.frombuffer(at, "<i4"), np.frombuffer(times, "<i4"), lang) for _, lang, at, times in map(sample.__getitem__, order)], idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                found = [predict(t, shared.value) for t in as_text(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(work, "doc_id long, lang_pred string, score double").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def digest(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
