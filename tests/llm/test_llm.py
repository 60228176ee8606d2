"""Each operator against a brute-force version, on odd rows and on a small table."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tidelog.llm import byte_bpe, common, components, decontamination, exact_dedup, language_id, quality, queries, simhash, substring_dedup, token_counts, token_files, tool_calls

SPACE = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that operators use themselves, in an order of their own.
ODD = "kept string, doc_id long, score double, text string, h string, fp long, row string, lang string, source string, n_chars long, copies int"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(9000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnd again it does."), (2, "the quick  brown fox jumps\tover the lazy dog.\nAnd again it does."), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG),
    (8, LONG + " tail"), (9, "ÄÖÜ straße 漢字 émoji 🙂 don't we'll it's  <|endoftext|> </s> ▁x"), (10, "a b"), (10, "a b"), (None, "no id here"), (None, None), (12, "x" * 3000), (13, "a a a a a a a a a a a a a a a a a a a a a a a a a"),
    (14, "12345 67,8!! ??\r\n\x0b\x0c end"), (15, "a b"), (16, "A B"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("z", i, 0.5, t, "h", 7, "r", None if i is None or i % 4 == 0 else "en", None, None, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, ODD).repartition(3).transform(common.checkpointed)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def got(df, *columns):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns or df.columns).collect()), key=repr)


def both(odd, table, texts):
    return [(odd, TEXTS), (table, texts)]


# 1


def test_token_counts(odd, table, texts, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df, rows in both(odd, table, texts):
        expected = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows]
        assert got(token_counts.count_tokens(df, path)) == sorted(expected, key=repr)
    assert got(token_counts.count_tokens(odd, path, block=50)) == got(token_counts.digest(odd, path))
    assert token_counts.digest(empty, path).count() == 0


def test_pre_tokens_are_counted_alike():
    own = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    rng, parts = random.Random(1), ["a", " ", "  ", "\n", "\t", "é", "漢", "▁", "</s>", "<0x0A>", "word", "\x00", "🙂"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert sum(own.count(token_counts.pre_tokens(text))) == len(own.model.encode(text))


def test_runs_without_white_space_are_one_pre_token(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "ab-漢" * 50_000
    df = spark.createDataFrame([(1, text), (2, text + " x"), (2, None)], "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert len(token_counts.pre_tokens(text)) == 1
    assert got(token_counts.digest(df, path), "doc_id", "n_tokens") == sorted([(1, len(sp.encode(text))), (2, len(sp.encode(text + " x"))), (2, 0)])


def test_counts_refuse_a_changing_input(spark):
    import pyarrow as pa

    with pytest.raises(RuntimeError):
        token_counts._add_up(pa.table({"block": pa.array([], pa.int64())}), pa.table({"counted": [5]}))


# 2


def call(i, turn, name="t", args='{"n":1}', needs=(), conv=1):
    return (conv, i, turn, name, args, list(needs))


def linked(spark, calls, results=(), schemas=(("t", "n", "integer", True, 5.0),)):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((calls, tool_calls.CALLS), (results, tool_calls.RESULTS), (schemas, tool_calls.SCHEMAS))]
    return {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_calls(*frames).collect()}


def test_tool_calls_are_linked_and_ordered(spark):
    chain = [call(f"k{i}", i, needs=[f"k{i - 1}"] if i else [], conv=2) for i in range(40)]
    calls = [call("a", 0), call("b", 1, needs=["a"]), call("c", 2, needs=["a", "b"]), call("d", 3, needs=["c", "b", "gone"]), call("x", 4, needs=["y"]), call("y", 5, needs=["x"]), call("z", 6, needs=["x", "a"]), call(None, 7), call(" ", 8), call("a", 9)]
    results = [(1, "a", 1, "one"), (1, "a", 5, "later"), (1, "q", 2, "stray"), (1, "b", 1, "early"), (None, None, 1, "lost")]
    r = linked(spark, calls + chain, results)
    assert {k[1]: (v["status"], v["level"]) for k, v in r.items() if k[0] == 1} == {
        "a": ("linked", 0), "b": ("result_before_call", 1), "c": ("no_result", 2), "d": ("no_result", 3), "x": ("cyclic", None), "y": ("cyclic", None), "z": ("cyclic", None),
        "q": ("orphan_result", None), None: ("unidentified", None), " ": ("unidentified", None),
    }
    assert [r[(2, f"k{i}")]["level"] for i in range(40)] == list(range(40))
    assert r[(1, "a")]["message"] == '{"arguments":{"n":1},"id":"a","name":"t","result":"one"}'
    assert r[(1, "d")]["errors"] == ["unknown_dependency:gone"] and r[(1, "q")]["message"] is None


def test_tool_arguments(spark):
    schemas = [("t", "n", "integer", True, 5.0), ("t", "s", "string", False, 3.0), ("t", "f", "number", False, None), ("t", "b", "boolean", False, None), ("t", "o", "object", False, None), ("t", "l", "array", False, None)]
    cases = {
        '{"n":1}': [], '{"n":9}': ["maximum:n"], '{"n":"1"}': ["type:n"], '{"s":"abcd"}': ["maximum:s", "missing:n"], '{"n":1,"zz":2}': ["unexpected:zz"], '{"n":1,"f":1.5,"b":true,"o":{"a":[1]},"l":[1]}': [],
        '{"n":1,"b":1,"o":[],"l":{}}': ["type:b", "type:l", "type:o"], "[1]": ["not_an_object"], "{bad": ["not_an_object"], '{"n":null}': ["type:n"],
    }
    r = linked(spark, [call(f"c{k}", k, args=a) for k, a in enumerate(cases)] + [call("nil", 99, args=None), call("u", 98, name="other"), call("v", 97, name=None)], schemas=schemas)
    assert [r[(1, f"c{k}")]["errors"] for k in range(len(cases))] == list(cases.values())
    assert [r[(1, i)]["errors"] for i in ("nil", "u", "v")] == [["not_an_object"], ["unknown_tool"], ["unknown_tool"]]
    assert r[(1, "c5")]["message"].startswith('{"arguments":{"b":true,"f":1.5,"l":[1],"n":1,"o":{"a":[1]}},"id":"c5"')
    assert r[(1, "c8")]["message"].startswith('{"arguments":"{bad","id"') and '"arguments":null' in r[(1, "nil")]["message"]
    assert linked(spark, []) == {}
    assert linked(spark, [call("a", 0, conv=None), call("b", 1, needs=["a"], conv=None)], [(None, "a", 3, "r")])[(None, "a")]["status"] == "linked"


def test_repeated_calls_and_results_each_give_a_row(spark):
    calls = [call("a", 2), call("a", 2), call("a", 6, needs=["gone"]), call("b", 3), call(None, 4), call("c", None), call("c", 5)]
    results = [(1, "a", 1, "early"), (1, "a", 5, "later"), (1, "a", 4, "right"), (1, "a", 4, "right"), (1, "b", None, "undated"), (1, "b", 9, "dated"), (1, "q", 2, "x"), (1, "q", 2, "x"), (1, None, 3, "lost"), (1, "c", 5, "same")]
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in ((calls, tool_calls.CALLS), (results, tool_calls.RESULTS), ([("t", "n", "integer", True, 5.0)], tool_calls.SCHEMAS))]
    rows = got(tool_calls.link_calls(*frames), "call_id", "turn", "status", "level", "valid", F.array_join("errors", ","), F.get_json_object("message", "$.result"))
    assert rows == sorted([
        ("a", 2, "linked", 0, True, "", "right"), ("a", 2, "duplicate_call", None, False, "duplicate_call", None), ("a", 6, "duplicate_call", None, False, "duplicate_call,unknown_dependency:gone", None),
        ("a", 1, "duplicate_result", None, False, "duplicate_result", None), ("a", 4, "duplicate_result", None, False, "duplicate_result", None), ("a", 5, "duplicate_result", None, False, "duplicate_result", None),
        ("b", 3, "linked", 0, True, "", "dated"), ("b", None, "duplicate_result", None, False, "duplicate_result", None), (None, 4, "unidentified", None, False, "no_identifier", None),
        ("c", 5, "result_before_call", 0, True, "", "same"), ("c", None, "duplicate_call", None, False, "duplicate_call", None),
        ("q", 2, "orphan_result", None, False, "no_call", None), ("q", 2, "orphan_result", None, False, "no_call", None), (None, 3, "unidentified", None, False, "no_identifier", None),
    ], key=repr)


def test_conversations_with_odd_rows(spark):
    rows = [("x", 1, 0, "user", "hi"), ("x", 1, 1, "assistant", None), ("x", 2, 0, None, "?"), ("x", None, 0, "user", None), ("x", 3, None, "user", "t"), ("x", 1, 0, "user", "hi"), ("x", 4, 5, "assistant", "alone")]
    df = spark.createDataFrame(rows, "level string, conv_id long, turn long, role string, text string")
    every = tool_calls.digest(df).collect()
    assert len(every) == len(rows) - 1  # one result stands in its call's row
    r = {(x["conv_id"], x["call_id"], x["status"]): x for x in every}
    assert (1, "c0", "linked") in r and (1, "c0", "duplicate_call") in r and (4, "c4", "orphan_result") in r and r[(None, "c0", "no_result")]["valid"]
    assert (3, None, "unidentified") in r and (2, None, "unknown_role") in r and len(r) == 6
    assert tool_calls.digest(df.where("false")).count() == 0


def test_sql_of_conversations_has_the_same_cases(spark, same):
    import duckdb

    rows = [(1, 0, "system", "be"), (1, 0, "user", "first"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "next"), (1, 2, "user", "next"), (1, 3, "tool", "x"), (1, 3, None, None), (1, 4, "developer", "y")]
    rows += [(None, 0, "user", None), (None, 1, "assistant", "r"), (2, None, "user", "t"), (2, None, "assistant", "t"), (2, 5, "assistant", "alone"), (3, 7, "user", "z" * 400), (3, 1, "user", ""), (3, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    con = duckdb.connect()
    conversations = df.toArrow()  # noqa: F841  read by name
    con.register("conversations", conversations)
    same(tool_calls.digest(df), con.sql(tool_calls.SQL))


def plain_levels(needs):
    levels, left = {}, dict(needs)
    while ready := [k for k, d in left.items() if all(x in levels for x in d)]:
        for k in ready:
            levels[k] = max((levels[x] + 1 for x in left.pop(k)), default=0)
    return levels


@pytest.mark.parametrize("bits", [10, 2])
def test_ladders_take_a_round_for_each_block(spark, monkeypatch, bits):
    monkeypatch.setattr(tool_calls, "BLOCK_BITS", bits)
    rng, needs = random.Random(11), {}
    for k in range(24):
        needs[f"a{k}"] = [f"{s}{k - 1}" for s in "ab"] if k else []
        needs[f"b{k}"] = [f"{s}{k - 1}" for s in "ab"] if k else []
    for k in range(60):
        needs[f"r{k}"] = [f"r{j}" for j in rng.sample(range(60), rng.randint(0, 3)) if j < k or (k, j) in ((5, 50), (6, 51))]
    needs |= {"x": ["y", "a0"], "y": ["x", "a1"], "z": ["x", "a2"]}
    turns = {n: int(n[1:] or 0) for n in needs}
    nodes = spark.createDataFrame([(n, turns[n]) for n in needs], "node string, turn long")
    edges = spark.createDataFrame([(n, d) for n, ds in needs.items() for d in ds], "node string, needs string")
    rounds, settle = [], tool_calls.checkpointed
    monkeypatch.setattr(tool_calls, "checkpointed", lambda df: rounds.append(1) or settle(df))
    found = {r["node"]: r["level"] for r in tool_calls.topological_levels(nodes, edges).collect()}
    expected = plain_levels(needs)
    assert found == {n: expected.get(n) for n in needs}
    assert bits < 10 or len(rounds) < 30


def test_tool_calls_use_no_python(spark, sf, monkeypatch):
    plans, cut = [], tool_calls.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(tool_calls, "checkpointed", noted)
    plans.append(queries.op2_tool_calls(spark, sf)._jdf.queryExecution().executedPlan().toString())
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c"), ("d", "b")], "node string, needs string")
    tool_calls.topological_levels(spark.createDataFrame([(n, 0) for n in "abcd"], "node string, turn long"), edges).collect()
    assert len(plans) > 15 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


# 3


def test_token_files(odd, table, texts, empty, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for k, (df, rows) in enumerate(both(odd, table, texts)):
        out = str(tmp_path / f"t{k}")
        token_files.write_tokens(df, path, out, shard=5000)
        back = token_files.read_tokens(spark, out)
        expected = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows]
        assert got(back, "doc_id", "ids") == sorted(expected, key=repr)
        ordered = [r for r in back.orderBy("start").collect()]
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
        assert keys == sorted(keys) and [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
        assert got(token_files.digest(df, path)) == sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in ordered), key=repr)
    assert token_files.digest(empty, path).count() == 0


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_are_dealt_to_several_tasks(spark, tmp_path, uncoalesced):
    rows = [(7, "same words here")] * 300 + [(None, f"no id {k % 5}") for k in range(300)] + [(k, f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).transform(common.checkpointed)
    out, path = str(tmp_path / "equal"), public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(df, path, out, shard=200)
    sizes = [r[0] for r in spark.read.parquet(out).groupBy("part").agg(F.sum("n_docs")).collect()]
    assert len(sizes) > 2 and max(sizes) < 450
    back = sorted(token_files.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in back] == np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1].tolist()
    plan = token_files.read_tokens(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


def test_words_are_encoded_as_texts_are():
    coder = token_files.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng, parts = random.Random(2), ["a", "The", " ", "\n", "é", "́", "Σ", "漢", "'re", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\x0b", "12", "🙂"]
    parts += [",", "end.", "x)!", "'", "<|", "\u0130"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(10)]
        found = coder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, coder.dtype).tolist() for x in found] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_each_distinct_word_of_a_column_is_looked_up_once(monkeypatch):
    class Counting(dict):
        asked = 0

        def get(self, *args):
            Counting.asked += 1
            return dict.get(self, *args)

    coder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    one = lambda t: coder.tokenizer.encode(t, add_special_tokens=False).ids
    coder._numbers = Counting()
    for direct in (True, False):
        assert coder._direct
        monkeypatch.setattr(coder, "_direct", direct)
        for texts in (["The word the WORD, " * 500, "word"], ["", " x", "y \n"], [""], [], [f"a{chr(k)}b" for k in range(1, 128)], ["A<|endoftext|>b <|ENDOFTEXT|> a<|", "AB"]):
            ids, ends = coder.encode_column(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == [one(t) for t in texts]
            if len(texts) == 2 and texts[1] == "word":
                assert Counting.asked == 4  # the, word, "word," and nothing, after the last space
            Counting.asked = 0
        monkeypatch.setattr(token_files, "CACHE", 3)  # from now on words are forgotten each time
        ids, ends = coder.encode_column(pa.array(["new words once more and the rest"]))
        assert ids.tolist() == one("new words once more and the rest") and len(coder._numbers) == 7
        monkeypatch.undo()
        coder._forget()
        coder._numbers = Counting()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 40, n).astype(np.uint16)
    built = token_files.WaveletMatrix.build(ids, 16)
    m = token_files.WaveletMatrix.from_bytes(built.to_bytes(), n, 16)
    assert (m.sequence() == ids).all()
    for i in range(0, n, 41):
        assert m.access(i) == ids[i] and m.rank(7, i) == (ids[:i] == 7).sum()
    assert m.positions(7) == np.flatnonzero(ids == 7).tolist() and m.count(60_000) == 0
    for bad in (-1, m.count(7)):
        with pytest.raises(IndexError):
            m.select(7, bad)
    with pytest.raises(IndexError):
        m.access(n)


# 4


def test_language_id(spark, sf, table, odd, empty):
    rows = language_id.digest(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert len(rows) == table.count() and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
    model = language_id.learn(table)
    assert 0 < (model.weights != 0).mean() < 0.5
    found = got(language_id.identify(odd, model), "doc_id", "lang_pred", "score")
    assert len(found) == len(TEXTS) and [r[1:] for r in found if r[0] in (3, 4, 5)] == [("und", 0.0)] * 3
    assert {r[1] for r in got(language_id.digest(odd.withColumn("lang", F.lit(None).cast("string"))), "doc_id", "lang_pred")} == {"und"}
    assert language_id.digest(empty).count() == 0


def test_language_id_learns_once_from_a_repeated_row(table, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda sample, idf: sorted((y, at.tolist()) for at, _, y in sample))
    some = table.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id < 60")
    once = language_id.learn(some)
    assert once and language_id.learn(some.unionByName(some)) == once


def test_rare_languages_are_learned(spark):
    langs = [f"l{k:03}" for k in range(205)]
    rows = [(k * 20 + j, f"{lang} {lang[::-1]} {chr(0x4E00 + k) * 3}", lang) for k, lang in enumerate(langs) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df, 2)
    assert model.languages == langs
    assert [language_id.predict(t, model)[0] for _, t, _ in rows[::12]] == langs
    one = language_id.learn(df.where("doc_id < 200"), 5, 3)
    assert one.languages == langs[:10] and [language_id.predict(t, one)[0] for _, t, _ in rows[:120:12]] == langs[:10]


def plain_features(text):
    """{feature: times}, gram by gram, in whole numbers."""
    low = "".join(" " if ord(c) < 128 and not c.isalpha() else c for c in f" {text.lower()} ")
    mix, out = [int(x) for x in language_id._MIX], {}
    for n in (1, 2, 3):
        for k in range(len(low) - n + 1):
            h = ord(low[k]) * mix[0]
            for c in low[k + 1 : k + n]:
                h = h * mix[1] + ord(c) * mix[0]
            f = ((h + n) * mix[2]) % 2**64 >> (64 - language_id.BITS)
            out[f] = out.get(f, 0) + 1
    return out


def plain_softmax(z):
    e = [np.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


class PlainModel:
    """TF-IDF, FTRL-proximal with elastic net, and a temperature: one number after another."""

    def __init__(self, rows, order):
        self.langs = sorted({y for _, y in rows})
        counted = [(plain_features(t), self.langs.index(y)) for t, y in rows]
        self.n, self.df = len(rows), {}
        for f, _ in counted:
            for g in f:
                self.df[g] = self.df.get(g, 0) + 1
        sample = [(self.weights_of(f), y) for f, y in (counted[k] for k in order)]
        train, aside = [r for k, r in enumerate(sample) if k % language_id.ASIDE], sample[:: language_id.ASIDE]
        known = {y for _, y in train}
        train, aside = train + [r for r in aside if r[1] not in known], [r for r in aside if r[1] in known]
        self.z, self.sq = {}, {}
        for epoch in range(language_id.EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(train)):
                x, y = train[k]
                p = plain_softmax(self.logits(x))
                step = [(g, c, v * (p[c] - (c == y)), self.w(g, c)) for g, v in [*x.items(), (None, 1.0)] for c in range(len(self.langs))]
                for g, c, d, w in step:
                    old = self.sq.get((g, c), 0.0)
                    self.z[g, c] = self.z.get((g, c), 0.0) + d - (np.sqrt(old + d * d) - np.sqrt(old)) / language_id.ALPHA * w
                    self.sq[g, c] = old + d * d
        losses = [(sum(-np.log(plain_softmax([v / t for v in self.logits(x)])[y] + 1e-12) for x, y in aside), t) for t in np.geomspace(0.05, 5, 80)]
        self.temperature = min(losses)[1]

    def weights_of(self, times):
        x = {g: (1 + np.log(n)) * (np.log((1 + self.n) / (1 + self.df.get(g, 0))) + 1) for g, n in times.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()}

    def w(self, g, c):
        z, l1, l2 = self.z.get((g, c), 0.0), *((0, 0) if g is None else (language_id.L1, language_id.L2))
        return 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((language_id.BETA + np.sqrt(self.sq.get((g, c), 0.0))) / language_id.ALPHA + l2)

    def logits(self, x):
        return [sum(v * self.w(g, c) for g, v in x.items()) + self.w(None, c) for c in range(len(self.langs))]

    def predict(self, text):
        p = plain_softmax([v / self.temperature for v in self.logits(self.weights_of(plain_features(text)))])
        return self.langs[p.index(max(p))], max(p)


def test_language_id_against_a_plain_version(spark):
    words = {"aa": "the of and to a in", "bb": "der die und in zu den", "cc": "я не что в и 漢字"}
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(words[lang].split(), k=rng.randint(2, 7))) + rng.choice(["", " 12!", "\n"]), lang) for k in range(70) for lang in [rng.choice(list(words))]]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert 30 < len(learned) < len(rows)
    plain = PlainModel([r[1:] for r in learned], np.random.default_rng(0).permutation(len(learned)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.learn(df)
    assert np.isclose(model.temperature, plain.temperature)
    for r in language_id.identify(df, model).collect():
        lang, p = plain.predict(rows[r["doc_id"]][1])
        assert r["lang_pred"] == lang and np.isclose(r["score"], p, atol=1e-9)


def test_the_sample_of_a_language_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda sample, idf: [(y, len(at)) for at, _, y in sample])
    rows = [(k, "".join(chr(0x4E00 + k * 40 + j) for j in range(30)), f"l{k % 2}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every, some = language_id.learn(df), language_id.learn(df, pairs=1000)
    for lang in ("l0", "l1"):
        assert sum(n for y, n in every if y == lang) > 500 >= sum(n for y, n in some if y == lang) > 300
    assert sorted(y for y, _ in language_id.learn(df, pairs=1)) == ["l0", "l1"]


# 5


def test_quality(spark, sf, table, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.digest(table, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == table.count() and all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([rows[i]["predicted"] == y for i, y in truth.items()]) > 0.9
    model = quality.learn(table, labels)
    found = quality.score(odd, model).collect()
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4)}) == 1
    none = spark.createDataFrame([(1, None, 1), (2, 7, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    assert {r["score"] for r in quality.digest(odd, none).collect()} == {0.5}
    assert quality.digest(empty, labels).count() == 0
    kept = quality.drop_rejected(odd, labels)
    assert kept.columns == odd.columns
    again = quality.learn(table.unionByName(table), labels)
    assert (again.weights == model.weights).all() and again.slope == model.slope


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        weights = {}
        for code in range(2**n):
            path = [code >> k & 1 for k in range(n)]
            weights[tuple(path)] = np.exp(sum(s * y for s, y in zip(scores, path, strict=True)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        expected = [sum(w for p, w in weights.items() if p[k]) / sum(weights.values()) for k in range(n)]
        assert np.allclose(quality.marginals(scores, moves), expected)


def brute_likelihood(texts, golds, params):
    """Log likelihood of the lines' labels, over all labellings of each text."""
    own, total = quality.OWN, 0.0
    w, moves = params[: quality.SIZE], params[quality.SIZE :].reshape(2, 2)
    for bins, gold in zip(texts, golds, strict=True):
        n = len(bins)

        def score(path):
            s = sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
            for t in (t for t in range(n) if path[t]):
                near = [(0, t)] + [(1, t - 1)] * (t > 0) + [(2, t + 1)] * (t + 1 < n)
                s += sum(w[k * own + f] for k, u in near for f in bins[u] if f >= 0) + w[3 * own] + (w[3 * own + 1] if t == 0 else 0) + (w[3 * own + 2] if t == n - 1 else 0)
            return s

        every = [score([code >> k & 1 for k in range(n)]) for code in range(2**n)]
        total += score(list(gold)) - np.log(np.exp(every).sum())
    return total


def test_gradient_of_the_fit_against_differences():
    rng = np.random.default_rng(1)
    texts = [quality.line_bins(t)[0] for t in ("one line", "a b\nC D 12!!\na b", "x\n\nThe end.\nTHE END\n??", "", "q\nq")]
    golds = [rng.integers(0, 2, len(b)) for b in texts]
    params = rng.normal(size=quality.SIZE + 4) / 3
    found = quality.gradient(quality.Lines(texts), np.concatenate(golds), params)
    used = np.flatnonzero(found)
    for at in [*used[:: max(1, len(used) // 40)], *range(quality.SIZE - 3, quality.SIZE + 4), 5]:
        step = np.zeros_like(params)
        step[at] = 1e-5
        slope = (brute_likelihood(texts, golds, params + step) - brute_likelihood(texts, golds, params - step)) / 2e-5
        assert abs(slope - found[at]) < 1e-6


def test_document_quality_is_weighted_by_length():
    bins, lengths = quality.line_bins("a long line of words that stands first\nno\n12345 !!!")
    model = quality.Model(np.random.default_rng(2).normal(size=quality.SIZE), np.array([[0.3, -0.2], [0.1, 0.5]]), 1.5, -0.4)
    good = quality.marginals(quality.emissions(bins, model.weights), model.moves)
    mean = sum(g * (n + 1) for g, n in zip(good, (38, 2, 9), strict=True)) / (39 + 3 + 10)
    assert np.isclose(quality.document_quality(bins, lengths, model), np.log(mean / (1 - mean)))
    assert np.isclose(quality.probability(bins, lengths, model), 1 / (1 + np.exp(-(1.5 * np.log(mean / (1 - mean)) - 0.4))))


def test_long_labelled_texts_are_passed_over_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda sample: sorted((len(n), y) for _, n, y in sample))
    docs = spark.createDataFrame([(k, "x\n" * (k % 7)) for k in range(1, 60)] + [(61, "y\n" * 500)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    every = quality.learn(docs, labels)
    assert (501, 1) in every
    some = quality.learn(docs, labels, most_lines=60)
    assert 55 <= sum(n for n, _ in some) <= 60 and not set(some) - set(every) and quality.learn(docs, labels, most_lines=501 + 7)
    assert quality.learn(docs, labels, most_lines=0) == []


# 6


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    top = {f: f for f in distinct}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                top[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=repr)


@pytest.mark.parametrize("leaf", [8192, 4])
def test_simhash(odd, table, texts, empty, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    for df, rows in both(odd, table, texts):
        assert got(simhash.digest(df)) == brute_components(rows)
    assert simhash.digest(empty).count() == 0


@pytest.mark.parametrize("leaf", [8192, 6])
def test_trie_finds_all_links(spark, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = dict(tuple(r) for r in components.connected(simhash.near_links(df)).collect())
    groups = {}
    for v in signed:
        groups.setdefault(roots.get(v, v), set()).add(v)
    unsigned = lambda v: v & (2**64 - 1)
    for a in signed:
        for b in signed:
            if (unsigned(a) ^ unsigned(b)).bit_count() <= 2:
                assert roots.get(a, a) == roots.get(b, b)
    links = {(r["a"], r["b"]) for r in simhash.near_links(df).collect()}
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 2 for a, b in links)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    roots = dict(tuple(r) for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(roots[k] == 0 for k in range(51)) and all(roots[1000 + k] == 1000 for k in range(30)) and roots[501] == 500
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_keeps_one_of_each_group(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    groups = {}
    for i, _, c in brute_components(TEXTS):
        groups.setdefault(c, i)
    assert len(ids) == len({c for _, _, c in brute_components(TEXTS) if c is not None}) + len({f for _, f, c in brute_components(TEXTS) if c is None})


# 7


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_substring_dedup(odd, table, texts, empty, block):
    for df, rows in both(odd, table, texts):
        found = substring_dedup.remove_repeats(df, block, 1 << 10).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
        assert got(found) == brute_repeats(rows)
    assert substring_dedup.digest(empty).count() == 0


def test_null_and_repeated_ids_and_equal_rows(spark):
    rng = random.Random(9)
    pieces = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 40))) for _ in range(12)]
    rows = [(1, pieces[0] + " " + pieces[1])] * 60 + [(None, f"{rng.choice(pieces)} {rng.choice(pieces)}") for _ in range(60)] + [(k % 20, f"{k} {rng.choice(pieces)} {rng.choice(pieces)}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (1 << 22, 500):
        found = substring_dedup.remove_repeats(df, block, 64).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
        assert got(found) == brute_repeats(rows)


def test_every_shift_shares_an_anchor():
    d, n = set(substring_dedup.COVER), substring_dedup.PERIOD
    assert substring_dedup.ANCHOR + n - 1 <= substring_dedup.WIDTH
    assert all(any((i + k) % n in d and (j + k) % n in d for k in range(n)) for i in range(n) for j in range(n))


# 8


def brute_hits(rows, items):
    clean = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = clean(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = clean(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "jumps over the lazy dog and again it does the"), (2, "JUMPS OVER"), (2, "jumps-over"), (None, "x2 word3 x3"), (4, None), (5, "!!"), (6, " ".join(LONG.split()[100:130])), (10, "straße")]


@pytest.mark.parametrize("block_words", [2_000_000, 5])
def test_decontamination(spark, sf, duck, odd, table, texts, empty, block_words):
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, hits string, doc_id string")
    pairs = [(odd, TEXTS, items, ITEMS)]
    if block_words > 5:
        pairs.append((table, texts, spark.read.parquet(f"{sf}/benchmark.parquet"), duck.sql("SELECT item_id, text FROM benchmark").fetchall()))
    for df, rows, bench, own in pairs:
        found = decontamination.benchmark_hits(df, bench, block_words=block_words)
        expected = brute_hits(rows, own)
        cut = sorted(((r["doc_id"], r["n_words"], len(r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect()), key=repr)
        assert cut == sorted((e[:5] for e in expected), key=repr)
        kept = decontamination.drop_contaminated(df, bench, block_words)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted((e[0] for e in expected if not e[5]), key=repr)
    assert got(decontamination.digest(odd, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(TEXTS, ITEMS)
    assert decontamination.digest(empty, items).count() == 0
    assert decontamination.digest(odd, items.where("false")).where("contaminated").count() == 0


def test_long_items_are_cut_without_losing_windows(spark):
    long = [(1, " ".join(f"w{k}" for k in range(400))), (2, "w5 w6"), (3, None)]
    items = spark.createDataFrame(long, "item_id long, text string")
    blocks = list(decontamination._blocks(items, 13, 60))
    assert len(blocks) > 6 and all(sum(len(w) for _, w in b) <= 60 for b in blocks)
    rows = [(k, " ".join(f"w{j}" for j in range(k, k + 13 + k % 3))) for k in range(0, 380, 7)] + [(999, "w1 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.benchmark_hits(docs, items, block_words=60)
    cut = sorted((r["doc_id"], r["n_words"], len(r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect())
    assert cut == sorted(e[:5] for e in brute_hits(rows, long))


# 9


@pytest.fixture(scope="module")
def reference_codec():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 40)])
def test_byte_bpe(odd, table, texts, empty, reference_codec, chunk, overlap):
    path, encoding = reference_codec
    for df, rows in both(odd, table, texts):
        coded = byte_bpe.decode_ids(byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN, chunk, overlap), path, public_tokenizers.PATTERN)
        expected = [(i, len(x), np.array(x, "<u4").tobytes(), (t or "").encode()) for i, t in rows for x in [encoding.encode_ordinary(t or "")]]
        assert got(coded, "doc_id", "n_tokens", "ids", "decoded") == sorted(expected, key=repr)
        both_ways = byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN, chunk, overlap, decode=True)
        assert got(both_ways, "doc_id", "n_tokens", "ids", "decoded") == sorted(expected, key=repr)
    assert byte_bpe.digest(empty, path, public_tokenizers.PATTERN).count() == 0


def test_chunks_are_stitched(reference_codec):
    path, encoding = reference_codec
    coder = byte_bpe.codec(path, public_tokenizers.PATTERN)
    rng, parts = random.Random(4), ["a", "'", "r", "e", " ", "   ", "\n", "1", "!", "é", "漢", "'re", "x" * 30, " " * 25, "🙂"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 100)))
        size, overlap = rng.choice([(5, 3), (8, 4), (16, 7), (7, 30), (1, 5)])
        cut = byte_bpe.cut(text, size, overlap)
        chunks = [(s, byte_bpe.encode_chunk(coder, s, x, k + 1 == len(cut))) for k, (s, x) in enumerate(cut)]
        assert np.frombuffer(byte_bpe.stitch(coder, chunks), "<u4").tolist() == encoding.encode_ordinary(text)
        s, c = chunks[0]
        back = byte_bpe.unpack(s, byte_bpe.pack(c))
        assert (back.bounds == c.bounds).all() and (back.counts == c.counts).all() and (back.ids, back.text) == (c.ids, c.text)
    assert regex.compile(public_tokenizers.PATTERN)


def test_characters_that_the_library_does_not_know(reference_codec):
    path, encoding = reference_codec
    coder = byte_bpe.codec(path, public_tokenizers.PATTERN)
    rng, parts = random.Random(5), ["a", "'s", " ", "!", "1", "é", "\U00010ec6", "\U00010ee1", "\u2028", "\x1d", *sorted(coder.newer)[:3]]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


# 10


def brute_groups(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for norm, members in groups.items():
        first = min(members)
        keep = rows[first[3]][0]
        out += [(rows[m[3]][0], keep, len(members), m == first, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def weak(norm):
    return F.substring(F.md5(norm.cast("binary")), 1, 1).cast("binary")


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_bits, weak])
def test_exact_dedup(odd, table, texts, empty, content_hash):
    for df, rows in both(odd, table, texts):
        assert got(exact_dedup.exact_groups(df, content_hash).drop("h")) == brute_groups(rows)
    assert exact_dedup.digest(empty).count() == 0


def test_exact_dedup_keeps_whole_rows(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in brute_groups(TEXTS) if r[3]), key=repr)


def test_exact_dedup_keeps_the_longest_row_of_a_repeated_id(spark):
    rows = [(i % 5, f"t{i % 5} x" + " " * k) for i in range(5) for k in (0, 3, 9, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(exact_dedup.drop_copies(df)) == [(i, f"t{i} x" + " " * 9) for i in range(5)]


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, same, name):
    same(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))


def test_names():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names[:10]] == list(range(1, 11)) and names[10:] == ["pipeline"]


def test_pipeline(spark, sf, duck, texts, reference_codec):
    """Against a chain of the brute-force versions; the classifier's verdicts are its own."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = [(i, t) for i, t in texts if quality.probability(*quality.line_bins(t or ""), model) >= quality.THRESHOLD]
    keep = {r[0] for r in brute_groups(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    keep = {i for i, _, c in brute_components(rows) if i == c}
    rows = [r for r in rows if r[0] in keep]
    dirty = {r[0] for r in brute_hits(rows, duck.sql("SELECT item_id, text FROM benchmark").fetchall()) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    encoding = reference_codec[1]
    expected = [
        (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows for x in [encoding.encode_ordinary(t)]
    ]
    assert 0 < len(expected) < len(texts)
    assert got(corpus_pipeline.run(spark, sf)) == sorted(expected, key=repr)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "decontamination", "byte_bpe"]


def test_stages_take_odd_tables(spark, sf, odd, empty):
    import corpus_pipeline

    for df in (odd, empty):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == df.columns
                docs = common.checkpointed(out)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() > 0) == (df is odd)
