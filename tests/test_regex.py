"""Translated expressions find what RE2 (DuckDB's engine) finds."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions.regex import RegexError, to_java_regex

TEXTS = [
    "error\n", "error", "an error here\nerror at end", "a\rb", "a\x0bb", "x\n", "\n", "", "[tag] {json: 1}", "a&&b", "tab\there", "ÄÖÜ ß", "user=12 ok", "A-Z^", "aaa", "foo.bar", "line1\nline2\n",
    "back\\slash", "P F stdout", "1.2.3.4", "x{2}", "#hash",
]
PATTERNS = [
    "error$", "(?m)error$", "^error", "(?m)^error", "(?m)^$", "a.b", "(?s)r.e", r"a\sb", r"\s", r"\S+", r"\v", "[[:alpha:]]+$", "[^[:space:]]$", "[[:^digit:]]", r"\pL", r"\p{Lu}", r"\PL", "a{2}", "a{2,}",
    "x{", "x{2}", "[]a]", "[^]a]", "[a&&b]", r"[\s]", r"[^\S]", "[[]", r"\Qa&&b\E", "(?i)USER", "(?i:U)ser", "(?P<n>a)(b|c)?", r"\x41", r"\x{C4}", r"\101", r"\bok\b", r"\{json", "a|", "(a|b)*", "a+?", "[#^-]",
    r"\d+\.\d+", "(?m:^line2$)", "(?-s)a.b", r"\\", "[A-Z^]$",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_as_re2(spark, duck, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(to_java_regex(pattern))).collect()]
    assert got == [duck.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in TEXTS]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a**", "a++", "*a", "(a", "a)", "[a", r"\C", "(?U)a", "a{1001}", "a{3,2}", r"\Z", "[[:nope:]]", "(?>a)", "\\"])
def test_refused(pattern):
    with pytest.raises(RegexError):
        to_java_regex(pattern)
