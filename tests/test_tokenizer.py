"""Tokenizer goldens (hand-derived from the reference's rules) and properties."""

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.functions.tokenizer import DEFAULT, TokenizerConfig, tokenize

GOLDEN = [
    ("@harbor_crew rain!again at#pier#OldTown near the very last kiosk #lanterns :]:D :p www.pierlights.com",
     ["USERNAME", "rain", "!", "again", "at", "pier", "old", "town", "near", "the", "very", "last", "kiosk",
      "lanterns", ":]", ":D", ":p", "URL"]),
    ("sooooo hahahaha AAAAbbb", ["sooo", "hahaha", "AAA", "abbb"]),
    ("Wowwwww a tinyyyy boaaaat <3", ["wowww", "a", "tinyyy", "boaaat", "<3"]),
    ("#HateSpeech", ["hate", "speech"]),
    ("#abc123", ["abc", "NUMBER"]),
    ("2nd 1st", ["NUMBER", "nd", "NUMBER", "st"]),
    ("2024-01-01", ["NUMBER", "NUMBER", "NUMBER"]),
    ("1 / 2", ["NUMBER"]),
    ("1234567abc", ["PHONENUMBER", "abc"]),
    ("bob@x.com", ["bob", "USERNAME", ".", "com"]),
    ("bit.ly", ["URL"]),
    ("bit.ly,", ["bit", ".", "ly", ","]),
    ("http://a.b/c", ["URL"]),
    ("12:30 PM", ["TIME"]),
    ("&amp;lt;", ["&lt", ";"]),
    ("&#65; &#x41;", ["A", "A"]),
    ("&nosuch;", ["&nosuch", ";"]),
    ("I A iPhone", ["I", "A", "i", "phone"]),
    ("co-op2", ["co", "-", "op2"]),
    ("niño", ["ni", "ño"]),
    ("a☀b", ["a", "☀", "b"]),
    ("-xd", ["-", "xd"]),
    ("hi...there ..", ["hi", "...", "there", "..."]),
    ("?!", ["?", "!"]),
    ("Won't", ["won", "'", "t"]),
    ("@ab\u200dc @abe\u0301x", ["USERNAME", "\u200dc", "USERNAME", "\u0301x"]),  # joiners and marks are no word characters
    ("&#55357;&#56832;", ["&", "NUMBER", ";", "&", "NUMBER", ";"]),  # surrogates are no characters
    ("", []),
    ("   ", []),
    (None, []),
]


def _tok(spark, texts, cfg=DEFAULT):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.tok for r in df.select("i", tokenize("t", cfg).alias("tok")).orderBy("i").collect()]


def test_goldens(spark):
    got = _tok(spark, [t for t, _ in GOLDEN])
    for (text, want), g in zip(GOLDEN, got):
        assert g == want, text


def test_long_runs_without_blanks(spark):
    """Nothing in the lexer or the splitter recurses per character."""
    run = "é日" * 300_000
    got = _tok(spark, [run, "a" * 400_000 + "é" * 400_000, "…" * 200_000 + ":)"])
    assert got[0] == [run] and got[1][-1] == "é" * 400_000 and got[2][-1] == ":)"


def test_replacement_policy(spark):
    cfg = DEFAULT.update(usernames="", urls=False, numbers="REMOVE", times="delete", phonenumbers="PHONE")
    got = _tok(spark, ["@bob see bit.ly at 12:30 pm call 555-123-4567 or 42"], cfg)[0]
    assert got == ["see", "bit.ly", "at", "call", "PHONE", "or"]


def test_settings(spark):
    cfg = DEFAULT.update(lowercase=False, normalize=0)
    assert _tok(spark, ["Sooooo COOL"], cfg)[0] == ["Sooooo", "COOL"]
    cfg = DEFAULT.update(allcapskeep=False)
    assert _tok(spark, ["COOL Stuff"], cfg)[0] == ["cool", "stuff"]
    cfg = DEFAULT.update(ignorestopwords=True)
    assert _tok(spark, ["i like the Cat"], cfg)[0] == ["like", "cat"]
    cfg = DEFAULT.update(ignorequotes=True)
    assert _tok(spark, ['he said "go away" now'], cfg)[0] == ["he", "said", "now"]
    with pytest.raises(TypeError):
        DEFAULT.update(nosuchsetting=1)


def test_custom_lexicons(spark):
    cfg = DEFAULT.with_lexicons(emoticons=["<o>", ":)"])
    assert _tok(spark, ["a<o>b :)"], cfg)[0] == ["a", "<o>", "b", ":)"]


def test_strict_raises(spark):
    df = spark.createDataFrame([(None,)], "t string")
    with pytest.raises(Exception):
        df.select(tokenize("t", DEFAULT, strict=True)).collect()


def test_idempotent_squeeze_and_fold(spark):
    df = spark.createDataFrame([("sooooo",), ("AAAAbbbb",), ("hahahahaha",), ("MiXeD",)], "w string")
    once = df.select(tx.fold_case(tx.squeeze_syllables(tx.squeeze_letters("w"))).alias("w"))
    twice = once.select(tx.fold_case(tx.squeeze_syllables(tx.squeeze_letters("w"))).alias("w"))
    assert [r.w for r in once.collect()] == [r.w for r in twice.collect()]


def test_bilingual_filter(spark):
    df = spark.createDataFrame([(["The", "ako", "!", "...", ":)", "kumusta", "don"],)], "t array<string>")
    got = df.select(tx.filter_bilingual("t").alias("f")).head().f
    # "..." is not a contiguous piece of the ASCII punctuation string, ":)" neither
    assert got == ["...", ":)", "kumusta"]


def test_entities_one_pass(spark):
    df = spark.createDataFrame([("&amp;lt; &#128512; &#xZZ; &#1114112; &lt;&gt;",)], "t string")
    assert df.select(tx.decode_entities("t").alias("d")).head().d == "&lt; \U0001F600 &#xZZ; &#1114112; <>"


def test_token_count_property(spark):
    from postlens.plans import fixtures as fx
    d = fx.documents(spark, "/root/testdata/sf0.001")
    r = d.select(F.size(tokenize("text")).alias("a"), F.size(tx.filter_bilingual(tokenize("text"))).alias("b"))
    assert r.filter(F.col("b") > F.col("a")).count() == 0
