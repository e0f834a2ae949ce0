"""JVM regex vs Python ``re``: the lexer pattern must split every fixture
message identically in both engines (Unicode classes, ``$``, look-behind).

The Python side is only the regex engine running the same fixed pattern
(brute force on the whole sf0.01 corpus plus the probe rows); it checks that
compiling the pattern for the JVM reproduces Python semantics.
"""

import re

from pyspark.sql import functions as F

from conftest import SF01
from postlens.functions import text as tx
from postlens.functions import fixed_values as fv
from postlens.functions.tokenizer import lexer_source, lex
from postlens.plans.text_queries import source


def test_lexer_matches_python_re(spark):
    pattern = re.compile(lexer_source())
    rows = source(spark, SF01).select("id", "text", lex("text").alias("lexed")).collect()
    assert len(rows) > 1000
    bad = [r.id for r in rows if r.text is not None and pattern.findall(r.text) != list(r.lexed)]
    assert not bad, bad[:10]


def test_quote_strip_matches_python_re(spark):
    pattern = re.compile(fv.QUOTED_RE)
    rows = source(spark, SF01).select("id", "text", tx.strip_quotes("text").alias("s")).collect()
    bad = [r.id for r in rows if r.text is not None and pattern.sub(" ", r.text) != r.s]
    assert not bad, bad[:10]


def _python_tokens(text, cfg):
    """The tokenizer's steps with Python's regex engine (same fixed patterns)."""
    from postlens.functions.tokenizer import _CLASSES, _class_pattern, special_pattern, splitter_source
    if text is None:
        return []
    lexer = re.compile(lexer_source(cfg))
    classes = [(setting, re.compile(_class_pattern(kind, cfg))) for setting, kind in _CLASSES]
    py = lambda pat: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08X" % int(m.group(1), 16), pat)
    splitter = re.compile(py(splitter_source(cfg)))
    special = re.compile(py(special_pattern(cfg)))
    letters, syllables = re.compile(fv.REPEATED_LETTER_RE), re.compile(fv.REPEATED_SYLLABLE_RE)

    def clean(w):
        w = syllables.sub(r"\1" * cfg.normalize, letters.sub(r"\1" * cfg.normalize, w))
        return w if (w.isupper() and cfg.allcapskeep) else w.lower()

    out = []
    for tok in lexer.findall(text):
        if re.fullmatch(r"[a-zA-Z]+", tok):
            out.append(clean(tok))
            continue
        hit = next((setting for setting, rx in classes if rx.match(tok)), None)
        if hit is not None:
            value = getattr(cfg, hit)
            if value is False:
                out.append(tok)
            elif value not in fv.DELETION_TOKENS:
                out.append(value)
        elif tok.startswith(".."):
            out.append("...")
        else:
            out.extend(p if special.match(p) else clean(p) for p in splitter.findall(tok))
    return out


def test_tokenizer_matches_python_re(spark):
    from postlens.functions.tokenizer import DEFAULT, tokenize
    assert _python_tokens("a&b", DEFAULT) == ["a", "&b"]
    # entity decoding has its own exact oracle; Python gets the decoded text
    rows = source(spark, SF01).select("id", tx.decode_entities("text").alias("d"),
                                      tokenize("text").alias("toks")).collect()
    bad = [r.id for r in rows if _python_tokens(r.d, DEFAULT) != list(r.toks)]
    assert not bad, bad[:10]


def test_tokenizer_matches_python_re_custom_settings(spark):
    from postlens.functions.tokenizer import DEFAULT, tokenize
    cfg = DEFAULT.update(usernames="", urls=False, numbers="REMOVE", times="T", lowercase=True,
                         allcapskeep=False, normalize=2, custom_hashtags=False)
    rows = source(spark, SF01).select("id", tx.decode_entities("text").alias("d"),
                                      tokenize("text", cfg).alias("toks")).collect()
    bad = [r.id for r in rows if _python_tokens(r.d, cfg) != list(r.toks)]
    assert not bad, bad[:10]


def test_short_cuts_change_no_token(spark):
    """The lexer's plain words and the pieces that skip a regex: as the alternation and the patterns alone have them."""
    from postlens.functions import tokenizer as tk
    odd = ["word. Word.x www.a.com www. 2nd 2ndx a-word, word-x. nd, 5th. Abc.de abc.12 http://a.b/c https, Aa. IPhone, iPhone. é.word ",
           "aaa AAA Aaa aaAAaa hahaha HAHAHA haHAhaha bababab abababx aaab. ßßß ΑΣ ΣΣΣaaa. İaaa ÀÉ . , !! x \U0001F600 ... ..a .a. word.\nnext word"]
    for cfg in (tk.DEFAULT, tk.DEFAULT.update(normalize=5, allcapskeep=False), tk.DEFAULT.update(normalize=0, domains=(".x", "de")),
                tk.DEFAULT.update(custom_hashtags=False, normalize=1, urls=False, lowercase=False)):
        whole = tk.lexer_source(cfg)
        plain = re.compile(whole[len(tk._plain_word(cfg)) + 1:])
        assert whole.startswith(tk._plain_word(cfg) + "|")
        rows = source(spark, SF01).select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
        rows = rows.select("text", lex("text", cfg).alias("l"), F.transform(
            lex("text", cfg), lambda t: tk._clean(t, cfg)).alias("c"), F.transform(
            lex("text", cfg), lambda t: tx.squeeze_syllables(tx.squeeze_letters(t, cfg.normalize), cfg.normalize)).alias("s"))
        rows = rows.withColumn("w", F.transform("s", lambda t: tx.fold_case(t, cfg.lowercase, cfg.allcapskeep))).filter("text is not null")
        for r in rows.collect():
            assert plain.findall(r.text) == list(r.l)
            assert list(r.c) == list(r.w)
