"""Catalogue entries: tokenizer and text normalizers.

Inputs are whole ``documents`` texts (or ``pages.html`` for entities) plus a
handful of literal probe rows (negative ids) for features the tables lack
(emoticons, emoji, times, URLs, entities, quotes, null / blank messages).
Oracles restate look-around patterns for RE2 where needed (see SURVEY 5.3):
a look-ahead for "blank or end" becomes a consumed ``(blank|end)`` group that
is written back; ``\\w``/``\\d``/``\\s`` become explicit Unicode classes.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.tokenizer import DEFAULT, TokenizerConfig, lex, special_pattern, tokenize
from ..plans import fixtures as fx
from ..session import read_table
from . import tokenizer_sql as tsql
from .registry import register

# Probe rows (FIXTURES.md "small inline fixtures"): id, text.
PROBES = [
    (-1, "<3:p:D a\U0001F600b"), (-2, "#OldTown at#pier #abc123"),
    (-3, "see http://a.b/c and bit.ly or bit.ly, at 12:30 PM"),
    (-4, "1234567abc 2nd 2024-01-01 1 / 2 call 555-123-4567 now"), (-5, "mail bob@x.com @someone_else_here_long"),
    (-6, "sooooo hahahaha AAAAbbb"), (-7, "&amp;lt; &#65; &#x41; &nosuch; &#xZZ;"),
    (-8, 'he said "stop it" and “no” then ＂x＂ and ‘a’ ok \'quoted bit\' end'),
    (-9, "The THE the don t Won't ako ANG"), (-10, None), (-11, ""), (-12, "   "), (-13, "?!..."),
    (-14, "wow... really.. $5.00 +1.5e3% -2"), (-15, "@ab\u200dc @abe\u0301x x\u0085y a\x1cb"),
    (-16, "&#55357;&#56832; &#xD800; &#x10FFFF;"), (-17, "é日" * 50_000), (-18, "STRASSE Straße ÀÉ Àé ñ 2x"),
]


def _sql_str(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


SQL_PROBES = "(VALUES " + ", ".join(f"({i}, {_sql_str(t)})" for i, t in PROBES) + ") AS p(id, text)"
SQL_SRC = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT id, text FROM {SQL_PROBES})"


def probes(spark):
    return spark.createDataFrame(PROBES, "id long, text string")


def source(spark, sf_dir):
    d = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return d.unionByName(probes(spark))


#: Blanks, in both engines' restated patterns.
WS = "[" + tx.CLASS_BODIES["s"] + "]"
_re2 = tsql.re2


_sql_lit = tsql.lit


# -- entities -------------------------------------------------------------

@register("decode_entities", "SELECT id, text FROM " + tsql.decoded(
    f"(SELECT page_id AS id, html AS text FROM pages UNION ALL SELECT id, text FROM {SQL_PROBES})"))
def q_decode_entities(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    src = p.unionByName(probes(spark))
    return src.select("id", tx.decode_entities("text").alias("text"))


# -- quotes / masks / squeezes on whole messages ------------------------------

@register("strip_quotes", f"SELECT id, regexp_replace(text, {_sql_lit(_re2(fv.QUOTED_RE))}, ' ', 'g') AS text FROM {SQL_SRC}")
def q_strip_quotes(spark, sf_dir):
    return source(spark, sf_dir).select("id", tx.strip_quotes("text").alias("text"))


def _mask_sql(kind: str, lookahead: bool) -> str:
    pat = tx.MASK_PATTERNS[kind]()
    tok = tx.MASK_TOKENS[kind]
    if lookahead:
        body = pat.replace(r"(?=\s+|$)", "")
        return (f"SELECT id, regexp_replace(text, {_sql_lit('(' + _re2(body) + ')(' + WS + '|$)')}, "
                f"{_sql_lit(tok + chr(92) + '2')}, 'g') AS text FROM {SQL_SRC}")
    return f"SELECT id, regexp_replace(text, {_sql_lit(_re2(pat))}, {_sql_lit(tok)}, 'g') AS text FROM {SQL_SRC}"


def _mask_query(kind):
    def q(spark, sf_dir):
        return source(spark, sf_dir).select("id", tx.mask("text", kind).alias("text"))
    q.__name__ = f"q_mask_{kind}"
    return q


for _kind, _name, _la in (("username", "mask_usernames", False), ("url", "mask_urls", True),
                          ("time", "mask_times", False), ("phone", "mask_phones", True),
                          ("number", "mask_numbers", False)):
    register(_name, _mask_sql(_kind, _la))(_mask_query(_kind))


@register("squeeze_ellipsis", f"SELECT id, regexp_replace(text, '\\.{{2,}}', '...', 'g') AS text FROM {SQL_SRC}")
def q_squeeze_ellipsis(spark, sf_dir):
    return source(spark, sf_dir).select("id", tx.squeeze_ellipsis("text").alias("text"))


@register("squeeze_letters", f"SELECT id, {tsql.letters_squeezed('text')} AS text FROM {SQL_SRC}")
def q_squeeze_letters(spark, sf_dir):
    return source(spark, sf_dir).select("id", tx.squeeze_letters("text", 3).alias("text"))


_CHUNK_RE = "[^" + tx.CLASS_BODIES["s"] + "]+"
_SQL_WORDS = f"regexp_extract_all(text, '{_CHUNK_RE}')"


def _words():
    """Runs of non-blanks of the whole text."""
    return F.regexp_extract_all("text", F.lit(_CHUNK_RE), 0)


@register("fold_case", f"""
SELECT id, array_to_string(list_transform({_SQL_WORDS},
         lambda w: CASE WHEN upper(w) = w AND lower(w) <> w AND strpos(w, 'ß') = 0 THEN w ELSE lower(w) END), ' ') AS text
FROM {SQL_SRC}""")
def q_fold_case(spark, sf_dir):
    return source(spark, sf_dir).select(
        "id", F.array_join(F.transform(_words(), lambda w: tx.fold_case(w)), " ").alias("text"))


def _sql_list(items) -> str:
    return "[" + ", ".join(_sql_lit(w) for w in items) + "]"


@register("filter_stopwords", f"""
SELECT id, array_to_string(list_filter({_SQL_WORDS}, lambda t: NOT list_contains({_sql_list(fv.STOPWORDS_EN)}, t)), ' ') AS text
FROM {SQL_SRC}""")
def q_filter_stopwords(spark, sf_dir):
    return source(spark, sf_dir).select("id", F.array_join(tx.filter_stopwords(_words()), " ").alias("text"))


_NOWS = tx.CLASS_BODIES["s"]
_WORDS_PUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_NOWS}]+"


@register("filter_stopwords_bilingual", f"""
SELECT id, array_to_string(list_filter(regexp_extract_all(text, {_sql_lit(_WORDS_PUNCT)}),
         lambda t: NOT list_contains({_sql_list(sorted(set(fv.STOPWORDS_TL) | set(fv.STOPWORDS_EN)))}, lower(t))
                   AND strpos({_sql_lit(fv.ASCII_PUNCTUATION)}, t) = 0), ' ') AS text
FROM {SQL_SRC}""")
def q_filter_bilingual(spark, sf_dir):
    toks = F.regexp_extract_all("text", F.lit(_WORDS_PUNCT), 0)
    return source(spark, sf_dir).select("id", F.array_join(tx.filter_bilingual(toks), " ").alias("text"))


@register("flatten_join", f"""
SELECT id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))), ' ') AS text
FROM {SQL_SRC}""")
def q_flatten_join(spark, sf_dir):
    nested = F.transform(F.split("text", "\n"), lambda l: F.split(l, " "))
    return source(spark, sf_dir).select("id", tx.flatten_join(nested).alias("text"))


# -- tokenizer (Java look-around / back-references: rows-only + goldens) ----

def tokenized(spark, sf_dir, cfg: TokenizerConfig = DEFAULT):
    src = source(spark, sf_dir)
    return src.select("id", tokenize("text", cfg).alias("tokens"))


@register("lex_tokens", f"""
WITH RECURSIVE {tsql.lexed(tsql.decoded(SQL_SRC))}
SELECT s.id, coalesce(t.lexed, '') AS lexed FROM src s LEFT JOIN (
  SELECT id, string_agg(tok, ' ' ORDER BY seg, ord) AS lexed FROM toks GROUP BY id) t ON s.id = t.id""")
def q_lex_tokens(spark, sf_dir):
    src = source(spark, sf_dir)
    return src.select("id", F.array_join(F.coalesce(lex(tx.decode_entities("text")), F.array()), " ").alias("lexed"))


@register("tokenize_set", f"""
WITH RECURSIVE {tsql.tokens(SQL_SRC)}
SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, coalesce(array_to_string(toks, ' '), '') AS tokens FROM tokens""")
def q_tokenize_set(spark, sf_dir):
    t = tokenized(spark, sf_dir)
    return t.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


_SQL_TAGS = f"(SELECT id, u.k, u.tag FROM {tsql.decoded(SQL_SRC)}, unnest(regexp_extract_all(text, '#[^#{tsql.S}]+')) WITH ORDINALITY AS u(tag, k))"


@register("split_hashtag", f"""
WITH RECURSIVE tags AS (SELECT *, row_number() OVER (ORDER BY id, k) AS n FROM {_SQL_TAGS}),
{tsql.tokens('(SELECT n AS id, tag AS text FROM tags)')}
SELECT s.id, CAST(count(t.k) AS INTEGER) AS n_tags,
       coalesce(string_agg(coalesce(array_to_string(x.toks, ' '), ''), ' | ' ORDER BY t.k), '') AS segmented
FROM {SQL_SRC} s LEFT JOIN tags t ON s.id = t.id LEFT JOIN tokens x ON x.id = t.n GROUP BY s.id""")
def q_split_hashtag(spark, sf_dir):
    """Every ``#tag`` of every message, tokenized alone: CamelCase, digit and
    all-caps boundaries become separate tokens and ``#`` is dropped."""
    src = source(spark, sf_dir)
    text = tx.decode_entities(F.coalesce("text", F.lit("")))
    tags = F.regexp_extract_all(text, F.lit(tx.jre(r"#[^\s#]+")), 0)
    seg = F.transform(tags, lambda t: F.array_join(tokenize(t), " "))
    return src.select("id", F.size(tags).alias("n_tags"), F.array_join(seg, " | ").alias("segmented"))


_SQL_CHUNKS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda c: c <> '')"


def _chunks(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), tx.jre(r"\s+")), lambda c: c != "")


@register("split_emoticons", f"""
SELECT id, array_to_string(flatten(list_transform({_SQL_CHUNKS}, lambda c: {tsql.split_pieces('c')})), ' ') AS pieces
FROM {SQL_SRC}""")
def q_split_emoticons(spark, sf_dir):
    """Every whitespace chunk of every message split into emoticons / emoji /
    punctuation and the runs between them (the splitter, uncleaned)."""
    from ..functions.tokenizer import split_pieces
    src = source(spark, sf_dir)
    pieces = F.flatten(F.transform(_chunks(F.col("text")), lambda c: split_pieces(c)))
    return src.select("id", F.array_join(pieces, " ").alias("pieces"))


_PUNCT = fv.SPLIT_PUNCTUATION + fv.QUOTE_CHARS


@register("split_punctuation", f"""
SELECT id, array_to_string(list_filter(flatten(list_transform({_SQL_CHUNKS}, lambda c: {tsql.split_pieces('c')})),
                                       lambda p: length(p) = 1 AND strpos({_sql_lit(_PUNCT)}, p) > 0), ' ') AS punctuation
FROM {SQL_SRC}""")
def q_split_punctuation(spark, sf_dir):
    """The single punctuation pieces the splitter emits, per message."""
    from ..functions.tokenizer import split_pieces
    src = source(spark, sf_dir)
    pieces = F.flatten(F.transform(_chunks(F.col("text")), lambda c: split_pieces(c)))
    punct = F.filter(pieces, lambda x: (F.length(x) == 1) & F.lit(_PUNCT).contains(x))
    return src.select("id", F.array_join(punct, " ").alias("punctuation"))


POLICY = DEFAULT.update(usernames="", urls=False, numbers="REMOVE", times="<time>", phonenumbers="PHONE")


def _policy_sql(chunk: str) -> str:
    """The policy on one blank-free chunk."""
    cases = tsql.policy_cases(chunk, POLICY, chunk, "NULL", "{}")
    return f"CASE WHEN regexp_full_match({chunk}, '[a-zA-Z]+') THEN {chunk} {cases} ELSE {chunk} END"


@register("token_policy", f"""
SELECT id, array_to_string(list_filter(list_transform({_SQL_CHUNKS}, lambda c: {_policy_sql('c')}),
                                       lambda x: x IS NOT NULL), ' ') AS tokens
FROM {SQL_SRC}""")
def q_token_policy(spark, sf_dir):
    """Custom class policy (usernames dropped, URLs kept, numbers removed,
    times and phones renamed) on every blank-delimited chunk of every message."""
    from ..functions.tokenizer import token_policy
    src = source(spark, sf_dir)
    return src.select("id", F.array_join(token_policy(_chunks(F.col("text")), POLICY), " ").alias("tokens"))


@register("tokenize_custom_policy", f"""
WITH RECURSIVE {tsql.tokens(SQL_SRC, POLICY)}
SELECT id, coalesce(array_to_string(toks, ' '), '') AS tokens FROM tokens""")
def q_tokenize_custom_policy(spark, sf_dir):
    """The full tokenizer with the same custom class policy."""
    t = tokenized(spark, sf_dir, POLICY)
    return t.select("id", F.array_join("tokens", " ").alias("tokens"))


#: A user's lists (``with_lexicons``): emoticons with shared prefixes, emoji beyond the ranges, stop words.
LEXICONS = dataclasses.replace(
    DEFAULT.with_lexicons(emoticons=["->", "->>", "<-", "=>", "==>", "(c)", "(r)", ":-]", ":-]]", ".,", ",."], emojis=["★", "♥♥"],
                          stopwords=["the", "and", "der", "und", "el", "la", "de"]), ignorestopwords=True)


@register("tokenize_custom_lexicons", f"""
WITH RECURSIVE {tsql.tokens(SQL_SRC, LEXICONS)}
SELECT id, coalesce(array_to_string(list_filter(toks, lambda t: NOT list_contains([{", ".join(tsql.lit(w) for w in LEXICONS.stopwords)}], t)), ' '), '') AS tokens
FROM tokens""")
def q_tokenize_custom_lexicons(spark, sf_dir):
    """The full tokenizer with a user's emoticons, emoji and stop words."""
    t = tokenized(spark, sf_dir, LEXICONS)
    return t.select("id", F.array_join("tokens", " ").alias("tokens"))


@register("squeeze_syllables", f"""
WITH RECURSIVE src AS (SELECT * FROM {SQL_SRC}),
words AS (SELECT id, u.ord, u.w FROM src, unnest({_SQL_WORDS}) WITH ORDINALITY AS u(w, ord)),
short AS (SELECT DISTINCT w, w AS x FROM words),
{tsql.syllables_squeezed('short', 'done')},
agg AS (SELECT id, string_agg(out, ' ' ORDER BY ord) AS t FROM words JOIN done ON words.w = done.w GROUP BY id)
SELECT s.id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(a.t, '') END AS text
FROM src s LEFT JOIN agg a ON s.id = a.id""")
def q_squeeze_syllables(spark, sf_dir):
    return source(spark, sf_dir).select(
        "id", F.array_join(F.transform(_words(), lambda w: tx.squeeze_syllables(w, 3)), " ").alias("text"))


@register("nonstring_policy", f"""
SELECT id, CAST(0 AS INTEGER) AS n_tokens FROM {SQL_SRC}
WHERE text IS NULL OR regexp_full_match(text, '[{tx.CLASS_BODIES["s"]}#]*')""")
def q_nonstring_policy(spark, sf_dir):
    """Messages that yield no token: null text (non-string policy) and, with
    the default replacements, text made only of blanks and '#'."""
    t = tokenized(spark, sf_dir)
    return t.select("id", F.size("tokens").alias("n_tokens")).filter(F.col("n_tokens") == 0)
