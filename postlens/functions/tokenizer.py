"""Social-media tokenizer as one native Column expression.

Order of work (kept from the behaviour being reproduced):

1. decode HTML entities (one pass);
2. optionally replace quoted spans by a blank;
3. lex: ordered alternation, leftmost match, first alternative wins --
   usernames, URLs, times, phone numbers, numbers, [CamelCase / digit-boundary
   pieces], ASCII words, ellipses, anything else up to a blank, ``#`` or ``..``
   (``#`` and blanks are never emitted);
4. classify each token *alone*, from its start, in class order: a token made
   only of ASCII letters is a word and is cleaned; otherwise the first class
   whose pattern matches a prefix replaces the whole token by the class
   token (or keeps it, or drops it); an ellipsis becomes ``...``; anything
   else is split into emoticons / emoji / punctuation (emitted as they are)
   and the runs between them (cleaned);
5. optionally drop stop words (exact case).

Everything is ``regexp_extract_all`` / ``transform`` / ``filter`` /
``flatten``: no Python runs per row, so the expression scales with the
cluster.  Lambdas only reference their own arguments and literals.
"""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import decode_entities, jre, squeeze_letters, squeeze_syllables, strip_quotes, url_pattern


@dataclass(frozen=True)
class TokenizerConfig:
    """Tokenizer settings (defaults are the reference behaviour).

    Replacement settings (``usernames`` ... ``numbers``): a string replaces the
    whole token; ``False`` leaves it unchanged; ``""``, ``"REMOVE"``,
    ``"DELETE"`` (upper or lower case) drop it.
    """

    lowercase: bool = True
    allcapskeep: bool = True
    normalize: int = 3
    custom_hashtags: bool = True
    usernames: str | bool = "USERNAME"
    urls: str | bool = "URL"
    phonenumbers: str | bool = "PHONENUMBER"
    times: str | bool = "TIME"
    numbers: str | bool = "NUMBER"
    ignorequotes: bool = False
    ignorestopwords: bool = False
    emoticons: tuple = field(default_factory=lambda: tuple(fv.EMOTICONS))
    stopwords: tuple = field(default_factory=lambda: tuple(fv.STOPWORDS_EN))
    emojis: tuple = ()
    domains: tuple = field(default_factory=lambda: tuple(fv.URL_DOMAINS))

    def update(self, **kwargs) -> "TokenizerConfig":
        """A copy with some settings changed; unknown names raise."""
        known = {f.name for f in dataclasses.fields(self)}
        bad = set(kwargs) - known
        if bad:
            raise TypeError(f"unknown tokenizer settings: {sorted(bad)}")
        return dataclasses.replace(self, **kwargs)

    def with_lexicons(self, emoticons=None, stopwords=None, emojis=None) -> "TokenizerConfig":
        """Replace lexicons (blank entries dropped, right-stripped, de-duplicated)."""
        def clean(items):
            return tuple(sorted({s.rstrip() for s in items if s and s.rstrip()}))
        kw = {}
        if emoticons is not None:
            kw["emoticons"] = clean(emoticons)
        if stopwords is not None:
            kw["stopwords"] = clean(stopwords)
        if emojis is not None:
            kw["emojis"] = clean(emojis)
        return dataclasses.replace(self, **kw)


DEFAULT = TokenizerConfig()

# classes in the order they are tried on a lone token
_CLASSES = (("usernames", "username"), ("urls", "url"), ("times", "time"),
            ("phonenumbers", "phone"), ("numbers", "number"))


def _class_pattern(kind: str, cfg: TokenizerConfig) -> str:
    return {
        "username": fv.USERNAME_RE,
        "url": url_pattern(cfg.domains),
        "time": fv.TIME_RE,
        "phone": fv.PHONE_RE,
        "number": fv.NUMBERS_RE,
    }[kind]


def _plain_word(cfg: TokenizerConfig) -> str:
    """A short cut for most words: lower-case letters, perhaps after a capital, that a blank, a comma or a
    dot before no letter or digit ends.  No URL (it needs a dot and more, or ``://``) or hashtag piece
    ends inside or behind such a word, and after a digit, where ``nd`` is a piece, it is not taken."""
    ends = r"[\s,]"
    if all(d[:1].isascii() and d[:1].isalnum() for d in cfg.domains):
        ends += r"|\.(?![A-Za-z0-9])"
    return rf"(?<!\d)[A-Z]?[a-z]++(?={ends})"


def lexer_source(cfg: TokenizerConfig = DEFAULT) -> str:
    """The ordered alternation (Python syntax).  Consecutive alternatives that share a set of
    possible first characters sit behind one look-ahead on that set; the
    order of alternatives (and so the leftmost-first result) is unchanged."""
    cls = {k: _class_pattern(k, cfg) for _, k in _CLASSES}
    alts = [_plain_word(cfg), cls["username"],
            r"(?=[A-Za-z0-9])(?:" + cls["url"] + ")",
            r"(?=[\d+\-$(])(?:" + "|".join([cls["time"], cls["phone"], cls["number"]]) + ")"]
    if cfg.custom_hashtags:
        alts.append(fv.HASHTAG_SPLIT_RE)
    # The JVM matches a repeated group of alternatives by recursion, one frame per
    # character: a long run overflows the stack.  Possessive repeats don't recurse,
    # and nothing follows this one, so no match needs its characters given back.
    alts += [fv.WORD_RE, fv.ELLIPSIS_RE, fv.OTHER_RE + "+"]
    return "|".join(alts)


def lexer_pattern(cfg: TokenizerConfig = DEFAULT) -> str:
    """The lexer for the JVM."""
    return jre(lexer_source(cfg))


def _emoji_class(cfg: TokenizerConfig) -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in fv.EMOJI_RANGES) + "]"


def trie_pattern(entries) -> str:
    """A pattern that matches the longest of ``entries``: their trie, shared prefixes written once, so
    that a long list is not tried entry by entry."""
    root: dict = {}
    for entry in entries:
        node = root
        for ch in entry:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [re.escape(ch) + written(node[ch]) for ch in sorted(node) if ch]
        if not parts:
            return ""
        if "" in node:  # an entry ends here; longer ones first
            return "(?:" + "|".join(parts) + ")?"
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return written(root)


def special_pattern(cfg: TokenizerConfig = DEFAULT) -> str:
    """What the splitter emits as is, longest first: emoticons (and listed
    emoji) of the scan width, single emoji code points, single punctuation."""
    width = max([len(e) for e in cfg.emoticons] + [2])
    listed = trie_pattern({s for s in tuple(cfg.emoticons) + tuple(cfg.emojis) if 0 < len(s) <= width})
    punct = fv.SPLIT_PUNCTUATION + fv.QUOTE_CHARS
    punct_class = "[" + "".join(re.escape(ch) if ch not in "-" else r"\-" for ch in dict.fromkeys(punct)) + "]"
    alts = [listed] * bool(listed) + [_emoji_class(cfg), punct_class]
    return "(?:" + "|".join(alts) + ")"


def special_first_class(cfg: TokenizerConfig = DEFAULT) -> str:
    """Character class of every character a special piece can start with."""
    width = max([len(e) for e in cfg.emoticons] + [2])
    firsts = {s[0] for s in tuple(cfg.emoticons) + tuple(cfg.emojis) if 0 < len(s) <= width}
    firsts |= set(fv.SPLIT_PUNCTUATION + fv.QUOTE_CHARS)
    body = "".join(re.escape(ch) if ch != "-" else r"\-" for ch in sorted(firsts))
    ranges = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in fv.EMOJI_RANGES)
    return "[" + body + ranges + "]"


def splitter_source(cfg: TokenizerConfig = DEFAULT) -> str:
    """Special pieces, or runs of anything else.  A run character that cannot
    start a special piece skips the look-ahead (the common case).  The repeat is
    possessive for the reason given in :func:`lexer_source`."""
    sp = special_pattern(cfg)
    first = special_first_class(cfg)
    neg = first.replace("[", "[^", 1)
    return f"{sp}|(?s:{neg}|(?!{sp}).)++"


def splitter_pattern(cfg: TokenizerConfig = DEFAULT) -> str:
    return jre(splitter_source(cfg))


def _is_deletion(value) -> bool:
    return isinstance(value, str) and value in fv.DELETION_TOKENS


def _replacement(tok: Column, value) -> Column:
    """Token -> pieces after the class policy."""
    if value is False or value is None:
        return F.array(tok)
    if _is_deletion(value):
        return F.array().cast(_PIECES)
    return F.array(F.lit(str(value)))


_PIECES = "array<string>"


def _clean(tok: Column, cfg: TokenizerConfig) -> Column:
    """A squeezed piece, its case folded (``tok`` is a lambda variable, so each regex runs once).

    A run takes three letters and three syllables take six, so shorter pieces
    skip them.  Squeezing leaves a copy of every letter, so the piece as it was
    tells whether the squeezed one is in lower case or all capitals.
    """
    n = cfg.normalize
    squeezed = tok
    if n:
        letters = squeeze_letters(tok, n)
        squeezed = F.when(F.length(tok) < 3, tok)
        if n <= 3:  # squeezing letters does not lengthen
            squeezed = squeezed.when(F.length(tok) < 6, letters)
        squeezed = squeezed.otherwise(squeeze_syllables(letters, n))
    if not cfg.lowercase:
        return squeezed
    out = F.when(F.lower(tok) == tok, squeezed)
    if cfg.allcapskeep:
        out = out.when(F.upper(tok) == tok, squeezed)
    return out.otherwise(F.lower(squeezed))


def split_pieces(tok: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    """Raw splitter output: emoticons / emoji / punctuation and the runs of
    everything else between them, in order (nothing cleaned)."""
    return F.regexp_extract_all(tok, F.lit(splitter_pattern(cfg)), 0)


def split_other(tok: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    """Split a non-word token into emoticons / emoji / punctuation (as is) and
    cleaned runs of everything else."""
    special_prefix = "^" + special_pattern(cfg)
    pieces = F.regexp_extract_all(tok, F.lit(splitter_pattern(cfg)), 0)
    one = lambda p: F.when(p.rlike(jre(special_prefix)), p).otherwise(_clean(p, cfg))
    split = F.transform(pieces, one)
    # a single character is one piece; no character that can start a special piece: the token is one run
    return (F.when(F.length(tok) == 1, F.array(one(tok)))
            .when(tok.rlike(jre(special_first_class(cfg))), split).otherwise(F.array(_clean(tok, cfg))))


def classify_token(tok: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    """One lexed token -> its pieces, cleaned (0, 1 or several)."""
    # every class starts with '@', '+', '-', '$', '(', an ASCII letter or a
    # digit; other tokens skip the five class patterns.
    maybe = tok.rlike(jre(r"^[@+\-$(A-Za-z\d]"))
    rest = F.when(tok.startswith(".."), F.array(F.lit("..."))).otherwise(split_other(tok, cfg))
    hits = [(tok.rlike(jre("^(?:" + _class_pattern(kind, cfg) + ")")), _replacement(tok, getattr(cfg, setting)))
            for setting, kind in _CLASSES]
    classes = F.when(*hits[0])
    for hit in hits[1:]:
        classes = classes.when(*hit)
    return (F.when(tok.rlike(r"^[a-zA-Z]+$"), F.array(_clean(tok, cfg)))
            .when(maybe, classes.otherwise(rest)).otherwise(rest))


def token_policy(tokens, cfg: TokenizerConfig = DEFAULT) -> Column:
    """Apply the per-class replacement policy to a token list: each token
    (matched alone, from its start, classes in order; ASCII words are never
    classified) is replaced by its class token, kept (``False``) or dropped
    (``""``/``REMOVE``/``DELETE``); other tokens pass unchanged."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    drop = F.lit(None).cast("string")

    def one(tok):
        expr = F.when(tok.rlike(r"^[a-zA-Z]+$"), tok)
        for setting, kind in _CLASSES:
            value = getattr(cfg, setting)
            out = tok if value is False or value is None else (drop if _is_deletion(value) else F.lit(str(value)))
            expr = expr.when(tok.rlike(jre("^(?:" + _class_pattern(kind, cfg) + ")")), out)
        return expr.otherwise(tok)

    return F.filter(F.transform(tokens, one), lambda t: t.isNotNull())


def lex(text, cfg: TokenizerConfig = DEFAULT) -> Column:
    """Raw lexer output (before classification)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(lexer_pattern(cfg)), 0)


def tokenize(text, cfg: TokenizerConfig = DEFAULT, strict: bool = False) -> Column:
    """Message -> ``array<string>`` of tokens.  Null text gives ``[]`` (or an
    error when ``strict``)."""
    text = F.col(text) if isinstance(text, str) else text
    msg = decode_entities(text)
    if cfg.ignorequotes:
        msg = strip_quotes(msg)
    toks = F.flatten(F.transform(lex(msg, cfg), lambda t: classify_token(t, cfg)))
    if cfg.ignorestopwords:
        words = list(cfg.stopwords)
        toks = F.filter(toks, lambda t: ~t.isin(*words))
    empty = F.array().cast("array<string>")
    if strict:
        empty = F.raise_error(F.lit("a message without text (null) in strict mode")).cast("array<string>")
    return F.when(text.isNull(), empty).otherwise(toks)
