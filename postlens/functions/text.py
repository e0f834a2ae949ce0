"""Message-level normalizers as native Column expressions.

Patterns come from ``fixed_values`` (Python syntax).  For the JVM, ``\\w``
``\\d`` ``\\s`` are spelled out as the classes of Python 3 (its own Unicode flag
also takes combining marks and joiners for word characters), and ``(?d)`` makes
``\\n`` the only line end, as in Python.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

JFLAGS = "(?d)"
MAX_CODE_POINT = 0x10FFFF
SURROGATES = (0xD800, 0xDFFF)

#: Python 3's classes for str patterns, as bodies of a character class.
CLASS_BODIES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\t-\r\x1c-\x1f\x{85}\p{Z}"}


def spell_classes(pattern: str) -> str:
    r"""``\w \d \s \S`` written out (bracketed outside a class, spliced in inside one)."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in CLASS_BODIES:
                out.append(CLASS_BODIES[nxt] if in_class else "[" + CLASS_BODIES[nxt] + "]")
            elif nxt == "S" and not in_class:
                out.append("[^" + CLASS_BODIES["s"] + "]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch in "[]":
            in_class = ch == "["
        out.append(ch)
        i += 1
    return "".join(out)


def jre(pattern: str) -> str:
    """A Python-syntax pattern for the JVM, with Python 3's meaning."""
    return JFLAGS + spell_classes(pattern)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- entities ---------------------------------------------------------------

def _entity_map() -> Column:
    """HTML-4 named entities (built from the standard library table)."""
    names = sorted(html.entities.name2codepoint)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                             F.array(*[F.lit(chr(html.entities.name2codepoint[n])) for n in names]))


def _code_point_to_string(code: Column) -> Column:
    """A Unicode code point (BIGINT) as a one-character string (not ``chr``,
    which is modulo 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _decode_one(entity: Column, names: Column) -> Column:
    """``&name;`` / ``&#123;`` / ``&#x7B;`` -> character; anything else unchanged."""
    body = F.substring(entity, 2, F.length(entity) - 2)  # without & and ;
    is_num = body.startswith("#")
    is_hex = is_num & F.substring(body, 2, 1).isin("x", "X")
    hex_digits = F.regexp_replace(F.substring(body, F.lit(3), F.length(body)), "^0+(?=.)", "")
    dec_digits = F.regexp_replace(F.substring(body, F.lit(2), F.length(body)), "^0+(?=.)", "")
    hex_ok = hex_digits.rlike("^[0-9a-fA-F]{1,6}$")
    dec_ok = dec_digits.rlike("^[0-9]{1,7}$")
    code = (F.when(is_hex & hex_ok, F.conv(hex_digits, 16, 10).cast("long"))
            .when(~is_hex & is_num & dec_ok, dec_digits.cast("long")))
    # a surrogate is no character: its entity stays as it is
    numeric = F.when(code.isNotNull() & (code <= MAX_CODE_POINT) & ~code.between(*SURROGATES), _code_point_to_string(code))
    named = F.try_element_at(names, body)
    return F.coalesce(F.when(is_num, numeric).otherwise(named), entity)


def decode_entities(text) -> Column:
    """Decode named, decimal and hexadecimal entities in one left-to-right pass
    (``&amp;lt;`` -> ``&lt;``); unknown or unparsable entities stay as they are."""
    text = _c(text)
    pat = F.lit(jre(fv.ENTITY_RE))
    parts = F.split(text, jre(fv.ENTITY_RE), -1)
    ents = F.regexp_extract_all(text, pat, 0)
    names = _entity_map()
    decoded = F.transform(ents, lambda e: _decode_one(e, names))
    tail = F.zip_with(decoded, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                      lambda d, p: F.concat(d, p))
    out = F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    # messages without '&' (the common case) skip the regex scan entirely
    return (F.when(text.isNull(), text).when(F.instr(text, "&") == 0, text)
            .when(F.size(ents) == 0, text).otherwise(out))


# -- quotes -----------------------------------------------------------------

def strip_quotes(text) -> Column:
    """Replace quoted spans (curly, straight, full-width double quotes; single
    quotes between blanks) by one blank."""
    return F.regexp_replace(_c(text), jre(fv.QUOTED_RE), " ")


# -- masks (message level) -------------------------------------------------

def url_pattern(domains=None) -> str:
    return fv.URL_RE_TEMPLATE.replace("{domains}", "|".join(domains or fv.URL_DOMAINS))


MASK_PATTERNS = {
    "username": lambda cfg=None: fv.USERNAME_RE,
    "url": lambda cfg=None: url_pattern(cfg.domains if cfg is not None else None),
    "time": lambda cfg=None: fv.TIME_RE,
    "phone": lambda cfg=None: fv.PHONE_RE,
    "number": lambda cfg=None: fv.NUMBERS_RE,
}
MASK_TOKENS = {"username": "USERNAME", "url": "URL", "time": "TIME",
               "phone": "PHONENUMBER", "number": "NUMBER"}


def mask(text, kind: str, replacement: str | None = None, cfg=None) -> Column:
    """Replace every match of one token class in the message by its token."""
    rep = MASK_TOKENS[kind] if replacement is None else replacement
    return F.regexp_replace(_c(text), jre(MASK_PATTERNS[kind](cfg)), rep.replace("$", "\\$"))


def squeeze_ellipsis(text) -> Column:
    """Two or more dots -> ``...``."""
    return F.regexp_replace(_c(text), r"\.{2,}", "...")


# -- word cleaning -----------------------------------------------------------

def squeeze_letters(word, n: int = 3) -> Column:
    """Runs of 3+ of the same ASCII letter -> exactly ``n`` copies (0 = off)."""
    if not n:
        return _c(word)
    return F.regexp_replace(_c(word), fv.REPEATED_LETTER_RE, "$1" * n)


def squeeze_syllables(word, n: int = 3) -> Column:
    """3+ repeats of a letter+vowel(+letter) unit -> ``n`` copies (0 = off)."""
    if not n:
        return _c(word)
    return F.regexp_replace(_c(word), fv.REPEATED_SYLLABLE_RE, "$1" * n)


def is_all_caps(word) -> Column:
    """Python ``str.isupper``: has a cased character and none is lower case."""
    w = _c(word)
    return (F.upper(w) == w) & (F.lower(w) != w)


def fold_case(word, lowercase: bool = True, keep_caps: bool = True) -> Column:
    """Lower-case unless the word is all capitals (and ``keep_caps``)."""
    w = _c(word)
    if not lowercase:
        return w
    if not keep_caps:
        return F.lower(w)
    # most words are in lower case already: one conversion tells
    return F.when(F.lower(w) == w, w).when(F.upper(w) == w, w).otherwise(F.lower(w))


# -- token-list filters ------------------------------------------------------

def filter_stopwords(tokens, words=None) -> Column:
    """Drop tokens found (exact case) in ``words``; duplicates and order of the
    remaining tokens are kept (unlike ``array_except``)."""
    words = list(words if words is not None else fv.STOPWORDS_EN)
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


def filter_bilingual(tokens, tagalog=None, english=None, punctuation: str = fv.ASCII_PUNCTUATION) -> Column:
    """Job-side filter: drop a token whose lower case is a Tagalog or English
    stop word, or that is a contiguous piece of the ASCII punctuation string."""
    stop = sorted(set(tagalog if tagalog is not None else fv.STOPWORDS_TL)
                  | set(english if english is not None else fv.STOPWORDS_EN))
    punct = F.lit(punctuation)
    return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(*stop) & ~punct.contains(t))


def flatten_join(nested) -> Column:
    """Flatten a list of token lists and join with one blank."""
    return F.array_join(F.flatten(_c(nested)), " ")
