"""The tokenizer stated for DuckDB, as the oracle of the tokenizer queries.

RE2 has neither look-around nor back-references, so the lexer is a token walk
(a recursive query): at the head of what is left of a text the alternatives
are tried in order, each anchored there; a look-ahead becomes a group behind
the captured token, a look-behind a test of the characters before.  Blanks and
``#`` start no token and are skipped.  To keep the walk short, a text is first
cut at blanks that no token can span: blanks after a letter other than ``x``,
and blanks before a letter that begins neither AM/PM nor ``x``.  Syllables are
squeezed by a second walk, over the distinct words.
"""

from __future__ import annotations

import html.entities

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.tokenizer import _CLASSES, DEFAULT, TokenizerConfig, _class_pattern, special_pattern

W, D, S = (tx.CLASS_BODIES[c] for c in "wds")
AHEAD = r"(?=\s+|$)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return tx.spell_classes(pattern)


# -- entities ---------------------------------------------------------------------

def _names() -> str:
    items = ", ".join(f"{lit(k)}: {lit(chr(v))}" for k, v in sorted(html.entities.name2codepoint.items()))
    return "MAP {" + items + "}"


ENTITY = rf"&#?[{W}]+;"
_SURROGATES = "NOT BETWEEN {} AND {}".format(*tx.SURROGATES)
#: Entity ``x`` decoded, or as it is.
DECODE_ONE = f"""(CASE WHEN substring(x, 2, 1) = '#' THEN
  CASE WHEN lower(substring(x, 3, 1)) = 'x' THEN
    CASE WHEN regexp_full_match(regexp_replace(substring(x, 4, length(x) - 4), '^0+(.)', '\\1'), '[0-9a-fA-F]{{1,6}}')
          AND CAST(('0x' || substring(x, 4, length(x) - 4)) AS BIGINT) <= 1114111
          AND CAST(('0x' || substring(x, 4, length(x) - 4)) AS BIGINT) {_SURROGATES}
         THEN chr(CAST(CAST(('0x' || substring(x, 4, length(x) - 4)) AS BIGINT) AS INTEGER)) ELSE x END
  ELSE
    CASE WHEN regexp_full_match(regexp_replace(substring(x, 3, length(x) - 3), '^0+(.)', '\\1'), '[0-9]{{1,7}}')
          AND CAST(substring(x, 3, length(x) - 3) AS BIGINT) <= 1114111
          AND CAST(substring(x, 3, length(x) - 3) AS BIGINT) {_SURROGATES}
         THEN chr(CAST(substring(x, 3, length(x) - 3) AS INTEGER)) ELSE x END
  END
ELSE coalesce(element_at({_names()}, substring(x, 2, length(x) - 2))[1], x) END)"""


def decoded(src: str) -> str:
    """Rows (id, text) of ``src`` with their entities decoded."""
    return f"""(SELECT id, CASE WHEN text IS NULL THEN NULL WHEN len(ents) = 0 THEN text
           ELSE parts[1] || array_to_string(list_transform(list_zip(list_transform(ents, lambda x: {DECODE_ONE}), parts[2:]),
                                                            lambda z: z[1] || z[2]), '') END AS text
FROM (SELECT id, text, regexp_extract_all(text, '{ENTITY}') AS ents, regexp_split_to_array(text, '{ENTITY}') AS parts FROM {src}))"""


# -- lexer ------------------------------------------------------------------------

def _head(pattern: str) -> str:
    """The match of ``pattern`` (Python syntax) at the head of ``s``, or null."""
    if AHEAD in pattern:
        return f"nullif(regexp_extract(s, {lit('^(' + re2(pattern.replace(AHEAD, '')) + f')(?:[{S}]|$)')}, 1), '')"
    return f"nullif(regexp_extract(s, {lit('^(?:' + re2(pattern) + ')')}), '')"


def _captured(rx: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(s, {lit(rx)}, {group}), '')"


def lexed_token(cfg: TokenizerConfig = DEFAULT) -> str:
    """The token at the head of ``s``, given the two characters ``prev`` before it."""
    before = "right(prev, 1)"
    other = rf"(?:\.?[^#{S}.])"
    alts = [_head(_class_pattern(kind, cfg)) for _, kind in _CLASSES]
    if cfg.custom_hashtags:
        alts += [
            _captured("^([A-Z][a-z]+)"),
            _captured(rf"^([A-Z]+)(?:[A-Z][a-z]|[{D}]|[{S}])"),
            f"CASE WHEN regexp_full_match({before}, '[{D}]') THEN {_captured('^([nrt][dh])')} END",
            f"CASE WHEN regexp_full_match({before}, '[#{S}{D}]') THEN {_captured(rf'^([a-z]+)(?:[A-Z]|[{D}]|[{W}]\])')} END",
            f"CASE WHEN regexp_full_match(prev, '[{W}]-') THEN {_captured(rf'^([{W}]+)')} END",
        ]
    alts += [_captured("^([a-zA-Z]+)"), _captured(r"^(\.\.+)"),
             _captured(rf"^({other}*\.)(?:[#{S}]|$)"), _captured(rf"^({other}+)")]
    return "coalesce(" + ",\n      ".join(alts) + ")"


def lexed(src: str, cfg: TokenizerConfig = DEFAULT) -> str:
    """CTEs that end in ``toks`` (id, seg, ord, tok): the lexer's output for the
    rows (id, text) of ``src``, in the order of seg and ord."""
    cut = f"regexp_replace(text, '([a-wyzA-Z][{S}])', '\\1' || chr(1), 'g')"
    cut = f"regexp_replace({cut}, '([{S}])([b-oq-wyzB-OQ-Z])', '\\1' || chr(1) || '\\2', 'g')"

    def skip(of: str) -> str:
        return f"regexp_extract({of}, '^[#{S}]*')"

    return f"""
src AS (SELECT id, text FROM {src}),
segs AS (SELECT id, u.seg, u.s, CASE WHEN u.seg = 1 THEN '' ELSE ' ' END AS prev
         FROM src, unnest(string_split({cut}, chr(1))) WITH ORDINALITY AS u(s, seg)),
walk(id, seg, ord, prev, s, tok) AS (
  SELECT id, seg, 0, right(prev || {skip('s')}, 2), substr(s, length({skip('s')}) + 1), NULL::VARCHAR FROM segs
  UNION ALL
  SELECT id, seg, ord + 1, right(prev || tok || lead, 2), substr(rest, length(lead) + 1), tok
  FROM (SELECT *, {skip('rest')} AS lead
        FROM (SELECT id, seg, ord, prev, tok, substr(s, length(tok) + 1) AS rest
              FROM (SELECT id, seg, ord, prev, s, {lexed_token(cfg)} AS tok FROM walk WHERE s <> '')))),
toks AS (SELECT id, seg, ord, tok FROM walk WHERE tok IS NOT NULL)"""


# -- classification, splitting, cleaning --------------------------------------------

def split_pieces(chunk: str, cfg: TokenizerConfig = DEFAULT) -> str:
    """The splitter: ``special|any character`` finds the same special pieces at
    the same places (a run stops exactly where a special piece would match);
    single characters are then merged into runs, by marking specials with
    U+0001 and splitting there."""
    sp = special_pattern(cfg)
    pieces = f"regexp_extract_all({chunk}, {lit(sp + '|(?s:.)')})"
    marked = (f"list_transform({pieces}, lambda p: CASE WHEN regexp_full_match(p, {lit(sp)}) "
              f"THEN chr(1) || p || chr(1) ELSE p END)")
    return f"list_filter(string_split(array_to_string({marked}, ''), chr(1)), lambda x: x <> '')"


def policy_cases(tok: str, cfg: TokenizerConfig, keep: str, drop: str, value: str) -> str:
    """WHEN clauses of the token classes; ``keep``, ``drop``, ``value`` are their
    results, the last with ``{}`` for the replacement."""
    out = []
    for setting, kind in _CLASSES:
        pattern, to = _class_pattern(kind, cfg), getattr(cfg, setting)
        rx = f"^(?:{re2(pattern.replace(AHEAD, ''))})" + (f"(?:[{S}]|$)" if AHEAD in pattern else "")
        result = keep if to is False else drop if to in fv.DELETION_TOKENS else value.format(lit(to))
        out.append(f"WHEN regexp_matches({tok}, {lit(rx)}) THEN {result}")
    return " ".join(out)


def letters_squeezed(expr: str, n: int = 3) -> str:
    """One replacement per ASCII letter; runs of different letters never overlap."""
    for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        expr = f"regexp_replace({expr}, '{ch}{{3,}}', '{ch * n}', 'g')"
    return expr


def syllables_squeezed(words: str, name: str) -> str:
    """CTEs that end in ``name`` (w, out): each word of ``words`` (w, squeezed
    letters in ``x``) with its syllables squeezed.  At each place the two-letter
    unit, then the three-letter unit, is tried for three copies or more."""
    return f"""
{name}_walk(w, x, p, out) AS (
  SELECT w, x, 1, '' FROM {words} WHERE regexp_matches(x, '[a-zA-Z]')
  UNION ALL
  SELECT w, x, p + CASE WHEN r2 >= 3 THEN 2 * r2 WHEN r3 >= 3 THEN 3 * r3 ELSE 1 END,
         out || CASE WHEN r2 >= 3 THEN repeat(u2, 3) WHEN r3 >= 3 THEN repeat(u3, 3) ELSE substr(x, p, 1) END
  FROM (SELECT w, x, p, out, u2, u3,
               CASE WHEN regexp_full_match(u2, '[a-zA-Z][aeiouAEIOU]')
                    THEN length(regexp_extract(substr(x, p), '^(?:' || u2 || ')+')) // 2 ELSE 0 END AS r2,
               CASE WHEN regexp_full_match(u3, '[a-zA-Z][aeiouAEIOU][a-zA-Z]')
                    THEN length(regexp_extract(substr(x, p), '^(?:' || u3 || ')+')) // 3 ELSE 0 END AS r3
        FROM (SELECT *, substr(x, p, 2) AS u2, substr(x, p, 3) AS u3 FROM {name}_walk WHERE p <= length(x)))),
{name} AS (SELECT w, out FROM {name}_walk WHERE p > length(x)
           UNION ALL SELECT w, x FROM {words} WHERE NOT regexp_matches(x, '[a-zA-Z]'))"""


def folded(w: str) -> str:
    """Lower case unless all capitals (``ß`` has a longer capital form on the JVM)."""
    return f"CASE WHEN upper({w}) = {w} AND lower({w}) <> {w} AND strpos({w}, 'ß') = 0 THEN {w} ELSE lower({w}) END"


def tokens(src: str, cfg: TokenizerConfig = DEFAULT) -> str:
    """CTEs that end in ``tokens`` (id, toks): the token list of every row (id,
    text) of ``src``; a null text has none."""
    cases = policy_cases("tok", cfg, "[' ' || tok]", "[]::VARCHAR[]", "[' ' || {}]")
    special = f"^{special_pattern(cfg)}"
    split = f"list_transform({split_pieces('tok', cfg)}, lambda p: CASE WHEN regexp_matches(p, {lit(special)}) THEN ' ' || p ELSE p END)"
    return f"""{lexed(decoded(src), cfg)},
pieces AS (SELECT id, seg, ord, u.k, u.piece FROM (
    SELECT id, seg, ord, CASE WHEN regexp_full_match(tok, '[a-zA-Z]+') THEN [tok] {cases}
                              WHEN starts_with(tok, '..') THEN [' ...'] ELSE {split} END AS ps FROM toks),
  unnest(ps) WITH ORDINALITY AS u(piece, k)),
plain AS (SELECT DISTINCT piece AS w FROM pieces WHERE NOT starts_with(piece, ' ')),
short AS (SELECT w, {letters_squeezed('w', cfg.normalize)} AS x FROM plain),
{syllables_squeezed('short', 'cleaned')},
tokens AS (SELECT s.id, coalesce(t.toks, []) AS toks FROM src s LEFT JOIN (
    SELECT id, list(CASE WHEN starts_with(piece, ' ') THEN substr(piece, 2) ELSE {folded('c.out')} END ORDER BY seg, ord, k) AS toks
    FROM pieces LEFT JOIN cleaned c ON piece = c.w GROUP BY id) t ON s.id = t.id)"""
