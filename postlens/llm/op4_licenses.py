"""License scans by sentence rules.  DataFrame functions only.

Every whole text is cut into sentences, each sentence is normalised (ASCII
letters and digits, lower case, single blanks) and mapped to the identifier of
a known license sentence.  The identifiers of a text, in order, form a
sequence against which the ordered rules are matched: a rule is a sequence of
adjacent identifiers; an earlier (more specific) rule takes its identifiers out
of the sequence, later rules see what is left.

Sentences end at ``.``, ``!`` or ``?`` before white space and at blank lines.
Since long license texts are wrapped while notices stand on lines of their own,
such a sentence is looked up as a whole first, its line ends read as blanks;
if it is not known, each of its lines is looked up as a sentence.  So either
kind is found wherever it stands, in the order of the text and none twice.
``n_sentences`` counts lines as sentences.

Defined results: a null or empty text has no sentences and no license;
``licenses`` lists every recognised license once per occurrence, in rule order;
the bytes 0x01 and 0x02 in a text end a sentence and a line; repeated rows are scanned one by one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Known license sentences (fixed values): identifier, normalised sentence.
TEXTS = (
    ("mit_notice", "released under the mit license"),
    ("mit_notice", "licensed under the mit license"),
    ("mit_notice", "this project is licensed under the mit license"),
    ("mit_title", "the mit license"),
    ("mit_title", "mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"),
    ("mit_keep", "the above copyright notice and this permission notice shall be included in all copies or "
                 "substantial portions of the software"),
    ("as_is", "the software is provided as is without warranty of any kind express or implied including but not "
              "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2_notice", "licensed under the apache license version 2 0"),
    ("apache2_notice", "licensed under the apache license version 2 0 the license"),
    ("apache2_notice", "released under the apache license version 2 0"),
    ("apache2_title", "apache license version 2 0"),
    ("apache2_use", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl3_notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3_notice", "licensed under the gnu general public license version 3"),
    ("gpl3_notice", "released under the gnu general public license version 3"),
    ("gpl2_notice", "this work is licensed under the gnu general public license version 2"),
    ("gpl2_notice", "licensed under the gnu general public license version 2"),
    ("gpl_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                 "general public license as published by the free software foundation either version 3 of the "
                 "license or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without "
                 "even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl3_notice", "licensed under the gnu lesser general public license version 3"),
    ("agpl3_notice", "licensed under the gnu affero general public license version 3"),
    ("mpl2_notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd_redistribute", "redistribution and use in source and binary forms with or without modification are "
                         "permitted provided that the following conditions are met"),
    ("bsd3_notice", "licensed under the bsd 3 clause license"),
    ("bsd2_notice", "licensed under the bsd 2 clause license"),
    ("cc_by_notice", "licensed under cc by 4 0"),
    ("cc_by_sa_notice", "licensed under cc by sa 4 0"),
    ("cc_by_nc_notice", "licensed under cc by nc 4 0"),
    ("cc_by_nc_notice", "this work is licensed under cc by nc 4 0"),
    ("cc0_notice", "released under cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)

#: Names of licenses in notices (fixed values): identifier, normalised name with its article.
NAMES = (
    ("mit_notice", "the mit license"),
    ("apache2_notice", "the apache license version 2 0"),
    ("apache2_notice", "the apache license 2 0"),
    ("gpl2_notice", "the gnu general public license version 2"),
    ("gpl3_notice", "the gnu general public license version 3"),
    ("lgpl3_notice", "the gnu lesser general public license version 3"),
    ("agpl3_notice", "the gnu affero general public license version 3"),
    ("mpl2_notice", "the mozilla public license version 2 0"),
    ("bsd2_notice", "the bsd 2 clause license"),
    ("bsd3_notice", "the bsd 3 clause license"),
    ("cc_by_notice", "cc by 4 0"),
    ("cc_by_sa_notice", "cc by sa 4 0"),
    ("cc_by_nc_notice", "cc by nc 4 0"),
    ("cc0_notice", "cc0 1 0"),
    ("unlicense", "the unlicense"),
)
#: Beginnings of notices (fixed values).
HEADS = ("licensed under", "released under", "distributed under", "this project is licensed under",
         "this work is licensed under", "this software is licensed under")
SPDX = "spdx license identifier"

#: Ordered rules (fixed values): license, class, adjacent sentence identifiers.
TEXT_RULES = (
    ("Apache-2.0", "permissive", ("apache2_notice", "apache2_use", "apache2_copy")),
    ("Apache-2.0", "permissive", ("apache2_notice", "apache2_use")),
    ("MIT", "permissive", ("mit_title", "mit_grant", "mit_keep", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_keep", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_keep")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free", "gpl_hope")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free",)),
    ("Apache-2.0", "permissive", ("apache2_notice",)),
    ("Apache-2.0", "permissive", ("apache2_title",)),
    ("MIT", "permissive", ("mit_notice",)),
    ("MIT", "permissive", ("mit_grant",)),
    ("MIT", "permissive", ("mit_title",)),
    ("GPL-3.0", "copyleft", ("gpl3_notice",)),
    ("GPL-2.0", "copyleft", ("gpl2_notice",)),
    ("LGPL-3.0", "copyleft", ("lgpl3_notice",)),
    ("AGPL-3.0", "copyleft", ("agpl3_notice",)),
    ("MPL-2.0", "copyleft", ("mpl2_notice",)),
    ("BSD-3-Clause", "permissive", ("bsd3_notice",)),
    ("BSD-2-Clause", "permissive", ("bsd2_notice",)),
    ("BSD", "permissive", ("bsd_redistribute",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc_by_nc_notice",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_notice",)),
    ("CC-BY-4.0", "permissive", ("cc_by_notice",)),
    ("CC0-1.0", "permissive", ("cc0_notice",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("Reserved", "proprietary", ("reserved",)),
)



def _normal(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _tagged() -> tuple[tuple[str, str, str], ...]:
    """(identifier, license, class) of the licenses that a tag line can name."""
    named = dict.fromkeys((name, kind) for name, kind, _ in TEXT_RULES if name not in ("BSD", "Reserved"))
    return tuple((f"spdx_{_normal(name).replace(' ', '_')}", name, kind) for name, kind in named)


#: All known sentences: the texts, every beginning of a notice with every name, and the tag lines.
SENTENCES = tuple((name, said) for said, name in {
    **{f"{SPDX} {_normal(name)}": tag for tag, name, _ in _tagged()},
    **{f"{head} {terms}{name}": tag for tag, name in NAMES for head in HEADS for terms in ("", "the terms of ")},
    **{said: tag for tag, said in TEXTS}}.items())
RULES = TEXT_RULES + tuple((name, kind, (tag,)) for tag, name, kind in _tagged())

#: Sentence ends; single line ends are left.
ENDS = "[.!?][\\x20\\x09-\\x0D]+|\\n[\\x20\\x09\\x0B-\\x0D]*\\n"
#: Stand after the sentences and the lines of a normalised text; any other control byte is dropped.
MARK, LINE = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """Words in lower case between single blanks, sentences ended by MARK, lines inside them by LINE."""
    marked = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), ENDS, MARK), "\n", LINE)
    return F.lower(F.regexp_replace(marked, "[^A-Za-z0-9\\x01\\x02]+", " "))


def count_sentences(plain: Column) -> Column:
    pieces = F.split(plain, "[\\x01\\x02]")
    return F.size(F.filter(pieces, lambda s: ~s.isin("", " "))).cast("bigint")


def known_ids(plain: Column, table) -> Column:
    """Identifiers of the known sentences of a normalised text, in order."""
    ids = F.create_map(*[F.lit(x) for name, said in table for x in (said, name)])
    none = F.expr("array()").cast("array<string>")

    def whole(b: Column) -> Column:
        return F.trim(F.when(F.contains(b, F.lit(LINE)), F.regexp_replace(b, "[ \\x02]+", " ")).otherwise(b))

    looked = F.transform(F.split(plain, MARK), lambda b: F.struct(b.alias("said"), F.element_at(ids, whole(b)).alias("id")))
    lines = lambda said: F.filter(F.transform(F.split(said, LINE), lambda s: F.element_at(ids, F.trim(s))), lambda i: i.isNotNull())
    return F.flatten(F.transform(looked, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"]))
                                 .when(F.contains(x["said"], F.lit(LINE)), lines(x["said"])).otherwise(none)))


def match_rules(ids: Column, rules) -> Column:
    """(license, class) of every rule that fits the identifier sequence, in rule order.

    The sequence is written ``|a||b||c|``; a rule's text ``|a||b|`` is a plain
    substring of it, and is blanked once matched.
    """
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("class"),
                               F.lit("".join(f"|{s}|" for s in seq)).alias("seq")) for name, kind, seq in rules])
    start = F.struct(F.concat(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), ""),
                              F.lit("")).alias("left"),
                     F.expr("array()").cast("array<struct<license:string,class:string>>").alias("found"))
    return F.aggregate(table, start, lambda acc, r: F.struct(
        F.replace(acc["left"], r["seq"], F.lit("|-|")).alias("left"),
        F.concat(acc["found"], F.array_repeat(
            F.struct(r["license"].alias("license"), r["class"].alias("class")),
            ((F.length(acc["left"]) - F.length(F.replace(acc["left"], r["seq"], F.lit("")))) / F.length(r["seq"]))
            .cast("int"))).alias("found")), lambda acc: acc["found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  table=SENTENCES, rules=RULES) -> DataFrame:
    """``id_col``, n_sentences, ids (array), found (array of license, class) per row of ``docs``."""
    read = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("plain"))
    read = read.select("id", count_sentences(F.col("plain")).alias("n_sentences"), known_ids(F.col("plain"), table).alias("ids"))
    none = F.expr("array()").cast("array<struct<license:string,class:string>>")
    return read.select(F.col("id").alias(id_col), "n_sentences", "ids",
                       F.when(F.size("ids") > 0, match_rules(F.col("ids"), rules)).otherwise(none).alias("found"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.size("ids").cast("bigint").alias("n_license_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["class"]))), ",").alias("classes"))


def _sql() -> str:
    names = "MAP {" + ", ".join(f"'{s}': '{n}'" for n, s in SENTENCES) + "}"

    plain = (f"lower(regexp_replace(translate(regexp_replace(coalesce(text, ''), '{ENDS}', chr(1), 'g'), chr(10), chr(2)), "
             f"'[^A-Za-z0-9\\x01\\x02]+', ' ', 'g'))")
    whole = "trim(regexp_replace(b, '[ \\x02]+', ' ', 'g'))"
    lines = ("list_filter(list_transform(string_split(b, chr(2)), lambda s: CASE WHEN map_contains(m, trim(s)) THEN m[trim(s)] END), "
             "lambda i: i IS NOT NULL)")

    steps, prev = [], "seq0"
    for k, (name, kind, seq) in enumerate(RULES):
        pat = "".join(f"|{s}|" for s in seq)
        steps.append(f"s{k} AS (SELECT * EXCLUDE (seq, found), replace(seq, '{pat}', '|-|') AS seq, "
                     f"list_concat(found, list_transform(range((length(seq) - length(replace(seq, '{pat}', ''))) "
                     f"// {len(pat)}), lambda x: {{'license': '{name}', 'class': '{kind}'}})) AS found FROM {prev})")
        prev = f"s{k}"
    return f"""
WITH names AS (SELECT {names} AS m),
read AS (SELECT doc_id, {plain} AS plain FROM documents),
best AS (SELECT doc_id, len(list_filter(string_split(replace(plain, chr(2), chr(1)), chr(1)), lambda s: trim(s) <> '')) AS n_sentences,
                flatten(list_transform(string_split(plain, chr(1)), lambda b: CASE WHEN map_contains(m, {whole}) THEN [m[{whole}]]
                                       ELSE {lines} END)) AS ids FROM read, names),
seq0 AS (SELECT *, list_aggregate(list_transform(ids, lambda i: '|' || i || '|'), 'string_agg', '') AS seq,
                []::STRUCT(license VARCHAR, class VARCHAR)[] AS found FROM best WHERE len(ids) > 0),
{", ".join(steps)}
SELECT b.doc_id, b.n_sentences, len(b.ids) AS n_license_sentences,
       coalesce(array_to_string(b.ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_transform(found, lambda x: x.license), ','), '') AS licenses,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.class))), ','), '') AS classes
FROM best b LEFT JOIN {prev} f ON b.doc_id = f.doc_id
"""


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE_SQL = {"op4_license_scan": _sql()}
