"""Licence recognition by sentence rules.

A text is cut into sentences (wrapped lines are joined first), each sentence is normalised, and known licence
sentences become identifiers, also where a line break, a comment sign, a colon or the like has cut one into several
parts; all others are unknown. The sequence of identifiers, with a break wherever more than
`max_gap` unknown sentences lie between two known ones, is matched against ordered licence rules: the longest rules
come first, and what a rule has matched is used up. Identifiers that no rule uses are reported as unmatched.

Everything is a row-local expression: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import barrier, table

MAX_GAP = 20

#: Identifier -> normalised sentence (lower case, words and version numbers only).
SENTENCES = {
    "MIT_NAME": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                 "mit license", "the mit license", "distributed under the mit license"],
    "MIT_GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT_NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions "
                   "of the software"],
    "APACHE2_NAME": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                     "apache license version 2.0", "released under the apache license version 2.0",
                     "this project is licensed under the apache license version 2.0"],
    "APACHE2_COMPLY": ["you may not use this file except in compliance with the license"],
    "APACHE2_COPY": ["you may obtain a copy of the license at"],
    "APACHE2_ASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                     "on an as is basis without warranties or conditions of any kind either express or implied"],
    "BSD_GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
                  "following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following "
                   "disclaimer"],
    "BSD_BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                   "disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD_NAMES": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                  "products derived from this software without specific prior written permission"],
    "BSD_NAME": ["released under the bsd license", "licensed under the bsd license", "bsd license"],
    "GPL3_NAME": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                  "licensed under the gnu gpl version 3", "gnu general public license version 3", "licensed under gpl 3.0"],
    "GPL2_NAME": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
                  "gnu general public license version 2"],
    "GPL_FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                 "license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2_FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                  "license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL_HOPE": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                 "warranty of merchantability or fitness for a particular purpose"],
    "LGPL3_NAME": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"],
    "AGPL3_NAME": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"],
    "MPL2_FORM": ["this source code form is subject to the terms of the mozilla public license v. 2.0",
                  "licensed under the mozilla public license version 2.0", "mozilla public license version 2.0"],
    "ISC_GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "CCBY4_NAME": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CCBYSA4_NAME": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CCBYNC4_NAME": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CCBYND4_NAME": ["licensed under cc by nd 4.0"],
    "CCBYNCSA4_NAME": ["licensed under cc by nc sa 4.0"],
    "CC0_NAME": ["licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "RESERVED": ["all rights reserved"],
}

#: Licence and the ordered identifiers that state it. Longer rules are tried first, then in this order.
RULES = [
    ("Apache-2.0", ["APACHE2_NAME", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_ASIS"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("Apache-2.0", ["APACHE2_NAME", "APACHE2_COMPLY", "APACHE2_COPY"]),
    ("MIT", ["MIT_NAME", "MIT_GRANT", "MIT_NOTICE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("Apache-2.0", ["APACHE2_NAME", "APACHE2_COMPLY"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_HOPE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_HOPE"]),
    ("MIT", ["MIT_NAME"]), ("MIT", ["MIT_GRANT"]), ("Apache-2.0", ["APACHE2_NAME"]), ("BSD", ["BSD_NAME"]),
    ("GPL-3.0-or-later", ["GPL_FREE"]), ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("GPL-3.0", ["GPL3_NAME"]), ("GPL-2.0", ["GPL2_NAME"]), ("LGPL-3.0", ["LGPL3_NAME"]), ("AGPL-3.0", ["AGPL3_NAME"]),
    ("MPL-2.0", ["MPL2_FORM"]), ("ISC", ["ISC_GRANT"]), ("Unlicense", ["UNLICENSE"]),
    ("CC-BY-4.0", ["CCBY4_NAME"]), ("CC-BY-SA-4.0", ["CCBYSA4_NAME"]), ("CC-BY-NC-4.0", ["CCBYNC4_NAME"]),
    ("CC-BY-ND-4.0", ["CCBYND4_NAME"]), ("CC-BY-NC-SA-4.0", ["CCBYNCSA4_NAME"]), ("CC0-1.0", ["CC0_NAME"]),
    ("Proprietary", ["RESERVED"]),
]

#: Further forms, as the cutter yields them.
FORMS = {"MPL2_FORM": ["this source code form is subject to the terms of the mozilla public license v 2.0"]}
KNOWN = {name: forms + FORMS.get(name, []) for name, forms in SENTENCES.items()}

_WRAP = r"\n[ \t]*([a-z0-9(])"           # a line that goes on in lower case belongs to the line before
_STOP = r"([.!?;:])[ \t\r\n]+"
_JUNK = r"[^a-z0-9.]+"
_DOTS = r"\.([^0-9]|$)"                   # a full stop that is not inside a number
_COPYRIGHT = r"^(portions )?copyright (c )?[0-9]{4}( [0-9]{4})* [a-z]"


def sentences(text: Column) -> Column:
    """Normalised, non-empty sentences of a text in order."""
    joined = F.regexp_replace(text, _WRAP, " $1")
    parts = F.split(F.regexp_replace(joined, _STOP, "$1\n"), "\n")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), _JUNK, " "), _DOTS, " $1")))
    return F.filter(F.transform(clean, lambda s: F.trim(F.regexp_replace(s, " +", " "))), lambda s: s != "")


def identify(found: Column, known: dict[str, list[str]]) -> Column:
    """(first position, last position, identifier) of every known sentence, in order. One that was cut is the longest run
    of parts that make it up; parts of a run start no other. `found` must be a plain column."""
    all_forms = [form for forms in known.values() for form in forms]
    texts = F.create_map(*[F.lit(x) for name, forms in known.items() for form in forms for x in (form, name)])
    forms = F.array(*[F.lit(form) for form in all_forms])
    starts = "^(" + "|".join(sorted({form.split(" ")[0] for form in all_forms})) + ")( |$)"
    most = max(len(form.split(" ")) for form in all_forms)  # every part has a word

    def run(i, n):
        return F.element_at(texts, F.array_join(F.slice(found, i + 1, n), " "))

    def longest(s, i):
        begins = s.rlike(starts) & F.exists(forms, lambda form: F.startswith(form, F.concat(s, F.lit(" "))))
        lengths = F.filter(F.sequence(F.lit(1), F.least(F.lit(most), F.size(found) - i)), lambda n: run(i, n).isNotNull())
        return F.coalesce(F.when(begins, F.array_max(lengths)), F.lit(1))

    spans = F.transform(found, lambda s, i: F.struct(i.alias("pos"), longest(s, i).alias("n"), s.alias("s")))
    ids = F.transform(spans, lambda x: F.struct(x["pos"].alias("pos"), (x["pos"] + x["n"] - 1).alias("end"), F.coalesce(
        F.when(x["n"] > 1, run(x["pos"], x["n"])).otherwise(F.element_at(texts, x["s"])),
        F.when(x["s"].rlike(_COPYRIGHT), F.lit("COPYRIGHT"))).alias("id")))
    named = F.filter(ids, lambda x: x["id"].isNotNull())
    return F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.greatest(F.lit(1), i + 1 - most), F.least(i, F.lit(most))),
                                                  lambda y: y["end"] >= x["pos"]))


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] = KNOWN, rules=RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """Documents that hold at least one known licence sentence.

    Returns doc_id, licenses (by rule order, each once), n_matches (rule matches), sentence_ids (in text order) and
    unmatched (identifiers no rule has used, in text order). Null and empty texts hold no sentence and are not
    returned; repeated rows are reported each; other columns are ignored."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    table_ = F.array(*[F.struct(F.lit(name).alias("license"), F.lit("".join(f"<{i}>" for i in ids)).alias("pattern"))
                       for name, ids in ordered])
    rows = barrier(docs.select("doc_id", "text"), "found", sentences(F.col("text")))
    rows = barrier(rows.select("doc_id", "found"), "ids", identify(F.col("found"), known)).drop("found").where(F.size("ids") > 0)
    text = F.lit("")
    # copyright lines are evidence but part of no rule; they stay out of the matched sequence
    sequence = F.aggregate(
        F.filter("ids", lambda x: x["id"] != "COPYRIGHT"),
        F.struct(text.alias("seq"), F.lit(-1).alias("last")),
        lambda acc, x: F.struct(
            F.concat(acc["seq"], F.when((acc["last"] >= 0) & (x["pos"] - acc["last"] - 1 > max_gap), F.lit("|")).otherwise(F.lit("")),
                     F.lit("<"), x["id"], F.lit(">")).alias("seq"), x["end"].alias("last")),
        lambda acc: acc["seq"])
    start = F.struct(F.col("seq").alias("rest"), F.array().cast("array<string>").alias("found"), F.lit(0).alias("n"))

    def use(acc, rule):
        after = F.replace(acc["rest"], rule["pattern"], F.lit("|"))
        hits = ((F.length(acc["rest"]) - F.length(after)) / (F.length(rule["pattern"]) - 1)).cast("int")
        return F.struct(after.alias("rest"),
                        F.when(hits > 0, F.array_append(acc["found"], rule["license"])).otherwise(acc["found"]).alias("found"),
                        (acc["n"] + hits).alias("n"))

    return (rows.withColumn("seq", sequence)
            .withColumn("m", F.aggregate(table_, start, use))
            .select("doc_id", F.array_distinct("m.found").alias("licenses"), F.col("m.n").cast("long").alias("n_matches"),
                    F.transform("ids", lambda x: x["id"]).alias("sentence_ids"),
                    F.regexp_extract_all(F.col("m.rest"), F.lit("<([^>]*)>"), 1).alias("unmatched")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    forms = ", ".join(f"('{f}', '{name}')" for name, fs in SENTENCES.items() for f in fs)
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    sql = f"""
WITH known(form, id) AS (VALUES {forms}),
cut AS (SELECT row_number() OVER () AS k, doc_id, list_filter(list_transform(string_split(regexp_replace(
    regexp_replace(text, '\\n[ \\t]*([a-z0-9(])', ' \\1', 'g'), '([.!?;:])[ \\t\\r\\n]+', '\\1\n', 'g'), chr(10)),
  lambda s: trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'),
    '\\.([^0-9]|$)', ' \\1', 'g')), ' +', ' ', 'g'))), lambda s: s <> '') AS ss FROM documents),
sent AS (SELECT k, doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM cut),
named AS (SELECT k, doc_id, pos, coalesce(id, CASE WHEN regexp_matches(s, '{_COPYRIGHT}') THEN 'COPYRIGHT' END) AS id
  FROM sent LEFT JOIN known ON s = form),
gaps AS (SELECT k, pos, id, lag(pos) OVER (PARTITION BY k ORDER BY pos) AS last FROM named WHERE id <> 'COPYRIGHT'),
m0 AS (SELECT k, string_agg(CASE WHEN pos - last - 1 > {MAX_GAP} THEN '|' ELSE '' END || '<' || id || '>', '' ORDER BY pos) AS rest,
  CAST([] AS VARCHAR[]) AS found, 0 AS n FROM gaps GROUP BY k)"""
    for i, (name, ids) in enumerate(ordered):
        pat = "".join(f"<{x}>" for x in ids)
        sql += f""",
m{i + 1} AS (SELECT k, replace(rest, '{pat}', '|') AS rest,
  CASE WHEN contains(rest, '{pat}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found,
  n + (length(rest) - length(replace(rest, '{pat}', '|'))) // {len(pat) - 1} AS n FROM m{i})"""
    return sql + f""",
ids AS (SELECT k, any_value(doc_id) AS doc_id, list(id ORDER BY pos) AS sentence_ids FROM named WHERE id IS NOT NULL GROUP BY k)
SELECT doc_id, coalesce(found, []) AS licenses, coalesce(n, 0)::BIGINT AS n_matches, sentence_ids,
  coalesce(regexp_extract_all(rest, '<([^>]*)>', 1), []) AS unmatched
FROM ids LEFT JOIN m{len(ordered)} USING (k)
"""


ORACLE = _oracle()
