"""Operator 2 [native]: licence scans by canonical digest.

A text is normalised (copyright statements, case, equivalent spellings, punctuation, white space), and the SHA-256 of
the whole normalised text is joined to the digests of known licences. The same lookup is made for every line, which
finds short notices inside longer texts, and for runs of paragraphs, which finds whole licences inside longer texts: a
licence is there if all its paragraphs, with or without its title, follow each other, empty ones left out. The SQL makes
the same list and the same lookups.

Nulls and empty texts have the digest of the empty string and match nothing; repeated rows give repeated rows, an
empty table an empty result. A licence that is listed twice under one digest counts under its smallest name.
"""

from __future__ import annotations

import functools
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import saved

#: Spellings that count as one.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("merchantibility", "merchantability"), ("judgement", "judgment"),
    ("organisation", "organization"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"), ("https:", "http:"),
]

#: Known licence texts and notices, by SPDX name.
KNOWN = {
    "MIT": 'MIT License\nCopyright (c)\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'ISC License\nCopyright (c)\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: More texts and notices: whole texts by SPDX name, names by which notices call a licence, and SPDX identifiers.
LISTED = json.loads((Path(__file__).parent / "licenses.json").read_text(encoding="utf-8"))
NOTICE = [
    f"{a} {b}" for b in ("", "the ", "a ")
    for a in ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "Made available under", "This work is licensed under", "This software is licensed under",
              "This project is licensed under", "This file is licensed under", "This program is licensed under", "This document is licensed under", "This text is licensed under", "This code is licensed under",
              "This work is released under", "This software is released under", "This project is released under", "This software is distributed under", "License:", "Content licensed under")
]
PUBLIC_DOMAIN = ["This work is in the public domain.", "This file is in the public domain.", "This code is in the public domain.", "This software is in the public domain.", "Released into the public domain.", "Placed in the public domain.", "Dedicated to the public domain.", "Public domain."]

#: Words behind "copyright" that don't make a line a copyright statement.
NO_NAME = (
    "notices?|holders?|owners?|laws?|licen[cs](?:e|es|ed|or|ors|ing)|acts?|treat(?:y|ies)|statements?|interests?|protections?|permissions?|rights?|disclaimers?|infringements?|information|claims?"
    "|terms?|works?|materials?|status|and|or|in|to|is|are|of|for|by|on|under|as|with|that|which|if|shall|may|can|must|not"
)
#: A line that is a copyright statement: the word or a sign, then (c), a year, a place for one, or a name.
SIGNED = r"(?i:copyright)[ \t:,]*(?:\([cC]\)|©|[0-9]{4}|[<\[{(][ \t]*(?i:year|yyyy|dates?|name|owner|copyright))|©|\([cC]\)[ \t]*(?:(?i:copyright)|[0-9]{4}|[<\[{][ \t]*(?i:year|yyyy))"
COPYRIGHT = rf"(^|\n)[ \t*#/;-]*(?:{SIGNED}|(?i:copyright)[ \t:]+(?:by[ \t]+)?(?!(?i:{NO_NAME})(?!\p{{L}}))\p{{Lu}})[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
#: Marks in a text that is being normalised: a word that may belong to what a hyphen ends, and the end of a paragraph. Private characters, which texts lose first.
JOINED, ENDED = "\ue000", "\ue001"
#: Where paragraphs part, and how long a first paragraph may be to count as a title.
PARAGRAPH, TITLE = r"\n[ \t\r]*\n", 80


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    return functools.reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _merge(text: Column) -> Column:
    return _replace(text, (f" {JOINED}", ""), (JOINED, ""), ("copyright holder", "copyright owner"))


def marked_lines(text: Column) -> Column:
    """The lines that have letters or digits, each normalised once, and the mark ENDED as a line where a paragraph ends."""
    text = _replace(F.coalesce(text, F.lit("")), (JOINED, "¶"), (ENDED, "¶"))
    text = F.lower(F.regexp_replace(text, COPYRIGHT, "$1\f"))  # not an empty line, as that would end a paragraph
    text = F.regexp_replace(text, r"\b(?:(sub)-(\s++)(?=licen[cs]e)|(non)-(\s++)(?=commercial))", f"$1$3-$2$4{JOINED}")  # a spelling that a line's end may part
    text = F.regexp_replace(_replace(text, *SPELLINGS), PARAGRAPH, f"\n{ENDED}\n")
    lines = F.split(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}\n{JOINED}{ENDED}]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _whole(lines: Column) -> Column:
    return _merge(_replace(F.array_join(lines, " "), (f" {ENDED}", ""), (f"{ENDED} ", ""), (ENDED, "")))


def _paragraphs(lines: Column) -> Column:
    """Canonical paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(F.array_join(lines, " "), ENDED), lambda x: _merge(F.trim(x))), lambda x: x != "")


def canonical(text: Column) -> Column:
    return _whole(marked_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def listed() -> list[tuple[str, str]]:
    """(name, text) of all that is known: whole texts, and notices under a name that ends in -notice."""
    rows = [*KNOWN.items(), *map(tuple, LISTED["texts"])]
    rows += [(f"{k}-notice", a + n) for k, names in LISTED["names"].items() for n in names for a in NOTICE if k.startswith("CC") or not a.endswith(" a ")]
    rows += [(f"{k}-notice", f"SPDX-License-Identifier: {k}") for k in LISTED["spdx_ids"]]
    return rows + [("public-domain-notice", x) for x in PUBLIC_DOMAIN]


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    rows = listed() if texts is None else list(texts.items())
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.select(digest(F.col("text")).alias("known_digest"), "license_id").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def whole_texts() -> list[tuple[str, str]]:
    """(name, text) with paragraphs parted by empty lines: the texts of KNOWN have a paragraph a line."""
    return [*((k, x.replace("\n", "\n\n")) for k, x in KNOWN.items() if not k.endswith("-notice")), *map(tuple, LISTED["texts"])]


def known_runs(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (run_digest, run, name, j, n): paragraph j of the n of a run, a licence's paragraphs with its title or without."""
    rows = whole_texts() if texts is None else list(texts.items())
    df = spark.createDataFrame(rows, "name string, text string").select("name", marked_lines(F.col("text")).alias("_lines")).select("name", _paragraphs(F.col("_lines")).alias("all")).where(F.size("all") > 0)
    bare = df.where((F.size("all") > 1) & (F.length(F.get("all", F.lit(0))) <= TITLE)).select("name", F.slice("all", 2, F.size("all") - 1).alias("all"))
    both = df.union(bare).withColumn("run", F.sha2(F.concat_ws("|", "name", F.array_join("all", "|")).cast("binary"), 256))
    each = both.select("run", "name", F.size("all").alias("n"), F.posexplode("all").alias("j", "x"))
    return each.select(F.sha2(F.col("x").cast("binary"), 256).alias("run_digest"), "run", "name", "j", "n")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: DataFrame | None = None) -> DataFrame:
    """Rows (id, canonical_sha256, license_id, notice_ids, and with runs embedded_ids): notice_ids are the distinct names that lines match,
    embedded_ids those of runs of paragraphs, by name, comma-joined."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_text_md5"), marked_lines(text).alias("_lines"))  # rows of one id and text have the same notices
    piece = lambda kind, at, x: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), x.alias("x"))
    pieces = [F.array(piece("whole", F.lit(0), _whole(F.col("_lines")))), F.transform(F.filter("_lines", lambda x: x != ENDED), lambda x: piece("line", F.lit(0), _merge(x)))]
    none = F.lit(None)
    parts = [known.select(F.explode(F.array(F.lit("whole"), F.lit("line"))).alias("kind"), F.col("known_digest").alias("digest"), F.col("license_id").alias("name"), none.cast("string").alias("run"), none.cast("int").alias("j"), none.cast("int").alias("n"))]
    if runs is not None:
        pieces.append(F.transform(_paragraphs(F.col("_lines")), lambda x, i: piece("paragraph", i, x)))
        parts.append(runs.select(F.lit("paragraph").alias("kind"), F.col("run_digest").alias("digest"), "name", "run", "j", "n"))
    listed = saved(functools.reduce(DataFrame.unionByName, parts), "license-list")  # as files, its size is known to the join
    # one pass over the texts: a row for each document's whole, and what its lines and paragraphs hit
    pieces = docs.select("_id", "_text_md5", F.explode_outer(F.concat(*pieces)).alias("p")).select("_id", "_text_md5", "p.*").where("kind = 'whole' OR x <> ''")
    found = pieces.select("_id", "_text_md5", "kind", "at", F.sha2(F.col("x").cast("binary"), 256).alias("digest")).join(listed, ["kind", "digest"], "left").where("kind = 'whole' OR name IS NOT NULL")
    found = saved(found.withColumn("digest", F.when(F.col("kind") == "whole", F.col("digest"))), "license-hits")
    runs_hit = found.where("kind = 'paragraph'").groupBy("_id", "_text_md5", "run", "name", "n", (F.col("at") - F.col("j")).alias("_start")).agg(F.count_distinct("j").alias("_found")).where("_found = n")
    hits = found.where("kind = 'line'").select("_id", "_text_md5", "kind", "name").unionByName(runs_hit.select("_id", "_text_md5", F.lit("paragraph").alias("kind"), "name"))
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), ",")
    h, w = hits.groupBy("_id", "_text_md5").agg(names("line").alias("notice_ids"), names("paragraph").alias("embedded_ids")).alias("h"), found.where("kind = 'whole'").alias("w")
    out = w.join(h, F.col("w._id").eqNullSafe(F.col("h._id")) & (F.col("w._text_md5") == F.col("h._text_md5")), "left")
    told = ["notice_ids"] if runs is None else ["notice_ids", "embedded_ids"]
    return out.select(F.col("w._id").alias(id_col), F.col("w.digest").alias("canonical_sha256"), F.col("w.name").alias("license_id"), *[F.coalesce(f"h.{x}", F.lit("")).alias(x) for x in told])


def _sql_lines(table: str, key: str, text: str) -> str:
    """Rows (key, pos, line) of all lines, copyright statements emptied."""
    named = r"regexp_extract(line, '^[ \t*#/;-]*(?i:copyright)[ \t:]+(by[ \t]+)?(\p{Lu}\p{L}*)', 2)"
    statement = rf"regexp_matches(line, '^[ \t*#/;-]*(?:{SIGNED})') OR ({named} <> '' AND NOT regexp_full_match(lower({named}), '{NO_NAME}'))"
    return f"""(SELECT {key}, pos, CASE WHEN {statement} THEN '' ELSE line END AS line
  FROM (SELECT {key}, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT {key}, string_split(coalesce({text}, ''), chr(10)) AS lines FROM {table})))"""


def _sql_paragraphs(table: str, key: str, text: str) -> str:
    """Rows (key, at_j, x): canonical paragraphs that aren't empty, numbered from 0."""
    cut = f"(SELECT {key}, unnest(ps) AS body, unnest(range(len(ps))) AS p FROM (SELECT {key}, string_split_regex(coalesce({text}, ''), '{PARAGRAPH}') AS ps FROM {table}))"
    return f"""(SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS at_j, x FROM
  (SELECT {key}, p, {_sql_canonical("string_agg(line, chr(10) ORDER BY pos)")} AS x FROM {_sql_lines(cut, f"{key}, p", "body")} GROUP BY {key}, p) WHERE x <> '')"""


def _sql_canonical(x: str) -> str:
    x = rf"regexp_replace(lower({x}), '\b(sub|non)-\s+', '\1-', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace(trim(regexp_replace({x}, '{OTHER}', ' ', 'g')), 'copyright holder', 'copyright owner')"


def _sql_digest(x: str) -> str:
    return f"sha256({_sql_canonical(x)})"


def sql() -> str:
    """The list's rule is made anew: whole texts, each name behind each notice, each identifier."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    texts = [*KNOWN.items(), *map(tuple, LISTED["texts"])]
    names = [(k, n) for k, some in LISTED["names"].items() for n in some]
    return f"""
WITH listed AS (
  SELECT * FROM (VALUES {values(texts)}) t(license_id, body)
  UNION ALL SELECT k || '-notice', a || n FROM (VALUES {values(names)}) t(k, n), (VALUES {values([(a,) for a in NOTICE])}) u(a) WHERE k[1:2] = 'CC' OR a[-3:] <> ' a '
  UNION ALL SELECT k || '-notice', 'SPDX-License-Identifier: ' || k FROM (VALUES {values([(k,) for k in LISTED["spdx_ids"]])}) t(k)
  UNION ALL SELECT 'public-domain-notice', x FROM (VALUES {values([(x,) for x in PUBLIC_DOMAIN])}) t(x)),
numbered AS (SELECT *, row_number() OVER () AS i FROM listed),
known_text AS (SELECT i, string_agg(line, chr(10) ORDER BY pos) AS body FROM {_sql_lines("numbered", "i", "body")} GROUP BY i),
known AS (SELECT {_sql_digest("k.body")} AS known_digest, min(license_id) AS license_id FROM known_text k JOIN numbered USING (i) GROUP BY 1),
lines AS MATERIALIZED (SELECT * FROM {_sql_lines("documents", "doc_id", "text")}),
notices AS (SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notice_ids FROM lines JOIN known k ON {_sql_digest("line")} = k.known_digest WHERE line <> '' GROUP BY doc_id),
whole AS (SELECT doc_id, {_sql_digest("string_agg(line, chr(10) ORDER BY pos)")} AS canonical_sha256 FROM lines GROUP BY doc_id),
full_text AS (SELECT *, row_number() OVER () AS i FROM (VALUES {values(whole_texts())}) t(name, body)),
kp AS {_sql_paragraphs("full_text", "i", "body")}, dp AS {_sql_paragraphs("documents", "doc_id", "text")},
runs AS (SELECT i, 0 AS bare, at_j AS j, x, count(*) OVER (PARTITION BY i) AS n FROM kp UNION ALL
  SELECT i, 1, at_j - 1, x, count(*) OVER (PARTITION BY i) FROM kp WHERE at_j > 0 AND i IN (SELECT i FROM kp WHERE at_j = 0 AND length(x) <= {TITLE})),
hits AS (SELECT doc_id, r.i, bare, n, at_j - j AS start_at, count(DISTINCT j) AS found FROM dp JOIN runs r ON r.x = dp.x GROUP BY ALL HAVING count(DISTINCT j) = n),
inside AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS embedded_ids FROM hits JOIN full_text USING (i) GROUP BY 1)
SELECT w.doc_id, canonical_sha256, k.license_id, coalesce(n.notice_ids, '') AS notice_ids, coalesce(i.embedded_ids, '') AS embedded_ids
FROM whole w LEFT JOIN known k ON canonical_sha256 = k.known_digest LEFT JOIN notices n ON w.doc_id = n.doc_id LEFT JOIN inside i ON w.doc_id = i.doc_id"""
