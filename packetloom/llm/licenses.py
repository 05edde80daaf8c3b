"""Licence detection by canonical digest: whole texts, after normalisation, against known digests.

A unit is a document, one of its lines, a paragraph (lines between those without a letter or digit) or a comment block
(lines that begin with a comment sign), the last two of two lines at least. Lines that only name a copyright holder are dropped, spellings
that licence guidelines treat as equal are made one, case and punctuation go, white space becomes one
space; the SHA-256 of what is left is looked up. Everything is SQL functions; the known digests are
the short lists below, so the join may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements by which texts are put under a licence, and short licences in full.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
]

# Digests of the canonical forms of complete licences, wrapped as they are published and unwrapped, with and without a title;
# for MIT also of the paragraph that grants the licence.
TEXTS = [
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "3f45def1376d8af26a33a76f037e3e01f90560fd84cdcc11fea0c4f4288bb15d"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Unlicense", "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "594673f8fe0542761280c31fa6f0d1eca9f491e533af6c2c1fef40b1c4229b47"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9"),
    ("GPL-3.0", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("GPL-3.0", "bda82f3a202b0f0ebf2cc2ab21865abcd306566ed767f7335ad3f831da3f456a"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-2.1", "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "958f21dc8dffc8ff8e2cd52fee0a8a694d6cbc45344ba2aa6e9802e632a8fc03"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]

# Spellings that count as equal, applied to text in small letters whose punctuation is gone.
EQUIVALENT = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("colour", "color"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("per cent", "percent"),
]
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\"\"\")"
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright|\(c\)|©)[^\n]*"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = "[^a-z0-9]+"


def canonical(text: Column) -> Column:
    """Small ASCII letters and digits, one space between words, no copyright lines, one spelling."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower()), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, " "), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    known = spark.createDataFrame(KNOWN, "license string, notice string")
    texts = spark.createDataFrame(TEXTS, "license string, digest string")
    return known.select("license", F.sha2(canonical(F.col("notice")), 256).alias("digest")).union(texts).distinct()


def _runs(lines: Column, pattern: str, n: Column) -> Column:
    """(line, stop): the first lines and ends of the longest runs of lines that match `pattern`."""
    breaks = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.rlike(F.element_at(lines, i), F.lit(pattern)))
    begins = F.concat(F.array(F.lit(1)), F.transform(breaks, lambda i: i + 1))
    ends = F.concat(breaks, F.array(n + 1))
    return F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("line"), b.alias("stop"))), lambda r: r["stop"] > r["line"])


def block_units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, line, body) of the paragraphs and comment blocks of several lines that are not the whole text."""
    rows = docs.where(F.instr("text", "\n") > 0).select("doc_id", F.split("text", "\n").alias("_lines"))
    rows = rows.select("doc_id", "_lines", F.size("_lines").alias("_n"))

    def several(kind: str, runs: Column) -> Column:
        # a run that holds all there is to read is the document
        return F.when(
            (F.size(runs) > 1) | (F.element_at(runs, 1)["stop"] - F.element_at(runs, 1)["line"] < F.col("_n")),
            F.transform(F.filter(runs, lambda r: r["stop"] - r["line"] > 1), lambda r: F.struct(F.lit(kind).alias("unit"), r["line"].alias("line"), r["stop"].alias("stop"))),
        )

    runs = rows.select(
        "*", _runs(F.col("_lines"), "[A-Za-z0-9]", F.col("_n")).alias("_p"), _runs(F.col("_lines"), COMMENT, F.col("_n")).alias("_c")
    )
    # the only paragraph of a text is the document as well
    paragraphs = F.when(F.size("_p") > 1, several("paragraph", F.col("_p")))
    none = F.array().cast("array<struct<unit: string, line: int, stop: int>>")
    comments = F.when(F.size("_c") > 0, several("comment", F.col("_c")))
    found = runs.select("doc_id", "_lines", F.concat(F.coalesce(paragraphs, none), F.coalesce(comments, none)).alias("_blocks"))
    bodies = F.transform(
        "_blocks", lambda r: F.struct(r["unit"].alias("unit"), r["line"].alias("line"), F.array_join(F.slice("_lines", r["line"], r["stop"] - r["line"]), "\n").alias("body"))
    )
    return found.select("doc_id", F.inline(bodies))


def license_units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, line, license): `unit` is document, line, paragraph or comment, `line` (the first one) counts from 1
    and is null for documents. A block can be a paragraph and a comment.

    Null and empty texts match nothing. Of a text of one line only the document is looked up. A row that is
    repeated reports each of its copies. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.when(F.instr(text, "\n") > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    units = docs.select("doc_id", F.posexplode(F.concat(F.array(text), lines)).alias("line", "body"))
    units = units.select("doc_id", F.when(F.col("line") == 0, "document").otherwise("line").alias("unit"), "line", "body")
    known = known_digests(docs.sparkSession)
    return (
        # a unit without a letter is no licence; every other one is digested whole
        units.union(block_units(docs)).where(F.rlike("body", F.lit("[A-Za-z]")))
        .select("doc_id", "unit", "line", F.sha2(canonical(F.col("body")), 256).alias("_digest"))
        .join(F.broadcast(known), F.col("_digest") == known["digest"])
        .select("doc_id", "unit", F.when(F.col("line") > 0, F.col("line")).cast("long").alias("line"), "license")
    )


def twin_sql() -> str:
    """The same over the view `documents`, for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canonical_sql(column: str) -> str:
        out = f"regexp_replace(translate({column}, '{CAPITALS}', '{CAPITALS.lower()}'), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, '{NOT_WORD}', ' ', 'g') || ' '"
        for old, new in EQUIVALENT:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"

    known = ", ".join(f"({quoted(name)}, {quoted(notice)})" for name, notice in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {canonical_sql("notice")} AS digest FROM (VALUES {known}) v(license, notice)),
whole AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) AS line
  FROM whole WHERE contains(body, chr(10))
),
units AS (
  SELECT doc_id, 'document' AS unit, NULL::BIGINT AS line, body FROM whole
  UNION ALL SELECT doc_id, 'line', line, body FROM lines
)
SELECT doc_id, unit, line, license FROM units
JOIN known ON digest = {canonical_sql("body")}
WHERE regexp_matches(body, '[A-Za-z]')
"""
