"""Licence detection by canonical digests of entire texts.

A text is brought to a canonical form - case, punctuation, copyright lines, list
marks and equivalent spellings no longer matter - and the digest of all of it is
looked up among those of known licences. The same form is looked up for each line on
its own, which finds short notices within other texts. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.session import stored

# Texts of public licences and notices, which must be as published.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
ZERO_BSD = """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD_2 = """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
#: Fixed values: (licence, MD5 of the canonical form of its whole published text).
DIGESTS = (
    ("Apache-2.0", "78595e4b5a47cff6ba1e5dc34a5c411a"),
    ("Artistic-1.0-Perl", "dc4a091dae3cbb0eaa99c7976db9c452"),
    ("BSD-3-Clause", "669fb5c886d64c4af4448ac0f6641673"),
    ("CC0-1.0", "ffa8ed2ac3885fbcd7505890bbc413dd"),
    ("GFDL-1.2", "9c4ac8de993c0ffa7ff6e7d5622c4d4f"),
    ("GFDL-1.3", "def80ccbf1b3c69c05bcc3ed25ff5d2e"),
    ("GPL-1.0", "29ed6cb03107176e9fb98a6de359a1cb"),
    ("GPL-2.0", "26b2bfb32c731688a49c7316842df11c"),
    ("GPL-3.0", "febacd52ab2d8337fbb8fb6b03f2dfe7"),
    ("LGPL-2.0", "a6c71e468cb3a74b32d790234a6b452d"),
    ("LGPL-2.1", "86d8dfebdf105230da0149a95ab44835"),
    ("LGPL-3.0", "45ec14853d944805ef573d0b3a40cda3"),
    ("MPL-1.1", "d9ee2de305de355bbd6fbfb79a4e8338"),
    ("MPL-2.0", "4cb33a85d42c23a40cfd9b0a96de1127"),
)
_TITLED = (("MIT", MIT), ("ISC", ISC), ("0BSD", ZERO_BSD), ("BSD-2-Clause", BSD_2))
_IDS = sorted({name for name, _ in DIGESTS + _TITLED} | {"CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0"})


def spdx_lines(ids=_IDS):
    """(licence, line) of the identifier lines of licences; those of the GNU family have forms of their own."""
    for name in ids:
        forms = [name] + [f"{name}-{form}" for form in ("only", "or-later")] * (name[0] in "GL" and "GPL" in name)
        yield from ((name, f"SPDX-License-Identifier: {form}") for form in forms)


#: (licence, text). Callers may give a larger table of the same columns.
KNOWN = (
    *_TITLED,
    # They come without their title as well.
    *((name, text.split("\n", 1)[1]) for name, text in _TITLED),
    *spdx_lines(),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
)
#: Spellings that count as equal, after lower-casing and removal of punctuation.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("per cent", "percent"),
)
#: Lines that go: who holds the copyright, and the reservation of rights.
COPYRIGHT_LINE = r"(^|\n)[^\n\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©|<|\[|[0-9])|\(c\)|©)[^\n]*"
RIGHTS_LINE = r"(^|\n)[^\n\p{L}\p{N}]*all rights reserved[^\n\p{L}\p{N}]*"
#: Numbers and letters of a list, before the line's text.
LIST_MARK = r"(^|\n)[ \t]*\(?([0-9]{1,2}|[a-h])[.)][ \t]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text: words of letters and digits, one blank between."""
    plain = F.lower(text)
    plain = F.regexp_replace(plain, COPYRIGHT_LINE, "\n")
    plain = F.regexp_replace(plain, RIGHTS_LINE, "\n")
    plain = F.regexp_replace(plain, LIST_MARK, "\n")
    # Two blanks between words, so that neighbours can both be replaced.
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, NOT_WORD, "  "), F.lit(" "))
    for variant, usual in EQUIVALENT:
        plain = F.replace(
            plain, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} ")
        )
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(digest, license) of known texts and digests; the first licence by name where two are equal."""
    table = known
    if not isinstance(known, DataFrame):
        table = spark.createDataFrame(list(known), "license string, text string")
    told = spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license")
    found = table.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").unionByName(told)
    return found.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """Per document: doc_id, digest, license, notices.

    `digest` is that of the canonical form of the entire text, `license` the known
    licence with that digest, else null. `notices` are the known licences of which a
    text is one line of the document: sorted, without repeats. `known` is a list of (licence, text) or a
    table of these columns, `digests` one of (licence, digest). A null text counts as empty; a text without words in its
    canonical form has a null digest, no licence and no notices. Null doc_ids and repeated
    rows stay as rows; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    form = canonical(text)
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))
    digests = stored(known_digests(docs.sparkSession, known, digests))
    whole = rows.select("doc_id", "row_key", form.alias("form"))
    whole = whole.select("doc_id", "row_key", F.when(F.col("form") != "", F.md5("form")).alias("digest"))
    lines = rows.filter(F.contains("text", F.lit("\n")) | (F.col("text") != ""))
    lines = lines.select("row_key", F.explode(F.split("text", "\n")).alias("text"))
    found = (
        lines.select("row_key", F.md5(canonical(F.col("text"))).alias("digest"))
        .join(digests, "digest")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set("license")).alias("notices"))
    )
    return (
        whole.join(digests, "digest", "left")
        .join(found, "row_key", "left")
        .select(
            "doc_id",
            "digest",
            "license",
            F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
        )
    )


def oracle(known=KNOWN) -> str:
    """DuckDB SQL for `scan` over documents."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    form = f"regexp_replace(lower(t), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    form = f"regexp_replace({form}, {quoted(RIGHTS_LINE)}, chr(10), 'g')"
    form = f"regexp_replace({form}, {quoted(LIST_MARK)}, chr(10), 'g')"
    form = f"' ' || regexp_replace({form}, {quoted(NOT_WORD)}, '  ', 'g') || ' '"
    for variant, usual in EQUIVALENT:
        a, b = (f" {x.replace(' ', '  ')} " for x in (variant, usual))
        form = f"replace({form}, {quoted(a)}, {quoted(b)})"
    macro = f"trim(replace({form}, '  ', ' '))"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known)
    digests = ", ".join(f"({quoted(digest)}, {quoted(name)})" for name, digest in DIGESTS)
    return f"""
WITH k AS (SELECT md5(f) AS digest, min(license) AS license FROM (
  SELECT license, {macro} AS f FROM (VALUES {values}) v(license, t)) GROUP BY 1
  UNION ALL VALUES {digests}),
d AS (SELECT doc_id, text AS t, {macro} AS f FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS t FROM documents)),
n AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS notices FROM (
  SELECT doc_id, md5({macro}) AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS t FROM d)) x
  JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f <> '' THEN md5(f) END AS digest, k.license,
  array_to_string(coalesce(notices, []), ',') AS notices
FROM d LEFT JOIN k ON k.digest = md5(f) LEFT JOIN n ON n.doc_id = d.doc_id"""
