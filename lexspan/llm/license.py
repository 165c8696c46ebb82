"""License scans: entire texts are brought to a canonical form, digested and hash-joined to known licence digests.

Canonical form: lower case; copyright notices go, as does "all rights reserved"; every run
of signs that are neither letters nor digits becomes one blank; a licence's title at the beginning goes; equivalent
spellings become one of them. So two copies of a licence that differ in case, punctuation, holders, line breaks, title
or spelling have equal digests. A notice
ends with its line, at a full stop or where a licence begins; a holder's name that is broken over two lines keeps its second part.
DataFrame functions only.

Defined results: a null text counts as empty; a text without letters or digits has no words, the digest of the
empty string, and no licence; repeated rows give repeated rows; when several known licences share a digest, the
smallest id wins; a very long text is read whole; an empty table gives an empty table; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = r"(?:\(c\)|©|&copy;)"
_YEAR = r"(?:[(\[<{]?(?:19|20)\d\d(?!\d)|[\[<{](?:year|yyyy))"
#: Words after "copyright" in running text; other words are a holder where a line begins with "copyright".
_NO_HOLDER = (
    r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|interests?|statements?|claims?|rights?|protections?|permissions?|information|infringements?|treat(?:y|ies)|acts?|terms?|messages?|"
    r"headers?|disclaimers?|grants?|management|material|works?|and|or|in|of|to|is|are|for|on|as|at|that|this|with|under|from|which|may|shall|must|will|can|has|have|does|do|not|if|be|was|were|applies|apply|applicable)"
)
_BEGINS = (
    r"(?:permission\s+(?:is|to)\s|redistribution\s+and\s+use|redistributions?\s+of\s|this\s+(?:software|program|library|file|package|work|code|product|project)\s|the\s+software\s+is\s|"
    r"this\s+is\s+free\s|(?:licen[cs]ed|released|distributed)\s+under|everyone\s+is\s+permitted|you\s+may\s|\S+\s+licen[cs]e\s|all\s+rights\s+reserved)"
)
#: A copyright notice in lower case, to the end of its line, a full stop (not one of an abbreviation or initial) or the beginning of a licence.
NOTICE = (
    rf"(?<![\p{{L}}\p{{N}}])(?:copyright\s*:?\s*(?:by\s+)?(?:{_SIGN}|,?\s*{_YEAR})|{_SIGN}\s*(?:copyright(?![\p{{L}}\p{{N}}]|\s+{_NO_HOLDER}(?![\p{{L}}\p{{N}}]))|{_YEAR})"
    rf"|(?<=^|\n)[ \t]*(?:copyright[ \t]*:?[ \t]+(?:by[ \t]+)?(?!{_NO_HOLDER}(?![\p{{L}}\p{{N}}]))(?=[\p{{L}}<\[{{])|©|\(c\)[ \t]*(?:[^\s.;]+[ \t]+){{1,5}}{_YEAR}(?=[ \t.]*(?:\n|\z)|[ \t.]+{_BEGINS})))"
    rf"[^\n]*?(?:(?=\n|\z)|(?=\s+{_BEGINS})|(?<![^\p{{L}}\p{{N}}](?:\p{{L}}|inc|ltd|corp|co|jr|sr|dr|mr|ms|st|al|etc|bros|dept|univ|intl))\.(?=[ \t]))"
)
RESERVED = r"all\s+rights\s+reserved\.?"
#: Titles in canonical form, as the public matching guidelines let them be left out: only at the very beginning.
TITLE = (
    r"^(?:the )?(?:(?:mit|expat|isc|x11|zlib|unlicense|boost software|(?:new |simplified |modified |revised )?bsd(?: (?:[0-9]|zero|two|three) clause)?|(?:[0-9]|two|three) clause bsd) licen[cs]e|mit no attribution|bsd zero clause licen[cs]e|unlicense)"
    r"(?: (?:mit|expat|isc|x11|zlib|0bsd|bsd|bsd [0-9] clause))?(?: version [0-9](?: [0-9])?)?(?: (?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9a-z]+ [0-9]{4})? "
)
#: What the SQL drops: any line that begins like a notice, and the closing formula.
SQL_LINE, SQL_RESERVED = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", r"all rights reserved\.?"
#: Equivalent spellings, as public licence-matching guidelines list them: fixed values, variant then chosen form.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"),
    ("licences", "licenses"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sub licensed", "sublicensed"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
#: Most known licences that are broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 10_000

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
#: Short licences that are known without a table of one's own (public texts).
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.\n" + _ISC_END,
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not "
    "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
    "but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
}


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """Replace column text by column out, the canonical form of the entire text.

    Two projections, so that the form before the spelling step is computed once; most texts have no variant at all.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, F.lit(NOTICE), F.lit(" "))
    t = F.regexp_replace(t, F.lit(RESERVED), F.lit(" "))
    t = F.trim(F.regexp_replace(t, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))
    df = df.withColumn(out, F.regexp_replace(t, F.lit(TITLE), F.lit(""))).drop(text)
    spelled = F.col(out)
    for variant, chosen in SPELLINGS:
        spelled = F.regexp_replace(spelled, F.lit(rf"(?<![^ ]){variant}(?![^ ])"), F.lit(chosen))
    any_variant = r"(?<![^ ])(?:" + "|".join(v for v, _ in SPELLINGS) + r")(?![^ ])"
    return df.withColumn(out, F.when(F.rlike(out, F.lit(any_variant)), spelled).otherwise(F.col(out)))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of the built-in short licences, or of one's own."""
    return spark.createDataFrame(sorted((texts or KNOWN).items()), "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words (of the canonical form), canonical_sha256, license_id (null if none)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    table = with_canonical(known.select("license_id", "text"), "text", "c").filter("c <> ''")
    table = table.groupBy(F.sha2("c", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    scanned = with_canonical(docs.select(docs["doc_id"], docs[text].alias("__t")), "__t", "__c")
    words = F.when(F.col("__c") == "", 0).otherwise(F.length("__c") - F.length(F.replace("__c", F.lit(" "), F.lit(""))) + 1).cast("long")
    scanned = scanned.select("doc_id", words.alias("n_words"), F.sha2("__c", 256).alias("canonical_sha256"))
    return scanned.join(table, "canonical_sha256", "left").select("doc_id", "n_words", "canonical_sha256", "license_id")


def _sql_canonical(column: str) -> str:
    t = f"regexp_replace(lower(coalesce({column}, '')), '{SQL_LINE}', chr(10), 'g')"
    t = f"regexp_replace({t}, '{SQL_RESERVED}', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    t = f"regexp_replace({t}, '{TITLE}', '')"
    out = f"replace(' ' || {t} || ' ', ' ', '  ')"
    for variant, chosen in SPELLINGS:
        out = f"replace({out}, ' {variant.replace(' ', '  ')} ', ' {chosen} ')"
    return f"trim(replace({out}, '  ', ' '))"


def scan_sql() -> str:
    """The same scan as DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
WITH known AS (SELECT sha256(c) AS canonical_sha256, min(license_id) AS license_id
               FROM (SELECT license_id, {_sql_canonical("text")} AS c FROM (VALUES {rows}) v(license_id, text)) WHERE c <> '' GROUP BY 1),
scanned AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents)
SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END::BIGINT AS n_words, sha256(c) AS canonical_sha256, license_id
FROM scanned LEFT JOIN known ON known.canonical_sha256 = sha256(c)
"""
