"""License scans: canonical digests of entire texts, looked up among known ones.

The canonical form of a text: A-Z lowered; typographic quotes and dashes as ASCII
punctuation; every run of ASCII characters that are neither letters nor digits one
space; variant spellings, words and phrases, replaced by the one that ``SPELLINGS``
names. In texts that hold one of ``SIGNS``, as licences do, lines that only claim
copyright, title lines ("The MIT License (MIT)") and list markers (``1.``, ``a)``)
are left out first. Two texts with one canonical form have one SHA-256, so a
licence is found by a hash join of digests, whatever its case, wrapping, bullets,
title and owner.

Texts are looked up at two grains: the whole text among ``licences`` (full licence
texts; the built-in ones are the files of ``licence_texts``, with and without what
follows their end line), and each of its lines among ``notices`` (one-line
statements, made by rule from the licences' names). Notices are literals, so lines
never leave their row; the join carries a digest a row, and Spark broadcasts the
licences or shuffles by digest, whichever their size asks for.

Everything is SQL functions. Defined results: a null or empty text, or one without
letters and digits, has the digest of the empty string and no licence; equal texts
get equal results and repeated rows stay; of equal licences the least id by name
wins; an empty table gives an empty table; columns that clash with an added name
are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic characters and what they become.
TYPOGRAPHIC, PLAIN = "‘’“”„«»–—−… •", "''\"\"\"\"\"---. -"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lines that only claim copyright.
COPYRIGHT_LINE = r"^[^a-z0-9©]*(portions )?(copyright *(\(c\)|©|[0-9<\[{]|by )|\(c\) *[0-9<\[{]|© *[0-9<\[{a-z]|all rights reserved[^a-z0-9]*$)"
#: Equivalent spellings, the variant and the one that stays.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "colour": "color",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "merchantibility": "merchantability",
    "modelling": "modeling",
    "noninfringement": "non infringement",
    "normalise": "normalize",
    "optimise": "optimize",
    "organisation": "organization",
    "percent": "per cent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: A text with one of these, in lower case, is read as a licence would be.
SIGNS = ("copyright", "licens", "licenc", "warrant", "(c)", "©", "all rights reserved")
_TITLE_WORD = (
    "(the|a|and|mit|expat|x11|isc|zlib|libpng|bsd|freebsd|new|modified|simplified|revised|original|free|clause|version|v|apache|gnu|general|public|lesser|library|"
    "affero|documentation|mozilla|boost|software|artistic|unlicense|attribution|no|legal|code|universal|cc0|mpl|gpl|lgpl|text|[0-9]+)"
)
#: A line of nothing but words of licence names, "license" among them.
TITLE_LINE = f"^[^a-z0-9]*({_TITLE_WORD}[^a-z0-9]+)*licen[sc]e([^a-z0-9]+{_TITLE_WORD})*[^a-z0-9]*$"
#: A list marker that stands alone between white space.
MARKER = r" [(]?([0-9][0-9]?|[a-z])[.)] "
BLANKS = r"[\x20\x09-\x0D]+"

#: What follows this line in a licence text is advice on its use.
_END_LINE = "END OF TERMS AND CONDITIONS"


def _texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


#: Public licence texts by their SPDX id. Callers with more of them hand in a table.
LICENCES = _texts()


def _variants(licences: dict[str, str]) -> list[tuple[str, str]]:
    """Each licence's text, and its terms alone where advice follows them."""
    cut = [(k, t[: t.index(_END_LINE) + len(_END_LINE)]) for k, t in licences.items() if _END_LINE in t]
    return sorted([*licences.items(), *cut])


#: Names that notices use, by SPDX id.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0 (the \"License\")"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
#: What stands before a name in a notice.
FORMS = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "Distributed under the {}", "This work is licensed under the {}", "This software is licensed under the {}", "This project is licensed under the {}")


def _notices() -> dict[str, str]:
    found = {form.format(name): k for k, names in NAMES.items() for name in names for form in FORMS}
    found |= {f"SPDX-License-Identifier: {k}{more}": k for k in {*NAMES, *LICENCES} for more in ("", *(("-only", "-or-later") if "GPL" in k or "GFDL" in k else ()))}
    return dict(sorted(found.items()))


#: One-line statements of a licence.
NOTICES = _notices()
#: Notices are literals of the plan; a longer list belongs among the licences.
MOST_NOTICES = 500


def _folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + TYPOGRAPHIC, LOWER + PLAIN)


def _wide(words: str) -> str:
    """``words`` as they stand in a text whose every word has a space of its own on both sides."""
    return " " + words.replace(" ", "  ") + " "


def _spelled(words: Column) -> Column:
    """``words`` with spellings replaced; most have none and are only looked through once."""
    any_variant = "(^| )(" + "|".join(SPELLINGS) + ")( |$)"
    wide = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, stays in SPELLINGS.items():
        wide = F.replace(wide, F.lit(_wide(variant)), F.lit(f" {stays} "))
    return F.when(words.rlike(any_variant), F.trim(F.regexp_replace(wide, " +", " "))).otherwise(words)


def _canonical_line(folded: Column) -> Column:
    return _spelled(F.trim(F.regexp_replace(folded, SEPARATORS, " ")))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    folded = _folded(text)
    rest = F.array_join(F.filter(F.split(folded, "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE) & ~x.rlike(TITLE_LINE)), "\n")
    wide = F.concat(F.lit(" "), F.regexp_replace(rest, BLANKS, "  "), F.lit(" "))
    some = reduce(or_, [F.contains(folded, F.lit(x)) for x in SIGNS])
    return _canonical_line(F.when(some, F.regexp_replace(wide, MARKER, " ")).otherwise(folded))


def registry(spark, licences: dict[str, str] = LICENCES) -> DataFrame:
    """``licence, text`` of the built-in licences, several rows of one licence where its text has several forms."""
    return spark.createDataFrame(_variants(licences), "licence string, text string")


def license_scan(docs: DataFrame, licences: DataFrame, text: str = "text", *, licence_id: str = "licence", licence_text: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """``docs`` with ``canonical_sha256, licence`` (string), ``n_notices`` (long), ``notice_licences`` (string, sorted, comma-joined) and ``licensed`` (boolean)."""
    if len(notices) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices; put them among the licences")
    added = ["canonical_sha256", "licence", "n_notices", "notice_licences", "licensed"]
    rest = [c for c in docs.columns if c not in added]
    known = licences.select(F.sha2(canonical(F.col(licence_text)), 256).alias("__digest"), F.col(licence_id).alias("__licence"), F.length(canonical(F.col(licence_text))).alias("__n"))
    known = known.where("__n > 0").groupBy("__digest").agg(F.min("__licence").alias("__licence"))
    own = docs.sparkSession.createDataFrame([(n,) for n in notices] or [("",)], "n string").select("n", _canonical_line(_folded(F.col("n"))).alias("c")).collect()
    by_form = {r["c"]: notices[r["n"]] for r in own if r["n"] in notices and r["c"]}
    forms = F.array(*[F.lit(c) for c in by_form]) if by_form else F.array().cast("array<string>")
    least, most = min(map(len, by_form), default=1), max(map(len, by_form), default=0)
    lines = F.filter(F.split(_folded(F.col(text)), "\n"), lambda x: F.length(x) >= least)
    forms_found = F.filter(F.transform(lines, lambda x: _canonical_line(x)), lambda c: F.length(c).between(least, most) & F.array_contains(forms, c))
    rows = docs.select(*rest, F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"), forms_found.alias("__found"))
    names = F.array(*[F.lit(n) for n in by_form.values()]) if by_form else F.array().cast("array<string>")
    named = F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda c: F.element_at(names, F.array_position(forms, c).cast("int"))))), ",")
    rows = rows.select(*rest, "canonical_sha256", F.size("__found").cast("long").alias("n_notices"), F.when(F.size("__found") > 0, named).otherwise(F.lit("")).alias("notice_licences"))
    joined = rows.join(known, rows.canonical_sha256 == known["__digest"], "left")
    return joined.select(*rest, "canonical_sha256", F.col("__licence").alias("licence"), "n_notices", "notice_licences", (F.col("__licence").isNotNull() | (F.col("n_notices") > 0)).alias("licensed"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_spelled(words: str) -> str:
    wide = f"' ' || replace({words}, ' ', '  ') || ' '"
    for variant, stays in SPELLINGS.items():
        wide = f"replace({wide}, '{_wide(variant)}', ' {stays} ')"
    return f"trim(regexp_replace({wide}, ' +', ' ', 'g'))"


def _sql_line(folded: str) -> str:
    return _sql_spelled(f"trim(regexp_replace({folded}, '{SEPARATORS}', ' ', 'g'))")


def _sql_folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), {_sql_text(UPPER + TYPOGRAPHIC)}, {_sql_text(LOWER + PLAIN)})"


def _sql_canonical(text: str) -> str:
    folded = _sql_folded(text)
    rest = f"array_to_string(list_filter(string_split({folded}, chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT_LINE}') AND NOT regexp_matches(x, '{TITLE_LINE}')), chr(10))"
    wide = f"' ' || regexp_replace({rest}, '{BLANKS}', '  ', 'g') || ' '"
    some = " OR ".join(f"contains({folded}, '{x}')" for x in SIGNS)
    return _sql_line(f"CASE WHEN {some} THEN regexp_replace({wide}, '{MARKER}', ' ', 'g') ELSE {folded} END")


def _rows(pairs) -> str:
    return ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in pairs)


#: The same in DuckDB, for the built-in licences and notices.
ORACLE_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(l) AS licence FROM (VALUES {_rows(_variants(LICENCES))}) v(l, t) GROUP BY 1),
forms AS (SELECT DISTINCT {_sql_line(_sql_folded("n"))} AS form, l FROM (VALUES {_rows(NOTICES.items())}) v(n, l)),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
lines AS (SELECT r, {_sql_line("line")} AS form FROM (SELECT r, unnest(string_split({_sql_folded("text")}, chr(10))) AS line FROM d)),
hits AS (SELECT r, count(*) AS n, string_agg(DISTINCT l, ',' ORDER BY l) AS names FROM lines JOIN forms USING (form) GROUP BY r)
SELECT d.doc_id, d.digest AS canonical_sha256, known.licence, coalesce(hits.n, 0)::BIGINT AS n_notices, coalesce(hits.names, '') AS notice_licences,
       known.licence IS NOT NULL OR coalesce(hits.n, 0) > 0 AS licensed
FROM d LEFT JOIN known ON d.digest = known.digest LEFT JOIN hits ON d.r = hits.r
"""
