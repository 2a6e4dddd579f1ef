"""Quality rules: line-first cleaning, with whole-document counts beside it.

Everything is built from SQL functions on arrays inside one row, so a document
never leaves its row and the plan has no shuffle: a scan and projections.

Line rules, each on the lines that hold a word:

* *punctuation*: a line of fewer than ``short`` characters that does not end in
  closing punctuation;
* *navigation*: symbols ``#*$%&|<>`` are more than ``symbol_share`` of its
  characters, as in menus, tables and markup;
* *boilerplate*: it holds one of ``BOILERPLATE``.

Failing lines are removed. A document is rejected when the base rules fail or
when less than ``least_kept`` of its words are left.

Defined results: a null or empty text has no words and is rejected; blank lines
are neither judged nor kept; equal rows get equal results; columns that the
operator does not own pass through unless they clash with an added name, in
which case the added one wins; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Phrases that mark a line as site furniture, in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "terms of service",
    "terms of use",
    "use of cookies",
)
#: Characters that end a sentence or close a quotation after one.
CLOSING = ".!?:;…。！？\"'”’»)]"
WINDOW = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _symbol_count(text: Column) -> Column:
    return F.size(F.split(text, f"[{SYMBOLS}]")) - 1


def _shift(name: str, bits: Column | int, of: Column) -> Column:
    return F.call_function(name, of, F.lit(bits) if isinstance(bits, int) else bits)


def has_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def line_fails(line: Column, boiler: Column, symbols: Column, *, short: int = 25, symbol_share: float = 0.1) -> Column:
    """True for a line that one of the line rules removes.

    ``boiler`` and ``symbols`` say whether the document has such text at all,
    so that most documents skip those rules.
    """
    navigation = _symbol_count(line) > F.lit(symbol_share) * F.length(F.translate(line, SPACES, ""))
    open_end = ~F.contains(F.lit(CLOSING), F.right(F.regexp_replace(line, SPACE_CLASS + "+$", ""), F.lit(1)))
    return (boiler & has_boilerplate(line)) | (symbols & navigation) | ((F.length(line) < short) & open_end)


def quality_columns(df: DataFrame, text: str = "text", *, short: int = 25, symbol_share: float = 0.1, least_kept: float = 0.5) -> DataFrame:
    """Add counts, verdict and cleaned text to every row of ``df``.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed, kept`` (boolean), ``n_lines, n_failed_lines, n_kept_words``
    (long) and ``clean_text`` (string).
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "n_kept_words", "clean_text"]
    rest = [c for c in df.columns if c not in own]
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.select("*", _words(F.col("__t")).alias("__w"), lines.alias("__l"), _symbol_count(F.col("__t")).cast("long").alias("n_symbols"), has_boilerplate(F.col("__t")).alias("__boiler"))

    # windows of five words by the hashes of their words, doubled: 2, 4, then 4 + 1
    pair = lambda a, b: F.xxhash64(a, b)
    rows = rows.select("*", F.size("__w").cast("long").alias("n_words"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__1"))
    rows = rows.select("*", F.zip_with("__1", F.slice("__1", 2, F.size("__1")), pair).alias("__2"))
    rows = rows.select("*", F.zip_with("__2", F.slice("__2", 3, F.size("__2")), pair).alias("__4")).drop("__2")
    rows = rows.select("*", F.slice(F.zip_with("__4", F.slice("__1", 5, F.size("__1")), pair), 1, F.greatest(F.size("__1") - (WINDOW - 1), F.lit(0))).alias("__5")).drop("__1", "__4")

    # only where a window occurs twice: sort hash above index, keep what equals a neighbour
    bits = F.length(F.bin("n_words"))
    packed = F.sort_array(F.transform("__5", lambda x, i: _shift("shiftleft", F.col("__b"), x).bitwiseOR(i.cast("long"))))
    rows = rows.select("*", F.when(F.size(F.array_distinct("__5")) < F.size("__5"), bits).alias("__b"))
    rows = rows.select("*", F.when(F.col("__b").isNotNull(), packed).alias("__s")).drop("__5")
    mask = _shift("shiftleft", F.col("__b"), F.lit(1).cast("long")) - 1

    def at(x: Column) -> Column:
        return x.bitwiseAND(mask)

    def same(x: Column, y: Column) -> Column:
        near = _shift("shiftright", F.col("__b"), x) == _shift("shiftright", F.col("__b"), y)
        return F.coalesce(near & (F.slice("__w", at(x).cast("int") + 1, WINDOW) == F.slice("__w", at(y).cast("int") + 1, WINDOW)), F.lit(False))

    starts = F.array_sort(F.transform(F.filter("__s", lambda x, k: same(x, F.get("__s", k - 1)) | same(x, F.get("__s", k + 1))), at))
    rows = rows.select("*", F.when(F.col("__s").isNotNull(), starts).alias("__d")).drop("__s")
    covered = F.aggregate(
        "__d",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    good = F.filter("__l", lambda x: ~line_fails(x, F.col("__boiler"), F.col("n_symbols") > 0, short=short, symbol_share=symbol_share))
    rows = rows.select(
        *rest,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        good.alias("__g"),
    )
    rows = rows.select("*", F.array_join("__g", "\n").alias("clean_text"), (F.col("n_lines") - F.size("__g")).alias("n_failed_lines")).drop("__g")
    left = F.when(F.col("n_failed_lines") == 0, F.col("n_words")).otherwise(F.size(_words(F.col("clean_text"))).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("*", left.alias("n_kept_words"), failed.alias("base_failed"))
    return rows.select("*", (~F.col("base_failed") & (F.col("n_kept_words") >= F.lit(least_kept) * F.col("n_words"))).alias("kept"))


def passing(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows of ``quality_columns`` that are kept.

    A filter on a column of rows that also have a number of their own is not moved
    below them; moved, it would repeat the verdict's expressions many times over.
    """
    judged = quality_columns(df, text, **rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).drop("__row")


def _sql_contains(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in BOILERPLATE) + ")"


#: The same verdicts in DuckDB, at the default thresholds.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i:i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM dup) GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             list_filter(ls, lambda x: NOT ({_sql_contains('lower(x)')}
               OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
               OR (length(x) < 25 AND NOT contains('{CLOSING.replace(chr(39), chr(39) * 2)}', right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1))))) AS good
      FROM w LEFT JOIN cov ON w.r = cov.r),
k AS (SELECT *, len(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+')) AS left_words,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND left_words >= 0.5 * n_words AS kept FROM k
"""
