"""Quality rules: a table of thresholds compiled into one projection.

Everything is a built-in expression, so a scan of the texts is the only work:
no shuffle and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import WHITE, let, table, text_or_empty, words


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is outside [least, most]."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "at", "by", "this", "from", "be",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas",
    "el", "los", "y", "del", "se", "las", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "no",
]

#: The verdict's thresholds. ``base_failed`` holds the base rules; these add to them.
RULES = [
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("shouted_ratio", None, 0.3),
    Rule("bar_ratio", None, 0.1),
]


def compile_rules(rules: list[Rule]) -> Column:
    """True if every rule holds; a measure that is null fails no rule."""
    tests = []
    for r in rules:
        c = F.col(r.measure)
        if r.least is not None:
            tests.append(F.coalesce(c >= F.lit(r.least), F.lit(True)))
        if r.most is not None:
            tests.append(F.coalesce(c <= F.lit(r.most), F.lit(True)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def repeated_words(hashes: str) -> Column:
    """Words inside 8-word windows that a text has twice or more.

    Windows are compared by hash; only a text with an equal pair is sorted, and
    the covered words are counted from the gaps between positions in order.
    """
    h = F.col(hashes)
    none = F.lit(0).cast("long")

    def covered(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + F.lit(d))["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(k, -1) | same(k, 1)), lambda x: x["i"]))

    def length(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + F.lit(1)) - x, F.lit(8))).cast("long"))
        return F.aggregate(gaps, none, lambda a, x: a + x)

    ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(let(ordered, covered), length))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds nothing to ``docs``: returns key and measures, a row for each row.

    Null text: empty, which has no words and fails the base rules. Repeated
    rows and ids are measured each on its own. Other columns are ignored.
    """
    t = docs.select(F.col(key), text_or_empty(text).alias("_t")).withColumn("_w", words(F.col("_t")))
    n = F.size("_w")
    each = F.transform("_w", lambda w: F.xxhash64(w))
    inside = F.filter(F.transform("_e", lambda x, i: F.when(i + 7 < F.size("_e"), F.xxhash64(*[F.get("_e", i + F.lit(k)) for k in range(8)]))), lambda x: x.isNotNull())
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    low = F.transform("_w", lambda w: F.lower(w))
    t = t.withColumns({"_e": each, "_l": lines, "_low": low, "n_words": n.cast("long")}).withColumn("_h", inside)
    chars = lambda c, drop: F.length(c) - F.length(F.translate(c, drop, ""))
    t = t.select(
        key,
        "n_words",
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        chars(F.col("_t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words("_h").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_low", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_shouted"),
        F.size(F.filter("_w", lambda w: w == "|")).cast("long").alias("n_bars"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return t.withColumns({
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "stop_ratio": share("n_stop", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "shouted_ratio": share("n_shouted", "n_words"),
        "bar_ratio": share("n_bars", "n_words"),
    })


def judge(measured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def quality(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    out = judge(measure(docs), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "symbol_ratio", "stop_ratio", "dup_line_ratio", "shouted_ratio", "bar_ratio")


def op5_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)
#: The same rows for DuckDB.
SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS g, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u), p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at_word FROM c WHERE n > 1), r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stop,
len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS shouted, len(list_filter(w, lambda x: x = '|')) AS bars FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
q AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, word_chars / NULLIF(n_words, 0) AS mean, n_symbols / NULLIF(n_words, 0) AS symbol_ratio, stop / NULLIF(n_words, 0) AS stop_ratio,
(len(l) - len(list_distinct(l))) / NULLIF(len(l), 0) AS dup_line_ratio, shouted / NULLIF(n_words, 0) AS shouted_ratio, bars / NULLIF(n_words, 0) AS bar_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND mean BETWEEN 2 AND 14 AND symbol_ratio <= 0.25 AND stop_ratio >= 0.02 AND dup_line_ratio <= 0.3 AND shouted_ratio <= 0.3 AND bar_ratio <= 0.1 AS kept,
symbol_ratio, stop_ratio, dup_line_ratio, shouted_ratio, bar_ratio FROM q"""
