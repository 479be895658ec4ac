"""Quality rules by distribution divergence, with Spark expressions only.

A document's histograms of character classes and of its language's common words
are compared with those of the whole corpus in that language by the
Jensen-Shannon distance (base 2, so from 0 to 1). The references are sums over
all documents of a language that pass the base rules; only one row per language
is aggregated for them, with partial sums before the shuffle.

Defined results: a null text has no words, so it fails the base rules. A null or
unlisted language has a character reference of its own and no common words. A
document under ``min_chars`` or ``min_words``, and one whose language has
under ``min_reference`` words in all, is not compared. Rows are independent:
repeated rows give repeated results, an empty table gives none, and columns other
than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Frequent function words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}
#: Character classes; what is in none of them is counted as other.
CHAR_CLASSES = (r"[a-z]+", r"[A-Z]+", r"[0-9]+", common.SPACE + "+", r"""[.,;:!?'"()\-]+""", r"[#*$%&|<>=_{}\[\]/\\+~^@`]+")

REPEAT_WINDOW = 5


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    n, m = _total(p), _total(q)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: F.struct((a / n).alias("a"), (b / m).alias("b")))
    apart = F.aggregate(F.transform(both, lambda x: (part(x["a"], x["b"]) + part(x["b"], x["a"])) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(apart, F.lit(0.0))))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules to ``doc_id, text, lang``, and ``words``."""
    w = docs.withColumn("words", common.words(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = w.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "_lines": lines,
            "_grams": F.when(
                F.col("n_words") > REPEAT_WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("words") - REPEAT_WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(REPEAT_WINDOW)])),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    w = w.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Positions of windows found twice or more: neighbours after sorting by hash. Most texts have none and skip the sort.
    pairs = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    w = w.withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    same = lambda x, i: F.coalesce(F.get("_pairs", i)["g"] == x["g"], F.lit(False))
    again = F.transform("_pairs", lambda x, i: F.when(same(x, i + 1) | ((i > 0) & same(x, i - 1)), x["i"]))
    w = w.withColumn("_at", F.array_sort(F.filter(again, lambda i: i.isNotNull())))
    covered = F.transform("_at", lambda i, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("_at", k + 1) - i, F.lit(REPEAT_WINDOW))).cast("long"))
    w = w.withColumn("n_repeat_words", _total(covered))
    w = w.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return w.drop("_lines", "_grams", "_pairs", "_at")


def _features(docs: DataFrame) -> DataFrame:
    """Base counts and the two histograms of each document."""
    w = base_counts(docs)
    text = F.coalesce("text", F.lit(""))
    known = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*[F.lit(v) for v in ws]))])
    w = w.withColumn("_common", F.coalesce(F.element_at(known, F.coalesce("lang", F.lit(""))), F.array().cast("array<string>")))
    w = w.withColumn("_hits", F.filter(F.transform("words", lambda v: F.array_position(F.col("_common"), v)), lambda i: i > 0))
    left = text
    classes = []
    for pattern in CHAR_CLASSES:
        rest = F.regexp_replace(left, pattern, "")
        classes.append((left, rest))
        left = rest
    counts = [F.length(a) - F.length(b) for a, b in classes] + [F.length(left)]
    each = F.transform("_common", lambda _, k: F.size(F.filter("_hits", lambda i: i == k + 1)).cast("long"))
    return w.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.length(text).cast("long").alias("n_chars"),
        F.array(*[c.cast("long") for c in counts]).alias("chars"),
        F.concat(each, F.array((F.col("n_words") - F.size("_hits")).cast("long"))).alias("common"),
    )


def references(features: DataFrame) -> DataFrame:
    """One row per language: summed histograms of the documents that pass the base rules."""
    n_common = len(next(iter(COMMON_WORDS.values())))
    sums = lambda col, n: F.array(*[F.coalesce(F.sum(F.get(col, F.lit(k))), F.lit(0)) for k in range(n)])
    return (
        features.filter(~F.col("base_failed"))
        .groupBy("lang")
        .agg(sums("chars", len(CHAR_CLASSES) + 1).alias("ref_chars"), sums("common", n_common + 1).alias("ref_common"), F.sum("n_words").alias("ref_words"))
    )


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_chars: int = 200,
    min_words: int = 80,
    min_reference: int = 1000,
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.3,
) -> DataFrame:
    """``doc_id``, the base counts, ``js_chars``, ``js_words``, ``base_failed`` and ``kept`` for every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    f = common.staged(_features(own), "quality")
    r = references(f).withColumnRenamed("lang", "_lang")
    joined = f.join(r, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    enough = F.col("ref_words") >= min_reference
    joined = joined.withColumns(
        {
            "js_chars": F.when(enough & (F.col("n_chars") >= min_chars), js_distance(F.col("chars"), F.col("ref_chars"))),
            "js_words": F.when(
                enough & (F.col("n_words") >= min_words) & (F.size("common") > 1),
                js_distance(F.col("common"), F.slice("ref_common", F.lit(1), F.size("common"))),
            ),
        }
    )
    far = (F.coalesce("js_chars", F.lit(0.0)) > max_char_distance) | (F.coalesce("js_words", F.lit(0.0)) > max_word_distance)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
