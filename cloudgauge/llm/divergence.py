"""Quality rules by distribution: how far an answer's characters and common words lie
from those of its language.

Everything is a column expression. The references are sums over all answers: shares of
character classes, and shares of the most common short words, per language. An answer is
held against those of the other answers of its language by Jensen-Shannon distance (base 2,
0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.llm.common import text_or_empty, written
from cloudgauge.session import settle

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\u000b\f\r"
# classes counted one after another, each on what the ones before have left
CLASSES = {
    "lower": "[a-z]+",
    "white": WHITE,
    "upper": "[A-Z]+",
    "stops": "[.,;:]+",
    "digit": "[0-9]+",
    "symbol": r"[#*$%&|<>]+",
    "mark": r"[!-/:-@\[-`{-~]+",
    "letter": r"[\p{L}\p{M}]+",
}


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def bound_once(value: Column, use) -> Column:  # noqa: ANN001
    """`use(value)` with the value computed once, also when lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def repeated_windows(words: Column, n: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more in the same text."""

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(  # (hash, place) of each window, equal windows together
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def places(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.when(i > 0, F.get(s, i - 1)["h"])), x["i"]
                    ).otherwise(F.lit(-1)),
                ),
                lambda p: p >= 0,
            )
            return bound_once(
                F.sort_array(again),
                lambda p: total(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))),
            )

        return bound_once(marked, places)

    def any_twice(hashes: Column) -> Column:
        # most texts repeat no window, which a set of numbers tells
        once = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(once, F.lit(0).cast("long")).otherwise(covered(hashes))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound_once(
        hashed,
        lambda h: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
    )
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(bound_once(windows, any_twice))


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds `classes`, the number of characters of each class and of the rest."""
    names, rest = [], text
    keep = list(df.columns)
    for name, pattern in CLASSES.items():
        left = f"_left_{name}"
        df = df.withColumn(left, F.regexp_replace(rest, pattern, ""))
        df = df.withColumn(f"_n_{name}", (F.length(rest) - F.length(left)).cast("long"))
        names.append(f"_n_{name}")
        rest = left
    return df.select(*keep, F.array(*names, F.length(rest).cast("long")).alias("classes"))


def shares(counts: Column) -> Column:
    """Shares with one added to every count, so that no share is zero."""
    n = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x + 1)
    return bound_once(n, lambda s: F.transform(counts, lambda x: (x + 1) / s))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the base-2 divergence) of two arrays of positive shares."""
    term = F.zip_with(
        p, q, lambda a, b: (a * F.log2(2 * a / (a + b)) + b * F.log2(2 * b / (a + b))) / 2
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(term, F.lit(0.0), lambda acc, x: acc + x)))


def common_short_words(rows: DataFrame, common_words: int = 16, max_word_chars: int = 5) -> DataFrame:
    """(language, n_rows, ref_words) of every language over all rows with columns language
    and words: its most frequent words of at most `max_word_chars` characters, ties by the word."""
    short = F.filter("words", lambda w: F.length(w) <= max_word_chars)
    counts = rows.select("language", F.explode(short).alias("word")).groupBy("language", "word").count()
    top = Window.partitionBy("language").orderBy(F.desc("count"), "word")
    best = counts.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= common_words)
    words = best.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    every = rows.groupBy("language").agg(F.count("*").alias("n_rows"))
    none = F.array().cast("array<string>")
    return every.join(words, "language", "left").select("language", "n_rows", F.coalesce("w.word", none).alias("ref_words"))


def with_references(rows: DataFrame, references: DataFrame, large_share: float = 1 / 256) -> DataFrame:
    """The rows with the columns of their language's reference, which has n_rows. So many
    references that they cannot be broadcast are joined by a shuffle, but for those of
    languages with `large_share` of the rows, of which there are few."""
    side, small = settle(references)
    if small:
        return rows.join(F.broadcast(side), "language")
    all_rows = side.agg(F.sum("n_rows").alias("all_rows"))
    side = side.crossJoin(F.broadcast(all_rows)).withColumn("large", F.col("n_rows") >= F.col("all_rows") * large_share).drop("all_rows")
    large, rest = side.filter("large").drop("large"), side.filter("NOT large").drop("large")
    others = rows.join(F.broadcast(large.select("language")), "language", "left_anti")
    return rows.join(F.broadcast(large), "language").unionByName(others.join(rest.hint("merge"), "language"))


def summed(counts: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.get(F.col(counts), F.lit(i))), F.lit(0)) for i in range(n)])


def without(sums: Column, own: Column) -> Column:
    return F.zip_with(sums, own, lambda a, b: a - F.coalesce(b, F.lit(0)))


def word_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs: they are removed one by one, and what is left
    is noted each time."""
    start = F.struct(words.alias("rest"), F.array(F.size(words)).alias("sizes"))

    def step(acc: Column, word: Column) -> Column:
        return bound_once(
            F.array_remove(acc["rest"], word),
            lambda r: F.struct(r.alias("rest"), F.concat(acc["sizes"], F.array(F.size(r))).alias("sizes")),
        )

    sizes = F.aggregate(common, start, step, lambda acc: acc["sizes"])
    return bound_once(
        sizes, lambda s: F.transform(common, lambda _, i: (F.get(s, i) - F.get(s, i + 1)).cast("long"))
    )


def divergence_rules(
    receipts: DataFrame,
    language: str = "profile",
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.5,
    min_words: int = 50,
    min_common: int = 20,
    prior_chars: int = 10_000,
    common_words: int = 16,
    cell_id: str = "cell_id",
    response_content: str = "response_content",
) -> DataFrame:
    """One row per answer: cell_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance, kept.

    An answer fails the base rules with under `min_words` words, or if repeated 3-word
    windows cover more than half of them. Of the rest, an answer is dropped whose
    character classes are further than `max_class_distance` from its reference, or whose
    common words are further than `max_word_distance`; the latter only if the language has
    so many common words in as many words that `min_common` are expected.

    The reference of an answer is what the other answers of its language have, with
    `prior_chars` characters more that are spread as in the other answers of all languages. So an
    answer that is alone in its language is held against the others; a distance is null
    if there is no other answer with a character. `language` names the vocabulary profile of
    an answer; null is a language of its own. Null answers are empty and fail. Repeated
    rows count and are judged each; other columns are not read.
    """
    rows = receipts.select(
        F.col(cell_id).alias("cell_id"),
        F.coalesce(F.col(language).cast("string"), F.lit("")).alias("language"),
        text_or_empty(response_content).alias("text"),
    ).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE_CHARS)) != "")
    symbol, white, n_classes = list(CLASSES).index("symbol"), list(CLASSES).index("white"), len(CLASSES) + 1
    counted = with_classes(with_references(rows, common_short_words(rows, common_words)), "text").select(
        "cell_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("classes")[white]).cast("long").alias("word_chars"),
        F.col("classes")[symbol].alias("n_symbols"),
        bound_once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_windows(F.col("words"), F.size("words")).alias("n_repeat_words"),
        "classes",
        word_counts(F.col("words"), F.col("ref_words")).alias("common"),
    )
    # what is counted of a text is counted once
    narrow = written(counted, "divergence-counts")
    sums = narrow.groupBy("language").agg(
        F.sum("n_words").alias("mass"),
        F.count("*").alias("n_rows"),
        summed("classes", n_classes).alias("ref_classes"),
        F.slice(summed("common", common_words), 1, F.max(F.size("common"))).alias("ref_common"),
    )
    every = narrow.agg(summed("classes", n_classes).alias("all_classes"))
    met = with_references(narrow, sums).crossJoin(F.broadcast(every))
    own_language, others = without(F.col("ref_classes"), F.col("classes")), without(F.col("all_classes"), F.col("classes"))
    met = met.select("*", own_language.alias("_own"), others.alias("_others"), total(others).alias("_n_others"), without(F.col("ref_common"), F.col("common")).alias("_common"))
    reference = F.zip_with("_own", "_others", lambda a, b: a + prior_chars * b / F.col("_n_others"))
    mass = F.nullif(F.col("mass") - F.col("n_words"), F.lit(0))
    judged = met.select(
        *narrow.columns,
        F.when(F.col("_n_others") > 0, jensen_shannon(shares(F.col("classes")), shares(reference))).alias("class_distance"),
        jensen_shannon(shares(F.col("common")), shares(F.col("_common"))).alias("words_apart"),
        (total(F.col("_common")) * F.col("n_words") / mass).alias("expected"),
    ).drop("classes", "common", "language")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn(
        "word_distance", F.when(F.col("expected") >= min_common, F.col("words_apart"))
    )
    far = F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word_distance, F.lit(False)
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("words_apart", "expected")
