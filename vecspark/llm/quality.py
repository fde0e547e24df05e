"""Quality rules per document, and host verdicts from shrunken failure rates, in DataFrame functions only.

A document fails its base rules with fewer than 20 words, or with over 30 %
of its words in repeated 8-word windows. Failures are counted by host; a
beta prior is fitted to the hosts' rates by moments, every host's rate is
shrunk toward it, and hosts above `max_rate` lose all their documents.

Defined results: a null or blank text has no words and fails; a document
with a null host gets no host verdict; repeated rows are rows of their own;
an empty table gives an empty table. The operator reads only the columns it
is given, so clashing names elsewhere do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import BLANKS, written

#: Fixed values of the rules.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_RATE = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1e6)


def _let(value: Column, body) -> Column:
    """Computes `value` once and hands it to `body`."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column, width: int) -> Column:
    """Positions under windows of `width` at ascending `starts`."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("total"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["total"] + F.least(F.lit(width), s - acc["last"])).alias("total"))
    return F.aggregate(starts, zero, step, lambda acc: acc["total"])


def _with_later(hashes: Column, step: int) -> Column:
    """Hashes of each number and the one `step` places later; at the end, where there is none, of the number alone."""
    return _let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))


def _window_hashes(words: Column, width: int) -> Column:
    """A hash of every window of `width` words, from hashes of windows half as wide.

    Two windows of half the width, or more, cover a window. Hashes are numbers,
    so that no window is put together.
    """
    span, found = 1, F.transform(words, lambda w: F.xxhash64(w))
    while span < width:
        step = min(span, width - span)
        span, found = span + step, _with_later(found, step)
    return F.slice(found, 1, F.size(words) - F.lit(width - 1))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words under windows of `width` words that occur twice or more, the first one included.

    Windows are hashed, sorted with their places, and compared with their
    neighbours: n log n even for very long texts. Without any repeat the
    sort is skipped.
    """

    def repeats(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def flagged(p: Column) -> Column:
            same = lambda i, j: F.get(p, j)["x"] == F.get(p, i)["x"]
            mark = lambda i: F.when(
                F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(p, i)["i"]
            )
            starts = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(p) - 1), mark)))
            return _covered(starts, width)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_let(placed, flagged))

    return F.when(F.size(words) <= width, F.lit(0).cast("bigint")).otherwise(_let(_window_hashes(words, width), repeats))


def base_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.ltrim(line, F.lit(BLANK_CHARS)) != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("chars"), repeated_words(w).alias("repeat")
    )
    counted = df.select(
        F.col(id_col),
        F.col(host).alias("_host"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _let(F.array_remove(F.split(body, BLANKS), ""), of_words).alias("_w"),
    )
    named = counted.select(
        id_col,
        "_host",
        F.col("_w.n").alias("n_words"),
        F.col("_w.chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("_w.repeat").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return named.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per host: n, failed, rate (shrunken) and rejected."""
    hosts = rows.where("_host IS NOT NULL").groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
    )
    prior = hosts.select((F.col("failed") / F.col("n")).alias("p")).agg(F.avg("p").alias("m"), F.var_samp("p").alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    strength = (
        F.when(F.col("v").isNull(), F.lit(STRENGTH[0]))
        .when(F.col("v") <= 0, F.lit(STRENGTH[1]))
        .otherwise(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.try_divide(spread, F.col("v")) - 1)))
    )
    prior = prior.select(F.struct((F.col("m") * strength).alias("a"), strength.alias("s"))).scalar()
    rate = (F.col("failed") + prior["a"]) / (F.col("n") + prior["s"])
    return hosts.select("_host", "n", "failed", rate.alias("rate")).withColumn("rejected", F.col("rate") > max_rate)


def judged(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Base rules and `kept`.

    The narrow counts are written once, then read for the hosts' sums and
    for the join. Only rejected hosts are joined; the side of the documents
    is the one that may be skewed, which a left join lets Spark split.
    """
    rows = written(base_rules(df, id_col, text, host), "quality")
    rejected = host_verdicts(rows, max_rate).where("rejected").select("_host", F.lit(True).alias("_rejected"))
    return (
        rows.join(rejected, "_host", "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull())
        .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
