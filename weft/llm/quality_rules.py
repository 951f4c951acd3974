"""Quality rules whose cutoffs are chosen under a risk bound. DataFrame functions only.

Every document gets whole-text counts and, from them, one value for each rule; a rule rejects a
value above its cutoff. The cutoffs of all rules form a ladder of levels, fixed beforehand, from
lenient to strict; a document that any rule rejects at a level is rejected there. Levels are
certified with the labelled holdout, in each stratum (the language; null is a stratum of its own):
level by level, the exact binomial (Clopper-Pearson) upper bound of the joint false-rejection rate
is compared with ``risk``. The bound at confidence 1 - e lies below a exactly if
P(Binomial(n, a) <= k) <= e, where k of n good documents are rejected. e is ``doubt`` divided by
the number of strata (Bonferroni); within a stratum the levels are tested in their fixed order and
the first that fails ends the sequence, which needs no further correction. So with probability
1 - doubt no certified level of any stratum loses more than ``risk`` of the good documents, and any
of them may be chosen: the one with the greatest share of label 0 rejected less share of label 1
rejected, ties to the more lenient. Where none is certified (few labels) the rules reject nothing.

Defined results: null, empty and white-space texts have no words and fail the base; documents with
a null language are judged by the cutoffs of that stratum; without labels only the base counts;
repeated rows are judged alike, and labels that repeat count as often as they are given; labels
other than 0 and 1 do not count.

Scale: one pass over the texts, whose counts are kept in the shared folder; no text is shuffled.
Work on a text of n words is O(n log n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import WORD_GAP, cut

LEVELS = 8
#: rule -> its cutoff at each level, from strict (level 0) to lenient; a value above it is rejected
LADDER: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_word_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "capital_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 0.7, 0.9),
    "marks_per_word": (0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5),
    "same_word_share": (0.5, 0.6, 0.65, 0.7, 0.8, 0.85, 0.9, 0.95),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, _stratum, n_words, the base counts, and the counts that the rules need."""
    zero = F.lit(0).cast("long")
    d = docs.select("doc_id", F.col("lang").alias("_stratum"), F.col("text").alias("_text"), _words(F.col("text")).alias("_words"))
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    five = F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + j) for j in range(5)]))
    d = d.withColumn("_grams", F.when(F.size("_words") >= 5, five).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_lines", F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    found_again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(found_again, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twin = lambda x, i, by: F.coalesce(F.get(F.col("_sorted"), i + by)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("_sorted", lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    found = lambda marks: F.coalesce(F.regexp_count("_text", F.lit(f"[{marks}]")), F.lit(0)).cast("long")
    return d.select(
        "doc_id", "_stratum", "n_words",
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        found(r"#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_sorted") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        found("A-Z").alias("_capitals"),
        found("!?").alias("_marks"),
        F.when(F.size("_words") > 0, F.size("_words") - F.size(F.array_distinct("_hashes"))).otherwise(0).alias("_same"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def values() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "capital_share": F.col("_capitals") / chars,
        "marks_per_word": F.col("_marks") / words,
        # words seen before, beyond what a text of this length repeats by nature (Heaps' law, exponent 1/2)
        "same_word_share": F.greatest(F.lit(0.0), 1 - (F.col("n_words") - F.col("_same")) / F.sqrt(words * F.lit(1.0))) ,
    }


def passes(k: Column, n: Column, rate: float, doubt: Column) -> Column:
    """Whether P(Binomial(n, rate) <= k) <= doubt, summed exactly in logarithms."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log1p(F.lit(-rate))
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(t, a["s"]), F.least(t, a["s"])
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    # at k >= n * rate the sum is no less than 1/2 or so, and no test passes
    return F.when(k >= n * rate, F.lit(False)).otherwise(F.aggregate(steps, start, add, lambda a: a["s"]) <= F.log(doubt))


def worst() -> Column:
    """At how many levels, from the strict end, some rule rejects the document: it is rejected at
    level l exactly if this exceeds l."""
    of = values()
    above = [sum(((of[rule] > c).cast("int") for c in cuts), F.lit(0)) for rule, cuts in LADDER.items()]
    return F.greatest(*above)


def levels(counted: DataFrame, labels: DataFrame, risk: float = 0.03, doubt: float = 0.05) -> DataFrame:
    """_of (stratum), _level (the chosen one) of the strata that have a certified level."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_good"))
    rows = counted.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    rejected = lambda good, at: F.count_if((F.col("_good") == good) & (F.col("_worst") > at))
    steps = F.array(*[F.struct(F.lit(at).alias("level"), rejected(True, at).alias("k"), rejected(False, at).alias("hits")) for at in range(LEVELS)])
    by = rows.groupBy("_stratum").agg(F.count_if(F.col("_good")).alias("_n"), F.count_if(~F.col("_good")).alias("_bad"), steps.alias("_steps"))
    strata = by.agg(F.count("*").alias("_strata"))
    tested = by.join(F.broadcast(strata))  # one row
    tested = tested.select("_stratum", "_n", "_bad", "_strata", F.explode("_steps").alias("_t"))
    tested = tested.withColumn("_ok", passes(F.col("_t.k"), F.col("_n"), risk, F.lit(doubt) / F.col("_strata")))
    # the fixed order: a level counts if it and all more lenient ones pass
    ends = tested.groupBy("_stratum").agg(F.coalesce(F.max(F.when(~F.col("_ok"), F.col("_t.level"))), F.lit(-1)).alias("_fails"))
    certified = tested.join(ends.withColumnRenamed("_stratum", "_s"), F.col("_stratum").eqNullSafe(F.col("_s"))).filter(F.col("_t.level") > F.col("_fails"))
    gain = F.col("_t.hits") / F.greatest("_bad", F.lit(1)) - F.col("_t.k") / F.greatest("_n", F.lit(1))
    return certified.groupBy(F.col("_stratum").alias("_of")).agg(F.max_by("_t.level", F.struct(gain.alias("gain"), F.col("_t.level").alias("level"))).alias("_level"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.03, doubt: float = 0.05) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept."""
    counted = cut(counts(docs).withColumn("_worst", worst()))
    judged = counted.join(levels(counted, labels, risk, doubt), F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    broken = F.coalesce(F.col("_worst") > F.col("_level"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~broken).alias("kept"))
