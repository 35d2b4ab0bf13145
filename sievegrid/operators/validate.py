"""Completeness checks of numbered sequences, by words of 64 numbers.

A word holds which of 64 neighbouring numbers there are, as bits.  Words are or-ed together in every task before they
shuffle, a row for 64 numbers, and comparisons are between words; only words with gaps are taken apart.  Numbers may be
negative; nulls are no numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_numbers

_BITS = 6
_FULL = -1


def words(rows: DataFrame, id_col: str, *by: str) -> DataFrame:
    """(by, sg_word, sg_bits, sg_n): for each 64 numbers which are there, and how many rows have them."""
    at = F.col(id_col).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    keyed = rows.where(at.isNotNull()).select(*by, F.shiftright(at, _BITS).alias("sg_word"), bit.alias("sg_bit"))
    return keyed.groupBy(*by, "sg_word").agg(F.bit_or("sg_bit").alias("sg_bits"), F.count("*").alias("sg_n"))


def _numbers(held: DataFrame, bits: Column, id_col: str, *by: str) -> DataFrame:
    """The numbers of the bits that are set, a row each."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("sg_found"), i) == 1)
    found = held.withColumn("sg_found", bits).where("sg_found != 0")
    return found.select(*by, F.explode(at).alias("sg_at"), "sg_word").select(*by, (F.shiftleft("sg_word", _BITS) + F.col("sg_at")).alias(id_col))


def missing(actual: DataFrame, id_col: str, n: int) -> DataFrame:
    """Numbers of 0 to n - 1 that are absent."""
    # a row for 64 numbers on both sides
    all_words = actual.sparkSession.range((n + 63) >> _BITS).withColumnRenamed("id", "sg_word")
    held = all_words.join(words(actual, id_col), "sg_word", "left")
    return _numbers(held, F.bitwise_not(F.coalesce("sg_bits", F.lit(0).cast("long"))), id_col).where(F.col(id_col) < n)


def extra(actual: DataFrame, id_col: str, expected: DataFrame) -> DataFrame:
    """Numbers of ``actual`` that ``expected`` lacks."""
    other = words(expected, id_col).select("sg_word", F.col("sg_bits").alias("sg_known"))
    held = words(actual, id_col).join(other, "sg_word", "left")
    return _numbers(held, F.col("sg_bits").bitwiseAND(F.bitwise_not(F.coalesce("sg_known", F.lit(0).cast("long")))), id_col)


def first_missing(rows: DataFrame, id_col: str, *by: str) -> DataFrame:
    """(by, first_missing): the least number from 0 on that a key lacks, which is how many it has without a gap.

    It is a gap in a word, or the first number of a word that is not there; the words that are there are numbers
    themselves and form words of words, each level 64 times smaller, up to one that holds the last.
    """
    known = rows.where(F.col(id_col).cast("long") >= 0)
    last = known.agg(F.max(F.col(id_col).cast("long")).alias("m")).first()["m"]
    level, out, scale = words(known, id_col, *by), None, 0
    while True:
        # the ones below the first zero; adding one to the greatest number would overflow
        bits, end = F.col("sg_bits"), (1 << 63) - 1
        ones = F.when(bits == end, 63).otherwise(F.bit_count(bits.bitwiseXOR(F.when(bits == end, F.lit(end)).otherwise(bits) + F.when(bits == end, 0).otherwise(1))) - 1)
        gap = F.when(bits != _FULL, F.shiftleft(F.shiftleft("sg_word", _BITS) + ones, scale * _BITS))
        found = level.select(*by, gap.alias("gap")).groupBy(*by).agg(F.min("gap").alias("gap"))
        out = found if out is None else out.unionByName(found)
        scale += 1
        if last is None or last >> (_BITS * scale) == 0 and last + 1 < 1 << (_BITS * scale):
            break
        level = words(level, "sg_word", *by)
    keys = rows.select(*by).distinct() if by else None
    found = out.groupBy(*by).agg(F.min("gap").alias("gap"))
    if keys is None:
        return found.select(F.coalesce("gap", F.lit(0).cast("long")).alias("first_missing"))
    return keys.join(found, list(by), "left").select(*by, F.coalesce("gap", F.lit(0).cast("long")).alias("first_missing"))


def differs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the counts of both tables and whether they agree, an invariant between two steps."""
    n, m = left.agg(F.count("*").alias("n_left")), right.agg(F.count("*").alias("n_right"))
    return n.crossJoin(m).withColumn("agrees", F.col("n_left") == F.col("n_right"))  # one row each


def total(**parts: DataFrame) -> DataFrame:
    """(part, n): the rows of each part and of all ("total")."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("total").alias("part"), "n"))


def absent(rows: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys ``held`` lacks: what a buffer still has to take in."""
    return rows.join(held.select(*keys).distinct(), list(keys), "left_anti")


def report(offenders: DataFrame, id_col: str, first: int = 10) -> DataFrame:
    """One row: how many, the first few in order, and how many more."""
    count = offenders.agg(F.count("*").alias("n"))
    head = offenders.orderBy(id_col).limit(first).agg(F.array_join(F.array_sort(F.collect_list(id_col)).cast("array<string>"), ", ").alias("first_ids"))
    return count.crossJoin(head).select(F.col("n").alias("n_offenders"), "first_ids", F.greatest(F.col("n") - first, F.lit(0)).alias("n_more"))


def islands(actual: DataFrame, id_col: str, blocks: int | None = None) -> DataFrame:
    """(first_id, last_id, n) of each run of consecutive ids."""
    numbered = row_numbers(actual.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "sg_rn", blocks)
    runs = numbered.groupBy((F.col(id_col) - F.col("sg_rn")).alias("sg_run"))
    return runs.agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), F.count("*").alias("n")).drop("sg_run")


def contiguous_prefix(actual: DataFrame, id_col: str) -> DataFrame:
    """One row: how many ids from 0 on are there without a gap."""
    return first_missing(actual, id_col).withColumnRenamed("first_missing", "prefix_length")


def sequence_check(rows: DataFrame, by: str, position: str) -> DataFrame:
    """For each key: rows, missing and repeated positions, and whether 0 to the last are complete.

    Missing are positions of 0 to the last; positions below 0 are rows, but fill none of them.
    """
    bits, low_zeros = F.col("sg_bits"), lambda w: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", w, i) == 1)
    ends = low_zeros(bits)
    first, last = F.shiftleft("sg_word", _BITS) + F.array_min(ends), F.shiftleft("sg_word", _BITS) + F.array_max(ends)
    held = words(rows, position, by).select(by, "sg_n", F.bit_count(bits).alias("d"), F.when(F.col("sg_word") >= 0, F.bit_count(bits)).otherwise(0).alias("f"), first.alias("low"), last.alias("high"))
    sums = held.groupBy(by).agg(F.sum("sg_n").alias("n"), F.sum("d").alias("d"), F.sum("f").alias("f"), F.min("low").alias("low"), F.max("high").alias("high"))
    missing_ones = F.greatest(F.col("high") + 1, F.lit(0)) - F.col("f")
    checked = sums.select(by, "n", missing_ones.alias("n_missing"), (F.col("n") - F.col("d")).alias("n_repeated"), ((F.col("low") == 0) & (missing_ones == 0) & (F.col("n") == F.col("d"))).alias("is_complete"))
    # keys whose positions are all null
    keys = rows.select(F.col(by).alias("sg_key")).distinct()
    joined = keys.join(checked, F.col("sg_key").eqNullSafe(F.col(by)), "left")
    return joined.select(F.col("sg_key").alias(by), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "n_missing", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"), "is_complete")


def completeness(rows: DataFrame, expected: DataFrame, by: str, position: str, n_expected: str) -> DataFrame:
    """(by, n_missing, n_extra, prefix_length) of every key of ``expected``, which says how many there should be.

    One table of words gives all three: bits below the expected number, bits beyond it, and the first gap.
    """
    held = words(rows, position, by).join(expected.select(by, F.col(n_expected).cast("long").alias("sg_m")), by)
    # how many numbers of the word are expected, as a mask
    inside = F.least(F.greatest(F.col("sg_m") - F.shiftleft("sg_word", _BITS), F.lit(0)), F.lit(64)).cast("int")
    mask = F.when(inside == 64, F.lit(_FULL).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(_FULL).cast("long"), inside)))
    mask = F.when(F.col("sg_word") < 0, F.lit(0).cast("long")).otherwise(mask)
    good = F.bit_count(F.col("sg_bits").bitwiseAND(mask))
    sums = held.groupBy(by).agg(F.sum(good).alias("good"), F.sum(F.bit_count("sg_bits") - good).alias("over"))
    nothing = F.lit(0).cast("long")
    out = expected.select(by, F.col(n_expected).cast("long").alias("sg_m")).join(sums, by, "left").join(first_missing(rows, position, by), by, "left")
    return out.select(by, (F.col("sg_m") - F.coalesce("good", nothing)).alias("n_missing"), F.coalesce("over", nothing).alias("n_extra"), F.least(F.coalesce("first_missing", nothing), F.col("sg_m")).alias("prefix_length"))


def message_lists(rows: DataFrame, by: str, order_col: str, message: str, first: int = 10) -> DataFrame:
    """For each key the first messages joined by "; ", and how many more there are.

    Ranks up to ``first`` are kept in every task before the shuffle, so no key collects more.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order_col))
    head = rows.select(by, order_col, message).withColumn("sg_rn", rank).where(F.col("sg_rn") <= first)
    lists = head.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sg_rn", message))).alias("sg_list"))
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform("sg_list", lambda x: x[message].cast("string")), "; ")
    return counts.join(lists, by).select(by, "n", text.alias("messages"), F.greatest(F.col("n") - first, F.lit(0)).alias("n_more"))
