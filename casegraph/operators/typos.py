"""Names that differ by typing or reading errors, found without comparing all pairs.

Two texts within ``most`` edits, swaps of neighbours included, share a text that both become by at
most ``most`` deletions each. So they also share its first or last k characters, which lie in the first
or last k + ``most`` of both: only this end of a name is shortened, which makes far fewer texts than
the whole. Which end and which k make the least work is counted over all names. Numbers of names are joined
on hashes of the shortened texts, hot ones dealt over several tasks, and only the pairs that meet are
measured, each once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from casegraph.functions.edits import edit_distance
from casegraph.operators.pairs import distinct_pairs
from casegraph.workspace import stored

# Characters that scanning mixes up, and what they are taken for.
CONFUSED, TAKEN_FOR = "015|$8i", "olslsbl"
# A name makes up to hundreds of shortened texts, so few names are enough for a task.
NAMES_IN_TASK = 10_000
# Characters of an end that a key may have.
KEY_LENGTHS = (4, 6, 8, 10, 12, 16, 24)
# Measuring a pair takes as long as making so many keys.
KEYS_OF_A_PAIR = 10
PAIRS_IN_TASK = 100_000


def plain_letters(c: Column) -> Column:
    """Lower case, with characters that scanning mixes up made equal and ``rn`` read as ``m``."""
    return F.regexp_replace(F.translate(F.lower(c), CONFUSED, TAKEN_FOR), "rn", "m")


def shortened(c: Column, most: int) -> Column:
    """The distinct texts that a text becomes by at most ``most`` deletions, itself included."""

    def once(t: Column) -> Column:
        places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    found = F.array(c)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, once))))
    return found


def cheapest_end(texts: DataFrame, most: int) -> tuple[str, int] | None:
    """The end ("left" or "right") and the number of characters of a key that make the fewest keys and meetings.

    None stands for whole texts. Ends that agree as they are tell how often shortened ones meet: every
    way to shorten one can meet every way to shorten the other.
    """
    ends = [(side, k) for side in ("left", "right") for k in KEY_LENGTHS]
    cut = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(getattr(F, side)("text", F.lit(k))).alias("end")) for i, (side, k) in enumerate(ends)])
    alike = texts.select(F.explode(cut).alias("e")).groupBy("e.i", "e.end").agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = {r["i"]: r["pairs"] for r in alike.groupBy("i").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    size = F.length("text").cast("double")
    total = texts.agg(F.count(F.lit(1)), F.sum(size * (size - 1) / 2 + size + 1 if most == 2 else size + 1)).first()
    ways = [math.comb(k + most, most) for _, k in ends]
    work = [(total[0] * w + met.get(i, 0) * w * w * KEYS_OF_A_PAIR, i) for i, w in enumerate(ways)]
    least, best = min(work)
    return ends[best] if least < (total[1] or 0) else None


def typo_pairs(names: DataFrame, name_col: str, most: int = 1, confusable: bool = False, hub_size: int = 2_000) -> DataFrame:
    """(name1, name2, edits) with name1 < name2: distinct names within ``most`` edits (1 or 2).

    With ``confusable`` names are compared as ``plain_letters`` writes them, so reading errors of
    that kind cost nothing.
    """
    if most not in (1, 2):
        raise ValueError("edits are 1 or 2")
    name = F.col(name_col)
    rows = names.where(name.isNotNull()).select(name.alias("name")).distinct()
    rows = rows.withColumn("text", plain_letters(F.col("name")) if confusable else F.col("name"))
    numbered = stored(rows.withColumn("no", F.monotonically_increasing_id()), "names")
    # Keys are hashes and names are numbers until a pair has met; what meets by a clash is measured like the rest.
    spread = numbered.repartition(numbered.count() // NAMES_IN_TASK + 1)
    keys = shortened(F.col("text"), most)
    if end := cheapest_end(numbered, most):
        side, k = getattr(F, end[0]), end[1]
        keys = F.array_distinct(F.transform(shortened(side("text", F.lit(k + most)), most), lambda t: side(t, F.lit(k))))
    keyed = spread.select(F.explode(F.transform(keys, lambda t: F.xxhash64(t))).alias("key"), "no")
    met = stored(distinct_pairs(keyed, "key", "no", hub_size), "met")
    pairs = met.join(numbered.select(F.col("no").alias("item1"), F.struct("name", "text").alias("a")), "item1").join(
        numbered.select(F.col("no").alias("item2"), F.struct("name", "text").alias("b")), "item2")
    spread = pairs.repartition(met.count() // PAIRS_IN_TASK + 1)
    # stored, since Spark would move a filter on the measure to before the pairs are spread
    measured = stored(spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).select(
        F.col("a.name").alias("name1"), F.col("b.name").alias("name2"), edit_distance("a.text", "b.text").alias("edits")), "measured")
    return measured.where(F.col("edits") <= most)
