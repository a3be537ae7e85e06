"""Unique names when many folders are flattened into one.

Images choose in path order: each takes the first of its candidate names nobody
before it holds. Written as rounds: every image asks for its current candidate,
a name goes to the earliest path asking for it, everybody else moves on. Rounds
end when nobody is turned away; names and rounds agree with choosing one by one
because all names rank the images the same way.

Images that share a folded name would be turned away once for every number. They are
ranked by path instead and go to the gap of their rank: of r images with the same numbers
to choose from, the next can at best have the r-th number that no image before all of them
holds. So a name that any number of images share takes a bounded number of rounds; more are
needed only for names that images between them hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.text import base_name, folded_path
from boxloom.operators.ranking import row_numbers
from boxloom.session import durable


def _gaps(asking: DataFrame, mark: str) -> DataFrame:
    """``_path, _gap``: the least number that each image of a crowded folded name can get,
    0 for the folded name itself.

    ``asking`` carries the number each image wants next, ``_next``, and the name it holds,
    null if it was turned away.
    """
    chain = F.lower(F.col("_folded"))
    members = asking.filter(F.col("_next") >= 0).select(chain.alias("_chain"), F.col("rel_path").alias("_path"), "_next")
    chains = members.groupBy("_chain").agg(F.min("_path").alias("_first"), F.max("_next").alias("_most")).filter("_most > 0")
    chains = durable(chains.drop("_most"))
    ranked = row_numbers(members.join(chains, "_chain").select("_chain", "_path"), ["_chain"], [F.col("_path")], "_n")
    # names that images before all members hold, as numbers of the chain they belong to
    parts = F.regexp_extract("_held", rf"(?s)^(.*){mark}([1-9][0-9]{{0,17}})$", 1), F.regexp_extract("_held", rf"(?s)^(.*){mark}([1-9][0-9]{{0,17}})$", 2)
    held = asking.filter(F.col("_held").isNotNull()).select(F.lower("_held").alias("_held"), F.col("rel_path").alias("_by"))
    places = F.array(
        F.struct(F.col("_held").alias("_chain"), F.lit(0).cast("bigint").alias("_number")),
        F.struct(parts[0].alias("_chain"), F.try_to_number(parts[1], F.lit("9" * 18)).cast("bigint").alias("_number")),
    )
    taken = held.select("_by", F.inline(places)).filter(F.col("_number").isNotNull())
    taken = taken.join(chains, "_chain").filter(F.col("_by") < F.col("_first")).select("_chain", "_number").distinct()
    # the k-th number taken shifts every rank from number - k on by one
    shifts = row_numbers(taken, ["_chain"], [F.col("_number")], "_k").select(
        "_chain", (F.col("_number") - F.col("_k") + 1).alias("_at"), F.lit(None).cast("string").alias("_path")
    )
    merged = shifts.unionByName(ranked.select("_chain", (F.col("_n") - 1).alias("_at"), "_path"))
    numbered = row_numbers(merged, ["_chain"], [F.col("_at"), F.col("_path").isNotNull(), F.coalesce("_path", F.lit(""))], "_n")
    return numbered.filter(F.col("_path").isNotNull()).select("_path", (F.col("_n") - 1).alias("_gap"))


def first_free_names(
    images: DataFrame, plain: Column, folded: Column, out: str, mark: str | None = None
) -> DataFrame:
    """Add ``out``: the first free one of plain, folded, folded_1, folded_2, …

    ``mark`` stands before the number. Without it the folded name is final and may repeat.
    Paths are unique.
    """
    key = F.lower(F.col("_name"))
    last_resort = F.lit(mark is None) & (F.col("_try") > 0)
    zero = F.lit(0).cast("bigint")
    asking = durable(
        images.withColumns({"_plain": plain, "_folded": folded, "_try": zero, "_name": plain})
    )
    while True:
        holders = asking.groupBy(key.alias("_key")).agg(F.min("rel_path").alias("_holder"))
        judged = asking.join(holders, key == F.col("_key")).withColumn(
            "_lost", (F.col("_holder") != F.col("rel_path")) & ~last_resort
        )
        judged = durable(judged.drop("_key", "_holder"))
        turned = judged.agg(F.max(F.when(F.col("_lost"), F.col("_try")))).first()[0]
        if turned is None:
            return judged.select(*images.columns, F.col("_name").alias(out))
        following = F.col("_try") + F.col("_lost").cast("bigint")
        if turned > 0:
            wanted = judged.select(
                "rel_path", "_folded", (following - 1).alias("_next"), F.when(~F.col("_lost"), F.col("_name")).alias("_held")
            )
            judged = judged.join(_gaps(wanted, mark), F.col("rel_path") == F.col("_path"), "left")
            following = F.greatest(following, F.coalesce(F.col("_gap") + 1, zero))
        moved = judged.withColumn("_try", following)
        name = F.when(F.col("_try") == 0, F.col("_plain")).when(F.col("_try") == 1, F.col("_folded"))
        if mark is not None:
            name = name.otherwise(F.concat("_folded", F.lit(mark), (F.col("_try") - 1).cast("string")))
        asking = durable(moved.withColumn("_name", name).drop("_lost", "_path", "_gap"))


def unique_names(items: DataFrame) -> DataFrame:
    """Archive names: the base name, or the folded path when that is taken.

    A folded path can only take somebody's base name if that contains ``__``.
    Without such a name the earliest path of each base name keeps it, and one
    aggregate and join say so.
    """
    path = F.col("rel_path")
    if not items.filter(base_name(path).contains("__")).isEmpty():
        return first_free_names(items, base_name(path), folded_path(path), "archive_name")
    key = F.lower(base_name(path))
    firsts = items.groupBy(key.alias("_key")).agg(F.min("rel_path").alias("_first"))
    name = F.when(path == F.col("_first"), base_name(path)).otherwise(folded_path(path))
    return items.join(firsts, key == F.col("_key")).select(*items.columns, name.alias("archive_name"))


def number_repeats(entries: DataFrame, order: list[Column], name: str = "name") -> DataFrame:
    """Append `` (2)``, `` (3)``, … before the extension of repeated names."""
    keyed = entries.withColumn("_key", F.lower(F.col(name)))
    counted = row_numbers(keyed, ["_key"], order, "_n")
    parts = F.regexp_extract(F.col(name), r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(
        F.col(name), r"(?s)^(.+?)(\.[^.]*)?$", 2
    )
    numbered = F.concat(parts[0], F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), parts[1])
    return counted.select(
        *[c for c in entries.columns if c != name],
        F.when(F.col("_n") == 1, F.col(name)).otherwise(numbered).alias(name),
    )


