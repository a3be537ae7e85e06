"""Mixing sources to target weights, with DataFrame operations only.

Every source deals its documents to buckets, lays the words of a bucket end to end and cuts
them into blocks of ``BLOCK_WORDS``; only the last block of a bucket is shorter. The output is a line of slots of one block each, cut into shards. Every
shard draws its source counts from a multinomial with the target weights; a source's
n-th draw takes the block at place n of a pseudorandom permutation of its blocks, with a
new permutation for each pass over them. Draws beyond a source's quota go to sources
that drew too few, so totals are exact and no block is taken more often than the quota
says. All randomness is a hash of the seed and a place, so reruns agree.

The mix itself is a stored table, a row per slot in shard order: the drawn block's text
and the parts it is made of. What a document gave is counted from that table.

Texts travel twice: to their bucket, where they are packed and meet the slots that drew
them, and from there to the shards. The drawn blocks are stored in between, and shards are
written in ``PORTIONS`` steps, so that never more than the blocks, the shards so far and one
portion's shuffle lie on disk.

Driver memory holds one row per source. Offsets of documents come from two levels of
running sums, over buckets of about ``BUCKET_WORDS`` but never more than the square root of
a source's documents, so no task sees a whole source.

Defined cases: a null or empty text has size 0 and is taken 0 words; null sources are one
source, the last; repeated rows and null ids are documents of their own; no documents, or
none with words, give rows with target 0 and nothing taken.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.llm.tables import done_with, narrow, release, stored
from boxloom.session import shared_folder, shuffle_partitions

#: Words in a block. Quotas are whole blocks, so this bounds how far a source's taken
#: words can be from its target.
BLOCK_WORDS = 64
#: Words of a bucket, about.
BUCKET_WORDS = 32768
#: Steps in which the shards are written.
PORTIONS = 4
#: Slots of an output shard.
SHARD_SLOTS = 8192
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix in hundredths of all words.
TOTAL_PERCENT = 150
#: No source gives more than so many times its words.
MOST_PASSES = 2
#: Rounds of swaps in a permutation.
ROUNDS = 8
SEED = 20240229


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: int
    target: float = 0.0
    blocks: int = 0
    quota: int = 0


def plan_sources(sizes: list[tuple[str | None, int]], blocks_of: dict[str | None, int] | None = None) -> list[Source]:
    """Targets and block quotas of the sources, given as ``(name, words)``; a source whose
    number of blocks is not given is cut without short blocks but the last.

    Words are shared by weight; a target stops at ``MOST_PASSES`` times its source, and
    what is over is shared again by weight among those below, until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    sources = [Source(n, s, WEIGHTS[i % len(WEIGHTS)]) for i, (n, s) in enumerate(ordered)]
    caps = [float(MOST_PASSES * s.size) for s in sources]
    targets = [0.0] * len(sources)
    free = list(range(len(sources)))
    rest = TOTAL_PERCENT * sum(s.size for s in sources) / 100
    while free:
        level = rest / sum(sources[i].weight for i in free)
        full = [i for i in free if sources[i].weight * level > caps[i]]
        for i in full or free:
            targets[i] = caps[i] if full else sources[i].weight * level
        rest -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)] if full else []
    planned = []
    for source, target in zip(sources, targets, strict=True):
        blocks = (blocks_of or {}).get(source.name, -(-source.size // BLOCK_WORDS))
        words = source.size / blocks if blocks else 1
        quota = min(MOST_PASSES * blocks, round(target / words))
        planned.append(Source(source.name, source.size, source.weight, target, blocks, quota))
    return planned


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _at(values: list[int], index: Column) -> Column:
    return F.get(_longs(values), index)


def _running(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def _bin(bounds: list[int], value: Column) -> Column:
    """The index of the interval of ``bounds`` that holds the value."""
    return F.size(F.filter(_longs(bounds[1:]), lambda b: b <= value)).cast("bigint")


def permuted(place: Column, blocks: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. blocks - 1: in every round a place either
    swaps with its mirror at a random axis or both stay. Never null, so that a join on it
    computes it once and not in a null check as well."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(r, blocks) - x, blocks)
        coin = F.xxhash64(r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)

    rounds = F.array(*[F.xxhash64(key, F.lit(r)) for r in range(ROUNDS)])
    return F.coalesce(F.aggregate(rounds, place, swap), F.lit(0).cast("bigint"))


def draws(docs: DataFrame, sources: list[Source], seed: int = SEED) -> DataFrame:
    """The mix as slots: shard, src (index of the source), pass, block."""
    spark = docs.sparkSession
    quotas = [s.quota for s in sources]
    bounds = _running(quotas)
    slots = bounds[-1]
    slot = spark.range(0, slots, 1, shuffle_partitions(spark)).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(slots, 1))).alias("u"),
    )
    counts = slot.select("shard", _bin(bounds, F.col("u")).alias("src")).groupBy("shard", "src").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts)
    drawn = {r["src"]: r["n"] for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect()}  # a row per source
    totals = [drawn.get(i, 0) for i in range(len(sources))]
    over = _running([max(0, t - q) for t, q in zip(totals, quotas, strict=True)])
    short = _running([max(0, q - t) for t, q in zip(totals, quotas, strict=True)])
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    n = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    # dealt out before they grow to a row per slot: the counts alone fit into one task
    started = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = started.repartition(shuffle_partitions(spark), "shard", "src").select("shard", "src", n.alias("i"))
    quota = _at(quotas, F.col("src"))
    line = F.when(F.col("i") >= quota, _at(over, F.col("src")) + F.col("i") - quota)
    moved = placed.select("shard", "src", "i", line.alias("line")).select(
        "shard", "src", "i", "line", F.when(F.col("line").isNotNull(), _bin(short, F.col("line"))).alias("to")
    )
    settled = moved.select(
        "shard",
        F.coalesce("to", "src").alias("src"),
        F.when(F.col("to").isNull(), F.col("i"))
        .otherwise(_at(totals, F.col("to")) + F.col("line") - _at(short, F.col("to"))).alias("i"),
    )
    blocks = F.greatest(_at([s.blocks for s in sources], F.col("src")), F.lit(1))
    return settled.select(
        "shard", "src", F.floor(F.col("i") / blocks).alias("pass"), F.pmod(F.col("i"), blocks).alias("place"), blocks.alias("blocks")
    ).withColumn("key", F.xxhash64(F.lit(seed), "src", "pass")).select(
        "shard", "src", "pass", permuted(F.col("place"), F.col("blocks"), F.col("key")).alias("block")
    )


def _words(text: Column | str) -> Column:
    """The words of a text. Splitting at one plain blank is far cheaper than at a pattern."""
    spaced = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def sized(docs: DataFrame, **more: str) -> DataFrame:
    """Documents with their number of words: doc_id, source, size, mark (a hash of the text)."""
    return narrow(docs, doc_id="doc_id", source="source", size=F.size(_words("text")).cast("bigint"), mark=F.xxhash64("text"), **more)


def _laid(dealt: DataFrame, base: DataFrame) -> DataFrame:
    """``inner`` and ``offset``, the places of a document's first word in its bucket and in
    its source. Rows that agree in all the order looks at have the same text, so every call
    gives the same places."""
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.repartition(shuffle_partitions(dealt.sparkSession), "src", "bucket")
    inner = near.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the side with texts stays where the window left it, and no estimate makes it travel
    return inner.join(base.hint("merge"), ["src", "bucket"]).withColumn("offset", F.col("base") + F.col("inner"))


def blocks(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """The drawn blocks of ``placed`` (src, bucket, size, inner, offset, first_block, text):
    src, block, text, parts, the (offset of the document, words) the block holds in order,
    and slots, at most ``MOST_PASSES``. ``slots`` is (src, bucket, block, slot)."""
    first = F.floor(F.col("inner") / BLOCK_WORDS)
    last = F.floor((F.col("inner") + F.col("size") - 1) / BLOCK_WORDS)
    split = placed.filter("size > 0").select("src", "bucket", "first_block", "inner", "offset", "size", _words("text").alias("split"))

    def piece(block: Column) -> Column:
        start = F.greatest(block * BLOCK_WORDS - F.col("inner"), F.lit(0))
        # the array is named twice, so that no step of the optimizer moves the split in here
        n = F.least((block + 1) * BLOCK_WORDS - F.col("inner"), F.size("split")) - start
        text = F.array_join(F.slice("split", (start + 1).cast("int"), n.cast("int")), " ")
        return F.struct((F.col("first_block") + block).alias("block"), n.alias("n"), text.alias("text"))

    cut = split.select("src", "bucket", "offset", F.explode(F.transform(F.sequence(first, last), piece)).alias("piece"))
    pieces = cut.select(
        "src", "bucket", F.col("piece.block").alias("block"),
        F.struct("offset", F.col("piece.n").alias("n"), F.col("piece.text").alias("text")).alias("piece"),
    )
    # both sides lie by bucket already: a union and one aggregate join them without an exchange
    near = slots.repartition(shuffle_partitions(slots.sparkSession), "src", "bucket")
    both = pieces.withColumn("slot", F.lit(None).cast(slots.schema["slot"].dataType)).unionByName(
        near.select("src", "bucket", "block", F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"), "slot")
    )
    found = both.groupBy("src", "bucket", "block").agg(F.sort_array(F.collect_list("piece")).alias("found"), F.collect_list("slot").alias("slots"))
    return found.filter(F.size("slots") > 0).select(
        "src", "block", F.array_join("found.text", " ").alias("text"),
        F.transform("found", lambda p: F.struct(p["offset"].alias("offset"), p["n"].alias("n"))).alias("parts"), "slots",
    )


def mix(docs: DataFrame, seed: int = SEED, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text, source) mixed to the target weights.

    Returns the documents as ``doc_id, source, src, size, source_size, target, offset``,
    where offset is the place of a document's first word in its source, and the mix as
    stored in ``folder``: ``shard, place, src, pass, block, text, parts``. A shard read by
    place, src, pass and block is its text in order.
    """
    spark = docs.sparkSession
    known = stored(sized(docs))
    totals = known.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row per source
    sizes = [(r["source"], r["size"]) for r in totals]
    rows_of = {r["source"]: r["n"] for r in totals}
    sources = plan_sources(sizes)
    names = F.array(*[F.lit(s.name).cast("string") for s in sources if s.name is not None]) if sources else F.array()
    src = F.when(F.col("source").isNull(), F.lit(len(sources) - 1)).otherwise(F.array_position(names.cast("array<string>"), F.col("source")) - 1)
    buckets = [max(1, min(isqrt(rows_of[s.name]), s.size // BUCKET_WORDS)) for s in sources] or [1]

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("src", src.cast("bigint")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), _at(buckets, F.col("src"))))

    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = dealt(known).groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("n", F.ceil(F.col("words") / BLOCK_WORDS))
    base = stored(full.select(
        "src", "bucket", "n", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_block"),
    ))
    cut = base.groupBy("src").agg(F.sum("n").alias("n")).collect()  # a row per source
    sources = plan_sources(sizes, {sources[r["src"]].name: r["n"] for r in cut})
    index = F.col("src")
    rows = _laid(dealt(known), base).select(
        "doc_id", "source", "src", "size", _at([s.size for s in sources] or [0], index).alias("source_size"),
        F.get(F.array(*[F.lit(s.target) for s in sources] or [F.lit(0.0)]), index).alias("target"), "offset",
    )
    place = F.xxhash64(F.lit(seed), "shard", "src", "pass", "block").alias("place")
    drawn = draws(docs, sources, seed).select("src", "block", F.struct("shard", "pass", place).alias("slot"))
    lies = base.filter("n > 0").select("src", "bucket", F.explode(F.expr("sequence(first_block, first_block + n - 1)")).alias("block"))
    # blocks grow with the corpus, and no estimate of exploded rows tells so: never broadcast
    slots = drawn.join(lies.hint("merge"), ["src", "block"]).select("src", "bucket", "block", "slot")
    packed = stored(blocks(_laid(dealt(sized(docs, text="text")), base), slots))
    folder = folder or f"{shared_folder(spark)}/mix-{uuid.uuid4().hex}"
    for portion in range(PORTIONS):
        own = F.filter("slots", lambda s: F.pmod(s["shard"], F.lit(PORTIONS)) == portion)
        filled = packed.select("src", "block", "text", "parts", F.explode(own).alias("slot")).select(
            "slot.shard", "slot.place", "src", "slot.pass", "block", "text", "parts"
        )
        # a shard lies in up to eight tasks, each with a range of its places
        tasks = filled.repartition(shuffle_partitions(spark), "shard", F.shiftright("place", 61))
        ordered = tasks.sortWithinPartitions("shard", "place", "src", "pass", "block")
        ordered.write.mode("append" if portion else "errorifexists").option("compression", "zstd").parquet(folder)
        release(spark)
    done_with(packed)
    return rows, spark.read.schema(filled.schema).parquet(folder)


def report(docs: DataFrame, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Per document row: ``doc_id, size, source_size, target, taken``, and its source;
    taken is what the stored mix holds of the document."""
    rows, shards = mix(docs, seed, folder)
    parts = shards.select("src", F.explode("parts").alias("part")).select("src", "part.offset", "part.n")
    taken = parts.groupBy("src", "offset").agg(F.sum("n").alias("taken"))
    # a document without words starts where the next one does, and nothing is taken of it
    own = F.when(F.col("size") > 0, F.col("offset")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)))
    return rows.withColumn("offset", own).join(taken.hint("merge"), ["src", "offset"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"
    )
