"""Mixing sources to target weights.

The words of each source are packed, in a fixed order of its documents, into
blocks of ``block_words``, and a pseudorandom permutation gives every block a place. The
places are dealt to the output shards in stripes. How many slots each shard gets of each source is
a multinomial draw, given totals that meet the targets; a shard takes as many
places of its stripe, from the stripe's start and at most ``most`` times over, so the draw decides which blocks
the mix holds. Slots and packed blocks are joined by index.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and
share ``share`` of all words; none gives more than ``most`` times what it has,
and what it cannot give is shared again among the others by weight.

At scale: the order inside a source is (hash bucket, id, hash of the text), so
that running totals need one window per bucket and one over the bucket sums; a
source with a third of all rows is spread over ``ORDER_BUCKETS`` tasks. Slots
are thrown in chunks and counted in part before they are dealt, so no task makes a whole source's
slots, and they are never broadcast. The permutation is
a swap-or-not network: a bijection on any number of indexes, computed from the
index alone. Only one row per source passes through a single task.

Cases: a null or blank text has size 0 and gives nothing; null is a source like
any other; repeated rows are rows of their own; a null id is kept; sources
without words have target 0; an empty table gives an empty result; columns
other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import keep, words_of

ORDER_BUCKETS = 1024
ROUNDS = 24
CHUNK = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, size)`` rows to ``(source, rank, source_size, target, weight)``, one a source.

    With the sources in order of cap over weight, let L(i) be what a unit of
    weight gets once all before i stand at their caps. L rises until the first
    source that need not be capped and falls after it, so its maximum is the
    level at which the resharing ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", F.element_at(turn, (F.col("rank") - 1) % len(weights) + 1))
    cap = F.col("source_size") * float(most)
    over_all, before = W.partitionBy(), W.orderBy(cap / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(over_all) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(over_all) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return ranked.withColumn("level", level).withColumn("target", F.least(cap, F.col("weight") * F.max("level").over(over_all))).drop("level")


def _swap_or_not(index: Column, n: Column, rank: Column, seed: int, back: bool = False) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 .. n-1, or its origin."""
    rounds = F.lit(list(reversed(range(ROUNDS))) if back else list(range(ROUNDS)))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), rank, r), n) - x, n)
        return F.when(F.xxhash64(F.lit(seed + 1), rank, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), step)


def _ahead(df: DataFrame, *columns: str) -> DataFrame:
    """``df(rank, nth, ...)`` with the sum of each column over a source's rows before, as ``<column>_ahead``, and over all, as ``<column>_all``.

    By runs of rows, so that no task reads all rows of a source but for one sum a run.
    """
    run = df.withColumn("run", F.expr(f"nth div {CHUNK}"))
    sums = run.groupBy("rank", "run").agg(*[F.sum(c).alias(c) for c in columns])
    before, whole = W.partitionBy("rank").orderBy("run"), W.partitionBy("rank")
    base = sums.select("rank", "run", *[(F.sum(c).over(before) - F.col(c)).alias(f"{c}_base") for c in columns], *[F.sum(c).over(whole).alias(f"{c}_all") for c in columns])
    inside = W.partitionBy("rank", "run").orderBy("nth")
    counted = run.withColumns({f"{c}_ahead": F.sum(c).over(inside) - F.col(c) for c in columns}).join(base, ["rank", "run"])
    return counted.withColumns({f"{c}_ahead": F.col(f"{c}_ahead") + F.col(f"{c}_base") for c in columns}).drop("run", *[f"{c}_base" for c in columns])


def shard_counts(sources: DataFrame, block_words: int = 512, shard_blocks: int = 256, seed: int = 7, most: int = 2) -> DataFrame:
    """Slots of every source in every output shard: ``(rank, shard, n, ahead, ...)``, with those of earlier shards in ``ahead``.

    The places of a source's permutation are dealt to the shards in stripes. Its
    slots are thrown at the shards, each as likely as its stripe is long: a multinomial
    draw whose sum is fixed by the target. A stripe has room for ``most`` slots a place; what
    a shard draws beyond that goes to the first shards that have room left. Only shards with a
    place of the source have a row.
    """
    b, n, size, k = block_words, F.col("n_blocks"), F.col("source_size"), F.col("n_shards")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("target").over(W.partitionBy()) / (b * shard_blocks)))  # one row a source
    # The short block may be met in each pass; as many more slots make up for the words it lacks.
    enough = F.ceil((F.col("give") + most * (b - F.col("short"))) / b).cast("long")
    plan = (
        sources.withColumn("n_shards", shards)
        .where("source_size > 0")
        .select("rank", "source_size", "n_shards", F.round("target").cast("long").alias("give"))
        .where("give > 0")
        .withColumn("n_blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
        .withColumn("short_at", _swap_or_not(n - 1, n, F.col("rank"), seed, back=True))
        .withColumn("short", size - (n - 1) * b)
        .withColumn("slots", F.least(most * n, enough))
    )
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({upto} - 1) div {CHUNK}")))
    inside = lambda upto: F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.expr(upto)) - 1))
    thrown = plan.select("rank", "n_blocks", "n_shards", "slots", chunks("slots").alias("chunk")).repartition(parts, "rank", "chunk").select("rank", "n_blocks", "n_shards", inside("slots").alias("slot"))
    at = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "slot"), n)
    drawn = thrown.groupBy("rank", _owner(at).alias("shard")).agg(F.count("*").alias("drawn"))
    held = "least(n_blocks, n_shards)"
    stripes = plan.select("*", chunks(held).alias("chunk")).repartition(parts, "rank", "chunk").select("*", inside(held).alias("nth")).drop("chunk", "slots")
    stripes = stripes.withColumn("shard", F.when(n <= k, F.expr("nth * n_shards div n_blocks")).otherwise(F.col("nth")))
    stripes = stripes.withColumn("first", F.expr("(shard * n_blocks + n_shards - 1) div n_shards")).withColumn("places", F.expr("((shard + 1) * n_blocks + n_shards - 1) div n_shards") - F.col("first"))
    room = F.col("places") * most
    met = stripes.join(drawn, ["rank", "shard"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    met = _ahead(met.withColumns({"over": F.greatest(F.col("drawn") - room, F.lit(0)), "left": F.greatest(room - F.col("drawn"), F.lit(0))}), "over", "left")
    more = F.least(F.greatest(F.col("over_all") - F.col("left_ahead"), F.lit(0)), F.col("left"))
    settled = met.withColumn("n", F.least(F.col("drawn"), room) + more).drop("drawn", "over", "left", "over_ahead", "over_all", "left_ahead", "left_all")
    settled, _ = keep(_ahead(settled, "n").withColumnRenamed("n_ahead", "ahead").drop("n_all", "nth"), "settled")
    short = settled.where(F.col("shard") == _owner(F.col("short_at"))).select("rank", F.col("ahead").alias("short_ahead"), F.col("n").alias("short_n"), F.col("first").alias("short_first"), F.col("places").alias("short_places"))
    return settled.where("n > 0").join(short, "rank")


def _owner(place: Column) -> Column:
    """The shard whose stripe a place is in."""
    spread = place * F.col("n_shards")
    return F.round((spread - spread % F.col("n_blocks")) / F.col("n_blocks")).cast("long")


def slots(counts: DataFrame, block_words: int = 512, seed: int = 7, most: int = 2) -> DataFrame:
    """Output slots ``(rank, block, pass, place, take, shard)`` of ``shard_counts``; ``take`` words from the block's start.

    A shard's count of a source decides which places it takes: the first of its stripe, and from the
    start again when it has had them all. The permutation says which block stands at a
    place. The last slots of a source take what its target still lacks, perhaps nothing.
    """
    b = F.lit(block_words)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = counts.repartition(parts, "rank", "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    placed = each.withColumns({"pass": F.expr("j div places"), "place": F.col("first") + F.col("j") % F.col("places"), "slot": F.col("ahead") + F.col("j")})
    length = F.when(F.col("place") == F.col("short_at"), F.col("short")).otherwise(b)
    used = F.lit(0)
    for t in range(most):
        nth = F.col("short_at") - F.col("short_first") + t * F.col("short_places")
        used = used + ((nth < F.col("short_n")) & (F.col("short_ahead") + nth < F.col("slot"))).cast("long")
    before = F.col("slot") * b - (b - F.col("short")) * used
    take = F.greatest(F.lit(0), F.least(length, F.col("give") - before))
    return placed.withColumn("take", take).withColumn("block", _swap_or_not(F.col("place"), F.col("n_blocks"), F.col("rank"), seed)).select("rank", "block", "pass", "place", "take", "shard")


def packed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its source's rank and ``start``, its first word's place in the source.

    ``docs`` has id, source, size and h (a hash that settles ties), and may
    have more columns.
    """
    placed = docs.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(ORDER_BUCKETS)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")
    base = sums.withColumn("ahead", ahead).drop("n").join(sources, sums["source"].eqNullSafe(sources["source"])).select(
        sums["source"].alias("of"), F.col("bucket").alias("at"), "ahead", "rank", "source_size", "target"
    )
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("id", "h").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("inside", inside).join(base, placed["source"].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).withColumn("start", F.col("ahead") + F.col("inside")).drop("bucket", "inside", "of", "at", "ahead")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each part of a document that lies in one block."""
    b = block_words
    cut = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
    first = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
    return cut.withColumns({"first_word": first, "n": last - first}).withColumn("in_block", F.col("start") + F.col("first_word") - F.col("block") * b)


def _used() -> Column:
    """Words of a part that a slot takes; a block without a slot gives none."""
    return F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("take", F.lit(0)) - F.col("in_block")))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block_words: int = 512, shard_blocks: int = 256, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """Per document: id, size, source_size, target of its source, and the words the mix takes."""
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    read, _ = keep(read, "sizes")
    sources, _ = keep(source_targets(read, weights, share, most), "targets")
    placed, _ = keep(packed(read, sources), "placed")
    counts, _ = keep(shard_counts(sources, block_words, shard_blocks, seed, most), "shards")
    joined = pieces(placed, block_words).join(slots(counts, block_words, seed, most).hint("merge"), ["rank", "block"], "left")
    key = ["id", "h", "rank", "start", "size", "source_size", "target"]
    given = joined.groupBy(*key).agg(F.sum(_used()).cast("long").alias("taken"))
    none = placed.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return given.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block_words: int = 512, shard_blocks: int = 256, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: the words of every output slot, as one row per document part.

    Rows carry the shard, the slot's key inside it (source, pass, place), the
    part's place in the block, and the document it is from. Words of a part are
    joined by one space.
    """
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    read, _ = keep(read, "sizes")
    sources, _ = keep(source_targets(read, weights, share, most), "targets")
    counts, _ = keep(shard_counts(sources, block_words, shard_blocks, seed, most), "shards")
    whole = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(text).alias("h"), text.alias("text"))
    placed = packed(whole, sources).where("size > 0").withColumn("w", words_of(F.col("text"))).drop("text")
    parts = pieces(placed, block_words).select("id", "source", "rank", "block", "start", "first_word", "in_block", F.slice("w", F.col("first_word").cast("int") + 1, F.col("n").cast("int")).alias("part")).select("id", "source", "rank", "block", "first_word", "in_block", F.size("part").cast("long").alias("n"), F.array_join("part", " ").alias("text"))
    joined = parts.join(slots(counts, block_words, seed, most).hint("merge"), ["rank", "block"]).withColumn("used", _used()).where("used > 0")
    cut = F.when(F.col("used") == F.col("n"), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", " "), 1, F.col("used").cast("int")), " "))
    return joined.select("shard", "source", "pass", "place", "in_block", F.col("id").alias(id_col), "first_word", F.col("used").alias("n_words"), cut.alias(text_col))
