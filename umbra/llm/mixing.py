"""Mixing sources to target weights, by DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
all words. No target exceeds 3 times its source's size; the excess goes to the others
by weight. That is ``target = min(3 * size, level * weight)``, and the level is read
off the sources in the order of ``size / weight``.

Block quotas: a source's documents are dealt by hash into blocks of about equal size.
Its ratio of target to size, split in whole passes and a rest, gives the number of
blocks to draw: each block once a pass, and in the last pass the first blocks of a
permuted order until the rest is used up.

Splitting tree: the quotas of all sources are partitioned among the output shards. A
node's draws, each named by source and number alone, stand in a random order, and an
exact half of them goes to either side, so that every source's number on a side is
multivariate hypergeometric. A leaf is a shard with an exact quota of every source.

Draws: a source's permuted blocks are handed to the shards by their quotas, in disjoint
runs. What the shards draw is what the mix takes, and nothing else: ``taken`` is the sum
over them. Only the block in which a source's last pass ends is looked into: its
documents are taken in a permuted order, the last one in part, so a source's taken words
equal its target up to rounding and no document gives more than 3 times its size. In a
shard rows are ordered by a hash of id, text and pass, so that the passes of a document
lie apart. The pipeline stage writes its rows so, a slice of a shard to a file.

The number of blocks grows with the square root of the rows, and so does a block. Ranks
and running sums over sources, blocks and draws are made by range partitions
(``running``); no task sees all of them.

All choices come from hashes of id, text and a seed, so reruns agree. Null text has
no words; documents without words take 0. Rows that repeat are equal in every column
but may differ in ``taken`` if the last pass ends between them. Null ids are allowed.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import free, join_facts, materialize, partitions

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS_PER_ROOT = 4  # blocks for the square root of the number of rows
LEVELS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each column of ``sums`` over all rows before a row.

    Rows are dealt by range of ``order`` and summed within a partition; only one row a
    partition is summed over in one task, and joined back."""
    dealt = df.withColumns({f"{k}__of": v.cast("double") if k.endswith("_weight") else v.cast("long") for k, v in sums.items()})
    dealt = materialize(dealt.repartitionByRange(partitions(df.sparkSession), *order).withColumn("__at", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("__at").agg(*[F.sum(f"{k}__of").alias(f"{k}__part") for k in sums])
    parts = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__at", *[F.coalesce(F.sum(f"{k}__part").over(parts), F.lit(0)).alias(f"{k}__before") for k in sums])
    within = Window.partitionBy("__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(f"{k}__of").over(within), F.lit(0)).alias(f"{k}__within") for k in sums])
    return summed.join(F.broadcast(per), "__at").select(*df.columns, *[(F.col(f"{k}__before") + F.col(f"{k}__within")).alias(k) for k in sums])


def targets(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size)`` with ``total`` and ``target``."""
    ranked = running(sources, [F.col("source").isNull(), F.col("source")], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = ranked.select("source", "source_size", weight.alias("weight"))
    by_ratio = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    sums = materialize(running(weighed, by_ratio, {"size_before": F.col("source_size"), "before_weight": F.col("weight")}), "sources")
    # the level if just the sources before this one stop at their cap; of those that hold the first is the highest
    whole = sums.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    level = (F.col("total") - MOST * F.col("size_before")) / (F.col("weights") - F.col("before_weight"))
    level = sums.join(F.broadcast(whole)).agg(F.max(F.when(level * F.col("weight") <= MOST * F.col("source_size"), level)).alias("level"), F.max("total").alias("total"))
    return sums.join(F.broadcast(level)).select("source", "source_size", "total", F.least(MOST * F.col("source_size").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))


def _hash(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def plan_draws(rows: DataFrame, blocks: int | None, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``sized`` with their block, the facts of the sources, and the plan, a row for each block:
    source, block, held (words), full (passes), quota (words of the last pass) and
    shards (the shard that draws it, by pass)."""
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    if blocks is None:
        blocks = math.ceil(BLOCKS_PER_ROOT * math.sqrt(totals.agg(F.sum("n")).first()[0] or 0))
    goals = targets(totals.select("source", "source_size"))
    # as many blocks as a source's share of all words asks for: blocks + sources at most
    count = F.greatest(F.lit(1), F.ceil(blocks * F.col("source_size") / F.greatest(F.col("total"), F.lit(1)))).cast("long")
    goals = materialize(goals.withColumn("blocks", count), "targets")
    facts = source_facts(goals, totals)
    dealt = join_facts(rows.withColumn("key", source_key("source")), facts, "key", "n").drop("key", "n")
    dealt = materialize(dealt.withColumn("block", F.pmod(_hash("doc_id", "th"), F.col("blocks"))), "dealt")
    held = dealt.groupBy("source", "block").agg(F.sum("size").alias("held"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(goal / F.col("source_size")))).otherwise(0).cast("long")
    # a block's place in its source: all sums before it less those before its source
    by_source = [F.col("source").isNull(), F.col("source")]
    placed = materialize(running(held, [*by_source, _hash("source", "block"), F.col("block")], {"words": F.col("held"), "place": F.lit(1)}), "places")
    first = placed.groupBy("source").agg(F.min("words").alias("w"), F.min("place").alias("p"), F.count("*").alias("of")).withColumnRenamed("source", "s")
    plan = placed.join(first, placed["source"].eqNullSafe(first["s"])).withColumns({"words": F.col("words") - F.col("w"), "place": F.col("place") - F.col("p")})
    plan = plan.withColumn("full", full).withColumn("rest", goal - F.col("full") * F.col("source_size"))
    plan = plan.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("held"), F.col("rest") - F.col("words")))).drop("s", "w", "p")
    plan = materialize(plan.select("source", "block", "held", "place", "of", "full", "quota"), "blocks")
    quotas = split(plan, levels).withColumnRenamed("source", "q")
    passes = (F.col("full") + (F.col("quota") > 0).cast("long")).cast("int")
    # the shard of a source's n-th draw: how many shards end at or before it
    shard = lambda nth: F.size(F.filter("ends", lambda end: end <= nth))
    shards = F.when(passes > 0, F.transform(F.sequence(F.lit(1), passes), lambda turn: shard((turn - 1) * F.col("of") + F.col("place")))).otherwise(F.array().cast("array<int>"))
    plan = plan.join(quotas, plan["source"].eqNullSafe(quotas["q"]), "left").withColumn("shards", shards)
    return dealt, facts, materialize(plan.select("source", "block", "held", "full", "quota", "shards"), "plan")


def source_key(source) -> Column:
    """A source as a string that is never null."""
    return F.concat_ws(":", F.col(source).isNull().cast("string"), F.col(source).cast("string"))


def source_facts(goals: DataFrame, totals: DataFrame) -> DataFrame:
    """``goals`` by key, with the number of rows. Joined by ``join_facts``, large sources
    hold up no task."""
    facts = goals.join(totals.select(F.col("source").alias("s"), "n"), goals["source"].eqNullSafe(F.col("s"))).drop("s")
    return facts.withColumn("key", source_key("source")).drop("source")


def mix(docs: DataFrame, blocks: int | None = None, levels: int = LEVELS, **cols) -> DataFrame:
    """doc_id, th, source, size, source_size, target, taken, and draws (array of shard
    and words, a draw each) for every row."""
    rows = materialize(sized(docs, **cols), "sized")
    dealt, _, plan = plan_draws(rows, blocks, levels)
    drawn = dealt.join(plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), dealt["source"].eqNullSafe(F.col("s")) & (dealt["block"] == F.col("b"))).drop("s", "b")
    # a third way only for the block in which a source's last pass ends
    cut = (F.col("quota") > 0) & (F.col("quota") < F.col("held"))
    within = Window.partitionBy("source", "block").orderBy(_hash("source", "doc_id", "th"), "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    ends = drawn.where(cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    others = drawn.where(~cut).withColumn("part", F.col("size"))
    draws = F.transform("shards", lambda shard, i: F.struct(shard.alias("shard"), F.when(i < F.col("full"), F.col("size")).otherwise(F.col("part")).alias("n")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["n"])
    out = ends.unionByName(others).withColumn("draws", F.filter(draws, lambda d: d["n"] > 0))
    return out.select("doc_id", "th", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def split(plan: DataFrame, levels: int) -> DataFrame:
    """The splitting tree: each source's quota of draws to ``ends``, the sums of the
    quotas of the shards up to each (of 2**levels). A draw is its source and a number."""
    draws = plan.groupBy("source").agg(F.sum(F.col("full") + (F.col("quota") > 0).cast("long")).alias("draws"))
    pieces = F.sequence(F.lit(0), F.col("draws") - 1)
    tokens = draws.where("draws > 0").select("source", F.explode(pieces).alias("nth"))
    # one random order serves all nodes: halves of its halves are random too
    lot = [_hash(F.lit("tree"), "source", "nth"), F.col("source").isNull(), F.col("source"), F.col("nth")]
    ordered = running(tokens, lot, {"rank": F.lit(1)})
    size = tokens.agg(F.count("*").alias("inside"))
    placed = ordered.join(F.broadcast(size)).withColumn("node", F.lit(0))
    for _ in range(levels):
        left = F.ceil(F.col("inside") / 2).cast("long")
        right = F.col("rank") >= left
        placed = placed.select(
            "source",
            F.when(right, F.col("rank") - left).otherwise(F.col("rank")).alias("rank"),
            F.when(right, F.col("inside") - left).otherwise(left).alias("inside"),
            (F.col("node") * 2 + right.cast("int")).alias("node"),
        )
    of = lambda leaf: F.sum((F.col("node") <= leaf).cast("long"))
    return placed.groupBy("source").agg(F.array(*[of(leaf) for leaf in range(2**levels)]).alias("ends"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words and the white space between them."""
    runs = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(runs, F.lit(1), n.cast("int")), "")


def deal(docs: DataFrame, name: str = "shard") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with their shard in the column
    ``name``, by shard and within it in the order of a hash. A shard is cut into slices
    by that hash, one a partition, so that its size is bounded by no task.

    Each row finds its block's draws where it is: of the plan, a row for each block, and
    not of the documents, copies go around. Only the rows of blocks in which a source's
    last pass ends meet each other before they are dealt."""
    _, facts, plan = plan_draws(materialize(sized(docs), "sized"), None, LEVELS)
    i, t, key, block, copies, size, nth, copy, n, shard, order = free(docs, "id", "th", "key", "block", "copies", "size", "nth", "copy", "n", "shard", "order")
    named = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64(F.coalesce("text", F.lit(""))), key: source_key("source")})
    named = named.where(F.col("text").rlike(WORD))  # the others have no words to take
    own = facts.select(F.col("key").alias(key), F.col("blocks").alias(block), F.col("n").alias(n))
    placed = join_facts(named, own, key, n).drop(n).withColumn(block, F.pmod(_hash(i, t), F.col(block)))
    p = plan.select(*[F.col(c).alias(f"{order}{c}") for c in ("source", "block", "held", "full", "quota", "shards")])
    of = lambda c: F.col(f"{order}{c}")
    drawn = placed.join(p, (F.col(key) == source_key(f"{order}source")) & (F.col(block) == of("block")))
    cut = (of("quota") > 0) & (of("quota") < of("held"))
    whole = drawn.where(~cut).withColumns({copies: F.transform(of("shards"), lambda s: F.struct(F.lit(None).cast("long").alias("n"), s.alias("shard"))), size: F.lit(None).cast("long")})
    within = Window.partitionBy(key, block).orderBy(_hash("source", i, t), i, t).rowsBetween(Window.unboundedPreceding, -1)
    ends = drawn.where(cut).withColumn(size, words(F.col("text")))
    ends = ends.withColumn(n, F.greatest(F.lit(0), F.least(F.col(size), of("quota") - F.coalesce(F.sum(size).over(within), F.lit(0)))))
    last = F.transform(of("shards"), lambda s, k: F.struct(F.when(k < of("full"), F.col(size)).otherwise(F.col(n)).alias("n"), s.alias("shard")))
    ends = ends.withColumn(copies, F.filter(last, lambda c: c["n"] > 0)).drop(n)
    each = whole.unionByName(ends.select(*whole.columns))
    each = each.select(*docs.columns, i, t, size, F.posexplode(copies).alias(nth, copy)).withColumns({n: F.col(f"{copy}.n"), shard: F.col(f"{copy}.shard")})
    short = F.coalesce(F.col(n) < F.col(size), F.lit(False))
    text = F.when(short, first_words(F.col("text"), F.col(n))).otherwise(F.col("text"))
    each = each.withColumn("n_chars", F.when(short, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    each = each.withColumn("text", text).withColumn(order, F.shiftrightunsigned(_hash(F.lit("order"), i, t, nth), 1))
    slices = -(-partitions(docs.sparkSession) // 2**LEVELS)
    slice_ = F.shiftright(F.shiftright(order, 31) * slices, 32)  # of equal width, in the order of the hash
    dealt = each.repartitionById(slices * 2**LEVELS, (F.col(shard) * slices + slice_).cast("int"))
    return dealt.sortWithinPartitions(shard, order, i, t, nth, n).withColumnRenamed(shard, name).select(*docs.columns, name)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, dealt to shards, and where
    the last pass ends within a row (one of a source at most) its first words for the
    rest; n_chars follows. Rows that the mix doesn't take go."""
    return deal(docs, *free(docs, "in_shard")).select(*docs.columns)
