"""Mixing sources to target weights by blocks, multinomial draws and index permutations (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm._common import NOT_SPACE, Scratch

#: Words of a block, slots of an output shard, and how often a block may be used.
BLOCK, SLOTS, MOST = 64, 4096, 3
#: Documents of a run: a source is dealt by hash to enough runs that each run is a small sort, and the runs follow each other.
RUN_DOCS = 4096
#: Numbers of draws that meet the ranges of the sources by one key.
CHUNK = 1 << 10
WEIGHTS = (1, 2, 3)
_KEYS = tuple(range(1, 13))


def _targets(totals: DataFrame) -> DataFrame:
    """Adds target to the table sk, source, source_size of all sources.

    Sources, by code point and null last, weigh 1, 2, 3, repeating. A source fills up where the level (words a unit
    of weight) passes limit / weight; taken in that order, the first source that the level left to it doesn't fill
    fixes the level of itself and all after it.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # UTF-8 bytes sort as code points do
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (nth % len(WEIGHTS) + 1).cast("int"))
    weighted = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(MOST)))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy((F.col("limit") / F.col("weight")).asc(), "sk").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = weighted.withColumn("level", left / heavy)
    fits = F.col("weight") * F.col("level") <= F.col("limit")
    fixed = F.min(F.when(fits, F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    return leveled.select("sk", "source", "source_size", F.least("limit", F.col("weight") * F.coalesce(fixed, F.lit(0.0))).alias("target"))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size-1 for each key: the public swap-or-not shuffle, exact for any size."""

    def round_(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1024)) == 0, other).otherwise(x)

    return F.aggregate(F.array(*(F.lit(k).cast("long") for k in _KEYS)), index, round_)


def _packed(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word in the stream of their source, and the sources with what is drawn of them."""
    source = F.col("source").cast("string")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("sk"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"),
    )
    docs = scratch.write(docs, "sizes")
    totals = scratch.write(docs.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "totals")
    drawn = _targets(totals).join(totals.select("sk", "docs"), "sk")
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK))
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    drawn = drawn.withColumn("blocks", blocks).withColumn("draws", F.least(draws, blocks * MOST)).withColumn("runs", F.ceil(F.col("docs") / F.lit(RUN_DOCS)))
    ahead = Window.partitionBy(F.lit(0)).orderBy("sk").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first_draw", F.coalesce(F.sum("draws").over(ahead), F.lit(0))).withColumn("all_draws", F.sum("draws").over(Window.partitionBy(F.lit(0))))
    sources = scratch.write(drawn.drop("docs"), "sources")

    dealt = docs.join(sources.select("sk", "runs"), "sk").withColumn("run", F.pmod(F.xxhash64("doc_id", "size"), F.col("runs")))
    order = Window.partitionBy("sk", "run").orderBy(F.xxhash64("size", "doc_id"), "doc_id", "size")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("nth", F.row_number().over(order)).withColumn("within", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    dealt = scratch.write(dealt.select("doc_id", "sk", "size", "run", "nth", "within"), "dealt")
    lengths = dealt.groupBy("sk", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = scratch.write(lengths.select("sk", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin")), "begins")
    packed = dealt.join(begins, ["sk", "run"]).select("doc_id", "sk", "size", "run", "nth", (F.col("begin") + F.col("within")).alias("start"))
    packed = scratch.write(packed, "packed")
    scratch.drop("sizes", "totals", "dealt", "begins")
    return packed, sources


def _owners(ranges: DataFrame, first: str, n: str) -> DataFrame:
    """Rows with a range first .. first + n - 1 of numbers, once for each chunk of numbers that it reaches into, to be found by an equi-join."""
    some = ranges.where(f"{n} > 0")
    return some.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(first) / CHUNK), F.floor((F.col(first) + F.col(n) - 1) / CHUNK))))


def _slots(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """shard, slot, sk, block: every slot of every output shard with the block that it takes.

    1. Each slot draws a source by itself, in proportion to the draws that the targets need, so the counts of a
       shard are a multinomial draw. A source's draws are numbered over the shards by counts of shards, summed in
       two levels.
    2. The totals are then brought to the targets: of a source drawn too often, a pseudorandom part of the draws goes
       to the sources drawn too seldom, one by one, in the order of their numbers.
    3. The i-th draw of a source maps through the permutation of its (i div blocks)-th pass over its blocks.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    shards = -(-total // SLOTS)
    # A fixed number of partitions: a few rows unfold to all slots, so Spark must not coalesce them by their size.
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))
    slots = spark.range(0, shards, 1, tasks).withColumnRenamed("id", "shard").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    slots = slots.where(F.col("shard") * SLOTS + F.col("slot") < total).withColumn("ticket", F.pmod(F.xxhash64("shard", "slot", F.lit("draw")), F.lit(max(1, total)).cast("long")))
    owners = _owners(sources.select("sk", "first_draw", "draws"), "first_draw", "draws")
    drawn = slots.withColumn("chunk", F.floor(F.col("ticket") / CHUNK)).join(owners, "chunk").where("ticket >= first_draw and ticket < first_draw + draws")
    drawn = scratch.write(drawn.select("shard", "slot", "sk"), "drawn")

    counts = drawn.groupBy("shard", "sk").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN_DOCS))
    counts = scratch.write(counts, "counts")
    upto = lambda *keys: Window.partitionBy(*keys)
    earlier = lambda w, by: F.coalesce(F.sum("n").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("sk", "run").agg(F.sum("n").alias("n")).withColumn("run_from", earlier(upto("sk"), "run"))
    begins = counts.withColumn("shard_from", earlier(upto("sk", "run"), "shard")).join(runs.select("sk", "run", "run_from"), ["sk", "run"])
    begins = scratch.write(begins.select("shard", "sk", (F.col("run_from") + F.col("shard_from")).alias("begin")), "begins")
    had = counts.groupBy("sk").agg(F.sum("n").alias("had"))
    known = sources.select("sk", "blocks", "draws").join(had, "sk", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    known = known.withColumns({"over": F.greatest(F.col("had") - F.col("draws"), F.lit(0)), "under": F.greatest(F.col("draws") - F.col("had"), F.lit(0))})
    ahead = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy(F.lit(0)).orderBy("sk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = scratch.write(known.withColumns({"first_over": ahead("over"), "first_under": ahead("under")}), "known")

    place = F.row_number().over(Window.partitionBy("shard", "sk").orderBy("slot")) - 1
    numbered = drawn.withColumn("place", place).join(begins, ["shard", "sk"]).join(known, "sk")
    numbered = numbered.withColumn("nth", permuted(F.col("begin") + F.col("place"), F.col("had"), F.col("sk"), F.lit("deal")))
    numbered = scratch.write(numbered.select("shard", "slot", "sk", "blocks", "nth", F.when(F.col("nth") >= F.col("draws"), F.col("first_over") + F.col("nth") - F.col("draws")).alias("moved")), "numbered")
    stay = numbered.where("moved is null").select("shard", "slot", "sk", "blocks", "nth")
    takers = _owners(known.select("sk", "blocks", "had", "first_under", "under"), "first_under", "under")
    gone = numbered.where("moved is not null").select("shard", "slot", "moved", F.floor(F.col("moved") / CHUNK).alias("chunk"))
    gone = gone.join(takers, "chunk").where("moved >= first_under and moved < first_under + under")
    dealt = stay.union(gone.select("shard", "slot", "sk", "blocks", (F.col("had") + F.col("moved") - F.col("first_under")).alias("nth")))
    block = permuted(F.pmod("nth", F.col("blocks")), F.col("blocks"), F.col("sk"), F.floor(F.col("nth") / F.col("blocks")))
    return dealt.select("shard", "slot", "sk", block.alias("block"))


def _pieces(packed: DataFrame) -> DataFrame:
    """One row per document and block that it reaches into, with the words of the document that stand there."""
    over = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + BLOCK)
    return over.select("doc_id", "sk", "run", "nth", "block", (begin - F.col("start")).alias("first_word"), (end - begin).alias("words"))


def mixture(documents: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, source, block, doc_id, first_word, words; a slot has the pieces of one block.

    See mix() for the rules. Joining the pieces to documents on doc_id and cutting the words gives the texts.
    """
    scratch = Scratch(documents.sparkSession, "mixture")
    packed, sources = _packed(documents, scratch)
    out = _slots(sources, scratch).join(_pieces(packed), ["sk", "block"])
    return out.select("shard", "slot", F.expr("if(sk = 'n', null, substring(sk, 2))").alias("source"), "block", "doc_id", "first_word", "words")


def mix(documents: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Needs doc_id, text and source; other columns are ignored. The words of a source form one stream, documents in a
    pseudorandom order that follows from their ids, cut into blocks of BLOCK words. The counts of the sources in each
    output shard are a multinomial draw, then adjusted so that each source gets as many slots as its target has
    blocks, and no block is used more than MOST times, so no document exceeds MOST times its size.
    Offsets come from running sums in two levels (within runs of some thousand documents, then over the runs), so a
    source with a third of all rows is no single task; slots and pieces meet on (source, block), which no hot key
    can fill. Reruns agree: nothing depends on partitions or order. A null text has size 0 and is taken 0 times; a
    null source is a source of its own, the last; rows that share doc_id and source are packed one after the other.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    packed, sources = _packed(documents, scratch)
    uses = scratch.write(_slots(sources, scratch).groupBy("sk", "block").agg(F.count("*").alias("uses")), "uses")
    taken = _pieces(packed).join(uses, ["sk", "block"]).groupBy("sk", "run", "nth").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    taken = scratch.write(taken, "taken")
    scratch.drop("uses", "drawn", "counts", "begins", "known", "numbered")
    out = packed.join(taken, ["sk", "run", "nth"], "left").join(sources.select("sk", "source_size", "target"), "sk")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
