"""Mix sources to target weights by fixed-length blocks of words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bounded_broadcast, saved

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
ROUNDS = 24
SOURCES_BROADCAST = 20_000


@dataclass(frozen=True)
class Mix:
    """The parts of a mix, each a table in the shared folder.

    ``rows``: every input row with its number, size and place (``start``, ``skey``)
    in its source's run of words. ``sources``: sizes and targets. ``slots``: the
    output, one row per block: output shard, place in it, source, pass over the
    source, block and words of it that are taken.
    """

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of sources from (``skey``, ``source``, ``source_size``).

    Sources in code point order, null last, take the weights in turn and share the
    sum of all sizes. None gets more than ``most`` times its size; what is left
    over goes to the others by weight until none is above. With sources ordered by
    the level at which they are full, running sums tell which of them are: the
    common level of the rest follows. Sums of integers stay exact.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumn("full", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("full") / F.col("weight"), "skey")
    everything = Window.partitionBy()
    levelled = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_before"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    capped = F.col("full") / F.col("weight") * F.col("weight_from") + F.col("full_before") <= F.col("total")
    levelled = levelled.withColumn("capped", capped)
    spare = F.col("total") - F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("full").cast("double")).otherwise(spare * F.col("weight") / F.nullif(open_weight, F.lit(0)))
    return levelled.select("skey", "source", "source_size", "weight", target.alias("target"))


def permuted(value: Column, size: Column, *key: Column, back: bool = False) -> Column:
    """Pseudorandom permutation of 0 .. size-1, for any size, by swap-or-not rounds.

    Each round pairs ``x`` with ``k - x`` and a hash of the pair decides whether
    they change places, so every round is its own inverse; ``back`` runs them the
    other way round. Nothing is stored per element.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *key), size) - x, size)
        moves = F.pmod(F.xxhash64(F.lit("bit"), r, F.greatest(x, other), *key), F.lit(2)) == 1
        return F.when(moves, other).otherwise(x)

    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.aggregate(rounds, value.cast("long"), swap)


def _located(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, total: Column, pieces: int = 1024) -> DataFrame:
    """Join points to the range that holds them: ranges are cut at equal steps, so the join has an equal key."""
    width = F.expr(f"({total}) div {pieces}") + 1
    cut = ranges.where(F.col(high) > F.col(low)).withColumn("_step", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("_step", F.floor(F.col(at) / width)).join(cut, "_step").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_step")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = BLOCK_WORDS, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> Mix:
    """Mix documents so that sources share the output by weight.

    1. Words of each source are packed into blocks of ``block`` words; documents
       follow each other in an order given by a hash of id and text. Places come
       from totals of small chunks, so no source is ever gathered in one task.
    2. A source's target fixes how many blocks it gives, the last one cut to the
       word. Every output slot draws a source in proportion to these numbers:
       counts of an output shard are multinomial. Draws above a source's number,
       about the square root of it, are dealt on to sources short of theirs.
    3. The j-th slot of a source is block ``permutation(j mod n)`` of pass ``j div
       n``: every pass holds each block once, so no word is taken more than
       ``most`` times, and each source gives its target to the word.

    Results depend on the rows alone, not on how they are partitioned. A null text
    has no words; null is a source of its own; rows without words take part in
    nothing; equal rows may change places. An empty table gives an empty mix.
    Columns other than the three named are not read.
    """
    source = F.col(source_column)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("mark"),
    )
    rows = saved(rows, "sizes")
    chunks = 1 + rows.count() // SHARD_SLOTS
    rows = rows.withColumn("chunk", F.pmod("mark", F.lit(chunks)))
    totals = rows.groupBy("skey", "chunk").agg(F.sum("size").alias("chunk_size"))
    earlier = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("skey", "chunk", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("skey", "chunk").orderBy("mark", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(totals, ["skey", "chunk"]).select(
        "row", "id", "source", "skey", "size", (F.col("before") + F.sum("size").over(inside) - F.col("size")).alias("start")
    )
    placed = saved(placed, "places")

    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    sources = saved(_quotas(source_targets(sizes, weights, most), block, seed), "sources")
    return Mix(placed, sources, saved(_slots(sources, block, seed), "slots"), block)


def _quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Blocks of each source, slots it fills, and the place of its short last block in the last pass."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    out = sources.withColumn("words", words).withColumn("blocks", F.ceil(size / block).cast("long"))
    out = out.withColumn("passes", F.when(size > 0, F.expr("words div source_size")).otherwise(0))
    out = out.withColumn("rest", F.col("words") - F.col("passes") * size)
    last = size - (F.col("blocks") - 1) * block
    at = F.when(size > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("skey"), F.col("passes"), back=True))
    out = out.withColumn("last_words", last).withColumn("last_at", at)
    rest = F.col("rest")
    more = (
        F.when(rest <= F.col("last_at") * block, F.ceil(rest / block))
        .when(rest <= F.col("last_at") * block + F.col("last_words"), F.col("last_at") + 1)
        .otherwise(F.ceil((rest + block - F.col("last_words")) / block))
    )
    out = out.withColumn("quota", F.when(size > 0, F.col("passes") * F.col("blocks") + more).otherwise(0).cast("long"))
    cumulative = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("quota_to", F.sum("quota").over(cumulative)).withColumn("quota_from", F.col("quota_to") - F.col("quota"))


def _slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    parts = max(1, min(2000, math.ceil(total / 65_536)))
    slots = spark.range(0, total, 1, parts).select(
        F.col("id").alias("slot"), F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("ticket")
    )
    drawn = _located(slots, "ticket", sources.select("skey", "quota_from", "quota_to"), "quota_from", "quota_to", f"{total}L").select("slot", "shard", "skey")
    drawn = saved(drawn, "draws")
    # Multinomial counts of each output shard and, from them, the number of each slot among its source's.
    counts = drawn.groupBy("shard", "skey").agg(F.count("*").alias("draws"))
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "skey", F.coalesce(F.sum("draws").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "skey").orderBy("slot")
    numbered = drawn.join(counts, ["shard", "skey"]).select("slot", "shard", "skey", (F.col("before") + F.row_number().over(inside) - 1).alias("nth"))

    # Draws above a source's quota go, in order, to the sources that are short.
    got = drawn.groupBy("skey").agg(F.count("*").alias("draws"))
    balance = sources.select("skey", "quota").join(got, "skey", "left").na.fill(0, ["draws"])
    balance = balance.withColumn("over", F.greatest(F.col("draws") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("draws"), F.lit(0)))
    run = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    balance = saved(balance.withColumn("over_from", F.sum("over").over(run) - F.col("over")).withColumn("short_to", F.sum("short").over(run)).withColumn("short_from", F.col("short_to") - F.col("short")), "balance")
    excess = balance.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    small = bounded_broadcast(balance.select("skey", "quota", "over_from"), SOURCES_BROADCAST)
    numbered = numbered.join(small, "skey")
    kept = numbered.where("nth < quota").select("slot", "shard", "skey", "nth")
    moved = numbered.where("nth >= quota").select("slot", "shard", (F.col("over_from") + F.col("nth") - F.col("quota")).alias("at"))
    short = balance.select("skey", "draws", "short_from", "short_to")
    moved = _located(moved, "at", short, "short_from", "short_to", f"{excess}L").select("slot", "shard", "skey", (F.col("draws") + F.col("at") - F.col("short_from")).alias("nth"))

    facts = bounded_broadcast(sources.select("skey", "blocks", "passes", "last_words", "last_at", "rest"), SOURCES_BROADCAST)
    out = kept.unionByName(moved).join(facts, "skey")
    out = out.withColumn("pass", F.expr("nth div blocks")).withColumn("turn", F.expr("nth % blocks"))
    out = out.withColumn("block", permuted(F.col("turn"), F.col("blocks"), F.lit(seed), F.col("skey"), F.col("pass")))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(F.lit(block))
    # Words of the last pass before this slot; the short block counts as short.
    earlier_words = F.col("turn") * block - F.when(F.col("last_at") < F.col("turn"), block - F.col("last_words")).otherwise(0)
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - earlier_words)))
    return out.select("shard", (F.col("slot") - F.col("shard") * SHARD_SLOTS).cast("int").alias("slot"), "skey", F.col("pass").cast("int").alias("pass"), "block", words.cast("int").alias("words"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document lies in: words ``low`` to ``high`` of the block."""
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    begin = F.col("block") * block
    return cut.select(
        "row", "skey", "block", (F.greatest("start", begin) - begin).alias("low"), (F.least(F.col("start") + F.col("size"), begin + block) - begin).alias("high"), (F.greatest("start", begin) - F.col("start")).alias("first_word")
    )


def taken_words(mixed: Mix) -> DataFrame:
    """Every input row with the words that the mix takes of it, repeats counted.

    Slots are counted per block before they meet the documents.
    """
    block = mixed.block
    uses = mixed.slots.groupBy("skey", "block").agg(
        F.count(F.when(F.col("words") >= block, 1)).alias("times"),
        F.collect_list(F.when(F.col("words") < block, F.col("words"))).alias("cuts"),  # one per pass at most
    )
    high_cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + F.greatest(F.lit(0), F.least(F.col("high"), c) - F.col("low")))
    words = F.col("times") * (F.col("high") - F.col("low")) + high_cut
    taken = _pieces(mixed.rows, block).join(uses, ["skey", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    sources = bounded_broadcast(mixed.sources.select("skey", "source_size", "target"), SOURCES_BROADCAST)
    return mixed.rows.join(taken, "row", "left").join(sources, "skey").select("row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The mix as documents: one row per document and pass, with the words taken in that pass.

    A document taken whole keeps its text as it is; of one taken in part, the
    words taken are joined by single spaces, in their order.  All columns of the
    input are returned; rows of which nothing is taken are left out.
    """
    base = docs.withColumn("_mix_row", F.monotonically_increasing_id())
    base = saved(base, "mixed")
    mixed = mix(base, id_column="_mix_row", text_column=text_column, source_column=source_column, **options)
    pieces = _pieces(mixed.rows, mixed.block).join(mixed.slots, ["skey", "block"])
    pieces = pieces.withColumn("n", F.least(F.col("high"), F.col("words").cast("long")) - F.col("low")).where("n > 0")
    # One list per document and pass, as long as the document has blocks.
    parts = pieces.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n"))).alias("_mix_parts"), F.sum("n").alias("_mix_n"))
    parts = mixed.rows.select("row", F.col("id").alias("_mix_row"), F.col("size").alias("_mix_size")).join(parts, "row").drop("row", "pass")
    words = F.regexp_extract_all(F.col(text_column), F.lit(f"({WORD})"), F.lit(1))
    some = F.concat_ws(" ", F.flatten(F.transform("_mix_parts", lambda p: F.slice("_mix_words", (p["first_word"] + 1).cast("int"), p["n"].cast("int")))))
    joined = base.join(parts, "_mix_row")
    joined = joined.withColumn("_mix_words", F.when(F.col("_mix_n") < F.col("_mix_size"), words))
    return joined.withColumn(text_column, F.when(F.col("_mix_n") == F.col("_mix_size"), F.col(text_column)).otherwise(some)).select(*docs.columns)
