"""Operator 4 [native]: mixing sources to target weights.

The words of a source, its documents in a pseudorandom order, are packed into blocks of a fixed number of words (the
last one may be shorter). The mix is a sequence of slots, cut into output shards. For each shard the numbers of slots
of the sources are drawn from a multinomial distribution; a source stops when it has its target, and what sources
still lack after all shards makes up one closing shard, so that a source's words equal its target exactly. Slot j of
a source is in pass j / blocks, and a pseudorandom permutation of block indexes (swap-or-not, one for each source and
pass) maps it to its block. Blocks are joined by index.

Sizes: a null or empty text has no words; it stays in the result with 0 taken. A null source is a source of its own,
last in order. Repeated rows count each. With an empty table, or no words at all, nothing is taken. All draws are
hashes of indexes, contents and the seed: reruns agree, whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the words that a source may give, as a multiple of its size.
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, ROUNDS, STRIPS = 128, 16, 4096
#: Slots in a row of draws that is dealt out, and slots for a task.
CUT, DEALT = 256, 16_384


@dataclass
class Mix:
    base: DataFrame  # row, source, size, start, and any kept columns
    sources: DataFrame  # source, source_size, target, blocks, passes, ...
    slots: DataFrame  # shard, source, slot, pass, block, words


def _turned(x: Column, n: Column, key: list[Column], rounds: Column) -> Column:
    """Swap-or-not: each round is its own inverse, so the same rounds backwards invert the permutation of 0 .. n - 1."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit("turn")), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, x, step)


def permuted(x: Column, n: Column, key: list[Column]) -> Column:
    return _turned(x, n, key, F.sequence(F.lit(1), F.lit(ROUNDS)))


def unpermuted(x: Column, n: Column, key: list[Column]) -> Column:
    return _turned(x, n, key, F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)))


def _targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source. The windows hold a row for each source, not for each document, in one task: sources are
    thought of as some thousands of names at most, not as free text."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    t = (
        total.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    # A source of the k smallest ratios is at its cap; the level is what the others then get for each unit of weight.
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"])
    return t.select("source", "sid", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 1, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """keep: further columns of docs (the text too, if wanted) that base carries."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).cast("int").alias("kept")
    base = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("place"), kept,
        ),
        "mix-base",
    )
    n_docs = base.count()
    sources = _targets(base.select("source", "size"), weights, most)
    words = F.round("target").cast("long")
    sources = (
        sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0))
        .withColumn("rest", words - F.col("passes") * F.col("source_size"))
        .withColumn("last", F.col("source_size") - (F.col("blocks") - 1) * block)  # words of the last block
        .withColumn("tail", F.when(F.col("blocks") > 0, unpermuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), [F.col("sid"), F.col("passes"), F.lit(seed)])))
        .withColumn("need", F.ceil(F.col("rest") / F.lit(block)))
        .withColumn("need", F.col("need") + F.when((F.col("need") > F.col("tail")) & (F.col("need") * block - (block - F.col("last")) < F.col("rest")), 1).otherwise(0))
        .withColumn("slots", F.coalesce(F.col("passes") * F.col("blocks") + F.col("need"), F.lit(0)))
    )
    sources = saved(sources, "mix-sources")
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    per_shard = max(4096, int(n_slots**0.5))

    # Draws: a slot's hash falls into one source's part of [0, 1), found through equal strips of it.
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    parts = sources.where("slots > 0").select("sid", "slots", (F.sum("slots").over(upto) / F.lit(max(n_slots, 1))).alias("to"))
    parts = parts.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0.0)))
    strips = parts.select("sid", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * STRIPS), F.least(F.floor(F.col("to") * STRIPS), F.lit(STRIPS - 1)))).alias("strip"))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit("draw")), 11) / F.lit(float(1 << 53))
    drawn = spark.range(n_slots).select(F.floor(F.col("id") / F.lit(per_shard)).alias("shard"), draw.alias("draw"))
    drawn = drawn.withColumn("strip", F.floor(F.col("draw") * STRIPS)).join(strips, "strip").where("draw >= from and draw < to")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = sources.where("slots > 0").select("sid", "source", "source_size", "blocks", "passes", "rest", "last", "tail", "slots")
    open_slots = counts.withColumn("at", before).join(plan.select("sid", "slots"), "sid").select("shard", "sid", "at", F.least(F.col("n"), F.col("slots") - F.col("at")).alias("n")).where("n > 0")
    short = plan.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select(F.lit((n_slots + per_shard - 1) // per_shard).cast("long").alias("shard"), "sid", F.coalesce("got", F.lit(0)).cast("long").alias("at"), (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")
    # Runs of slots are cut and dealt out before they are made rows: a run may hold any part of all slots.
    cuts = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1, F.lit(CUT)))
    runs = open_slots.unionByName(short).select("shard", "sid", (F.col("at") + F.col("n")).alias("end"), cuts.alias("from")).repartition(max(1, n_slots // DEALT), "sid", "from")
    slots = runs.select("shard", "sid", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CUT, F.col("end")) - 1)).alias("slot"))
    slots = slots.join(plan, "sid").withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("i", F.col("slot") % F.col("blocks"))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block))
    so_far = F.col("i") * block - F.when(F.col("i") > F.col("tail"), block - F.col("last")).otherwise(0)
    slots = (
        slots.withColumn("block", permuted(F.col("i"), F.col("blocks"), [F.col("sid"), F.col("pass"), F.lit(seed)]))
        .withColumn("full", length)
        .withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("full")).otherwise(F.least(F.col("full"), F.col("rest") - so_far)))
        .select("shard", "source", "sid", "slot", F.col("pass"), "passes", "block", "full", "words")
    )

    # Where a document's words begin in its source: sums by bins, then within a bin; either is about the root of the rows.
    bins = max(1, int(n_docs**0.5))
    binned = base.select("row", "source", "size", "place", "id").withColumn("bin", F.pmod("place", F.lit(bins))).join(sources.select(F.col("source").alias("name"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    offsets = binned.groupBy("sid", "bin").agg(F.sum("size").alias("of_bin")).withColumn("bin_start", F.coalesce(F.sum("of_bin").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("of_bin")
    within = Window.partitionBy("sid", "bin").orderBy("place", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["sid", "bin"]).select("row", "sid", "source_size", "target", "size", (F.col("bin_start") + F.col("inner")).alias("start"))
    return Mix(base.join(saved(starts, "mix-starts").drop("size"), "row"), sources, slots)


def _pieces(base: DataFrame, block: int) -> DataFrame:
    """Rows (row, sid, block, lo, hi): the part lo .. hi of a block that a document fills, and where the part begins in the document."""
    at = F.col("block") * block
    return (
        base.where("size > 0").select("row", "sid", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)))).alias("block"))
        .select("row", "sid", "block", "size", (F.greatest(F.col("start"), at) - at).alias("lo"), (F.least(F.col("start") + F.col("size"), at + block) - at).alias("hi"), (F.greatest(F.col("start"), at) - F.col("start")).alias("from"))
    )


def taken(m: Mix, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, size, source_size, target, taken), one for each document."""
    drawn = m.slots.groupBy("sid", "block").agg(F.count_if(F.col("words") == F.col("full")).alias("times"), F.max(F.when(F.col("words") < F.col("full"), F.col("words"))).alias("part"))
    got = F.col("times") * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", F.coalesce("part", F.lit(0))) - F.col("lo"), F.lit(0))
    words = _pieces(m.base, block).join(drawn, ["sid", "block"]).groupBy("row").agg(F.sum(got).alias("taken"))
    return m.base.select("row", F.col("id").alias(id_col), "size", "source_size", "target").join(words, "row", "left").select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix with docs' columns: one row for each pass that takes a document whole, and one with the taken words for a pass that takes a part."""
    m = mix(docs, block=block, keep=tuple(docs.columns), id_col=id_col, text_col=text_col, source_col=source_col, **options)
    passes = m.sources.select("sid", "passes")
    last = m.slots.where(F.col("pass") == F.col("passes")).select("sid", "block", "words")
    parts = (
        _pieces(m.base, block).join(last, ["sid", "block"]).withColumn("n", F.least("hi", "words") - F.col("lo")).where("n > 0")
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "n"))).alias("parts"), F.sum("n").alias("got"))
    )  # fmt: skip  a document's parts: as many as it has blocks
    whole = m.base.where("size > 0").join(passes, "sid").join(parts, "row", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    copies = F.col("passes") + F.when(F.col("got") == F.col("size"), 1).otherwise(0)
    full = whole.withColumn("copies", copies.cast("int")).where("copies > 0").select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).select("kept.*")
    cut = F.concat_ws(" ", F.flatten(F.transform("parts", lambda p: F.slice(F.regexp_extract_all(F.col(f"kept.{text_col}"), F.lit(WORD), F.lit(0)), (p["from"] + 1).cast("int"), p["n"].cast("int")))))
    part = whole.where("got > 0 and got < size").withColumn("cut", cut)
    types = {f.name: f.dataType for f in docs.schema.fields}
    changed = {text_col: F.col("cut").cast(types[text_col])} | ({chars_col: F.length("cut").cast(types[chars_col])} if chars_col in types else {})
    return full.unionByName(part.select(*[changed.get(c, F.col(f"kept.{c}")).alias(c) for c in docs.columns]))
