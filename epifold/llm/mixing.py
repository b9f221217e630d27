"""Mix sources to target weights with DataFrame functions only.

1. Every text is cut into blocks of words; a block has a place in its source's
   permuted order, given by a keyed digest.
2. Targets share all words by weight; none is above ``CAP`` times its source,
   what is over goes to the others by weight.
3. A source gives all its blocks as often as its target holds it, and of one more
   pass the first blocks of the permuted order up to the nearest word count: its
   exact quota of blocks.
4. A binary tree splits the quotas among the output shards: at every node the
   left half draws its blocks from the sources' quotas without replacement
   (multivariate hypergeometric, one source after the other). No node moves a
   block, only counts. Groups of sources are dealt first, then each group's own.
5. A shard takes, of each source, the next blocks of the permuted order, so
   shards are disjoint, and orders what it has by another digest.

Ranks come from counts per bucket of the digest and a running count inside the
bucket, so that a source with most of the rows is dealt over many tasks.

Defined results: a NULL text has no words and is never drawn as blocks; a NULL
source is a source of its own, last in order; repeated rows are drawn one by one.
Without any word all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epifold.operators.ranges import prefix_sums
from epifold.sources.storage import Scratch

Store = Callable[[DataFrame, str], DataFrame]

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 256
#: Blocks whose ranks one task counts together.
BUCKET = 4096
#: Blocks of an output shard, about.
SHARD_BLOCKS = 8192
SEED = "mix"
DIGITS = 13
SPACE = 16**DIGITS


def _digest(*parts: Column) -> Column:
    """A keyed place in [0, SPACE)."""
    text = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.conv(F.substring(text, 1, DIGITS), 16, 10).cast("long")


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, print, copy, source, size): one row per document, told apart by ``copy`` if equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.md5(text.cast("binary")).alias("print"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    alike = Window.partitionBy("doc_id", "print").orderBy(F.col("source").asc_nulls_last())
    return narrow.withColumn("copy", F.row_number().over(alike))


def targets(rows: DataFrame, block_words: int | None, store: Store) -> DataFrame:
    """(source, source_size, blocks, target): one row per source.

    Ranks and running sums over the sources go through ranges of them, so that
    there may be one source per host.
    """
    blocks = F.lit(1) if block_words is None else F.ceil(F.col("size") / block_words)
    per = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(blocks).cast("long").alias("blocks")
    )
    # From here on there is one row per source.
    per = per.withColumns({"one": F.lit(1).cast("long"), "at": F.struct(F.col("source").isNull(), "source")})
    per = prefix_sums(per, [], "at", {"rank": "one"}, fix=lambda df: store(df, "ranks"))
    weights = F.array(*map(F.lit, WEIGHTS))
    weight = F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": CAP * F.col("source_size")})
    per = per.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    per = per.withColumn("by_ratio", F.struct("ratio", "at"))
    per = prefix_sums(per, [], "by_ratio", {"caps": "cap", "weights": "weight"}, fix=lambda df: store(df, "ratios"))
    total, weight_of_all = per.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(total).cast("long") - (F.col("caps") - F.col("cap"))
    level = left.cast("double") / (F.lit(weight_of_all).cast("long") - (F.col("weights") - F.col("weight")))
    per = store(per.withColumn("level", level), "levels")
    # Sources up to this level are full; the others share what is left by weight.
    rise = per.where("ratio > level").agg(F.min_by("level", "ratio")).first()[0]
    rise = F.lit(rise).cast("double")
    target = F.when(F.col("ratio") > rise, rise * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", "blocks", target.alias("target"))


def _drawn(total: Column, kind: Column, draws: Column, *key: Column) -> Column:
    """How many of ``kind`` among ``total`` are in ``draws`` taken without replacement.

    The weights of the possible counts follow from each other by a ratio; a
    running choice keeps every count with its share of the weight so far.
    """
    n, k, d = (x.cast("double") for x in (total, kind, draws))
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(mean * (n - k) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - (total - kind), F.floor(mean - 10 * spread - 2).cast("long"))
    high = F.least(kind, draws, F.ceil(mean + 10 * spread + 2).cast("long"))
    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), low.alias("pick"))

    def step(state, x):
        chance = F.pmod(F.xxhash64(*key, x), F.lit(1 << 40)) / float(1 << 40)
        total_weight = state["sum"] + state["weight"]
        ratio = (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
        return F.struct(
            (state["weight"] * ratio).alias("weight"),
            total_weight.alias("sum"),
            F.when(chance * total_weight < state["weight"], x).otherwise(state["pick"]).alias("pick"),
        )

    return F.aggregate(F.sequence(low, F.greatest(low, high)), start, step, lambda s: s["pick"])


def _halved(nodes: DataFrame, level: int, draws: Column) -> DataFrame:
    """Both children of every node (tree, node, quota): the left one takes ``draws`` blocks."""
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q["n"])
    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<struct<source:string,n:bigint>>").alias("out"))

    def take(state, q):
        drawn = F.transform(
            F.array(_drawn(state["total"], q["n"], state["draws"], F.lit(SEED), F.lit(level), F.col("tree"), F.col("node"), q["source"])),
            lambda x: F.struct(
                (state["total"] - q["n"]).alias("total"),
                (state["draws"] - x).alias("draws"),
                F.array_append(state["out"], F.struct(q["source"].alias("source"), x.alias("n"))).alias("out"),
            ),
        )
        return drawn[0]

    nodes = nodes.withColumn("left", F.aggregate("quota", start, take, lambda s: s["out"]))
    right = F.zip_with("quota", "left", lambda a, b: F.struct(a["source"].alias("source"), (a["n"] - b["n"]).alias("n")))
    children = F.array(
        F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quota")),
        F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quota")),
    )
    return nodes.select("tree", "all", F.explode(children).alias("c")).select("tree", "c.node", "c.quota", "all")


def _roots(quotas: DataFrame) -> DataFrame:
    """The root of each ``tree``: the list of its quotas and their sum."""
    listed = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("quota")
    return quotas.groupBy("tree").agg(listed, F.sum("n").alias("all")).withColumn("node", F.lit(0).cast("long"))


def _leaves(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree", F.col("node").alias("shard"), F.explode("quota").alias("q")).select("tree", "q.source", "shard", "q.n")


def split(quotas: DataFrame, depth: int, store: Store = lambda df, name: df) -> DataFrame:
    """(source, shard, n): quotas of blocks dealt to 2^depth shards of equal size.

    ``quotas`` is (source, n), one row per source. Sources are put into groups, as
    many as a group has members. One tree deals the groups' totals; then a tree
    per group deals its sources, each node's draws being those of the group. So
    no row lists more than about the root of the number of sources.
    """
    groups = max(1, math.isqrt(max(0, quotas.count() - 1)) + 1)
    grouped = quotas.withColumn("tree", F.pmod(F.xxhash64("source"), F.lit(groups)))
    totals = grouped.groupBy("tree").agg(F.sum("n").alias("n"))
    nodes = _roots(totals.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").cast("string").alias("source"), "n"))
    for level in range(depth):

        def bound(k: Column, width: int) -> Column:
            return F.floor(F.col("all").cast("decimal(38,0)") * k / F.lit(width)).cast("long")

        left = bound(2 * F.col("node") + 1, 2 ** (level + 1)) - bound(2 * F.col("node"), 2 ** (level + 1))
        nodes = _halved(nodes, level, left)
        if level % 4 == 3:
            nodes = nodes.repartition("node")
    dealt = store(_leaves(nodes).select(F.col("source").cast("long").alias("tree"), "shard", "n"), "groups")
    nodes = _roots(grouped)
    for level in range(depth):
        height = depth - level
        half = F.shiftright("shard", height - 1)
        # What a group has in the left half of a node is what its shards there have.
        draws = dealt.where(half % 2 == 0).groupBy("tree", F.floor(half / 2).cast("long").alias("node")).agg(F.sum("n").alias("draws"))
        nodes = _halved(nodes.join(draws, ["tree", "node"]), level, F.col("draws"))
    return _leaves(nodes).select("source", "shard", "n")


def _none(column: str) -> Column:
    """A source as a join key that is never NULL."""
    return F.concat(F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(column, F.lit("")))


def mix(docs: DataFrame, block_words: int | None = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The rows with sizes and targets, and the mixture.

    Rows: (doc_id, print, copy, source, size, source_size, target). Mixture: (shard,
    position, doc_id, print, copy, block, pass, words), one row per drawn block.
    With ``block_words`` None a block is a whole text.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        rows = scratch.store(rows_of(docs), "rows")
        plan = scratch.store(targets(rows, block_words, scratch.store).withColumn("key", _none("source")), "plan")
        whole = rows.withColumn("key", _none("source"))
        known = whole.join(plan.drop("source"), "key").drop("key")
        per_text = F.lit(1) if block_words is None else F.ceil(F.col("size") / block_words).cast("int")
        number = F.explode(F.when(per_text > 0, F.sequence(F.lit(0), per_text - 1)))
        blocks = whole.select("key", "doc_id", "print", "copy", "size", number.alias("block"))
        words = F.col("size") if block_words is None else F.least(F.lit(block_words), F.col("size") - block_words * F.col("block")).cast("long")
        place = _digest(F.lit(SEED), F.col("doc_id"), F.col("print"), F.col("copy"), F.col("block"))
        blocks = blocks.withColumns({"words": words, "place": place}).drop("size")
        # The digest's range is cut into as many buckets as the source has blocks for.
        buckets = plan.select("key", F.ceil(F.col("blocks") / BUCKET).cast("long").alias("buckets"))
        blocks = scratch.store(
            blocks.join(buckets, "key").withColumn("bucket", F.floor(F.col("place") / F.lit(float(SPACE)) * F.col("buckets")).cast("long")).drop("buckets"),
            "blocks",
        )
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = blocks.groupBy("key", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
        sums = sums.select("key", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
        inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "print", "copy", "block")
        running = blocks.withColumns(
            {
                "run_words": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"),
                "run_rank": F.row_number().over(inside) - 1,
            }
        ).join(sums, ["key", "bucket"])
        full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        passes = plan.select("key", "blocks", full.alias("passes"), (F.col("target") - full * F.col("source_size")).alias("rest"))
        ranked = running.join(passes, "key").withColumn("rank", F.col("rank_before") + F.col("run_rank"))
        extra = (F.col("words_before") + F.col("run_words") + F.col("words") / 2 <= F.col("rest")) & (F.col("rest") > 0)
        ranked = scratch.store(
            ranked.select("key", "doc_id", "print", "copy", "block", "words", "rank", "blocks", "passes", (F.col("passes") + extra.cast("long")).alias("times")),
            "ranked",
        )
        quotas = scratch.store(ranked.groupBy("key").agg(F.sum("times").alias("n")).where("n > 0").withColumnRenamed("key", "source"), "quotas")
        total = quotas.agg(F.sum("n")).first()[0] or 0
        depth = max(0, (-(-total // shard_blocks) - 1).bit_length())
        shards = split(quotas, depth, scratch.store)
        # A shard's range of a source, listed in every cell of equal width that it meets.
        upto = Window.partitionBy("source").orderBy("shard")
        high = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranges = shards.withColumn("high", high).withColumn("low", F.col("high") - F.col("n")).where("n > 0")
        ranges = ranges.join(quotas.withColumnRenamed("n", "quota"), "source")
        width = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.lit(2**depth))).cast("long")
        cells = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
        ranges = scratch.store(ranges.select(F.col("source").alias("key"), "shard", "low", "high", width.alias("width"), cells.alias("cell")), "ranges")
        widths = ranges.select("key", "width").distinct()
        pass_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
        drawn = ranked.where("times > 0").select("key", "doc_id", "print", "copy", "block", "words", "rank", "blocks", pass_.alias("pass"))
        drawn = drawn.withColumn("index", F.col("pass") * F.col("blocks") + F.col("rank")).join(widths, "key").withColumn("cell", F.floor(F.col("index") / F.col("width")))
        placed = drawn.join(ranges.drop("width"), ["key", "cell"]).where("low <= index and index < high")
        order = _digest(F.lit(SEED), F.lit("local"), F.col("doc_id"), F.col("print"), F.col("copy"), F.col("block"), F.col("pass"))
        local = Window.partitionBy("shard").orderBy("order", "doc_id", "print", "copy", "block", "pass")
        mixture = placed.withColumn("order", order).select(
            "shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "print", "copy", "block", "pass", "words"
        )
        known = known.select("doc_id", "print", "copy", "source", "size", "source_size", "target")
        return scratch.keep(known), scratch.keep(mixture)

