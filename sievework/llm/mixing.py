"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of blocks: its documents in a pseudo-random order (a hash of the id), cut where the hash
passes equal steps, about ``block_words`` words each.  A source gives whole passes over its blocks and a last,
partial one up to the document nearest to its target.  A binary tree over the output shards splits the exact
block quotas: at each node the left half draws its share without replacement from the node's blocks, source by
source (hypergeometric), the right half keeps the rest.  The leaves' quotas are cut from a random permutation of
the source's blocks, so shards hold disjoint draws, and each shard is shuffled in itself.

Built-in expressions only.  Text never moves before the final arrangement: the decisions hang on the hash, the
source and the block.  Tables of sources and of blocks are small against the documents (a block is hundreds of
thousands of words), and only the documents of each source's last block pass through a window.

Null sources are a source of their own, ordered last; a source without words gets no words.  Null and empty texts
have size 0; they follow their block, so they are repeated or left out like its other documents.  Rows that share
an id act together.  An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import WORD, stored, unit_hash

#: The contract's weights, repeating over sources in code point order, and its greatest repetition.
WEIGHTS = (1, 2, 3)
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: weighted shares of all words, at most ``most`` times the source.

    Sources reach their limit in the order of limit by weight; with the first k at theirs, the others share the
    rest by weight.  The right k is the first for which the next source stays within its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = totals.withColumn("w", F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % len(weights)])
    whole = Window.partitionBy()
    rank = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    held = weighed.select(
        "source", "source_size", "w",
        F.sum("source_size").over(whole).alias("all"), F.sum("w").over(whole).alias("all_w"),
        (F.coalesce(F.sum("source_size").over(rank), F.lit(0)) * most).alias("full"), F.coalesce(F.sum("w").over(rank), F.lit(0)).alias("full_w"),
    )
    level = (F.col("all") - F.col("full")).cast("double") / (F.col("all_w") - F.col("full_w"))
    fits = F.when(level * F.col("w") <= F.col("source_size") * most, level)
    chosen = held.withColumn("level", F.max(fits).over(whole))
    return chosen.select(
        "source", "source_size",
        F.when(F.col("level").isNull(), (F.col("source_size") * most).cast("double")).otherwise(F.least(F.col("level") * F.col("w"), (F.col("source_size") * most).cast("double"))).alias("target"),
    )


def hypergeometric(whole: Column, good: Column, draws: Column, u: Column) -> Column:
    """The smallest count of good ones among ``draws`` of ``whole`` whose distribution function reaches ``u``.

    Weights follow from each other by the ratio of neighbours, over twelve deviations around the mean.
    """
    n, k, m = whole.cast("double"), good.cast("double"), draws.cast("double")
    mean = m * k / F.greatest(n, F.lit(1.0))
    spread = 12 * F.sqrt(mean * (1 - k / F.greatest(n, F.lit(1.0)))) + 2
    least = F.greatest(F.lit(0).cast("long"), (good + draws - whole).cast("long"), F.floor(mean - spread))
    most = F.greatest(least, F.least(good.cast("long"), draws.cast("long"), F.ceil(mean + spread)))
    steps = F.sequence(least, most)
    ratio = lambda x: (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t")),
        lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["t"] + a["w"]).alias("t")), lambda a: a["t"],
    )
    return F.aggregate(
        steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), least.alias("x")),
        lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["t"] + a["w"]).alias("t"), F.when(a["t"] < u * total, x).otherwise(a["x"]).alias("x")),
        lambda a: a["x"],
    )


PART = "struct<key:string,quota:bigint>"


def _draw(seed: str):
    """The step that draws one source's share of a node for its left half."""

    def step(state: Column, p: Column) -> Column:
        u = (unit_hash(F.lit(seed), F.col("first"), p["key"]) + 0.5) / float(2**60)
        got = hypergeometric(state["left"], p["quota"], state["draws"], u)
        return F.struct(
            (state["left"] - p["quota"]).alias("left"), (state["draws"] - got).alias("draws"),
            F.concat(state["parts"], F.array(F.struct(p["key"].alias("key"), got.alias("quota")))).alias("parts"),
        )

    return step


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``key, quota`` to ``shard, key, quota``: the block quotas of every source at every leaf, zeros left out.

    One row for each node of a level, with the quotas of all sources; each level halves the shards of a node.
    """
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", F.col("quota").cast("long").alias("quota")))).alias("parts")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("count"), "parts"
    )
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["quota"])
        half = (F.col("count") / 2).cast("int")
        sized = nodes.select("*", size.alias("size"), half.alias("half")).withColumn("share", F.floor(F.col("size") * F.col("half") / F.col("count")).cast("long"))

        drawn = sized.withColumn(
            "drawn",
            F.aggregate("parts", F.struct(F.col("size").alias("left"), F.col("share").alias("draws"), F.array().cast(f"array<{PART}>").alias("parts")), _draw(f"{seed}|{level}"), lambda s: s["parts"]),
        )
        rest = F.zip_with("parts", "drawn", lambda a, b: F.struct(a["key"].alias("key"), (a["quota"] - b["quota"]).alias("quota")))
        nodes = drawn.select(
            F.inline(
                F.filter(
                    F.array(
                        F.struct(F.col("first"), F.col("half").alias("count"), F.col("drawn").alias("parts")),
                        F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("count") - F.col("half")).alias("count"), rest.alias("parts")),
                    ),
                    lambda n: n["count"] > 0,
                )
            )
        )
    return nodes.select(F.col("first").alias("shard"), F.inline("parts")).filter("quota > 0")


class Mixture:
    """The plan of one mix; ``shards`` output shards, ``block_words`` words a block, reruns with one ``seed`` agree."""

    def __init__(self, docs: DataFrame, shards: int = 16, block_words: int = 500_000, seed: str = "mix") -> None:
        self.docs, self.shards, self.block_words, self.seed = docs, shards, block_words, seed
        text = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), words(F.col("text")).alias("size"))
        self.sizes = stored(self._keyed(text).drop("text"), "mix-sizes")
        self.sources = stored(self._sources(), "mix-sources")
        self.blocks = stored(self._blocks(), "mix-blocks")

    def _keyed(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``hash``, their order within a source: that of id and text, so that rows without id are spread."""
        hashed = unit_hash(F.lit(self.seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        return docs.select("*", hashed.alias("hash"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"))

    @staticmethod
    def _block(parts: str = "parts") -> Column:
        """The step of the hash's highest 31 of 60 bits in which a document falls."""
        return F.shiftright(F.shiftright(F.col("hash"), 29) * F.col(parts), 31)

    def _sources(self) -> DataFrame:
        """Each source's words, target, number of blocks, whole passes, and the hash where its partial pass ends."""
        totals = self.sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
        aimed = targets(totals.select("source", "source_size")).join(totals.select(F.col("source").alias("_s"), "key"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        base = stored(
            aimed.select(
                "key", "source", "source_size", "target",
                F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / self.block_words).cast("long").alias("parts"),
                F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
            ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
            "mix-targets",
        )
        sums = self.sizes.join(base.select("key", "parts", "rest"), "key").groupBy("key", "rest", self._block().alias("block")).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        last = placed.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))).select("key", "block", "before", "rest")
        inside = self.sizes.join(base.select("key", "parts"), "key").withColumn("block", self._block()).join(last, ["key", "block"])
        steps = inside.groupBy("key", "block", "before", "rest", "hash").agg(F.sum("size").alias("words"))
        within = Window.partitionBy("key").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
        middle = F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)) + F.col("words") / 2
        # if not even the first document of the block is taken, the pass ends before it: all earlier blocks stay whole
        cut = steps.withColumn("middle", middle).groupBy("key", "block").agg(
            F.coalesce(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("hash"))), F.min("hash") - 1).alias("cut")
        )
        return base.join(cut.withColumnRenamed("block", "last"), "key", "left").select(
            "key", "source", "source_size", "target", "parts", "passes",
            F.when(F.col("rest") > 0, F.col("last")).alias("last"), F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(-1))).otherwise(-1).cast("long").alias("cut"),
        )

    def _blocks(self) -> DataFrame:
        """``key, block, draws``: pass and shard of every draw of a block."""
        counts = self.sources.select("key", "parts", "passes", (F.coalesce(F.col("last"), F.lit(-1)) + 1).alias("more"))
        units = counts.select(
            "key",
            F.explode(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(0).cast("long"), F.col("passes")),
                        lambda p: F.transform(
                            F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda b: (p < F.col("passes")) | (b < F.col("more"))),
                            lambda b: F.struct(b.alias("block"), p.alias("pass")),
                        ),
                    )
                )
            ).alias("unit"),
        ).select("key", "unit.block", "unit.pass")
        permuted = Window.partitionBy("key").orderBy(unit_hash(F.lit(self.seed), F.col("key"), F.col("block"), F.col("pass")), "block", "pass")
        numbered = units.withColumn("u", F.row_number().over(permuted).cast("long"))
        quotas = units.groupBy("key").agg(F.count("*").alias("quota"))
        leaves = split_tree(quotas, self.shards, self.seed)
        until = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        dealt = leaves.withColumn("until", F.sum("quota").over(until)).select("key", "shard", F.explode(F.sequence(F.col("until") - F.col("quota") + 1, F.col("until"))).alias("u"))
        return numbered.join(dealt, ["key", "u"]).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))

    def _drawn(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` rows (with ``hash`` and ``key``) with ``source_size``, ``target`` and their own ``draws``."""
        placed = keyed.join(self.sources.drop("source"), "key", "left").withColumn("block", self._block())
        draws = placed.join(self.blocks, ["key", "block"], "left")
        own = F.filter("draws", lambda d: (d["pass"] < F.col("passes")) | (F.col("hash") <= F.col("cut")))
        return draws.withColumn("draws", F.coalesce(own, F.array().cast("array<struct<pass:bigint,shard:int>>")))

    def documents(self) -> DataFrame:
        """One row for every document: ``doc_id, size, source_size, target, taken`` and the shards of its draws."""
        return self._drawn(self.sizes).select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards")
        )

    def rows(self, arranged: bool = True) -> DataFrame:
        """The mix itself: the rows of the documents, a row for every draw, with their own columns only.

        If ``arranged``, a partition holds whole shards, each in a shuffled order of its own.
        """
        mine = self.docs.columns
        packed = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in mine]).alias("row"), F.col("doc_id"), F.col("source"), F.col("text"))
        drawn = self._drawn(self._keyed(packed)).select("row", "hash", F.explode("draws").alias("draw"))
        if arranged:
            drawn = drawn.select("row", F.col("draw.shard").alias("shard"), unit_hash(F.lit(self.seed), F.col("hash"), F.col("draw.pass"), F.lit("order")).alias("at"))
            # ranges over (shard, at) keep shards whole and in order, and let a large shard lie in several files
            drawn = drawn.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
        return drawn.select(*[F.col("row").getField(c).alias(c) for c in mine])
