"""Density clustering of positions (DBSCAN) on a grid, exact, without comparing all pairs.

Cells have the side eps / sqrt(2), so two points of one cell are always neighbours.  A cell with at
least ``min_points`` rows is dense: all its points are core points and none of them is compared.  Only
points of thin cells (fewer than ``min_points`` rows each) look at the 20 cells around them.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.detectors import with_rate
from sievework.session import settle

EPS = 0.5
MIN_POINTS = 5

# Cells that can hold a point within eps: the 5 x 5 block without its corners.
AROUND = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) < 4]
HALF_AROUND = [(dx, dy) for dx, dy in AROUND if (dx, dy) > (0, 0)]


class Clustering:
    """Points of a table, their cells and which of them are core, border or noise."""

    def __init__(self, df: DataFrame, latitude: str, longitude: str, eps: float = EPS, min_points: int = MIN_POINTS):
        self.df, self.latitude, self.longitude, self.eps, self.min_points = df, latitude, longitude, eps, min_points
        self.side = eps / math.sqrt(2)
        lat, lon = F.col(latitude).cast("double"), F.col(longitude).cast("double")
        both = df.select(lat.alias("_lat"), lon.alias("_lon")).filter("_lat is not null and _lon is not null")
        # Collects one row: the scale of the two axes.
        scale = both.agg(
            F.count(F.lit(1)).alias("n"), F.avg("_lat").alias("mx"), F.stddev_pop("_lat").alias("sx"),
            F.avg("_lon").alias("my"), F.stddev_pop("_lon").alias("sy"),
        ).first()
        self.rows = scale["n"]
        self.enough = self.rows >= min_points
        if not self.enough:
            return
        x = (F.col("_lat") - scale["mx"]) / (scale["sx"] or 1.0)
        y = (F.col("_lon") - scale["my"]) / (scale["sy"] or 1.0)
        # Equal points become one row with a weight; copies are combined inside each task.
        spots = both.groupBy("_lat", "_lon").agg(F.count(F.lit(1)).alias("weight"))
        spots = spots.withColumns({"x": x, "y": y})
        self.points = settle(spots.withColumns({"cx": F.floor(F.col("x") / self.side), "cy": F.floor(F.col("y") / self.side)}))
        self.cells = settle(self.points.groupBy("cx", "cy").agg((F.sum("weight") >= min_points).alias("dense")))
        self.thin = settle(self._thin_points())

    def _thin_points(self) -> DataFrame:
        """Points of thin cells with ``core`` and ``near_dense``.

        Each meets the rows of its own and 20 other cells; a dense cell meets at most 4 points of each
        of 20 thin cells, so the work grows with the table and not with its square.  Comparisons are
        filtered and summed as they are made.
        """
        thin_cells = self.cells.filter("not dense").select("cx", "cy")
        mine = self.points.join(thin_cells, ["cx", "cy"], "left_semi")
        looks = self._looks(mine).join(self.cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "dense"), ["nx", "ny"])
        others = self.points.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("weight").alias("ow"))
        met = looks.join(others, ["nx", "ny"]).filter(self._close("x", "y", "ox", "oy"))
        judged = met.groupBy("_lat", "_lon", "x", "y", "cx", "cy").agg(
            (F.sum("ow") >= self.min_points).alias("core"), F.max("dense").alias("near_dense")
        )
        return judged

    def _looks(self, points: DataFrame) -> DataFrame:
        offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND])
        spread = points.select("_lat", "_lon", "x", "y", "cx", "cy", F.inline(offsets))
        return spread.select("_lat", "_lon", "x", "y", "cx", "cy", (F.col("cx") + F.col("dx")).alias("nx"), (F.col("cy") + F.col("dy")).alias("ny"))

    def _close(self, ax: str, ay: str, bx: str, by: str) -> Column:
        return F.pow(F.col(ax) - F.col(bx), 2) + F.pow(F.col(ay) - F.col(by), 2) <= self.eps * self.eps

    def noise_points(self) -> DataFrame:
        """Points that are neither core nor within reach of a core point."""
        open_points = self.thin.filter("not core and not near_dense")
        cores = self.thin.filter("core").select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        reached = self._looks(open_points).join(cores, ["nx", "ny"]).filter(self._close("x", "y", "ox", "oy"))
        return open_points.join(reached.select("_lat", "_lon").distinct(), ["_lat", "_lon"], "left_anti").select("_lat", "_lon")

    def noise_rows(self, ids: list[str]) -> DataFrame:
        lat, lon = F.col(self.latitude).cast("double"), F.col(self.longitude).cast("double")
        if not self.enough:
            return self.df.select(*ids, self.latitude, self.longitude).filter(F.lit(False))
        keyed = self.df.select(*ids, F.col(self.latitude), F.col(self.longitude), lat.alias("_lat"), lon.alias("_lon"))
        return keyed.join(self.noise_points(), ["_lat", "_lon"], "left_semi").select(*ids, self.latitude, self.longitude)

    def core_points(self) -> DataFrame:
        dense = self.points.join(self.cells.filter("dense").select("cx", "cy"), ["cx", "cy"], "left_semi")
        return dense.select("x", "y", "cx", "cy").unionByName(self.thin.filter("core").select("x", "y", "cx", "cy"))

    def cluster_count(self) -> int:
        """Groups of cells joined by two core points within eps. Collects one number.

        Pairs of cells are decided on bounding boxes: near enough as a whole, too far as a whole, or
        near enough at the outermost points.  Pairs that stay open and are not in one group already are
        quartered; a pair splits into at most 16, and boxes with one point each are always decided.
        """
        if not self.enough:
            return 0
        core = settle(self.core_points())
        boxes = self._boxes(core, 0)
        labels = settle(boxes.select(F.struct("bx", "by").alias("cell"))).select("cell", F.col("cell").alias("label"))
        offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in HALF_AROUND])
        here, there = F.struct("bx", "by"), F.struct((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"))
        pairs = boxes.select("bx", "by", F.inline(offsets)).select(here.alias("a"), there.alias("b"))
        pairs = pairs.select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), "a", "b")
        level = 0
        while True:
            judged = settle(self._judge(pairs, self._boxes(core, level)))
            labels = self._grouped(labels, judged.filter("linked").select("root_a", "root_b").distinct())
            side = lambda root, name: labels.select(F.col("cell").alias(root), F.col("label").alias(name))
            left = judged.filter("not linked").join(side("root_a", "_la"), "root_a").join(side("root_b", "_lb"), "root_b")
            left = settle(left.filter("_la != _lb").select("root_a", "root_b", "a", "b"))
            if left.isEmpty():
                return labels.select("label").distinct().count()
            level += 1
            wanted = left.select("a").union(left.select("b")).distinct().withColumnRenamed("a", "parent")
            parent = F.struct(F.floor(F.col("bx") / 2).alias("bx"), F.floor(F.col("by") / 2).alias("by"))
            children = self._boxes(core, level).select(F.struct("bx", "by").alias("child"), parent.alias("parent")).join(wanted, "parent", "left_semi")
            pairs = (
                left.join(children.select(F.col("parent").alias("a"), F.col("child").alias("child_a")), "a")
                .join(children.select(F.col("parent").alias("b"), F.col("child").alias("child_b")), "b")
                .select("root_a", "root_b", F.col("child_a").alias("a"), F.col("child_b").alias("b"))
            )

    def _grouped(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Give linked cells the smallest label of their group.

        Every round takes the smallest label around and then the label of that label, so the labels
        of long chains close in by halves.
        """
        # Links join groups, so they are drawn between the cells the groups are named after.
        group = lambda root, name: labels.select(F.col("cell").alias(root), F.col("label").alias(name))
        edges = links.join(group("root_a", "src"), "root_a").join(group("root_b", "dst"), "root_b").filter("src != dst").select("src", "dst").distinct()
        edges = settle(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        while True:
            around = edges.join(labels.select(F.col("cell").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("_near"))
            stepped = labels.join(around, labels["cell"] == around["src"], "left").select("cell", "label", F.least("label", F.coalesce("_near", "label")).alias("_next"))
            jump = stepped.select(F.col("cell").alias("_next"), F.col("_next").alias("_jump"))
            best = F.least("_next", "_jump")
            moved = settle(stepped.join(jump, "_next", "left").select("cell", best.alias("label"), (F.col("label") != best).alias("changed")))
            labels = moved.select("cell", "label")
            if moved.filter("changed").isEmpty():
                return labels

    def _boxes(self, core: DataFrame, level: int) -> DataFrame:
        """Bounding box and outermost points of the core points per cell of side / 2^level."""
        scale = 2**level / self.side
        # Children are cut from the parent's own index, so that they nest exactly.
        bx = F.col("cx") * 2**level + F.least(F.lit(2**level - 1), F.greatest(F.lit(0), F.floor((F.col("x") - F.col("cx") * self.side) * scale)))
        by = F.col("cy") * 2**level + F.least(F.lit(2**level - 1), F.greatest(F.lit(0), F.floor((F.col("y") - F.col("cy") * self.side) * scale)))
        spot = F.struct("x", "y")
        return core.select("x", "y", bx.alias("bx"), by.alias("by")).groupBy("bx", "by").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.array(F.min_by(spot, "x"), F.max_by(spot, "x"), F.min_by(spot, "y"), F.max_by(spot, "y")).alias("rim"),
        )

    def _judge(self, pairs: DataFrame, boxes: DataFrame) -> DataFrame:
        """Pairs still of interest with ``linked``; pairs that are too far apart are dropped."""
        box = boxes.select(F.struct("bx", "by").alias("id"), F.struct("x0", "x1", "y0", "y1", "rim").alias("box"))
        sided = pairs.join(box.select(F.col("id").alias("a"), F.col("box").alias("p")), "a").join(
            box.select(F.col("id").alias("b"), F.col("box").alias("q")), "b"
        )
        gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"q.{low}") - F.col(f"p.{high}"), F.col(f"p.{low}") - F.col(f"q.{high}"))
        reach = lambda low, high: F.greatest(F.col(f"q.{high}") - F.col(f"p.{low}"), F.col(f"p.{high}") - F.col(f"q.{low}"))
        square = self.eps * self.eps
        nearest = F.pow(gap("x0", "x1"), 2) + F.pow(gap("y0", "y1"), 2)
        farthest = F.pow(reach("x0", "x1"), 2) + F.pow(reach("y0", "y1"), 2)
        rims = [
            F.pow(F.col("p.rim")[i]["x"] - F.col("q.rim")[j]["x"], 2) + F.pow(F.col("p.rim")[i]["y"] - F.col("q.rim")[j]["y"], 2) <= square
            for i in range(4)
            for j in range(4)
        ]
        linked = (farthest <= square) | reduce(or_, rims)
        return sided.filter(nearest <= square).select("root_a", "root_b", "a", "b", linked.alias("linked"))

    def summary(self, with_clusters: bool = True) -> DataFrame:
        total = self.df.agg(F.count(F.lit(1)).alias("total_count"))
        noise = self.noise_rows([]).agg(F.count(F.lit(1))).scalar()
        severity = F.least(F.try_divide(F.col("anomaly_count"), F.lit(max(self.rows, 1))), F.lit(1.0))
        counted = f"; clusters found: {self.cluster_count()}" if with_clusters and self.enough else ""
        row = total.select("total_count", noise.alias("anomaly_count")).withColumns(
            {
                "detector_name": F.lit("geographic_clustering"), "anomaly_type": F.lit("clustering_anomaly"),
                "column_name": F.lit(None).cast("string"), "severity_score": severity,
                "description": F.lit("Points that belong to no cluster" + counted),
            }
        )
        return with_rate(row)
