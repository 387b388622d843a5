"""Merging and matching of facility masters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import similarity
from sievework.sources.tables import newest_per_key

# Least similarities as fractions, so that lengths and edit counts are computed in whole numbers.
NAME_FROM = (17, 20)
ADDRESS_FROM = (4, 5)
WITHIN_DEGREES = 0.01
CROWDED = 200


def merge_masters(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One master from two: all keys of both, values of the first where it has them.

    A master has one row per complete key; of repeated ones the last by all other columns stays.
    ``found_in`` tells where a key came from; rows without a complete key match nothing and stay.  A
    full outer join cannot split a frequent key and sends all rows without one to a single task, so
    matches and the rows left over on either side are found by joins that can.
    """
    columns = list(dict.fromkeys([*first.columns, *second.columns]))
    first, second = newest_per_key(first, keys), newest_per_key(second, keys)
    a, b = first.alias("a"), second.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    picked: list[Column] = []
    for name in columns:
        sides = [F.col(f"{side}.{name}") for side, df in (("a", first), ("b", second)) if name in df.columns]
        picked.append(F.coalesce(*sides).alias(name))
    both = a.join(b, same).select(*picked, F.lit("both").alias("found_in"))
    parts = [both, _without_match(first, second, keys, "first"), _without_match(second, first, keys, "second")]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select(*columns, "found_in")


def _without_match(df: DataFrame, other: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """Rows whose key the other side does not have, and rows without a complete key."""
    complete = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    known = other.filter(complete).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
    rest = df.filter(complete).join(known, same, "left_anti").unionByName(df.filter(~complete))
    return rest.withColumn("found_in", F.lit(origin))


def _edits(length: Column, least: tuple[int, int]) -> Column:
    """Most edits between a text of this length and any text that is similar enough."""
    share, whole = least
    return F.floor(length * (whole - share) / share).cast("int")


def _start(length: Column, index: Column, count: Column) -> Column:
    return F.floor(length * index / count).cast("int")


def _pieces(text: Column, least: tuple[int, int]) -> Column:
    """The text cut into k + 1 numbered pieces, k being the most edits a match can have.

    k edits cannot touch all pieces: one of them stands unchanged in any matching text.
    """
    length = F.length(text)
    count = _edits(length, least) + 1
    cut = lambda i: F.substring(text, _start(length, i, count) + 1, _start(length, i + 1, count) - _start(length, i, count))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(length.alias("length"), i.alias("piece_no"), cut(i).alias("piece")))


def _probes(text: Column, least: tuple[int, int]) -> Column:
    """Every numbered piece a matching text of any possible length can have.

    k edits move a piece by at most k places.
    """
    share, whole = least
    mine = F.length(text)
    lengths = F.sequence(F.ceil(mine * share / whole).cast("int"), F.floor(mine * whole / share).cast("int"))

    def of_length(length: Column) -> Column:
        edits = _edits(length, least)

        def of_piece(i: Column) -> Column:
            start, size = _start(length, i, edits + 1), _start(length, i + 1, edits + 1) - _start(length, i, edits + 1)
            places = F.filter(F.sequence(start - edits, start + edits), lambda at: (at >= 0) & (at + size <= mine))
            return F.transform(places, lambda at: F.struct(length.alias("length"), i.alias("piece_no"), F.substring(text, at + 1, size).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_piece))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def _keyed(df: DataFrame, groups: DataFrame, by: list[str], name: str, keys: Column) -> DataFrame:
    """Rows of crowded groups once per key, all other rows once without one."""
    none = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("piece_no"), F.lit("").alias("piece")))
    marked = df.join(groups.withColumn("_crowded", F.lit(True)), by, "left")
    return marked.withColumn(name, F.explode(F.when(F.col("_crowded"), keys).otherwise(none))).drop("_crowded")


def _crowded(df: DataFrame, by: list[str], more_than: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than).select(*by)


ABOUT = ("name", "address", "state", "latitude", "longitude")


def distinct_sites(df: DataFrame) -> DataFrame:
    """Rows equal in everything but the id as one site, named after the smallest id, with a count."""
    return df.groupBy(*ABOUT).agg(F.min("id").alias("site_id"), F.count(F.lit(1)).alias("copies"))


def site_members(df: DataFrame) -> DataFrame:
    """(id, site_id) of every row. The site side is unique, so a site with many copies can be split."""
    sites = distinct_sites(df).select("site_id", *[F.col(c).alias(f"_{c}") for c in ABOUT])
    same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(sites[f"_{c}"]) for c in ABOUT])
    return df.join(sites, same).select("id", "site_id")


def match_sites(
    left: DataFrame, right: DataFrame, tolerance: float = WITHIN_DEGREES, name_from: float = NAME_FROM[0] / NAME_FROM[1],
    address_from: float = ADDRESS_FROM[0] / ADDRESS_FROM[1], crowded: int = CROWDED,
) -> DataFrame:
    """Pairs of distinct sites (from id, name, address, state, latitude, longitude) that are the same place.

    Same state, coordinates within the tolerance, names at least 85 % and addresses at least 80 %
    alike.  Candidates share the state and a grid cell.  In a crowded cell (a default position, say)
    they also share an unchanged piece of the name, and where a piece is crowded too (``PLANT``) one of
    the address; every match has both, so nothing is lost and no group is compared with itself as a
    whole.  Equal rows of a side are one site with a number of copies (see :func:`site_members`): a site
    repeated in a third of all rows is one row here.
    """
    if name_from < NAME_FROM[0] / NAME_FROM[1] or address_from < ADDRESS_FROM[0] / ADDRESS_FROM[1]:
        raise ValueError(f"pieces are cut for similarities of at least {NAME_FROM} and {ADDRESS_FROM}")
    place = ["state", "_cy", "_cx"]
    site = F.struct("site_id", "copies", *ABOUT)
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    a = distinct_sites(left).select(site.alias("_a"), "state", cell("latitude").alias("_cy"), cell("longitude").alias("_cx"))
    b = distinct_sites(right).select(site.alias("_b"), "state", cell("latitude").alias("_y"), cell("longitude").alias("_x"), F.inline(near))
    b = b.select("_b", "state", (F.col("_y") + F.col("dy")).alias("_cy"), (F.col("_x") + F.col("dx")).alias("_cx"))
    cells = _crowded(a, place, crowded)
    a = _keyed(a, cells, place, "_name", _pieces(F.col("_a.name"), NAME_FROM))
    b = _keyed(b, cells, place, "_name", _probes(F.col("_b.name"), NAME_FROM))
    pieces = _crowded(a, [*place, "_name"], crowded)
    a = _keyed(a, pieces, [*place, "_name"], "_address", _pieces(F.col("_a.address"), ADDRESS_FROM))
    b = _keyed(b, pieces, [*place, "_name"], "_address", _probes(F.col("_b.address"), ADDRESS_FROM))
    close = lambda c: F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) <= tolerance
    pairs = (
        a.join(b, [*place, "_name", "_address"])
        .filter(close("latitude") & close("longitude"))
        .withColumns(
            {
                "name_similarity": similarity(F.col("_a.name"), F.col("_b.name")),
                "address_similarity": similarity(F.col("_a.address"), F.col("_b.address")),
            }
        )
        .filter((F.col("name_similarity") >= name_from) & (F.col("address_similarity") >= address_from))
        .select(
            F.col("_a.site_id").alias("left_id"), F.col("_b.site_id").alias("right_id"), F.col("_a.copies").alias("left_copies"),
            F.col("_b.copies").alias("right_copies"), "name_similarity", "address_similarity",
        )
    )
    return pairs.distinct()
