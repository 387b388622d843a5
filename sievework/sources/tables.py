"""Parquet tables: staging appends, batches, upserts, truncation and table facts.

A table is a folder of versions.  A new version becomes visible through its ``_SUCCESS`` mark only when it is whole,
so a job never reads what it overwrites and a lost job leaves the old version in place.

An upsert writes only the partitions it has rows for into the next version, whose manifest lists the partitions that
are carried over from earlier ones.  A table without partition columns in its key is cut into hash buckets of the key,
so that an upsert of few rows still rewrites few files.  ``expire`` removes what no kept version lists.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.ordering import dense_positions

ETL_COLUMNS = ("etl_batch_id", "etl_load_date", "etl_source_file", "etl_row_number")
BATCH_COLUMN = "etl_batch_id"
PART_COLUMN = "written_by"
MANIFEST = "_manifest.json"
BUCKET_COLUMN = "key_bucket"
KEY_BUCKETS = 16  # of a table whose key holds no partition column, unless it is made with another number
MAX_CARRIED = 8  # versions a manifest may carry partitions over from
ROW_KEY = "_row_key"  # hash of what a row is about; kept in staging to find repeats of other batches


class Tables:
    """Named tables below one base folder, grouped in schemas such as ``staging`` and ``core``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def path(self, name: str, schema: str = "core") -> str:
        return f"{self.base}/{schema}/{name}"

    def _files(self, folder: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return fs, []
        return fs, [status.getPath() for status in fs.listStatus(path)]

    def _mark(self, folder: str) -> None:
        fs, _ = self._files(folder)
        fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"), True).close()

    def _text(self, path: str) -> str | None:
        jvm = self.spark.sparkContext._jvm
        fs, _ = self._files(path.rsplit("/", 1)[0])
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _leaves(self, folder: str, depth: int, above: str = "") -> list[str]:
        """Partition folders ``depth`` levels below ``folder``, as paths relative to it."""
        names = [c.getName() for c in self._files(f"{folder}/{above}" if above else folder)[1]]
        found = [f"{above}/{n}" if above else n for n in names if "=" in n]
        return found if depth <= 1 else [leaf for f in found for leaf in self._leaves(folder, depth - 1, f)]

    def manifest(self, name: str, schema: str = "core", version: int | None = None) -> dict | None:
        """What a version made by an upsert is made of: ``schema, partition_by, buckets`` and ``leaves`` by version."""
        at = f"{self.path(name, schema)}/v{version}" if version else self.current(name, schema)
        text = self._text(f"{at}/{MANIFEST}")
        return json.loads(text) if text else None

    def versions(self, name: str, schema: str = "core") -> list[int]:
        fs, children = self._files(self.path(name, schema))
        jvm = self.spark.sparkContext._jvm
        found = []
        for child in children:
            label = child.getName()
            if label.startswith("v") and label[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
                found.append(int(label[1:]))
        return sorted(found)

    def exists(self, name: str, schema: str = "core") -> bool:
        return bool(self.versions(name, schema))

    def names(self, schema: str = "core") -> list[str]:
        _, children = self._files(f"{self.base}/{schema}")
        return sorted(c.getName() for c in children if self.exists(c.getName(), schema))

    def current(self, name: str, schema: str = "core") -> str:
        known = self.versions(name, schema)
        if not known:
            raise ValueError(f"Unknown table: {schema}.{name}")
        return f"{self.path(name, schema)}/v{known[-1]}"

    def read(self, name: str, schema: str = "core") -> DataFrame:
        known = self.manifest(name, schema)
        if known is None:
            return self.spark.read.parquet(self.current(name, schema))
        return self._listed(name, schema, known).drop(BUCKET_COLUMN)

    def _listed(self, name: str, schema: str, known: dict) -> DataFrame:
        """The partitions that a manifest lists, with the bucket column."""
        columns = T.StructType.fromJson(known["schema"])
        frames = []
        for version, leaves in known["leaves"].items():
            base = f"{self.path(name, schema)}/v{version}"
            if leaves:
                reader = self.spark.read.schema(columns).option("basePath", base)
                frames.append(reader.parquet(*[f"{base}/{leaf}" for leaf in leaves]).select(*columns.names))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], columns)

    def append(self, df: DataFrame, name: str, schema: str = "core", partition_by: tuple[str, ...] = (), part: str | None = None) -> None:
        """Add rows; under the name of a ``part`` repeating the step doesn't repeat them (see ``put``)."""
        if part is not None:
            return self.put(df, name, part, schema)
        known = self.versions(name, schema)
        if known and self.manifest(name, schema) is not None:
            raise ValueError(f"{schema}.{name} is kept by upserts; rows can't be appended to it")
        target = f"{self.path(name, schema)}/v{known[-1] if known else 1}"
        df.write.mode("append").partitionBy(*partition_by).parquet(target)

    def put(self, df: DataFrame, name: str, part: str, schema: str = "core") -> None:
        """Write one named part of a table, in place of what an earlier attempt wrote under that name.

        Tables of records (run log, findings, lineage) are made of such parts, so repeating a step never
        doubles its records.  The name shows as column ``written_by``.
        """
        if not re.fullmatch(r"[A-Za-z][\w.-]*", part):
            raise ValueError(f"not the name of a part: {part}")
        known = self.versions(name, schema)
        target = f"{self.path(name, schema)}/v{known[-1] if known else 1}"
        df.write.mode("overwrite").parquet(f"{target}/{PART_COLUMN}={part}")
        if not known:
            self._mark(target)

    def copied(self, df: DataFrame, path: str) -> DataFrame:
        """A copy of ``df`` in a folder for the time of a step (see ``forget``), in place of an earlier one."""
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, path: str) -> None:
        fs, _ = self._files(path)
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    def claim(self, name: str) -> bool:
        """True for the one caller that gets the name first."""
        fs, _ = self._files(self.base)
        try:
            fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/claims", name), False).close()
        except Py4JJavaError as problem:
            if "AlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        return True

    def replace(self, df: DataFrame, name: str, schema: str = "core", partition_by: tuple[str, ...] = ()) -> None:
        known = self.versions(name, schema)
        target = f"{self.path(name, schema)}/v{known[-1] + 1 if known else 1}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)

    def truncate(self, name: str, schema: str = "core") -> None:
        """The next version has the same columns and no rows."""
        self.replace(self.spark.createDataFrame([], self.read(name, schema).schema), name, schema)

    def stage(
        self,
        df: DataFrame,
        name: str,
        batch_id: int,
        source_file: str | None = None,
        order: tuple[str, ...] | None = None,
    ) -> None:
        """Append one batch to staging, replacing that batch if it was written before.

        Partitioned by batch, so reading one batch prunes to its folder and a retried batch
        overwrites itself.  Row numbers are dense and follow ``order``; without an order they are the
        scan order ids, which cost nothing.
        """
        file = F.lit(source_file) if source_file is not None else F.col("_metadata.file_path")
        if order:
            stamped = df.withColumn("etl_source_file", file)
            stamped = dense_positions(stamped, list(order)).withColumn("etl_row_number", F.col("position") + 1)
            stamped = stamped.drop("position")
        else:
            stamped = df.select("*", file.alias("etl_source_file"), F.monotonically_increasing_id().alias("etl_row_number"))
        stamped = stamped.withColumns(
            {BATCH_COLUMN: F.lit(batch_id).cast("bigint"), "etl_load_date": F.current_timestamp()}
        )
        known = self.versions(name, "staging")
        target = f"{self.path(name, 'staging')}/v{known[-1] if known else 1}"
        (
            stamped.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH_COLUMN)
            .parquet(target)
        )
        if not known:
            self._mark(target)  # dynamic overwrite leaves no mark of its own

    def batch(self, name: str, batch_id: int) -> DataFrame:
        return self.read(name, "staging").filter(F.col(BATCH_COLUMN) == batch_id)

    def upsert(
        self, source: DataFrame, name: str, keys: list[str], schema: str = "core", order: list[str] | None = None,
        partition_by: tuple[str, ...] = (), buckets: int = KEY_BUCKETS,
    ) -> None:
        """Update rows whose key exists, insert the others.

        Only partitions that the source has rows for are read and written, into the next version; the others are
        listed by its manifest.  Partitions are those of ``partition_by`` if the key holds these columns, else hash
        buckets of the key.  A table made in another way is written anew once.  The names of touched partitions are
        collected, not their rows.
        """
        parts = partition_by if partition_by and set(partition_by).issubset(keys) else (BUCKET_COLUMN,)
        known = self.manifest(name, schema) if self.exists(name, schema) else None
        count = known["buckets"] if known else buckets
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(count)).cast("int")
        placed = lambda df: df if parts != (BUCKET_COLUMN,) else df.withColumn(BUCKET_COLUMN, bucket)
        incoming = placed(source)
        if not self.exists(name, schema):
            self._next_version(newest_per_key(incoming, keys, order), name, schema, parts, count, {}, keys)
            return
        if known is None or known["partition_by"] != list(parts) or known["keys"] != list(keys):
            self._next_version(upsert(placed(self.read(name, schema)), incoming, keys, order), name, schema, parts, count, {}, keys)
            return
        carried = {int(v): list(leaves) for v, leaves in known["leaves"].items()}
        target = self._listed(name, schema, known)
        touched = incoming.select(*parts).distinct()
        values = touched.collect()
        oldest = min(carried) if len(carried) >= MAX_CARRIED else None
        if oldest is not None:  # its partitions move along, so that a manifest never lists many versions
            base = f"{self.path(name, schema)}/v{oldest}"
            moved = self.spark.read.schema(target.schema).option("basePath", base).parquet(*[f"{base}/{leaf}" for leaf in carried[oldest]]) if carried[oldest] else None
            if moved is not None:
                values = values + moved.select(*parts).distinct().collect()
        if not values:
            return
        # Constants prune the folders to be read; the join keeps exactly the touched ones.
        kinds = T.StructType([target.schema[c] for c in parts])
        for i, column in enumerate(parts):
            some = sorted({v[i] for v in values if v[i] is not None})
            test = F.col(column).isin(some)
            target = target.filter(test | F.col(column).isNull() if any(v[i] is None for v in values) else test)
        if len(parts) > 1:
            wanted = self.spark.createDataFrame(sorted(set(map(tuple, values)), key=repr), kinds)
            target = target.join(wanted, reduce(and_, [target[c].eqNullSafe(wanted[c]) for c in parts]), "left_semi")
        self._next_version(upsert(target, incoming, keys, order), name, schema, parts, count, carried, keys)

    def _next_version(self, df: DataFrame, name: str, schema: str, parts: tuple[str, ...], buckets: int, carried: dict[int, list[str]], keys: list[str] | None = None) -> None:
        """Write ``df`` as partitions of the next version, then its manifest, then the mark that makes it visible."""
        known = self.versions(name, schema)
        number = known[-1] + 1 if known else 1
        folder = f"{self.path(name, schema)}/v{number}"
        files = df.repartition(*parts) if parts == (BUCKET_COLUMN,) else df
        files.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(*parts).parquet(folder)
        own = self._leaves(folder, len(parts))
        leaves = {v: [leaf for leaf in held if leaf not in set(own)] for v, held in carried.items()}
        listed = {str(v): held for v, held in leaves.items() if held} | {str(number): own}
        order = [c for c in df.columns if c not in parts] + list(parts)
        fields = [T.StructField(c, df.schema[c].dataType, True) for c in order]
        text = json.dumps({"schema": T.StructType(fields).jsonValue(), "partition_by": list(parts), "keys": list(keys or []), "buckets": buckets, "leaves": listed})
        fs, _ = self._files(folder)
        stream = fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._mark(folder)

    def expire(self, name: str, schema: str = "core", keep: int = 2) -> None:
        """Remove versions before the last ``keep``, but for the partitions that kept ones list."""
        known = self.versions(name, schema)
        kept = known[-keep:]
        used: dict[int, set[str] | None] = {v: None for v in kept}  # None: as a whole
        for version in kept:
            for of, leaves in ((self.manifest(name, schema, version) or {}).get("leaves") or {}).items():
                if used.get(int(of), ()) is not None:
                    used.setdefault(int(of), set()).update(leaves)
        jvm = self.spark.sparkContext._jvm
        fs, children = self._files(self.path(name, schema))
        for child in children:
            label = child.getName()
            if not (label.startswith("v") and label[1:].isdigit()) or int(label[1:]) > known[-1]:
                continue
            held = used.get(int(label[1:]), set())
            if held is None:
                continue
            if not held:
                fs.delete(child, True)
                continue
            for file in ("_SUCCESS", MANIFEST):  # a part of a version can't be read by itself any more
                fs.delete(jvm.org.apache.hadoop.fs.Path(child, file), False)
            depth = next(iter(held)).count("/") + 1
            for leaf in self._leaves(child.toString(), depth):
                if leaf not in held:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(child, leaf), True)

    def info(self, name: str, schema: str = "core") -> DataFrame:
        return table_info(self.read(name, schema), f"{schema}.{name}")

    def row_counts(self) -> DataFrame:
        """Rows per table of all schemas; counts come from file footers."""
        parts = []
        for schema in ("staging", "core"):
            for name in self.names(schema):
                count = self.read(name, schema).agg(F.count(F.lit(1)).alias("row_count"))
                parts.append(count.select(F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "row_count"))
        if not parts:
            return self.spark.createDataFrame([], "table_schema string, table_name string, row_count bigint")
        return reduce(DataFrame.unionByName, parts)


def newest_per_key(source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per complete key, the last one by ``order`` (all columns by default).

    A key with a null is never in conflict with another: all such rows stay.
    """
    from sievework.operators.dedup import keep_last

    whole = complete(keys)
    kept = keep_last(source.filter(whole), keys, order or [c for c in source.columns if c not in keys] or keys)
    return kept.unionByName(source.filter(~whole))


def complete(keys: list[str]):
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` put in: update where the key exists, insert otherwise.

    A key that comes twice in the source counts once, with its last row.  ``created_*`` columns of an
    updated row keep the target's values.  With a small source no step moves the target: both joins
    against it are semi joins that adaptive execution can broadcast.
    """
    fresh = newest_per_key(source, keys, order)
    same = lambda left, right: reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    incoming = fresh.filter(complete(keys)).select(*keys)
    kept = target.join(incoming, same(target, incoming), "left_anti")
    created = [c for c in target.columns if c.startswith("created_") and c in fresh.columns]
    if created:
        prior = target.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_was_{c}") for c in created])
        match = reduce(lambda a, b: a & b, [prior[f"_k_{k}"].eqNullSafe(incoming[k]) for k in keys])
        prior = prior.join(incoming, match, "left_semi")
        match = reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(prior[f"_k_{k}"]) for k in keys])
        fresh = fresh.join(prior, match, "left").select(
            *[F.coalesce(f"_was_{c}", c).alias(c) if c in created else F.col(c) for c in fresh.columns]
        )
    return kept.unionByName(fresh, allowMissingColumns=True)


def query(spark: SparkSession, text: str, parameters: dict | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL over named frames; values are bound, never pasted into the text."""
    return spark.sql(text, args=parameters or {}, **views)


def table_info(df: DataFrame, name: str) -> DataFrame:
    columns = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"))
            for f in df.schema.fields
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.inline(columns),
    )


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch_rows: int = 10_000) -> None:
    """Bulk append to a database table from the executors, in batches."""
    df.write.option("batchsize", batch_rows).jdbc(url, table, mode="append", properties=properties)


def stable_key(*columns: str) -> Column:
    """Surrogate key that does not depend on load order: a 128-bit hash of the natural key.

    64 bits would collide within some billions of rows.
    """
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns])))
