"""Staging to core: projection, key look-up, upsert, and the batch log around it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.parsing import to_identifier, to_number, yes_no
from sievework.functions.text import either_spelling
from sievework.operators.keys import consistency, resolve
from sievework.operators.matching import merge_masters
from sievework.operators.ordering import dealt_out
from sievework.plans.transform import transform
from sievework.sources import runlog
from sievework.sources.catalog import CORE_LOAD_ORDER, CORE_TABLES, ICIS_TO_FACILITIES, CoreTable, Source, core_table
from sievework.sources.lineage import lineage
from sievework.sources.tables import BATCH_COLUMN, ROW_KEY, Tables, complete, newest_per_key, stable_key

LOADED_BY = "etl_system"
MASTER_KEYS = {"echo_facilities": "registry_id", "icis_facilities": "facility_uin"}


def to_core(df: DataFrame, target: str, as_of: datetime) -> DataFrame:
    """Project a staging frame to the columns of a core table.

    Mapped columns the frame lacks are left out, ``yearqtr`` is split, ``is_*``/``has_*`` become
    booleans, audit columns are added.  Column names match with or without underscores.
    """
    table = core_table(target)
    out = []
    for staged, wanted in table.mapping.items():
        found = either_spelling(df.columns, staged)
        if found is None and (staged, target) == ("npdes_id", "permits"):
            found = either_spelling(df.columns, "external_permit_nmbr")
        if found is None:
            continue
        value = F.col(found)
        if isinstance(wanted, tuple):
            text = value.cast("string")
            year, quarter = wanted
            out.append(to_number(F.substring(text, 1, 4)).try_cast("int").alias(year))
            out.append(to_number(F.substring(text, 5, 10)).try_cast("int").alias(quarter))
        elif wanted.startswith(("is_", "has_")):
            out.append(yes_no(value).alias(wanted))
        else:
            out.append(value.alias(wanted))
    stamp = F.lit(as_of)
    audit = {"created_date": stamp, "updated_date": stamp, "created_by": F.lit(LOADED_BY), "updated_by": F.lit(LOADED_BY)}
    return df.select(*out, *[c.alias(n) for n, c in audit.items()])


def with_keys(df: DataFrame, table: CoreTable, tables: Tables) -> DataFrame:
    """Surrogate key from the natural key, foreign keys from the tables loaded before."""
    for column, (parent, key) in table.foreign.items():
        if key in df.columns and tables.exists(parent):
            parents = tables.read(parent)
            if key in parents.columns and column in parents.columns:
                df = resolve(df, parents, key, column, order=[column])
                continue
        df = df.withColumn(column, F.lit(None).cast("string"))
    natural = [c for c in table.unique if c in df.columns]
    return df.withColumn(table.primary_key, stable_key(*(natural or df.columns)))


def load_core(tables: Tables, target: str, batch_id: int, as_of: datetime) -> DataFrame:
    """Upsert one staged batch into its core table; returns the lineage of the load."""
    table = core_table(target)
    staged = tables.batch(table.staging_table, batch_id)
    loaded = with_keys(to_core(staged, target, as_of), table, tables)
    keys = [c for c in table.unique if c in loaded.columns]
    if table.open_key:  # nulls never meet in an upsert; the surrogate key tells them apart and repeats itself
        loaded = loaded.filter(complete([k for k in keys if k not in table.open_key]))
        keys = [table.primary_key, *[c for c in table.partition_by if c in keys]]
    tables.upsert(loaded, target, keys or [table.primary_key], partition_by=tuple(c for c in table.partition_by if c in loaded.columns))
    return lineage(tables.spark, table, staged, tables.read(target), batch_id, as_of)


def icis_masters(staged: DataFrame, as_of: datetime) -> DataFrame:
    """ICIS facilities as rows of the facility master, one per registry id (their UIN), of the newest batch.

    A site that holds a discharge permit number has water permits.  Sites without UIN link with nothing; they stay in
    staging.
    """
    rows = staged.withColumn("registry_id", to_identifier(F.col("facility_uin").cast("decimal(38,6)")))
    rows = rows.filter(F.col("registry_id").isNotNull())
    stamp = F.lit(as_of)
    audit = {"created_date": stamp, "updated_date": stamp, "created_by": F.lit(LOADED_BY), "updated_by": F.lit(LOADED_BY)}
    rows = rows.select(
        "registry_id", *[F.col(c).alias(n) for c, n in ICIS_TO_FACILITIES.items() if c in rows.columns],
        F.col("npdes_id").isNotNull().alias("has_water_permits"), *[c.alias(n) for n, c in audit.items()], F.col(BATCH_COLUMN).alias("_batch"),
    )
    order = ["_batch", *[c for c in rows.columns if c not in ("registry_id", "_batch", *audit)]]
    return newest_per_key(rows, ["registry_id"], order).drop("_batch")


def merge_facilities(tables: Tables, staged: DataFrame, key: str, as_of: datetime) -> None:
    """Bring ECHO and ICIS together in the facility master for the sites of one staged batch.

    The master keeps the values that ECHO gave and takes from ICIS what ECHO leaves open; sites only ICIS knows
    become rows of their own.  A site has water permits if either says so.  Only rows of the batch's sites are
    merged and upserted, so the result doesn't depend on which source came first.
    """
    if not tables.exists("icis_facilities", "staging"):
        return
    sites = staged.select(to_identifier(F.col(key).cast("decimal(38,6)")).alias("registry_id")).filter("registry_id IS NOT NULL").distinct()
    icis = icis_masters(tables.read("icis_facilities", "staging"), as_of).join(sites, "registry_id", "left_semi")
    if tables.exists("facilities"):
        known = tables.read("facilities").join(sites, "registry_id", "left_semi")
        water = icis.filter("has_water_permits").select("registry_id", F.lit(True).alias("_water"))
        merged = merge_masters(known, icis, ["registry_id"]).filter("found_in <> 'first'").drop("found_in")
        merged = merged.join(water, "registry_id", "left")
        merged = merged.withColumn("has_water_permits", F.coalesce("_water", "has_water_permits")).drop("_water")
        merged = merged.withColumn("updated_date", F.lit(as_of))
    else:
        merged = icis
    tables.upsert(merged.withColumn("facility_id", stable_key("registry_id")), "facilities", ["registry_id"])


def targets_of(source: Source) -> list[str]:
    return [t for t in CORE_LOAD_ORDER if CORE_TABLES[t].staging_table == source.staging_table]


def load_source(
    spark: SparkSession, tables: Tables, raw: DataFrame, source: Source, batch_id: int | None, as_of: datetime, key: str | None = None
) -> bool:
    """Transform, stage and load one source under a batch in the run log.

    The batch is the given number, or the one the run log has or allots for ``key`` (by default a new
    one).  Everything is written by batch, so running it again doubles nothing.  A failing step closes the
    batch as FAILED and is raised again.
    """
    process = f"load_{source.name}"
    if batch_id is None:
        batch_id = runlog.batch_of(tables, process, key or uuid.uuid4().hex, as_of, source.title)
    else:
        runlog.numbered(tables, batch_id, process, as_of, source.title)
    try:
        tables.stage(transform(dealt_out(raw), source, as_of, key_as=ROW_KEY), source.staging_table, batch_id, source_file=source.title)
        staged = tables.batch(source.staging_table, batch_id).count()
        for target in targets_of(source):
            tables.put(load_core(tables, target, batch_id, as_of), "data_lineage", f"batch-{batch_id}-{target}")
        if source.name in MASTER_KEYS:
            merge_facilities(tables, tables.batch(source.staging_table, batch_id), MASTER_KEYS[source.name], as_of)
    except Exception as problem:
        runlog.log_event(tables, batch_id, runlog.close_batch(spark, batch_id, "FAILED", as_of, error=str(problem)), "end")
        raise
    runlog.log_event(tables, batch_id, runlog.close_batch(spark, batch_id, "SUCCESS", as_of, processed=staged, inserted=staged), "end")
    return True


def cross_references(tables: Tables) -> dict[str, DataFrame]:
    """Consistency of emissions with facilities and of measurements with permits."""
    return {
        "registry_id": consistency(tables.read("air_emissions"), tables.read("facilities"), "registry_id", "registry_id"),
        "npdes_id": consistency(tables.read("water_measurements"), tables.read("permits"), "npdes_id", "npdes_id"),
    }
