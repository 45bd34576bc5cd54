"""Collections, membership, settings, changes and edits of a library.

Tables are immutable; each operator returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import uniquified


def members(publications: DataFrame, bridge: DataFrame, collection: str, inside: bool = True) -> DataFrame:
    """Publications in a collection, or those outside."""
    own = bridge.where(F.col("collection_guid") == collection).select(F.col("publication_guid").alias("guid"))
    return publications.join(own, "guid", "left_semi" if inside else "left_anti")


def marked(records: DataFrame, library: DataFrame, key: str = "sha1") -> DataFrame:
    """Each record with ``imported``: whether the library has its key."""
    have = library.select(key).distinct().withColumn("imported", F.lit(True))
    return records.join(have, key, "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


def with_attachments(publications: DataFrame, attachments: DataFrame) -> DataFrame:
    """Publications with the list of their attachments' names and their number."""
    per = attachments.groupBy(F.col("publication").alias("guid")).agg(F.array_sort(F.collect_list("name")).alias("files"), F.count(F.lit(1)).alias("n_files"))
    return publications.join(per, "guid", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def whole_row(df: DataFrame) -> Column:
    """A text of all columns: an order of rows in which only equal ones tie."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def insert(table: DataFrame, new: DataFrame, unique: list[str], order: list | None = None) -> DataFrame:
    """The table and those new rows whose unique columns clash with no old row and no earlier new one.

    New rows that clash with old ones are gone first. Of the others, one stays if it is the first of its value in every unique
    column, in the given order, or else in that of whole rows; nulls clash with nothing."""
    fresh = new
    for c in unique:
        fresh = fresh.join(table.select(c).distinct(), c, "left_anti")
    fresh = fresh.select(*new.columns)
    order = order or [whole_row(new)]
    places = [f"_place_{k}" for k in range(len(unique))]
    first = F.lit(True)
    for c, place in zip(unique, places, strict=True):
        fresh = fresh.withColumn(place, F.when(F.col(c).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(c).orderBy(*order))))
        first = first & (F.col(place) == 1)
    return table.unionByName(fresh.where(first).drop(*places), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the table with the columns of their change; one change for a key."""
    c = changes.select(key, F.lit(True).alias("_hit"), *(F.col(x).alias(f"_new_{x}") for x in columns))
    out = table.join(c, key, "left")
    out = out.withColumns({x: F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)) for x in columns})
    return out.select(*table.columns)


def upsert(table: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """Replaces rows with equal keys and adds the others; the new table has one row of a key.

    Of new rows with one key the first in the given order stays, or else in that of whole rows; rows without a key are left out."""
    some = uniquified(new.where(F.col(key).isNotNull()), [key], order or [whole_row(new)])
    return table.join(some.select(key), key, "left_anti").select(*table.columns).unionByName(some)


def set_trash(publications: DataFrame, keys: DataFrame, trashed: bool) -> DataFrame:
    hit = keys.select("guid").distinct().withColumn("_hit", F.lit(True))
    out = publications.join(hit, "guid", "left").withColumn("trashed", F.when(F.col("_hit"), F.lit(trashed)).otherwise(F.col("trashed")))
    return out.select(*publications.columns)


def empty_trash(publications: DataFrame) -> DataFrame:
    return publications.where(~F.col("trashed"))


def mark_read(publications: DataFrame, reads: DataFrame) -> DataFrame:
    """Publications after some reads (guid, at): ``times_read`` grows by their number, ``last_read`` is the latest."""
    per = reads.groupBy("guid").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.max("at").alias("_at"))
    out = publications.join(per, "guid", "left")
    out = out.withColumns({"times_read": F.coalesce("times_read", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_read": F.greatest("last_read", "_at")})
    return out.select(*publications.columns)


def remove_members(bridge: DataFrame, collection: str, keys: DataFrame) -> DataFrame:
    """The bridge without the given publications of one collection."""
    gone = keys.select(F.col("guid").alias("publication_guid")).distinct().withColumn("collection_guid", F.lit(collection))
    return bridge.join(gone, ["collection_guid", "publication_guid"], "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str = "guid") -> DataFrame:
    """key and type (INSERT, DELETE, UPDATE) of what differs between two states; keys are unique in each."""
    columns = sorted(set(before.columns) & set(after.columns) - {key})
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256) if columns else F.lit("")
    a, b = before.select(key, content.alias("x")), after.select(key, content.alias("y"))
    kind = F.when(F.col("x").isNull(), "INSERT").when(F.col("y").isNull(), "DELETE").when(F.col("x") != F.col("y"), "UPDATE")
    return a.join(b, key, "full_outer").select(key, kind.alias("type")).where("type is not null")


def numbered(log: DataFrame, order: list, start: int = 1) -> DataFrame:
    """A change log with a counter that grows with the order and may have gaps; ranks are local to range partitions."""
    ordered = log.orderBy(*order)
    return ordered.withColumn("counter", F.monotonically_increasing_id() + F.lit(start))


def sort_orders(collections: DataFrame, order: list) -> DataFrame:
    """sort_order from 0 among the children of each parent."""
    k = F.row_number().over(Window.partitionBy("parent").orderBy(*order)) - 1
    return collections.withColumn("sort_order", k.cast("int"))


def setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(F.col("key") == key).select("value")


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one map."""
    return settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def templated(value: Column, names: dict[str, str]) -> Column:
    """A configuration value with ``__NAME__`` replaced, over and over until names in values are replaced, too."""
    for _ in names:
        for name, text in names.items():
            value = F.replace(value, F.lit(f"__{name}__"), F.lit(text))
    return value


def check_version(settings: dict[str, str], wanted: int, key: str = "db_version") -> None:
    from ..sources.records import DatabaseVersionError

    if int(settings.get(key, -1)) != wanted:
        raise DatabaseVersionError(f"{key} is {settings.get(key)}, not {wanted}")


#: Steps between versions: version to a function from the table to its next version.
MIGRATIONS: dict[int, object] = {}


def migrated(table: DataFrame, version: int, wanted: int, steps: dict | None = None) -> DataFrame:
    steps = MIGRATIONS if steps is None else steps
    while version < wanted:
        table, version = steps[version](table), version + 1
    return table
