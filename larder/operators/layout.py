"""Archive layout, byte ranges and member statistics as window and aggregate queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S

HEADER_BYTES = 16
MAX_GAP = 1 << 20


def offsets(members: DataFrame, container: list[str], order: list[str], length: str = "data_length", start: int = HEADER_BYTES, alias: str = "data_offset") -> DataFrame:
    """Absolute offset of each member: where the one before it ends. One sort per container, no global window."""
    w = Window.partitionBy(*container).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn(alias, F.lit(start).cast("long") + F.coalesce(F.sum(length).over(w), F.lit(0)))


def running_totals(members: DataFrame, container: list[str], order: list[str], length: str = "data_length") -> DataFrame:
    """Files and bytes of a container after each member."""
    w = Window.partitionBy(*container).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumns({"file_count": F.count(F.lit(1)).over(w), "data_bytes": F.sum(length).over(w)})


def last_wins(entries: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Of entries with one name the last added stays; by aggregation, so a hot name is combined before it is moved."""
    rest = [c for c in entries.columns if c not in key]
    return entries.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_last")).select(*key, "_last.*")


def grouped_ranges(entries: DataFrame, container: list[str], offset: str = "data_offset", length: str = "data_length", tie: str = "name", max_gap: int = MAX_GAP) -> DataFrame:
    """Number the merged ranges of each container: a new one begins where the gap to everything before exceeds ``max_gap``."""
    w = Window.partitionBy(*container).orderBy(offset, length, tie)
    before = F.max(F.col(offset) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(offset) - before > max_gap), 1).otherwise(0)
    return entries.withColumn("_new", new).withColumn("range_id", F.sum("_new").over(w)).drop("_new")


def merge_ranges(entries: DataFrame, container: list[str], offset: str = "data_offset", length: str = "data_length", tie: str = "name", max_gap: int = MAX_GAP) -> DataFrame:
    """The byte ranges to read: start, end, members and bytes wanted. Ends are the furthest of any member, so zero-length ties cannot cut a range."""
    own = grouped_ranges(entries, container, offset, length, tie, max_gap)
    return own.groupBy(*container, "range_id").agg(F.min(offset).alias("range_start"), F.max(F.col(offset) + F.col(length)).alias("range_end"), F.count(F.lit(1)).alias("members"), F.sum(length).alias("wanted_bytes"))


def slice_members(ranges: DataFrame, members: DataFrame, on: list[str], buffer: str = "buffer", start: str = "range_start") -> DataFrame:
    """Cut members out of the bytes of their ranges."""
    return members.join(ranges, on).withColumn("data", F.expr(f"substring({buffer}, cast(data_offset - {start} + 1 as int), cast(data_length as int))"))


def stats(entries: DataFrame, container: list[str], flags: str = "flags", length: str = "data_length", external_size: str | None = None) -> DataFrame:
    """Counts and bytes of internal and external members per archive."""
    ext = P.is_external(F.col(flags))
    return entries.groupBy(*container).agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(~ext).alias("internal_files"), F.count_if(ext).alias("external_files"),
        F.coalesce(F.sum(F.when(~ext, F.col(length))), F.lit(0)).alias("internal_size_bytes"), F.coalesce(F.sum(F.when(ext, F.col(external_size or length))), F.lit(0)).alias("external_size_bytes"),
    )


def derived(stats_: DataFrame) -> DataFrame:
    """Total size, and archive bytes per internal byte (0.0 without any)."""
    return stats_.withColumns({"total_size_bytes": F.col("internal_size_bytes") + F.col("external_size_bytes"), "compression_ratio": F.when(F.col("internal_size_bytes") == 0, F.lit(0.0)).otherwise(F.col("archive_size_bytes").cast("double") / F.col("internal_size_bytes"))})


def footer_errors(f: dict[str, Column], size: Column) -> Column:
    """The first fault of a footer, or null: magic, version, counts, order and overlap of the regions, index too small for its count."""
    ends = {r: f[f"{r}_start"] + f[f"{r}_length"] for r in ("data", "meta", "index")}
    return (
        F.when(size < 88, "file too small").when(f["magic"] != "DESFOOT1", "invalid footer magic").when(f["version"] != 1, "unsupported version")
        .when(F.least(*[f[k] for k in f if k not in ("magic", "version", "file_count")]) < 0, "negative field").when((f["file_count"] < 0) | (f["file_count"] > size / 38 + 1), "invalid file_count")
        .when(F.greatest(*[f[f"{r}_start"] for r in ("data", "meta", "index")]) > size - 72, "offset exceeds file size").when(f["data_start"] < HEADER_BYTES, "data overlaps header")
        .when(ends["data"] > f["meta_start"], "data overlaps meta").when(ends["meta"] > f["index_start"], "meta overlaps index").when(ends["index"] > size - 72, "index overlaps footer")
        .when(f["index_length"] < f["file_count"] * 38, "index too small for file_count")
    )


# The forms in which entries, statistics, footers and catalog rows are shown.


def entry_text(name: Column, offset: Column, length: Column, flags: Column) -> Column:
    labels = S.flag_labels(flags)
    return F.concat(F.lit("IndexEntry(name='"), name, F.lit("', data_offset="), offset.cast("string"), F.lit(", data_length="), length.cast("string"), F.when(labels == "", F.lit("")).otherwise(F.concat(F.lit(" ["), labels, F.lit("]"))), F.lit(")"))


def stats_text(total: Column, internal: Column, external: Column, size: Column, archive: Column) -> Column:
    return F.concat(F.lit("DesStats(files="), total.cast("string"), F.lit(" ["), internal.cast("string"), F.lit(" internal, "), external.cast("string"), F.lit(" external], size="), S.human_size(size), F.lit(", archive="), S.human_size(archive), F.lit(")"))


def external_text(name: Column, key: Column, size: Column) -> Column:
    return F.concat(F.lit("ExternalFileInfo(name='"), name, F.lit("', key='"), key, F.lit("', size="), S.human_size(size), F.lit(")"))


def footer_text(f: dict[str, Column]) -> Column:
    span = lambda r: F.concat(F.lit(f"{r}="), f[f"{r}_start"].cast("string"), F.lit(":"), (f[f"{r}_start"] + f[f"{r}_length"]).cast("string"))
    return F.concat(F.lit("DesFooter(version="), f["version"].cast("string"), F.lit(", files="), f["file_count"].cast("string"), F.lit(", "), F.concat_ws(", ", span("data"), span("meta"), span("index")), F.lit(")"))


def catalog_text(id_: Column, name: Column, status: Column) -> Column:
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("CatalogEntry(id="), none(id_), F.lit(", des_name="), none(name), F.lit(", des_status="), none(status), F.lit(")"))


def enriched_meta(size: Column, external: Column, key: Column) -> Column:
    """Stored member metadata: the size, and for external members that they are and where."""
    return F.to_json(F.struct(size.alias("size"), F.when(external, F.lit(True)).alias("is_external"), F.when(external, key).alias("external_key")))
