"""Import of snapshot archives into a versioned store of Parquet tables.

Every import writes its tables to a folder of its own, checks them, and only then makes them current by creating the next
version file, which only one of several writers can do; the others start again from what is current by then. Readers
that started before go on with the old version; a failed import leaves it in place. Snippets are mined again only for
apps whose reports are not those of the version before.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import schemas
from ..functions.runtime import report_runtime
from ..operators import mining, tables
from ..operators.ranking import with_hardware
from ..operators.versions import Versions
from ..sources import archive
from ..sources.listing import snapshot_date
from ..sources.records import flatten, normalize

_EMPTY = {
    "sources": schemas.SOURCES,
    "import_runs": schemas.IMPORT_RUNS,
    "games": schemas.GAMES,
}


class SnapshotError(ValueError):
    """An import that cannot be carried out; the store is as it was."""


@dataclass(frozen=True)
class SourceSpec:
    """Where snapshots come from: kind and id prefix of their sources, base address and licence note."""

    kind: str
    id_prefix: str
    base_url: str
    license_note: str


@dataclass(frozen=True)
class SnapshotMeta:
    filename: str
    date: dt.date | None = None
    url: str = ""
    license: str = ""
    source_id: str = ""


def complete_meta(spark: SparkSession, meta: SnapshotMeta, spec: SourceSpec) -> SnapshotMeta:
    """Meta data with defaults filled in; a missing name or date is an error."""
    name = meta.filename.strip()
    if not name:
        raise SnapshotError("import snapshot: snapshot filename is required")
    date = meta.date
    if date is None:
        date = spark.range(1).select(snapshot_date(F.lit(name)).alias("d")).first()["d"]
    if date is None:
        raise SnapshotError("import snapshot: snapshot date is required when filename date cannot be parsed")
    return replace(
        meta,
        filename=name,
        date=date,
        url=meta.url.strip() or f"{spec.base_url}/{name}",
        license=meta.license.strip() or spec.license_note,
        source_id=meta.source_id.strip() or spec.id_prefix + name,
    )


#: How often an import starts anew because others were faster.
ATTEMPTS = 5


class Store:
    """Tables of the current version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)

    def version(self) -> int:
        """Number of the current version, 0 when there is none."""
        return self.versions.latest()[0]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the current version, or of an older one that has not expired."""
        folder = (self.versions.read(version) if version else self.versions.latest()[1]).get("folder")
        if folder and self.versions.exists(folder, name):
            return self.spark.read.parquet(f"{self.root}/{folder}/{name}")
        if name in _EMPTY:
            return self.spark.createDataFrame([], _EMPTY[name])
        raise SnapshotError(f"the store holds no {name}")

    def has(self, name: str) -> bool:
        folder = self.versions.latest()[1].get("folder")
        return bool(folder) and self.versions.exists(folder, name)

    def expire(self, keep: int = 2) -> None:
        """Delete all versions but the latest ones; readers of deleted ones fail."""
        for number in self.versions.numbers()[:-keep]:
            folder = self.versions.read(number)["folder"]
            self.versions.delete("versions", f"{number}.json")
            self.versions.delete(folder)


def stored_reports(normalized: DataFrame, run_id: str) -> DataFrame:
    """Valid reports as they are stored: with runtime and comparison categories made once."""
    parsed = normalized.where("valid").withColumn("_document", F.try_parse_json("raw_json"))
    reports = parsed.withColumns(
        {
            "run_id": F.lit(run_id),
            "runtime": report_runtime(F.col("_document"), F.col("proton_version")),
            "session_type": F.lit(""),
        }
    )
    return with_hardware(reports).drop("_document", "valid", "archive", "session_type")


def normalized_records(store: Store, archive_path: str, meta: SnapshotMeta, folder: str) -> tuple[DataFrame, dict[str, int]]:
    """Records of an archive in their normal form, written to a folder, and their counts from that very write."""
    spark = store.spark
    # An archive is read by one task: its items are written first, and spread over all tasks from there.
    items_path, path = f"{store.root}/{folder}/items", f"{store.root}/{folder}/normalized"
    archive.read_archives(spark, archive_path).repartition(spark.sparkContext.defaultParallelism).write.parquet(items_path)
    records = normalize(flatten(spark.read.parquet(items_path)), F.lit(meta.source_id)).drop("value")
    counts, valid = Observation("import"), F.col("valid")
    records.observe(
        counts,
        F.count_if(valid).alias("report_count"),
        F.count_if(valid & F.col("has_system_info")).alias("system_infos"),
        F.count_if(~valid).alias("skipped_count"),
    ).write.parquet(path)
    return spark.read.parquet(path), dict(counts.get)


def _write_version(
    store: Store, normalized: DataFrame, counts: dict[str, int], meta: SnapshotMeta, spec: SourceSpec, now: dt.datetime,
    run_id: str, folder: str,
) -> dict[str, int]:
    """All tables of a new version beside those of the current one; gives its numbers of games and of mined apps."""
    spark, path = store.spark, f"{store.root}/{folder}"
    run = (run_id, meta.source_id, meta.filename, meta.date, meta.url, meta.license, now, now)
    new_runs = spark.createDataFrame([(*run, counts["report_count"], counts["skipped_count"])], schemas.IMPORT_RUNS)
    new_sources = spark.createDataFrame([(meta.source_id, spec.kind, meta.url, meta.license, now)], schemas.SOURCES)
    sources = tables.upsert_sources(store.table("sources"), new_sources)
    kept = tables.kept_runs(store.table("import_runs"), sources, spec.kind, spec.id_prefix)
    sources.write.parquet(f"{path}/sources")
    kept.unionByName(new_runs).write.parquet(f"{path}/import_runs")

    reports = stored_reports(normalized, run_id)
    if store.has("reports"):
        # whatever other kinds of source brought stays
        reports = reports.unionByName(tables.of_kept_runs(store.table("reports"), kept))
    # ranges of app and time: a popular app spreads over many files, and row groups can be skipped
    order = [F.col("appid").asc(), F.col("ts").desc(), F.col("source_report_id").asc()]
    reports.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/reports")
    written = spark.read.parquet(f"{path}/reports")

    mining.app_digests(written).write.parquet(f"{path}/app_digests")
    digests = spark.read.parquet(f"{path}/app_digests")
    changed, same = digests.select("appid"), None
    if store.has("app_digests"):
        changed = mining.changed_apps(digests, store.table("app_digests"))
        same = digests.join(store.table("app_digests"), digests.columns, "left_semi").select("appid")
    changed.write.parquet(f"{path}/mined_apps")
    changed = spark.read.parquet(f"{path}/mined_apps")
    candidates = mining.mine(written.join(changed, "appid", "left_semi"))
    found = {"snippet_tally": mining.tally(candidates), "suggestion_sources": mining.suggestion_sources(candidates)}
    for name, rows in found.items():
        if same is not None:
            rows = rows.unionByName(store.table(name).join(same, "appid", "left_semi"))
        rows.repartitionByRange("appid").write.parquet(f"{path}/{name}")
    tally = spark.read.parquet(f"{path}/snippet_tally")
    suggestions = mining.suggestion_table(mining.aged(tally, F.lit(now)))
    suggestions.write.parquet(f"{path}/launch_option_suggestions")

    new_games = tables.games_of(written.where(F.col("run_id") == run_id))
    number = Observation("games")
    games = tables.upsert_games(store.table("games"), new_games.observe(number, F.count(F.lit(1)).alias("games")))
    games = tables.without_orphans(games, written, spark.read.parquet(f"{path}/launch_option_suggestions"))
    games.write.parquet(f"{path}/games")
    return {"games": number.get["games"], "apps": changed.count()}


def import_snapshot(
    store: Store, archive_path: str, meta: SnapshotMeta, spec: SourceSpec, now: dt.datetime
) -> dict[str, object]:
    """Replace all snapshots of one kind of source by a new one; gives the import's counters."""
    meta = complete_meta(store.spark, meta, spec)
    work = f"work-{uuid.uuid4().hex}"
    try:
        normalized, counts = normalized_records(store, archive_path, meta, work)
        if not counts["report_count"] and not counts["skipped_count"]:
            raise SnapshotError("import snapshot: no report records found")
        if not counts["report_count"]:
            raise SnapshotError(f"import snapshot: no valid reports imported; skipped {counts['skipped_count']} records")
        for _ in range(ATTEMPTS):
            version = store.version() + 1
            run_id, folder = f"{meta.source_id}@{version}", f"data-{uuid.uuid4().hex}"
            made = None
            try:
                made = _write_version(store, normalized, counts, meta, spec, now, run_id, folder)
                won = store.versions.publish(version, {"folder": folder, "published_at": now.isoformat()})
            except BaseException:
                store.versions.delete(folder)
                raise
            if not won:
                store.versions.delete(folder)
                continue
            return {
                "version": version,
                "run_id": run_id,
                "source_id": meta.source_id,
                "snapshot_filename": meta.filename,
                "reports_imported": counts["report_count"],
                "games_imported": made["games"],
                "system_infos_imported": counts["system_infos"],
                "records_skipped": counts["skipped_count"],
                "apps_mined": made["apps"],
            }
        raise SnapshotError(f"import snapshot: other imports were faster {ATTEMPTS} times")
    finally:
        store.versions.delete(work)
