"""Views over the given tables that stand in for stored reports.

The same SQL text runs in Spark and, as common table expressions, in the checking database; the
few functions which differ are written in capitals and filled in per engine. Every view covers its
whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hardware import parse_ram_gb
from ..operators.ranking import with_hardware

NOW_TEXT = "2001-08-02 00:00:00"

_SPARK = {
    "EPOCH": r"unix_timestamp(\1)",
    "ISO_SECONDS": r"date_format(\1, 'yyyy-MM-dd''T''HH:mm:ss''Z''')",
    "ISO_DAY": r"date_format(\1, 'yyyy-MM-dd')",
    "DAY_SECONDS": r"make_dt_interval(0, 0, 0, CAST(\1 AS DECIMAL(18, 6)))",
}
_DUCK = {
    "EPOCH": r"CAST(epoch(\1) AS BIGINT)",
    "ISO_SECONDS": r"strftime(\1, '%Y-%m-%dT%H:%M:%SZ')",
    "ISO_DAY": r"strftime(\1, '%Y-%m-%d')",
    "DAY_SECONDS": r"to_seconds(\1)",
}


def _fill(sql: str, dialect: dict[str, str]) -> str:
    for name, text in dialect.items():
        sql = re.sub(rf"\b{name}\(([^()]*)\)", text, sql)
    return sql


# Reports: one per order. App 1 holds a quarter of all, 25 apps are dense, 75 middling, the rest thin.
_REPORT_COLUMNS = """
SELECT o_orderkey AS k,
  CAST(CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 + o_custkey % 25 WHEN 2 THEN 100 + o_custkey % 75
    ELSE 1000 + o_custkey END AS INT) AS appid,
  CAST(o_orderdate + DAY_SECONDS(o_orderkey % 86400) AS TIMESTAMP) AS ts,
  CASE WHEN o_orderstatus = 'F' THEN 'no' ELSE 'yes' END AS verdict,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'platinum' WHEN '2' THEN 'gold' WHEN '3' THEN 'silver'
    WHEN '4' THEN 'bronze' ELSE 'borked' END AS rating,
  CASE o_orderkey % 12 WHEN 0 THEN 'PROTON_LOG=1 %command%' WHEN 1 THEN 'gamemoderun  %command%'
    WHEN 2 THEN 'mangohud gamemoderun %command%' WHEN 3 THEN 'DXVK_ASYNC=1 %command% -nostartupmovies'
    WHEN 4 THEN 'PROTON_ENABLE_NVAPI=1 gamescope -f -- %command%' WHEN 5 THEN '%command%'
    WHEN 6 THEN 'sudo rm -rf / && %command%' WHEN 7 THEN '%command% -novid'
    WHEN 8 THEN 'PROTON_NO_' || CAST(o_orderkey % 31 AS STRING) || '=1 %command%'
    WHEN 9 THEN '-windowed -h ' || CAST(o_orderkey % 17 AS STRING) ELSE '' END AS launch_options,
  CASE o_orderkey % 9 WHEN 0 THEN 'Black  screen on start' || chr(10) || 'set RADV_PERFTEST=gpl and it works'
    WHEN 1 THEN 'use Proton Experimental' WHEN 2 THEN 'No tweaks required'
    WHEN 3 THEN 'crashes after intro, skip the intro videos'
    WHEN 4 THEN 'Try VKD3D_CONFIG=dxr' || chr(10) || 'prime-run %command%'
    WHEN 5 THEN 'works out of the box' WHEN 6 THEN 'verdict: yes %command%' ELSE '' END AS notes,
  CASE o_orderkey % 7 WHEN 0 THEN 'Proton Experimental' WHEN 1 THEN 'GE' WHEN 2 THEN 'native' WHEN 3 THEN 'default'
    WHEN 4 THEN '' WHEN 5 THEN 'proton ge' ELSE 'custom build x' END AS proton_version,
  CASE o_orderkey % 4 WHEN 0 THEN 'NVIDIA Corporation GA104 [GeForce RTX 3070] (rev a1)' WHEN 1 THEN 'AMD Radeon RX 6800'
    WHEN 2 THEN 'Intel Arc A770' ELSE '' END AS gpu_model,
  CASE o_orderkey % 5 WHEN 0 THEN 'AMD Ryzen 7 5800X' WHEN 1 THEN 'Intel(R) Core(TM) i7-9700K'
    WHEN 2 THEN 'AMD Ryzen 5 3600' WHEN 3 THEN 'Intel Xeon' ELSE '' END AS cpu,
  CASE o_orderkey % 6 WHEN 0 THEN '32 GB' WHEN 1 THEN '16 GB' WHEN 2 THEN '8192 MB' WHEN 3 THEN '7.7 GB'
    WHEN 4 THEN 'lots' ELSE '' END AS ram,
  CASE o_orderkey % 5 WHEN 0 THEN 'Arch Linux' WHEN 1 THEN 'Fedora 40' WHEN 2 THEN 'Pop!_OS 22.04'
    WHEN 3 THEN 'Debian 12' ELSE '' END AS distro,
  CASE o_orderkey % 3 WHEN 0 THEN '6.8.0-arch1-1' WHEN 1 THEN '5.15.0' ELSE '' END AS kernel,
  CASE o_orderkey % 3 WHEN 0 THEN 'KDE (Wayland)' WHEN 1 THEN 'GNOME X11' ELSE '' END AS desktop,
  CASE o_orderkey % 11 WHEN 0 THEN '550.54.14' WHEN 1 THEN 'Mesa 24.1.2' ELSE '' END AS gpu_driver,
  CASE o_orderkey % 10 WHEN 1 THEN 'Proton Experimental' WHEN 7 THEN ' ge ' ELSE '' END AS variant,
  o_orderkey % 6 AS shape
FROM orders
"""

# The raw JSON of a report in six shapes; of shape 5 half cannot be read and half lacks an app id.
_REPORTS = f"""
SELECT *, 'r' || CAST(k AS STRING) AS source_report_id, 'board:' || CAST(k % 3 AS STRING) AS source_id,
  'Game ' || CAST(appid AS STRING) AS title,
  CASE shape
  WHEN 0 THEN '{{"appId":' || CAST(appid AS STRING) || ',"title":"Game ' || CAST(appid AS STRING)
    || '","timestamp":' || CAST(EPOCH(ts) AS STRING) || ',"verdict":"' || verdict || '","rating":" ' || rating
    || '","launchOptions":"' || launch_options || '","protonVersion":"' || proton_version || '","notes":"'
    || replace(notes, chr(10), chr(92) || 'n') || '","systemInfo":{{"gpu":"' || gpu_model || '","cpu":"' || cpu
    || '","ram":"' || ram || '","os":"' || distro || '","kernel":"' || kernel || '","desktop":"' || desktop
    || '","driver":"' || gpu_driver || '"}}}}'
  WHEN 1 THEN '{{"app":{{"steam":{{"appId":"' || CAST(appid AS STRING) || '"}},"title":"Game ' || CAST(appid AS STRING)
    || '"}},"timestamp":" ' || CAST(EPOCH(ts) AS STRING) || '","responses":{{"verdict":"' || verdict || '","launch_options":"'
    || launch_options || '","proton_version":"' || proton_version || '","notes":{{"variant":"' || variant
    || '"}},"extra":"' || replace(notes, chr(10), chr(92) || 'n') || '"}}}}'
  WHEN 2 THEN '{{"APPID":' || CAST(appid AS STRING) || '.0,"Game_Name":"Game ' || CAST(appid AS STRING)
    || '","CreatedAt":"' || ISO_SECONDS(ts) || '","Summary":"' || verdict || '","Tier":"' || rating
    || '","LaunchOption":"' || launch_options || '","Proton":"' || proton_version || '","Body":["'
    || replace(notes, chr(10), chr(92) || 'n') || '","yes",{{"fix":"' || rating || '"}}]}}'
  WHEN 3 THEN '{{"app":{{"appid":' || CAST(appid AS STRING) || ',"name":"Game ' || CAST(appid AS STRING)
    || '"}},"date":"' || ISO_DAY(ts) || '","specs":{{"gpu":{{"vendor":"' || substr(gpu_model, 1, 3) || '","name":"'
    || gpu_model || '","driver":"' || gpu_driver || '"}},"ramGb":16.5,"processor":"' || cpu || '","distribution":"' || distro
    || '"}},"audioFaults":"' || verdict || '","saveGameFaults":"' || rating || '"}}'
  WHEN 4 THEN '{{"responses":{{"answerToWhatGame":"' || CAST(appid AS STRING) || '","tier":" ' || rating
    || '","verdict":"' || verdict || '","protonVersion":"native"}},"time":' || CAST(EPOCH(ts) AS STRING)
    || '.25,"gpu":"' || gpu_model || '","kernel":"' || kernel || '"}}'
  ELSE CASE WHEN k % 12 = 5 THEN 'no json' ELSE '{{"appid":"none","title":"x","time":"' || ISO_SECONDS(ts) || '"}}' END
  END AS raw_json
FROM report_columns
"""

_PROFILES = """
SELECT CAST(s_suppkey AS BIGINT) AS profile_id,
  CASE s_suppkey % 5 WHEN 0 THEN 'NVIDIA' WHEN 1 THEN 'AMD' ELSE '' END AS gpu_vendor,
  CASE s_suppkey % 5 WHEN 0 THEN 'GeForce RTX 3070 Ti' WHEN 1 THEN 'Radeon RX 6800' WHEN 2 THEN 'Intel Arc A770' ELSE '' END AS gpu_model,
  CASE s_suppkey % 3 WHEN 0 THEN '550.100' WHEN 1 THEN '24.1' ELSE '' END AS gpu_driver,
  CASE s_suppkey % 5 WHEN 0 THEN 'AMD Ryzen 7 7800X3D' WHEN 1 THEN 'Intel Core i7-9700K' WHEN 2 THEN 'AMD Ryzen 5 3600' ELSE '' END AS cpu,
  CAST(CASE s_suppkey % 5 WHEN 0 THEN 32 WHEN 1 THEN 15.5 WHEN 2 THEN 7.5 ELSE 0 END AS DOUBLE) AS ram_gb,
  CASE s_suppkey % 5 WHEN 0 THEN 'Manjaro' WHEN 1 THEN 'Nobara 39' WHEN 2 THEN 'Linux Mint' ELSE '' END AS distro,
  CASE s_suppkey % 5 WHEN 0 THEN '6.8.9' WHEN 1 THEN '5.15.1' WHEN 2 THEN 'custom' ELSE '' END AS kernel,
  CASE s_suppkey % 5 WHEN 0 THEN 'wayland' WHEN 1 THEN '' ELSE 'tty' END AS session_type,
  CASE s_suppkey % 5 WHEN 1 THEN 'Xorg' ELSE '' END AS desktop
FROM supplier
"""

# One request per machine; every seventh asks for an app nobody reported.
_REQUESTS = """
SELECT CAST(s_suppkey AS BIGINT) AS profile_id,
  CAST(CASE WHEN s_suppkey % 7 = 6 THEN 900000 + s_suppkey WHEN s_suppkey % 4 = 0 THEN 1
    WHEN s_suppkey % 4 = 1 THEN 2 + s_suppkey % 25 WHEN s_suppkey % 4 = 2 THEN 100 + s_suppkey % 75
    ELSE 1000 + s_suppkey END AS INT) AS appid
FROM supplier
"""

_GAMES = """
SELECT CAST(1000 + c_custkey AS INT) AS appid, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 60 = 0 THEN '' ELSE 'steam' END AS launcher
FROM customer
"""

_CATALOGUE = """
SELECT event_id,
  CASE WHEN event_id % 5 = 4 THEN CASE event_id % 3 WHEN 0 THEN 'reports_feb30_2024.tar.gz' WHEN 1 THEN 'reports_jan1_2024.zip'
    ELSE 'readme.md' END
  ELSE 'Reports_' || CASE event_id % 12 WHEN 0 THEN 'jan' WHEN 1 THEN 'Feb' WHEN 2 THEN 'mar' WHEN 3 THEN 'apr' WHEN 4 THEN 'MAY'
    WHEN 5 THEN 'jun' WHEN 6 THEN 'jul' WHEN 7 THEN 'aug' WHEN 8 THEN 'sep' WHEN 9 THEN 'oct' WHEN 10 THEN 'nov' ELSE 'dec' END
    || CAST(1 + event_id % 31 AS STRING) || '_' || CAST(2000 + event_id % 25 AS STRING) || '.tar.gz' END AS name,
  CASE event_type WHEN 'click' THEN 'file' WHEN 'view' THEN '' WHEN 'error' THEN 'dir' ELSE 'file' END AS type,
  CASE WHEN event_id % 2 = 0 THEN 'https://example.org/d/' || CAST(event_id AS STRING) ELSE '' END AS download_url,
  CAST(event_id * 10 AS BIGINT) AS size
FROM events
"""

# Runs: one per order; a source per customer, some of the kind that is replaced, some with its prefix.
_RUNS = """
SELECT 'run' || CAST(o_orderkey AS STRING) AS id,
  CASE o_custkey % 3 WHEN 0 THEN 'snap:' ELSE 'other:' END || CAST(o_custkey AS STRING) AS source_id,
  CAST(o_orderdate AS TIMESTAMP) AS started_at, o_orderkey AS report_count, o_orderkey % 7 AS skipped_count
FROM orders
"""
_SOURCES = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'snap:' ELSE 'other:' END || CAST(c_custkey AS STRING) AS id,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 1 THEN 'snapshot' ELSE 'manual' END AS kind,
  'https://example.org/' || CAST(c_custkey AS STRING) AS url, c_mktsegment AS license,
  TIMESTAMP '2001-01-01 00:00:00' AS imported_at
FROM customer
"""

_INVENTORY = """
SELECT CAST(CASE p_partkey % 3 WHEN 0 THEN 2 + p_partkey % 25 WHEN 1 THEN 100 + p_partkey % 75
  ELSE 1000 + p_partkey END AS INT) AS appid, p_partkey AS item, p_name AS name
FROM part
"""

_NAMES = "SELECT p_partkey AS doc_id, p_name AS name FROM part"
_NAME_QUERIES = """
SELECT p_name AS query_id, upper(p_name) AS query FROM part GROUP BY p_name
UNION ALL SELECT p_type AS query_id, p_type || ' widget' AS query FROM part GROUP BY p_type
UNION ALL SELECT 'ring ' || p_brand AS query_id, 'ring' AS query FROM part GROUP BY p_brand
"""

# Parts of names of one to seven letters, in capitals every other time.
_NAME_PARTS = """
SELECT part AS part_id, CASE WHEN length(part) % 2 = 0 THEN upper(part) ELSE part END AS part
FROM (SELECT DISTINCT substr(p_name, CAST(1 + p_partkey % 4 AS INT), CAST(1 + p_partkey % 7 AS INT)) AS part FROM part)
"""

# Launch lines: one per customer, with what is set already; chosen snippets are those of its orders.
_LINES = """
SELECT c_custkey AS line_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'MANGOHUD=1 gamemoderun %command% -dx11'
  WHEN 'MACHINERY' THEN '-novid' WHEN 'AUTOMOBILE' THEN ' "DXVK_ASYNC=0" %COMMAND%' ELSE '' END AS existing
FROM customer
"""
_SELECTED = """
SELECT o_custkey AS line_id, o_orderkey AS pos, 's' || CAST(o_orderkey AS STRING) AS id,
  CASE o_orderkey % 8 WHEN 7 THEN 'workaround' WHEN 5 THEN 'env_var' WHEN 6 THEN 'wrapper' ELSE 'launch_option' END AS kind,
  CASE o_orderkey % 8 WHEN 5 THEN CASE o_orderkey % 3 WHEN 0 THEN 'DXVK_ASYNC=1' WHEN 1 THEN '"DXVK_ASYNC=0"' ELSE 'PROTON_LOG=' || CAST(o_orderkey % 5 AS STRING) END
    WHEN 6 THEN CASE o_orderkey % 3 WHEN 0 THEN 'MangoHud' ELSE 'gamemoderun' END
    WHEN 7 THEN 'use proton experimental' ELSE launch_options END AS snippet
FROM orders JOIN report_columns ON k = o_orderkey
"""

# Collected files: a manifest per part in five libraries, a folders file per supplier, a user config per customer.
_APP_FILES = """
SELECT '/lib' || CAST(p_partkey % 5 AS STRING) || '/steamapps/appmanifest_' || CAST(p_partkey AS STRING) || '.acf' AS path,
  '"AppState"' || chr(10) || '{ "UserConfig" { "a" { "appid" "9" "b" { "c" { "d" { "e" { "appid" "9" } } } } } } "appid" "'
    || CAST(p_partkey AS STRING) || '" "name" "' || p_name || '" "SizeOnDisk" "' || CAST(p_size * 1000 AS STRING)
    || '" "installdir" "' || p_type || '" "later" { "name" "{" } }' AS text
FROM part
"""
_FOLDER_FILES = """
SELECT '/root' || CAST(s_suppkey AS STRING) || '/steamapps/libraryfolders.vdf' AS path,
  '"libraryfolders" { "10" { "path" "/far" } "1" { "apps" { "7" { "path" "/no" } } "path" "/lib' || CAST(s_suppkey % 5 AS STRING)
    || '/" } "0" { "path" "/x/y/../../root' || CAST(s_suppkey AS STRING) || '" } }' AS text
FROM supplier
"""
_CONFIG_FILES = """
SELECT '/root' || CAST(c_custkey % 10 AS STRING) || '/userdata/' || CAST(c_custkey AS STRING) || '/config/localconfig.vdf' AS path,
  CASE WHEN c_custkey % 2 = 0 THEN '"UserLocalConfigStore" { "Software" { "Valve" { "Steam" { "apps" { "'
      || CAST(c_custkey % 50 + 1 AS STRING) || '" { "cloud" { "LaunchOptions" "no" } "LaunchOptions" "opt ' || CAST(c_custkey AS STRING)
      || '" } } } } } }'
    ELSE '"other" { "' || CAST(c_custkey % 50 + 1 AS STRING) || '" { "Launch Options" " opt ' || CAST(c_custkey AS STRING) || ' " } }' END AS text
FROM customer
"""
_PROBE_FILES = """
SELECT '/probe/' || CAST(s_suppkey AS STRING) || '/os-release' AS path,
  'NAME=Plain' || chr(10) || 'PRETTY_NAME="Distro ' || CAST(s_suppkey AS STRING) || '"' || chr(10) AS text FROM supplier
UNION ALL SELECT '/probe/' || CAST(s_suppkey AS STRING) || '/cpuinfo' AS path,
  'processor : 0' || chr(10) || 'model name : Core ' || CAST(s_suppkey AS STRING) || chr(10) AS text FROM supplier
UNION ALL SELECT '/probe/' || CAST(s_suppkey AS STRING) || '/meminfo' AS path,
  'MemTotal: ' || CAST(s_suppkey * 1048576 AS STRING) || ' kB' || chr(10) AS text FROM supplier
"""

VIEWS = {
    "app_files": _APP_FILES,
    "folder_files": _FOLDER_FILES,
    "config_files": _CONFIG_FILES,
    "probe_files": _PROBE_FILES,
    "report_columns": _REPORT_COLUMNS,
    "reports": _REPORTS,
    "profiles": _PROFILES,
    "requests": _REQUESTS,
    "games": _GAMES,
    "catalogue": _CATALOGUE,
    "runs": _RUNS,
    "sources": _SOURCES,
    "inventory": _INVENTORY,
    "names": _NAMES,
    "name_queries": _NAME_QUERIES,
    "name_parts": _NAME_PARTS,
    "lines": _LINES,
    "selected": _SELECTED,
}
_NEEDS = {"reports": ("report_columns",), "selected": ("report_columns",)}
_TABLES = ("orders", "supplier", "customer", "events", "part", "lineitem", "documents")


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


class Data:
    """The adapter views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = _fill(VIEWS[name], _SPARK)
        for table in _TABLES:
            if re.search(rf"\b{table}\b", sql):
                self.table(table).createOrReplaceTempView(table)
        for needed in _NEEDS.get(name, ()):
            self.view(needed).createOrReplaceTempView(needed)
        return self.spark.sql(sql)

    def reports(self, spread: bool = False) -> DataFrame:
        """Reports as stored, with hardware, comparison categories and input position.

        The given table is one small file, thus one task; ``spread`` deals it out to all cores
        before work that is heavy per row, as the many files of a large table would be.
        """
        df = self.view("reports")
        if spread:
            df = df.repartition(self.spark.sparkContext.defaultParallelism, "k")
        df = df.withColumns(
            {"ram_gb": parse_ram_gb(F.col("ram")), "gpu_vendor": F.lit(""), "position": F.array("k")}
        )
        return with_hardware(df)

    def profiles(self) -> DataFrame:
        return with_hardware(self.view("profiles"))


def oracle_views(*names: str) -> str:
    """The ``WITH`` list that defines views for the checking database."""
    wanted: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in wanted:
                wanted.append(needed)
    return ", ".join(f"{name} AS ({_fill(VIEWS[name], _DUCK).strip()})" for name in wanted)
