"""Target schemas of the stored tables."""

from __future__ import annotations

SYSTEM_FIELDS = ("gpu_vendor", "gpu_model", "gpu_driver", "cpu", "ram_gb", "distro", "kernel", "desktop")

SOURCES = "id STRING, kind STRING, url STRING, license STRING, imported_at TIMESTAMP"
IMPORT_RUNS = (
    "id STRING, source_id STRING, snapshot_filename STRING, snapshot_date DATE, source_url STRING, license STRING, "
    "started_at TIMESTAMP, finished_at TIMESTAMP, report_count BIGINT, skipped_count BIGINT"
)
GAMES = "appid INT, name STRING, launcher STRING"
SYSTEM_INFO = (
    "gpu_vendor STRING, gpu_model STRING, gpu_driver STRING, cpu STRING, ram_gb DOUBLE, "
    "distro STRING, kernel STRING, desktop STRING, raw_json STRING"
)
REPORTS = (
    "run_id STRING, source_id STRING, source_report_id STRING, appid INT, title STRING, ts TIMESTAMP, verdict STRING, "
    "rating STRING, notes STRING, launch_options STRING, proton_version STRING, raw_json STRING, position ARRAY<BIGINT>"
)
SUGGESTIONS = (
    "appid INT, snippet STRING, kind STRING, occurrences BIGINT, newest_report_ts TIMESTAMP, "
    "confidence STRING"
)
#: One row per source: a popular snippet has too many for one array.
SUGGESTION_SOURCES = "appid INT, snippet STRING, kind STRING, source_report_id STRING"

#: The nine compared hardware categories: column, display name, weight, partial match allowed.
#: Fixed values.
COMPARED_FIELDS = (
    ("norm_gpu_vendor", "GPU vendor", 0.28, False),
    ("norm_gpu_model", "GPU model", 0.12, True),
    ("norm_gpu_driver", "GPU driver", 0.10, False),
    ("norm_distro_family", "distro family", 0.15, False),
    ("norm_kernel", "kernel", 0.10, False),
    ("norm_ram_bucket", "RAM bucket", 0.08, False),
    ("norm_session_type", "session type", 0.07, False),
    ("norm_cpu_vendor", "CPU vendor", 0.05, False),
    ("norm_cpu_class", "CPU class", 0.05, False),
)
NORM_COLUMNS = tuple(name for name, _, _, _ in COMPARED_FIELDS)
