"""Machine profiles from collected system texts, one folder per machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any, simplify, strip, text_or_empty

# File names of the texts, and display controllers in a device list.
PROBES = ("os-release", "cpuinfo", "meminfo", "lspci")
CONTROLLERS = ("vga compatible controller", "3d controller", "display controller")
CONTROLLER_VENDORS = (
    ("NVIDIA", ("nvidia",)),
    ("AMD", ("advanced micro devices", "amd/ati", "radeon")),
    ("Intel", ("intel",)),
)


def _lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def _first_line(text: Column, test) -> Column:
    return F.get(F.filter(_lines(text), test), F.lit(0))


def os_release_value(text: Column, key: str) -> Column:
    """Value of a key, without quotes around it; the last line with the key counts."""
    lines = F.filter(
        F.transform(_lines(text), strip), lambda line: ~line.startswith("#") & (F.instr(line, "=") > 0)
    )
    of_key = F.filter(lines, lambda line: strip(F.substring_index(line, "=", 1)) == key)
    line = F.try_element_at(of_key, F.lit(-1))
    value = strip(F.substring(line, F.instr(line, "=") + 1, F.length(line)))
    return F.replace(F.regexp_replace(value, r'(?s)^"(.*)"$', "$1"), F.lit('\\"'), F.lit('"'))


def distro_name(text: Column) -> Column:
    key = lambda name: F.nullif(os_release_value(text, name), F.lit(""))
    return F.coalesce(key("PRETTY_NAME"), F.when(key("NAME").isNotNull(), F.concat_ws(" ", key("NAME"), key("VERSION_ID"))), F.lit(""))


def cpu_name(text: Column) -> Column:
    named = lambda line: (line.startswith("model name") | line.startswith("Hardware")) & line.rlike(":.")
    return F.coalesce(strip(F.regexp_extract(_first_line(text, named), ":(.*)$", 1)), F.lit(""))


def memory_gb(text: Column) -> Column:
    """Total memory in GiB to one decimal."""
    line = simplify(_first_line(text, lambda line: line.startswith("MemTotal:")))
    kb = F.get(F.split(line, " "), F.lit(1)).try_cast("double")
    return F.coalesce(F.round(kb / 1024.0 / 1024.0 * 10.0, 0) / 10.0, F.lit(0.0))


def controller(text: Column) -> tuple[Column, Column]:
    """Vendor and model of the first display controller."""
    line = strip(_first_line(text, lambda line: contains_any(F.lower(line), CONTROLLERS)))
    at = F.instr(line, ": ")
    model = F.when((at > 0) & (at + 1 < F.length(line)), F.substring(line, at + 2, F.length(line))).otherwise(line)
    vendor = F.lit("")
    for name, needles in reversed(CONTROLLER_VENDORS):
        vendor = F.when(contains_any(F.lower(line), needles), F.lit(name)).otherwise(vendor)
    return F.coalesce(vendor, F.lit("")), F.coalesce(model, F.lit(""))


def machine_profiles(files: DataFrame) -> DataFrame:
    """Profiles of the machines whose texts were collected as ``<machine>/<probe>``."""
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("profile_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("probe"),
        "text",
    )
    texts = named.groupBy("profile_id").agg(
        *[F.max(F.when(F.col("probe") == probe, F.col("text"))).alias(probe.replace("-", "_")) for probe in PROBES]
    )
    vendor, model = controller(F.col("lspci"))
    return texts.select(
        "profile_id",
        vendor.alias("gpu_vendor"),
        model.alias("gpu_model"),
        cpu_name(F.col("cpuinfo")).alias("cpu"),
        memory_gb(F.col("meminfo")).alias("ram_gb"),
        distro_name(F.col("os_release")).alias("distro"),
        F.coalesce(os_release_value(F.col("os_release"), "ID"), F.lit("")).alias("distro_id"),
        F.coalesce(os_release_value(F.col("os_release"), "ID_LIKE"), F.lit("")).alias("distro_id_like"),
    )
