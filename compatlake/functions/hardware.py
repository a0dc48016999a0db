"""Hardware and platform categories used to compare machines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind, classify, contains_any, simplify, strip, text_or_empty

# Category tables, tried in order.
GPU_VENDORS = (
    ("nvidia", ("nvidia", "geforce", "rtx", "gtx")),
    ("amd", ("advanced micro devices", "amd/ati", "amd", "radeon", "radv")),
    ("intel", ("intel", "arc", "iris", "uhd graphics")),
)
GPU_VENDOR_LABELS = (
    ("NVIDIA", ("nvidia", "geforce", "rtx", "gtx")),
    ("AMD", ("amd", "radeon", "radv")),
    ("Intel", ("intel", "arc")),
)
GPU_NAME_NOISE = (
    "nvidia corporation",
    "nvidia",
    "advanced micro devices, inc.",
    "advanced micro devices",
    "amd/ati",
    "amd",
    "ati technologies inc.",
    "intel corporation",
    "intel",
    "[",
    "]",
    ",",
)
CPU_VENDORS = (
    ("amd", ("amd", "ryzen", "epyc")),
    ("intel", ("intel", "core(tm)", "core i", "xeon")),
    ("apple", ("apple",)),
)
CPU_CLASSES = (
    ("ryzen 9", ("ryzen 9",)),
    ("ryzen 7", ("ryzen 7",)),
    ("ryzen 5", ("ryzen 5",)),
    ("ryzen 3", ("ryzen 3",)),
    ("threadripper", ("threadripper",)),
    ("epyc", ("epyc",)),
    ("core ultra", ("core ultra",)),
    ("core i9", ("core i9", "i9-")),
    ("core i7", ("core i7", "i7-")),
    ("core i5", ("core i5", "i5-")),
    ("core i3", ("core i3", "i3-")),
    ("xeon", ("xeon",)),
)
DISTRO_FAMILIES = (
    ("arch", ("arch", "manjaro", "endeavour", "steamos")),
    ("fedora", ("fedora", "nobara", "bazzite", "ublue")),
    ("ubuntu", ("ubuntu", "pop!_os", "pop os", "mint", "neon")),
    ("debian", ("debian",)),
)
SESSION_TYPES = (("wayland", ("wayland",)), ("x11", ("x11", "xorg")))
UNKNOWN = "unknown"


def gpu_vendor(text: Column) -> Column:
    return classify(F.lower(text_or_empty(text)), GPU_VENDORS, UNKNOWN)


def gpu_vendor_label(text: Column) -> Column:
    """Display vendor of a GPU text, empty when none is recognised."""
    return classify(F.lower(text_or_empty(text)), GPU_VENDOR_LABELS, "")


def gpu_model(model: Column) -> Column:
    """Bare lower-case model: bracket content if any, no parenthesis, no vendor words."""
    bracket = r"^[^\[]*\[([^\]]*)\]"
    value = strip(text_or_empty(model))
    value = F.when(value.rlike(bracket), F.regexp_extract(value, bracket, 1)).otherwise(value)
    value = F.lower(F.substring_index(value, "(", 1))
    for noise in GPU_NAME_NOISE:
        value = F.replace(value, F.lit(noise), F.lit(" "))
    return simplify(value)


def cpu_vendor(cpu: Column) -> Column:
    return classify(F.lower(text_or_empty(cpu)), CPU_VENDORS, UNKNOWN)


def cpu_class(cpu: Column) -> Column:
    return classify(F.lower(text_or_empty(cpu)), CPU_CLASSES, UNKNOWN)


def ram_bucket(ram_gb: Column) -> Column:
    ram = F.coalesce(ram_gb, F.lit(0.0))
    return (
        F.when(ram <= 0, F.lit(UNKNOWN))
        .when(ram < 8, F.lit("<8"))
        .when(ram < 16, F.lit("8-15"))
        .when(ram < 32, F.lit("16-31"))
        .otherwise(F.lit("32+"))
    )


def distro_family(*values: Column) -> Column:
    return classify(F.lower(F.concat_ws(" ", *values)), DISTRO_FAMILIES, UNKNOWN)


def session_type(value: Column) -> Column:
    return classify(F.lower(text_or_empty(value)), SESSION_TYPES, UNKNOWN)


def version_major_minor(value: Column) -> Column:
    """First ``major.minor`` in a text, empty when there is none."""
    return F.regexp_extract(text_or_empty(value), r"(\d+\.\d+)", 1)


def parse_ram_gb(value: Column) -> Column:
    """RAM text with an optional unit, in GiB; 0 when no number is found."""

    def scaled(text: Column) -> Column:
        number = F.regexp_extract(text, r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
        size = (
            F.when(contains_any(text, ("mib", "mb")), number / 1024.0)
            .when(contains_any(text, ("kib", "kb")), number / 1024.0 / 1024.0)
            .otherwise(number)
        )
        return F.coalesce(size, F.lit(0.0))

    return bind(F.lower(strip(text_or_empty(value))), scaled)


def normalized_profile(
    gpu_vendor_text: Column,
    gpu_model_text: Column,
    gpu_driver: Column,
    cpu: Column,
    ram_gb: Column,
    distro: Column,
    kernel: Column,
    session: Column,
    desktop: Column,
    distro_id: Column | None = None,
    distro_id_like: Column | None = None,
) -> dict[str, Column]:
    """The nine comparison categories of a machine, by column name."""
    families = [F.nullif(v, F.lit("")) for v in (distro_id, distro_id_like, distro) if v is not None]
    return {
        "norm_gpu_vendor": gpu_vendor(F.concat_ws(" ", gpu_vendor_text, gpu_model_text)),
        "norm_gpu_model": gpu_model(gpu_model_text),
        "norm_gpu_driver": version_major_minor(gpu_driver),
        "norm_distro_family": distro_family(*families),
        "norm_kernel": version_major_minor(kernel),
        "norm_ram_bucket": ram_bucket(ram_gb),
        "norm_session_type": session_type(F.coalesce(F.nullif(session, F.lit("")), desktop)),
        "norm_cpu_vendor": cpu_vendor(cpu),
        "norm_cpu_class": cpu_class(cpu),
    }
