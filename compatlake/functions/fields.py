"""Fields of loosely-shaped JSON records.

A record is a ``VARIANT``. ``members`` turns an object into a map of its non-null values,
``folded`` into the same map under lower-case keys, and ``scalar_texts`` either map into one of
texts. They are made once per object, after which every lookup is a map access.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .hardware import gpu_vendor_label
from .text import BLANKS, bind, dedupe_ignoring_case, present, strip

# Spellings under which a field may stand.
APP_ID_KEYS = ("appid", "appId", "steamAppId", "steam_appid")
RESPONSE_APP_ID_KEYS = ("answerToWhatGame",) + APP_ID_KEYS
TITLE_KEYS = ("title", "name", "gameTitle", "game_name")
VERDICT_KEYS = ("verdict", "summary")
RATING_KEYS = ("rating", "tier")
RESPONSE_RATING_KEYS = ("rating", "tier", "verdict")
OPTION_KEYS = ("launchOptions", "launch_options", "launchOption", "launch_option")
RUNTIME_KEYS = ("protonVersion", "proton_version", "proton", "protonVersionName")
ID_KEYS = ("id", "reportId", "reportID", "uuid", "_id")
TIME_KEYS = ("timestamp", "createdAt", "created_at", "date", "time")
NOTE_KEYS = ("notes", "text", "body", "content", "report")
FAULT_KEYS = (
    "extra", "customizationsUsed", "audioFaults", "graphicalFaults", "inputFaults", "performanceFaults",
    "saveGameFaults", "significantBugs", "stabilityFaults", "windowingFaults",
)
SYSTEM_KEYS = ("systemInfo", "system", "specs")
GPU_KEYS = ("gpu", "graphics", "videoCard", "video_card")
# Answers that are no free text.
FORM_ANSWERS = ("yes", "no", "n/a", "na", "none", "default", "true", "false")
# Text forms of a report time, beside epoch numbers.
TIME_FORM = (
    r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})?| \d{2}:\d{2}:\d{2})?$"
)


def _kind(value: str) -> str:
    """SQL for the type name of a variant value, up to its parameters."""
    return f"substring_index(substring_index(schema_of_variant({value}), '(', 1), '<', 1)"


def _text(value: str) -> str:
    """SQL for the text of a scalar, stripped; empty for objects and arrays."""
    plain = f"try_variant_get({value}, '$', 'string')"
    # a whole number held as a fraction prints without its point
    return (
        f"get(transform(array({_kind(value)}), kind -> CASE WHEN kind = 'STRING' THEN btrim({plain}, '{BLANKS}') "
        "WHEN kind IN ('OBJECT', 'ARRAY', 'VOID') THEN '' "
        f"WHEN kind IN ('DOUBLE', 'DECIMAL', 'FLOAT') THEN regexp_replace({plain}, '[.]0+$', '') ELSE {plain} END), 0)"
    )


def members(record: Column) -> Column:
    """Members of an object that are not null; NULL for anything else."""
    return F.map_filter(
        F.try_variant_get(record, "$", "map<string,variant>"), lambda _, value: ~F.is_variant_null(value)
    )


def folded(found: str) -> Column:
    """A map column under lower-case keys; of keys that differ in case only, the first counts."""
    first = "(x, i) -> array_position(low, get(low, i)) = i + 1"
    return F.expr(
        f"get(transform(array(transform(map_keys({found}), k -> lower(k))), low -> "
        f"CASE WHEN size(array_distinct(low)) = size(low) THEN map_from_arrays(low, map_values({found})) "
        f"ELSE map_from_arrays(filter(low, {first}), filter(map_values({found}), {first})) END), 0)"
    )


def scalar_texts(found: str) -> Column:
    """The members of a map column as stripped texts; empty for objects and arrays."""
    return F.expr(f"transform_values({found}, (k, v) -> {_text('v')})")


class Members:
    """Lookups in the maps of one object: exact spelling first, then any case.

    A look-up is one SQL text, so that the many of them stay cheap to build and to compile.
    """

    def __init__(self, name: str):
        self.exact, self.any_case = f"_{name}_exact", f"_{name}_any_case"

    def _lookups(self, keys: tuple[str, ...], suffix: str = "") -> str:
        low = dict.fromkeys(key.lower() for key in keys)
        found = [f"{self.exact}{suffix}['{key}']" for key in keys]
        return ", ".join(found + [f"{self.any_case}{suffix}['{key}']" for key in low])

    def value(self, *keys: str) -> Column:
        return F.expr(f"get(transform(array(coalesce({self._lookups(keys)})), v -> v), 0)")

    def text(self, *keys: str) -> Column:
        """Text of the first member present; NULL where that is blank or no scalar."""
        return F.expr(f"get(transform(array(coalesce({self._lookups(keys, '_text')})), t -> nullif(t, '')), 0)")


def add_members(df: DataFrame, name: str, record: Column) -> tuple[DataFrame, Members]:
    """Add the maps of an object as columns and give the lookups over them."""
    found = Members(name)
    texts = found.exact + "_text"
    df = df.withColumn(found.exact, members(record)).withColumn(texts, scalar_texts(found.exact))
    folds = {found.any_case: folded(found.exact), found.any_case + "_text": folded(texts)}
    return df.withColumns(folds), found


def kind_of(value: Column) -> Column:
    """Type name of a variant value, up to its parameters."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)


def as_int(value: Column) -> Column:
    """Numbers are cut, texts must be whole numbers; else NULL."""

    def whole(text: Column) -> Column:
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))

    return bind(
        kind_of(value),
        lambda kind: F.when(kind == "STRING", whole(strip(F.try_variant_get(value, "$", "string")))).when(
            kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "double").try_cast("int")
        ),
    )


def as_gb(value: Column) -> Column:
    """A number, or a text of one with an optional GB behind it; else 0."""
    text = strip(F.regexp_replace(strip(F.try_variant_get(value, "$", "string")), "(?i)GB$", ""))
    number = F.when(kind_of(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), text.try_cast("double"))
    return bind(number, lambda n: F.coalesce(n, F.lit(0.0)))


def is_free_text(value: Column) -> Column:
    """More than two characters and no form answer."""
    text = strip(value)
    return F.coalesce((F.length(text) > 2) & ~F.lower(text).isin(*FORM_ANSWERS), F.lit(False))


#: Tokens of a JSON text: a string with the colon of a key, a bracket, or anything else. No part of it backtracks.
_JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[\[\]{}]|[^\s"\[\]{}:,]++'


def _unquoted(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.get_json_object(token, "$")).otherwise(inner)


def note_texts(value: Column) -> Column:
    """Free texts in a value of any depth: its own, those of members under their keys, those of items.

    One pass over the tokens of its JSON carries what stands before a text: the keys of all open objects.
    """
    texts = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("key"), texts.alias("texts"))

    def step(state: Column, token: Column) -> Column:
        before, key = state["open"], state["key"]
        under = F.concat(F.element_at(before, -1), key)
        names = token.endswith(":")
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        text = F.when(token.startswith('"') & ~names, strip(_unquoted(token)))
        return F.struct(
            F.when(opens, F.array_append(before, under))
            .when(closes, F.slice(before, 1, F.size(before) - 1))
            .otherwise(before)
            .alias("open"),
            F.when(names, F.concat(_unquoted(F.regexp_replace(token, r"\s*:$", "")), F.lit(": ")))
            .otherwise(F.lit(""))
            .alias("key"),
            F.when(is_free_text(text), F.array_append(state["texts"], F.concat(under, text)))
            .otherwise(state["texts"])
            .alias("texts"),
        )

    tokens = F.regexp_extract_all(F.to_json(value), F.lit(_JSON_TOKEN), F.lit(0))
    return F.coalesce(F.aggregate(tokens, start, step, lambda state: state["texts"]), texts)


def report_time(value: Column) -> Column:
    """Epoch seconds or milliseconds, as number or text, or one of the text forms; else NULL."""
    text = F.when(
        kind_of(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), strip(F.try_variant_get(value, "$", "string"))
    )
    return bind(text, report_time_text)


def report_time_text(text: Column) -> Column:
    number = text.try_cast("double")
    millis = F.when(number > 1e12, number).otherwise(number * 1000.0)
    epoch = F.when((number > 0) & (millis < 9e18), F.timestamp_millis(F.when(millis < 9e18, millis).cast("bigint")))
    written = F.when(text.rlike(TIME_FORM), text.try_cast("timestamp"))
    return F.when(number.isNotNull(), epoch).otherwise(written)


def generated_report_id(source_id: Column, appid: Column, ts: Column, index: Column, raw: Column) -> Column:
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    digest = F.sha1(
        F.concat_ws("\n", source_id, appid.cast("string"), seconds, index.cast("string"), raw)
    )
    return F.concat_ws(
        ":",
        F.lit("generated"),
        appid.cast("string"),
        F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"),
        F.substring(digest, 1, 12),
    )


def app_id(top: Members, app: Members, steam: Members, responses: Members) -> Column:
    return F.coalesce(
        as_int(top.value(*APP_ID_KEYS)),
        as_int(steam.value(*APP_ID_KEYS)),
        as_int(app.value(*APP_ID_KEYS)),
        as_int(responses.value(*RESPONSE_APP_ID_KEYS)),
        F.lit(0),
    )


def title(top: Members, app: Members) -> Column:
    return F.coalesce(top.text(*TITLE_KEYS), app.text(*TITLE_KEYS))


def verdict(top: Members, responses: Members) -> Column:
    return F.coalesce(top.text(*VERDICT_KEYS), responses.text(*VERDICT_KEYS))


def rating(top: Members, responses: Members) -> Column:
    return F.coalesce(top.text(*RATING_KEYS), responses.text(*RESPONSE_RATING_KEYS))


def launch_options(top: Members, responses: Members) -> Column:
    return F.coalesce(top.text(*OPTION_KEYS), responses.text(*OPTION_KEYS))


def runtime_version(top: Members, responses: Members) -> Column:
    return F.coalesce(top.text(*RUNTIME_KEYS), responses.text(*RUNTIME_KEYS))


def _fault_text(found: Members, key: str) -> Column:
    return bind(found.text(key), lambda text: F.when(is_free_text(text), F.concat(F.lit(key + ": "), text)))


def _fault_texts(found: Members) -> Column:
    return F.array_compact(F.array(*[_fault_text(found, key) for key in FAULT_KEYS]))


def notes(top: Members, responses: Members) -> Column:
    """All free text of a record, one piece a line, repeats left out."""
    parts = F.concat(
        note_texts(top.value(*NOTE_KEYS)),
        _fault_texts(top),
        note_texts(responses.value("notes")),
        _fault_texts(responses),
    )
    return F.array_join(dedupe_ignoring_case(parts), "\n")


def system_info(system: Members, gpu: Members, top: Members) -> dict[str, Column]:
    """The eight hardware fields of a record; texts are NULL where missing."""
    gpu_text = F.coalesce(system.text(*GPU_KEYS), top.text("gpu"))
    ram = as_gb(system.value("ramGb", "ramGB", "ram_gb", "ram", "memory"))
    return {
        "gpu_vendor": F.coalesce(
            system.text("gpuVendor", "gpu_vendor", "vendor"),
            gpu.text("vendor", "gpuVendor", "gpu_vendor"),
            top.text("gpuVendor", "gpu_vendor"),
            bind(gpu_text, lambda text: F.nullif(gpu_vendor_label(text), F.lit(""))),
        ),
        "gpu_model": F.coalesce(
            system.text("gpuModel", "gpu_model", "gpuName", "gpu_name", "name", "model"),
            gpu.text("name", "model", "gpuName", "gpu_model"),
            top.text("gpuModel", "gpu_model", "gpuName", "gpu_name"),
            gpu_text,
        ),
        "gpu_driver": F.coalesce(
            system.text("gpuDriver", "gpu_driver", "driver", "driverVersion", "driver_version"),
            gpu.text("driver", "driverVersion", "driver_version"),
            top.text("gpuDriver", "gpu_driver", "driver", "driverVersion", "driver_version"),
        ),
        "cpu": F.coalesce(
            system.text("cpu", "cpuModel", "cpu_model", "processor"), top.text("cpu", "cpuModel", "cpu_model")
        ),
        "ram_gb": bind(ram, lambda gb: F.when(gb > 0, gb).otherwise(as_gb(top.value("ramGb", "ramGB", "ram_gb")))),
        "distro": F.coalesce(
            system.text("distro", "distribution", "os", "osName", "os_name"), top.text("distro", "distribution", "os")
        ),
        "kernel": F.coalesce(
            system.text("kernel", "kernelVersion", "kernel_version"),
            top.text("kernel", "kernelVersion", "kernel_version"),
        ),
        "desktop": F.coalesce(
            system.text("desktop", "desktopEnvironment", "desktop_environment", "session", "sessionType"),
            top.text("desktop", "desktopEnvironment", "session"),
        ),
    }


def has_system_values(info: dict[str, Column]) -> Column:
    texts = [present(value).isNotNull() for name, value in info.items() if name != "ram_gb"]
    return reduce(lambda left, right: left | right, texts) | (F.coalesce(info["ram_gb"], F.lit(0.0)) > 0)


def system_map(system: Column) -> Column:
    """Scalar members of the hardware object as texts."""
    scalars = F.map_filter(system, lambda _, value: ~kind_of(value).isin("OBJECT", "ARRAY", "VOID"))
    return F.transform_values(scalars, lambda _, value: F.try_variant_get(value, "$", "string"))


def looks_like_report(top: Members) -> Column:
    """Has a time, notes or a rating."""
    filled = f"WHEN 'STRING' THEN {_text('v')} <> ''"
    object_filled = "WHEN 'OBJECT' THEN size(try_variant_get(v, '$', 'map<string,variant>')) > 0"

    def any_of(keys: tuple[str, ...], cases: str) -> str:
        values = ", ".join(f"coalesce({top._lookups((key,))})" for key in keys)
        return f"exists(array({values}), v -> v IS NOT NULL AND CASE {_kind('v')} {cases} ELSE false END)"

    noted = any_of(NOTE_KEYS, f"{filled} {object_filled}")
    rated = any_of(("rating", "verdict", "tier"), filled)
    return top.value(*TIME_KEYS).isNotNull() | F.expr(noted) | F.expr(rated)
