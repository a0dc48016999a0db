"""Report records out of loosely-nested documents, and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields
from ..functions.text import present, text_or_empty
from ..operators.scaling import stored
from ..schemas import SYSTEM_FIELDS

#: Levels that are opened in one go; documents with more brackets within each other are opened step by step.
LEVELS = 4
_NODE = "struct<done: boolean, value: variant, appid: int, title: string, id: string, position: array<bigint>>"


def _node(value: Column, appid: Column, title: Column, id_: Column, position: Column, done: bool = False) -> Column:
    return F.struct(
        F.lit(done).alias("done"),
        value.alias("value"),
        appid.cast("int").alias("appid"),
        title.alias("title"),
        id_.alias("id"),
        position.alias("position"),
    )


def _under(parent: Column, separator: str, key: Column) -> Column:
    return F.when(parent == "", key).otherwise(F.concat(parent, F.lit(separator), key))


def _objects(df: DataFrame, record: Column):
    df, top = fields.add_members(df, "top", record)
    df, app = fields.add_members(df, "app", top.value("app"))
    df, steam = fields.add_members(df, "steam", app.value("steam"))
    df, responses = fields.add_members(df, "responses", top.value("responses"))
    return df, top, app, steam, responses


def _level(df: DataFrame) -> DataFrame:
    """Replace every open node by its children; finished ones stay as they are."""
    node = F.col("node")
    keep = df.columns
    df, top, app, steam, responses = _objects(df, F.when(~node["done"], node["value"]))
    own_id = fields.app_id(top, app, steam, responses)
    df = df.withColumns(
        {
            "_appid": F.when(own_id > 0, own_id).otherwise(node["appid"]),
            "_title": F.coalesce(fields.title(top, app), node["title"]),
            "_reports": top.value("reports"),
            "_is_report": fields.looks_like_report(top),
            "_own_id": F.coalesce(top.text(*fields.ID_KEYS), node["id"]),
        }
    )
    appid, title, reports = F.col("_appid"), F.col("_title"), F.col("_reports")

    def items(value: Column, separator: str, appid: Column, title: Column) -> Column:
        return F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda child, at: _node(
                child,
                appid,
                title,
                _under(node["id"], separator, at.cast("string")),
                F.array_append(node["position"], at.cast("bigint")),
            ),
        )

    def entries(value: Column, separator: str, numeric_keys: bool) -> Column:
        def child(entry: Column, at: Column) -> Column:
            key = entry["key"]
            of_key = F.coalesce(F.when(key.rlike(r"^[+-]?\d+$"), key.try_cast("int")), appid) if numeric_keys else appid
            return _node(
                entry["value"],
                of_key,
                title,
                _under(node["id"], separator, key),
                F.array_append(node["position"], at.cast("bigint")),
            )

        return F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), child)

    kind = fields.kind_of(node["value"])
    report = _node(node["value"], appid, title, F.col("_own_id"), node["position"], done=True)
    children = (
        F.when(node["done"], F.array(node))
        .when(kind == "ARRAY", items(node["value"], ":", node["appid"], node["title"]))
        .when(
            (kind == "OBJECT") & reports.isNotNull(),
            F.when(fields.kind_of(reports) == "ARRAY", items(reports, "/", appid, title)).when(
                fields.kind_of(reports) == "OBJECT", entries(reports, "/", False)
            ),
        )
        .when((kind == "OBJECT") & (F.col("_is_report") | (appid > 0)), F.array(report))
        .when(kind == "OBJECT", entries(node["value"], ":", True))
    )
    return df.select(*[c for c in keep if c != "node"], F.explode(children.cast(f"array<{_NODE}>")).alias("node"))


def _depth(raw: Column) -> Column:
    """How many brackets of a JSON text stand within each other; not counted where there are only a few at all."""
    brackets = F.length(raw) - F.length(F.translate(raw, "[{", ""))
    bare = F.regexp_replace(raw, r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.when(brackets <= LEVELS, F.lit(0)).otherwise(F.aggregate(marks, start, step, lambda state: state["most"]))


def _chosen(df: DataFrame, chosen: Column, node: Column) -> DataFrame:
    """Nodes of the chosen rows; an explode, since a filter would be carried into every level above it."""
    return df.select("archive", F.explode(F.when(chosen, F.array(node.cast(_NODE)))).alias("node"))


def _opened(df: DataFrame) -> DataFrame:
    """Nodes after some levels, their values as JSON texts; what can hold no report is left out."""
    for _ in range(LEVELS):
        df = _level(df)
    kept = df.where(F.col("node.done") | fields.kind_of(F.col("node.value")).isin("OBJECT", "ARRAY"))
    names = ("done", "appid", "title", "id", "position")
    return kept.select("archive", *[F.col(f"node.{n}").alias(n) for n in names], F.to_json("node.value").alias("raw_json"))


def flatten(items: DataFrame) -> DataFrame:
    """Report records in document items ``(archive, position, raw)``, however deep they lie.

    App id, title and path id come down from the containers. Items cut out of a container may carry its other members
    as JSON (``outer``) and their own path id (``id``). A level is one explode in the same stage; nothing is
    shuffled. Items that are nested deeply are few; what is still closed after some levels is stored and opened again.
    """
    position = F.col("position")
    start_id = F.array_join(F.transform(position, lambda p: p.cast("string")), ":")
    deep = F.coalesce(_depth(F.col("raw")) > LEVELS, F.lit(False))
    appid, title = F.lit(0), F.lit(None).cast("string")
    if "outer" in items.columns:
        items, top, app, steam, responses = _objects(items, F.try_parse_json("outer"))
        own_id = fields.app_id(top, app, steam, responses)
        appid, title, start_id = F.when(own_id > 0, own_id).otherwise(F.lit(0)), fields.title(top, app), F.col("id")
    node = _node(F.try_parse_json("raw"), appid, title, start_id, position)
    found = _opened(items.select("archive", node.cast(_NODE).alias("node"))).where("done")
    rest = None if items.where(deep).isEmpty() else stored(_opened(_chosen(items, deep, node))).where("NOT done")
    while rest is not None and not rest.isEmpty():
        node = _node(F.try_parse_json("raw_json"), F.col("appid"), F.col("title"), F.col("id"), F.col("position"))
        rows = stored(_opened(_chosen(rest, ~F.col("done"), node)))
        found, rest = found.unionByName(rows.where("done")), rows.where("NOT done")
    return found.select("archive", "appid", "title", "id", "position", F.try_parse_json("raw_json").alias("value"), "raw_json")


def normalize(records: DataFrame, source_id: Column) -> DataFrame:
    """Reports with their hardware fields; ``valid`` is false without an app id or a time."""
    df = records.withColumnsRenamed({"appid": "_in_appid", "title": "_in_title", "id": "_in_id"})
    df, top, app, steam, responses = _objects(df, F.col("value"))
    system_value = top.value(*fields.SYSTEM_KEYS)
    df, system = fields.add_members(df, "system", system_value)
    df, gpu = fields.add_members(df, "gpu", system.value(*fields.GPU_KEYS))
    own_id = fields.app_id(top, app, steam, responses)
    info = fields.system_info(system, gpu, top)
    df = df.withColumns(
        {
            "source_id": source_id,
            "appid": F.when(own_id > 0, own_id).otherwise(F.col("_in_appid")),
            "ts": fields.report_time(top.value(*fields.TIME_KEYS)),
            "_given_id": F.coalesce(top.text(*fields.ID_KEYS), F.nullif(F.col("_in_id"), F.lit(""))),
            "_own_title": fields.title(top, app),
            "verdict": text_or_empty(fields.verdict(top, responses)),
            "rating": text_or_empty(fields.rating(top, responses)),
            "notes": fields.notes(top, responses),
            "launch_options": text_or_empty(fields.launch_options(top, responses)),
            "proton_version": text_or_empty(fields.runtime_version(top, responses)),
            "system_json": F.to_json(system_value),
            "system_map": fields.system_map(F.col("_system_exact")),
            **{name: info[name] for name in SYSTEM_FIELDS},
        }
    )
    has_values = fields.has_system_values({name: F.col(name) for name in SYSTEM_FIELDS})
    given = F.col("_given_id")
    generated = fields.generated_report_id(
        F.col("source_id"),
        F.col("appid"),
        F.col("ts"),
        F.array_join(F.transform("position", lambda p: p.cast("string")), "."),
        F.col("raw_json"),
    )
    return df.select(
        "archive",
        "source_id",
        F.when(given.isNull() | given.rlike(r"^[+-]?\d+$"), generated).otherwise(given).alias("source_report_id"),
        "appid",
        F.coalesce(
            "_own_title", present(F.col("_in_title")), F.concat(F.lit("Steam App "), F.col("appid").cast("string"))
        ).alias("title"),
        "ts",
        "verdict",
        "rating",
        "notes",
        "launch_options",
        "proton_version",
        "raw_json",
        "position",
        F.coalesce((F.col("appid") > 0) & F.col("ts").isNotNull(), F.lit(False)).alias("valid"),
        (F.col("system_json").isNotNull() | has_values).alias("has_system_info"),
        "system_json",
        "system_map",
        *SYSTEM_FIELDS,
    )
