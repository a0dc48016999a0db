"""Installed games, library folders and launch options from collected manifest files.

Files are read whole, as ``(path, text)``. A text is cut into quoted texts and braces, and one pass over these carries
the keys of all open blocks, so that blocks may lie at any depth and hold any number of entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import present
from ..operators.scaling import number_rows, sliced_join, stored
from ..operators.tables import with_report_counts

#: A quoted text or a brace; no part of it backtracks.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}]'
# Where launch options stand in a user config, and how their key may be spelled.
_APPS = ("userlocalconfigstore", "software", "valve", "steam", "apps")
_OPTION_KEYS = ("launchoptions", "launch options")
#: Pairs of a game and a root that are made in one task.
PLACED = 20_000_000
#: Roots of a shelf travel in blocks of at most so many (a power of two).
_BLOCK_BITS = 10


def read_files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """All files of a folder tree whose name fits, as path and whole text."""
    files = spark.read.format("text").options(wholetext="true", recursiveFileLookup="true", pathGlobFilter=names)
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    return files.load(folder).select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))


def clean_path(path: Column) -> Column:
    """Without doubled slashes, dots, steps up, and a slash at the end."""
    rooted = path.startswith("/")

    def step(kept: Column, piece: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        stuck = last.isNull() | (last == "..")
        up = F.when(stuck & rooted, kept).when(stuck, F.array_append(kept, piece)).otherwise(F.slice(kept, 1, F.size(kept) - 1))
        return F.when(piece.isin("", "."), kept).when(piece == "..", up).otherwise(F.array_append(kept, piece))

    pieces = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(pieces, "/"))


def dedupe_paths(paths: DataFrame, group: str) -> DataFrame:
    """Clean paths ``(group, pos, path)``, each once where it came first."""
    cleaned = paths.where(F.col("path") != "").select(group, "pos", clean_path(F.col("path")).alias("path"))
    return cleaned.groupBy(group, "path").agg(F.min("pos").alias("pos"))


def _plain(text: Column) -> Column:
    """A quoted text without its escapes."""
    for letter, blank in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        text = F.regexp_replace(text, rf"(?<!\\)\\{letter}", blank)
    return F.regexp_replace(text, r"\\(.)", "$1")


def _uncommented(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\s*//.*$", "")


def pairs(text: Column, wanted: Callable[[Column, Column], Column]) -> Column:
    """Wanted pairs of a manifest in order, as structs of the open blocks' keys, key and value."""
    shape = "array<struct<blocks:array<string>,key:string,value:string>>"
    start = F.struct(
        F.array().cast("array<string>").alias("blocks"),
        F.lit(None).cast("string").alias("key"),
        F.array().cast(shape).alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        blocks, key = state["blocks"], state["key"]
        quoted = token.startswith('"')
        body = _plain(F.substring(token, F.lit(2), F.length(token) - 2))
        pair = F.struct(blocks.alias("blocks"), key.alias("key"), body.alias("value"))
        outside = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
        return F.struct(
            F.when(token == "{", F.array_append(blocks, F.coalesce(key, F.lit(""))))
            .when(token == "}", outside)
            .otherwise(blocks)
            .alias("blocks"),
            F.when(quoted & key.isNull(), body).alias("key"),
            F.when(quoted & key.isNotNull() & wanted(blocks, key), F.array_append(state["found"], pair))
            .otherwise(state["found"])
            .alias("found"),
        )

    tokens = F.regexp_extract_all(_uncommented(text), F.lit(_TOKEN), F.lit(0))
    return F.aggregate(tokens, start, step, lambda state: state["found"])


def _value(found: Column, key: str) -> Column:
    """Last value of a key."""
    return F.try_element_at(F.filter(found, lambda p: p["key"] == key), F.lit(-1))["value"]


def _lower(blocks: Column) -> Column:
    return F.transform(blocks, F.lower)


def installed_games(files: DataFrame) -> DataFrame:
    """One row per app manifest with an app id."""
    library = clean_path(F.regexp_extract("path", r"^(.*)/steamapps/[^/]*$", 1))
    own = pairs(F.col("text"), lambda blocks, _: _lower(blocks) == F.array(F.lit("appstate")))
    state = files.select("path", library.alias("library"), own.alias("own"))
    parsed = F.struct(
        "library",
        "path",
        _value(F.col("own"), "appid").try_cast("int").alias("appid"),
        F.coalesce(_value(F.col("own"), "name"), F.lit("")).alias("name"),
        F.coalesce(_value(F.col("own"), "SizeOnDisk").try_cast("bigint"), F.lit(0)).alias("size_on_disk"),
        F.coalesce(_value(F.col("own"), "StateFlags").try_cast("bigint"), F.lit(0)).alias("state_flags"),
        F.coalesce(_value(F.col("own"), "buildid"), F.lit("")).alias("build_id"),
        _value(F.col("own"), "installdir").alias("_dir"),
    )
    # an explode, since a filter would be carried below whatever deals the files out, and read them there once more
    games = state.select(F.explode(F.filter(F.array(parsed), lambda game: game["appid"] > 0)).alias("game")).select("game.*")
    place = F.concat(F.col("library"), F.lit("/steamapps/common/"), F.nullif("_dir", F.lit("")))
    return games.withColumn("install_path", F.coalesce(place, F.lit(""))).drop("_dir")


def library_folders(files: DataFrame) -> DataFrame:
    """Libraries per root in order: the root itself, then the listed paths by number."""

    def listed(blocks: Column, key: Column) -> Column:
        return (F.size(blocks) == 2) & (F.lower(F.get(blocks, F.lit(0))) == "libraryfolders") & (key == "path")

    rooted = files.select(
        clean_path(F.regexp_extract("path", r"^(.*)/steamapps/[^/]*$", 1)).alias("root"),
        pairs(F.col("text"), listed).alias("entries"),
    )
    sortable = F.array_sort(
        F.transform(
            "entries",
            lambda e: F.struct(
                F.coalesce(F.get(e["blocks"], F.lit(1)).try_cast("int"), F.lit(2147483647)).alias("number"),
                F.get(e["blocks"], F.lit(1)).alias("key"),
                e["value"].alias("path"),
            ),
        )
    )
    paths = F.concat(F.array("root"), F.transform(sortable, lambda b: b["path"]))
    listed_paths = rooted.select("root", F.posexplode(paths).alias("pos", "path"))
    return dedupe_paths(listed_paths, "root").withColumnRenamed("path", "library")


def launch_options(files: DataFrame) -> DataFrame:
    """Launch options per root and app from user configs; the first file in path order counts.

    Within a file the apps block of the usual place counts first, then any numbered block, outer ones before inner ones
    and in order of their keys.
    """

    def option(blocks: Column, key: Column) -> Column:
        return F.element_at(blocks, -1).rlike(r"^0*[1-9]\d{0,9}$") & F.lower(key).isin(*_OPTION_KEYS)

    found = files.where(F.col("path").rlike(r"/userdata/.*/config/localconfig\.vdf$")).select(
        clean_path(F.regexp_extract("path", r"^(.*?)/userdata/", 1)).alias("root"),
        "path",
        F.explode(pairs(F.col("text"), lambda blocks, key: (F.size(blocks) > 0) & option(blocks, key))).alias("p"),
    )
    blocks = F.col("p")["blocks"]
    usual = _lower(F.slice(blocks, 1, F.size(blocks) - 1)) == F.array(*[F.lit(key) for key in _APPS])
    spelling = F.array_position(F.array(*[F.lit(key) for key in _OPTION_KEYS]), F.lower(F.col("p")["key"]))
    options = found.select(
        "root",
        F.element_at(blocks, -1).try_cast("int").alias("appid"),
        present(F.col("p")["value"]).alias("existing"),
        F.struct("path", (~usual).alias("unusual"), blocks.alias("blocks"), spelling.alias("spelling")).alias("place"),
    )
    return (
        options.where((F.col("appid") > 0) & F.col("existing").isNotNull())
        .groupBy("root", "appid")
        .agg(F.min_by("existing", "place").alias("existing"))
    )


def _shelves(games: DataFrame, libraries: DataFrame) -> DataFrame:
    """Root and library for every library with games; one that no root lists is a root of its own."""
    held = games.select("library").distinct()
    root = F.coalesce("root", "library").alias("root")
    listed = libraries.join(held, "library", "left_semi").select(root, "library")
    alone = held.join(libraries.select("library").distinct(), "library", "left_anti")
    return listed.unionByName(alone.select(F.col("library").alias("root"), "library"))


def _placed(games: DataFrame, shelves: DataFrame, options: DataFrame) -> DataFrame:
    """Games ``(shelf, ...)`` in each root of their shelf, with what is set for them.

    Pairs are counted first, and a shelf of many is cut into slices. Games meet the roots in blocks and are repeated only at the
    end. Only roots for which anything is set meet the options.
    """
    options = stored(options)
    asked = options.select("root").distinct()
    stock = games.groupBy("shelf").agg(F.count(F.lit(1)).alias("_games"))

    def place(roots: DataFrame) -> DataFrame:
        counted = roots.groupBy("shelf").agg(F.count(F.lit(1)).alias("_roots")).join(stock, "shelf")
        counted = stored(counted.select("shelf", (F.col("_roots") * F.col("_games")).alias("_rows")))
        tasks = max(games.sparkSession.sparkContext.defaultParallelism, -(-(counted.agg(F.sum("_rows")).first()[0] or 0) // PLACED))
        numbered = number_rows(roots, ["shelf"], [F.col("root").asc()], "_number")
        block = F.shiftright(F.col("_number") - 1, _BLOCK_BITS).alias("_block")
        # in arrays, since a root may be NULL
        blocks = numbered.groupBy("shelf", block).agg(F.flatten(F.collect_list(F.array("root"))).alias("_roots")).drop("_block")
        met = sliced_join(games, blocks, ["shelf"], ["path"], counted, tasks=tasks)
        return met.withColumn("root", F.explode("_roots")).drop("shelf", "_roots")

    plain = place(shelves.join(asked, "root", "left_anti")).withColumn("existing", F.lit(""))
    found = place(shelves.join(asked, "root", "left_semi")).join(options, ["root", "appid"], "left")
    return plain.unionByName(found.withColumn("existing", F.coalesce("existing", F.lit(""))))


def inventory(games: DataFrame, libraries: DataFrame, options: DataFrame) -> DataFrame:
    """Installed games per root with what is set for them; a library that no root lists is a root of its own."""
    games = stored(games)
    shelf = F.array("library").alias("shelf")
    shelves = stored(_shelves(games, libraries).select("root", shelf))
    return _placed(games.select("*", shelf), shelves, options)


def ranked_inventory(games: DataFrame, libraries: DataFrame, options: DataFrame, order: list[Column]) -> DataFrame:
    """The inventory with the place (``rank``) of each game in its root.

    Roots with the same libraries have the same games in the same order, so games are numbered once for each such set of libraries.
    """
    games = stored(games)
    listed = F.array_sort(F.collect_list(F.array("library")))
    sets = stored(_shelves(games, libraries).groupBy("root").agg(listed.alias("_libraries")))
    kinds = stored(sets.select("_libraries").distinct().withColumn("shelf", F.monotonically_increasing_id()))
    members = kinds.select("shelf", F.explode("_libraries").alias("_held"))
    stock = sliced_join(games.withColumn("_held", F.array("library")), members, ["_held"], ["path"]).drop("_held")
    ranked = number_rows(stock, ["shelf"], order)
    return _placed(ranked, stored(sets.join(kinds, "_libraries").select("root", "shelf")), options)


def inventory_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.lower("name"), "appid")


def coverage(found: DataFrame, reports: DataFrame) -> DataFrame:
    """Games or their inventory with report counts; games are fewer and better counted before they are placed."""
    return with_report_counts(found, reports)


def coverage_order() -> list[Column]:
    return [F.col("has_reports").desc(), F.lower("name").asc()]


