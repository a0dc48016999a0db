"""Archives, manifests and probes, on files written to a temporary folder."""

import datetime as dt
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from compatlake.operators import mining
from compatlake.operators.ranking import with_hardware
from compatlake.plans import ingest
from compatlake.sources import archive, manifests, probes
from compatlake.sources.records import flatten

SPEC = ingest.SourceSpec("snapshot", "snap:", "https://example.org/raw", "open data")
NOW = dt.datetime(2026, 6, 2)


def record(appid, title, **more):
    return {
        "app": {"steam": {"appId": str(appid)}, "title": title},
        "responses": {"verdict": "yes", "opens": "yes", "protonVersion": "Proton Experimental"},
        "timestamp": 1710000000,
        "systemInfo": {"gpu": "NVIDIA GeForce RTX 4070", "os": "Test Linux", "ram": "32 GB"},
        **more,
    }


def write_archive(path, document, member=archive.MEMBER):
    data = json.dumps(document).encode()
    with tarfile.open(path, "w:gz") as out:
        for name, content in (("data/readme.txt", b"x"), (f"data/{member}", data)):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))
    return str(path)


def run(spark, root, path, filename):
    store = ingest.Store(spark, str(root))
    meta = ingest.SnapshotMeta(filename, dt.date(2026, 6, 1), f"file://test/{filename}")
    return store, ingest.import_snapshot(store, path, meta, SPEC, NOW)


def test_import_replaces_and_purges(spark, tmp_path):
    first = write_archive(tmp_path / "a.tar.gz", [record(999001, "Dedup Test Game")])
    store, result = run(spark, tmp_path / "store", first, "reports_jun1_2026.tar.gz")
    assert (result["reports_imported"], result["games_imported"], result["records_skipped"]) == (1, 1, 0)
    row = store.table("reports").first()
    assert (row["appid"], row["verdict"], row["runtime"], row["ram_gb"]) == (999001, "yes", "Proton Experimental", 32.0)
    assert (row["norm_gpu_vendor"], row["norm_gpu_model"]) == ("nvidia", "geforce rtx 4070")
    assert row["source_report_id"].startswith("generated:999001:20240309T160000Z:")

    store, _ = run(spark, tmp_path / "store", first, "reports_jun1_2026.tar.gz")
    assert store.table("reports").count() == 1
    assert store.table("import_runs").count() == 1

    second = write_archive(tmp_path / "b.tar.gz", [record(999002, "Replacement Snapshot Game")])
    store, _ = run(spark, tmp_path / "store", second, "reports_jul1_2026.tar.gz")
    assert [r["appid"] for r in store.table("reports").collect()] == [999002]
    assert [(g["appid"], g["name"]) for g in store.table("games").collect()] == [(999002, "Replacement Snapshot Game")]
    assert store.table("sources").count() == 2


def test_failed_import_leaves_store(spark, tmp_path):
    good = write_archive(tmp_path / "a.tar.gz", [record(5, "Kept")])
    store, _ = run(spark, tmp_path / "store", good, "reports_jun1_2026.tar.gz")
    bad = write_archive(tmp_path / "b.tar.gz", [{"title": "no app", "timestamp": 1}, {"appid": 3, "date": "nope"}])
    with pytest.raises(ingest.SnapshotError, match="no valid reports imported; skipped 2"):
        run(spark, tmp_path / "store", bad, "reports_jul1_2026.tar.gz")
    assert store.version() == 1
    assert [r["appid"] for r in store.table("reports").collect()] == [5]


def test_last_title_names_the_game(spark, tmp_path):
    titles = write_archive(tmp_path / "a.tar.gz", [record(7, f"Title {n}") for n in range(30)] + [record(7, "Last")])
    store, result = run(spark, tmp_path / "store", titles, "reports_jun1_2026.tar.gz")
    assert result["reports_imported"] == 31
    assert store.table("games").first()["name"] == "Last"


def test_meta_needs_name_and_date(spark):
    with pytest.raises(ingest.SnapshotError, match="filename is required"):
        ingest.complete_meta(spark, ingest.SnapshotMeta("  "), SPEC)
    with pytest.raises(ingest.SnapshotError, match="date is required"):
        ingest.complete_meta(spark, ingest.SnapshotMeta("x.tar.gz"), SPEC)
    meta = ingest.complete_meta(spark, ingest.SnapshotMeta("reports_jun1_2026.tar.gz"), SPEC)
    assert (meta.date, meta.source_id) == (dt.date(2026, 6, 1), "snap:reports_jun1_2026.tar.gz")
    assert meta.url == "https://example.org/raw/reports_jun1_2026.tar.gz"


def items_of(document, size):
    text = document if isinstance(document, str) else json.dumps(document)
    return list(archive.document_items(lambda: iter([text[at : at + size] for at in range(0, len(text), size)])))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_document_items_in_any_chunks(size):
    document = [{"a": "é]\"[{\\"}, [1, 2], 12345, "x,y\\\"", None, True, {"b": {"c": []}}, "", -1.5e3]
    found = items_of(document, size)
    assert [json.loads(text) for _, text, _, _ in found] == document
    assert [(position, path) for position, _, path, _ in found] == [([n], str(n)) for n in range(len(document))]
    assert items_of([], size) == items_of({}, size) == []

    beside = {"title": "T{", "appId": 5, "meta": {"reports": [1]}}
    found = items_of({**beside, "reports": document, "later": "x"}, size)
    assert [json.loads(text) for _, text, _, _ in found] == document
    assert {json.dumps(json.loads(outer)) for *_, outer in found} == {json.dumps({**beside, "later": "x"})}
    found = items_of({"reports": {"k": {"a": 1}, "l": [2]}}, size)
    assert found == [([0], '{"a": 1}', "k", "{}"), ([1], "[2]", "l", "{}")]
    found = items_of({"12": [{"a": 1}, {"b": 2}], "+7": {"c": 3}}, size)
    assert found == [
        ([0, 0], '{"a": 1}', "12:0", '{"appid": 12}'), ([0, 1], '{"b": 2}', "12:1", '{"appid": 12}'), ([1], '{"c": 3}', "+7", '{"appid": 7}')
    ]
    for whole in ({"title": "x", "timestamp": 5}, {"reports": None, "a": 1}, 5, "text"):
        assert items_of(json.dumps(whole), size) == [([], json.dumps(whole), "", None)]
    for broken in ('[{"a":1},{"b"', '[1,', '[1 2]', '{"reports": [1}', '{"a": 1} x', '{"a" 1}', "[1] 2", '["\\', "{5: 1}", ""):
        with pytest.raises(ValueError):
            items_of(broken, size)


def test_items_give_the_records_of_the_whole_document(spark):
    """Cut into items or read as one, a document has the same records."""
    inner = [record(5, "Five"), {"timestamp": 1710000000, "verdict": "yes"}, {"deep": {"reports": [record(6, "Six")]}}, "no"]
    documents = {
        "array": inner,
        "reports": {"appId": 77, "title": "Outer", "reports": inner},
        "reports by key": {"title": "Outer", "reports": {f"k{n}": item for n, item in enumerate(inner)}},
        "by app": {"101": inner, "102": record(8, "Eight"), "103": {"timestamp": 1710000000}},
    }
    columns = "archive string, position array<bigint>, raw string"
    cut = [(shape, *item) for shape, document in documents.items() for item in items_of(document, 50)]
    whole = [(shape, [], json.dumps(document)) for shape, document in documents.items()]
    names = ["archive", "appid", "title", "id", "position", "raw_json"]
    got = flatten(spark.createDataFrame(cut, f"{columns}, id string, outer string")).select(names).collect()
    want = flatten(spark.createDataFrame(whole, columns)).select(names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {shape: sum(r.archive == shape for r in want) for shape in documents} == {"array": 3, "reports": 3, "reports by key": 3, "by app": 5}


def test_long_documents_take_linear_time():
    import time

    text = json.dumps({"notes": "x" * 200, "list": [{"a": [1, 2, 3]}] * 20})
    large = "{" + '"reports": {' + ",".join(f'"k{n}": {text}' for n in range(15_000)) + "}}"
    started = time.time()
    assert sum(1 for _ in items_of(large, 1 << 16)) == 15_000
    assert time.time() - started < 30
    whole = '{"title": "' + "y" * 20_000_000 + '"}'
    assert len(items_of(whole, 1 << 16)[0][1]) == len(whole)


def test_archive_by_uri_with_an_object(spark, tmp_path):
    path = write_archive(tmp_path / "one.tar.gz", {"reports": {"x": record(11, "Eleven"), "y": record(12, "Twelve")}})
    rows = archive.read_archives(spark, f"file://{path}").collect()
    assert [(r["archive"][-7:], r["position"], r["id"]) for r in rows] == [(".tar.gz", [0], "x"), (".tar.gz", [1], "y")]
    folder = archive.read_archives(spark, tmp_path.as_uri())
    assert folder.count() == 2
    store, result = run(spark, f"file://{tmp_path}/store", f"file://{path}", "reports_jun1_2026.tar.gz")
    assert (result["reports_imported"], result["games_imported"], result["system_infos_imported"]) == (2, 2, 2)


def test_broken_archives(spark, tmp_path):
    other = write_archive(tmp_path / "a.tar.gz", [], member="other.json")
    with pytest.raises(ValueError, match="no reports_piiremoved.json"):
        list(archive.archive_items(other))


def test_suggestions_are_mined_for_changed_apps_only(spark, tmp_path):
    def noted(appid, *notes):
        return [record(appid, f"Game {appid}", id=f"{appid}-{n}", notes=note) for n, note in enumerate(notes)]

    first = noted(1, "use Proton Experimental", "DXVK_ASYNC=1 helps") + noted(2, "black screen on start") + noted(3, "gamemoderun %command%")
    path = write_archive(tmp_path / "a.tar.gz", first)
    store, result = run(spark, tmp_path / "store", path, "reports_jun1_2026.tar.gz")
    assert result["apps_mined"] == 3

    def table():
        return {(r["appid"], r["snippet"]): r["occurrences"] for r in store.table("launch_option_suggestions").collect()}

    assert table()[(2, "black screen")] == 1 and (1, "dxvk_async=1") in table()
    second = first[:2] + noted(2, "black screen on start", "again a black screen") + noted(4, "skip the intro videos")
    store, result = run(spark, tmp_path / "store", write_archive(tmp_path / "b.tar.gz", second), "reports_jun1_2026.tar.gz")
    assert {r["appid"] for r in store.table("mined_apps").collect()} == {2, 4} and result["apps_mined"] == 2
    found = table()
    assert found[(2, "black screen")] == 2 and (1, "dxvk_async=1") in found and not any(app == 3 for app, _ in found)
    assert {r["appid"] for r in store.table("suggestion_sources").collect()} == {1, 2, 4}
    assert {r["appid"] for r in store.table("games").collect()} == {1, 2, 4}
    # what is kept equals what mining everything gives
    now = F.lit(NOW)
    fresh = mining.suggestion_table(mining.mined(store.table("reports"), now))
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, store.table("launch_option_suggestions").collect()))
    assert store.table("reports", 1).count() == 4
    store.expire(keep=1)
    assert store.versions.numbers() == [2] and store.table("reports").count() == 5


def test_two_imports_at_once(spark, tmp_path):
    """Snapshots of different kinds at the same time: both are there afterwards, whoever came first."""
    from concurrent.futures import ThreadPoolExecutor

    other = ingest.SourceSpec("other", "other:", "https://example.org/other", "open data")
    jobs = [
        (write_archive(tmp_path / "a.tar.gz", [record(1, "One")]), SPEC, "reports_jun1_2026.tar.gz"),
        (write_archive(tmp_path / "b.tar.gz", [record(2, "Two")]), other, "reports_jun2_2026.tar.gz"),
    ]

    def load(job):
        store = ingest.Store(spark, str(tmp_path / "store"))
        return ingest.import_snapshot(store, job[0], ingest.SnapshotMeta(job[2]), job[1], NOW)["version"]

    with ThreadPoolExecutor(2) as pool:
        versions = sorted(pool.map(load, jobs))
    store = ingest.Store(spark, str(tmp_path / "store"))
    assert versions == [1, 2]
    assert {r["appid"] for r in store.table("reports").collect()} == {1, 2}
    assert store.table("import_runs").count() == store.table("sources").count() == 2
    left = [name for name in os.listdir(tmp_path / "store") if name.startswith(("work-", "data-"))]
    assert len(left) == 2 and not any(name.startswith("work-") for name in left)


MANIFEST = """"AppState"
{
    "appid"     "%d"
    "Universe"  "1"
    "name"      "%s"
    "StateFlags" "4"
    "installdir" "%s"
    "SizeOnDisk" "%d"
    "buildid"   "%d"
    "UserConfig" { "name" "inner {brace}" "deep" { "appid" "1" } }
}
"""
CONFIG = """"UserLocalConfigStore"
{
    "Software" { "Valve" { "Steam" { "apps"
    {
        "123" { "cloud" { "LaunchOptions" "wrong" } "LaunchOptions" "%s" }
        "456" { "launch options" " gamemoderun %%command%% " }
        "789" { "other" "x" }
    } } } }
}
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_inventory(spark, tmp_path):
    root, other = tmp_path / "m1" / "root", tmp_path / "m1" / "second lib+"
    write(
        root / "steamapps" / "libraryfolders.vdf",
        f'"libraryfolders"\n{{\n "10" {{ "path" "/late" }}\n "0" {{ "path" "{root}/" "apps" {{ "5" "6" }} }}\n'
        f' "1" {{ "path" "{other}" "label" "" }}\n}}\n',
    )
    write(root / "steamapps" / "appmanifest_123.acf", MANIFEST % (123, "Puzzle Proton", "Puzzle Proton", 424242, 999))
    write(other / "steamapps" / "appmanifest_456.acf", MANIFEST % (456, 'Sample \\"Tactics\\"', "Sample", 777777, 12345))
    write(other / "steamapps" / "appmanifest_0.acf", MANIFEST % (0, "None", "", 0, 0))
    write(root / "userdata" / "2" / "config" / "localconfig.vdf", CONFIG % "later %command%")
    write(root / "userdata" / "1" / "config" / "localconfig.vdf", CONFIG % "PROTON_USE_WINED3D=1 %command%")

    folder = str(tmp_path / "m1")
    libraries = manifests.library_folders(manifests.read_files(spark, folder, "libraryfolders.vdf"))
    assert [r["library"] for r in libraries.orderBy("pos").collect()] == [str(root), str(other), "/late"]

    games = manifests.installed_games(manifests.read_files(spark, folder, "appmanifest_*.acf"))
    found = {r["appid"]: r for r in games.collect()}
    assert sorted(found) == [123, 456]
    assert (found[123]["name"], found[123]["size_on_disk"], found[123]["build_id"]) == ("Puzzle Proton", 424242, "999")
    assert found[456]["name"] == 'Sample "Tactics"'
    assert found[456]["install_path"] == f"{other}/steamapps/common/Sample"

    options = manifests.launch_options(manifests.read_files(spark, folder, "localconfig.vdf"))
    placed = manifests.inventory(games, libraries, options)
    rows = manifests.inventory_order(placed).collect()
    assert [(r["appid"], r["existing"], r["root"]) for r in rows] == [
        (123, "PROTON_USE_WINED3D=1 %command%", str(root)),
        (456, "gamemoderun %command%", str(root)),
    ]
    reports = spark.createDataFrame([(456,), (456,)], "appid int")
    covered = manifests.coverage(placed, reports).orderBy(*manifests.coverage_order()).collect()
    assert [(r["appid"], r["report_count"], r["has_reports"]) for r in covered] == [(456, 2, True), (123, 0, False)]


@pytest.mark.parametrize(
    "path, clean",
    [("/a//b/", "/a/b"), ("/a/./b", "/a/b"), ("/a/x/../b", "/a/b"), ("/a/x/y/../../b", "/a/b"), ("/", "/")],
)
def test_clean_path(spark, path, clean):
    assert spark.range(1).select(manifests.clean_path(F.lit(path)).alias("p")).first()["p"] == clean


def test_machine_profiles(spark, tmp_path):
    one = tmp_path / "one"
    write(one / "os-release", '# c\nNAME="Arch Linux"\nPRETTY_NAME="Arch \\"btw\\" Linux"\nID=arch\n')
    write(one / "cpuinfo", "processor : 0\nmodel name\t: AMD Ryzen 7 5800X 8-Core\nmodel name\t: other\n")
    write(one / "meminfo", "MemFree: 5 kB\nMemTotal:       32780000 kB\n")
    write(
        one / "lspci",
        "00:00.0 Host bridge: Intel\n01:00.0 VGA compatible controller: NVIDIA Corporation GA104 [GeForce RTX 3070] (rev a1)\n",
    )
    write(tmp_path / "two" / "os-release", "NAME=Fedora\nVERSION_ID=40\n")
    files = manifests.read_files(spark, str(tmp_path), "*")
    rows = {r["profile_id"]: r for r in with_hardware(probes.machine_profiles(files)).collect()}
    first = rows["one"]
    assert (first["gpu_vendor"], first["norm_gpu_model"], first["norm_gpu_vendor"]) == ("NVIDIA", "geforce rtx 3070", "nvidia")
    assert (first["cpu"], first["norm_cpu_class"]) == ("AMD Ryzen 7 5800X 8-Core", "ryzen 7")
    assert (first["ram_gb"], first["norm_ram_bucket"]) == (31.3, "16-31")
    assert (first["distro"], first["norm_distro_family"]) == ('Arch "btw" Linux', "arch")
    assert (rows["two"]["distro"], rows["two"]["ram_gb"], rows["two"]["norm_distro_family"]) == ("Fedora 40", 0.0, "fedora")


def _text_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_many_apps_and_deep_blocks(spark):
    """Thousands of entries and ten levels of blocks are neither too many nor guessed at."""
    apps = " ".join(f'"{n}" "{n * 7}"' for n in range(1, 3001))
    folders = f'"libraryfolders" {{ "0" {{ "path" "/r" "apps" {{ {apps} }} "a" {{ "b" {{ "path" "/no" }} }} }} "1" {{ "x" {{ "y" {{ "z" "1" }} }} "path" "/s/../t" }} }}'
    found = manifests.library_folders(_text_rows(spark, [("/r/steamapps/libraryfolders.vdf", folders)]))
    assert [r["library"] for r in found.orderBy("pos").collect()] == ["/r", "/t"]

    nested = '"appid" "999"'
    for level in range(10):
        nested = f'"level{level}" {{ {nested} }}'
    manifest = f'"AppState" {{ {nested} "appid" "5" "name" "Deep" {nested} }}'
    game = manifests.installed_games(_text_rows(spark, [("/r/steamapps/appmanifest_5.acf", manifest)])).first()
    assert (game["appid"], game["name"]) == (5, "Deep")

    config = '"other" { "7" { "LaunchOptions" "fallback" } "8" { "LaunchOptions" "only here" } } "UserLocalConfigStore" { "Software" { "Valve" { "Steam" { "apps" { "7" { "a" { "b" { "c" "d" } } "LaunchOptions" "usual" } } } } } }'
    options = manifests.launch_options(_text_rows(spark, [("/r/userdata/1/config/localconfig.vdf", config)]))
    assert {r["appid"]: r["existing"] for r in options.collect()} == {7: "usual", 8: "only here"}


def test_root_without_a_folders_file(spark):
    games = manifests.installed_games(_text_rows(spark, [("/q/steamapps/appmanifest_5.acf", '"AppState" { "appid" "5" }')]))
    none = spark.createDataFrame([], "root string, pos int, library string")
    options = spark.createDataFrame([("/q", 5, "-novid")], "root string, appid int, existing string")
    row = manifests.inventory(games, none, options).first()
    assert (row["root"], row["existing"]) == ("/q", "-novid")


def test_clean_path_goes_up_any_number_of_steps(spark):
    path = "/" + "/".join("abcdefgh") + "/.." * 7 + "/z"
    assert spark.range(1).select(manifests.clean_path(F.lit(path)).alias("p")).first()["p"] == "/a/z"


def test_notes_and_documents_of_any_depth(spark):
    from compatlake.functions import fields
    deep = {"a": {"b": [{"c": {"d": {"e \"q\"": "deep\ntext"}}}, "item text", 5, None, "no"]}, "x": "shallow: text, {"}
    note = spark.range(1).select(fields.note_texts(F.parse_json(F.lit(json.dumps(deep)))).alias("n")).first()["n"]
    assert note == ['a: b: c: d: e "q": deep\ntext', "a: b: item text", "x: shallow: text, {"]
    escaped = spark.range(1).select(fields.note_texts(F.parse_json(F.lit(json.dumps("\n\"x\\" * 3000)))).alias("n")).first()["n"]
    assert escaped == [("\n\"x\\" * 3000).strip()]

    record_ = {"appid": 7, "timestamp": 1710000000}
    nested = record_
    for level in range(8):
        nested = [nested] if level % 2 else {f"group {level}": nested}
    items = [("a", [0], json.dumps(nested)), ("a", [1], json.dumps(record_)), ("a", [2], json.dumps([[[[[[]]]]]]))]
    found = flatten(spark.createDataFrame(items, "archive string, position array<bigint>, raw string")).collect()
    assert sorted((r["appid"], r["position"][0]) for r in found) == [(7, 0), (7, 1)]


def _reads(df) -> int:
    """How often a plan cuts texts into tokens."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_manifests_are_read_once_where_they_are_dealt_out(spark):
    texts = [(f"/q/steamapps/appmanifest_{n}.acf", f'"AppState" {{ "appid" "{n}" }}') for n in range(20)]
    games = manifests.installed_games(_text_rows(spark, texts).repartition(4, "path"))
    assert _reads(games) == 1
    assert sorted(r["appid"] for r in games.collect()) == list(range(1, 20))


def test_inventory_of_many_roots(spark, monkeypatch):
    """Shared, unlisted and missing libraries, options for some roots; the pairs are made by many tasks, none of which has most."""
    monkeypatch.setattr(manifests, "PLACED", 100, raising=False)
    games = [(lib, f"{lib}/{n}", n % 37, f"Game {n % 7}") for lib in ("/a", "/b", "/r1", "/alone", None) for n in range(40)]
    libraries = [(f"/r{n}", at, lib) for n in range(30) for at, lib in enumerate([f"/r{n}", "/a", "/far"] + ["/b"] * (n % 3 == 0))]
    options = [(f"/r{n}", app, f"opt {n}") for n in range(0, 30, 4) for app in (1, 2, 99)]
    frames = (
        spark.createDataFrame(games, "library string, path string, appid int, name string").coalesce(1),
        spark.createDataFrame(libraries, "root string, pos int, library string").coalesce(1),
        spark.createDataFrame(options, "root string, appid int, existing string").coalesce(1),
    )
    known, roots = {(root, app): said for root, app, said in options}, {}
    for root, _, lib in libraries:
        roots.setdefault(lib, []).append(root)
    want = [(root, *game[2:], known.get((root, game[2]), "")) for game in games for root in roots.get(game[0], [game[0]])]
    columns = ["root", "appid", "name", "existing"]
    found = manifests.inventory(*frames).select(*columns, F.spark_partition_id().alias("task")).collect()
    order = lambda row: tuple(str(value) for value in row)
    assert sorted((tuple(r)[:4] for r in found), key=order) == sorted(want, key=order)
    tasks = [r["task"] for r in found]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 4
    ranked = manifests.ranked_inventory(*frames, [F.lower("name").asc(), F.col("appid").asc()]).select(*columns, "rank").collect()
    placed = {}
    for row in sorted(want, key=lambda row: (row[2].lower(), row[1])):
        placed.setdefault(row[0], []).append(row)
    numbered = [(*row, at + 1) for rows in placed.values() for at, row in enumerate(rows)]
    assert sorted(map(tuple, ranked), key=order) == sorted(numbered, key=order)


def test_raw_json_is_dealt_out(spark, tmp_path):
    """A table of one file is opened by many tasks."""
    from compatlake.checks import registry

    spark.range(60).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "DATE '2000-01-01' AS o_orderdate", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority"
    ).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = registry.QUERIES["a4_raw_json_characters"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["k"] for r in rows) == [k for k in range(60) if k % 6 not in (3, 5)]
    assert len({r["task"] for r in rows}) > 1


def test_games_meet_roots_in_blocks(spark, monkeypatch):
    """Roots of a shelf, one of them NULL, meet its games by the block; each game is in each root once."""
    monkeypatch.setattr(manifests, "_BLOCK_BITS", 2, raising=False)
    games = [(lib, f"{lib}/{n}", n, f"Game {n}") for lib in ("/a", None) for n in range(5)]
    libraries = [(root, 0, "/a") for root in (*(f"/r{n}" for n in range(21)), None)]
    frames = (
        spark.createDataFrame(games, "library string, path string, appid int, name string"),
        spark.createDataFrame(libraries, "root string, pos int, library string"),
        spark.createDataFrame([("/r3", 2, "opt")], "root string, appid int, existing string"),
    )
    met, join = [], manifests.sliced_join

    def watched(large, small, *more, **named):
        met.append(small.count())
        return join(large, small, *more, **named)

    monkeypatch.setattr(manifests, "sliced_join", watched)
    found = manifests.inventory(*frames).select("root", "appid", "name", "existing").collect()
    # a library no root lists, or a root without a name, goes by the library
    roots = {"/a": [*(f"/r{n}" for n in range(21)), "/a"], None: [None]}
    want = [(root, at, name, "opt" if (root, at) == ("/r3", 2) else "") for lib, _, at, name in games for root in roots[lib]]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert max(met) <= 7
