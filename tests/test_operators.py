"""Exactness where rows are cut into pieces, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from compatlake.checks import registry
from compatlake.functions.rules import COMMAND
from compatlake.operators import launchline, mining, ranking, scaling, search
from compatlake.sources.records import flatten


def test_number_rows_with_one_large_group(spark):
    rng = random.Random(1)
    rows = [("hot" if n % 3 else f"g{n % 50}", rng.randrange(5), n) for n in range(5000)]
    df = spark.createDataFrame(rows, "g string, score int, id int").repartition(6)
    got = scaling.number_rows(df, ["g"], [F.col("score").desc(), F.col("id").asc()]).collect()
    expected, count = {}, {}
    for g, _, n in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        count[g] = count.get(g, 0) + 1
        expected[n] = count[g]
    assert {r["id"]: r["rank"] for r in got} == expected


def test_sliced_join_keeps_every_pair(spark):
    large = spark.createDataFrame([(1, n) for n in range(200)] + [(2, 500), (4, 501)], "k int, id int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    expected = sorted([(1, n, v) for n in range(200) for v in "ab"] + [(2, 500, "c")])
    for share in (scaling.HOT_SHARE, 0.02, 0.9999):  # all keys hot, one of them, none
        got = scaling.sliced_join(large, small, ["k"], ["id"], share=share).collect()
        assert sorted((r["k"], r["id"], r["v"]) for r in got) == expected
    counted = large.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    got = scaling.sliced_join(large, small, ["k"], ["id"], counted).collect()
    assert sorted((r["k"], r["id"], r["v"]) for r in got) == expected
    assert scaling.sliced_join(large.limit(0), small, ["k"], ["id"]).collect() == []


def fold(members):
    """One member after the other, as the rule says."""
    held = None
    for _, text in sorted(members):
        if held is None or (COMMAND in held and COMMAND not in text) or len(text) < len(held):
            held = text
    return held


def test_fold_snippets_in_any_order_of_lengths(spark):
    rng = random.Random(7)
    groups, rows = {}, []
    for group in range(60):
        members = set()
        for _ in range(rng.randrange(1, 25)):
            mark = COMMAND if rng.random() < 0.6 else "x" * rng.randrange(9, 14)
            members.add((rng.choice(["env_var", "launch_option", "wrapper"]), rng.choice("abcdef") * rng.randrange(1, 6) + mark))
        groups[group] = members
        rows += [(group, "key", kind, text) for kind, text in members]
    df = spark.createDataFrame(rows, "appid int, key string, kind string, canonical string")
    expected = {group: fold(members) for group, members in groups.items()}
    assert {r["appid"]: r["snippet"] for r in mining.fold_snippets(df).collect()} == expected
    # the stepwise fold by itself, with every group cut into several runs
    assert {r["appid"]: r["snippet"] for r in mining._fold_exactly(df).collect()} == expected


def test_stepwise_fold_across_runs(spark):
    """One group alone is cut into runs by its order."""
    rng = random.Random(3)
    members = {("launch_option", f"{n:04d}" + "y" * rng.randrange(30) + (COMMAND if n % 5 else "z" * 20)) for n in range(800)}
    df = spark.createDataFrame([(1, "key", k, t) for k, t in members], "appid int, key string, kind string, canonical string")
    assert mining._fold_exactly(df).first()["snippet"] == fold(members)


def test_phrase_search(spark):
    docs = spark.createDataFrame(
        [(1, "Half-Life two"), (2, "life half"), (3, "A half life"), (4, "unrelated"), (5, "Éclair half")],
        "doc_id int, name string",
    )
    queries = spark.createDataFrame([("p", "half-life"), ("w", "half life"), ("m", "eclair"), ("n", "half missing")], "query_id string, query string")
    got = search.search(docs, search.tokens(F.col("name")), queries).collect()
    found = {}
    for row in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(row["query_id"], []).append(row["doc_id"])
    assert set(found["p"]) == {1, 3}
    assert set(found["w"]) == {1, 2, 3}
    assert found["m"] == [5]
    assert "n" not in found


def test_no_phrase_spans_two_fields(spark):
    docs = spark.createDataFrame([(1, "one half", "life")], "doc_id int, a string, b string")
    queries = spark.createDataFrame([("p", "half-life"), ("w", "half life")], "query_id string, query string")
    got = search.search(docs, search.field_tokens(F.col("a"), F.col("b")), queries).collect()
    assert [r["query_id"] for r in got] == ["w"]


def test_compose_line(spark):
    lines = spark.createDataFrame([(1, "DXVK_ASYNC=0 gamemoderun %command% -a"), (2, "-novid"), (3, "")], "line_id int, existing string")
    selected = spark.createDataFrame(
        [
            (1, 0, "s0", "env_var", "DXVK_ASYNC=1"),
            (1, 1, "s1", "wrapper", "GameModeRun"),
            (1, 2, "s2", "launch_option", "mangohud %command% -A -b gamemoderun"),
            (1, 3, "s3", "launch_option", "sudo x"),
            (1, 4, "s4", "note", "works"),
            (2, 0, "t0", "launch_option", "-novid"),
        ],
        "line_id int, pos int, id string, kind string, snippet string",
    )
    got = {r["line_id"]: r for r in launchline.compose(lines, selected).collect()}
    assert got[1]["preview"] == "DXVK_ASYNC=0 DXVK_ASYNC=1 gamemoderun mangohud %command% -a -b"
    assert got[1]["applied"] == ["s0", "s1", "s2"] and got[1]["skipped"] == ["s3", "s4"]
    assert got[1]["conflicts"] == ["Conflicting DXVK_ASYNC: 0, 1"]
    assert got[1]["warnings"] == ["Skipped s3: contains dangerous tokens.", launchline.CONFLICTING]
    assert got[2]["preview"] == "%command% -novid" and got[2]["warnings"] == [launchline.NO_COMMAND]
    assert got[3]["preview"] == "%command%" and got[3]["warnings"] == []


def test_deep_documents_are_read(spark):
    deep = spark.createDataFrame([("a", [], '{"a":{"b":{"c":{"d":{"e":{"appid":1}}}}}}')], "archive string, position array<bigint>, raw string")
    assert [r["appid"] for r in flatten(deep).collect()] == [1]


def test_number_rows_deals_one_group_to_all_tasks(spark):
    """One group, one score: only the last part of the order tells its rows apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.lit("only").alias("g"), F.lit(1).alias("score"), "id")
        got = scaling.number_rows(df, ["g"], [F.col("score").desc(), F.col("id").desc()])
        assert {(r["id"], r["rank"]) for r in got.collect()} == {(n, 5000 - n) for n in range(5000)}
        written = [path for path in got.inputFiles() if "stored-" in path]
        assert len(written) >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert scaling.number_rows(df.limit(0), [], [F.col("id").asc()]).collect() == []


def test_ranks_by_counts(spark):
    """Ranks of all requests against sorting every machine's reports."""
    rng = random.Random(9)
    kinds = [("nvidia", "a"), ("amd", "b"), ("amd", None), (None, None)]
    names = ranking.NORM_COLUMNS
    value = lambda kind: tuple([*kind] + [None] * (len(names) - 2))
    shape = ", ".join(f"{name} string" for name in names)
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), "s", f"r{rng.randrange(80)}", [n], dt.datetime(2001, 1, rng.randrange(1, 4)),
         rng.choice([0.05, 1.0, 0.951]), 3, "fresh", rng.choice([0.45, 0.85]), value(rng.choice(kinds)))
        for n in range(400)
    ]
    columns = "appid int, source_id string, source_report_id string, position array<int>, ts timestamp, recency double, age_days int, freshness string, quality double"
    reports = spark.createDataFrame(rows, f"{columns}, hardware struct<{shape}>")
    machines = [(p, app, value(kinds[p % 3])) for p in range(6) for app in (1, 2, 9)]
    machines = spark.createDataFrame(machines, f"profile_id long, appid int, machine struct<{shape}>")
    expected = {}
    pairs = ranking.for_requests(ranking.compare_machines(reports, machines), machines).collect()
    for row in sorted(pairs, key=lambda r: (-r.score, -r.ts.timestamp(), r.source_report_id, r.source_id, r.position)):
        found = expected.setdefault((row.profile_id, row.appid), [])
        found.append((row.position[0], row.score))
    got = {}
    for row in ranking.rank_reports(reports, machines).collect():
        got.setdefault((row.profile_id, row.appid), []).append((row["rank"], row.position[0], row.score))
    assert {k: [(p, s) for _, p, s in sorted(v)] for k, v in got.items()} == expected
    assert all([r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_number_rows_with_ties_and_null_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "hot", "hot", "a"]), rng.choice([None, 1, 2, 3]), n) for n in range(600)]
    df = spark.createDataFrame(rows, "g string, score int, id int").repartition(5)
    order = [F.col("score").desc(), F.col("id").asc()]
    got = scaling.number_rows(df, ["g"], order).collect()
    expected, count = {}, {}
    for g, _, n in sorted(rows, key=lambda r: (str(r[0]), -(r[1] or 0), r[2])):
        count[g] = count.get(g, 0) + 1
        expected[n] = count[g]
    assert {r["id"]: r["rank"] for r in got} == expected


def test_search_finds_marked_letters(spark):
    docs = spark.createDataFrame([(1, "Őrség"), (2, "Český Krumlov"), (3, "résumé"), (4, "other")], "doc_id long, name string")
    queries = spark.createDataFrame([("a", "orseg"), ("b", "cesky"), ("c", "résumé"), ("d", "resume")], "query_id string, query string")
    found = search.search(docs, search.field_tokens(F.col("name")), queries).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {("a", 1), ("b", 2), ("c", 3), ("d", 3)}


def test_names_of_many_parts(spark):
    names = spark.createDataFrame([(1, "Ring of Fire"), (2, "ringing"), (3, ""), (4, None), (5, "İr")], "doc_id long, name string")
    parts = spark.createDataFrame([("a", "RING"), ("b", "g o"), ("c", "zzz"), ("d", ""), ("e", "i"), ("f", None), ("g", "ingi"), ("g", "ingi")], "part_id string, part string")
    got = sorted((r["part_id"], r["doc_id"]) for r in search.names_containing(names, parts).collect())
    low = lambda text: text.lower()
    want = {(p.part_id, n.doc_id) for p in parts.collect() for n in names.collect() if p.part is not None and n.name is not None and low(p.part) in low(n.name)}
    assert set(got) == want and len(got) == len(want)


def test_names_meet_parts_in_many_tasks(spark, monkeypatch):
    """Names are shuffled under the chosen pieces alone, and more names go to more tasks, not to larger ones."""
    monkeypatch.setattr(search, "MEETINGS", 100, raising=False)
    names = spark.createDataFrame([(n, f"{word} number {n}") for n in range(300) for word in ("ring", "bolt")], "doc_id long, name string").coalesce(1)
    parts = spark.createDataFrame([("a", "NUMBER"), ("b", "n"), ("c", "ring num"), ("d", "zzz"), ("e", "")], "part_id string, part string")
    found = search.names_containing(names, parts).select("part_id", "doc_id", "name", F.spark_partition_id().alias("task")).collect()
    want = [(p.part_id, n.doc_id, n.name) for p in parts.collect() for n in names.collect() if p.part.lower() in n.name.lower()]
    assert sorted(tuple(r)[:3] for r in found) == sorted(want)
    tasks = [r["task"] for r in found]
    assert len(set(tasks)) >= 12 and max(map(tasks.count, set(tasks))) < len(tasks) / 4


def test_reports_are_explained_once_per_machine(spark):
    """What is said of a report and a machine is the same for all its requests, and none of it is worked out per request."""
    rng = random.Random(11)
    names = ranking.NORM_COLUMNS
    kinds = [["nvidia", "rtx 3070"], ["amd", "rx 6800"], ["amd", None], [None, None]]
    norm = lambda: rng.choice(kinds) + [rng.choice([None, "a1b2c3", "unknown"]) for _ in names[2:]]
    shape = ", ".join(f"{name} string" for name in names)
    rows = [
        (rng.choice([1, 1, 2, 3, None]), "s", f"r{n}", [n], dt.datetime(2000, rng.randrange(1, 13), 2), rng.choice(["gold", "", None]),
         rng.choice(["%command%", "", None]), rng.choice(["x=1", None]), rng.choice(["yes", None]), *norm())
        for n in range(60)
    ]
    columns = "appid int, source_id string, source_report_id string, position array<int>, ts timestamp, rating string, launch_options string, notes string, verdict string"
    reports = spark.createDataFrame(rows, f"{columns}, {shape}")
    profiles = spark.createDataFrame([(p, *norm()) for p in range(5)] + [(5, *[None] * len(names))], f"profile_id long, {shape}")
    requests = spark.createDataFrame([(p, app) for p in range(6) for app in (1, 2, 9)], "profile_id long, appid int")
    now, keep, said = F.lit("2001-08-02").cast("timestamp"), ["launch_options"], ["matches", "mismatches", "unknowns", "similarity_summary", "reasons"]
    got = ranking.compare_explained(reports, requests, profiles, now, keep, lambda: said)
    key = ["profile_id", "appid", "source_report_id"]
    want = ranking.explain(ranking.compare(reports, requests, profiles, now, keep)).select(*key, *said)
    assert sorted(map(repr, got.select(*key, *said).collect())) == sorted(map(repr, want.collect()))
    assert want.count() == 6 * sum(r[0] in (1, 2) for r in rows)
    assert "recency" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_search_deals_out_frequent_words(spark, monkeypatch):
    """A word of all documents is counted by as many tasks as its number asks for."""
    monkeypatch.setattr(search, "HITS", 200)
    docs = spark.createDataFrame([(n, "ring " * (1 + n % 3) + f"n{n}") for n in range(1500)], "doc_id int, name string")
    queries = spark.createDataFrame([(f"q{n}", "RING") for n in range(3)] + [("one", "ring n7"), ("none", "bolt")], "query_id string, query string")
    got = search.search(docs, search.tokens(F.col("name")), queries)
    assert len([path for path in got.inputFiles() if "stored-" in path]) > 20
    rows = {}
    for row in got.collect():
        rows.setdefault(row["query_id"], []).append((row["rank"], row["doc_id"]))
    # a word of all documents has the least weight: scores are alike, and ids decide
    assert all([doc for _, doc in sorted(rows[q])] == list(range(20)) for q in ("q0", "q1", "q2"))
    assert rows["one"] == [(1, 7)] and set(rows) == {"q0", "q1", "q2", "one"}


def compared_tables(spark, rng):
    """Reports, requests and machines, some requests twice, most for one app."""
    names = ranking.NORM_COLUMNS
    norm = lambda: [rng.choice(["nvidia", "amd", None])] + [rng.choice([None, "a1b2c3"])] + [None] * (len(names) - 2)
    shape = ", ".join(f"{name} string" for name in names)
    rows = [
        (rng.choice([1, 1, 1, 2, 3, None]), "s", f"r{n % 30}", [n], dt.datetime(2000, rng.randrange(1, 13), 2), "gold", "", None, "yes", *norm())
        for n in range(80)
    ]
    columns = "appid int, source_id string, source_report_id string, position array<int>, ts timestamp, rating string, launch_options string, notes string, verdict string"
    reports = spark.createDataFrame(rows, f"{columns}, {shape}")
    profiles = spark.createDataFrame([(p, *norm()) for p in range(40)], f"profile_id long, {shape}")
    requests = [(p, 1) for p in range(40)] + [(p, app) for p in range(7) for app in (1, 2, 9)] + [(99, 1), (None, 1), (3, None)]
    return reports, spark.createDataFrame(requests, "profile_id long, appid int"), profiles, F.lit("2001-08-02").cast("timestamp")


def test_reports_meet_requests_in_blocks(spark, monkeypatch):
    """Blocks of requests give the rows that single requests give, by as many tasks as there are rows to make."""
    monkeypatch.setattr(ranking, "_BLOCK_BITS", 2)
    monkeypatch.setattr(ranking, "MEETINGS", 100)
    reports, requests, profiles, now = compared_tables(spark, random.Random(5))
    machines = ranking.asked(requests, profiles)
    rows = ranking.scored(reports, now, [])
    key = ["profile_id", "appid", "source_report_id", "position", "similarity", "score"]
    want = ranking.for_requests(ranking.compare_machines(rows, machines), machines).select(*key)
    got = ranking.compare(reports, requests, profiles, now, []).select(*key)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.rdd.getNumPartitions() >= want.count() // 100
    _, blocks = ranking.request_blocks(machines)
    sizes = [len(r["profiles"]) for r in blocks.collect()]
    assert max(sizes) <= 4 and sum(sizes) == machines.where("appid IS NOT NULL").count()
    # no likeness is worked out for a row that only meets it
    assert "round" not in ranking.alike(rows.select("appid", "hardware").distinct(), machines)._jdf.queryExecution().optimizedPlan().toString()
    assert ranking.compare(reports.limit(0), requests, profiles, now, []).collect() == []
    assert ranking.compare(reports, requests.limit(0), profiles, now, []).collect() == []


def test_compared_columns_are_made_once_per_machine(spark):
    """A column of compared reports is text before the requests meet it."""
    reports, requests, profiles, now = compared_tables(spark, random.Random(6))
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    got = ranking.compare(reports, requests, profiles, now, [], [day, "age_days"])
    want = ranking.compare(reports, requests, profiles, now, [])
    key = ["profile_id", "appid", "source_report_id", "position", "age_days"]
    assert sorted(map(repr, got.select(*key, "day").collect())) == sorted(map(repr, want.select(*key, day).collect()))
    for name in ("c5_profiles_against_reports", "b47_rank_score"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "date_format" not in plan and "hardware" not in plan


def test_ranked_reports_meet_requests_in_many_tasks(spark, monkeypatch):
    """Few reports of one score and many requests: as many tasks as there are rows to make, not as the reports fill."""
    monkeypatch.setattr(ranking, "_BLOCK_BITS", 2)
    monkeypatch.setattr(ranking, "MEETINGS", 100)
    reports, requests, profiles, now = compared_tables(spark, random.Random(7))
    machines = ranking.asked(requests, profiles)
    rows = ranking.scored(reports, now, [])
    got = ranking.rank_reports(rows, machines, keep=["appid"])
    key = ["profile_id", "appid", "source_report_id", "position", "score", "rank"]
    full = ranking.rank_reports(rows, machines)
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, full.select(*key).collect()))
    assert "hardware" in full.columns and "hardware" not in got.columns
    assert got.rdd.getNumPartitions() >= got.count() // 100 >= 10
    assert got.count() == ranking.for_requests(ranking.compare_machines(rows, machines), machines).count()


def test_best_reports_are_picked_once(spark):
    """The few reports of each cell are worked out once, though kinds of hardware are read from them too."""
    reports, requests, profiles, now = compared_tables(spark, random.Random(8))
    machines = ranking.asked(requests, profiles)
    rows = ranking.scored(reports, now, [])
    best = ranking.best_reports(rows, machines, 3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") <= 2 and "norm_gpu_vendor" not in plan.replace("machine", "")
    key = ["profile_id", "appid", "position", "rank"]
    want = ranking.rank_reports(rows, machines).where("rank <= 3").select(*key)
    assert sorted(map(repr, ranking.for_requests(best, machines).select(*key).collect())) == sorted(map(repr, want.collect()))


def test_nothing_is_stored_per_report_and_machine(spark, monkeypatch):
    """Reports meet blocks of requests of their kind; what is said of a report and a machine is written nowhere."""
    monkeypatch.setattr(ranking, "_BLOCK_BITS", 2)
    reports, requests, profiles, now = compared_tables(spark, random.Random(9))
    machines = ranking.asked(requests, profiles)
    made = ranking.compare_machines(ranking.asked_for(ranking.scored(reports, now, []), machines), machines).count()
    sizes, keep = [], ranking.stored

    def counted(df):
        table = keep(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(ranking, "stored", counted)
    text = F.concat_ws("|", "reasons").alias("text")
    got = ranking.compare_explained(reports, requests, profiles, now, ["launch_options"], lambda: ["similarity", "score", text])
    want = ranking.explain(ranking.compare(reports, requests, profiles, now, ["launch_options"]))
    key = ["profile_id", "appid", "source_report_id", "position", "similarity", "score"]
    assert sorted(map(repr, got.select(*key, "text").collect())) == sorted(map(repr, want.select(*key, text).collect()))
    assert max(sizes) < made / 2
    # blocks of an app and machine are full but for one
    askers, blocks = ranking.request_blocks(machines)
    sizes = {}
    for row in blocks.collect():
        sizes.setdefault(row["asker"], []).append(len(row["profiles"]))
    assert all(sorted(found)[1:] == [4] * (len(found) - 1) for found in sizes.values()) and len(sizes) == askers.where("appid IS NOT NULL").count()
