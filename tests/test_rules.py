"""Every phrase, known snippet, variable name and wrapper, against Python's own patterns."""

import re

from pyspark.sql import functions as F

from compatlake.functions import rules, snippets
from compatlake.operators import mining
from compatlake.plans import recommend

# One text for each phrase, in the order of the rules.
SAYINGS = [
    "use Proton Experimental", "Use GE-Proton9-4", "switch the compatibility tool to Proton 9", "use  Proton 8.0", "disabling the intro video",
    "skip intro videos", "skip the intro", "disable launcher", "run in windowed mode", "force to window mode", "disabling fullscreen",
    "disable Steam input", "use the native Linux version", "install protontricks", "anti-cheat", "EAC support", "Black  screen", "white screen",
    "screen flickering", "no sound", "audio crackling", "controller not work", "it freezes during play", "crashes to desktop", "no tweak required",
    "runs flawlessly",
]
NAMES = [
    "PROTON_X", "DXVK_X", "VKD3D_X", "RADV_X", "MESA_X", "WINEX", "__GL_X", "NVIDIA_X", "AMD_X", "SDL_X", "WINEDLLOVERRIDES", "MANGOHUD",
    "ENABLE_VKBASALT", "PULSE_LATENCY_MSEC", "DXVK_FRAME_RATE", "DXVK_HDR", "ENABLE_HDR_WSI", "MANGOHUD_CONFIG", "LD_PRELOAD",
]


def canonical(text):
    return re.sub(r"\s+", " ", text).strip().lower()


def test_every_phrase_variable_and_wrapper(spark):
    texts = [*SAYINGS, "nothing here", *(f"set {name}=1 and {name.lower()}=two;" for name in NAMES), *(f"try {w.upper()} now" for w in rules.WRAPPERS)]
    expected, reached = set(), set()
    for text in texts:
        for number, (kind, regexp) in enumerate(rules.PHRASES):
            found = re.search(regexp, text + " ", re.I)
            if found:
                reached.add(number)
                expected.add((text, kind, canonical(found.group())))
        expected |= {(text, "env_var", canonical(m.group())) for m in re.finditer(rules.ENV_IN_TEXT, text, re.I)}
        expected |= {(text, "wrapper", name) for name in rules.WRAPPERS if name in text.lower()}
    assert reached == set(range(len(rules.PHRASES)))
    reports = spark.createDataFrame(
        [(n, "s", text, text, "") for n, text in enumerate(texts)], "appid int, source_id string, source_report_id string, notes string, launch_options string"
    ).withColumn("ts", F.lit("2001-01-01").cast("timestamp"))
    got = {(r.source_key[2:], r.kind, r.canonical) for r in mining.mine(reports).collect()}
    assert got == expected
    assert {text for text, kind, _ in got if kind == "wrapper"} >= {f"try {w.upper()} now" for w in rules.WRAPPERS}
    assert sum(kind == "env_var" for _, kind, _ in got) >= 2 * len(NAMES) - 8  # in prefixes of lower case too


def test_every_known_snippet(spark):
    cores = [regexp.replace(".*", " the ") for regexp, *_ in rules.KNOWN_SNIPPETS]
    cores += [f"x {core} y" for core in cores] + ["", "proton_own_flag=1", "mesa_loader=zink", "unknown words"]
    rows = spark.createDataFrame([(core.upper(),) for core in cores], "snippet string")
    reached = set()
    for row in snippets.with_meta(rows, F.col("snippet")).collect():
        core = row.snippet.lower().strip()
        matching = [n for n, (regexp, *_) in enumerate(rules.KNOWN_SNIPPETS) if re.search(regexp, core, re.I)] if core else []
        if matching:
            reached.add(matching[0])
            assert (row.label, row.description, row.category) == rules.KNOWN_SNIPPETS[matching[0]][1:], core
        else:
            label = {"": "Unknown option", "proton_own_flag=1": "own flag", "mesa_loader=zink": "loader"}.get(core, "")
            assert (row.label, row.description, row.category) == (label, "", "")
    assert reached == set(range(len(rules.KNOWN_SNIPPETS)))


def test_a_reports_text_is_scanned_once(spark):
    """Reports with one text get the same candidates, however many they are; texts without any meet nothing."""
    rows = [(1, "s", f"r{n}", "skip the intro", "gamemoderun %command%") for n in range(500)] + [(2, "s", "x", None, None), (2, "s", "y", "", " ")]
    reports = spark.createDataFrame(rows, "appid int, source_id string, source_report_id string, notes string, launch_options string")
    found = mining.mine(reports.withColumn("ts", F.lit("2001-01-01").cast("timestamp"))).collect()
    each = {}
    for row in found:
        each.setdefault(row.source_key, set()).add((row.kind, row.canonical))
    assert len(each) == 500 and len({frozenset(v) for v in each.values()}) == 1
    assert each["s:r7"] == {("launch_option", "gamemoderun %command%"), ("workaround", "skip the intro"), ("launch_option", "skip the intro gamemoderun %command%"), ("wrapper", "gamemoderun")}


def test_citations_are_cut(spark):
    long = "é" * 300
    row = spark.createDataFrame([(long, "gold")], "notes string, rating string")
    assert recommend.citable(row).first()["snippet"] == "é" * 180
