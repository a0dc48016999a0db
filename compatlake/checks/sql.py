"""Pieces of checking SQL, each written from the rules' meaning rather than from the Spark code."""

from __future__ import annotations

from ..functions import rules
from ..schemas import COMPARED_FIELDS
from .adapter import NOW_TEXT, oracle_views

NOW = f"TIMESTAMP '{NOW_TEXT}'"
COMMAND = rules.COMMAND


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def query(body: str, *views: str, ctes: str = "") -> str:
    """A query over adapter views and further common table expressions."""
    parts = [part for part in (oracle_views(*views) if views else "", ctes) if part]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def simplify(x: str) -> str:
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def r3(x: str) -> str:
    return f"(round(({x}) * 1000e0) / 1000e0)"


# --- hardware -----------------------------------------------------------------------------------


def gpu_vendor(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), 'nvidia|geforce|rtx|gtx') THEN 'nvidia' "
        f"WHEN regexp_matches(lower({x}), 'advanced micro devices|amd|radeon|radv') THEN 'amd' "
        f"WHEN regexp_matches(lower({x}), 'intel|arc|iris|uhd graphics') THEN 'intel' ELSE 'unknown' END"
    )


def gpu_vendor_label(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), 'nvidia|geforce|rtx|gtx') THEN 'NVIDIA' "
        f"WHEN regexp_matches(lower({x}), 'amd|radeon|radv') THEN 'AMD' "
        f"WHEN regexp_matches(lower({x}), 'intel|arc') THEN 'Intel' ELSE '' END"
    )


def gpu_model(x: str) -> str:
    bracket = rf"CASE WHEN regexp_matches({x}, '\[[^\]]*\]') THEN regexp_extract({x}, '\[([^\]]*)\]', 1) ELSE {x} END"
    bare = rf"lower(regexp_replace({bracket}, '\(.*$', ''))"
    noise = (
        r"nvidia corporation|nvidia|advanced micro devices, inc\.|advanced micro devices|amd/ati|amd"
        r"|ati technologies inc\.|intel corporation|intel|\[|\]|,"
    )
    return simplify(f"regexp_replace({bare}, '{noise}', ' ', 'g')")


def cpu_vendor(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), 'amd|ryzen|epyc') THEN 'amd' "
        rf"WHEN regexp_matches(lower({x}), 'intel|core\(tm\)|core i|xeon') THEN 'intel' "
        f"WHEN contains(lower({x}), 'apple') THEN 'apple' ELSE 'unknown' END"
    )


def cpu_class(x: str) -> str:
    classes = ["ryzen 9", "ryzen 7", "ryzen 5", "ryzen 3", "threadripper", "epyc", "core ultra"]
    cases = [f"WHEN contains(lower({x}), '{c}') THEN '{c}'" for c in classes]
    cases += [f"WHEN regexp_matches(lower({x}), 'core i{n}|i{n}-') THEN 'core i{n}'" for n in (9, 7, 5, 3)]
    return "CASE " + " ".join(cases) + f" WHEN contains(lower({x}), 'xeon') THEN 'xeon' ELSE 'unknown' END"


def ram_bucket(x: str) -> str:
    return (
        f"CASE WHEN {x} <= 0 THEN 'unknown' WHEN {x} < 8 THEN '<8' WHEN {x} < 16 THEN '8-15' "
        f"WHEN {x} < 32 THEN '16-31' ELSE '32+' END"
    )


def distro_family(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), 'arch|manjaro|endeavour|steamos') THEN 'arch' "
        f"WHEN regexp_matches(lower({x}), 'fedora|nobara|bazzite|ublue') THEN 'fedora' "
        f"WHEN regexp_matches(lower({x}), 'ubuntu|pop!_os|pop os|mint|neon') THEN 'ubuntu' "
        f"WHEN contains(lower({x}), 'debian') THEN 'debian' ELSE 'unknown' END"
    )


def session_type(x: str) -> str:
    return (
        f"CASE WHEN contains(lower({x}), 'wayland') THEN 'wayland' "
        f"WHEN regexp_matches(lower({x}), 'x11|xorg') THEN 'x11' ELSE 'unknown' END"
    )


def major_minor(x: str) -> str:
    return rf"regexp_extract({x}, '\d+\.\d+')"


RAM_GB = (
    "CAST(CASE k % 6 WHEN 0 THEN 32 WHEN 1 THEN 16 WHEN 2 THEN 8 WHEN 3 THEN 7.7 ELSE 0 END AS DOUBLE)"
)


def norms(gpu: str, model: str, driver: str, cpu: str, ram: str, distro: str, kernel: str, session: str) -> str:
    """The nine categories as select items."""
    made = {
        "norm_gpu_vendor": gpu_vendor(gpu),
        "norm_gpu_model": gpu_model(model),
        "norm_gpu_driver": major_minor(driver),
        "norm_distro_family": distro_family(distro),
        "norm_kernel": major_minor(kernel),
        "norm_ram_bucket": ram_bucket(ram),
        "norm_session_type": session_type(session),
        "norm_cpu_vendor": cpu_vendor(cpu),
        "norm_cpu_class": cpu_class(cpu),
    }
    return ", ".join(f"{sql} AS {name}" for name, sql in made.items())


REPORT_NORMS = norms("gpu_model", "gpu_model", "gpu_driver", "cpu", RAM_GB, "distro", "kernel", "desktop")
PROFILE_NORMS = norms(
    "gpu_vendor || ' ' || gpu_model",
    "gpu_model",
    "gpu_driver",
    "cpu",
    "ram_gb",
    "distro",
    "kernel",
    "CASE WHEN session_type = '' THEN desktop ELSE session_type END",
)


# --- scores -------------------------------------------------------------------------------------

AGE = f"((epoch_ms({NOW}) - epoch_ms(ts)) / 86400000e0)"
AGE_DAYS = f"greatest(0, CAST(trunc({AGE}) AS BIGINT))"
RECENCY = (
    f"CASE WHEN {AGE} <= 30 THEN 1e0 WHEN {AGE} <= 90 THEN {r3(f'0.95e0 - (({AGE} - 30e0) / 60e0) * 0.10e0')} "
    f"WHEN {AGE} < 365 THEN {r3(f'0.75e0 - (({AGE} - 90e0) / 275e0) * 0.35e0')} "
    f"WHEN {AGE} < 730 THEN {r3(f'0.24e0 - (({AGE} - 365e0) / 365e0) * 0.12e0')} ELSE 0.05e0 END"
)
FRESHNESS = (
    f"CASE WHEN {AGE_DAYS} < 90 THEN 'fresh' WHEN {AGE_DAYS} < 365 THEN 'recent' "
    f"WHEN {AGE_DAYS} < 730 THEN 'stale' ELSE 'historical' END"
)
QUALITY = r3(
    "least(1e0, CASE rating WHEN 'platinum' THEN 0.95e0 WHEN 'gold' THEN 0.85e0 WHEN 'silver' THEN 0.65e0 "
    "WHEN 'bronze' THEN 0.45e0 WHEN 'borked' THEN 0.20e0 ELSE 0.45e0 END "
    "+ CASE WHEN trim(launch_options) <> '' OR contains(lower(notes), '%command%') "
    r"OR regexp_matches(notes, '\b[A-Z_][A-Z0-9_]{2,}=') "
    r"OR regexp_matches(lower(notes), '\b(gamemoderun|mangohud|gamescope|prime-run|obs-gamecapture)\b') "
    "THEN 0.08e0 ELSE 0e0 END + CASE WHEN trim(verdict) <> '' THEN 0.03e0 ELSE 0e0 END)"
)


def _cmp(x: str) -> str:
    return f"nullif(nullif(lower(trim({x})), ''), 'unknown')"


def _match(u: str, r: str, partial: bool) -> str:
    part = (
        f" WHEN length({u}) >= 4 AND length({r}) >= 4 AND (contains({u}, {r}) OR contains({r}, {u})) THEN 0.7e0"
        if partial
        else ""
    )
    return f"CASE WHEN {u} IS NULL OR {r} IS NULL THEN NULL WHEN {u} = {r} THEN 1e0{part} ELSE 0e0 END"


#: Requests with both sides' categories compared: one m_<field> per field, NULL where one side is unknown.
COMPARED_CTES = (
    f"rn AS (SELECT *, {REPORT_NORMS} FROM reports), pn AS (SELECT profile_id, {PROFILE_NORMS} FROM profiles), "
    "pairs AS (SELECT q.profile_id, r.*, "
    + ", ".join(f"{_cmp('p.' + c)} AS u_{c}, {_cmp('r.' + c)} AS r_{c}" for c, _, _, _ in COMPARED_FIELDS)
    + " FROM requests q JOIN pn p USING (profile_id) JOIN rn r USING (appid)), "
    "matched AS (SELECT *, "
    + ", ".join(f"{_match('u_' + c, 'r_' + c, partial)} AS m_{c}" for c, _, _, partial in COMPARED_FIELDS)
    + " FROM pairs), weighed AS (SELECT *, "
    + " + ".join(f"coalesce({w}e0 * m_{c}, 0e0)" for c, _, w, _ in COMPARED_FIELDS)
    + " AS got, "
    + " + ".join(f"CASE WHEN m_{c} IS NULL THEN 0e0 ELSE {w}e0 END" for c, _, w, _ in COMPARED_FIELDS)
    + " AS possible FROM matched), "
    f"compared AS (SELECT *, CASE WHEN possible = 0 THEN 0.5e0 ELSE {r3('got / possible')} END AS similarity, "
    f"{RECENCY} AS recency, {QUALITY} AS quality, {FRESHNESS} AS freshness, {AGE_DAYS} AS age_days FROM weighed), "
    f"scored AS (SELECT *, {r3('recency * 0.72e0 + similarity * 0.20e0 + quality * 0.08e0')} AS score FROM compared), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id, appid ORDER BY score DESC, ts DESC, "
    "source_report_id) AS rank FROM scored)"
)
COMPARED_VIEWS = ("reports", "profiles", "requests")


def similarity_list(kind: str) -> str:
    """Matches, mismatches or unknowns as a list without NULLs."""
    items = []
    for column, name, _, _ in COMPARED_FIELDS:
        low, u, r, m = name.lower(), f"u_{column}", f"r_{column}", f"m_{column}"
        items.append(
            {
                "matches": f"CASE WHEN {m} > 0 THEN '{low} ' || {r} END",
                "mismatches": f"CASE WHEN {m} = 0 THEN '{low} user=' || {u} || ' report=' || {r} END",
                "unknowns": f"CASE WHEN {u} IS NULL AND {r} IS NULL THEN '{name} unknown for user and report' "
                f"WHEN {u} IS NULL THEN '{name} unknown for user' WHEN {r} IS NULL THEN '{name} unknown for report' END",
            }[kind]
        )
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def limited(items: str, n: int) -> str:
    more = f"CASE WHEN len({items}) > {n} THEN ', ' || (len({items}) - {n}) || ' more' ELSE '' END"
    return f"array_to_string({items}[1:{n}], ', ') || {more}"


# --- windows ------------------------------------------------------------------------------------


def in_days(days: int) -> str:
    return f"CAST(ts AS DATE) >= CAST({NOW} AS DATE) - {days}"


RATES_CTES = (
    f"w AS (SELECT appid, '90 days' AS \"window\", 1 AS turn, verdict FROM reports WHERE {in_days(90)} "
    f"UNION ALL SELECT appid, '365 days', 2, verdict FROM reports WHERE {in_days(365)} "
    "UNION ALL SELECT appid, 'all time', 3, verdict FROM reports), "
    "t AS (SELECT appid, \"window\", turn, count(*) AS total, count(*) FILTER (verdict = 'yes') AS yes FROM w GROUP BY ALL), "
    "rates AS (SELECT * FROM t WHERE total >= 5 OR turn = 3 QUALIFY row_number() OVER (PARTITION BY appid ORDER BY turn) = 1), "
    "badged AS (SELECT *, CAST(yes * 100 // total AS INT) AS percent FROM rates)"
)
BADGE = (
    "CASE WHEN total < 5 THEN 'Few reports' WHEN percent >= 95 THEN 'Excellent' WHEN percent >= 85 THEN 'Good' "
    "WHEN percent >= 70 THEN 'Playable' WHEN percent >= 50 THEN 'Issues' ELSE 'Borked' END"
)
RUNTIME = (
    "CASE WHEN shape = 1 AND trim(variant) <> '' THEN trim(variant) WHEN trim(proton_version) <> '' THEN trim(proton_version) "
    "WHEN shape = 4 THEN 'native' ELSE '' END"
)


def runtime_label(x: str) -> str:
    low = f"lower(trim({x}))"
    title = (
        f"array_to_string([upper(w[1]) || w[2:] for w in string_split(trim({x}), ' ') if w <> ''], ' ')"
    )
    return (
        f"CASE {low} WHEN 'native' THEN 'Native' WHEN 'official' THEN 'Official Proton' WHEN 'official proton' THEN 'Official Proton' "
        f"WHEN 'experimental' THEN 'Proton Experimental' WHEN 'proton experimental' THEN 'Proton Experimental' "
        f"WHEN 'ge' THEN 'Proton-GE' WHEN 'proton ge' THEN 'Proton-GE' WHEN 'proton-ge' THEN 'Proton-GE' "
        f"WHEN 'proton-cachyos' THEN 'Proton-CachyOS' WHEN '' THEN {x} ELSE {title} END"
    )


RUNTIME_CTES = (
    f"y AS (SELECT *, {RUNTIME} AS runtime FROM reports WHERE verdict = 'yes'), "
    f"rw AS (SELECT *, '90 days' AS \"window\", 1 AS turn FROM y WHERE {in_days(90)} "
    f"UNION ALL SELECT *, '365 days', 2 FROM y WHERE {in_days(365)} UNION ALL SELECT *, 'all time', 3 FROM y), "
    "placed AS (SELECT *, lower(trim(runtime)) AS key, lower(trim(runtime)) NOT IN ('', 'none', 'n/a', 'unknown', 'default') AS named, "
    "row_number() OVER (PARTITION BY appid, turn ORDER BY ts DESC, source_report_id DESC) AS place FROM rw), "
    "sizes AS (SELECT appid, turn, \"window\", count(*) AS total, count(*) FILTER (named) AS clean FROM placed GROUP BY ALL), "
    "picked AS (SELECT * FROM sizes WHERE clean >= 5 OR turn = 3 QUALIFY row_number() OVER (PARTITION BY appid ORDER BY turn) = 1), "
    "freq AS (SELECT appid, turn, key, count(*) AS n, min(place) AS place FROM placed WHERE named GROUP BY ALL), "
    "mode AS (SELECT p.*, f.key, f.n, f.place FROM picked p JOIN freq f USING (appid, turn) "
    "QUALIFY row_number() OVER (PARTITION BY appid ORDER BY n DESC, key) = 1), "
    "common AS (SELECT m.appid, "
    + runtime_label("coalesce(CASE WHEN m.place <= 50 THEN s.runtime END, m.key)")
    + " AS value, m.key AS raw_value, m.n AS \"count\", m.total, m.\"window\" FROM mode m "
    "LEFT JOIN placed s ON s.appid = m.appid AND s.turn = m.turn AND s.place = m.place)"
)


# --- mining -------------------------------------------------------------------------------------


def canonical(x: str) -> str:
    return f"lower({simplify(x)})"


def _phrases() -> str:
    return " UNION ALL ".join(
        f"SELECT k, '{kind}' AS kind, {canonical(f'''regexp_extract(txt, {text(regexp)}, 0, 'i')''')} AS canonical "
        f"FROM txts WHERE regexp_matches(txt, {text(regexp)}, 'i')"
        for kind, regexp in rules.PHRASES
    )


OPTION_SQL = f"SELECT k, 'launch_option' AS kind, {canonical('launch_options')} AS canonical FROM txts WHERE launch_options <> ''"
PHRASE_SQL = _phrases()
LINE_SQL = (
    "SELECT k, 'launch_option' AS kind, line AS canonical FROM (SELECT k, lower(trim(list_filter(string_split(txt, chr(10)), "
    "lambda l: contains(lower(l), '%command%'))[1])) AS line FROM txts) WHERE length(line) > 5 AND NOT contains(line, 'verdict:') "
    "AND NOT contains(line, 'windowingfaults:') AND NOT contains(line, 'stabilityfaults:') AND NOT contains(line, 'performancefaults:')"
)
ENV_SQL = (
    f"SELECT k, 'env_var' AS kind, {canonical('m')} AS canonical FROM (SELECT k, unnest(regexp_extract_all(txt, "
    f"{text(rules.ENV_IN_TEXT)}, 0, 'i')) AS m FROM txts)"
)
WRAPPER_SQL = (
    "SELECT k, 'wrapper' AS kind, w AS canonical FROM txts, (SELECT unnest(["
    + ", ".join(text(w) for w in rules.WRAPPERS)
    + "]) AS w) WHERE contains(lower(txt), w)"
)
TEXT_CTE = "txts AS (SELECT *, notes || ' ' || launch_options AS txt FROM reports)"
CANDIDATE_CTES = (
    f"{TEXT_CTE}, cand AS ({OPTION_SQL} UNION ALL {PHRASE_SQL} UNION ALL {LINE_SQL} UNION ALL {ENV_SQL} UNION ALL {WRAPPER_SQL}), "
    f"cands AS (SELECT DISTINCT r.appid, r.source_id || ':' || r.source_report_id AS source_key, r.ts, r.k, "
    f"{RECENCY} AS recency, c.kind, c.canonical FROM cand c JOIN reports r ON r.k = c.k)"
)


def core(x: str) -> str:
    low = f"lower({trim(x)})"
    at = f"strpos({low}, '{COMMAND}')"
    before = trim(f"substr({low}, 1, {at} - 1)")
    after = trim(f"substr({low}, {at} + 9)")
    return f"CASE WHEN {at} = 0 THEN {low} WHEN {before} <> '' THEN {before} ELSE {after} END"


def _meta(part: int, unknown: str, fallback: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(core, {text(rule[0])}, 'i') THEN {text(rule[part])}" for rule in rules.KNOWN_SNIPPETS
    )
    return f"CASE WHEN core = '' THEN {text(unknown)} {cases} ELSE {fallback} END"


def env_label(x: str) -> str:
    name = f"upper(split_part({x}, '=', 1))"
    for prefix in rules.ENV_LABEL_PREFIXES:
        name = f"regexp_replace({name}, '^{prefix}', '')"
    return f"lower(trim(replace({name}, '_', ' ')))"


META = (
    _meta(1, "Unknown option", f"CASE WHEN contains(core, '=') THEN {env_label('core')} ELSE '' END")
    + " AS label, "
    + _meta(2, "", "''")
    + " AS description, "
    + _meta(3, "", "''")
    + " AS category"
)
CONFIDENCE = (
    "CASE WHEN conf >= 0.65e0 THEN 'high' WHEN conf >= 0.35e0 THEN 'medium' ELSE 'low' END"
)


def conf(occurrences: str, similarity: str, recency: str) -> str:
    return (
        f"(CASE WHEN {occurrences} >= 7 THEN 0.4e0 WHEN {occurrences} >= 3 THEN 0.25e0 ELSE 0.1e0 END "
        f"+ {similarity} * 0.3e0 + {recency} * 0.3e0)"
    )


def suggestion_id(kind: str, snippet: str) -> str:
    return f"substr({kind}, 1, 5) || '-' || substr(sha1({kind} || {snippet}), 1, 8)"


#: Candidates counted per request, scored and labelled, then merged and ordered.
SUGGESTION_CTES = (
    f"{CANDIDATE_CTES}, {COMPARED_CTES}, "
    "counted AS (SELECT s.profile_id, c.appid, c.kind, c.canonical, count(DISTINCT c.source_key) AS occurrences, "
    "max(s.similarity) AS similarity, max(c.recency) AS recency FROM cands c JOIN compared s ON s.k = c.k GROUP BY ALL), "
    f"confident AS (SELECT *, {conf('occurrences', 'similarity', 'recency')} AS conf, {core('canonical')} AS core FROM counted), "
    f"labelled AS (SELECT *, {CONFIDENCE} AS confidence, {META}, {suggestion_id('kind', 'canonical')} AS id FROM confident), "
    "worth AS (SELECT *, CASE WHEN label = '' THEN canonical ELSE label END AS key FROM labelled WHERE label <> '' OR kind = 'launch_option'), "
    "grouped AS (SELECT profile_id, appid, key, count(*) AS members, CAST(sum(occurrences) AS BIGINT) AS occurrences, "
    "max(similarity) AS similarity, max(recency) AS recency, "
    "arg_min({'id': id, 'kind': kind, 'label': label, 'description': description, 'category': category, 'confidence': confidence}, "
    "{'kind': kind, 'canonical': canonical}) AS head, "
    "list_reduce(list(canonical ORDER BY kind, canonical), lambda a, b: CASE WHEN (contains(a, '%command%') AND NOT contains(b, '%command%')) "
    "OR length(b) < length(a) THEN b ELSE a END) AS snippet FROM worth GROUP BY ALL), "
    "merged AS (SELECT profile_id, appid, head.id AS id, head.kind AS kind, snippet, head.label AS label, head.description AS description, "
    "head.category AS category, occurrences, similarity, recency, CASE WHEN members > 1 AND occurrences >= 7 THEN 'high' "
    "WHEN members > 1 AND occurrences >= 3 AND head.confidence = 'low' THEN 'medium' ELSE head.confidence END AS confidence FROM grouped), "
    "suggested AS (SELECT *, row_number() OVER (PARTITION BY profile_id, appid ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 "
    "ELSE 1 END DESC, occurrences DESC, recency DESC, similarity DESC, id) AS rank FROM merged), "
    "shown AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY profile_id, appid ORDER BY rank) AS rank FROM suggested "
    "WHERE kind NOT IN ('diagnostic', 'note') AND (label <> '' OR kind = 'launch_option')) WHERE rank <= 15)"
)


# --- launch lines -------------------------------------------------------------------------------


def is_env(x: str) -> str:
    prefixes = "|".join(f"{p}[^=]*" for p in rules.ENV_PREFIXES)
    names = "|".join(rules.ENV_NAMES)
    return f"regexp_matches({x}, '^({prefixes}|{names})=', 'i')"


def is_wrapper(x: str) -> str:
    return f"lower({x}) IN ({', '.join(text(w) for w in rules.WRAPPERS)})"


def is_dangerous(x: str) -> str:
    words = "|".join(rules.DANGEROUS_WORDS)
    return (
        f"(regexp_matches(lower(trim({x})), '(^| )({words})') OR regexp_matches({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') "
        f"OR contains({x}, '$(') OR contains({x}, '`') OR contains({x}, '&&') OR contains({x}, '||') OR contains({x}, ';|'))"
    )


def unquoted(x: str) -> str:
    t = trim(x)
    return rf"""CASE WHEN regexp_matches({t}, '^(".*"|''.*'')$') AND length({t}) >= 2 THEN substr({t}, 2, length({t}) - 2) ELSE {t} END"""


def _side(x: str, side: int) -> str:
    at = f"strpos(lower({x}), '{COMMAND}')"
    return trim(f"substr({x}, 1, {at} - 1)") if side == 0 else trim(f"substr({x}, {at} + 9)")


def _pieces(x: str, side: int) -> str:
    return f"list_filter(string_split({_side(x, side)}, ' '), lambda p: p <> '')"


def _token_rows(source: str, x: str, pos: str, leading: str) -> str:
    marked = f"contains(lower({x}), '{COMMAND}')"
    parts = [
        f"SELECT line_id, {pos} AS pos, {side} AS section, unnest(generate_series(0, len({_pieces(x, side)}) - 1)) AS place, "
        f"unnest({_pieces(x, side)}) AS token FROM {source} WHERE {marked} AND len({_pieces(x, side)}) > 0"
        for side in (0, 1)
    ]
    parts.append(
        f"SELECT line_id, {pos} AS pos, CASE WHEN {leading} THEN 0 ELSE 1 END AS section, 0 AS place, {x} AS token "
        f"FROM {source} WHERE NOT {marked} AND {x} <> ''"
    )
    return " UNION ALL ".join(parts)


LINE_CTES = (
    f"base AS (SELECT line_id, {trim('existing')} AS existing FROM lines), "
    f"fate AS (SELECT *, kind IN ('launch_option', 'env_var', 'wrapper') AS copyable, {is_dangerous('snippet')} AS danger FROM selected), "
    "used AS (SELECT * FROM fate WHERE copyable AND NOT danger), "
    f"alltokens AS ({_token_rows('base', 'existing', '-1', 'false')} UNION ALL "
    # an empty chosen snippet is an (empty) game argument
    f"{_token_rows('used', 'snippet', 'pos', is_env('snippet') + ' OR ' + is_wrapper('snippet'))} "
    "UNION ALL SELECT line_id, pos, 1, 0, snippet FROM used WHERE snippet = ''), "
    f"tokens AS (SELECT line_id, section, pos, place, token, section = 0 AND {is_env('token')} AS env FROM alltokens "
    f"QUALIFY row_number() OVER (PARTITION BY line_id, lower({unquoted('token')}) ORDER BY section, pos, place) = 1), "
    r"clash AS (SELECT line_id, name, 'Conflicting ' || name || ': ' || string_agg(value, ', ' ORDER BY value) AS conflict FROM "
    r"(SELECT DISTINCT line_id, upper(trim(split_part(token, '=', 1))) AS name, trim(substr(token, strpos(token, '=') + 1)) AS value "
    "FROM tokens WHERE env AND strpos(token, '=') < length(token)) GROUP BY line_id, name HAVING count(*) > 1), "
    "preview AS (SELECT line_id, string_agg(token, ' ' ORDER BY part, pos, place) AS preview FROM (SELECT line_id, CASE WHEN env THEN 0 "
    "WHEN section = 0 THEN 1 ELSE 3 END AS part, pos, place, token FROM tokens UNION ALL SELECT line_id, 2, 0, 0, '%command%' FROM base) "
    "GROUP BY line_id)"
)
