"""URL filters: rules indexed by their rarest literal token; only the rules a URL's tokens fetch run a regular expression.

A rule is a pattern. ``||host/path`` fits a host, its subdomains, and every path that starts so; any other pattern fits
anywhere in the URL, with ``*`` for any text. A *token* is a run of ASCII letters and digits, lower-cased. Every token
of a rule that has a literal neighbour on both sides is a whole token of each URL that it fits, so one of them is
enough to find the rule: the one that the fewest URLs of the corpus hold. Rules without such a token are tried on
every URL.

Host rules come first: of those that fit the longest decides (of equally long ones the alphabetically last). Without
one, a URL that a pattern rule fits is blocked, any other allowed. Equal URLs are judged once. A null URL, or one
without ``://``, has an empty host and path. Rows are never merged: each page gives one row, repeated ones too.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """What to do (``allow`` or ``block``) with URLs that a pattern fits."""

    action: str
    pattern: str

    @property
    def for_host(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    def regex(self) -> str:
        """For a host rule over host and path together, else over the whole URL."""
        literals = r"[\s\S]*".join(re.escape(part) for part in self.name.split("*"))
        return rf"^(?:[^/]*\.)?{literals}" if self.for_host else literals

    def tokens(self) -> list[str]:
        """Tokens that are whole in every URL the rule fits."""
        text = ("." if self.for_host else "*") + self.name + "*"
        found = re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9])", text)
        return sorted({m[0].lower() for m in found if "*" not in (text[m.start() - 1], text[m.end()])})


#: Rules for hosts and paths.
HOST_RULES = (
    Rule("allow", "||org/"),
    Rule("block", "||example.org/es/"),
    Rule("block", "||example.org/en/1"),
    Rule("allow", "||com/fr/"),
    Rule("block", "||com/de/"),
)
#: Pages that hold no text of their own: print views, logins, carts, reply forms, tracked and session links.
PATTERN_RULES = tuple(
    Rule("block", pattern)
    for pattern in (
        "/print/",
        "/wp-login.",
        "/cgi-bin/",
        "/cart/",
        "/tag/*/page/",
        "?replytocom=",
        "&ref=",
        "?sessionid=",
        "&sessionid=",
        "=session*sid=",
    )
)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lowered(host), path


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, and the empty one, under which rules without a token are kept."""
    runs = F.regexp_extract_all(lowered(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(runs, F.array(F.lit(""))))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.action, r.for_host, r.regex(), r.tokens() or [""]) for r in rules]
    return spark.createDataFrame(rows, "rule string, action string, for_host boolean, regex string, tokens array<string>")


def index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest token; ``tokens`` (token) has a row for each URL and token."""
    wanted = rules.select("rule", "for_host", F.explode("tokens").alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarity = wanted.join(counts, "token", "left").groupBy("rule", "for_host")
    best = rarity.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(best, ["rule", "for_host"]).select("rule", "action", "for_host", "regex", "best.token")


def candidates(urls: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pairs of a URL and a rule that one of its tokens fetches."""
    return urls.withColumn("token", F.explode("tokens")).join(indexed, "token")


def judged(pages: DataFrame, rules: tuple[Rule, ...], id: str = "page_id", url: str = "url") -> DataFrame:
    """Columns page_id, url, host, path, rule, verdict of every page."""
    stored = Stored(pages.sparkSession, "url-filter")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select("url").where("url IS NOT NULL").distinct().withColumn("tokens", url_tokens(F.col("url")))
    urls = urls.withColumn("site", F.concat(host, path))
    table = rule_table(pages.sparkSession, rules)
    indexed = stored.keep(index(table, urls.select(F.explode("tokens").alias("token"))), "index")
    subject = F.when(F.col("for_host"), F.col("site")).otherwise(F.col("url"))
    met = candidates(urls, indexed).where(F.rlike(subject, F.col("regex")))
    longest = F.max(F.when(F.col("for_host"), F.struct(F.length("rule").alias("n"), "rule", "action")))
    blocked = F.max(~F.col("for_host") & (F.col("action") == "block"))
    fitted = stored.keep(met.groupBy("url").agg(longest.alias("best"), blocked.alias("blocked")), "fitted")
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return rows.join(fitted, "url", "left").select(
        "page_id", "url", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the url of every page."""
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), HOST_RULES + PATTERN_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _sql_fits(rule: Rule) -> str:
    host, slash, path = rule.name.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}'))"


_BY_LENGTH = sorted(HOST_RULES, key=lambda rule: (-len(rule.name), rule.name))
_RULE_SQL = " ".join(f"WHEN {_sql_fits(rule)} THEN '{rule.name}'" for rule in _BY_LENGTH)
_ACTION_SQL = " ".join(f"WHEN rule = '{rule.name}' THEN '{rule.action}'" for rule in _BY_LENGTH)
_PATTERN_SQL = " OR ".join(f"url LIKE '%{rule.name.replace('_', '|_').replace('*', '%')}%' ESCAPE '|'" for rule in PATTERN_RULES)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*', 0) AS raw,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path, translate(raw, '{_UPPER}', '{_LOWER}') AS host
  FROM cut
), ruled AS (SELECT *, CASE {_RULE_SQL} END AS rule FROM split)
SELECT page_id, host, path, rule,
       CASE {_ACTION_SQL} WHEN {_PATTERN_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
