"""URL verdicts against every rule tried on every URL."""

import random
import re

from pyspark.sql import functions as F

from compatlake.llm import url_filter as uf

SHAPE = "page_id long, url string, rule string, tokens int"
RULES = uf.HOST_RULES + uf.PATTERN_RULES + (uf.Rule("block", "*q"), uf.Rule("block", "||sub.example.net/a*b/"))


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url):
    host, path = split(url)
    best, blocked = None, False
    for rule in RULES:
        if rule.for_host:
            own, _, start = rule.name.partition("/")
            fits = re.match("/" + re.escape(start).replace(r"\*", r"[\s\S]*"), path)
            if (host == own or host.endswith("." + own)) and fits and (not best or (len(rule.name), rule.name) > (len(best.name), best.name)):
                best = rule
        else:
            blocked |= bool(url is not None and re.search(re.escape(rule.name).replace(r"\*", r"[\s\S]*"), url))
    verdict = best.action if best else "block" if blocked else "allow"
    return host, path, best and best.name, verdict


def urls():
    dice = random.Random(4)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.b.Example.ORG", "badexample.org", "x.com", "com", "example.org:80", "org.net", "ÉX.org"]
    hosts += ["sub.example.net", "user@example.org", ""]
    paths = ["", "/", "/es/", "/es", "/ES/1", "/en/1", "/en/12?x", "/en/2", "/fr/1", "/de/1#top", "/print/", "?ref=&ref=", "/a/b/", "/aXXb/"]
    paths += ["/q", "/en/1/print/", "/tag/x/page/2", "/xprint/", "?sessionid=1", "/é?a&sessionid=2", "/wp-login.php", "#/es/", "/=sessionAsid="]
    found = [h and f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths]
    found += ["no scheme /es/", "://", "a://b://c/es/", "http://example.org/es/\n/x", "x" * 50_000, "http://x.com/fr/" + "a-" * 20_000, "", None]
    return found + [dice.choice(found) for _ in range(50)]


def test_against_brute_force(spark):
    rows = [(n if n % 9 else None, u, "x", 1) for n, u in enumerate(urls())]
    got = uf.judged(spark.createDataFrame(rows, SHAPE), RULES).collect()
    want = sorted([(i, u, *brute(u)) for i, u, *_ in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert len({r.rule for r in got}) > 5


def test_no_rows(spark):
    assert uf.judged(spark.createDataFrame([], SHAPE), RULES).collect() == []


def test_tokens():
    assert uf.Rule("block", "||example.org/en/1").tokens() == ["en", "example", "org"]
    assert uf.Rule("block", "&ref=").tokens() == ["ref"]
    assert uf.Rule("block", "/tag/*/page").tokens() == ["tag"]
    assert uf.Rule("block", "*q").tokens() == []


def test_rules_go_under_their_rarest_token(spark):
    rules = uf.rule_table(spark, (uf.Rule("block", "||example.org/en/1"), uf.Rule("allow", "||org/")))
    tokens = spark.createDataFrame([("org",)] * 5 + [("example",)] * 2 + [("en",)] * 3, "token string")
    found = {r.rule: r.token for r in uf.index(rules, tokens).collect()}
    assert found == {"example.org/en/1": "example", "org/": "org"}


def test_only_candidates_are_tried(spark):
    pages = spark.createDataFrame([(f"http://h{n}.net/x/{n}",) for n in range(50)], "url string")
    pages = pages.withColumn("tokens", uf.url_tokens(F.col("url")))
    rules = uf.rule_table(spark, uf.HOST_RULES).withColumn("token", F.element_at("tokens", 1)).drop("tokens")
    assert uf.candidates(pages, rules).count() == 0
