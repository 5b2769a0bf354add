"""URL filters against rules and terms tried one by one."""

import random

from gaugeworks.llm import urls

SCHEMA = "page_id long, url string, Host string, id int, verdict string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def model(url, rules=urls.RULES, strict=urls.STRICT, soft=urls.SOFT, limit=urls.SOFT_LIMIT):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, path = lower(rest[:cut]), rest[cut:]
        path = path[: min([len(path), *(path.index(c) for c in "?#" if c in path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    t = lower(url or "")
    word = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789" and c != ""
    hits = lambda k: sum(t.startswith(k, i) and not word(t[i - 1 : i]) and not word(t[i + len(k) : i + len(k) + 1]) for i in range(len(t)))
    n, few = sum(hits(k) for k in strict), sum(hits(k) > 0 for k in soft)
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else ("block" if n or few >= limit else "allow"), n, few


def test_random_urls(spark):
    rng = random.Random(4)
    hosts = ["example.org", "WWW.Example.ORG", "notexample.org", "org", "a.b.com", "com", "fr", "free-bets.net", "casino.net", "Acasino.net", "winwin.io", "win.bet.io", "x:80", "", ".org", "org.", "ü.org", "cheap.cheap.de"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/free", "/en/2", "/fr/x", "/de/y?free=win#bets", "#top/fr/", "?a://b.com/de/", "/FREE/Win", "//es/", "/casino_x/xxx.html", "/pills-Pills-pills", "/é/free/è"]
    rows = [(i, f"{rng.choice(['http', 'https', '', 'ftp'])}{rng.choice(['://', '://', '://', ':/', '://u@'])}{rng.choice(hosts)}{rng.choice(paths)}", "H", 1, "v") for i in range(900)]
    rows += [(2000, None, None, None, None), (2001, "", "", 0, ""), (2002, "://", "", 0, ""), (None, "http://a.com/de/", "", 0, ""), (2003, "http://" + "a." * 100_000 + "com/fr/" + "free-win/" * 50_000, "", 0, "")]
    rows += [rows[3]] * 3 + [(i, "http://hot.example.org/en/1", "", 0, "") for i in range(3000, 3300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, urls.judged(table).collect()), key=str)
    assert got == sorted([(r[0], *model(r[1])) for r in rows if r[0] != 2003] + [g for g in got if g[0] == 2003], key=str)
    assert [(g[3], g[4], g[5], g[6]) for g in got if g[0] == 2003] == [("com/fr/", "allow", 0, 2)]
    kept = urls.allowed(table)
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if r[0] == 2003 or model(r[1])[3] == "allow"], key=str)


def test_rules_and_terms_of_one_s_own(spark):
    rules = [("b.c", "/", "block"), ("c", "/long/path/", "allow"), ("b.c", "", "allow"), ("", "/x", "block")]
    words = {"strict": ("he", "she", "hers"), "soft": ("a-b", "b", "A"), "soft_limit": 3}
    rows = [(i, u, "", 0, "") for i, u in enumerate(["x://a.b.c/long/path/z", "x://b.c?q", "x:///x/y", "she", "ushers", "he she.hers", "a-b", "A/a-b", "b", "x://c/b/a-b"])]
    got = sorted(map(tuple, urls.judged(spark.createDataFrame(rows, SCHEMA), rules=rules, **words).collect()))
    assert got == [(i, *model(u, rules, ("he", "she", "hers"), ("a-b", "b", "a"), 3)) for i, u, *_ in rows]
    none = urls.judged(spark.createDataFrame(rows, SCHEMA), rules=(), strict=(), soft=())
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_empty_table(spark):
    assert urls.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert urls.allowed(spark.createDataFrame([], SCHEMA)).count() == 0
