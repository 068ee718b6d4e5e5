"""The wildcard automaton against regular expressions, pattern by pattern."""

import random
import re

from turnledger.llm import url_filter as U


def plain_pattern(glob):
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        c = glob[at]
        if c == "\\" and at + 1 < len(glob):
            at += 1
            c = re.escape(glob[at])
        else:
            c = {"*": "[^/?]*", "?": "[^/?]"}.get(c) or re.escape(c)
        out, at = out + c, at + 1
    return re.compile(out, re.S)


def test_many_patterns_at_once_fit_what_each_fits_alone():
    rng = random.Random(3)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randrange(n)))
    # Hundreds of positions, so that patterns lie across the words of the state.
    globs = [make(["a", "b", "/", "?", "*", "**", "\\*", "é", "."], 12) for _ in range(150)] + ["a" * 200 + "*"]
    urls = [make("ab/?*é.", 14) for _ in range(600)] + ["", "a" * 200, "a" * 300, "a" * 300 + "/"]
    found = U.Automaton(globs).first([u.encode() for u in urls])
    patterns = [plain_pattern(g) for g in globs]
    for u, got in zip(urls, found.tolist(), strict=True):
        assert got == next((i for i, p in enumerate(patterns) if p.fullmatch(u)), -1), u


def plain(url, rules, otherwise="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else otherwise


CASES = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/a", "http://m.example.org/es", "http://example.org",
    "http://example.org/", "http://example.org?q=/es/", "http://a.b?u=x.example.org/es/", "http://a.b#x.org/",
    "http://badexample.org/en/1", "http://example.org/en/12#en", "ftp://x.com/fr/?a#b", "http://x.com/de/", "http://COM/de/",
    "http://example.org/ES/", "http://a.b/http://c.org/", "://org/", "http://Ü.org/é", "http://x.org\n/y\nz", "http://o*.com/fr/",
    "http://x.com:80/de/", "http://u@x.com/de/", "http://net.com/xx", "http://x.com//de/", "http://org/" + "a/" * 50000,
]


def test_urls_of_all_kinds(spark):
    rng = random.Random(8)
    hosts = ["example.org", "M.example.org", "x.com", "com", "org", "a.net", "ads-track.example.com"]
    paths = ["", "/", "/es/1", "/en/1", "/en/2", "/fr/", "/de/9?x=/fr/", "#/de/", "/dé/?"]
    urls = CASES + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 250, u, "host", None) for i, u in enumerate(urls)], "page_id long, url string, rule string, id int")
    got = U.judged(pages, globs=())
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "by_glob"]
    expected = sorted(((i % 250, *plain(u, U.RULES)) for i, u in enumerate(urls)), key=repr)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected


def test_many_rules_and_empty_hosts_and_paths(spark):
    rng = random.Random(9)
    hosts = ["", "a", "b.a", "c.b.a", "a*", "b"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/x", "/x/y", "/?", "/*", "x", "#"])) for _ in range(80)]
    urls = [f"s://{rng.choice(['a', 'b.a', 'x.c.b.a', 'a*', 'q.a*', 'ba', ''])}{rng.choice(['', '/', '/x', '/xx', '/x/yz', '/*', '?x', '/?x'])}" for _ in range(300)] + [None, "a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judged(pages, rules, ()).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_globs_judge_what_no_rule_fits(spark):
    urls = ["http://m.ads-track.x.com/en/", "http://ads-track.x.com/en/", "http://ads-track.org/", "http://x.net/?u=/wp-login.php", "http://x.net/wp-login.ph"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"], r["by_glob"]) for r in U.judged(pages).orderBy("page_id").collect()]
    assert got == [(None, "block", True), (None, "block", True), ("org/", "allow", False), (None, "block", True), (None, "allow", False)]
    assert U.judged(pages.where("false")).collect() == []
