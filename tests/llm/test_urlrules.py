import itertools
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, urlrules

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return (lower(found[1]), found[2]) if found else ("", "")


def brute(url):
    host, path = parts(url)
    best = None
    for rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


URLS = [
    "https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org", "http://badexample.org/es/1", "https://x.com/fr/1", "https://x.com/de/1", "https://com/de/",
    "no scheme", "", None, "ftp://h?x=/de/", "x://a://b/c", "http://u@x.com:80/de/", "//com/de/", "https://x.com/DE/", "http://org/", "a://org#/",
]


def test_hosts_paths_and_hand_rules(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in urlrules.judged(pages, labels).collect():
        assert (r.host, r.path, r.rule) == brute(URLS[r.id])
        assert r.verdict == RULES.get(r.rule, "allow")


def test_query_over_the_whole_table(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op4_urlrules(spark, sf).collect()
    assert sorted(r.page_id for r in out) == sorted(urls)
    assert all((r.host, r.path, r.rule) == brute(urls[r.page_id]) and r.verdict == RULES.get(r.rule, r.verdict) for r in out)


def labelled():
    rows = []
    for k in range(200):
        good = k % 5 > 0
        word = "news" if good else "casino"
        rows.append((k, f"http://{word}.site{k % 7}.net/{'promo' if k % 10 == 0 else 'a'}/{'win' if not good else 'read'}", good))
    rows += [(200 + k, f"http://win.site.net/read/{k}", True) for k in range(30)]  # win alone is no sign
    return rows


@pytest.fixture(scope="module")
def mined(spark):
    df = spark.createDataFrame([(u, not g) for _, u, g in labelled()], "url string, bad boolean")
    return df, {(tuple(sorted(r.antecedent)), tuple(r["keys"]), round(r.confidence, 9), round(r.support, 9)) for r in urlrules.mine(df, min_count=10, min_support=0.0).collect()}


def test_mined_rules_against_counting(spark, mined):
    df, found = mined
    rows = [(frozenset(r.t), r.bad) for r in df.select(urlrules.tokens(df.url).alias("t"), "bad").collect()]
    share = sum(b for _, b in rows) / len(rows)
    where = {t: frozenset(k for k, (s, _) in enumerate(rows) if t in s) for s, _ in rows for t in s}
    classes = {}
    for t in sorted(where):
        classes.setdefault(where[t], []).append(t)
    freq = {c[0]: len(at) for at, c in classes.items()}
    whole = {c[0]: tuple(c) for c in classes.values()}
    want = set()
    for size in (1, 2, 3):
        for combo in itertools.combinations(sorted(freq), size):
            n = sum(set(combo) <= s for s, _ in rows)
            hit = sum(set(combo) <= s and b for s, b in rows)
            if n >= 10 and hit >= 10 and hit / n >= 0.8 and hit / n / share >= 1.5:
                want.add((combo, whole[min(combo, key=lambda t: (freq[t], t))], round(hit / n, 9), round(hit / len(rows), 9)))
    assert {f for f in found if len(f[0]) <= 3} == want and want


def test_rules_decide(spark):
    pages = spark.createDataFrame([(i, u) for i, u, _ in labelled()] + [(900, "http://casino.new.net/x"), (901, "http://news.new.net/x"), (902, "http://casino.x.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in labelled()], "doc_id long, quality int, toxic int")
    out = {r.id: r.verdict for r in urlrules.judged(pages, labels).collect()}
    assert out[900] == "block" and out[901] == "allow" and out[902] == "allow"
    assert all(out[i] == ("allow" if g else "block") for i, _, g in labelled())


def test_tokens_that_always_come_together(spark):
    """Thirty query keys in every bad URL make one item; each of them alone still decides."""
    keys = "&".join(f"k{chr(97 + k % 26)}{k // 26}=1" for k in range(30))
    rows = [(k, f"http://a{k}.net/x?{keys}" if k % 4 == 0 else f"http://b{k}.net/x?z=1", int(k % 4 > 0)) for k in range(200)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900, "http://new.net/?kd1=5"), (901, "http://new.net/?z=5")], "page_id long, url string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    out = {r.id: r.verdict for r in urlrules.judged(pages, labels).collect()}
    assert out[900] == "block" and out[901] == "allow" and all(out[i] == ("allow" if g else "block") for i, _, g in rows)


def test_verdicts_against_brute_force(spark, mined):
    """Every verdict of the whole operator, by counting all combinations of up to three tokens."""
    rows = labelled()
    toks = {r.url: frozenset(r.t) for r in mined[0].select("url", urlrules.tokens(F.col("url")).alias("t")).collect()}
    share = sum(not g for _, _, g in rows) / len(rows)
    bad = set()
    for size in (1, 2, 3):
        for combo in {c for u in toks.values() for c in itertools.combinations(sorted(u), size)}:
            n = sum(set(combo) <= toks[u] for _, u, _ in rows)
            hit = sum(set(combo) <= toks[u] and not g for _, u, g in rows)
            if hit >= urlrules.MIN_COUNT and hit / n >= urlrules.MIN_CONFIDENCE and hit / n / share >= urlrules.MIN_LIFT:
                bad.add(combo)
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    for r in urlrules.judged(pages, labels).collect():
        want = "block" if any(set(c) <= toks[r.url] for c in bad) else "allow"
        assert r.rule is not None or r.verdict == want


def test_tokens_with_digits_and_long_ones(spark):
    long = "a" * 80
    bad = ["1xbet", "888casino", "123movies", "4chan", long]
    rows = [(k, f"http://{bad[k % 5]}.site{k}.net/1{k}", 0) for k in range(100)] + [(100 + k, f"http://news{k}.net/2024/{k}", 1) for k in range(300)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900 + k, f"http://{x}.new.net/y") for k, x in enumerate(bad)] + [(990, "http://2024.new.net/y")], "page_id long, url string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    out = {r.id: r.verdict for r in urlrules.judged(pages, labels).collect()}
    assert all(out[900 + k] == "block" for k in range(5)) and out[990] == "allow"
    found = spark.createDataFrame([(f"http://1xbet.com/2024/{long}?7=1",)], "url string").select(urlrules.tokens(F.col("url"))).first()[0]
    assert "h:1xbet" in found and not any(t in ("p:2024", "q:7") for t in found) and len(found) == 3


def test_edges_of_the_input(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None), (2, "http://h/" + "x/" * 40000)], "page_id long, url string")
    labels = spark.createDataFrame([(1, None, None), (1, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert urlrules.judged(pages, labels).count() == 4
    assert urlrules.judged(pages.limit(0), labels).count() == 0
