import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from lorekeep.llm import url_rules as ur
from lorekeep.llm.queries import PAGE_RULES, op13_association_rules

LOW = str.maketrans(ur.UPPER, ur.LOWER)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[h:]
    p = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:h].translate(LOW), tail[:p]


def rule_of(host, path):
    fits = [(len(name), name, verdict) for verdict, name in PAGE_RULES if (host == (h := name.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(name[len(h) :])]
    return max(fits)[1:] if fits else (None, None)


def check(rows, pages):
    """Hosts, paths and given rules by plain Python; what no given rule fits has the method's verdict."""
    want = Counter((i, *(hp := parts(u)), (r := rule_of(*hp))[0], r[1]) for i, u in pages)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.by == "given" else None) for r in rows)
    assert got == want
    assert all(r.verdict == {"mined": "block", "none": "allow"}.get(r.by, r.verdict) for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    rows = op13_association_rules(spark, sf).collect()
    check(rows, pages)
    assert {r.rule for r in rows} >= {"org/", "com/fr/", "com/de/"}


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG", "http://a.example.org/en/12?x=1#y", "http://example.org/es", "http://example.org/es/", "http://notexample.org/es/", "x://É.org/É", "http://com/de/",
    "http://b.com/de/1", "http://b.com/fr/1/", "http://b.com?u=http://c.org/", "http://b.com#f", "a://b://c/d", "http://org", "http://org/", "http://user@x.org:80/p", "http:// /", "http://x.com/\nde/", "http://..org//", "h://" + "a." * 300 + "org/" + "x/" * 5000,
]


def test_odd_urls_and_tables(spark):
    pages = [*enumerate(URLS), (None, "http://a.org/"), (None, None), (3, "no scheme"), (3, "no scheme")]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("r")).withColumn("tokens", F.lit("t")).withColumn("a.b", F.lit(0))
    none = ur.mined(spark.createDataFrame([], "url string, block boolean"))
    check(ur.judged(df, ur.given(spark, PAGE_RULES), none).collect(), pages)
    assert ur.judged(df.limit(0), ur.given(spark, PAGE_RULES), none).count() == 0
    assert none.count() == 0
    labels = spark.createDataFrame([(1, None, None), (12, 0, None), (12, 1, 0), (None, 0, 1), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r.url, r.block) for r in ur.labelled_pages(df, labels).collect()}
    assert got == {("http://a.example.org/en/12?x=1#y", True), ("http://b.com/de/1", False), ("http://b.com/fr/1/", False)}


def brute(labelled, toks, least, support, confidence):
    """All token sets of blocked urls by enumeration, pruned by count, confidence and weaker sets."""
    rows = [(toks[u], b) for u, b in labelled if b is not None and toks[u]]
    hits = Counter(s for t, b in rows if b for k in range(1, len(t) + 1) for s in itertools.combinations(sorted(t), k))
    floor = max(least, support * len(rows))
    sure = {}
    for s, h in hits.items():
        if h >= floor:
            seen = sum(set(s) <= set(t) for t, _ in rows)
            if h >= confidence * seen:
                sure[s] = (h, seen)
    return {s: v for s, v in sure.items() if not any(o != s and set(o) < set(s) and w[0] * v[1] >= v[0] * w[1] for o, w in sure.items())}


def test_mined_rules_against_enumeration(spark):
    r = random.Random(5)
    labelled = []
    for i in range(400):
        h, seg, q = r.choice(["cheap-pills.example.net", "news.example.net", "win.com"]), r.choice(["en", "de"]), r.choice(["", "?ref=1"])
        bad = r.random() < (0.9 if "pills" in h or (h == "win.com" and seg == "de") else 0.1)
        labelled.append((f"http://{h}/{seg}/{i}{q}", bad if i % 50 else None))
    labelled.append(("nothing", True))
    df = spark.createDataFrame(labelled, "url string, block boolean").withColumn("tokens", F.lit(1))
    toks = {x.url: x.t for x in df.select("url", ur.tokens("url").alias("t")).collect()}
    want = brute(labelled, toks, 15, 0.01, 0.6)
    rules = ur.mined(df, 15, 0.01, 0.6)
    got = rules.collect()
    assert {tuple(sorted(x.tokens)): (x.hits, x.seen) for x in got} == want and want
    assert any("word=pills" in s for s in want)
    counts = Counter(t for u, b in labelled if b is not None for t in toks[u])
    assert all(x.key in x.tokens and counts[x.key] == min(counts[t] for t in x.tokens) for x in got)
    # by the index every url is blocked that a rule fits, and no other
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id bigint, url string")
    for x in ur.judged(pages, ur.given(spark, []), rules).collect():
        fits = any(set(s) <= set(toks[labelled[x.page_id][0]]) for s in want)
        assert (x.verdict, x.by) == (("block", "mined") if fits else ("allow", "none"))


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://{'abc'[i % 3]}.net/x/{i}") for i in range(90)], "page_id bigint, url string")
    labelled = pages.select("url", (F.col("page_id") % 3 == 0).alias("block"))
    run = lambda: sorted(map(tuple, ur.judged(pages, ur.given(spark, PAGE_RULES), ur.mined(labelled)).collect()))
    one = run()
    monkeypatch.setattr(ur, "BROADCAST", 0)
    assert run() == one and sum(x[4] == "block" for x in one) == 30


def test_rules_of_tokens_far_behind_in_long_urls(spark):
    """What tells blocked urls is behind forty other tokens that come together, in paths that end at different depths."""
    r = random.Random(6)
    deep = "/".join(f"d{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))
    labelled = []
    for i in range(240):
        some = deep if i % 3 else "/".join(deep.split("/")[: 10 + i % 20])
        bad = i % 2 == 0
        labelled.append((f"http://a.b.c.d.example.net/{some}{'/spam' if bad and i % 3 else ''}?x=1&{'buy' if bad else 'see'}=1&{r.choice('pq')}=2", bad))
    df = spark.createDataFrame(labelled, "url string, block boolean")
    got = {tuple(sorted(x.tokens)): (x.hits, x.seen) for x in ur.mined(df, 20, 0.001, 0.6).collect()}
    assert got[("name=buy",)] == (120, 120) and got[("path30=spam",)] == (80, 80)
    toks = {x.url: set(x.t) for x in df.select("url", ur.tokens("url").alias("t")).collect()}
    assert min(map(len, toks.values())) > 16
    for s, (hits, seen) in got.items():
        assert (hits, seen) == (sum(b for u, b in labelled if set(s) <= toks[u]), sum(set(s) <= toks[u] for u, _ in labelled))
        parts = [p for k in range(1, len(s)) for p in itertools.combinations(s, k)]
        assert hits >= 0.6 * seen and not any(sum(b for u, b in labelled if set(p) <= toks[u]) * seen >= hits * sum(set(p) <= toks[u] for u, _ in labelled) for p in parts)
