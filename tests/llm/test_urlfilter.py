import random

import numpy as np
import pandas as pd

from helixmill.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(url):
    host, path = parts(url)
    best = None
    for verdict, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


URLS = [
    None, "", "no scheme.com/", "http://a.com", "http://A.COM/", "http://com/", "http://xcom/", "https://www.example.com/en/1", "https://m.example.com/en/1",
    "https://example.com/en", "https://deep.www.example.com/en/x?q=1", "http://b.net/es/", "http://b.net/es", "http://net/fr/x#y", "ftp://É.Net/fr/é", "http://a.com:80/",
    "a://b://c.com/d", "://x.com/p?://y", "http://x.com?a=/en/", "http://x.com#/", "http://new\nline.com/\n?z", "http://b.org/" + "a/" * 3000,
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df).collect()}
    for k, u in enumerate(URLS):
        assert (got[k].host, got[k].path) == parts(u), u
        want = brute(u)
        assert got[k].rule == (want and want[1]), u
        assert got[k].verdict in ("allow", "block") and (want is None or got[k].verdict == want[0])
    assert urlfilter.filter_urls(df.limit(0)).collect() == []
    assert {r.verdict for r in urlfilter.filter_urls(df.where("url is null")).collect()} == {"allow"}


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.4
        host = rng.choice(["a.org", "b.org", "c.info"]) if not bad else rng.choice(["a.org", "x9-8.biz", "c.info"])
        path = "/" + "/".join(rng.choice(["en", "news", "p"]) for _ in range(rng.choice([1, 2]))) if not bad else "/" + "".join(rng.choice("0123456789abcdef") for _ in range(30))
        rows.append((f"http://{host}{path}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.5 else ""), host, path, float(bad)))
    return pd.DataFrame(rows, columns=["url", "host", "path", "block"])


def test_held_out_accuracy_of_the_trees():
    model, test = urlfilter.fit(labelled(600, 1)), labelled(400, 2)
    x = urlfilter.lexical(list(test.url), list(test.host), list(test.path), model.suffix, model.prior)
    assert np.mean((model.margin(x) > 0) == (test.block == 1)) > 0.97


def test_a_tree_splits_where_it_should():
    x = np.arange(100.0)[:, None]
    model = urlfilter.boost(x, (x[:, 0] >= 37).astype(float), bins=100)
    assert ((model.margin(x) > 0) == (x[:, 0] >= 37)).all()
    assert not urlfilter.boost(x, np.ones(100)).trees


def test_the_sample_is_bounded_and_the_same_in_any_order(spark):
    rows = labelled(500, 4)
    df = spark.createDataFrame(rows.assign(page_id=range(500)))
    a, b = urlfilter.train(df, 60), urlfilter.train(df.repartition(7), 60)
    x = urlfilter.lexical(list(rows.url), list(rows.host), list(rows.path), a.suffix, a.prior)
    assert a.suffix == b.suffix and (a.margin(x) == b.margin(x)).all()


def test_repeated_rows_train_once_and_long_urls_stay_behind(spark):
    rows = labelled(300, 6)
    df = spark.createDataFrame(rows.assign(page_id=range(300)))
    hot = df.limit(1).crossJoin(spark.range(3000)).drop("id")
    a, b = urlfilter.train(df, 100), urlfilter.train(df.unionByName(hot), 100)
    assert a.suffix == b.suffix and a.prior == b.prior
    long = spark.createDataFrame([(f"http://{'h' * 5000}.org/{'p' * 100_000}{k}", "h" * 5000 + ".org", "/p", float(k % 2), k) for k in range(30)], "url string, host string, path string, block double, page_id long")
    assert len(urlfilter.train(long).suffix) == 2 and urlfilter.train(df.limit(0)).trees == []
