import random

from quireline.llm import queries
from quireline.llm import url_rules as U

SCHEMA = "host string, path string, verdict string"


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = U.judge_urls(pages, spark.createDataFrame(rules, SCHEMA), **more)
    return [tuple(r)[1:] for r in sorted(out.collect())]


def test_random_urls_and_nested_rules_equal_brute_force(spark):
    rng = random.Random(9)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "a-b", "é"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join("/" + rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randrange(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/x", "block")]
    urls = [rng.choice(["http://", "HTTPS://", "://", ""]) + rng.choice([str.upper, str])(host()) + path() + rng.choice(["", "?q=/x", "#f"]) for _ in range(500)]
    urls += [None, "", "http://", "nothing", "http://a..b/x", "x://y://z/", "http://a/\n/x"] + ["http://ab.a/x"] * 50
    want = [U.brute_force(u, rules) for u in urls]
    assert judged(spark, urls, rules) == want
    assert judged(spark, urls, rules, block_chars=30) == want
    assert {w[3] for w in want} == {"allow", "block"}


def test_label_bounds_and_defaults(spark):
    rules = [("org", "/", "block")]
    urls = ["http://xorg/", "http://x.org/", "http://org/", "http://x.org", "http://X.ORG/a?b"]
    assert [g[2:] for g in judged(spark, urls, rules)] == [(None, "allow"), ("org/", "block"), ("org/", "block"), (None, "allow"), ("org/", "block")]
    assert judged(spark, ["http://x.org/"], [], default="block") == [("x.org", "/", None, "block")]
    assert judged(spark, [], rules) == []


def test_many_nested_paths_of_one_host_in_many_blocks(spark):
    rng = random.Random(10)
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 9)))
    rules = [("h.org", path(), rng.choice(["allow", "block", "other"])) for _ in range(300)] + [("org", path(), "block") for _ in range(50)]
    rules = [*{r[:2]: r for r in rules}.values()] + [("h.org", "/zz", "allow"), ("h.org", "/zz", "block"), ("net", "/q", None)]
    urls = ["http://" + rng.choice(["h.org", "x.h.org", "org", "i.org"]) + path() for _ in range(400)] + ["http://h.org/zzz", "http://net/q"]
    want = [U.brute_force(u, [r for r in rules if r[2]]) for u in urls]
    assert want[-2:] == [("h.org", "/zzz", "h.org/zz", "block"), ("net", "/q", None, "allow")] and len({w[2] for w in want}) > 60
    for size in (1 << 20, 2000, 600):
        assert judged(spark, urls, rules, block_chars=size) == want


def test_kept_columns_of_any_name(spark):
    names = ["host", "path", "rule", "verdict", "rkey", "rule_host", "rule_path", "page_id", "__k0"]
    df = spark.sql("SELECT 'http://a.org/x' AS url, " + ", ".join(f"{i} AS `{n}`" for i, n in enumerate(names)))
    out = U.judge_urls(df, spark.createDataFrame([("org", "/", "block")], SCHEMA), keep=tuple(names))
    assert out.columns == ["host_kept", "path_kept", "rule_kept", "verdict_kept", *names[4:], "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == (*range(len(names)), "a.org", "/x", "org/", "block")


def test_query(spark, sf):
    urls = {r.page_id: r.url for r in queries.table(spark, sf, "pages").collect()}
    got = queries.op10_url_rules(spark, sf).collect()
    assert len(got) == len(urls)
    assert all(tuple(r)[1:] == U.brute_force(urls[r.page_id], queries.URL_RULES) for r in got)
