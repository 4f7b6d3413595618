"""URL verdicts: parsing, rules, templates and purity."""

import re

import oracle
from pyspark.sql import functions as F

from driftpool.llm import queries, url_templates

ODD = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x", "http://a.example.org/en/123?x=1", "http://example.org/en/2", "http://myexample.org/es/1", "ftp://x.com#f",
    "http://x.com/de/1", "http://com/fr/a", "http://x.com/fr", "http://x.org", "HTTP://Ä.ORG/ß", "http://a.net/p://q.com/de/1", "http://a.net/a\nb?c", "http://a.net?u=/de/", "http://x.org:80/es/1",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in queries.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len, default=None)


def check(pages, labels):
    verdict = {r: v for v, r in queries.RULES}
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    found = url_templates.judge(pages, labels, queries.RULES).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=repr) == sorted(((i, *brute(u)) for i, u in rows), key=repr)
    assert all(r.verdict == (verdict[r.rule] if r.rule else "block" if r.score < url_templates.PURITY else "allow") for r in found)
    return found


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(ODD + ODD)] + [(None, ODD[5], "y", 2), (3, ODD[3], "z", 3)], "page_id long, url string, host string, n int")
    check(pages, spark.createDataFrame([(4, True), (4, None), (99, False), (None, True)], "page_id long, good boolean"))
    check(pages.limit(0), spark.createDataFrame([], "page_id long, good boolean"))


def test_given_pages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    found = queries.QUERIES["op2_url_templates"](spark, sf_dir).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in found) == sorted((i, *brute(u)) for i, u in rows)


def test_bad_branch_goes_and_its_like_stay(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i}/slug{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 > 0 or i % 60 == 0) for i in range(0, 600, 2)], "page_id long, good boolean")
    found = url_templates.judge(pages, labels).collect()
    assert {(r.page_id % 3 == 0, r.verdict) for r in found} == {(True, "block"), (False, "allow")}
    by = {r.template: r.judged_by for r in found}
    assert by["/spam/#/slug#"] == "/~1" and by["/news/#/slug#"] == by["/blog/#/slug#"]


def test_many_branches_become_one(spark):
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(100)]
    pages = spark.createDataFrame([(i, f"http://h.net/{w}/end") for i, w in enumerate(words)] + [(200 + i, "http://h.net/often/end") for i in range(50)], "page_id long, url string")
    found = url_templates.judge(pages, spark.createDataFrame([], "page_id long, good boolean"))
    assert {r.template for r in found.select("template").collect()} == {"/*/end", "/often/end"}
    assert found.filter("score <> 1").count() == 0


def test_variable_segment_below_another(spark):
    """200 users of three slugs each, no two alike: one template; what is frequent stays named at either level."""
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(4))
    urls = [f"http://h.net/user{word(i // 3)}/{word(7000 + i)}/end" for i in range(600)] + ["http://h.net/about/us/end"] * 40 + [f"http://h.net/user{word(i)}/home/end" for i in range(100)]
    found = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "page_id long, good boolean"))
    assert {r.template: r["count"] for r in found.groupBy("template").count().collect()} == {"/*/*/end": 600, "/about/us/end": 40, "/*/home/end": 100}


def test_branches_merge_by_a_test_not_by_rounding(spark):
    """Shares of 0.199 and 0.201 are alike; 0.1 and 0.9 are not; a branch without labels is judged by what is above it."""
    shares = {"a": 199, "b": 201, "c": 900, "d": 905}
    rows = [(1000 * k + i, f"http://h.net/{name}/x", i < good) for k, (name, good) in enumerate(shares.items()) for i in range(1000)] + [(9000, "http://h.net/e/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    by = {r.template: (r.judged_by, r.verdict) for r in url_templates.judge(pages.drop("good"), pages.select("page_id", "good")).collect()}
    assert by == {"/a/x": ("/~1", "block"), "/b/x": ("/~1", "block"), "/c/x": ("/~2", "allow"), "/d/x": ("/~2", "allow"), "/e/x": ("", "allow")}


def test_shapes(spark):
    cases = {"/a/12/b-3.html": "/a/#/b-#.html", "/x//y/": "/x/y", "/u/3f2504e0-4f89-11d3-9a0c-0305e82c3301": "/u/%", "/": "", "": "", "/deadbeef": "/deadbeef"}
    got = spark.createDataFrame([(k,) for k in cases], "path string").select("path", url_templates.shape_of(F.col("path")).alias("shape")).collect()
    assert {r.path: r.shape for r in got} == cases


def test_sql_on_odd_and_wide_pages(spark, tmp_path):
    """Every branch of the method: wildcards, merged and separate branches, hexadecimal words, repeated and null labels."""
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(100)]
    urls = ODD + [f"http://w.net/{w}/{i}" for i, w in enumerate(words)] + [f"http://w.net/often/{i}.html" for i in range(300)]
    urls += [f"http://h.net/{'spam' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i % 7}/{i}/" for i in range(600)]
    urls += [f"http://v.net/{words[i // 2]}/{words[i % 97]}{words[i % 89]}/{'*' if i % 5 else 'z'}" for i in range(200)] + ["http://v.net/*/*/q"] * 20
    urls += ["http://u.net/3F2504e0-4f89-11d3-9a0c-0305e82c3301/0123456789abcdef/x_0123456789abcdef/0123456789abcdefg", "http://u.net/a//b/", "http://u.net/a\n/1/\n"]
    pages = spark.createDataFrame(list(enumerate(urls + urls[:9])) + [(None, ODD[5]), (3, ODD[3])], "page_id long, url string")
    labels = [(i, int(i % 3 > 0 or i % 60 == 0), 0 if i % 11 else 1) for i in range(0, 600, 2)] + [(4, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0)]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = oracle.duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = queries.QUERIES["op2_url_templates"](spark, str(tmp_path))
    assert oracle.compare(found, queries.SQL["op2_url_templates"], con) is None
    assert {r.verdict for r in found.filter("rule IS NULL").select("verdict").collect()} == {"allow", "block"}
