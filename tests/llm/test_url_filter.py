"""URL parts, rules and the template tree on small tables."""

from sparkloom.llm.url_filter import url_filter

SCHEMA = "page_id long, url string, html string, host int, template string"


def run(spark, urls, **more):
    rows = [(i, u, None, 1, "t") for i, u in enumerate(urls)]
    return {r.page_id: r for r in url_filter(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_parts_and_rules(spark):
    urls = [
        None,
        "no scheme/en/",
        "HTTPS://WWW.Example.COM/en/7?x=/en/#y",
        "http://example.com/en/8",
        "http://notexample.com/en/7",
        "http://com/en/",
        "http://a.example.net/de/81#q",
        "http://x.net/de/8",
        "http://org",
        "http://a.org?x=/es/",
        "http://a.org/es/://b.com/en/",
        "://",
    ]
    got = run(spark, urls)
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("www.example.com", "/en/7", "example.com/en/7", "allow"),
        3: ("example.com", "/en/8", "com/en/", "block"),
        4: ("notexample.com", "/en/7", "com/en/", "block"),
        5: ("com", "/en/", "com/en/", "block"),
        6: ("a.example.net", "/de/81", "example.net/de/8", "block"),
        7: ("x.net", "/de/8", "net/de/", "allow"),
        8: ("org", "", None, "allow"),
        9: ("a.org", "", None, "allow"),
        10: ("a.org", "/es/://b.com/en/", "org/es/", "block"),
        11: ("", "", None, "allow"),
    }


def test_tree_generalises_merges_and_rejects(spark):
    urls = [f"http://h.io/shop/{i}" for i in range(40)] + [f"http://h.io/news/{i}" for i in range(40)] + [f"http://h.io/blog/{i}/comments" for i in range(40)]
    urls += [f"http://h.io/u{i}/about" for i in range(3)]
    urls += [f"http://h.io/help/{i}" for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in [*range(20), *range(80, 100)]], "page_id long, bad int")
    got = run(spark, urls, labels=labels)
    assert got[0].template == got[39].template == got[79].template and got[0].template.endswith("/{n}")
    assert got[39].verdict == got[50].verdict == "block"  # what is known of shop reaches its unlabelled likes
    assert got[119].verdict == "allow" and got[119].template == "blog/{n}/comments"
    apart = spark.createDataFrame([(i, int(i < 20)) for i in [*range(20), *range(123, 143)]], "page_id long, bad int")
    got = run(spark, urls, labels=apart)
    assert got[39].template == "shop/{n}" and got[39].verdict == "block"  # opposite labels keep branches apart
    assert got[150].template == "help/{n}" and got[150].verdict == "allow"
    alike = run(spark, urls)
    assert alike[0].template == alike[79].template and alike[0].template.startswith("*") and alike[0].verdict == "allow"
    assert alike[100].template.endswith("/{n}/comments")
    many = run(spark, [f"http://h.io/u{i}/about" for i in range(100)])
    assert {r.template for r in many.values()} == {"*/about"}


def test_literals_that_look_like_wildcards(spark):
    urls = [f"http://{h}.io/x/{i}" for h in "abc" for i in range(20)] + ["http://a.io/x/*", "http://b.io/x/{n}", "http://c.io/x/\\{n}"] * 5
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "page_id long, bad int")
    got = run(spark, urls, labels=labels)
    assert [got[i].template for i in (0, 60, 61, 62)] == ["x/{n}", "x/\\*", "x/\\{n}", "x/\\\\{n}"]
    assert got[0].verdict == "block" and all(got[i].verdict == "allow" for i in range(60, 75))


def test_empty(spark):
    assert run(spark, []) == {}


def test_levels_below_the_fourth_are_generalised(spark):
    urls = [f"http://h.io/a/b/c/d/slug-{chr(97 + i % 26)}{i}x" for i in range(300)] + [f"http://h.io/a/b/c/d/e/f/{i}" for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(i, 0) for i in range(300, 320)], "page_id long, bad int")
    got = run(spark, urls, labels=labels)
    assert {got[i].template for i in range(300)} == {"a/b/c/d/*"}
    assert all(got[i].verdict == "block" for i in range(300)) and all(got[i].verdict == "allow" for i in range(300, 320))


def test_sections_of_slugs_are_merged_like_sections_of_numbers(spark):
    """What is known of /es/ reaches /pt/, whether pages below are numbers or words: subtrees are compared after they are generalised."""
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7)) + chr(97 + i // 26) + "-story"
    for name in (str, word):
        urls = [f"http://site.org/{s}/{name(i)}" for s in ("es", "pt") for i in range(100)]
        got = run(spark, urls)
        assert len({r.template for r in got.values()}) == 1 and {r.verdict for r in got.values()} == {"block"}
    deep = run(spark, [f"http://site.org/{s}/{word(i)}/{word(i + 1)}" for s in ("es", "pt") for i in range(100)] + [f"http://site.org/fr/{i}" for i in range(100)])
    assert {deep[i].verdict for i in range(200)} == {"block"} and {deep[i].verdict for i in range(200, 300)} == {"allow"}
