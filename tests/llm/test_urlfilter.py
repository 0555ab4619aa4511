from emberwatch.llm.urlfilter import Rule, judge_urls


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "t", 1) for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, template string, n int")


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/1?x#y", "http://example.net", "http://xexample.net/en/1",
            "http://net/", "http://a.org/fr/2#t", "http://a.org?q=/fr/", "http://b.example.com/de/1", "http://ex.com/de/1",
            "x://y://z/en", "http://a.org/fr/2#t", "http://Ä.org/x"]
    rows = {r.page_id: r for r in judge_urls(pages(spark, urls)).collect()}
    assert len(rows) == len(urls)
    got = [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))]
    assert got == [("", "", None)] * 3 + [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "", None), ("xexample.net", "/en/1", "net/"),
        ("net", "/", "net/"), ("a.org", "/fr/2", "org/fr/"), ("a.org", "", None), ("b.example.com", "/de/1", "example.com/de/"),
        ("ex.com", "/de/1", None), ("y:", "//z/en", None), ("a.org", "/fr/2", "org/fr/"), ("Ä.org", "/x", None)]
    assert rows[5].verdict == "block" and rows[3].verdict == "allow"
    assert judge_urls(pages(spark, ["x"]).limit(0)).count() == 0


def test_similar_branches_merge_and_different_ones_stay(spark):
    """Blocked /spam/*, unlabelled /docs and /blog: the spam branch stands alone and is rejected, numbered leaves and
    the similar branches become wildcards, and an unlabelled spam page takes its template's verdict."""
    rules = [Rule("block", "h.io", "/spam/a")]
    urls = ([f"http://h.io/spam/a{i}" for i in range(40)] + [f"http://h.io/docs/{i}" for i in range(30)]
            + [f"http://h.io/blog/{i}/{'x' * 5000}" for i in range(30)] + ["http://h.io/spam/b7", "http://h.io/spam/b8"])
    rows = {r.page_id: r for r in judge_urls(pages(spark, urls), rules=rules).collect()}
    assert rows[0].template.startswith("/spam") and rows[0].verdict == "block"
    assert rows[40].template.startswith("/docs") or rows[40].template.startswith("/*")
    assert rows[40].verdict == rows[70].verdict == "allow"
    assert len({rows[i].template for i in range(40, 70)}) == 1 and "{n}" in rows[40].template or "*" in rows[40].template


def test_deep_paths_are_kept_whole_and_told_apart(spark):
    """Two branches that part at the ninth segment, one blocked and one allowed."""
    deep = "http://d.io/a/b/c/d/e/f/g/h/"
    urls = [f"{deep}{kind}/{'x' * (i % 9)}p{i}q" for kind in ("spam", "good") for i in range(40)] + ["http://d.io/", "http://e.io/" + "/".join("abcdefghijklmnop")]
    rules = [Rule("block", "d.io", "/a/b/c/d/e/f/g/h/spam/"), Rule("allow", "d.io", "/a/b/c/d/e/f/g/h/good/")]
    rows = {r.page_id: r for r in judge_urls(pages(spark, urls), rules=rules).collect()}
    assert rows[0].purity > 0.9 and rows[40].purity < 0.1
    assert rows[81].template == "/" + "/".join("abcdefghijklmnop") and len(rows) == 82


def test_equally_long_rules_and_hot_shapes(spark, monkeypatch):
    from emberwatch.llm import urlfilter

    monkeypatch.setattr(urlfilter, "HOT", 5)
    rules = [Rule("block", "b.io", "/x/"), Rule("allow", "a.b.io", "/")]
    rows = judge_urls(pages(spark, ["http://a.b.io/x/1"] * 60 + ["http://b.io/x/2"]), rules=rules).collect()
    assert len(rows) == 61 and sorted({r.page_id for r in rows}) == list(range(61))
    equal = [Rule("block", "b.io", "/xy"), Rule("allow", "ab.io", "/x")]  # names of seven characters fit one url each
    got = {r.host: r.rule for r in judge_urls(pages(spark, ["http://ab.io/xyz", "http://b.io/xyz", "http://c.b.io/x"]), rules=equal).collect()}
    assert got == {"ab.io": "ab.io/x", "b.io": "b.io/xy", "c.b.io": None}
    tied = [Rule("block", "b.io", "/x/"), Rule("allow", "a.b.io", "/")]
    assert {len(r.name) for r in tied} == {7}
    assert {r.rule for r in judge_urls(pages(spark, ["http://a.b.io/x/1"]), rules=tied).collect()} == {"b.io/x/"}  # the later name
