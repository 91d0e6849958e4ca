import pytest
from pyspark.sql import functions as F

from lattica.llm import url_filter as u
from lattica.llm._cluster import components
from lattica.llm.queries import URL_RULES

PAGES = [
    (1, "https://A.example.org/es/x?q#f", "<link rel=canonical href='https://c.net/z'>"), (2, "https://c.net/z", None), (3, "http://d.net/a/b?x=1#frag", '<LINK href="/k" rel="canonical">'),
    (4, "http://d.net/k", '<meta http-equiv="refresh" content="0; url=http://m.com/de/1">'), (5, "http://m.com/fr/9", "<link rel='canonical' href='http://m.com/de/1'>"), (6, None, None), (7, "nourl", "<link rel=canonical href=x>"),
    (8, "https://x.org?y", ""), (9, "http://e.net", "<link rel=stylesheet href=/a><link rel=canonical href=b>"), (10, "http://e.net/b", ""), (1, "https://A.example.org/es/x?q#f", "again"), (None, "http://myexample.org/es/", ""),
]
WANT = {
    (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "c.net", "/z", None, "block"), (3, "d.net", "/a/b", None, "block"), (4, "d.net", "/k", None, "block"), (5, "m.com", "/fr/9", "com/fr/", "allow"), (6, "", "", None, "allow"),
    (7, "", "", None, "allow"), (8, "x.org", "", None, "allow"), (9, "e.net", "", None, "allow"), (10, "e.net", "/b", None, "allow"), (None, "myexample.org", "/es/", "org/", "allow"),
}


@pytest.mark.parametrize("inline", [64, 2])
def test_verdicts(spark, monkeypatch, inline):
    monkeypatch.setattr(u, "INLINE_RULES", inline)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("host", F.lit(1))
    rules = u.rules_table(spark, [*URL_RULES, ("org", None, "block")])
    got = u.url_verdicts(pages, rules).collect()
    assert len(got) == len(PAGES) and {tuple(r) for r in got} == WANT
    redirects = spark.createDataFrame([("http://e.net", "http://q.com/de/2"), (None, "http://q.com")], "a string, b string")
    more = {r.page_id: r.verdict for r in u.url_verdicts(pages, rules, redirects).collect()}
    assert more[9] == more[10] == "block" and more[5] == "allow"
    assert u.url_verdicts(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in u.url_verdicts(pages, u.rules_table(spark, [])).collect()} == {"allow"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300), (5, None), (400, 401), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_every_link_and_long_tags_make_edges(spark):
    html = f"<link rel=canonical href=/a><LINK data-x='{'y' * 5000}' href=/b rel=canonical><meta http-equiv=refresh content='0;url=/c'><meta http-equiv=refresh content='0;url=/d'><link rel=icon href=/e>"
    pages = spark.createDataFrame([(1, "http://h.net/", html), (2, "http://h.net/n", "canonical http-equiv")], "page_id long, url string, html string")
    assert sorted(r.b for r in u.page_edges(pages).collect()) == [f"http://h.net/{x}" for x in "abcd"]


def test_dots_comments_and_quotes(spark):
    html = [
        "<link rel=canonical href=../x>", "<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><!-- <script> --><link rel=canonical href='./y/../z/.'>",
        '<link title="a > b" rel="alternate canonical" data-href="/no" href="/a b/../c?q=/../#f">', "<link rel=non-canonical href=/no><link rel='x' title='rel=canonical' href=/no2>", "<!-- <link rel=canonical href=/no>",
    ]
    pages = spark.createDataFrame([(i, f"http://d.net/a/b{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.a[-1], r.b) for r in u.page_edges(pages).collect()}
    assert got == {("0", "http://d.net/x"), ("1", "http://d.net/a/z/"), ("2", "http://d.net/c?q=/../")}
    same = spark.createDataFrame([(1, "http://d.net/x/../de?1", "<link rel=canonical href=http://q.com/de/1>"), (2, "http://d.net/de?1", None), (3, "http://d.net/de?2", None)], "page_id long, url string, html string")
    assert [r.verdict for r in u.url_verdicts(same, u.rules_table(spark, URL_RULES)).orderBy("page_id").collect()] == ["block", "block", "allow"]


def test_sql_form(spark, tmp_path):
    """The SQL form gives the same verdicts on odd pages."""
    import duckdb

    from lattica.llm import queries as q

    html = ["<link rel=canonical href=../x>", f"<meta data-x='{'y' * 3000}' http-equiv=refresh content=\"0; url='/n?a=1&amp;b=2'\">", "<!-- <link rel=canonical href=http://m.com/de/1> -->", "<link rel='canonical' href=\" http://m.com/de/1 \">", None, "<link rel=canonical href='?p=2'><link rel=canonical href=//m.com/de/./..//z>"]
    rows = [(i, f"http://d.net/a/b{i}?x", h) for i, h in enumerate(html)] + [(10, "http://d.net/x", "<link rel=canonical href=/a/../../a/b3?x>"), (11, "http://d.net/n?a=1&b=2", None), (12, "http://d.net/a/b5?p=2", "<link rel=canonical href=http://m.com/de/>"), (13, None, "<link rel=canonical href=/>"), (14, "http://m.com//z", None), *[(20 + r[0] if r[0] else None, *r[1:]) for r in PAGES]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(r) for r in u.url_verdicts(pages, u.rules_table(spark, URL_RULES)).collect()}
    pages.toPandas().to_parquet(tmp_path / "p.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as from '{tmp_path}/p.parquet'")
    assert {tuple(r) for r in c.sql(q.ORACLES["op2_url_filter"]).fetchall()} == got
    assert {r[0]: r[4] for r in got if r[0] in (0, 2, 10, 11)} == {0: "block", 2: "allow", 10: "block", 11: "allow"}
