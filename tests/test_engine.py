"""Laws and small cases of functions, records, graphs, folds, readers and writers."""

import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.functions import rules, scalar
from loomfield.operators import graph, records, stats
from loomfield.sources import documents, readers, writers
from loomfield.streaming.state import Breaker, next_breaker


def column(spark, values, *made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *[m(F.col("v")) for m in made]).collect())]


def test_price_cases(spark):
    got = column(spark, ["$1,299.00", "A$5", "1.2.3", "", None, "€3"], scalar.price, lambda c: scalar.currency(c, compat=False))
    assert [(*p, x) for p, x in got] == [(1299.0, "USD", "USD"), (5.0, "USD", "AUD"), (None, "USD", "USD"), (None, "USD", "USD"), (None, "USD", "USD"), (3.0, "EUR", "EUR")]


def test_scalar_cases(spark):
    assert column(spark, ["1,234", "1.2K", "n/a"], scalar.review_count) == [(1234,), (1200,), (0,)]
    assert column(spark, ["Currently unavailable"], scalar.availability, lambda c: scalar.availability(c, strict=True)) == [("in_stock", "out_of_stock")]
    assert column(spark, ["+1 (555) 123-4567"], scalar.clean_phone) == [("5551234567",)]
    assert column(spark, [" A@B.com ", "x@y"], scalar.clean_email) == [("a@b.com",), ("",)]
    assert column(spark, ["01/02/2024", "12/31/2024", "soon"], scalar.clean_date) == [("2024-02-01",), ("2024-12-31",), ("soon",)]
    assert column(spark, ["https://a.com/x/?q=1#f", "/rel"], scalar.normalize_page_url) == [("https://a.com/x",), (None,)]
    assert column(spark, ["https://a.com/x/?q=1", "https://a.com/x#f"], scalar.normalize_record_url) == [("https://a.com/x",), ("https://a.com/x#f",)]
    assert column(spark, ["u?a=1"], lambda c: scalar.page_urls(c, F.lit(3))[2], lambda c: scalar.page_urls(c, F.lit(3), "offset", offset=True)[2]) == [("u?a=1&page=3", "u?a=1&offset=40")]
    assert column(spark, ["x y  z\n"], scalar.clean_text) == [("x y z",)]


def test_rules_cases(spark):
    df = spark.createDataFrame([("please wait … captcha", 200), ("<p>ok</p>", 503), ("fine" * 300, 200)], "h string, s int")
    got = [tuple(r.p) for r in df.select(rules.problem(F.col("h"), F.col("s"), F.lit(""), F.lit("")).alias("p")).collect()]
    assert got[0][:2] == ("bot_detected", "critical") and "captcha" in got[0][3]
    assert got[1][:3] == ("http_error", "medium", "HTTP 503 error") and got[2][0] is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab /?#.=&\t\n:", max_size=24), min_size=1, max_size=8))
def test_normalisers_are_idempotent(spark, values):
    for f in (scalar.clean_text, scalar.normalize_record_url):
        for (once, twice) in column(spark, values, f, lambda c, f=f: f(f(c))):
            assert once == twice or f is scalar.normalize_record_url and once.strip() != once


def test_records(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, ""), (4, None, "y")], "id int, k string, v string")
    assert sorted(r.id for r in records.first_wins(df, F.col("k"), [F.col("id")]).collect()) == [1, 3, 4]
    assert [tuple(r) for r in records.null_falsy(df.where("id = 3"), "id").collect()] == [(3, None, None)]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "n")], "k int, v string")
    assert [r.k for r in records.new_items(new, old, "k").collect()] == [3]
    assert sorted(r.k for r in records.new_items(new, old, "k", changed=True).collect()) == [2, 3]
    with pytest.raises(Exception, match="nope"):
        records.validate(df, {"nope": records.FieldRule()}).collect()


def test_graph_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 9)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, graph.reach(edges, start, 3).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, graph.reach(edges, start, 10).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert [r.node for r in graph.crawl(edges, start, 10, 2).collect()] == [1, 2]


def test_folds(spark):
    rnd = random.Random(3)
    events = [("a", 1_700_000_000 + i * 5000, rnd.random() < 0.5, rnd.choice([200, 429, 500]), rnd.choice([None, 7.0])) for i in range(200)]
    df = spark.createDataFrame(events, "k string, t long, ok boolean, s int, r double").withColumn("ts", F.timestamp_seconds("t"))
    ok, plain = F.col("ok"), {
        "confidence": (0.5, lambda x, e: min(1.0, x + (0.05 if e[2] else -0.1))), "improve": (0.5, lambda x, e: min(1.0, x + 0.1) if e[2] else max(0.1, x - 0.15)),
        "profile": (0.5, lambda x, e: max(0.0, min(1.0, x + (0.1 if e[2] else -0.1)))), "pattern": (0.5, lambda x, e: min(0.95, x + 0.1) if e[2] else x),
        "ema": (0.0, lambda x, e: x * 0.7 + e[3] * 0.3),
        "delay": (3.0, lambda x, e: min(60.0, e[4] if e[4] else x * 2) if e[3] == 429 else min(60.0, x * 1.5) if e[3] == 500 else max(1.0, x * 0.95)),
    }
    steps = {"confidence": stats.confidence_step(ok), "improve": stats.improve_step(ok), "profile": stats.profile_step(ok), "pattern": stats.pattern_step(ok), "ema": stats.ema_step(F.col("s").cast("double")), "delay": stats.delay_step(F.col("s"), F.col("r"))}
    for name, (start, step) in plain.items():
        x = start
        for e in events:
            x = step(x, e)
        for unit in ("hour", "day", "year"):
            got = stats.fold_linear(df, ["k"], ["ts"], steps[name], start, "x", unit).first().x
            assert abs(got - x) < 1e-9, (name, unit)
    rows = [("a", t * 7, rnd.random() < 0.4) for t in range(80)]
    b = Breaker()
    for _, t, ok in rows:
        b, _ = next_breaker(b, t, ok, 2, 30)
    log = spark.createDataFrame(rows, "k string, t long, ok boolean")
    start = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(0).cast("long").alias("opened"))
    got = stats.fold(log, ["k"], ["t"], F.struct("t", "ok"), start, lambda acc, v: stats.breaker_step(acc, v, 2, 30), "b").first().b
    assert (got.state, got.failures) == (b.state, b.failures)


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,\"y\"\nz", ["a", "b"], (5,)), (2, None, [], (None,))], "id int, s string, l array<string>, m struct<n:int>")
    writers.write_csv(df, str(tmp_path / "csv"))
    back = sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "csv"), {"id": "int", "m_n": "int"}).select("id", "l", "m_n", "s").collect()))
    assert back[0] == (1, "a; b", 5, 'x,"y"\nz') and back[1][0] == 2
    writers.write_ndjson(df, str(tmp_path / "nd"))
    writers.write_ndjson(df, str(tmp_path / "nd"), append=True)
    assert readers.read_ndjson(spark, str(tmp_path / "nd"), "id int, s string").count() == 4
    assert set(writers.write_all(df.select("id", "s"), str(tmp_path / "all"), ["json", "csv", "parquet", "xlsx"])) == {"json", "csv", "parquet", "xlsx"}
    assert documents.parse_xlsx(writers.workbook(df.select("id", "s").where("id = 1"))) == [("data", 0, ["id", "s"]), ("data", 1, ["1", 'x,"y"\nz'])]
    (tmp_path / "o" / "p").mkdir(parents=True)
    (tmp_path / "o" / "p" / "x.txt").write_text("# c\nhttp://1\n\nhttp://2\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "o" / "p" / "x.txt")).collect()] == ["http://1", "http://2"]
    assert readers.list_objects(spark, str(tmp_path / "o"), "x").count() == 1
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in readers.read_json(spark, str(tmp_path / "d.json")).collect()) == [1, 2]


def test_workbooks_of_results_beyond_a_sheet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "WORKBOOK_ROWS", 50)
    df = spark.range(120).selectExpr("id", "concat('é ', id, '\n') as s").repartition(3)
    path = writers.write_all(df, str(tmp_path / "all"), ["xlsx"])["xlsx"]
    got = documents.xlsx_rows(readers.read_objects(spark, path)).where("row > 0").collect()
    assert sorted(int(r.cells[0]) for r in got) == list(range(120)) and all(r.cells[1] == f"é {r.cells[0]}\n" for r in got)
    writers.write_workbooks(df, str(tmp_path / "small"), rows=7)
    files = list((tmp_path / "small").glob("part-*"))
    assert len(files) >= 18 and all(f.suffix == ".xlsx" and len(documents.parse_xlsx(f.read_bytes())) <= 8 for f in files)
    for f in files:  # the line break at the end is the archive's comment
        with zipfile.ZipFile(f) as z:
            assert z.comment == b"\n" and z.testzip() is None
    writers.write_workbooks(df.limit(0), str(tmp_path / "none"))
    assert readers.read_objects(spark, str(tmp_path / "none"), "*.xlsx").count() == 0


def test_sitemaps_and_robots(spark):
    xml = "<urlset><url><loc> https://a.com/1 </loc><priority>.8</priority><lastmod>2024-01-05</lastmod></url><url><loc>https://a.com/2</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"
    rows = readers.sitemap_rows(spark.createDataFrame([(xml,), (index,)], "x string"), "x")
    assert sorted((r.url, r.type) for r in rows.collect()) == [("https://a.com/1", "url"), ("https://a.com/2", "url"), ("https://a.com/s.xml", "sitemap")]
    assert [r.url for r in readers.filter_sitemap(rows, min_priority=0.5).collect()] == ["https://a.com/1"]
    assert [r.url for r in readers.filter_sitemap(rows, days=10, as_of=F.lit("2024-01-10").cast("date")).collect()] == ["https://a.com/1"]
    robots = spark.createDataFrame([("User-agent: *",), ("Sitemap: https://A.com/S.xml",)], "value string")
    assert [r.url for r in readers.robots_sitemaps(robots).collect()] == ["https://A.com/S.xml"]
    assert spark.range(1).select(readers.sitemap_urls(F.lit(xml + "<loc>https://a.com/tag/x</loc>")).alias("u")).first().u == ["https://a.com/1", "https://a.com/2"]


def test_docx():
    got = documents.parse_docx(documents.make_docx([("Heading2", "T"), (None, "p")], [[["a", "b"]]]))
    assert got == [(0, "heading", "T", 2), (1, "paragraph", "p", 0), (2, "table", "a\tb", 0)]


def test_global_ranks(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 5)) for i in range(1000)]
    got = stats.global_rank(spark.createDataFrame(rows, "i long, p int").repartition(7), [F.desc("p"), F.col("i")]).collect()
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.i: r["rank"] for r in got} == want
    assert stats.global_rank(spark.createDataFrame([], "i long"), [F.col("i")]).collect() == []


def test_both_limits_and_pools(spark):
    rnd = random.Random(2)
    rows = [(i, f"d{rnd.randint(0, 3)}", rnd.randint(0, 300)) for i in range(120)]
    got = {r.i: r for r in stats.both_limits(spark.createDataFrame(rows, "i int, d string, s long"), "d", F.col("s"), (3, 20), (8, 30)).collect()}
    for i, d, t in rows:
        own, every = sum(e == d and t - 20 <= x <= t for _, e, x in rows), sum(t - 30 <= x <= t for _, _, x in rows)
        assert (got[i].own_count, got[i].all_count, got[i].allowed) == (own, every, own <= 3 and every <= 8)
    pool = spark.createDataFrame([("a", None), ("a", None), ("b", True), ("b", False), ("b", None)], "p string, ok boolean")
    assert {r.p: (r.n, r.n_ok, r.n_failed, r.success_rate) for r in stats.pool_stats(pool, ["p"], F.col("ok")).collect()} == {"a": (2, 0, 0, 1.0), "b": (3, 1, 1, 0.5)}


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6)], "src long, dst long")
    start, path = spark.createDataFrame([(1,)], "node long"), str(tmp_path / "crawl")
    seen, ended = graph.crawl_in_steps(edges, start, path, 10, 100, steps=2)
    assert not ended and [r.node for r in seen.collect()] == [1, 2, 3]
    seen, ended = graph.crawl_in_steps(edges, start, path, 10, 100)
    assert ended and sorted(map(tuple, seen.collect())) == sorted(map(tuple, graph.reach(edges, start, 10).collect()))
    assert [r.node for r in graph.crawl_in_steps(edges, start, path, 10, 2)[0].collect()] == [1, 2]


def test_row_callbacks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    run = lambda r: None if r["s"] is None else [{"i": r["i"], "t": r["s"] * n} for n in range(1, r["i"] + 1)]
    assert sorted(map(tuple, records.map_rows(df, run, "i int, t string, gone double").collect())) == [(1, "a", None), (2, "b", None), (2, "bb", None)]
    assert [tuple(r) for r in records.map_rows(df.where("i = 1"), lambda r: {"t": r["s"]}, "t string").collect()] == [("a",)]


def test_objects_at_any_depth(spark):
    deep = '{"k":' * 12 + '[{"x": 1}, 2, {"y": [{"z": 3}]}]' + "}" * 12
    from loomfield.operators.learning import list_objects

    got = list_objects(spark.createDataFrame([(1, deep), (2, '{"a": {"b": 1}, "c": [{"d": 4}]}'), (3, "no json"), (4, None)], "i int, body string"), "body", ["i"])
    assert sorted((r.i, r.item) for r in got.collect()) == [(1, '{"x":1}'), (1, '{"y":[{"z":3}]}'), (2, '{"d":4}')]


def test_config_and_json(spark, tmp_path):
    assert readers.load_config(spark)["requests"]["timeout"] == 30
    (tmp_path / "c.yaml").write_text('{"requests": {"timeout": 5}, "own": [1, 2]}')
    got = readers.load_config(spark, str(tmp_path / "c.yaml"))
    assert got["requests"] == {"timeout": 5} and got["own"] == [1, 2] and got["output"]["formats"][0] == "json"
    df = spark.createDataFrame([(1, None, "ü\n")], "a int, b string, c string")
    writers.write_json_array(df, str(tmp_path / "arr"))
    (part,) = (tmp_path / "arr").glob("part-*")
    assert json.loads(part.read_text()) == [{"a": 1, "b": None, "c": "ü\n"}] and "ü" in part.read_text()
    writers.write_json_array(df.limit(0), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")).strip() == "[]"
    values = spark.createDataFrame([("x.json", '{"a": 1}'), ("x.json", "no"), ("x.txt", "{}")], "name string, value string")
    assert sorted(str(r.value_json) for r in readers.parse_values(values, "value", "name").collect()) == ["None", "None", '{"a":1}']
    sheets = documents.parse_xlsx(writers.workbook_with_summary(df))
    assert ("summary", 1, ["rows", "1"]) in sheets and ("summary", 4, ["filled b", "0"]) in sheets


def test_long_runs_of_letters(spark):
    text = "a" * 300_000 + " x@y.org,p@q.de5r@s.net " + "b." * 100_000
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(scalar.EMAIL), F.lit(0)).alias("m")).first().m
    assert got == ["x@y.org", "p@q.de", "5r@s.net"]


def test_exact_retrieval_in_blocks(spark, monkeypatch):
    import numpy as np

    from loomfield.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(120)] + [(500, None), (501, [0.0] * 5), (502, [1.0, 0.0, 0.0, 0.0, 0.0]), (503, [2.0, 0.0, 0.0, 0.0, 0.0]), (504, [3.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(5)
    got = {}
    for r in vectors.cosine_topk(df, df.where("i % 20 = 0 or i > 499"), "i", "v", k=4).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q in [*range(0, 120, 20), 500, 502, 503, 504]:
        want = sorted((-round(float(x[q] @ w), 9), i) for i, w in x.items() if i != q)[:4] if q in x else []
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in want]
    assert vectors.cosine_topk(df, df.limit(0), "i", "v").collect() == []


def test_several_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    got = writers.write_everywhere(df, [str(tmp_path / "a"), "nosuch://x/y", str(tmp_path / "b")])
    assert list(got.values())[::2] == [None, None] and got["nosuch://x/y"] and spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_blocked_elements(spark):
    rows = [("x advert-y", "", ""), ("", "my-ad-box", ""), ("promotion", "", ""), ("plain", "p", "https://a.com/i.png"), ("", "", "https://x.doubleclick.net/a"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, i string, s string")
    assert [r.b for r in df.select(rules.is_blocked_element(F.col("c"), F.col("i"), F.col("s")).alias("b")).collect()] == [True, True, True, False, True, False]


def test_first_distinct_keeps_k_a_task(spark):
    df = spark.range(0, 5000, 1, 6).select((F.col("id") % 3).alias("g"), F.array((F.col("id") % 700).cast("string"), F.lit("x"), F.lit(None).cast("string")).alias("v"))
    got = stats.first_distinct(df, ["g"], F.col("v"), 20, "top")
    for r in got.collect():
        want = sorted({str(i % 700) for i in range(5000) if i % 3 == r.g} | {"x"})
        assert [x for x in r.top if x is not None] == want[: len([x for x in r.top if x is not None])] and len(want[:20]) - 1 <= len(r.top) <= 20
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    every = {r.g: r.a for r in stats.first_distinct(df, ["g"], F.col("v"), None, "a").collect()}
    assert len(every) == 3 and all(len(a) == 701 for a in every.values())
