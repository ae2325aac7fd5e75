import random
import re

from loomfield.llm import urls

ODD = [None, "", "no scheme/x", "://", "http://", "http://NET", "http://a.NET/", "http://net/?x", "HTTPS://Sub.Example.NET/en/1?x=/fr/", "http://example.net/en", "http://notexample.net/en/1",
       "http://x.example.com/de/9#a", "http://example.com.evil/de/9", "http://a.org/fr/1", "http://org/fr/", "http://a.org?/fr/", "http://a://b.net/x", "http://É.com/é\nx/1", "http://h.com:80//a//b/", "http://h.com/" + "a/" * 5000]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, said in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, said)
    return host, path, best[0] if best else None, best[1] if best else None


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)) + [(3, ODD[3])], "page_id long, url string").selectExpr("*", "'x' as host", "1 as template", "2 as t0")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        host, path, rule, said = brute(ODD[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said or "allow")


def test_templates_merge_and_reject(spark):
    rows, labels, k = [], [], 0
    for section, bad in (("news", 0), ("sport", 0), ("spam", 1)):
        for i in range(40):
            rows.append((k := k + 1, f"http://h.com/{section}/{i}/view.html"))
            labels.append((k, bad))
    for i in range(60):
        rows.append((k := k + 1, f"http://h.com/tag/name-{chr(97 + i % 26)}{'x' * (i // 26)}"))
    rows.append((k := k + 1, "http://h.com/spam/777/view.html"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([*labels, (1, None), (1, 0), (None, 1)], "page_id long, bad int")).collect()}
    assert got[1].template == got[41].template == "/~/{n}/view.html"
    assert got[k].template == "/spam/{n}/view.html" and got[k].verdict == "block"
    assert got[1].verdict == got[121].verdict == "allow" and got[121].template == "/tag/*"


def test_forms(spark):
    cases = {"123": "{n}", "12.html": "{n}.html", "2024-01-02": "{date}", "deadbeef01": "{hex}", "about": "about", "v2": "v2", "0f8fad5b-d9cb-469f-a165-70867728950e": "{uuid}"}
    df = spark.createDataFrame([(x,) for x in cases], "s string")
    assert {r.s: r.t[0] for r in df.select("s", urls.template(df["s"]).alias("t")).collect()} == cases


def form(segment):
    stem, ext = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z0-9]{1,5})?", segment).groups()
    for pattern, name in urls._FORMS:
        if re.fullmatch(pattern.strip("^$"), stem.lower()) and (name != "{hex}" or len(stem) >= 6):
            return name + (ext or "")
    return segment


def plain_verdicts(pages, labels, max_children=32, rare=0.05, z=1.96, min_bad=0.7, weight=4.0):
    """page -> (template, verdict) by plain dictionaries."""
    known, count = {}, {}
    for p, bad in labels:
        known[p] = max(bad, known.get(p, 0))
    t0 = {}
    for p, url in pages:
        host, path, _, said = brute(url)
        t0[p] = (host, tuple(form(s) for s in path.split("/") if s), said)
        c = count.setdefault(t0[p][:2], [0, 0, 0])
        c[0] += 1
        if p in known:
            c[1] += 1
            c[2] += known[p]
    now = {k: list(k[1]) for k in count}
    for level in reversed(range(max((len(k[1]) for k in count), default=0))):
        children = {}
        for k, t in now.items():
            if len(t) > level:
                node = children.setdefault((k[0], tuple(t[:level])), {}).setdefault(t[level], [0, 0, 0, set(), []])
                for i in range(3):
                    node[i] += count[k][i]
                node[3].add(tuple(t[level + 1 :]))
                node[4].append(k)
        for kids in children.values():
            if len(kids) < 2:
                continue
            total = sum(c[0] for c in kids.values())
            pool, groups = {}, {}
            for c in kids.values():
                pooled = pool.setdefault(frozenset(c[3]), [0, 0])
                pooled[0] += c[1]
                pooled[1] += c[2]
            side = {s: (frozenset(c[3]), c[2] * pool[frozenset(c[3])][0] > pool[frozenset(c[3])][1] * c[1]) for s, c in kids.items()}
            for s, c in kids.items():
                g = groups.setdefault(side[s], [0, 0, 0])
                g[0] += 1
                g[1] += c[1]
                g[2] += c[2]
            for s, c in kids.items():
                like, labelled, bad = groups[side[s]]
                p = bad / labelled if labelled else 0.0
                far = abs(c[2] - c[1] * p) > z * (c[1] * p * (1 - p)) ** 0.5 + 0.5
                to = "*" if len(kids) > max_children and c[0] < rare * total else "~" if like > 1 and not far and not s.startswith("{") else s
                for k in c[4]:
                    now[k][level] = to
    labelled, bad = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
    share, nodes = bad / labelled if labelled else 0.0, {}
    for k, t in now.items():
        n = nodes.setdefault((k[0], tuple(t)), [0, 0])
        n[0] += count[k][1]
        n[1] += count[k][2]
    out = {}
    for p, (host, t, said) in t0.items():
        n = nodes[host, tuple(now[host, t])]
        out[p] = "/" + "/".join(now[host, t]), said or ("block" if (n[1] + weight * share) / (n[0] + weight) >= min_bad else "allow")
    return out


def test_templates_and_verdicts_against_a_plain_version(spark):
    rnd = random.Random(8)
    pages, labels = [], []
    for k in range(1500):
        kind = rnd.choice(["news", "sport", "spam", "casino", "tag", "deep"])
        leaf = {"tag": rnd.choice("abcdefghij") * rnd.randint(1, 6), "deep": "/".join("xy"[rnd.random() < 0.02] for _ in range(30))}.get(kind, f"{rnd.choice(['a', 'b'])}/{rnd.randint(1, 99)}.html")
        pages.append((k, f"http://{rnd.choice(['h.com', 'i.com', 'a.net'])}/{kind}/{leaf}"))
        if rnd.random() < 0.4:
            labels.append((k, int(rnd.random() < (0.95 if kind in ("spam", "casino") else 0.05))))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    want = plain_verdicts(pages, labels)
    assert {r.page_id: (r.template, r.verdict) for r in got} == want
    assert sum(v == "block" for _, v in want.values()) > 300 and len({t for t, _ in want.values()}) > 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, spark.createDataFrame([], "page_id long, bad int")).collect() == []


def test_rules_label_the_templates_of_other_pages(spark):
    """Pages in a blocked folder give their templates bad labels, which count for alike branches that no rule fits."""
    pages = [(i, f"http://a.example.com/de/{i}") for i in range(6)] + [(10 + i, f"http://a.example.com/en/{i}") for i in range(3)] + [(20, "http://a.example.com/about.html"), (21, "http://b.example.com/en/7")]
    pages += [(30 + i, f"http://c.org/fr/{i}") for i in range(6)] + [(40, "http://c.org/en/1"), (41, "http://free.xyz/en/1")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert [got[i].verdict for i in (0, 10, 11, 12)] == ["block"] * 4 and got[10].rule is None and got[10].template == "/~/{n}"
    assert [got[i].verdict for i in (20, 21, 30, 40, 41)] == ["allow"] * 5


def test_labels_count_beside_rules(spark):
    """Labels mark the templates of pages that no rule fits; where both speak, the rule's word counts."""
    pages = [(i, f"http://free.xyz/spam/{i}") for i in range(20)] + [(20 + i, f"http://free.xyz/news/{i}") for i in range(20)] + [(40 + i, f"http://c.org/fr/{i}") for i in range(6)] + [(50, "http://c.org/en/1")]
    labels = spark.createDataFrame([(i, int(i < 18 or i >= 40)) for i in range(46) if i not in (18, 19)], "page_id long, bad int")
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(df, labels, label_by_rules=True).collect()}
    assert [got[i] for i in (0, 18, 19)] == ["block"] * 3 and [got[i] for i in (20, 40, 45, 50)] == ["allow"] * 4
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()}[0] == "allow"


def test_registered_query_reads_labels(spark, tmp_path):
    from loomfield.llm.queries import op4_url_templates

    spark.createDataFrame([(i, f"http://free.xyz/{'spam' if i < 20 else 'news'}/{i}") for i in range(40)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, int(i >= 20), 0) for i in range(2, 40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r.verdict for r in op4_url_templates(spark, str(tmp_path)).collect()}
    assert got[0] == got[1] == "block" and got[20] == "allow"
