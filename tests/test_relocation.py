from loomfield.operators import relocation as R
from loomfield.operators.html_tree import parse

OLD = "<body><div class='a b'><p class='t'>Price 5</p></div><div><p>Price 5</p></div></body>"


def test_the_best_way_wins(spark):
    new = {
        1: OLD,
        2: OLD.replace("class='t'", ""),  # same number, same text
        3: "<body><i></i><b></b><div><p>price 5 </p></div><div class='b'><section><p>Price 5</p></section></div></body>",
        4: "<body><i></i><b></b><em></em><div class='c'><p>Price 5</p></div></body>",
        5: "<body><p>Price 6</p></body>",
        6: None,
    }
    old = spark.createDataFrame([(i, "", OLD) for i in [*new, 7]] + [(None, "", OLD), (8, "", "<p>no</p>")], "page_id long, url string, html string")
    pages = spark.createDataFrame([(i, "", h) for i, h in new.items()], "page_id long, url string, html string").selectExpr("*", "1 as digest", "'x' as above")
    tracked = R.track_elements(old, "p.t")
    assert {tuple(r)[1:4] for r in tracked.collect()} == {("p.t", R.text_hash("Price 5"), list(x.attrs.get("class") for x in parse(OLD).walk()).index("t"))}
    got = {r.page_id: (r.strategy, r.place) for r in R.relocate_elements(tracked, pages).collect()}
    number = lambda h, text: [i for i, n in enumerate(parse(h).walk()) if n.tag == "p" and n.text().strip() == text]
    assert got[1] == ("selector", number(OLD, "Price 5")[0]) and got[2] == ("position", number(OLD, "Price 5")[0])
    assert got[3] == ("parent", number(new[3], "Price 5")[0] - 1)  # the section, whose text it is too
    assert got[4][0] == "text" and got[5] == got[6] == got[7] == got[None] == (None, None) and 8 not in got
