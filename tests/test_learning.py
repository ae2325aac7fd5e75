import datetime as dt
import random

import pytest

from loomfield.operators.learning import cron_fields, next_run


def test_next_runs():
    at = dt.datetime(2024, 2, 28, 23, 50)
    assert next_run("*/15 * * * *", at) == dt.datetime(2024, 2, 29, 0, 0)
    assert next_run("0 9 * * 1-5", dt.datetime(2024, 3, 1, 9, 0)) == dt.datetime(2024, 3, 4, 9, 0)
    assert next_run("0 0 29 2 *", dt.datetime(2024, 2, 29, 0, 0)) == dt.datetime(2028, 2, 29, 0, 0)
    assert next_run("0 0 13 * 5", dt.datetime(2024, 9, 1)) == dt.datetime(2024, 9, 6)
    assert next_run("5 4 * * 7", dt.datetime(2024, 3, 2)) == dt.datetime(2024, 3, 3, 4, 5)
    assert next_run("0 0 31 2 *", at) is None


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "a * * * *"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        cron_fields(bad)


def test_next_runs_of_a_table_are_those_of_each_job(spark):
    from loomfield.operators.learning import next_runs

    rnd = random.Random(2)
    crons = ["*/15 * * * *", "0 9 * * 1-5", "0 0 29 2 *", "0 0 13 * 5", "5 4 * * 7", "0 0 31 2 *", "30 23 1,15 1-3 *", "* * * * *", "0 0 * * 0", "a b", None, "59 23 31 12 *"]
    rows = [(i, rnd.choice(crons), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 3 * 366 * 86400), microseconds=rnd.choice([0, 5]))) for i in range(300)]
    rows += [(1000 + i, c, dt.datetime(2024, 2, 29, 0, 0)) for i, c in enumerate(crons)] + [(2000, "* * * * *", None)]
    df = spark.createDataFrame(rows, "id long, cron string, last_run timestamp_ntz").selectExpr("*", "'x' AS day", "1 AS next", "2 AS fits", "3 AS times")

    def one(c, t):
        try:
            return next_run(c, t) if c is not None and t is not None else None
        except ValueError:
            return None

    assert {r.id: r.next_run for r in next_runs(df).collect()} == {i: one(c, t) for i, c, t in rows}
    assert [r.next_run for r in next_runs(df.where("id = 2000")).collect()] == [None] and next_runs(df.limit(0)).collect() == []


def test_answers_by_template(spark):
    from loomfield.operators.learning import TEMPLATES, template_items

    said = [(1, 'Sure {"article": {"title": "T", "tags": ["a", "b"], "odd": 1}}'), (2, '{"article": null}'), (3, "no"), (4, None), (5, '{"jobs": [{"title": "x", "requirements": ["r"]}, null]}')]
    df = spark.createDataFrame(said, "id long, answer string")
    assert [(r.id, r.title, r.tags, r.author) for r in template_items(df, "answer", "articles", ["id"]).collect()] == [(1, "T", ["a", "b"], None)]
    assert [(r.id, r.title, r.requirements) for r in template_items(df, "answer", "jobs", ["id"]).collect()] == [(5, "x", ["r"])]
    assert all(template_items(df, "answer", t, ["id"]).count() <= 1 for t in TEMPLATES)
    with pytest.raises(ValueError):
        template_items(df, "answer", "recipes", ["id"])
