"""Small learned and guessed things: JSON out of model answers, regex answers to prompts, selectors from
demonstrations, skill names, agents for tasks, next runs of schedules."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.scalar import EMAIL, base_domain, blank, lookup, netloc
from loomfield.operators import substring
from loomfield.session import ensure_checkpoint_dir

# ---- answers


def repaired_json(answer: Column) -> Column:
    """The JSON in a model's answer: a fenced block, the whole, or what the outermost braces hold; else an
    error object with the answer's start."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    text = F.when(fenced != "", fenced).otherwise(answer)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    error = F.to_json(F.struct(F.lit("no JSON found").alias("error"), F.left(text, F.lit(500)).alias("raw")))
    return F.coalesce(F.to_json(F.try_parse_json(F.trim(text))), F.to_json(F.try_parse_json(F.nullif(braced, F.lit("")))), error)


def flat_object(answer: Column) -> Column:
    """The first object without nested braces, as JSON; null if there is none."""
    return F.to_json(F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{[^{}]*\})", 1), F.lit(""))))


#: What a prompt of each kind asks for, as the type of its answer.  Names are fixed values.
TEMPLATES = {
    "products": "products array<struct<name string, price string, original_price string, description string, image_url string, rating string, reviews_count string, in_stock boolean, brand string>>",
    "articles": "article struct<title string, author string, published_date string, content string, excerpt string, category string, tags array<string>, image_url string, reading_time string>",
    "contacts": "contacts struct<company_name string, emails array<string>, phones array<string>, address string, social_media struct<twitter string, linkedin string, facebook string, instagram string>>",
    "jobs": "jobs array<struct<title string, company string, location string, salary string, description string, requirements array<string>, benefits array<string>, posted_date string, job_type string, remote string>>",
    "prices": "prices array<struct<item_name string, current_price string, original_price string, currency string, discount_percent string, available boolean, unit_price string>>",
}


def template_items(answers: DataFrame, answer: str, template: str, keep: Sequence[str]) -> DataFrame:
    """keep and the fields of each item that a template's answers hold, with the template's types: a row for every
    product, job or price, one for an article or contact.  Answers are repaired first; one without the template's
    object gives no row, fields that it lacks are null, those that the template lacks are left out."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}, there are {sorted(TEMPLATES)}")
    schema = TEMPLATES[template]
    name, kind = schema.split(" ", 1)
    held = F.from_json(repaired_json(F.col(answer)), schema)[name]
    items = F.explode(held) if kind.startswith("array") else F.explode(F.when(held.isNotNull(), F.array(held)))
    return answers.select(*keep, items.alias("__item")).where("__item IS NOT NULL").select(*keep, "__item.*")


def prompted(html: Column, prompt: Column) -> dict[str, Column]:
    """Arrays of what a prompt's words ask for, null for what they don't."""
    low, none = F.lower(blank(prompt)), F.lit(None).cast("array<string>")
    every = lambda p, g=0: F.regexp_extract_all(html, F.lit(p), F.lit(g))
    ask = lambda words, found: F.when(low.rlike(words), found).otherwise(none)
    return {
        "emails": ask("email", F.array_sort(F.array_distinct(every(EMAIL)))),
        "phones": ask("phone", every(r"\+?1?[-. ]?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}")),
        "prices": ask("price", every(r"\$[0-9,]+\.?[0-9]*")),
        "titles": ask("title|heading", F.slice(every(r"(?is)<h[1-3][^>]*>([^<]*)", 1), 1, 10)),
        "links": ask("link|url", F.slice(every(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1), 1, 20)),
        "images": ask("image", F.slice(every(r"""(?is)<img\s[^>]*?src\s*=\s*["']([^"']+)["']""", 1), 1, 20)),
    }


def list_objects(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Objects that are direct items of a list reached through nested objects, as JSON; objects that are
    given aren't searched themselves.  A level of nesting is a round, until none holds an object; each is
    written, so that the plan doesn't grow with the depth."""
    ensure_checkpoint_dir(df.sparkSession)
    now, out = df.select(*keep, F.try_parse_json(F.col(body)).alias("__v")), None
    while True:
        kind = F.schema_of_variant("__v")
        lists = now.where(kind.startswith("ARRAY")).select(*keep, F.explode(F.try_variant_get("__v", "$", "array<variant>")).alias("__i"))
        found = lists.where(F.schema_of_variant("__i").startswith("OBJECT")).select(*keep, F.to_json("__i").alias("item"))
        out = found if out is None else out.unionAll(found)
        inner = now.where(kind.startswith("OBJECT")).select(*keep, F.explode(F.map_values(F.try_variant_get("__v", "$", "map<string,variant>"))).alias("__v"))
        # written as JSON; a value without a bracket holds no list
        inner = inner.select(*keep, F.to_json("__v").alias("__v")).where("__v like '%[%'").checkpoint()
        if inner.isEmpty():
            return out
        now = inner.withColumn("__v", F.parse_json("__v"))


# ---- demonstrations

FIELD_HINTS = (
    # fixed values, in this order
    ("title", ("h1", "h2", "[class*='title']", "[class*='heading']")),
    ("price", ("[class*='price']", "[class*='cost']", "[id*='price']")),
    ("description", ("p", "[class*='desc']", "[class*='text']")),
    ("image", ("img", "[class*='image']", "[class*='photo']")),
    ("link", ("a", "[class*='link']")),
)


def generalized_selector(selector: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(selector, r":nth-child\(\d+\)", ""), r":nth-of-type\(\d+\)", ":first-of-type")


def inferred_field(selector: Column) -> Column:
    out = None
    for name, hints in FIELD_HINTS:
        hit = F.lower(selector).contains(hints[0])
        for h in hints[1:]:
            hit = hit | F.lower(selector).contains(h)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(None).cast("string"))


def learned_workflows(actions: DataFrame) -> DataFrame:
    """actions: demo_id, seq, action, selector.  (demo_id, field, selector): each field's last clicked selector."""
    clicks = actions.where("action = 'click' and selector <> ''").withColumn("field", inferred_field(F.col("selector"))).where("field is not null")
    return clicks.groupBy("demo_id", "field").agg(F.max_by(generalized_selector(F.col("selector")), "seq").alias("selector"))


# ---- skills and agents

SKILL_NAMES = {
    # fixed values
    "bot_detected": "Bot Detection Bypass",
    "cloudflare": "Cloudflare Challenge",
    "rate_limited": "Rate Limit Handler",
    "captcha": "CAPTCHA Solver",
    "js_required": "JS Render Fix",
    "auth_required": "Auth Handler",
    "empty_content": "Empty Content Fix",
}
#: Fixed values.
METHOD_HINTS = {"use_browser": "Browser Method", "add_delay": "Delayed Approach", "rotate_proxy": "Proxy Method", "solve_captcha": "Auto-Solve"}


def skill_name(problem_type: Column, url: Column, method: Column) -> Column:
    host = netloc(url)
    main = F.when(host.contains("."), F.substring_index(base_domain(host), ".", 1)).otherwise(host)
    domain = F.when((main != "") & ~main.isin("com", "org", "net", "io"), F.concat(F.lit("for "), main))
    hint = F.when(blank(method) != "", F.coalesce(lookup(method, METHOD_HINTS), F.lit("")))
    return F.concat_ws(" - ", lookup(problem_type, SKILL_NAMES, F.initcap(F.replace(problem_type, F.lit("_"), F.lit(" ")))), domain, hint)


def first_solution(problems: DataFrame, patterns: DataFrame) -> DataFrame:
    """problems: problem_type, keywords; patterns: problem_type, seq, technique, confidence.  The first pattern
    of the type, its confidence cut by a fifth without keywords; 0.4 and no technique where there is none."""
    first = patterns.groupBy("problem_type").agg(F.min_by(F.struct("technique", "confidence"), "seq").alias("p"))
    cut = F.when(F.size("keywords") > 0, 1.0).otherwise(0.8)
    joined = problems.join(first, "problem_type", "left")
    return joined.withColumn("technique", F.col("p.technique")).withColumn("confidence", F.coalesce(F.col("p.confidence") * cut, F.lit(0.4))).drop("p")


def suggestions(flags: Mapping[str, Column]) -> Column:
    """What to try, by a site's flags cloudflare, antibot, captcha, lazy_load."""
    tries = (
        # fixed values
        (flags["cloudflare"], "Use stealth browser mode"), (flags["antibot"], "Try proxy rotation"), (flags["lazy_load"], "Use scroll pattern"), (flags["captcha"] | flags["lazy_load"], "Increase wait times")
    )
    return F.array_compact(F.array(*[F.when(f, s) for f, s in tries]))


def best_agent(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """tasks: task_type; agents: agent, specialization, completed.  A specialisation that holds the task's type, or is
    held by it, in any case, counts one, experience a hundredth each; a score must be above 0; ties to the first
    name.  Empty names hold nothing.

    The best agent of each specialisation is found first, and the most experienced of all, who is the best of those
    that don't fit; types and specialisations meet by what they hold, not in pairs."""
    types = tasks.select("task_type", F.lower("task_type").alias("t")).where("t IS NOT NULL").distinct().checkpoint()
    top = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct((-F.col("completed") / 100).alias("s"), F.col("agent"))).alias("b"))
    skilled = top(agents.where("specialization <> ''").withColumn("a", F.lower("specialization")), "a").checkpoint()
    fit = substring.holding(skilled.select("a"), types.select("t")).select(F.col("text").alias("a"), F.col("needle").alias("t"))
    fit = fit.unionAll(substring.holding(types.select("t"), skilled.select("a")).select(F.col("needle").alias("a"), F.col("text").alias("t"))).distinct()
    fitting = types.join(fit, "t").join(skilled, "a").select("task_type", (1 - F.col("b.s")).alias("score"), F.col("b.agent").alias("agent"))
    # one row, the same for every type
    veteran = top(agents).first()
    if veteran and veteran.b:
        fitting = fitting.unionAll(types.select("task_type", F.lit(-veteran.b.s).alias("score"), F.lit(veteran.b.agent).alias("agent")))
    best = fitting.where("score > 0").groupBy("task_type").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("agent"))).alias("b"))
    return best.select("task_type", "b.agent", (-F.col("b.s")).alias("score"))


# ---- schedules

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_fields(expression: str) -> tuple[frozenset[int], ...]:
    """The allowed minutes, hours, days, months and weekdays (0 is Sunday, as is 7)."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"a cron expression has five fields: {expression!r}")
    out = []
    for part, (low, high) in zip(parts, _RANGES):
        allowed: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, dash, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b) if dash else (high if step else int(a)))
            if not low <= first <= last <= high or step and int(step) < 1:
                raise ValueError(f"bad cron field {part!r}")
            allowed.update(range(first, last + 1, int(step or 1)))
        out.append(frozenset(allowed))
    out[4] = frozenset(d % 7 for d in out[4])
    return tuple(out)


def next_run(expression: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after ``after`` that fits; with both days restricted either may fit; None within
    eight years."""
    minutes, hours, days, months, weekdays = cron_fields(expression)
    any_day, any_weekday = expression.split()[2] == "*", expression.split()[4] == "*"
    day = after.date()
    for _ in range(8 * 366):
        a, b = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month in months and (a and b if any_day or any_weekday else a or b):
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = dt.datetime(day.year, day.month, day.day, h, m)
                    if at > after:
                        return at
        day += dt.timedelta(days=1)
    return None


def next_runs(jobs: DataFrame, cron: str = "cron", after: str = "last_run") -> DataFrame:
    """jobs with next_run, as next_run() has it; null where the expression or the time is null or the expression wrong.

    Each different expression is read once.  Its days are laid out as a calendar, as long as the jobs' times and eight
    years, shared by all expressions with the same days; a job then looks up its own day and the next one that fits."""
    ensure_checkpoint_dir(jobs.sparkSession)

    @F.pandas_udf("string")
    def read(crons: pd.Series) -> pd.Series:
        def one(c):
            try:
                minutes, hours, days, months, weekdays = map(sorted, cron_fields(c))
            except (ValueError, AttributeError):
                return None
            either = c.split()[2] != "*" and c.split()[4] != "*"
            return json.dumps({"times": [60 * h + m for h in hours for m in minutes], "day": json.dumps([days, months, weekdays, either])})

        return crons.map(one)

    plans = jobs.select(F.col(cron).alias("__cron")).where("__cron IS NOT NULL").distinct().select("__cron", F.from_json(read("__cron"), "times array<int>, day string").alias("p"))
    plans = plans.where("p.day IS NOT NULL").select("__cron", "p.times", "p.day").checkpoint()
    at = F.col(after).cast("timestamp_ntz")
    first, last = jobs.agg(F.min(F.to_date(at)), F.max(F.to_date(at))).first()
    none = F.lit(None).cast("timestamp_ntz")
    if first is None or plans.isEmpty():
        return jobs.withColumn("next_run", none)
    part = lambda i: F.from_json(F.get(F.from_json("day", "array<string>"), F.lit(i)), "array<int>")
    days = plans.select("day").distinct().select("day", part(0).alias("days"), part(1).alias("months"), part(2).alias("weekdays"), F.get(F.from_json("day", "array<string>"), F.lit(3)).cast("boolean").alias("either"))
    span = F.sequence(F.lit(first), F.date_add(F.lit(last), 8 * 366))
    dates = days.withColumn("date", F.explode(span))
    a, b = F.array_contains("days", F.dayofmonth("date")), F.array_contains("weekdays", F.dayofweek("date") - 1)
    fits = F.array_contains("months", F.month("date")) & F.when(F.col("either"), a | b).otherwise(a & b)
    later = Window.partitionBy("day").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    calendar = dates.withColumn("fits", fits).select("day", "date", "fits", F.min(F.when(F.col("fits"), F.col("date"))).over(later).alias("next"))
    # names of its own, as jobs may have columns like these
    calendar = calendar.where(F.col("date") <= F.lit(last)).select(*[F.col(c).alias(f"__{c}") for c in ("day", "date", "fits", "next")])
    plans = plans.select("__cron", F.col("times").alias("__times"), F.col("day").alias("__day"))

    rows = jobs.withColumn("__date", F.to_date(at)).withColumn("__cron", F.col(cron)).join(plans, "__cron", "left").join(calendar, ["__day", "__date"], "left")
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.expr(f"extract(SECOND FROM cast(`{after}` AS timestamp_ntz))")
    today = F.try_element_at(F.filter("__times", lambda m: m * 60 > seconds), F.lit(1))
    on = lambda date, minute: date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)
    soon = F.col("__next") < F.date_add("__date", 8 * 366)
    run = F.when(F.col("__fits") & today.isNotNull(), on(F.col("__date"), today)).when(soon, on(F.col("__next"), F.get("__times", F.lit(0))))
    return rows.select(*[F.col(f"`{c}`") for c in jobs.columns], run.alias("next_run"))


def expectations(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """(rule, n_failed, n_rows) of data-quality rules, in one pass; null fails."""
    rules = list(rules)
    got = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, (_, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col("n").alias("n_rows")) for i, (name, _) in enumerate(rules)])
    return got.select(F.explode(rows).alias("r")).select("r.*")
