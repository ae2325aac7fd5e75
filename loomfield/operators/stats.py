"""Statistics over fact logs: rates, ranks, running values and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.scalar import backoff
from loomfield.operators import substring
from loomfield.session import ensure_checkpoint_dir


def rate(ok: Column) -> Column:
    return F.avg(ok.cast("double"))


def method_rates(attempts: DataFrame, *by: str) -> DataFrame:
    """Success per method from the log, never from counters that are updated in place."""
    return attempts.groupBy(*by, "method").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), rate(F.col("success")).alias("success_rate"))


def best_method(attempts: DataFrame, by: str, least: float) -> DataFrame:
    """The method with the highest success rate above ``least``; ties to the first by name."""
    rates = method_rates(attempts, by).where(F.col("success_rate") > least)
    top = F.min(F.struct((-F.col("success_rate")).alias("r"), F.col("method")))
    return rates.groupBy(by).agg(top.alias("t")).select(by, F.col("t.method").alias("method"), (-F.col("t.r")).alias("success_rate"))


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def first_distinct(df: DataFrame, by: Sequence[str], values: Column, k: int | None, name: str) -> DataFrame:
    """(*by, name): the different elements of the arrays ``values`` in order, the first ``k`` of each group.

    Elements become distinct rows before they meet; with ``k`` each task keeps k of a group at most, both before and
    after the shuffle (Spark's group limit under a row number), so that no state grows with a group."""
    rows = df.select(*by, F.explode(values).alias("__v")).distinct()
    if k is not None:
        rows = last_n(rows, by, [F.col("__v")], k).drop("rank")
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("__v")).alias(name))


def global_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df with rank, each row's place in the order of the whole table, from 1.  Rows are dealt by ranges of the
    order and counted by range, so that no task holds them all; ``order`` must tell rows apart."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__id")).checkpoint()
    before, total = {}, 0
    for r in dealt.groupBy("__range").agg(F.count("*").alias("n"), F.min("__id").alias("low")).orderBy("__range").collect():  # one row a range
        before[r["__range"]] = total - r.low + 1
        total += r.n
    shift = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("__range")) if before else F.lit(1)
    return dealt.withColumn("rank", F.col("__id") + shift).drop("__range", "__id")


def ranked_round_robin(df: DataFrame, order: Sequence[Column], workers: int) -> DataFrame:
    """Each row's worker by its rank modulo the number of workers."""
    return global_rank(df, order).withColumn("worker", F.pmod(F.col("rank") - 1, F.lit(workers)))


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int = 20) -> DataFrame:
    """One result page; sizes above 100 are cut to it."""
    size = min(size, 100)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """An ordered fold per group by any step: the group's values sorted by ``order``, then reduced.  A group must
    fit in a task; fold_linear() splits groups, and streams use keyed state."""
    row = F.struct(*[F.col(o) for o in order], value.alias("__v"))
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return got.select(*by, F.aggregate(F.transform("__rows", lambda r: r["__v"]), start, step).alias(name))


def linear(a: float | Column = 1.0, b: float | Column = 0.0, lo: float | Column = float("-inf"), hi: float | Column = float("inf")) -> Column:
    """A step x -> min(hi, max(lo, a * x + b)) with a >= 0.  Such steps compose to steps of the same form."""
    one = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(one(a).alias("a"), one(b).alias("b"), one(lo).alias("lo"), one(hi).alias("hi"))


def _applied(step: Column, x: Column) -> Column:
    # 0 times infinity isn't a number
    inner = F.when(step["a"] == 0, step["b"]).otherwise(step["a"] * x + step["b"])
    return F.least(step["hi"], F.greatest(step["lo"], inner))


def _then(first: Column, second: Column) -> Column:
    b = F.when(second["a"] == 0, second["b"]).otherwise(second["a"] * first["b"] + second["b"])
    return F.struct((first["a"] * second["a"]).alias("a"), b.alias("b"), _applied(second, first["lo"]).alias("lo"), _applied(second, first["hi"]).alias("hi"))


def fold_linear(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Column, start: float, name: str, unit: str = "day") -> DataFrame:
    """An ordered fold per group by linear() steps: the steps of each ``unit`` of time (the first of ``order``)
    are composed to one, then those of a group in order.  So a group of any size is dealt by group and unit,
    and only one step a unit meets in a task."""
    row = F.struct(*[F.col(o) for o in order], step.alias("__s"))
    parts = df.groupBy(*by, F.date_trunc(unit, F.col(order[0])).alias("__t")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    composed = F.aggregate(F.transform("__rows", lambda r: r["__s"]), linear(), _then)
    whole = parts.select(*by, "__t", composed.alias("__s")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__t", "__s"))).alias("__rows"))
    return whole.select(*by, F.aggregate(F.transform("__rows", lambda r: r["__s"]), F.lit(float(start)), lambda x, s: _applied(s, x)).alias(name))


def _chosen(ok: Column, yes: Column, no: Column) -> Column:
    return F.when(ok, yes).otherwise(no)


def confidence_step(ok: Column) -> Column:
    """Up 0.05 to 1 at most, down 0.1 without a floor."""
    return linear(b=F.when(ok, 0.05).otherwise(-0.1), hi=1.0)


def improve_step(ok: Column) -> Column:
    """Up 0.1 to 1 at most, down 0.15 to 0.1 at least."""
    return _chosen(ok, linear(b=0.1, hi=1.0), linear(b=-0.15, lo=0.1))


def profile_step(ok: Column) -> Column:
    return linear(b=F.when(ok, 0.1).otherwise(-0.1), lo=0.0, hi=1.0)


def pattern_step(ok: Column) -> Column:
    return _chosen(ok, linear(b=0.1, hi=0.95), linear())


def ema_step(v: Column) -> Column:
    return linear(a=0.7, b=v * 0.3)


def delay_step(status: Column, retry_after: Column, down: float = 0.95, floor: float = 1.0, cap: float = 60.0, retry_scale: float = 1.0) -> Column:
    """Success shortens the delay, 429 doubles it or takes retry_after, 5xx adds half."""
    limited = _chosen(retry_after.isNotNull(), linear(a=0.0, b=F.coalesce(retry_after * retry_scale, F.lit(0.0)), hi=cap), linear(a=2.0, hi=cap))
    return F.when(status == 429, limited).when(status >= 500, linear(a=1.5, hi=cap)).otherwise(linear(a=down, lo=floor))


def breaker_step(acc: Column, v: Column, threshold: int = 5, reset_s: int = 60) -> Column:
    """A circuit breaker as struct(state, failures, opened): five failures open it, after reset_s one try is
    let through, a success closes it.  v: struct(t seconds, ok)."""
    cooled = (acc["state"] == "open") & (v["t"] - acc["opened"] >= reset_s)
    state = F.when(cooled, "half_open").otherwise(acc["state"])
    refused = state == "open"
    failures = F.when(refused, acc["failures"]).when(v["ok"], F.lit(0)).otherwise(acc["failures"] + 1)
    opens = ~refused & ~v["ok"] & ((failures >= threshold) | (state == "half_open"))
    new = F.when(refused, "open").when(v["ok"], "closed").when(opens, "open").otherwise(state)
    return F.struct(new.alias("state"), failures.alias("failures"), F.when(opens, v["t"]).otherwise(acc["opened"]).alias("opened"))


def runs_of_failures(df: DataFrame, by: str, order: str, ok: str) -> DataFrame:
    """(by, longest): the longest run of failures in order, by gaps and islands."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.select(by, order, ok, F.count_if(F.col(ok)).over(w).alias("island")).where(~F.col(ok))
    runs = marked.groupBy(by, "island").count()
    return df.select(by).distinct().join(runs.groupBy(by).agg(F.max("count").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("longest"))


def sliding_allowed(df: DataFrame, by: str, seconds: Column, window_s: int, limit: int) -> DataFrame:
    """Requests in the window_s seconds up to each request, and whether that keeps within the limit."""
    w = Window.partitionBy(by).orderBy(seconds).rangeBetween(-window_s, Window.currentRow)
    return df.withColumn("in_window", F.count("*").over(w)).withColumn("within", F.col("in_window") <= limit)


CATEGORY_OF_PROBLEM = {
    # fixed values
    "bot_detected": "anti_detection",
    "cloudflare": "protection",
    "rate_limited": "rate_limiting",
    "captcha": "captcha",
    "js_required": "rendering",
    "auth_required": "authentication",
    "empty_content": "data_extraction",
    "http_error": "network",
}


def skill_candidates(problems: DataFrame, skills: DataFrame, categories: Mapping[str, str] = CATEGORY_OF_PROBLEM, most: int = 10, per_word: int = 5) -> DataFrame:
    """problems with skill, each candidate once: the ``most`` surest skills of the problem's type, of its host as
    site pattern and, from confidence 0.5, of its category, and for each of its first five keywords the
    ``per_word`` surest ones whose keywords or tags hold it.

    problems: problem_id, problem_type, keywords, host.  Lists are made once for each type, word, host and
    category, so that a problem meets a few dozen skills however many there are."""
    sure, row = [F.desc("confidence"), F.desc("success_rate"), F.col("id")], F.struct(*skills.columns)

    def lists(found: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
        top = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("nth") <= k)
        return top.select("key", "skill")

    own = skills.select(*skills.columns, row.alias("skill"))
    by_type = lists(own.withColumn("key", F.concat(F.lit("t:"), "problem_type")), sure, most)
    by_host = lists(own.where("site_pattern is not null").withColumn("key", F.concat(F.lit("h:"), "site_pattern")), sure, most)
    by_category = lists(own.where("confidence >= 0.5").withColumn("key", F.concat(F.lit("c:"), "category")), sure, most)
    first = F.array_distinct(F.slice("keywords", 1, 5))
    words = problems.select(F.explode(first).alias("word")).distinct()
    held = substring.matches(own, "id", ["error_keywords", "tags"], words).select("id", F.col("needle").alias("word"))
    by_word = lists(own.join(held, "id").withColumn("key", F.concat(F.lit("w:"), "word")), [F.desc("confidence"), F.col("id")], per_word)
    category = F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("problem_type"))
    keys = F.array_compact(F.concat(F.array(F.concat(F.lit("t:"), "problem_type"), F.concat(F.lit("h:"), "host"), F.concat(F.lit("c:"), category)), F.transform(first, lambda w: F.concat(F.lit("w:"), w))))
    every = by_type.unionAll(by_host).unionAll(by_category).unionAll(by_word)
    asked = problems.withColumn("key", F.explode(keys)).join(every, "key")
    return asked.drop("key").dropDuplicates(["problem_id", "skill"])


def retry_outcomes(attempts: DataFrame, job: Sequence[str], order: Sequence[str], ok: str, most: int = 3) -> DataFrame:
    """Each job's retries by its log: executions (up to the first success, ``most`` retries after the first one at
    most), whether it succeeded within them, and the seconds waited between them by exponential backoff."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(ok).alias("__ok"))))
    tried = attempts.groupBy(*job).agg(rows.alias("__rows")).withColumn("__rows", F.slice("__rows", 1, most + 1))
    hit = F.array_position(F.transform("__rows", lambda r: r["__ok"]), True)
    n = F.when(hit > 0, hit).otherwise(F.size("__rows").cast("long"))
    wait = F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0.0), lambda s, i: s + F.when(i > 0, backoff(i - 1)).otherwise(0.0))
    return tried.select(*job, n.alias("executions"), (hit > 0).alias("succeeded"), wait.alias("waited"))


def both_limits(df: DataFrame, by: str, seconds: Column, own: tuple[int, int], every: tuple[int, int]) -> DataFrame:
    """df with own_count and all_count, the requests of the key and of all keys in the seconds up to each request,
    and allowed, whether both keep within their limits; a limit is (requests, seconds).  Requests of all keys are
    counted by second first, so that no task holds more than a row a second."""
    (own_limit, own_s), (limit, all_s) = own, every
    rows = df.withColumn("__s", seconds.cast("long"))
    w = Window.partitionBy(by).orderBy("__s").rangeBetween(-own_s, Window.currentRow)
    total = rows.groupBy("__s").agg(F.count("*").alias("__n"))
    total = total.select("__s", F.sum("__n").over(Window.orderBy("__s").rangeBetween(-all_s, Window.currentRow)).alias("all_count"))
    counted = rows.withColumn("own_count", F.count("*").over(w)).join(total, "__s")
    return counted.withColumn("allowed", (F.col("own_count") <= own_limit) & (F.col("all_count") <= limit)).drop("__s")


def pool_stats(df: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """n, n_ok, n_failed and success_rate per group; a null ``ok`` is a member that wasn't tried yet, and a group
    of those alone has the rate 1."""
    tried = F.count(ok.cast("int"))
    good = F.count_if(ok)
    return df.groupBy(*by).agg(F.count("*").alias("n"), good.alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.when(tried > 0, good / tried).otherwise(1.0).alias("success_rate"))


def match_score(problem_type: Column, keywords: Column, host: Column, skill: dict[str, Column]) -> Column:
    """How well a skill fits a problem, at most 1: type, shared keywords, host suffix, confidence, success,
    and keywords found within the skill's texts."""
    own = F.array_union(F.split(skill["error_keywords"], ","), F.split(skill["tags"], ","))
    shared = F.size(F.array_intersect(own, F.array_distinct(keywords)))
    fuzzy = F.aggregate(
        keywords,
        F.lit(0.0),
        lambda s, k: s + F.when(skill["error_keywords"].contains(k), 0.05).otherwise(0.0) + F.when(skill["tags"].contains(k), 0.03).otherwise(0.0),
    )
    site = F.coalesce(skill["site_pattern"], F.lit(""))
    on_site = (site != "") & (F.coalesce(host, F.lit("")) != "") & host.endswith(F.replace(site, F.lit("*"), F.lit("")))
    total = F.when(problem_type == skill["problem_type"], 0.4).otherwise(0.0) + F.least(F.lit(0.2), shared * 0.05) + F.when(on_site, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), total + skill["confidence"] * 0.15 + skill["success_rate"] * 0.15 + fuzzy)


def should_apply(confidence: Column, success_rate: Column, attempts: Column) -> Column:
    return F.when(confidence >= 0.8, True).when(attempts >= 3, True).when(success_rate < 0.3, False).otherwise(True)
