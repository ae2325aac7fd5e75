"""Statistics, rankings, scores and folds over skills, attempts, queues and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators import breaker, records, stats, substring, vector_index, vectors
from loomfield.plans.registry import query
from loomfield.plans.views import ATTEMPTS, QUEUE, SKILLS, attempts, queue, skills, table
from loomfield.session import ensure_checkpoint_dir


@query(f"WITH {SKILLS} SELECT category, count(*) AS n FROM skills GROUP BY category")
def skill_counts_by_category(spark, sf_dir):
    return skills(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {SKILLS} SELECT count(*) AS n, count(*) FILTER (WHERE use_count > 0) AS n_used, round(avg(confidence), 9) AS avg_confidence, round(avg(success_rate), 9) AS avg_success, round(avg(success_rate) FILTER (WHERE use_count > 0), 2) AS used_success, count(*) FILTER (WHERE confidence >= 0.8) AS n_sure FROM skills""")
def skill_global_stats(spark, sf_dir):
    used = F.col("use_count") > 0
    return skills(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(used).alias("n_used"), F.round(F.avg("confidence"), 9).alias("avg_confidence"), F.round(F.avg("success_rate"), 9).alias("avg_success"),
        F.round(F.avg(F.when(used, F.col("success_rate"))), 2).alias("used_success"), F.count_if(F.col("confidence") >= 0.8).alias("n_sure"),
    )


@query(f"WITH {SKILLS} SELECT id, confidence, success_rate FROM skills WHERE problem_type = 'captcha' AND confidence >= 0.5 ORDER BY confidence DESC, success_rate DESC, id LIMIT 20")
def skill_top(spark, sf_dir):
    found = skills(spark, sf_dir).where("problem_type = 'captcha' and confidence >= 0.5")
    return found.orderBy(F.desc("confidence"), F.desc("success_rate"), "id").limit(20).select("id", "confidence", "success_rate")


@query(f"WITH {SKILLS} SELECT id FROM skills WHERE error_keywords ILIKE '%bolt%' OR tags ILIKE '%RED%' OR name ILIKE '%steel%' OR category ILIKE '%econ%'")
def skill_search(spark, sf_dir):
    return skills(spark, sf_dir).where("error_keywords ilike '%bolt%' or tags ilike '%RED%' or name ilike '%steel%' or category ilike '%econ%'").select("id")


_KEYWORDS = "keywords AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS keyword FROM part UNION SELECT DISTINCT 'Brand#' || p_size FROM part)"


def _keywords(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.explode(F.split(F.upper("p_name"), " ")).alias("keyword")).unionAll(p.select(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")))).distinct()


@query(f"WITH {SKILLS}, {_KEYWORDS} SELECT id, keyword FROM skills JOIN keywords ON contains(lower(error_keywords), lower(keyword)) OR contains(lower(tags), lower(keyword))")
def skill_keyword_search(spark, sf_dir):
    """Each keyword of a table with the skills whose error keywords or tags hold it, in any case."""
    return substring.matches(skills(spark, sf_dir), "id", ["error_keywords", "tags"], _keywords(spark, sf_dir), ignore_case=True).select("id", F.col("needle").alias("keyword"))


@query(f"""WITH {SKILLS}, terms AS (SELECT DISTINCT left(word, n) AS term FROM (SELECT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS word FROM part), (SELECT unnest([2, 4, 9]) AS n))
SELECT term, count(*) AS n, min(id) AS first_id FROM skills JOIN terms ON contains(lower(error_keywords), lower(term)) OR contains(lower(tags), lower(term)) OR contains(lower(name), lower(term)) OR contains(lower(category), lower(term)) GROUP BY term""")
def technique_search(spark, sf_dir):
    """Search terms of a table over four columns, in any case; short ones are grams of their own."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    terms = table(spark, sf_dir, "part").select(F.explode(words).alias("word")).distinct().select(F.explode(F.array(*[F.left("word", F.lit(n)) for n in (2, 4, 9)])).alias("term")).distinct()
    found = substring.matches(skills(spark, sf_dir), "id", ["error_keywords", "tags", "name", "category"], terms, ignore_case=True)
    return found.groupBy(F.col("needle").alias("term")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {SKILLS} SELECT id, CASE WHEN confidence >= 0.8 THEN true WHEN use_count >= 3 THEN true WHEN success_rate < 0.3 THEN false ELSE true END AS apply FROM skills")
def skill_should_apply(spark, sf_dir):
    return skills(spark, sf_dir).select("id", stats.should_apply(F.col("confidence"), F.col("success_rate"), F.col("use_count")).alias("apply"))


_PROBLEMS = """problems AS (SELECT event_id AS problem_id, ['bot_detected', 'cloudflare', 'rate_limited', 'captcha', 'js_required'][(event_id % 5 + 1)::INT] AS problem_type,
  [event_type, ['bolt', 'ring', 'widget', 'gear'][(event_id % 4 + 1)::INT], 'brand#' || (event_id % 25)] AS keywords, CASE WHEN event_id % 3 = 0 THEN '*example.com' ELSE 'h' || (event_id % 3) || '.example.com' END AS host FROM events WHERE event_type = 'error')"""
#: The catalog's categories are those of parts.
_CATEGORIES = {"bot_detected": "promo", "cloudflare": "economy", "captcha": "large"}


def _problems(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("event_id", F.lit(n)) + 1).cast("int"))
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    words = F.array("event_type", pick(("bolt", "ring", "widget", "gear"), 4), F.concat(F.lit("brand#"), F.pmod("event_id", F.lit(25)).cast("string")))
    return e.select(
        F.col("event_id").alias("problem_id"), pick(("bot_detected", "cloudflare", "rate_limited", "captcha", "js_required"), 5).alias("problem_type"), words.alias("keywords"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "*example.com").otherwise(F.concat(F.lit("h"), F.pmod("event_id", F.lit(3)).cast("string"), F.lit(".example.com"))).alias("host"),
    )


@query(f"""WITH {SKILLS}, {_PROBLEMS}, words AS (SELECT DISTINCT unnest(keywords[1:5]) AS w FROM problems),
t AS (SELECT 't:' || problem_type AS key, id FROM skills QUALIFY row_number() OVER (PARTITION BY problem_type ORDER BY confidence DESC, success_rate DESC, id) <= 10),
h AS (SELECT 'h:' || site_pattern AS key, id FROM skills WHERE site_pattern IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_pattern ORDER BY confidence DESC, success_rate DESC, id) <= 10),
c AS (SELECT 'c:' || category AS key, id FROM skills WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY category ORDER BY confidence DESC, success_rate DESC, id) <= 10),
k AS (SELECT 'w:' || w AS key, id FROM skills JOIN words ON contains(error_keywords, w) OR contains(tags, w) QUALIFY row_number() OVER (PARTITION BY w ORDER BY confidence DESC, id) <= 5),
lists AS (FROM t UNION ALL FROM h UNION ALL FROM c UNION ALL FROM k),
asked AS (SELECT problem_id, 't:' || problem_type AS key FROM problems UNION SELECT problem_id, 'h:' || host FROM problems UNION SELECT problem_id, 'c:' || CASE problem_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORIES.items())} END FROM problems UNION SELECT problem_id, 'w:' || unnest(keywords[1:5]) FROM problems),
pairs AS (SELECT DISTINCT problem_id, id FROM asked JOIN lists USING (key)),
scored AS (SELECT problem_id, id, round(least(1.0, CASE WHEN p.problem_type = s.problem_type THEN 0.4 ELSE 0 END + least(0.2, 0.05 * len(list_intersect(list_distinct(string_split(error_keywords, ',') || string_split(tags, ',')), keywords)))
  + CASE WHEN coalesce(site_pattern, '') <> '' AND host LIKE '%' || replace(site_pattern, '*', '') THEN 0.2 ELSE 0 END + confidence * 0.15 + success_rate * 0.15
  + list_sum(list_transform(keywords, lambda w: CASE WHEN contains(error_keywords, w) THEN 0.05 ELSE 0 END + CASE WHEN contains(tags, w) THEN 0.03 ELSE 0 END))), 9) AS score FROM pairs JOIN problems p USING (problem_id) JOIN skills s USING (id))
SELECT problem_id, id, score FROM scored QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, id) = 1""")
def skill_match_top1(spark, sf_dir):
    """Candidates by type, keyword, host and category, scored once for problems that are alike; the best by a partially
    aggregated maximum."""
    problems, same = _problems(spark, sf_dir), ["problem_type", "keywords", "host"]
    kinds = problems.groupBy(*same).agg(F.min("problem_id").alias("problem_id"))
    pairs = stats.skill_candidates(kinds, skills(spark, sf_dir), _CATEGORIES)
    parts = {c: F.col(f"skill.{c}") for c in ("problem_type", "error_keywords", "tags", "site_pattern", "confidence", "success_rate")}
    score = F.round(stats.match_score(F.col("problem_type"), F.col("keywords"), F.col("host"), parts), 9)
    best = pairs.select(*same, "skill.id", score.alias("score")).groupBy(*same).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id"))).alias("b"))
    return problems.join(best, same).select("problem_id", "b.id", (-F.col("b.s")).alias("score"))


@query(f"""WITH {SKILLS}, m AS (SELECT category, round(max(confidence), 9) AS confidence, round(avg(success_rate), 9) AS success_rate, list_sort(list_distinct(flatten(list(string_split(error_keywords, ',')))))[1:20] AS k,
list_sort(list_distinct(flatten(list(string_split(tags, ','))))) AS t FROM skills GROUP BY category), c AS (SELECT category, problem_type, count(*) AS n FROM skills GROUP BY ALL),
top AS (SELECT category, min(problem_type) AS problem_type FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.category = c.category) GROUP BY category), f AS (SELECT category, string_agg(name, '; ' ORDER BY id) AS first_names FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM skills) WHERE r <= 3 GROUP BY category)
SELECT category, confidence, success_rate, array_to_string(k, ',') AS keywords, array_to_string(t, ',') AS tags, problem_type, first_names FROM m JOIN top USING (category) JOIN f USING (category)""")
def merge_skills(spark, sf_dir):
    s = skills(spark, sf_dir)
    merged = s.groupBy("category").agg(F.round(F.max("confidence"), 9).alias("confidence"), F.round(F.avg("success_rate"), 9).alias("success_rate"))
    keywords = stats.first_distinct(s, ["category"], F.split("error_keywords", ","), 20, "keywords")
    tags = stats.first_distinct(s, ["category"], F.split("tags", ","), None, "tags")
    merged = merged.join(keywords, "category").join(tags, "category").select("category", "confidence", "success_rate", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"))
    counts = s.groupBy("category", "problem_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("problem_type"))).alias("t")).select("category", "t.problem_type")
    first = records.top_per_group(s, ["category"], [F.col("id")], 3).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("f"))
    first = first.select("category", F.array_join(F.transform("f", lambda x: x["name"]), "; ").alias("first_names"))
    return merged.join(top, "category").join(first, "category")


@query(f"WITH {ATTEMPTS} SELECT domain, method, count(*) AS n, count(*) FILTER (WHERE success) AS n_ok, round(avg(success::INT::DOUBLE), 9) AS success_rate FROM attempts GROUP BY ALL")
def technique_success_rate(spark, sf_dir):
    return stats.method_rates(attempts(spark, sf_dir), "domain").withColumn("success_rate", F.round("success_rate", 9))


@query(f"""WITH {ATTEMPTS}, r AS (SELECT domain, method, avg(success::INT::DOUBLE) AS rate FROM attempts GROUP BY ALL) SELECT domain, method, round(rate, 9) AS success_rate FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rate DESC, method) AS k FROM r WHERE rate > 0.5) WHERE k = 1""")
def best_method_per_domain(spark, sf_dir):
    return stats.best_method(attempts(spark, sf_dir), "domain", 0.5).withColumn("success_rate", F.round("success_rate", 9))


@query(f"""WITH {ATTEMPTS} SELECT domain, round(max(items / 100.0::DOUBLE), 9) AS best_rate, max(attempt_id) FILTER (WHERE success AND ts = m) AS last_ok, count(DISTINCT method) AS n_methods FROM (SELECT *, max(ts) FILTER (WHERE success) OVER (PARTITION BY domain) AS m FROM attempts) GROUP BY domain""")
def domain_profile(spark, sf_dir):
    ok = F.col("success")
    return attempts(spark, sf_dir).groupBy("domain").agg(
        F.round(F.max(F.col("items") / 100.0), 9).alias("best_rate"), F.max_by(F.col("attempt_id"), F.when(ok, F.struct("ts", "attempt_id"))).alias("last_ok"), F.count_distinct("method").alias("n_methods")
    )


@query(f"""WITH {ATTEMPTS} SELECT count(*) AS total, count(*) FILTER (WHERE success) AS completed, count(*) FILTER (WHERE NOT success) AS failed, sum(items)::BIGINT AS n_items, round(sum(time_taken), 4) AS total_time, round(sum(time_taken) / greatest(count(*) FILTER (WHERE success), 1), 6) AS avg_time, round(count(*) FILTER (WHERE success) / count(*), 9) AS success_rate FROM attempts""")
def task_pool_stats(spark, sf_dir):
    done = F.count_if("success")
    return attempts(spark, sf_dir).agg(
        F.count("*").alias("total"), done.alias("completed"), F.count_if(~F.col("success")).alias("failed"), F.sum("items").alias("n_items"), F.round(F.sum("time_taken"), 4).alias("total_time"),
        F.round(F.sum("time_taken") / F.greatest(done, F.lit(1)), 6).alias("avg_time"), F.round(done / F.count("*"), 9).alias("success_rate"),
    )


@query(f"WITH {QUEUE} SELECT state, count(*) AS n, sum(attempts)::BIGINT AS n_attempts FROM queue GROUP BY state")
def queue_state_counts(spark, sf_dir):
    return queue(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("n_attempts"))


@query(f"WITH {QUEUE} SELECT seq, priority, row_number() OVER (ORDER BY priority DESC, seq)::BIGINT AS rank FROM queue WHERE state = 'pending'")
def queue_priority_order(spark, sf_dir):
    """Highest priority first, first in first out within one."""
    pending = queue(spark, sf_dir).where("state = 'pending'").select("seq", "priority")
    return stats.global_rank(pending, [F.desc("priority"), F.col("seq")])


@query(f"""WITH {QUEUE}, i AS (SELECT substring(md5(url), 1, 16) AS id, * FROM queue), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM i WHERE state = 'pending') SELECT id, seq FROM f WHERE r = 1 AND id NOT IN (SELECT id FROM i WHERE state = 'completed' AND seq % 3 = 0)""")
def queue_dedupe(spark, sf_dir):
    q = queue(spark, sf_dir).withColumn("id", S.short_id(F.col("url")))
    done = q.where("state = 'completed' and seq % 3 = 0").select("id").distinct()
    return records.first_wins(q.where("state = 'pending'"), F.col("id"), [F.col("seq")]).join(done, "id", "left_anti").select("id", "seq")


@query(f"""WITH {QUEUE} SELECT priority, count(*) AS n, count(*) FILTER (WHERE attempts < 3 AND state = 'failed') AS retryable, count(*) FILTER (WHERE attempts >= 3 AND state = 'failed') AS dead, max(least(power(2.0, attempts), 60.0))::DOUBLE AS longest_delay FROM queue GROUP BY priority""")
def retry_attempts(spark, sf_dir):
    failed = F.col("state") == "failed"
    return queue(spark, sf_dir).groupBy("priority").agg(
        F.count("*").alias("n"), F.count_if((F.col("attempts") < 3) & failed).alias("retryable"), F.count_if((F.col("attempts") >= 3) & failed).alias("dead"), F.max(S.backoff(F.col("attempts"))).alias("longest_delay")
    )


@query("""SELECT o_orderpriority AS job, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS enabled, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1996-01-01') AS due, min(o_orderdate) AS next_run FROM orders GROUP BY 1""")
def scheduler_stats(spark, sf_dir):
    on = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(
        F.count("*").alias("n"), F.count_if(on).alias("enabled"), F.count_if(on & (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))).alias("due"), F.min("o_orderdate").alias("next_run")
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1996-06-01'")
def due_jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' and o_orderdate <= timestamp_ntz '1996-06-01'").select("o_orderkey")


@query(f"""WITH {ATTEMPTS}, e AS (SELECT domain, avg(success::INT::DOUBLE) AS rate, avg(time_taken) AS latency FROM attempts GROUP BY domain), r AS (SELECT *, row_number() OVER (ORDER BY round(-rate, 9), round(latency, 9), domain)::BIGINT AS rank FROM e) SELECT domain, rank, ((rank - 1) % 4)::BIGINT AS worker FROM r""")
def ranked_round_robin(spark, sf_dir):
    e = attempts(spark, sf_dir).groupBy("domain").agg(F.round(-stats.rate(F.col("success")), 9).alias("r"), F.round(F.avg("time_taken"), 9).alias("latency"))
    return stats.ranked_round_robin(e, [F.col("r"), F.col("latency"), F.col("domain")], 4).select("domain", "rank", "worker")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def results_page(spark, sf_dir):
    mine = table(spark, sf_dir, "orders").where("o_custkey % 10 = 3")
    return stats.page_of(mine, [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_orderkey", "o_orderdate")


@query(f"WITH {ATTEMPTS} SELECT domain, attempt_id, rank::INT AS rank FROM (SELECT domain, attempt_id, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, attempt_id) AS rank FROM attempts) WHERE rank <= 10")
def history_last_n(spark, sf_dir):
    return stats.last_n(attempts(spark, sf_dir), ["domain"], [F.desc("ts"), F.col("attempt_id")], 10).select("domain", "attempt_id", "rank")


@query(f"""WITH {ATTEMPTS} SELECT domain, round(avg(time_taken), 9) AS avg_recent, max(time_taken) AS max_recent, max(time_taken) FILTER (WHERE rank = 1) AS current FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, attempt_id DESC) AS rank FROM attempts) WHERE rank <= 100 GROUP BY domain""")
def resource_stats(spark, sf_dir):
    recent = stats.last_n(attempts(spark, sf_dir), ["domain"], [F.desc("ts"), F.desc("attempt_id")], 100)
    return recent.groupBy("domain").agg(F.round(F.avg("time_taken"), 9).alias("avg_recent"), F.max("time_taken").alias("max_recent"), F.max(F.when(F.col("rank") == 1, F.col("time_taken"))).alias("current"))


@query(f"""WITH {ATTEMPTS} SELECT attempt_id, round(avg(success::INT::DOUBLE) OVER (PARTITION BY domain ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING), 9) AS running_rate FROM attempts""")
def running_success(spark, sf_dir):
    w = Window.partitionBy("domain").orderBy("ts", "attempt_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attempts(spark, sf_dir).select("attempt_id", F.round(F.avg(F.col("success").cast("double")).over(w), 9).alias("running_rate"))


@query(f"""WITH {ATTEMPTS} SELECT domain, count(*) AS n, round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 3)::DOUBLE AS seconds, round(count(*) * 60.0 / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0), 6)::DOUBLE AS per_minute FROM attempts GROUP BY domain HAVING min(ts) < max(ts)""")
def requests_per_minute(spark, sf_dir):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000.0
    got = attempts(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), span.alias("s")).where("s > 0")
    return got.select("domain", "n", F.round("s", 3).alias("seconds"), F.round(F.col("n") * 60.0 / F.col("s"), 6).alias("per_minute"))


@query(f"""WITH {ATTEMPTS}, c AS (SELECT attempt_id, count(*) OVER (PARTITION BY domain ORDER BY (epoch_us(ts) // 1000000) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS own_count, count(*) OVER (ORDER BY (epoch_us(ts) // 1000000) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS all_count FROM attempts)
SELECT attempt_id, own_count::BIGINT AS own_count, all_count::BIGINT AS all_count, own_count <= 2 AND all_count <= 20 AS allowed FROM c""")
def both_rate_limits(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return stats.both_limits(attempts(spark, sf_dir), "domain", seconds, (2, 3600), (20, 3600)).select("attempt_id", "own_count", "all_count", "allowed")


@query(f"""WITH {ATTEMPTS}, p AS (SELECT method, domain, CASE WHEN domain % 7 <> 0 THEN success END AS ok FROM attempts) SELECT domain, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed,
round(CASE WHEN count(ok) > 0 THEN count(*) FILTER (WHERE ok) / count(ok) ELSE 1.0 END, 9)::DOUBLE AS success_rate FROM p GROUP BY domain""")
def proxy_pool_stats(spark, sf_dir):
    """Members that weren't tried yet count as good."""
    tried = F.when(F.pmod("domain", F.lit(7)) != 0, F.col("success"))
    return stats.pool_stats(attempts(spark, sf_dir), ["domain"], tried).withColumn("success_rate", F.round("success_rate", 9))


@query(f"""WITH {ATTEMPTS} SELECT attempt_id, in_window::BIGINT AS in_window, in_window <= 2 AS within FROM (SELECT attempt_id, count(*) OVER (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM attempts)""")
def rate_limit_sliding(spark, sf_dir):
    t = attempts(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return stats.sliding_allowed(t, "domain", F.col("us"), 3600 * 1000000, 2).select("attempt_id", "in_window", "within")


def _list_fold(step: str, start: str, out: str, value: str = "success") -> str:
    return f"""WITH {ATTEMPTS}, g AS (SELECT domain, list({value} ORDER BY ts, attempt_id) AS v FROM attempts GROUP BY domain) SELECT domain, round(list_reduce(v, lambda acc, x: {step}, {start}), 6) AS {out} FROM g"""


def _fold(spark, sf_dir, step, start, name):
    return stats.fold_linear(attempts(spark, sf_dir), ["domain"], ["ts", "attempt_id"], step, start, name).withColumn(name, F.round(name, 6))


@query(_list_fold("least(1.0, acc + CASE WHEN x > 0.5 THEN 0.05 ELSE -0.1 END)", "0.5::DOUBLE", "confidence", "success::INT::DOUBLE"))
def confidence_fold(spark, sf_dir):
    return _fold(spark, sf_dir, stats.confidence_step(F.col("success")), 0.5, "confidence")


@query(_list_fold("CASE WHEN x > 0.5 THEN least(1.0, acc + 0.1) ELSE greatest(0.1, acc - 0.15) END", "0.5::DOUBLE", "confidence", "success::INT::DOUBLE"))
def improve_fold(spark, sf_dir):
    return _fold(spark, sf_dir, stats.improve_step(F.col("success")), 0.5, "confidence")


@query(_list_fold("greatest(0.0, least(1.0, acc + CASE WHEN x > 0.5 THEN 0.1 ELSE -0.1 END))", "0.5::DOUBLE", "rate", "success::INT::DOUBLE"))
def profile_fold(spark, sf_dir):
    return _fold(spark, sf_dir, stats.profile_step(F.col("success")), 0.5, "rate")


@query(_list_fold("CASE WHEN x > 0.5 THEN least(0.95, acc + 0.1) ELSE acc END", "0.5::DOUBLE", "confidence", "success::INT::DOUBLE"))
def pattern_fold(spark, sf_dir):
    return _fold(spark, sf_dir, stats.pattern_step(F.col("success")), 0.5, "confidence")


@query(_list_fold("acc * 0.7 + x * 0.3", "0.0::DOUBLE", "latency", "time_taken"))
def ema_latency(spark, sf_dir):
    return _fold(spark, sf_dir, stats.ema_step(F.col("time_taken")), 0.0, "latency")


_STATUS = "CASE WHEN NOT success AND attempt_id % 2 = 0 THEN 429.0 WHEN NOT success THEN 500.0 ELSE 200.0 END::DOUBLE"


@query(_list_fold("CASE WHEN x = 429 THEN least(60.0, acc * 2) WHEN x >= 500 THEN least(60.0, acc * 1.5) ELSE greatest(1.0, acc * 0.95) END", "3.0::DOUBLE", "delay", _STATUS))
def delay_fold(spark, sf_dir):
    status = F.when(~F.col("success") & (F.pmod("attempt_id", F.lit(2)) == 0), 429).when(~F.col("success"), 500).otherwise(200)
    return _fold(spark, sf_dir, stats.delay_step(status, F.lit(None).cast("double")), 3.0, "delay")


@query(f"""WITH {ATTEMPTS}, m AS (SELECT domain, ts, attempt_id, success, count(*) FILTER (WHERE success) OVER (PARTITION BY domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM attempts), r AS (SELECT domain, island, count(*) AS n FROM m WHERE NOT success GROUP BY ALL) SELECT d.domain, coalesce(max(n), 0)::BIGINT AS longest FROM (SELECT DISTINCT domain FROM attempts) d LEFT JOIN r USING (domain) GROUP BY d.domain""")
def consecutive_failures(spark, sf_dir):
    return stats.runs_of_failures(attempts(spark, sf_dir), "domain", "ts", "success")


_BREAKER = f"""WITH RECURSIVE {ATTEMPTS}, a AS (SELECT domain, attempt_id, (epoch_us(ts) // 1000000) AS t, success AS ok, row_number() OVER (PARTITION BY domain ORDER BY epoch_us(ts) // 1000000, attempt_id) AS k FROM attempts),
b(domain, k, attempt_id, t, state, failures, opened, half, refused) AS (SELECT DISTINCT domain, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 'closed', 0, 0::BIGINT, NULL::BIGINT, false FROM a UNION ALL
SELECT domain, k, attempt_id, t, CASE WHEN refused THEN 'open' WHEN ok THEN 'closed' WHEN opens THEN 'open' ELSE state END, failures, CASE WHEN opens THEN t ELSE opened END, CASE WHEN state = 'half_open' THEN opened + 3600 END, refused FROM (
  SELECT *, NOT refused AND NOT ok AND (failures >= 2 OR state = 'half_open') AS opens FROM (
    SELECT domain, k, attempt_id, t, ok, opened, state, state = 'open' AS refused, CASE WHEN state = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END AS failures FROM (
      SELECT a.domain, a.k, a.attempt_id, a.t, a.ok, b.opened, b.failures, CASE WHEN b.state = 'open' AND a.t - b.opened >= 3600 THEN 'half_open' ELSE b.state END AS state FROM b JOIN a ON a.domain = b.domain AND a.k = b.k + 1)))),
last AS (SELECT domain, state, failures, opened FROM b QUALIFY row_number() OVER (PARTITION BY domain ORDER BY k DESC) = 1)"""


def _breakers(spark, sf_dir):
    calls = attempts(spark, sf_dir).select(F.col("domain").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("attempt_id").alias("id"), F.col("success").alias("ok"))
    return breaker.Breakers(calls, threshold=2, reset_s=3600)


@query(f"{_BREAKER} SELECT domain, state, failures FROM last")
def circuit_breaker_fold(spark, sf_dir):
    """The breaker's last state per domain."""
    return _breakers(spark, sf_dir).final().select(F.col("key").alias("domain"), "state", F.col("failures").cast("int").alias("failures"))


@query(f"""{_BREAKER}, now AS (SELECT max(epoch_us(ts) // 1000000) AS t FROM attempts)
SELECT domain, t::DOUBLE AS t, attempt_id, state, failures::BIGINT AS failures, NOT refused AS passed FROM b WHERE k > 0
UNION ALL SELECT b.domain, half::DOUBLE, NULL, 'half_open', (SELECT failures FROM b p WHERE p.domain = b.domain AND p.k = b.k - 1)::BIGINT, NULL FROM b WHERE half IS NOT NULL
UNION ALL SELECT domain, (opened + 3600)::DOUBLE, NULL, 'half_open', failures::BIGINT, NULL FROM last, now WHERE state = 'open' AND opened + 3600 <= now.t""")
def circuit_breaker_history(spark, sf_dir):
    """Every call with the breaker's state after it and whether it was let through, and every change by the clock, up
    to the time of the table's last call."""
    now = attempts(spark, sf_dir).agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] or 0
    return _breakers(spark, sf_dir).history(float(now)).select(F.col("key").alias("domain"), "t", F.col("id").alias("attempt_id"), "state", "failures", "passed")


@query("""SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'view'), 6) AS views, round(sum(value) FILTER (WHERE event_type = 'click'), 6) AS clicks FROM events GROUP BY user_id""")
def crawl_stats_merge(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id")
    one = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    return kinds.agg(F.round(one("view"), 6).alias("views"), F.round(one("click"), 6).alias("clicks"))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS full_text FROM conversations GROUP BY conv_id""")
def element_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    return c.select("conv_id", "n_user", "n_assistant", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).alias("full_text"))


@query(f"""WITH {SKILLS}, {ATTEMPTS} SELECT a.domain, count(*) AS n, round(sum(s.confidence), 6) AS confidence FROM attempts a JOIN skills s ON a.attempt_id % 2000 = s.id GROUP BY a.domain""")
def facts_by_skill(spark, sf_dir):
    a, s = attempts(spark, sf_dir).withColumn("id", F.pmod("attempt_id", F.lit(2000))), skills(spark, sf_dir)
    return a.join(s, "id").groupBy("domain").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query("""SELECT n_name AS nation, l_returnflag, count(*) AS n, round(sum((l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DECIMAL(38,4)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ROLLUP (n_name, l_returnflag)""")
def star_rollup(spark, sf_dir):
    """A star join under a roll-up, as a check of the general surface; sums of decimals don't depend on their order."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01'")
    j = l.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    price = F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(15,2)"))
    return j.rollup(F.col("n_name").alias("nation"), "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(price.cast("decimal(28,4)")), 2).cast("double").alias("revenue"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def embedding_topk(spark, sf_dir):
    """Cosine retrieval: the rows whose id is divisible by 50 against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.cosine_topk(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")


@query(f"""WITH {ATTEMPTS}, g AS (SELECT domain, date_trunc('day', ts) AS day, list(success ORDER BY ts, attempt_id)[1:4] AS v FROM attempts GROUP BY ALL), n AS (SELECT *, CASE WHEN list_contains(v, true) THEN list_position(v, true) ELSE len(v) END AS k FROM g)
SELECT domain, day, k::BIGINT AS executions, list_contains(v, true) AS succeeded, (CASE WHEN k > 1 THEN power(2, k - 1) - 1 ELSE 0 END)::DOUBLE AS waited FROM n""")
def retry_outcomes(spark, sf_dir):
    """A domain's attempts of one day as a job: retried until it succeeds, three times at most."""
    a = attempts(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return stats.retry_outcomes(a, ["domain", "day"], ["ts", "attempt_id"], "success")


_APIS = "apis AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || (user_id % 40) AS url, (event_id % 7) / 10.0::DOUBLE AS confidence FROM events)"


@query(f"WITH {_APIS}, f AS (SELECT * FROM apis QUALIFY row_number() OVER (PARTITION BY method, url ORDER BY seq) = 1) SELECT seq, method, url, row_number() OVER (ORDER BY confidence DESC, seq)::BIGINT AS rank FROM f")
def ranked_apis(spark, sf_dir):
    """The first of each method and url, by confidence; ties in the order they were found."""
    e = table(spark, sf_dir, "events")
    apis = e.select(
        F.col("event_id").alias("seq"), F.when(F.pmod("event_id", F.lit(5)) == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/api/"), F.pmod("user_id", F.lit(40)).cast("string")).alias("url"),
        (F.pmod("event_id", F.lit(7)) / 10.0).cast("double").alias("confidence"),
    )
    first = records.first_wins(apis, F.concat_ws(":", "method", "url"), [F.col("seq")])
    return stats.global_rank(first, [F.desc("confidence"), F.col("seq")]).select("seq", "method", "url", "rank")


@query(f"""WITH {ATTEMPTS} SELECT method AS worker, count(*) AS n_results, sum(items)::BIGINT AS n_items, sum(items) > 0 AS success, round(max(time_taken), 6) AS slowest FROM attempts GROUP BY method""")
def worker_results(spark, sf_dir):
    """Results of workers put together; a worker with any item has succeeded."""
    return attempts(spark, sf_dir).groupBy(F.col("method").alias("worker")).agg(
        F.count("*").alias("n_results"), F.sum("items").alias("n_items"), (F.sum("items") > 0).alias("success"), F.round(F.max("time_taken"), 6).alias("slowest")
    )


@query(f"""WITH {ATTEMPTS}, a AS (SELECT method AS agent, count(*) AS tasks, count(*) FILTER (WHERE success) AS completed, round(avg(time_taken), 6) AS avg_time FROM attempts GROUP BY method) SELECT agent, tasks, completed, avg_time, round(completed / tasks, 9) AS success_rate FROM a
UNION ALL SELECT 'all', sum(tasks)::BIGINT, sum(completed)::BIGINT, (SELECT round(avg(time_taken), 6) FROM attempts), round(sum(completed) / sum(tasks), 9) FROM a""")
def agent_stats(spark, sf_dir):
    """Each agent and the pool of all, in one pass."""
    got = attempts(spark, sf_dir).rollup("method").agg(F.count("*").alias("tasks"), F.count_if("success").alias("completed"), F.round(F.avg("time_taken"), 6).alias("avg_time"))
    return got.select(F.coalesce("method", F.lit("all")).alias("agent"), "tasks", "completed", "avg_time", F.round(F.col("completed") / F.col("tasks"), 9).alias("success_rate"))


@query()
def embedding_index_topk(spark, sf_dir):
    """The same retrieval through an inverted-file index of all rows; tests measure its recall against the exact one."""
    e = table(spark, sf_dir, "embeddings")
    ensure_checkpoint_dir(spark)
    index = vector_index.build_index(e, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}", "vec_id", "embedding")
    return vector_index.search_index(index, e.where("vec_id % 50 = 0"), "vec_id", "embedding")
