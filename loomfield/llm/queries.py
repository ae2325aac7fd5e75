"""Queries of this subpackage's operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import ann, audit, chat, lines, mixing, packing, pii, quality, secrets, simhash, toxicity, trie, urls

TOKENIZER = "word_bpe_49k.json"
#: A real run passes a secret of its own.
PII_KEY = "loomfield-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled are the pages that a rule fits, and those whose ids are labelled documents': bad is low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return urls.judge(_table(spark, sf_dir, "pages"), labels, label_by_rules=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY)


def tool_talk(turns: DataFrame) -> DataFrame:
    """Conversations as talks with tools: each user turn is a call, which cites the user turn's call before
    it, and each assistant turn the result of the call that the turn before it made.  The calls' tools and
    arguments follow from turn and text length, so that some name an unknown tool or have a wrong type."""
    size, turn = F.length("text"), F.col("turn")
    call_id = lambda t: F.concat(F.lit("c"), t.cast("string"))
    cited = F.concat(F.lit("${"), call_id(turn - 2), F.lit("} "), F.col("text"))
    limit = F.when(size % 5 == 0, F.to_json(F.struct(cited.alias("query"), F.lit("all").alias("limit")))).otherwise(F.to_json(F.struct(cited.alias("query"), size.alias("limit"))))
    kind = (turn + size) % 4
    arguments = F.when(kind == 0, limit).when(kind == 1, F.to_json(F.struct(cited.alias("url")))).when(kind == 2, F.to_json(F.struct(cited.alias("expression")))).otherwise("{}")
    name = F.element_at(F.array(*[F.lit(n) for n in ("search", "fetch", "calculate", "nosuch")]), kind.cast("int") + 1)
    head = F.to_json(F.struct(call_id(turn).alias("id"), name.alias("name")))
    call = F.concat(F.lit('{"tool_calls":['), F.left(head, F.length(head) - 1), F.lit(',"arguments":'), arguments, F.lit('}],"content":null}'))
    result = F.to_json(F.struct(call_id(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", role.alias("role"), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.format_chat(tool_talk(_table(spark, sf_dir, "conversations")))
    return rows.withColumn("problems", F.array_join("problems", "; "))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op9_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_host_quality": op2_host_quality,
    "op3_pow2_packing": op3_pow2_packing,
    "op4_url_templates": op4_url_templates,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_tool_call_linking": op7_tool_call_linking,
    "op8_rp_forest": op8_rp_forest,
    "op9_raked_mixing": op9_raked_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_ftrl_toxicity": op12_ftrl_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}

OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 6)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), flagged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS n_docs,
    count(*) FILTER (WHERE base_failed OR 10 * n_symbols > n_words OR 5 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS n_failed
  FROM flagged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT avg(n_failed / n_docs) AS m, greatest(var_pop(n_failed / n_docs) - avg((n_failed / n_docs) * (1 - n_failed / n_docs) / n_docs), 0) AS v FROM hosts
), prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000.0 END, 1.0), 10000.0) AS weight FROM moments
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((n_failed + m * weight) / (n_docs + weight) > 0.5, false) AS kept, n_docs::BIGINT AS host_docs, n_failed::BIGINT AS host_failed
FROM flagged LEFT JOIN hosts USING (source) CROSS JOIN prior
"""

OP5_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS body FROM documents),
lines AS (SELECT doc_id, unnest(body) AS line, unnest(range(len(body))) AS place FROM split),
words AS (SELECT doc_id, line, doc_id * 1000000 + place AS spot, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS s FROM lines),
sets AS (SELECT s, len(s) AS n, min(spot) AS spot FROM words WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT spot, n, unnest(s) AS w FROM sets),
rarity AS (SELECT w, count(*) AS df FROM tokens GROUP BY w),
prefixes AS (SELECT spot, n, w FROM tokens JOIN rarity USING (w) QUALIFY row_number() OVER (PARTITION BY spot ORDER BY df, w) <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT x.spot AS a, y.spot AS b FROM prefixes x JOIN prefixes y ON x.w = y.w AND x.spot < y.spot AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
lost AS (SELECT DISTINCT b AS spot FROM pairs JOIN sets x ON x.spot = a JOIN sets y ON y.spot = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
judged AS (SELECT doc_id, line, words.spot, words.spot <> sets.spot OR lost.spot IS NOT NULL AS gone FROM words LEFT JOIN sets USING (s) LEFT JOIN lost ON lost.spot = words.spot)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT coalesce(gone, false)) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM judged GROUP BY doc_id) USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE talk AS (
  SELECT conv_id, turn, role, text, length(text) AS n, 'c' || turn AS call_id, 'c' || (turn - 1) AS answers, '${c' || (turn - 2) || '} ' || text AS cited, (turn + length(text)) % 4 AS kind FROM conversations
), calls AS (
  SELECT conv_id, turn, call_id, ['search', 'fetch', 'calculate', 'nosuch'][kind + 1] AS name,
    CASE kind WHEN 0 THEN '{"limit":' || CASE WHEN n % 5 = 0 THEN '"all"' ELSE n::VARCHAR END || ',"query":' || to_json(cited) || '}' WHEN 1 THEN '{"url":' || to_json(cited) || '}' WHEN 2 THEN '{"expression":' || to_json(cited) || '}' ELSE '{}' END AS arguments,
    CASE WHEN kind = 0 AND n % 5 = 0 THEN 'limit isn''t number' WHEN kind = 3 THEN 'unknown tool' ELSE '' END AS problems, kind < 3 AS cites
  FROM talk WHERE role = 'user'
), levels AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c WHERE NOT cites OR NOT EXISTS (FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM calls c JOIN levels l ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 WHERE c.cites
), results AS (
  SELECT t.conv_id, t.turn, t.answers AS call_id, t.text, c.turn AS called FROM talk t LEFT JOIN calls c ON c.conv_id = t.conv_id AND c.call_id = t.answers WHERE t.role = 'assistant'
)
SELECT conv_id, turn, 0 AS part, CASE role WHEN 'user' THEN 'assistant' ELSE role END AS role, NULL AS call_id, NULL::INT AS level, NULL::BOOLEAN AS valid, '' AS problems, 'plain' AS status,
  CASE role WHEN 'user' THEN '{"content":null,"role":"assistant"}' ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json FROM talk WHERE role <> 'assistant'
UNION ALL SELECT c.conv_id, c.turn, 1, 'assistant', c.call_id, l.level, problems = '', problems, CASE WHEN EXISTS (FROM results r WHERE r.conv_id = c.conv_id AND r.called = c.turn) THEN 'linked' ELSE 'unanswered' END,
  '{"arguments":' || arguments || ',"id":"' || c.call_id || '","name":"' || name || '"}' FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
UNION ALL SELECT r.conv_id, r.turn, 0, 'tool', r.call_id, l.level, NULL, '', CASE WHEN called IS NULL THEN 'orphan' ELSE 'linked' END, '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || r.call_id || '"}'
FROM results r LEFT JOIN levels l ON l.conv_id = r.conv_id AND l.turn = r.called
"""



def _op4_sql(levels: int = 6) -> str:
    """The tree unrolled for paths of ``levels`` segments, which none of the given pages exceeds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    stem, ext = (rf"regexp_extract(s, '(?s)^(.*?)(\.[A-Za-z0-9]{{1,5}})?$', {g})" for g in (1, 2))
    forms = " ".join(f"WHEN regexp_matches(lower({stem}), '{p}')" + (f" AND length({stem}) >= 6" if name == "{hex}" else "") + f" THEN '{name}' || {ext}" for p, name in urls._FORMS)
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rules = sorted(urls.RULES, key=lambda r: -len(r[0]))
    case = lambda at: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[at]}'" for r in rules) + " END"
    parts = [
        "addresses AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"parsed AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM addresses)",
        f"ruled AS (SELECT *, {case(0)} AS rule, {case(1)} AS said, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE {forms} ELSE s END) AS t0 FROM parsed)",
        "known AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id)",
        "marked AS (SELECT host, t0, coalesce((said = 'block')::INT, bad) AS bad FROM ruled LEFT JOIN known USING (page_id))",
        f"tree{levels} AS (SELECT host, t0, t0 AS t, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM marked GROUP BY host, t0)",
    ]
    for k in range(levels - 1, -1, -1):
        parts += [
            f"kids{k} AS (SELECT host, t[:{k}] AS prefix, t[{k + 1}] AS seg, list_sort(list(DISTINCT t[{k + 2}:])) AS below, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM tree{k + 1} WHERE len(t) > {k} GROUP BY ALL)",
            f"wide{k} AS (SELECT *, count(*) OVER (PARTITION BY host, prefix) AS branches, sum(n) OVER (PARTITION BY host, prefix) AS all_n, "
            f"bad * sum(labelled) OVER (PARTITION BY host, prefix, below) > sum(bad) OVER (PARTITION BY host, prefix, below) * labelled AS worse FROM kids{k})",
            f"alike{k} AS (SELECT *, count(*) OVER w AS alike, coalesce(sum(bad) OVER w / nullif(sum(labelled) OVER w, 0), 0.0)::DOUBLE AS p FROM wide{k} WINDOW w AS (PARTITION BY host, prefix, below, worse))",
            f"named{k} AS (SELECT host, prefix, seg, CASE WHEN branches > 32 AND n < 0.05::DOUBLE * all_n THEN '*' WHEN alike > 1 AND NOT abs(bad - labelled * p) > 1.96::DOUBLE * sqrt(labelled * p * (1 - p)) + 0.5 AND NOT starts_with(seg, '{{') THEN '~' ELSE seg END AS became FROM alike{k})",
            f"tree{k} AS (SELECT x.host, x.t0, CASE WHEN became IS NULL THEN x.t ELSE x.t[:{k}] || [became] || x.t[{k + 2}:] END AS t, x.n, x.labelled, x.bad FROM tree{k + 1} x LEFT JOIN named{k} m ON len(x.t) > {k} AND m.host = x.host AND m.prefix = x.t[:{k}] AND m.seg = x.t[{k + 1}])",
        ]
    parts += [
        "overall AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0.0)::DOUBLE AS share FROM tree0)",
        "judged AS (SELECT host, t, (sum(bad) + 4.0::DOUBLE * any_value(share)) / (sum(labelled) + 4.0::DOUBLE) >= 0.7::DOUBLE AS rejected FROM tree0, overall GROUP BY host, t)",
    ]
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(x.t, '/') AS template"
        " FROM ruled r JOIN tree0 x ON x.host = r.host AND x.t0 = r.t0 JOIN judged j ON j.host = x.host AND j.t = x.t"
    )


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM words
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(string_split(filter_order[1 : step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""

OP13_SQL = """
WITH whole AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS digest, strlen(text) AS n FROM whole
), own AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS d, list(n ORDER BY turn NULLS FIRST, digest) AS n FROM turns GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, x: list_reduce([xor(crc, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 9 AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_slice(coalesce(b.d, []), 1, h) || c.d[h + 1 :] AS d, list_slice(coalesce(b.n, []), 1, h) || c.n[h + 1 :] AS n FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), members AS (
  SELECT conv_id, array_to_string(list_slice(d, 1, depth), ',') AS key, d[depth] AS digest, coalesce(n[depth], 0) AS n, depth, depth = len(d) AS ends FROM (SELECT *, unnest(range(len(d) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(digest) AS digest, (count(*) - 1) * max(n) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY key, depth
), up AS (
  SELECT *, CASE WHEN depth > 0 THEN left(key, greatest(65 * depth - 66, 0)) END AS parent FROM nodes
), kids AS (SELECT parent AS key, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY parent), counted AS (
  SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (key)
), sums AS (
  SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT left(key, greatest(65 * unnest(range(depth + 1)) - 1, 0)) AS top, n_children, saved FROM counted) GROUP BY top
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256, x.digest FROM counted x JOIN sums USING (key) LEFT JOIN nodes p ON p.key = x.parent
"""


SQL: dict[str, str] = {"op2_host_quality": OP2_SQL, "op4_url_templates": _op4_sql(), "op5_line_dedup": OP5_SQL, "op7_tool_call_linking": OP7_SQL, "op11_filter_audit": OP11_SQL, "op13_prefix_trie": OP13_SQL}
