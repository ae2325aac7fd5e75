"""Ordered rule tables as expressions: page problems, challenges, blocked links, ads, API endpoints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.scalar import blank

# The values below are fixed: other results would follow from other words.

PROBLEM_PATTERNS = (
    ("bot_detected", "critical", ("access denied", "blocked", "forbidden", "403", "please verify you are a human", "i am not a robot", "unusual traffic", "suspicious activity", "automated requests", "captcha")),
    ("cloudflare", "high", ("cloudflare", "checking your browser", "one more step", "please wait", "ray id", "cf-.*ray", "__cf.*ch.*ku")),
    ("rate_limited", "high", ("429", "too many requests", "rate limit", "rate exceeded", "try again later", "slow down")),
    ("captcha", "high", ("captcha", "recaptcha", "hcaptcha", "prove you are human", "verify.*human", "security check", "enter the characters")),
    ("js_required", "medium", (r"<body>\s*</body>", "loading", "spa-init", "ng-app", "react-root", "vue-app", "ember-app")),
    ("auth_required", "high", ("login", "sign in", "authenticate", "session expired", "please log in")),
    ("empty_content", "medium", (r"<html>\s*</html>", r"<body>\s*</body>", "no results found", "0 results", "nothing found")),
)
DESCRIPTIONS = {
    "bot_detected": "Bot detection triggered - site identified automated access",
    "cloudflare": "Cloudflare protection challenge detected",
    "rate_limited": "Rate limit exceeded - too many requests",
    "captcha": "CAPTCHA challenge detected",
    "js_required": "JavaScript rendering required for content",
    "auth_required": "Authentication required",
    "empty_content": "Content is empty or minimal",
    "http_error": "HTTP error occurred",
    "request_error": "Request failed",
    "minimal_content": "Response contains minimal content",
}
QUICK_RULES = (
    ("cloudflare", ("cloudflare", "checking your browser")),
    ("captcha", ("captcha", "recaptcha", "prove you are human")),
    ("bot_detected", ("access denied", "blocked", "forbidden")),
    ("rate_limited", ("429", "too many requests")),
    ("js_required", ("<body> </body>", "loading")),
)
CHALLENGES = {
    "cloudflare": ("just a moment", "cloudflare", "checking your browser", "cf-"),
    "antibot": ("access denied", "forbidden", "403", "blocked", "suspicious"),
    "captcha": ("captcha", "verify you are human", "i'm not a robot"),
    "lazy_load": ("loading", "show more", "load more", "infinite"),
    "rate_limit": ("429", "too many requests", "rate limit"),
}
STATUS_CHALLENGES = {
    "cloudflare": ("just a moment...", "checking your browser", "cloudflare", "attention required", "cf-challenge"),
    "antibot": ("access denied", "forbidden", "403", "blocked", "bot detected", "suspicious activity"),
}
CAPTCHA_TYPES = (
    ("recaptcha", ("grecaptcha", "google.com/recaptcha", "data-sitekey")),
    ("hcaptcha", ("hcaptcha", "h-captcha")),
    ("cloudflare", ("cloudflare", "checking your browser", "one more step", "please wait", "ray id", "cloudflare ray")),
    ("image", ("captcha", "i am not a robot", "prove you are human", "security check", "verify you are human")),
    ("text", ("enter the letters", "type the characters", "what is", "math challenge", "simple question")),
)
BLOCK_WORDS = ("our systems have detected unusual traffic", "not a robot", "captcha", "enable javascript", "unusual traffic patterns", "try again later")
CHALLENGE_PAGE = ("checking your browser", "cf-challenge-browser", "cloudflare", "ray id", "turnstile", "just a moment", "_cf_chl_opt")
JS_URL_WORDS = ("react", "vue", "angular", "nextjs", "gatsby", "cloudflare", "shopify", "wix", "squarespace")
JS_HTML_WORDS = ("react", "vue", "angular", "next", "nuxt", "__nuxt", "window.__")
EXCLUDED_URL_PARTS = ("/tag/", "/category/", "/author/", "/page/", ".xml", ".pdf", ".jpg", ".png")
BLOCKED_LINK_WORDS = ("login", "signup", "register", "signin", "password", "reset", "auth", "logout")
AD_DOMAINS = (
    "googlesyndication.com", "googleadservices.com", "doubleclick.net", "adservice.google.com", "pagead2.googlesyndication.com", "ads.facebook.com",
    "advertising.com", "adnxs.com", "adsrvr.org", "adform.net", "criteo.com", "criteo.net", "outbrain.com", "taboola.com", "mgid.com", "revcontent.com",
    "popads.net", "popcash.net", "propellerads.com", "bidswitch.net", "casalemedia.com", "pubmatic.com", "rubiconproject.com", "openx.net",
    "amazon-adsystem.com", "media.net", "moatads.com",
)
TRACKER_DOMAINS = (
    "google-analytics.com", "googletagmanager.com", "googletagservices.com", "facebook.net", "facebook.com/tr", "connect.facebook.net", "hotjar.com",
    "mixpanel.com", "segment.com", "segment.io", "amplitude.com", "heap.io", "heapanalytics.com", "intercom.io", "crisp.chat", "drift.com", "hubspot.com",
    "marketo.com", "pardot.com", "salesforce.com/analytics", "optimizely.com", "kissmetrics.com", "mouseflow.com", "fullstory.com", "crazyegg.com",
    "clarity.ms", "analytics.twitter.com", "tiktok.com/api/track",
)
AD_URL_PATTERNS = (r"\.ad[s]?\.", r"\.doubleclick\.", r"banner.*\.jpg", r"banner.*\.png", "/ads/", "/ad/", "advertisement", "googleadservices", "googlesyndication")
AD_SELECTORS = (
    "[class*='ad-']", "[class*='ads-']", "[class*='advert']", "[id*='ad-']", "[id*='ads-']", "[id*='advert']", ".sponsored", ".promotion",
    "[data-ad]", "[data-ad-slot]", "ins.adsbygoogle", ".google-ad", ".dfp-ad",
)
STRATEGIES = {
    "cloudflare": ("playwright_stealth", "ua_rotate", "wait_retry"),
    "antibot": ("proxy_rotate", "stealth_mode", "human_behavior"),
    "lazy_load": ("scroll_pattern", "click_load_more", "api_intercept"),
    "captcha": ("wait_retry",),
}
#: Endpoint patterns: name, pattern, group.
HTML_API_PATTERNS = (
    ("fetch", r"""fetch\(["']([^"']+)["']""", 1),
    ("axios.get", r"""axios\.get\(["']([^"']+)["']""", 1),
    ("axios.post", r"""axios\.post\(["']([^"']+)["']""", 1),
    (".get", r"""\.get\(["']([^"']+)["']""", 1),
    (".post", r"""\.post\(["']([^"']+)["']""", 1),
    ("api", r"""api["']?\s*:\s*["']([^"']+)["']""", 1),
    ("endpoint", r"""endpoint["']?\s*:\s*["']([^"']+)["']""", 1),
    ("baseURL", r"""baseURL["']?\s*:\s*["']([^"']+)["']""", 1),
    ("url", r"""url["']?\s*:\s*["']([^"']+)["']""", 1),
    ("/api/", r""""/api/[^"']+\"""", 0),
    ("/v/api/", r""""/v\d+/api/[^"']+\"""", 0),
    ("graphql", "graphql", 0),
    ("/rest/", r""""/rest/[^"']+\"""", 0),
)
SCRIPT_API_PATTERNS = (
    ("/api/", r"""["'](/api/[a-zA-Z0-9/_-]+)["']""", 1),
    ("/v/", r"""["'](/v\d+/[a-zA-Z0-9/_-]+)["']""", 1),
    ("absolute", r"""["'](https?://[a-zA-Z0-9._-]+/api/)["']""", 1),
    ("baseURL", r"""baseURL["']?\s*[:=]\s*["']([^"']+)["']""", 1),
    ("endpoint", r"""endpoint["']?\s*[:=]\s*["']([^"']+)["']""", 1),
)
GUESSED_ENDPOINTS = ("/api", "/api/v1", "/graphql", "/rest", "/wp-json/wp/v2", "/feed.json")


def has_any(low: Column, words: Sequence[str]) -> Column:
    """Whether lower-cased text holds any word; one expression, no Python."""
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 _-")


def _found(low: Column, pattern: str) -> Column:
    """Whether a pattern matches; one without regular expression syntax is searched for as plain text."""
    return low.contains(pattern) if _PLAIN.issuperset(pattern) else low.rlike(pattern)


def matching(low: Column, patterns: Sequence[str]) -> Column:
    """The patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(_found(low, p), p) for p in patterns]))


def problem(html: Column, status: Column, headers: Column, error: Column) -> Column:
    """struct(problem_type, severity, description, evidence): the first rule group that matches the page, its
    status, headers and error taken together; then http, request and length rules; null if none.

    The text is lowered once and the first rule's number found once: both are bound by a lambda, so that no
    field of the result repeats the search."""
    text = F.concat_ws(" ", F.lower(blank(html)), F.coalesce(status, F.lit(200)).cast("string"), F.lower(blank(headers)), F.lower(blank(error)))
    bad, failed = F.coalesce(status >= 400, F.lit(False)), blank(error) != ""
    small = (F.length(blank(html)) < 500) & F.lower(blank(html)).contains("<html")
    groups = [p for _, _, p in PROBLEM_PATTERNS]
    http, request, minimal = len(groups), len(groups) + 1, len(groups) + 2
    names = [n for n, _, _ in PROBLEM_PATTERNS] + ["http_error", "request_error", "minimal_content"]
    levels = [x for _, x, _ in PROBLEM_PATTERNS] + ["medium", "medium", "low"]
    none = F.array().cast("array<string>")

    def rule(t: Column) -> Column:
        out = None
        for i, patterns in enumerate(groups):
            hit = _found(t, patterns[0])
            for p in patterns[1:]:
                hit = hit | _found(t, p)
            out = F.when(hit, i) if out is None else out.when(hit, i)
        return out.when(bad, http).when(failed, request).when(small, minimal)

    def judged(r: Column) -> Column:
        i = r["rule"]
        nth = lambda values: F.when(i.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), F.coalesce(i, F.lit(0)) + 1))
        severity = F.when((i == http) & (status < 500), "high").otherwise(nth(levels))
        said = F.when(i == http, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" error"))).when(i == request, F.left(error, F.lit(200))).otherwise(nth([DESCRIPTIONS[n] for n in names]))
        evidence = F.when(i == http, F.array(F.concat(F.lit("Status code: "), status.cast("string")))).when(i == request, F.array(F.left(error, F.lit(500))))
        evidence = evidence.when(i == minimal, F.array(F.concat(F.lit("HTML length: "), F.length(html).cast("string"))))
        for k, patterns in enumerate(groups):
            evidence = evidence.when(i == k, matching(r["text"], patterns))
        return F.struct(nth(names).alias("problem_type"), severity.alias("severity"), said.alias("description"), evidence.otherwise(none).alias("evidence"))

    ruled = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), rule(t).alias("rule")))
    return F.transform(ruled, judged)[0]


def problem_keywords(kind: Column, host: Column, evidence: Column, most: int = 20) -> Column:
    """The problem's kind, its host's second-level name, and the first three words of each matched pattern;
    different ones, in alphabetical order where there are more than ``most``."""
    labels = F.split(host, r"\.")
    name = F.when(F.size(labels) >= 2, F.element_at(labels, -2))
    words = F.flatten(F.transform(evidence, lambda p: F.slice(F.regexp_extract_all(F.lower(p), F.lit("[a-z]+"), F.lit(0)), 1, 3)))
    found = F.array_distinct(F.array_compact(F.concat(F.array(kind, name), words)))
    return F.when(F.size(found) > most, F.slice(F.array_sort(found), 1, most)).otherwise(found)


def problem_signatures(kind: Column, host: Column, path: Column) -> Column:
    """The kind alone, with eight hex digits of the host, and with those of the path where there is one."""
    short = lambda c: F.concat(kind, F.lit("_"), F.left(F.md5(c), F.lit(8)))
    return F.array_compact(F.array(kind, short(host), F.when(path != "", short(path))))


def first_rule(low: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    out = None
    for name, words in rules:
        out = F.when(has_any(low, words), name) if out is None else out.when(has_any(low, words), name)
    return out.otherwise(otherwise)


def quick_problem(html: Column) -> Column:
    return first_rule(F.lower(blank(html)), QUICK_RULES, "unknown")


def captcha_type(html: Column) -> Column:
    return first_rule(F.lower(blank(html)), CAPTCHA_TYPES, "none")


def challenge_flags(html: Column, title: Column) -> dict[str, Column]:
    low = F.lower(F.concat(blank(html), blank(title)))
    return {k: has_any(low, w) for k, w in CHALLENGES.items()} | {"empty": F.length(blank(html)) < 1000}


def status_challenge_flags(html: Column, title: Column, status: Column) -> dict[str, Column]:
    low = F.lower(F.concat(blank(html), blank(title)))
    return {
        "cloudflare": has_any(low, STATUS_CHALLENGES["cloudflare"]),
        "antibot": status.isin(403, 429) | has_any(low, STATUS_CHALLENGES["antibot"]),
        "captcha": (low.contains("captcha") | low.contains("verify")) & low.contains("human"),
        "rate_limited": status == 429,
        "lazy_load": F.lit(False),
        "requires_auth": F.lit(False),
    }


def is_blocked(html: Column) -> Column:
    return has_any(F.lower(blank(html)), BLOCK_WORDS)


def is_challenge_page(html: Column) -> Column:
    return html.isNull() | (html == "") | has_any(F.lower(html), CHALLENGE_PAGE)


def needs_browser(url: Column) -> Column:
    return has_any(F.lower(blank(url)), JS_URL_WORDS)


def has_js_markers(html: Column) -> Column:
    return has_any(F.lower(blank(html)), JS_HTML_WORDS)


def is_excluded(url: Column) -> Column:
    return has_any(F.lower(blank(url)), EXCLUDED_URL_PARTS)


def is_blocked_link(href: Column) -> Column:
    return F.lower(blank(href)).rlike("|".join(BLOCKED_LINK_WORDS))


def is_ad_url(url: Column, trackers: bool = False) -> Column:
    domains = AD_DOMAINS + (TRACKER_DOMAINS if trackers else ())
    return has_any(F.lower(blank(url)), domains) | F.lower(blank(url)).rlike("|".join(AD_URL_PATTERNS))


def is_blocked_element(class_: Column, id_: Column, src: Column, selectors: Sequence[str] = AD_SELECTORS) -> Column:
    """Whether an element's class or id holds what a simple selector names (a class or attribute part anywhere, an id
    as a whole), or its source is an ad's or tracker's."""
    class_, id_, out = blank(class_), blank(id_), is_ad_url(src, trackers=True) & (blank(src) != "")
    for s in selectors:
        if m := re.fullmatch(r"\.([\w-]+)|\[class\*=['\"]([^'\"]+)['\"]\]", s):
            out = out | class_.contains(m[1] or m[2])
        elif m := re.fullmatch(r"#([\w-]+)", s):
            out = out | (id_ == m[1])
        elif m := re.fullmatch(r"\[id\*=['\"]([^'\"]+)['\"]\]", s):
            out = out | id_.contains(m[1])
    return out


def next_method(challenges: dict[str, Column], current: Column) -> Column:
    """The first strategy other than the current one of the first challenge that has such a strategy."""
    tries = []
    for name, flag in challenges.items():
        if name in STRATEGIES:
            others = F.filter(F.array(*[F.lit(m) for m in STRATEGIES[name]]), lambda m: m != current)
            tries.append(F.when(flag, F.try_element_at(others, F.lit(1))))
    return F.coalesce(*tries)
