"""Tables of word and pattern rules against texts, in one pass over each text whatever the number of rules.

A rule table has a row for each pattern: rule set, rank, name, pattern, and whether it's a regular expression.  All
plain patterns, and the words that a regular expression can't match without, are one automaton; expressions are
tried on the texts alone that have all of their words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import rules as R

SCHEMA = "ruleset string, rank int, name string, pattern string, regex boolean"
#: Bytes of a rule table, which goes to every task; a larger one is an error.
MOST_BYTES = 16 << 20
_SEPARATOR = "\x1f"
_PLAIN = re.compile(r"[a-z0-9 _/<>:;,'\"=@#&%!~-]+")


def default_rules() -> list[tuple]:
    """The engine's own rules as rows of a rule table."""
    out = [("problem", i, name, p, not R._PLAIN.issuperset(p)) for i, (name, _, patterns) in enumerate(R.PROBLEM_PATTERNS) for p in patterns]
    for ruleset, groups in (("quick", R.QUICK_RULES), ("captcha", R.CAPTCHA_TYPES)):
        out += [(ruleset, i, name, w, False) for i, (name, words) in enumerate(groups) for w in words]
    plain = {
        "blocked": R.BLOCK_WORDS, "challenged": R.CHALLENGE_PAGE, "js": R.JS_HTML_WORDS, "excluded": R.EXCLUDED_URL_PARTS, "blocked_link": R.BLOCKED_LINK_WORDS,
        "ad": R.AD_DOMAINS, "tracker": R.TRACKER_DOMAINS, "browser": R.JS_URL_WORDS,
    }
    out += [(ruleset, 0, ruleset, w, False) for ruleset, words in plain.items() for w in words]
    return out + [("ad", 0, "ad", p, not _PLAIN.fullmatch(p)) for p in R.AD_URL_PATTERNS]


def needed_words(pattern: str) -> list[str] | None:
    """Words that every match of a regular expression holds; None where that can't be told."""
    parts = re.split(r"\.\*|\\s\*", pattern)
    if not all(re.fullmatch(r"(?:[a-z0-9 _/<>:;,'\"=@#&%!~-]|\\[.\-/]|\[[a-z]\]\?)*", p) for p in parts):
        return None
    words = [w for p in parts for w in re.split(r"\[[a-z]\]\?", re.sub(r"\\([.\-/])", r"\1", p)) if w]
    return words or None


class Matcher:
    """The rules (ruleset, rank, name, pattern, regex) as one automaton."""

    def __init__(self, rules: Sequence[tuple]):
        import ahocorasick

        self.rules = sorted(rules)
        self.automaton, owners = ahocorasick.Automaton(), {}
        self.needs: dict[int, set[str]] = {}
        self.always = []
        for i, (_, _, _, pattern, regex) in enumerate(self.rules):
            words = needed_words(pattern) if regex else [pattern]
            if words is None:
                self.always.append(i)
                continue
            if regex:
                self.needs[i] = set(words)
            for w in words:
                owners.setdefault(w, []).append(i)
        for w, own in owners.items():
            self.automaton.add_word(w, (w, own))
        self.automaton.make_automaton()
        self.compiled = {i: re.compile(r[3], re.ASCII) for i, r in enumerate(self.rules) if r[4]}

    def hits(self, text: str | None) -> list[str]:
        """ruleset and name of each rule that the text matches, each once, in order of rule set and rank."""
        if text is None:
            return []
        words, found = set(), set()
        for _, (w, own) in self.automaton.iter(text) if len(self.automaton) else ():
            if w not in words:
                words.add(w)
                found.update(own)
        sure = [i for i in found if i not in self.needs] + [i for i in [*found, *self.always] if i in self.compiled and self.needs.get(i, set()) <= words and self.compiled[i].search(text)]
        return list(dict.fromkeys(_SEPARATOR.join((self.rules[i][0], self.rules[i][2])) for i in sorted(sure)))


@lru_cache(maxsize=4)
def _matcher(rules: tuple) -> Matcher:
    return Matcher(rules)


def rule_hits(spark: SparkSession, rules: DataFrame, rulesets: Sequence[str] | None = None):
    """A function of a text column that gives its hits, for any() and first(); texts are matched as they stand.
    ``rulesets`` names those that count, all if None.  Rules without a pattern count as none."""
    rows = rules.select(*[c.split()[0] for c in SCHEMA.split(", ")]).where("pattern <> ''")
    rows = rows.where(F.col("ruleset").isin(*rulesets)) if rulesets is not None else rows
    size = rows.agg(F.sum(F.octet_length("pattern") + F.octet_length("name") + F.octet_length("ruleset") + 16)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a rule table has {MOST_BYTES} bytes at most, this one has {size}")
    sent = spark.sparkContext.broadcast(tuple(tuple(r) for r in rows.collect()))

    @F.pandas_udf("array<string>")
    def hits(texts: pd.Series) -> pd.Series:
        m = _matcher(sent.value)
        return texts.map(m.hits, na_action=None)

    return hits


def any_hit(hits: Column, *rulesets: str) -> Column:
    """Whether a rule of any of the rule sets matches."""
    return F.exists(hits, lambda h: F.substring_index(h, _SEPARATOR, 1).isin(*rulesets))


def first_hit(hits: Column, ruleset: str) -> Column:
    """The name of the rule set's first rule that matches, null if none does."""
    own = F.filter(hits, lambda h: h.startswith(ruleset + _SEPARATOR))
    return F.when(F.size(own) > 0, F.substring_index(F.get(own, F.lit(0)), _SEPARATOR, -1))
