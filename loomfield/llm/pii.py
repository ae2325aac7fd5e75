"""PII surrogates in built-in expressions only.

One pattern finds all entities of a text, from left to right; card and account numbers count only if their
check digits are right.  A surrogate is a pure function of a key, the entity's type and its canonical form,
so that all mentions of an entity, in whatever format, get the same replacement in every document without a
join.  It is laid into the mention's own format: digits replace digits and check digits are right again,
letters replace letters of their case and script.

Names are replaced word by word, and titles stay: a word has the same replacement in every name, so that
``Mr. John Smith``, ``Dr John Smith`` and ``Mr Smith`` stay one person.  A given name's last letter shows the
gender of its title, or, after a title without gender, of the same name elsewhere in the text.  A full name
that has a title somewhere in a text is also replaced where it stands without one.

Collisions are then checked over the different entities of the corpus: an entity whose surrogate another
entity has as well, or which is itself an entity of the corpus, takes its next attempt, until all are
distinct.  Only those entities, normally none, are looked up by a join when the texts are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, fresh

#: Titles by gender, also all in capitals; a name is a title and all words with a capital that follow it, particles
#: between them.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "г-н", "господин", "κύριος", "מר", "السيد"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "госпожа", "κυρία", "גברת", "السيدة"),
    "n": ("Dr", "Prof", "Mx"),
}
#: Words in lower case that names go on behind; they stay as they are.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "af", "al", "el", "bin", "ben", "y", "ван", "де", "фон", "бен", "בן", "بن")
_END, _START = r"(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])"
_TITLE = "|".join(sorted({v for ts in TITLES.values() for t in ts for v in (t, t.upper())}, key=lambda t: (-len(t), t)))
_TAIL = r"[\p{L}\p{M}]*(?:['’-](?!s(?!\p{L}))[\p{L}\p{M}]+){0,3}"
_WORD = rf"(?:\p{{Lu}}|[\p{{IsHebrew}}\p{{IsArabic}}&&\p{{L}}]){_TAIL}"
#: Types by priority where several begin at one place; each has one group in the joint pattern.  Repeated
#: groups are bounded or possessive, as a matcher goes one level deeper for each round of others: a host has 127
#: labels at most, a name any number of words.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?<!\.)@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": r"(?<![\p{L}\p{N}_.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}_]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}_.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?|[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{6,12})(?![\p{L}\p{N}_]|-[0-9])",
    "name": _START + rf"(?:{_TITLE})\.? {_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) )*+{_WORD})*+",
}
_NUMBERS = ("ip", "ssn", "iban", "card", "phone")
#: Where a title stands before a name.
_TITLED = _START + rf"(?:{_TITLE})\.? [\p{{Lu}}\p{{IsHebrew}}\p{{IsArabic}}]"


def joint_pattern(mail: bool = True, numbers: bool = True, names: bool = True) -> str:
    """One pattern for several types; a look at a number's first characters spares most places the rest."""
    parts = [PATTERNS["email"]] if mail else []
    if numbers:
        parts.append("(?=[0-9+(]|[A-Z]{2}[0-9])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in _NUMBERS) + ")")
    if names:
        parts.append(PATTERNS["name"])
    return "(?:" + "|".join(f"(?:{p})" for p in parts) + ")"


#: Letters that names are made of: consonants and vowels by script, and the last letters of given names by gender.
SCRIPTS = {
    # fixed values
    "cyrillic": (r"\p{IsCyrillic}", "бвгдзклмнпрстфхш", "аеиоу", {"m": "н", "f": "а", "n": "о"}),
    "greek": (r"\p{IsGreek}", "βγδζκλμνπρστφχθ", "αεηιο", {"m": "ς", "f": "α", "n": "ο"}),
    "hebrew": (r"\p{IsHebrew}", "בגדזחטלמנסעפקרש", "אהוי", {"m": "ן", "f": "ה", "n": "י"}),
    "arabic": (r"\p{IsArabic}", "بتدرزسشفقكلمنه", "اوي", {"m": "د", "f": "ة", "n": "ي"}),
    "latin": (r"\p{L}", "bdfghklmnprstvz", "aeiou", {"m": "o", "f": "a", "n": "e"}),
}
#: A word's surrogate is longer than it from this attempt on, which makes room for short words.
_LONGER = 3
_SEP = "\x1f"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_rest(digits: Column) -> Column:
    """The sum of a card number's digits by Luhn's rule modulo ten, which is 0 if the last one is right."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(F.pmod(i, F.lit(2)) == 1, twice(digit(i))).otherwise(digit(i))), F.lit(10))


def iban_rest(account: Column) -> Column:
    """An account number modulo 97 after its first four characters went to the end, which is 1 if it is right."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda i: F.substring(turned, i, F.lit(1))
    step = lambda s, i: F.pmod(F.when(value(i).rlike("[0-9]"), s * 10 + F.ascii(value(i)) - 48).otherwise(s * 100 + F.ascii(value(i)) - 55), F.lit(97))
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def entity_type(mention: Column) -> Column:
    """The first type whose whole pattern is the mention, as looking around is of no use within it; null for
    card and account numbers with wrong check digits."""
    checks = {"card": lambda: luhn_rest(_digits_of(mention)) == 0, "iban": lambda: iban_rest(mention) == 1}
    out = None
    for name, p in PATTERNS.items():
        hit = mention.rlike(f"^(?:{p})$")
        kind = F.when(checks[name](), F.lit(name)) if name in checks else F.lit(name)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("phone")


def words_of(name: Column) -> Column:
    """A name's words after its title."""
    words = F.split(name, " ")
    return F.slice(words, 2, F.size(words))


def _gender(name: Column) -> Column:
    title = F.upper(F.regexp_replace(F.substring_index(name, " ", 1), r"\.$", ""))
    return F.when(title.isin(*[t.upper() for t in TITLES["m"]]), "m").when(title.isin(*[t.upper() for t in TITLES["f"]]), "f").otherwise("n")


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: case and format don't matter.  A name's entities are its
    words, of kind word."""
    return (
        F.when(kind.isin("email", "word"), F.lower(mention)).when(kind == "ip", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(_digits_of(mention))
    )


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits drawn by key, type, entity and attempt."""
    return F.sha2(F.concat_ws(_SEP, F.lit(key), kind, canon, attempt.cast("string")), 512)


def _draw(stream: Column, i: Column, n: int | Column) -> Column:
    """A number below n from two hex digits at place i, which wraps around."""
    at = F.pmod(i * 2, F.lit(126)) + 1
    return F.pmod(F.conv(F.substring(stream, at, F.lit(3)), 16, 10).cast("int") + F.floor(i / 63).cast("int"), F.lit(n)).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def _drawn(stream: Column, n: Column) -> Column:
    """n digits, the first one not 0."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, _draw(stream, i, 9) + 1).otherwise(_draw(stream, i, 10)).cast("string")), "")


def _laid(value: Column, digits: Column, skip: Column) -> Column:
    """value with digits in the places of its own, but for those among its first ``skip`` characters."""
    number = lambda i: F.length(_digits_of(F.substring(value, F.lit(1), i + 1)))
    laid = lambda d: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$") & (i >= skip), F.substring(d, number(i), F.lit(1))).otherwise(c)), "")
    return _let(digits, laid)


def _digits(value: Column, stream: Column, skip: Column) -> Column:
    return _laid(value, _drawn(stream, F.length(_digits_of(value))), skip)


def _card(value: Column, stream: Column) -> Column:
    check = lambda body: F.pmod(10 - luhn_rest(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return _let(_drawn(stream, F.length(_digits_of(value)) - 1), lambda body: _laid(value, F.concat(body, check(body)), F.lit(0)))


def _iban(value: Column, stream: Column) -> Column:
    def checked(body: Column) -> Column:
        rest = F.substring(body, F.lit(5), F.length(body))
        check = F.lpad((98 - iban_rest(F.concat(F.substring(body, 1, 2), F.lit("00"), rest))).cast("string"), 2, "0")
        return F.concat(F.substring(body, 1, 2), check, rest)

    return _let(_letters_and_digits(value, stream, F.lit(4)), checked)


def _letters_and_digits(value: Column, stream: Column, skip: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    new = lambda c, i: (
        F.when(i < skip, c).when(c.rlike("^[0-9]$"), _draw(stream, i, 10).cast("string")).when(c.rlike("^[A-Z]$"), _pick(upper, _draw(stream, i, 26)))
        .when(c.rlike("^[a-z]$"), _pick(lower, _draw(stream, i, 26))).otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), new), "")


def _octets(value: Column, stream: Column) -> Column:
    """Four octets; the first is of a range without reserved addresses."""
    part = lambda i: F.conv(F.substring(stream, 1 + 4 * i, 4), 16, 10).cast("int")
    return F.concat_ws(".", (F.pmod(part(0), F.lit(89)) + 11).cast("string"), *[F.pmod(part(i), F.lit(256)).cast("string") for i in (1, 2, 3)])


def _word(word: Column, stream: Column, attempt: Column, gender: Column | None = None) -> Column:
    """A made-up word of the word's length, case and script, with its marks between letters; consonants and
    vowels take turns.  gender sets the last letter."""
    length = F.length(word)
    total = length + F.greatest(attempt - (_LONGER - 1), F.lit(0))
    chars = F.transform(F.sequence(F.lit(1), total), lambda i: F.struct(F.substring(word, F.least(i, length), F.lit(1)).alias("c"), i.alias("i")))
    nth = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    held = list(SCRIPTS.values())

    def script(c: Column) -> Column:
        out = None
        for k, (pattern, *_) in enumerate(held, 1):
            out = F.when(c.rlike(f"^{pattern}$"), k) if out is None else out.when(c.rlike(f"^{pattern}$"), k)
        return out

    def letters(x: Column) -> Column:
        """What the place's letter is drawn from; null in places of marks."""
        k = x["k"]
        out = F.when(F.pmod(x["i"], F.lit(2)) == 1, nth([h[1] for h in held], k)).otherwise(nth([h[2] for h in held], k))
        if gender is not None:
            last = F.when(gender == "m", nth([h[3]["m"] for h in held], k)).when(gender == "f", nth([h[3]["f"] for h in held], k)).otherwise(nth([h[3]["n"] for h in held], k))
            out = F.when(x["i"] == total, last).otherwise(out)
        return F.when(k.isNotNull(), out)

    def made(x: Column) -> Column:
        c, i, of = x["c"], x["i"], x["of"]
        new = F.substring(of, _draw(stream, i, F.length(of)) + 1, F.lit(1))
        capital = (F.upper(c) == c) & (F.lower(c) != c) & (i <= length)
        return F.when(of.isNull(), c).when(capital, F.upper(new)).otherwise(new)

    chars = F.transform(chars, lambda x: F.struct(x["c"].alias("c"), x["i"].alias("i"), script(x["c"]).alias("k")))
    chars = F.transform(chars, lambda x: F.struct(x["c"].alias("c"), x["i"].alias("i"), letters(x).alias("of")))
    return F.array_join(F.transform(chars, made), "")


def _name(key: str, name: Column, gender: Column, attempt_of) -> Column:
    """The title, then each word's surrogate; the first of several words is a given name."""
    words = words_of(name)

    def one(w: Column, i: Column) -> Column:
        drawn = _let(attempt_of(F.lit("word"), F.lower(w)), lambda n: F.struct(n.alias("n"), _stream(key, F.lit("word"), F.lower(w), n).alias("s")))
        made = _let(drawn, lambda d: F.when((i == 0) & (F.size(words) > 1), _word(w, d["s"], d["n"], gender)).otherwise(_word(w, d["s"], d["n"])))
        return F.when(w.isin(*PARTICLES), w).otherwise(made)

    return F.array_join(F.transform(words, one), " ")


def surrogate(key: str, kind: Column, mention: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a mention: of its type and format, the same for all mentions of an entity."""
    local = F.substring_index(mention, "@", 1)
    # mail goes to reserved example domains only
    mail = F.concat(
        _let(_stream(key, kind, F.lower(local), attempt), lambda s: _letters_and_digits(local, s, F.lit(0))), F.lit("@m"),
        F.substring(F.sha2(F.concat_ws(_SEP, F.lit(key), F.lower(mention), attempt.cast("string")), 256), 1, 10), F.lit(".example.org"),
    )
    country = F.length(F.regexp_extract(mention, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0))

    def made(s: Column) -> Column:
        new = (
            F.when(kind == "email", mail).when(kind == "ip", _octets(mention, s)).when(kind == "word", _word(mention, s, attempt)).when(kind == "card", _card(mention, s))
            .when(kind == "iban", _iban(mention, s)).when(kind == "phone", _digits(mention, s, country)).otherwise(_digits(mention, s, F.lit(0)))
        )
        # where a format has no more free values, the type and 80 bits
        return F.when(attempt < ROUNDS, new).otherwise(F.concat(kind, F.lit("-"), F.substring(s, 1, 20)))

    return _let(_stream(key, kind, canon, attempt), made)


def _by_pattern(text: Column, with_pattern, otherwise: Column) -> Column:
    """with_pattern(joint pattern) for the types that text can hold; a text without an @, a digit or a titled
    capital is never searched for what needs one."""
    has = (text.contains("@"), text.rlike("[0-9]"), text.rlike(_TITLED))

    def chosen(f: Column) -> Column:
        out = None
        for kinds in ((m, n, t) for m in (False, True) for n in (False, True) for t in (False, True) if m or n or t):
            if kinds[0] and not kinds[1]:
                continue  # rare, and covered by the pattern with numbers
            hit = (f["m"] == (kinds[0])) & (f["t"] == kinds[2]) & ((f["n"] == kinds[1]) | F.lit(kinds[0]))
            part = with_pattern(joint_pattern(*kinds))
            out = F.when(hit, part) if out is None else out.when(hit, part)
        return out.otherwise(otherwise)

    return _let(F.struct(has[0].alias("m"), has[1].alias("n"), has[2].alias("t")), chosen)


def mentions(text: Column) -> Column:
    """All entities of a text from left to right; none where the text has no hint of one."""
    none = F.array().cast("array<string>")
    return F.when(text.isNotNull(), _by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)), none)).otherwise(none)


#: Attempts after which a surrogate gives up the mention's format.
ROUNDS = 20


def _entities(found: DataFrame) -> DataFrame:
    """found, with a column mention, as a row per entity: kind, canon, mention.  A name's entities are its words."""
    found = found.withColumn("kind", entity_type(F.col("mention"))).where("kind is not null")
    parts = F.when(F.col("kind") == "name", F.filter(words_of(F.col("mention")), lambda w: ~w.isin(*PARTICLES))).otherwise(F.array("mention"))
    found = found.withColumn("mention", F.explode(parts)).withColumn("kind", F.when(F.col("kind") == "name", "word").otherwise(F.col("kind")))
    return found.withColumn("canon", canonical(F.col("kind"), F.col("mention")))


def _claimed(kind: Column, made: Column) -> Column:
    """What surrogates of two entities mustn't share: a word's last letter may differ by gender."""
    return F.when(kind == "word", F.concat(F.lower(F.substring(made, F.lit(1), F.length(made) - 1)), F.lit("*"))).otherwise(made)


def attempts(docs: DataFrame, key: str, ws: Workspace) -> DataFrame | None:
    """(kind, canon, attempt) of entities whose first surrogate collides; None if none does.

    A collision is told by the surrogates' canonical forms: of two different entities, or of a surrogate
    and an entity of the corpus.  The smaller canonical form keeps its surrogate.  After ROUNDS attempts
    surrogates are distinct by 80 bits, so that the search ends."""
    found = _entities(docs.select(F.explode(F.array_distinct(mentions(F.col("text")))).alias("mention")))
    entities = ws.save(found.groupBy("kind", "canon").agg(F.min("mention").alias("mention")))
    real = ws.save(entities.select("kind", _claimed(F.col("kind"), F.col("canon")).alias("claim")).distinct())
    now, bumped = entities.withColumn("attempt", F.lit(0)), None
    for n in range(1, ROUNDS + 1):
        made = canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("mention"), F.col("canon"), F.col("attempt")))
        made = ws.save(now.withColumn("claim", _claimed(F.col("kind"), made)))
        taken = made.groupBy("kind", "claim").agg(F.min("canon").alias("first"), F.count("*").alias("claims")).where("claims > 1").select("kind", "claim", "first")
        clash = made.join(taken, ["kind", "claim"]).where("canon <> first").select("kind", "canon")
        own = made.join(real, ["kind", "claim"], "left_semi").select("kind", "canon")
        again = ws.save(clash.unionAll(own).distinct().withColumn("again", F.lit(True)))
        if again.isEmpty():
            return bumped
        old = now
        now = ws.save(old.join(again, ["kind", "canon"], "left").withColumn("attempt", F.when(F.col("again"), n).otherwise(F.col("attempt"))).select("kind", "canon", "mention", "attempt"))
        bumped = now.where("attempt > 0").select("kind", "canon", "attempt")
    return bumped


def rewritten(text: Column, key: str, attempt_of) -> Column:
    """struct(text, kinds): the text with its entities replaced, and the array of their types."""

    def full_names(found: Column) -> Column:
        named = F.filter(found, lambda x: (x["kind"] == "name") & (F.size(words_of(x["m"])) > 1))
        full = F.transform(named, lambda x: F.struct(F.array_join(words_of(x["m"]), " ").alias("name"), _gender(x["m"]).alias("gender")))
        return _let(F.array_distinct(full), lambda f: F.struct(F.array_distinct(F.transform(f, lambda x: x["name"])).alias("names"), F.filter(f, lambda x: x["gender"] != "n").alias("known")))

    def replaced_all(found: Column, full: Column) -> Column:
        def gender_of(name: Column, own: Column) -> Column:
            other = F.filter(full["known"], lambda x: x["name"] == name)
            return F.when(own != "n", own).otherwise(F.coalesce(F.get(other, F.lit(0))["gender"], F.lit("n")))

        def replaced(x: Column) -> Column:
            m, kind = x["m"], x["kind"]
            canon = canonical(kind, m)
            name = F.concat(F.substring_index(m, " ", 1), F.lit(" "), _name(key, m, gender_of(F.array_join(words_of(m), " "), _gender(m)), attempt_of))
            return F.when(kind.isNull(), m).when(kind == "name", name).otherwise(surrogate(key, kind, m, canon, attempt_of(kind, canon)))

        # the names that stand without a title, in what lies between the mentions
        bare = F.transform(full["names"], lambda n: F.struct(n.alias("old"), _name(key, F.concat(F.lit("- "), n), gender_of(n, F.lit("n")), attempt_of).alias("new")))
        without = lambda p, b: F.aggregate(b, p, lambda t, n: F.regexp_replace(t, F.concat(F.lit(_START), n["old"], F.lit(_END)), n["new"]))
        parts = _by_pattern(text, lambda p: F.split(text, p, -1), F.array(text))
        parts = F.when(F.size(full["names"]) > 0, _let(bare, lambda b: F.transform(parts, lambda p: without(p, b)))).otherwise(parts)
        return F.array_join(F.zip_with(parts, F.transform(found, replaced), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")

    def whole(found: Column) -> Column:
        kinds = F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull())
        new = F.when(F.size(found) > 0, _let(full_names(found), lambda full: replaced_all(found, full))).otherwise(text)
        return F.struct(new.alias("text"), kinds.alias("kinds"))

    return _let(F.transform(mentions(text), lambda m: F.struct(m.alias("m"), entity_type(m).alias("kind"))), whole)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with their texts rewritten, and n_email ... n_name counts of the replaced mentions (names by their
    titles; those without one aren't counted).

    Null texts stay null and count nothing; empty texts and texts without entities stay as they are;
    repeated rows get the same result; a null doc_id is a row like others.  Empty tables give empty
    results; columns of docs that clash with the counts are replaced by them.
    """
    ws = Workspace(docs.sparkSession)
    counts = [f"n_{k}" for k in PATTERNS]
    docs = docs.select(*[c for c in docs.columns if c not in counts])
    rest = [c for c in docs.columns if c != "text"]
    bumped = attempts(docs.select("text"), key, ws)
    place = fresh(docs, "pii_attempts")
    if bumped is None:
        rows, attempt_of = docs, lambda kind, canon: F.lit(0)
    else:
        # the few texts with colliding entities get their attempts as a map; keyed by text, as ids may repeat
        named = docs.select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(mentions(F.col("text")))).alias("mention"))
        named = _entities(named).join(bumped, ["kind", "canon"])
        maps = named.select("h", F.concat_ws(_SEP, "kind", "canon").alias("k"), "attempt").distinct().groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias(place))
        h = fresh(docs, "pii_text")
        rows = docs.withColumn(h, F.xxhash64("text")).join(maps.withColumnRenamed("h", h), h, "left").drop(h)
        attempt_of = lambda kind, canon: F.coalesce(F.try_element_at(F.col(place), F.concat_ws(_SEP, kind, canon)), F.lit(0))
    held = fresh(docs, "pii_text")
    out = rows.select(*rest, rewritten(F.col("text"), key, attempt_of).alias(held))
    count = lambda k: F.size(F.filter(F.col(held)["kinds"], lambda x: x == k)).cast("long")
    text = F.col(held)["text"].alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[count(k).alias(f"n_{k}") for k in PATTERNS])
