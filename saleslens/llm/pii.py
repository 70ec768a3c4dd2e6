"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Built-in functions only. One pattern finds all mentions of a text; the cards in it are the text's own,
chosen by their check digit. Each mention has one or two
entities in canonical form (an address in lower case, the digits of a number, each name), so that
an entity gets the same surrogate wherever and however it is written. Numbers go through a keyed
permutation of numbers of the same length; addresses and names through a keyed hash.

Over the whole corpus the distinct entities are checked: no two may share a surrogate, and no
surrogate may be an entity that occurs. Those that fail get the next attempt until none is left.
Only texts with such an entity need the table of attempts; all others compute their surrogates
from the key alone.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saleslens.llm.common import let, stored

#: Names the key in the session's configuration. Whoever knows the key can turn numbers back: without
#: one the key below is taken, which is public, and a warning says so.
KEY_NAME = "spark.saleslens.surrogateKey"
KEY = "surrogate-key"
ROUNDS = 6
MAX_ATTEMPTS = 64
#: At this attempt, a format of numbers that has too few unused ones left is permuted as a whole.
CROWDED = 16
NUMBERS = ("ip", "card", "ssn", "phone")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC_LETTERS = "абвгдежзиклмнопрстуфхцчшэюя"

#: Patterns of the kinds, in the order in which they are tried at a place.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FEMALE = r"Mrs|Ms|Miss|Madam|Lady|Frau|Professorin|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Dra|Profa|[Гг]оспожа|г-жа"
MALE = r"Mr|Mister|Sir|Lord|Herrn?|Monsieur|Señor|Sr|[Гг]осподин|г-н"
EITHER = r"Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur|Mx|Rev|[Дд]октор|[Пп]рофессор"
LABEL = r"[Nn]ame|NAME|[Pp]atient|[Cc]ontact|[Vv]orname|[Nn]achname|[Nn]om|[Nn]ombre|[Ии]мя|[Фф]амилия"
TITLE = rf"(?:(?:(?:{FEMALE}|{MALE}|{EITHER})\.?|(?:{LABEL}):) )"
#: First letters of all these.
TITLE_STARTS = "".join(sorted(set("MLFPSDHRNCV" + "cnpv" + "гдпГДПИиФф")))
#: Letters, digits and signs of an address before the @: Latin, Greek and Cyrillic.
LOCAL = r"A-Za-z0-9\u00C0-\u052F\u1E00-\u1EFF._%+-"
CARD_START = r"(?:[3-6]\d{3}|2(?:22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720))"
CARD_SIZES = range(13, 20)
PATTERNS = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "card": rf"(?<![\w.+-]){CARD_START}(?:[ -]?\d){{{CARD_SIZES[0] - 4},{CARD_SIZES[-1] - 4}}}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)",
    "name": rf"(?=[{TITLE_STARTS}])(?<!\p{{L}}){TITLE}++\p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+)?",
}


def _mention(card: str) -> str:
    """The pattern of all mentions, with `card` for the cards. No mention follows a letter from A to
    Z, which is asked first, so that the inside of a word costs one look."""
    kinds = "|".join(f"(?:{card if kind == 'card' else pattern})" for kind, pattern in PATTERNS.items())
    return f"(?<![A-Za-z])(?:{kinds})"


#: Matches nowhere.
NEVER = "(?!)"
#: What every mention has, cheap to look for.
HINT = rf"[@\d]|(?=[{TITLE_STARTS}])(?<!\p{{L}}){TITLE}\p{{Lu}}"
#: Syllables of made-up names by script, and their endings by gender.
LATIN = "ba be bo da de do fa fe ga ge ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se so ta te to va ve vi".split()
CYRILLIC = "ба бе бо ва ве да де до га го ка ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се со та те то".split()
ENDINGS = {
    "latin": {"female": "lia", "male": "ron", "given": "min", "family": "sen"},
    "cyrillic": {"female": "лина", "male": "рон", "given": "мин", "family": "нов"},
}
NAMES = ("female", "male", "given", "family")


def _stream(seed: Column, k: Column, n: Column | int) -> Column:
    """The k-th number below n that the seed gives."""
    return F.pmod(F.xxhash64(seed, k), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _seed(kind: Column | str, value: Column, attempt: Column, key: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value).cast("binary"), 256)


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _like(value: Column, seed: Column) -> Column:
    """Letters for letters, digits for digits, everything else as it is."""
    letters, digits, cyrillic = F.lit(LETTERS), F.lit("0123456789"), F.lit(CYRILLIC_LETTERS)

    def other(c: Column, k: Column) -> Column:
        return (
            F.when(c.rlike("[a-z]"), F.substring(letters, _stream(seed, k, 26) + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), F.substring(digits, _stream(seed, k, 10) + 1, F.lit(1)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substring(cyrillic, _stream(seed, k, len(CYRILLIC_LETTERS)) + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substring(letters, _stream(seed, k, 26) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(value), other), "")


def permuted(left: Column, right: Column, left_size: Column, right_size: Column, seed: Column) -> Column:
    """Keyed permutation of pairs (left, right) below the sizes: struct l, r."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def drawn(k: Column, half: Column, size: Column) -> Column:
        bits = F.substring(F.sha2(F.concat_ws(":", seed, k, half).cast("binary"), 256), 1, 15)
        return F.pmod(F.conv(bits, 16, 10).cast("bigint"), size)

    def turn(s: Column, k: Column) -> Column:
        return F.when(
            k % 2 == 0,
            F.struct(F.pmod(s["l"] + drawn(k, s["r"], left_size), left_size).alias("l"), s["r"].alias("r")),
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + drawn(k, s["l"], right_size), right_size).alias("r")))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _digits(value: Column, seed: Column) -> Column:
    """Keyed permutation of digit strings of the same length, of 2 digits at least."""

    def split(d: Column) -> Column:
        n = F.char_length(d)
        a = F.floor(n / 2).cast("int")
        pair = permuted(
            F.substring(d, F.lit(1), a), F.substring(d, a + 1, n), _power(a), _power(n - a), seed
        )
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), n - a, "0")))

    return F.when(F.char_length(value) >= 2, let(value, split)).otherwise(value)


def _check_digit(payload: Column) -> Column:
    """Luhn check digit."""
    doubled = F.transform(
        F.reverse(_chars(payload)),
        lambda c, k: F.when(k % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _name(script: str, ending: str, value: Column, seed: Column, attempt: Column) -> Column:
    syllables = F.array(*map(F.lit, LATIN if script == "latin" else CYRILLIC))
    size = len(LATIN if script == "latin" else CYRILLIC)
    count = 3 + F.floor(attempt / 8).cast("int")
    made = F.transform(F.sequence(F.lit(1), count), lambda k: F.get(syllables, _stream(seed, k, size)))
    return F.concat(F.array_join(made, ""), F.lit(ENDINGS[script][ending]))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of a canonical entity."""
    seed = _seed(kind, value, attempt, key)
    fixed = _seed(kind, F.lit(""), attempt, key)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    name_of_domain = F.regexp_replace(domain, r"\.[a-z]+$", "")
    # a short address has few others of its shape: from the 8th attempt on it grows
    longer = F.array_join(
        F.transform(
            F.slice(F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), 2, MAX_ATTEMPTS),
            lambda k: F.substring(F.lit(LETTERS), _stream(seed, -k, 26) + 1, F.lit(1)),
        ),
        "",
    )
    email = F.concat(
        _like(local, seed), longer, F.lit("@"),
        _like(name_of_domain, _seed("domain", name_of_domain, F.lit(0), key)),
        F.lit("."), F.substring_index(domain, ".", -1),
    )
    octets = F.split(value, r"\.")
    octet = [F.get(octets, F.lit(k)).cast("int") for k in range(4)]
    halves = permuted(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), fixed)
    ip = let(halves, lambda h: F.concat_ws(
        ".", *(x.cast("int").cast("string") for x in (F.floor(h["l"] / 256), h["l"] % 256, F.floor(h["r"] / 256), h["r"] % 256))
    ))
    # the range from 2221 to 2720 is told by four digits, the others by one
    own = F.when(value.startswith("2"), 4).otherwise(1)
    payload = F.concat(
        F.substring(value, F.lit(1), own), _digits(F.substring(value, own + 1, F.char_length(value) - own - 1), fixed)
    )
    card = let(payload, lambda p: F.concat(p, _check_digit(p)))
    prefix = F.regexp_extract(value, r"^(\+\d+\|)?", 0)
    phone = F.concat(prefix, _digits(F.regexp_replace(value, r"^\+\d+\|", ""), fixed))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    out = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "ssn", _digits(value, fixed)).when(kind == "phone", phone)
    )
    for ending in NAMES:
        for s in ("cyrillic", "latin"):
            out = out.when((kind == ending) & (script == s), _name(s, ending, value, seed, attempt))
    return out.otherwise(value)


def kind_of(mention: Column) -> Column:
    """Kind of a mention; null for a number like a card's without a valid check digit."""
    out = F.when(F.contains(mention, F.lit("@")), "email")
    for kind in ("ip", "card", "ssn", "phone", "name"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return F.when((out == "card") & ~F.call_function("luhn_check", F.regexp_replace(mention, r"\D", "")), None).otherwise(out)


def entities(mention: Column) -> Column:
    """kind and canonical value of the entities of a mention, in order; empty if it is none."""

    def one(kind: Column | str, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))

    def of(kind: Column) -> Column:
        digits = F.regexp_replace(mention, r"\D", "")
        country = F.regexp_extract(mention, r"^\+\d{1,3}(?=[ .(-])", 0)
        # without a separator the country code can't be told: the first digit stands for it
        country = F.when(mention.startswith("+") & (country == ""), F.substring(mention, 1, 2)).otherwise(country)
        rest = F.substring(digits, F.greatest(F.char_length(country), F.lit(1)), F.char_length(digits))
        phone = F.when(country == "", digits).otherwise(F.concat(country, F.lit("|"), rest))
        names = F.split(F.lower(F.regexp_replace(mention, f"^{TITLE}++", "")), "[ -]")
        title = F.regexp_extract(mention, f"^{TITLE}++", 0)
        gender = F.when(title.rlike(rf"(?:^| )(?:{FEMALE})\.? "), "female")
        gender = gender.when(title.rlike(rf"(?:^| )(?:{MALE})\.? "), "male").otherwise("given")
        family = one("family", F.element_at(names, -1))
        return (
            F.when(kind == "email", F.array(one(kind, F.lower(mention))))
            .when(kind == "ip", F.array(one(kind, mention)))
            .when(kind.isin("card", "ssn"), F.array(one(kind, digits)))
            .when(kind == "phone", F.array(one(kind, phone)))
            .when((kind == "name") & (F.size(names) > 1), F.array(one(gender, F.get(names, F.lit(0))), family))
            .when(kind == "name", F.array(family))
            .otherwise(F.array().cast("array<struct<kind: string, value: string>>"))
        )

    return let(kind_of(mention), of)


def _shaped(shape: Column, plain: Column) -> Column:
    """The digits of `plain` put where `shape` has digits."""

    def put(c: Column, k: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substring(shape, F.lit(1), k), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substring(plain, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(shape), put), "")


def _cased(like: Column, plain: Column) -> Column:
    return (
        F.when((F.char_length(like) > 1) & (F.upper(like) == like), F.upper(plain))
        .when(F.lower(like) == like, plain)
        .otherwise(F.initcap(plain))
    )


def replaced(mention: Column, found: Column, made: Column) -> Column:
    """The mention with surrogates `made` for its entities `found`, in its own format."""
    kind = F.get(found, F.lit(0))["kind"]
    first, last = F.get(made, F.lit(0)), F.element_at(made, -1)
    title = F.regexp_extract(mention, f"^{TITLE}++", 0)
    words = F.regexp_replace(mention, f"^{TITLE}++", "")
    given = F.regexp_extract(words, r"^[^ -]+", 0)
    between = F.regexp_extract(words, r"[ -]", 0)
    own = F.regexp_extract(words, r"[^ -]+$", 0)
    return (
        F.when(F.size(found) == 0, mention)
        .when(kind == "email", F.when(F.upper(mention) == mention, F.upper(first)).otherwise(first))
        .when(kind == "ip", first)
        .when(kind.isin("card", "ssn", "phone"), _shaped(mention, F.regexp_replace(first, r"\D", "")))
        .when(F.size(found) == 1, F.concat(title, _cased(own, last)))
        .otherwise(F.concat(title, _cased(given, first), between, _cased(own, last)))
    )


def pattern(body: Column) -> Column:
    """The pattern of the mentions of a text: of numbers like a card's it has those whose check digit is right.

    A number that only looks like a card's thus hides nothing: what lies in it is found by the other
    patterns. A card may start at any group of digits and end at any, the longest first.
    """

    def runs(size: int) -> Column:
        start = rf"(?<![\w.+-])(?=({CARD_START}(?:[ -]?\d){{{size - 4}}}(?![\w-])))"
        return F.regexp_extract_all(body, F.lit(start), F.lit(1))

    every = F.array_distinct(F.concat(*map(runs, reversed(CARD_SIZES))))
    cards = F.filter(every, lambda run: F.call_function("luhn_check", F.regexp_replace(run, r"\D", "")))
    before, after = _mention("\0").split("\0")

    def own(cards: Column) -> Column:
        of = F.concat(F.lit(rf"{before}(?<![\w.+-])(?:"), F.array_join(cards, "|"), F.lit(rf")(?![\w-]){after}"))
        return F.when(F.size(cards) > 0, of).otherwise(_mention(NEVER))

    return F.when(body.rlike(PATTERNS["card"]), let(cards, own)).otherwise(_mention(NEVER))


def mentions(body: Column, mention: Column) -> Column:
    """All mentions of a text in order, by its `pattern`."""
    none = F.array().cast("array<string>")
    return F.when(body.rlike(HINT), F.regexp_extract_all(body, mention, F.lit(0))).otherwise(none)


def key_of(spark: SparkSession) -> str:
    found = spark.conf.get(KEY_NAME, None)
    if found is None:
        warnings.warn(f"{KEY_NAME} is not set: surrogates are made with a public key", stacklevel=2)
    return found or KEY


def sealed(df: DataFrame, key: str) -> DataFrame:
    """`df` stored with its column `value` encrypted, and read with it in clear: no entity is left on
    the disk. Equal values have equal ciphers."""
    secret = F.substring(F.sha2(F.lit(f"seal:{key}").cast("binary"), 256), 1, 32).cast("binary")
    mode = F.lit("ECB")
    kept = stored(df.withColumn("value", F.aes_encrypt(F.col("value").cast("binary"), secret, mode)))
    return kept.withColumn("value", F.aes_decrypt("value", secret, mode).cast("string"))


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, attempt, made for the distinct entities of `found`, checked for collisions.

    Of entities that would share a surrogate the first by value keeps it. Where the numbers of a
    format (kind, country code and length) still collide at the attempt `CROWDED`, nearly all numbers
    of that format occur: they then get one permutation together, which keeps them distinct, but a
    surrogate may be a number that occurs. Entities that still collide after MAX_ATTEMPTS keep their
    last surrogates, which may be shared: names and addresses grow with the attempts, so that no kind
    comes to this but one without room.
    """
    distinct = found.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    made = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)
    form = F.concat_ws(":", "kind", F.char_length("value").cast("string"), F.regexp_extract("value", r"^(\+\d+\|)?", 0))
    rows = sealed(distinct.withColumn("made", made), key)
    settled = rows.limit(0)
    for attempt in range(1, MAX_ATTEMPTS + 1):
        taken = rows.select("kind", F.col("value").alias("made")).withColumn("real", F.lit(True))
        place = F.row_number().over(W.partitionBy("kind", "made").orderBy("attempt", "value"))
        checked = sealed(
            rows.withColumn("place", place).join(taken, ["kind", "made"], "left")
            .select("kind", "value", "attempt", "made", (F.coalesce("real", F.lit(False)) | (F.col("place") > 1)).alias("bad")),
            key,
        )
        if checked.filter("bad").isEmpty():
            return rows.unionByName(settled)
        if attempt == CROWDED:
            formed = checked.withColumn("form", form)
            full = formed.filter(F.col("bad") & F.col("kind").isin(*NUMBERS)).select("form").distinct()
            together = formed.join(full, "form", "left_semi").select("kind", "value")
            settled = sealed(together.withColumn("attempt", F.lit(CROWDED)).withColumn("made", made), key)
            checked = formed.join(full, "form", "left_anti").drop("form")
        again = checked.filter("bad").select("kind", "value", F.lit(attempt).alias("attempt"))
        rows = sealed(checked.filter("not bad").drop("bad").unionByName(again.withColumn("made", made)), key)
    return rows.unionByName(settled)


def with_surrogates(
    docs: DataFrame, text: str = "text", key: str | None = None, counts: str | None = None
) -> DataFrame:
    """docs with `text` rewritten and, if `counts` names one, a struct column of counts: n_entities,
    n_emails, n_phones, n_ips, n_cards, n_ssns, n_names.

    A null text stays null; a text without personal data stays as it is. Equal entities have equal
    surrogates in all rows, different ones different. Numbers of 13 to 19 digits count as cards only
    with a valid check digit. Without a `key` the session's is taken.
    """
    body = F.col(text)
    key = key or key_of(docs.sparkSession)
    found = sealed(
        docs.filter(body.rlike(HINT))
        .select(body.alias("body"), pattern(body).alias("pattern"))
        .select(
            F.xxhash64("body").alias("key"),
            F.explode(F.array_distinct(mentions(F.col("body"), F.col("pattern")))).alias("mention"),
        )
        .select("key", F.inline(entities(F.col("mention")))),
        key,
    )
    later = surrogates(found, key).filter("attempt > 0")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    if later.isEmpty():
        rows = rows.withColumn("fix", F.lit(None).cast("map<string,string>"))
    else:
        pair = F.struct(F.concat_ws(":", "kind", "value").alias("key"), F.col("made").alias("value"))
        fixes = (
            found.join(later, ["kind", "value"]).groupBy("key")
            .agg(F.map_from_entries(F.collect_set(pair)).alias("fix"))
        )
        rows = rows.withColumn("key", F.xxhash64(F.col(f"row.{text}"))).join(fixes, "key", "left").drop("key")
    old = F.col("row")[text]
    rows = rows.withColumn("pattern", pattern(F.coalesce(old, F.lit(""))))
    rows = rows.withColumn("found", mentions(F.coalesce(old, F.lit("")), F.col("pattern")))

    def rewritten(mention: Column) -> Column:
        def made(e: Column) -> Column:
            fix = F.try_element_at("fix", F.concat_ws(":", e["kind"], e["value"]))
            return F.coalesce(fix, surrogate(e["kind"], e["value"], F.lit(0), key))

        return let(
            entities(mention),
            lambda own: F.struct(
                replaced(mention, own, F.transform(own, made)).alias("text"),
                F.get(own, F.lit(0))["kind"].alias("kind"),
            ),
        )

    rows = rows.withColumn("parts", F.transform("found", rewritten))
    gaps = F.split(old, F.col("pattern"), -1)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("parts")), "parts", lambda g, p: F.concat(g, p["text"])), ""),
        F.element_at(gaps, -1),
    )
    new = F.when(F.size("found") > 0, joined).otherwise(old)

    def count(*kinds: str) -> Column:
        return F.size(F.filter("parts", lambda p: p["kind"].isin(*kinds))).cast("bigint")

    numbers = F.struct(
        F.size(F.filter("parts", lambda p: p["kind"].isNotNull())).cast("bigint").alias("n_entities"),
        count("email").alias("n_emails"), count("phone").alias("n_phones"), count("ip").alias("n_ips"),
        count("card").alias("n_cards"), count("ssn").alias("n_ssns"),
        count(*NAMES).alias("n_names"),
    )
    out = [new.alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return rows.select(*out, *([numbers.alias(counts)] if counts else []))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_entities, n_emails, n_phones, n_ips, n_cards, n_ssns, n_names."""
    return with_surrogates(docs.select("doc_id", "text"), counts="n").select("doc_id", "text", "n.*")
