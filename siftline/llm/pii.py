"""Surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by keyed values of the same type and format: the same entity gets the same surrogate
everywhere, different entities get different ones, and no surrogate equals an entity of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored

# Given names by gender and script, and the titles that precede names.
MALE = "John James Robert Michael William David Thomas Peter Hans Klaus Jean Pierre Luis Carlos Juan Иван Сергей Дмитрий".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Susan Anna Maria Ursula Marie Claire Carmen Lucia Ольга Анна Елена".split()
TITLES = ["Mr\\.", "Mrs\\.", "Ms\\.", "Miss", "Dr\\.", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "господин", "госпожа"]

_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
_GIVEN = "(?:" + "|".join(MALE + FEMALE) + ")"
_BEFORE = "(?:" + "|".join([*TITLES, *MALE, *FEMALE]) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# The type of an entity and its pattern, in order of preference. Each begins with what fails fastest, since every
# pattern is tried at every character of a text. An e-mail address is tried once per run of its characters, whole,
# with the punctuation in front of it, and right after another entity.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "phone": r"(?=[+(\d])(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
              r"|(?<=[=\"])(?i:(?<=token = \")[0-9a-z_-]{16,}(?=\")|(?<=password=)[^\s\"'<>]{4,})",
    "given": rf"(?=[A-ZИСДОАЕ])(?<!\p{{L}})(?:{_GIVEN}(?=\s{_NAME})|(?<=(?:Mr\.|Ms\.|Mrs\.|Dr\.) ){_GIVEN}(?!\p{{L}}))",
    "surname": rf"(?=\p{{Lu}})(?<=\s)(?<=(?<!\p{{L}}){_BEFORE}\s){_NAME}",
}

# All types at once, behind a first character that few places of a text have. E-mail addresses come first, as they may
# begin like any other type.
ANY = "|".join([
    PATTERNS["email"],
    "(?=[0-9+(])(?:" + "|".join(PATTERNS[t] for t in ("ip", "phone", "ssn", "card")) + ")",
    r"(?=\p{Lu})(?:" + "|".join(PATTERNS[t] for t in ("iban", "given", "surname")) + ")",
    PATTERNS["secret"],
])
# Texts without any of these, "@", "=" or "AKIA" hold no entity.
_NUMBERED = r"[0-9]\.?[0-9]"
_NAMED = rf"(?=\p{{Lu}}|г)(?:{_BEFORE})\s\p{{Lu}}"

# Surrogate names are built from syllables, one table per script.
_LATIN = "ba do ka le mi no ra si ta ve lo ri na be du go ha ju pe to".split()
_CYRILLIC = "ба до ка ле ми но ра си та ве ло ри на бе ду го за жу пе то".split()
_UPPER_HALF, EASY_TRIES = r"^\p{Lu}+$", 6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn(c: Column) -> Column:
    """Whether the digits carry a valid check digit."""
    return F.pmod(_luhn_sum(F.reverse(_digits(c)), 0), F.lit(10)) == 0


def _luhn_sum(reverse: Column, shift: int) -> Column:
    def part(d: Column, i: Column) -> Column:
        n = d.cast("int")
        double = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when((i + shift) % 2 == 1, double).otherwise(n)

    return F.aggregate(F.transform(F.split(reverse, ""), part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _kind(c: Column) -> Column:
    """The first type whose pattern the mention fills; names are told by their context-free shape last."""
    whole = {t: f"^(?:{p})$" for t, p in PATTERNS.items()}
    return (
        F.when(c.rlike(whole["email"]), "email").when(c.rlike(whole["ip"]), "ip").when(c.rlike(whole["phone"]), "phone")
        .when(c.rlike(whole["ssn"]), "ssn").when(c.rlike(whole["card"]), F.when(luhn(c), "card"))
        .when(c.rlike(whole["iban"]), "iban")
        .when(c.isin(MALE), "male").when(c.isin(FEMALE), "female")
        .when(c.rlike(rf"^{_NAME}$"), "surname").otherwise("secret")
    )


def _normal(kind: Column, c: Column) -> Column:
    """What mentions of one entity have in common: letters' case, blanks and punctuation do not count."""
    return (
        F.when(kind == "email", F.lower(F.regexp_replace(c, r"^[._%+-]+", "")))
        .when(kind == "phone", F.right(_digits(c), F.lit(10)))
        .when(kind.isin("ssn", "card"), _digits(c)).when(kind == "iban", F.replace(c, F.lit(" "), F.lit("")))
        .when(kind.isin("surname", "male", "female"), F.initcap(c)).otherwise(c)
    )


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _same_format(c: Column, seed: Column, hexadecimal: Column) -> Column:
    """Digits to digits and letters to letters of the same case; everything else stays."""
    def other(ch: Column, i: Column) -> Column:
        letters = lambda base, n: F.char(_draw(seed, i, n) + base)
        return (
            F.when(ch.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .when(ch.rlike("[a-z]"), F.when(hexadecimal, letters(97, 6)).otherwise(letters(97, 26)))
            .when(ch.rlike("[A-Z]"), F.when(hexadecimal, letters(65, 6)).otherwise(letters(65, 26)))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(c, ""), other), "")


def _syllables(seed: Column, table: list[str], n: Column) -> Column:
    words = F.array(*map(F.lit, table))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(words, _draw(seed, i, len(table)))), ""))


def surrogate(kind: Column, normal: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity in its normal form. Late attempts get longer, so that one is always left."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string")), 256)
    longer = F.greatest(attempt - EASY_TRIES, F.lit(0))
    more = F.array_join(F.transform(F.sequence(F.lit(0), longer), lambda i: F.when(i > 0, _draw(seed, i + 1000, 10).cast("string")).otherwise("")), "")
    plain = _same_format(normal, seed, normal.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    domain = F.split_part(normal, F.lit("@"), F.lit(2))
    top = F.substring_index(domain, ".", -1)
    site = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    place = _same_format(site, F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), F.lit(False))
    user = _same_format(F.split_part(normal, F.lit("@"), F.lit(1)), seed, F.lit(False))
    octets = F.array_join(F.array(*[_draw(seed, i, 254) + 1 for i in range(4)]), ".")
    # The first digit of a card names its issuer; the last one is its check digit.
    body = F.concat(F.left(normal, F.lit(1)), F.substring(plain, F.lit(2), F.length(plain) - 2), more)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.reverse(body), 1), F.lit(10)), F.lit(10)).cast("string")
    cyrillic = normal.rlike(r"^\p{IsCyrillic}")
    stem = F.when(cyrillic, _syllables(seed, _CYRILLIC, 3 + longer)).otherwise(_syllables(seed, _LATIN, 3 + longer))
    ending = (
        F.when(kind == "female", F.when(cyrillic, "на").otherwise("na"))
        .when(kind == "male", F.when(cyrillic, "н").otherwise("n"))
        .when(cyrillic, F.when(normal.rlike("[ая]$"), "ова").otherwise("ов")).otherwise("son")
    )
    return (
        F.when(kind == "email", F.concat(user, more, F.lit("@"), place, F.lit("."), top))
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(body, check))
        .when(kind.isin("male", "female", "surname"), F.concat(stem, ending))
        .when((kind == "secret") & normal.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(plain, 5, 1 << 30), more))
        .when(kind == "iban", F.concat(F.left(normal, F.lit(2)), F.substring(plain, 3, 1 << 30), more))
        .otherwise(F.concat(plain, more))
    )


def _as_written(kind: Column, mention: Column, value: Column) -> Column:
    """The surrogate in the format of one mention: its punctuation, blanks and case."""
    digits = _digits(mention)
    lead = F.length(digits) - F.length(value)
    place = lambda i: F.length(_digits(F.substring(mention, F.lit(1), i + 1))) - lead
    filled = F.array_join(F.transform(
        F.split(mention, ""),
        lambda ch, i: F.when(ch.rlike("[0-9]") & (place(i) > 0), F.substring(value, place(i), F.lit(1))).otherwise(ch),
    ), "")
    # A surrogate with more digits than the mention goes out plain.
    punctuated = F.when(lead >= 0, filled).otherwise(value)
    spaced = F.when(mention.contains(" "), F.rtrim(F.regexp_replace(value, "(.{4})", "$1 "))).otherwise(value)
    return (
        F.when(kind.isin("phone", "ssn", "card"), punctuated).when(kind == "iban", spaced)
        .when(kind.isin("male", "female", "surname") & mention.rlike(_UPPER_HALF), F.upper(value))
        .when(kind == "email", F.concat(
            F.regexp_extract(mention, r"^[._%+-]*", 0), F.when(mention == F.upper(mention), F.upper(value)).otherwise(value),
        )).otherwise(value)
    )


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, normal, value)`` for distinct ``(kind, normal)``; every collision moves to the next attempt.

    A surrogate collides when a smaller entity of its type has it already or when it is itself an entity of the
    corpus. Entities that keep theirs never change, so the rounds end; each takes two aggregates over entities.
    """
    now = stored(entities.select("kind", "normal", F.lit(0).alias("attempt")), "entities")
    while True:
        made = now.withColumn("value", surrogate(F.col("kind"), F.col("normal"), key, F.col("attempt")))
        made = stored(made, "surrogates")
        owners = made.groupBy("kind", "value").agg(F.min(F.struct("attempt", "normal")).alias("owner"))
        taken = made.select("kind", F.col("normal").alias("value"), F.lit(True).alias("taken"))
        checked = made.join(owners, ["kind", "value"]).join(taken, ["kind", "value"], "left")
        wrong = (F.col("owner.normal") != F.col("normal")) | F.coalesce("taken", F.lit(False))
        if checked.filter(wrong).isEmpty():
            return made.select("kind", "normal", "value")
        now = stored(checked.select("kind", "normal", (F.col("attempt") + wrong.cast("int")).alias("attempt")), "entities")


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``_n_entities`` beside it.

    Types: e-mail addresses, phone and card numbers (with a valid check digit), social security and bank account
    numbers, IP addresses, names after a title or beside a known given name, access keys, tokens and passwords. A
    phone number is known by its last ten digits, so the ways to write it share a surrogate and keep their own
    punctuation; punctuation in front of an e-mail address is no part of it; names keep gender and script, cards their issuer digit and a valid check digit, addresses their
    top-level domain and, for a common domain, a common surrogate.

    Null texts stay null and empty ones empty. Ids may be null or repeated: rows are matched by id and hash of the
    text. All columns are returned, those named here excepted (``_text_hash``, ``_pos``). Long texts are read whole.
    """
    based = docs.withColumn("_th", F.xxhash64(F.col(text_col)))
    text = F.col(text_col)
    maybe = text.contains("@") | text.contains("=") | text.contains("AKIA") | text.rlike(_NUMBERED) | text.rlike(_NAMED)
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    mentions = stored(
        based.select(F.col(id_col).alias("_mid"), F.col("_th").alias("_mth"), F.posexplode(found).alias("_pos", "mention"))
        .distinct().withColumn("kind", _kind(F.col("mention"))).withColumn("normal", _normal(F.col("kind"), F.col("mention"))),
        "mentions",
    )
    real = mentions.filter("kind is not null")
    table = replacements(real.select("kind", "normal").distinct(), key)
    # Distinct spellings are joined, not mentions, so a hot entity does not meet in one task.
    spelled = real.select("kind", "normal", "mention").distinct().join(table, ["kind", "normal"])
    spelled = spelled.select("mention", "kind", _as_written(F.col("kind"), F.col("mention"), F.col("value")).alias("new"))
    lists = mentions.join(spelled, ["mention", "kind"], "left").groupBy("_mid", "_mth").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("new", "mention").alias("new"), F.col("new").isNotNull().alias("is")))).alias("_new")
    )
    joined = based.join(
        lists.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_mid")) & (F.col("_th") == F.col("_mth")), "left"
    )
    parts = F.split(F.col(text_col), ANY)
    written = F.array_join(F.transform(parts, lambda s, i: F.concat(s, F.coalesce(F.get("_new", i)["new"], F.lit("")))), "")
    return joined.withColumn("_n_entities", F.when(
        F.col("_new").isNull(), F.lit(0)).otherwise(F.size(F.filter("_new", lambda x: x["is"]))).cast("bigint")
    ).withColumn(text_col, F.when(F.col("_new").isNull(), F.col(text_col)).otherwise(written)).select(*docs.columns, "_n_entities")
