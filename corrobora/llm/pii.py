"""Surrogates for personal data; DataFrame functions only.

Patterns find e-mail addresses, secrets, network addresses, account, card, social
security and phone numbers, and names.  Each entity has a normal form, and its
surrogate is a keyed function of kind and normal form, so one entity gets one
replacement in every document and spelling (coreference): a number keeps its
separators, a card its issuer digit and the validity of its check digit, a private
network address stays private, a name keeps honorific, gender, script and case.

Collision check over the whole table: no two entities of a kind share a surrogate,
and no surrogate is an entity that occurs.  Losers take the next attempt until
nothing collides.  A format that is so full that attempts fail is widened: private
addresses go to 10.0.0.0/8, numbers and local parts of e-mail addresses grow, so
the attempts end whatever occurs.  Only attempts above the first are kept as a table, and only
texts that hold such an entity are joined with it; all others are rewritten where
they are read, without a shuffle.

Defined results
* a null text stays null and an empty one empty, with no entity;
* repeated rows are rewritten alike; text outside the entities is kept as it is;
* an empty table gives an empty result; other columns are kept by ``rewritten``.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, free, free_names

#: Attempts in a format after which a surrogate may leave it for a wider one of its kind.
NARROW_ATTEMPTS = 8

# Honorifics and given names by gender and script.
MALE_TITLES = "Mr|Mister|Sir|Herr|Monsieur|Señor|господин|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Madam|Frau|Fräulein|Madame|Mme|Mademoiselle|Señora|Señorita|госпожа|г-жа"
OTHER_TITLES = "Mx|Dr|Prof|Professor|доктор|профессор"
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter George Edward Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques François Antoine Julien Carlos José Miguel Javier Alejandro Иван Дмитрий Сергей Алексей Николай".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Laura Anna Julia Alice Emma Olivia Sophia Ursula Monika Sabine Claudia Heike Marie Camille Sophie Isabelle Chloé Carmen Lucía Isabel Pilar Elena Мария Анна Елена Ольга Наталья".split()

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])(?:(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
IPV6 = r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?<![\w+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])"
WORD = r"\p{Lu}[\p{L}'’-]+"
TITLE = rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?"
GIVEN = rf"(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)})"
#: The first look at a position is one letter's class, so most of a text costs no more than that.
NAME = rf"(?=[\p{{Lu}}гдп])(?<![\p{{L}}\d])(?:{TITLE}[ ]{WORD}(?:[ ]{WORD})?|{GIVEN}[ ]{WORD})(?![\p{{L}}\d])"
KINDS = (("email", EMAIL), ("secret", SECRET), ("ipv6", IPV6), ("ipv4", IPV4), ("iban", IBAN), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("name", NAME))
#: All of these begin where a run of letters and digits begins or at one of an e-mail's or a phone number's signs, so other places are passed over at once.
NUMBER = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9+(._%-])(?:" + "|".join(p for k, p in KINDS if k != "name") + ")"
ANY = f"{NUMBER}|{NAME}"
#: A text without these holds no entity but names: a digit, an e-mail's sign, an address's colon, a key's prefix, letters that are a hexadecimal secret.
HINT = r"[0-9@:]|(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA|[a-f]{32}|[A-F]{32}"

LATIN = "ba be bi bo ca ce co da de di do fa fe fi ga go ha he ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si ta te ti to va ve vi".split()
CYRILLIC = "ба бе бо ва ве ви го да де до за зо ка ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се си та те ти то".split()


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def kind_of(m: Column) -> Column:
    """The kind of a match, by the first pattern that takes all of it.

    Lookarounds hold at the ends of a match that stands alone.
    """
    return reduce(lambda rest, k: F.when(m.rlike(rf"\A(?:{k[1]})\z"), k[0]).otherwise(rest), reversed(KINDS[:-1]), F.lit("name"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def normal(kind: Column, m: Column) -> Column:
    """The form in which all spellings of an entity are equal."""
    return (
        F.when(kind.isin("ssn", "phone", "card"), digits(m))
        .when(kind.isin("email", "ipv4", "ipv6"), F.lower(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .otherwise(m)
    )


def _hash(key: str, *parts: Column) -> Column:
    """128 hex digits, keyed."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _number(h: Column, at: int | Column, n: int = 6) -> Column:
    """A number from n hex digits at a place (from 0)."""
    start = F.lit(at + 1) if isinstance(at, int) else at + 1
    return F.conv(F.substring(h, start, F.lit(n)), 16, 10).cast("long")


def _like(text: Column, h: Column) -> Column:
    """Each ASCII letter and digit replaced by another of its class; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        v = _number(h, (i * 2) % 124, 4)
        return (
            F.when(c.rlike("[a-z]"), F.char(v % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(v % 26 + 65))
            .when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex_like(text: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), F.substring(h, i % 128 + 1, F.lit(1))).otherwise(c)), "")


def _luhn(number: Column) -> Column:
    """Sum of the digits, every second from the right doubled: a multiple of 10 if valid."""

    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int") * (x["i"] % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    pairs = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(c.alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add)


def _digits_like(norm: Column, h: Column, kept: int) -> Column:
    stream = F.concat(*[F.lpad((_number(h, k * 12, 12) % 10**12).cast("string"), 12, "0") for k in range(10)])
    return F.concat(F.substring(norm, 1, kept), F.substring(stream, F.lit(1), F.length(norm) - kept))


def _card(norm: Column, h: Column) -> Column:
    """Valid under the check digit rule if and only if the original is."""
    body = F.substring(_digits_like(norm, h, 1), F.lit(1), F.length(norm) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    odd = (_luhn(norm) % 10 != 0).cast("int") * (1 + _number(h, 120, 6) % 9)
    return F.concat(body, ((check + odd) % 10).cast("string"))


def _ipv4(norm: Column, h: Column, wider: Column) -> Column:
    """Private ranges, loopback and link-local keep the octets that make them so; a full range gives way to the largest private one."""
    kept = F.regexp_extract(norm, r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    kept = F.when((wider > 0) & (kept != ""), "10.").otherwise(kept)
    n = F.length(F.regexp_replace(kept, r"[^.]", ""))
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.when(i == 0, 11 + _number(h, i * 4, 4) % 115).otherwise(_number(h, i * 4, 4) % 256)).cast("string"))
    return F.concat(kept, F.array_join(F.slice(octets, n + 1, 4 - n), "."))


def _iban(norm: Column, h: Column) -> Column:
    """Country kept; the two check digits fulfil the remainder rule."""
    body = _like(F.substring(norm, F.lit(5), F.length(norm) - 4), h)
    chars = F.split(F.concat(body, F.substring(norm, 1, 2), F.lit("00")), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substring(norm, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def email_domain(norm: Column) -> Column:
    return F.regexp_extract(norm, r"@(.*)(\.[a-z]+)$", 1)


def _grown(text: Column, h: Column, wider: Column) -> Column:
    """With so many digits more, from the far end of the hash."""
    return F.concat(text, F.substring(F.translate(F.reverse(h), "abcdef", "012345"), F.lit(1), wider))


def _email(norm: Column, h: Column, domain_h: Column, wider: Column) -> Column:
    """Local part by the whole address; the domain by itself, so that one domain stays one; the last label stays."""
    domain = email_domain(norm)
    return F.concat(_grown(_like(F.regexp_extract(norm, "^(.*)@", 1), h), h, wider), F.lit("@"), _like(domain, domain_h), F.regexp_extract(norm, r"(\.[a-z]+)$", 1))


def _syllables(script: Column, h: Column, n: Column) -> Column:
    """A word of n syllables in a script."""

    def pick(values: list[str], i: Column) -> Column:
        return F.element_at(_lits(values), (_number(h, (i * 6) % 120, 6) % len(values) + 1).cast("int"))

    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(script == "C", pick(CYRILLIC, i)).otherwise(pick(LATIN, i))), "")


def _name_part(kind: Column, h: Column, attempt: Column) -> Column:
    """kind: given or surname, gender (m, f or x) and script (L or C), as in ``given_f_L``; lower case."""
    script = F.substring(kind, -1, 1)
    stem = _syllables(script, h, 3 + F.least(attempt, F.lit(9)))
    end = lambda latin, cyrillic: F.when(script == "C", cyrillic).otherwise(latin)
    return F.concat(stem, F.when(kind.startswith("given_f"), end("na", "на")).when(kind.startswith("given_m"), end("n", "н")).when(kind.startswith("given"), end("l", "л")).otherwise(end("s", "в")))


def hashes(kind: Column, norm: Column, attempt: Column, key: str) -> tuple[Column, Column]:
    """The keyed hash of an entity, and of its domain if it is an address."""
    domain = F.when(kind == "email", _hash(key, F.lit("domain"), email_domain(norm)))
    return _hash(key, kind, norm, attempt.cast("string")), domain


def surrogate(kind: Column, norm: Column, attempt: Column, h: Column, domain_h: Column) -> Column:
    """The replacement's normal form."""
    wider = F.floor(attempt / NARROW_ATTEMPTS).cast("int")
    return (
        F.when(kind == "email", _email(norm, h, domain_h, wider))
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), _hex_like(norm, h)).when(norm.rlike("^[0-9A-F]+$"), F.upper(_hex_like(norm, h))).otherwise(F.concat(F.substring(norm, 1, 4), _like(F.substring(norm, F.lit(5), F.length(norm)), h))))
        .when(kind == "ipv6", _hex_like(norm, h))
        .when(kind == "ipv4", _ipv4(norm, h, wider))
        .when(kind == "iban", _iban(norm, h))
        .when(kind == "ssn", _grown(_digits_like(norm, h, 0), h, wider))
        .when(kind == "phone", _grown(_digits_like(norm, h, 1), h, wider))
        .when(kind == "card", _card(norm, h))
        .otherwise(_name_part(kind, h, attempt))
    )


def parsed(found: Column) -> Column:
    """Matches to (m, kind, norm) and, for names, (title, given, surname, given_kind, surname_kind).

    Each step is a transform of its own, so that a field is worked out once a match.
    """

    def with_parts(x: Column) -> Column:
        m, kind = x["m"], x["kind"]
        named = lambda c: F.when(kind == "name", c)
        parts = zip(name_parts(m), ("title", "given", "surname", "given_kind", "surname_kind"), strict=True)
        return F.struct(m.alias("m"), kind.alias("kind"), normal(kind, m).alias("norm"), *[named(c).alias(n) for c, n in parts])

    return F.transform(F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))), with_parts)


def name_parts(m: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Title (with its blank), given name or '', surname, and the kinds of the two."""
    title = F.regexp_extract(m, rf"\A({TITLE}[ ])", 1)
    rest = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    two = F.size(rest) > 1
    given, surname = F.when(two, rest[0]).otherwise(""), F.when(two, F.get(rest, F.lit(1))).otherwise(rest[0])
    gender = (
        F.when(title.rlike(rf"\A(?:{MALE_TITLES})\.? ") | given.isin(MALE_NAMES), "m")
        .when(title.rlike(rf"\A(?:{FEMALE_TITLES})\.? ") | given.isin(FEMALE_NAMES), "f")
        .otherwise("x")
    )
    script = F.when(surname.rlike(r"\p{IsCyrillic}"), "C").otherwise("L")
    return title, given, surname, F.concat(F.lit("given_"), gender, F.lit("_"), script), F.concat(F.lit("surname_"), script)


def atoms(x: Column) -> Column:
    """What a parsed match is made of: an array of (kind, norm)."""
    pair = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    names = F.filter(F.array(pair(x["given_kind"], F.lower(x["given"])), pair(x["surname_kind"], F.lower(x["surname"]))), lambda a: a["norm"] != "")
    return F.when(x["kind"] == "name", names).otherwise(F.array(pair(x["kind"], x["norm"])))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))


def replacements(found: Column, attempt_of, key: str) -> Column:
    """Parsed matches to texts in their surrogates' form; attempt_of(kind, norm) is a column."""

    def hashed(x: Column) -> Column:
        kind = F.when(x["kind"] == "name", x["surname_kind"]).otherwise(x["kind"])
        norm = F.when(x["kind"] == "name", F.lower(x["surname"])).otherwise(x["norm"])
        h, domain = hashes(kind, norm, attempt_of(kind, norm), key)
        has_given = (x["kind"] == "name") & (x["given"] != "")
        given_try = attempt_of(x["given_kind"], F.lower(x["given"]))
        given = F.when(has_given, hashes(x["given_kind"], F.lower(x["given"]), given_try, key)[0])
        return F.struct(x.alias("x"), kind.alias("kind"), norm.alias("norm"), attempt_of(kind, norm).alias("attempt"), h.alias("h"), domain.alias("domain_h"), given.alias("given_h"), F.when(has_given, given_try).alias("given_try"))

    def drawn(y: Column) -> Column:
        given = F.when(y["given_h"].isNotNull(), _name_part(y["x"]["given_kind"], y["given_h"], y["given_try"]))
        return F.struct(y["x"].alias("x"), surrogate(y["kind"], y["norm"], y["attempt"], y["h"], y["domain_h"]).alias("other"), given.alias("given"))

    def shaped(z: Column) -> Column:
        x, other = z["x"], z["other"]
        m, kind = x["m"], x["kind"]

        def filled(keep: str) -> Column:
            place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), f"[^{keep}]", ""))
            put = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(f"[{keep}]"), F.substring(other, place(i), F.lit(1))).otherwise(c)), "")
            return F.concat(put, F.substring(other, place(F.length(m)) + 1, F.length(other)))  # what a wider format has more

        given = F.when(z["given"].isNotNull(), F.concat(_cased(z["given"], x["given"]), F.lit(" "))).otherwise("")
        return (
            F.when(kind == "name", F.concat(x["title"], given, _cased(other, x["surname"])))
            .when(kind.isin("ssn", "phone", "card"), filled("0-9"))
            .when(kind == "iban", filled("A-Z0-9"))
            .when(kind.isin("email", "ipv6") & (F.upper(m) == m), F.upper(other))
            .otherwise(other)
        )

    return F.transform(F.transform(F.transform(found, hashed), drawn), shaped)


def draw(entities: DataFrame, key: str) -> DataFrame:
    """Rows of (kind, norm, attempt) with their surrogate ``other``."""
    h, domain = hashes(F.col("kind"), F.col("norm"), F.col("attempt"), key)
    held = entities.withColumns({"h": h, "domain_h": domain})
    return held.withColumn("other", surrogate(*map(F.col, ("kind", "norm", "attempt", "h", "domain_h")))).drop("h", "domain_h")


def configured_key(spark: SparkSession) -> str:
    """The secret of the registered queries, from ``spark.corrobora.pii.key``.

    Where it is unset (tests, synthetic tables) a public one is taken, from which
    anyone who guesses an entity can work out its surrogate.
    """
    return spark.conf.get("spark.corrobora.pii.key", None) or "public key for synthetic tables"


def matches(text: str = "text") -> Column:
    """All entities of a text in order; null texts have none."""
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def collisions(docs: DataFrame, key: str, drawer=draw) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate collides, with the attempt that doesn't.

    drawer(rows, key) adds surrogates; tests pass one that collides.
    """
    found = docs.select(F.explode(F.flatten(F.transform(parsed(matches()), atoms))).alias("a")).select("a.*").distinct()
    known = cut(found, "pii-entities")
    state = cut(drawer(known.withColumn("attempt", F.lit(0)), key), "pii-surrogates")
    for _ in count():
        taken = known.select("kind", F.col("norm").alias("other"), F.lit(True).alias("occurs"))
        # the one that has tried most stays; others of the same surrogate go on
        again = F.row_number().over(Window.partitionBy("kind", "other").orderBy(F.desc("attempt"), "norm")) > 1
        judged = state.join(taken, ["kind", "other"], "left").withColumn("again", again | F.col("occurs").isNotNull())
        losers = cut(judged.where("again").select("kind", "norm", F.lit(1).alias("one")), "pii-losers")
        n = losers.count()
        if not n:
            return state.where("attempt > 0").select("kind", "norm", "attempt")
        attempt = F.col("attempt") + F.coalesce("one", F.lit(0))
        moved = state.drop("other").join(checked_broadcast(losers, n), ["kind", "norm"], "left").select("kind", "norm", attempt.alias("attempt"))
        before = state
        state = cut(drawer(moved, key), "pii-surrogates")
        free(before)
        free(losers)


def rewritten(docs: DataFrame, key: str, found: str = "__found", late: DataFrame | None = None) -> DataFrame:
    """The documents with surrogates in ``text``, and their parsed matches in a new column ``found``.

    late: (kind, norm, attempt) of entities whose attempt is not the first, by default from ``collisions``.
    """
    late = collisions(docs, key) if late is None else late
    hash_, tries_ = free_names(docs, f"{found}_hash", f"{found}_tries")
    held = docs.withColumn(found, parsed(matches()))
    n = late.count()
    if n:
        # texts that hold an entity with a later attempt; a text's hash stands for it
        own = held.where(F.size(found) > 0).select(F.xxhash64("text").alias(hash_), F.explode(F.flatten(F.transform(found, atoms))).alias("a")).select(hash_, "a.*").distinct()
        entry = F.struct(F.concat_ws(":", "kind", "norm"), F.col("attempt"))
        tries = cut(own.join(checked_broadcast(late, n), ["kind", "norm"]).groupBy(hash_).agg(F.map_from_entries(F.collect_set(entry)).alias(tries_)), "pii-attempts")
        held = held.withColumn(hash_, F.xxhash64("text")).join(checked_broadcast(tries, tries.count()), hash_, "left")
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(tries_, F.concat_ws(":", kind, norm)), F.lit(0))
    else:
        attempt_of = lambda kind, norm: F.lit(0)
    between = F.when(F.col("text").rlike(HINT), F.split("text", ANY, -1)).otherwise(F.split("text", NAME, -1))
    others = replacements(F.col(found), attempt_of, key)
    joined = F.array_join(F.flatten(F.zip_with(between, others, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return held.withColumn("text", F.when(F.size(found) > 0, joined).otherwise(F.col("text"))).select(*docs.columns, found)


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """The query's rows: doc_id, the whole rewritten text, n_entities and the kinds found."""
    out = rewritten(docs.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda x: x["kind"]))), ",")
    return out.select("doc_id", "text", F.size("__found").alias("n_entities"), kinds.alias("kinds"))


def anonymised(docs: DataFrame, key: str) -> DataFrame:
    """Documents with surrogates in their texts; n_chars, where there is one, follows the text."""
    out = rewritten(docs, key, *free_names(docs, "found"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
