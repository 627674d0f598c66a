"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns, cards and account numbers by their check digits too, and reduced to a canonical core (so that one e-mail
address, number or surname is one entity however it is written); each core gets a keyed replacement of its type. The replacement is poured
into the format of every place where the entity stands: separators, country code, case, title, public prefix and script stay; cards and
account numbers keep valid check digits. Cores are checked against each other and against all originals: where two entities
would share a replacement, or a replacement is itself an entity of the corpus, another is drawn until all are distinct.
Equal cores get equal replacements in all documents.

Given names and surnames are replaced apart, so that people of one surname keep one and their given names stay distinct. A given name gets one
of the gender that its titles show anywhere. A run of capitalised words without a title ends in a name if its last two words
have a title anywhere; a lone surname without a title isn't recognised.

* Null text stays null, with no entities; texts without entities aren't shuffled.
* Rows that share id and text get the same result; no row is lost. A text of any length is read whole.
* The dictionary of entities is a distributed table; an entity of any frequency costs a partial aggregation and a join.
* The key is the secret: without it replacements can't be computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut

TITLES_M = "Mr|Sr|Mister|Herr|Monsieur|Señor|Signor"
TITLES_F = "Mrs|Ms|Mme|Mlle|Sra|Srta|Miss|Frau|Madame|Señora|Señorita|Signora"
TITLES_N = "Dr|Prof"
SHORT = r"(?:Mr|Sr|Mrs|Ms|Mme|Mlle|Sra|Srta|Dr|Prof)\.?"  #: these may end in a full stop
LONG = "(?:Mister|Herr|Monsieur|Señor|Signor|Miss|Frau|Madame|Señora|Señorita|Signora)"
TITLES_CYRILLIC = "г-н|г-жа|Г-н|Г-жа|господин|госпожа|Господин|Госпожа"
WORD = r"\p{Lu}[\p{L}'’-]+"
#: In order of precedence; none has groups, so that they can be joined.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "token": r"(?<![\w-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,16})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?=(?:[ .()-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6})(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{SHORT}|{LONG}|{TITLES_CYRILLIC}) {WORD}(?: {WORD})?",
    "pair": rf"(?<![\p{{L}}\p{{N}}]){WORD}(?: {WORD})+(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of this hold no entity; far cheaper to look for, as titles are taken by their first letter.
HINT = (
    r"[0-9@]|::|eyJ|sk-|xox|gh[pousr]_|[0-9a-fA-F]{32}|M(?:rs?|s|me|lle|ister|iss|onsieur|adame)\.? \p{Lu}|S(?:ra?|rta)\.? \p{Lu}|Se(?:ñor|ñora|ñorita) \p{Lu}|Signora? \p{Lu}"
    r"|(?:Dr|Prof)\.? \p{Lu}|(?:Herr|Frau) \p{Lu}|[Гг](?:-н|-жа|осподин|оспожа) \p{Lu}|\p{Lu}[\p{L}'’-]+ \p{Lu}"
)
#: Given names by the gender that a title shows.
GIVEN = {
    "m": ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Simon"],
    "f": ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Sofia"],
    "n": ["Alex", "Andrea", "Charlie", "Dana", "Eden", "Jamie", "Kim", "Lee", "Marion", "Morgan", "Nicola", "Robin", "Sam", "Sasha", "Toni", "Val"],
    "mc": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Макар", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    "fc": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Юлия"],
}
CONSONANTS, VOWELS = "bdfghklmnprstvwz", "aeio"
CONSONANTS_CYRILLIC, VOWELS_CYRILLIC = "бвгджзклмнпрстфш", "аеио"
MOST_ROUNDS = 64
LONGER = 16  #: from this draw on numbers and secrets get longer, so that a type is never used up


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The digit sum in which every second digit from the right is doubled, the last one first if ``doubled`` is 0."""
    terms = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The remainder of the number that digits and upper-case letters (10 to 35) make."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: step(a, c).cast("int"))


def kind_of(entity: Column) -> Column:
    """none for numbers whose check digits are wrong."""
    digits, account = _digits(entity), F.regexp_replace(entity, " ", "")
    valid = {
        "card": digits.rlike("^[2-6]") & (luhn_sum(digits, 1) % 10 == 0),
        "iban": mod97(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))) == 1,
    }
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in PATTERNS.items():
        found = F.when(valid[kind], F.lit(kind)).otherwise(F.lit("none")) if kind in valid else F.lit(kind)
        out = out.when(entity.rlike(f"^(?:{pattern})$"), found)
    return out.otherwise(F.lit("name"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def canonical(kind: Column, entity: Column) -> Column:
    """What is one entity: lower case for addresses and secrets, digits for numbers, the surname for names."""
    digits = _digits(entity)
    surname = F.lower(F.regexp_extract(entity, rf"({WORD})$", 1))
    return (
        F.when(kind.isin("email", "secret", "ipv6"), F.lower(entity))
        .when(kind.isin("ip", "token"), entity)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("name", "pair"), surname)
        .otherwise(digits)
    )


def _nibble(hexes: Column, at: Column | int) -> Column:
    return F.conv(F.substring(hexes, at, 1) if isinstance(at, int) else F.substr(hexes, at, F.lit(1)), 16, 10).cast("int")


def core(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a canonical entity in its ``attempt``-th draw, of the same type and length class."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    stream = F.concat(h, F.sha2(h, 256), F.sha2(F.concat(h, F.lit("+")), 256))
    digits = F.translate(stream, "abcdef", "123456")
    n = F.length(canon) + F.greatest(attempt - LONGER, F.lit(0))
    nonzero = F.translate(F.substring(digits, 1, 1), "0", "7")
    plain = F.concat(nonzero, F.substr(digits, F.lit(2), n - 1))

    body = F.concat(F.translate(F.substring(digits, 1, 1), "01789", "42345"), F.substr(digits, F.lit(2), F.length(canon) - 2))
    card = F.concat(body, F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10)).cast("string"))

    def octet(at: int) -> Column:
        return F.conv(F.substring(h, at, 2), 16, 10).cast("int")

    ip = F.concat_ws(".", (octet(1) % 223 + 1).cast("string"), *[octet(a).cast("string") for a in (3, 5, 7)])

    letters = F.translate(stream, "0123456789abcdef", "bcdfghjkmnpqrstv")
    def as_is(text: Column) -> Column:
        """Random characters of the class of each of ``text``'s."""

        def one(c: Column, i: Column) -> Column:
            at = i % 128 + 1
            lower = F.substr(letters, at, F.lit(1))
            return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(lower)).when(c.rlike(r"\p{L}"), lower).otherwise(c)

        return F.array_join(F.transform(_chars(text), one), "")

    poured = as_is(F.lower(F.substring_index(canon, "@", 1)))
    prefix = F.regexp_extract(canon, "^(?:eyJ|AKIA|sk-|gh[pousr]_|xox[abprs]-|AIza)", 0)
    token = F.concat(prefix, as_is(F.substr(canon, F.length(prefix) + 1)))
    bban, land = as_is(F.substr(canon, F.lit(5))), F.substring(canon, 1, 2)
    check = F.lpad((F.lit(98) - mod97(F.concat(bban, land, F.lit("00")))).cast("string"), 2, "0")
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(h, a, 4) for a in range(1, 25, 4)])
    # a domain has one replacement for all its addresses; later draws lengthen the local part
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    longer = F.when(attempt > 0, F.concat(F.lit("."), F.substring(letters, 120, 8))).otherwise(F.lit(""))
    email = F.concat(poured, longer, F.lit("@m"), F.substring(domain, 1, 10), F.lit(".example"))

    def syllables(consonants: str, vowels: str) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.least(attempt, F.lit(8)) + 2),
            lambda i: F.concat(
                F.substr(F.lit(consonants), _nibble(stream, i * 2 + 1) + 1, F.lit(1)), F.substr(F.lit(vowels), _nibble(stream, i * 2 + 2) % len(vowels) + 1, F.lit(1))
            ),
        )
        return F.array_join(parts, "")

    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    name = F.when(cyrillic, syllables(CONSONANTS_CYRILLIC, VOWELS_CYRILLIC)).otherwise(syllables(CONSONANTS, VOWELS))
    # a given name is one of the list of its gender, or made up once these are taken
    gender, pick = F.substring_index(canon, "|", 1), F.pmod(F.xxhash64(h), F.lit(16)).cast("int") + 1
    listed = F.lit(None).cast("string")
    for g, names in GIVEN.items():
        listed = F.when(gender == g, F.lower(F.element_at(F.array(*[F.lit(x) for x in names]), pick))).otherwise(listed)
    ending = F.when(gender == "f", "na").when(gender == "m", "no").when(gender == "fc", "на").when(gender == "mc", "н").otherwise("ne")
    given = F.when(attempt < 4, listed).otherwise(F.concat(name, ending))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", card)
        .when(kind == "token", token)
        .when(kind == "iban", F.concat(land, check, bban))
        .when(kind == "secret", F.substr(stream, F.lit(1), n))
        .when(kind == "name", name)
        .when(kind == "given", given)
        .otherwise(plain)
    )


def _filled(entity: Column, new: Column, kind: str, at: Column) -> Column:
    """``entity`` with its characters of class ``kind`` from number ``-at`` on replaced by those of ``new``; what is left of it follows."""
    start = F.struct(F.lit("").alias("s"), at.alias("k"))
    step = lambda acc, c: F.when(
        c.rlike(kind), F.struct(F.concat(acc["s"], F.when(acc["k"] >= 0, F.substr(new, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(_chars(entity), start, step, lambda acc: F.concat(acc["s"], F.substr(new, F.greatest(acc["k"], F.lit(0)) + 1)))


def pour(kind: Column, entity: Column, new: Column, given: Column) -> Column:
    """``new``, and for names ``given``, in the format of ``entity``."""
    spare = F.length(_digits(entity)) - F.length(new)
    numbers = _filled(entity, new, "[0-9]", F.least(-spare, F.lit(0)))
    words = F.split(entity, " ")
    like = lambda old, x: F.when(old == F.upper(old), F.upper(x)).otherwise(F.initcap(x))
    before = F.slice(words, 1, F.greatest(F.size(words) - F.when(given.isNotNull(), 2).otherwise(1), F.lit(0)))
    name = F.concat_ws(" ", before, F.when(given.isNotNull(), like(F.element_at(words, -2), given)), like(F.element_at(words, -1), new))
    return (
        F.when(kind == "none", entity)
        .when(kind == "name", name)
        .when(kind == "iban", _filled(entity, new, "[0-9A-Z]", F.lit(0)))
        .when(kind.isin("email", "ip", "ipv6", "token"), new)
        .when(kind == "secret", F.when(entity == F.upper(entity), F.upper(new)).otherwise(new))
        .otherwise(numbers)
    )


def gender_of(title: Column) -> Column:
    """The key of ``GIVEN`` that a title shows."""
    bare = F.regexp_replace(title, r"\.$", "")
    return (
        F.when(F.lower(bare).isin("г-жа", "госпожа"), "fc").when(bare.rlike(r"\p{IsCyrillic}"), "mc").when(bare.isin(*TITLES_M.split("|")), "m").when(bare.isin(*TITLES_F.split("|")), "f").otherwise("n")
    )


def _named(places: DataFrame) -> DataFrame:
    """``places`` with ``given``, the entity of the given name: gender and name; pairs of words count as names if they are known, else as none."""
    words = F.split("entity", " ")
    full = (F.col("kind") == "pair") | (F.col("kind") == "name") & (F.size(words) > 2)
    places = places.withColumn("first", F.when(full, F.lower(F.element_at(words, -2))))
    titled = places.filter("kind = 'name' AND first IS NOT NULL")
    genders = titled.groupBy("first").agg(F.max_by(gender_of(F.element_at(words, 1)), gender_of(F.element_at(words, 1)) != "n").alias("gender"))
    known = titled.select("first", "canon").distinct().join(genders, "first").withColumn("known", F.lit(True))
    kind = F.when(F.col("kind") != "pair", F.col("kind")).when(F.col("known"), F.lit("name")).otherwise(F.lit("none"))
    given = F.when(F.col("known"), F.concat_ws("|", "gender", "first"))
    return places.join(known, ["first", "canon"], "left").select("_id", "_doc", "at", "entity", kind.alias("kind"), "canon", given.alias("given"))


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, core): a distinct replacement for each distinct entity of ``found``, none of them an entity itself."""
    state = cut(
        found.groupBy("kind", "canon").agg(F.count("*").alias("n")).select("kind", "canon", F.lit(0).alias("attempt"), core(key, F.col("kind"), F.col("canon"), F.lit(0)).alias("core"))
    )
    for _ in range(MOST_ROUNDS):
        owners = state.groupBy("kind", "core").agg(F.min("canon").alias("owner"), F.max("canon").alias("other")).filter("owner < other").select("kind", "core", "owner")
        originals = state.select("kind", F.substring_index("canon", "|", -1).alias("core"), F.lit(True).alias("taken")).distinct()
        judged = state.join(owners, ["kind", "core"], "left").join(originals, ["kind", "core"], "left")
        clash = F.coalesce(F.col("canon") != F.col("owner"), F.lit(False)) | F.coalesce("taken", F.lit(False))
        judged = cut(judged.select("kind", "canon", "attempt", "core", clash.alias("clash")))
        if judged.filter("clash").isEmpty():
            return judged.select("kind", "canon", "core")
        again = F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        moved = judged.withColumn("attempt", again)
        state = cut(moved.withColumn("core", F.when(F.col("clash"), core(key, F.col("kind"), F.col("canon"), F.col("attempt"))).otherwise(F.col("core"))).drop("clash"))
    raise ValueError("a type of entity has too few replacements")


def surrogates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str, bits: int = 18) -> DataFrame:
    """One row per input row: ``id_col``, text with all entities replaced, n_entities, kinds (array, in order)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_doc", F.xxhash64("_text"))
    places = rows.filter(F.col("_text").rlike(HINT)).select("_id", "_doc", F.posexplode(F.regexp_extract_all("_text", F.lit(ANY), 0)).alias("at", "entity"))
    places = places.withColumn("kind", kind_of(F.col("entity")))
    places = cut(places.withColumn("canon", canonical(F.col("kind"), F.col("entity"))))
    places = cut(_named(places))
    found = places.filter("kind <> 'none'").select("kind", "canon").unionByName(places.filter("given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("given").alias("canon")))
    cores = dictionary(found, key)
    givens = cores.filter("kind = 'given'").select(F.col("canon").alias("given"), F.col("core").alias("new_given"))
    new = places.join(cores.filter("kind <> 'given'"), ["kind", "canon"], "left").join(givens, "given", "left")
    new = new.select("_id", "_doc", "at", "kind", pour(F.col("kind"), F.col("entity"), F.col("core"), F.col("new_given")).alias("new"))
    per_text = cut(new.groupBy("_id", "_doc").agg(F.sort_array(F.collect_set(F.struct("at", "kind", "new"))).alias("news")).filter(F.exists("news", lambda x: x["kind"] != "none")))

    # only texts in a bucket with some text that has entities are shuffled; the set of buckets has a fixed bound
    buckets = per_text.select(bucket(bits, F.col("_doc")).alias("_bucket")).distinct().withColumn("_near", F.lit(True))
    marked = rows.withColumn("_bucket", bucket(bits, F.col("_doc"))).join(F.broadcast(buckets), "_bucket", "left")
    left, right = marked.filter("_near").alias("l"), per_text.alias("r")
    joined = left.join(right, F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._doc") == F.col("r._doc")), "left").select("l._id", "l._text", "r.news")
    between = F.split("_text", ANY, -1)
    replaced = F.array_join(F.flatten(F.zip_with(between, F.col("news.new"), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.col("news").isNull(), F.col("_text")).otherwise(replaced)
    kinds = F.filter(F.coalesce(F.col("news.kind"), F.array().cast("array<string>")), lambda k: k != "none")
    out = joined.select(F.col("_id").alias(id_col), text.alias("text"), F.size(kinds).cast("long").alias("n_entities"), kinds.alias("kinds"))
    none = [F.col("_id").alias(id_col), F.col("_text").alias("text"), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds")]
    return out.unionByName(marked.filter("_near IS NULL").select(*none))
