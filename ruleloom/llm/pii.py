"""Surrogates for personal data, with DataFrame functions only.

Patterns find e-mail addresses, phone numbers, IPv4 addresses, payment-card
and social-security numbers, account numbers (IBAN), credentials, and names
after a title. An entity is brought to a canonical form and parted into units,
and each unit gets one surrogate for the whole input:

* cards, phone, social-security and account numbers are their digits and
  letters, whatever stands between them; a mention keeps its own separators;
* an address is a local part and a domain, in lower case; so addresses of one
  domain stay at one domain, and one person's local part stays the same;
* a name is given names and a surname; so ``Mr. John Smith``, ``Mr John Smith``
  and ``Mr. Smith`` share what they share. Where a text names a person with a
  title, that full name and that surname are replaced in the rest of the text
  too, where they stand alone with the same capitals;
* a credential is its value, without the word before it.

A surrogate is drawn from SHA-512 of a secret key, the kind, the unit and an
attempt number, and keeps the form:

* digits become digits and letters become letters of the same case and script
  (Latin, Greek, Cyrillic);
* phone numbers keep the country code; IPv4 addresses stay valid, private ones
  in their private range; card and account numbers pass their check if the
  entity did; cards keep their first digit, account numbers their country;
* domains are of the reserved top level ``example``;
* given names are of the gender of the title (after a title without gender, of
  the gender that other mentions of the given name have), names of the script
  of the name; Russian surnames keep a masculine or feminine ending.

Collision checks: a surrogate that two units share, or that is itself a unit
of the input, is drawn anew with the next attempt; addresses at ``example`` and
given names need not be unlike those of the input. What still collides after
ATTEMPTS draws (a form that has hardly more values than the input has of it)
is told apart by a suffix; so distinct units always stay distinct.

Not found: names that have a title nowhere in their text, numbers in words. A
phone number with its country code and without it are two.

Null and empty texts stay as they are; so does every text without an entity,
byte by byte. Very long texts are read whole. Repeated rows stay and get equal
replacements; ties can't arise. All columns stay; internal names avoid those of
the input. Empty tables give empty tables. Hot texts and entities are left to
the adaptive splitting of skewed joins.
"""

from __future__ import annotations

import secrets
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import checkpoint, fresh, written

#: Draws for a unit, and the setting of a session that has the secret key.
ATTEMPTS, KEY_CONF = 10, "spark.ruleloom.pii.key"


@cache
def _random_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key of the session; where it has none, one drawn for this application,
    so that surrogates of two runs have nothing in common."""
    return spark.conf.get(KEY_CONF, None) or _random_key()


_WORD = r"[\p{L}\p{N}]"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++){{0,12}}(?<=\.\p{{L}}{{2,24}})"
#: What stands before a credential's value: a word and a sign, the name of a scheme, or the sign that an issuer puts first.
LEAD = r"(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?|(?i:bearer)\s{1,3}|(?:AKIA|ASIA)(?=[A-Z0-9]{16}(?![\p{L}\p{N}]))|gh[pousr]_|sk-)"
SECRET = rf"(?<![\p{{L}}\p{{N}}_]){LEAD}[\p{{L}}\p{{N}}_/+-]{{16,}}+[\"']?"
IBAN = rf"(?<!{_WORD})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_WORD})"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}])(?!\.\d)"
SSN = rf"(?<![\p{{L}}\p{{N}}-])\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}-])"
CARD = rf"(?<![\p{{L}}\p{{N}}+-])(?:\d{{13,19}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?!{_WORD})(?!-\d)"
PHONE = rf"(?<![\p{{L}}\p{{N}}+.-])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\) ?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}(?!{_WORD})(?!-\d)|(?<![\p{{L}}\p{{N}}+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}(?!{_WORD})"

#: Titles by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Madam", "Госпожа"], "n": ["Dr", "Prof", "Mx"]}
#: Given names by script and gender.
GIVEN = {
    "latin": {"m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul"],
              "f": ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Ida", "Julia", "Karla", "Lea", "Maria", "Nora", "Olga", "Paula"],
              "n": ["Alex", "Robin", "Kim", "Sasha", "Jamie", "Charlie", "Sam", "Dana", "Toni", "Noor", "Kai", "Mika", "Jules", "Remy", "Ariel", "Morgan"]},
    "cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"], "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
                 "n": ["Саша", "Женя", "Валя", "Шура"]},
    "greek": {"m": ["Αλέξης", "Γιάννης", "Κώστας", "Νίκος"], "f": ["Άννα", "Ελένη", "Μαρία", "Σοφία"], "n": ["Αλέξ", "Φώτη"]},
}
#: Syllables of surnames by script.
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gar", "hol", "jo", "ker", "lan", "mo", "nel", "per", "ras", "sil", "ton", "ver", "win"],
    "cyrillic": ["ба", "вел", "гор", "дим", "жар", "ков", "лен", "мор", "нов", "пет", "рам", "сен", "тов", "фед", "чер", "шин"],
    "greek": ["βα", "γερ", "δημ", "καλ", "λεν", "μαρ", "νικ", "παπ", "ραλ", "σαρ", "ταν", "φιλ", "χρι", "ψαλ", "θεο", "κων"],
}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
NAME = rf"(?<!{_WORD})(?:{_TITLE})\.?[  ]\p{{Lu}}[\p{{L}}'-]{{1,40}}(?:[  ]\p{{Lu}}[\p{{L}}'-]{{1,40}}){{0,2}}"

#: In this order: the first that fits at a place is taken.
KINDS = {"secret": SECRET, "email": EMAIL, "ipv4": IPV4, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
#: Every kind begins where no letter or digit stands before; asked once, not kind by kind.
PATTERN = rf"(?<!{_WORD})(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What every entity has: an @, a digit, a title or a credential's lead. A cheap test that lets texts without either pass.
HINT = rf"@|\d|(?:{_TITLE})\.?[  ]\p{{Lu}}|{LEAD}"
#: Kinds whose separators are a mention's own.
NUMBERS = ("card", "phone", "ssn", "iban")


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern takes the whole entity."""
    whole = [(k, entity.rlike(rf"\A(?:{p})\z")) for k, p in KINDS.items()]
    return reduce(lambda acc, kp: F.when(kp[1], F.lit(kp[0])).otherwise(acc), reversed(whole), F.lit("other"))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _byte(digest: Column, i: int) -> Column:
    """Byte i of a hex digest as a number."""
    return F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")


def _masked(entity: Column, digest: Column, keep: Column) -> Column:
    """Each digit or letter after the first ``keep`` characters replaced by one
    of its class, chosen by the digest; everything else stays."""
    classes = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
               ("[а-яё]", "абвгдежзиклмнопрстуфхчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЧШЭЮЯ"), ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
               ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{Ll}", "àáâäèéêëìíîïòóôöùúûüñç"), (r"\p{Lu}", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÑÇ")]

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digest, F.pmod(i, F.lit(63)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int")
        out = c
        for pattern, letters in reversed(classes):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, doubled from the second last leftward."""
    parts = F.split(F.reverse(digits), "")
    value = F.transform(parts, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x)


def _card(canon: Column, digest: Column) -> Column:
    made = _masked(canon, digest, F.lit(1))
    stem = F.left(made, F.length(made) - 1)
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10))
    return F.when(luhn_sum(canon) % 10 == 0, F.concat(stem, check.cast("string"))).otherwise(made)


def _mod_97(turned: Column) -> Column:
    """Of a string of digits and capitals, capitals counting from A as 10."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(code(c) > 9, (a * 100 + code(c)) % 97).otherwise((a * 10 + code(c)) % 97))


def iban_valid(canon: Column) -> Column:
    return _mod_97(F.concat(F.substr(canon, F.lit(5)), F.left(canon, F.lit(4)))) == 1


def _iban(canon: Column, digest: Column) -> Column:
    body, country = F.substr(_masked(canon, digest, F.lit(4)), F.lit(5)), F.left(canon, F.lit(2))
    check = F.lpad((98 - _mod_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(iban_valid(canon), F.concat(country, check, body)).otherwise(F.concat(_masked(F.left(canon, F.lit(4)), digest, F.lit(2)), body))


def _ipv4(canon: Column, digest: Column) -> Column:
    kept = F.regexp_extract(canon, r"\A(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.)", 1)
    parts = [F.pmod(_byte(digest, 0), F.lit(223)) + 1, _byte(digest, 1), _byte(digest, 2), _byte(digest, 3)]
    dots = F.length(F.regexp_replace(kept, r"[^.]", ""))
    anew = F.concat_ws(".", *parts)
    # a public address doesn't become a private one
    anew = F.when(anew.rlike(r"\A(?:10|127|192|172|169)\."), F.concat_ws(".", F.lit(100), *parts[1:])).otherwise(anew)
    return F.when(dots == 0, anew).when(dots == 1, F.concat(kept, F.concat_ws(".", *parts[1:]))).otherwise(F.concat(kept, F.concat_ws(".", *parts[2:])))


#: Endings of given names that are made up, by script and gender.
ENDINGS = {
    "latin": {"m": ["ar", "on", "us", "ek"], "f": ["ia", "ina", "ela", "anna"], "n": ["in", "el", "ey", "is"]},
    "cyrillic": {"m": ["ан", "ор", "ей", "им"], "f": ["ана", "ия", "ина", "ела"], "n": ["и", "ель", "ли", "ни"]},
    "greek": {"m": ["ος", "ης", "ων", "ας"], "f": ["ία", "ίνα", "ούλα", "ώ"], "n": ["ι", "έλ", "ίς", "ύ"]},
}


def _syllables(script: str, digest: Column, least: int, attempt: Column) -> Column:
    """``least`` syllables, and one more for each attempt."""
    each = F.transform(F.sequence(F.lit(1), attempt + least), lambda i: _pick(SYLLABLES[script], F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return F.array_join(each, "")


def _by_script(canon: Column, of) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _given(gender: str, canon: Column, digest: Column, attempt: Column) -> Column:
    """A name of the list first; one made up where another has it."""
    def of(script: str) -> Column:
        made = F.initcap(F.concat(_syllables(script, digest, 1, attempt), _pick(ENDINGS[script][gender], _byte(digest, 40))))
        return F.when(attempt == 0, _pick(GIVEN[script][gender], _byte(digest, 0))).otherwise(made)

    return _by_script(canon, of)


def _surname(canon: Column, digest: Column, attempt: Column) -> Column:
    ending = F.when(canon.rlike("(?:ов|ев|ёв|ин)а\\z"), "ова").when(canon.rlike("(?:ов|ев|ёв|ин)\\z"), "ов").otherwise("")
    return F.initcap(F.concat(_by_script(canon, lambda script: _syllables(script, digest, 4, attempt)), ending))


def unit_surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """One draw for a unit."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    longer = F.when(attempt > 2, F.substring(F.translate(F.substring(digest, 101, 12), "0123456789", "ghijklmnop"), F.lit(1), attempt)).otherwise("")
    domain = F.concat(F.translate(F.substring(digest, 101, 8), "0123456789", "ghijklmnop"), F.lit(".example"))
    hexes = canon.rlike(r"\A[0-9a-f]{16,128}\z")
    secret = F.when(hexes, F.substring(digest, F.lit(1), F.length(canon))).otherwise(_masked(canon, digest, F.lit(0)))
    country = F.length(F.regexp_extract(canon, r"\A(\+(?:[17]|\d\d))", 1))
    out = _masked(canon, digest, F.lit(0))
    for k, made in {"local": F.concat(out, longer), "domain": domain, "ipv4": _ipv4(canon, digest), "card": _card(canon, digest), "phone": _masked(canon, digest, country), "iban": _iban(canon, digest), "secret": secret,
                    "surname": _surname(canon, digest, attempt), **{f"given_{g}": _given(g, canon, digest, attempt) for g in "mfn"}}.items():
        out = F.when(kind == k, made).otherwise(out)
    return out


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) for the distinct (kind, canon): no two of a kind are
    made equal, nor is one made that the input has, as far as the kind asks."""
    space = F.when(F.startswith("kind", F.lit("given_")), "given").otherwise(F.col("kind"))
    base = written(units.select("kind", "canon").distinct().withColumn("space", space))
    real = base.where(~F.col("space").isin("given", "local", "domain")).select("space", F.col("canon").alias("real"))
    form = lambda c: F.when(F.col("space") == "surname", F.lower(c)).otherwise(c)
    drawn = base.withColumn("attempt", F.lit(0)).withColumn("made", unit_surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
    for attempt in range(1, ATTEMPTS + 2):
        drawn = written(drawn.select("space", "kind", "canon", "attempt", "made", form(F.col("made")).alias("seen")))
        first = drawn.groupBy("space", "seen").agg(F.count("*").alias("n"), F.min(F.struct("kind", "canon")).alias("first")).where("n > 1").select("space", "seen", "first")
        is_real = drawn.join(real.withColumnRenamed("real", "seen"), ["space", "seen"], "left_semi").select("kind", "canon")
        sharer = drawn.join(first, ["space", "seen"]).where(F.struct("kind", "canon") != F.col("first")).select("kind", "canon")
        taken = written(is_real.union(sharer).distinct().withColumn("again", F.lit(True)))
        if taken.isEmpty():
            return drawn.select("kind", "canon", "made")
        marked = drawn.join(taken, ["kind", "canon"], "left")
        if attempt > ATTEMPTS:  # a suffix tells them apart
            place = F.row_number().over(Window.partitionBy("space", "made").orderBy("kind", "canon"))
            return written(marked.withColumn("place", place)).select("kind", "canon", F.when(F.col("again"), F.concat_ws("-", "made", F.col("place") + 1)).otherwise(F.col("made")).alias("made"))
        redrawn = unit_surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key)
        drawn = marked.select("space", "kind", "canon", F.when(F.col("again"), attempt).otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("again"), redrawn).otherwise(F.col("made")).alias("made"))


def _filled(mention: Column, made: Column) -> Column:
    """A mention with its digits and letters replaced by those of ``made``, in order."""
    def step(a: Column, c: Column) -> Column:
        counts = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(a["out"], F.when(counts, F.substring(made, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + F.when(counts, 1).otherwise(0)).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.when(F.startswith(made, F.lit("+")), 2).otherwise(1).alias("k"))
    return F.aggregate(F.split(mention, ""), start, step, lambda a: a["out"])


def _parted(entities: DataFrame) -> DataFrame:
    """Distinct ``entities`` (entity) with kind, lead (what stands before the units
    and stays) and words, the units' own text, in order."""
    e = F.col("entity")
    lead = F.when(F.col("kind") == "name", F.regexp_extract(e, rf"\A((?:{_TITLE})\.?[  ])", 1)).when(F.col("kind") == "secret", F.regexp_extract(e, rf"\A({LEAD})", 1)).otherwise("")
    body = F.substr(e, F.length("lead") + 1)
    words = (F.when(F.col("kind") == "email", F.split(e, "@")).when(F.col("kind") == "name", F.split(body, "[  ]"))
             .when(F.col("kind") == "secret", F.array(F.regexp_replace(body, "[\"']\\z", ""))).otherwise(F.array(e)))
    out = entities.select("entity").distinct().withColumn("kind", kind_of(e)).withColumn("lead", lead).withColumn("words", words)
    title = F.regexp_replace("lead", r"[.  ]", "")
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f")
    return out.withColumn("gender", F.when(F.col("kind") == "name", gender))


def _units(parted: DataFrame) -> DataFrame:
    """(entity, pos, word, kind, canon) for each unit of each entity."""
    each = parted.select("entity", F.col("kind").alias("of"), "gender", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    word, last = F.col("word"), F.col("pos") == F.col("n") - 1
    each = each.withColumn("kind", F.when(F.col("of") == "email", F.when(last, "domain").otherwise("local")).when(F.col("of") == "name", F.when(last, "surname").otherwise("given")).otherwise(F.col("of")))
    numbers = F.regexp_replace(word, "[^0-9A-Z+]", "")
    each = each.withColumn("canon", F.when(F.col("of").isin("email", "name"), F.lower(word)).when(F.col("of").isin(*NUMBERS), numbers).otherwise(word))
    # after a title without gender: the gender that most other entities with this given name have
    told = each.where("kind = 'given' and gender is not null").groupBy("canon").agg(F.when(F.count_if(F.col("gender") == "m") >= F.count_if(F.col("gender") == "f"), "m").otherwise("f").alias("usual"))
    each = each.join(told, "canon", "left")
    given = F.concat(F.lit("given_"), F.coalesce("gender", "usual", F.lit("n")))
    return each.select("entity", "pos", "word", F.when(F.col("kind") == "given", given).otherwise(F.col("kind")).alias("kind"), "canon")


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate, bare, bare_surrogate, last, last_surrogate) for the
    distinct ``entities`` (entity). ``bare`` is a name without its title, ``last``
    a surname; both null for other kinds."""
    parted = checkpoint(_parted(entities))
    units = checkpoint(_units(parted))
    made = units.join(surrogates(units, key), ["kind", "canon"])
    capital = (F.col("word") == F.upper("word")) & (F.length("word") > 1)
    of_name = F.startswith("kind", F.lit("given_")) | (F.col("kind") == "surname")
    made = made.withColumn("made", F.when(of_name & capital, F.upper("made")).when(F.col("kind").isin(*NUMBERS), _filled(F.col("word"), F.col("made"))).otherwise(F.col("made")))
    listed = made.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "made"))).alias("made"))
    joined = parted.join(listed, "entity").withColumn("made", F.transform("made", lambda m: m["made"]))
    name = F.col("kind") == "name"
    sign = F.when(F.col("kind") == "email", "@").when(name, F.regexp_extract("entity", "([  ])[^  ]*\\z", 1)).otherwise("")
    tail = F.when(F.col("kind") == "secret", F.regexp_extract("entity", "([\"'])\\z", 1)).otherwise("")
    several = name & (F.size("words") > 1)
    return joined.select("entity", F.concat("lead", F.array_join("made", "\x1f"), tail).alias("s"), sign.alias("sign"), F.when(several, F.array_join("words", " ")).alias("bare"), F.when(several, F.array_join("made", " ")).alias("bare_surrogate"),
                         F.when(name, F.element_at("words", -1)).alias("last"), F.when(name, F.element_at("made", -1)).alias("last_surrogate")).withColumn("surrogate", F.replace("s", F.lit("\x1f"), F.col("sign"))).drop("s", "sign")


def replace_pii(df: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``df`` with the entities of ``text`` replaced, keyed by ``key`` or
    ``session_key``; with ``count``, a column of that name has their number.

    Rows with an entity are written once to the shared folder, and of these only
    distinct texts are shuffled, keyed by their hash; all others pass where they lie."""
    digest, found, swaps = fresh(df, "pii_digest", "pii_found", "pii_swaps")
    t = F.col(text)
    tested = df.withColumn(found, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    has = F.coalesce(F.size(found) > 0, F.lit(False))
    hits = checkpoint(tested.where(has).withColumn(digest, F.sha2(t, 256)))
    entities = checkpoint(hits.select(digest, found).dropDuplicates([digest]).select(digest, F.posexplode(found).alias("pos", "entity")))
    table = replacements(entities, key or session_key(df.sparkSession))
    one = F.struct("pos", "surrogate", "bare", "bare_surrogate", "last", "last_surrogate")
    swapped = checkpoint(entities.join(table, "entity").groupBy(digest).agg(F.array_sort(F.collect_list(one)).alias(swaps)))

    def mentions(name: str) -> Column:
        return F.transform(F.filter(swaps, lambda s: s[name].isNotNull()), lambda s: F.struct(s[name].alias("a"), s[f"{name}_surrogate"].alias("b")))

    names = F.array_distinct(F.concat(mentions("bare"), mentions("last")))
    bound = r"(?<![\p{L}\p{N}'-])", r"(?![\p{L}\p{N}'-])"
    gaps = F.transform(F.split(t, PATTERN, -1), lambda gap: F.aggregate(names, gap, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(bound[0]), n["a"], F.lit(bound[1])), n["b"])))
    made = F.array_join(F.zip_with(gaps, swaps, lambda gap, swap: F.concat(gap, F.coalesce(swap["surrogate"], F.lit("")))), "")
    columns = [made.alias(c) if c == text else F.col(c) for c in df.columns]
    same = [F.col(c) for c in df.columns]
    if count:
        columns.append(F.size(swaps).cast("long").alias(count))
        same.append(F.lit(0).cast("long").alias(count))
    return hits.join(swapped, digest).select(*columns).unionByName(tested.where(~has).select(*same))


def op1_pii_surrogates(spark, sf_dir):
    """Every document with its text after replacement and the number of entities replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, count="n_entities")
