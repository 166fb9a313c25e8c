"""Text functions as Column builders: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space in the wide sense: control blanks, all separators of Unicode, and the byte order mark.
BLANK = r"[\s\x0B\p{Z}\x{FEFF}]"
#: Text of visible ASCII characters alone, which has none.
VISIBLE = r"\A[!-~]*\z"
#: The blanks, one by one.
BLANKS = " \t\n\x0B\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def collapse(x: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.when(x.rlike(VISIBLE), x).otherwise(F.trim(F.regexp_replace(x, f"{BLANK}+", " ")))


def trimmed(x: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(x, F.lit(BLANKS))


def blank_to_null(x: Column) -> Column:
    """Absent, null and blank are one thing: null."""
    return bound(trimmed(x), lambda t: F.when(t != "", t))


def first_present(*names: Column) -> Column:
    """The first of several synonyms that is present."""
    return F.coalesce(*(blank_to_null(n) for n in names))


def digits(x: Column) -> Column:
    """Digits alone; null where there are none, so that nothing equals it."""
    t = F.regexp_replace(x, "[^0-9]+", "")
    return F.when(t != "", t)


def alnum(x: Column) -> Column:
    """Lower-case letters and digits alone; null where there are none."""
    t = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    return F.when(t != "", t)


def sentences(x: Column) -> Column:
    """Parts after . ? ! and white space, or at two blanks and more."""
    marked = F.regexp_replace(F.regexp_replace(x, r"([.?!])[ \t\r\n]+", "$1\u0001"), r"[ \t]{2,}", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), collapse), lambda s: s != "")


def one_edit(a: Column, b: Column) -> Column:
    """At most one letter put in, left out or changed, or two neighbours swapped.

    The swap is told from the common beginning and end: they leave two letters."""
    n = F.length(a)
    same = F.length(b) == n
    spots = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.try_element_at(spots, F.lit(1)), F.try_element_at(spots, F.lit(2))
    at = lambda x, k: F.substring(x, k, F.lit(1))
    swap = same & (F.size(spots) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    return (F.levenshtein(a, b) <= 1) | F.coalesce(swap, F.lit(False))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def person(x: Column) -> Column:
    """(first, last) of a name, written ``First Last`` or ``Last, First``;
    punctuation and middle initials are dropped; a single word is a first name
    with an empty last one. Null where there is no letter."""
    return bound(name_letters(x), person_of)


def name_letters(x: Column) -> Column:
    """The words of a name, given name first, in lower-case letters alone."""
    turned = F.regexp_replace(F.regexp_replace(F.lower(x), BLANK, " "), "(?s)^([^,]*),(.*)$", "$2 $1")
    # most names are letters and blanks already
    return F.trim(F.when(x.rlike(r"\A[A-Za-z ]*\z"), F.lower(x)).otherwise(F.regexp_replace(turned, "[^a-z ]+", "")))


def person_of(letters: Column) -> Column:
    """``person`` of what ``name_letters`` gave."""
    last = F.when(letters.contains(" "), F.substring_index(letters, " ", -1)).otherwise("")
    return F.when(letters != "", F.struct(F.substring_index(letters, " ", 1).alias("first"), last.alias("last")))


def near_person(p: Column, q: Column, tolerance: int = 1) -> Column:
    """As ``same_person``, of what ``person`` gave."""
    return F.coalesce(F.levenshtein(p["first"], q["first"]) + F.levenshtein(p["last"], q["last"]) <= tolerance, F.lit(False))


def same_person(a: Column, b: Column, tolerance: int = 1) -> Column:
    """First and last names differ by ``tolerance`` letters together at most; no name matches none."""
    return near_person(person(a), person(b), tolerance)


def same_date(a: Column, b: Column) -> Column:
    """Equal as dates; as text where one is no date."""
    return F.coalesce(parse_date(a) == parse_date(b), F.lower(collapse(a)) == F.lower(collapse(b)), F.lit(False))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_date(x: Column) -> Column:
    """ISO, month/day/year and ``Mon d, yyyy`` dates; anything else is null."""
    return bound(blank_to_null(x), date_of)


def date_of(t: Column) -> Column:
    """``parse_date`` of a text without white space at its ends."""
    def of(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, month, day).try_cast("date")

    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(t, 1, 3)))
    us = of(F.substring_index(t, "/", -1), F.substring_index(t, "/", 1), F.substring_index(F.substring_index(t, "/", 2), "/", -1))
    named = of(F.right(t, F.lit(4)), month.cast("string"), F.regexp_extract(t, "[0-9]{1,2}", 0))
    return (F.when(t.contains("/"), F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), us)).when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t.try_cast("date"))
            .when(t.rlike(r"^[A-Za-z]{3,9}\.?[ ]+[0-9]{1,2},?[ ]+[0-9]{4}$"), named))


TIMESTAMP = r"\A(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:?\d\d)?\z"


def parse_timestamp(x: Column) -> Column:
    """An ISO 8601 timestamp with an optional fraction, of which microseconds
    count, and an optional offset (none means UTC); anything else is null."""
    t = trimmed(x)
    part = lambda k: F.regexp_extract(t, TIMESTAMP, k)
    zone = F.regexp_replace(F.when(part(4).isin("", "Z"), "+00:00").otherwise(part(4)), r"^(...)(\d\d)$", "$1:$2")
    text = F.concat(part(1), F.lit("T"), part(2), F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0"), zone)
    return F.when(t.rlike(TIMESTAMP), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))


def span_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000.0


def span_agrees(latency_ms: Column, start: Column, end: Column, tolerance_ms: float = 50.0) -> Column:
    """Whether a latency is what its timestamps say, within a tolerance; not where one of the three is missing."""
    return F.coalesce(F.abs(latency_ms - span_ms(start, end)) <= tolerance_ms, F.lit(False))


CREDENTIALS = (r"Bearer [A-Za-z0-9._~+/=-]+", r"sk-[A-Za-z0-9_-]{8,}", r"[0-9a-f]{32,}", r"(?i)(api[_-]?key|token|secret)[ ]*[=:][ ]*[^ ]+")
#: A header's value, with its scheme: what follows "Basic " is the credential.
AUTHORIZATION = r"""(?i)("?authorization"?\s*[:=]\s*)("[^"]*"|(?:(?:basic|bearer|digest|negotiate|token)\s+)?[^\s,}]+)"""


def redact(x: Column, keep: int = 200) -> Column:
    """Credentials masked, then cut to ``keep`` characters."""
    return F.substring(redact_whole(x), 1, keep)


def redact_whole(x: Column) -> Column:
    """Credentials and authorization headers masked in the whole text."""
    for pattern in CREDENTIALS:
        x = F.regexp_replace(x, pattern, "[redacted]")
    return F.regexp_replace(x, AUTHORIZATION, "$1[redacted]")


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """``{slot}`` replaced by its value."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def strip_comments(html: Column) -> Column:
    """Without comments, over lines as well."""
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def reason_prefix(x: Column) -> Column:
    """What stands before the first colon, bracket or blank."""
    return F.regexp_extract(x, r"^[^:( ]*", 0)
