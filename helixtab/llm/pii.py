"""Surrogates for personal data, in DataFrame operations only.

Found: e-mail addresses, telephone, card, social security and IBAN numbers, IPv4 and IPv6 addresses, access tokens, and
names after one or more titles; in texts with such names, also their parts without one. Each distinct value gets one surrogate, made from
an HMAC under a secret key, over the whole table (coreference); two values never get the same one, and none gets a value of its kind that
the table really holds (collision checks; who loses draws again, from more values each time where a kind has few).
Surrogates keep what kind of value it is: length, separators and case; the leading digit of a card and whether its check
digit is right; the country of an IBAN, with right check digits; a name's script and its bearer's gender; the country
prefix of a telephone number or its leading zero; other spellings of it get the same digits. Given and family names are
values apart, so a family name alone is still the same person's, and so are the parts of a name with hyphens or
apostrophes, which stay where they are; initials, particles (van, de la) and a letter before an apostrophe stay as they
are. An address's domain and the whole address are values apart, too. Letters outside ASCII become ASCII ones there. A given name's gender is
that of most of its titles that tell one, so Frau Maria and Dr. Maria are the same.

An empty key is an error. Nulls: a null text stays null, a null id is an id. Repeated rows come out alike. Texts without a finding pass
unchanged; empty tables give empty results; extra columns are carried along, but for one named n_entities, which is
replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import written

# Titles by gender, and syllables of made-up names by script.
MALE = "Mr Herr Herrn Monsieur Señor Sr Sir Господин Г-н".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Госпожа Г-жа".split()
NEUTRAL = "Dr Prof Mx".split()
PARTICLES = "al bin da de del den der des di do dos du el ibn la le ten ter van vom von zu zum zur".split()
SYLLABLES = {"lat": "ba be bo da de do fa fe ka ko la le li lo ma mi mo na ne ni no pa ra re ri ro sa si so ta te to".split(), "cyr": "ба бе бо да де до ва ве ка ко ла ле ли ло ма ми мо на не ни но па ра ре ри ро са си со та те то".split()}
ENDINGS = {"given_m": {"lat": "rik bert lan tor".split(), "cyr": "слав мир тор дан".split()}, "given_f": {"lat": "lina nora tessa mira".split(), "cyr": "лина нора миля дана".split()}, "given_n": {"lat": "lin ren nel ris".split(), "cyr": "лин рен нель рис".split()}, "surname": {"lat": "gard holt vik mond".split(), "cyr": "нко вич дзе рян".split()}}

_TITLE = rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})"
_NAME = rf"(?!{_TITLE}(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}\p{{M}}'’-]++"
_SMALL = rf"(?:\p{{Lu}}\.|{'|'.join(PARTICLES)})"
#: A name's titles, and the words in it that are values.
TITLES = rf"^(?:{_TITLE}\.? )+"
WORD = rf"(?<![\p{{L}}\p{{M}}])(?!\p{{L}}['’.])(?!{_SMALL} )[\p{{L}}\p{{M}}]++"
TOKENS = r"AKIA|ASIA|AIza|eyJ|github_pat_|gh[pousr]_|glpat-|xox[abeoprs]-|[rs]k_(?:live|test)_|sk-(?:proj-|svcacct-|admin-)?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++(?:['’][\p{L}\p{M}\p{N}._%+-]++)*+@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)*(?<=\.\p{L}{2,63}|\.xn--[0-9A-Za-z-]{2,59})(?![\p{L}\p{N}-])",
    "secret": r"(?<![0-9A-Za-z_])(?:A[KS]IA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+|github_pat_[0-9A-Za-z_]{22,}+|gh[pousr]_[0-9A-Za-z]{36}|glpat-[0-9A-Za-z_-]{20,}+|xox[abeoprs]-[0-9A-Za-z-]{10,}+|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+|sk-(?:proj-|svcacct-|admin-)?[0-9A-Za-z]{20,}+|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}+)(?![0-9A-Za-z_])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w-])(?<!\d )\d{3} \d{2} \d{4}(?![\w-]| \d)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![\w+.-])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w+.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w|\.\d)|(?<![\w+.,:/-])(?=0(?:[ /-]?\d){8,12}(?!\d))0\d{2,4}[ /-]\d{3,9}(?:[ -]\d{2,4}){0,3}(?!\w|[.,:/-]\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE}\.? )++(?:{_SMALL} )*+{_NAME}(?:(?: {_SMALL})*+ {_NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What a text with a finding must have; cheap to look for, and most texts have none of it.
DIGIT_RUN = r"[0-9][0-9 ()./-]{5,}[0-9]|[A-Z]{2}[0-9]{2}|[0-9a-f]{32}|[0-9A-Fa-f]::?[0-9A-Fa-f]{1,4}:|[0-9A-Fa-f]::[0-9A-Fa-f]"
HINTS = ("@", "AKIA", "ASIA", "AIza", "eyJ", "_", "sk-", "glpat-", "xox")
TITLED = rf"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?<!\p{{L}}){_TITLE}\.? (?:\p{{Lu}}|{_SMALL} )"
#: Draws after which those from more values begin, and after which it is an error.
NARROW, ROUNDS = 4, 60


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def found_in(text: Column) -> Column:
    """If there is anything to find; hints first, as most texts have none."""
    digits = text.rlike("[0-9]") & text.rlike(DIGIT_RUN)
    hinted = reduce(or_, [text.contains(h) for h in HINTS], digits) | text.rlike(TITLED)
    return F.coalesce(hinted & text.rlike(ANY), F.lit(False))


def kind_of(m: Column) -> Column:
    found = F.when(m.contains("@"), "email")
    for kind in ("secret", "iban", "ssn", "card", "ip", "ip6", "name"):
        found = found.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return found.when(m.rlike(r"^\p{Lu}"), "bare").otherwise("phone")


def script_of(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "_cyr").otherwise("_lat")


def parts_of(matches: Column) -> Column:
    """Of each match: m, kind, a name's titles, given names (with what is between them and the last) and last name. Each step
    reads the one before as a field, so that no expression is repeated in the next one."""
    matches = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"), F.regexp_extract(m, TITLES, 0).alias("titles")))
    matches = F.transform(matches, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["titles"].alias("titles"), F.substr(x["m"], F.length(x["titles"]) + 1, F.length(x["m"])).alias("names")))
    matches = F.transform(matches, lambda x: F.struct(*[x[c].alias(c) for c in ("m", "kind", "titles", "names")], F.regexp_extract(x["names"], "^.* ", 0).alias("given")))
    return F.transform(matches, lambda x: F.struct(*[x[c].alias(c) for c in ("m", "kind", "titles", "given")], F.substr(x["names"], F.length(x["given"]) + 1, F.length(x["names"])).alias("last")))


def values_of(x: Column) -> Column:
    """The values a match (of parts_of) stands for, as array<struct<kind, norm, gender>>: one, an address and its domain, or a
    name's parts."""
    m, kind, titles, given, last = (x[c] for c in ("m", "kind", "titles", "given", "last"))
    told = lambda some: titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(some)})(?!\p{{L}})")
    gender = F.when(told(MALE), "m").when(told(FEMALE), "f").otherwise("n")
    value = lambda kind, norm, gender="n": F.struct(kind.alias("kind"), norm.alias("norm"), (F.lit(gender) if isinstance(gender, str) else gender).alias("gender"))
    part = lambda text, what, gender: F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: value(F.concat(F.lit(what), script_of(x)), F.lower(x), gender))
    named = F.concat(part(given, "given", gender), part(last, "surname", "n"))
    digits = F.regexp_replace(_digits(m), "^0", "")
    norm = F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind.isin("ssn", "card"), _digits(m)).when(kind == "phone", F.right(digits, F.lit(10))).when(kind == "iban", F.replace(m, F.lit(" "))).otherwise(m)
    address = F.array(value(kind, norm), value(F.lit("domain"), F.split_part(F.lower(m), F.lit("@"), F.lit(2))))
    return F.when(kind == "name", named).when(kind == "email", address).otherwise(F.array(value(kind, norm)))


def _luhn(digits: Column) -> Column:
    """Sum of the digits as the card check has it; right if it divides by ten."""
    backwards = F.split(F.reverse(digits), "")
    twice = lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(F.filter(backwards, lambda c: c != ""), lambda c, i: twice(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def _ninety_seventh(text: Column) -> Column:
    """Of digits and capital letters (10 to 35), as the IBAN check has it: the rest after division by 97."""
    step = lambda rest, c: F.when(c.rlike("[A-Z]"), (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _hmac(key: str, text: Column) -> Column:
    """HMAC-SHA-512 of a text, in hex."""
    raw = key.encode()
    padded = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 512))), 512)


def _stream(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """What the key draws for a value at an attempt, as 256 hex digits."""
    seed = F.concat_ws("|", kind, norm, attempt.cast("string"))
    return F.concat(_hmac(key, F.concat(seed, F.lit("|0"))), _hmac(key, F.concat(seed, F.lit("|1"))))


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, stream: Column) -> Column:
    """The value made from an attempt's stream; from NARROW on, from more values at each."""
    more = F.greatest(attempt - (NARROW - 1), F.lit(0))
    draw = lambda i: F.conv(F.substr(stream, (i % 85) * 3 + 1, F.lit(3)), 16, 10).cast("int")
    pick = lambda some, i: F.element_at(F.array(*[F.lit(x) for x in some]), draw(i if isinstance(i, Column) else F.lit(i)) % len(some) + 1)
    letter = lambda first, i: F.chr((F.lit(ord(first)) + draw(i) % 26).cast("long"))
    added = F.array_join(F.transform(F.sequence(F.lit(1), more + 1), lambda i: F.when(i <= more, letter("a", i + 60)).otherwise("")), "")

    def like(text: Column, at: int = 0) -> Column:
        """Digits for digits (none for a leading zero), letters for letters, the rest as it is."""
        one = lambda c, i: F.when(c.rlike("[0-9]"), F.when((i == 0) & (c != "0"), draw(i + at) % 9 + 1).otherwise(draw(i + at) % 10).cast("string")).when(c.rlike(r"\p{Lu}"), letter("A", i + at)).when(c.rlike(r"\p{L}"), letter("a", i + at)).otherwise(c)
        return F.array_join(F.transform(F.split(text, ""), one), "")

    local = F.concat(like(F.split_part(norm, F.lit("@"), F.lit(1))), added)
    domain = F.concat(like(F.split_part(norm, F.lit("."), F.lit(1)), 40), added, F.lit(".example."), pick(["com", "org", "net"], 84))
    hexed = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex((draw(i) % 16).cast("long"))))), "")
    ip6 = F.when(more > 0, F.regexp_replace(F.lower(F.left(stream, F.lit(32))), "(.{4})(?!$)", "$1:")).otherwise(hexed)
    prefix = F.regexp_extract(norm, f"^(?:{TOKENS})", 0)
    secret = F.when(prefix == "", hexed).otherwise(F.concat(prefix, like(F.substr(norm, F.length(prefix) + 1, F.length(norm)))))
    octet = lambda o, i: F.when(more > 0, draw(i) % 256).when(F.length(o) == 1, draw(i) % 10).when(F.length(o) == 2, draw(i) % 90 + 10).otherwise(draw(i) % 156 + 100).cast("string")
    ip = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    body = F.concat(F.left(norm, F.lit(1)), like(F.substr(norm, F.lit(2), F.length(norm) - 2)))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(norm) % 10 == 0, check).otherwise(((check.cast("int") + 1 + draw(F.lit(80)) % 9) % 10).cast("string")))
    account = like(F.substr(norm, F.lit(5), F.length(norm)))
    country = F.left(norm, F.lit(2))
    iban = F.concat(country, F.lpad((98 - _ninety_seventh(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    made = F.when(kind == "email", local).when(kind == "domain", domain).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "ssn", F.concat(F.lit("9"), like(F.substr(norm, F.lit(2), F.lit(8))))).when(kind == "iban", iban)
    for script in ("lat", "cyr"):
        stem = F.array_join(F.transform(F.sequence(F.lit(0), more + 2), lambda i: pick(SYLLABLES[script], i)), "")  # noqa: B023
        end = lambda what: pick(ENDINGS[what][script], 80)  # noqa: B023, E731
        made = made.when(kind == f"surname_{script}", F.concat(stem, end("surname")))
        made = made.when(kind == f"given_{script}", F.concat(stem, F.when(gender == "m", end("given_m")).when(gender == "f", end("given_f")).otherwise(end("given_n"))))
    return made.otherwise(like(norm))


def assign(values: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate of each distinct (kind, norm) of values with kind, norm, gender: different surrogates for
    different values of a kind. Each round draws for the values that have none; a draw counts if it is nobody's real
    value and nobody has it; of several that draw the same in a round the first has it."""
    told = lambda g: F.sum((F.col("gender") == g).cast("int"))
    gender = F.when(told("m") > told("f"), "m").when(told("f") > told("m"), "f").otherwise("n")
    values = written(values.groupBy("kind", "norm").agg(gender.alias("gender")), "pii-values")
    done, left = None, values
    for attempt in range(ROUNDS):
        # the stream is a column of its own: a surrogate reads it in hundreds of places
        streams = left.withColumn("stream", _stream(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        drawn = streams.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.lit(attempt), F.col("stream"))).drop("stream")
        free = drawn.join(values.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        new = written(first.select("kind", "norm", "surrogate"), "pii-assigned")
        done = new if done is None else done.unionByName(new)
        left = written(left.join(new, ["kind", "norm"], "left_anti"), "pii-left")
        if left.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates after {ROUNDS} draws")


def _rendered(matches: Column, found: Column) -> Column:
    """The matches (of parts_of) with their values' surrogates in their own format; found: map of kind|norm to surrogate."""
    has = lambda kind, norm: F.try_element_at(found, F.concat_ws("|", kind, norm))
    got = lambda v: F.coalesce(has(v["kind"], v["norm"]), v["norm"])
    cased = lambda s, like: F.when(F.upper(like) == like, F.upper(s)).otherwise(F.initcap(s))

    def renamed(text: Column, what: str) -> Column:
        new = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: cased(F.coalesce(has(F.concat(F.lit(what), script_of(x)), F.lower(x)), x), x))
        return F.array_join(F.zip_with(F.split(text, WORD, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def one(x: Column) -> Column:
        m, kind, own, second = (x[c] for c in ("m", "kind", "own", "second"))
        spare = F.length(_digits(m)) - F.length(own)
        place = lambda i: F.length(_digits(F.left(m, i + 1))) - spare
        digits = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]") & (place(i) > 0), F.substr(own, place(i), F.lit(1))).otherwise(c)), "")
        spaced = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(own, F.length(F.replace(F.left(m, i + 1), F.lit(" "))), F.lit(1)))), "")
        name = F.concat(x["titles"], renamed(x["given"], "given"), renamed(x["last"], "surname"))
        bare = cased(F.coalesce(has(F.concat(F.lit("surname"), script_of(m)), F.lower(m)), has(F.concat(F.lit("given"), script_of(m)), F.lower(m)), m), m)
        address = F.concat(own, F.lit("@"), second)
        return F.when(kind == "name", name).when(kind == "bare", bare).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).when(kind == "email", F.when(m == F.upper(m), F.upper(address)).otherwise(address)).when((kind == "ip6") & (m == F.upper(m)), F.upper(own)).otherwise(own)

    fields = ("m", "kind", "titles", "given", "last")
    matches = F.transform(matches, lambda x: F.struct(*[x[c].alias(c) for c in fields], values_of(x).alias("values")))
    matches = F.transform(matches, lambda x: F.struct(*[x[c].alias(c) for c in fields], got(F.get(x["values"], 0)).alias("own"), got(F.get(x["values"], 1)).alias("second")))
    return F.transform(matches, one)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in place of what is found in text; n_entities says how many.

    Only texts with findings are joined with their surrogates, on id and a hash of the text; the others pass."""
    if not key:
        raise ValueError("surrogates need a secret key")
    docs = docs.drop("n_entities")
    has = found_in(F.col("text"))
    keys = {"_pii_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_pii_hash": F.xxhash64("text")}
    hit = docs.where(has).withColumns(keys)
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    values = hit.select(*keys, F.explode(F.flatten(F.transform(parts_of(matches), values_of))).alias("v")).select(*keys, "v.kind", "v.norm", "v.gender")
    values = written(values.distinct(), "pii-found")
    given = assign(values.select("kind", "norm", "gender"), key)
    own = values.select(*keys, "kind", "norm").distinct().join(given, ["kind", "norm"])
    maps = own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "surrogate"))).alias("_pii_map"))
    # a text's names without their titles, too
    parts = F.transform(F.filter(F.map_keys("_pii_map"), lambda k: k.rlike(r"^(?:given|surname)_")), lambda k: F.initcap(F.split_part(k, F.lit("|"), F.lit(2))))
    written_as = F.concat(parts, F.transform(parts, F.upper))
    pattern = F.when(F.size(parts) > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:\Q"), F.array_join(F.reverse(F.array_sort(written_as)), r"\E|\Q"), F.lit(r"\E)(?!\p{L})"))).otherwise(F.lit(ANY))
    joined = hit.join(maps, list(keys), "left").withColumn("_pii_pattern", F.coalesce(pattern, F.lit(ANY))).withColumn("_pii_matches", F.regexp_extract_all("text", F.col("_pii_pattern"), F.lit(0)))
    pieces = F.split("text", F.col("_pii_pattern"), -1)
    new = F.array_join(F.zip_with(pieces, _rendered(parts_of(F.col("_pii_matches")), F.col("_pii_map")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rewritten = joined.withColumn("n_entities", F.size("_pii_matches")).withColumn("text", new).select(*docs.columns, "n_entities")
    return rewritten.unionByName(docs.where(~has).withColumn("n_entities", F.lit(0)))
