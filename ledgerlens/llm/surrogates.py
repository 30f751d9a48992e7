"""PII surrogates with DataFrame functions only.

Entities are found by one pattern. Each distinct entity of the whole table gets
a keyed replacement of its own type: digits for digits, letters of the same
script, valid octets, a kept check digit rule, names of the same gender. A
collision check over the distinct entities gives another attempt to all but one
of those with the same surrogate and to those whose surrogate is a real entity,
until there are none. So distinct entities stay distinct, and one entity has one
surrogate everywhere (names part by part, so "Mr. Roe" is still "Mr. Jo Roe").
Nothing of an entity can be read from its surrogate without the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

KEY = "surrogate-key-1"
#: Cuts a string into its characters.
CHARS = r"(?!^)(?!\z)"
#: Rounds of the collision check; attempts add entropy, so a few are enough.
ROUNDS = 12

# Titles by gender, given names by gender and script, syllables by script.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar"],
    ("f", "latin"): ["Ada", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Laura", "Maria", "Nora"],
    ("n", "latin"): ["Alex", "Robin", "Kim", "Sascha", "Noa", "Jules", "Charlie", "Eden", "Sky", "Toni", "Andrea", "Dominique"],
    ("m", "cyrillic"): ["Иван", "Олег", "Пётр", "Антон", "Борис", "Глеб"],
    ("f", "cyrillic"): ["Анна", "Ольга", "Вера", "Дарья", "Ирина", "Нина"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("m", "greek"): ["Νίκος", "Πέτρος", "Γιώργος", "Ανδρέας"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Σοφία", "Άννα"],
    ("n", "greek"): ["Άλεξ", "Φώτη", "Χάρη", "Φανή"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "can", "da", "del", "fa", "gar", "han", "ka", "lan", "lor", "ma", "mer", "na", "nor", "pel", "ra", "ros", "sal", "ta", "tor", "va", "vin", "zel"],
    "cyrillic": ["ба", "вер", "гор", "да", "зин", "ка", "лев", "ма", "нов", "пет", "ро", "сам", "та", "фё", "чер", "яр"],
    "greek": ["βα", "γορ", "δα", "καλ", "λα", "μαν", "νι", "παπ", "ρο", "σα", "της", "φω"],
}

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++[\p{L}\p{N}-]*\p{L}{2}"
_SECRET = r"(?<![\p{L}\p{N}])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])"
_CARD = r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}(?:[ -]?[0-9]{1,4}){1,2}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\p{L}\p{N}])"
_PHONE = r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,5}\)|[0-9]{2,5})){2,5}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])"
_SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"\p{Lu}[\p{Ll}'’]*+(?:-\p{Lu}\p{Ll}++)*+"
_PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"
PATTERN = "|".join([_EMAIL, _SECRET, _IBAN, _IP, _CARD, _PHONE, _SSN, _PERSON])
#: Whatever PATTERN finds has a digit, an @ or a title; texts without are passed over quickly.
HINT = rf"[0-9@]|(?:{_TITLE})\.? "
_KINDS = [("email", "@"), ("secret", r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\z"), ("ip", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), ("iban", r"^[A-Z]{2}[0-9]{2}"), ("phone", r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\z"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), ("card", "^[0-9]")]


def kind(found: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(_KINDS):
        out = F.when(found.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _names(found: Column) -> Column:
    """The name's parts, without the title."""
    parts = F.split(found, " ")
    return F.slice(parts, 2, F.size(parts) - 1)


def _gender(found: Column) -> Column:
    title = F.regexp_replace(F.element_at(F.split(found, " "), 1), r"\.$", "")
    by_title = F.when(title.isin(TITLES["m"]), F.lit("m")).when(title.isin(TITLES["f"]), F.lit("f"))
    first = F.element_at(_names(found), 1)
    by_name = F.when(first.isin([n for (g, _), v in GIVEN.items() if g == "m" for n in v]), F.lit("m")).when(first.isin([n for (g, _), v in GIVEN.items() if g == "f" for n in v]), F.lit("f"))
    return F.coalesce(by_title, by_name, F.lit("n"))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(name.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def units(found: Column) -> Column:
    """Array of (type, canonical form) of what has a surrogate of its own."""
    one = lambda t, c: F.array(F.struct(t.alias("type"), c.alias("form")))
    k = kind(found)
    names = _names(found)
    gender = _gender(found)
    person = F.transform(names, lambda n, i: F.struct(F.concat(F.when(i == F.size(names) - 1, F.lit("surname:")).otherwise(F.concat(F.lit("given:"), gender, F.lit(":"))), _script(n)).alias("type"), F.lower(n).alias("form")))
    digits = F.regexp_replace(found, "[^0-9A-Za-z]", "")
    country = F.regexp_extract(found, r"^\+([0-9]{1,3})", 1)
    return F.when(k == "person", person).when(k.isin("email", "secret"), one(k, F.lower(found))).when(k == "ip", one(k, found)).when(k == "phone", one(F.concat(F.lit("phone:"), country), digits)).otherwise(one(k, digits))


def _bytes(type_: Column, form: Column, attempt: Column, n: Column, key: str) -> Column:
    """Array of n keyed numbers in 0..255 (SHA-256 of key, type, form, attempt and a counter)."""
    seed = F.concat_ws("\x1f", F.lit(key), type_, form, attempt.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 32), F.lit(1)).cast("int")), lambda j: F.sha2(F.concat_ws("\x1f", seed, j.cast("string"), F.lit(key)), 256))
    stream = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).try_cast("int"))


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule over a string of digits, mod 10."""
    turned = F.reverse(F.split(digits, CHARS))
    terms = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10


def _picks(values: list[str], raw: Column, n: Column, sep: str) -> Column:
    """n + 1 of the values, by keyed numbers, joined."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(values, F.element_at(raw, (i + 1).cast("int")))), sep)


def with_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, form, attempt, surrogate) of entities (type, form, attempt)."""
    n = F.length("form") + 8 + F.col("attempt") * 4
    raw = _bytes(F.col("type"), F.col("form"), F.col("attempt"), n, key)
    drawn = entities.select("type", "form", "attempt", raw.alias("_raw"))  # a column of its own, so it is drawn once
    return drawn.select("type", "form", "attempt", _surrogate(F.col("type"), F.col("form"), F.col("attempt"), F.col("_raw")).alias("surrogate"))


def _surrogate(type_: Column, form: Column, attempt: Column, raw: Column) -> Column:
    """The surrogate's canonical form."""
    chars = F.split(form, CHARS)
    n = F.size(chars)
    at = lambda i: F.element_at(raw, (i + 1).cast("int"))
    digit = lambda i: (at(i) % 10).cast("string")
    letter = lambda i: F.char((at(i) % 26 + 97).cast("long"))
    shaped = lambda keep: F.array_join(F.transform(chars, lambda c, i: F.when(keep(i), c).when(c.rlike("[0-9]"), digit(i)).when(c.rlike(r"\p{Lu}"), F.upper(letter(i))).when(c.rlike(r"\p{L}"), letter(i)).otherwise(c)), "")
    last_label = n - F.length(F.substring_index(form, ".", -1))
    email = shaped(lambda i: i >= last_label)
    country = F.length(F.substring_index(type_, ":", -1))
    phone = shaped(lambda i: i < country)
    plain = shaped(lambda i: F.lit(False))
    iban = shaped(lambda i: i < 2)
    # The last digit keeps the check rule: valid stays valid, invalid stays invalid.
    body = F.substring(plain, F.lit(1), n - 1)
    right = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    valid = _luhn(form) == 0
    check = F.when(valid, right).otherwise(F.pmod(right + 1 + at(n) % 9, F.lit(10)))
    card = F.concat(body, check.cast("string"))
    secret = F.array_join(F.transform(chars, lambda c, i: F.lower(F.hex((at(i) % 16).cast("long")))), "")
    ip = F.concat_ws(".", (at(F.lit(0)) % 223 + 1).cast("string"), at(F.lit(1)).cast("string"), at(F.lit(2)).cast("string"), (at(F.lit(3)) % 254 + 1).cast("string"))
    out = plain
    for (g, script), names in GIVEN.items():
        out = F.when(type_ == f"given:{g}:{script}", F.lower(_picks(names, raw, attempt, "-"))).otherwise(out)
    for script, parts in SYLLABLES.items():
        out = F.when(type_ == f"surname:{script}", _picks(parts, raw, attempt + 2, "")).otherwise(out)
    return F.when(type_ == "email", email).when(type_ == "secret", secret).when(type_ == "ip", ip).when(type_ == "card", card).when(type_ == "iban", iban).when(type_.startswith("phone"), phone).otherwise(out)


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, form, surrogate) of distinct entities (type, form), without collisions."""
    current = saved(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(ROUNDS):
        # All phones share one space, whatever the country code in their type.
        space = F.substring_index("type", ":", 1)
        taken = current.groupBy(space.alias("_t"), F.col("surrogate").alias("_s")).agg(F.min(F.struct("type", "form")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        real = current.select(space.alias("_rt"), F.col("form").alias("_rs")).distinct()
        twice = current.join(taken, (space == F.col("_t")) & (F.col("surrogate") == F.col("_s")), "left")
        both = twice.join(real, (space == F.col("_rt")) & (F.col("surrogate") == F.col("_rs")), "left")
        bad = (F.col("_first").isNotNull() & ((F.col("_first.type") != F.col("type")) | (F.col("_first.form") != F.col("form")))) | F.col("_rs").isNotNull()
        marked = saved(both.select("type", "form", "attempt", "surrogate", F.coalesce(bad, F.lit(False)).alias("bad")), "marked")
        if not marked.where("bad").take(1):
            return current.select("type", "form", "surrogate")
        again = marked.where("bad").withColumn("attempt", F.col("attempt") + 1)
        current = saved(marked.where("not bad").drop("bad").unionByName(with_surrogates(again, key)), "surrogates")
    raise RuntimeError("surrogates still collide")


def _fill(found: Column, core: Column) -> Column:
    """core's characters in the places of found's letters and digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], F.substring(core, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(F.split(found, CHARS), start, step)["s"]


def render(found: Column, known: Column) -> Column:
    """The surrogate in the format of what was found; known: map of 'type|form'."""
    k = kind(found)
    core = lambda u: F.element_at(known, F.concat(u["type"], F.lit("|"), u["form"]))
    parts = F.transform(units(found), core)
    first = F.element_at(parts, 1)
    shouted = (F.upper(found) == found) & (F.lower(found) != found)
    names = F.concat(F.array(F.element_at(F.split(found, " "), 1)), F.transform(parts, lambda p: F.initcap(F.replace(p, F.lit("-"), F.lit("- ")))))
    person = F.replace(F.array_join(names, " "), F.lit("- "), F.lit("-"))
    text = F.when(k == "person", person).when(k.isin("email", "secret", "ip"), first).otherwise(_fill(found, first))
    return F.when((k != "person") & shouted, F.upper(text)).otherwise(text)


def replace_pii(docs: DataFrame, key: str = KEY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_entities), one row per row of docs, entities replaced.

    Texts without entities come back as they are, null texts as null, with 0
    entities. Repeated rows get equal texts. Null ids keep their rows; other
    columns are ignored; an empty table gives no rows. Texts are searched whole.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    hits = rows.where(has).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    hits = saved(hits, "hits")
    seen = hits.select("_key", F.explode(F.array_distinct(F.flatten(F.transform("found", units)))).alias("u")).select("_key", "u.type", "u.form")
    surrogates = distinct_surrogates(seen.select("type", "form").distinct(), key)
    entry = F.struct(F.concat("type", F.lit("|"), "form").alias("k"), F.col("surrogate").alias("v"))
    maps = seen.distinct().join(surrogates, ["type", "form"]).groupBy("_key").agg(F.map_from_entries(F.collect_set(entry)).alias("known"))
    gaps = F.split("text", PATTERN, -1)
    new = F.concat(F.transform("found", lambda f: render(f, F.col("known"))), F.array(F.lit("")))
    rewritten = hits.join(maps, "_key").select("doc_id", F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, s)), "").alias("text"), F.size("found").alias("n_entities"))
    return rows.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities")).unionByName(rewritten)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))
