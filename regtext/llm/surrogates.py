"""Surrogates for personal data, with DataFrame functions only.

Emails, phone numbers, IPv4 addresses, card numbers and persons behind an honorific are found by one regular
expression. The distinct entities of the corpus get keyed replacements of the same type: digits for digits, capitals for
capitals, letters of the same script for letters (in names vowels for vowels), given names of the same gender and script, safe
mail domains with the old suffix, card numbers whose check digit is right or wrong as before. Letters of the scripts in SCRIPTS stay in their script; of
any other script they become Latin ones.

One entity has one replacement in every spelling and document (coreference). A person is known by its name; the gender comes from any of its titles, so
that Mrs., Dr and Prof. Anna Smith are one. Where a name has titles of both genders, these are two persons and a title of neither is a third. A name of two words
or more is also replaced where it stands without a title in the same text. Replacements that two entities share, or that are entities of
the corpus themselves, are drawn again (distinctness); from the turn WIDE on, each draw but that of an address is a keyed character longer than
the one before, so that a format with few values, such as one-letter names, never runs out of them.

Only rows with an entity move: they are written once, their distinct entities are looked up, and their texts are
put together again from the stretches between the entities, in their order. An entity that very many rows share is
pre-aggregated, and Spark splits its partition in the join.

Defined results: null stays null, empty stays empty; texts without entities stay as they are; repeated rows are
handled one by one; an empty table gives an empty result; other columns are kept out; ties between
colliding entities go to the smallest one. Entities and texts may be of any length.
"""

from __future__ import annotations

import unicodedata
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regtext.llm.support import materialise, partitions

# What counts as an entity (possessive, so that Java's matcher doesn't recurse). Honorifics by gender.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
PHONE = r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
ADDRESS = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\p{N}])"
FEMALE, MALE, ANY = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Signora"), ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Signor"), ("Dr", "Prof")
TITLE = "|".join(FEMALE + MALE + ANY)
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++){{0,2}}"
ENTITY = "|".join((EMAIL, PHONE, ADDRESS, CARD, PERSON))
#: Rows that can hold an entity at all.
_MAYBE = rf"[@0-9]|(?:{TITLE})\.? \p{{Lu}}"

# Given names by gender, and letters by script.
NAMES = {
    "f": ["Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Frida", "Greta", "Hanna", "Helen", "Ida", "Ines", "Irene", "Jana", "Julia", "Karin", "Laura", "Lena", "Lucia", "Maria", "Marta", "Mira", "Nina", "Nora", "Olga", "Paula", "Rita", "Rosa", "Sara", "Silvia", "Sofia", "Tina", "Vera"],
    "m": ["Adam", "Albert", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Erik", "Felix", "Frank", "Georg", "Hans", "Hugo", "Ivan", "Jakob", "Jonas", "Karl", "Leon", "Lukas", "Marco", "Martin", "Max", "Nils", "Oscar", "Otto", "Paul", "Peter", "Robert", "Simon", "Stefan", "Thomas", "Tim", "Victor", "Walter"],
    "a": ["Alex", "Chris", "Dominique", "Eden", "Jamie", "Jules", "Kim", "Luca", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Toni"],
}
# Given names in other scripts.
FOREIGN = {
    "Greek": {"f": ["Μαρία", "Ελένη", "Σοφία", "Ειρήνη", "Κατερίνα", "Δήμητρα"], "m": ["Γιώργος", "Νίκος", "Γιάννης", "Πέτρος", "Ανδρέας", "Παύλος"], "a": ["Φοίβη", "Χάρι"]},
    "Cyrillic": {"f": ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера"], "m": ["Иван", "Пётр", "Олег", "Павел", "Сергей", "Антон"], "a": ["Саша", "Женя", "Валя"]},
}
# Vowels and consonants that stand for each other (the plain ones are drawn), and the letters of scripts, as ranges.
VOWELS = [("aeiou", "áàâäãåāăąæéèêëēėęěíìîïīıóòôöõøōőœúùûüūůűýÿ"), ("αεηιουω", "άέήίόύώϊϋΐΰ"), ("аеиоуыэюя", "ёєії")]
CONSONANTS = [("bcdfghjklmnpqrstvwxyz", "çćčďðğłñńňřśşšťþžźżß"), ("βγδζθκλμνξπρστφχψ", "ς"), ("бвгджзйклмнпрстфхцчшщь", "ъґђћџљњќѓўј")]
RANGES = {"Greek": (0x3B1, 0x3CA), "Cyrillic": (0x430, 0x450), "Armenian": (0x561, 0x587), "Georgian": (0x10D0, 0x10F1), "Hebrew": (0x5D0, 0x5EB), "Arabic": (0x627, 0x64B), "Devanagari": (0x904, 0x93A), "Bengali": (0x985, 0x9BA), "Tamil": (0xB85, 0xBBA), "Thai": (0xE01, 0xE2F), "Ethiopic": (0x1200, 0x1248), "Hangul": (0xAC00, 0xAE00), "Hiragana": (0x3042, 0x3094), "Katakana": (0x30A2, 0x30F4), "Han": (0x4E00, 0x5000)}
SCRIPTS = {name: "".join(chr(c) for c in range(a, b) if unicodedata.category(chr(c)) in ("Ll", "Lo")) for name, (a, b) in RANGES.items()}
#: Draws with the entity's own format; each later one (but of an address) is a character longer.
WIDE = 3


def kind_of(value: Column) -> Column:
    return F.when(value.contains("@"), "email").when(value.startswith("+"), "phone").when(value.rlike(rf"^(?:{ADDRESS})$"), "address").when(value.rlike(r"^\d"), "card").otherwise("person")


def same_as(value: Column, kind: Column) -> Column:
    """What spellings of one entity have in common; of a person, its own title's gender and its name."""
    digits = F.regexp_replace(value, r"\D", "")
    name = F.regexp_replace(value, r"^\p{L}+\.? ", "")
    return F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card"), digits).when(kind == "address", value).otherwise(F.concat_ws(":", gender_of(value), F.lower(name)))


def gender_of(value: Column) -> Column:
    title = F.regexp_extract(value, r"^(\p{L}+)", 1)
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("a")


def _number(digest: Column, i: Column | int, below: int) -> Column:
    """The i-th number below so many that a digest gives."""
    return F.pmod(F.xxhash64(digest, F.lit(i) if isinstance(i, int) else i), F.lit(below)).cast("int")


def _letters(text: Column, digest: Column, name: bool = False) -> Column:
    """The same format with other characters: digit for digit, letter for letter of its case and script; in names vowel for vowel."""
    groups = [*VOWELS, *CONSONANTS] if name else [(a[0] + b[0], a[1] + b[1]) for a, b in zip(VOWELS, CONSONANTS, strict=True)]

    def other(c: Column, i: Column) -> Column:
        def drawn(letters: str) -> Column:
            return F.lit(letters).substr(_number(digest, i, len(letters)) + 1, F.lit(1))

        out = F.when(c.rlike("^[0-9]$"), _number(digest, i, 10).cast("string"))
        for letters, more in groups:
            # accented capitals are told by their own lower case
            out = out.when(c.rlike(f"^[{letters}{more}]$"), drawn(letters)).when(F.lower(c).rlike(f"^[{letters}{more}]$"), F.upper(drawn(letters)))
        rest = F.when(c.rlike(r"^\p{Lu}$"), F.upper(drawn(CONSONANTS[0][0]))).when(c.rlike(r"^\p{L}$"), drawn(CONSONANTS[0][0])).otherwise(c)
        far = F.lit(None).cast("string")
        for script, letters in SCRIPTS.items():
            far = F.when(c.rlike(rf"^\p{{Is{script}}}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(drawn(letters))).when(c.rlike(r"^\p{L}$"), drawn(letters)).otherwise(c)).otherwise(far)
        return out.when(c.rlike(r"^[\x00-\x7F\p{IsLatin}]$"), rest).otherwise(F.coalesce(far, rest))

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _by_script(name: Column, of, otherwise: Column) -> Column:
    """of(script) for names that begin with a letter of a script in SCRIPTS."""
    out = otherwise
    for script in SCRIPTS:
        out = F.when(name.rlike(rf"^\p{{Is{script}}}"), of(script)).otherwise(out)
    return out


def _check_sum(digits: Column) -> Column:
    """The sum of a card number that is 0 modulo 10 when its check digit is right."""
    n = F.length(digits)
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def draw(rows: DataFrame, key: str) -> DataFrame:
    """kind, entity, turn and core: what an entity's replacement is made of in its turn."""
    kind, entity, turn, digest = F.col("kind"), F.col("entity"), F.col("turn"), F.col("digest")
    domain = F.substring_index("entity", "@", -1)
    # digests stand in columns of their own, as one serves every character of an entity
    rows = rows.select("kind", "entity", "turn", F.sha2(F.concat_ws("|", F.lit(key), kind, entity, turn.cast("string")).cast("binary"), 512).alias("digest"), F.sha2(F.concat_ws("|", F.lit(key), domain).cast("binary"), 256).alias("host"))
    shaped = _letters(entity, digest)
    more = F.sha2(digest.cast("binary"), 512).substr(F.lit(1), F.greatest(turn - (WIDE - 1), F.lit(0)))
    letters, digits = F.translate(more, "0123456789", "ghijklmnop"), F.translate(more, "abcdef", "012345")
    email = F.concat(_letters(F.substring_index(entity, "@", 1), digest), letters, F.lit("@mx-"), F.substring("host", 1, 8), F.lit(".example."), F.substring_index(domain, ".", -1))
    phone = F.concat(F.substring(entity, 1, 1), shaped.substr(F.lit(2), F.length(entity)), digits)
    octets = F.concat_ws(".", *((_number(digest, i, 223 if i == 0 else 254) + 1).cast("string") for i in range(4)))
    body = F.concat(F.substring(entity, 1, 1), shaped.substr(F.lit(2), F.length(entity) - 2), digits)
    check = F.pmod(_check_sum(entity) - _check_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    gender, name = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)

    def given(lists: dict[str, list[str]]) -> Column:
        out = F.lit(None).cast("string")
        for g, names in lists.items():
            out = F.when(gender == g, F.element_at(F.array(*map(F.lit, names)), _number(digest, -1, len(names)) + 1)).otherwise(out)
        return F.lower(out)

    rest = F.regexp_replace(name, r"^[^ ]+ ?", "")
    shaped_name = _letters(name, digest, True)
    first = _by_script(name, lambda script: given(FOREIGN[script]) if script in FOREIGN else F.substring_index(shaped_name, " ", 1), given(NAMES))
    person = F.when(rest == "", shaped_name).otherwise(F.concat(first, F.lit(" "), _letters(rest, digest, True)))
    tail = _by_script(name, lambda script: F.translate(more, "0123456789abcdef", SCRIPTS[script][:16]), letters)
    core = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "address", octets).when(kind == "card", F.concat(body, check)).otherwise(F.concat(gender, F.lit(":"), person, tail))
    return rows.select("kind", "entity", "turn", core.alias("core"))


def render(value: Column, kind: Column, core: Column) -> Column:
    """A replacement in the spelling of the value that it stands for."""
    between = F.split(value, "[0-9]", -1)
    digits = F.concat_ws("", F.zip_with(between, F.split(core, ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    title, name = F.regexp_extract(value, r"^(\p{L}+\.? )", 1), F.substring_index(core, ":", -1)
    person = F.concat(title, F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "))
    return F.when(kind.isin("phone", "card"), digits).when(kind == "person", person).otherwise(core)


def cores(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity and core: distinct cores, none of which is an entity itself."""
    n = partitions(entities.sparkSession)
    # drawing is work of the CPU on few bytes, so it is dealt by number and not by size
    rows = entities.select("kind", "entity", F.lit(0).alias("turn")).repartition(n, "kind", "entity")
    for _ in count():
        now = materialise(draw(rows, key), "cores")
        keepers = now.groupBy("kind", "core").agg(F.min("entity").alias("keeper"), F.count(F.lit(1)).alias("n"))
        taken = keepers.join(entities.select("kind", F.col("entity").alias("core")), ["kind", "core"], "left_semi").select("kind", "core", F.lit(True).alias("taken"))
        shared = keepers.where("n > 1").drop("n")
        again = shared.join(taken, ["kind", "core"], "full")
        if again.isEmpty():
            return now.select("kind", "entity", "core")
        lost = (F.coalesce("taken", F.lit(False))) | (F.col("keeper").isNotNull() & (F.col("keeper") != F.col("entity")))
        rows = now.join(again, ["kind", "core"], "left").select("kind", "entity", F.when(lost, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn")).repartition(n, "kind", "entity")


def _with_genders(values: DataFrame) -> DataFrame:
    """values (value, kind, entity) in which a person whose title says no gender has that of the other titles of its name, if these agree."""
    name = F.substring_index("entity", ":", -1)
    people = values.where("kind = 'person'").withColumns({"name": name, "gender": F.substring_index("entity", ":", 1)})
    known = people.groupBy("name").agg(F.max(F.col("gender") == "f").alias("f"), F.max(F.col("gender") == "m").alias("m"))
    gender = F.when(F.col("gender") != "a", F.col("gender")).when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("a")
    keyed = people.join(known, "name").select("value", "kind", F.concat(gender, F.lit(":"), F.col("name")).alias("entity"))
    return values.where("kind <> 'person'").select("value", "kind", "entity").unionByName(keyed)


def _mentions(text: Column, people: Column) -> Column:
    """A stretch of text in which people (name, surrogate; without titles, sorted) are replaced wherever they stand by themselves."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}'-])(?:"), F.array_join(F.transform(people, lambda p: F.concat(F.lit(r"\Q"), p["name"], F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}'-])"))
    found, between = F.regexp_extract_all(text, pattern, 0), F.split(text, pattern, -1)
    put = F.transform(found, lambda m: F.coalesce(F.try_element_at(F.map_from_entries(people), m), m))
    whole = F.concat_ws("", F.zip_with(between, put, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    return F.when((F.size(people) > 0) & F.regexp_like(text, pattern), whole).otherwise(text)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with surrogates, n_entities (places that the pattern finds) and kinds (sorted) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hit = F.coalesce(F.col("text").rlike(_MAYBE) & F.col("text").rlike(ENTITY), F.lit(False))
    found = materialise(rows.where(hit).select(F.monotonically_increasing_id().alias("row"), "id", "text", F.regexp_extract_all("text", F.lit(ENTITY), 0).alias("values")), "found")
    values = found.select("row", F.posexplode("values").alias("at", "value"))
    distinct = values.select("value").distinct().withColumn("kind", kind_of(F.col("value"))).withColumn("entity", same_as(F.col("value"), F.col("kind")))
    distinct = materialise(_with_genders(materialise(distinct, "values")), "entities")
    drawn = cores(distinct.select("kind", "entity").distinct(), key)
    rendered = distinct.join(drawn, ["kind", "entity"]).select("value", "kind", render(F.col("value"), F.col("kind"), F.col("core")).alias("surrogate"))
    untitled = lambda c: F.regexp_replace(c, r"^\p{L}+\.? ", "")
    person = F.when((F.col("kind") == "person") & untitled(F.col("value")).contains(" "), F.struct(untitled(F.col("value")).alias("name"), untitled(F.col("surrogate")).alias("surrogate")))
    put = values.join(rendered, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("put"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.collect_set(person).alias("people"))
    # a name that two persons of one text share says nothing without its title; longer names are looked for first
    alone = F.filter("people", lambda p: F.size(F.filter("people", lambda q: q["name"] == p["name"])) == 1)
    longest = F.transform(F.reverse(F.array_sort(F.transform(alone, lambda p: F.struct(F.length(p["name"]).alias("n"), p["name"].alias("name"), p["surrogate"].alias("surrogate"))))), lambda x: F.struct(x["name"].alias("name"), x["surrogate"].alias("surrogate")))
    between = F.transform(F.split("text", ENTITY, -1), lambda a: _mentions(a, F.col("people")))
    text = F.concat_ws("", F.zip_with(between, "put", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b["surrogate"], F.lit("")))))
    some = found.join(put.withColumn("people", longest), "row").select("id", text.alias("text"), F.size("values").cast("long").alias("n_entities"), "kinds")
    none = rows.where(~hit).select("id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return some.unionByName(none).withColumnRenamed("id", id_col)
