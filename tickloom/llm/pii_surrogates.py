"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern. Every distinct entity (its core: lower-case letters, or digits alone) gets
a replacement derived from a secret key and the core, of the same type, script, case and format: a card
number stays a valid card number, an address stays an address, a man's name becomes a man's name of the same
script. Replacements are checked against each other and against all real entities of the corpus; those that
clash are derived anew, so different entities stay different and one entity has one replacement everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, written

KEY = "tickloom-demo-key"  # a deployment passes its own secret
# Patterns of the entity types, in order of precedence.
EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
# Where a card may stand: other digits may be next to it, parted by a space or dash. Every start is tried, as a
# number that fails its check may hold the beginning of a card: usual groups, 17 to 19 digits in groups, whole runs.
BEFORE, AFTER = r"(?:(?<![\w.-])|(?<=[0-9]-))", r"(?:(?![\w-])|(?=-[0-9]))"
CARD_FORMS = [
    r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3}|[0-9]{13,19}",
    r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}",
    rf"(?<![0-9] ){CARD}(?! [0-9])",
]
CARD_HINT = "[0-9](?:[ -]?[0-9]){12}"
PHONE = (r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
         r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![\w.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])")
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.[0-9])"
# Titles by gender and script; a capitalised name follows (fixed values).
TITLES = {
    "m": {"latin": ["Mr", "Herr", "Señor", "Monsieur", "Sir"], "cyrillic": ["г-н", "господин"], "greek": ["κύριος", "Κύριος"]},
    "f": {"latin": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame"], "cyrillic": ["г-жа", "госпожа"], "greek": ["κυρία", "Κυρία"]},
}
# Given names by gender and script, of which surrogates are made (fixed values).
GIVEN = {
    "m": {"latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Noel", "Oscar", "Paul", "Simon"],
          "cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Игорь", "Кирилл", "Лев"],
          "greek": ["Άρης", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Φίλιππος"]},
    "f": {"latin": ["Alma", "Berta", "Clara", "Doris", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
          "cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
          "greek": ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χαρά"]},
}
ALL_TITLES = [t for by in TITLES.values() for names in by.values() for t in names]
NAME = rf"(?<!\p{{L}})(?:{'|'.join(ALL_TITLES)})\.? \p{{Lu}}\p{{Ll}}{{1,40}}(?: \p{{Lu}}\p{{Ll}}{{1,40}}){{0,2}}(?!\p{{L}})"
# (?U) lets \w and classes follow Unicode.
FIRST, LAST = "(?U)" + "|".join([EMAIL, IBAN, SSN, PHONE]), "|".join([IP, NAME])
PATTERN = f"{FIRST}|{LAST}"  # of texts without a card
# Every entity holds an @, two digits in a row, a digit and a dot, or a title; other texts are not searched.
HINT = "@|[0-9][0-9 .)-]|" + "|".join(ALL_TITLES)
TYPES = [("email", EMAIL), ("iban", IBAN), ("ssn", SSN), ("ip", IP), ("card", CARD), ("phone", PHONE), ("name", NAME)]
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _kind(surface: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES):
        out = F.when(surface.rlike(f"(?U)^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits (valid numbers give a multiple of ten)."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _cards(text: Column) -> Column:
    """The valid card numbers of a text as alternatives of a pattern; null if there is none."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){BEFORE}(?=({form}){AFTER})"), F.lit(1)) for form in CARD_FORMS])
    valid = F.filter(F.array_distinct(found), lambda c: luhn_sum(_digits(c)) % 10 == 0)
    return F.when(text.rlike(CARD_HINT), F.nullif(F.array_join(valid, "|"), F.lit("")))


def _pattern(cards: Column) -> Column:
    return F.when(cards.isNull(), F.lit(PATTERN)).otherwise(
        F.concat(F.lit(f"{FIRST}|{BEFORE}(?:"), cards, F.lit(f"){AFTER}|{LAST}")))


def _core(kind: Column, surface: Column) -> Column:
    """What two mentions of one entity have in common."""
    return (F.when(kind.isin("card", "phone", "ssn"), _digits(surface))
            .when(kind == "iban", F.regexp_replace(surface, " ", ""))
            .when(kind == "ip", surface)
            .otherwise(F.lower(surface)))


def _random(seed: Column, i: Column, n: int) -> Column:
    """A number below ``n``, a function of seed and position."""
    return F.pmod(F.xxhash64(seed, i), F.lit(n))


def _mapped(core: Column, seed: Column) -> Column:
    """``core`` with every digit and letter replaced by one of its script, in place; marks and dots stay."""
    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _random(seed, i, 10).cast("string"))
        for script, alphabet in LETTERS.items():
            pick = F.substring(F.lit(alphabet), _random(seed, i, len(alphabet)).cast("int") + 1, F.lit(1))
            pattern = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
            out = out.when(c.rlike(pattern), F.when(c.rlike(r"\p{Lu}"), F.upper(pick)).otherwise(pick))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(core, ""), one), "")


def _group_of(core: Column) -> tuple[Column, Column]:
    """Gender and script of a titled name (lower case)."""
    title = F.regexp_extract(core, r"^(\S+?)\.? ", 1)
    gender, script = F.lit("m"), F.lit("latin")
    for g, by in TITLES.items():
        for s, titles in by.items():
            hit = title.isin([t.lower() for t in titles])
            gender, script = F.when(hit, g).otherwise(gender), F.when(hit, s).otherwise(script)
    return gender, script


def _derive(kind: Column, core: Column, attempt: Column, key: str) -> Column:
    """The replacement core number ``attempt`` of an entity.

    From the fourth attempt on the free part grows by a character an attempt, so that clashes end however
    small the space of a format is (a number of fixed length keeps its length: it has at least 10^9 values).
    """
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, core, attempt.cast("string")), 256)
    more = F.greatest(attempt - 3, F.lit(0))
    longer = F.array_join(F.transform(F.sequence(F.lit(1), more + 1), lambda i: F.when(
        i <= more, F.substring(F.lit(LETTERS["latin"]), _random(seed, i + 1000, 26).cast("int") + 1, F.lit(1))).otherwise("")), "")
    local, domain = F.substring_index(core, "@", 1), F.substring_index(core, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_mapped(local, seed), longer, F.lit("@"), _mapped(host, F.sha2(seed, 256)), F.lit("."), top)
    free = _mapped(F.expr("substring(core, 1, length(core) - 1)"), seed)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(free, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.concat(free, check.cast("string"))
    octets = F.array_join(F.transform(F.split(core, r"\."), lambda o, i: (_random(seed, i, 254) + 1).cast("string")), ".")
    gender, script = _group_of(core)
    names = F.lit(None).cast("array<string>")
    for g, by in GIVEN.items():
        for s, given in by.items():
            names = F.when((gender == g) & (script == s), F.array(*[F.lit(n.lower()) for n in given])).otherwise(names)
    words = F.split(core, " ")
    given = F.element_at(names, (F.pmod(F.xxhash64(seed), F.size(names)) + 1).cast("int"))
    family = F.concat(_mapped(F.array_join(F.slice(words, F.size(words), 1), ""), seed), longer)
    middle = F.transform(F.slice(words, 3, F.greatest(F.size(words) - 3, F.lit(0))), lambda w, i: _mapped(w, F.concat(seed, i.cast("string"))))
    person = F.when(F.size(words) <= 2, F.concat_ws(" ", words[0], family)).otherwise(
        F.concat_ws(" ", words[0], given, F.array_join(middle, " "), family))
    name = F.regexp_replace(person, " +", " ")
    phone = F.concat(F.substring(core, 1, 1), _mapped(F.expr("substring(core, 2)"), seed))  # a country code keeps its first digit
    iban = F.concat(F.substring(core, 1, 2), _mapped(F.expr("substring(core, 3)"), seed))
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", octets)
            .when(kind == "name", name).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(_mapped(core, seed)))


def surrogates(cores: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, core, surrogate) of the distinct (kind, core) rows given.

    A replacement is accepted if no accepted one of its kind equals it, if of several entities that ask for
    it this is the smallest, and if it is no entity of the corpus. The others try again; every round is
    written to the shared folder, and mostly a handful of rows reach the second one.
    """
    cores = written(cores, "entities")
    open_, done, attempt = cores, None, 0
    while True:
        tried = open_.withColumn("surrogate", _derive(F.col("kind"), F.col("core"), F.lit(attempt), key))
        real = cores.select("kind", F.col("core").alias("surrogate"))
        tried = tried.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(tried.groupBy("kind", "surrogate").agg(F.min("core").alias("core")).select("kind", "core", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = written(open_.join(won, ["kind", "core"], "left_anti"), "clashes")
        if open_.isEmpty():
            return done
        attempt += 1


def _dressed(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The replacement in the format of one mention: its separators, its case."""
    chars = F.split(surface, "")
    before = lambda i: F.length(_digits(F.array_join(F.slice(chars, 1, i), "")))
    placed = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(
        surrogate, before(i) + 1, F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        surrogate, F.length(F.regexp_replace(F.array_join(F.slice(chars, 1, i), ""), " ", "")) + 1, F.lit(1)))), "")
    title = F.substring_index(surface, " ", 1)
    name = F.concat(title, F.lit(" "), F.initcap(F.expr("substring(surrogate, instr(surrogate, ' ') + 1)")))
    cased = F.when((F.upper(surface) == surface) & (F.lower(surface) != surface), F.upper(surrogate)).otherwise(surrogate)
    return (F.when(kind.isin("card", "phone", "ssn"), placed).when(kind == "iban", spaced)
            .when(kind == "name", name).when(kind == "email", cased).otherwise(surrogate))


def replace_entities(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of its texts replaced; every row and column stays.

    Null and empty texts stay as they are, and so does every text without an entity. Numbers in card format
    are entities only if their Luhn sum is valid; digits next to them do not hide them. ``count_col``: a column for the number of replaced mentions.
    """
    text = F.col(text_col)
    found, digest, table = free_name(docs, "found"), free_name(docs, "digest"), free_name(docs, "replacements")
    cards = free_name(docs, "cards")
    mentions = F.when(text.rlike(HINT), F.regexp_extract_all(text, _pattern(F.col(cards)), F.lit(0)))
    marked = docs.withColumn(cards, _cards(text)).withColumn(found, mentions).withColumn(found, F.when(F.size(found) > 0, F.col(found)))
    # texts without an entity have no partner in the join; a short hash of their own keeps them apart
    marked = marked.withColumn(digest, F.when(F.col(found).isNotNull(), F.sha2(text, 256)).otherwise(F.hex(F.xxhash64(text))))
    each = (marked.filter(F.col(found).isNotNull())
            .select(F.col(digest).alias("digest"), F.explode(F.array_distinct(found)).alias("surface")).distinct())
    each = written(each, "mentions")
    kinds = each.select("surface").distinct().withColumn("kind", _kind(F.col("surface")))
    kinds = kinds.filter((F.col("kind") != "card") | (luhn_sum(_digits(F.col("surface"))) % 10 == 0))
    kinds = written(kinds.withColumn("core", _core(F.col("kind"), F.col("surface"))).filter("kind is not null"), "surfaces")
    chosen = surrogates(kinds.select("kind", "core").distinct(), key)
    new = (kinds.join(chosen, ["kind", "core"])
           .select("surface", _dressed(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("new")))
    # both are written, so that the sides of their joins are dealt anew and a frequent entity or text can be split
    new = written(new, "replacements")
    tables = (each.join(new, "surface").groupBy("digest")
              .agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias(table))
              .withColumnRenamed("digest", digest))
    tables = written(tables, "tables")
    put = lambda m: F.coalesce(F.element_at(F.col(table), m), m)
    gaps = F.split(text, _pattern(F.col(cards)), -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.transform(F.col(found), put), lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
    out = marked.join(tables, digest, "left")
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(table).isNull(), 0).otherwise(
            F.size(F.filter(F.col(found), lambda m: F.map_contains_key(F.col(table), m)))).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(table).isNull(), text).otherwise(joined))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != count_col], *([count_col] if count_col else []))
