"""PII surrogates in DataFrame expressions only.

Each detected entity has a canonical value (digits of a number, lower-case address, folded name)
from which a keyed hash makes a canonical surrogate of the same kind; a mention's own format
(separators, case, script, country code, card brand and check digit) is then poured over it, so
all mentions of one entity read alike in every document. All distinct entities are checked for
collisions: two entities with one surrogate, or a surrogate that is another entity's real value;
the later of two in key order draws again until none is left. Redrawn entities are rare, so texts
are rewritten row by row and only documents that hold a redrawn entity are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import identity, let, materialize, quoted

KEY, GROW = "tessera-surrogates-1", 8
# Patterns of the detected kinds (Java syntax), most specific first.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Господин|Госпожа|господин|госпожа)\.?\x20\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any entity of PATTERNS holds; texts without it are passed over.
HINT = r"@|\d{3}|\+\d|\d\.\d|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|осподин|оспожа)\.?\x20"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа|госпожа)"
TITLE = r"^(?:Mrs|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|[Гг]осподин|[Гг]оспожа)\.?\x20"
# Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Robert", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара", "Ульяна", "Юлия"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Юрий"],
}
SYLLABLES = {"latin": ["ba", "co", "del", "fer", "gan", "hol", "jen", "kar", "lin", "mor", "nel", "par", "ros", "sten", "tal", "ven"], "cyrillic": ["ба", "ко", "дел", "фер", "ган", "хол", "жен", "кар", "лин", "мор", "нел", "пар", "рос", "стен", "тал", "вен"]}


def _draw(seed: Column, at: Column | int, of: Column | int) -> Column:
    """A keyed number from 0 below ``of`` for position ``at``."""
    at, of = (F.lit(x) if isinstance(x, int) else x for x in (at, of))
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, at.cast("string")), 256), 1, 12), 16, 10).cast("long"), of.cast("long"))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def kind_of(m: Column) -> Column:
    """Kind of a whole match: the first of PATTERNS that fits it."""
    out = F.lit("phone")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, m: Column) -> Column:
    """What all mentions of one entity share; names have their gender, numbers beyond +1 their prefix."""
    digits = F.regexp_replace(m, r"\D", "")
    name = F.concat(F.when(m.rlike(FEMALE), "f ").otherwise("m "), F.lower(F.regexp_replace(m, TITLE, "")))
    # +1 is left out where the rest has its ten digits; other prefixes are part of the number.
    phone = F.when(m.startswith("+1") & (F.length(digits) == 11) | ~m.startswith("+") & (F.length(digits) > 10), F.right(digits, F.lit(10))).otherwise(digits)
    return F.when(kind == "email", F.lower(m)).when(kind == "ip", m).when(kind == "name", name).when(kind == "phone", phone).otherwise(digits)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Luhn sum, modulo 10, of a string of digits."""
    n = F.length(digits)
    each = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """Canonical surrogate of a canonical value."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    # Where draws keep failing, a format's numbers are used up: every GROW draws make one digit more.
    more = F.floor(attempt / GROW).cast("int")
    digit = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) + more, F.lit(1))), lambda i: F.when(i == 1, 1 + _draw(seed, i, 9)).otherwise(_draw(seed, i, 10)).cast("string")), "")
    body = F.concat(F.substring(value, 1, 1), digit.substr(F.lit(2), F.greatest(F.length(value) + more - 2, F.lit(0))))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, F.when(_luhn(value) == 0, check).otherwise(_draw(seed, 99, 10).cast("string")))
    local = F.regexp_extract(value, "^[^@]*", 0)
    letters = F.array_join(
        F.transform(
            _chars(local),
            lambda c, i: F.when(c.rlike(r"\p{IsCyrillic}"), _pick(list("абвгдежиклмнопрст"), _draw(seed, i, 17)))
            .when(c.rlike(r"\p{L}"), _pick(list("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i, 26)))
            .when(c.rlike(r"\p{N}"), _draw(seed, i, 10).cast("string"))
            .otherwise(c),
        ),
        "",
    )
    host = F.array_join(F.transform(F.sequence(F.lit(100), F.lit(107)), lambda i: _pick(list("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i, 26))), "")
    email = F.concat(letters, F.lit("@"), host, F.lit(".example"))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), 3 + more), lambda k: F.when(k == 0, _draw(seed, k, 223) + 1).otherwise(_draw(seed, k, 256)).cast("string")), ".")

    def name(script: str) -> Column:
        given = F.when(value.startswith("f "), _pick(GIVEN[script, "f"], _draw(seed, 0, 16))).otherwise(_pick(GIVEN[script, "m"], _draw(seed, 0, 16)))
        # One syllable more for each new draw: the names to draw from never run out.
        last = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + attempt), lambda i: _pick(SYLLABLES[script], _draw(seed, i, 16))), "")
        return F.when(F.regexp_replace(value, "^[fm] ", "").contains(" "), F.concat(given, F.lit(" "), F.initcap(last))).otherwise(F.initcap(last))

    names = F.when(value.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "name", names).when(kind == "card", card).otherwise(digit)


def poured(kind: Column, m: Column, canon: Column) -> Column:
    """The surrogate in the mention's own format."""
    total = F.length(F.regexp_replace(m, r"\D", ""))
    spare = F.greatest(total - F.length(canon), F.lit(0))
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"\D", "")) - spare
    numbers = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c.rlike(r"\d") & (place(i) > 0), F.substring(canon, place(i), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(canon, total + 1, F.length(canon)))
    local = F.regexp_extract(m, "^[^@]*", 0)
    shaped = F.array_join(F.transform(_chars(local), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(canon, i + 1, F.lit(1)))).otherwise(F.substring(canon, i + 1, F.lit(1)))), "")
    email = F.concat(shaped, F.substring(canon, F.length(local) + 1, F.length(canon)))
    return F.when(kind == "email", email).when(kind == "ip", canon).when(kind == "name", F.concat(F.regexp_extract(m, TITLE, 0), canon)).otherwise(numbers)


def _found(text: Column) -> Column:
    """array<struct<m, kind, value>> of a text's entities in order; empty for a text without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), canonical(x["kind"], x["m"]).alias("value")))
    return F.when(text.rlike(HINT), found)


def redrawn(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Collision check over all distinct ``entities(kind, value)``: those that must draw again.

    Returns (kind, value, attempt), attempt > 0. Among entities with one surrogate the one with
    the lowest attempt, then value, keeps it; a surrogate that is a real value is never kept.
    Names, numbers and addresses grow as draws fail, so that there always are some left.
    """
    drawn = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("value").alias("s"), F.lit(True).alias("real"))
    while True:
        own = drawn.withColumn("s", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        first = own.groupBy("kind", "s").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n"))
        judged = own.join(first, ["kind", "s"]).join(real, ["kind", "s"], "left")
        lost = F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.col("first.value") != F.col("value")))
        moved = judged.where(lost).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        moved = materialize(moved, "redrawn")
        if moved.isEmpty():
            return drawn.where("attempt > 0")
        drawn = materialize(drawn.join(moved.withColumnRenamed("attempt", "next"), ["kind", "value"], "left").select("kind", "value", F.coalesce("next", "attempt").alias("attempt")), "drawn")


def surrogated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with each entity in ``text_col`` replaced, and a column ``entities`` of what was found.

    entities: array<struct<kind, surrogate>> in text order (named ``pii_entities`` where ``docs`` has
    a column of that name). Nulls: a null text stays null and has
    no entities; a null id is carried. Texts without entities are unchanged, byte for byte.
    Repeated rows are rewritten alike. An empty table stays empty. Other columns pass untouched.
    """
    text = F.col(text_col).cast("string")
    slim = F.struct(F.col(id_col).cast("long").alias("id"), text.alias("text")).alias("__d")
    base = docs.select(slim).where(F.col("__d.text").rlike(HINT)).select(identity("__d.id", "__d.text").alias("key"), "__d.text")
    mentions = base.select("key", F.explode(_found(F.col("text"))).alias("x")).select("key", F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))
    again = materialize(redrawn(materialize(mentions.select("kind", "value").distinct(), "entities"), key), "again")
    out = docs.withColumn("__found", _found(text))
    if again.isEmpty():
        attempt = lambda x: F.lit(0)
    else:
        held = mentions.join(again, ["kind", "value"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("__again"))
        held = materialize(held.select(F.col("key").alias("__k"), "__again"), "held")
        out = out.withColumn("__d", slim)
        out = out.join(held, identity("__d.id", "__d.text") == F.col("__k"), "left")
        attempt = lambda x: F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws("|", x["kind"], x["value"])), F.lit(0))
    fresh = F.transform("__found", lambda x: F.struct(x["kind"].alias("kind"), poured(x["kind"], x["m"], surrogate(x["kind"], x["value"], attempt(x), key)).alias("surrogate")))
    # The stretches between entities: found once, and only in texts that have any.
    joined = let(F.split(text, ANY, -1), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.zip_with("__entities", F.slice(p, 2, F.size("__entities")), lambda x, after: F.concat(x["surrogate"], after)), "")))
    rewritten = F.when(F.size(F.coalesce("__entities", F.array())) > 0, joined).otherwise(text)
    out = out.withColumn("__entities", F.coalesce(fresh, F.array().cast("array<struct<kind:string,surrogate:string>>")))
    return out.select(*[rewritten.alias(c) if c == text_col else quoted(c) for c in docs.columns], F.col("__entities").alias("entities" if "entities" not in docs.columns else "pii_entities"))
