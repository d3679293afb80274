"""Personal data replaced by surrogates (operator 9), with built-in functions only.

Every detected entity gets a replacement derived from a secret key and the entity's normal form: the
same entity always gets the same surrogate, in the format it was written in. Distinct
entities keep distinct surrogates: the dictionary of entities is checked for surrogates that two
entities share, or that occur in the corpus as real entities, and those are drawn again until none is left;
names, emails and secrets grow with the draws, the other formats after many, so that there are always enough. The parts of a name are
entities of their own, family names ("name") and given names of one gender ("given"), so that distinct names stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Titles and given names that tell a name (fixed values). The given names are also what surrogates are drawn from.
MALE_TITLES = "Mr|Herr|Señor|Sr|Monsieur|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа"
MALE_NAMES = tuple("""
Adam Alejandro Alexander Andreas Andrew Anthony Antonio Arthur Benjamin Bernard Bruno Carl Carlos Charles Christian Christopher
Daniel David Diego Dieter Dmitri Edward Emil Enrique Ernst Felix Fernando Francisco Frederick Friedrich George Georg Gerhard
Hans Heinrich Henri Henry Hugo Ivan Jacques James Javier Johannes John Jonas Jorge José Joseph Juan Julien Karl Klaus Leon Louis
Luis Martin Matthew Michael Michel Miguel Nicolas Nils Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert
Samuel Simon Stefan Stephen Thomas Walter Werner William Wolfgang
""".split())
FEMALE_NAMES = tuple("""
Adriana Alice Alma Amelia Ana Andrea Angela Anna Anne Barbara Beatriz Berta Carmen Caroline Catherine Charlotte Christine Clara
Claudia Cristina Diana Dorothea Eleanor Elena Elisabeth Elizabeth Emily Emma Flora Frieda Gabriela Gertrud Greta Hanna Hannah
Helen Helga Ingrid Irma Isabel Jane Jennifer Jessica Johanna Juana Julia Juliette Karin Klara Laura Lena Linda Louise Lucía Luisa
Margaret Margarete María Maria Marie Martha Mary Michelle Monika Nathalie Nora Olga Patricia Petra Pilar Rachel Rebecca Renate
Sabine Sarah Silvia Sofia Sophie Susan Susanne Teresa Ursula Valentina Victoria
""".split())
CYRILLIC_MALE = tuple("Александр Алексей Андрей Антон Борис Виктор Владимир Глеб Денис Дмитрий Егор Иван Игорь Кирилл Константин Лев Максим Марк Михаил Николай Олег Павел Сергей Юрий".split())
CYRILLIC_FEMALE = tuple("Алла Анастасия Анна Вера Виктория Галина Дарья Екатерина Елена Зоя Ирина Ксения Лидия Людмила Марина Мария Надежда Наталья Нина Ольга Полина Светлана Татьяна Юлия".split())
SYLLABLES = ("ba", "den", "for", "gal", "hol", "kin", "lor", "mar", "nel", "ros", "san", "ter", "vin", "wes", "zel", "tal")
CYRILLIC_SYLLABLES = ("ба", "дем", "фор", "гал", "хол", "кин", "лор", "мар", "нел", "рос", "сан", "тер")
#: Words in lower case that join the parts of a name, and stay as they are.
PARTICLES = ("van", "von", "vom", "zu", "zum", "zur", "der", "den", "de", "del", "della", "la", "du", "des", "di", "da", "do", "dos", "das", "ten", "ter", "bin", "ibn", "al", "el")
#: (type, pattern), the first that matches decides. No pattern has groups of its own.
_TITLE = rf"(?:{MALE_TITLES}|{FEMALE_TITLES})\.?"
#: A capitalised word with its hyphenated and apostrophe parts (but for 's), whole; what may stand before one: particles and initials.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|(?!['’][sS](?!\p{L}))['’-]\p{L})++"
_LINK = rf"(?:(?:{'|'.join(PARTICLES)}) |\p{{Lu}}\.?(?:-?\p{{Lu}}\.)*+ )*+"


def _given() -> str:
    """A given name of the lists, by first letters; no letter follows."""
    by = {}
    for name in sorted({*MALE_NAMES, *FEMALE_NAMES, *CYRILLIC_MALE, *CYRILLIC_FEMALE}, reverse=True):
        by.setdefault(name[0], []).append(name[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + r")(?![\p{L}\p{M}])"


GIVEN = _given()
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = (
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i)(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api_?key)(?-i)\s{0,3}[=:]\s{0,3}\"?[^\s\"'\]\[]{6,}+"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])\+(?=[1-9])(?:[ .()/-]{0,2}[0-9]){8,15}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])(?:[3-6][0-9]|2[2-7])[0-9]{2}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+(?![0-9A-Za-z])|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?<=[0-9][A-Z]{0,4})(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]{{6}})(?=[A-Fa-f:]*[0-9])(?!(?:[0-9A-Fa-f]*:){{8}}){_HEX}(?::{_HEX})*+::(?:{_HEX}(?::{_HEX})*+)?+)(?![0-9A-Za-z:])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_LINK}{_WORD}(?: {_LINK}{_WORD})*+"),
    ("name", rf"(?<![\p{{L}}\p{{N}}-]){GIVEN}(?:-{GIVEN})?+ {_LINK}{_WORD}(?: {_LINK}{_WORD})*+"),
)
TYPES = ("secret", "email", "phone", "card", "iban", "ip", "ipv6", "name")


#: Draws after which formats of fixed length get longer.
TAIL_AFTER = 12


def _let(value: Column, f) -> Column:
    """f(value), with value worked out and planned once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: No entity starts behind an ASCII letter or digit, so places inside words are passed over at once.
_ANY = rf"(?<![A-Za-z0-9])(?:{'|'.join(f'(?:{p})' for _, p in PATTERNS)})"


def type_of(piece: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(piece.rlike(rf"\A(?:{pattern})\z"), name).otherwise(kind)
    return kind


def entities_of(text: Column) -> Column:
    """The entities of a text in order, repeats included: (kind, piece)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), 0)
    return F.transform(found, lambda p: F.struct(type_of(p).alias("kind"), p.alias("piece")))


_digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
_value = lambda s: F.regexp_extract(s, r"(?s)\A(?:AKIA|[A-Za-z_]+\s*[=:]\s*\"?)(.*)\z", 1)
_bare = lambda s: F.regexp_replace(s, rf"\A{_TITLE} ", "")
#: Whether a phone number has a country code other than 1; such numbers are told by all their digits.
_abroad = lambda s: s.startswith("+") & ~_digits(s).rlike(r"\A1[0-9]{10}\z")


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, without leading zeros, in lower case."""
    some = lambda s: F.filter(F.split(s, ":", -1), lambda g: g != "")
    def of(halves: Column) -> Column:
        left, right = some(halves[0]), some(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        return F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)

    return F.transform(of(F.split(F.lower(address), "::", -1)), lambda g: F.regexp_replace(g, r"\A0+(?=.)", ""))


def normal(kind: Column, piece: Column) -> Column:
    """What an entity's surrogate depends on: not case, punctuation, country code 1, spaces or shortened groups. Names: see _parts."""
    phone = F.when(_abroad(piece), F.concat(F.lit("+"), _digits(piece))).otherwise(F.substring(_digits(piece), -10, 10))
    return (
        F.when(kind == "email", F.lower(piece)).when(kind == "phone", phone).when(kind == "card", _digits(piece))
        .when(kind == "iban", F.replace(piece, F.lit(" "))).when(kind == "ipv6", F.array_join(_groups(piece), ":"))
        .when(kind == "secret", _value(piece)).otherwise(piece)
    )


def _parts(piece: Column) -> Column:
    """The words of a name and their hyphenated parts: (kind, norm, part), norm null for particles. A given name's norm starts with the gender."""
    first = F.regexp_extract(piece, r"\A[\p{L}\p{M}]+", 0)
    gender = F.when(piece.rlike(rf"\A(?:{FEMALE_TITLES})\.? ") | (~piece.rlike(rf"\A{_TITLE} ") & first.isin(*FEMALE_NAMES, *CYRILLIC_FEMALE)), "f ").otherwise("m ")
    def of(words: Column) -> Column:
        last = F.size(words) - 1
        norm = lambda p, i: F.when(p.isin(*PARTICLES), None).otherwise(F.concat(F.when(i == last, "").otherwise(gender), F.translate(F.lower(p), "’.", "'")))
        part = lambda i: lambda p: F.struct(F.when(i == last, "name").otherwise("given").alias("kind"), norm(p, i).alias("norm"), p.alias("part"))
        return F.transform(words, lambda w, i: F.transform(F.split(w, "-", -1), part(i)))

    return _let(F.split(_bare(piece), " ", -1), of)


def _hash(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), norm), 256)


def _number(hex_: Column, at: Column | int, width: int = 4) -> Column:
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(hex_, start + 1, F.lit(width)), 16, 10).cast("long")


def _like(s: Column, hex_: Column) -> Column:
    """s with every letter and digit replaced by one of its kind and script, drawn by place."""
    def draw(c: Column, i: Column) -> Column:
        n = _number(hex_, (i * 3) % 61, 3) + i * 7
        letter = lambda first, count: F.chr((n % count + first))
        code = F.ascii(c)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter(97, 26)).when(c.rlike("[A-Z]"), letter(65, 26))
            .when((code >= 0x430) & (code < 0x450), F.element_at(F.split(F.lit("абвгдежзийклмнопрстуфхцчшщыьэюя"), ""), (n % 31 + 1).cast("int")))
            .when((code >= 0x3B1) & (code < 0x3CA), F.element_at(F.split(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), ""), (n % 24 + 1).cast("int")))
            .when(c.rlike(r"\p{Lu}"), letter(65, 26)).when(c.rlike(r"\p{L}"), letter(97, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), draw), "")


def _filled(form: Column, new: Column, skip: Column, which: str = "[0-9]") -> Column:
    """form with its digits (characters `which`), but for the first `skip`, replaced by those of new in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    def step(s: Column, c: Column) -> Column:
        mine = c.rlike(which)
        other = F.when(mine & (s["k"] >= skip), F.substr(new, s["k"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], other).alias("out"), (s["k"] + mine.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _checked(country: Column, rest: Column) -> Column:
    """An IBAN of the country and the account, with its check digits."""
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(F.concat(rest, country), ""), F.lit(0), lambda m, c: ((m * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97).cast("int"))
    return F.concat(country, F.lpad((98 - (left * 100) % 97).cast("string"), 2, "0"), rest)


def _luhn(digits: Column) -> Column:
    """The 15 digits with their check digit."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + _luhn_part(F.substr(digits, i, F.lit(1)).cast("int"), i))
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _luhn_part(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d).cast("int")


def core(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, before it takes the format of a mention. Equal cores are a collision."""
    drawn = F.struct(kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt"), _hash(key, kind, norm, attempt).alias("h"))
    return _let(drawn, lambda x: _core(x["kind"], x["norm"], x["attempt"], x["h"]))


def _core(kind: Column, norm: Column, attempt: Column, h: Column) -> Column:
    num = F.translate(h, "abcdef", "036925")
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    def syllables(n: Column) -> Column:
        at = F.slice(F.sequence(F.lit(0), F.lit(15)), 1, F.least(n, F.lit(16)))
        return F.array_join(F.transform(at, lambda i: F.when(cyrillic, pick(CYRILLIC_SYLLABLES, _number(h, i * 4))).otherwise(pick(SYLLABLES, _number(h, i * 4)))), "")

    female = norm.startswith("f ")
    first = F.when(cyrillic, F.when(female, pick(CYRILLIC_FEMALE, _number(h, 60))).otherwise(pick(CYRILLIC_MALE, _number(h, 60)))).otherwise(F.when(female, pick(FEMALE_NAMES, _number(h, 60))).otherwise(pick(MALE_NAMES, _number(h, 60))))
    more = F.substring(F.translate(h, "0123456789", "ghijklmnop"), 1, F.greatest(attempt - 1, F.lit(0)))
    # formats of fixed length get a tail once many draws have failed: they are nearly used up
    tail = F.when(attempt > TAIL_AFTER, F.concat(F.lit("x"), F.substring(num, 17, F.least(attempt - TAIL_AFTER + 2, F.lit(40))))).otherwise("")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    zone = F.substring_index(domain, ".", -1)
    site = F.length(domain) - F.length(zone)
    hexes = lambda i: F.lower(F.conv((_number(h, i * 6, 6) % 65535 + 1).cast("string"), 10, 16))
    return (
        F.when(kind == "email", F.concat(_like(local, h), more, F.lit("@"), _like(F.substr(domain, F.lit(1), site), F.reverse(h)), zone))
        .when((kind == "phone") & norm.startswith("+"), F.concat(F.substring(norm, 1, 3), F.substr(num, F.lit(1), F.length(norm) - 3), tail))
        .when(kind == "phone", F.concat(F.translate(F.substring(num, 1, 1), "01", "28"), F.substring(num, 2, 9), tail))
        .when(kind == "card", F.concat(_luhn(F.concat(F.substring(norm, 1, 1), F.substring(num, 1, 14))), tail))
        .when(kind == "iban", F.concat(_checked(F.substring(norm, 1, 2), _like(F.substr(norm, F.lit(5)), h)), tail))
        .when(kind == "ip", F.concat(F.concat_ws(".", *((_number(h, i * 6, 6) % 254 + 1).cast("string") for i in range(4))), tail))
        .when(kind == "ipv6", F.concat(F.array_join(F.transform(F.split(norm, ":"), lambda g, i: F.when(g == "0", g).otherwise(hexes(i))), ":"), tail))
        .when(kind == "name", F.concat(syllables(4 + attempt), F.when(cyrillic, "ов").otherwise("")))
        .when(kind == "given", F.concat(F.substring(norm, 1, 2), F.lower(first), syllables(2 * attempt)))
        .otherwise(F.concat(_like(norm, h), more))
    )


def surrogate(key: str, kind: Column, piece: Column, attempt) -> Column:
    """The replacement for one mention of an entity, in the mention's format, script and gender; attempt(kind, norm): how often it was drawn again."""
    def of(x: Column) -> Column:
        other = _let(core(key, x["kind"], x["norm"], attempt(x["kind"], x["norm"])), lambda new: _formatted(x["kind"], x["piece"], new))
        return F.when(x["kind"] == "name", _renamed(key, x["piece"], attempt)).otherwise(other)

    with_norm = lambda k: F.struct(k.alias("kind"), piece.alias("piece"), normal(k, piece).alias("norm"))
    return _let(_let(kind, with_norm), of)


def _renamed(key: str, piece: Column, attempt) -> Column:
    new = lambda p: F.initcap(F.substring_index(core(key, p["kind"], p["norm"], attempt(p["kind"], p["norm"])), " ", -1))
    words = F.transform(_parts(piece), lambda word: F.array_join(F.transform(word, lambda p: F.when(p["norm"].isNull(), p["part"]).otherwise(new(p))), "-"))
    return F.concat(F.regexp_extract(piece, rf"\A({_TITLE} )", 1), F.array_join(words, " "))


def _formatted(kind: Column, piece: Column, core_: Column) -> Column:
    new, tail = F.substring_index(core_, "x", 1), F.regexp_extract(core_, "x([0-9]+)$", 1)
    more = lambda sign: F.when(tail != "", F.concat(F.lit(sign), tail)).otherwise("")
    kept = F.when(_abroad(piece), F.lit(2)).otherwise(F.length(_digits(piece)) - 10)
    digits = F.when(_abroad(piece), F.substr(new, F.lit(4))).otherwise(new)
    halves = F.split(piece, "::", -1)
    count = lambda s: F.size(F.filter(F.split(s, ":", -1), lambda g: g != ""))
    groups = F.split(new, ":")
    short = F.concat(F.array_join(F.slice(groups, F.lit(1), count(halves[0])), ":"), F.lit("::"), F.array_join(F.slice(groups, 9 - count(F.try_element_at(halves, F.lit(2))), count(F.try_element_at(halves, F.lit(2)))), ":"))
    return (
        F.when(kind == "phone", F.concat(_filled(piece, digits, kept), more(" x"))).when(kind == "card", F.concat(_filled(piece, new, F.lit(0)), more("-")))
        .when(kind == "iban", F.concat(_filled(piece, new, F.lit(0), "[0-9A-Z]"), more("-"))).when(kind == "ip", F.concat(new, more(":")))
        .when(kind == "ipv6", F.concat(F.when(F.size(halves) > 1, short).otherwise(new), more("%")))
        .when(kind == "secret", F.concat(F.substr(piece, F.lit(1), F.length(piece) - F.length(_value(piece))), core_))
        .otherwise(core_)
    )


def _norms(found: Column) -> Column:
    """The (kind, norm) of the entities found, each once."""
    named = lambda p: F.transform(F.filter(F.flatten(_parts(p)), lambda x: x["norm"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["norm"].alias("norm")))
    of = lambda e: F.when(e["kind"] == "name", named(e["piece"])).otherwise(F.array(F.struct(e["kind"].alias("kind"), normal(e["kind"], e["piece"]).alias("norm"))))
    return F.array_distinct(F.flatten(F.transform(found, of)))


def redrawn(entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt) of the entities whose first surrogate is not theirs alone; None if there are none."""
    words = written(entities.distinct().withColumn("attempt", F.lit(0)), "entities")
    own = words.select("kind", F.col("norm").alias("core"))
    changed = False
    while True:
        drawn = words.withColumn("core", core(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        # of those that share a surrogate, one keeps it, unless it's real: the one drawn first, then the smallest
        keeps = drawn.groupBy("kind", "core").agg(F.min(F.struct("attempt", "norm")).alias("first")).join(own, ["kind", "core"], "left_anti")
        keeps = keeps.select("kind", F.col("first.norm").alias("norm"), F.lit(0).alias("again"))
        judged = written(words.join(keeps, ["kind", "norm"], "left").select("kind", "norm", "attempt", F.coalesce("again", F.lit(1)).alias("again")), "entities")
        if judged.where("again > 0").isEmpty():
            return words.where("attempt > 0") if changed else None
        changed = True
        words = judged.select("kind", "norm", (F.col("attempt") + F.col("again")).alias("attempt"))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity in text replaced by its surrogate, and n_<type> columns of the mentions.

    Types: secret, email, phone (also abroad), card, iban, ip, ipv6, name (after a title or with a known given name). Whole texts
    count. A null text stays null and an empty one empty, both with counts 0; repeated rows get equal results; all other columns are
    kept, whatever their names, and existing columns n_<type> replaced; an empty table gives an empty table. The same key gives the same surrogates.
    A secret runs to the next blank, quote or square bracket, however long; a name takes all capitalised, hyphenated and apostrophe
    parts, initials and particles that follow, each after one blank. A format that is nearly used up gets longer (phone x17, ip:170).

    Texts are searched once; what is found goes with them to a table, from which the dictionary of entities and the new texts are made.
    """
    docs = docs.drop(*(f"n_{t}" for t in TYPES))
    columns, others = docs.columns, [c for c in docs.columns if c != text]
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = written(docs.select(*rest, F.col(text).alias("text"), entities_of(F.col(text)).alias("found")), "entities-found")
    some = rows.where(F.size("found") > 0).select(F.xxhash64("text").alias("h"), F.explode(_norms(F.col("found"))).alias("e"))
    mentions = some.select("h", "e.kind", "e.norm").distinct()
    again = redrawn(mentions.select("kind", "norm"), key)
    if again is None:
        attempt = lambda kind, norm: F.lit(0)
    else:
        # only texts with such an entity get a map of theirs
        maps = mentions.join(again, ["kind", "norm"]).groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "norm").alias("k"), F.col("attempt").alias("v")))).alias("again"))
        with_some, without = rows.where(F.size("found") > 0), rows.where(F.size("found") == 0)
        rows = with_some.join(maps, F.xxhash64("text") == F.col("h"), "left").drop("h").unionByName(without, allowMissingColumns=True)
        attempt = lambda kind, norm: F.coalesce(F.try_element_at("again", F.concat_ws(" ", kind, norm)), F.lit(0))
    new = F.transform("found", lambda e: surrogate(key, e["kind"], e["piece"], attempt))
    # the text between entities: one piece more than there are entities
    between = F.split("text", _ANY, -1)
    changed = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.when(F.size("found") > 0, changed).otherwise(F.col("text"))
    mentioned = lambda t: F.size(F.filter("found", lambda e: e["kind"] == t)).cast("long").alias(f"n_{t}")
    named = {text: changed} | {c: F.col("rest").getField(c) for c in others}
    return rows.select(*(named[c].alias(c) for c in columns), *map(mentioned, TYPES))
