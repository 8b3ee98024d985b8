"""Replace personal data and secrets by keyed surrogates of the same type, format, script and gender.

Detection is one alternation of patterns per text. A match is an entity, as normalised, in a dress of marks, spaces and
case; a surrogate is a function of the key, the type and the entity, and is put into the same dress, so that one entity
has one surrogate in the whole corpus however it is spelt (coreference). A name's entities are its parts: a given name
(with the gender that its honorific shows) and a surname; once a text names someone with an honorific, the bare full
name and the bare surname are mentions of that name too.

Distinct entities of a type must keep distinct surrogates, and none may equal an entity that occurs: all entities are
gathered once, those that clash get another attempt number, again and again until none clashes. Later attempts draw
from ever larger sets, so that this ends. All of it is DataFrame expressions, on the main path too.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, spread, stash

# Honorifics by the gender they show; n shows none. A dot may follow.
HONORIFICS = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Signora", "г-жа", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Κύριος"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Mx"),
}
_TITLES = "|".join(sorted((x for v in HONORIFICS.values() for x in v), key=lambda x: (-len(x), x)))
TITLE = rf"(?:(?:{_TITLES})\.?[  ])"
# What comes before a secret: a keyword, alone or in a longer name of a variable, quoted as in JSON or not.
NAMED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)(?i:(?:[_-](?:access|auth|api))?[_-](?:key|token|value))?[\"']?\s?[=:]\s?"
# Patterns of the types, tried in this order at each position. No pattern holds a group that captures, and
# none repeats a group without a bound, for such a repeat takes stack by the text's length. A domain has 127 labels at
# most. A value of masking marks only is no secret.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "secret": rf"(?<![A-Za-z0-9]){NAMED}" r"(?!\"?[*•.#_xX-]+\"?(?:\s|$))(?:\"[^\"\s]{6,}\"|[^\s\"]{6,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])(?:\d{4}[ -]?){3}\d{4}(?![\d.]\d|\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\d(+])\+\d{1,3}(?: (?!(?:\d{1,3}\.){3}\d)|[.-]?)\(?\d{2,4}\)?(?:(?: (?!(?:\d{1,3}\.){3}\d)|[.-]?)\d{2,4}){2,3}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}}){TITLE}{{1,3}}\p{{Lu}}\p{{L}}+(?:[- ]\p{{Lu}}\p{{L}}+){{0,2}}",
}
# Telephone country codes of two digits; 1 and 7 have one digit, all others three.
COUNTRY_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# Given names by script and gender; the first surrogate of a given name comes from its own list.
GIVEN = {
    ("latin", "f"): ("Alice", "Anna", "Bella", "Carla", "Clara", "Diana", "Elena", "Emma", "Flora", "Greta", "Hanna", "Ida", "Julia", "Klara", "Laura", "Lena", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "Albert", "Anton", "Bruno", "Carlo", "Daniel", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leon", "Lukas", "Martin", "Nils", "Oskar", "Paul", "Robert", "Simon", "Tomas", "Viktor"),
    ("latin", "n"): ("Alex", "Ariel", "Chris", "Dana", "Jamie", "Kim", "Luca", "Mika", "Noel", "Robin", "Sam", "Sascha", "Terry", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София", "Юлия"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Максим", "Олег", "Павел", "Роман"),
    ("cyrillic", "n"): ("Валя", "Женя", "Саша", "Шура"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος", "Σταύρος"),
    ("greek", "n"): ("Αλέξ", "Κρις"),
}
# Syllables of invented names, by script, and the ending of invented given names by script and gender.
SYLLABLES = {
    "latin": ("bar", "bel", "cor", "dal", "den", "fal", "gar", "hol", "kel", "lan", "mar", "mel", "nor", "pel", "ran", "sel", "tar", "ten", "val", "ver"),
    "cyrillic": ("бар", "вел", "гор", "дал", "жен", "кал", "лан", "мар", "нов", "пол", "рад", "сел", "тар", "чер"),
    "greek": ("βαλ", "γαρ", "δελ", "καλ", "λαν", "μαρ", "νελ", "παλ", "ραν", "σελ", "ταρ"),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("latin", "n"): "y", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ин", ("cyrillic", "n"): "о", ("greek", "f"): "α", ("greek", "m"): "ος", ("greek", "n"): "ι"}
_STARTS = {"key": "(?=[Ags])", "secret": "(?=[AaPpSsTt])", "iban": "(?=[A-Z])", "name": f"(?=[{''.join(sorted({x[0] for v in HONORIFICS.values() for x in v}))}])"}
_WORDY = "|".join(f"{_STARTS.get(k, '')}(?:{PATTERNS[k]})" for k in ("email", "key", "secret", "iban", "name"))
# All patterns; what begins with a letter follows none, so that most places are passed by one look.
ANY = rf"(?<![A-Za-z])(?:{_WORDY})|(?=[\d(+])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in ('card', 'ssn', 'ip', 'phone'))})"
LAST = 12  # from this attempt on a surrogate has ten more digits than its entity


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once: an expression in a lambda is evaluated wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 256)


def _number(hexes: Column, at: int, mod: int) -> Column:
    """Eight hex digits of a digest, from place `at` of eight, as a number below mod."""
    return F.pmod(F.conv(F.substring(hexes, at * 8 + 1, 8), 16, 10).cast("long"), F.lit(mod))


def _pick(values: Column, n: Column) -> Column:
    return F.get(values, F.pmod(n, F.size(values)).cast("int"))


def _words(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ")  # one literal, so that plans stay small


def _cases(cases: dict, fits: Callable) -> Column:
    """CASE over a table: the value of the first key that fits; null if none does."""
    out = None
    for k, v in cases.items():
        out = F.when(fits(k), v) if out is None else out.when(fits(k), v)
    return out


# --- types and entities -------------------------------------------------------------------------------------------


def _luhn_sum(digits: Column) -> Column:
    """Sum of a text's digits, those at even places from 0 doubled and nine less if above nine."""
    d = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, a capital counting as two digits from A = 10."""
    code = lambda c: F.ascii(c).cast("int")
    step = lambda s, c: F.when(c == "", s).when(code(c) >= 65, (s * 100 + code(c) - 55) % 97).otherwise((s * 10 + code(c) - 48) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def kind_of(m: Column) -> Column:
    """The type of a match: the first whose pattern fits all of it; none where 16 digits are no card by their check digit."""
    first = _cases({k: F.lit(k) for k in PATTERNS}, lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")).otherwise("name")
    card = _luhn_sum(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0
    return _let(first, lambda kind: F.when((kind != "card") | card, kind))


def normal(kind: Column, m: Column) -> Column:
    """What must agree for two mentions to be of one entity. A secret's entity is its value, a name's its name without honorifics."""
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "secret", F.regexp_replace(m, rf"^{NAMED}\"?|\"$", ""))
        .when(kind.isin("card", "ssn", "iban"), F.regexp_replace(m, r"[^0-9A-Za-z]", ""))
        .when(kind == "phone", F.regexp_replace(m, r"[^0-9+]", ""))
        .when(kind == "name", F.regexp_replace(m, f"^{TITLE}+", ""))
        .otherwise(m)
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    fits = lambda g: m.rlike(rf"(?<!\p{{L}})(?:{'|'.join(HONORIFICS[g])})\.?[  ]")
    return F.when(fits("f"), "f").when(fits("m"), "m").otherwise("n")


def _parts(norm: Column, gender: Column) -> Column:
    """Entities of a name: kind and norm of each part; the last is the surname."""
    words = F.split(norm, " ")
    kind = lambda p, i: F.when(i + 1 == F.size(words), F.concat(F.lit("surname:"), _script(p))).otherwise(F.concat(F.lit("given:"), _script(p), F.lit(":"), gender))
    return F.transform(words, lambda p, i: F.struct(kind(p, i).alias("kind"), F.lower(p).alias("norm")))


def found_in(text: Column) -> Column:
    """struct(found, pattern): all matches in a text, an array of kind, norm, m, gender (kind null: no entity), and the
    pattern that splits the text at them, null for ANY. No matches in a null text.

    A text with names by honorific is gone through again, with its own names without honorific as further patterns.
    """
    surname = lambda n: F.element_at(F.split(n, " "), -1)

    def named(matches: Column) -> Column:
        titled = F.filter(matches, lambda m: m.rlike(f"^{TITLE}") & (kind_of(m) == "name"))
        return F.transform(titled, lambda m: F.struct(_gender(m).alias("gender"), normal(F.lit("name"), m).alias("norm")))

    def again(names: Column) -> Column:
        bare = F.flatten(F.transform(names, lambda n: F.array(n["norm"], surname(n["norm"]), F.upper(n["norm"]), F.upper(surname(n["norm"])))))
        longest = F.transform(F.array_sort(F.transform(F.array_distinct(bare), lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b")))), lambda s: s["b"])
        pattern = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        every = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m")))

        def resolved(e: Column) -> Column:
            norm = normal(e["kind"], e["m"])
            shown = F.filter(names, lambda n: (F.lower(n["norm"]) == F.lower(norm)) & (n["gender"] != "n"))
            gender = F.when(e["kind"] == "name", F.when(_gender(e["m"]) != "n", _gender(e["m"])).otherwise(F.coalesce(F.get(shown, F.lit(0))["gender"], F.lit("n"))))
            return F.struct(e["kind"].alias("kind"), norm.alias("norm"), e["m"].alias("m"), gender.alias("gender"))

        return F.struct(F.transform(every, resolved).alias("found"), pattern.alias("pattern"))

    def plain(matches: Column) -> Column:
        def one(m: Column) -> Column:
            return _let(kind_of(m), lambda k: F.struct(k.alias("kind"), normal(k, m).alias("norm"), m.alias("m"), F.lit(None).cast("string").alias("gender")))

        return F.struct(F.transform(matches, one).alias("found"), F.lit(None).cast("string").alias("pattern"))

    first = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return _let(first, lambda matches: _let(named(matches), lambda names: F.when(F.size(names) > 0, again(names)).otherwise(plain(matches))))


# --- surrogates ---------------------------------------------------------------------------------------------------


# The letters that replace those of a script, by the pattern of the letters replaced, tried in this order.
ALPHABETS = {
    r"^[0-9]$": "0123456789",
    r"^[A-Z]$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"^[a-z]$": "abcdefghijklmnopqrstuvwxyz",
    r"^[\p{IsCyrillic}&&\p{Lu}]$": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"^\p{IsCyrillic}$": "абвгдежзиклмнопрстуфхцчшэюя",
    r"^[\p{IsGreek}&&\p{Lu}]$": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"^\p{IsGreek}$": "αβγδεζηθικλμνξοπρστυφχψω",
    r"^\p{Lu}$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"^\p{L}$": "abcdefghijklmnopqrstuvwxyz",
}


def _shaped(value: Column, stream: Column) -> Column:
    """value with each letter and digit replaced by another of its class and script; the rest stays. Linear in its length.

    The i-th character takes the i-th two hex digits of the stream; accented Latin and other letters become plain ones,
    letters of hex numbers stay among the first six.
    """

    def step(c: Column, i: Column, hexes: Column) -> Column:
        n = F.conv(F.substring(stream, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 96).cast("int")
        letters = _cases({p: F.lit(v) for p, v in ALPHABETS.items()}, lambda p: c.rlike(p))
        many = lambda v: F.when(hexes & (F.length(v) == 26), 6).otherwise(F.length(v))
        return _let(letters, lambda v: F.coalesce(F.substring(v, F.pmod(n, many(v)).cast("int") + 1, F.lit(1)), c))

    return _let(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), lambda hexes: F.array_join(F.transform(F.split(value, ""), lambda c, i: step(c, i, hexes)), ""))


def _syllables(script: Column, d: Column, count: Column) -> Column:
    """So many syllables of a script, the first with a capital."""
    values = _cases({s: _words(v) for s, v in SYLLABLES.items()}, lambda s: script == s)
    number = lambda i: F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return _let(values, lambda v: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(8), count) - 1), lambda i: _pick(v, number(i))), "")))


def surrogate(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity, normalised like its entity: put into a mention's dress by `dressed`.

    The types of names are given:script:gender and surname:script, their norms are lower-case parts; their surrogates
    begin with a capital.
    """
    word = F.split(kind, ":")
    script, gender = F.get(word, F.lit(1)), F.get(word, F.lit(2))
    code = F.when(~norm.startswith("+"), 0).when(F.substring(norm, 2, 1).isin("1", "7"), 2).when(F.substring(norm, 2, 2).isin(*COUNTRY_CODES), 3).otherwise(4)
    kept = F.when(kind == "key", 4).when(kind == "card", 1).when(kind == "iban", 4).when(kind == "phone", code).otherwise(0)
    body = F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "card", F.substring(norm, 2, 14)).otherwise(F.substr(norm, kept + 1))
    free = F.length(F.regexp_replace(norm, r"[^\p{L}\p{N}]", "")) >= 6  # else too little of a secret would change

    def name(d: Column) -> Column:
        listed = _cases({k: _words(v) for k, v in GIVEN.items()}, lambda k: F.concat_ws(":", script, gender) == ":".join(k))
        ending = _cases({k: F.lit(v) for k, v in ENDINGS.items()}, lambda k: F.concat_ws(":", script, gender) == ":".join(k))
        more = F.floor(attempt / 2).cast("int")
        return F.when((word[0] == "given") & (attempt == 0), _pick(listed, _number(d, 0, 1 << 31))).otherwise(
            F.concat(_syllables(script, d, F.when(word[0] == "given", 2 + more).otherwise(4 + more)), F.when(word[0] == "given", ending).otherwise(""))
        )

    def coded(d: Column, new: Column) -> Column:
        country = F.substring(norm, 1, 2)
        card = F.concat(F.substring(norm, 1, 1), new)
        return (
            F.when(kind == "email", F.concat(new, F.lit("@"), F.substring(d, 1, 6), F.lit(".example.org")))
            .when((kind == "secret") & ~free, F.substring(d, 1, 12))
            .when(kind == "iban", F.concat(country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new))
            .when(kind == "card", F.concat(card, F.pmod(10 - _luhn_sum(card), F.lit(10)).cast("string")))
            .otherwise(F.concat(F.substr(norm, F.lit(1), kept), new))
        )

    def made(d: Column) -> Column:
        octets = F.concat_ws(".", F.when(attempt < 4, "10").otherwise((_number(d, 3, 223) + 1).cast("string")), *[_number(d, i, 256).cast("string") for i in range(3)])
        stream = F.concat(d, _digest(key, d, F.lit("1")), _digest(key, d, F.lit("2")))
        other = _let(stream, lambda s: _let(_shaped(body, s), lambda new: coded(d, new)))
        return F.when(word[0].isin("given", "surname"), name(d)).when(kind == "ip", octets).otherwise(other)

    def longer(d: Column) -> Column:
        digits = F.when(attempt >= LAST, F.lpad(F.pmod(F.conv(F.substring(d, 20, 12), 16, 10).cast("long"), F.lit(10**10)).cast("string"), 10, "0")).otherwise("")
        return _let(made(d), lambda new: F.when(kind == "email", F.concat(digits, new)).otherwise(F.concat(new, digits)))

    return _let(_digest(key, kind, norm, attempt.cast("string")), longer)


def dressed(kind: Column, m: Column, new: Column) -> Column:
    """A surrogate with the marks, spaces and keyword of match m."""
    digits = F.when(kind == "phone", "^[0-9+]$").otherwise("^[0-9A-Za-z]$")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        own = F.regexp_like(c, digits)
        return F.struct((acc["i"] + own.cast("int")).alias("i"), F.concat(acc["s"], F.when(own, F.substr(new, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    spaced = F.aggregate(F.split(m, ""), start, step, lambda acc: F.concat(acc["s"], F.substr(new, acc["i"] + 1)))  # of bounded types only
    quoted = F.concat(F.regexp_extract(m, rf"^({NAMED}\"?)", 1), new, F.when(m.endswith('"'), '"').otherwise(""))
    return F.when(kind == "secret", quoted).when(kind.isin("card", "ssn", "iban", "phone"), spaced).otherwise(new)


def settle(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, norm), one row each, with the attempts at which all surrogates are distinct and new."""
    now = stash(entities.withColumn("attempt", F.lit(0)), "pii-entities")
    for _ in itertools.count():
        cand = now.withColumn("cand", F.lower(surrogate(F.col("kind"), F.col("norm"), key, F.col("attempt"))))
        shelf = F.when(F.col("kind").startswith("given:"), "given").otherwise(F.substring_index("kind", ":", 1))
        order = W.partitionBy("shelf", "cand").orderBy("attempt", "kind", "norm")
        own = now.select(shelf.alias("k"), F.lower("norm").alias("n")).distinct()
        checked = (
            cand.withColumn("shelf", shelf)
            .withColumn("later", F.row_number().over(order) > 1)
            .join(own, (F.col("shelf") == F.col("k")) & (F.col("cand") == F.col("n")), "left")
            .select("kind", "norm", "attempt", (F.col("later") | F.col("n").isNotNull()).alias("clash"))
        )
        checked = stash(checked, "pii-entities")
        now = checked.select("kind", "norm", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
        if checked.where("clash").isEmpty():
            return now


def replace_pii(docs: DataFrame, *, key: str, text: str = "text", inline: int = 1000) -> DataFrame:
    """docs with `text` rewritten, and pii_count (matches) and pii_kinds (sorted distinct types).

    Null and empty texts stay as they are, with count 0. Repeated rows are rewritten alike. Other columns are kept; an
    input column named pii_count or pii_kinds is replaced. An empty table gives an empty result. Texts may be of any
    length. 16 digits that fail a card's check are no entity, nor are masked secrets. A name is found by its honorific;
    a name that no text has with an honorific is not found.

    Texts are searched once and kept with their matches, and rewritten from those. Of the entities that need a second
    attempt, up to `inline` are held in the expression; beyond that texts with matches are joined with theirs.
    """
    found, row, tried = free_names(docs, "found", "row", "tried")
    base = stash(spread(docs.drop("pii_count", "pii_kinds")).withColumns({found: found_in(F.col(text)), row: F.monotonically_increasing_id()}), "pii-found")
    matches = F.col(f"{found}.found")
    parts = lambda f: F.when(f["kind"] == "name", _parts(f["norm"], f["gender"])).otherwise(F.array(F.struct(f["kind"].alias("kind"), f["norm"].alias("norm"))))
    each = lambda c: F.flatten(F.transform(F.filter(c, lambda f: f["kind"].isNotNull()), parts))
    entities = base.select(F.explode(each(matches)).alias("e")).select("e.kind", "e.norm").distinct()
    again = settle(entities, key).where("attempt > 0").select(F.concat_ws(":", "kind", "norm").alias("e"), "attempt")
    few = again.limit(inline + 1).collect()
    if not few:
        attempts = F.lit(None).cast("map<string,int>")
    elif len(few) <= inline:
        attempts = F.create_map(*[F.lit(x) for r in few for x in (r["e"], r["attempt"])])
    else:
        per_row = (
            base.select(row, F.explode(each(matches)).alias("e"))
            .select(row, F.concat_ws(":", "e.kind", "e.norm").alias("e"))
            .join(again, "e")
            .groupBy(row)
            .agg(F.map_from_entries(F.collect_set(F.struct("e", "attempt"))).alias(tried))
        )
        base = base.where(F.size(matches) > 0).join(per_row, row, "left").unionByName(base.where(~F.coalesce(F.size(matches) > 0, F.lit(False))), allowMissingColumns=True)
        attempts = F.col(tried)

    def made(kind: Column, norm: Column) -> Column:
        return _let(F.coalesce(F.try_element_at(attempts, F.concat_ws(":", kind, norm)), F.lit(0)), lambda attempt: surrogate(kind, norm, key, attempt))

    def name(f: Column) -> Column:
        new = F.transform(_parts(f["norm"], f["gender"]), lambda p: made(p["kind"], p["norm"]))
        cased = F.zip_with(F.split(f["norm"], " "), new, lambda o, n: F.when((o == F.upper(o)) & (F.length(o) > 1), F.upper(n)).otherwise(n))
        return F.concat(F.regexp_extract(f["m"], f"^({TITLE}*)", 1), F.array_join(cased, " "))

    def new(f: Column) -> Column:
        return F.when(f["kind"].isNull(), f["m"]).when(f["kind"] == "name", name(f)).otherwise(dressed(f["kind"], f["m"], made(f["kind"], f["norm"])))

    between = F.split(F.col(text), F.coalesce(F.col(f"{found}.pattern"), F.lit(ANY)), -1)
    joined = F.array_join(F.zip_with(between, F.transform(matches, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    real = F.filter(F.coalesce(matches, F.array().cast("array<struct<kind:string,norm:string,m:string,gender:string>>")), lambda f: f["kind"].isNotNull())
    out = base.withColumns({text: F.when(F.size(matches) > 0, joined).otherwise(F.col(text)), "pii_count": F.size(real), "pii_kinds": F.array_sort(F.array_distinct(F.transform(real, lambda f: f["kind"])))})
    return out.drop(found, row, tried)
