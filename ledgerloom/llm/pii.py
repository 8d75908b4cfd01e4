"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns: e-mail addresses, IPv4 addresses, payment cards and other long numbers, phone and social
security numbers, bank accounts, access tokens, and names that follow a title or a cue ("my name is", "Dear") or begin with a listed given
name. Each gets a replacement that a key and the entity's normal form determine: characters keep their class (digit, lower, upper,
hexadecimal) and separators their places, cards that pass the check-digit rule still do, address bytes stay valid, names keep
script and case, given names gender where a title or the list tells it (else a neutral one), titles stay. A person's words are replaced one by
one, so "Frau Keller" and "Anna Keller" keep a common family name. So equal entities, also in other spellings, stay
equal across all documents (coreference).

Distinctness is checked over the corpus: replacements that two entities share, or that are themselves an entity of the
corpus, are drawn again for all but the smallest entity, round by round, and only these. As attempts go on
replacements grow by further characters, so there is always room for one more. The exceptions, rarely any, are looked up in hash sets up to
EXCEPTIONS of them, and joined beyond.

Defined cases: null and empty texts have no entities and stay; equal texts get equal results; a table without entities is returned as it is;
columns of any name are kept; an address has at most 126 labels of 63 characters, what is longer is none; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Given names by gender and script, for detection and replacement.
GIVEN = {
    "f": ["Alice", "Anna", "Barbara", "Carmen", "Claire", "Elena", "Emma", "Greta", "Ingrid", "Julia", "Karen", "Laura", "Linda", "Maria", "Marie", "Mary", "Nina", "Olivia", "Sarah", "Sofia"],
    "m": ["Adam", "Carlos", "Daniel", "David", "Erik", "Felix", "Hans", "Henri", "Jack", "James", "John", "Karl", "Lucas", "Marco", "Michael", "Oliver", "Paul", "Peter", "Robert", "Thomas"],
    "n": ["Alex", "Chris", "Jamie", "Kim", "Robin", "Sam", "Sasha", "Toni"],
    "fc": ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    "mc": ["Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
    "nc": ["Женя", "Саша", "Слава", "Шура"],
}
#: First letters, vowels and last letters of the syllables of made-up names, and endings of given names by gender.
SCRIPTS = {
    "Latin": ("bdfghjklmnprstvz", "aeiou", ["", "l", "m", "n", "r", "s", "t", "k"], {"f": ["a", "ia", "ina", "ela"], "m": ["o", "an", "us", "ik"], "n": ["i", "e", "en", "is"]}),
    "Cyrillic": ("бвгджзклмнпрстфх", "аеиоу", ["", "л", "м", "н", "р", "с", "т", "к"], {"f": ["а", "ия", "ина", "ела"], "m": ["ан", "ор", "ик", "ей"], "n": ["и", "е", "ю", "о"]}),
    "Greek": ("βγδζθκλμνξπρστφχ", "αειου", ["", "λ", "μ", "ν", "ρ", "σ", "τ", "κ"], {"f": ["α", "ια", "ινα", "ελα"], "m": ["ος", "ας", "ης", "ις"], "n": ["ι", "ο", "υ", "ε"]}),
    "Armenian": ("բգդզթլխկհմնպռստր", "աեիոու", ["", "լ", "մ", "ն", "ր", "ս", "տ", "կ"], {"f": ["ա", "իա", "ինա", "ելա"], "m": ["ան", "որ", "իկ", "ուս"], "n": ["ի", "ե", "են", "ո"]}),
}
#: What is said before a name of two words or more.
CUES = ["name is", "Name:", "Dear", "Sincerely,", "Regards,", "Signed,"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr"]
TITLES = [*FEMALE_TITLES, *MALE_TITLES, "Dr", "Prof"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_ANY_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)",
    "iban": r"(?<!\w)(?![0-9A-F]{32,128}(?!\w))[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "token": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,})(?!\w)",
    "name": rf"(?=\p{{Lu}})(?<!\w)(?:(?:{'|'.join(TITLES)})\.? (?:{_NAME} )?{_NAME}|(?:{_ANY_GIVEN}) {_NAME}|(?<=(?:{'|'.join(CUES)}) ){_NAME}(?: {_NAME}){{1,3}})(?!\w)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes: two digits side by side or with one separator between (all kinds of numbers), or
#: what e-mail addresses, tokens and names hold beside digits; names are only tried at capital letters.
MAYBE = rf"[0-9][ .-]?[0-9]|@|[0-9a-f]{{32}}|[0-9A-F]{{32}}|AKIA|(?:sk|pk|gh[po]|xox[abp])[-_]|(?=\p{{Lu}})(?<!\w)(?:(?:{'|'.join(TITLES)})\.? |(?:{_ANY_GIVEN}) |(?<=(?:{'|'.join(CUES)}) )\p{{Lu}})"
#: Tokens whose case is a spelling.
HEXADECIMAL = "^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"
EXCEPTIONS = 100_000


def kind(e: Column) -> Column:
    out = F.lit(None).cast("string")
    alone = {**PATTERNS, "name": rf"{PATTERNS['name']}|{_NAME}(?: {_NAME})+"}  # a cue is not part of its name
    for k, p in reversed(alone.items()):
        out = F.when(e.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def normal(e: Column, k: Column) -> Column:
    """The form that spellings of one entity share."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.concat_ws(":", k, F.when(k.isin("card", "phone", "ssn"), digits).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when((k == "email") | (k == "token") & e.rlike(HEXADECIMAL), F.lower(e)).otherwise(e))


def _stream(key: str, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits from the key, the entity and the attempt."""
    one = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), attempt.cast("string"), norm).cast("binary"), 256)
    return F.concat(one(0), one(1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masked(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by any of its class; the k-th of them by the k-th draw from the stream, so that separators don't matter."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, ch: Column) -> Column:
        draw = F.xxhash64(stream, acc["k"])
        one = lambda chars: F.substring(F.lit(chars), F.pmod(draw, F.lit(len(chars))).cast("int") + 1, F.lit(1))
        new = F.when(ch.between("0", "9") | ch.between("a", "f"), one("0123456789abcdef")) if hexadecimal else F.when(ch.between("0", "9"), one("0123456789"))
        new = new.when(ch.between("a", "z"), one(ascii_lowercase)).when(ch.between("A", "Z"), one(ascii_uppercase))
        return _let(new, lambda x: F.struct(F.concat(acc["out"], F.coalesce(x, ch)).alias("out"), (acc["k"] + x.isNotNull().cast("int")).alias("k")))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The sum of the check-digit rule; a valid number's is a multiple of 10."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _card(e: Column, masked: Column) -> Column:
    """Digits replaced but for the first; the last one restores the check-digit rule where the original kept it."""

    def valid(drawn: Column) -> Column:
        bare = F.regexp_replace(drawn, "[^0-9]", "")
        open_ = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit("0"))
        check = F.pmod(F.lit(10) - F.pmod(_luhn(open_), F.lit(10)), F.lit(10)).cast("string")
        keeps = _luhn(F.regexp_replace(e, "[^0-9]", "")) % 10 == 0
        return F.when(keeps, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)

    return _let(F.concat(F.substring(e, 1, 1), F.substring(masked, F.lit(2), F.length(e))), valid)


def _listed(options) -> Column:
    """An array of words or letters without commas, in few expressions; the optimizer makes it one constant."""
    return F.split(F.lit(",".join(options)), ",")


def _parts(word: Column) -> Column:
    """What words of the word's script are made of: a struct of arrays, by SCRIPTS."""

    def of(script: str) -> Column:
        first, vowels, last, endings = SCRIPTS[script]
        return F.struct(*[_listed(x).alias(n) for n, x in {"first": first, "vowels": vowels, "last": last, **endings}.items()])

    out = of("Latin")
    for script in SCRIPTS:
        if script != "Latin":
            out = F.when(word.rlike(rf"\p{{Is{script}}}"), of(script)).otherwise(out)
    return out


def _chosen(options: Column, draw: Column) -> Column:
    return F.get(options, F.pmod(draw, F.size(options)).cast("int"))


def _choice(options, draw: Column) -> Column:
    return F.get(_listed(options), F.pmod(draw, F.lit(len(options))).cast("int"))


def _made_up(parts: Column, stream: Column, syllables: int, attempt: Column) -> Column:
    """A word of so many syllables, and one more for each attempt beyond the seventh."""

    def one(draw: Column) -> Column:
        return F.concat(_chosen(parts["first"], draw), _chosen(parts["vowels"], F.shiftright(draw, 16)), _chosen(parts["last"], F.shiftright(draw, 32)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(syllables) + F.greatest(attempt - 7, F.lit(0))), lambda i: _let(F.xxhash64(stream, i), one)), "")


def _cased(word: Column, new: Column) -> Column:
    return _let(new, lambda x: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(x)).otherwise(F.initcap(x)))


def family_unit(word: Column) -> Column:
    return F.concat(F.lit("family:"), F.lower(word))


def _family(word: Column, key: str, attempt: Column) -> Column:
    """A family name of the word's script; it depends on the word alone, so titles and given names don't matter."""
    stream = _stream(key, family_unit(word), attempt)
    return _let(stream, lambda s: _cased(word, _let(_parts(word), lambda parts: _made_up(parts, s, 3, attempt))))


def _gender(word: Column, title: Column) -> Column:
    """f, m or n by the title before the name, else by the list."""
    by_list = F.when(word.isin(GIVEN["f"] + GIVEN["fc"]), "f").when(word.isin(GIVEN["m"] + GIVEN["mc"]), "m").otherwise("n")
    return F.when(title.rlike(f"^(?:{'|'.join(FEMALE_TITLES)})\\.?$"), "f").when(title.rlike(f"^(?:{'|'.join(MALE_TITLES)})\\.?$"), "m").otherwise(by_list)


def given_unit(word: Column, gender: Column) -> Column:
    return F.concat(F.lit("given:"), gender, F.lit(":"), F.lower(word))


def _given(word: Column, gender: Column, key: str, attempt: Column) -> Column:
    """A given name of the word's script and the gender: a listed one at first, then made-up ones, of which there is no end."""

    def made(s: Column) -> Column:
        draw = F.xxhash64(s)
        by_gender = lambda f, m, n: F.when(gender == "f", f).when(gender == "m", m).otherwise(n)
        listed = lambda suffix: _let(by_gender(*[_listed(GIVEN[g + suffix]) for g in "fmn"]), lambda x: _chosen(x, draw))
        from_list = F.when(word.rlike(r"\p{IsCyrillic}"), listed("c")).when(word.rlike(r"\p{IsLatin}"), listed(""))
        new = _let(_parts(word), lambda parts: F.concat(_made_up(parts, s, 2, attempt), _let(by_gender(parts["f"], parts["m"], parts["n"]), lambda x: _chosen(x, draw))))
        return _cased(word, F.coalesce(F.when(attempt == 0, from_list), new))

    return _let(_stream(key, given_unit(word, gender), attempt), made)


_TITLE = f"^(?:{'|'.join(TITLES)})\\.?$"


def _words_of_name(e: Column, family: Callable, given: Callable, title: Callable) -> Column:
    """An array of what the functions make of the words of a name; given() also gets the gender."""

    def of(words: Column) -> Column:
        first = F.get(words, F.lit(0))
        return F.transform(words, lambda w, i: F.when((i == 0) & first.rlike(_TITLE), title(w)).when(i == F.size(words) - 1, family(w)).otherwise(_let(_gender(w, first), lambda g: given(w, g))))

    return _let(F.split(e, " "), of)


def _name(e: Column, key: str, attempt_of: Callable[[Column], Column]) -> Column:
    family = lambda w: _let(attempt_of(family_unit(w)), lambda t: _family(w, key, t))
    given = lambda w, g: _let(attempt_of(given_unit(w, g)), lambda t: _given(w, g, key, t))
    return F.array_join(_words_of_name(e, family, given, lambda w: w), " ")


def units(e: Column, k: Column) -> Column:
    """What is replaced as a whole, array of struct(norm, e): the entity, or the words of a name without its title."""
    unit = lambda norm, e: F.struct(norm.alias("norm"), e.alias("e"))
    nothing = F.struct(F.lit(None).cast("string").alias("norm"), F.lit(None).cast("string").alias("e"))
    words = _words_of_name(e, lambda w: unit(family_unit(w), w), lambda w, g: unit(given_unit(w, g), w), lambda w: nothing)
    return F.when(k == "name", F.filter(words, lambda x: x["norm"].isNotNull())).otherwise(F.array(unit(normal(e, k), e)))


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """The replacement of one entity that is no name; names have it word by word."""

    def made(k: Column, s: Column) -> Column:
        extra = lambda after: F.greatest(attempt - after, F.lit(0))
        more = F.concat(e, F.repeat(F.lit("0"), extra(31)))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64(s, i), F.lit(253)) + 1).cast("string")), ".")
        groups = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(s, 4 * i + 1, F.lit(4))), ":"))
        longer = F.concat(F.repeat(F.lit("x"), extra(3)), e)  # addresses can be short, so that their room ends soon
        digits = _masked(F.lower(more), s, hexadecimal=True)
        bare = _let(digits, lambda x: F.when(e.rlike("[A-F]"), F.upper(x)).otherwise(x))
        # what stays in front: a country's code, or a token's kind
        front = F.when(k == "phone", F.regexp_extract(e, r"^\+\d{1,3}(?=[ .-])", 0)).when(k == "iban", F.substring(e, 1, 2)).when(k == "token", F.regexp_extract(e, r"^(?:AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_])", 0)).otherwise("")

        def masked(x: Column) -> Column:
            behind = _let(front, lambda kept: F.when((k == "token") & (kept == ""), bare).otherwise(F.concat(kept, F.substring(x, F.length(kept) + 1, F.length(more)))))
            return F.when(k == "email", F.concat(x, F.regexp_extract(e, r"\.[^.]+$", 0))).when(k == "card", _card(more, x)).otherwise(behind)

        mask = _masked(F.when(k == "email", F.regexp_extract(longer, r"^(.*)\.[^.]+$", 1)).otherwise(more), s)
        return F.when(k == "ip", F.when(attempt > 31, groups).otherwise(octets)).when(k.isin("email", "card", "phone", "ssn", "iban", "token"), _let(mask, masked)).otherwise(e)

    return _let(kind(e), lambda k: _let(_stream(key, normal(e, k), attempt), lambda s: made(k, s)))


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _drawn(rows: DataFrame, key: str, attempt: int) -> DataFrame:
    """norm, e and the normal form of the unit's replacement."""
    t, space = F.lit(attempt), F.split_part("norm", F.lit(":"), F.lit(1))
    given = F.concat(F.lit("given:"), F.lower(_given(F.col("e"), F.split_part("norm", F.lit(":"), F.lit(2)), key, t)))
    other = _let(surrogate(F.col("e"), key, t), lambda x: normal(x, space))
    return rows.withColumn("replaced", F.when(space == "family", family_unit(_family(F.col("e"), key, t))).when(space == "given", given).otherwise(other))


def exceptions(docs: DataFrame, key: str, scratch: C.Scratch, text: str = "text") -> DataFrame:
    """norm and attempt (1 or more) of the units whose first replacement was taken."""
    found = docs.select(F.explode(entities(F.col(text))).alias("e")).groupBy("e").count()
    found = found.select(F.explode(_let(kind(F.col("e")), lambda k: units(F.col("e"), k))).alias("u")).groupBy("u.norm").agg(F.min("u.e").alias("e"))
    drawn = scratch.keep(_drawn(found, key, 0), "drawn")
    surface = F.regexp_replace("norm", "^given:[fmn]:", "given:")  # a given name of any gender
    used = drawn.select(surface.alias("replaced")).unionByName(drawn.select("replaced"))
    first = drawn.groupBy("replaced").agg(F.min("norm").alias("keeps"), F.count("*").alias("n"))
    shared = drawn.join(first.filter("n > 1"), "replaced").filter("norm <> keeps").select("norm", "e")
    taken = drawn.join(drawn.select(surface.alias("replaced")).distinct(), "replaced", "left_semi").select("norm", "e")
    waiting, settled, attempt = scratch.keep(shared.unionByName(taken).distinct(), "waiting"), None, 0
    while not waiting.isEmpty():
        attempt += 1
        mine = scratch.keep(_drawn(waiting, key, attempt), "redrawn")
        known = used.join(mine.select("replaced").distinct(), "replaced", "left_semi").distinct()
        keeps = mine.groupBy("replaced").agg(F.min("norm").alias("norm"))
        fine = scratch.keep(mine.join(keeps, ["replaced", "norm"]).join(known, "replaced", "left_anti").select("norm", "replaced"), "fine")
        used = used.unionByName(fine.select("replaced"))
        done = fine.select("norm", F.lit(attempt).alias("attempt"))
        settled = done if settled is None else settled.unionByName(done)
        waiting = scratch.keep(waiting.join(fine.select("norm"), "norm", "left_anti"), "waiting")
    return settled if settled is not None else drawn.select("norm", F.lit(0).alias("attempt")).limit(0)


def replace(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with surrogates in the text; ``found`` names a column for the kinds of the entities, in order."""
    scratch = C.Scratch(docs.sparkSession, "pii")
    odd = scratch.keep(exceptions(docs, key, scratch, text), "exceptions")
    few = odd.limit(EXCEPTIONS + 1).collect()
    ents, made, tries, mark = (C.free_name([*docs.columns, found or ""], x) for x in ("entities", "replaced", "attempts", "mark"))
    rows = docs.withColumn(ents, entities(F.col(text)))
    if len(few) <= EXCEPTIONS:
        scratch.drop_all()
        by_attempt: dict[int, list[str]] = {}
        for r in few:
            by_attempt.setdefault(r["attempt"], []).append(r["norm"])

        def attempt_of(norm: Column) -> Column:
            out = F.lit(0)
            for t, norms in by_attempt.items():
                out = F.when(norm.isin(norms), t).otherwise(out)
            return out
    else:
        every = F.array_distinct(F.flatten(F.transform(ents, lambda e: F.transform(_let(kind(e), lambda k: units(e, k)), lambda u: u["norm"]))))
        prints = C.table_print(rows.select(ents, F.col(text).alias("text")), "text")
        named = prints.filter(F.size(ents) > 0).select("_p", F.explode(every).alias("norm")).distinct()
        named = named.join(odd, "norm").groupBy("_p").agg(F.map_from_entries(F.collect_list(F.struct("norm", "attempt"))).alias(tries))
        rows = rows.withColumn(mark, C.text_print(F.col(text))).join(named.withColumnRenamed("_p", mark), mark, "left")
        attempt_of = lambda norm: F.coalesce(F.element_at(tries, norm), F.lit(0))

    def new(e: Column) -> Column:
        return _let(kind(e), lambda k: F.when(k == "name", _name(e, key, attempt_of)).otherwise(_let(attempt_of(normal(e, k)), lambda t: surrogate(e, key, t))))

    between = F.split(F.col(text), PATTERN, -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(ents)), F.transform(ents, new), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    rows = rows.withColumn(made, F.when(F.size(ents) > 0, whole).otherwise(F.col(text)))
    extra = [F.transform(ents, kind).alias(found)] if found else []
    return rows.select(*[F.col(made).alias(c) if c == text else F.col(c) for c in docs.columns if c != found], *extra)
