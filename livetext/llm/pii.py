"""Operator 10, PII surrogates. DataFrame functions only.

One pattern finds all kinds of entities in a text; each becomes a keyed surrogate of its own kind:

* digits become digits and letters become letters of the same case and script, place by place; separators stay;
* a card number that passes the Luhn check gets a surrogate that passes it, an IBAN with valid check digits one with valid
  check digits and its country, an address stays a valid address, an e-mail address keeps its shape before the @ and goes
  to a reserved domain; a phone number keeps its country code;
* a person after titles gets given names of the first title's gender (of a man where it has none) and another family
  name, word for word: initials become other letters, particles and titles stay.

A surrogate depends on the key and on the identity of an entity alone, so an entity has one surrogate everywhere
(coreference). The identity of a phone number is its national digits, of a card or IBAN its digits and letters, whatever the
separators; of a family name its lower-case letters, so that "Mr. John Smith" and "Mr Smith" stay of one family; of a given
name itself with the family name. Other mentions of a family name in the same document, and given names right before it,
become that person's surrogates; of two persons with one name the first counts.

All distinct identities of the corpus are then checked: a surrogate that two of them share, or that is itself one of them, is
drawn again, with a higher attempt, for all but the smallest, until none is left. Names are longer in each attempt, so few
rounds are enough for any number of persons; other kinds have the space that their length gives, and a corpus that
fills it ends in an error after ``ROUNDS``. Only such exceptions are joined to their documents; all others are computed in
place.

The key is the setting ``livetext.pii.key`` of the session; without it a public default is used, for tests.

Null text stays null; texts without entities stay as they are; a text is searched whole, in one task. Repeated rows and ids
are treated alike, and entities of an empty table are empty. Other columns pass through ``replace_entities`` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import table, written

#: Titles, particles of names, and a capitalised word without a possessive 's.
TITLES = "Mrs|Mr|Ms|Miss|Mme|Herr|Frau|Srta|Sra|Sr|Señora|Señor|Dra|Dr|Profa|Prof|Г-н|Г-жа"
PARTICLES = "von|vom|van|zu|zum|zur|de|del|della|der|den|des|di|da|do|dos|das|du|d[’']|la|las|le|les|los|ten|ter|af|av|bin|ibn|al|el|y|e"
WORD = r"\p{Lu}(?:\p{L}|['’](?!s\b)(?=\p{L}))*+"
#: Words of a name; initials and particles lead to another word. Possessive, so that no run of words is too long.
NAME = rf"(?:(?:\p{{Lu}}\.[ -]?(?=\p{{Lu}}|(?:{PARTICLES})[ -])|(?:{PARTICLES})[ -])*+{WORD}|{WORD})"
#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}\b",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-(?=[A-Za-z0-9_-]{20})[A-Za-z0-9]+(?:[_-]+[A-Za-z0-9]+)*|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b(?!\.[0-9])",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,5}){2,5}\b|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "person": rf"(?U)\b(?:(?:{TITLES})\.? )++{NAME}(?:[ -]{NAME})*+",
}
#: Titles of women, and names by script and gender.
FEMALE = r"^(?:Mrs|Ms|Miss|Mme|Frau|Sra|Srta|Señora|Dra|Profa|Г-жа)\b"
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Diana", "Elena", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sara", "Teresa", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
}
SYLLABLES = {"latin": ["ba", "der", "fel", "gan", "hol", "kin", "lor", "mas", "nov", "per", "ras", "sen", "tur", "val", "wex", "zim"], "cyrillic": ["бар", "вин", "гор", "дан", "жил", "зор", "кал", "лев", "мор", "нов", "пав", "рус", "сол", "тим", "фед", "чар"]}
ANY = "|".join(f"(?:{p.removeprefix('(?U)')})" for p in PATTERNS.values())
#: Nothing matches without one of these, so other texts skip the search: every pattern needs one of them.
GATE = rf"[0-9@]|[0-9a-f]{{32}}|sk-|AKIA|gh[pousr]_|(?:{TITLES})\.? "


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern takes the whole entity."""
    cases = [F.when(entity.rlike(f"^(?:{p.removeprefix('(?U)')})$"), F.lit(k)) for k, p in PATTERNS.items()]
    return F.coalesce(*cases, F.lit("phone"))


TITLE = rf"^(?:(?:{TITLES})\.? )+"
#: Country calling codes of one, two and three digits.
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]+)"
INITIAL = r"(?U)^(?:\p{L}\.)*\p{L}\.?$"


def is_person(entity: Column) -> Column:
    return entity.rlike(TITLE)


def _tokens(entity: Column) -> Column:
    """The words of a person's name without titles; the last one is the family name."""
    return F.split(F.regexp_replace(entity, TITLE, ""), " ")


def _givens(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.size(tokens) - 1)


def _family(tokens: Column) -> Column:
    return F.split(F.element_at(tokens, -1), "-")


def _family_id(part: Column) -> Column:
    return F.concat(F.lit("family:"), F.replace(F.lower(part), F.lit("’"), F.lit("'")))


def _person_id(entity: Column, tokens: Column) -> Column:
    return F.concat_ws(":", F.lit("person"), F.when(entity.rlike(FEMALE), "f").otherwise("m"), F.lower(F.element_at(tokens, -1)), F.lower(F.array_join(_givens(tokens), " ")))


def _national(entity: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, CODE, ""), "[^0-9]", ""), "^0+", "")


def normal(entity: Column, kind: Column) -> Column:
    """What makes two mentions of other kinds than persons one entity."""
    return F.when(kind == "email", F.lower(entity)).when(kind == "phone", F.concat(F.lit("tel:"), _national(entity))).when(kind.isin("card", "iban"), F.regexp_replace(entity, "[ -]", "")).otherwise(entity)


def identities(entity: Column) -> Column:
    """The identities that a mention's surrogate is made of."""
    families = F.transform(_family(_tokens(entity)), _family_id)
    person = F.when(F.size(_tokens(entity)) > 1, F.concat(families, F.array(_person_id(entity, _tokens(entity))))).otherwise(families)
    return F.when(is_person(entity), person).otherwise(F.array(_with(kind_of(entity), lambda kind: normal(entity, kind))))


def found(text: Column) -> Column:
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _draws(key: str, entity: Column, attempt: Column, n: Column) -> Column:
    """``n`` keyed numbers (0 to 255) for an entity and attempt, as hex pairs of one or more digests."""
    seed = F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), entity)
    pages = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("\x1f"), k.cast("string")), 256))
    return F.array_join(pages, "")


def _draw(draws: Column, at: Column, below: int) -> Column:
    return F.pmod(F.conv(F.substring(draws, 2 * at + 1, F.lit(2)), 16, 10).cast("int"), F.lit(below))


def _pick(options: list[str], k: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(options)), ","), k + 1)


def _shaped(entity: Column, draws: Column) -> Column:
    """Place by place: a digit for a digit, a letter of the same case and script for a letter. A digit other than 0
    in the first two places (after a + too) stays other than 0."""

    def one(c, k):
        digit = F.when((c != "0") & (k < 2), _draw(draws, k, 9) + 1).otherwise(_draw(draws, k, 10)).cast("string")
        lower = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(draws, k, 26) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), digit).when(c.rlike("^[a-z]$"), lower).when(c.rlike("^[A-Z]$"), F.upper(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _hex(entity: Column, draws: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, ""), lambda c, k: F.substring(F.lit("0123456789abcdef"), _draw(draws, k, 16) + 1, F.lit(1))), "")


def _luhn(number: Column) -> Column:
    """The Luhn sum's last digit."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    add = lambda d, k: F.when(k % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)
    return F.aggregate(F.transform(digits, lambda c, k: add(c.cast("int"), k)), F.lit(0), lambda s, d: s + d) % 10


def _card(entity: Column, draws: Column) -> Column:
    shaped = _shaped(entity, draws)
    body = F.substring(shaped, F.lit(1), F.length(shaped) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(_luhn(entity) == 0, F.concat(body, check.cast("string"))).otherwise(shaped)


def _ip(draws: Column) -> Column:
    return F.concat_ws(".", *[(_draw(draws, F.lit(k), 254) + 1).cast("string") for k in range(4)])


def _email(entity: Column, draws: Column) -> Column:
    local = F.substring_index(entity, "@", 1)
    host = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(draws, F.length(local) + k, 26) + 1, F.lit(1))), "")
    return F.concat(_shaped(local, draws), F.lit("@"), host, F.lit(".example."), _pick(["com", "net", "org"], _draw(draws, F.length(local) + 6, 3)))


def _mod97(number: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10) by 97."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(number, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))


def _iban(entity: Column, draws: Column) -> Column:
    shaped, country = _shaped(entity, draws), F.substring(entity, 1, 2)
    body = F.substr(shaped, F.lit(5))
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    fine = _mod97(F.concat(F.substr(entity, F.lit(5)), F.substring(entity, 1, 4))) == 1
    return F.concat(country, F.when(fine, check).otherwise(F.substring(shaped, 3, 2)), body)


def _script(of: Column, f) -> Column:
    return F.when(of.rlike(r"\p{IsCyrillic}"), f("cyrillic")).otherwise(f("latin"))


def _syllables(script: str, draws: Column, first: int, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: _pick(SYLLABLES[script], _draw(draws, first + k, 16))), "")


def _family_name(identity: Column, draws: Column, attempt: Column) -> Column:
    """Two more syllables with each attempt: however many families there are, some attempt has room for all of them."""
    return _script(identity, lambda script: F.initcap(_syllables(script, draws, 0, 3 + 2 * attempt)))


def _given_names(identity: Column, key: str, attempt: Column) -> Column:
    """The given names of a person identity, each drawn by itself and the family name; double names from the second attempt on."""
    fields = F.split(identity, ":")
    gender, family = fields[1], fields[2]

    def named(word, draws, script):
        upper = [chr(k) for k in range(*((0x410, 0x42A) if script == "cyrillic" else (65, 91)))]
        pick = lambda g: _pick(NAMES[script, g], _draw(draws, F.lit(0), len(NAMES[script, g])))
        name = F.when(gender == "f", pick("f")).otherwise(pick("m"))
        longer = F.concat_ws("-", name, F.when(attempt > 0, F.initcap(_syllables(script, draws, 1, 2 * F.greatest(attempt, F.lit(1))))))
        letter = F.regexp_replace(word, r"\p{L}", _pick(upper, _draw(draws, F.lit(0), len(upper))))
        return F.when(word.rlike(INITIAL), letter).otherwise(longer)

    def one(word):
        draws = _draws(key, F.concat_ws(":", F.lit("given"), gender, family, word), attempt, 2 + 2 * attempt)
        return F.when(word.rlike(rf"^(?:{PARTICLES})$"), word).otherwise(_with(draws, lambda d: _script(word, lambda script: named(word, d, script))))

    return F.array_join(F.transform(F.split(fields[3], " "), one), " ")


def drawn(identity: Column, key: str, attempt: Column = None) -> Column:
    """The surrogate of an identity, itself written as one."""
    attempt = F.lit(0) if attempt is None else attempt

    def of(x):
        identity, draws, kind = x["i"], x["d"], x["k"]
        secret = F.when(identity.rlike("^[0-9a-f]+$"), _hex(identity, draws)).otherwise(_shaped(identity, draws))
        by = {"email": _email(identity, draws), "secret": secret, "ip": _ip(draws), "card": _card(identity, draws), "iban": _iban(identity, draws)}
        other = reduce(lambda out, k: out.when(kind == k, by[k]), list(by)[1:], F.when(kind == "email", by["email"])).otherwise(_shaped(identity, draws))
        family = F.concat(F.lit("family:"), F.lower(_family_name(identity, draws, attempt)))
        phone = F.concat(F.lit("tel:"), _shaped(F.substr(identity, F.lit(5)), draws))
        return F.when(kind == "family", family).when(kind == "tel", phone).otherwise(other)

    def person(identity):
        return F.concat(F.lit("drawn:"), F.substring_index(F.substr(identity, F.lit(8)), ":", 2), F.lit(":"), _given_names(identity, key, attempt))

    kind = F.when(identity.startswith("family:"), "family").when(identity.startswith("tel:"), "tel").otherwise(kind_of(identity))
    draws = _draws(key, identity, attempt, F.length(identity) + 8 + 2 * attempt)
    return F.when(identity.startswith("person:"), person(identity)).otherwise(_with(F.struct(identity.alias("i"), draws.alias("d"), kind.alias("k")), of))


def _laid(entity: Column, chars: Column) -> Column:
    """``chars`` in the places of a mention's digits and letters; separators stay."""
    at = lambda k: F.length(F.regexp_replace(F.substring(entity, F.lit(1), k), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, k: F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(chars, at(k) + 1, F.lit(1))).otherwise(c)), "")


def rendered(entity: Column, lookup) -> Column:
    """A mention with the surrogates of its identities (``lookup``) in its own format."""
    like = lambda name, word: _with(name, lambda n: F.when((F.length(word) > 1) & (word == F.upper(word)) & ~word.contains("."), F.upper(n)).otherwise(n))

    def person(x):
        tokens, parts = x["t"], _family(x["t"])
        part = lambda p, s: F.when(p.rlike(r"^\p{Lu}"), like(F.initcap(F.substr(s, F.lit(8))), p)).otherwise(p)
        family = F.array(F.array_join(F.zip_with(parts, F.slice(x["s"], F.lit(1), F.size(parts)), part), "-"))
        names = F.split(F.element_at(F.split(F.element_at(x["s"], -1), ":"), -1), " ")
        givens = F.zip_with(_givens(tokens), names, lambda t, n: F.when(t.rlike(r"^\p{Ll}"), t).otherwise(like(n, t)))
        words = F.concat(F.when(F.size(tokens) > 1, givens).otherwise(F.array().cast("array<string>")), family)
        return F.concat(F.regexp_extract(entity, TITLE, 0), F.array_join(words, " "))

    def phone(x):
        zeros = F.length(F.regexp_replace(x["rest"], "[^0-9]", "")) - F.length(x["national"])
        return F.concat(x["code"], _laid(x["rest"], F.concat(F.repeat(F.lit("0"), zeros), x["national"])))

    def other(x):
        code, s, kind = F.regexp_extract(entity, CODE, 0), F.element_at(x["s"], 1), kind_of(entity)
        number = F.struct(code.alias("code"), F.substr(entity, F.length(code) + 1).alias("rest"), F.substr(s, F.lit(5)).alias("national"))
        return _with(kind, lambda k: F.when(k == "phone", _with(number, phone)).when(k.isin("card", "iban"), _laid(entity, s)).otherwise(s))

    known = F.struct(_tokens(entity).alias("t"), F.transform(identities(entity), lookup).alias("s"))
    return _with(known, lambda x: F.when(is_person(entity), person(x)).otherwise(other(x)))


def surrogate(entity: Column, key: str, attempt: Column = None) -> Column:
    """The surrogate of a mention, without regard to other entities."""
    return rendered(entity, lambda identity: drawn(identity, key, attempt))


def entity_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct identities of the corpus."""
    return docs.select(F.explode(found(F.col(text_col))).alias("e")).distinct().select(F.explode(identities(F.col("e"))).alias("entity")).distinct()


#: Attempts before a corpus that leaves no free surrogate is an error.
ROUNDS = 50


def resolve_collisions(entities: DataFrame, key: str, draw=drawn) -> DataFrame:
    """(entity, surrogate) for the entities whose first surrogate isn't theirs alone; ``entities`` is a written table.

    Of the entities that drew one surrogate the smallest keeps it, unless an entity of the corpus looks like it.
    """
    first = written(entities.select("entity", draw(F.col("entity"), key).alias("surrogate")), "surrogates")
    settled, open_ = first, None
    for attempt in range(1, ROUNDS + 1):
        state = settled if open_ is None else open_
        keeps = state.groupBy("surrogate").agg(F.min("entity").alias("keeper"))
        taken = entities.select(F.col("entity").alias("surrogate"))
        if open_ is not None:
            taken = taken.unionByName(settled.select("surrogate"))
        free = keeps.join(taken.distinct().hint("merge"), "surrogate", "left_anti")
        good = written(state.join(free.select("surrogate", F.col("keeper").alias("entity")).hint("merge"), ["surrogate", "entity"], "left_semi").select("entity", "surrogate"), "settled")
        bad = state.join(good.select("entity").hint("merge"), "entity", "left_anti").select("entity")
        redrawn = written(bad.select("entity", draw(F.col("entity"), key, F.lit(attempt)).alias("surrogate")), "redrawn")
        if open_ is not None:
            exceptions = written(exceptions.unionByName(good), "exceptions")
            settled = settled.unionByName(good)
        else:
            settled = good
            exceptions = good.limit(0)
        if redrawn.isEmpty():
            return exceptions
        open_ = redrawn
    raise RuntimeError(f"{redrawn.count()} entities have no free surrogate of their kind after {ROUNDS} attempts")


def replaced(text: Column, key: str, exceptions: Column = None) -> Column:
    """The text with its entities replaced; ``exceptions`` maps identities to surrogates that differ from the first draw."""

    def lookup(identity):
        first = drawn(identity, key)
        return first if exceptions is None else F.coalesce(F.element_at(exceptions, identity), first)

    between = F.split(text, ANY, -1)
    joined = lambda entities, put: F.array_join(F.zip_with(_mentions(between, entities, put), put, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(GATE), _with(found(text), lambda entities: _with(F.transform(entities, lambda e: rendered(e, lookup)), lambda put: joined(entities, put)))).otherwise(text)


def _mentions(between: Column, entities: Column, put: Column) -> Column:
    """The texts between entities with the names of the document's persons replaced: family names, and given names before them."""
    pairs = F.filter(F.arrays_zip(entities.alias("e"), put.alias("s")), lambda x: is_person(x["e"]))
    families = lambda f: F.flatten(F.transform(pairs, lambda x: _family(_tokens(x[f]))))
    givens = lambda f: F.flatten(F.transform(pairs, lambda x: _givens(_tokens(x[f]))))
    word = rf"(?<!\p{{L}}){WORD}"
    of = lambda names, e, s, w: F.when(F.length(w) > 1, F.get(names[s], (F.array_position(names[e], w) - 1).cast("int")))

    def renamed(piece, names):
        found_ = F.struct(F.regexp_extract_all(piece, F.lit(f"({word})"), F.lit(1)).alias("w"), F.split(piece, word, -1).alias("gap"))

        def put_in(x):
            known = lambda w: F.array_contains(names["fe"], w) | F.array_contains(names["ge"], w)
            leads = lambda k: F.coalesce((F.get(x["gap"], k + 1) == " ") & known(F.get(x["w"], k + 1)), F.lit(False))
            new = F.transform(x["w"], lambda w, k: F.coalesce(of(names, "fe", "fs", w), F.when(leads(k), of(names, "ge", "gs", w)), w))
            return F.array_join(F.zip_with(x["gap"], new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

        return _with(found_, put_in)

    names = F.struct(families("e").alias("fe"), families("s").alias("fs"), givens("e").alias("ge"), givens("s").alias("gs"))
    named = _with(names, lambda names: F.transform(between, lambda piece: renamed(piece, names)))
    return F.when(F.exists(entities, is_person), named).otherwise(between)


#: Exceptions by text that are sent to all tasks: at most so many texts and entries, else they are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_ENTRIES = 50_000, 200_000


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced; all other columns as they are."""
    entities = written(entity_table(docs, text_col), "entities")
    exceptions = resolve_collisions(entities, key)
    text = F.col(text_col)
    if exceptions.isEmpty():
        return docs.withColumn(text_col, replaced(text, key))
    # texts that mention an exception get a map of theirs, joined by the text's digest
    mark, entries = _unused(docs, "__livetext_digest"), _unused(docs, "__livetext_map")
    digest = F.sha2(text, 256)
    mentions = docs.select(digest.alias(mark), F.explode(F.array_distinct(F.flatten(F.transform(found(text), identities)))).alias("entity")).distinct()
    maps = mentions.join(exceptions.hint("merge"), "entity").groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(entries))
    maps = written(maps, "exception-maps")
    n, size = maps.agg(F.count("*"), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    small = n <= BROADCAST_TEXTS and size <= BROADCAST_ENTRIES
    joined = docs.withColumn(mark, digest).join(F.broadcast(maps) if small else maps.hint("merge"), mark, "left")
    return joined.withColumn(text_col, replaced(text, key, F.col(entries))).select(*docs.columns)


KEY = "livetext-surrogates-1"


def key_of(spark: SparkSession) -> str:
    """The session's key; the default is public and for tests."""
    return spark.conf.get("livetext.pii.key", KEY)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(found(F.col("text"))).cast("long").alias("n_entities"))
    return replace_entities(docs, key_of(spark)).select("doc_id", "text", "n_entities")
