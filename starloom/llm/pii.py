"""Keyed, type-consistent surrogates for personal data, by DataFrame functions only."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import written

#: Kinds of entities and the patterns that find them, first match wins.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}",
    "access": r"\bAKIA[A-Z0-9]{16}\b",
    "hex": r"(?<![0-9A-Za-z])(?=[0-9a-f]{0,63}[a-f])(?=[0-9a-f]{0,63}[0-9])[0-9a-f]{16,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[3-6](?:[0-9][ -]?){11,17}[0-9](?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Titles by gender, u for those of both, and those known in capitals.
TITLES = {
    "f": "Mrs|Ms|Miss|Madam|Frau|Fräulein|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Signora|[Гг]оспожа|г-жа",
    "m": "Mr|Mister|Sir|Herr|Monsieur|Señor|Signor|[Гг]осподин|г-н",
    "u": "Dr|Doctor|Prof|Professor|Rev|Reverend|[Дд]октор|[Пп]рофессор",
}
CAPITALS = {"f": "MRS|MISS", "m": "MR", "u": "PROF"}
#: Words with which people name themselves; their gender stays open.
CUES = "[Mm]y name is|[Mm]e llamo|[Jj]e m['’]appelle|[Mm]ein Name ist|[Мм]еня зовут"
#: Small words inside names, which stay.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ben", "zu", "ter", "y"]
TITLE = "|".join([*TITLES.values(), *CAPITALS.values()])
LETTER = r"[\p{L}\p{M}]"
#: A word of a name: inner capitals, apostrophes (an "'s" behind it isn't its) and parts joined by hyphens.
WORD = rf"(?:\p{{Lu}}['’]{LETTER}|\p{{Lu}}){LETTER}+(?:['’](?:\p{{Lu}}|{LETTER}{{3}}){LETTER}*|-{LETTER}{{2,}})*"
PART = rf"(?:\p{{Lu}}['’])?{LETTER}{LETTER}+(?:['’](?:\p{{Lu}}|{LETTER}{{3}}){LETTER}*)?"
#: A person is named by titles or a cue and one to six words, with initials and small words between. Once named, these words
#: are the person's throughout the document.
LED = rf"(?<!{LETTER})(?:(?:(?:{TITLE})(?:\.\s{{0,2}}|[\s\xA0]{{1,2}})){{1,3}}|(?:{CUES})\s{{1,2}})"
FREE = rf"(?!(?:{TITLE})(?!{LETTER}))"
SMALL = rf"(?:(?:{'|'.join(PARTICLES)})[ \xA0]){{0,3}}(?:(?:al|el)-)?"
INITIALS = r"(?:\p{Lu}\.[ \xA0]?){0,3}"
NAMED = rf"{SMALL}{INITIALS}{SMALL}{FREE}{WORD}"
PERSON = rf"{LED}{NAMED}(?:[ \xA0]{NAMED}){{0,5}}"
#: What a text must hold to be looked at more closely. Every match of PATTERNS and PERSON holds one of these: an email "@", a key
#: AKIA, a hex secret 16 hex digits in a row, an account two capitals and two digits, an address digit-dot-digit, a card 13
#: digits with single separators, a phone and a security number three digits in a row, a name its title or cue.
HINT = rf"[0-9]{{3}}|@|AKIA|[0-9a-f]{{16}}|[A-Z]{{2}}[0-9]{{2}}|[0-9]\.[0-9]|(?:[0-9][ -]?){{12}}[0-9]|(?<!{LETTER})(?:{TITLE}|{CUES})(?!{LETTER})"
#: The syllables that names are built from, by script; endings by gender, one for names whose gender is open.
SYLLABLES = {
    "latin": ["ba", "re", "mi", "lo", "ka", "ne", "di", "so", "ta", "ve", "ri", "no", "la", "se", "ti", "mo"],
    "cyrillic": ["ба", "ре", "ми", "ло", "ка", "не", "ди", "со", "та", "ве", "ри", "но", "ла", "се", "ти", "мо"],
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("latin", "u"): "l", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "u"): "л"}
#: Alphabets of initials.
ALPHABETS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"]
#: Times that a surrogate is drawn anew before its entity is given up with an error.
ATTEMPTS = 40
#: Syllables of a name's surrogate at most: so many that any number of names finds free ones.
MOST = 12


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a string, 64 hex digits."""
    block = hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()
    block = block.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        fits = entity.rlike(f"^(?:{pattern})$")
        out = F.when(fits, F.lit(kind)) if out is None else out.when(fits, F.lit(kind))
    return out


def plain(word: Column) -> Column:
    """What the spellings of one word of a name share."""
    return F.lower(F.replace(word, F.lit("’"), F.lit("'")))


def people(text: Column) -> Column:
    """(word, gender) of each word that names a person in the text, as it is spelt there; gender m, f or u (open)."""
    named = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PERSON), F.lit(0))), F.array().cast("array<string>"))
    words = lambda p: F.filter(F.regexp_extract_all(F.regexp_replace(p, f"^{LED}", ""), F.lit(PART), F.lit(0)), lambda w: ~w.isin(PARTICLES))

    def gender(p: Column) -> Column:
        titled = lambda g: p.rlike(rf"(?:^|[\s\xA0.])(?:{TITLES[g]}|{CAPITALS[g]})(?!{LETTER})")
        return F.when(titled("f"), F.lit("f")).when(titled("m"), F.lit("m")).otherwise(F.lit("u"))

    return F.array_distinct(F.flatten(F.transform(named, lambda p: F.transform(words(p), lambda w: F.struct(w.alias("word"), gender(p).alias("gender"))))))


def genders(named: Column) -> Column:
    """A map from each plain word of `people` to the first gender that isn't open, else u."""
    each = F.array_distinct(F.transform(named, lambda x: plain(x["word"])))
    known = lambda w: F.filter(named, lambda x: (plain(x["word"]) == w) & (x["gender"] != "u"))
    return F.map_from_entries(F.transform(each, lambda w: F.struct(w, F.coalesce(F.try_element_at(known(w), F.lit(1))["gender"], F.lit("u")))))


def spellings(named: Column) -> Column:
    """A pattern of the words of `people`, each as spelt, in capitals and (if spelt in capitals) with one, longest first."""
    forms = F.flatten(F.transform(named, lambda x: F.array(x["word"], F.upper(x["word"]), F.when(x["word"] == F.upper(x["word"]), F.initcap(x["word"])).otherwise(x["word"]))))
    ordered = F.array_sort(F.array_distinct(forms), lambda a, b: F.length(b) - F.length(a))
    return F.regexp_replace(F.array_join(ordered, "|"), "['’]", "['’]")


def initial(letter: Column, key: str) -> Column:
    """Another letter: each is the next one of its alphabet in an order that the key gives, so that different ones stay different."""
    out = letter
    for alphabet in ALPHABETS:
        order = sorted(alphabet, key=lambda c: hmac.new(key.encode(), f"initial|{c}".encode(), "sha256").digest())
        out = F.when(letter.isin(list(alphabet)), F.translate(letter, "".join(order), "".join(order[1:] + order[:1]))).otherwise(out)
    return F.when(letter.isin(list("".join(ALPHABETS))), out).otherwise(F.lit("X"))


def canonical(entity: Column, kind: Column) -> Column:
    """What two mentions of one entity share: digits of cards and phones, lower-case addresses, accounts without spaces."""
    entity = F.when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity)
    return F.when(kind.isin("card", "phone"), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "email", F.lower(entity)).otherwise(entity)


def stream(key: str, kind: Column, canon: Column, attempt: Column, size: Column) -> Column:
    """`size` pseudo-random bytes in hex, for one draw of one entity's surrogate."""
    text = lambda n: F.concat_ws("|", kind, attempt.cast("string"), n.cast("string"), canon)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda n: keyed(key, text(n))), "")


def _byte(bits: Column, n: Column) -> Column:
    return F.conv(F.substr(bits, 2 * n + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str | Column, n: Column) -> Column:
    text = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
    return F.substr(text, F.pmod(n, F.length(text)) + 1, F.lit(1))


def _poured(entity: Column, bits: Column, hexadecimal: Column) -> Column:
    """Each letter and digit becomes one of its class and case; other characters stay."""
    chars = F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.substr(entity, i, F.lit(1)))

    def one(c: Column, i: Column) -> Column:
        r = _byte(bits, i)
        lower = F.when(hexadecimal, _pick("abcdef", r)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", r))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", r)).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule; a valid number's is a multiple of 10."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """An account number of any digits and capitals, country and check digits moved to its end, modulo 97."""
    moved = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    values = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def drawn(df: DataFrame, items: str, key: str) -> DataFrame:
    """df with a field `surrogate` added to its array `items` of struct(kind, canon, attempt, ...): canonical surrogates.

    They have the kind, length and classes of characters of their entities. Cards keep their first digit and are valid
    by the Luhn rule if the entity is; accounts keep their country and are valid modulo 97 if the entity is; phones keep their country code of digits before the last ten; addresses keep
    their top-level domain; words of names, whose canon is the gender and the word, keep gender and script. Every step reads what the step before has written, so
    that nothing is worked out twice.
    """
    fields = [f.name for f in df.schema[items].dataType.elementType.fields]

    def add(df: DataFrame, **made) -> DataFrame:
        grown = F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields], *[m(x).alias(n) for n, m in made.items()]))
        fields.extend(made)
        return df.withColumn(items, grown)

    canon = lambda x: x["canon"]
    df = add(df, bits=lambda x: stream(key, x["kind"], canon(x), x["attempt"], F.length(canon(x)) + 16))
    df = add(df, poured=lambda x: _poured(canon(x), x["bits"], x["kind"] == "hex"))
    df = add(df, body=lambda x: F.when(x["kind"] == "card", F.concat(F.substring(canon(x), 1, 1), F.substr(x["poured"], F.lit(2), F.length(canon(x)) - 2))))
    df = add(df, check=lambda x: F.when(x["kind"] == "card", F.pmod(10 - F.pmod(_luhn(F.concat(x["body"], F.lit("0"))), F.lit(10)), F.lit(10))))

    def account(x: Column) -> Column:
        blank = F.concat(F.substring(canon(x), 1, 2), F.lit("00"), F.substr(x["poured"], F.lit(5), F.length(canon(x))))
        right = 98 - _mod97(blank)
        digits = F.when(_mod97(canon(x)) == 1, right).otherwise(F.pmod(right + 1 + F.pmod(_byte(x["bits"], F.lit(0)), F.lit(90)), F.lit(97)) + 2)
        return F.when(x["kind"] == "iban", F.lpad(digits.cast("string"), 2, "0"))

    df = add(df, account=account)

    def made(x: Column) -> Column:
        kind, bits, poured, size = x["kind"], x["bits"], x["poured"], F.length(x["canon"])
        wrong = F.pmod(x["check"] + 1 + F.pmod(_byte(bits, F.lit(40)), F.lit(9)), F.lit(10))
        card = F.concat(x["body"], F.when(F.pmod(_luhn(canon(x)), F.lit(10)) == 0, x["check"]).otherwise(wrong).cast("string"))
        code = F.greatest(size - 10, F.lit(0))
        phone = F.concat(F.substr(canon(x), F.lit(1), code), F.substr(poured, code + 1, size - code))
        top = F.regexp_extract(canon(x), r"\.[a-z]+$", 0)
        email = F.concat(F.substr(poured, F.lit(1), size - F.length(top)), top)
        octets = F.concat_ws(".", *[(F.pmod(_byte(bits, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
        two = lambda i: _byte(bits, F.lit(i)) * 256 + _byte(bits, F.lit(i + 1))
        area, group, serial = (F.lpad((F.pmod(two(i), F.lit(n)) + 1).cast("string"), w, "0") for i, n, w in ((0, 665, 3), (2, 99, 2), (4, 9999, 4)))
        access = F.concat(F.lit("AKIA"), F.substr(poured, F.lit(5), F.lit(16)))
        return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "email", email).when(kind == "ip", octets).when(kind == "access", access).when(kind == "iban", F.concat(F.substring(canon(x), 1, 2), x["account"], F.substr(poured, F.lit(5), size))).when(kind == "ssn", F.concat_ws("-", area, group, serial)).when(kind == "name", _name(canon(x), bits, x["attempt"])).otherwise(poured)

    return add(df, surrogate=made)


def _name(canon: Column, bits: Column, attempt: Column) -> Column:
    """A new word for one of a name, of its gender and script: four syllables and one more for each attempt, up to MOST."""
    gender, word = F.substring(canon, 1, 1), F.substring(canon, 3, 1 << 30)
    out = F.lit("")
    for name, syllables in SYLLABLES.items():
        of = F.array(*map(F.lit, syllables))
        made = F.array(*[F.element_at(of, F.pmod(_byte(bits, F.lit(i)), F.lit(len(syllables))) + 1) for i in range(MOST)])
        end = F.when(gender == "f", F.lit(ENDINGS[name, "f"])).when(gender == "m", F.lit(ENDINGS[name, "m"])).otherwise(F.lit(ENDINGS[name, "u"]))
        whole = F.concat(F.array_join(F.slice(made, F.lit(1), F.least(F.lit(MOST), attempt + 4)), ""), end)
        out = F.when(word.rlike(r"\p{IsCyrillic}") == F.lit(name == "cyrillic"), whole).otherwise(out)
    return F.when(F.contains(word, F.lit("'")), F.concat(F.upper(F.substring(out, 1, 1)), F.lit("'"), F.initcap(out))).otherwise(F.initcap(out))


def rendered(entity: Column, kind: Column, canon: Column) -> Column:
    """The canonical surrogate in the mention's format: separators of numbers and accounts, letter case, apostrophes."""
    chars = F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.substr(entity, i, F.lit(1)))
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def pour(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(a["text"], F.when(digit, F.substr(canon, a["at"], F.lit(1))).otherwise(c)).alias("text"), (a["at"] + digit.cast("int")).alias("at"))

    numbers = F.aggregate(chars, start, pour)["text"]
    cased = F.array_join(F.zip_with(chars, F.split(canon, ""), lambda c, s: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")
    email = F.when(F.length(entity) == F.length(canon), cased).otherwise(canon)
    groups = F.aggregate(chars, start, lambda a, c: F.struct(F.concat(a["text"], F.when(c == " ", c).otherwise(F.substr(canon, a["at"], F.lit(1)))).alias("text"), (a["at"] + (c != " ").cast("int")).alias("at")))["text"]
    name = F.when(entity == F.upper(entity), F.upper(canon)).when(entity == F.lower(entity), F.lower(canon)).otherwise(canon)
    name = F.when(F.contains(entity, F.lit("’")), F.replace(name, F.lit("'"), F.lit("’"))).otherwise(name)
    return F.when(kind.isin("card", "phone"), numbers).when(kind == "email", email).when(kind == "iban", groups).when(kind == "name", name).otherwise(canon)


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct entities whose first draw won't do, with one that will; written.

    A draw won't do if an entity before it, in order of attempt and text, has the same surrogate, or if it is itself an
    entity of the corpus. Those are drawn again until all surrogates differ from each other and from all entities.
    """
    def draw(rows: DataFrame) -> DataFrame:
        one = rows.select(F.array(F.struct("kind", "canon", "attempt")).alias("items"))
        return drawn(one, "items", key).select(F.explode("items").alias("x")).select("x.kind", "x.canon", "x.attempt", "x.surrogate")

    held = written(draw(entities.withColumn("attempt", F.lit(0))))
    text = F.when(F.col("kind") == "name", F.substring("canon", 3, 1 << 30)).otherwise(F.col("canon"))
    real = written(entities.select(F.col("kind").alias("r_kind"), text.alias("r_canon")).distinct())
    for attempt in range(1, ATTEMPTS + 1):
        first = F.min(F.struct("attempt", "canon")).alias("first")
        shared = held.groupBy("kind", "surrogate").agg(first, F.count("*").alias("n")).where("n > 1")
        shared = shared.select(F.col("kind").alias("c_kind"), F.col("surrogate").alias("c_surrogate"), F.col("first.canon").alias("c_canon"))
        again = held.join(shared, (F.col("kind") == F.col("c_kind")) & (F.col("surrogate") == F.col("c_surrogate")) & (F.col("canon") != F.col("c_canon")))
        alike = F.when(F.col("kind") == "name", F.lower("surrogate")).otherwise(F.col("surrogate"))
        known = held.join(real, (F.col("kind") == F.col("r_kind")) & (alike == F.col("r_canon")))
        again = written(again.select("kind", "canon").unionAll(known.select("kind", "canon")).distinct())
        if again.isEmpty():
            return held.where("attempt > 0").select("kind", "canon", "surrogate")
        held = written(held.join(again, ["kind", "canon"], "left_anti").unionAll(draw(again.withColumn("attempt", F.lit(attempt)))))
    raise ValueError(f"no distinct surrogates after {ATTEMPTS} draws")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, text with surrogates, n_entities, kinds. `key` is the secret of the surrogates.

    An entity has one surrogate throughout the corpus under a key, and different entities of a kind have different
    ones, none of which is an entity of the corpus. Surrogates are computed in place; only entities whose first draw
    collides travel, to the documents that hold them. Null texts stay null with no entities; empty texts stay empty.
    Rows repeated whole get equal results, also those with a null id; texts are read whole; an empty df gives no rows.
    Columns other than the id and the text, whatever their names, aren't looked at.

    Names are found by their titles or by words such as "my name is", and replaced word by word: the words of "Mr John
    Smith" are replaced alike in "Mr. Smith", "Smith" and "JOHN SMITH" anywhere in that document, each counting as an
    entity, and titles and small words ("van") stay. Parts joined by hyphens are words; those with an apostrophe keep it.
    A word takes the gender of its first title that has one, else open. Initials before such a word become other
    letters; they have their own kind and alone don't tell people apart. Names that neither goes with aren't found.
    """
    text = F.col(text_col)
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), people(text).alias("named"))
    words = spellings(F.col("named"))
    mine = F.concat(F.lit(f"{ANY}|(?<!{LETTER})(?:"), words, F.lit(f")(?!{LETTER})|(?<!{LETTER})\\p{{Lu}}(?=\\.(?: ?\\p{{Lu}}\\.){{0,2}}[ \\xA0]?{SMALL}(?:"), words, F.lit(f")(?!{LETTER}))"))
    held = held.withColumn("pattern", F.when(F.size("named") > 0, mine).otherwise(F.lit(ANY))).withColumn("people", genders(F.col("named")))
    mentions = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", "pattern", F.lit(0)))
    held = held.withColumn("mentions", F.coalesce(mentions, F.array().cast("array<string>")))
    gender = lambda m: F.try_element_at("people", plain(m))
    kind = lambda m: F.when(F.length(m) == 1, F.lit("initial")).otherwise(F.coalesce(kind_of(m), F.lit("name")))
    held = held.withColumn("items", F.transform("mentions", lambda m: F.struct(m.alias("entity"), kind(m).alias("kind"), gender(m).alias("gender"))))
    canon = lambda x: F.when(x["kind"] == "name", F.concat_ws(" ", F.coalesce(x["gender"], F.lit("u")), plain(x["entity"]))).otherwise(canonical(x["entity"], x["kind"]))
    held = held.withColumn("items", F.transform("items", lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), canon(x).alias("canon"), F.lit(0).alias("attempt"))))
    each = written(held.where(F.size("mentions") > 0).select("doc_id", F.explode("items").alias("x")).where("x.kind <> 'initial'").select("doc_id", "x.kind", "x.canon").distinct())
    redrawn = collisions(each.select("kind", "canon").distinct(), key)
    if redrawn.isEmpty():
        held = held.withColumn("other", F.create_map().cast("map<string,string>"))
    else:
        of = each.join(redrawn.withColumnsRenamed({"kind": "x_kind", "canon": "x_canon"}), (F.col("kind") == F.col("x_kind")) & (F.col("canon") == F.col("x_canon")))
        maps = written(of.groupBy(F.col("doc_id").alias("m_id")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "surrogate"))).alias("other")))
        held = held.join(maps, F.col("doc_id").eqNullSafe(F.col("m_id")), "left").withColumn("other", F.coalesce("other", F.create_map().cast("map<string,string>")))

    def new(x: Column) -> Column:
        other = F.try_element_at(F.col("other"), F.concat_ws("|", x["kind"], x["canon"]))
        return F.when(x["kind"] == "initial", initial(x["entity"], key)).otherwise(rendered(x["entity"], x["kind"], F.coalesce(other, x["surrogate"])))

    held = drawn(held, "items", key)
    gaps = F.split("text", F.col("pattern"), -1)
    made = F.concat(F.transform("items", new), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(gaps, made, lambda g, s: F.concat(g, s)), "")
    return held.select(
        "doc_id",
        F.when(F.size("mentions") == 0, F.col("text")).otherwise(whole).alias("text"),
        F.size("mentions").cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform("items", lambda x: x["kind"]))).alias("kinds"),
    )
