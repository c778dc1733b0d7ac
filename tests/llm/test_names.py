"""Names in their many forms, account and security numbers: what is found, what stays and what its surrogate looks like."""

import random
import re

from starloom.llm import pii

RANDOM = random.Random(11)
FIRST = ["Jean-Luc", "Anne-Marie", "DeShawn", "Åsa", "Zoë", "María", "Xi", "Björn", "Siân", "Jean-luc"]
LAST = ["O'Brien", "D’Angelo", "McDonald", "N'diaye", "Smith-Jones", "Müller-Lüdenscheidt", "MacIntyre", "Nguyễn", "Łukasz", "DiCaprio", "Ta'anari"]
LINKS = ["", "", "van der ", "de la ", "von ", "bin "]
CYRILLIC = ["Анна", "Белл", "Римский-Корсаков", "Щёголев"]


def names(n):
    """(title, name): every title with names of several words, hyphens, apostrophes, inner capitals, initials and small words."""
    latin = [t for t in pii.TITLE.split("|") if not re.search("[а-я]", t)]
    for i in range(n):
        title = latin[i % len(latin)] + RANDOM.choice(["", "."])
        words = [RANDOM.choice(FIRST)][: RANDOM.randrange(2)] + [RANDOM.choice(LAST) for _ in range(RANDOM.randrange(1, 3))]
        middle = RANDOM.choice(["", "", "Q. ", "J. R. "]) if len(words) > 1 else ""
        name = " ".join(words[:-1]) + (" " if words[1:] else "") + middle + RANDOM.choice(LINKS) + words[-1]
        yield title, name.upper() if i % 17 == 0 else name
    for title in ("господин", "госпожа", "Доктор", "г-н"):
        yield title, f"{RANDOM.choice(CYRILLIC)} {RANDOM.choice(CYRILLIC)}"
    for cue in ("My name is", "me llamo", "mein Name ist", "Меня зовут"):
        yield cue, f"{RANDOM.choice(FIRST)} {RANDOM.choice(LAST)}"


def parts(name):
    """The words of a name; small words stay unless in capitals, and initials become other letters."""
    return [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", name) if len(w) > 1 and w not in pii.PARTICLES]


def test_no_part_of_a_name_survives(spark):
    rows = [(i, t, n, f"Then {t} {n} said so. {n}'s car, {parts(n)[-1]} and {parts(n)[0].upper()}.") for i, (t, n) in enumerate(names(300))]
    found = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, title string, name string, text string"), "k").collect()}
    for i, title, name, text in rows:
        new = found[i]["text"]
        assert title in new and not any(re.search(rf"(?<![^\W\d_]){re.escape(p)}(?![^\W\d_])", new, re.I) for p in parts(name)), (text, new)
        assert found[i]["n_entities"] == 2 * (len(parts(name)) + len(re.findall(r"\b[A-Z]\.", name))) + 2, (text, new)


def test_forms_of_names_are_kept(spark):
    texts = [
        "Prof. Dr. Jean-Luc O'Brien met MR JOHN SMITH; Smith saw O’Brien and Jean.",
        "Dr Ada Weber. Frau Weber is here, Ada too.",
        "Mr J. R. Tolk wrote. J. R. Tolk, A Tolk and J. alone; Mr Smith Dr Jones.",
        "Dr No's Mr X, Mr. and Mrs, Missing Mrsa, DR Congo, Srta",
        "Miss Ω. Tolk and Mr Q. Tolk and Mr R. Tolk",
    ]
    found = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").collect()]
    a = re.fullmatch(r"Prof\. Dr\. (\w+l)-(\w+l) (\w'\w+l) met MR ([A-Z]+N) ([A-Z]+N); (\w+n) saw (\w’\w+l) and \1\.", found[0])
    assert a and a[6].upper() == a[5] and a[7].replace("’", "'") == a[3] and a[3][0] == a[3][2]
    b = re.fullmatch(r"Dr (\w+l) (\w+na)\. Frau \2 is here, \1 too\.", found[1])
    assert b
    c = re.fullmatch(r"Mr ([A-Z])\. ([A-Z])\. (\w+n) wrote\. \1\. \2\. \3, A \3 and J\. alone; Mr \w+n Dr \w+l\.", found[2])
    assert c and c[1] != "J" and c[2] != "R" and c[1] != c[2]
    assert re.fullmatch(r"Dr \w+l's Mr X, Mr\. and Mrs, Missing Mrsa, DR Congo, Srta", found[3])
    d = re.fullmatch(r"Miss X\. (\w+na) and Mr ([A-Z])\. \1 and Mr ([A-Z])\. \1", found[4])
    assert d and d[2] != d[3] and "Q" != d[2]


def test_initials_stay_apart(spark):
    letters = "".join(pii.ALPHABETS)
    docs = spark.createDataFrame([(i, f"Mr {c}. Tolk") for i, c in enumerate(letters)], "doc_id long, text string")
    for key in ("k", "another"):
        new = {letters[r["doc_id"]]: r["text"].split()[1][0] for r in pii.replace(docs, key).collect()}
        assert len(set(new.values())) == len(letters) and all(a != b and (a < "А") == (b < "А") for a, b in new.items())


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_accounts_and_security_numbers(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432 now", "DE89370400440532013000", "DE88370400440532013000", "SSN 123-45-6789, 123-45-6789, not 000-12-3456 or 900-12-3456", "4532015112830366 and 412-34-5678"]
    found = [r for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").collect()]
    a = re.fullmatch(r"pay (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) or (GB\w{20}) now", found[0]["text"])
    assert a and a[1].replace(" ", "") == a[2] and mod97(a[2]) == 1 and "WEST" not in a[2]
    assert mod97(found[1]["text"]) == 1 and mod97(found[2]["text"]) != 1 and found[1]["text"][:2] == found[2]["text"][:2] == "DE"
    b = re.fullmatch(r"SSN (\d{3}-\d\d-\d{4}), \1, not 000-12-3456 or 900-12-3456", found[3]["text"])
    assert b and b[1] != "123-45-6789" and re.fullmatch(pii.PATTERNS["ssn"], b[1]) and found[3]["kinds"] == ["ssn"]
    assert found[4]["kinds"] == ["card", "ssn"]
