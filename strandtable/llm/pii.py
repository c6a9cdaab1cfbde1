"""Surrogates for personal data, in native DataFrame expressions throughout.

Entities (e-mail, IPv4 and IPv6 addresses, phone, card and social security numbers, IBANs, secret keys, names
with a title or a known given name) are found in whole texts by one pattern and replaced by surrogates
that a secret key decides. Every map is one to one, so that no number of entities can collide:

- ``scramble`` permutes the letters and digits of a word within their classes (vowels, consonants, digits;
  Latin, Cyrillic, Greek, Hebrew, Arabic; the scripts' rarer letters, such as ``ő``, are a class of their own):
  length, script, punctuation and case stay, a first letter of these classes always changes, and any two
  words stay different;
- numbers keep their format; cards and IBANs stay as valid or invalid as they were; phones keep country code
  and trunk zero, so ``+49 30 ...`` and ``030 ...`` stay one number; key prefixes stay;
- e-mail addresses keep their shape and top-level domain; one domain always becomes the same other one;
- names keep title, gender and script: known given names become others of that gender and script by a keyed
  shift of the list, other names are scrambled (the last letters, which carry gender, stay in given names and
  in Cyrillic and Greek names), each part on its own, so ``Mr Smith`` and ``John Smith`` stay related.

Mentions of one entity in another case or punctuation get one surrogate (coreference), and a family name found
in a text is replaced where it stands alone in that text as well (capitalised). Distinctness and coreference are
checked over all entities of the result; should an entity have two surrogates or two entities share one, the whole
result is returned all the same, and those entities are written to the shared folder and logged (``clashes``).
Not found: names without title or listed given name in texts that name the person in no other way, names in
other scripts (such as Han), and lower-case names.

Scale. One pass matches the pattern once and writes texts with their entities; the check shuffles one row per
distinct entity of a map task. Texts are not shuffled and no row is exploded for the replacement.

Nulls and odd rows: a null text stays null with no entities; empty texts and texts without entities come
back as they are; repeated rows are replaced alike. Columns other than doc_id and text are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Titles and common given names by gender and script; letters by class; country calling codes; key prefixes.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don Господин г-н Κύριος".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Госпожа г-жа Κυρία".split()
OTHER_TITLES = "Dr Prof Доктор Профессор Δρ".split()
MALE_NAMES = [
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Stefan Pierre Jean Michel Jacques José Juan Carlos Luis Miguel".split(),
    "Александр Сергей Дмитрий Андрей Алексей Иван Николай Владимир Михаил Павел".split(),
    "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης".split(),
]
FEMALE_NAMES = [
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Anna Laura Alice Ursula Monika Petra Claudia Marie Sophie Nathalie Isabelle Carmen María Lucía Ana Elena".split(),
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
]
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "çñšžčřłśź", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"]
# The other letters of these scripts with one upper and one lower form each, a class for each script.
for _ranges in ([(0xDF, 0x250), (0x1E00, 0x1F00)], [(0x430, 0x530)], [(0x370, 0x400), (0x1F00, 0x2000)]):
    _more = [chr(c) for a, b in _ranges for c in range(a, b) if chr(c) not in "".join(CLASSES)]
    CLASSES.append("".join(c for c in _more if c != c.upper() and len(c.upper()) == 1 and c.upper().lower() == c and c.title() == c.upper()))
HEX = "0123456789abcdef"
CALLING_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
KEY_PREFIX = r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|sk-(?:proj-)?|xox[abprs]-|glpat-"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,24}"
SECRET = rf"(?<=[\"'])[0-9a-fA-F]{{32,64}}(?=[\"'])|(?<![\p{{L}}\p{{N}}_-])(?:{KEY_PREFIX})[0-9A-Za-z_-]{{16,255}}+|(?<=[:=\s\"'])(?=[0-9A-Za-z+/_-]{{16}})(?=[0-9A-Za-z+/_-]*\d)(?<=(?i:key|token|secret|password)[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[0-9A-Za-z+/_-]{{16,255}}+"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\d])"
IPV6 = rf"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![\w:])"
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"
CARD = r"(?<![\d.-])(?:\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|[3-6]\d{12,18})(?![\d-]|\.\d)"
PHONE = (
    r"(?<![\d\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d\w+])\+[1-9](?:[ ./()-]{0,2}\d){6,13}(?!\d)"
    r"|(?<![\d\w.-])0[1-9](?:[ .-]\d{2}){4}(?![\d-])|(?<![\d\w.-])0[1-9]\d{1,3}[ /-]\d{5,9}(?![\d-])|(?<![\d\w.-])[2-9]\d{9}(?![\d\w-]|\.\d)"
)
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_ALL_TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
_ALL_NAMES = [n for names in MALE_NAMES + FEMALE_NAMES for n in names]
_either = lambda words: "|".join(dict.fromkeys(x for w in words for x in (w, w.upper())))
_TITLES, _GIVEN = _either(_ALL_TITLES), _either(_ALL_NAMES)
_WORD = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]][\p{L}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]+"
NAME = rf"(?<![\p{{L}}\d])(?=[\p{{Lu}}г])(?:(?:{_TITLES})\.? (?:{_WORD}|[\p{{IsHebrew}}\p{{IsArabic}}]{{2,}})(?:[ -]{_WORD})?|(?:{_GIVEN})(?: {_WORD}))"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "card": CARD, "ipv6": IPV6, "ip": IP, "phone": PHONE, "ssn": SSN, "name": NAME}
#: One group for each kind; no kind has groups of its own.
PATTERN = "|".join(f"({p})" for p in KINDS.values())
_PLAIN = r"^[0-9a-fA-F]+$"
# Private-use characters that mark mentions in a text, and the groups in a mention.
_MARK, _NEXT = "\ue000", "\ue001"
_LETTERS = "".join(CLASSES)
# For each letter, where its class begins and how many letters it has, as a character (plain numbers would be hundreds of literals).
_FIRST = "".join(chr(1000 + _LETTERS.index(c[0])) for c in CLASSES for _ in c)
_SIZE = "".join(chr(1000 + len(c)) for c in CLASSES for _ in c)
# The most listed given names of one pattern of classes and one kept last letter.
_WALK = max(Counter((tuple(_FIRST[_LETTERS.index(c)] for c in n[: len(n) - (len(n) > 3)]), n[len(n) - (len(n) > 3) :]) for n in {n.lower() for n in _ALL_NAMES}).values())


# Expressions are kept shallow: Spark resolves nested lambdas one level a round, so long maps are stages of columns.


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 512)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _moved(text: Column, by: Column, whole: Column, least: int = 0) -> Column:
    """``text`` with every letter moved on within its class (``whole``: within the hexadecimal digits).

    ``by`` has hexadecimal digits for each place. With ``least`` 1 no place keeps its letter.
    """
    told = lambda table, p: F.ascii(F.substring(F.lit(table), p, F.lit(1))) - 1000

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(by, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        hexadecimal = lambda p: F.substring(F.lit(HEX), (p - 1 + least + step % (16 - least)) % 16 + 1, F.lit(1))
        classed = lambda p: F.substring(F.lit(_LETTERS), told(_FIRST, p) + (p - 1 - told(_FIRST, p) + least + step % (told(_SIZE, p) - least)) % told(_SIZE, p) + 1, F.lit(1))
        at = F.instr(F.when(whole, F.lit(HEX)).otherwise(F.lit(_LETTERS)), c)
        return _let(at, lambda p: F.when(p == 0, c).when(whole, hexadecimal(p)).otherwise(classed(p)))

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _each(jobs: str, change) -> Column:
    """Every job of every mention changed: ``change(job)`` has the fields of the new struct."""
    return F.transform(jobs, lambda js: F.transform(js, lambda j: F.struct(*change(j))))


def scramble(rows: DataFrame, jobs: str, out: str, secret: str) -> DataFrame:
    """Add ``out``: the words of ``jobs`` (array<array<struct<tag, word, whole>>>) mapped one to one, without fixed points.

    The first letter moves on by what the rest decides, but never by nothing; then, keyed by the new first
    letter, the halves of the rest move each other on in three rounds. Empty words stay empty.
    """
    same = lambda j, *names: [j[n].alias(n) for n in names]
    key = F.lit(f"{secret}\u001e")
    rest = lambda j: F.substring(j["word"], F.lit(2), F.length(j["word"]))
    half = lambda j: (F.length(j["rest"]) / 2).cast("int")
    rows = rows.withColumn("_w", _each(jobs, lambda j: [*same(j, "tag", "whole", "word"), F.substring(j["word"], 1, 1).alias("f"), rest(j).alias("rest"), _hash(key, j["tag"], F.lit("first"), rest(j)).alias("h")]))
    rows = rows.withColumn("_w", _each("_w", lambda j: [*same(j, "tag", "whole", "word"), _moved(j["f"], j["h"], j["whole"], 1).alias("f"), F.substring(j["rest"], F.lit(1), half(j)).alias("l"), F.substring(j["rest"], half(j) + 1, F.length(j["rest"])).alias("r")]))
    for k, (move, by) in enumerate((("l", "r"), ("r", "l"), ("l", "r"))):
        rows = rows.withColumn("_w", _each("_w", lambda j, k=k, by=by: [*same(j, "tag", "whole", "word", "f", "l", "r"), _hash(key, j["tag"], F.lit(str(k)), j["f"], j[by]).alias("h")]))
        rows = rows.withColumn("_w", _each("_w", lambda j, move=move, by=by: [*same(j, "tag", "whole", "word", "f", by), _moved(j[move], j["h"], j["whole"]).alias(move)]))
    made = lambda j: F.concat(j["f"], j["l"], j["r"])
    return rows.withColumn(out, F.transform("_w", lambda js: F.transform(js, lambda j: made(j)))).drop("_w")


def _fill(mention: Column, digits: Column, place: str = r"\d") -> Column:
    """``mention`` with the places of ``place`` taken, in turn, by ``digits``."""
    return F.array_join(F.transform(F.split(mention, place, -1), lambda p, i: F.concat(p, F.substring(digits, i + 1, F.lit(1)))), "")


def _lower(text: Column) -> Column:
    """Lower case at the same length: a capital I with a dot becomes a plain i."""
    return F.lower(F.translate(text, "\u0130", "I"))


def _cased(like: Column, made: Column) -> Column:
    """Upper case if ``like`` is so in all its letters."""
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(made)).otherwise(made)


def _cased_by_place(like: Column, made: Column) -> Column:
    """Each place in upper case where ``like`` is; for words of the same length."""
    return F.array_join(F.zip_with(F.split(made, ""), F.split(like, ""), lambda m, c: F.when(c != F.lower(c), F.upper(m)).otherwise(F.coalesce(m, F.lit("")))), "")


def _digits(mention: Column) -> Column:
    return F.regexp_replace(mention, r"\D", "")


def _luhn(body: Column) -> Column:
    """The check digit for a card's other digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add) % 10, F.lit(10))


def _card(mention: Column, body: Column) -> Column:
    """A new body, whose check digit is off by as much as it was."""
    digits = _digits(mention)
    error = F.substring(digits, -1, 1).cast("int") - _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1))
    return _fill(mention, F.concat(body, F.pmod(_luhn(body) + error, F.lit(10)).cast("string")))


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account (letters and digits) in a country."""
    digit = lambda c: c.between("0", "9")
    step = lambda total, c: F.when(c == "", total).otherwise((total * F.when(digit(c), 10).otherwise(100) + F.ascii(c) - F.when(digit(c), 48).otherwise(55)) % 97)
    return F.lpad((98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)).cast("string"), 2, "0")


def _iban(mention: Column, account: Column) -> Column:
    """A new account; check digits that were right are right again, and trade places with those that would be."""
    plain = F.regexp_replace(mention, " ", "")
    country, check, made = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.upper(account)
    old, right = _iban_check(country, F.substring(plain, F.lit(5), F.length(plain))), _iban_check(country, made)
    return _fill(mention, F.concat(country, F.when(check == old, right).when(check == right, old).otherwise(check), made), "[0-9A-Z]")


def _gap() -> str:
    """What lies between the words of a name; titles may have a hyphen."""
    return r"(?<!^[гГ])[ -]"


def _titled(mention: Column) -> Column:
    return mention.rlike(rf"^(?:{_TITLES})\.? ")


def _shifted(secret: str, word: Column) -> Column:
    """A listed given name (lower case) as another one of its gender and script; null for other words."""
    out = F.lit(None).cast("string")
    for k, names in enumerate(MALE_NAMES + FEMALE_NAMES):
        low, proper = (F.split(F.lit(" ".join(x)), " ") for x in ([n.lower() for n in names], names))
        step = 1 + F.pmod(F.conv(F.substring(_hash(F.lit(f"{secret}\u001enames{k}")), 1, 14), 16, 10).cast("long"), F.lit(len(names) - 1))
        out = F.when(F.array_contains(low, word), F.element_at(proper, ((F.array_position(low, word) - 1 + step) % len(names) + 1).cast("int"))).otherwise(out)
    return out


def _job(tag: str | Column, word: Column, before: Column | str = "", after: Column | str = "", like: Column | str = "", whole: bool | Column = False) -> Column:
    """A word to scramble (lower case), what stays before and after it, and the word whose case it takes."""
    plain = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    return F.struct(plain(tag).alias("tag"), word.alias("word"), plain(before).alias("before"), plain(after).alias("after"), plain(like).alias("like"), plain(whole).alias("whole"))


def _name_jobs(secret: str, mention: Column) -> Column:
    def job(w: Column, i: Column) -> Column:
        low, n = _lower(w), F.size(F.split(mention, _gap()))
        title = (i == 0) & _titled(mention)
        given = F.when(_titled(mention), (i == 1) & (n == 3)).otherwise(i == 0)
        new = F.when(given, _shifted(secret, low))
        # The last letters carry gender: they stay in given names, and in Cyrillic and Greek names.
        keep = F.when(given, (F.length(w) > 3).cast("int")).when((F.length(w) > 4) & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), 2).otherwise(0)
        stays = title | new.isNotNull()
        word = F.when(stays, "").otherwise(F.substring(low, F.lit(1), F.length(w) - keep))
        after = F.when(stays, "").otherwise(F.substring(low, F.length(w) - keep + 1, keep))
        return _job(F.when(given, "given").otherwise("family"), word, F.when(title, w).otherwise(F.coalesce(_cased(w, new), F.lit(""))), after, F.when(stays, "").otherwise(w))

    return F.transform(F.split(mention, _gap()), job)


def _jobs(secret: str, m: Column) -> Column:
    """What is scrambled in a mention."""
    kind, mention = m["kind"], m["mention"]
    low, digits, plain = F.lower(mention), _digits(mention), F.regexp_replace(mention, " ", "")
    domain = F.substring_index(low, "@", -1)
    top = F.substring_index(domain, ".", -1)
    prefix = F.when(mention.rlike(_PLAIN), "").otherwise(F.regexp_extract(mention, f"^(?:{KEY_PREFIX})", 0))
    secret_word = F.substring(mention, F.length(prefix) + 1, F.length(mention))
    hexed = lambda i: F.lpad(F.lower(F.hex(F.split(mention, r"\.")[i].cast("int"))), 2, "0")
    kept = F.when(mention.startswith("+"), F.length(F.regexp_extract(digits, f"^(?:{CALLING_CODE})", 0))).when(digits.startswith("0"), 1).otherwise(0)
    return (
        F.when(kind == "email", F.array(_job("local", F.substring_index(low, "@", 1)), _job("domain", F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), after=top)))
        .when(kind == "secret", F.array(_job("secret", F.lower(secret_word), prefix, like=F.when(mention.rlike(_PLAIN), "").otherwise(secret_word), whole=mention.rlike(_PLAIN))))
        .when(kind == "iban", F.array(_job("iban", F.lower(F.substring(plain, F.lit(5), F.length(plain))))))
        .when(kind == "card", F.array(_job("card", F.substring(digits, F.lit(1), F.length(digits) - 1))))
        .when(kind == "ipv6", F.array(_job("ipv6", low, whole=True)))
        .when(kind == "ip", F.array(_job("ip", F.concat(*map(hexed, range(4))), whole=True)))
        .when(kind == "phone", F.array(_job("phone", F.substring(digits, kept + 1, F.length(digits)), F.substring(digits, F.lit(1), kept))))
        .when(kind == "ssn", F.array(_job("ssn", digits)))
        .otherwise(_name_jobs(secret, mention))
    )


def _assembled(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate of a mention from its scrambled parts."""
    octets = F.concat_ws(".", *[F.conv(F.substring(made[0], 2 * k + 1, 2), 16, 10) for k in range(4)])
    gaps = F.concat(F.regexp_extract_all(mention, F.lit(_gap()), F.lit(0)), F.array(F.lit("")))
    return (
        F.when(kind == "email", _cased(mention, F.concat_ws("@", made))).when(kind.isin("secret", "ipv6"), _cased(mention, made[0])).when(kind == "iban", _iban(mention, made[0]))
        .when(kind == "card", _card(mention, made[0])).when(kind == "ip", octets).when(kind.isin("phone", "ssn"), _fill(mention, made[0]))
        .otherwise(F.array_join(F.zip_with(made, gaps, lambda w, g: F.concat(w, g)), ""))
    )


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all ways to write an entity."""
    plain = F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}.:+]", ""))
    return F.when(kind.isin("email", "name"), _lower(mention)).when((kind == "secret") & ~mention.rlike(_PLAIN), mention).otherwise(plain)


def _marked(text: Column) -> Column:
    """Pieces of the text: every second one is a mention, its text in the group of its kind."""
    groups = _NEXT.join(f"${k + 1}" for k in range(len(KINDS)))
    return F.split(F.regexp_replace(text, PATTERN, f"{_MARK}{groups}{_MARK}"), _MARK, -1)


def _mention(piece: Column) -> Column:
    """(kind, mention) of a marked piece."""
    at = F.array_position(F.transform(F.split(piece, _NEXT, -1), lambda x: x != ""), True)
    return F.struct(F.get(F.split(F.lit(" ".join(KINDS)), " "), (at - 1).cast("int")).alias("kind"), F.replace(piece, F.lit(_NEXT), F.lit("")).alias("mention"))


def _alone(piece: Column, names: Column) -> Column:
    """``piece`` with the family names of ``names`` (old, new) replaced where they stand alone."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\d])(?:"), F.array_join(F.flatten(F.transform(names, lambda n: F.array(F.initcap(n["old"]), F.upper(n["old"])))), "|"), F.lit(r")(?![\p{L}\d])"))
    found = F.split(F.regexp_replace(piece, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    new = lambda x: F.filter(names, lambda n: n["old"] == F.lower(x))[0]["new"]
    return F.array_join(F.transform(found, lambda x, i: F.when(i % 2 == 1, F.when(F.upper(x) == x, F.upper(new(x))).otherwise(F.initcap(new(x)))).otherwise(x)), "")


#: The marks' own characters step aside for the time of the match, so that any text comes back whole.
_ASIDE = [("", "o"), (_MARK, "m"), (_NEXT, "n")]


def _swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.when(text.rlike("[-]"), reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)).otherwise(text)


def surrogates(docs: DataFrame, secret: str) -> DataFrame:
    """(doc_id, text, n_entities): each text with surrogates in place of its entities.

    n_entities counts the mentions that the pattern finds, not the family names that stand alone.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_p", _marked(_swapped(F.col("text"), _ASIDE)))
    rows = rows.withColumn("_m", F.transform(F.filter("_p", lambda p, i: i % 2 == 1), _mention))
    rows = rows.withColumn("_j", F.transform("_m", lambda m: _jobs(secret, m)))
    rows = scramble(rows, "_j", "_s", secret)
    # A given name that would come out as a listed one goes on through the same map until it is none, so that it cannot be that name's
    # surrogate. Listed names of one pattern of letters and one ending are few, and each is met once at most.
    listed = F.split(F.lit(" ".join(n.lower() for n in _ALL_NAMES)), " ")
    for _ in range(_WALK):
        met = lambda j, x: (j["tag"] == "given") & (x != "") & F.array_contains(listed, F.concat(x, j["after"]))
        again = lambda j, x: F.struct(j["tag"].alias("tag"), F.when(met(j, x), x).otherwise("").alias("word"), F.lit(False).alias("whole"))
        rows = rows.withColumn("_again", F.zip_with("_j", "_s", lambda js, ss: F.zip_with(js, ss, again)))
        rows = scramble(rows, "_again", "_t", secret)
        rows = rows.withColumn("_s", F.zip_with("_s", "_t", lambda ss, ts: F.zip_with(ss, ts, lambda x, t: F.when(t != "", t).otherwise(x))))
    whole = lambda j, x: F.concat(j["before"], F.when(j["like"] != "", _cased_by_place(j["like"], F.concat(x, j["after"]))).otherwise(F.concat(x, j["after"])))
    rows = rows.withColumn("_s", F.zip_with("_j", "_s", lambda js, ss: F.zip_with(js, ss, whole)))
    rows = rows.withColumn("_e", F.zip_with("_m", "_s", lambda m, ss: F.struct(m["kind"].alias("kind"), m["mention"].alias("mention"), _assembled(m["kind"], m["mention"], ss).alias("new"))))
    family = lambda js, ss: F.struct(F.lower(F.element_at(js, -1)["like"]).alias("old"), F.lower(F.element_at(ss, -1)).alias("new"))
    names = F.filter(F.zip_with("_j", "_s", lambda js, ss: F.when(F.element_at(js, -1)["tag"] == "family", family(js, ss))), lambda n: n.isNotNull() & (F.length(n["old"]) > 2))
    rows = rows.withColumn("_n", F.array_distinct(names))
    between = F.filter("_p", lambda p, i: i % 2 == 0)
    rows = rows.withColumn("_b", F.when(F.size("_n") > 0, F.transform(between, lambda p: _alone(p, F.col("_n")))).otherwise(between))
    text = F.array_join(F.zip_with("_b", F.concat(F.transform("_e", lambda e: e["new"]), F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    text = F.when(F.size("_p") > 1, _swapped(text, [(b, a) for a, b in reversed(_ASIDE)])).otherwise(F.col("text"))
    made = table(rows.select("doc_id", text.alias("text"), F.coalesce(F.when(F.size("_m") > 0, F.size("_m")), F.lit(0)).alias("n_entities"), "_e"), "pii-texts")
    met = table(clashes(made.select(F.explode("_e").alias("e")).select("e.*")), "pii-clashes")
    if not met.isEmpty():
        logging.getLogger(__name__).warning("entities share a surrogate or have several; they are listed in %s", met._shared_path)
    return made.select("doc_id", "text", "n_entities")


def clashes(found: DataFrame) -> DataFrame:
    """(kind, entity, new): entities of (kind, mention, new) that have two surrogates, or share one with another entity."""
    pairs = found.select("kind", canonical(F.col("kind"), F.col("mention")).alias("entity"), canonical(F.col("kind"), F.col("new")).alias("new")).distinct()
    pairs = table(pairs, "pii-entities")
    out = None
    for one in ("entity", "new"):
        bad = pairs.groupBy("kind", one).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", one)
        some = pairs.join(bad, ["kind", one], "left_semi").select("kind", "entity", "new")
        out = some if out is None else out.union(some)
    return out.distinct()
