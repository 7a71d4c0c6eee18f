"""Keyed surrogates for personal data, in DataFrame expressions only.

Found are e-mail addresses, keys and tokens, IBANs, IPv4 addresses, card
numbers, telephone and social security numbers, and names after titles or
with a listed given name (also in capitals, with up to two more words): any number of words with inner capitals, apostrophes
and hyphens, with particles and initials between them. White space may be wide;
a line may break after a title, or after a title and a listed given name. In a
document that has a name, its surnames are mentions wherever they stand alone,
capitalised or in capitals. A mention is made of units: a number's digits, an
address in lower case, each word of a name (the first of several is a given
name, others are surnames unless listed). Titles and particles stay; initials
turn by a keyed number of letters. A unit has one surrogate in the
whole corpus, a function of the secret key, its kind and itself, so mentions
that differ in punctuation, case or title stay coreferent ("Mr Smith", "John
Smith"). The surrogate has the unit's type and format: digits for digits,
letters for letters of the same case, the same separators and lengths, valid
check digits where they were (cards, IBANs), a given name of the same gender, names in the
same script. Letters of an address beyond a-z become other letters of their
script (`LETTERS`; scripts without a pool share one), digits become digits. Text
in a script without spaces before an address in other letters is not a part of
it; if the local part ends in such a script (and up to four digits), the whole
run is replaced, since nothing shows where the address begins.

Collision check: over the distinct units, no two of a kind may have the same
surrogate and no surrogate may be a unit of the corpus. Units that fail draw
again with the next attempt number until all are distinct. Names get longer
with the attempts, and from attempt 16 on every other format grows by a digit an
attempt (an address gets a further part), so no supply runs out: a full format
overflows into a wider one instead of ending the query.

Shuffled are the mentions and distinct units, and the texts that have a
mention; other texts stay in their scan.

Defined results: a NULL text stays NULL and has no mentions. Rows equal in
doc_id and text are treated once and get the same result. All columns are kept.
Two mentions that touch are two mentions; overlapping patterns go to the one
listed first.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

# Titles that announce a name, by gender; given names by gender and script; syllables of surnames (fixed values).
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Herrn", "M", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Doña", "госпожа", "г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "Pablo", "Diego", "Martin"],
    ("f", "latin"): ["Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Julia", "Emma", "Alice", "Heidi", "Ursula", "Claire", "Sophie", "Marie", "Lucía", "Carmen", "Elena", "Rosa", "Martha"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Андрей", "Николай", "Дмитрий", "Павел", "Михаил", "Юрий", "Олег"],
    ("m", "greek"): ["Γιώργος", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Παναγιώτης", "Βασίλης", "Χρήστος", "Θανάσης", "Μιχάλης"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Κατερίνα", "Βασιλική", "Σοφία", "Αγγελική", "Γεωργία", "Δήμητρα", "Κωνσταντίνα", "Παρασκευή"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна", "Вера", "Нина"],
}
SYLLABLES = {
    "latin": (["Bar", "Cal", "Der", "Fen", "Gar", "Hol", "Kel", "Lan", "Mar", "Nor", "Pel", "Ros", "Sal", "Tor", "Ver", "Wen"],
              ["a", "be", "di", "ka", "lo", "ma", "ne", "ri", "so", "ta", "u", "vi"],
              ["berg", "den", "field", "ham", "ler", "mann", "nell", "ton", "vale", "win"]),
    "cyrillic": (["Бар", "Вол", "Гор", "Дем", "Зар", "Кал", "Лаз", "Мор", "Ник", "Ром", "Сав", "Тар"],
                 ["а", "е", "и", "о", "у", "ми", "ра", "то"],
                 ["нов", "ров", "лев", "шин", "дин", "ский"]),
    "greek": (["Βαρ", "Γαλ", "Δερ", "Καλ", "Λαν", "Μαρ", "Νικ", "Παπ", "Ρομ", "Σαλ", "Τορ", "Φεν"],
              ["α", "ε", "ι", "ο", "ου", "μι", "ρα", "το"],
              ["δης", "κης", "λης", "νος", "πουλος", "ρας"]),
}

# Scripts written without spaces: a mention in other letters may begin right after their text.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# Their text lies beyond U+0DFF, which is cheaper to ask first.
_LEFT, _RIGHT = rf"(?:(?<![\p{{L}}\p{{N}}])|(?<![\x00-\x{{0DFF}}])(?<=[{_UNSPACED}])(?![{_UNSPACED}]))", r"(?![\p{L}\p{N}])"
# Pools of surrogate letters by script, in lower case; the last one serves all other scripts.
LETTERS = [
    (r"\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsLatin}", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"\p{IsDevanagari}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"), (r"\p{IsThai}", "กขคงจฉชซญฐณดตถทธนบปผพฟภมยรลวสหอ"),
    (r"\p{L}", "安白成大东方高国海和华江建金九开来林明南平青山水天文小新永元"),
]
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))
# A name word: a capital and more letters, inner capitals included; not the English endings 's, 'll and the like.
_LETTER = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}"
_JOIN = rf"(?:-(?=\p{{Lu}})|['’](?!(?i:s|d|m|t|ll|re|ve)(?![{_LETTER}\p{{N}}])))[{_LETTER}]+"
_WORD = rf"(?=\p{{Lu}})[{_LETTER}](?:[{_LETTER}]+(?:{_JOIN})*|(?:{_JOIN})+)"
_SPACE = r"[\t\p{Zs}]{1,8}"
_BREAK = rf"(?:{_SPACE}|[\t\p{{Zs}}]{{0,8}}\r?\n[\t\p{{Zs}}]{{0,8}})"
_INITIAL = rf"\p{{Lu}}(?![{_LETTER}\p{{N}}'’-])"
PARTICLES = ["van", "von", "vom", "der", "den", "dem", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "las", "le", "los", "bin", "ibn", "al", "el", "ten", "ter", "zu", "zum", "zur", "y", "af", "av"]
_BETWEEN = rf"(?:{_INITIAL}(?:\.(?:{_SPACE})?|{_SPACE})|(?:{'|'.join(PARTICLES)}){_SPACE}|(?:al|el)-|[dl]['’](?=\p{{Lu}}))*+"
# A title before a capital begins another mention; "M." may as well be an initial.
_NEXT = rf"(?!(?:{'|'.join(t for t in _TITLE.split('|') if len(t) > 1)})\.?{_BREAK}{_BETWEEN}\p{{Lu}})"
_NAMES = rf"{_BETWEEN}{_WORD}(?:{_SPACE}{_NEXT}{_BETWEEN}{_WORD})*"
_TITLES = rf"(?:(?:{_TITLE})\.?{_BREAK})+"
_END = rf"(?![{_LETTER}\p{{N}}])"
# Listed given names in capitals take at most two more words: the rest of the text may be in capitals too.
_UPPER_JOIN = _JOIN.replace(f"[{_LETTER}]+", r"[\p{Lu}\p{M}]+")
_UPPER = rf"\p{{Lu}}(?:[\p{{Lu}}\p{{M}}]+(?:{_UPPER_JOIN})*|(?:{_UPPER_JOIN})+)"
_UPPER_NAME = rf"(?:{_GIVEN.upper()})(?:-{_UPPER})?(?:{_SPACE}{_NEXT}{_BETWEEN}{_UPPER}){{1,2}}"
# Kinds in order of precedence. A mention never begins inside a word (`ANY` checks that once for all kinds).
PATTERNS = {
    "email": rf"(?=[\p{{L}}\p{{M}}\p{{N}}._%+-]++@)(?:[\p{{L}}\p{{M}}\p{{N}}._%+-]++(?<=[{_UNSPACED}][._%+-]{{0,3}}\p{{N}}{{0,4}})|[\p{{L}}\p{{M}}\p{{N}}._%+\-&&[^{_UNSPACED}]]++)@" r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}|(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,128})" + _RIGHT,
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT,
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}" + _RIGHT,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _RIGHT,
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _RIGHT,
    "name": f"(?=[\\p{{Lu}}г])(?:{_TITLES}(?:(?:{_GIVEN}){_BREAK})?{_NAMES}|(?:{_GIVEN})(?:-{_WORD})?{_SPACE}{_NAMES}|{_UPPER_NAME}){_END}",
}
_KINDS = "|".join(PATTERNS.values())
ANY = f"{_LEFT}(?:{_KINDS})"
# The words of a name, without its particles and initials.
_TOKEN = rf"(?<![{_LETTER}\p{{N}}]){_WORD}|(?<=(?<![{_LETTER}])[dl]['’]){_WORD}"
KEY = ("__tw_id", "__tw_hash")


@dataclass(frozen=True)
class Surrogates:
    key: str
    attempts: int = 16  # draws in the unit's own format, before it grows by a character an attempt


def _keyed(docs: DataFrame) -> dict[str, Column]:
    return {"__tw_id": F.col("doc_id").cast("long"), "__tw_hash": F.xxhash64("text")}


def _pick(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(draw, F.lit(len(values))) + 1).cast("int"))


def _kind(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention (its surroundings were checked when it was found)."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("name")


def _name_words(mention: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(mention, f"^{_TITLES}", ""), F.lit(_TOKEN), F.lit(0))


def _is_surname(words: Column, word: Column, i: Column) -> Column:
    """The last word, and middle ones that are no listed given names."""
    given = [n for ns in GIVEN.values() for n in ns]
    return (i == F.size(words) - 1) | (i > 0) & ~F.initcap(word).isin(given)


def _bare(found: Column) -> Column:
    """A pattern of the bare surnames of the names among a document's mentions; NULL without names."""
    names = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    surnames = F.flatten(F.transform(names, lambda m: _surnames(_name_words(m))))
    # Capitalised and in capitals; longer words first, so that none ends another one.
    forms = F.flatten(F.transform(surnames, lambda w: F.array(w, F.upper(w), F.when(w == F.upper(w), F.initcap(F.lower(w))).otherwise(w))))
    text = F.array_join(F.reverse(F.array_sort(F.array_distinct(forms))), "|")
    return F.when(text != "", F.concat(F.lit(f"{_LEFT}(?:"), text, F.lit(f"){_END}")))


def _with_bare(found: Column, gaps: Column, bare: Column) -> Column:
    """The mentions `found` between `gaps`, with the bare surnames of the gaps."""
    more = F.zip_with(gaps, found, lambda g, m: F.concat(F.regexp_extract_all(g, bare, F.lit(0)), F.when(m.isNull(), F.array().cast("array<string>")).otherwise(F.array(m))))
    return F.when(bare.isNull(), found).otherwise(F.flatten(more))


def _surnames(words: Column) -> Column:
    return F.filter(words, lambda w, i: _is_surname(words, w, i))


def mentions(docs: DataFrame) -> DataFrame:
    """Key columns, pos, mention, kind, its units (kind, unit) in text order, and the document's bare surnames (a pattern)."""
    found = docs.filter(F.col("text").rlike(ANY)).select(*[c.alias(n) for n, c in _keyed(docs).items()], F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("all"), "text")
    found = found.withColumn("bare", _bare(F.col("all")))
    gaps = F.when(F.col("bare").isNotNull(), F.split("text", ANY, -1))
    found = found.select(*KEY, _with_bare(F.col("all"), gaps, F.col("bare")).alias("all"), "bare")
    found = found.groupBy(*KEY).agg(F.first("all").alias("all"), F.first("bare").alias("bare")).select(*KEY, "bare", F.posexplode("all").alias("pos", "mention"))
    found = found.withColumn("kind", _kind(F.col("mention")))
    title = F.regexp_extract("mention", f"^({_TITLES})", 1)
    words = _name_words(F.col("mention"))
    gender = None
    for g in ("m", "f"):
        hit = title.rlike(rf"(?<![{_LETTER}-])(?:{'|'.join(TITLES[g])})(?![{_LETTER}-])")
        gender = F.when(hit, g) if gender is None else F.coalesce(gender, F.when(hit, g))
    listed = F.initcap(F.split(words[0], "-")[0])
    for g in ("m", "f"):
        gender = F.coalesce(gender, F.when(listed.isin([n for (of, _), ns in GIVEN.items() if of == g for n in ns]), g))
    gender = F.coalesce(gender, F.lit("n"))

    def unit(word: Column, i: Column) -> Column:
        script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        given = F.concat(F.lit("given "), gender, F.lit(" "), script)
        return F.struct(F.when(_is_surname(words, word, i), F.concat(F.lit("surname "), script)).otherwise(given).alias("kind"), F.lower(word).alias("unit"))

    plain = F.struct(F.col("kind"), (
        F.when(F.col("kind").isin("card", "ssn"), F.regexp_replace("mention", "[^0-9]", ""))
        .when(F.col("kind") == "phone", F.regexp_replace("mention", "[^0-9+]", ""))
        .when(F.col("kind") == "email", F.lower("mention"))
        .when(F.col("kind") == "iban", F.regexp_replace("mention", " ", ""))
        .otherwise(F.col("mention"))).alias("unit"))
    units = F.when(F.col("kind") != "name", F.array(plain)).otherwise(F.transform(words, unit))
    return found.select(*KEY, "pos", "mention", "kind", units.alias("units"), "bare")


def _luhn_rest(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def _mod97(text: Column) -> Column:
    """The number of a string of digits and capitals (A is 10, Z is 35) modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _surrogate(spec: Surrogates) -> Column:
    """The surrogate of (kind, unit, attempt)."""
    seed = F.concat_ws("\x1f", F.lit(spec.key), "kind", "unit", F.col("attempt").cast("string"))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1fmore")), 512))
    kind, unit = F.col("kind"), F.col("unit")

    def draw(i) -> Column:
        """The i-th keyed number below 2^16."""
        return F.conv(F.substr(stream, F.pmod(F.lit(4) * i, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int")

    def letters(text: Column, keep: Column) -> Column:
        """Digits for digits and letters for letters, after the first `keep` characters."""
        def other(c: Column, n: Column, pool: str) -> Column:
            """A letter of the pool that is not `c`."""
            return F.substr(F.lit(pool), F.pmod(F.instr(F.lit(pool), c) + F.pmod(n, F.lit(len(pool) - 1)), F.lit(len(pool))) + 1, F.lit(1))

        def one(c: Column, i: Column) -> Column:
            n = draw(i)
            out = (F.when(i < keep, c).when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                    .when(c.rlike("[a-f]") & (kind == "secret") & unit.rlike("^[0-9a-f]+$"), F.substr(F.lit("abcdef"), F.pmod(n, F.lit(6)) + 1, F.lit(1)))
                    .when(c.rlike("[a-z]"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n, F.lit(26)) + 1, F.lit(1)))
                    .when(c.rlike("[A-Z]"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(n, F.lit(26)) + 1, F.lit(1))))
            out = out.when(~c.rlike(r"[\p{L}\p{N}]"), c)
            for script, pool in LETTERS:
                out = out.when(c.rlike(rf"(?=\p{{L}}){script}"), other(c, n, pool))
            return out.when(c.rlike(r"\p{N}"), F.pmod(n, F.lit(10)).cast("string")).otherwise(c)
        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    # Formats that fill up grow: one more digit with every attempt from `spec.attempts` on.
    grown = F.col("attempt") - spec.attempts
    more = F.when(grown < 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(grown, F.lit(0))), lambda i: F.pmod(draw(i + 17), F.lit(10)).cast("string")), ""))
    last = F.regexp_extract("unit", r"(\.[a-z]+)$", 1)
    email = F.concat(more, letters(F.expr("substr(unit, 1, length(unit) - length(regexp_extract(unit, '([.][a-z]+)$', 1)))"), F.lit(0)), last)
    ip = F.concat_ws(".", F.lit("10"), *[F.pmod(draw(F.lit(i)), F.lit(256)).cast("string") for i in range(3)])
    ip = F.when(grown < 0, ip).otherwise(F.concat_ws(".", ip, more))
    card = F.concat(letters(unit, F.lit(1)), more)
    stem = F.substr(card, F.lit(1), F.length(card) - 1)
    fixed = F.concat(stem, F.pmod(10 - _luhn_rest(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
    card = F.when(_luhn_rest(unit) == 0, fixed).otherwise(card)
    secret = letters(unit, F.when(unit.rlike("^(AKIA|ASIA)"), 4).when(unit.rlike("^[a-z]+[-_]"), F.length(F.regexp_extract("unit", "^([a-z]+[-_])", 1))).otherwise(0))
    secret = F.concat(secret, more)
    iban = F.concat(letters(unit, F.lit(4)), more)
    country = F.substr(unit, F.lit(1), F.lit(2))
    valid = _mod97(F.expr("concat(substr(unit, 5), substr(unit, 1, 4))")) == 1

    def rechecked(x: Column) -> Column:
        """Two last digits that agree with the check digits (18 * 10^6 is 1 modulo 97), or else new check digits."""
        stem = F.substr(x, F.lit(5), F.length(x) - 6)
        rest = _mod97(F.concat(stem, F.lit("00"), F.substr(x, F.lit(1), F.lit(4))))
        ending = F.lpad(F.pmod(18 * (1 - rest), F.lit(97)).cast("string"), 2, "0")
        digits = F.lpad((98 - _mod97(F.concat(F.substr(x, F.lit(5)), country, F.lit("00")))).cast("string"), 2, "0")
        fits = F.when(x.rlike("[0-9]{2}$"), F.concat(F.substr(x, F.lit(1), F.lit(4)), stem, ending)).otherwise(
            F.concat(country, digits, F.substr(x, F.lit(5))))
        return F.when(valid, fits).otherwise(x)

    iban = F.transform(F.array(iban), rechecked)[0]
    names = None
    for script, (starts, middles, ends) in SYLLABLES.items():
        extra = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt")), lambda i: _pick(middles, draw(i + 2))), "")
        value = F.concat(_pick(starts, draw(F.lit(0))), extra, _pick(ends, draw(F.lit(1))))
        names = F.when(kind == f"surname {script}", value) if names is None else names.when(kind == f"surname {script}", value)
        for gender in ("m", "f", "n"):
            pool = GIVEN[gender, script] if gender != "n" else GIVEN["m", script] + GIVEN["f", script]
            # Every fourth attempt adds a name to the compound.
            many = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("attempt") / 4).cast("int")), lambda i: _pick(pool, draw(i))), "-")
            names = names.when(kind == f"given {gender} {script}", many)
    return (
        names.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "secret", secret)
        .when(kind == "phone", F.concat(letters(unit, F.when(unit.startswith("+"), 2).otherwise(0)), more))
        .when(kind == "ssn", F.concat(letters(unit, F.lit(0)), more)).otherwise(iban))


def surrogate_table(found: DataFrame, spec: Surrogates) -> DataFrame:
    """kind, unit, attempt, surrogate for every distinct unit: distinct within a kind, and none a unit of the corpus."""
    units = found.select(F.explode("units").alias("u")).select("u.kind", "u.unit").distinct()
    table = materialize(units.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(spec)))
    while True:
        real = table.select("kind", F.col("unit").alias("low"), F.lit(True).alias("real"))
        first = table.groupBy("kind", F.lower("surrogate").alias("low")).agg(F.min("unit").alias("owner"))
        checked = (
            table.withColumn("low", F.lower("surrogate")).join(first, ["kind", "low"]).join(real, ["kind", "low"], "left")
            .withColumn("bad", (F.col("unit") != F.col("owner")) | F.col("real").isNotNull())
        )
        fresh = checked.filter("bad").select("kind", "unit", (F.col("attempt") + 1).alias("attempt"))
        fresh = materialize(fresh.withColumn("surrogate", _surrogate(spec)))
        if fresh.isEmpty():
            return table
        table = materialize(table.join(fresh.select("kind", "unit"), ["kind", "unit"], "left_anti").unionByName(fresh))


def _turned(letters: str, by: int):
    return lambda x: F.translate(x, letters, letters[by:] + letters[:by])


def _rendered(spec: Surrogates) -> Column:
    """The mention with its units' surrogates (`new`, in order) in its own format."""
    mention, kind, only = F.col("mention"), F.col("kind"), F.col("new")[0]
    chars = F.filter(F.split(mention, ""), lambda c: c != "")

    def fill(c: Column, i: Column, skip: str) -> Column:
        # How many of the unit's characters came before this one.
        before = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), skip, ""))
        return F.when(c.rlike(skip), c).otherwise(F.substr(only, before + 1, F.lit(1)))

    def filled(skip: str) -> Column:
        # What a grown surrogate has beyond the unit's length follows at the end.
        rest = F.substr(only, F.length(F.regexp_replace(mention, skip, "")) + 1)
        return F.concat(F.array_join(F.transform(chars, lambda c, i: fill(c, i, skip)), ""), rest)

    digits, phone, iban = filled("[^0-9]"), filled("[^0-9+]"), filled(" ")
    title = F.regexp_extract("mention", f"^({_TITLES})", 1)
    bare = F.regexp_replace("mention", f"^{_TITLES}", "")
    words = F.zip_with(_name_words(mention), F.col("new"), lambda w, n: F.when(w == F.upper(w), F.upper(n)).otherwise(n))
    between = F.split(bare, _TOKEN, -1)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
        by = int(hashlib.sha256(f"{spec.key}\x1finitial".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        between = F.transform(between, _turned(letters, by))
    name = F.concat(title, F.array_join(F.zip_with(between, words, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    email = F.when(mention == F.upper(mention), F.upper(only)).otherwise(only)
    return (F.when(kind == "name", name).when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "email", email).otherwise(only))


def replace(docs: DataFrame, spec: Surrogates) -> DataFrame:
    """The documents with surrogates in place of all mentions, plus n_entities."""
    found = materialize(mentions(docs))
    table = surrogate_table(found, spec)
    slots = found.select(*KEY, "pos", "mention", F.col("kind").alias("type"), F.posexplode("units").alias("at", "u")).select(*KEY, "pos", "mention", "type", "at", "u.kind", "u.unit")
    slots = slots.join(table.select("kind", "unit", "surrogate"), ["kind", "unit"])
    slots = slots.groupBy(*KEY, "pos", "mention", F.col("type").alias("kind")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    new = slots.select(*KEY, "pos", _rendered(spec).alias("new")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("__tw_new"))
    new = new.join(found.filter("pos = 0").select(*[F.col(c).alias(f"{c}3") for c in KEY], F.col("bare").alias("__tw_bare")), F.col("__tw_id").eqNullSafe(F.col("__tw_id3")) & (F.col("__tw_hash") == F.col("__tw_hash3")))
    new = new.select(F.col("__tw_id").alias("__tw_id2"), F.col("__tw_hash").alias("__tw_hash2"), "__tw_new", "__tw_bare")
    names = [c for c in docs.columns if c != "n_entities"]
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    touched = docs.filter(has).withColumns(_keyed(docs)).join(new, F.col("__tw_id").eqNullSafe(F.col("__tw_id2")) & (F.col("__tw_hash") == F.col("__tw_hash2")))
    gaps = F.split("text", ANY, -1)
    gaps = F.when(F.col("__tw_bare").isNull(), gaps).otherwise(F.flatten(F.transform(gaps, lambda g: F.split(g, F.col("__tw_bare"), -1))))
    text = F.array_join(F.zip_with(gaps, F.transform("__tw_new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    touched = touched.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], F.size("__tw_new").cast("long").alias("n_entities"))
    return docs.filter(~has).select(*names, F.lit(0).cast("long").alias("n_entities")).union(touched)
