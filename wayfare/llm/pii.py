"""Personal data: keyed surrogates of the same type, script, gender and format.

Entities are e-mail addresses, phone numbers, IPv4 addresses, card and account numbers, IBANs, social security
numbers, and names behind a title, led by a known first name, or (Cyrillic) a surname before one; names in capitals
too. A surrogate is a keyed permutation inside the
entity's format: digits go to digits, vowels to vowels and consonants to consonants of the same script, case and
separators stay, check digits are made valid again, first names stay in the list of their script and gender, and
endings of surnames that tell a gender stay. So the same value has the same surrogate wherever and however it is
written (coreference), and different values have different ones (distinctness).

The collision check runs over all distinct values of the corpus, as joins: values whose surrogate is shared,
unchanged or itself a value of the corpus get a surrogate under the next tweak, in up to ``most`` rounds (each leaves the share of a format that is in use). What then is
left lies in formats that are too full for it, and is settled exactly, also as joins: the format's values that nobody
has, in a keyed order, go to what is left by rank; when these are used up, values of the corpus, distinct and
never a value's own. A warning counts those, and values that stay as they are because their format holds nothing else.

Surrogates that differ from the first tweak's are exceptions. At most ``bound`` of them are sent to the tasks; when
there are more, documents that hold some get theirs by joins. Both ways give the same texts.

Defined results: null texts stay null, with no entities; texts are processed whole; repeated rows repeat their
result; an empty table gives no rows; further columns are kept by :func:`replace_in`, but for one named
``n_entities``, which the count takes the place of where it is asked for.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, positional, tidy

#: Common first names by script and gender, and titles that lead a name.
FIRST = {
    ("latin", "f"): "Alice Amelia Anna Barbara Carla Caroline Charlotte Claire Elena Elisabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Julia Karen Laura Linda Lisa Lucy Margaret Maria Marie Martha Mary Nina Olivia Patricia Paula Rachel Rosa Ruth Sarah Sofia Susan Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Carlos Charles Christopher Daniel David Edward Eric Felix Francis George Hans Henry Jack Jacob James John Joseph Karl Lucas Luis Mark Martin Matthew Michael Miguel Nicolas Oliver Oscar Paul Pedro Peter Philip Richard Robert Samuel Simon Stephen Thomas Victor William".split(),
    ("cyrillic", "f"): "Александра Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Мария Марина Надежда Наталья Ольга Полина Светлана София Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Антон Борис Василий Виктор Владимир Геннадий Георгий Григорий Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Παναγιώτα Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Αντώνιος Βασίλειος Γεώργιος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Χρήστος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Fräulein Monsieur Madame Mademoiselle Mme Mlle Señor Señora Sr Sra Don Doña".split()
#: Letters that are permuted, by script: vowels, consonants.
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
#: Endings of names that tell a gender; they stay. Longer ones go first.
ENDINGS = "ovich evich ovna evna skaya skiy ovsky ovska ova eva ina ska sky ski opoulou idou ides idis akis aki poulos ова ева ёва ина ына ская цкая ский цкий ая ий ов ев ёв ин ын ович евич овна евна опούλου ίδου ίδης άκης άκη όπουλος ου ος ης ας a а я η α".split()
#: Endings of Cyrillic surnames, which may stand before the first name.
SURNAMES = ("ов", "ев", "ёв", "ин", "ын", "ова", "ева", "ёва", "ина", "ына", "ский", "ская", "цкий", "цкая", "енко", "чук", "юк")
GENDER = {name: (script, sex) for (script, sex), names in FIRST.items() for name in names}
CLASS = {c: (script, i) for script, parts in LETTERS.items() for i, part in enumerate(parts) for c in part} | {d: ("digit", 0) for d in "0123456789"}
RADIX = {(s, i): part for s, parts in LETTERS.items() for i, part in enumerate(parts)} | {("digit", 0): "0123456789"}

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = re.compile(rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)", re.ASCII)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", re.ASCII)
CARD = re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,5}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,5}[ -]?\d{2,5})(?![\w]|-\d|\.\d)", re.ASCII)
UPPER, LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ", "a-zß-öø-ÿа-яёα-ωά-ώ"
WORD = rf"[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)?"
CAPITALS = rf"[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})?"
ANY = rf"(?:{WORD}|{CAPITALS})"
PAIR = re.compile(rf"(?<![\w])(?=({ANY}) ({ANY})(?![\w]))")
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?:({WORD})(?: ({WORD}))?|({CAPITALS})(?: ({CAPITALS}))?)(?!\w)")
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "name")


def plain_case(name: str) -> str:
    """A name in capitals as it is otherwise written; other names as they are."""
    return "-".join(w[0] + w[1:].lower() for w in name.split("-")) if len(name) > 1 and name.isupper() else name


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, without overlaps; earlier kinds go first."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str, a: int, b: int) -> None:
        at = bisect.bisect_left(found, (a,))
        if (at == 0 or found[at - 1][1] <= a) and (at == len(found) or b <= found[at][0]):
            found.insert(at, (a, b, kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    if re.search(r"\d", text):
        for kind, pattern in (("ip", IP), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            for m in pattern.finditer(text):
                add(kind, *m.span())
    for m in PAIR.finditer(text):
        one, two = m[1], m[2]
        if one.isupper() == two.isupper() and (plain_case(one) in GENDER or plain_case(two) in GENDER and one.lower().endswith(SURNAMES)):
            add("name", *m.span(1))
            add("name", *m.span(2))
    for m in TITLED.finditer(text):
        for g in range(1, 5):
            if m[g]:
                add("name", *m.span(g))
    return found


def stem(name: str) -> int:
    """Letters of a name before an ending that tells a gender; two of them at least move."""
    low = name.lower()
    return next((len(name) - len(e) for e in ENDINGS if low.endswith(e) and len(name) - len(e) >= 2), len(name))


def _round(key: bytes, tweak: str, r: int, part: tuple[int, ...]) -> int:
    data = f"{tweak}|{r}|{','.join(map(str, part))}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=16).digest(), "big")


def permute(key: bytes, tweak: str, digits: list[int], radix: list[int]) -> list[int]:
    """A keyed permutation of the mixed-radix numbers with these radices: an alternating Feistel network."""
    n = len(digits)
    if n == 0:
        return []
    if n == 1:
        order = sorted(range(radix[0]), key=lambda d: _round(key, tweak, d, (radix[0],)))
        return [order[digits[0]]]
    half = n // 2
    x, (left, right) = list(digits), (range(half), range(half, n))
    for r in range(10):
        src, dst = (left, right) if r % 2 == 0 else (right, left)
        f = _round(key, f"{tweak}|{n}|{radix[0]}", r, tuple(x[i] for i in src))
        for i in dst:
            f, d = divmod(f, radix[i]) if f >= radix[i] else (_round(key, f"{tweak}|{i}", r, (f,)), f)
            x[i] = (x[i] + d) % radix[i]
    return x


def shuffle_text(key: bytes, tweak: str, value: str, keep: int = 0, end: int | None = None) -> str:
    """Permute letters and digits of ``value`` before ``end`` and behind the first ``keep`` of them, each within its class; the rest stays."""
    low = value.lower() if len(value.lower()) == len(value) else value
    at = [i for i, c in enumerate(low[:end]) if c in CLASS][keep:]
    sets = [RADIX[CLASS[low[i]]] for i in at]
    new = permute(key, tweak, [s.index(low[i]) for s, i in zip(sets, at, strict=True)], [len(s) for s in sets])
    out = list(value)
    for i, s, d in zip(at, sets, new, strict=True):
        out[i] = s[d].upper() if value[i] != low[i] else s[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def put_digits(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def canonical(kind: str, value: str) -> str:
    """What two ways of writing one value have in common."""
    if kind in ("card", "ssn", "phone"):
        return ("+" if value[0] == "+" else "") + "".join(filter(str.isdigit, value))
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else plain_case(value)


@lru_cache(maxsize=64)
def _name_order(key: bytes, tweak: str, script: str, sex: str) -> dict[str, str]:
    """A keyed single cycle through the names of a script and gender: no name stays itself."""
    names = sorted(FIRST[script, sex], key=lambda w: _round(key, f"{tweak}|{w}", 0, ()))
    return dict(zip(names, names[1:] + names[:1], strict=True))


def surrogate(key: bytes, kind: str, value: str, tweak: int = 0) -> str:
    """The surrogate of ``value``, written in its format."""
    t = f"{kind}|{tweak}"
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        return f"{shuffle_text(key, t + '|l', local)}@{'.'.join(shuffle_text(key, t + '|d', x) for x in labels[:-1])}.{labels[-1]}"
    if kind == "ip":
        first, *rest = map(int, value.split("."))
        return ".".join(map(str, [first, *permute(key, f"{t}|{first}", rest, [256] * 3)]))
    if kind == "iban":
        country, body = value[:2], value[4:]
        body = shuffle_text(key, t, body)
        plain = body.replace(" ", "") + country + "00"
        check = 98 - int("".join(str(int(c, 36)) for c in plain)) % 97
        return f"{country}{check:02}{body}"
    if kind == "name":
        own = plain_case(value)
        if own in GENDER:
            new = _name_order(key, t, *GENDER[own])[own]
        else:
            end = stem(own)
            new = shuffle_text(key, f"{t}|{own[end:].lower()}", own, end=end)
            while new in GENDER or stem(new) != end:  # walk the permutation's cycle inside the format: listed names are surrogates of listed names alone
                new = shuffle_text(key, f"{t}|{own[end:].lower()}", new, end=end)
        return new if own == value else new.upper()
    digits = "".join(filter(str.isdigit, value))
    if kind == "card":
        if luhn(digits[:-1]) == int(digits[-1]):
            body = shuffle_text(key, t + "|valid", digits[:-1], 1)
            return put_digits(value, body + str(luhn(body)))
        body = digits
        while True:  # walk the permutation's cycle until the number fails the check as the source does
            body = shuffle_text(key, t, body, 1)
            if luhn(body[:-1]) != int(body[-1]):
                return put_digits(value, body)
    country = len(re.match(r"\+?(\d{0,3})", value)[1]) if value[0] == "+" else 0
    return put_digits(value, shuffle_text(key, f"{t}|{digits[:country]}", digits, country + (kind == "phone")))


#: (kind, canonical value) -> canonical surrogate, where it isn't that of the first tweak.
Exceptions = dict[tuple[str, str], str]


def replacement(key: bytes, kind: str, value: str, exceptions: Exceptions) -> str:
    """The surrogate of ``value``, written in its format; it depends on the canonical value alone."""
    plain = canonical(kind, value)
    own = exceptions.get((kind, plain)) or canonical(kind, surrogate(key, kind, plain))
    if kind in ("card", "ssn", "phone"):
        return put_digits(value, own.lstrip("+"))
    if kind == "iban":
        it = iter(own)
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(value, own, strict=True))
    return own.upper() if kind == "name" and plain_case(value) != value else own


def _moving(kind: str, value: str) -> list[int]:
    """Places of a canonical value that its format lets change; check digits not among them."""
    n = len(value)
    if kind == "email":
        places = [i for i in range(value.rindex(".")) if value[i] != "@"]
    elif kind == "card":
        places = range(1, n - (luhn(value[:-1]) == int(value[-1])))
    elif kind == "phone":
        places = range(len(re.match(r"\+\d{0,3}|", value)[0]) + 1, n)
    else:
        places = range(4 if kind == "iban" else 0, stem(value) if kind == "name" else n)
    return [i for i in places if value[i].lower() in CLASS]


def format_of(kind: str, value: str) -> str:
    """What all values of one format have in common."""
    if kind == "ip":
        return value.split(".")[0]
    if kind == "name" and value in GENDER:
        return "|".join(("first", *GENDER[value]))
    out = list(value)
    for i in _moving(kind, value):
        script, part = CLASS[value[i].lower()]
        out[i] = f"<{script}{part}{value[i] != value[i].lower()}>"
    if kind == "iban":
        out[2:4] = "00"
    if kind == "card" and luhn(value[:-1]) == int(value[-1]):
        out[-1] = "valid"
    return "".join(out)


def format_size(kind: str, value: str) -> int:
    """Places in the keyed order of the format of ``value``; some may hold no value."""
    if kind == "name" and value in GENDER:
        return len(FIRST[GENDER[value]])
    return 256**3 if kind == "ip" else math.prod(len(RADIX[CLASS[value[i].lower()]]) for i in _moving(kind, value))


def format_values(key: bytes, kind: str, value: str, first: int = 0, last: int | None = None) -> Iterator[str]:
    """The canonical values of the format of ``value`` at the places from ``first`` to before ``last`` of a keyed order."""
    tweak = f"settle|{format_of(kind, value)}"
    if kind == "name" and value in GENDER:
        yield from sorted(FIRST[GENDER[value]], key=lambda w: _round(key, f"{tweak}|{w}", 0, ()))[first:last]
        return
    at = [1, 2, 3] if kind == "ip" else _moving(kind, value)
    parts = value.split(".") if kind == "ip" else list(value)
    sets = [[*map(str, range(256))] if kind == "ip" else RADIX[CLASS[value[i].lower()]] for i in at]
    valid = kind == "card" and luhn(value[:-1]) == int(value[-1])
    for k in range(first, min(format_size(kind, value) if last is None else last, format_size(kind, value))):
        digits = []
        for s in sets:
            k, d = divmod(k, len(s))
            digits.append(d)
        out = list(parts)
        for i, s, d in zip(at, sets, permute(key, tweak, digits, [len(s) for s in sets]), strict=True):
            out[i] = s[d].upper() if parts[i] != parts[i].lower() else s[d]
        new = (".".join if kind == "ip" else "".join)(out)
        if kind == "iban":
            new = f"{new[:2]}{98 - int(''.join(str(int(c, 36)) for c in new[4:] + new[:2] + '00')) % 97:02}{new[4:]}"
        elif valid:
            new = new[:-1] + str(luhn(new[:-1]))
        if not (kind == "card" and not valid and luhn(new[:-1]) == int(new[-1])) and not (kind == "name" and (new in GENDER or stem(new) != stem(value))):
            yield new


def rewrite(text: str | None, key: bytes, exceptions: Exceptions) -> tuple[str | None, int]:
    if not text:
        return text, 0
    spans = find(text)
    out, at = [], 0
    for a, b, kind in spans:
        value = text[a:b]
        out += [text[at:a], replacement(key, kind, value, exceptions)]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` yields for the rows of each batch, a batch at a time."""
    types = df.sparkSession.createDataFrame([], schema).schema
    arrow = {"string": pa.string(), "bigint": pa.int64()}

    def run(batches):
        for b in batches:
            rows = list(make(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow[f.dataType.simpleString()]) for i, f in enumerate(types)], names=types.names)

    return df.mapInArrow(tidy(run), schema)


VALUES = "kind string, value string, format string, surrogate string"


def values_of(docs: DataFrame, key: bytes) -> DataFrame:
    """Distinct kind, value, format, surrogate (value and surrogate canonical) of the corpus."""

    def make(rows):
        seen = {}
        for (text,) in rows:
            for a, z, kind in find(text or ""):
                seen.setdefault((kind, canonical(kind, text[a:z])))
        return [(k, c, format_of(k, c), canonical(k, surrogate(key, k, c))) for k, c in seen]

    return _mapped(docs.select("text"), make, VALUES).distinct()


def collisions(values: DataFrame) -> DataFrame:
    """kind, value of those whose surrogate is unchanged, also a value of the corpus, or shared (the least value keeps it)."""
    first = values.groupBy("kind", "surrogate").agg(F.min("value").alias("first"))
    shared = values.join(first, ["kind", "surrogate"]).where(F.col("value") != F.col("first")).select("kind", "value")
    known = values.select("kind", F.col("value").alias("surrogate"))
    return shared.union(values.join(known, ["kind", "surrogate"], "left_semi").select("kind", "value")).distinct()


#: Places of a format that a row lists, and hash buckets in which ranks are counted.
PLACES, BUCKETS = 4096, 4096


def _ranked(rows: DataFrame, order: Column) -> DataFrame:
    """Adds ``rank`` from 0 on within each (kind, format), by hash bucket and then ``order``; no task sees a whole format."""
    b = rows.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(BUCKETS)))
    sizes = b.groupBy("kind", "format", "bucket").agg(F.count(F.lit(1)).alias("size"))  # at most BUCKETS rows for a format
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("kind", "format").orderBy("bucket")) - F.col("size")).drop("size")
    inside = F.row_number().over(Window.partitionBy("kind", "format", "bucket").orderBy(order))
    return b.withColumn("inside", inside).join(before, ["kind", "format", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before")


def settle(values: DataFrame, left: DataFrame, key: bytes) -> DataFrame:
    """``values`` with new surrogates for ``left(kind, value)``, whose formats are too full for another tweak.

    A format's values that are neither in the corpus nor taken go to what is left, by rank. What is then left takes
    values of the corpus that nobody has as a surrogate: others' first, its own kind in a ring, and where a single one
    would have to keep itself, it changes with another value of the format.
    """
    here = ["kind", "format"]
    left = materialize(values.join(left, ["kind", "value"], "left_semi").select("kind", "format", "value"), "pii-left")
    stay = values.join(left.select("kind", "value"), ["kind", "value"], "left_anti")
    one = left.groupBy(*here).agg(F.min("value").alias("value"))
    places = _mapped(one, lambda rows: ((k, f, v, i) for k, f, v in rows for i in range(0, format_size(k, v), PLACES)), "kind string, format string, value string, first bigint")
    every = _mapped(places.repartition("kind", "format", "first"), lambda rows: ((k, f, x) for k, f, v, i in rows for x in format_values(key, k, v, i, i + PLACES)), "kind string, format string, surrogate string")
    taken = stay.select("kind", "surrogate")
    corpus = values.select("kind", F.col("value").alias("surrogate"))
    spare = materialize(every.join(taken, ["kind", "surrogate"], "left_anti"), "pii-spare")
    free = _ranked(spare.join(corpus, ["kind", "surrogate"], "left_anti"), F.col("surrogate"))
    pairs = _ranked(left, F.col("value")).join(free, [*here, "rank"], "left").select(*here, "value", "surrogate")
    pairs = materialize(pairs, "pii-settled")
    done, rest = pairs.where("surrogate IS NOT NULL"), pairs.where("surrogate IS NULL").select(*here, "value")
    if not rest.isEmpty():
        used = spare.join(corpus, ["kind", "surrogate"], "left_semi")
        ring = rest.join(used.select("kind", F.col("surrogate").alias("value")), ["kind", "value"], "left_semi")  # could keep themselves
        apart = _ranked(rest.join(ring, ["kind", "value"], "left_anti").select(*here, "value"), F.col("value"))
        others = _ranked(used.join(rest.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti"), F.col("surrogate"))
        # values that can't keep themselves take others' first, then those that could give theirs
        numbered = materialize(_ranked(ring, F.col("value")), "pii-ring")
        size = numbered.groupBy(*here).agg(F.count(F.lit(1)).alias("size"))
        first = apart.join(others, [*here, "rank"], "left").select(*here, "value", "surrogate")
        turned = numbered.join(size, here).select(*here, "value", ((F.col("rank") + 1) % F.col("size")).alias("rank"))
        second = turned.join(numbered.select(*here, "rank", F.col("value").alias("surrogate")), [*here, "rank"]).select(*here, "value", "surrogate")
        done = materialize(done.union(first).union(second), "pii-settled")
        if not done.where("value = surrogate").isEmpty():  # one in a format at most: it changes with another one
            own = done.where("value = surrogate").select(*here, F.col("value").alias("own"))
            all_ = stay.select(*here, "value", "surrogate").union(done.where("value != surrogate"))
            mate = all_.join(own, here).groupBy(*here, "own").agg(F.min(F.struct("value", "surrogate")).alias("m"))
            swap = mate.select(*here, F.col("own").alias("value"), F.col("m.surrogate").alias("surrogate")).union(mate.select(*here, F.col("m.value"), F.col("own")))
            swap = materialize(swap, "pii-swap")
            done = done.join(swap, ["kind", "value"], "left_anti").select(*here, "value", "surrogate").union(swap)
    new = materialize(done, "pii-settled")
    again = new.join(corpus, ["kind", "surrogate"], "left_semi").where("value != surrogate").count()
    same = new.where("value = surrogate").count()
    if same or again:
        warnings.warn(f"formats without free values: {again} surrogates are distinct, but also values of the corpus; {same} values stay as they are", stacklevel=2)
    kept = values.join(new.select("kind", "value"), ["kind", "value"], "left_anti")
    return materialize(kept.select(*VALUE_NAMES).union(new.select(*VALUE_NAMES)), "pii-values")


VALUE_NAMES = [f.split()[0] for f in VALUES.split(", ")]


def check(docs: DataFrame, key: bytes, most: int = 6) -> DataFrame:
    """kind, value, surrogate of the values whose surrogate isn't that of the first tweak."""
    start = values = materialize(values_of(docs, key), "pii-values")
    for tweak in range(1, most + 1):
        bad = materialize(collisions(values), "pii-collisions")
        if bad.isEmpty():
            break
        if tweak == most:
            values = settle(values, bad, key)
            break
        again = values.join(bad, ["kind", "value"], "left_semi").select("kind", "value", "format")
        renewed = _mapped(again, lambda rows, t=tweak: ((k, v, f, canonical(k, surrogate(key, k, v, t))) for k, v, f in rows), VALUES)
        values = materialize(values.join(bad, ["kind", "value"], "left_anti").select(*VALUE_NAMES).union(renewed), "pii-values")
    if values is start:
        return start.limit(0).select("kind", "value", "surrogate")
    old = start.select("kind", "value", F.col("surrogate").alias("old"))
    return values.join(old, ["kind", "value"]).where("surrogate != old").select("kind", "value", "surrogate")


def replace_in(docs: DataFrame, key: str = "surrogates", bound: int = 10_000, counted: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text`` and, if ``counted``, a last column ``n_entities``."""
    secret = key.encode()
    if counted:
        docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "n_entities"])
    give_back(docs.sparkSession)
    exceptions = materialize(check(docs, secret), "pii-exceptions")
    names = docs.columns
    place = names.index("text")
    schema = T.StructType([*docs.schema.fields, *([T.StructField("n_entities", T.LongType())] if counted else [])])
    rows = exceptions.limit(bound + 1).collect()  # at most bound + 1 rows reach the driver
    sent = {(r.kind, r.value): r.surrogate for r in rows}
    if len(rows) > bound:
        sent = {}

        def own(rows):
            for (text,) in rows:
                for k, v in {(k, canonical(k, text[a:z])) for a, z, k in find(text or "")}:
                    yield hashlib.sha256(text.encode()).hexdigest(), k, v

        held = _mapped(docs.select("text"), own, "__sha string, kind string, value string").distinct().join(exceptions, ["kind", "value"])
        held = held.groupBy("__sha").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("__own"))  # no more than a text holds
        docs = docs.withColumn("__sha", F.sha2(F.col("text").cast("binary"), 256)).join(held, "__sha", "left").select(*[f"`{c}`" for c in names], "__own")

    def run(batches):
        for b in batches:
            extra = b.column(len(names)).to_pylist() if b.num_columns > len(names) else [None] * b.num_rows
            rows = [rewrite(t.as_py(), secret, {(o["kind"], o["value"]): o["surrogate"] for o in x} if x else sent) for t, x in zip(b.column(place), extra, strict=True)]
            columns = list(b.columns[: len(names)])
            columns[place] = pa.array([r[0] for r in rows], pa.string())
            if counted:
                columns.append(pa.array([r[1] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return positional(docs).mapInArrow(tidy(run), schema)
