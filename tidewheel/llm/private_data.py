"""Personal data and secrets, replaced by keyed surrogates.

Detected: e-mail and IPv4 addresses, telephone, social security, card and other long
numbers, bank accounts (IBAN), secrets (long hex strings, well-known key formats,
values assigned to names such as token or password), and people named with a title or
a well-known first name (the lists are short: a name without either is not found).

An entity's surrogate is a keyed function of its kind and canonical form, so an entity
gets one surrogate everywhere, in the format of each mention: digits for digits,
letters for letters of the same alphabet with their case, separators as they stand, valid
check digits where the original's are valid, the country codes of telephone numbers and
accounts, a first name of the same gender and script, and a surname spelled in the same
script. Digits are an entity whatever they are taken for (the same number may stand as a
telephone and as a plain number) and in whichever digits they are written; all but e-mail
addresses and secrets are written in the mention's own.

All but surnames go through a keyed permutation of the strings of their format that
leaves none in place (a Feistel network, one step on, and back), so two entities never
share a surrogate however few strings a format has. Surnames have no such domain: theirs
are spelled by a keyed hash. A surname's surrogate is the same with and without a first
name or title beside it.

Spark checks that no two meet, by grouping all distinct entities by surrogate: of
surnames that do, all but the smallest take their next attempt, each longer than the
last, until none meet. The entities that needed one are few and are broadcast if a count
shows that they are; beyond that they are joined to their documents.

Texts are searched once: what is found is written beside them and read for the rest.

The key is the session's ``tidewheel.surrogate.key``; without it, one that is public and
fit for tests only.

Defined results: a null text stays null with no entities; an empty or clean text stays
as it is; very long texts are searched whole, in time proportional to their length; of overlapping entities the kind first in
PATTERNS wins, then the earlier; an entity whose format has one string only (no letter
or digit that could change) stays; repeated rows are replaced alike; null and shared
doc_ids work like any other; an empty table gives an empty table; other columns are kept
by replaced().
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.session import table
from tidewheel.storage import cut

#: The key where the session names none: public, for tests.
KEY = b"tidewheel"
#: Entities with attempts beyond the first that are broadcast at most.
SENT = 100_000
#: Letters that are exchanged for one another; others stay.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")

_UPPER = r"[^\W\d_a-zà-öø-ÿа-я]"
#: Titles that go before a name, with the gender they tell, if any.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sir": "m", "Don": "m", "Dr": "", "Prof": "", "Professor": "", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f"}
#: First names that are recognised and given, by script and gender.
FIRST = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Peter Paul Daniel Andrew Hans Jürgen Klaus Stefan Pierre Jean Michel Luc Carlos José Miguel Pablo Mark Charles George Wolfgang Jens Uwe Matthias Antoine Olivier Javier Diego Wei Ahmed Mohammed Ali".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Emma Laura Ursula Monika Petra Sabine Marie Sophie Claire Hélène Carmen Lucía Pilar Isabel Alice Anna Julia Margaret Anja Katrin Heike Camille Nathalie Elena Marta Teresa Mei Fatima Aisha".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
}
#: Syllables that surnames are spelled with.
SYLLABLES = {
    "latin": "ba be bo da den do fa fer ga gan ha hel ka ken ko la lin lo ma mer mo na nor pa per ra rin ro sa sel so ta ten to va vel wa wen za".split(),
    "cyrillic": "ба бе во га го да де жа за зо ка ко ла ле ма мо на но па по ра ре са со та то фа хо ча ше".split(),
}
_GENDER = {name: key for key, names in FIRST.items() for name in names}
_WORD = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)?"

#: In order of precedence; a kind's group 1, if it has one, is the entity.
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"),
    "secret": re.compile(
        r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?!\w)"
        r"|(?<![^\W_])(?i:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_.!@#$%^&*-]{8,}[A-Za-z0-9])"
    ),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
        r"|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
    ),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}(?:([ -]))\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    "number": re.compile(r"(?<!\w)\d{9,}(?!\w)"),
    "person": re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? (?:{_WORD} )?{_WORD}|(?:{'|'.join(_GENDER)}) {_WORD})(?!\w)"),
}
#: Kinds whose entities are their digits, whichever the kind.
DIGITS = ("phone", "ssn", "card", "number")
#: Country codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_DIGIT = re.compile(r"\d")
_NAMED = re.compile(rf"(?<!\w)(?:{'|'.join([*TITLES, *_GENDER])})(?!\w)")


def _iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _luhn_ok(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order; earlier kinds win overlaps."""
    numeric, named = bool(_DIGIT.search(text)), bool(_NAMED.search(text))
    kept: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS.items():
        if not (named if kind == "person" else kind == "secret" or numeric or (kind == "email" and "@" in text)):
            continue
        if kind == "email" and "@" not in text:
            continue
        taken = []
        for m in pattern.finditer(text):
            start, end = m.span(1) if kind == "secret" and m[1] else m.span()
            found = text[start:end]
            if kind == "secret" and (found.isalpha() or found.isdigit()):
                continue  # a word, or a number for a later kind
            if kind == "ip" and any(int(x) > 255 for x in found.split(".")):
                continue
            if kind == "iban" and not _iban_ok(found):
                continue
            taken.append((start, end, kind))
        kept = _apart(kept, taken)
    return kept


def _apart(kept: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans kept so far and those found that overlap none of them, in order; both are in order and without overlaps."""
    at, free = 0, []
    for span in found:
        while at < len(kept) and kept[at][1] <= span[0]:
            at += 1
        if at == len(kept) or span[1] <= kept[at][0]:
            free.append(span)
    return sorted(kept + free) if free else kept


def canonical(kind: str, mention: str) -> str:
    """The entity that a mention names, whatever its separators, case or title."""
    if kind in DIGITS:
        return ("+" if mention[0] == "+" else "") + "".join(str(unicodedata.decimal(c)) for c in mention if c.isdecimal())
    if kind == "ip":
        return "".join(str(unicodedata.decimal(c, c)) for c in mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "email":
        return mention.lower()
    if kind == "person":
        first, *rest = mention.split(" ")
        return " ".join(rest) if first.rstrip(".") in TITLES else mention
    return mention


def _bytes(key: bytes, *parts: object) -> Iterator[int]:
    """An endless stream of bytes keyed by the parts."""
    block = 0
    while True:
        yield from hashlib.blake2b("\x1f".join(map(str, (*parts, block))).encode(), key=key, digest_size=64).digest()
        block += 1


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def moved(at: int, left: int, right: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of 0 to left * right - 1 that leaves no number in place, if there are two.

    A Feistel network over pairs (below left, below right), then some steps on, then the network back.
    """
    if left * right < 2:
        return at
    sizes = (left, right)

    def turned(n: int, way: int) -> int:
        half = list(divmod(n, right))
        for step in range(8)[::way]:
            side = step % 2
            if sizes[side] > 1:
                half[side] = (half[side] + way * _number(key, *tweak, *sizes, step, half[1 - side])) % sizes[side]
        return half[0] * right + half[1]

    steps = 1 + _number(key, *tweak, *sizes, "steps") % (left * right - 1)
    return turned((turned(at, 1) + steps) % (left * right), -1)


Slot = tuple[Sequence[str], int]  # choices for a part of an entity, and which it has; a part with one choice stays


def _octet(text: str) -> Slot:
    """An octet among those of its length and leading zeros."""
    rest = text.lstrip("0") or "0"
    zeros = text[: len(text) - len(rest)]
    least, most = 10 ** (len(rest) - 1) if len(rest) > 1 else 0, 256 if len(rest) == 3 else 10 ** len(rest)
    return [zeros + str(n) for n in range(least, most)], int(rest) - least


def _char(c: str, hexed: bool = False) -> Slot:
    """A character among the digits or letters it can be exchanged for."""
    if hexed:
        choices = "0123456789ABCDEF" if hexed == "upper" else "0123456789abcdef"
    elif c.isdecimal():
        choices = [chr(ord(c) - unicodedata.decimal(c) + n) for n in range(10)]
    else:
        choices = next((a if c in a else a.upper() for a in ALPHABETS if c in a or c in a.upper()), c)
    return choices, choices.index(c)


def _slots(kind: str, entity: str) -> list[Slot]:
    if kind == "ip":
        return [slot for octet in entity.split(".") for slot in (_octet(octet), (["."], 0))][:-1]
    if kind == "email":  # the last label stays
        head, dot, last = entity.rpartition(".")
        return [*map(_char, head), ([dot + last], 0)]
    if kind == "secret" and len(entity) >= 32 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity):
        hexed = "upper" if entity == entity.upper() else "lower"
        return [_char(c, hexed) for c in entity]
    known = re.match(r"AKIA|gh[pousr]_|sk-", entity) if kind == "secret" else None
    head = known[0] if known else ""
    return [([head], 0), *map(_char, entity[len(head) :])]


def exchanged(slots: list[Slot], key: bytes, *tweak: object) -> str:
    """The parts that the place of these among all of their format is moved to."""
    middle = len(slots) // 2
    sides = [slots[:middle], slots[middle:]]
    at, sizes = [], []
    for side in sides:
        n, size = 0, 1
        for choices, place in side:
            n, size = n * len(choices) + place, size * len(choices)
        at.append(n)
        sizes.append(size)
    shape = "".join(f"{len(c)}{c[0]}" for c, _ in slots)
    both = divmod(moved(at[0] * sizes[1] + at[1], *sizes, key, *tweak, shape), sizes[1])
    out = []
    for side, n in zip(reversed(sides), reversed(both), strict=True):
        for choices, _ in reversed(side):
            n, place = divmod(n, len(choices))
            out.append(choices[place])
    return "".join(reversed(out))


def _check_digit(body: str) -> int:
    return next(d for d in range(10) if _luhn_ok(f"{body}{d}"))


def _checks(country: str, body: str) -> list[str]:
    """The check digits that make an IBAN of a country and a body valid."""
    return [f"{n:02d}" for n in range(100) if _iban_ok(f"{country}{n:02d}{body}")]


def _digits(entity: str, attempt: int, key: bytes) -> str:
    """Other digits, by the digits alone: behind a plus the country's code stays, and of card numbers the last is as far from the valid one as before."""
    if entity[0] == "+":
        code = next((c for c in CODES if entity.startswith(c, 1)), entity[1:4])
        return f"+{code}" + exchanged(_slots("digits", entity[1 + len(code) :]), key, "digits", code, attempt)
    if not 13 <= len(entity) <= 19:
        return exchanged(_slots("digits", entity), key, "digits", attempt)
    body, last = entity[:-1], entity[-1]
    made = exchanged(_slots("digits", body), key, "card", attempt)
    return made + str((int(last) - _check_digit(body) + _check_digit(made)) % 10)


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of a canonical entity; of a part of a name for the kind ``name``."""
    if kind == "name":
        script = "cyrillic" if re.search("[Ѐ-ӿ]", entity) else "latin"
        stream = _bytes(key, kind, entity, attempt)
        return "".join(SYLLABLES[script][next(stream) % len(SYLLABLES[script])] for _ in range(3 + attempt)).capitalize()
    if kind in DIGITS or kind == "digits":
        return _digits(entity, attempt, key)
    if kind == "iban":
        country, check, body = entity[:2], entity[2:4], entity[4:]
        made = exchanged(_slots(kind, body), key, kind, country, attempt)
        valid = _checks(country, made)
        return country + valid[min(_checks(country, body).index(check), len(valid) - 1)] + made
    return exchanged(_slots(kind, entity), key, kind, attempt)


def parts(kind: str, entity: str) -> list[tuple[str, str]]:
    """The (kind, entity) that have surrogates of their own: of a person, all words but a known first name; digits, whatever they are of."""
    if kind != "person":
        return [("digits" if kind in DIGITS else kind, entity)]
    words = entity.split(" ")
    return [("name", w) for w in (words[1:] if len(words) > 1 and words[0] in _GENDER else words)]


def _first_name(name: str, key: bytes) -> str:
    pool = FIRST[_GENDER[name]]
    return pool[moved(pool.index(name), len(pool), 1, key, "first", *_GENDER[name])]


def _like(made: str, c: str) -> str:
    """A character, as a digit of the script of c if that is a digit."""
    return chr(ord(c) - unicodedata.decimal(c) + int(made)) if c.isdecimal() and made.isdecimal() else made


def rendered(kind: str, mention: str, made: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind == "person":
        title = mention.split(" ")[0]
        return f"{title} {made}" if title.rstrip(".") in TITLES else made
    if kind in DIGITS or kind in ("iban", "ip"):
        chars = iter(made.lstrip("+").replace(".", ""))
        return "".join(_like(next(chars), c) if c.isalnum() else c for c in mention)
    if len(made) != len(mention):  # lower-casing lengthened it
        return made
    return "".join(m.upper() if c.isupper() else m for c, m in zip(mention, made, strict=True))


_SPANS = "array<struct<kind:string,start:int,length:int>>"
_ATTEMPTS = "array<struct<kind:string,entity:string,attempt:int>>"


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column has."""
    while name in taken:
        name += "_"
    return name


def searched(docs: DataFrame, spans: str) -> DataFrame:
    """docs with a column ``spans``: (kind, start, length) of the entities of text, in order; a written table."""
    names = docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "length": b - a} for a, b, k in detect(t)] if (t := text.as_py()) else [] for text in batch.column("text")]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(found, kind)], [*names, spans])

    return cut(docs.mapInArrow(each, StructType([*docs.schema, *StructType.fromDDL(f"{spans} {_SPANS}")])), "searched")


def entities(held: DataFrame, spans: str) -> DataFrame:
    """Distinct (kind, entity) of all texts; of persons, the parts of their names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {part for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, kind, name in _mentions(text, own) for part in parts(kind, name)}
            kinds, names = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["kind", "entity"])

    return held.where(F.size(spans) > 0).select("text", spans).mapInArrow(each, "kind string, entity string").distinct()


def _mentions(text: str, spans: list[dict]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the spans of a text."""
    for s in spans:
        end = s["start"] + s["length"]
        yield s["start"], end, s["kind"], canonical(s["kind"], text[s["start"] : end])


def attempts(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate another one holds, or is themselves.

    An entity that can only be itself is let be. Each attempt at a name is longer than the last, so the rounds end.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("kind", "entity", "attempt")), strict=True))
            yield pa.record_batch([*batch.columns, pa.array([surrogate(*r, key) for r in rows], pa.string())], [*batch.schema.names, "made"])

    schema = "kind string, entity string, attempt int, made string"
    given = cut(found.withColumn("attempt", F.lit(0)).mapInArrow(made, schema), "surrogates")
    while True:
        first = given.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        met = first.where("n > 1").select("kind", "made", F.col("first.entity").alias("holder"))
        late = given.join(met, ["kind", "made"]).where(F.col("entity") != F.col("holder")).select("kind", "entity", "attempt")
        late = cut(late.union(given.where("made = entity and kind = 'name'").select("kind", "entity", "attempt")).distinct(), "late")
        if late.isEmpty():
            return given.where("attempt > 0").select("kind", "entity", "attempt")
        again = late.withColumn("attempt", F.col("attempt") + 1).mapInArrow(made, schema)
        given = cut(given.join(late, ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "made").union(again), "surrogates")


def session_key(docs: DataFrame) -> bytes:
    named = docs.sparkSession.conf.get("tidewheel.surrogate.key", None)
    return hashlib.blake2b(named.encode(), digest_size=32).digest() if named else KEY


class Surrogates:
    """Surrogates of mentions, remembered up to a number of entities."""

    def __init__(self, key: bytes, most: int = 100_000):
        self.key, self.most, self.known = key, most, {}

    def of(self, kind: str, entity: str, mention: str, late: dict[tuple[str, str], int]) -> str:
        if kind != "person":
            return rendered(kind, mention, self._part(*parts(kind, entity)[0], late))
        words = entity.split(" ")
        first = [_first_name(words[0], self.key)] if len(words) > 1 and words[0] in _GENDER else []
        return rendered(kind, mention, " ".join([*first, *(self._part(k, w, late) for k, w in parts(kind, entity))]))

    def _part(self, kind: str, entity: str, late: dict[tuple[str, str], int]) -> str:
        asked = (kind, entity, late.get((kind, entity), 0))
        if asked not in self.known:
            if len(self.known) > self.most:
                self.known.clear()
            self.known[asked] = surrogate(*asked, self.key)
        return self.known[asked]


def replaced(docs: DataFrame, key: bytes | None = None, sent: int = SENT) -> DataFrame:
    """docs with surrogates in text, and added columns n_entities and entities (kind, start, length, surrogate).

    start and length count characters of the original text.
    """
    docs = docs.drop("n_entities", "entities")
    key = key or session_key(docs)
    spark, names = docs.sparkSession, docs.columns
    spans, own_late = _free("spans_", names), _free("late_", names)
    held = searched(docs, spans)
    late = cut(attempts(entities(held, spans), key), "attempts")
    few = late.limit(sent + 1).count() <= sent
    told = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in late.collect()} if few else {})
    rows = held.withColumn(own_late, F.lit(None).cast(_ATTEMPTS)) if few else _with_attempts(held, late, spans, own_late)
    rest = [c for c in names if c != "text"]
    added = StructType.fromDDL("n_entities bigint, entities array<struct<kind:string,start:int,length:int,surrogate:string>>")
    schema = StructType([*(docs.schema[c] for c in rest), docs.schema["text"], *added])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        kind_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, all_spans = [], []
            for text, found, own in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), batch.column(own_late), strict=True):
                late_here = {(x["kind"], x["entity"]): x["attempt"] for x in own.as_py()} if own.is_valid else told.value
                out, pieces, at = [], [], 0
                for a, b, kind, name in _mentions(text, found):
                    new = made.of(kind, name, text[a:b], late_here)
                    pieces += [text[at:a], new]
                    out.append({"kind": kind, "start": a, "length": b - a, "surrogate": new})
                    at = b
                texts.append("".join([*pieces, text[at:]]) if out else text)
                all_spans.append(out)
            yield pa.record_batch(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(s) for s in all_spans], pa.int64()), pa.array(all_spans, kind_)],
                [*rest, "text", "n_entities", "entities"],
            )

    return rows.mapInArrow(each, schema)


def _with_attempts(held: DataFrame, late: DataFrame, spans: str, own_late: str) -> DataFrame:
    """held with the attempts that each text's entities need, joined by entity and then by text."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, hashes = (batch.column(k).to_pylist() for k in range(3))
            rows = [(h, *part) for text, own, h in zip(texts, found, hashes, strict=True) for part in {p for _, _, kind, name in _mentions(text, own) for p in parts(kind, name)}]
            hashes, kinds, names = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(hashes, pa.string()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["text_hash", "kind", "entity"])

    text_hash = F.sha2("text", 256)
    pairs = held.where(F.size(spans) > 0).select("text", spans, text_hash.alias("h")).mapInArrow(own, "text_hash string, kind string, entity string").distinct()
    needed = pairs.join(late, ["kind", "entity"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("attempts_"))
    d, n = held.alias("d"), needed.alias("n")
    return d.join(n, text_hash == F.col("n.text_hash"), "left").select("d.*", F.coalesce("n.attempts_", F.array().cast(_ATTEMPTS)).alias(own_late))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data and secrets, and where they stand."""
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_surrogates": op5_surrogates}
ORACLE_SQL: dict[str, str] = {}
