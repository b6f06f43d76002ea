"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

A surrogate is the image of the entity under a keyed permutation of all strings of its format (a Feistel network with
cycle walking).  Permutations have no collisions, so different entities stay different and every mention of one entity,
in any document and on any machine, gets the same surrogate, without a table of entities.  Where a class of strings is
closed (numbers with a right check digit, listed given names, private addresses), images outside it are walked on until
they fall inside, which keeps the permutation; that walk is the collision check.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, slices, tables

#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Clara Elena Sophie Camille Lucia Carmen Ingrid Greta Alice Helen Jane Mary Susan Linda".split(),
    ("latin", "m"): "John James Peter Paul Thomas Michael David Daniel Martin Hans Karl Jean Pierre Louis Carlos Miguel Pablo Robert Henry George".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
#: Titles and the gender that they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Alphabets within which a letter is replaced; vowels stay vowels.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñßðþýÿ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "0123456789")
_PLACE = {c: (a, i) for a, alphabet in enumerate(ALPHABETS) for i, c in enumerate(alphabet)}


@cache
def _scripts() -> tuple[dict[str, list[str]], dict[str, tuple[str, int]]]:
    """The letters of all other alphabets by script (the first word of their names), those with case apart, and the
    place of each."""
    letters: dict[str, list[str]] = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if c.isalpha() and c == c.lower() and c not in _PLACE:
            up = c.upper()
            cased = up != c and len(up) == 1 and up.lower() == c
            script = unicodedata.name(c, f"BLOCK{ord(c) >> 8}").split()[0].split("-")[0]
            letters.setdefault(f"{script}{'+' if cased else ''}", []).append(c)
    return letters, {c: (k, i) for k, found in letters.items() for i, c in enumerate(found)}


_GIVEN = {n.lower(): kind for kind, names in NAMES.items() for n in names}
_HEX = "0123456789abcdef"


def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_NAME = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))+"
PATTERNS = {
    "email": r"(?<![\w.+\-])[\w+\-](?:[\w.+\-]*[\w+\-])?@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,24}(?!\w)",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-f]{0,63}[a-f])(?=[a-f]{0,63}[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9A-F]{0,63}[A-F])(?=[A-F]{0,63}[0-9])[0-9A-F]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "token": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|sk-[0-9A-Za-z]{20,64}|xox[abprs]-[0-9A-Za-z]{8,64})(?![0-9A-Za-z])",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\w]|[.\-]\d)|(?<![\w.])\+\d{8,15}(?!\w)",
}
#: A short number is a phone number only after a word that says so.
_SHORT_PHONE = re.compile(r"(?<!\w)(?:[Tt]el|[Pp]hone|[Cc]all|[Ff]ax|[Mm]obile|[Tt]éléphone|[Tt]elefon|[Tt]eléfono|[Тт]ел)\.?:? (?P<phone>\d{3}[\-. ]\d{4})(?![\w\-]|\.\d)")
_NUMERIC = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_TITLED = re.compile(rf"(?<!\w)(?P<title>{_alternatives(TITLES)})(?:\. ?| )(?P<name>{_NAME}(?: {_NAME}){{0,2}})")
#: Words that a person's full name follows.
CUES = ("my name is", "My name is", "Name:", "name:", "Contact:", "Author:", "Dear", "Regards,", "Sincerely,", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "меня зовут", "Меня зовут", "με λένε", "Με λένε")
_CUED = re.compile(rf"(?<!\w)(?P<cue>{_alternatives(CUES)})\s(?P<name>{_NAME}(?: {_NAME}){{1,2}})")
_NAMED = re.compile(rf"(?<!\w)(?P<given>{_alternatives(n for v in NAMES.values() for n in v)}) (?P<family>{_NAME})")


class Permuter:
    """Keyed permutations of {0 .. n-1} without fixed points, one for each tag."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, tag: str, value: int, n: int) -> int:
        if n < 2:
            return value
        half = max(1, (n - 1).bit_length() + 1 >> 1)
        salt = f"{tag}:{n}:".encode()
        # one step along a cycle of all values, in the keyed order
        return self._walk(salt, half, (self._walk(salt, half, value, n) + 1) % n, n, back=True)

    def _walk(self, salt: bytes, half: int, value: int, n: int, back: bool = False) -> int:
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for turn in reversed(range(6)) if back else range(6):
                by = left if back else right
                digest = hmac.new(self.key, salt + turn.to_bytes(1, "big") + by.to_bytes((half + 7) // 8, "big"), hashlib.sha256).digest()
                grown = digest if half <= 256 else b"".join(hashlib.sha256(digest + i.to_bytes(4, "big")).digest() for i in range((half + 255) // 256))
                mixed = int.from_bytes(grown, "big") & mask
                left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
            value = left << half | right
            if value < n:
                return value

    @staticmethod
    def _letters(alphabet: int | str):
        return ALPHABETS[alphabet] if isinstance(alphabet, int) else _scripts()[0][alphabet]

    def word(self, tag: str, text: str, alphabets=None, keep: int = 0) -> str:
        """Another string of the same shape: letters in their own alphabet and case, digits digits, the rest and the
        last ``keep`` characters kept."""
        spots, value, n = [], 0, 1
        for i, c in enumerate(text[: len(text) - keep]):
            place = alphabets.get(c.lower()) if alphabets else _PLACE.get(c.lower())
            if not place and not alphabets and c.isalpha():
                place = _scripts()[1].get(c.lower())
                if c != c.lower() and (not place or c.lower().upper() != c):
                    place = None
            if place and len(c.lower()) == 1:
                size = len(_HEX) if alphabets else len(self._letters(place[0]))
                spots.append((i, place[0], size, c != c.lower()))
                value, n = value * size + place[1], n * size
        shape = "".join(f"{a},{size};" for _, a, size, _ in spots) + (text[-keep:].lower() if keep else "")
        value = self.permute(f"{tag}:{shape}", value, n)
        out = list(text)
        for i, a, size, upper in reversed(spots):
            value, k = divmod(value, size)
            c = _HEX[k] if alphabets else self._letters(a)[k]
            out[i] = c.upper() if upper else c
        return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


class Surrogates:
    def __init__(self, key: bytes):
        self.keyed = Permuter(key)
        self.known: dict[tuple[str, str], str] = {}
        self.meant: dict[tuple[str, str], str] = {}

    def of(self, kind: str, entity: str) -> str:
        """The surrogate of an entity, checked against those that this task made: none may stand for two entities of a
        type or for itself.  The task remembers 50,000 of them; over a whole table :func:`collisions` checks."""
        new = self.known.get((kind, entity))
        if new is None:
            new = getattr(self, kind)(entity)
            if len(self.known) >= 50_000:
                self.known.clear()
                self.meant.clear()
            plain, old = (re.sub(r"\D", "", x) if kind in ("card", "phone", "ssn") else x.lower() for x in (new, entity))
            if self.meant.setdefault((kind, plain), old) != old:
                raise ValueError(f"two entities of type {kind} have one surrogate")
            self.known[kind, entity] = new
        return new

    def token(self, text: str) -> str:
        """The prefix that tells the service stays."""
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-", text)[0]
        return head + self.keyed.word(f"token:{head}", text[len(head) :])

    def ipv6(self, text: str) -> str:
        """Groups change within their length; the first stays, as it tells the kind of address."""
        head, _, rest = text.partition(":")
        new = self.keyed.word("ipv6", rest, {c: (0, i) for i, c in enumerate(_HEX)})
        return f"{head}:{new}"

    def _digits(self, tag: str, text: str, keep: int = 0, walk=None) -> str:
        """Replace the digits of a text after the first ``keep``, whatever stands between them."""
        digits = "".join(c for c in text if c.isdigit())
        new = digits[keep:]
        while True:
            new = str(self.keyed.permute(f"{tag}:{len(digits)}:{digits[:keep]}", int(new or 0), 10 ** len(new))).zfill(len(new)) if new else ""
            if walk is None or walk(digits[:keep] + new) == walk(digits):
                break
        spare = iter(digits[:keep] + new)
        return "".join(next(spare) if c.isdigit() else c for c in text)

    def email(self, text: str) -> str:
        user, _, host = text.rpartition("@")
        labels = host.split(".")
        return ".".join([f"{self.keyed.word('user', user)}@{self.keyed.word('host', labels[0])}", *(self.keyed.word("host", x) for x in labels[1:-1]), labels[-1]])

    def secret(self, text: str) -> str:
        return self.keyed.word("hex", text, {c: (0, i) for i, c in enumerate(_HEX)})

    def iban(self, text: str) -> str:
        """The country stays, the check digits are made right for the new account if they were right before."""
        bare = text.replace(" ", "")
        account = self.keyed.word(f"iban:{bare[:2]}", bare[4:].lower()).upper()
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        valid = number(bare[4:] + bare[:4]) % 97 == 1
        check = f"{98 - number(account + bare[:2] + '00') % 97:02d}" if valid else bare[2:4]
        spare = iter(bare[:2] + check + account)
        return "".join(next(spare) if c != " " else c for c in text)

    def ip(self, text: str) -> str:
        """Private, loopback and public addresses stay so."""
        kind = lambda v: "p" if v >> 24 == 10 or v >> 20 == 0xAC1 or v >> 16 == 0xC0A8 else "l" if v >> 24 == 127 else "o" if v >> 24 == 0 or v >> 24 >= 224 else "g"
        old = value = int.from_bytes(bytes(map(int, text.split("."))), "big")
        while True:
            value = self.keyed.permute("ip", value, 1 << 32)
            if kind(value) == kind(old):
                return ".".join(map(str, value.to_bytes(4, "big")))

    def card(self, text: str) -> str:
        return self._digits("card", text, walk=luhn)

    def ssn(self, text: str) -> str:
        return self._digits("ssn", text)

    def phone(self, text: str) -> str:
        """The first digit stays (of an international number it is the zone), however the number is written."""
        return self._digits("phone", text, keep=1)

    def given(self, name: str, gender: str = "") -> str:
        """A listed name becomes another of its script and gender; any other, a word of its shape and with its ending,
        which is what tells the gender of most names, that isn't listed."""
        kind = _GIVEN.get(name.lower())
        if kind is None:
            return self.family(name)
        names = NAMES[kind]
        i = [n.lower() for n in names].index(name.lower())
        new = names[self.keyed.permute(f"given:{kind}", i, len(names))]
        return new.upper() if name.isupper() else new

    def family(self, name: str) -> str:
        """A word of the same shape and ending that is no listed name: one permutation for all names, so that a given
        and a family name don't meet.  The ending tells the gender of Slavic and Greek family names too."""
        new = name
        while True:
            new = self.keyed.word("name", new, keep=int(len(name) > 2))
            if new.lower() not in _GIVEN:
                return new


def _names(text: str, made: Surrogates) -> list[tuple[int, int, str, str]]:
    """Spans of person names with surrogates: after a title or a cue, or starting with a listed given name, and then every
    later or earlier mention of one of their parts in the same document, in capitals and (from four letters) in any case."""
    found = [*_TITLED.finditer(text)] if any(t in text for t in TITLES) else []
    found += [m for m in _CUED.finditer(text) if m["name"].split(" ")[1][0].isupper()] if any(c in text for c in CUES) else []
    found += _NAMED.finditer(text)
    parts: dict[str, str] = {}
    for m in found:
        groups = m.groupdict()
        titled = "title" in groups
        named = []
        for w in (groups.get("name") or f"{m['given']} {m['family']}").split(" "):
            if not w[0].isupper():
                break
            named.append(w)
        if not named or not titled and len(named) < 2:
            continue
        for i, w in enumerate(named):
            last = i == len(named) - 1
            if w.lower() not in parts:
                new = made.family(w) if last and w.lower() not in _GIVEN else made.given(w)
                parts[w.lower()] = new if not w.isupper() else new.title()
    if not parts:
        return []
    long, short = [w for w in parts if len(w) > 3], [w for w in parts if len(w) <= 3]
    forms = [rf"(?i:{_alternatives(long)})"] if long else []
    forms += [_alternatives([x for w in short for x in (w.title(), w.upper())])] if short else []
    spans = []
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(forms)})(?!\w)", text):
        if (new := parts.get(m[0].lower())) is not None:
            spans.append((m.start(), m.end(), "name", new.upper() if m[0].isupper() and len(m[0]) > 1 else new.lower() if m[0].islower() else new))
    return spans


def replace(text: str, made: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and the (type, entity, surrogate) of each replacement in order."""
    spans = []
    if re.search(r"[@\d]|[0-9A-Fa-f]{32}|sk-|xox|gh[pousr]_|AKIA|::", text):
        spans += [(m.start(), m.end(), m.lastgroup, made.of(m.lastgroup, m[0])) for m in _NUMERIC.finditer(text)]
        spans += [(*m.span("phone"), "phone", made.of("phone", m["phone"])) for m in _SHORT_PHONE.finditer(text)]
    spans += _names(text, made)
    out, at, told = [], 0, []
    for a, b, kind, new in sorted(spans):
        if a < at:
            continue
        out += [text[at:a], new]
        told.append((kind, text[a:b], new))
        at = b
    return "".join([*out, text[at:]]), told


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """Replace e-mail addresses, phone numbers, IP addresses (both kinds), card and account numbers, IBANs, social
    security numbers, hexadecimal secrets, service keys and person names.  Persons are found by title, by what comes
    before them or by a listed given name; a name without any of these is not found.

    Returns ``doc_id, n_entities, kinds`` (``type:count``, sorted, with commas), ``found`` (array of type, entity and
    surrogate), ``text`` (with surrogates, all else untouched) and ``rest`` (all other columns).

    Rows are documents; repeated rows have equal results.  A null text stays null with no entities; an empty table
    gives no rows.  Texts pass in slices of about 2 MB; of a longer one a worker holds that text and its entities.  One
    pass without a shuffle: equal entities get equal surrogates everywhere, different ones of a
    type different ones (see :func:`collisions`, which verifies it over a whole table).
    """
    base = docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest"))
    found = "array<struct<kind:string,entity:string,surrogate:string>>"
    schema = T.StructType([base.schema["doc_id"], *T._parse_datatype_string(f"n_entities long, kinds string, found {found}, text string").fields, base.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        told_type = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))
        for batch in slices(batches):
            texts, told = [], []
            for text in batch.column("text").to_pylist():
                new, found = replace(text, made) if text else (text, [])
                texts.append(new)
                told.append([{"kind": k, "entity": e, "surrogate": s} for k, e, s in found])
            kinds = [",".join(f"{k}:{n}" for k, n in sorted(Counter(t["kind"] for t in x).items())) for x in told]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, told), pa.int64()), pa.array(kinds, pa.string()), pa.array(told, told_type), pa.array(texts, pa.string()), batch.column("rest")], names=schema.names)

    return base.mapInArrow(run, schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for several entities of one type; there are none.  Entities are compared as they count:
    without case, and numbers by their digits."""
    plain = lambda c: F.when(F.col("kind").isin("card", "phone", "ssn"), F.regexp_replace(c, r"\D", "")).otherwise(F.lower(c))
    told = replaced.select(F.explode("found").alias("f")).select("f.*")
    told = told.select("kind", plain(F.col("entity")).alias("entity"), plain(F.col("surrogate")).alias("surrogate"), F.length(plain(F.col("entity"))).alias("n")).distinct()
    return told.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


#: Of the query, where the session has no ``spark.quillgraph.pii.key``: for tests and demonstrations, not for real data.
DEMO_KEY = "quillgraph-surrogates-1"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quillgraph.pii.key", DEMO_KEY)
    return surrogates(tables(spark, sf_dir, "documents").select("doc_id", "text"), key.encode()).select("doc_id", "n_entities", "kinds", "text")
