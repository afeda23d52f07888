"""Operator 9, personal data: detected entities receive keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity's own domain: its letters and digits are read as one number in the mixed
radix of their classes (lower, upper, digit, hexadecimal, vowels and consonants of a script), a Feistel network keyed by
HMAC moves the number, and what falls outside the domain walks on until it is inside. So equal entities get equal
surrogates anywhere in the corpus without a table (coreference), and distinct ones of one shape get distinct ones. Parts
that make the type stay: the country code of a phone, issuer and check digit rule of a card, octets of an address,
top-level domain of an address, title and grammatical ending of a name. A name is moved word by word: a given name in the
list of its gender and script moves within that list, any other word keeps its last letter and stays outside the lists.
`collisions` verifies it over all entities of the corpus, grouped by surrogate; if any two originals met, the key is
changed and the check runs again before a text is written.

Persons are found by a title, or by a listed given name before another name; every further mention in the same text of a
word of such a name goes, too, and gets the word's surrogate.

The key is never part of the program. It is an argument, or the session's setting `spark.tabforge.surrogates.key`; where
that is unset a call draws a random one, with which nobody can undo the surrogates and which no other call repeats.

Defined cases: a null text stays null and an empty one empty; a text without entities is unchanged; repeated rows are
changed alike; overlapping finds give way to the earlier, then longer one; an empty table gives an empty result; all other
columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import text_slices

KEY_SETTING = "spark.tabforge.surrogates.key"

# Titles by gender, and common given names by script and gender.
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Signora Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Sr Signor Господин Κύριος".split(), "n": "Dr Prof Mx".split()}
GIVEN = {
    ("latin", "f"): "Alice Anna Carla Clara Diana Elena Emma Eva Julia Laura Lucia Maria Mary Nina Olivia Paula Rosa Sara Sofia Susan".split(),
    ("latin", "m"): "Adam Albert Carl Daniel David Eric Frank George Hans James John Lucas Mark Martin Oscar Paul Peter Robert Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Денис Иван Михаил Николай Олег Пётр Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αντώνης Γιάννης Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
# Letters that surrogates are made of.
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоу", "бвгджзклмнпрстфхцчш"), "greek": ("αειου", "βγδζθκλμνξπρστφχψ")}
CLASSES = ["0123456789", *(x for pair in LETTERS.values() for x in pair)]
CLASS_OF = {c: k for k, x in enumerate(CLASSES) for c in x}
# Accented letters count as their base letter's class.
CLASS_OF |= {c: CLASS_OF[b] for b, more in {"a": "áàâäãå", "e": "éèêë", "i": "íìîï", "o": "óòôöõø", "u": "úùûü", "n": "ñ", "c": "ç", "s": "ß", "α": "ά", "ε": "έ", "ι": "ίϊ", "ο": "ό", "υ": "ύ", "и": "й"}.items() for c in more}

LISTS = {w: names for names in GIVEN.values() for w in names}
_TITLE = "|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))
_NAME = r"[A-ZÀ-ÞΑ-ΩΆΈΊΌΎΏА-ЯЁ][^\W\d_]+(?:-[A-ZÀ-ÞΑ-ΩА-ЯЁ][^\W\d_]+)?"
#: What must be in a text for a pattern to be tried (a key of HINTS), the type, the pattern.
PATTERNS: list[tuple[str, str, re.Pattern]] = [
    ("@", "email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("digit", "card", re.compile(r"(?<![\w.+-])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])")),
    ("digit", "phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![\w-])")),
    ("digit", "ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("digit", "ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("digit", "iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("sign", "secret", re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)["']?\s{0,3}[=:]\s{0,3}["']?(?P<at>[A-Za-z0-9+/_~.\-]{8,})""")),
    ("digit", "secret", re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![A-Za-z0-9_-])")),
    ("title", "person", re.compile(rf"\b(?P<title>{_TITLE})\.? (?P<at>{_NAME}(?: {_NAME}){{0,2}})")),
    ("given", "person", re.compile(rf"(?<!\w)(?P<at>(?:{'|'.join(LISTS)})(?: {_NAME}){{1,2}})")),
]
_TITLES = re.compile("|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True)).encode()).search
HINTS: dict[str, Callable[[bytes], object]] = {
    "@": lambda b: b"@" in b,
    "digit": lambda b: len(b.translate(None, b"0123456789")) < len(b),
    "sign": lambda b: b"=" in b or b":" in b,
    "title": lambda b: _TITLES(b),
    "given": lambda b: not _GIVEN.isdisjoint(b.split()),
}
_GIVEN = {w.encode() for w in LISTS}
_PARTS = re.compile("[ -]")


def find(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """start, end and type of the entities, in order, without overlaps."""
    raw = text.encode() if raw is None else raw
    got, hint = [], {k: may(raw) for k, may in HINTS.items()}
    for need, kind, pattern in PATTERNS:
        if hint[need]:
            for m in pattern.finditer(text):
                a, b = m.span("at" if "at" in pattern.groupindex else 0)
                if kind != "card" or 13 <= sum(c.isdigit() for c in text[a:b]) <= 19:
                    got.append((a, b, kind))
    if names := {w for a, b, kind in got if kind == "person" for w in _PARTS.split(text[a:b])}:
        mention = "|".join(map(re.escape, sorted(names, key=lambda w: (-len(w), w))))
        got += [(*m.span(), "person") for m in re.finditer(rf"(?<!\w)(?:{mention})(?!\w)", text)]
    got.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in got:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _network(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of range(size), or its inverse: an eight-round Feistel network with cycle walking."""
    half = max(1, (size.bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(r: int, x: int) -> int:
        d = hashlib.blake2b(f"{tweak}|{size}|{r}|{x}".encode(), key=key[:64], digest_size=max(8, (half + 7) // 8) if half <= 512 else 64).digest()
        return int.from_bytes(hashlib.shake_256(key + d).digest((half + 7) // 8) if half > 512 else d, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(8)) if back else range(8):
            left, right = (right ^ mixed(r, left), left) if back else (right, left ^ mixed(r, right))
        value = (left << half) | right
        if value < size:
            return value


def _moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of range(size). A small range moves along one cycle through all of it, so that nothing stays where it is."""
    if size < 2:
        return value
    at = _network(value, size, key, tweak)
    return _network((at + 1) % size, size, key, tweak, back=True) if size <= 1 << 20 else at


def _spelt(text: str, key: bytes, tweak: str, hexa: bool = False, keep: frozenset[int] = frozenset()) -> str:
    """text with its letters and digits moved within their classes; case stays, as do the positions in keep and all other characters."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    sets = ["0123456789abcdef" if hexa and c in "0123456789abcdef" else CLASSES[CLASS_OF[c]] if c in CLASS_OF else "" for c in low]
    at = [i for i, s in enumerate(sets) if s and i not in keep]
    size, value = 1, 0
    for i in at:
        s = sets[i]
        base = low[i] if low[i] in s else s[sum(map(ord, low[i])) % len(s)]
        size, value = size * len(s), value * len(s) + s.index(base)
    # accents are part of the shape, so texts that differ in them alone stay distinct
    shape = "".join("-" if low[i] in sets[i] else low[i] for i in range(len(low)) if sets[i])
    value = _moved(value, size, key, f"{tweak}|{shape}")
    out = list(text)
    for i in reversed(at):
        value, k = divmod(value, len(sets[i]))
        out[i] = sets[i][k].upper() if text[i] != low[i] else sets[i][k]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _laid(digits: str, form: str) -> str:
    """form with its digits replaced."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _person(name: str, key: bytes) -> str:
    """name with each of its words moved, as it is moved wherever it stands."""
    words = re.split("([ -])", name)
    for i in range(0, len(words), 2):
        w = words[i]
        if w in LISTS:
            words[i] = LISTS[w][_moved(LISTS[w].index(w), len(LISTS[w]), key, f"given|{LISTS[w][0]}")]
            continue
        ending = frozenset(range(max(1, len(w) - 1), len(w)))
        words[i] = _spelt(w, key, "name", keep=ending)
        while words[i] in LISTS:
            words[i] = _spelt(words[i], key, "name", keep=ending)
    return "".join(words)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity, in the form in which it is written."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_spelt(local, key, 'local')}@{_spelt(host, key, 'host')}.{top}"
    digits = "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return _laid(digits[:-10] + _spelt(digits[-10:], key, "phone"), text)
    if kind == "card":
        body = digits[0] + _spelt(digits[1:-1], key, "card" + digits[0])
        return _laid(body + str((int(digits[-1]) - _luhn(digits[:-1]) + _luhn(body)) % 10), text)
    if kind == "ip":
        number = _moved(int.from_bytes(map(int, text.split(".")), "big"), 1 << 32, key, "ip")
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "person":
        return _person(text, key)
    if kind == "iban":
        plain = text.replace(" ", "")
        body = _spelt(plain[4:], key, "iban" + plain[:2])
        rest = lambda b, c: int("".join(str(int(x, 36)) for x in b + plain[:2] + c)) % 97
        check = f"{98 - rest(body, '00'):02d}" if rest(plain[4:], plain[2:4]) == 1 else _spelt(plain[2:4], key, "iban check")
        it = iter(plain[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in text)
    hexa = kind == "secret" and re.fullmatch("[0-9a-f]+", text) is not None
    return _spelt(text, key, kind, hexa)


def canonical(kind: str, text: str) -> str:
    """What written forms of one entity share: digits of numbers (the last ten of a phone), lower case of addresses, else the text."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())[-10 if kind == "phone" else 0 :]
    return text.lower() if kind == "email" else text.replace(" ", "") if kind == "iban" else text


def masked(text: str, found: list[tuple[int, int, str]], key: bytes) -> str:
    out, end = [], 0
    for a, b, kind in found:
        out += [text[end:a], surrogate(kind, text[a:b], key)]
        end = b
    return "".join([*out, text[end:]])


def session_key(docs: DataFrame) -> bytes:
    """The key that the session is set to, hashed; a random one where it is unset."""
    own = docs.sparkSession.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(own.encode(), digest_size=32).digest() if own else secrets.token_bytes(32)


def entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Each distinct kind, original (canonical) and surrogate (canonical) of the corpus."""

    def run(batches):
        for _, texts in text_slices(batches, text):
            rows = set()
            for raw in texts:
                t = raw.decode()
                rows |= {(k, canonical(k, t[a:b]), canonical(k, surrogate(k, t[a:b], key))) for a, b, k in find(t, raw)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*sorted(rows))], ["kind", "original", "surrogate"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "kind string, original string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one original, and originals that got more than one surrogate."""
    met = found.groupBy("kind", "surrogate").count().where("count > 1").select("kind", F.col("surrogate").alias("value"), F.lit("distinctness").alias("broken"))
    split = found.groupBy("kind", "original").count().where("count > 1").select("kind", F.col("original").alias("value"), F.lit("coreference").alias("broken"))
    return met.unionByName(split)


def safe_key(docs: DataFrame, key: bytes, text: str = "text", tries: int = 5) -> bytes:
    """key, or one made from it with which no two entities of the corpus collide."""
    for _ in range(tries):
        if not collisions(entities(docs, key, text)).take(1):
            return key
        key = hashlib.blake2b(b"next", key=key[:64], digest_size=32).digest()
    raise ValueError("no key without collisions was found")


def mask(docs: DataFrame, key: bytes | None = None, text: str = "text") -> DataFrame:
    """docs with surrogates in the text column; the schema stays. key: by default session_key."""
    key = safe_key(docs, session_key(docs) if key is None else key, text)

    def run(batches):
        for part, texts in text_slices(batches, text):
            at = part.schema.get_field_index(text)
            plain = part.column(at)
            new = []
            for raw, valid in zip(texts, plain.is_valid().to_pylist()):
                t = raw.decode()
                new.append(masked(t, find(t, raw), key) if valid else None)
            yield part.set_column(at, part.schema.field(at), pa.array(new, plain.type))

    return docs.mapInArrow(run, docs.schema)


def masked_documents(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the text with surrogates, how many entities it held and their kinds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = safe_key(rows, session_key(docs) if key is None else key)

    def run(batches):
        for part, texts in text_slices(batches):
            new, kinds = [], []
            for raw, valid in zip(texts, part.column(1).is_valid().to_pylist()):
                t = raw.decode()
                found = find(t, raw)
                new.append(masked(t, found, key) if valid else None)
                kinds.append([x[2] for x in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "kinds"])

    out = rows.mapInArrow(run, "doc_id long, text string, kinds array<string>")
    return out.select("doc_id", F.size("kinds").alias("n_entities"), "kinds", "text")
