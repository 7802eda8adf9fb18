"""Operator 8: surrogates for personal data and secrets.

Detected entities: mail addresses, IPv4 addresses, phone numbers, long numbers (cards keep their
check digit valid), social security numbers, account numbers, access keys, hexadecimal tokens,
values of password-like keys, and names after a title or with a known given name. Of two names
after a title the first is a given name, of the gender that the title says. A name found so is
found wherever its word stands in the document, so later mentions go with the first.

A surrogate is a keyed permutation of the entity within its format: digits stay digits, vowels
vowels and consonants consonants of the same script and case, all else stays in place. A
permutation gives different entities of one format different surrogates, and equal entities
(mail case ignored; name parts apart) the same everywhere. Mail addresses of one domain keep one
domain. Known given names get another given name of the same gender and script, others an ending of
that gender. Then Spark checks all distinct entities for collisions: a surrogate that equals any
entity of the corpus, or that two entities share, is made again with the next counter until none is
left. Entities that still clash after those rounds, as their format has too few free values, get a
longer surrogate (an address: any other one), checked in the same way; if even those don't settle,
it is an error. The key is the caller's.

Each text is searched once, and its entities' places are saved with it. Only rows with entities
pass through the rewriting step; only exceptions travel there, by broadcast if few, else by a join.

Rows: null text stays null; empty text stays. Repeated rows get equal results. A null doc_id keeps
its row. Texts of any length are read whole. An empty table gives an empty table. Other columns
pass through; one that clashes with an output is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches

#: Exceptions up to this many are broadcast (about 100 bytes each); more are joined.
BROADCAST_ROWS = 20_000
#: From this counter on, a surrogate leaves its entity's format for a larger one.
WIDE = 1 << 20

# Given names by script and gender, and titles before names.
GIVEN = {
    ("latin", "f"): "Anna Barbara Carmen Charlotte Claudia Elisabeth Emily Emma Francesca Gabriela Isabella Jennifer Katharina Laura Linda Margaret Maria Monika Patricia Sabine Sophie Susan Ursula Victoria".split(),
    ("latin", "m"): "Alexander Andreas Carlos Charles Christian David Eduardo Francisco George Heinrich James Javier Joseph Klaus Luis Michael Miguel Olivier Patrick Philippe Richard Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Γιάννης Δημήτρης Κώστας Νίκος".split(),
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Don Г-н Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Г-жа Κυρία".split(),
    "u": "Dr Prof".split(),
}
GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäãåèéêëìíîïòóôöõùúûü", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
CLASS = {c: s for s in CLASSES for c in s}
HEX = "0123456789abcdef"
#: Endings of given names by script and gender.
ENDINGS = {("latin", "f"): "ae", ("latin", "m"): "nsrlo", ("cyrillic", "f"): "а", ("cyrillic", "m"): "нрлс", ("greek", "f"): "αη", ("greek", "m"): "ς"}
SCRIPTS = {c: script for script, kinds in (("latin", CLASSES[1:7]), ("cyrillic", CLASSES[7:11]), ("greek", CLASSES[11:15])) for k in kinds for c in k}

_MAIL = r"(?<![\w.+-])(?P<mail>[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,})"
_SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<secret>[^\s\"',;]{6,})"
_KEYED = r"\b(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})\b"
_HEX = r"\b(?P<hex>[0-9a-f]{32,})\b"
_IP = r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?![\d]|\.\d)"
_SSN = r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
_IBAN = r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
_CARD = r"(?<![\d-])(?P<card>\d(?:[ -]?\d){12,18})(?![\d-])"
_PHONE = r"(?<![\w(+])(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{9,12})(?!\d)"
_marked = re.compile("|".join([_MAIL, _SECRET, _KEYED, _HEX, _IP, _SSN, _IBAN, _CARD, _PHONE]))
_needs = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)\s*[=:]")
_near = re.compile(r"[0-9@]|[=:]\s*[\"']?[^\s\"',;]{6}")
_titled = regex.compile(r"\b(" + "|".join(t for ts in TITLES.values() for t in ts) + r")\b\.? (\p{Lu}[\p{Ll}'’-]+)(?: (\p{Lu}[\p{Ll}'’-]+))?")
_given = regex.compile(r"\b(" + "|".join(GENDER) + r") (\p{Lu}\p{Ll}[\p{Ll}'’-]*)")

#: Characters searched at a time behind a mark, and their overlap.
WINDOW, MARGIN = 4096, 256
Found = tuple[int, int, str, str]  # start, stop, kind, value


def detect(text: str | None) -> list[Found]:
    """Entities in order of place, without overlap. Names come part by part."""
    if not text:
        return []
    out: list[Found] = []
    if _needs.search(text):
        at, size = 0, len(text)
        while at < size and (m := _near.search(text, at)):  # look only around marks of an entity
            a = m.start()
            word = max(text.rfind(" ", at, a), text.rfind("\n", at, a), at)
            begin = max(text.rfind(" ", at, word), text.rfind("\n", at, word), at)  # a key may stand a word before
            hit = _marked.search(text, begin, min(size, a + WINDOW))
            if hit and hit.end() > a + WINDOW - MARGIN:  # it may be cut
                hit = _marked.search(text, begin)
            if not hit:
                at = min(size, a + WINDOW) - MARGIN if size > a + WINDOW else size
                continue
            kind = hit.lastgroup
            out.append((*hit.span(kind), kind, hit[kind]))
            at = hit.end(kind)
    names: dict[str, str] = {}  # the kind of each name, as first told
    for m in _titled.finditer(text):
        gender = next(g for g, titles in TITLES.items() if m[1] in titles)
        for k in (2, 3):
            if m[k]:
                kind = "family" if k == 3 or (m[2] not in GENDER and not m[3]) else "given" if m[2] in GENDER else f"given_{gender}"
                names.setdefault(m[k], kind)
    for m in _given.finditer(text):
        names.setdefault(m[1], "given")
        names.setdefault(m[2], "family")
    if names:
        every = regex.compile(r"\b(?:" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + r")\b(?![’'-]\p{L})")
        ends = sorted((o[0], o[1]) for o in out)
        starts = [o[0] for o in ends]
        for m in every.finditer(text):
            k = bisect_right(starts, m.start())
            if (k == 0 or ends[k - 1][1] <= m.start()) and (k == len(ends) or ends[k][0] >= m.end()):
                out.append((*m.span(), names[m[0]], m[0]))
    return sorted(out)


def _stream(key: bytes, *parts: object) -> bytes:
    return hmac.new(key, "\0".join(map(str, parts)).encode("utf-8", "replace"), hashlib.sha256).digest()


def permute(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of mixed-radix numbers: rounds that shift one half by a function of the other."""
    n = len(values)
    if n == 1:
        return [(values[0] + 1 + int.from_bytes(_stream(key, tweak, sizes)[:8], "big") % max(1, sizes[0] - 1)) % sizes[0]]
    now, half = list(values), n // 2
    for r in range(6):
        mine, other = (range(half), range(half, n)) if r % 2 else (range(half, n), range(half))
        seed, block = tuple(now[i] for i in other), b""
        for k, i in enumerate(mine):
            if k % 8 == 0:
                block = _stream(key, tweak, r, k // 8, seed)
            now[i] = (now[i] + int.from_bytes(block[4 * (k % 8) : 4 * (k % 8) + 4], "big")) % sizes[i]
    return now


def _letters(text: str, key: bytes, tweak: str) -> str:
    """All characters of known classes permuted within their classes."""
    places = [i for i, c in enumerate(text) if c in CLASS]
    if not places:
        return text
    kinds = [CLASS[text[i]] for i in places]
    new = permute([s.index(text[i]) for i, s in zip(places, kinds, strict=True)], [len(s) for s in kinds], key, tweak + "\0" + "".join("x" if c in CLASS else c for c in text))
    out = list(text)
    for i, s, v in zip(places, kinds, new, strict=True):
        out[i] = s[v]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _wide(kind: str, value: str, key: bytes, tweak: str) -> str:
    """A surrogate in a larger format: any address, or twelve characters more."""
    block = _stream(key, "wide", tweak, value)
    if kind == "ip":
        return ".".join(str(b) for b in block[:4])
    if kind == "hex":
        return surrogate(kind, value, key) + block.hex()[:12]
    if kind == "family" or kind.startswith("given"):
        lower = next((k for k in (2, 8, 12) if value[0] in CLASSES[k] + CLASSES[k + 2] or value[0] in CLASSES[k - 1] + CLASSES[k + 1]), 2)
        return _letters(value, key, tweak) + "".join(CLASSES[lower - (i % 2)][b % len(CLASSES[lower - (i % 2)])] for i, b in enumerate(block[:12]))
    more = "".join(str(b % 10) for b in block[:12])
    if kind == "mail":
        local, _, domain = surrogate(kind, value, key).partition("@")
        return f"{local}{more}@{domain}"
    return surrogate(kind, value, key) + more


@lru_cache(10_000)
def surrogate(kind: str, value: str, key: bytes, counter: int = 0) -> str:
    """The surrogate of an entity under a key; another one for each counter."""
    tweak = f"{kind}\0{counter}"
    if kind == "given" and value in GENDER:
        names = sorted(GIVEN[GENDER[value]], key=lambda n: _stream(key, "order", n))
        return names[(names.index(value) + 1 + counter) % len(names)]
    if counter >= WIDE:
        return _wide(kind, value, key, tweak)
    if kind == "ip":
        lows = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        octets = value.split(".")
        spans = [lows[len(o)] for o in octets]
        new = permute([int(o) - s[0] for o, s in zip(octets, spans, strict=True)], [s[1] for s in spans], key, f"{tweak}\0{[len(o) for o in octets]}")
        return ".".join(str(s[0] + v) for s, v in zip(spans, new, strict=True))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = _letters(digits[1:-1], key, f"{tweak}\0{digits[0]}\0{len(digits)}\0{luhn(digits)}")
        last = next(d for d in "0123456789" if luhn(digits[0] + body + d)) if luhn(digits) else _letters(digits[-1], key, tweak + "last")
        if not luhn(digits) and luhn(digits[0] + body + last):
            last = str((int(last) + 1) % 10)
        new = iter(digits[0] + body + last)
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "hex":
        new = permute([HEX.index(c) for c in value], [16] * len(value), key, f"{tweak}\0{len(value)}")
        return "".join(HEX[v] for v in new)
    if kind == "phone" and value[0] == "+":
        country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)[0]
        return country + _letters(value[len(country) :], key, f"{tweak}\0{country}")
    if kind == "key":
        prefix = re.match(r"AKIA|ASIA|gh._|sk-", value)[0]
        return prefix + _letters(value[len(prefix) :], key, f"{tweak}\0{prefix}")
    if kind == "iban":
        return value[:2] + _letters(value[2:], key, f"{tweak}\0{value[:2]}")
    if kind == "mail":
        local, _, domain = value.lower().partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local, key, tweak)}@{_letters(host, key, f'domain{chr(0)}{top}')}.{top}"
    if kind.startswith("given_") and len(value) > 2:
        made, choice = _letters(value, key, tweak), ENDINGS.get((SCRIPTS.get(value[0].lower(), ""), kind[-1]), "")
        return made[:-1] + choice[_stream(key, tweak, value)[0] % len(choice)] if choice else made
    return _letters(value, key, tweak)


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    return value.lower() if kind == "mail" else value


def located(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __hm_found: start, stop, kind and value (as `normal` has it) of each entity of the text."""
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("__hm_found", T.ArrayType(place), False)])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(s, e, k, normal(k, v)) for s, e, k, v in detect(t.as_py())] for t in b.column(at).cast(pa.string())]
            rows = [[dict(zip(("start", "stop", "kind", "value"), f, strict=True)) for f in fs] for fs in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def entities(found: DataFrame) -> DataFrame:
    """The distinct kind and value of the output of located."""
    return found.select(F.explode("__hm_found").alias("e")).select("e.kind", "e.value").distinct()


def _made(rows: DataFrame, key: bytes) -> DataFrame:
    """kind, value, counter with their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(k, v, key, n) for k, v, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "value", "counter", "made"])

    return rows.select("kind", "value", "counter").mapInArrow(run, "kind string, value string, counter int, made string")


def assign(known: DataFrame, key: bytes, rounds: int = 50) -> DataFrame:
    """kind, value, counter and made of each distinct entity (kind, value), free of collisions.

    Given names take each other's places within their lists, so of them only distinctness is asked.
    """
    now = saved(_made(known.withColumn("counter", F.lit(0)), key))
    originals = now.where("kind <> 'given'").select("kind", F.col("value").alias("made")).distinct().withColumn("taken", F.lit(True))
    for turn in range(1, 2 * rounds + 1):
        first = now.groupBy("kind", "made").agg(F.min("value").alias("first"))
        checked = now.join(first, ["kind", "made"]).join(originals, ["kind", "made"], "left")
        clash = (F.col("value") != F.col("first")) | F.col("taken").isNotNull() | (F.col("value") == F.col("made"))
        checked = saved(checked.select("kind", "value", "counter", "made", F.coalesce(clash, F.lit(False)).alias("clash")))
        bad = checked.where("clash")
        if not bad.take(1):
            break
        more = F.col("counter") + 1 if turn < rounds else F.greatest(F.col("counter") + 1, F.lit(WIDE))
        again = _made(bad.withColumn("counter", more), key)
        now = saved(checked.where("not clash").drop("clash").unionByName(again))
    else:
        raise RuntimeError(f"surrogates still clash after {2 * rounds} rounds")
    return now


def rewrite(text: str, found: list[tuple[int, int, str, str]], exceptions: dict[tuple[str, str], int], key: bytes) -> str:
    """The text with surrogates in the places of its entities (start, stop, kind, normal value)."""
    out, at = [], 0
    for start, stop, kind, value in found:
        out += [text[at:start], surrogate(kind, value, key, exceptions.get((kind, value), 0))]
        at = stop
    return "".join(out) + text[at:]


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with surrogates in `text`, n_entities and kinds (sorted, distinct)."""
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    at = keep.index(text)
    found = saved(located(docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in keep]), text))
    odd = saved(assign(entities(found), key).where("counter > 0").select("kind", "value", "counter"))
    own = [F.col(f"`{c}`") for c in keep]
    kinds = F.array_sort(F.array_distinct(F.transform("__hm_found", lambda e: e.kind)))
    told = [F.size("__hm_found").cast("long").alias("n_entities"), kinds.alias("kinds")]
    plain, source = found.where(F.size("__hm_found") == 0).select(*own, *told), found.where(F.size("__hm_found") > 0)
    few = odd.count() <= BROADCAST_ROWS
    shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.counter for r in odd.collect()} if few else {})
    if not few:  # each document gets the exceptions among its own entities
        mark = F.xxhash64(F.col(f"`{text}`"))
        each = source.select(mark.alias("__hm_mark"), F.explode("__hm_found").alias("e")).select("__hm_mark", "e.kind", "e.value").distinct()
        per = each.join(odd, ["kind", "value"]).groupBy("__hm_mark").agg(F.collect_list(F.struct("kind", "value", "counter")).alias("__hm_odd"))
        source = source.join(per, mark == F.col("__hm_mark"), "left").select(*own, "__hm_found", "__hm_odd")
    else:
        source = source.select(*own, "__hm_found", F.lit(None).cast("array<struct<kind:string,value:string,counter:int>>").alias("__hm_odd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(at).to_pylist(), b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True)
            new = [rewrite(t, [tuple(f.values()) for f in fs], {(e["kind"], e["value"]): e["counter"] for e in x} if x else shared.value, key) for t, fs, x in rows]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return plain.unionByName(source.mapInArrow(run, source.schema).select(*own, *told))


def result(docs: DataFrame, key: bytes) -> DataFrame:
    return pseudonymize(docs.select("doc_id", "text"), key).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
