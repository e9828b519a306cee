"""Surrogates for personal data.

Detected entities (mail addresses, phone numbers, IPv4 and IPv6 addresses,
payment cards with a right check digit, social security numbers, IBANs with right
check digits, secrets assigned to a name, access keys of known forms, person names
after a title or before an honorific) are replaced by values of the same type.  A
surrogate is derived from a secret key and the entity in a normal form, so all
mentions share one (coreference), and laid out in the form of each mention:
separators, letter case, digit places and digit set, script.  Cards and IBANs keep
right check digits, phones their country code, given names the gender that the
title shows.

Names are replaced word by word: the surname by itself, the words before it with
the gender.  "Mr John Smith", "Dr Smith" and, further on in the same text, a bare
"Smith" or "John" therefore agree.

Distinctness is checked over the corpus: distinct entities whose surrogates are
equal, or equal to a real entity, are given another try until none is left.
Names grow with every try; after ``TRIES`` tries in the entity's own form the
surrogates of mail addresses, phone numbers and secrets grow as well, so that a
small form that many use up doesn't end the search; the other types have 10^9
values or more.  Few entities need that; what they need is sent to every executor
only up to ``BROADCAST`` bytes and is otherwise joined to the documents.

Null texts stay null with no entities; repeated rows are treated alike; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import BROADCAST, drop, keep
from .batches import short_batches

#: Tries in the form of the entity; later ones are longer.
TRIES = 12
NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
    r"|(?<![\w.,+-])0\d{2,4} \d{3,4} \d{3,4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
)
DIGITS = re.compile(r"\d+")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd)\b\s*[=:]\s*[\"']?([A-Za-z0-9_+/=.-]{8,})")
HINTS = ("oken", "OKEN", "ecret", "ECRET", "key", "Key", "KEY", "assw", "ASSW")
# Access keys by the prefix that their makers give them.
TOKEN = re.compile(r"(?<!\w)((?:AKIA|ASIA)(?=[0-9A-Z]{16}(?!\w))|gh[pousr]_(?=\w{36})|xox[abprs]-(?=[\w-]{10})|sk_live_(?=\w{16})|AIza(?=[\w-]{35}))[\w-]+")
TOKEN_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza")
MAIL_LEFT = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Nd}._%+-]{1,64}\Z")
MAIL_RIGHT = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Nd}-]{1,63}(?:\.[\p{Latin}\p{Cyrillic}\p{Greek}\p{Nd}-]{1,63})+")
# Titles that announce a person's name, by the gender they show.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Madame": "f", "Monsieur": "m", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n"}
# Honorifics that follow a name written in Han characters.
HONORIFICS = {"さん": "n", "様": "n", "氏": "n", "先生": "n", "女士": "f", "小姐": "f"}
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
_BY_LENGTH = sorted(TITLES, key=len, reverse=True)
NAME = regex.compile(rf"(?<!\w)(?:({'|'.join(_BY_LENGTH)})\.? ({_WORD}(?: {_WORD})?)|({'|'.join(t.upper() for t in _BY_LENGTH)})\.? ({_WORD}))")
HAN_NAME = regex.compile(rf"(?<!\p{{Han}})(\p{{Han}}{{1,4}}?)({'|'.join(HONORIFICS)})")
TITLE_HINTS = tuple(dict.fromkeys([f"{x}{end}" for t in TITLES for x in (t, t.upper()) for end in ". "] + [*HONORIFICS]))
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he ja jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де ди до за зи ка ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βο γα γε δα δε δι δο ζα ζε κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
    "han": list("安白本川春村大東方福高光海河花佳嘉江金景静静康林玲梅美明木南平青秋山上石水松天田文西小新雪陽玉原月云中竹子"),
}
#: The given name's ending by gender.
ENDINGS = {"latin": {"f": "na", "m": "n"}, "cyrillic": {"f": "на", "m": "н"}, "greek": {"f": "να", "m": "νος"}, "han": {}}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": "".join(SYLLABLES["han"])}
# Country calling codes of two digits; those with 1 and 7 have one, all others three.
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def script(text: str) -> str:
    for name, pattern in (("han", r"\p{Han}"), ("cyrillic", r"\p{Cyrillic}"), ("greek", r"\p{Greek}")):
        if not text.isascii() and regex.search(pattern, text):
            return name
    return "latin"


def ascii_digits(text: str) -> str:
    """``text`` with the digits of every digit set as 0 to 9."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def luhn(digits: str) -> int:
    """Sum that a right number makes a multiple of ten."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Titled names, and further on the bare words of those."""
    out, bare = [], {}
    for m in NAME.finditer(text):
        group = 2 if m[1] else 4
        gender = TITLES[m[1]] if m[1] else next(g for t, g in TITLES.items() if t.upper() == m[3])
        start, end = m.span(group)
        if text[start:end].endswith(("'s", "’s", "'S", "’S")):
            end -= 2
        kind, normal = f"titled-{gender}", text[start:end].lower()
        out.append((start, end, kind, normal))
        for word, (unit, low) in zip(text[start:end].split(" "), units(kind, normal), strict=True):
            if len(word) > 2:
                bare |= {word: (unit, low), word.upper(): (unit, low)}
    for m in HAN_NAME.finditer(text) if any(h in text for h in HONORIFICS) else ():
        out.append((*m.span(1), "name", m[1]))
        if len(m[1]) > 1:
            bare[m[1]] = ("name", m[1])
    if bare:
        end = min(e[1] for e in out)
        for m in _whole(tuple(sorted(bare, key=len, reverse=True))).finditer(text, end):
            out.append((*m.span(), *bare[m[0]]))
    return out


@lru_cache(maxsize=256)
def _whole(words: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(w) if script(w) == "han" else rf"(?<![\w'’-]){re.escape(w)}(?![\w-])" for w in words))


def units(kind: str, normal: str) -> list[tuple[str, str]]:
    """The entities that a mention consists of: a name's words, the last being the surname; other mentions are one."""
    if not kind.startswith("titled"):
        return [(kind, normal)]
    *given, last = normal.split(" ")
    return [*((f"name-{kind[-1]}", w) for w in given), ("name", last)]


def _numbers(text: str) -> Iterator[re.Match]:
    """The matches of ``NUMBERS``, in order: each begins at a run of digits or one or two characters before it."""
    end = 0
    for run in DIGITS.finditer(text):
        first = run.start()
        for at in range(max(end, first - 2), first + 1):
            if m := NUMBERS.match(text, at):
                end = m.end()
                yield m
                break


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities, in order, without overlaps."""
    out = []
    at = text.find("@")
    while at >= 0:
        if (a := MAIL_LEFT.search(text, max(0, at - 64), at)) and (b := MAIL_RIGHT.match(text, at + 1)):
            start = a.start() + len(a[0]) - len(a[0].lstrip("."))
            if start < at:
                out.append((start, b.end(), "mail", text[start : b.end()].lower()))
        at = text.find("@", at + 1)
    if any(h in text for h in HINTS):
        # a line of dots or dashes is a blank or a rule and no secret
        out += [(*m.span(1), "secret", m[1]) for m in SECRET.finditer(text) if any(map(str.isalnum, m[1]))]
    if any(h in text for h in TOKEN_HINTS):
        out += [(*m.span(), f"secret-{len(m[1])}", m[0]) for m in TOKEN.finditer(text)]
    if any(h in text for h in TITLE_HINTS):
        out += _names(text)
    for m in IPV6.finditer(text) if text.count(":") > 2 else ():
        try:
            whole = ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if sum(map(bool, m[0].split(":"))) > 2:
            out.append((*m.span(), "ip-6", whole.exploded))
    for m in _numbers(text):
        kind, whole = m.lastgroup, ascii_digits(m[0])
        plain = re.sub(r"\D", "", whole)
        if kind == "ip" and not all(int(x) < 256 for x in whole.split(".")):
            continue
        if kind == "card" and (not 13 <= len(plain) <= 19 or luhn(plain)):
            continue
        if kind == "phone":
            if not 8 <= len(plain) <= 15:
                continue
            plain = "+" * (whole[0] == "+") + plain
        if kind == "iban":
            plain = whole.replace(" ", "")
            if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
                continue
        out.append((*m.span(), kind, whole if kind == "ip" else plain))
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], -1
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


class Keyed:
    """A stream of numbers from the key, the entity and the try."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int) -> None:
        self.seed, self.n, self.pool = f"{kind}\0{attempt}\0{normal}".encode("utf-8", "surrogatepass"), 0, b""
        self.key = key[:64]

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.seed, key=self.key, salt=self.n.to_bytes(16, "little")).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return x % n


def _shaped(s: str, draw: Keyed) -> str:
    """Digits for digits and letters for letters of the script; what is hexadecimal stays so."""
    if re.fullmatch(r"[0-9a-f]{16,}", s) and not s.isdigit():
        return "".join("0123456789abcdef"[draw.below(16)] for _ in s)

    def one(c: str) -> str:
        if c.isdecimal():
            return str(draw.below(10))
        if not c.isalpha():
            return c
        letters = ALPHABETS[script(c)]
        x = letters[draw.below(len(letters))]
        return x.upper() if c.isupper() else x

    return "".join(map(one, s))


def country_code(phone: str) -> int:
    """How many characters of a phone number in normal form name its country (its first digit without a +)."""
    return 1 if phone[0] != "+" else 1 + (1 if phone[1] in "17" else 2 if phone[1:3] in TWO_DIGITS else 3)


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Surrogate of an entity in normal form, in normal form."""
    draw = Keyed(key, kind, normal, attempt)
    longer = max(0, attempt - TRIES + 1)
    more = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(n))
    if kind == "mail":
        local, _, domain = normal.partition("@")
        *labels, top = domain.split(".")
        if not any(map(str.isalnum, local + "".join(labels))):  # nothing to draw in its own form
            longer = attempt + 1
        return f"{_shaped(local, draw)}{more(longer and longer + 7)}@{'.'.join(_shaped(x, draw) for x in labels)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip-6":  # zero groups stay, so that the short form is as short
        return ":".join(g if g == "0000" else f"{1 + draw.below(0xFFFF):04x}" for g in normal.split(":"))
    if kind == "card":
        body = normal[0] + "".join(str(draw.below(10)) for _ in normal[1:-1])
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "phone":
        own = country_code(normal)
        size = len(normal) - (normal[0] == "+")
        return normal[:own] + "".join(str(draw.below(10)) for _ in range(min(max(15, size), size + longer) - len(normal[:own].lstrip("+"))))
    if kind == "iban":
        body = _shaped(normal[4:], draw)
        return normal[:2] + f"{98 - mod97(normal[:2] + '00' + body):02d}" + body
    if kind.startswith("name"):
        of = script(normal)
        count = (1 if of == "han" else 2) + draw.below(3 if of != "han" else 2) + attempt
        return "".join(SYLLABLES[of][draw.below(len(SYLLABLES[of]))] for _ in range(count)) + ENDINGS[of].get(kind.partition("-")[2], "")
    if kind.startswith("secret-"):  # the maker's prefix stays
        own = int(kind[7:])
        return normal[:own] + _shaped(normal[own:], draw) + more(longer and longer + 7)
    return _shaped(normal, draw) + (more(longer and longer + 7) if kind == "secret" else "")


def laid_out(value: str, kind: str, mention: str) -> str:
    """A surrogate in the form of a mention."""
    if kind in ("card", "phone", "ssn", "iban", "ip") and not mention.isascii():  # the digit set of the mention
        zero = next((ord(c) - int(c) for c in mention if c.isdecimal()), ord("0"))
        return laid_out(value, kind, ascii_digits(mention)).translate({ord("0") + d: zero + d for d in range(10)})
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(value.lstrip("+"))
        return "".join(next(chars) if c.isalnum() else c for c in mention) + "".join(chars)
    if kind == "ip-6":
        whole = ipaddress.IPv6Address(value)
        padded = all(len(g) == 4 for g in mention.split(":"))
        out = whole.exploded if padded else whole.compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in whole.exploded.split(":"))
        return out.upper() if mention.isupper() else out
    if kind == "mail":
        if mention.isupper():
            return value.upper()
        if mention == mention.lower() or len(mention) != len(mention.lower()):
            return value
        # what a longer surrogate has more stands before the @
        at, end = mention.index("@"), value.index("@")
        form = "".join(v.upper() if m.isupper() else v for v, m in zip(value[:at] + value[end:], mention, strict=True))
        return form[:at] + value[at:end] + form[at:]
    if kind.startswith("name"):
        return value.upper() if len(mention) > 1 and mention.isupper() else value[0].upper() + value[1:]
    return value


def replaced(key: bytes, kind: str, normal: str, mention: str, tries: dict[tuple[str, str], int]) -> str:
    """The mention with surrogates for its entities."""
    of, words = units(kind, normal), mention.split(" ") if kind.startswith("titled") else [mention]
    return " ".join(laid_out(surrogate(key, k, n, tries.get((k, n), 0)), k, m) for (k, n), m in zip(of, words, strict=True))


def entities(docs: DataFrame) -> DataFrame:
    """``kind, normal`` of every entity mentioned."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = {u for t in b["text"] if t for _, _, k, n in find(t) for u in units(k, n)}
            yield pd.DataFrame(sorted(got), columns=["kind", "normal"])

    return docs.select("text").mapInPandas(scan, "kind string, normal string")


def second_tries(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal, attempt`` of the entities whose first surrogate isn't theirs alone."""

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(value=[surrogate(key, k, n, a) for k, n, a in zip(b["kind"], b["normal"], b["attempt"], strict=True)])

    schema = "kind string, normal string, attempt int, value string"
    # names of every gender share one space
    space = F.regexp_replace("kind", "-.*", "").alias("space")
    chosen, read = found.withColumn("attempt", F.lit(0)), []
    while True:
        valued = keep(chosen.mapInPandas(derive, schema).select("*", space), "surrogates")
        drop(*read)
        owner = valued.groupBy("space", "value").agg(F.min(F.struct("attempt", "kind", "normal")).alias("owner"), F.count("*").alias("n"))
        taken = owner.filter("n > 1").select("space", "value", "owner")
        again = valued.join(taken, ["space", "value"]).filter((F.col("owner.kind") != F.col("kind")) | (F.col("owner.normal") != F.col("normal"))).select("kind", "normal")
        real = found.select(space, F.col("normal").alias("value"))
        again = again.unionByName(valued.join(real, ["space", "value"], "left_semi").select("kind", "normal")).distinct()
        again = keep(again, "again")
        if again.isEmpty():
            break
        chosen = valued.join(again.withColumn("more", F.lit(1)), ["kind", "normal"], "left").select("kind", "normal", (F.col("attempt") + F.coalesce("more", F.lit(0))).cast("int").alias("attempt"))
        read = [valued, again]
    return valued.filter("attempt > 0").select("kind", "normal", "attempt")


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``text_out``, ``n_entities`` and ``kinds`` of every row."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("text", F.col(f"row.`{text}`"))
    found = keep(entities(rows).distinct(), "entities")
    tries = keep(second_tries(found, key), "second-tries")
    small = tries.agg(F.sum(F.length("kind") + 2 * F.length("normal") + 100)).first()[0] or 0
    if small <= BROADCAST:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["normal"]): r["attempt"] for r in tries.toLocalIterator()})
        rows = rows.withColumn("tries", F.lit(None).cast("array<struct<kind:string,normal:string,attempt:int>>"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast({})

        def scan(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"kind": k, "normal": n} for k, n in sorted({u for _, _, k, n in find(t) for u in units(k, n)})] if t else [] for t in texts], dtype=object)

        scan.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        found_in = F.pandas_udf(scan, "array<struct<kind:string,normal:string>>")("text")
        held = rows.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.explode(found_in).alias("e")).select("h1", "h2", "e.*")
        per_text = held.join(tries, ["kind", "normal"]).distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("tries"))
        rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).join(per_text, ["h1", "h2"], "left").select("row", "text", "tries")

    result = T.StructType([T.StructField("text_out", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def swap(texts: pd.Series, tries: pd.Series) -> pd.DataFrame:
        known, out = sent.value, []
        for t, own in zip(texts, tries, strict=True):
            got = find(t) if t else []
            mine = known if own is None or not len(own) else known | {(e["kind"], e["normal"]): e["attempt"] for e in own}
            parts, end = [], 0
            for a, b, kind, normal in got:
                parts += [t[end:a], replaced(key, kind, normal, t[a:b], mine)]
                end = b
            out.append(("".join(parts) + t[end:] if got else t, len(got), sorted({k.split("-")[0].replace("titled", "name") for _, _, k, _ in got})))
        return pd.DataFrame(out, columns=["text_out", "n_entities", "kinds"])

    swap.__annotations__ = {"texts": pd.Series, "tries": pd.Series, "return": pd.DataFrame}
    return rows.withColumn("new", F.pandas_udf(swap, result)("text", "tries")).select("row", "new.*")
