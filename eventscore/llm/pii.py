"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Titles (fixed values): those of women, of men, and those that tell nothing.
WOMEN = "Mrs|Ms|Miss|Madam|Frau|Mme|Mlle|Madame|Señora|Sra|Srta|Doña|[Гг]оспожа|[Гг]-жа|Κυρία|[Κκ]α"
MEN = "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|[Гг]осподин|[Гг]-н|Κύριος|Κύριο|[Κκ]ος"
OTHERS = "Dr|Prof|[Дд]октор|Δρ"
#: A name: a capital and more letters, of any case, with apostrophes and hyphens between letters.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L}))+(?!\w)"
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?(?P<v>[^\s\"',;]{6,})",
    "key": r"(?<![\w-])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w-])|(?<![\w-])(?:ghp_|gho_|sk-|xox[bp]-)[\w-]{16,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{2})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.+-])\+\d{8,15}(?![\w-])|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\(?\d{2,8}\)?){2,4}(?![\w-])|(?<![\w.+-])555-\d{4}(?![\w-])|(?<=(?i:\b(?:call|phone|tel|telefon|fax|mobile|dial)\b[.:]? ))\d{3}[ -]\d{4}(?![\w-])",
    "person": rf"(?<!\w)(?P<t>(?:{WOMEN})|(?:{MEN})|(?:{OTHERS}))(?:\.[ \t]?|[ \t])(?P<a>{NAME})(?:[ \t](?P<b>{NAME}))?",
}
FOUND = {k: regex.compile(v) for k, v in PATTERNS.items()}
HINTS = {"email": re.compile("@"), "secret": re.compile("(?i)passw|pwd|token|secret|key"), "ip6": re.compile("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "person": re.compile(rf"(?:{WOMEN}|{MEN}|{OTHERS})[. \t]")}
DIGIT = re.compile("[0-9]")
SHE, HE = regex.compile(f"(?:{WOMEN})$"), regex.compile(f"(?:{MEN})$")
#: Given names by which a person without a title is known (fixed values), and two capitalised words in a row.
GIVEN = {x: s for s, names in {
    "f": "Alice Amanda Amelia Amy Ana Andrea Angela Anna Anne Barbara Carmen Carol Caroline Catherine Charlotte Chloe Christine Claire Claudia Cristina Deborah Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Eva Francesca Gabriele Hannah Heike Helen Helena Ingrid Irina Isabel Isabella Jane Jennifer Jessica Joan Julia Julie Karen Katharina Katherine Kathleen Laura Lena Linda Lisa Lucia Lucy Luisa Margaret Maria Marie Marta Martha Martina Mary Megan Melissa Michelle Monica Monika Nancy Natalia Nicole Nina Olga Olivia Pamela Patricia Petra Rachel Rebecca Renate Rosa Ruth Sabine Sandra Sara Sarah Sharon Silvia Sofia Sophia Sophie Stephanie Susan Susanne Teresa Ursula Valerie Vanessa Victoria Анна Елена Ирина Мария Наталья Ольга Татьяна",
    "m": "Adam Alan Albert Alejandro Alexander Andreas Andrew Anthony Antoine Antonio Arthur Benjamin Bernd Brian Carlos Charles Christian Christopher Claude Daniel David Dennis Diego Dieter Dmitri Donald Edward Enrique Eric Fernando Francis Francisco Frank Friedrich Gary George Georg Gerhard Gregory Guillaume Hans Harry Heinrich Henri Henry Ivan Jack Jacob Jacques James Jason Javier Jean Jeffrey Johann John Jonathan Jorge Jose Joseph Joshua José Juan Jürgen Karl Kevin Klaus Larry Lars Louis Luis Lukas Manuel Mark Martin Matthew Michael Michel Miguel Nicholas Nicolas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Raymond Richard Robert Roger Ronald Ryan Samuel Scott Sebastian Sergio Stefan Stephen Steven Thomas Timothy Tobias Tom Ulrich Victor Walter Werner William Wolfgang Александр Андрей Дмитрий Иван Михаил Сергей",
    "n": "Alex Chris Jordan Kim Robin Sam Taylor",
}.items() for x in names.split()}
PAIR = regex.compile(rf"(?<!\w)(?P<a>{NAME})[ \t](?=(?P<b>{NAME}))")
WORD = regex.compile(rf"(?<!\w){NAME}")
#: Domains that are reserved for examples and name nobody (fixed values).
RESERVED = ("example.com", "example.net", "example.org", "example.edu")
#: Second levels under which countries register names (fixed values).
SECOND = {"ac", "co", "com", "edu", "gov", "gob", "net", "org"}
#: Syllables of invented names, by script, and the endings of women's, men's and family names.
NAMES = {
    "Latin": (["ba", "ca", "da", "el", "fa", "ga", "ha", "in", "jo", "ka", "la", "mi", "na", "or", "pe", "ra", "sa", "ti", "ul", "ve"], {"f": ["na", "ra", "la", "ia"], "m": ["on", "rt", "ck", "us"], "n": ["le", "ry", "is", "el"], "s": ["son", "ner", "man", "berg"]}),
    "Cyrillic": (["ба", "ва", "га", "да", "ел", "жа", "за", "ин", "ка", "ла", "ми", "на", "ор", "пе", "ра", "са", "ти", "ул", "фе", "ха"], {"f": ["на", "ра", "ла", "ия"], "m": ["он", "рт", "ск", "им"], "n": ["ле", "ри", "ис", "ел"], "s": ["енко", "ов", "ман", "ский"]}),
    "Greek": (["βα", "γα", "δα", "ελ", "ζα", "θα", "ιν", "κα", "λα", "μι", "να", "ορ", "πε", "ρα", "σα", "τι", "υλ", "φε", "χα", "ψι"], {"f": ["να", "ρα", "λα", "ια"], "m": ["ος", "ης", "ας", "ων"], "n": ["λε", "ρι", "ις", "ελ"], "s": ["ιδης", "ακης", "ου", "εας"]}),
}


class Entity(NamedTuple):
    """A mention: its range, its kind, and the value that all mentions of the same thing share."""

    start: int
    end: int
    kind: str
    core: str


def script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return next((s for s in ("Cyrillic", "Greek") if name.startswith(s.upper())), "Latin")


def fold(name: str) -> str:
    """What all forms of a name share: its letters in lower case, without a possessive ending."""
    return regex.sub("['’]s$", "", name.casefold())


def detect(text: str) -> list[Entity]:
    """The mentions in a text in their order, without overlaps; of two that overlap the kind that stands first in PATTERNS.

    A person is found behind a title or by a known given name before a capitalised word; every further mention of one of
    the found names, as a whole word whatever its case, is the same entity. A given name has one gender in a text: that
    of the titles it stands behind if they agree, else that of the list of given names; where women and men of one
    given name occur, mentions that don't tell go with the first.
    """
    out: list[Entity] = []
    digits = DIGIT.search(text) is not None
    for kind, pattern in FOUND.items():
        hint = HINTS.get(kind)
        if not (hint.search(text) if hint else digits):
            continue
        for m in pattern.finditer(text):
            if kind == "person":
                title = m["t"]
                sex = "f" if SHE.match(title) else "m" if HE.match(title) else "n"
                first, last = (("a", "b") if m["b"] else (None, "a"))
                new = [Entity(*m.span(last), "family", fold(m[last]))] + [Entity(*m.span("a"), f"given_{sex}", fold(m["a"]))] * bool(first)
            elif kind == "secret":
                new = [Entity(*m.span("v"), kind, m["v"])]
            elif kind == "email":
                new = [Entity(*m.span(), kind, m[0].casefold())]
            elif kind in ("ip", "key"):
                new = [Entity(*m.span(), kind, m[0])]
            elif kind == "ip6":
                new = [Entity(*m.span(), kind, m[0].casefold())]
            else:
                new = [Entity(*m.span(), kind, "".join(c for c in m[0] if c.isalnum()))]
            out += [e for e in new if not any(e.start < x.end and x.start < e.end for x in out)]
    free = lambda start, end: not any(start < x.end and x.start < end for x in out)
    for m in PAIR.finditer(text):
        if (sex := GIVEN.get(m["a"]) or (GIVEN.get(m["a"].capitalize()) if m["a"].isupper() and m["b"].isupper() else None)) and free(m.start("a"), m.end("b")):
            out += [Entity(*m.span("a"), f"given_{sex}", fold(m["a"])), Entity(*m.span("b"), "family", fold(m["b"]))]
    people = [e for e in sorted(out) if e.kind == "family" or e.kind.startswith("given")]
    if not people:
        return sorted(out)
    told: dict[str, list[str]] = {}
    for e in people:
        if e.kind in ("given_f", "given_m"):
            told.setdefault(e.core, []).append(e.kind)
    names: dict[str, str] = {}
    for e in people:
        if e.kind == "given_n":
            listed = GIVEN.get(e.core.capitalize(), "n")
            names.setdefault(e.core, told.get(e.core, [f"given_{listed}"])[0])
        else:
            names.setdefault(e.core, e.kind)
    out = [e._replace(kind=names[e.core]) if e.kind == "given_n" and names[e.core] != "family" else e for e in out]
    out += [Entity(*m.span(), names[core], core) for m in WORD.finditer(text) if (core := fold(m[0])) in names and free(*m.span())]
    return sorted(out)


class Stream:
    """Numbers drawn from a key and a value by HMAC-SHA256."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def draw(self, below: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % below


def like(s: Stream, text: str, keep: int = 0) -> str:
    """Digits for digits, hexadecimal for hexadecimal runs, letters for letters of their case and script; marks stay."""
    hexa = re.fullmatch("(?=.*[a-f])[0-9a-f]{8,}", text) is not None
    out = []
    for i, c in enumerate(text):
        if i < keep or not c.isalnum():
            out.append(c)
        elif hexa:
            out.append("0123456789abcdef"[s.draw(16)])
        elif c.isdigit():
            out.append(str(s.draw(10)))
        else:
            base = {"Cyrillic": ("а", 32), "Greek": ("α", 17)}.get(script(c), ("a", 26))
            x = chr(ord(base[0]) + s.draw(base[1]))
            out.append(x.upper() if c.isupper() else x)
    return "".join(out)


def luhn(digits: str) -> int:
    """0 if the check digit, the last one, is right."""
    return sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)), 1)) % 10


def iban_ok(x: str) -> bool:
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


#: After so many attempts a format is taken as full, and the next wider one is used.
FULL = 24


def surrogate(key: bytes, kind: str, core: str, attempt: int) -> str:
    """The surrogate's core. The same key, kind, core and attempt give the same one.

    Attempts from FULL on leave the format for a wider one of the same type (a wider private range, more digits or
    letters), so that even where all values of a format are real ones a free surrogate is found.
    """
    s, wide = Stream(key, kind.split("_")[0], core, str(attempt)), attempt // FULL
    if kind == "email":
        local, _, host = core.partition("@")
        labels = host.split(".")
        if any(host == r or host.endswith(f".{r}") for r in RESERVED):
            keep = 2
        else:
            keep = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else 1
        site = Stream(key, "site", host, str(attempt // 4))
        return f"{like(s, local)}{more(s, wide)}@{'.'.join([like(site, x) for x in labels[:-keep]] + labels[-keep:])}"
    if kind == "ip":
        a = core.split(".")
        private = core.startswith(("192.168.", "169.254.")) or a[0] in ("10", "127") or (a[0] == "172" and 16 <= int(a[1]) <= 31)
        if wide > 1 and private:
            return "fd" + "%02x" % s.draw(256) + "".join(f":{s.draw(65536):x}" for _ in range(7))
        if wide and private:
            a, keep = ["10"], 1
        elif a[0] == "172" and private:
            a, keep = ["172", str(16 + s.draw(16))], 2
        else:
            keep = 2 if core.startswith(("192.168.", "169.254.")) else 1 if private else 0
        first = [*(x for x in range(1, 224) if x not in (10, 127, 169, 172, 192))]
        return ".".join(a[:keep] + [str(first[s.draw(len(first))]) if i == 0 else str(s.draw(256)) for i in range(keep, 4)])
    if kind == "ip6":
        head = 4 if core[:2].casefold() in ("fe", "fd", "fc") else 0
        return core[:head] + "".join(c if c == ":" else "0123456789abcdef"[s.draw(16)] for c in core[head:]) + "".join(f":{s.draw(65536):x}" for _ in range(wide))
    if kind == "card":
        body = like(s, core, 1) + more(s, wide, digits=True)
        return next(x for d in "0123456789" if luhn(x := body[:-1] + d) == 0) if luhn(core) == 0 else body
    if kind in ("family", "given_f", "given_m", "given_n"):
        syllables, endings = NAMES[script(core)]
        end = endings["s" if kind == "family" else kind[-1]]
        return "".join(syllables[s.draw(len(syllables))] for _ in range(2 + s.draw(2) + attempt // 4)) + end[s.draw(len(end))]
    if kind == "phone":
        return like(s, core, max(0, len(core) - 10)) + more(s, wide, digits=True)
    if kind == "key":
        return like(s, core, 4) + more(s, wide)
    if kind == "iban":
        body = like(s, core, 4) + more(s, wide, digits=True)
        return next(x for d in range(2, 99) if iban_ok(x := f"{body[:2]}{d:02d}{body[4:]}")) if iban_ok(core) else body
    return like(s, core) + more(s, wide, digits=kind != "secret")


def more(s: Stream, n: int, digits: bool = False) -> str:
    """n further characters."""
    return "".join(str(s.draw(10)) if digits else "abcdefghijklmnopqrstuvwxyz"[s.draw(26)] for _ in range(n))


def render(core: str, mention: str, kind: str) -> str:
    """A surrogate in a mention's form: its separators, its capitals."""
    if kind.startswith(("given", "family")):
        tail = regex.search("['’][sS]$", mention)
        shown = core.upper() if mention.isupper() and len(mention) > 1 else core[:1].upper() + core[1:]
        return shown + (tail[0] if tail else "")
    if kind in ("iban", "card", "ssn", "phone"):
        chars = iter(core)
        return "".join(next(chars) if c.isalnum() else c for c in mention) + "".join(chars)
    if kind == "email" and mention != mention.casefold():
        return core.upper() if mention.isupper() else core
    return core


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[Entity]]:
    found, out, at = detect(text), [], 0
    for e in found:
        out += [text[at : e.start], render(surrogate(key, e.kind, e.core, attempts.get((e.kind, e.core), 0)), text[e.start : e.end], e.kind)]
        at = e.end
    return "".join([*out, text[at:]]), found


def settle(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, core, attempt) of the entities whose first surrogate won't do.

    In each round the open entities' surrogates are compared with all real values of their family of kinds, with those
    already settled, and with each other; of equal ones the smallest entity's stays, the others draw anew. So different
    entities never share a surrogate, and no surrogate is anyone's real value. Formats that are full widen with the
    attempts (surrogate), so the rounds end.
    """

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, core, tries = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(key, *x) for x in zip(kind, core, tries, strict=True)], pa.string())], ["kind", "core", "attempt", "fake"])

    family = F.substring_index("kind", "_", 1)
    real = scratch.table(entities.select(family.alias("_f"), F.col("core").alias("_core")).distinct(), "real")
    now, settled, late, k = entities.select("kind", "core", F.lit(0).alias("attempt")), None, [], 0
    while True:
        offered = scratch.table(now.mapInArrow(offer, "kind string, core string, attempt int, fake string").withColumn("f", family), f"offer{k}")
        first = offered.groupBy("f", "fake").agg(F.min(F.struct("kind", "core")).alias("w")).select(F.col("f").alias("_wf"), F.col("fake").alias("_wfake"), F.col("w.kind").alias("_wk"), F.col("w.core").alias("_wc"))
        told = offered.join(first, (F.col("f") == F.col("_wf")) & (F.col("fake") == F.col("_wfake")))
        told = told.join(real, (F.col("f") == F.col("_f")) & (F.col("fake") == F.col("_core")), "left")
        good = (F.col("kind") == F.col("_wk")) & (F.col("core") == F.col("_wc")) & F.col("_core").isNull()
        if settled is not None:
            told = told.join(settled, (F.col("f") == F.col("_sf")) & (F.col("fake") == F.col("_sfake")), "left")
            good = good & F.col("_sf").isNull()
        told = scratch.table(told.select("kind", "core", "attempt", "fake", "f", good.alias("good")), f"told{k}")
        done = told.where("good")
        if k:
            late.append(done.select("kind", "core", "attempt"))
        new = done.select(F.col("f").alias("_sf"), F.col("fake").alias("_sfake"))
        settled = new if settled is None else settled.union(new)
        now = told.where("not good").select("kind", "core", (F.col("attempt") + 1).alias("attempt"))
        k += 1
        if now.isEmpty():
            break
    if not late:
        return now
    out = late[0]
    for x in late[1:]:
        out = out.union(x)
    return scratch.table(out, "late")


def protect(docs: DataFrame, spark: SparkSession, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with surrogates, n_entities, kinds (their different kinds, sorted).

    All mentions of an entity in all rows get one surrogate, different entities different ones, none equal to a real
    value. Null text stays null, with no entities; texts without entities are unchanged. Rows of equal id are judged each by its text.
    """
    scratch = Scratch(spark, "pii")
    own = F.xxhash64("text")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(k, e.kind, e.core) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if t.is_valid for e in detect(t.as_py())}
            k, kind, core = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, "i8"), pa.array(kind, pa.string()), pa.array(core, pa.string())], ["of", "kind", "core"])

    mentions = scratch.table(src.select(own, "text").mapInArrow(scan, "of long, kind string, core string"), "mentions")
    entities = scratch.table(mentions.select("kind", "core").distinct(), "entities")
    late = settle(entities, key, scratch).withColumnRenamed("kind", "_k").withColumnRenamed("core", "_c")
    odd = mentions.join(late, (F.col("kind") == F.col("_k")) & (F.col("core") == F.col("_c"))).select("of", F.struct("kind", "core", "attempt").alias("x")).distinct()
    odd = scratch.table(odd.groupBy("of").agg(F.collect_list("x").alias("odd")), "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, o in zip(b.column(1), b.column(2), strict=True):
                if not t.is_valid:
                    texts, counts, kinds = [*texts, None], [*counts, 0], [*kinds, ""]
                    continue
                new, found = replace(t.as_py(), key, {(x["kind"], x["core"]): x["attempt"] for x in o.as_py() or ()})
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(sorted({e.kind for e in found})))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, "i8"), pa.array(kinds, pa.string())], [id_col, "text", "n_entities", "kinds"])

    both = src.join(odd, own == F.col("of"), "left").select("id", "text", "odd")
    return both.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, text string, n_entities long, kinds string")
