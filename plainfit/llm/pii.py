"""Surrogates for personal data: keyed, type-consistent replacements that keep who is who apart.

``detect`` finds e-mail addresses, phone, card and social-security numbers, IBANs, IP addresses, secrets and named
persons.  Each entity's replacement is drawn from a keyed hash of its type and canonical form (without case), in its own
format: digits stay digits where they stood, letters keep script and case, checksums stay valid or invalid, names keep
gender, script and hyphens, and no part of an address is its own replacement.  So the same entity gets the same
replacement everywhere, however it is written, and nobody without the key can tell the original.

Drawing alone can give two entities one replacement, or hit a value that occurs in the texts.  So the distinct entities
of the corpus are gathered (as hashes), claims of all types are compared with each other and with the originals, and
those that lose draw again, round by round, until all are distinct and none equals an original.  Only entities that
drew again have to be looked up when texts are rewritten: these few are broadcast while they are at most
``MOST_BROADCAST``, and joined to their documents beyond.

Null and empty texts stay as they are, and an empty table gives an empty result.  Repeated rows get the same
replacements; further columns are kept, but for ``n_entities``.  Names count as persons after a title, or as a known
given name with a capitalised name behind it; given and family names found so are also replaced where they stand
alone in the same text.  A given name is one entity whatever title stands before it: it has the gender it is listed with, else that of
most titles before it in the corpus, else none.  Logins in addresses of sites (``//user:password@host``) and tokens of
known shapes are secrets; fixed beginnings of tokens stay.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_name, rows_of

MOST_BROADCAST, ROUNDS = 100_000, 64
#: Titles by gender (fixed values).
TITLES = {"f": "Mrs Ms Miss Madam Frau Mme Madame Mlle Señora Sra Doña Госпожа Κυρία".split(), "m": "Mr Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(), "n": "Dr Prof".split()}
#: Common given names by gender (fixed values).
GIVEN = {
    "f": "Mary Anna Emma Maria Sophie Laura Julia Sarah Elena Claire Carmen Lucia Lucía Ingrid Heidi Nicole Camille Alice Linda Susan Karen Olga Jennifer Elizabeth Barbara Jessica Margaret Helen Nancy Ursula Monika Sabine Petra Hannah Isabelle Chloé Amélie Pilar Dolores Анна Мария Елена Ольга Наталья Μαρία Ελένη".split(),
    "m": "John James Robert Michael David Thomas Peter Hans Klaus Jean Pierre Carlos Miguel Pablo William Richard George Frank Paul Daniel Martin Joseph Charles Christopher Matthew Andrew Steven Jürgen Wolfgang Stefan Günter François Jacques André José Javier Diego Luis Иван Пётр Сергей Дмитрий Γιώργος Νίκος".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
LISTED = {name.casefold(): g for name, g in GENDER.items()}
CAPITALS = "".join(c for c in map(chr, range(sys.maxunicode)) if c.isupper() or c.istitle())
_name = rf"[{CAPITALS}][^\W\d_]+(?:[-'’](?![sS](?!\w))[^\W\d_]+)*|[{CAPITALS}]['’][{CAPITALS}][^\W\d_]+"
NAME = re.compile(rf"(?<!\w)(?:{_name})(?!\w)")
PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(x for t in TITLES.values() for x in t)})\.?[ ]+(?:(?P<tgiven>{_name})[ ]+)?(?P<tfamily>{_name})|(?P<given>{'|'.join(GENDER)})[ ]+(?P<family>{_name}))(?!\w)")
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*([\"']?)([\w/+-]{12,})\1")
LOGIN = re.compile(r"(?<=://)([^\s/:@]+):([^\s/@]+)(?=@[\w.-])")
#: Fixed beginnings of tokens of common services and what follows them (fixed values).
TOKEN = re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA)([0-9A-Z]{16})|gh[opsur]_([0-9A-Za-z]{36,})|github_pat_(\w{22,})|glpat-([\w-]{20,})|xox[abprs]-([0-9A-Za-z-]{10,})|sk-([0-9A-Za-z_-]{20,})|AIza([\w-]{35})|eyJ([\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}))(?![\w-])")
MAYBE_TOKEN = re.compile("AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox|sk-|AIza|eyJ")
NUMBERS = [
    ("iban", re.compile(r"(?i)(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)")),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)")),
]
DIGIT, MAYBE_NAME = re.compile(r"\d"), re.compile(rf"(?<!\w)(?:{'|'.join(x for t in TITLES.values() for x in t)}|{'|'.join(GENDER)})(?!\w)")
#: Letters that new names are made of, by script: consonants, vowels, and endings by gender (fixed values).
SOUNDS = {
    "LATIN": ("b d f g k l m n p r s t v z".split(), "a e i o u".split(), {"f": ["a", "ina", "elle"], "m": ["o", "ert", "us"], "n": ["y", "en", "is"]}),
    "CYRILLIC": ("б в г д з к л м н п р с т".split(), "а е и о у".split(), {"f": ["а", "ина"], "m": ["ор", "ан"], "n": ["ий", "ен"]}),
    "GREEK": ("β γ δ θ κ λ μ ν π ρ σ τ".split(), "α ε ι ο υ".split(), {"f": ["α", "ίνα"], "m": ["ος", "ης"], "n": ["ι", "ω"]}),
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split()[0]
    return name if name in SOUNDS else "LATIN"


def groups_of(address: str) -> str:
    """The 32 hexadecimal digits of an IPv6 address, or none if it isn't one with digits in it, or has zeros alone."""
    try:
        digits = ipaddress.IPv6Address(address).exploded.replace(":", "") if DIGIT.search(address) else ""
    except ValueError:
        return ""
    return digits if digits.strip("0") else ""


def canonical_number(kind: str, written: str) -> str:
    """What a number is known by; nothing if it isn't one of its kind."""
    plain = re.sub(r"[^0-9A-Za-z]", "", written)
    if kind == "iban":
        return plain.upper() if mod97(plain) == 1 else ""
    if kind == "ip":
        return written if all(int(x) <= 255 for x in written.split(".")) else ""
    return groups_of(written) if kind == "ip6" else plain


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of the entities of a text, in order and without overlaps; earlier types first."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(0)

    def add(begin: int, end: int, kind: str, canonical: str) -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        if taken.find(1, begin, end) < 0:
            taken[begin:end] = b"\1" * (end - begin)
            found.append((begin, end, kind, canonical))

    if "://" in text and "@" in text:
        for m in LOGIN.finditer(text):
            for part in (1, 2):
                add(m.start(part), m.end(part), "secret", m[part])
    if MAYBE_TOKEN.search(text):
        for m in TOKEN.finditer(text):
            add(m.start(m.lastindex), m.end(m.lastindex), "secret", m[m.lastindex])
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m[0].lower())
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            add(m.start(2), m.end(2), "secret", m[2])
    if DIGIT.search(text):
        for kind, pattern in NUMBERS:
            for m in pattern.finditer(text):
                if canonical := canonical_number(kind, m[0]):
                    add(m.start(), m.end(), kind, canonical)
    if MAYBE_NAME.search(text):
        names: dict[str, str] = {}
        for m in PERSON.finditer(text):
            given, last = ("tgiven", "tfamily") if m["title"] else ("given", "family")
            listed = GENDER.get(m[given] or m[last])
            titled = next((g for g in "fm" if m["title"] in TITLES[g]), None)
            if m["title"] and not m[given] and listed:  # a title before a given name alone
                given = last
            if m[given]:
                kind = f"given-{titled or listed or 'n'}"  # which gender this place speaks for
                add(m.start(given), m.end(given), kind, m[given].casefold())
                names.setdefault(m[given].casefold(), kind)
            if given != last:
                add(m.start(last), m.end(last), "family", m[last].casefold())
                names[m[last].casefold()] = "family"
        for m in NAME.finditer(text) if names else ():
            if kind := names.get(m[0].casefold()):
                add(m.start(), m.end(), kind, m[0].casefold())
            elif "-" in m[0]:
                for part in re.finditer(r"[^-]+", m[0]):
                    if kind := names.get(part[0].casefold()):
                        add(m.start() + part.start(), m.start() + part.end(), kind, part[0].casefold())
    return sorted(found)


class Draw:
    """A stream of numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.seed = hashlib.blake2b("\0".join(what).encode(), key=key, digest_size=32).digest()
        self.pool, self.block = 0, 0
        self._more()

    def _more(self):
        self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.block.to_bytes(8), digest_size=64).digest())
        self.block += 1

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self._more()
        self.pool, x = divmod(self.pool, n)
        return x

    def of(self, options):
        return options[self.below(len(options))]


@lru_cache(4096)
def near(c: str) -> str:
    """The characters of one kind and script beside ``c``: of ASCII ones all 26 letters of a case, or all ten digits."""
    kind, first = unicodedata.category(c), ord(c) & ~63
    script_of = lambda x: unicodedata.name(x, "").split(" ")[0]
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and (c.isascii() or script_of(x) == script_of(c)))


def alike(draw: Draw, text: str, hexadecimal: bool = False) -> str:
    """Other digits for digits and other letters for letters of the same script and case; never ``text`` itself."""
    if not any(map(str.isalnum, text)):
        return "".join(draw.of("abcdefghijklmnopqrstuvwxyz") for _ in text)
    while True:
        out = []
        for c in text:
            if c.isalnum():
                c = draw.of([x for x in near(c) if x in "0123456789abcdefABCDEF"] if hexadecimal else near(c))
            out.append(c)
        if (new := "".join(out)).casefold() != text.casefold() or all(len(near(c)) < 2 for c in text if c.isalnum()):
            return new


def drawn_name(draw: Draw, kind: str, canonical: str, more: int) -> str:
    """A name of the same script with the same hyphens and apostrophes, in lower case; its end tells the gender."""
    parts = re.split(r"([-'’])", canonical)
    consonants, vowels, endings = SOUNDS[script(canonical)]
    for i, part in enumerate(parts):
        if len(part) == 1 and part.isalpha():
            parts[i] = draw.of(consonants)
        elif len(part) > 1:
            name = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(3 + more)) + draw.of(consonants)
            parts[i] = name + (draw.of(endings[kind[-1]]) if kind.startswith("given") else draw.of(vowels) + draw.of(consonants))
    return "".join(parts)


def surrogate(key: bytes, kind: str, canonical: str, turn: int = 0) -> str:
    """The replacement's canonical form that an entity draws in a round; from the eighth round it may grow.

    An address (``email``) draws what stands before the @; its ``host`` is an entity of its own.
    """
    draw = Draw(key, kind, canonical, str(turn))
    more = "".join(str(draw.below(10)) for _ in range(turn // 8))
    if kind == "email":
        return alike(draw, canonical.rpartition("@")[0]) + more
    if kind == "host":
        return "".join(draw.of("abcdefghijklmnopqrstuvwxyz") for _ in range(max(8, len(canonical.split(".")[0])) + turn // 8)) + ".example"
    if kind == "secret":
        return alike(draw, canonical, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical)))
    while True:
        if kind == "ip":
            new = ".".join(str(1 + draw.below(254)) for _ in range(4))
        elif kind == "ip6":  # groups of 0 stay, so that all ways to write an address stay ways to write one
            least = [16 ** min(3, len(g.lstrip("0")) - 1 + turn // 8) if g != "0000" else 0 for g in re.findall("....", canonical)]
            new = "".join(f"{n + draw.below(15 * n) if n else 0:04x}" for n in least)
        elif kind == "iban":
            body = alike(draw, canonical[4:])
            new = canonical[:2] + f"{98 - mod97(canonical[:2] + '00' + body):02d}" + body
        elif kind == "card":
            body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:-1])
            new = body + draw.of([c for c in "0123456789" if luhn(body + c) == luhn(canonical)])
        elif kind == "phone":  # the first digit stays: it tells trunk prefixes and the world's numbering zones
            new = canonical[0] + alike(draw, canonical[1:])
        elif kind == "ssn":
            new = alike(draw, canonical)
        else:
            new = drawn_name(draw, kind, canonical, turn // 8)
        if new != canonical:
            return new


def cased(original: str, new: str) -> str:
    """Upper case for upper case, a capital for a capital, part by part."""
    old, out = re.split(r"[-'’]", original), re.split(r"([-'’])", new)
    for i in range(0, len(out), 2):
        part = old[i // 2] if i // 2 < len(old) else old[-1]
        out[i] = out[i].upper() if part.isupper() and (len(part) > 1 or len(original) > 1) else out[i].capitalize() if part[:1].isupper() or part[:1].istitle() else out[i]
    return "".join(out)


def fitted(original: str, kind: str, replacement: str) -> str:
    """A replacement in the format of the place where it goes."""
    if kind == "email":
        if original.isupper():
            return replacement.upper()
        old, (local, _, host) = original.rpartition("@")[0], replacement.rpartition("@")
        return "".join(n.upper() if o.isupper() else n for o, n in zip(old.ljust(len(local)), local, strict=False)) + "@" + host
    if kind == "family" or kind.startswith("given"):
        return cased(original, replacement)
    if kind == "ip6":
        before, gap, after = original.partition("::")
        head, tail = before.split(":") if before else [], after.split(":") if after else []
        new = [replacement[i : i + 4] for i in range(0, 32, 4)]
        write = lambda old, group: (f"{int(group, 16):0{len(old)}x}" if old[:1] == "0" else f"{int(group, 16):x}")
        text = ":".join(map(write, head, new)) + gap + ":".join(map(write, tail, new[8 - len(tail) :]))
        return text.upper() if original.upper() == original else text
    if kind not in ("phone", "card", "ssn", "iban"):
        return replacement
    new = iter(replacement)
    return "".join(next(new).lower() if c.islower() else next(new) if c.isalnum() else c for c in original)


def form(kind: str, canonical: str) -> str:
    """What entities of all kinds are compared by; an address goes by its own part within its host."""
    return canonical.casefold()


def claimed(kind: str, canonical: str, new: str) -> str:
    return form(kind, f"{new}@{canonical.rpartition('@')[2]}" if kind == "email" else new)


def parts_of(kind: str, canonical: str) -> list[tuple[str, str]]:
    """The entities that draw for one that was detected."""
    if kind == "email":
        return [(kind, canonical), ("host", canonical.rpartition("@")[2])]
    return [("given" if kind.startswith("given") else kind, canonical)]


def listed_gender(canonical: str) -> str:
    """The gender of a given name on the list, else none."""
    return LISTED.get(canonical, "n")


def identity(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), signed=True)


def entities(docs: DataFrame, column: str = "text") -> DataFrame:
    """(kind, canonical, gender): the distinct entities of the corpus, given names with their gender.

    Each task sends what it has seen in a batch once, with the number of titles of either gender before it.
    """

    def run(batches):
        for batch in rows_of(batches, 2000):
            seen: dict[tuple[str, str], list[int]] = {}
            for text in batch.column(0).to_pylist():
                for *_, kind, canonical in detect(text) if text else ():
                    for part in parts_of(kind, canonical):
                        votes = seen.setdefault(part, [0, 0])
                        if part[0] == "given" and kind[-1] != "n":
                            votes["fm".index(kind[-1])] += 1
            parts, votes = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.string()), pa.array([c for _, c in parts], pa.string()), pa.array([f for f, _ in votes], pa.int64()), pa.array([m for _, m in votes], pa.int64())], names=["kind", "canonical", "f", "m"])

    counted = docs.select(F.col(column)).mapInArrow(run, "kind string, canonical string, f long, m long").groupBy("kind", "canonical").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    names = {g: F.col("canonical").isin([n for n, x in LISTED.items() if x == g]) for g in "fm"}
    gender = F.when(names["f"], "f").when(names["m"], "m").when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n")
    return counted.select("kind", "canonical", F.when(F.col("kind") == "given", gender).alias("gender"))


def redrawn(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """(kind, canonical, turn, gender) of the entities whose first draw collided, with the round whose draw is theirs, and of given names whose gender isn't that of the list."""
    known = materialise(entities(docs, column), "entities")

    def draw(batches):
        for batch in batches:
            rows = [(form(k, c), claimed(k, c, surrogate(key, k if g is None else f"{k}-{g}", c, t))) for k, c, g, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([identity(a) for a, _ in rows], pa.int64()), pa.array([identity(b) for _, b in rows], pa.int64())], names=["kind", "canonical", "gender", "turn", "own", "claim"])

    schema = "kind string, canonical string, gender string, turn int, own long, claim long"
    claims = materialise(known.withColumn("turn", F.lit(0)).mapInArrow(draw, schema), "claims")
    originals = claims.select(F.col("own").alias("claim")).distinct()
    settled, open_ = None, claims
    for turn in range(ROUNDS):
        first = open_.groupBy("claim").agg(F.min(F.struct("own", "kind", "canonical")).alias("winner"))
        judged = open_.join(first, "claim").join(originals.withColumn("real", F.lit(True)), "claim", "left")
        if settled is not None:
            judged = judged.join(settled.select("claim").distinct().withColumn("held", F.lit(True)), "claim", "left")
        else:
            judged = judged.withColumn("held", F.lit(None).cast("boolean"))
        wins = F.col("real").isNull() & F.col("held").isNull() & (F.struct("own", "kind", "canonical") == F.col("winner"))
        judged = materialise(judged.select("kind", "canonical", "gender", "turn", "own", "claim", wins.alias("wins")), "judged")
        won = judged.filter("wins").drop("wins")
        settled = won if settled is None else settled.unionByName(won)
        lost = judged.filter("not wins")
        if not lost.limit(1).count():
            learned = (F.col("gender") != "n") & ~F.col("canonical").isin(list(LISTED))
            return settled.filter((F.col("turn") > 0) | learned).select("kind", "canonical", "turn", "gender")
        open_ = materialise(lost.select("kind", "canonical", "gender", (F.col("turn") + 1).alias("turn")).mapInArrow(draw, schema), "claims")
    raise RuntimeError("more entities of a format than replacements")


def replacement(key: bytes, part: tuple[str, str], again: dict[tuple[str, str], tuple[int, str | None]]) -> str:
    """What a part of an entity is replaced by; ``again`` has the turn and gender of those that ``redrawn`` gives."""
    kind, canonical = part
    turn, gender = again.get(part, (0, listed_gender(canonical)))
    return surrogate(key, f"given-{gender}" if kind == "given" else kind, canonical, turn)


def rewritten(text: str, key: bytes, again: dict[tuple[str, str], tuple[int, str | None]]) -> tuple[str, int]:
    found, out, at = detect(text), [], 0
    for begin, end, kind, canonical in found:
        new = "@".join(replacement(key, part, again) for part in parts_of(kind, canonical))
        out += [text[at:begin], fitted(text[begin:end], kind, new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def replace_pii(docs: DataFrame, key: bytes, column: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with the entities of ``column`` replaced, and ``n_entities``, how many there were in each text."""
    spark = docs.sparkSession
    again = materialise(redrawn(docs, key, column), "redrawn")
    keep = [c for c in docs.columns if c != "n_entities"]
    at = keep.index(column)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_entities", T.LongType())])
    few = again.limit(most_broadcast + 1).count() <= most_broadcast
    if few:
        turns = spark.sparkContext.broadcast({(r.kind, r.canonical): (r.turn, r.gender) for r in again.collect()})
        source, width = docs.select(*(F.col(f"`{c}`") for c in keep)), len(keep)
    else:
        hash_, turns_ = new_name(docs, "text_hash"), new_name(docs, "turns")
        # Each text's own entities that drew again come to it by a hash of the text.
        def mentions(batches):
            for batch in rows_of(batches, 2000):
                rows = [(identity(x), *part) for x in batch.column(0).to_pylist() if x for part in {p for e in detect(x) for p in parts_of(*e[2:])}]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string()], strict=True)], names=[hash_, "kind", "canonical"])

        named = docs.select(F.col(column)).mapInArrow(mentions, f"{hash_} long, kind string, canonical string").distinct().join(again, ["kind", "canonical"])
        per_text = named.groupBy(hash_).agg(F.collect_list(F.struct("kind", "canonical", "turn", "gender")).alias(turns_))  # no more than one text mentions

        def hashed(batches):
            for batch in rows_of(batches, 2000):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([identity(x or "") for x in batch.column(at).to_pylist()], pa.int64())], names=[*keep, hash_])

        with_hash = docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(hashed, T.StructType([*(docs.schema[c] for c in keep), T.StructField(hash_, T.LongType())]))
        source, width, turns = with_hash.join(per_text, hash_, "left").select(*(F.col(f"`{c}`") for c in keep), turns_), len(keep) + 1, None

    def run(batches):
        for batch in rows_of(batches, 1000):
            out, counts = [], []
            own = batch.column(width - 1).to_pylist() if turns is None else None
            for i, text in enumerate(batch.column(at).to_pylist()):
                lookup = turns.value if turns is not None else {(t["kind"], t["canonical"]): (t["turn"], t["gender"]) for t in own[i] or []}
                new, n = rewritten(text, key, lookup) if text else (text, 0)
                out.append(new)
                counts.append(n)
            columns = list(batch.columns[: len(keep)])
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*keep, "n_entities"])

    return source.mapInArrow(run, schema)
