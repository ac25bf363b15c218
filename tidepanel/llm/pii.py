"""Surrogates for personal data: every entity gets one keyed replacement of its own type, gender, script and format."""
from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, keep, table

KEY = "change me"
#: What each kind of entity looks like. Earlier kinds win where two overlap at one place.
KINDS = {
    # a local part has at most 64 characters and begins where a run begins, so a long run is looked at once
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b|(?<![0-9A-Fa-f])[0-9A-Fa-f]{40}(?![0-9A-Fa-f])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)",
}
#: Given names and family names by script; the first list of given names is female, the second male.
NAMES = {
    "latin": (["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Marie", "Nora", "Paula", "Sofia", "Vera", "Zoe"],
              ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Max", "Oscar", "Paul", "Simon"],
              ["Albers", "Brandt", "Carver", "Dumont", "Ellis", "Ferrer", "Garland", "Hansen", "Iver", "Keller", "Lorenz", "Moreau", "Norden", "Ortega", "Perrin", "Quint"]),
    "cyrillic": (["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга", "София", "Юлия"], ["Алексей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
                 ["Беленко", "Гончар", "Коваленко", "Лысенко", "Мельник", "Петренко", "Романюк", "Шевчук"]),
}
#: Titles that introduce a person, by gender; x stands for either.
HONORIFIC = {"Mrs": "f", "Ms": "f", "Miss": "f", "Mme": "f", "Mlle": "f", "Madame": "f", "Frau": "f", "Señora": "f", "Sra": "f", "госпожа": "f", "Госпожа": "f",
             "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "господин": "m", "Господин": "m", "Dr": "x", "Prof": "x"}


HEX = re.compile(r"[0-9A-Fa-f]{40}")
FOUND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
#: What stands before a secret, whatever its case.
SECRET_WORDS = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|auth)[ _-]?key)"
#: a secret is what follows such a word and a sign, with blanks and quotes or without
KEYED = re.compile(SECRET_WORDS + r"""["']?[ \t]*[:=][ \t]*(?:"([^"\n]+)"(?=[^\w\s]*(?:\s|$))|'([^'\n]+)'(?=[^\w\s]*(?:\s|$))|(\S+))""")
TITLE = "(?:" + "|".join(sorted(HONORIFIC, key=len, reverse=True)) + ")"
#: persons are found by a title, the last of several, which gives the gender
TITLED = re.compile(rf"\b(?:{TITLE}\.? )*({TITLE})\.? (?!{TITLE}\b)([^\W\d_]\w+(?: [^\W\d_]\w+)?)")
#: a text without any of these holds none of the entities, so the slower patterns need not look
HINT = re.compile(r"[@\d]|AKIA|gh[pousr]_|sk-|" + SECRET_WORDS + rf"|\b{TITLE}\b")


def canonical(kind: str, raw: str) -> str:
    """What two spellings of one entity have in common."""
    if kind == "email":
        return raw.lower()
    if kind in ("card", "phone", "iban", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", raw)
    return raw.lower() if HEX.fullmatch(raw) else raw


def _keyed(t: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found and the secrets behind a word such as password. An entity that begins with such a value, or goes on behind it, stays."""
    for m in KEYED.finditer(t):
        start, stop = m.span(m.lastindex)
        over = [e for e in found if e[0] < stop and start < e[1]]
        if any(not re.search(r"\w", t[start:max(start, e[0])] + t[min(stop, e[1]):stop]) for e in over):      # but for signs, an entity already
            continue
        stay = [e for e in over if e[0] < start or e[1] > stop]
        start = max([start, *(e[1] for e in stay if e[0] <= start)])
        stop = min([stop, *(e[0] for e in stay if e[0] > start)])
        if start < stop:
            found = [e for e in found if e not in over or e in stay] + [(start, stop, "secret", canonical("secret", t[start:stop]))]
    return found


def _persons(t: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Given and family names behind titles and every other mention of them in the text, as they stand or in capitals."""
    taken, names = sorted(found), {}
    starts = [e[0] for e in taken]

    def free(start: int, stop: int) -> bool:
        k = bisect.bisect_left(starts, stop)
        return k == 0 or taken[k - 1][1] <= start

    for m in TITLED.finditer(t):
        words = m.group(2).split()
        if not words[0][0].isupper():
            continue
        if len(words) > 1 and words[1][0].isupper():
            names.setdefault(words[0], f"given_{HONORIFIC[m.group(1)]}")
            names[words[1]] = "family"
        else:
            names[words[0]] = "family"
    if not names:
        return found
    loud = {n.upper(): n for n in sorted(names)} | {n: n for n in names}
    some = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(loud, key=lambda n: (-len(n), n)))) + r")(?!\w)")
    return found + [(m.start(), m.end(), names[loud[m.group()]], loud[m.group()]) for m in some.finditer(t) if free(m.start(), m.end())]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, canonical form), ascending and apart. A person is a title's given and family name, each an entity of its own, and
    so is every later or earlier mention of either in the same text. Cards must have a valid check digit."""
    t = text or ""
    if not HINT.search(t):
        return []
    out = [(m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m.group())) for m in FOUND.finditer(t)]
    out = [e for e in out if e[2] != "card" or luhn(e[3][:-1]) == e[3][-1]]
    return sorted(_persons(t, _keyed(t, out)))


class _Stream:
    """Numbers below a bound from a keyed hash of the entity and the attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        self.seed, self.n, self.bits = hmac.new(key.encode(), f"{kind}\x00{value}\x00{attempt}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bits) < 4:
            self.bits += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.bits = int.from_bytes(self.bits[:4], "big"), self.bits[4:]
        return x * n >> 32

    def like(self, c: str) -> str:
        if "0" <= c <= "9":
            return chr(48 + self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        return c

    def more(self, attempt: int) -> str:
        """Letters that make later draws longer, so that short values do not run out of free ones."""
        return "".join(self.like("a") for _ in range(attempt // 2))


def luhn(digits: str) -> str:
    """The check digit that completes a card number."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    """The two digits that make an account number valid: 98 less the rest of its number modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def surrogate(kind: str, value: str, attempt: int = 0, key: str = KEY) -> str:
    """The replacement's canonical form: a function of key, kind, value and attempt. Digits, cases and lengths are kept; mail goes to
    example.org, addresses to any of their form, cards keep their first digit and a valid check digit, account numbers get valid ones.
    Values that collide time and again become longer, so that no space of values is ever full."""
    s = _Stream(key, kind, value, attempt)
    longer = "".join(s.like("0") for _ in range(attempt // 8))
    if kind == "email":
        local, host = value.rsplit("@", 1)
        return "".join(map(s.like, local)) + s.more(attempt) + "@" + "".join(map(s.like, host.rsplit(".", 1)[0].split(".")[0])) + ".example.org"
    if kind == "ip":
        return ".".join(str(x) for x in (1 + s.below(223), s.below(256), s.below(256), s.below(256))) + (f"%{longer}" if longer else "")
    if kind == "card":
        body = value[0] + "".join(map(s.like, value[1:-1])) + longer
        return body + luhn(body)
    if kind == "iban":
        body = "".join(map(s.like, value[4:])) + longer
        return value[:2] + iban_check(value[:2], body) + body
    if kind == "phone":
        lead = len(value) - 10 if value.startswith("+") and len(value) > 10 else value.startswith("+")
        return value[:lead] + "".join(map(s.like, value[lead:])) + longer
    if kind == "secret":
        lead = next((len(p) for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if value.startswith(p)), 0)
        hexa = not lead and re.fullmatch(r"[0-9a-f]+", value)
        signs = not any(c.isalnum() for c in value[lead:])      # nothing but signs: letters, as signs alone would stay as they are
        like = lambda c: "0123456789abcdef"[s.below(16)] if hexa else s.like("a" if signs or not c.isascii() else c)
        return value[:lead] + "".join(map(like, value[lead:])) + s.more(attempt)
    if kind == "family" or kind.startswith("given"):
        women, men, family = NAMES["cyrillic" if re.search(r"[\u0400-\u04ff]", value) else "latin"]
        pool = family if kind == "family" else {"f": women, "m": men}.get(kind[-1], women + men)
        name = pool[s.below(len(pool))]
        for _ in range(attempt // 2):       # few names collide often: later draws are longer, so there are always enough
            name += pool[s.below(len(pool))].lower()
        return name
    return "".join(map(s.like, value)) + longer


def dressed(raw: str, kind: str, new: str) -> str:
    """The replacement in the spelling of the place: its separators and, for mail, names and hexadecimal secrets, its case."""
    if kind in ("card", "phone", "iban", "ssn"):
        chars = iter(new)
        return "".join(next(chars, "") if re.match(r"[0-9A-Za-z+]", c) else c for c in raw) + "".join(chars)
    loud = kind == "email" or HEX.fullmatch(raw) or (kind == "family" or kind.startswith("given")) and len(raw) > 1
    return new.upper() if raw.isupper() and loud else new


def register(docs: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, attempt, surrogate: one row for each distinct entity of docs.

    Every round compares all surrogates of a kind with each other and with all real values: of entities that share one the least keeps
    it, and one that equals a real value goes; the others draw again. Entities are grouped before anything is compared, so a value that
    a third of the rows mention counts once.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sorted({(k, v) for t in b.column(0) for _, _, k, v in entities(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=["kind", "value"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, v, a, key) for k, v, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    real = keep(docs.select(F.col("text").cast("string")).mapInArrow(find, "kind string, value string").distinct())
    now = keep(real.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(draw, schema))
    names = real.select(F.split("kind", "_")[0].alias("k"), F.col("value").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    while True:
        same = Window.partitionBy("k", "surrogate").orderBy("attempt", "value", "kind")
        marked = now.withColumn("k", F.split("kind", "_")[0]).withColumn("r", F.row_number().over(same)).join(names, ["k", "surrogate"], "left")
        marked = cut(marked.select("kind", "value", "attempt", "surrogate", ((F.col("r") > 1) | F.col("taken")).alias("again")).withColumn("again", F.coalesce("again", F.lit(False))))
        if marked.where("again").isEmpty():
            return marked.drop("again")
        anew = marked.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        now = marked.where("not again").drop("again").unionByName(anew)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_entities, kinds of every row, entities replaced by their surrogates.

    One entity has one surrogate in all texts and spellings; different entities have different ones, and none equals a real value.
    A surrogate follows from the key and the entity alone unless it collided; only those that drew again are sent along, joined to
    the documents that mention them. Null texts stay null; empty texts have no entity; repeated rows stay.
    """
    again = keep(register(docs, key).where("attempt > 0").select("kind", "value", "attempt"))
    few = again.limit(SPECIAL + 1).count() <= SPECIAL
    special = {(r["kind"], r["value"]): r["attempt"] for r in again.collect()} if few else None

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, kinds = [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                known = special if few else {(x["kind"], x["value"]): x["attempt"] for x in b.column(2)[i].as_py() or []}
                found, at, parts = entities(t), 0, []
                for start, stop, kind, value in found:
                    parts += [t[at:start], dressed(t[start:stop], kind, surrogate(kind, value, known.get((kind, value), 0), key))]
                    at = stop
                texts.append(None if t is None else "".join(parts) + t[at:])
                n.append(len(found))
                kinds.append(sorted({k for _, _, k, _ in found}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_entities", "kinds"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if not few:      # more redrawn entities than the bound: each document gets those it mentions
        def mention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(m, *e) for m, t in zip(b.column(0).to_pylist(), b.column(1)) for e in sorted({(k, v) for _, _, k, v in entities(t.as_py())})]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[j] for g in got], pa.string()) for j in (1, 2))], names=["mark", "kind", "value"])

        own = rows.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(mention, "mark bigint, kind string, value string").distinct()
        own = own.join(again, ["kind", "value"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("special"))
        rows = rows.withColumn("mark", F.xxhash64("text")).join(own, "mark", "left").select("doc_id", "text", "special")
    return rows.mapInArrow(swap, "doc_id bigint, text string, n_entities int, kinds array<string>")


#: redrawn entities that are sent to all tasks; more are joined to the documents
SPECIAL = 50_000


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"))
