"""Personal data replaced by keyed surrogates.

Every detected entity gets a replacement of its own type that keeps script,
gender and format: letters stay letters (vowels vowels), digits digits,
separators and case stay, card numbers keep their checksum, address octets
stay octets, names keep title, gender and alphabet.  A replacement depends on
key, type and normal form alone, so one entity has one replacement in the
whole corpus however it is written (coreference).  Each word of a name is an
entity, folded in case, so a name is told by its words with and without title
or first name; its gender is that of its titles in the corpus, if these agree.
A name's words are replaced wherever its document repeats them, but for those
that are plain words too (PLAIN_WORDS), which need a title or the rest of the
name beside them.  A phone
number is told by its digits without the country code.  The table of all distinct
entities is then checked for collisions: two entities with one replacement, or
a replacement that is itself an entity of the corpus.  All but the least
entity of a collision draw again, until none is left (distinctness).  What
still collides after max_draws draws has a wider format: addresses octets of
any width, names more syllables, all others one more character a draw.

Entities are gathered, checked and joined back as tables; a row's text is
moved only if it holds an entity, and an entity that very many rows hold is a
skewed join key like any other.

Defined results: null or empty text stays as it is; repeated rows are each
rewritten alike; null ids don't matter; ties: of entities that draw the same
replacement the one with fewer draws, then the lesser, keeps it; very long
texts: whole; an empty table gives an empty result; all other columns are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, saved, table, texts_of, tidy, with_columns

#: Setting with the key of the query and the pipeline, and what they take where it is unset: a published value that hides nothing.
KEY_SETTING, TEST_KEY = "spark.postura.surrogateKey", "a test key, not a secret"
MAX_DRAWS = 64

# Titles and their gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
#: Names that are plain words as well: where one stands alone it is taken as the word, not as the person named before.
PLAIN_WORDS = frozenset(
    "april art august autumn bill black bond brook brown carol chance chase christian cliff dawn day dean dick drew earl faith fall frank gene glen grace grant gray green hall harmony heath heather "
    "holly hope iris ivy jack jasmine jay jean jewel joy june king lance lane lee lily long love mark marina mason max may melody miles misty olive page pat pearl penny pierce price prince ray reed "
    "rich river rob robin rock rose ruby rusty sky skip star stone storm summer sunny terry tom trent victor violet wade ward white will winter wood young".split()
)
_WORD = r"[^\W\d_]"
_NAME = re.compile(rf"\b({'|'.join(TITLES)})\.?\s+((?:[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]{_WORD}+(?:[-'’]{_WORD}+)?)(?:[ ][A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]{_WORD}+(?:[-'’]{_WORD}+)?){{0,2}})")
#: (type, pattern, group with the entity), in order of precedence.
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+%-]*[\w+%-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.A), 0),
    ("email", re.compile(r"(?<![\w.+-])[^\W_](?:[\w.+%-]*[\w+%-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}"), 0),
    ("secret", re.compile(r"(?i)\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|secret[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{8,})"), 1),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,128})\b"), 0),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d)"), 0),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), 0),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])"), 0),
    ("phone", re.compile(r"(?<![\w.])\+\d{8,15}(?!\w)"), 0),
)
_DIGIT = re.compile(r"\d")
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxz"
#: Fixed values: (consonants, vowels, male endings, female endings) of an alphabet.
ALPHABETS = {
    "LATIN": ("bdfgklmnprstv", "aeiou", ("an", "er", "is", "ol"), ("a", "ia", "ina", "elle")),
    "CYRILLIC": ("бвгдклмнпрст", "аеиоу", ("ан", "ор", "ев", "ий"), ("а", "ия", "ина", "ева")),
    "GREEK": ("βγδκλμνπρστ", "αειου", ("ος", "ης", "ας", "ων"), ("α", "η", "ια", "ινα")),
}


def luhn(digits: str) -> int:
    """Sum that is 0 modulo 10 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits)))


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    digits, mail = bool(_DIGIT.search(text)), "@" in text
    for kind, pattern, group in PATTERNS:
        if not (mail if kind == "email" else digits or kind == "secret"):
            continue
        for m in pattern.finditer(text):
            found.append((m.start(group), m.end(group), kind, m.group(group)))
    for m in _NAME.finditer(text):
        found.append((m.start(2), m.end(2), f"name:{TITLES[m.group(1)]}", m.group(2)))
    out = []
    rank = {k: n for n, (k, _, _) in reversed(list(enumerate(PATTERNS)))}
    taken = bytearray(len(text) if found else 0)  # a mark a character
    for a, b, kind, surface in sorted(found, key=lambda x: (rank.get(x[2], 99), x[0])):
        if taken.find(1, a, b) >= 0:
            continue
        form = normal(kind, surface)
        if form is not None:
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind, form))
    return sorted(out)


def normal(kind: str, surface: str) -> str | None:
    """One form for all spellings of an entity; None if it is none after all."""
    digits = "".join(c for c in surface if "0" <= c <= "9")
    if kind == "card":
        return digits if len(digits) == 16 or luhn(digits) % 10 == 0 else None
    if kind == "phone" and 7 <= len(digits) <= 15:
        return digits[_country(surface, digits) :]
    if kind in ("phone", "ssn"):
        return digits if 7 <= len(digits) <= 15 else None
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "email":
        return surface.lower()
    if kind.startswith("name"):
        return " ".join(surface.split())
    return surface


_COUNTRY = re.compile(r"\+(\d{1,3})[ .(-]")


def _country(surface: str, digits: str) -> int:
    """Digits of a phone number's country code, where it is set off or that of North America."""
    if m := _COUNTRY.match(surface):
        n = sum("0" <= c <= "9" for c in m.group(1))
        return n if len(digits) - n >= 7 else 0
    return int(surface[:2] == "+1" and len(digits) == 11)


#: A run of letters with nothing of a word before it, and the same with one more run behind a hyphen or apostrophe.
_RUN = re.compile(rf"(?<![\w-])(?=({_WORD}+)({_WORD}*[-'’]{_WORD}+)?)")
_GOES_ON = re.compile(r"\w|-\w")


def name_words(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str, bool]]:
    """The entities with each word of a name by itself, also where it is repeated; the last value tells the first word of each."""
    out = [(*e, True) for e in found if not e[2].startswith("name")]
    words: dict[str, str] = {}
    for a, b, kind, _ in found:
        if kind.startswith("name"):
            for m in re.finditer(r"\S+", text[a:b]):
                out.append((a + m.start(), a + m.end(), kind, m.group().casefold(), not m.start()))
                words[m.group()] = words[m.group().upper()] = words[m.group().capitalize()] = kind
    if not words:
        return sorted(out)
    taken = bytearray(len(text))
    for a, b, *_ in out:
        taken[a:b] = b"\x01" * (b - a)
    again = []
    for m in _RUN.finditer(text):
        for end in (m.end(2), m.end(1)):  # with what follows a hyphen or apostrophe, or without
            word = text[m.start() : end] if end > 0 else ""
            if word in words and not _GOES_ON.match(text, end) and taken.find(1, m.start(), end) < 0:
                taken[m.start() : end] = b"\x01" * (end - m.start())
                again.append((m.start(), end, words[word], word.casefold()))
                break
    # a plain word is a name where a word that is none stands beside it
    sure = [(a, b) for a, b, _, form in again if form not in PLAIN_WORDS] + [(a, b) for a, b, kind, *_ in out if kind.startswith("name")]
    after, before = {b + 1 for _, b in sure}, {a - 1 for a, _ in sure}
    beside = lambda a, b: (a in after and text[a - 1] == " ") or (b in before and text[b] == " ")
    again = [x for x in again if x[3] not in PLAIN_WORDS or beside(x[0], x[1])]
    ends = {b for _, b, kind, *_ in out if kind.startswith("name")}
    for a, b, kind, form in again:
        out.append((a, b, kind, form, not (a and text[a - 1] == " " and a - 1 in ends)))
        ends.add(b)
    return sorted(out)


class _Draws:
    """A stream of numbers from key, type, form and draw."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.pool = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), digest_size=64).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def of(self, letters: str) -> str:
        return letters[self.below(len(letters))]


def _alphabet(text: str) -> str:
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "LATIN").split()[0]
            return name if name in ALPHABETS else "LATIN"
    return "LATIN"


def surrogate(key: bytes, kind: str, form: str, draw: int = 0, wider: int = 0) -> str:
    """Replacement of a normal form; as long as it, but for names and wider formats."""
    r = _Draws(key, kind, form, str(draw))
    if kind.startswith("name"):
        consonants, vowels, male, female = ALPHABETS[_alphabet(form)]
        ends = {"m": male, "f": female}.get(kind[-1], male + female)
        words = []
        for k, _ in enumerate(form.split()):
            body = "".join(r.of(consonants) + r.of(vowels) for _ in range(1 + wider + r.below(2))) + r.of(consonants)
            words.append((body + ends[r.below(len(ends))]).capitalize())
        return " ".join(words)
    if kind == "ip" and wider:
        return ".".join(str(r.below(256)) for _ in range(4 + wider // 64))
    if kind == "ip":
        return ".".join(str({1: r.below(10), 2: 10 + r.below(90), 3: 100 + r.below(156)}[len(o)]) for o in form.split("."))
    kept = 0  # what tells the format: issuer, country
    if kind == "card":
        kept = 1
    elif kind == "iban":
        kept = 2
    elif kind == "secret" and (m := re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-", form)):
        kept = m.end()
    hexadecimal = kind == "secret" and re.fullmatch(r"[0-9a-f]+", form)
    last = form.rfind(".") if kind == "email" else len(form)
    out = []
    for i, c in enumerate(form):
        if i < kept or i >= last:
            out.append(c)
        elif hexadecimal:
            out.append(r.of("0123456789abcdef"))
        elif "0" <= c <= "9":
            out.append(r.of("0123456789"))
        elif c.isalpha():
            consonants, vowels = (_CONSONANTS, _VOWELS) if _alphabet(c) == "LATIN" else ALPHABETS[_alphabet(c)][:2]
            n = r.of(vowels if unicodedata.normalize("NFD", c)[0].lower() in vowels else consonants)
            out.append(n.upper() if c.isupper() else n)
        else:
            out.append(c)
    if kind == "email":
        out[:0] = [r.of(_CONSONANTS) for _ in range(wider)]
    else:
        out += [r.of("0123456789") for _ in range(wider)]
    if kind == "card" and luhn(form) % 10 == 0:
        out[-1] = "0"
        out[-1] = str(-luhn("".join(out)) % 10)
    return "".join(out)


def render(surface: str, kind: str, form: str, replacement: str) -> str:
    """The replacement in the separators and case of a surface."""
    if kind.startswith("name"):
        return replacement.upper() if surface.isupper() else replacement
    if kind == "ip":
        return replacement
    if kind == "phone":  # the country code stays
        skip = sum("0" <= c <= "9" for c in surface) - len(form)
        at = next(k for k in range(len(surface) + 1) if sum("0" <= c <= "9" for c in surface[:k]) == skip)
        if skip > 0:
            return surface[:at] + render(surface[at:], kind, form, replacement)
    letters = iter(replacement if len(form) == len(surface) else [c for c in replacement if c.isalnum()])
    out = []
    for c in surface:
        if len(form) != len(surface) and not c.isalnum():
            out.append(c)
        else:
            n = next(letters, c)
            out.append(n.upper() if c.isupper() else n)
    return "".join([*out, *letters])


_FOUND = "array<struct<start:int,end:int,kind:string,form:string,first:boolean>>"


def tagged(docs: DataFrame, text_col: str = "text", found_col: str = "_pii_found") -> DataFrame:
    """docs with found_col, their entities."""
    schema = StructType([*docs.schema.fields, StructType.fromDDL(f"x {_FOUND}")[0]])
    schema[-1].name = found_col
    schema.names[-1] = found_col
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string()), ("first", pa.bool_())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "form", "first")
        for batch in batches:
            found = [name_words(t, detect(t)) if t else [] for t in texts_of(batch, text_col)]
            yield with_columns(batch, {found_col: pa.array([[dict(zip(names, e)) for e in x] for x in found], kind)})

    return docs.mapInArrow(tidy(tag), schema)


def assignments(entities: DataFrame, key: bytes, max_draws: int = MAX_DRAWS) -> DataFrame:
    """(kind, form, replacement) of distinct (kind, form), free of collisions."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(replacement=[surrogate(key, k, f, n, max(0, n + 1 - max_draws)) for k, f, n in zip(pdf["kind"], pdf["form"], pdf["draw"])])

    shape = "kind string, form string, draw int, replacement string"
    drawn = saved(entities.select("kind", "form", F.lit(0).alias("draw")).mapInPandas(draw, shape), "surrogates")
    while True:  # ends, as every further draw has a wider format
        # a replacement that is an entity itself, or that a lesser entity has too
        taken = drawn.select(F.substring_index("kind", ":", 1).alias("type"), F.when(F.col("kind").startswith("name"), F.initcap("form")).otherwise(F.col("form")).alias("replacement")).distinct().withColumn("real", F.lit(True))
        typed = drawn.withColumn("type", F.substring_index("kind", ":", 1))
        least = typed.groupBy("type", "replacement").agg(F.min(F.struct("draw", "kind", "form")).alias("first"), F.count("*").alias("n"))
        checked = least.join(taken, ["type", "replacement"], "left").filter((F.col("n") > 1) | F.col("real"))
        again = typed.join(checked, ["type", "replacement"]).filter(F.col("real") | (F.struct("draw", "kind", "form") != F.col("first"))).select("kind", "form")
        again = saved(again, "collisions")
        if again.isEmpty():
            return drawn.select("kind", "form", "replacement")
        fresh = drawn.join(again, ["kind", "form"], "left_semi").withColumn("draw", F.col("draw") + 1).select("kind", "form", "draw").mapInPandas(draw, shape)
        drawn = saved(drawn.join(again, ["kind", "form"], "left_anti").unionByName(fresh), "surrogates")


def resolved(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, replacement) of distinct (kind, form), the same for all kinds of a name."""
    entities = saved(entities, "entities").withColumn("type", F.substring_index("kind", ":", 1))
    titled = F.collect_set(F.when(F.col("kind").isin("name:m", "name:f"), F.col("kind")))
    one = entities.groupBy("type", "form").agg(titled.alias("titled"))
    one = one.select("form", F.when(F.size("titled") == 1, F.col("titled")[0]).when(F.col("type") == "name", "name:n").otherwise(F.col("type")).alias("kind"))
    given = assignments(one, key).select(F.substring_index("kind", ":", 1).alias("type"), "form", "replacement")
    return entities.join(given, ["type", "form"]).select("kind", "form", "replacement")


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every entity replaced; count_col, if given, gets their number.  key: a secret of the caller's."""
    row, found, swaps_col = (fresh(docs, c) for c in ("_pii_row", "_pii_found", "_pii_swaps"))
    rows = saved(tagged(docs.withColumn(row, F.monotonically_increasing_id()), text_col, found), "tagged")
    some = rows.filter(F.size(found) > 0)
    held = some.select(F.col(row).alias("row"), F.explode(found).alias("e")).select("row", "e.start", "e.end", "e.kind", "e.form")
    mapping = resolved(held.select("kind", "form").distinct(), key)
    swaps = held.join(mapping, ["kind", "form"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "form", "replacement"))).alias(swaps_col))

    columns = rows.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(texts_of(batch, text_col), texts_of(batch, swaps_col)):
                out, end = [], 0
                for s in own:
                    out += [text[end : s["start"]], render(text[s["start"] : s["end"]], s["kind"], s["form"], s["replacement"])]
                    end = s["end"]
                texts.append("".join([*out, text[end:]]))
            kind = batch.schema.field(text_col).type
            yield with_columns(batch, {text_col: pa.array(texts, kind)}).select(columns)

    changed = some.join(swaps.withColumnRenamed("row", row), row).select(*rows.columns, swaps_col).mapInArrow(tidy(rewrite), rows.schema)
    whole = rows.filter(F.size(found) == 0).unionByName(changed)
    if count_col:
        return whole.select(*docs.columns, F.size(F.filter(found, lambda e: e["first"])).cast("long").alias(count_col))
    return whole.select(*docs.columns)


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's KEY_SETTING."""
    return spark.conf.get(KEY_SETTING, TEST_KEY).encode()


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, session_key(spark), count_col="n_entities")
