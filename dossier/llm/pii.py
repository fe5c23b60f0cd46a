"""Keyed surrogates for personal data: same kind, script, gender and format, distinct and coreferent."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

# fixed values: the shapes of what is replaced, and titles by gender
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\bgh[a-z]_[A-Za-z0-9]{16,}|\bgithub_pat_\w{16,}|\bsk-[\w\-]{16,}|\bxox[a-z]-[\w\-]{8,}|\bAIza[\w\-]{30,}|\beyJ[\w\-]+\.[\w\-]+\.[\w\-]*"
    r"|(?<=\b[Bb]earer )(?=\S*\d|\S{20})[A-Za-z0-9._~+/=\-]{8,}",
    "assigned": r"(?i:(?:api|access|secret|private|auth|client|signing|encryption)[_\- ]?key|secret|token|passw(?:or)?d|passphrase|pwd)\w*[\"']?[ \t]*(?:=>|:=|:(?!//|:)|=(?!=))[ \t]*"
    r"(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|[\"']?(?!(?:[Bb]earer|[Bb]asic)\b)(?P<bare>[^\s\"']+))"
    r"|-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?P<pem>[^-]+(?:-(?!----)[^-]*)*)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:))(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]{4}){2,7}(?:[ \-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ \-.]?\(?\d{2,4}\)?[ \-.]?\d{3,4}[ \-.]?\d{3,4}(?!\d)|(?<![\d+])(?:\+|00)[1-9]\d{0,2}(?:[ \-./]?\(?\d{1,5}\)?){2,5}(?!\d)"
    r"|(?<![\d.\-])(?:1[ \-.])?(?:\(\d{3}\)[ \-.]?|\d{3}[ \-.])\d{3}[ \-.]\d{4}(?![\-.]?\d)|(?<![\d.\-])\(?0\d{1,4}\)?[ \-/]\d{3,4}[ \-]?\d{3,5}(?![\-.]?\d)",
    "number": r"(?<![\d.])(?:\d{4}[ \-]?){3}\d{4}(?!\d)|\b\d{3}-\d{2}-\d{4}\b",
    "card": r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)",
    "man": r"(?<=\bMr )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}|(?<=\bMr\. )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}|(?<=\bHerr )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}",
    "woman": r"(?<=\bMrs )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}|(?<=\bMrs\. )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}|(?<=\bMs\. )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}|(?<=\bFrau )(?:[^\W\d_a-z][^\W\d_]+ ?){1,2}",
}
MEN = "adam bruno carl david emil felix georg hugo ivan jonas karl leon marc nils oscar paul robert simon tomas victor".split()
WOMEN = "anna berta clara diana emma flora greta helen irene julia karin laura maria nora olga paula rosa sofia tina vera".split()

_KINDS = list(PATTERNS)
#: What every match holds, so that most texts are passed by quickly.
_HINT = r"[@\d]|\b(?:Mr|Mrs|Ms|Herr|Frau)\b|::|[0-9A-Fa-f]:[0-9A-Fa-f]|(?i:key|secret|token|passw|passphrase|pwd|bearer)|PRIVATE|gh[a-z]_|github_pat_|sk-|xox|AIza|eyJ"
#: Ranges of letters of one script and case, in which a letter is replaced by another.
_RANGES = [(0x61, 26), (0x41, 26), (0x3B1, 25), (0x391, 17), (0x430, 32), (0x410, 32), (0x4E00, 20000), (0x3042, 80), (0xAC00, 11000), (0x5D0, 27), (0x627, 36)]


def _pattern() -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def finds(pattern: re.Pattern, text: str):
    """Start, end and kind of everything to replace, in reading order."""
    at = 0
    while m := pattern.search(text, at):
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "assigned":
            kind = "secret"
            start, end = m.span(next(g for g in ("double", "single", "bare", "pem") if m[g] is not None))
        elif kind == "ip6":
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                kind = None
        elif kind == "card":
            kind = "number" if luhn(re.sub(r"\D", "", m[0])) else None
        elif kind == "iban":
            # a following word in capitals may look like one more group
            ends = [end] + [m.start() + i.start() for i in reversed(list(re.finditer(r"[ \-]", m[0])))]
            end = next((e for e in ends if e - start >= 15 and iban(re.sub(r"[ \-]", "", text[start:e]))), None)
            kind = "iban" if end else None
        if kind is None:
            at = m.start() + 1
            continue
        # what holds no letter or digit (password=****) has nothing to replace
        if any(c.isalpha() or c.isdecimal() for c in text[start:end]):
            yield start, end, kind
        at = max(end, m.start() + 1)


def canonical(kind: str, text: str) -> str:
    """One spelling of an entity: e-mails and names by lower case, numbers by their digits."""
    if kind in ("email", "man", "woman"):
        return text.strip().lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "iban":
        return re.sub(r"[ \-]", "", text)
    if kind == "phone" and text.startswith("00"):
        text = text[2:]
    return re.sub(r"\D", "", text) if kind in ("phone", "number") else text


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.block, self.left = (key, f"{kind}\0{entity}\0{attempt}"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.seed[0], f"{self.seed[1]}\0{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        out, self.left = int.from_bytes(self.left[:4], "big") % n, self.left[4:]
        return out


def _like(char: str, stream: _Stream) -> str:
    if char.isdecimal():
        return chr(ord(char) - unicodedata.decimal(char) + stream.below(10))
    code = ord(char)
    for first, size in _RANGES:
        if first <= code < first + size:
            return chr(first + stream.below(size))
    return "aeiou"[stream.below(5)] if char.isalpha() and char.islower() else "AEIOU"[stream.below(5)] if char.isalpha() else char


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """Replacement of a canonical entity."""
    stream = _Stream(key, kind, entity, attempt)
    if kind == "ip6":
        return ":".join(["fd" + f"{stream.below(256):02x}"] + [f"{stream.below(1 << 16):x}" for _ in range(7)])
    if kind == "iban":
        out = entity[:2] + "00" + "".join(_like(c, stream) for c in entity[4:])
        return out[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in out[4:] + out[:4])) % 97:02d}" + out[4:]
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "email":
        name, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return "".join(_like(c, stream) for c in name) + "@" + "".join(_like(c, stream) for c in host) + "." + top
    if kind in ("man", "woman"):
        given, words = (MEN if kind == "man" else WOMEN), entity.split()
        first = [given[stream.below(len(given))]] if len(words) > 1 and entity.isascii() else []
        return " ".join(first + ["".join(_like(c, stream) for c in w) for w in words[len(first):]])
    if kind == "secret":
        head = 4 if entity.startswith("AKIA") else 0
        hexed = re.fullmatch(r"[0-9a-f]+", entity) is not None
        # a short secret has few of its shape: later attempts are longer
        longer = "".join(chr(0x61 + stream.below(26)) for _ in range(attempt // 8))
        return entity[:head] + "".join("0123456789abcdef"[stream.below(16)] if hexed else _like(c, stream) for c in entity[head:]) + longer
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        return entity[:keep] + "".join(str(2 + stream.below(8)) if i % 3 == 0 else str(stream.below(10)) for i in range(len(entity) - keep))
    out = entity[0] + "".join(str(stream.below(10)) for _ in entity[1:])
    if luhn(entity) and not luhn(out):
        out = next(o for o in (out[:-1] + str(d) for d in range(10)) if luhn(o))
    return out


def dressed(kind: str, found: str, new: str) -> str:
    """The surrogate in the format of the place where the entity was found."""
    if kind == "iban":
        signs = iter(new)
        return re.sub(r"[^ \-]", lambda m: next(signs, m[0]), found)
    if kind in ("phone", "number"):
        digits = iter("00" + new if kind == "phone" and found.startswith("00") else new)
        return re.sub(r"\d", lambda m: next(digits, m[0]), found)
    if kind in ("man", "woman"):
        words = [w.upper() if o.isupper() else w.capitalize() for w, o in zip(new.split(), found.split())]
        return " ".join(words) + " " * (len(found) - len(found.rstrip()))
    if kind == "email" and found.isupper():
        return new.upper()
    return new


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind and canonical entity of everything found, each once per document."""

    def run(batches):
        pattern, hint = _pattern(), re.compile(_HINT)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text and hint.search(text):
                    rows += [(doc_id, *e) for e in {(k, canonical(k, text[a:b])) for a, b, k in finds(pattern, text)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["doc_id", "kind", "entity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, entity string")


def surrogates(known: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity): no surrogate is shared or is an entity itself.

    Every attempt draws for the entities still open; a draw that is an entity, was given before or
    is drawn by a smaller entity as well is drawn again with the next attempt.
    """

    def draw(attempt: int):
        def run(batches):
            for batch in batches:
                kinds, names = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), batch.column("entity"), pa.array([surrogate(key, k, e, attempt) for k, e in zip(kinds, names)], pa.string())],
                    ["kind", "entity", "surrogate"],
                )

        return run

    open_, given, attempt = known, None, 0
    while True:
        drawn = open_.mapInArrow(draw(attempt), "kind string, entity string, surrogate string")
        free = drawn.join(known.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        new = C.stored(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"), "surrogates")
        given = new if given is None else given.union(new)
        open_ = C.stored(open_.join(new.select("kind", "entity"), ["kind", "entity"], "left_anti"), "open-entities")
        attempt += 1
        if open_.isEmpty():
            return given


def replace(docs: DataFrame, key: bytes = b"surrogates", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its surrogate; other columns pass as they are.

    In: doc_id (may be NULL or repeat), text; with ``count`` a column of that name
    holds the number of replacements. The same entity gets the same surrogate everywhere, different
    entities different ones. NULL stays NULL, texts without entities stay as they are.
    """
    base = docs.select(C.row_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = C.stored(entities(base).distinct(), "entities")
    known = C.stored(found.select("kind", "entity").distinct(), "known-entities")
    given = surrogates(known, key)
    # bounded by what one document holds
    column = "_given" + "_" * max(map(len, docs.columns))
    plans = found.join(given, ["kind", "entity"]).groupBy(F.col("doc_id").alias("_id" + column)).agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias(column))
    joined = docs.join(plans, C.row_key() == F.col("_id" + column), "left").drop("_id" + column)
    passed, place = list(docs.columns), docs.columns.index("text")

    def run(batches):
        pattern = _pattern()
        for batch in batches:
            texts, counts = [], []
            for text, plan in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
                n = 0
                if text is not None and plan:
                    names = {(p["kind"], p["entity"]): p["surrogate"] for p in plan}
                    parts, done = [], 0
                    for a, b, k in finds(pattern, text):
                        parts += [text[done:a], dressed(k, text[a:b], names[k, canonical(k, text[a:b])])]
                        n, done = n + 1, b
                    text = "".join(parts) + text[done:]
                texts.append(text)
                counts.append(n)
            columns = [batch.column(c) for c in passed]
            columns[place] = pa.array(texts, pa.string())
            names = list(passed)
            if count:
                columns.append(pa.array(counts, pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    if count:
        fields.append(T.StructField(count, T.LongType()))
    return joined.mapInArrow(run, T.StructType(fields))
