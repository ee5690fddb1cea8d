"""Operator 9: secret scans.

Fixed patterns (assignments, access keys, long hexadecimal strings) and a sliding-window entropy test. Candidates are
long runs of key characters. UUIDs, placeholders, numbers and names made of words are taken out of a candidate, and a
window of fixed length moves over each part that is left; the counts of its characters are updated by the one that
leaves and the one that enters, which gives its Shannon entropy in constant time a step. A run of windows above the
threshold of their own character class is a span of kind `entropy`. Spans of patterns always stay.

Nulls and empty texts have no spans. Repeated rows give repeated rows, an empty table an empty result. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import slices

KINDS = ("assign", "access", "hex", "entropy")


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The patterns.
ASSIGN = re.compile(f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
#: Parts of a candidate that are harmless wherever they stand: UUIDs and placeholders.
HARMLESS = re.compile(
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])"
    r"|(?i:example|placeholder|changeme|redacted)|x{4,}|X{4,}|0123456789|abcdefgh"
)
GROUP = re.compile("[A-Za-z0-9]+")
#: A group of letters with a short number before or behind it, or a number alone; the letters must look like words.
NAME = re.compile("[0-9]{0,4}([A-Za-z]+)[0-9]{0,4}|[0-9]+")
#: A group of so many characters or fewer between or beside random ones belongs to them.
SHORT = 4
PIECE = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
#: The letters that follow a letter in words of European languages.
FOLLOW = dict(x.split(":") for x in (
    "a:bcdfghiklmnprstuvwyz b:aeiloursbyj c:aehikloqrtuyc d:aeiorsudygv e:abcdfgeilmnpqrstuvwxyhkzto f:aefilorutys g:aeghilnorsuty h:aeiortuynml i:abcdefgklmnoprstvzxq j:aeou k:aeilnostyru "
    "l:adefikmlostuvypgb m:abeimopsuy n:acdefgiknostuvyzj o:abcdefghiklmnoprstuvwxy p:aefhiloprstuy q:u r:abcdefghiklmnoprstuvwyz s:acehiklmnopqstuvwy t:acehilorstuwyz u:abcdefgilmnprstxzhk v:aeioryu "
    "w:aehinorsu x:aceipty y:abceilmnoprstd z:aeioutzwy"
).split())
WINDOW = 20
#: Bits a character, by class: hexadecimal digits have at most 4, windows of 20 at most 4.32.
HEX_BITS, OTHER_BITS = 3.0, 3.7
HEXADECIMAL = frozenset("0123456789abcdefABCDEF")


@functools.lru_cache(maxsize=8)
def _xlogx(window: int) -> list[float]:
    return [0.0] + [k * math.log2(k) for k in range(1, window + 1)]


def looks_like_words(letters: str) -> bool:
    """Whether letters, parted where a capital begins a word, are pieces of three letters or more with usual pairs."""
    pieces = PIECE.findall(letters)
    if len(letters) > SHORT and len(letters) < 3 * len(pieces):
        return False
    pairs = [b in FOLLOW[a] for p in pieces for a, b in zip(p.lower(), p.lower()[1:])]
    return sum(pairs) >= 0.85 * len(pairs)


def random_parts(s: str) -> list[tuple[int, int]]:
    """Spans of a candidate that are left when UUIDs, placeholders, numbers and names of words are taken out."""
    out, at = [], 0
    for a, b in [*(m.span() for m in HARMLESS.finditer(s)), (len(s), len(s))]:
        groups = []  # [start, end, random, short]
        for m in GROUP.finditer(s, at, a):
            name = NAME.fullmatch(m[0])
            groups.append((m.start(), m.end(), not (name and (not name[1] or looks_like_words(name[1]))), len(m[0]) <= SHORT))
        i = 0
        while i < len(groups):
            j = i
            while j < len(groups) and (groups[j][2] or groups[j][3]):
                j += 1
            first = next((k for k in range(i, j) if groups[k][2]), None)
            if first is not None:
                while first > i and "=" not in s[groups[first - 1][1] : groups[first][0]]:
                    first -= 1
                out.append((groups[first][0], groups[j - 1][1]))
            i = j + 1
        at = b
    return out


def entropy_spans(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of s that windows above the threshold of their own class cover, touching ones joined."""
    highest, highest_hex = ((math.log2(window) - bits) * window + 1e-9 for bits in (OTHER_BITS, HEX_BITS))
    counts: dict[str, int] = {}
    xlogx = _xlogx(window)
    total, other, letter, out = 0.0, -1, -1, []  # where the last character beyond hexadecimal, and the last letter stand
    for i, c in enumerate(s):
        if c not in HEXADECIMAL:
            other = i
        elif c > "9":
            letter = i
        if i >= window:  # the leaving character first: no count passes the window's length
            gone = s[i - window]
            k = counts[gone]
            counts[gone] = k - 1
            total += xlogx[k - 1] - xlogx[k]
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += xlogx[k + 1] - xlogx[k]
        if i >= window - 1 and total <= (highest_hex if other <= i - window < letter else highest):
            a, b = i - window + 1, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for m in CANDIDATE.finditer(text):  # a hexadecimal run of 32 or more lies in a candidate
        at, s = m.start(), m[0]
        if len(s) >= 32:
            out += [(at + h.start(), 2, at + h.end()) for h in HEX.finditer(s) if h.end() - h.start() >= 32]
        for x, y in random_parts(s):
            out += [(at + x + a, 3, at + x + b) for a, b in entropy_spans(s[x:y])]
    return sorted(out)


def _spans_of(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    return [find_secrets(t) if t else [] for t in texts]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>), one for each row of docs, spans by start, then kind, then end."""
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in _spans_of(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("entropy"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "<secret>") -> DataFrame:
    """docs with every span (overlapping ones joined) replaced by a mark; texts without spans stay as they are."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                texts = part.column(where).to_pylist()
                for i, spans in enumerate(_spans_of(texts)):
                    if spans:
                        text, out, at = texts[i], [], 0
                        for a, _, b in spans:
                            if a >= at:
                                out += [text[at:a], mark]
                            at = max(at, b)
                        texts[i] = "".join([*out, text[at:]])
                columns = list(part.columns)
                columns[where] = pa.array(texts, part.column(where).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out
