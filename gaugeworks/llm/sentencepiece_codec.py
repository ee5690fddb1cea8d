"""Operator 1: SentencePiece encoding and decoding of whole texts.

Merge-type (BPE) vocabularies: a text becomes one symbol per character; an agenda ordered by score (ties: leftmost)
of adjacent symbol pairs whose joined form is a piece is worked off until no pair is left; symbols outside the
vocabulary become their UTF-8 byte pieces. No piece holds a word mark after another character, so runs of marks
with what follows them are independent, and each distinct one of a batch is merged once. Short ones are merged many at
a time: a segment's agenda is a row of pair scores, and in each step all rows take out their best pair. Long ones have
a heap each. Every segment that is merged is checked against the sentencepiece library, a batch at a time; a text with a
segment on which the two differ is encoded and decoded by the library, and `by_library` marks it.

Merged segments are kept per Python worker in Arrow arrays, at most KNOWN of them and KNOWN_BYTES of their text; the
ones used last stay.

Nulls and empty texts give no ids and an empty decoded text. Repeated rows give repeated rows. An empty table gives
an empty result. Columns other than the id and the text are not looked at. A literal word mark (U+2581) in a text
decodes to a space, as in the library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.shared import slices, text_bytes

MARK = "▁"
#: Merged segments that a worker keeps, and the bytes of their texts; segments merged in rows, by their characters; cells of such a block of rows.
KNOWN, KNOWN_BYTES, WIDTHS, CELLS = 400_000, 16 << 20, (4, 8, 12, 16, 24, 32, 48, 64), 1 << 20
_NEVER = np.iinfo(np.int32).max


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i in turn."""
    to = np.cumsum(size)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _strings(off: np.ndarray, data: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _code_points(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in turn, and the offset of each text in them."""
    data, off = text_bytes(texts)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), _offsets((data & 0xC0) != 0x80)[off]


class Merger:
    """The vocabulary of one model, and the merging of segments with it."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.size = lib.get_piece_size()
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(size)]
        self.pieces = {lib.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.pieces.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece of this model spans words, so segments can't be merged apart")
        if len(self.bytes) < 256:
            raise ValueError("this model has no byte pieces")
        if lib.encode(" a  ") and lib.decode(lib.encode(" a  ")) != " a  ":
            raise ValueError("this model's normaliser changes white space")
        self._prepare()
        self.keys, self.ids, self.decoded = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())
        self.differs, self.used, self.clock = np.zeros(0, bool), np.zeros(0, np.int64), 0

    def _prepare(self) -> None:
        """Tables for merging in rows: symbols are pieces, then characters that only occur in pieces, then all others as one."""
        symbols = dict(self.pieces)
        for c in sorted({c for p in self.pieces for c in p} - symbols.keys()):
            symbols[c] = self.size + len(symbols) - len(self.pieces)
        self.other = self.size + len(symbols)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        place = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.place = np.full(self.size + 1, _NEVER, np.int32)  # by piece; the last is for no piece
        for p, i in self.pieces.items():
            self.place[i] = place[self.scores[p]]
        joins = {(symbols[p[:k]], symbols[p[k:]]): i for p, i in self.pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.bits = max(4, (4 * len(joins)).bit_length())
        slots = 1 << self.bits
        self.pair, self.joined = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
        keys = np.array([a << 24 | b for a, b in joins], np.int64)
        for key, at, i in zip(keys.tolist(), self._slot(keys).tolist(), joins.values(), strict=True):
            while self.pair[at] >= 0:
                at = (at + 1) % slots
            self.pair[at], self.joined[at] = key, i
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        text = [byte_of.get(i) or b"" for i in range(self.size)]
        for p, i in self.pieces.items():
            text[i] = p.replace(MARK, " ").encode()
        self.piece_off, self.piece_data = _offsets(np.array([len(x) for x in text])), np.frombuffer(b"".join(text), np.uint8)
        self.of_byte = np.array([self.bytes[b] for b in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = a.astype(np.int64) << 24 | b
        at = self._slot(key)
        found = self.pair[at]
        out = np.where(found == key, self.joined[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.pair) - 1)
            found = self.pair[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.joined[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, by a heap."""
        symbols, get = list(segment), self.scores.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-score, i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (score := get(pair)) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, joined = pop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (score := get(pair := joined + symbols[k])) is not None:
                    push(agenda, (-score, i, pair))
            if (h := before[i]) >= 0 and (score := get(pair := symbols[h] + joined)) is not None:
                push(agenda, (-score, h, pair))
        ids, pieces = [], self.pieces
        for s in symbols:
            if s:
                if (i := pieces.get(s)) is not None:
                    ids.append(i)
                else:
                    ids.extend(self.bytes[b] for b in s.encode())
        return ids

    def _merge_rows(self, points: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments of at most `width` characters in turn, and the number of ids of each."""
        size = np.diff(off)
        filled = np.arange(width) < size[:, None]
        chars = np.zeros(filled.shape, np.uint32)
        chars[filled] = points[_spans(off[:-1], size)]
        n, every = len(size), np.arange(len(size))
        done = np.empty((n, width), np.int32)
        symbol = np.full((n, width + 1), self.other, np.int32)  # the last column stands for what is beyond either end
        symbol[:, :width][filled] = self.of_char[chars[filled]]
        to = np.full((n, width + 1), -1, np.int32)
        to[:, : width - 1] = self.join(symbol[:, : width - 1].ravel(), symbol[:, 1:width].ravel()).reshape(n, width - 1)
        agenda = self.place[to]
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        while True:
            best = agenda.argmin(axis=1)
            rows = np.flatnonzero(agenda[np.arange(len(best)), best] < _NEVER)
            if len(rows) < 0.7 * len(best) or not len(rows):
                done[every] = symbol[:, :width]
                if not len(rows):
                    break
                every, symbol, to, agenda, after, before, best = (x[rows] for x in (every, symbol, to, agenda, after, before, best))
                rows = np.arange(len(best))
            i = best[rows]
            j, s = after[rows, i], to[rows, i]
            k = after[rows, j]
            symbol[rows, i], symbol[rows, j], agenda[rows, j] = s, -1, _NEVER
            after[rows, i], before[rows, k] = k, i
            to[rows, i] = right = self.join(s, symbol[rows, k])
            agenda[rows, i] = self.place[right]
            h = before[rows, i]
            to[rows, h] = left = self.join(symbol[rows, h], s)
            agenda[rows, h] = self.place[left]
        alive = filled & (done >= 0)
        found, chars = done[alive], chars[alive]
        spelled = found >= self.size  # in UTF-8 bytes
        size = np.where(spelled, 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
        ids = np.repeat(found, size)
        at = np.flatnonzero(np.repeat(spelled, size))
        c, m = np.repeat(chars, size)[at].astype(np.int64), np.repeat(size, size)[at]
        k = m - 1 - (at - np.repeat(np.cumsum(size) - size, size)[at])  # bytes that follow in the character
        first = np.where(m == 1, 0, 0xFF00 >> m & 0xFF)
        ids[at] = self.of_byte[np.where(k == m - 1, first | c >> 6 * k, 0x80 | c >> 6 * k & 0x3F)]
        return ids, np.diff(_offsets(size)[_offsets(alive.sum(axis=1))])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.StringArray:
        """Texts of segments, with their leading spaces."""
        size = np.diff(self.piece_off)[ids]
        return _strings(_offsets(size)[off], self.piece_data[_spans(self.piece_off[ids], size)])

    def learn(self, segments: pa.StringArray) -> np.ndarray:
        """Merges segments, checks them against the library and keeps them. Their places among those kept."""
        points, off = _code_points(segments)
        size = np.diff(off)
        order, ids, counts, low = [], [], [], 0
        for width in WIDTHS:
            fit = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in np.array_split(fit, max(1, -(-len(fit) * width // CELLS))) if len(fit) else ():
                found, n = self._merge_rows(points[_spans(off[at], size[at])], _offsets(size[at]), width)
                order, ids, counts = [*order, at], [*ids, found], [*counts, n]
        for i in np.flatnonzero(size > low).tolist():
            found = self.merge(segments[i].as_py())
            order, ids, counts = [*order, np.array([i])], [*ids, np.array(found, np.int32)], [*counts, np.array([len(found)])]
        order = np.concatenate(order)
        segments = segments.take(pa.array(order))
        own, n = np.concatenate(ids), np.concatenate(counts)
        off = _offsets(n)
        decoded = self.decode(own, off)
        # A lone mark is an empty text to the library, which then adds no prefix.
        plain = pc.replace_substring(pc.utf8_slice_codeunits(segments, 1), MARK, " ").to_pylist()
        theirs = self.library.encode(plain, num_threads=1)
        m = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(m.sum()))
        lone = np.array([not p for p in plain])
        differs = (m != n) & ~lone
        both = np.flatnonzero(~differs & ~lone)
        unlike = own[_spans(off[both], n[both])] != flat[_spans(_offsets(m)[both], n[both])]
        differs[np.repeat(both, n[both])[unlike]] = True
        texts = pa.array(self.library.decode(theirs), pa.string())
        differs |= pc.not_equal(texts, pc.utf8_slice_codeunits(decoded, 1)).to_numpy(zero_copy_only=False) & ~lone
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(self.keys), len(self.keys) + len(order))
        self.keys = pa.concat_arrays([self.keys, segments])
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(own))])
        self.decoded = pa.concat_arrays([self.decoded, decoded])
        self.differs = np.concatenate([self.differs, differs])
        self.used = np.concatenate([self.used, np.full(len(n), self.clock)])
        return place

    def _forget(self) -> None:
        if len(self.keys) > KNOWN or self.keys.nbytes > KNOWN_BYTES:
            last = np.argsort(-self.used, kind="stable")[: KNOWN // 2]
            last = last[np.cumsum(pc.binary_length(self.keys).to_numpy()[last]) <= KNOWN_BYTES // 2]
            at = pa.array(last)
            self.keys, self.ids, self.decoded = self.keys.take(at), self.ids.take(at), self.decoded.take(at)
            self.differs, self.used = self.differs[last], self.used[last]

    def texts(self, texts: pa.Array) -> tuple[pa.ListArray, pa.StringArray, np.ndarray]:
        """Ids and decoded form of each text, and whether the library had to make them."""
        self._forget()
        self.clock += 1
        texts = pc.fill_null(texts, "").cast(pa.string())
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", MARK), pc.replace_substring(texts, " ", MARK), "")
        data, off = text_bytes(marked)
        a, b, c = MARK.encode()
        mark = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = True
        start = mark[begins[mark] | (np.diff(mark, prepend=-9) != 3)]
        segments = _strings(np.append(start, len(data)), data).dictionary_encode()
        index, distinct = segments.indices.to_numpy(), segments.dictionary
        at = pc.fill_null(pc.index_in(distinct, self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.learn(distinct.take(pa.array(new)))
        self.used[at] = self.clock
        each = pa.array(at[index])
        by_text = np.searchsorted(start, off)
        ids, decoded = self.ids.take(each), self.decoded.take(each)
        lists = pa.ListArray.from_arrays(pa.array(_offsets(pc.list_value_length(ids).to_numpy())[by_text].astype(np.int32)), ids.flatten())
        data, off = text_bytes(decoded)
        whole = pc.utf8_slice_codeunits(_strings(off[by_text], data), 1)
        odd = _offsets(self.differs[at[index]])
        odd = np.diff(odd[by_text]) > 0
        if odd.any():
            plain = texts.to_pylist()
            theirs = [self.library.encode(plain[i], num_threads=1) if o else None for i, o in enumerate(odd.tolist())]
            lists = pa.array([t if o else x for t, o, x in zip(theirs, odd.tolist(), lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
            whole = pa.array([self.library.decode(t) if o else x for t, o, x in zip(theirs, odd.tolist(), whole.to_pylist(), strict=True)], pa.string())
        return lists, whole, odd


_mergers: dict[str, Merger] = {}


def merger(model: str) -> Merger:
    if model not in _mergers:
        _mergers[model] = Merger(model)
    return _mergers[model]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string, by_library boolean), one for each row of docs. model: a path that every executor has."""
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([docs.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("by_library", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, decoded, odd = m.texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded, pa.array(odd)], names=[id_col, "ids", "decoded", "by_library"])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_texts()."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
