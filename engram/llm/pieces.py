"""SentencePiece encoding and decoding by streaming Viterbi.

``Pieces`` reads a SentencePiece model file. The encoder goes through the text once and keeps,
for each boundary between characters, the best last piece that ends there. Only boundaries
within the longest piece's length can still be extended; as soon as the backpointer paths of
all of these meet in one boundary, the ids before it are final and are given out.

* Unigram models: the usual score is maximised.
* BPE models: a piece may follow another only if merging their joint text gives back just these
  two; each prefix then has exactly one valid path, which is the result of BPE merging
  (a path's score is 0 or minus infinity). The window and the commits are the same.

Texts are cut in front of every blank beforehand where no piece of the vocabulary continues
over it, as all paths meet there, and ids of the parts are memoised for each worker.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import buffers, file_bytes, pick, place, positional, ragged, slices

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Parts that a worker remembers; beyond it the memo starts anew.
MEMO = 400_000
#: Parts longer than this aren't remembered.
MEMO_CHARS = 64


def _fields(blob: bytes):
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, blob[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, blob[at - n : at]
        elif kind == 5:
            at += 4
            yield key >> 3, blob[at - 4 : at]
        else:
            raise ValueError("not a SentencePiece model")


class Pieces:
    """A vocabulary with its encoder and decoder. ``blob``: the bytes of a model file."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        model, self.byte_fallback, norm = 1, False, {}
        for key, value in _fields(blob):
            if key == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif key == 2:
                spec = dict(_fields(value))
                model, self.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("models that put the blank at the end of words aren't supported")
            elif key == 3:
                norm = dict(_fields(value))
        if model not in (1, 2):
            raise ValueError("neither a unigram nor a BPE model")
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only models that leave the text as it is are supported")
        self.bpe, self.prefix = model == 2, bool(norm.get(3, 1))
        self.unknown = self.types.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.by_blank = not any(x[1] == BLANK and x[0] != BLANK for x in self.inside)
        #: The pieces that merging can reach.
        self._own = {x: i for x, i in self.ids.items() if not self.bpe or self.merged(x) == [x]}
        self.worst = min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - 10
        self._pair: dict[tuple[int, int], bool] = {}
        raw = [self._raw(i) for i in range(len(self.pieces))]
        self._flat = np.frombuffer(b"".join(raw), np.uint8)
        self._length = np.array([len(x) for x in raw], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._clear()

    def _raw(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return (" ⁇ " if self.types[i] == UNKNOWN else self.pieces[i].replace(BLANK, " ")).encode()

    def _clear(self) -> None:
        pieces = self

        class Memo(dict):
            def __missing__(self, part: str) -> int:
                at = len(pieces._starts)
                ids = pieces.part(part if part[:1] == "\n" else BLANK + part)
                pieces._starts.append(len(pieces._ids))
                pieces._lengths.append(len(ids))
                pieces._ids.extend(ids)
                if len(part) <= MEMO_CHARS:
                    self[part] = at
                return at

        self._memo, self._ids, self._starts, self._lengths = Memo(), array("i", [0]), array("q"), array("q")
        self._short: dict[str, list[int]] = {}

    # -- BPE: which pieces may follow each other

    def merged(self, s: str) -> list[str]:
        """BPE merging as defined: the best pair first, the leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        ok = self._pair.get((left, right))
        if ok is None:
            a, b = self.pieces[left], self.pieces[right]
            ok = self._pair[left, right] = a[-1] + b[0] not in self.inside or self.merged(a + b) == [a, b]
        return ok

    # -- encoding

    def stream(self, chars, window: list | None = None):
        """Ids of an iterable of characters, given out as soon as they are final. Characters
        that no piece has come out as byte ids or the unknown id. ``window`` gets the number of
        boundaries held, for tests."""
        ids, scores, longest, bpe = self._own, self.scores, self.longest, self.bpe
        text, base, at, done = "", 0, 0, 0  # text holds characters base..at
        back: dict[int, tuple[int, int | str]] = {0: (-1, -1)}
        best = {0: 0.0}
        due = 4 * longest
        for c in chars:
            text += c
            at += 1
            found = None
            low = max(base, at - longest)
            for begin in range(low, at):
                if begin not in back:
                    continue
                k = ids.get(text[begin - base :])
                if k is None:
                    continue
                if bpe:
                    before = back[begin][1]
                    if before == -1 or isinstance(before, str) or self._fits(before, k):
                        found = (begin, k)
                        break
                elif found is None or best[begin] + scores[k] > score:
                    found, score = (begin, k), best[begin] + scores[k]
            if c not in self.ids and at - 1 in back:  # the character on its own
                if found is None or not bpe and best[at - 1] + self.worst > score:
                    found, score = (at - 1, c), best[at - 1] + self.worst
            if found is not None:
                back[at] = found
                if not bpe:
                    best[at] = score
            if window is not None:
                window.append(len(back))
            if at - done >= due:
                alive = {b for b in range(max(done, at - longest + 1), at + 1) if b in back}
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if meet > done:
                    yield from self._path(back, done, meet)
                    last = back[meet][1]
                    for b in [b for b in back if b < meet]:
                        back.pop(b)
                        best.pop(b, None)
                    back[meet], done = (-1, last), meet
                    text, base = text[meet - base :], meet
                due = max(4 * longest, 2 * (at - done))
        if at > done:
            yield from self._path(back, done, at)

    def _within(self, s: str) -> list[int]:
        """``stream`` for a BPE part that doesn't outgrow the window, so that nothing is final
        before its end."""
        get, pair, longest = self._own.get, self._pair, self.longest
        last: list = [-1]
        step = [0]
        for at in range(1, len(s) + 1):
            found, begin = None, at - longest if at > longest else 0
            while begin < at:
                before = last[begin]
                if before is not None:
                    k = get(s[begin:at])
                    if k is not None:
                        if begin == 0:
                            found = k
                            break
                        ok = pair.get((before, k))
                        if ok is None:
                            ok = before < 0 or self._fits(before, k)
                        if ok:
                            found = k
                            break
                begin += 1
            if found is None and s[at - 1] not in self.ids:  # -2: a character on its own
                found, begin = -2, at - 1
            last.append(found)
            step.append(begin)
        out: list[int] = []
        at = len(s)
        while at:
            k = last[at]
            if k >= 0:
                out.append(k)
            elif self.byte_fallback and self.bytes:
                out.extend(self.bytes[b] for b in reversed(s[at - 1].encode()))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = step[at]
        return out[::-1]

    def _path(self, back: dict, low: int, high: int) -> list[int]:
        out: list[int] = []
        while high > low:
            high, k = back[high]
            if not isinstance(k, str):
                out.append(k)
            elif self.byte_fallback and self.bytes:
                out.extend(self.bytes[b] for b in reversed(k.encode()))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out[::-1]

    def part(self, s: str) -> list[int]:
        """Ids of text without the first blank's handling; cut where no piece goes across."""
        out: list[int] = []
        start, n = 0, len(s)
        inside, short = self.inside, self._short
        for i in range(1, n + 1):
            if i == n or s[i - 1 : i + 1] not in inside:
                p = s[start:i]
                ids = short.get(p)
                if ids is None:
                    if self.bpe and BLANK * 2 in p:  # their pieces have equal scores, ties go by place
                        ids = self._runs(p)
                    elif self.bpe and len(p) <= 2 * self.longest:
                        ids = self._within(p)
                    else:
                        ids = list(self.stream(p))
                    if len(p) <= MEMO_CHARS:
                        short[p] = ids
                out.extend(ids)
                start = i
        return out

    def _runs(self, s: str) -> list[int]:
        """For parts with runs of blanks: merging by a queue."""
        import heapq

        n = len(s)
        sym, nxt, prv = list(s), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i] if 0 <= i else n
            if i >= 0 and j < n:
                k = self.ids.get(sym[i] + sym[j])
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], i, sym[i] + sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if not sym[i] or j >= n or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        out: list[int] = []
        for x in filter(None, sym):
            k = self.ids.get(x)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in x.encode())
            else:
                out.append(self.unknown)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self._memo) > MEMO or len(self._ids) > 8 * MEMO:
            self._clear()
        get, places, counts = self._memo.__getitem__, [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            if BLANK in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or not self.by_blank or not self.prefix:
                parts = self._cut(text)
            else:
                parts = text.replace("\n", " \n").split(" ")
            places.extend(map(get, parts) if isinstance(parts, list) else parts[0])
            counts.append(len(parts) if isinstance(parts, list) else len(parts[0]))
        at = np.array(places, np.int64)
        starts, lengths, flat = np.array(self._starts), np.array(self._lengths), np.array(self._ids)
        n = lengths[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        doc = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ragged(flat, starts[at], n) if len(at) else np.zeros(0, np.int32), np.diff(ends[doc])

    def _cut(self, text: str) -> tuple[list[int]]:
        """For texts with unusual blanks: places of parts that aren't kept under their text."""
        s = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        out = []
        start = 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i] == BLANK and s[i - 1] != BLANK and self.by_blank or s[i] == "\n" and s[i - 1 : i + 1] not in self.inside:
                out.append(len(self._starts))
                ids = self.part(s[start:i])
                self._starts.append(len(self._ids))
                self._lengths.append(len(ids))
                self._ids.extend(ids)
                start = i
        return (out,)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    # -- decoding

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, number of bytes of each)."""
        counts = np.asarray(counts, np.int64)
        n = self._length[ids]
        out = ragged(self._flat, self._start[ids], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        size = np.diff(ends)
        if self.prefix and len(out):  # the blank put in front isn't part of the text
            first = ends[:-1][size > 0]
            drop = first[out[first] == 32]
            keep = np.ones(len(out), bool)
            keep[drop] = False
            size = size - np.bincount(np.searchsorted(ends, drop, "right") - 1, minlength=len(size))[: len(size)]
            out = out[keep]
        return out, size

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_batch(np.array(ids, np.int64), np.array([len(ids)]))
        return out.tobytes().decode("utf-8", "replace")


_LOADED: dict[int, Pieces] = {}


def loaded(blob: bytes) -> Pieces:
    """One encoder a worker."""
    key = hash(blob)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(blob)
    return _LOADED[key]


def texts_of(column: pa.Array, at: int, to: int) -> list[str]:
    return column.slice(at, to - at).to_pylist()


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of each row's text and whether decoding gives the text back.

    Columns: ``keep``, ``ids`` array<int>, ``n_ids`` int, ``round_trip`` boolean.

    ``model``: path of a SentencePiece model file (identity normalisation, unigram or BPE), read
    by the driver and broadcast (its size, about half a MB, doesn't depend on the data).

    A null text has null ids, 0 of them and a null round trip; an empty text has an empty array
    and a true one. Texts of any length are encoded whole, in slices of rows. Rows are handled
    one by one: repeated rows give repeated results, other columns are ignored whatever their
    names, empty tables give no rows. A text with the character U+2581 decodes to a blank, as it
    does in the format; its round trip is false.
    """
    blob = docs.sparkSession.sparkContext.broadcast(file_bytes(model))
    kept = [docs.schema[docs.columns[int(place(docs, c)[1:])]] for c in keep]
    own = positional(docs).select(*[F.col(place(docs, c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(place(docs, text)).cast("string").alias("text"))
    out = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        pieces = loaded(blob.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets, raw = buffers(column)
            null = np.asarray(column.is_null())
            for at, to in slices(np.diff(offsets)):
                ids, counts = pieces.encode_batch(texts_of(column, at, to))
                back, size = pieces.decode_batch(ids, counts)
                ends = np.concatenate([[0], np.cumsum(size)])
                want = np.diff(offsets[at : to + 1])
                same = size == want
                if not (same.all() and np.array_equal(back, raw[offsets[at] : offsets[to]])):
                    for i in np.flatnonzero(same):
                        same[i] = np.array_equal(back[ends[i] : ends[i + 1]], raw[offsets[at + i] : offsets[at + i + 1]])
                gone = null[at:to]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(gone) if gone.any() else None)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)], lists, pa.array(counts, pa.int32()), pa.array(same, mask=gone)],
                    names=[f.name for f in out],
                )

    return own.mapInArrow(run, out).toDF(*keep, "ids", "n_ids", "round_trip")
