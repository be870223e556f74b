"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, accents and look-alike letters of other scripts to plain
letters, digits beside letters and signs inside words to the letters they stand for, invisible characters
dropped, white space to one blank. An Aho-Corasick automaton over the folded lexicon finds all entries at once; hits
inside an exception phrase don't count. The score is the summed weight per 100 words.

The lexicon has general English entries and stems learned from labelled documents: word
beginnings that far more of the toxic documents have than of the others. The threshold is tuned on documents
that the stems weren't learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import as_string, buffers, cut, frugal, pick, place, portions, positional, slices

#: Labelled documents that are read to learn stems and the threshold, half of each class at most.
LABELLED = 4_000
#: Of stems and the threshold: see ``learn``.
SHORTEST, LONGEST, RATIO, TEXTS, SURE, ALARMS = 3, 8, 4.0, 8, 1.64, 0.002
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "b",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
    **dict.fromkeys("​‌‍⁠﻿­", ""),
}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")


class _Fold(dict):
    """For str.translate: filled as characters come."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        base = "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)).lower()
        base = _LOOK_ALIKE.get(x, base if base or not unicodedata.combining(x) else "")
        self[c] = out = "".join(_LOOK_ALIKE.get(y, y) for y in base)
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    text = " ".join(text.split())
    if any(d in text for d in "01345789"):
        text = _NUMBER.sub(lambda m: "#" * len(m[0]), text)  # numbers of their own stand for no letters
    if not text.isascii() or any(s in text for s in "@$!|+"):
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """``words`` match whole words, ``stems`` beginnings of words: pairs of (entry, weight). A text is toxic from
    ``threshold`` on. Texts of fewer than ``least_words`` words count as having so many, so that one mild word doesn't condemn a short one."""

    words: tuple[tuple[str, float], ...]
    stems: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    threshold: float = 2.0
    least_words: int = 50


_MILD = "annoying dumb fool foolish jerk lame nasty pest rubbish sucks ugly"
_PLAIN = "clown disgusting dimwit filth garbage idiot idiotic idiots loser losers moron moronic morons pathetic scum stupid trash vermin worthless"
_STRONG = "asshole bastard bitch cunt dickhead fuck fucked fucker fucking motherfucker shithead subhuman whore"
GENERAL = Lexicon(
    words=tuple((w, weight) for weight, ws in ((1.0, _MILD), (4.0, _PLAIN), (5.0, _STRONG)) for w in ws.split()),
    exceptions=("trash can", "trash bin", "trash bag", "take out the trash", "garbage collection", "garbage collector", "garbage can", "clown fish", "circus clown", "rodeo clown", "pest control", "sore loser rule", "fool proof", "ugly duckling"),
)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        entries: dict[str, list] = {}  # folded -> [word weight, stem weight, is exception]
        for place_, pairs in ((0, lexicon.words), (1, lexicon.stems)):
            for w, weight in pairs:
                if fold(w):
                    own = entries.setdefault(fold(w), [0.0, 0.0, False])
                    own[place_] = max(own[place_], float(weight))
        for x in lexicon.exceptions:
            if fold(x):
                entries.setdefault(fold(x), [0.0, 0.0, False])[2] = True
        self.least_words = lexicon.least_words
        self.automaton = ahocorasick.Automaton()
        for e, (word, stem, exception) in entries.items():
            self.automaton.add_word(e, (len(e), word, stem, exception))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text. Of entries that begin at the same place the heaviest counts."""
        if self.empty or not text:
            return []
        s = fold(text)
        n = len(s)
        found: dict[int, tuple[int, float]] = {}
        exempt: list[tuple[int, int]] = []
        for last, (length, word, stem, exception) in self.automaton.iter(s):
            start, end = last + 1 - length, last + 1
            if start and s[start - 1].isalnum():
                continue
            whole = end == n or not s[end].isalnum()
            if exception and whole:
                exempt.append((start, end))
            weight = max(stem, word if whole else 0.0)
            if weight and weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        return [(a, b, w) for a, (b, w) in sorted(found.items()) if not any(p <= a and b <= q for p, q in exempt)]

    def score(self, text: str) -> tuple[float, int, int]:
        """(score, hits, words)."""
        own = self.hits(text)
        n = len(text.split())
        return 100.0 * sum(w for *_, w in own) / max(n, self.least_words), len(own), n


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", fold(text)))


class _Copies:
    """Tells sets of words of which one before had the same least hashes in half of PERMUTATIONS orders: those of copies of one text, whose
    words would else count as so many witnesses."""

    PERMUTATIONS = 16
    FACTORS = np.random.default_rng(5).integers(1 << 62, size=(PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self) -> None:
        self.seen: dict[tuple[int, int], list[int]] = {}
        self.number = 0

    @classmethod
    def least(cls, words: set[str]) -> np.ndarray:
        own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.uint64)
        out = np.empty(cls.PERMUTATIONS, np.uint64)
        for i, factor in enumerate(cls.FACTORS[:, 0]):  # one order at a time: the words of a long text are many
            mixed = (own ^ (own << np.uint64(32))) * factor
            out[i] = (mixed ^ (mixed >> np.uint64(31))).min()
        return out

    def has(self, least: np.ndarray) -> bool:
        """Whether such a set was given before, by its ``least`` hashes; remembers this one if not."""
        own = list(enumerate(least.tolist()))
        if any(n >= self.PERMUTATIONS // 2 for n in Counter(i for x in own for i in self.seen.get(x, ())).values()):
            return True
        for x in own:
            self.seen.setdefault(x, []).append(self.number)
        self.number += 1
        return False


class _Halves:
    """Shares each class out evenly to two halves, in the order given; of copies the first counts."""

    def __init__(self) -> None:
        self.seen, self.copies = [0, 0], (_Copies(), _Copies())

    def take(self, least: np.ndarray, y: int) -> int | None:
        if self.copies[y].has(least):
            return None
        self.seen[y] += 1
        return (self.seen[y] - 1) % 2


class _Evidence:
    """Of labelled texts: how many of each class have each word beginning. A text counts once, however often it has one."""

    def __init__(self) -> None:
        self.held, self.number = (Counter(), Counter()), [0, 0]

    @staticmethod
    def beginnings(words: set[str], shortest: int, longest: int) -> set[str]:
        return {w[:k] for w in words for k in range(shortest, min(longest, len(w)) + 1)}

    def add(self, words: set[str], y: int, shortest: int, longest: int) -> None:
        self.held[y].update(self.beginnings(words, shortest, longest))
        self.number[y] += 1

    def __add__(self, other: _Evidence) -> _Evidence:
        out = _Evidence()
        out.held = (self.held[0] + other.held[0], self.held[1] + other.held[1])
        out.number = [a + b for a, b in zip(self.number, other.number)]
        return out

    def stems(self, shortest: int, longest: int, ratio: float, texts: int, sure: float) -> tuple[tuple[str, float], ...]:
        """Word beginnings and weights: see ``learn``."""
        scored = []
        for p, d in self.held[1].items():
            if d >= texts:
                other = self.held[0][p]
                lift = math.log((d + 0.5) / (self.number[1] + 1)) - math.log((other + 0.5) / (self.number[0] + 1))
                if lift - sure * math.sqrt(1 / (d + 0.5) + 1 / (other + 0.5)) >= math.log(ratio):
                    scored.append((-d * lift, len(p), p, lift))
        stems: dict[str, float] = {}
        for _, _, p, lift in sorted(scored):
            if not any(p.startswith(s) or s.startswith(p) for s in stems):
                stems[p] = round(lift, 3)
        return tuple(sorted(stems.items()))


def learn(
    rows: list[tuple[str, int]], base: Lexicon = GENERAL, shares: tuple[int, int] | None = None, shortest: int = SHORTEST, longest: int = LONGEST,
    ratio: float = RATIO, texts: int = TEXTS, sure: float = SURE, alarms: float = ALARMS,
) -> Lexicon:
    """Stems and threshold from (text, 0 or 1) rows.

    Stems are word beginnings of ``shortest`` to ``longest`` letters that are in ``texts`` toxic texts at least and whose share of toxic texts is, with ``sure`` standard
    errors to spare, ``ratio`` times that of the others; of nested ones the one with the most evidence. The threshold is tuned on texts from which no stem was learned: stems of one half of the rows score the other half.
    It is the one with the best F1 among those that call at most ``alarms`` of the clean texts toxic, midway to the next
    score below; rows weigh as their class does among ``shares`` (clean, toxic) rows, so that a balanced sample
    is judged as the whole. Near copies (see ``_Copies``) count once. Without both classes the lexicon stays as it is."""
    rows = [(t, y) for t, y in rows if t and y in (0, 1)]
    if len({y for _, y in rows}) < 2:
        return base
    general, known, shared = Matcher(base), {}, _Halves()
    halves: tuple[list, list] = ([], [])
    evidence = (_Evidence(), _Evidence())
    for text, y in rows:
        words = _words(text)
        half = shared.take(_Copies.least(words), y)
        if half is None:
            continue
        known.update((w, not general.hits(w)) for w in words if w not in known)
        evidence[half].add({w for w in words if known[w]}, y, shortest, longest)
        halves[half].append((text, y))
    how, points = (shortest, longest, ratio, texts, sure), []
    for own, other in zip(halves, evidence[::-1]):
        matcher = Matcher(replace(base, stems=other.stems(*how)))
        points += [(matcher.score(t)[0], y) for t, y in own]
    return replace(base, stems=(evidence[0] + evidence[1]).stems(*how), threshold=_threshold(points, base, shared.seen, shares, alarms))


def _threshold(points: list[tuple[float, int]], base: Lexicon, seen: list[int], shares: tuple[int, int] | None, alarms: float) -> float:
    """From (score, class) of texts, ``seen`` of each class: see ``learn``."""
    points = sorted(points, key=lambda x: (-x[0], -x[1]))
    weight = [s / n for s, n in zip(shares or seen, seen)]
    all_toxic, hit, false, found = weight[1] * seen[1], 0.0, 0.0, []
    for i, (s, y) in enumerate(points):
        hit, false = hit + weight[1] * y, false + weight[0] * (1 - y)
        after = points[i + 1][0] if i + 1 < len(points) else 0.0
        if s > after and false <= alarms * weight[0] * seen[0]:
            found.append((round(2 * hit / (all_toxic + hit + false), 3), (s + after) / 2))
    return round(max(found)[1] if found else max([base.threshold, *(s for s, y in points if not y)]), 6)


def _promising(d: Column, o: Column, toxic: int, clean: int) -> Column:
    """Whether ``_Evidence.stems`` may take a beginning of ``d`` toxic and ``o`` clean texts; it decides itself, as logarithms differ in their last digits."""
    d, o = d + F.lit(0.5), o + F.lit(0.5)
    lift = F.log(d / F.lit(toxic + 1.0)) - F.log(o / F.lit(clean + 1.0))
    return (d > TEXTS) & (lift - F.lit(SURE) * F.sqrt(1 / d + 1 / o) >= F.lit(math.log(RATIO) - 1e-6))


def learned(docs: DataFrame, labels: DataFrame | None, most: int = LABELLED) -> Lexicon:
    """``learn`` on labelled documents in the order of their ids, ``most`` / 2 of each class: those with the least hash of their id. ``labels``:
    (doc_id, toxic). Rows with a null are left out; of a document's labels the greatest counts.

    The texts stay with the executors, however long they are: they go to the shared checkpoint folder. The driver gets each text's least hashes and score
    (``most`` rows at most) and the numbers of texts of those word beginnings that may become stems."""
    if labels is None:
        return GENERAL
    own = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    shares = {int(r.toxic): r["count"] for r in own.groupBy("toxic").count().collect()}
    chosen = None
    for y in (0, 1):
        half = own.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most // 2)
        chosen = half if chosen is None else chosen.unionByName(half)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most / 2 ids of each class
    texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id").groupBy("doc_id").agg(F.min("text").cast("string").alias("text"), F.min("toxic").cast("int").alias("toxic"))
    texts = cut(texts.where("text != ''").select("doc_id", F.col("doc_id").cast("string").alias("name"), "toxic", "text"))

    def hashes(batches):
        for b in batches:
            least = [_Copies.least(_words(t)).tobytes() for _, t in _each(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(least, pa.binary())], names=["doc_id", "name", "toxic", "least"])

    hashed = texts.mapInArrow(frugal(hashes), T.StructType([*texts.schema[:3], T.StructField("least", T.BinaryType())]))
    rows = sorted(hashed.collect(), key=lambda r: r.doc_id)  # most rows at most
    if len({r.toxic for r in rows}) < 2:
        return GENERAL
    shared, evidence = _Halves(), (_Evidence(), _Evidence())
    where: dict[str, int] = {}
    for r in rows:
        half = shared.take(np.frombuffer(r.least, np.uint64), r.toxic)
        if half is not None:
            where[r.name] = half
            evidence[half].number[r.toxic] += 1

    def beginnings(batches):
        general, known, counts = Matcher(GENERAL), {}, Counter()

        def counted():
            keys = list(counts)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([w for _, w in some], pa.int32()), pa.array([counts[k] for k in some], pa.int64())], names=["start", "which", "n"])
            counts.clear()

        for b in batches:
            names, classes = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, t in _each(b.column(3)):
                if names[i] not in where:
                    continue
                words = _words(t)
                if len(known) > 1_000_000:
                    known.clear()
                known.update((w, not general.hits(w)) for w in words if w not in known)
                which = 2 * where[names[i]] + classes[i]
                counts.update((k, which) for k in _Evidence.beginnings({w for w in words if known[w]}, SHORTEST, LONGEST))
                if len(counts) > 500_000:
                    yield from counted()
        yield from counted()

    held = [F.coalesce(F.sum(F.when(F.col("which") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(4)]
    found = texts.mapInArrow(frugal(beginnings), "start string, which int, n bigint").groupBy("start").agg(*held)
    (c0, t0), (c1, t1) = (e.number for e in evidence)
    n = [F.col(f"n{i}") for i in range(4)]
    found = found.where(_promising(n[1], n[0], t0, c0) | _promising(n[3], n[2], t1, c1) | _promising(n[1] + n[3], n[0] + n[2], t0 + t1, c0 + c1))
    for r in found.collect():
        for i in range(4):
            evidence[i // 2].held[i % 2][r.start] = r[f"n{i}"]
    how = (SHORTEST, LONGEST, RATIO, TEXTS, SURE)
    other = [replace(GENERAL, stems=e.stems(*how)) for e in evidence[::-1]]

    def scores(batches):
        matchers = [Matcher(x) for x in other]
        for b in batches:
            names = b.column(1).to_pylist()
            points = [(matchers[where[names[i]]].score(t)[0], i) for i, t in _each(b.column(3)) if names[i] in where]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in points], pa.float64()), b.column(2).take(pa.array([i for _, i in points], pa.int64()))], names=["score", "toxic"])

    points = [tuple(r) for r in texts.mapInArrow(frugal(scores), "score double, toxic int").collect()]  # most rows at most
    threshold = _threshold(points, GENERAL, shared.seen, (shares.get(0, 0), shares.get(1, 0)), ALARMS)
    return replace(GENERAL, stems=(evidence[0] + evidence[1]).stems(*how), threshold=threshold)


_MATCHERS: dict = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    if lexicon not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[lexicon] = Matcher(lexicon)
    return _MATCHERS[lexicon]


def _each(column: pa.Array):
    """(place, text) of all texts; some megabytes of them are decoded at once."""
    column = as_string(column)
    for at, to in slices(np.diff(buffers(column)[0])):
        yield from enumerate(column.slice(at, to - at).to_pylist(), at)


def _scores(column: pa.Array, lexicon: Lexicon):
    matcher = _matcher(lexicon)
    for i, value in _each(column):
        yield i, *(matcher.score(value) if value else (0.0, 0, 0))


def flag(docs: DataFrame, lexicon: Lexicon = GENERAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxic rows: (``key``, ``score``, ``hits``, ``words``, ``toxic`` true).

    Null and empty texts score 0; a null key stays null; repeated rows are handled one by one; texts
    are searched whole at any length; a score equal to the threshold is toxic; other columns are
    ignored; an empty table gives no rows."""
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            rows = [r for r in _scores(batch.column(1), lexicon) if r[1] >= lexicon.threshold and r[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([True] * len(rows), pa.bool_())], names=["key", "score", "hits", "words", "toxic"])

    return own.mapInArrow(frugal(run), f"key {own.schema['key'].dataType.simpleString()}, score double, hits int, words int, toxic boolean").withColumnRenamed("key", key)


def drop(docs: DataFrame, lexicon: Lexicon = GENERAL, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns. Cases: see ``flag``; null and empty texts stay."""
    own = positional(docs)
    at = int(place(docs, text)[1:])

    def run(batches):
        for batch in batches:
            for part in portions(batch, at):
                keep = [not (s >= lexicon.threshold and h) for _, s, h, _ in _scores(part.column(at), lexicon)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return own.mapInArrow(frugal(run), own.schema).toDF(*docs.columns)
