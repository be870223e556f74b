"""Quality by weak supervision.

Rules look at each text and vote good, bad or abstain. How accurate each rule is gets estimated
from how the votes agree, by expectation-maximisation of a model in which the votes are
independent given the (unseen) class; a document's weight is then its posterior probability of being
good, in place of demanding that all rules pass. Only the numbers of documents with each combination
of votes enter: the table of combinations is bounded by 3 to the number of rules, whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import as_string, buffers, cut, frugal, pick, place, portions, positional, slices

GOOD, BAD, ABSTAIN = 1, 2, 0


@dataclass
class Measures:
    """Of a whole text. Bytes: letters of other scripts than Latin count by their bytes."""

    words: int
    distinct: int  # words
    pairs: int  # distinct pairs of neighbouring words
    top: int  # occurrences of the most frequent word
    bare: int  # words of marks alone
    clinging: int  # words that end in two marks or more
    size: int  # bytes that aren't blank
    letters: int
    upper: int
    marks: int  # of kinds that prose hardly has
    digits: int
    stops: int


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``bad`` holds, else good if ``good`` does, else abstains."""

    name: str
    bad: Callable[[Measures], bool]
    good: Callable[[Measures], bool]


#: Repetition shows against the square root of the length, as a long text repeats its vocabulary anyway.
RULES = (
    Rule("nothing", lambda m: m.words == 0, lambda m: False),
    Rule("vocabulary", lambda m: m.words >= 20 and m.distinct < min(0.25 * m.words, 2.5 * sqrt(m.words)), lambda m: m.words >= 20 and m.distinct > min(0.4 * m.words, 4 * sqrt(m.words))),
    Rule("word pairs", lambda m: m.words >= 20 and m.pairs < 0.45 * m.words, lambda m: m.words >= 20 and m.pairs > 0.7 * m.words),
    Rule("one word", lambda m: m.words >= 20 and m.top > max(6, 0.22 * m.words), lambda m: m.words >= 20 and m.top < 0.16 * m.words),
    Rule("marks", lambda m: m.words >= 3 and m.marks > 0.6 * m.words, lambda m: m.words >= 3 and m.marks < 0.15 * m.words),
    Rule("letters", lambda m: m.words >= 3 and m.letters < 0.78 * (m.size - m.digits), lambda m: m.words >= 3 and m.letters > 0.85 * (m.size - m.digits)),
    Rule("clinging marks", lambda m: m.words >= 3 and m.clinging > 0.25 * m.words, lambda m: m.words >= 3 and m.clinging < 0.05 * m.words),
    Rule("upper case", lambda m: m.words >= 3 and m.upper > 0.4 * max(m.letters, 1), lambda m: m.words >= 3 and m.upper < 0.15 * m.letters),
    Rule("bare marks", lambda m: m.words >= 8 and m.bare > 0.2 * m.words, lambda m: m.words >= 8 and m.bare < 0.03 * m.words),
    Rule("sentences", lambda m: m.words >= 60 and m.stops < 0.012 * m.words, lambda m: m.words >= 20 and 0.02 * m.words <= m.stops <= 0.4 * m.words),
    Rule("digits", lambda m: m.words >= 20 and m.digits > 0.3 * m.size, lambda m: False),
)

_LETTER, _UPPER, _MARK, _DIGIT, _STOP, _SPACE = (1 << i for i in range(6))
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = _LETTER
for _c in range(128):
    _x = chr(_c)
    _CLASS[_c] = _LETTER * _x.isalpha() | _UPPER * _x.isupper() | _MARK * (_x in "#$%&*|!<>{}[]~^=_\\") | _DIGIT * _x.isdigit() | _STOP * (_x in ".!?") | _SPACE * _x.isspace()
_MARKS = frozenset("#$%&*|!<>{}[]~^=_\\+-/.,;:?\"'()@`")


def measure(texts: list[str], offsets: np.ndarray, raw: np.ndarray) -> list[Measures]:
    """``offsets`` and ``raw``: the same texts in UTF-8."""
    kind = _CLASS[raw]
    sums = []
    for k in (_LETTER, _UPPER, _MARK, _DIGIT, _STOP, _SPACE):
        at = np.flatnonzero(kind & k)
        sums.append(np.diff(np.searchsorted(at, offsets)).tolist())
    sizes = np.diff(offsets).tolist()
    out = []
    for i, text in enumerate(texts):
        words = text.split()
        count = Counter(words)
        bare = clinging = 0
        for w, n in count.items():
            if w[-1] in _MARKS:
                if len(w) > 1 and w[-2] in _MARKS and not w.strip(_STRIP) == "":
                    clinging += n
                elif not w.strip(_STRIP):
                    bare += n
        letters, upper, marks, digits, stops, spaces = (s[i] for s in sums)
        out.append(Measures(len(words), len(count), len(set(zip(words, words[1:]))), max(count.values(), default=0), bare, clinging, sizes[i] - spaces, letters, upper, marks, digits, stops))
    return out


_STRIP = "".join(sorted(_MARKS))


def pattern(m: Measures, rules: tuple[Rule, ...]) -> int:
    """The votes as a number in base 3, rule 0 last. There is room for 39 rules."""
    return sum((BAD if r.bad(m) else GOOD if r.good(m) else ABSTAIN) * 3**i for i, r in enumerate(rules))


def _patterns(column: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    if len(rules) > 39:
        raise ValueError("39 rules at most")
    column = as_string(column)
    offsets, raw = buffers(column)
    out = np.zeros(len(column), np.int64)
    for at, to in slices(np.diff(offsets)):
        texts = [t or "" for t in column.slice(at, to - at).to_pylist()]
        own = measure(texts, offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]])
        out[at:to] = [pattern(m, rules) for m in own]
    return out


@dataclass(frozen=True)
class Model:
    """``prior`` of good; ``good[j]`` and ``bad[j]``: chance that rule j's vote is BAD in either class, if it votes.
    Abstaining says nothing."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = unpack(patterns, len(self.good))
        odds = np.log(self.prior) - np.log1p(-self.prior)
        odds = odds + ((v == BAD) * np.log(self.good / self.bad) + (v == GOOD) * np.log((1 - self.good) / (1 - self.bad))).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def unpack(patterns: np.ndarray, rules: int) -> np.ndarray:
    return np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(rules) % 3


#: Where estimation starts, and what it is held to with the weight HOLD of all documents: the chance of a BAD vote
#: among good documents and among bad ones, the share of good ones.
START, HOLD = (0.01, 0.5, 0.85), 0.02


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Maximum a posteriori from START. A rule never counts for the wrong side: its BAD votes aren't taken to be
    more frequent among good documents. Without documents the start is the result."""
    v = unpack(patterns, rules)
    n = np.asarray(counts, float)
    hold = 1 + HOLD * n.sum()
    model = Model(START[2], np.full(rules, START[0]), np.full(rules, START[1]))
    for _ in range(rounds if len(n) else 0):
        p = model.posterior(patterns)
        rates = []
        for weight, begin in ((p * n, START[0]), ((1 - p) * n, START[1])):
            voted = ((v != ABSTAIN) * weight[:, None]).sum(0)
            rates.append((((v == BAD) * weight[:, None]).sum(0) + hold * begin) / (voted + hold))
        good, bad = rates
        pooled = (good + bad) / 2
        good, bad = np.where(good > bad, pooled, good), np.where(good > bad, pooled, bad)
        new = Model(float(((p * n).sum() + hold * START[2]) / (n.sum() + hold)), good, bad)
        moved = max(np.abs(new.good - model.good).max(), np.abs(new.bad - model.bad).max(), abs(new.prior - model.prior))
        model = new
        if moved < tolerance:
            break
    return model


def _posteriors(spark, counted: list, rules: int) -> DataFrame:
    patterns = np.array([r[0] for r in counted], np.int64)
    model = expectation_maximisation(patterns, np.array([r[1] for r in counted], float), rules)
    p = model.posterior(patterns) if len(patterns) else np.zeros(0)
    return F.broadcast(spark.createDataFrame([(int(a), float(b)) for a, b in zip(patterns, np.round(p, 9))], "q_pattern bigint, quality double"))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``votes`` like "+-0" in the rules' order, ``quality`` posterior probability, ``keep``) of every row.

    The texts are read once: the combinations of votes go to the shared checkpoint folder, are counted over
    all rows and joined with their posteriors (at most 3 to the number of rules, broadcast).
    A null text counts as empty: one rule votes bad, all others abstain; a null key stays null; repeated rows count
    each; ``quality`` equal to ``least`` is kept; other columns are ignored; an empty table gives no rows.
    """
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_patterns(batch.column(1), rules))], names=["key", "q_pattern"])

    own = cut(own.mapInArrow(frugal(run), T.StructType([own.schema["key"], T.StructField("q_pattern", T.LongType())])))
    counted = sorted(own.groupBy("q_pattern").count().collect())  # bounded by the number of rules
    spelt = F.concat(*[F.element_at(F.array(F.lit("0"), F.lit("+"), F.lit("-")), (F.floor(F.col("q_pattern") / 3**i) % 3 + 1).cast("int")) for i in range(len(rules))])
    return own.join(_posteriors(docs.sparkSession, counted, len(rules)), "q_pattern").select(F.col("key").alias(key), spelt.alias("votes"), "quality", (F.col("quality") >= least).alias("keep"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose posterior is ``least`` at least, with all their columns. Cases: see ``score``.

    The texts are read once: rows go to the shared checkpoint folder with their votes."""
    own = positional(docs)
    at = int(place(docs, text)[1:])

    def run(batches):
        for batch in batches:
            for part in portions(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_patterns(part.column(at), rules))], names=[*part.schema.names, "q_pattern"])

    own = cut(own.mapInArrow(frugal(run), T.StructType([*own.schema, T.StructField("q_pattern", T.LongType())])))
    counted = sorted(own.groupBy("q_pattern").count().collect())  # bounded by the number of rules
    kept = _posteriors(docs.sparkSession, counted, len(rules)).where(F.col("quality") >= least)
    return own.join(kept, "q_pattern", "left_semi").drop("q_pattern").toDF(*docs.columns)
