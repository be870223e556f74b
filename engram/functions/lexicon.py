"""Lexicons: how much a text's wording speaks for remembering it."""

from __future__ import annotations

import math
import os
import string
import tempfile
import tomllib
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.lexicon_data import AFFIRMATIONS, NEGATIONS
from engram.schema import MigrationError

#: A hit doesn't count if one of so many words before it is a negator.
LOOK_BACK = 3
NEGATORS = frozenset("barely hardly wont cannot cant wasnt isnt didnt dont no never not".split())
AFFIRMED, NEGATED, HEAVIEST = 0.5, -0.3, 1.5


def normal(text: str) -> str:
    return text.lower().replace("'", "")


def is_negated(text: str, end: int | None = None) -> bool:
    """Whether one of the last words of the normalised text in front of a hit at ``end`` negates it; a part of a word that the
    hit begins in counts as a word. Only those words are looked at, backwards from the hit."""
    at = len(text) if end is None else end
    for _ in range(LOOK_BACK):
        while at and text[at - 1].isspace():
            at -= 1
        last = at
        while at and not text[at - 1].isspace():
            at -= 1
        if at == last:
            return False
        if text[at:last].rstrip(string.punctuation) in NEGATORS:
            return True
    return False


def occurs(text: str, pattern: str) -> bool:
    """Whether ``pattern`` stands in ``text``, both normalised, at least once without being negated."""
    at = text.find(pattern)
    while at >= 0:
        if not is_negated(text, at):
            return True
        at = text.find(pattern, at + 1)
    return False


@dataclass(frozen=True)
class Lexicon:
    """``terms`` with their weights, in (0, 1.5]; ``affirmations`` add 0.5 and ``negations`` take 0.3, each once a text."""

    terms: dict[str, float] = field(default_factory=dict)
    affirmations: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()

    def __post_init__(self):
        for term, weight in self.terms.items():
            if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not math.isfinite(weight) or not 0 < weight <= HEAVIEST:
                raise MigrationError(f"lexicon term {term!r} has weight {weight}; it must be above 0 and at most {HEAVIEST}")
        if any(not isinstance(p, str) or not normal(p) for p in (*self.terms, *self.affirmations, *self.negations)):
            raise MigrationError("lexicon patterns must be texts that aren't empty")

    def weighted(self) -> list[tuple[str, float]]:
        return [(normal(p), w) for p, w in (*self.terms.items(), *((p, AFFIRMED) for p in self.affirmations), *((p, NEGATED) for p in self.negations))]

    def boost(self, text: str) -> float:
        own = normal(text)
        return math.fsum(w for p, w in self.weighted() if occurs(own, p))


ENGLISH = Lexicon({}, AFFIRMATIONS, NEGATIONS)


def parse(toml: str) -> Lexicon:
    """From TOML: a table ``terms`` and lists ``patterns`` in the tables ``affirmations`` and ``negations``."""
    try:
        own = tomllib.loads(toml)
        lists = [own.get(k, {}).get("patterns", []) for k in ("affirmations", "negations")]
        terms = own.get("terms", {})
        if not isinstance(terms, dict) or not all(isinstance(x, list) for x in lists):
            raise ValueError("terms must be a table and patterns lists")
        return Lexicon(dict(terms), *map(tuple, lists))
    except (tomllib.TOMLDecodeError, AttributeError, ValueError) as e:
        raise MigrationError(f"the lexicon can't be read: {e}") from e


def read(path: str) -> Lexicon:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise MigrationError(f"the lexicon file can't be read: {e}") from e


class Scorer(ABC):
    """A boost from an entry's content; null contents get 0."""

    @abstractmethod
    def boost(self, content: Column, query: str = "") -> Column: ...


class LexiconScorer(Scorer):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def boost(self, content: Column, query: str = "") -> Column:
        """Arrow batches go to Python; the lexicon goes along with the function."""
        weighted = self.lexicon.weighted()

        def score(texts: pd.Series) -> pd.Series:
            out = []
            for text in texts:
                own = normal(text) if text else ""
                out.append(math.fsum(w for p, w in weighted if p in own and occurs(own, p)))
            return pd.Series(out, dtype="float64")

        return F.pandas_udf(score, "double")(content)


class CompositeScorer(Scorer):
    """The sum of several scorers; 0 without any."""

    def __init__(self, scorers: Iterable[Scorer]):
        self.scorers = list(scorers)

    def boost(self, content: Column, query: str = "") -> Column:
        return reduce(lambda a, b: a + b, [s.boost(content, query) for s in self.scorers], F.lit(0.0))


def _key(s: str) -> str:
    return s if s and all(c.isascii() and (c.isalnum() or c in "-_") for c in s) else _text(s)


def _text(s: str) -> str:
    escaped = "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c if ord(c) >= 32 and ord(c) != 127 else f"\\u{ord(c):04x}") for c in s)
    return f'"{escaped}"'


class LexiconFile:
    """A lexicon file that grows: each change reads it, writes a temporary file beside it and renames that. What isn't
    there yet counts as empty. Comments in the file go, but for the one that is being added."""

    def __init__(self, path: str):
        self.path = path

    def _now(self) -> Lexicon:
        return read(self.path) if os.path.exists(self.path) else Lexicon()

    def _write(self, own: Lexicon, remark: tuple[str, str] | None = None) -> None:
        lines = ["[terms]"]
        for term, weight in sorted(own.terms.items()):
            note = f"   # {' '.join(remark[1].split())}" if remark and remark[0] == term else ""
            lines.append(f"{_key(term)} = {float(weight)!r}{note}")
        for name in ("affirmations", "negations"):
            lines += ["", f"[{name}]", "patterns = ["] + [f"    {_text(p)}," for p in getattr(own, name)] + ["]"]
        folder = os.path.dirname(os.path.abspath(self.path))
        handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write("\n".join(lines) + "\n")
            os.replace(temporary, self.path)
        except OSError as e:
            raise MigrationError(f"the lexicon file can't be written: {e}") from e

    def add_term(self, term: str, weight: float, rationale: str | None = None) -> None:
        own = self._now()
        self._write(Lexicon({**own.terms, term: weight}, own.affirmations, own.negations), (term, rationale) if rationale else None)

    def remove_term(self, term: str) -> None:
        """By exact spelling; a term that isn't there is no error."""
        own = self._now()
        self._write(Lexicon({t: w for t, w in own.terms.items() if t != term}, own.affirmations, own.negations))

    def _patterns(self, name: str, change) -> None:
        own = self._now()
        lists = {k: change(getattr(own, k)) if k == name else getattr(own, k) for k in ("affirmations", "negations")}
        self._write(Lexicon(own.terms, **lists))

    def add_pattern(self, name: str, pattern: str) -> None:
        """``name``: affirmations or negations. One that differs in case alone is there already."""
        self._patterns(name, lambda ps: ps if any(p.lower() == pattern.lower() for p in ps) else (*ps, pattern))

    def remove_pattern(self, name: str, pattern: str) -> None:
        self._patterns(name, lambda ps: tuple(p for p in ps if p.lower() != pattern.lower()))


def persona_prompt(persona: str) -> str:
    """Asks a language model for a lexicon file in the words of ``persona``."""
    return (
        f"Write a TOML file that lists how the following persona marks what matters.\n\nPersona: {persona}\n\n"
        "Tables:\n"
        "- [terms]: words or short phrases of the persona's field, each with a weight above 0 and up to 1.5 (0.3 for a hint, 1.0 for what must not be lost).\n"
        '- [affirmations] with patterns = [...]: phrases with which it confirms, decides or promises.\n'
        '- [negations] with patterns = [...]: phrases with which it takes back or dismisses.\n\n'
        "Phrases are found anywhere in a text, whatever the case and without apostrophes; leave out what is part of ordinary words. "
        "A phrase within three words after a negation is skipped anyway, so list no negated forms. Give the file alone."
    )
