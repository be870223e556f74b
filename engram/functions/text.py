"""Text as column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: English function words; callers may give their own.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)
ABBREVIATIONS = ("approx", "cf", "dr", r"e\.g", "eq", "etc", "fig", r"i\.e", "jr", "mrs", "mr", "ms", "no", "prof", "sr", "vol", "vs")
#: Stands for a full stop that ends no sentence, and for a place to split at.
_HELD, _SPLIT = "\u0002", "\u0001"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once. Within a function over an array, an expression from outside would be worked out
    again for each of its items."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """A token for each started four bytes of UTF-8."""
    return F.ceil(F.octet_length(c) / 4).cast("bigint")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokenize(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """ASCII letters and digits of each blank-separated word, lower case, without stop words."""
    # what is dropped lies within words, so it can go before the text is split
    words = F.split(F.regexp_replace(ascii_lower(c), "[^a-z0-9 \\t\\n\\f\\r]+", ""), "[ \\t\\n\\f\\r]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


#: What lies between index terms, and the size from which a run of letters and digits is none.
ITEMS, TERM_BYTES = "[^\\p{L}\\p{N}]+", 40


def terms(c: Column) -> Column:
    """Index terms: runs of Unicode letters and digits, lower case, under TERM_BYTES bytes."""
    return F.filter(F.split(F.lower(c), ITEMS), lambda w: (w != "") & (F.octet_length(w) < TERM_BYTES))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; fewer than n tokens have none."""
    if n == 1:
        return tokens

    def runs(t: Column) -> Column:
        gram = lambda i: F.array_join(F.slice(t, i, n), " ")
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), gram)).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def ngrams_to_3(tokens: Column) -> Column:
    return let(tokens, lambda t: F.concat(t, ngrams(t, 2), ngrams(t, 3)))


def sentences(c: Column, strict: bool = False) -> Column:
    """Sentences of each line: they end at . ! ? before blanks and a capital, or at the line's end; not at a full
    stop after another one, nor behind an abbreviation. An abbreviation is found at the end of any
    word ("items." ends in "ms."), unless ``strict``."""
    edge = "\\b" if strict else ""

    def of_line(line: Column) -> Column:
        x = F.regexp_replace(line, f"(?i){edge}({'|'.join(ABBREVIATIONS)})\\.", f"$1{_HELD}")
        for _ in range(2):  # a match takes the capital along, which may be the letter before the next stop
            x = F.regexp_replace(x, f"(^|[^.{_HELD}])\\.(\\s+)(\\p{{Lu}})", f"$1.{_SPLIT}$3")
        x = F.regexp_replace(x, "([!?])(\\s+)(\\p{Lu})", f"$1{_SPLIT}$3")
        return F.transform(F.split(F.translate(x, _HELD, "."), _SPLIT), lambda s: F.trim(s))

    return F.filter(F.flatten(F.transform(F.split(c, "\n"), lambda line: of_line(F.trim(F.regexp_replace(line, "\r$", ""))))), lambda s: s != "")


def words_of(c: Column) -> Column:
    """Blank-separated words without marks at their ends; those that come out empty are left out."""
    clean = lambda w: F.regexp_replace(F.regexp_replace(w, "^[^A-Za-z0-9'\\-_:=]+|[^A-Za-z0-9'\\-_:=]+$", ""), "^[:=]+|[:=]+$", "")
    return F.filter(F.transform(F.split(c, "\\s+"), clean), lambda w: w != "")


def bigram_set(c: Column) -> Column:
    """Distinct pairs of neighbouring words, by ASCII letters and digits, lower case."""
    ws = F.filter(F.transform(F.split(F.lower(c), "\\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")
    return F.array_distinct(ngrams(ws, 2))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Of two sets: what they share against the smaller one; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def keep_start(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def keep_end(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)


def split_on_budget(c: Column, most: int) -> Column:
    """Whole lines packed into chunks of at most ``most`` characters, longer lines cut; joined they are the text
    again. ``most`` 0: one chunk. An empty text has no chunks."""
    if most <= 0:
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    lines = F.regexp_extract_all(c, F.lit(f"(?s)[^\\n]{{{most}}}|[^\\n]*\\n|[^\\n]+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(s: Column, line: Column) -> Column:
        full = (F.length(s["now"]) + F.length(line) > most) & (s["now"] != "")
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"),
            F.when(full, line).otherwise(F.concat(s["now"], line)).alias("now"),
        )

    return F.aggregate(lines, start, add, lambda s: F.when(s["now"] != "", F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))


def chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Replacements one after another, each on what the one before gave."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)
