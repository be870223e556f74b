"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match
must contain (AND of ORs, over lower-cased bytes). Each slice of rows gets an inverted index
over the trigrams that any rule asks for: one vectorised pass over the bytes, then
postings (trigram -> rows). A rule intersects and unites its postings, and its regular
expression runs over the remaining rows only. Rules without mandatory trigrams scan every row.

The index is built beside the rows that it points to, as segments of a search engine are, so
that candidates need no shuffle to meet their texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import as_string, buffers, pick, slices


@dataclass(frozen=True)
class Rule:
    """``pattern``: in the dialect that Python's ``re`` with ASCII classes and RE2 share. Repetitions are open, unless a
    kind of secret has one length: a cap would lose or cut what is longer."""

    name: str
    pattern: str


_HEAD = "-----BEGIN "
RULES = (
    Rule("assigned-token", r'\b[Tt]oken\s*[=:]\s*"[0-9A-Fa-f]{32,}"'),
    Rule("assigned-secret", r"""(?i)\b(?:secret|passwd|password|api_?key)\s*[=:]\s*["'][^"'\s]{8,}["']"""),
    Rule("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("github-token", r"\bgh[oprsu]_[0-9A-Za-z]{36,}\b"),
    Rule("slack-token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe-key", r"\b[rs]k_live_[0-9A-Za-z]{16,}\b"),
    Rule("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("web-token", r"\beyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
    Rule("pem-private-key", _HEAD + r"(?:[A-Z]{2,} )*PRIVATE KEY-----"),
    Rule("url-password", r"\b[a-z]{2,}://[0-9A-Za-z._-]+:[^@\s/]{3,}@[0-9A-Za-z.-]{3,}"),
    Rule("bare-hex", r"\b[0-9a-f]{40}\b"),
)

# -- from a regular expression to a Boolean query: None (always true), or a tuple of clauses
#    that must all hold, each a frozenset of trigrams of which one must occur

EXACT_MOST, CLAUSE_MOST = 64, 64
Query = tuple


def _lower(c: int) -> bytes:
    return chr(c).lower().encode() if c < 128 else chr(c).encode()


def _trigrams(s: bytes) -> set[bytes]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _of_string(s: bytes) -> set[frozenset]:
    return {frozenset([t]) for t in _trigrams(s)}


def _either(options: list[set[frozenset]]) -> set[frozenset]:
    """Clauses that hold whichever of the options does."""
    if not all(options):
        return set()
    out = set.intersection(*options)
    rest = [o - out for o in options]
    if all(rest):  # one clause of each option, the smallest
        best = frozenset().union(*[min(r, key=lambda x: (len(x), sorted(x))) for r in rest])
        if len(best) <= CLAUSE_MOST:
            out = out | {best}
    return out


class _Info:
    """What is known of a part's matches: all of them (``exact``), or clauses and the last and first
    bytes that each may have."""

    def __init__(self, exact=None, clauses=(), heads=None, tails=None):
        self.exact, self.clauses = exact, set(clauses)
        self.heads, self.tails = heads, tails  # sets of byte strings, None: anything

    def open(self) -> _Info:
        """The same with nothing exact."""
        if self.exact is None:
            return self
        clauses = _either([_of_string(s) for s in self.exact])
        return _Info(None, clauses, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact})


def _then(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT_MOST:
        both = {x + y for x in a.exact for y in b.exact}
        if max(map(len, both)) <= 64:
            return _Info(both)
    tails = a.exact if a.exact is not None else a.tails
    heads = b.exact if b.exact is not None else b.heads
    x, y = a.open(), b.open()
    clauses = x.clauses | y.clauses
    if tails is not None and heads is not None and len(tails) * len(heads) <= CLAUSE_MOST:
        clauses |= _either([_of_string(s[-2:] + t[:2]) for s in tails for t in heads])
    first = heads0 = a.exact if a.exact is not None else a.heads
    if a.exact is not None and heads is not None and min(map(len, a.exact), default=0) < 2:
        first = {s + t for s in a.exact for t in heads} if len(a.exact) * len(heads) <= CLAUSE_MOST else None
    elif a.exact is not None and heads is None and min(map(len, a.exact), default=0) < 2:
        first = heads0 if heads0 and min(map(len, heads0)) > 0 else None
    last = b.exact if b.exact is not None else b.tails
    if b.exact is not None and min(map(len, b.exact), default=0) < 2:
        if tails is not None and len(tails) * len(b.exact) <= CLAUSE_MOST:
            last = {s + t for s in tails for t in b.exact}
        elif min(map(len, b.exact), default=0) == 0:
            last = None
    return _Info(None, clauses, first and {s[:2] for s in first}, last and {s[-2:] for s in last})


def _chars(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, av in items:
        op = str(op)
        if op == "LITERAL":
            out.add(_lower(av))
        elif op == "RANGE" and av[1] - av[0] < EXACT_MOST:
            out |= {_lower(c) for c in range(av[0], av[1] + 1)}
        else:  # negations, classes such as \s
            return None
    return out if 0 < len(out) <= 16 else None


def _info(parsed) -> _Info:
    out = _Info({b""})
    for op, av in parsed:
        op = str(op)
        if op == "LITERAL":
            part = _Info({_lower(av)})
        elif op == "IN":
            chars = _chars(av)
            part = _Info(chars) if chars else _Info(None)
        elif op == "SUBPATTERN":
            part = _info(av[3])
        elif op == "BRANCH":
            options = [_info(x) for x in av[1]]
            if all(o.exact is not None for o in options) and sum(len(o.exact) for o in options) <= EXACT_MOST:
                part = _Info(set().union(*[o.exact for o in options]))
            else:
                opened = [o.open() for o in options]
                part = _Info(None, _either([o.clauses for o in opened]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = av
            one = _info(sub)
            if low == 0 and high == 1 and one.exact is not None:
                part = _Info(one.exact | {b""})
            elif low == 0:
                part = _Info(None)
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _then(part, one)
                if high != low or low > 4:
                    part = _then(part, _Info(None)) if low <= 4 else _then(_then(part, _Info(None)), one)
        elif op == "AT":
            part = _Info({b""})
        else:  # ANY, NOT_LITERAL, assertions ...
            part = _Info(None)
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> tuple[frozenset, ...]:
    """Clauses of trigrams of the lower-cased text: every match of ``pattern`` lies in a text
    that has at least one trigram of each clause. Empty: no trigram is mandatory."""
    clauses = _info(sre.parse(pattern)).open().clauses
    least = {c for c in clauses if not any(d < c for d in clauses)}
    return tuple(sorted(least, key=lambda c: (len(c), sorted(c))))


# -- the index of a slice of rows

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Plan:
    """Rules with compiled expressions and queries over numbered trigrams."""

    def __init__(self, rules):
        self.rules = [(r.name, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        grams = sorted({t for _, _, q in self.rules for c in q for t in c})
        self.number = {t: i for i, t in enumerate(grams)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, offsets: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """For each trigram the rows, ascending, whose bytes have it."""
        n = len(self.number)
        if len(raw) < 3:
            return [np.zeros(0, np.int64)] * n
        low = _FOLD[raw].astype(np.uint32)
        hit = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(hit >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(hit[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        gram, row = pairs // len(offsets), pairs % len(offsets)
        ends = np.searchsorted(gram, np.arange(n + 1))
        return [row[ends[i] : ends[i + 1]] for i in range(n)]

    def candidates(self, query, postings: list[np.ndarray], rows: int) -> np.ndarray:
        found = None
        for clause in query:
            own = np.unique(np.concatenate([postings[self.number[t]] for t in clause]))
            found = own if found is None else np.intersect1d(found, own, assume_unique=True)
            if not len(found):
                break
        return np.arange(rows) if found is None else found


_PLANS: dict = {}


def _plan(rules) -> Plan:
    if rules not in _PLANS:
        _PLANS[rules] = Plan(rules)
    return _PLANS[rules]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All matches of all rules: (``key``, ``rule``, ``match_no`` from 1 for each row and rule,
    ``start`` in characters from 0, ``n_chars``, ``fingerprint`` SHA-256 of the secret).

    The secret itself isn't given out. Null and empty texts have no matches; a null key stays
    null; repeated rows give repeated matches; texts are searched whole at any length; other
    columns are ignored; an empty table gives no rows.
    """
    rules = tuple(rules)
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string"))
    key_type = own.schema["key"].dataType.simpleString()

    def run(batches):
        plan = _plan(rules)
        for batch in batches:
            keys, column = batch.column(0), as_string(batch.column(1))
            offsets, raw = buffers(column)
            out: list[list] = [[], [], [], [], [], []]
            for at, to in slices(np.diff(offsets)):
                local = offsets[at : to + 1] - offsets[at]
                postings = plan.postings(local, raw[offsets[at] : offsets[to]])
                for name, expression, query in plan.rules:
                    for i in plan.candidates(query, postings, to - at).tolist():
                        value = column[at + i].as_py()
                        if not value:
                            continue
                        for no, m in enumerate(expression.finditer(value), 1):
                            for x, v in zip(out, (at + i, name, no, m.start(), m.end() - m.start(), hashlib.sha256(m[0].encode("utf-8", "surrogatepass")).hexdigest())):
                                x.append(v)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), *[pa.array(x, pa.int32()) for x in out[2:5]], pa.array(out[5], pa.string())], names=["key", "rule", "match_no", "start", "n_chars", "fingerprint"])

    return own.mapInArrow(run, f"key {key_type}, rule string, match_no int, start int, n_chars int, fingerprint string").withColumnRenamed("key", key)


def scan_sql(rules: tuple[Rule, ...] = RULES, key: str = "doc_id", table: str = "documents") -> str:
    """The same by running every expression over every text, in DuckDB's SQL."""
    parts = []
    for r in rules:
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT {key}, '{r.name}' AS rule, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS rest FROM {table} WHERE regexp_matches(text, '{p}')"
        )
    return (
        "WITH hits AS (" + " UNION ALL ".join(parts) + "), nth AS (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM hits) "
        f"SELECT {key}, rule, n::INT AS match_no, (list_sum(list_transform(rest[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n-1], lambda x: length(x))), 0))::INT AS start, "
        "length(found[n])::INT AS n_chars, sha256(found[n]) AS fingerprint FROM nth"
    )
