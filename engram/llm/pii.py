"""Personal data by a linear-chain conditional random field over word shapes.

Words (runs without blanks, quotes, brackets, commas and the like) are reduced to a core without clinging punctuation, and the core to
a shape: ``a`` for lower case, ``A`` for upper case, ``9`` with the run's length for digits, marks as
they are. A label's score is a sum of weights of the shape's features at the word, before it
and after it, plus a weight for each pair of neighbouring labels. The weights come from a
small labelled table by gradient ascent on the penalised log likelihood (forward-backward in
numpy); Viterbi decodes padded batches of sequences in numpy.

Plain words (letters or marks alone) between plain words are nearly always outside. After
training it is proved from the weights whether the middle ones of four of them must be,
whatever stands around; if so, a sequence may be cut there without changing the best path. Then only the stretches around other words go through Viterbi, which finds the
same labels as over whole texts.
"""

from __future__ import annotations

import itertools
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import as_string, buffers, frugal, pick, place, positional, slices

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Words of the labelled table that training reads at most.
TRAIN_WORDS = 60_000
#: Besides blanks these end a word, so that an address in a line of CSV or JSON is a word of its own; a comma before three digits of a
#: number doesn't.
_BREAKS = r'\s,;"<>{}\[\]|'
_INNER = f"[^{_BREAKS}]+(?:(?<=[0-9]),(?=[0-9]{{3}}(?![0-9]))[^{_BREAKS}]+)*"
WORD = re.compile(_INNER)
_EDGE_LEFT = re.compile(r"^[^\w+(]+")


# -- shapes and features


def core(word: str) -> tuple[int, int]:
    """(start, end) of the word without clinging punctuation; (0, 0) if nothing is left."""
    m = _EDGE_LEFT.match(word)
    start, end = m.end() if m else 0, len(word)
    while end > start and not (word[end - 1] in "_)" or word[end - 1].isalnum()):
        end -= 1
    return (start, end) if end > start else (0, 0)


_SIGN = re.compile(r"[0-9@+]")
_RUNS = re.compile(r"[^\W\d_A-Z]+|[A-Z]+|[0-9]+|[\s\S]")


def _run(m: re.Match) -> str:
    x = m[0]
    if "0" <= x[0] <= "9":
        n = len(x)
        return f"9{{{n if n <= 4 else '5-6' if n <= 6 else '7-8' if n <= 8 else '9-12' if n <= 12 else '13-19' if n <= 19 else '20+'}}}"
    if x.isalpha():
        return "A" if x[0].isupper() else "a"
    return x


def shape(word: str) -> str:
    """The shape of a word's core; '' for marks alone, 'w' for one without digits, @ and +."""
    start, end = core(word)
    own = word[start:end]
    if not own:
        return ""
    if not _SIGN.search(own):
        return "w"
    return _RUNS.sub(_run, own)


_IP = re.compile(r"9\{[123]\}(\.9\{[123]\}){3}")
_MAIL = re.compile(r"[^@]*[aAwz9}]@[aA9][^@]*\.[aA]+")


def features(s: str) -> list[str]:
    """Names of a shape's features; a shape not seen in training still has the others."""
    if s in ("", "w"):
        return ["bias", f"s={s}"]
    out = ["bias", f"s={s}", f"t={re.sub(r'[aA]+', 'a', s)}", "mixed"]
    groups = re.findall(r"9\{([^}]*)\}", s)
    digits = sum(int(re.split(r"[-+]", g)[0]) for g in groups)
    out += [f"groups={min(len(groups), 5)}", f"digits={digits if digits < 5 else '5-8' if digits < 9 else '9-12' if digits < 13 else '13-19' if digits < 20 else '20+'}"]
    if groups and not re.search(r"[aA]", s):
        out.append("no letters")
    if "@" in s:
        out += ["at", "mail" if _MAIL.fullmatch(s) else "at, no mail"]
    if _IP.fullmatch(s):
        out.append("quad")
    if s[0] in "+(":
        out.append(f"first={s[0]}")
    for c in "-./:":
        if c in s:
            out.append(f"has={c}")
    return out


# -- the labelled table


def labelled_rows(sentences: int = 700, seed: int = 7) -> list[tuple[int, int, str, str]]:
    """(sentence, position, word, label) of made-up sentences: words of several scripts and cases, personal
    data of each kind, and look-alikes outside (dates, versions, prices, times, hashes, addresses of pages)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    bits = "an er the ion est ver ung ment que ado über ção él ñu бе ла го mo ka sun riv lem tor".split()
    letters = lambda: "".join(pick(bits) for _ in range(int(rng.integers(1, 4))))

    def word() -> str:
        w = letters()
        r = rng.random()
        w = w.upper() if r < 0.15 else w.capitalize() if r < 0.3 else w
        return w + (pick([",", ".", ";", "!!", "%%%", "***", "?"]) if rng.random() < 0.2 else "")

    def personal(kind: str) -> list[str]:
        if kind == "EMAIL":
            user = pick([letters(), f"{letters()}.{letters()}", f"{letters()}.{d(2)}", f"{letters()}_{letters()}{d(1)}", f"{letters()}+{letters()}", f"{d(3)}{letters()}", f".{d(2)}"])
            host = pick([letters(), f"{letters()}{d(1)}", f"{letters()}-{letters()}", f"{letters()}{d(1)}.{letters()}", f"{letters()}.{letters()}"])
            x = f"{user}@{host}.{pick(['com', 'org', 'net', 'de', 'co.uk', 'io'])}"
            return [x.upper() if rng.random() < 0.2 else x]
        if kind == "PHONE":
            a, b, c = d(3), d(3), d(4)
            return pick([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{d(2)}", a, b, c], [f"+1-{a}-{b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"+{d(2)}", d(3), d(7)], [f"+1{a}{b}{c}"], [f"({a}){b}-{c}"]])
        if kind == "IP":
            return [".".join(str(x) for x in rng.integers(0, 256, 4)) + (f":{d(4)}" if rng.random() < 0.1 else "")]
        if kind == "CARD":
            return pick([[d(16)], [d(16)], [d(15)], [d(4), d(4), d(4), d(4)], [f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]])
        if kind == "SSN":
            return [f"{d(3)}-{d(2)}-{d(4)}"]
        return pick([[f"{pick(['DE', 'FR', 'ES', 'GB'])}{d(20)}"], [f"{pick(['DE', 'FR', 'ES'])}{d(2)}", d(4), d(4), d(4), d(4), d(2)]])

    def alike() -> list[str]:
        return pick([
            [f"{d(4)}-{d(2)}-{d(2)}"], [f"{d(2)}.{d(2)}.{d(4)}"], [f"{d(1)}.{d(1)}."], [f"v{d(1)}.{d(1)}.{d(2)}"], [f"{d(1)}.{d(2)}.{d(1)}"], [f"{d(2)}:{d(2)}"], [f"${d(2)}.{d(2)}"], [d(1)], [d(2)], [d(3)], [d(4)], [d(5)], [d(6)],
            [f"({d(4)})"], [f"({d(1)})"], [f"[{d(2)}]"], [f"{d(2)}%"], [f"{d(1)},{d(3)}"], [f"{d(1)},{d(3)},{d(3)}"], ['"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"'], ["".join(pick("0123456789abcdef") for _ in range(12))],
            ["token", "=", '"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"'], [f"https://{letters()}.com/{letters()}?{letters()}={d(3)}"], [f"{letters()}{d(1)}"], [f"{d(2)}th"], [f"@{letters()}"], [f"{letters()}@"], [f"{d(1)}/{d(1)}"], [f"{d(3)}x{d(3)}"], ["+", d(1)], [f"+{d(1)}%"], [f"{d(4)}-{d(4)}"], [f"Fig.{d(1)}"], [f"CC", "BY-NC", f"{d(1)}.{d(1)}."], ["Version", f"{d(1)}.{d(1)}."], [f"({letters()})"], [f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"], [d(20)], [d(24)],
        ])

    out = []
    for s in range(sentences):
        row: list[tuple[str, str]] = []
        noise = pick(["", "", "", "###", "%%%", "!!"]) if rng.random() < 0.4 else ""
        table = rng.random() < 0.15
        for _ in range(int(rng.integers(1, 4))):
            row += [(word(), "O") for _ in range(int(rng.integers(0, 5)))]
            r = rng.random()
            if r < 0.62:
                kind = pick(KINDS)
                for i, w in enumerate(personal(kind)):
                    if i and table:
                        row.append(("|", f"I-{kind}"))
                    row.append((w + (pick(["", "", "", ",", "."]) if rng.random() < 0.3 and w[-1].isdigit() and i == 0 and len(w) > 6 else noise), f"{'I' if i else 'B'}-{kind}"))
            elif r < 0.95:
                row += [(w + noise, "O") for w in alike()]
        row += [(word(), "O") for _ in range(int(rng.integers(0, 4)))]
        if rng.random() < 0.25:  # tables and rules
            row = [x for w in row for x in ([w, ("|", "O")] if w[1] == "O" else [w])]
            at = int(rng.integers(0, len(row) + 1))
            if at == len(row) or row[at][1][0] != "I":
                row[at:at] = [(pick(["|", "***", "--", "%%%"]), "O") for _ in range(int(rng.integers(2, 6)))]
        out += [(s, i, w, t) for i, (w, t) in enumerate(row)]
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence bigint, position int, word string, label string")


# -- the model


class Field:
    """Weights: ``here``, ``before``, ``after`` (feature -> a score for each label), ``step`` (label, next label),
    ``first``."""

    def __init__(self, vocabulary: dict[str, int], theta: list[np.ndarray]):
        self.vocabulary = vocabulary
        self.here, self.before, self.after, self.step, self.first = theta
        self.by_shape: dict[str | tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.by_word: dict[str, int] = {}
        # 0: beyond the end; its scores are those of a plain word
        for s in ("w", "", "w"):
            self.place_of(s)
        self.cuts = self._provable()

    def place_of(self, s: str) -> int:
        at = self.by_shape.get(s)
        if at is None:
            own = [self.vocabulary[f] for f in features(s) if f in self.vocabulary]
            kept = s if len(s) < 200 else tuple(own)  # long shapes of equal features are one, they'd fill the memory
            at = self.by_shape.get(kept)
            if at is None:
                at = self.by_shape[kept] = len(self.rows)
                self.rows.append(np.stack([w[own].sum(0) for w in (self.here, self.before, self.after)]))
        return at

    def word(self, w: str) -> int:
        """Number of the word's shape."""
        at = self.by_word.get(w)
        if at is None:
            if len(self.by_word) > 200_000:
                self.by_word.clear()
            at = self.place_of(shape(w))
            if len(w) < 64:
                self.by_word[w] = at
        return at

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """(..., labels) for sequences of shape numbers whose ends lie between plain words."""
        e = np.stack(self.rows)
        edge = np.full(shapes.shape[:-1] + (1,), self.by_shape["w"])
        left, right = np.concatenate([edge, shapes[..., :-1]], -1), np.concatenate([shapes[..., 1:], edge], -1)
        return e[shapes, 0] + e[left, 1] + e[right, 2]

    def _provable(self) -> bool:
        """Whether the two middle ones of four plain words between plain words are O on a best path,
        whatever the labels before and after them, also at either end of a text."""
        plain = [self.rows[self.by_shape[s]] for s in ("w", "")]
        outside = np.where(np.arange(len(LABELS)) == 0, 0.0, -np.inf)
        for run in itertools.product(plain, repeat=6):
            e = [h[0] + l[1] + r[2] for l, h, r in zip(run, run[1:], run[2:])]
            for before in (self.step + e[0], np.tile(self.first + e[0], (len(LABELS), 1))):
                for after in (self.step, np.zeros((len(LABELS), 1))):
                    free = kept = before
                    for turn in range(1, 4):
                        free = (free[:, :, None] + self.step).max(1) + e[turn]
                        kept = (kept[:, :, None] + self.step).max(1) + e[turn] + (outside if turn < 3 else 0)
                    free, kept = ((x[:, :, None] + after).max(1) for x in (free, kept))
                    if (kept < free - 1e-9).any():
                        return False
        return True

    def viterbi(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch: score (n, longest, labels). Ties go to the earlier label."""
        n, longest, k = score.shape
        back = np.zeros((n, longest, k), np.int8)
        best = self.first + score[:, 0]
        for t in range(1, longest):
            through = best[:, :, None] + self.step
            back[:, t] = through.argmax(1)
            new = through.max(1) + score[:, t]
            best = np.where((t < length)[:, None], new, best)
        out = np.zeros((n, longest), np.int8)
        out[np.arange(n), length - 1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            go = t < length
            out[go, t - 1] = back[go, t, out[go, t]]
        return out


def _padded(sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(length.max())), np.int64)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out, length


def fit(rows: list[tuple[int, int, str, str]], rounds: int = 160, penalty: float = 2e-4, lead: float = 1.0) -> Field:
    """Trains on (sentence, position, word, label) rows; rows with a null or an unknown label are left out, so are
    null words. ``lead``: added to the score of O on plain words, which the labelled table has few of."""
    sentences: dict = {}
    for s, p, w, t in sorted((r for r in rows if None not in r and r[3] in LABELS), key=lambda r: (r[0], r[1])):
        sentences.setdefault(s, []).append((shape(w), LABELS.index(t)))
    if not sentences:
        raise ValueError("no labelled words")
    vocabulary: dict[str, int] = {}
    for seq in sentences.values():
        for s, _ in [("w", 0), ("", 0), *seq]:
            for f in features(s):
                vocabulary.setdefault(f, len(vocabulary))
    shapes: dict[str, int] = {}
    for s in ["w", *(s for seq in sentences.values() for s, _ in seq)]:
        shapes.setdefault(s, len(shapes))
    has = np.zeros((len(shapes), len(vocabulary)), np.float64)
    for s, i in shapes.items():
        has[i, [vocabulary[f] for f in features(s)]] = 1
    x, length = _padded([[shapes[s] for s, _ in seq] for seq in sentences.values()])
    y, _ = _padded([[t for _, t in seq] for seq in sentences.values()])
    n, longest = x.shape
    k = len(LABELS)
    edge = np.full((n, 1), shapes["w"])
    on = np.arange(longest) < length[:, None]
    x = np.where(on, x, shapes["w"])
    around = [x, np.concatenate([edge, x[:, :-1]], 1), np.concatenate([x[:, 1:], edge], 1)]
    theta = [np.zeros((len(vocabulary), k)) for _ in range(3)] + [np.zeros((k, k)), np.zeros(k)]
    # I may follow only B or I of its own kind
    barred = np.zeros((k, k))
    for b in range(k):
        if LABELS[b][0] == "I":
            for a in range(k):
                if LABELS[a][1:] != LABELS[b][1:]:
                    barred[a, b] = -30
    bar_first = np.array([-30.0 if t[0] == "I" else 0.0 for t in LABELS])
    gold = np.eye(k)[y] * on[..., None]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
    starts = np.bincount(y[:, 0], minlength=k).astype(float)
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def counts(index: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values summed by index."""
        return np.stack([np.bincount(index, values[:, j], len(shapes)) for j in range(k)], 1)

    for turn in range(1, rounds + 1):
        through, first = np.exp(theta[3] + barred), theta[4] + bar_first
        score = sum((has @ w)[a] for w, a in zip(theta[:3], around))
        local = np.exp(score - score.max(2, keepdims=True))
        fore, hind = np.zeros((n, longest, k)), np.ones((n, longest, k))
        begin = np.exp(first - first.max()) * local[:, 0]
        fore[:, 0] = begin / begin.sum(1, keepdims=True)
        for t in range(1, longest):
            new = (fore[:, t - 1] @ through) * local[:, t]
            fore[:, t] = np.where(on[:, t, None], new / new.sum(1, keepdims=True), fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = (local[:, t + 1] * hind[:, t + 1]) @ through.T
            hind[:, t] = np.where(on[:, t + 1, None], new / new.sum(1, keepdims=True), 1)
        marginal = fore * hind
        marginal = marginal / marginal.sum(2, keepdims=True) * on[..., None]
        right = local[:, 1:] * hind[:, 1:] * on[:, 1:, None]
        total = np.einsum("ntk,ntk->nt", fore[:, :-1] @ through, right)
        right = right / np.where(total > 0, total, 1)[..., None]
        joint = np.tensordot(fore[:, :-1], right, ([0, 1], [0, 1])) * through
        miss = gold - marginal
        grads = [has.T @ counts(a[on], miss[on]) for a in around]
        grads += [pairs - joint, starts - marginal[:, 0].sum(0)]
        for i, g in enumerate(grads):
            g = g / n - penalty * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.12 * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)
    theta[0][vocabulary["s=w"], 0] += lead
    theta[0][vocabulary["s="], 0] += lead
    theta[3] = theta[3] + barred
    theta[4] = theta[4] + bar_first
    return Field(vocabulary, theta)


# -- decoding texts


#: Words that aren't letters or marks alone.
_ODD = re.compile(f"(?<![^{_BREAKS}])[^{_BREAKS}0-9@+]*[0-9@+][^{_BREAKS}]*(?:(?<=[0-9]),(?=[0-9]{{3}}(?![0-9]))[^{_BREAKS}]+)*")
_BREAK = re.compile(f"[{_BREAKS}]")
#: Up to so many plain words between two odd words belong to one sequence; else each takes REACH of them.
GAP, REACH = 5, 3
#: Padded cells of a batch for Viterbi at most (one sequence at least).
CELLS = 200_000


def spans(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in characters, ascending, for each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    sequences: list[tuple[int, list[tuple[int, int]], list[int], tuple[bool, bool]]] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        if not field.cuts:
            words = [m.span() for m in WORD.finditer(text)]
            if words:
                sequences.append((i, words, [field.word(text[a:b]) for a, b in words], (False, False)))
            continue
        run: list[tuple[int, int]] = []
        held = [False, False]
        for m in _ODD.finditer(text):
            odd = m.span()
            if not run:
                near = _before(text, odd[0], 0, GAP + 1)
                held = [len(near) > GAP, False]
                run = [*(near[-REACH:] if held[0] else near), odd]
                continue
            gap = _before(text, odd[0], run[-1][1], GAP + 1)
            if len(gap) <= GAP:
                run += [*gap, odd]
            else:
                run += _after(text, run[-1][1], REACH)
                sequences.append((i, run, [field.word(text[p:q]) for p, q in run], (held[0], True)))
                run, held = [*gap[-REACH:], odd], [True, False]
        if run:
            rest = _after(text, run[-1][1], GAP + 1)
            last = len(rest) > GAP
            run += rest[:REACH] if last else rest
            sequences.append((i, run, [field.word(text[p:q]) for p, q in run], (held[0], last)))
    sequences.sort(key=lambda s: len(s[2]))
    at = 0
    while at < len(sequences):
        to = at + 1
        while to < len(sequences) and (to + 1 - at) * len(sequences[to][2]) <= CELLS:
            to += 1
        x, length = _padded([s[2] for s in sequences[at:to]])
        x = np.where(np.arange(x.shape[1]) < length[:, None], x, field.by_shape["w"])
        score = field.scores(x)
        for j, (*_, (first, last)) in enumerate(sequences[at:to]):  # words at a cut are O
            if first:
                score[j, 0, 1:] = -1e9
            if last:
                score[j, length[j] - 1, 1:] = -1e9
        labels = field.viterbi(score, length)
        for (i, words, *_), row in zip(sequences[at:to], labels):
            if row[: len(words)].any():
                out[i] += _found(texts[i], words, row)
        at = to
    for own in out:
        own.sort()
    return out


def _before(text: str, a: int, reach: int, most: int) -> list[tuple[int, int]]:
    """Up to ``most`` words before place ``a``, none of them before ``reach``."""
    out: list[tuple[int, int]] = []
    end = a
    for _ in range(most):
        while end > reach and _BREAK.match(text[end - 1]):
            end -= 1
        start = end
        while start > reach and not _BREAK.match(text[start - 1]):
            start -= 1
        if start == end:
            break
        out.append((start, end))
        end = start
    return out[::-1]


_NEXT = re.compile(f"[{_BREAKS}]+({_INNER})")


def _after(text: str, b: int, most: int) -> list[tuple[int, int]]:
    out = []
    for _ in range(most):
        m = _NEXT.match(text, b)
        if not m:
            break
        out.append(m.span(1))
        b = m.end()
    return out


def _found(text: str, words: list[tuple[int, int]], row: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[list] = []
    for (a, b), t in zip(words, row.tolist()):
        label = LABELS[t]
        if label == "O":
            continue
        left, right = core(text[a:b])
        if not right:
            continue
        if label[0] == "B" or not out or out[-1][2] != label[2:]:
            out.append([a + left, a + right, label[2:]])
        else:
            out[-1][1] = a + right
    return [tuple(x) for x in out]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_rows())


def trained(labelled: DataFrame | None, most: int = TRAIN_WORDS) -> Field:
    """From the first ``most`` words, by sentence and position, of a labelled table."""
    if labelled is None:
        return default_field()
    rows = pick(labelled, "sentence", "position", "word", "label").orderBy("sentence", "position", "word", "label").limit(most).collect()
    return fit([tuple(r) for r in rows])


_FIELDS: dict = {}


def _worker_field(shared) -> Field:
    key, vocabulary, theta = shared.value
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = Field(vocabulary, theta)
    return _FIELDS[key]


def _shared(docs: DataFrame, labelled: DataFrame | None):
    """The model under a name of its own: workers that are used again keep it by that."""
    f = trained(labelled)
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, f.vocabulary, [f.here, f.before, f.after, f.step, f.first]))


def find(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that hold personal data: (``key``, ``redacted`` text, ``n_spans``, ``spans`` array of
    (start, end, kind), in characters of the original text). The data themselves aren't given out.

    ``labelled``: (sentence, position, word, label) rows with labels O, B-<kind>, I-<kind>, of which
    TRAIN_WORDS are read; by default ``labelled_rows``. Null and empty texts and texts without
    personal data give no row; a null key stays null; repeated rows are handled one by one; texts are
    decoded whole at any length; other columns are ignored; an empty table gives no rows. Equal
    scores go to the earlier label of LABELS.
    """
    model = _shared(docs, labelled)
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string"))
    out = T.StructType([T.StructField("key", own.schema["key"].dataType), T.StructField("redacted", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])))])
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        field = _worker_field(model)
        for batch in batches:
            column = as_string(batch.column(1))
            for at, to in slices(np.diff(buffers(column)[0])):
                texts = column.slice(at, to - at).to_pylist()
                found = spans(field, texts)
                have = [i for i, f in enumerate(found) if f]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([at + i for i in have], pa.int64())),
                        pa.array([redacted(texts[i], found[i]) for i in have], pa.string()),
                        pa.array([len(found[i]) for i in have], pa.int32()),
                        pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in found[i]] for i in have], kinds),
                    ],
                    names=["key", "redacted", "n_spans", "spans"],
                )

    return own.mapInArrow(run, out).withColumnRenamed("key", key)


def redact(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` replaced by [<kind>]; a column n_chars
    is kept in step with the text. The cases are those of ``find``; null texts stay null."""
    model = _shared(docs, labelled)
    own = positional(docs)
    at_text = int(place(docs, text)[1:])
    at_size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        field = _worker_field(model)
        for batch in batches:
            column = as_string(batch.column(at_text))
            for at, to in slices(np.diff(buffers(column)[0])):
                part = batch.slice(at, to - at)
                texts = column.slice(at, to - at).to_pylist()
                found = spans(field, texts)
                if any(found):
                    arrays = part.columns
                    new = [redacted(t, f) if f else t for t, f in zip(texts, found)]
                    arrays[at_text] = pa.array(new, pa.string())
                    if at_size >= 0:
                        kind = arrays[at_size].type
                        if pa.types.is_integer(kind):
                            arrays[at_size] = pa.array([len(t) if f else n for t, f, n in zip(new, found, arrays[at_size].to_pylist())], kind)
                    part = pa.RecordBatch.from_arrays(arrays, schema=part.schema)
                yield part

    return own.mapInArrow(frugal(run), own.schema).toDF(*docs.columns)
