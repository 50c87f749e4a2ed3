"""Toxicity of whole texts after noisy-channel restoration.

Obfuscated words (leetspeak, letters set apart, repeated letters) become
character lattices: every symbol offers the letters it may stand for, runs may
shrink, separators may vanish, each at a cost. Viterbi decoding under a
character trigram model counted over all texts restores the word. Restored and
plain words then give the features of a logistic model with non-negative
weights, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Memo, remainder, slices, tidy

#: Labelled rows the classifier is fitted on: about so many toxic and clean ones.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 6000
STEPS = 300
LASSO = 3e-4

#: Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
        "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
        "(": "c", "£": "l", "¡": "i"}
#: Symbols that may hide any letter.
HIDDEN = "*#%?"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
V = 61

_CODE = np.zeros(0x181, np.int32)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0xDF:0x100] = np.arange(27, 60)
_CODE[0xF7] = 0
_CODE[0x100:] = 60
_SYMBOLS = re.escape("".join(LEET) + HIDDEN)
#: A token to restore has a repeated letter, a symbol that may be a letter, a
#: separator between letters, or two apostrophes (one is a contraction).
_NOISY = re.compile(rf"([^\W\d_])\1|[{_SYMBOLS}]|[^\W\d_](?:[^\w\s'’]|_)+[^\W\d_]"
                    r"|[^\W\d_]['’]+[^\W\d_]+['’]+[^\W\d_]")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
#: Symbols alone are restored (@$$) if they are no amount ($45, 5€).
_CURRENCY = re.compile(r"[@$€£]")
_AMOUNT = re.compile(r"[^\w\s]?\d[\d.,:/%+-]*[^\w\s]?")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]{1,3}){2,}\S(?!\S)")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = ".,;:!?\"'()[]{}<>…*#%&~^=/\\"
_PUNCTUATION = "".join(x for x in _EDGE if x not in LEET and x not in HIDDEN)


_CODES = {chr(o): int(_CODE[o]) for o in range(0x180) if chr(o).isalpha()}
_LEADING = re.compile(f"[{''.join(_CODES)}]*")


def _code(ch: str) -> int:
    found = _CODES.get(ch)
    if found is None:
        return int(_CODE[0x180]) if ch.isalpha() and ch > "\u017f" else 0
    return found


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams over all texts, two zeros standing for what lies between words."""
    def run(batches):
        total = np.zeros(V ** 3, np.int64)
        for (texts,) in slices(batches):
            raw = "\n".join(t or "" for t in texts).lower() + "\n"
            o = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
            c = _CODE[np.minimum(o, 0x180)]
            c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
            c = np.repeat(c, np.where(c == 0, 2, 1))
            total += np.bincount((c[:-2] * V + c[1:-1]) * V + c[2:], minlength=V ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])],
                                         names=["trigram", "n"])

    found = docs.select("text").mapInArrow(tidy(run), "trigram bigint, n bigint")
    out = np.zeros(V ** 3)
    for r in found.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most V cubed
        out[r["trigram"]] = r["n"]
    return out.reshape(V, V, V)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Cost (negative log probability) of a character after two others, with
    shorter contexts mixed in."""
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 1) / (one.sum() + V)
    p2 = (two + weight * p1) / (two.sum(1, keepdims=True) + weight)
    p3 = (counts + weight * p2) / (counts.sum(2, keepdims=True) + weight)
    return -np.log(p3).astype(np.float32)


def _noisy(word: str) -> bool:
    if not _LETTER.search(word):
        return bool(_CURRENCY.search(word)) and not _AMOUNT.fullmatch(word)
    return bool(_NOISY.search(word))


def forms(token: str) -> set[str]:
    """What is to be restored of a lower-case token: the token without its edges,
    and with those edge symbols that may be letters. A question mark at the end
    and hiding symbols at both ends (**so**) are no letters."""
    if token.isalpha():
        return {token} if _DOUBLE.search(token) else set()
    full = token.lstrip(_PUNCTUATION).rstrip(_PUNCTUATION + "?")
    if full and full[0] in HIDDEN and full[-1] in HIDDEN:
        full = full.strip(HIDDEN)
    return {x for x in (token.strip(_EDGE), full) if x and _noisy(x)}


def lattice(word: str, masked: bool = True):
    """(letters given, cost) options at every place; a blank given is a word
    boundary. A string is a letter that stays; a number stands for so many hiding
    symbols: any letters (only if ``masked``, else they vanish)."""
    apart = ("'" in word or "’" in word) and len(re.findall("['’]+", word)) > 1
    at = 0
    while at < len(word):
        ch, run = word[at], 1
        while at + run < len(word) and word[at + run] == ch:
            run += 1
        at += run
        if ch in HIDDEN and masked:
            yield run
        elif ch.isalpha():
            yield ch if run == 1 else [(ch, 0.4), (ch * 2, 0.0 if run == 2 else 0.8)]
        elif ch in LEET:
            options = [(x, 0.7) for x in LEET[ch]]
            if run > 1:
                options += [(x * 2, 1.0) for x in LEET[ch]]
            yield [*options, ("", 2.5)]
        elif ch in HIDDEN or ch.isalnum():
            yield [("", 2.5)]
        elif ch.isspace() and run > 1:
            yield [("", 1.5), (" ", 0.3)]
        elif ch in "'’" and not apart:
            yield [("", 4.0), (" ", 0.0)]
        else:
            yield [("", 0.3), (" ", 1.5)]


#: Cost of a letter for a hiding symbol, and of its being none.
MASK, NO_MASK = 1.0, 4.0


class Steps:
    """Hiding symbols after states of given costs: what each state of the last two
    characters costs then, and the letters that lead there. The costs, less their
    least, come round after some steps: a long run is a beginning, a round taken many
    times, and a rest, so it takes little time and memory. States that lag by more than
    any two characters can make good, and by more than ``decode`` keeps, count alike."""

    def __init__(self, spent: np.ndarray, n: int, cost: np.ndarray):
        self.cost = cost[:, :, 1:27]
        begin, rest, seen = [], [], {}
        lag = 8.0 + 4.0 * float(cost.max())
        self.parts: list[tuple[list, int]] = [(begin, 1)]
        while len(begin) < n:
            spent = self._step(spent, begin)
            least = spent.min()
            key = np.minimum(np.round(spent - least, 6), lag).tobytes() if n > 16 else None
            if key in seen:
                first, before = seen[key]
                round_ = begin[first:]
                times, left = divmod(n - len(begin), len(round_))
                spent = spent + (least - before) * times
                for _ in range(left):
                    spent = self._step(spent, rest)
                self.parts += [(round_, times), (rest, 1)]
                break
            if key:
                seen[key] = len(begin), least
        self.spent = spent

    def _step(self, spent: np.ndarray, chosen: list) -> np.ndarray:
        total = spent[:, :, None] + self.cost
        least = total.argmin(0)
        given = np.take_along_axis(total, least[None], 0)[0] + MASK
        after = spent + NO_MASK
        better = given < after[:, 1:27]
        after[:, 1:27] = np.where(better, given, after[:, 1:27])
        chosen.append((least.astype(np.int8), better))
        return after

    def letters(self, x: int, y: int) -> tuple[str, tuple[int, int]]:
        """Letters given on the way to (x, y), and the state it starts from."""
        out = []
        for steps, times in reversed(self.parts):
            for _ in range(times):
                for least, better in reversed(steps):
                    if 1 <= y <= 26 and better[x, y - 1]:
                        out.append(LETTERS[y - 1])
                        x, y = int(least[x, y - 1]), x
        return "".join(reversed(out)), (x, y)


def tail(a: int, b: int, n: int, cost: np.ndarray, keep: int) -> list[tuple]:
    """(cost, (code, code), letters) of the ``keep`` cheapest ends of a word after
    ``a`` and ``b`` when ``n`` hiding symbols follow."""
    spent = np.full((V, V), np.inf)
    spent[a, b] = 0.0
    steps = Steps(spent, n, cost)
    ends = steps.spent + cost[:, :, 0]
    out = []
    for at in np.argsort(ends, axis=None, kind="stable")[:keep]:
        end = divmod(int(at), V)
        if np.isinf(ends[end]):
            break
        out.append((float(ends[end]), end, steps.letters(*end)[0]))
    return out


class _Masked(tuple):
    """A path that ends in a run of hiding symbols: (steps, state, paths before)."""


def _written(path) -> str:
    letters = []
    while path:
        if path.__class__ is _Masked:
            steps, end, paths = path
            text, start = steps.letters(*end)
            letters.append(text)
            path = paths[start]
        else:
            path, given = path
            letters.append(given)
    return "".join(reversed(letters))


_REPEATED = re.compile(r"([^\W\d_])\1+")


def _along(text: str, a: int, b: int, spent: float, flat: memoryview) -> tuple[float, int, int]:
    """Cost and last two characters after letters that stay."""
    for ch in text:
        z = _CODES.get(ch)
        if z is None:
            z = _code(ch)
        spent += flat[(a * V + b) * V + z]
        a, b = b, z
    return spent, a, b


def _cheapest(after: list[tuple]) -> list[tuple]:
    """Of the states with the same last two characters the first of the cheapest."""
    best: dict[tuple[int, int], tuple] = {}
    for state in after:
        known = best.get(state[1:3])
        if known is None or state[0] < known[0]:
            best[state[1:3]] = state
    return list(best.values())


def _decode_letters(word: str, flat: memoryview, keep: int) -> list[str]:
    """``decode`` of a word of letters, some repeated: nearly always there is one state."""
    states = [(0.0, 0, 0, "")]
    at = 0
    while at < len(word):
        m = _REPEATED.search(word, at)
        to = m.start() if m else len(word)
        while at < to and len(states) > 1:
            ch = word[at]
            z = _code(ch)
            states = _cheapest([(spent + flat[(a * V + b) * V + z], b, z, text + ch)
                                for spent, a, b, text in states])
            at += 1
        if at < to:
            ((spent, a, b, text),) = states
            states = [(*_along(word[at:to], a, b, spent, flat), text + word[at:to])]
        if m:
            ch, after = m[1], []
            z, twice = _code(ch), 0.0 if m.end() - to == 2 else 0.8
            for spent, a, b, text in states:
                one = spent + 0.4 + flat[(a * V + b) * V + z]
                two = spent + twice + flat[(a * V + b) * V + z] + flat[(b * V + z) * V + z]
                after += [(one, b, z, text + ch), (two, z, z, text + ch + ch)]
            states, to = _cheapest(after), m.end()
        at = to
    ends = sorted((spent + flat[(a * V + b) * V], text) for spent, a, b, text in states)
    return [text for spent, text in ends[:keep] if spent <= ends[0][0] + 4.0]


def readings(word: str, most: int = 8) -> list[str] | None:
    """Every way through the lattice of a word of letters: a repeated letter stays once
    or twice. None if there are more than ``most`` ways."""
    out, at = [""], 0
    for m in _REPEATED.finditer(word):
        if 2 * len(out) > most:
            return None
        once = word[at:m.start() + 1]
        out = [x + once + more for x in out for more in ("", m[1])]
        at = m.end()
    return [x + word[at:] for x in out]


#: Decodings of a token that give features: the best, and others within 4 of its cost.
KEEP = 4


def decode(word: str, cost: np.ndarray, keep: int = KEEP, masked: bool = True,
           tails: dict | None = None) -> list[str]:
    """Restored forms of a lower-case word, the likeliest first: Viterbi over
    the lattice, a state being the last two characters. Restored words are set
    apart by blanks. ``tails`` remembers what ``tail`` found: hiding symbols at the
    end of a word are restored from the two characters before them."""
    flat = memoryview(cost.reshape(-1))
    if word.isalpha() and len(word) <= 200:
        return _decode_letters(word, flat, keep)
    stem = word.rstrip(HIDDEN) if masked else word
    hidden, word = len(word) - len(stem), stem
    # a path is (path before, letters given): long words cost no copies
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    plain = _LEADING.match(word).end()
    if m := _DOUBLE.search(word, 0, plain):
        plain = m.start()
    if plain:  # one way leads through letters that are not repeated
        spent, a, b = _along(word[:plain], 0, 0, 0.0, flat)
        states = {(a, b): (spent, (None, word[:plain]))}
        word = word[plain:]
    for options in lattice(word, masked):
        after: dict[tuple[int, int], tuple] = {}
        if options.__class__ is str:
            z = _code(options)
            for (a, b), (spent, path) in states.items():
                spent += flat[(a * V + b) * V + z]
                best = after.get((b, z))
                if best is None or spent < best[0]:
                    after[b, z] = (spent, (path, options))
        elif options.__class__ is int and options > 2:
            spent = np.full((V, V), np.inf)
            for (a, b), (total, _) in states.items():
                spent[a, b] = total
            run = Steps(spent, options, cost)
            paths = {k: path for k, (_, path) in states.items()}
            after = {(int(a), int(b)): (float(run.spent[a, b]), _Masked((run, (int(a), int(b)),
                                                                         paths)))
                     for a, b in zip(*np.nonzero(np.isfinite(run.spent)))}
        elif options.__class__ is int:
            for _ in range(options):
                after = {}
                ends: dict[int, list] = {}
                for (a, b), (spent, path) in states.items():
                    after[a, b] = (spent + NO_MASK, path)
                    ends.setdefault(b, []).append((a, spent, path))
                for b, rows in ends.items():
                    total = cost[[r[0] for r in rows], b, 1:27] + np.array(
                        [[r[1]] for r in rows]) + MASK
                    least = total.argmin(0).tolist()
                    for z, i in enumerate(least):
                        spent = float(total[i, z])
                        best = after.get((b, z + 1))
                        if best is None or spent < best[0]:
                            after[b, z + 1] = (spent, (rows[i][2], LETTERS[z]))
                states = after
        else:
            steps = [(given, (0, 0) if given == " " else [_code(ch) for ch in given], price)
                     for given, price in options]
            for (a, b), (spent, path) in states.items():
                for given, codes, price in steps:
                    x, y, total = a, b, spent + price
                    for z in codes:
                        total += flat[(x * V + y) * V + z]
                        x, y = y, z
                    best = after.get((x, y))
                    if best is None or total < best[0]:
                        after[x, y] = (total, (path, given) if given else path)
        states = after
    last: dict[tuple[int, int], tuple] = {}
    for (a, b), (spent, path) in states.items():
        if not hidden:
            last[a, b] = (spent + flat[(a * V + b) * V], path)
            continue
        key = (a, b, hidden, keep)
        found = tails.get(key) if tails is not None else None
        if found is None:
            found = tail(a, b, hidden, cost, keep)
            if tails is not None:
                if len(tails) >= 20_000:
                    tails.clear()
                tails[key] = found
        for more, end, given in found:
            if end not in last or spent + more < last[end][0]:
                last[end] = (spent + more, (path, given) if given else path)
    ends = []
    for spent, path in sorted(last.values(), key=lambda x: x[0])[:keep + 1]:
        text = _written(path).strip()
        if text:
            ends.append((spent, text))
    ends.sort()
    return [text for spent, text in ends[:keep] if spent <= ends[0][0] + 4.0]


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode())


_WHOLE, _START = _bucket("w"), _bucket("p")


def word_features(word: str) -> tuple[int, ...]:
    """The word and its beginnings of 4 to 6 letters (inflected forms share them)."""
    crc32 = zlib.crc32
    data = word.encode()
    n = len(word)
    if n < 4:
        return (crc32(data, _WHOLE),)
    if len(data) == n:
        parts = data[:4], data[4:5], data[5:6]
    else:
        parts = word[:4].encode(), word[4:5].encode(), word[5:6].encode()
    four = crc32(parts[0], _START)
    five = crc32(parts[1], four)  # of a shorter word: the same again
    return crc32(data, _WHOLE), four, five, crc32(parts[2], five)


_NONE: frozenset = frozenset()


class Reader:
    """Features of texts, with a memo by lower-case token without punctuation at its ends."""

    def __init__(self, cost: np.ndarray, known: dict[int, int] | None = None):
        self.cost, self.known = cost, known
        self.flat = memoryview(cost.reshape(-1))
        # few tokens have evidence; without ``known`` each keeps all its features
        self.tokens = Memo(self._token, 200_000 if known is None else 400_000)
        self.tails: dict = {}
        self.phrases = Memo(self._phrase, 20_000)

    def _features(self, words) -> frozenset[int]:
        """Features of the words, those with evidence if it is known which have any."""
        known = self.known
        if known is None:
            return frozenset([f for word in words for f in word_features(word)])
        found = [known[f] for word in words for f in word_features(word) if f in known]
        return frozenset(found) if found else _NONE

    def _restored(self, raw: str) -> frozenset[int]:
        texts = decode(raw, self.cost, tails=self.tails)
        if any(x in raw for x in HIDDEN):
            texts += decode(raw, self.cost, masked=False)
        return self._features({word for text in texts for word in text.split()})

    def _token(self, low: str) -> frozenset[int]:
        if low.isalpha() and len(low) <= 200:
            found = self._features((low,))
            if _DOUBLE.search(low):
                # ways that add no evidence need not be compared by their cost
                ways = readings(low) if self.known is not None else None
                if ways is None or not self._features(ways) <= found:
                    found |= self._features(_decode_letters(low, self.flat, KEEP))
            return found
        found = self._features(_WORD.findall(low))
        for form in forms(low):
            # a form of letters alone is a word of the token
            found |= (self.tokens[form] if form.isalpha() and form != low
                      else self._restored(form))
        return found

    def _phrase(self, raw: str):
        """Letters set apart: all of them, without one at either end (a word of one
        letter), and the words between wide blanks each on its own."""
        letters = re.split(r"(?<=\S)(?=\s)", raw)
        tries = {raw, "".join(letters[1:]).lstrip(), "".join(letters[:-1])}
        tries.update(x for x in re.split(r"\s{2,}", raw) if len(x) > 3)
        return _NONE.union(*map(self._restored, tries))

    def features(self, text: str) -> set[int]:
        # punctuation at the ends is no word and is stripped from every form
        tokens = {x.strip(_PUNCTUATION) for x in set(text.lower().split())}
        out = set().union(*filter(None, map(self.tokens.__getitem__, tokens)))
        for m in _SPACED.finditer(text):
            raw = m.group().lower()
            if _LETTER.search(raw) or _CURRENCY.search(raw):
                out |= self.phrases[raw]
        return out


class Model:
    """Character costs, feature numbers, weights and bias."""

    def __init__(self, cost, known, weights, bias):
        self.cost, self.known, self.weights, self.bias = cost, known, weights, bias

    def reader(self) -> Reader:
        return Reader(self.cost, self.known)

    def score(self, features) -> float:
        z = self.bias + float(self.weights[list(features)].sum()) if features else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[int, np.ndarray]]):
    """(feature numbers, weights, bias) from (label, sorted feature hashes) rows;
    rows with the same features count once."""
    unique = {(y, f.tobytes()): (y, f) for y, f in rows}
    rows = [unique[k] for k in sorted(unique)]
    y = np.array([r[0] for r in rows], dtype=float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return {}, np.zeros(0), 30.0 if n1 else -30.0
    names, df1 = np.unique(np.concatenate([f for label, f in rows if label]), return_counts=True)
    names, df1 = names[df1 >= 2], df1[df1 >= 2]
    if not len(names):
        return {}, np.zeros(0), float(np.log(n1 / n0))

    def known(f: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(names, f), len(names) - 1)
        return place[names[place] == f]

    df0 = np.zeros(len(names), np.int64)
    for label, f in rows:
        if not label:
            df0[known(f)] += 1
    ratio = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
    good = np.flatnonzero(ratio > 1.0)
    good = good[np.argsort(-(ratio * df1)[good], kind="stable")]
    number = np.full(len(names), -1, np.int32)
    number[good] = np.arange(len(good))
    columns = [number[known(f)] for _, f in rows]
    columns = [c[c >= 0] for c in columns]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
    column = np.concatenate(columns)
    w, b = np.zeros(len(good)), float(np.log(n1 / n0)) - 2
    m, v = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(owner, w[column], minlength=len(y))
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(column, gap[owner], minlength=len(good)) + LASSO / 3
                      + 1e-6 * w, gap.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-10)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    kept = np.flatnonzero(w > 1e-3)
    return {int(names[good[k]]): i for i, k in enumerate(kept)}, w[kept], float(b)


def learn(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC,
          clean: int = SAMPLE_CLEAN) -> Model:
    """Character model of all texts; classifier of a bounded sample of labelled
    rows whose id may be learnt from, chosen by the hash of the id."""
    cost = language_model(trigram_counts(docs))
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)")
             .filter(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = [min(1.0, clean / max(counts.get(0, 0), 1)), min(1.0, toxic / max(counts.get(1, 0), 1))]
    unit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    picked = (known.filter(unit < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * (toxic + clean)))

    def run(batches):
        reader = Reader(cost)
        for ys, texts in slices(batches, 64):
            found = [np.sort(np.fromiter(reader.features(t or ""), np.uint32)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["y", "features"])

    # the sample is bounded by its two parameters, so is its broadcast
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("y", "text").mapInArrow(tidy(run), "y int, features binary").collect())
    numbers, weights, bias = fit([(r["y"], np.frombuffer(r["features"], np.uint32))
                                  for r in rows])
    if len(weights):
        bias -= float(np.log(share[1] / share[0]))
    return Model(cost, numbers, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every document.

    Null text counts as empty and gets the score of a text without evidence;
    repeated rows each give a row (of labels that contradict, the toxic one
    counts); null ids stay null and teach nothing; null labels are left out;
    without labels of both kinds every score says the only kind (none: clean);
    other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # bounded above

    def run(batches):
        model = shared.value
        reader = model.reader()
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([model.score(reader.features(t or "")) for t in texts], pa.float64())],
                names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, score double")
