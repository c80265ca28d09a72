"""Problem 10: abusive, hateful and sexually explicit language.

Words are brought to one form first (look-alikes, case, letter-for-digit spellings, repeated, masked, spaced and cut
letters).  Every word is then looked up in a trie of lexicon words by a Levenshtein automaton that walks the trie: what
is within one edit (two from nine letters) of a lexicon word, and no ordinary word of the corpus, is that word.  The
lexicon is the given list of terms and the words and pairs of syllables that reviewers' labels show to be as telling.
Terms of two Tibetan syllables are found by the syllable that is right and a walk over the other.

Only a find of the trie opens a context window: the words around it in its sentence.  A window's score is the log odds
of a logistic model over its word sequences of up to three words, terms by their category, so that the same term
scores high in an insult and low in a glossary entry, a quotation or a story.  A document has the score of its worst
window, less the threshold: above 0 is abusive.

The weights are fitted on a bounded sample of labelled documents (``positives`` and ``negatives`` rows at most), in which
a document stands for as many labelled ones of its class as the bound leaves out.  Which words are too common to be
misspellings is counted over all documents.  Labels belong to documents and are noisy, so fitting alternates between
choosing each document's guilty windows by models that did not see it, and the chance that each label is right given
the raters' votes.  Where labels say little, weights stay near those of ``PRIOR``.  The threshold is the one with which
models that did not see a document tell labels best.

Cases: null and empty texts, and texts without a lexicon word, have the least score; a document without label counts as
unlabelled; votes of null and repeated votes of a rater don't count; without any positive label the prior weights
score; a missing source is 'unknown'.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOTE, canon, to_script

# Figures and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l", "+": "t"})
EDGE = ".,;:?\"()“”«»…[]{}"
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[\n/།༎]+")
_SPACED = re.compile(r"(?<![^\s\"(])(?:[^\W\d_] ){2,}[^\W\d_](?![^\s.,;:?!\")])")
_MAYBE_SPACED = re.compile(r" [^\W\d_] [^\W\d_] ")
_REPEAT = re.compile(r"(.)\1{2,}")
_LATIN = re.compile(r"[a-z]+")
MISSED, FALSE = 0.06, 0.04  # how often a rater misses abuse, and sees it where there is none
AROUND = 16  # words on either side of a find that make its window
BASE = 0.06  # share of abusive documents before any evidence
NONE = -12.0
COMMON, COMMON_SHARE = 4, 1 / 5000  # documents, and share of all, from which a word is no misspelling
# Weights before any label: terms count more when they address somebody, less where language itself is the subject.
PRIOR = {
    "<insult>": 1.3, "<hate>": 1.0, "<sexual>": 0.8, "<term>": 1.3, "you": 1.5, "your": 1.5, "ཁྱོད": 1.5, "they": 0.5,
    "word": -1.5, "term": -1.5, "means": -1.5, "meaning": -1.5, "entry": -1.5, "dictionary": -1.5, "glossary": -1.5, "verse": -1.0, "says": -1.0, "called": -1.0, "ཞེས": -1.5,
}
RIDGE = 0.15  # pull of the weights to those
THRESHOLD = 0.0
#: Most terms that are broadcast.
MOST_TERMS = 100_000


def edits(letters: int) -> int:
    """Edits within which a word counts as a lexicon word of so many letters."""
    return 0 if letters < 5 else 1 if letters < 9 else 2


class LexiconTrie:
    """Words by their letters; lookups walk the trie and a Levenshtein automaton together."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node["\0"] = w

    def nearest(self, word: str, most: int, allowed: Callable[[int], int] | None = None, wild: str = "*") -> str | None:
        """The word at the least edit distance up to most, and up to what its length allows; the smallest among equals.

        The wild sign stands for any one letter.
        """
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "\0":
                    if row[-1] <= (allowed(len(child)) if allowed else most) and (best is None or (row[-1], child) < best):
                        best = (row[-1], child)
                    continue
                new = [row[0] + 1]
                for k, w in enumerate(word):
                    new.append(min(new[k] + 1, row[k + 1] + 1, row[k] + (w != c and w != wild)))
                if min(new) <= most:  # the automaton still lives
                    stack.append((child, new))
        return best[1] if best else None


class Lexicon:
    """What is looked for: words, terms of several words by their tag, and what is too common to be a misspelling."""

    def __init__(self, words: set[str], phrases: dict[tuple[str, ...], str], common: set[str] = frozenset()):
        self.words, self.phrases, self.common = words, phrases, common


class Reader:
    """Text to numbers: a word's number in the vocabulary, 0 for words without one, -1 between sentences."""

    def __init__(self, lexicon: Lexicon, numbers: dict[str, int], grow: bool = False, limit: int = 500_000):
        self.lexicon, self.numbers, self.grow, self.limit = lexicon, numbers, grow, limit
        self.trie = LexiconTrie(sorted(lexicon.words))
        self.cache: dict[str, int] = {"\0": -1}
        self.forms: dict[str, str] = {}
        for w in [*lexicon.words, *lexicon.phrases.values(), "<near>", *(x for p in lexicon.phrases for x in p)]:
            self._number(w)
        self.finds = {numbers[w] for w in [*lexicon.words, *lexicon.phrases.values(), "<near>"] if w in numbers}
        self.phrases = {tuple(numbers[w] for w in p): numbers[t] for p, t in lexicon.phrases.items() if all(w in numbers for w in p) and t in numbers}
        self.heads = {p[0] for p in self.phrases}
        self.longest = max((len(p) for p in self.phrases), default=0)
        # terms of two syllables: by the one that is right, a trie of the other
        self.after, self.before = {}, {}
        for p in lexicon.phrases:
            if len(p) == 2 and p[0] in numbers and p[1] in numbers and "ༀ" <= p[0][0] <= "࿿":
                self.after.setdefault(numbers[p[0]], set()).add(p[1])
                self.before.setdefault(numbers[p[1]], set()).add(p[0])
        self.after = {k: LexiconTrie(sorted(v)) for k, v in self.after.items()}
        self.before = {k: LexiconTrie(sorted(v)) for k, v in self.before.items()}
        self.sides = {*self.after, *self.before}
        self.pairs: dict[tuple[int, str, bool], bool] = {}

    def _number(self, w: str) -> int:
        if self.grow:
            return self.numbers.setdefault(w, len(self.numbers) + 1)
        return self.numbers.get(w, 0)

    def form(self, raw: str) -> str:
        """A word in one form, before any lookup."""
        w = raw.strip(EDGE)
        if not w or "ༀ" <= w[0] <= "࿿":
            return w
        if w[:1].isupper() and (w[1:].islower() or w.isupper() or not w[1:].isascii()) or (w.upper() == w and len(w) > 2 and "+" not in w):
            w = w.lower()
        script = to_script(w)
        if script and w not in self.lexicon.words:
            return script
        w = w.lower()
        if not any(c.isalpha() for c in w):
            return "#" if any(c.isdigit() for c in w) and "*" not in w else w
        if not w.isalpha():
            tail = w.rstrip("!")
            w = tail.translate(LEET) if any(c.isalpha() for c in tail) else tail
            w = "".join(c for c in w if c.isalpha() or c in "*'")
        return _REPEAT.sub(r"\1", w).strip("'")

    def plain(self, raw: str) -> str:
        """The lexicon word that the trie finds for a word, else the word in one form."""
        w = self.form(raw)
        if not w or "ༀ" <= w[0] <= "࿿" or w in self.lexicon.common:
            return w
        return self.trie.nearest(w, 0 if "*" in w else 1 if len(w) < 8 else 2, None if "*" in w else edits) or w

    def _new(self, raw: str) -> int:
        if len(self.cache) >= self.limit:
            self.cache = {"\0": -1}
        w = self.plain(raw)
        v = self.cache[raw] = self._number(w) if w else -2
        return v

    def _near(self, side: int, raw: str, after: bool) -> bool:
        """Whether the raw word beside the right syllable of a term is within an edit of the term's other one."""
        key = (side, raw, after)
        v = self.pairs.get(key)
        if v is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            trie = (self.after if after else self.before).get(side)
            w = self.form(raw) if trie else ""
            found = trie.nearest(w, 1, lambda n: int(n > 2)) if w and "ༀ" <= w[0] <= "࿿" else None
            v = self.pairs[key] = found is not None and found != w
        return v

    def parts(self, text: str) -> list[str]:
        """Words as written, without notes, spaced words closed up; '\\0' between sentences."""
        text = canon(text)
        if "[" in text:
            text = NOTE.sub(" ", text)
        if "་" in text:
            text = text.replace("་", " ")
        if _MAYBE_SPACED.search(text) or text[1:2] == " ":
            text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
        return _SENTENCE.sub(" \0 ", text).split()

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        raws = self.parts(text)
        get, new = self.cache.get, self._new
        found = [v if (v := get(r)) is not None else new(r) for r in raws]
        if -2 in found:
            raws = [r for r, v in zip(raws, found) if v != -2]
            found = [v for v in found if v != -2]
        if self.sides.isdisjoint(found) and self.heads.isdisjoint(found):
            return found
        out, k, n = [], 0, len(found)
        while k < n:
            v = found[k]
            if v in self.heads:
                for m in range(self.longest, 0, -1):
                    if tag := self.phrases.get(tuple(found[k : k + m])):
                        out.append(tag)
                        k += m
                        break
                if tag:
                    continue
            if k + 1 < n and (v in self.after and self._near(v, raws[k + 1], True) or found[k + 1] in self.before and self._near(found[k + 1], raws[k], False)):
                out.append(self.numbers.get("<near>", 0))
                k += 2
                continue
            out.append(v)
            k += 1
        return out


class Batch:
    """Texts as one array of numbers, with the windows around finds: owner (text), first and last position."""

    def __init__(self, reader: Reader, texts: list[str | None]):
        flat, ends = [-1], []
        for text in texts:
            flat += reader(text)
            flat += (-1, -1, -1)
            ends.append(len(flat))
        self.a = a = np.array(flat, np.int64)
        at = np.flatnonzero(np.isin(a, np.fromiter(reader.finds, np.int64, len(reader.finds))))
        marks = np.flatnonzero(a == -1)
        nth = np.searchsorted(marks, at)
        lo, hi = np.maximum(at - AROUND, marks[nth - 1] + 1), np.minimum(at + AROUND + 1, marks[np.minimum(nth, len(marks) - 1)])
        self.owner = np.searchsorted(np.array(ends, np.int64), at, side="right")
        if len(at):  # finds that share a window make one
            keep = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            lo, hi, self.owner = lo[keep], hi[keep], self.owner[keep]
        self.lo, self.hi, self.texts = lo, hi, len(texts)

    def grams(self, base: int):
        """For sequences of 1, 2 and 3 words: their codes at every position, and where they stay within a sentence and the vocabulary."""
        a, code, valid = self.a, np.zeros(len(self.a), np.int64), np.ones(len(self.a), bool)
        for n in range(3):
            shifted = np.append(a[n:], np.full(n, -1))[: len(a)]
            code = code * base + shifted
            valid = valid & (shifted > 0)
            yield code, valid

    def worst(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.texts, NONE)
        np.maximum.at(out, self.owner, values)
        return out


class Model:
    """The lexicon, the vocabulary's numbers, a bias and the weights of word sequences by length and code; the threshold is in the bias."""

    def __init__(self, lexicon: Lexicon, numbers: dict[str, int], base: int, bias: float, tables):
        self.lexicon, self.numbers, self.base, self.bias, self.tables = lexicon, numbers, base, bias, tables
        self.key = uuid.uuid4().hex  # workers keep the scorer of one model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.lexicon, model.numbers)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Each text's worst window."""
        batch = Batch(self.reader, texts)
        value = np.zeros(len(batch.a))
        for (code, valid), (at, weight) in zip(batch.grams(self.model.base), self.model.tables):
            where = np.flatnonzero(valid)
            if len(at) and len(where):
                spot = np.searchsorted(at, code[where]).clip(max=len(at) - 1)
                hit = at[spot] == code[where]
                value[where[hit]] += weight[spot[hit]]
        total = np.append(0.0, np.cumsum(value))
        return batch.worst(np.maximum(self.model.bias + total[batch.hi] - total[batch.lo], NONE))


class _Features:
    """Windows by the sequences that stand in them, for fitting: rows, columns (with repeats), names."""

    def __init__(self, batch: Batch, numbers: dict[str, int]):
        self.base = len(numbers) + 2
        size = batch.hi - batch.lo
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(batch.lo, size)
        rows, cols, self.codes, start = [], [], [], 0
        for code, valid in batch.grams(self.base):
            ok = valid[place]
            names, where = np.unique(code[place[ok]], return_inverse=True)
            # only what stands in more than one document
            pairs = np.unique(where.astype(np.int64) * (batch.texts + 1) + batch.owner[row[ok]])
            often = np.bincount(pairs // (batch.texts + 1), minlength=len(names)) > 1
            number = np.cumsum(often) - 1
            keep = often[where]
            rows.append(row[ok][keep])
            cols.append(number[where[keep]] + start)
            self.codes.append(names[often])
            start += int(often.sum())
        self.rows, self.cols, self.width = np.concatenate(rows), np.concatenate(cols), start
        self.owner, self.count, self.docs = batch.owner, len(size), batch.texts

    def prior(self, numbers: dict[str, int]) -> np.ndarray:
        out = np.zeros(self.width)
        known = {numbers[w]: x for w, x in PRIOR.items() if w in numbers}
        for k, c in enumerate(self.codes[0].tolist()):
            out[k] = known.get(c, 0.0)
        return out


def logistic(rows, cols, count: int, width: int, target: np.ndarray, weight: np.ndarray, prior: np.ndarray, start: tuple[float, np.ndarray], ridge: float, steps: int) -> tuple[float, np.ndarray]:
    """Bias and weights of least weighted log loss with a ridge about the prior; by limited-memory quasi-Newton steps."""

    about = np.append(np.log(BASE / (1 - BASE)), prior)

    def value(x):
        z = x[0] + np.bincount(rows, x[1:][cols], count)
        p = 1 / (1 + np.exp(-z.clip(-30, 30)))
        d = x - about
        loss = (weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * ridge * (d @ d)
        r = weight * (p - target)
        return loss, np.append(r.sum(), np.bincount(cols, r[rows], width)) + ridge * d

    x = np.append(start[0], start[1])
    loss, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.sqrt(g @ g))
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            q += (alpha - rho * (y @ q)) * s
        slope, step = g @ q, 1.0
        if slope <= 1e-9:
            break
        while True:
            new = x - step * q
            new_loss, new_g = value(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        done = loss - new_loss < 1e-6 * abs(loss)
        x, loss, g = new, new_loss, new_g
        if done:
            break
    return float(x[0]), x[1:]


def _right(top: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The chance of abuse given the text's log odds and the raters' votes."""
    prior = 1 / (1 + np.exp(-top.clip(-3.5, 3.5)))
    k, n = votes.T
    yes = prior * (1 - MISSED) ** k * MISSED ** (n - k)
    no = (1 - prior) * FALSE**k * (1 - FALSE) ** (n - k)
    return yes / np.maximum(yes + no, 1e-300)


def _g2(k, n, other, rest):
    """Likelihood ratio of k of n against other of rest."""
    share = (k + other) / (n + rest)
    return 2 * (k * np.log(max(k, 1e-9) / (n * share)) + other * np.log(max(other, 1e-9) / (rest * share)))


def _guilt(z: np.ndarray, f: _Features, votes: np.ndarray) -> np.ndarray:
    """Each window's part in its document's guilt: the worst ones, and all above even odds."""
    top = np.full(f.docs, NONE)
    np.maximum.at(top, f.owner, z)
    chance = _right(top, votes)[f.owner]
    worst = z >= top[f.owner]
    ties = np.bincount(f.owner[worst], minlength=f.docs)
    return np.where(z > 0, chance, np.where(worst, chance / np.maximum(ties, 1)[f.owner], 0.0))


def _held_out(f: _Features, guilt, weight, prior, folds: int, states: list, steps: int) -> np.ndarray:
    """Every window's log odds by a model that did not see its document."""
    z, fold = np.empty(f.count), (np.random.default_rng(0).permutation(f.docs) % folds)[f.owner]
    row_fold = fold[f.rows]
    for k in range(folds):
        seen = row_fold != k
        states[k] = logistic(f.rows[seen], f.cols[seen], f.count, f.width, guilt, np.where(fold != k, weight, 0.0), prior, states[k], RIDGE, steps)
        own = fold == k
        z[own] = (states[k][0] + np.bincount(f.rows[~seen], states[k][1][f.cols[~seen]], f.count))[own]
    return z


def best_threshold(top: np.ndarray, votes: np.ndarray, weight: np.ndarray) -> float:
    """The bar on held-out log odds with the best balance of found and right ones, as the votes tell; near 0 where they don't."""
    k, n = votes.T
    right = ((k / np.maximum(n, 1) - FALSE) / (1 - MISSED - FALSE)).clip(0, 1)
    bars = np.round(np.arange(-2, 3.01, 0.25), 2)
    all_right = (right * weight).sum()
    gain = []
    for t in bars:
        on = top > t
        gain.append(2 * (right * weight)[on].sum() / max(weight[on].sum() + all_right, 1e-9) - 0.01 * abs(t))
    return float(bars[int(np.argmax(gain))])


def fit(sample: list[tuple[str, int, int, float]], terms: list[tuple[str, str]], rounds: int = 4, folds: int = 3, common_words: Callable[[set[str]], set[str]] | None = None) -> Model:
    """The model from (text, positive votes, votes, labelled documents it stands for) and (term, category).

    common_words gives, for a lexicon, the words near it that are no misspellings; without it the sample decides.
    """
    listed = Reader(Lexicon(set(), {}), {}, grow=True)
    phrases: dict[tuple[str, ...], str] = {}
    latin = set()
    for term, category in terms:
        words = tuple(w for r in listed.parts(term) if r != "\0" and (w := listed.form(r)))
        if words:
            phrases[words] = "<term>" if len(words) > 1 and all("ༀ" <= w[0] <= "࿿" for w in words) else f"<{category}>"
            latin |= {w for w in words if _LATIN.fullmatch(w)}
    votes = np.array([(k, n) for _, k, n, _ in sample], float).reshape(-1, 2)
    weight = np.array([x for *_, x in sample], float)
    prior_odds = float(np.log(BASE / (1 - BASE)))
    if not len(votes) or not votes[:, 0].any():
        lexicon = Lexicon(latin, phrases, common_words(latin) if common_words else set())
        numbers: dict[str, int] = {}
        reader = Reader(lexicon, numbers, grow=True)
        for w in PRIOR:
            reader._number(w)
        known = sorted((numbers[w], x) for w, x in PRIOR.items())
        none = (np.zeros(0, np.int64), np.zeros(0))
        return Model(lexicon, numbers, len(numbers) + 2, prior_odds, [(np.array([c for c, _ in known]), np.array([x for _, x in known])), none, none])
    chance = _right(np.full(len(sample), prior_odds), votes)
    # words that the labels show to be telling join the lexicon
    pos, often, seen, rows = Counter(), Counter(), Counter(), Counter()
    pair_pos, pair_often, pair_seen = Counter(), Counter(), Counter()
    for share, (text, _, _, x) in zip(chance, sample):
        words = [w if r != "\0" else "\0" for r in (listed.parts(text) if text else ()) if (w := listed.form(r)) or r == "\0"]
        for w in set(words):
            pos[w] += share * x
            often[w] += x
            seen[w] += share
            rows[w] += 1
        for q in {q for q in zip(words, words[1:]) if "ༀ" <= q[0][0] <= "࿿" and "ༀ" <= q[1][0] <= "࿿"}:
            pair_pos[q] += share * x
            pair_often[q] += x
            pair_seen[q] += share
    every = weight.sum()
    p = (chance * weight).sum()
    n = every - p
    telling = lambda k, c: k / c > 4 * p / every and _g2(k, p, c - k, n) > 6
    learned = {w for w, k in pos.items() if seen[w] >= 1.4 and len(w) >= 4 and _LATIN.fullmatch(w) and telling(k, often[w])}
    function = {w for w, x in often.items() if x > every / 25}
    pairs = {q: "<term>" for q, k in pair_pos.items() if pair_seen[q] >= 1.2 and not function & set(q) and k > 0.25 * pair_often[q] and _g2(k, p, pair_often[q] - k, n) > 10}
    words = latin | learned
    common = common_words(words) if common_words else {w for w, c in rows.items() if c >= COMMON and w not in words}
    lexicon = Lexicon(words, {**pairs, **phrases}, common - words)
    numbers = {}
    reader = Reader(lexicon, numbers, grow=True)
    batch = Batch(reader, [t for t, *_ in sample])
    f = _Features(batch, numbers)
    prior = f.prior(numbers)
    w_row = weight[f.owner]
    size = np.maximum(np.bincount(f.owner, minlength=f.docs), 1)
    guilt = (chance / size)[f.owner]
    states = [(prior_odds, prior.copy()) for _ in range(folds)]
    z = np.zeros(0)
    for step in range(rounds):
        z = _held_out(f, guilt, w_row, prior, folds, states, 30 if step < rounds - 1 else 60)
        guilt = _guilt(z, f, votes)
    top = np.full(f.docs, NONE)
    np.maximum.at(top, f.owner, z)
    bar = best_threshold(top, votes, weight)
    bias, weights = logistic(f.rows, f.cols, f.count, f.width, guilt, w_row, prior, states[0], RIDGE, 200)
    tables, start = [], 0
    for codes in f.codes:
        x = weights[start : start + len(codes)]
        start += len(codes)
        keep = np.abs(x) > 1e-4
        tables.append((codes[keep], x[keep]))
    used = {int(c) for c in tables[0][0]} | {v for codes, _ in tables[1:] for c in codes.tolist() for v in (c // f.base**2, c // f.base % f.base, c % f.base)}
    kept = {w: v for w, v in numbers.items() if v in used or v in reader.finds or any(v in q for q in reader.phrases)}
    return Model(lexicon, kept, f.base, bias - bar, tables)


_scorers: dict[str, Scorer] = {}


def _scored(batches, shared):
    scorer = _scorers.get(shared.value.key)
    if scorer is None:
        _scorers.clear()
        scorer = _scorers[shared.value.key] = Scorer(shared.value)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scorer.scores(batch.column("text").to_pylist()))], ["id", "score"])


def _near_lexicon(batches, shared, limit: int = 500_000):
    """(word, documents): words that would be read as a lexicon word, and under "" all documents with text."""
    read, cache, found = Reader(Lexicon(shared.value, {}), {}), {}, Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            found[""] += 1
            if len(cache) >= limit:
                cache = {}
            near = set()
            for raw in set(read.parts(text)):
                w = cache.get(raw)
                if w is None:
                    w = read.form(raw)
                    w = cache[raw] = w if w != read.plain(raw) else ""
                if w:
                    near.add(w)
            found.update(near)
    yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["word", "n"])


def common_near(docs: DataFrame, text: str, lexicon: set[str]) -> set[str]:
    """Words within the automaton's reach of the lexicon that stand in too many of all documents to be misspellings."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lambda it: _near_lexicon(it, shared), "word string, n long")
    counts = dict(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).collect())  # near words only
    return {w for w, n in counts.items() if w and n >= counts[""] * COMMON_SHARE}


def labelled_sample(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, rater: str, positives: int, negatives: int) -> list[tuple[str, int, int, float]]:
    """Labelled documents with their votes: all, up to the bounds, else the first by a hash of the number.

    The last field is how many labelled documents of its class, with or without a positive vote, a row stands for.
    """
    votes = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("vote"), F.col(rater).cast("string").alias("rater")).where("id is not null and vote in (0, 1)").distinct()
    each = votes.groupBy("id").agg(F.sum("vote").alias("k"), F.count("*").alias("n"))
    sizes = each.agg(F.count_if(F.col("k") > 0), F.count_if(F.col("k") == 0)).first()
    stands = [max(1.0, all_ / most) if most else 0.0 for all_, most in zip(sizes, (positives, negatives))]
    some = each.where("k > 0").orderBy(F.xxhash64("id")).limit(positives).unionByName(each.where("k = 0").orderBy(F.xxhash64("id")).limit(negatives))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return [(r[1], r[2], r[3], stands[0 if r[2] else 1]) for r in rows.join(F.broadcast(some), "id").select("id", "text", "k", "n").orderBy("id").collect()]


def scored(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, rater: str, terms: DataFrame, term: str, category: str, positives: int = 3000, negatives: int = 4000, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, score, keep...): every document; a score above THRESHOLD counts as abusive."""
    listed = sorted((r[0], r[1] or "other") for r in terms.select(F.col(term).cast("string"), F.col(category).cast("string")).where(F.col(term).isNotNull()).distinct().limit(MOST_TERMS + 1).collect())
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms can't be broadcast")
    model = fit(labelled_sample(docs, doc_id, text, labels, label_id, label, rater, positives, negatives), listed, common_words=lambda lexicon: common_near(docs, text, lexicon))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(c.alias(n) for n, c in (keep or {}).items())).where("id is not null")
    if not keep:
        return rows.mapInArrow(lambda it: _scored(it, shared), "id long, score double")
    names = list(keep)
    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def with_kept(batches):
        for batch in batches:
            (out,) = _scored([batch], shared)
            yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(n) for n in names)], ["id", "score", *names])

    return rows.mapInArrow(with_kept, "id long, score double" + kinds)


def source_name(c: str) -> Column:
    """Source names written unevenly: case, edges, and blanks or hyphens for underscores don't count."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s\-]+", "_"), F.lit("")), F.lit("unknown"))
