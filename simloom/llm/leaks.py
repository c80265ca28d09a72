"""Problem 8: evaluation sentences that stand in documents, by greedy string tiling.

All texts are tokens of one space: transliterated syllables are put into Tibetan script, so either script of a sentence
meets either script of a document.  Windows of two tokens are hashed by a rolling (Karp-Rabin) polynomial over all
documents; windows that also stand in an evaluation sentence are seeds.  Where as many seeds of one sentence lie together
as any stretch has that counts as leaked, the longest matches that don't overlap are marked greedily, longest first; the tiles that follow one another in both texts
are chained, and a document leaks a sentence if one chain covers at least half of it with few tokens changed.

The evaluation sentences are a fixed, small table; their number is checked before they are sent to the executors.

Cases: null and empty texts leak nothing and are not leaked; a sentence of one token is a short quotation wherever it
stands and is not searched; several leaks of one sentence in a document are one row, the longest; copies of documents are rows of
their own; an item leaks if any of its sentences does.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Common, content_tokens

SEED = 2
#: Most evaluation sentences that are broadcast.
MOST = 200_000
_EDGE = ".,;:?!\"()“”«»…*'"


class Sentences:
    """Token sequences of the evaluation items with the rolling hashes of their windows."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.known: dict[str, int] = {}
        self.items: list[str] = []
        self.seqs: list[list[int]] = []
        seen = set()
        for item, tokens in rows:
            seq = tuple(self.known.setdefault(t, len(self.known)) for t in tokens)
            if len(seq) >= SEED and (item, seq) not in seen:
                seen.add((item, seq))
                self.items.append(item)
                self.seqs.append(list(seq))
        where = defaultdict(list)
        self.base = len(self.known) + 1
        for k, seq in enumerate(self.seqs):
            for j, h in enumerate(self.rolling(np.array(seq, np.int64)).tolist()):
                where[h].append((k, j))
        self.hashes = np.array(sorted(where), np.int64)
        # sentences by window: of each of the sorted hashes those from one end to the next
        owners = [sorted({k for k, _ in where[h]}) for h in self.hashes.tolist()]
        self.owners = np.array([k for o in owners for k in o], np.int64)
        self.ends = np.cumsum([0, *map(len, owners)])
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        self.needed = np.array([least_seeds(len(s)) for s in self.seqs], np.int64)

    def rolling(self, ids: np.ndarray) -> np.ndarray:
        """Hash of every window of SEED tokens; exact while base**SEED fits 63 bits, modulo 2**64 beyond."""
        h = np.zeros(max(0, len(ids) - SEED + 1), np.int64)
        with np.errstate(over="ignore"):
            for k in range(SEED):
                h = h * np.int64(self.base) + (ids[k : k + len(h)] + 1)
        return h


def tiles(doc: list[int], seq: list[int], shortest: int = 2) -> list[tuple[int, int, int]]:
    """Longest matches first, none overlapping another in either text: (place in doc, place in seq, length)."""
    at = defaultdict(list)
    for j, t in enumerate(seq):
        at[t].append(j)
    matches = []
    for p, t in enumerate(doc):
        for j in at.get(t, ()):
            if p and j and doc[p - 1] == seq[j - 1]:
                continue  # inside a longer one
            n = 1
            while p + n < len(doc) and j + n < len(seq) and doc[p + n] == seq[j + n]:
                n += 1
            if n >= shortest:
                matches.append((n, p, j))
    used_d, used_s, out = [False] * len(doc), [False] * len(seq), []
    matches.sort(key=lambda m: (-m[0], m[1], m[2]))
    while matches:
        n, p, j = matches.pop(0)
        free = [k for k in range(n) if not used_d[p + k] and not used_s[j + k]]
        if len(free) == n:
            out.append((p, j, n))
            for k in range(n):
                used_d[p + k] = used_s[j + k] = True
            continue
        # what is left of it in one piece comes back at its own length
        start = None
        rest = []
        for k in [*range(n), n]:
            ok = k < n and not used_d[p + k] and not used_s[j + k]
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= shortest:
                    rest.append((k - start, p + start, j + start))
                start = None
        if rest:
            matches = sorted([*matches, *rest], key=lambda m: (-m[0], m[1], m[2]))
    return sorted(out)


def best_chain(found: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """(covered stretch of the sentence, tokens changed in it, start in doc, end in doc) of the best chain of tiles in order."""
    best = (0, 0, 0, 0)
    score, first, changed = [], [], []
    for x, (p, j, n) in enumerate(found):
        s, f, c = n, x, 0
        for y in range(x):
            q, i, m = found[y]
            gap_d, gap_s = p - q - m, j - i - m
            if gap_d >= 0 and gap_s >= 0 and score[y] + n - max(gap_d, gap_s) > s:
                s, f, c = score[y] + n - max(gap_d, gap_s), first[y], changed[y] + max(gap_d, gap_s)
        score.append(s)
        first.append(f)
        changed.append(c)
        stretch = j + n - found[f][1]
        if (stretch - 2 * c, stretch) > (best[0] - 2 * best[1], best[0]):
            best = (stretch, c, found[f][0], p + n)
    return best


def leaks(stretch: int, changed: int, n: int) -> bool:
    """At least half of the sentence follows, with at most a few tokens changed."""
    return 2 * stretch >= n and changed <= max(4, stretch // 5)


def least_seeds(n: int) -> int:
    """Windows of SEED tokens that any leaked stretch of a sentence of n tokens holds, by what ``leaks`` accepts.

    A stretch s of at least half the sentence has c tokens changed; the best chain has at most s / 2 of them.  What is
    left lies in tiles of SEED tokens and more, at most one more than there are changes.
    """
    s = max(SEED, -(-n // 2))
    c = min(max(4, s // 5), s // 2)
    same = max(SEED, s - c)
    return same - min(c + 1, same // SEED) * (SEED - 1)


def _groups(sent: Sentences, at: np.ndarray, spot: np.ndarray, starts: np.ndarray):
    """(document, sentence, first and last place) of seeds that lie together and are as many as a leak needs."""
    many = sent.ends[spot + 1] - sent.ends[spot]
    place = np.repeat(at, many)
    step = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    which = sent.owners[np.repeat(sent.ends[spot], many) + step]
    doc = np.searchsorted(starts, place, side="right") - 1
    order = np.lexsort((place, which, doc))
    doc, which, place = doc[order], which[order], place[order]
    if not len(place):
        return
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]) | (place[1:] != place[:-1]))
    doc, which, place = doc[fresh], which[fresh], place[fresh]
    cut = np.append(True, (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]) | (place[1:] - place[:-1] > sent.lengths[which[1:]]))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(place)) - 1
    enough = last - first + 1 >= sent.needed[which[first]]
    for f, e in zip(first[enough].tolist(), last[enough].tolist()):
        yield int(doc[f]), int(which[f]), int(place[f]), int(place[e])


def _scan(batches, sent: Sentences):
    common = Common()
    cache: dict[str, int] = {}
    known, hashes = sent.known, sent.hashes

    def number(t: str) -> int:
        v = cache.get(t)
        if v is None:
            if len(cache) > 500_000:
                cache.clear()
            w = t.strip(_EDGE) or t
            v = known.get(common.one(t), -1)
            if v < 0:
                v = known.get(common.one(w), -1)
            cache[t] = v
        return v

    for batch in batches:
        ids, flat, starts = batch.column("id").to_pylist(), [], []
        for text in batch.column("text").to_pylist():
            starts.append(len(flat))
            flat.extend([number(t) for t in content_tokens(text)] if text else ())
            flat.extend((-1,) * SEED)
        a = np.array(flat, np.int64)
        h = sent.rolling(a)
        valid = np.ones(len(h), bool)
        for k in range(SEED):
            valid &= a[k : k + len(h)] >= 0
        at = np.flatnonzero(valid)
        if not len(at) or not len(hashes):
            continue
        spot = np.searchsorted(hashes, h[at]).clip(max=len(hashes) - 1)
        hit = hashes[spot] == h[at]
        rows: dict[tuple[int, str], tuple] = {}
        for d, k, first, last in _groups(sent, at[hit], spot[hit], np.array(starts)):
            seq, n = sent.seqs[k], len(sent.seqs[k])
            end = starts[d + 1] if d + 1 < len(starts) else len(flat)
            lo, hi = max(starts[d], first - n), min(end, last + n + SEED)
            stretch, changed, s, e = best_chain(tiles(flat[lo:hi], seq))
            if leaks(stretch, changed, n):
                row = (stretch / n, changed, lo + s - starts[d], lo + e - starts[d])
                key = (d, sent.items[k])
                if key not in rows or row[0] > rows[key][0]:
                    rows[key] = row
        keys = list(rows)
        cols = [pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.string())]
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
        cols += [pa.array([rows[x][c] for x in keys], kind) for c, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, ["id", "item", "coverage", "changed", "first_token", "end_token"])


FOUND = "id long, item string, coverage double, changed int, first_token int, end_token int"


def sentences(items: DataFrame, id_col: str, columns: list[str]) -> Sentences:
    n = items.count()
    if n * len(columns) > MOST:
        raise ValueError(f"{n} items: more than {MOST} sentences can't be broadcast; search them in parts")
    common = Common()
    rows = []
    for r in items.select(id_col, *columns).collect():
        for text in r[1:]:
            if r[0] is not None and (t := content_tokens(text)):
                rows.append((r[0], common(t)))
    return Sentences(sorted(rows))


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, columns: list[str]) -> DataFrame:
    """(id, item, coverage, changed, first_token, end_token): documents that hold a stretch of an item's sentence."""
    sent = sentences(items, item_id, columns)
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(lambda it: _scan(it, shared.value), FOUND)
