"""Problem 3: one form for texts that look the same.

Look-alike classes are the union-find closure over strings and code points of all pairs that are drawn alike (by the
character database's rules and a list of letters of other alphabets).  Of each class the member that is most frequent
in the corpus stands for all; invisible characters stand for nothing and vanish.  Texts are rewritten greedily from
the left, longest member first, by one automaton over all members, until nothing changes.

Cases: null stays null and empty stays empty; neither takes part in pairs, nor do texts without any letter. Case,
visible accents, notes, punctuation and the number of spaces count as differences. Ties between members go to the
shorter, then to the smaller by code point. Repeated rows (same number) are one row.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stage
from .text import PLACEHOLDERS, alike_pairs

PAIR_KEY = "field int, k1 long, k2 long, raw long"


class UnionFind:
    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def look_alike_classes(pairs: list[tuple[str, str]] | None = None) -> list[list[str]]:
    """Classes of two and more strings that look the same, directly or through others."""
    u = UnionFind()
    for a, b in alike_pairs() if pairs is None else pairs:
        u.union(a, b)
        composed = unicodedata.normalize("NFC", b)
        if composed != b:
            u.union(b, composed)
    classes: dict[str, list[str]] = {}
    for x in list(u.up):
        classes.setdefault(u.find(x), []).append(x)
    return sorted(sorted(c) for c in classes.values() if len(c) > 1)


def _counted(batches, columns: list[str], members: list[str]):
    single = [m for m in members if len(m) == 1]
    longer = [m for m in members if len(m) > 1]
    codes = np.array([ord(m) for m in single])
    for batch in batches:
        totals: dict[str, int] = {}
        for c in columns:
            text = "\n".join(x for x in batch.column(c).to_pylist() if x)
            have = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x10000)
            for m, n in zip(single, have[codes].tolist()):
                if n:
                    totals[m] = totals.get(m, 0) + n
            for m in longer:
                if all(have[ord(x)] for x in m) and (n := text.count(m)):
                    totals[m] = totals.get(m, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["member", "n"])


def member_counts(df: DataFrame, columns: list[str], classes: list[list[str]]) -> dict[str, int]:
    """How often each member of the classes occurs in the columns, over all rows; no more numbers than members."""
    members = sorted({m for c in classes for m in c if m})
    counted = df.select(*columns).mapInArrow(lambda it: _counted(it, columns, members), "member string, n long")
    return {r[0]: r[1] for r in counted.groupBy("member").agg(F.sum("n")).collect()}


def representatives(classes: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Member to the member that stands for its class; members that stand for themselves are left out."""
    out = {}
    for c in classes:
        best = "" if "" in c else max(c, key=lambda m: (counts.get(m, 0), -len(m), [-ord(x) for x in m]))
        out |= {m: best for m in c if m != best and m}
    return out


class Rewriter:
    """Leftmost-longest replacement of all patterns at once."""

    def __init__(self, to: dict[str, str]):
        self.machine = ahocorasick.Automaton()
        for m, best in to.items():
            self.machine.add_word(m, (len(m), best))
        self.machine.make_automaton()
        self.worth = re.compile("[" + "".join(sorted({re.escape(m[-1]) for m in to})) + "̀-ͯ]|[ིེུ-ཽ]ཱ")

    def __call__(self, s: str | None) -> str | None:
        if not s or s.isascii() or not self.worth.search(s):
            return s
        s = unicodedata.normalize("NFC", s)
        for _ in range(len(s) + 2):
            out, at = [], 0
            for end, (n, best) in self.machine.iter_long(s):
                out += (s[at : end - n + 1], best)
                at = end + 1
            if not out:
                return s
            new = "".join(out) + s[at:]
            if new == s:
                return s
            s = new
        raise RuntimeError("rewriting doesn't end: two members stand for one another")


def _has_letters(s: str) -> bool:
    return s.strip() not in PLACEHOLDERS and any(c.isalpha() for c in s)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _keyed(batches, to: dict[str, str], columns: list[str]):
    rewrite = Rewriter(to)
    for batch in batches:
        ids, fields, k1, k2, raw = [], [], [], [], []
        number = batch.column("id").to_pylist()
        for f, c in enumerate(columns):
            for i, s in zip(number, batch.column(f"t{f}").to_pylist()):
                if s and i is not None and _has_letters(s):
                    h = xxhash.xxh3_128_intdigest(rewrite(s).encode("utf-8", "surrogatepass"))
                    ids.append(i)
                    fields.append(f)
                    k1.append(_signed(h >> 64))
                    k2.append(_signed(h & 0xFFFFFFFFFFFFFFFF))
                    raw.append(_signed(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.int32()), *(pa.array(x, pa.int64()) for x in (k1, k2, raw))], ["id", "field", "k1", "k2", "raw"])


def chosen_forms(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """What is rewritten to what in this corpus."""
    classes = look_alike_classes()
    return representatives(classes, member_counts(df, columns, classes))


KEYS = ["field", "k1", "k2"]


def _looks(df: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(field, k1, k2, id, raw): rows by their look; and the looks that are stored in more than one form."""
    to = chosen_forms(df, columns)
    rows = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(columns)))
    keyed = stage(rows.mapInArrow(lambda it: _keyed(it, to, columns), f"id long, {PAIR_KEY}"), "looks")
    return keyed, keyed.groupBy(*KEYS).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*KEYS)


def alike_pairs_of_rows(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(a, b), a < b: rows whose values in the same column look alike and differ as stored.

    A class of rows yields pairs only between its different stored forms; classes of one form yield none and are
    dropped before rows meet.
    """
    keyed, mixed = _looks(df, id_col, columns)
    members = stage(keyed.join(mixed, KEYS).distinct(), "alike")
    a, b = members.withColumnRenamed("id", "a"), members.withColumnsRenamed({"id": "b", "raw": "raw_b"})
    return a.join(b, KEYS).where("raw <> raw_b and a < b").select("a", "b").distinct()


def alike_classes(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id_col, field, first, links): every row of a look that is stored in several forms, the look's smallest row, and to
    how many rows of another form it is linked. Links are counted from the sizes of forms; no pair is formed."""
    keyed, mixed = _looks(df, id_col, columns)
    members = keyed.join(mixed, KEYS).distinct()
    forms = stage(members.groupBy(*KEYS, "raw").agg(F.count("*").alias("n"), F.min("id").alias("first")), "forms")
    looks = forms.groupBy(*KEYS).agg(F.sum("n").alias("all"), F.min("first").alias("first"))
    sizes = forms.select(*KEYS, "raw", "n").join(looks, KEYS)
    names = F.array(*(F.lit(c) for c in columns))
    return members.join(sizes, [*KEYS, "raw"]).select(F.col("id").alias(id_col), F.get(names, F.col("field")).alias("field"), "first", (F.col("all") - F.col("n")).alias("links"))


def _rewritten(batches, to: dict[str, str], places: list[int]):
    rewrite = Rewriter(to)
    for batch in batches:
        arrays = list(batch.columns)
        for k in places:
            arrays[k] = pa.array([rewrite(x) for x in arrays[k].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(batch.schema, arrays)]))


def one_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with look-alikes in the columns rewritten to the form most frequent in it; all else as it was."""
    to = chosen_forms(df, columns)
    places = [df.columns.index(c) for c in columns]
    return df.mapInArrow(lambda it: _rewritten(it, to, places), df.schema)
