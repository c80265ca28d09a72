"""Column functions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BASE = 0x4DFF  # words become single characters from here on, for edit distance by word


def null_if_nan(c: str | Column) -> Column:
    """NaN counts as missing everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def strip(c: str | Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_sentence(c: str | Column) -> Column:
    """Notes in square brackets removed (within a line), ends stripped."""
    return strip(F.regexp_replace(c, r"\[.*?\]", ""))


def words(c: str | Column) -> Column:
    """Slash is a blank; pieces between white space."""
    return F.filter(F.split(F.translate(c, "/", " "), r"(?U)\s+"), lambda x: x != "")


def word_distance(a: str | Column, b: str | Column, at_most: int | None = None) -> Column:
    """Edits of whole words from a to b; with at_most, -1 beyond it. Null if either is null."""
    both = F.struct(words(a).alias("a"), words(b).alias("b"))
    return _let(both, lambda w: _let(F.struct(w["a"].alias("a"), w["b"].alias("b"), F.array_distinct(F.concat(w["a"], w["b"])).alias("known")), lambda x: _distance(x["a"], x["b"], x["known"], at_most)))


def _let(value: Column, body) -> Column:
    """The body over a value that is computed once, not at each place where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _distance(ta: Column, tb: Column, known: Column, at_most: int | None) -> Column:
    def coded(t: Column) -> Column:
        one = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, x) + F.lit(WORD_BASE)), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(t, one), "")

    return F.levenshtein(coded(ta), coded(tb), at_most) if at_most is not None else F.levenshtein(coded(ta), coded(tb))


def batch_key(c: str | Column) -> Column:
    return F.substring_index(c, "_", 2)


def score_type(c: str | Column) -> Column:
    """'emr' where the flag is false, 'bws' where it is true or missing."""
    return F.when(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(True)), "bws").otherwise("emr")


def one_set_letter(c: str | Column) -> Column:
    """_A_ to _D_ become _X_; null becomes the empty string."""
    out = F.coalesce(c, F.lit(""))
    for letter in "ABCD":
        out = F.replace(out, F.lit(f"_{letter}_"), F.lit("_X_"))
    return out


def is_no_fit(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))) == "true"


def short_name(c: str | Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def to_number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS double)")


def answer_labels(c: str | Column) -> tuple[Column, Column]:
    """Most and least similar label (1 to 4) of an annotator's answer; null where it has none."""
    found = (F.regexp_extract(c, rf"(?i){w}\s*similar\s*[:\-]?\s*P([1-4])", 1) for w in ("most", "least"))
    return tuple(F.when(x != "", x.cast("int")) for x in found)


def candidate_uid(*cols: str) -> Column:
    """Hash of the fields; null counts as empty."""
    return F.sha1(F.concat_ws("␞", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


def without_thinking(c: str | Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def mapped_parts(c: str | Column, names: dict[str, str]) -> Column:
    """Parts between plus signs, each by its name in the mapping, or as it is."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.array_join(F.transform(F.split(c, r"\+"), lambda p: F.coalesce(F.try_element_at(table, F.trim(p)), F.trim(p))), "+")


def combined_weights(c: str | Column) -> Column:
    """'combined(a=0.2,b=0.8)' as a map of weights; null for other strings."""
    inner = F.regexp_extract(c, r"^combined\((.*)\)$", 1)
    return F.when(inner != "", F.transform_values(F.str_to_map(inner, F.lit(","), F.lit("=")), lambda _, v: v.cast("double")))


def pair_prompt(a: list[str], b: list[str]) -> Column:
    """Four numbered pairs as an annotator gets them."""
    form = "\n".join(f"P{k}: A: %s | B: %s" for k in range(1, len(a) + 1))
    return F.format_string(form, *(F.coalesce(F.col(x), F.lit("")) for pair in zip(a, b) for x in pair))
