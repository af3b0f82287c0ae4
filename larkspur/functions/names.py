"""Comparison of person names: in Python for resolving in order, and as Column expressions for joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_LETTERS = 4
ABBREVIATED, SAME_INITIALS = 0.9, 0.7


def normalize_name(value: str) -> str:
    """Letters, digits and spaces in lower case, without short words in front that look like titles."""
    words = value.split()
    while words:
        first = words[0]
        short = len(first.rstrip(".")) <= TITLE_LETTERS
        dotted = first.endswith(".") and short
        plain = first.isalpha() and short and len(words) > 1 and len(words[1]) > TITLE_LETTERS
        if not (dotted or plain):
            break
        words.pop(0)
    return "".join(c.lower() for c in " ".join(words) if c.isalnum() or c.isspace()).strip()


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def abbreviates(short: str, full: str) -> bool:
    """Is each word of a name the start of the word at its place in another name of as many words or more?"""
    parts, words = [p.rstrip(".").lower() for p in short.split()], full.lower().split()
    return len(parts) <= len(words) and all(w.startswith(p) for p, w in zip(parts, words))


def initials(name: str) -> str:
    return "".join(w[0].lower() for w in name.split())


def similarity(a: str, b: str) -> float:
    """0 to 1: the best of edit distance, abbreviation, equal initials and shared words."""
    x, y = normalize_name(a), normalize_name(b)
    if x == y:
        return 1.0
    scores = [1 - edit_distance(x, y) / max(len(x), len(y))]
    if abbreviates(a, b) or abbreviates(b, a):
        scores.append(ABBREVIATED)
    if len(initials(x)) >= 2 and initials(x) == initials(y):
        scores.append(SAME_INITIALS)
    words, others = set(x.split()), set(y.split())
    if words and others:
        shared = len(words & others) / max(len(words), len(others))
        if shared > 0.5:
            scores.append(shared)
    return max(scores)


def _words(name: Column) -> Column:
    return F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")


def normalized(name: Column) -> Column:
    """normalize_name as an expression."""

    def shed(kept: Column, word: Column) -> Column:
        return F.when(F.size(kept) == 0, kept).otherwise(F.when(_titled(kept), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept))

    words = _words(name)
    left = F.aggregate(words, words, shed)
    return F.trim(F.lower(F.regexp_replace(F.array_join(left, " "), r"(?U)[^\p{L}\p{N}\s]", "")))


def _titled(words: Column) -> Column:
    first, second = F.element_at(words, 1), F.get(words, F.lit(1))
    short = F.length(F.regexp_replace(first, r"\.+$", "")) <= TITLE_LETTERS
    dotted = first.endswith(".") & short
    plain = first.rlike(r"^\p{L}+$") & short & F.coalesce(F.length(second) > TITLE_LETTERS, F.lit(False))
    return dotted | plain


def initials_of(name: Column) -> Column:
    return F.lower(F.array_join(F.transform(_words(name), lambda w: F.substring(w, 1, 1)), ""))


def abbreviation_of(short: Column, full: Column) -> Column:
    """abbreviates as an expression."""
    parts = F.transform(_words(short), lambda w: F.lower(F.regexp_replace(w, r"\.+$", "")))
    words = F.transform(_words(full), F.lower)
    pairs = F.zip_with(parts, words, lambda p, w: p.isNull() | F.coalesce(w.startswith(p), F.lit(False)))
    return (F.size(parts) <= F.size(words)) & F.forall(pairs, lambda ok: ok)


def similarity_of(a: Column, b: Column) -> Column:
    """similarity as an expression."""
    x, y = normalized(a), normalized(b)
    longest = F.greatest(F.length(x), F.length(y))
    edits = 1 - F.levenshtein(x, y) / longest
    short = F.when(abbreviation_of(a, b) | abbreviation_of(b, a), F.lit(ABBREVIATED)).otherwise(F.lit(0.0))
    ix, iy = initials_of(x), initials_of(y)
    same = F.when((ix == iy) & (F.length(ix) >= 2), F.lit(SAME_INITIALS)).otherwise(F.lit(0.0))
    wx, wy = F.array_distinct(_words(x)), F.array_distinct(_words(y))
    shared = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1))
    return F.when(x == y, F.lit(1.0)).otherwise(F.greatest(edits, short, same, F.when(shared > 0.5, shared).otherwise(F.lit(0.0))))
