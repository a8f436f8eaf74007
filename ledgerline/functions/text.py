"""Text scoring as column expressions; Arrow functions only for sequence alignment.

``strict`` selects the second-generation behaviour where the two differ.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ASCII punctuation, the articles, and the scorers' patterns.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"
SPACES = r"(?U)\s+"
DIGITS = r"(?U)(\d+)"
PARAGRAPH = r"Paragraph (\d+)"


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, articles to blanks, single blanks."""
    x = F.regexp_replace(F.lower(x), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, ARTICLES, " "), SPACES, " "))


def tokens(x: Column) -> Column:
    """Blank-separated tokens; the empty string has none."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " "))


def let(value: Column, body) -> Column:
    """``body(value)``, with the value made once: a lambda's expressions are evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _copies(ordered: Column) -> Column:
    """The words of a sorted array, each with the number of its copy: in time of the array's length."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    numbered = lambda w, n: F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(w, F.lit("\x01"), k.cast("string")))
    return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: numbered(F.get(ordered, at), F.coalesce(F.get(s, k + 1), F.size(ordered)) - at))))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the multiset overlap of normalized tokens; 0 without overlap. The overlap is that of the sets of numbered copies."""

    def score(z: Column) -> Column:
        same = F.size(F.array_intersect(_copies(z["p"]), _copies(z["g"])))
        return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(z["p"]) + F.size(z["g"])))

    words = lambda x: F.array_sort(tokens(normalize_answer(x)))
    return let(F.struct(words(prediction).alias("p"), words(gold).alias("g")), score)


def _f_measure(lcs: int, n: int, m: int) -> float:
    if not lcs:
        return 0.0
    p, r = lcs / n, lcs / m
    return 2 * r * p / (r + p + 1e-8)


def sentences(text: str) -> list[list[str]]:
    """The words of a text's sentences, which end at full stops; one of blanks alone has an empty word, and nothing between two stops is no sentence."""
    return [" ".join(part.split()).split(" ") for part in text.split(".") if part]


def lcs_words(a: list[str], b: list[str]) -> set[str]:
    """The words of a longest common subsequence; of several, the one met going back from both ends with steps in b first.

    The table's rows are kept as the bits of one number each: up to place i of
    row j it holds i less the bits set, so long sentences take little memory.
    """
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    rows = [(1 << len(a)) - 1]
    every = rows[0]
    for y in b:
        row = rows[-1]
        hit = row & places.get(y, 0)
        rows.append(((row + hit) | (row - hit)) & every)
    held = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    found, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(a[i - 1])
            i, j = i - 1, j - 1
        elif held(i - 1, j) > held(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = row = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def _rouge(p, g) -> float:
    """Over sentences: distinct words in the union of each reference sentence's common subsequences with all predicted ones, against the distinct words of either side."""
    mine, theirs = sentences(str(p or "")), sentences(str(g or ""))
    if not mine or not theirs:
        return 0.0
    union: set[str] = set()
    for reference in theirs:
        for sentence in mine:
            union |= lcs_words(reference, sentence)
    return _f_measure(len(union), len({w for x in mine for w in x}), len({w for x in theirs for w in x}))


@F.pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """Summary-level ROUGE-L F over blank-separated words; 0 where either side has no sentence."""
    return pd.Series([_rouge(p, g) for p, g in zip(prediction, gold, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def rouge_l_best(prediction: pd.Series, references: pd.Series) -> pd.Series:
    """The largest ROUGE-L F over the references; 0 without any."""
    return pd.Series([max((_rouge(p, g) for g in (refs if refs is not None else ())), default=0.0) for p, refs in zip(prediction, references, strict=True)], dtype=float)


def classification(prediction: Column, gold: Column, classes: Column, strict: bool = True) -> Column:
    """1 / matches if the gold class is in the prediction, after dropping matches that are part of the gold class.

    ``strict`` drops while walking the list, so the match after each dropped
    one is passed over; otherwise all are looked at.
    """
    found = F.filter(classes, lambda c: F.contains(prediction, c))
    part = lambda m: F.contains(gold, m) & (m != gold)
    if strict:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))
        step = lambda st, m: F.when(st["skip"] | ~part(m), F.struct(F.concat(st["kept"], F.array(m)).alias("kept"), F.lit(False).alias("skip"))).otherwise(F.struct(st["kept"].alias("kept"), F.lit(True).alias("skip")))
        kept = F.aggregate(found, start, step, lambda st: st["kept"])
    else:
        kept = F.filter(found, lambda m: ~part(m))
    return F.when(F.array_contains(kept, gold), 1.0 / F.size(kept)).otherwise(0.0)


def count_score(prediction: Column, gold: Column) -> Column:
    """Share of the numbers in the prediction that equal gold as text; 0 without numbers."""
    numbers = F.regexp_extract_all(prediction, F.lit(DIGITS), 1)
    return F.when(F.size(numbers) == 0, 0.0).otherwise(F.size(F.filter(numbers, lambda n: n == gold)) / F.size(numbers))


def retrieval_score(prediction: Column, gold: Column) -> Column:
    """As count_score, for the paragraph number that gold names; gold without one raises."""
    number = F.regexp_extract(gold, PARAGRAPH, 1)
    return F.when(number == "", F.raise_error(F.lit("the reference names no paragraph")).cast("double")).otherwise(count_score(prediction, number))


def code_line(prediction: Column) -> Column:
    """The first line without backtick, # and //; empty if none."""
    lines = F.split(F.regexp_replace(prediction, "^\n+", ""), "\n")
    return F.coalesce(F.get(F.filter(lines, lambda x: ~(F.contains(x, F.lit("`")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("//")))), F.lit(0)), F.lit(""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity in whole percent."""
    from difflib import SequenceMatcher

    return pd.Series([round(100 * SequenceMatcher(None, x or "", y or "").ratio()) / 100 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def sequence_ratio_best(a: pd.Series, references: pd.Series) -> pd.Series:
    """The largest similarity over the references; 0 without any."""
    from difflib import SequenceMatcher

    ratio = lambda x, y: round(100 * SequenceMatcher(None, x or "", y or "").ratio()) / 100
    return pd.Series([max((ratio(x, y) for y in (refs if refs is not None else ())), default=0.0) for x, refs in zip(a, references, strict=True)], dtype=float)


def code_similarity(prediction: Column, gold: Column) -> Column:
    return sequence_ratio(code_line(prediction), gold)


def best_reference(references: Column, score, strict: bool = True) -> Column:
    """Largest score over the references. Empty references raise if ``strict``, else give 0."""
    empty = F.raise_error(F.lit("no references")).cast("double") if strict else F.lit(0.0)
    return F.when(F.coalesce(F.size(references), F.lit(0)) <= 0, empty).otherwise(F.array_max(F.transform(references, score)))


def dispatch(scorer: Column, prediction: Column, references: Column, classes: Column, strict: bool = True) -> Column:
    """The task's scorer, at its best over all references; an unknown scorer gives null. The two alignment scorers are Arrow functions, which get only their own rows' references."""
    by = {
        "qa_f1": lambda g: token_f1(prediction, g),
        "classification": lambda g: classification(prediction, g, classes, strict),
        "count": lambda g: count_score(prediction, g),
        "retrieval": lambda g: retrieval_score(prediction, g),
    }
    out = F.lit(None).cast("double")
    for name, f in by.items():
        out = F.when(scorer == name, best_reference(references, f, strict)).otherwise(out)
    there = best_reference(references, lambda g: F.lit(1.0), strict)
    for name, text, f in (("rouge_l", prediction, rouge_l_best), ("code_similarity", code_line(prediction), sequence_ratio_best)):
        own = f(F.when(scorer == name, text), F.when(scorer == name, references))
        out = F.when(scorer == name, there * own).otherwise(out)
    return out


def postprocess(prediction: Column, first_line: Column, strict: bool = True) -> Column:
    """First-line tasks: leading line feeds go, line one stays. The first generation strips blanks in either case."""
    line = F.substring_index(F.regexp_replace(prediction, "^\n+", ""), "\n", 1)
    out = F.when(first_line, line).otherwise(prediction)
    return out if strict else F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def fill_template(template: str, fields: dict[str, Column], strict: bool = True) -> Column:
    """The template with {name} replaced in a single pass: braces inside contents stay as they are. A null field raises, or (not ``strict``) is empty; a name that is not given raises at once."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    if gone := sorted({x for x in parts[1::2] if x not in fields}):
        raise ValueError(f"no field for {', '.join(gone)}")
    empty = lambda x: F.raise_error(F.lit(f"the prompt's field {x} is null")).cast("string") if strict else F.lit("")
    return F.concat(*(F.coalesce(fields[x], empty(x)) if k % 2 else F.lit(x) for k, x in enumerate(parts)))
