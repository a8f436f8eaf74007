"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or abstain on each document.
Expectation-maximisation over the counts of vote patterns estimates how each
labeller votes on either class; the posteriors of the patterns are soft labels
on which a hashed linear scorer is trained. The scorer decides.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import stage, table
from ledgerline.llm.wordtokens import Memo, slices, worker_cache

JUNK, GOOD, ABSTAIN = 0, 1, 2
#: Buckets of the hashed linear scorer.
BUCKETS = 1 << 14
_RUN = re.compile(r"(.)\1+")
_SIGNS = re.compile(r"[$%&*#@^~=+]{2,}|[!?]{2,}")


def word_kind(word: str) -> int:
    """0 ordinary, 1 with a run of signs, 2 in capitals, 3 bare signs, 4 with a digit, 5 over 40 characters."""
    if _SIGNS.search(word):
        return 1
    if len(word) > 40:
        return 5
    if len(word) > 1 and word.isupper():
        return 2
    if not any(c.isalnum() for c in word):
        return 3
    return 4 if any(c.isdigit() for c in word) else 0


def word_shape(word: str) -> str:
    """Letters as a or A, digits as 0, signs as they are; runs once. Of shapes over 12 characters, what they are made of."""
    shape = _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
    return shape if len(shape) <= 12 else "long " + "".join(sorted(set(shape)))


def bucket(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature) % (BUCKETS - 1) + 1  # 0 is the constant


def _distinct(different: int, n: int) -> float:
    """The share of different words, evened out for few words, and against the square root of their number where texts are so long that words must come again."""
    return (different + 5) / (n + 5) * max(1.0, n**0.5 / 72)


class Shares(dict):
    """What the labellers look at, of one text."""

    def __init__(self, text: str, kind):
        words = text.split()
        n = len(words)
        kinds = Counter(map(kind, words))
        lines = [x for x in text.split("\n") if x.strip()]
        super().__init__(
            words=n,
            signs=kinds[1] / n if n else 1.0,
            capitals=kinds[2] / n if n else 0.0,
            bare=kinds[3] / n if n else 0.0,
            digits=kinds[4] / n if n else 0.0,
            long=kinds[5] / (n + 10),  # in a few words, one long one says little
            repeats=sum(map(operator.eq, words, words[1:])) / n if n else 0.0,
            distinct=_distinct(len(set(words)), n),
            repeated_lines=1 - len(set(lines)) / len(lines) if lines else 0.0,
            ended=sum(x.rstrip()[-1] in ".!?\"')" for x in lines) / len(lines) if lines else 0.0,
        )


def _over(key: str, good: float, junk: float):
    return lambda s: JUNK if s[key] > junk else GOOD if s[key] <= good else ABSTAIN


#: name -> vote of a labeller on Shares. Two thresholds with a gap between, in which it abstains.
LABELLERS = {
    "signs": _over("signs", 0.02, 0.15),
    "capitals": _over("capitals", 0.08, 0.25),
    "bare": _over("bare", 0.03, 0.1),
    "repeats": _over("repeats", 0.06, 0.2),
    "distinct": lambda s: JUNK if s["distinct"] < 0.25 else GOOD if s["distinct"] > 0.45 else ABSTAIN,
    "lines": _over("repeated_lines", 0.15, 0.5),
    "long": lambda s: GOOD if s["long"] <= 0.01 else JUNK if s["long"] > 0.1 else ABSTAIN,
    "prose": lambda s: JUNK if not s["words"] else GOOD if s["ended"] >= 0.8 and s["signs"] + s["bare"] < 0.05 and s["capitals"] < 0.2 else ABSTAIN if s["ended"] > 0.2 else JUNK,
}


def pattern_of(shares: Shares) -> int:
    n = 0
    for vote in LABELLERS.values():
        n = n * 3 + vote(shares)
    return n


def votes_of(pattern: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.stack([pattern // 3 ** (k - 1 - j) % 3 for j in range(k)], 1)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, strength: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, vote probabilities [class, labeller, vote]).

    Starts from the share of good votes. A prior worth ``strength`` of all
    documents holds that a labeller that votes is mostly right, which keeps
    the two classes from swapping or splitting an all-clean corpus.
    """
    votes = votes_of(patterns)
    good, junk = (votes == GOOD).sum(1), (votes == JUNK).sum(1)
    post = np.where(junk == 0, 0.95, np.where(good > 3 * junk, 0.4, 0.05))
    post = np.where(good + junk == 0, 0.7, post)
    total = max(counts.sum(), 1.0)
    prior = np.empty((2, len(LABELLERS), 3))
    prior[JUNK] = (0.45, 0.1, 0.45)  # junk is of many kinds: most labellers see nothing wrong
    prior[JUNK, :, JUNK], prior[JUNK, :, GOOD] = 0.35, 0.35
    prior[JUNK, :, ABSTAIN] = 0.3
    prior[GOOD] = (0.005, 0.795, 0.2)
    chance = prior
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        chance = np.stack([[[(weight[c] * (votes[:, j] == v)).sum() for v in range(3)] for j in range(len(LABELLERS))] for c in (JUNK, GOOD)])
        chance += prior * strength * total
        chance /= chance.sum(2, keepdims=True)
        share = (weight.sum(1) + strength * total * np.array([0.2, 0.8])) / (total * (1 + strength))
        log = np.stack([np.log(share[c]) + sum(np.log(chance[c, j, votes[:, j]]) for j in range(len(LABELLERS))) for c in (JUNK, GOOD)])
        new = 1 / (1 + np.exp(np.clip(log[JUNK] - log[GOOD], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, chance


def features(text: str, shape, shares: Shares) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and steps of the text's own shares."""
    found = Counter(map(shape, text.split()))
    n = shares["words"] + 8  # short texts stay near the constant
    out = {0: 1.0}
    for k, v in found.items():
        out[k] = out.get(k, 0.0) + v / n
    for k in ("repeats", "repeated_lines", "bare", "signs", "capitals", "long"):
        for step in (0.05, 0.15, 0.3):
            if shares[k] > step:
                b = bucket(f"{k}>{step}")
                out[b] = out.get(b, 0.0) + 1.0
    if shares["distinct"] < 0.3:
        out[bucket("few distinct")] = 1.0
    if not shares["words"]:
        out[bucket("empty")] = 1.0
    return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.float64, len(out))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights of the hashed linear scorer by gradient steps on soft labels; all classes weigh the same."""
    w = np.zeros(BUCKETS)
    w[0] = 2.0
    if not rows:
        return w
    at = np.concatenate([np.full(len(i), k) for k, (i, _, _) in enumerate(rows)])
    col, val = np.concatenate([i for i, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    y = np.array([r[2] for r in rows])
    good = max(y.sum(), 1e-9)
    weight = y * (0.5 * len(y) / good) + (1 - y) * (0.5 * len(y) / max(len(y) - good, 1.0))
    square = np.full(BUCKETS, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * w[col], len(y)), -30, 30)))
        g = np.bincount(col, val * ((p - y) * weight)[at], BUCKETS) / len(y) + l2 * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
    return w


def _memos(limit: int):
    return worker_cache(("quality", limit), lambda: (Memo2(word_kind, limit).__getitem__, Memo2(lambda x: bucket("s " + word_shape(x)), limit).__getitem__))


class Memo2(Memo):
    """A memo whose values do not add up over punctuation."""

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self.compute(word)
        return value


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, memo_entries: int = 300_000) -> dict:
    """The model: ``posterior`` by vote pattern, ``chance`` per labeller, ``weights`` of the scorer.

    Vote patterns of all documents are counted (at most 3 ** labellers
    counts reach the driver). The scorer is trained on at most
    ``sample_rows`` documents, half from each side of the posterior, those of
    smallest hash; only their hashed features reach the driver.
    """
    spark = docs.sparkSession

    def vote(batches):
        import pyarrow as pa

        kind, _ = _memos(memo_entries)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern_of(Shares(t or "", kind)) for t in b.column(1).to_pylist()], pa.int32())], names=["h", "pattern"])

    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    votes = stage(keyed.mapInArrow(vote, "h long, pattern int"), "votes", 1000)
    seen = sorted((r.pattern, r.n) for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    patterns, counts = np.array([p for p, _ in seen], np.int64), np.array([n for _, n in seen], float)
    post, chance = em(patterns, counts) if seen else (np.zeros(0), np.zeros((2, len(LABELLERS), 3)))
    posterior = {int(p): float(x) for p, x in zip(patterns, post, strict=True)}
    picked = []
    for side in (True, False):
        own = [p for p, x in posterior.items() if (x >= 0.5) == side]
        if own:
            picked += votes.filter(F.col("pattern").isin(own)).select("h", "pattern").distinct().orderBy("h").limit(sample_rows // 2).collect()
    label = {r.h: posterior[r.pattern] for r in picked}  # at most sample_rows entries

    def look(batches):
        import pyarrow as pa

        kind, shape = _memos(memo_entries)
        for b in slices(batches):
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i, v = features(t or "", shape, Shares(t or "", kind))
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([i.tolist()], pa.list_(pa.int32())), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["h", "i", "v"])

    rows = []
    if label:
        chosen = F.broadcast(spark.createDataFrame([(h,) for h in label], "h long"))  # at most sample_rows rows
        sample = keyed.join(chosen, "h", "left_semi").dropDuplicates(["h"])
        rows = [(np.array(r.i), np.array(r.v), label[r.h]) for r in sorted(sample.mapInArrow(look, "h long, i array<int>, v array<double>").collect(), key=lambda r: r.h)]
    return {"posterior": posterior, "chance": chance, "weights": train(rows)}


def _judge(texts, w, kind, shape, posterior):
    for t in texts:
        shares = Shares(t or "", kind)
        i, v = features(t or "", shape, shares)
        score = float(1 / (1 + np.exp(-np.clip((w[i] * v).sum(), -30, 30))))
        yield score, posterior.get(pattern_of(shares), 0.5) if posterior is not None else 0.0


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", memo_entries: int = 300_000) -> DataFrame:
    """One row per document: ``id_col``, ``posterior`` of its votes, ``score`` of the scorer, ``keep`` (score >= 0.5, so a tie at 0.5 keeps).

    Null and empty texts are junk; repeated rows each keep theirs, and equal
    texts have equal scores; texts of any length are looked at whole; an empty
    table gives none; other columns are not read. A narrow pass.
    """
    held = docs.sparkSession.sparkContext.broadcast((model["weights"], model["posterior"]))  # BUCKETS floats, 3 ** labellers at most
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, T.DoubleType()) for x in ("posterior", "score")), T.StructField("keep", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        kind, shape = _memos(memo_entries)
        w, posterior = held.value
        for b in slices(batches):
            found = list(_judge(b.column(1).to_pylist(), w, kind, shape, posterior))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for _, p in found], pa.float64()), pa.array([s for s, _ in found], pa.float64()), pa.array([s >= 0.5 for s, _ in found], pa.bool_())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", memo_entries: int = 300_000) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps (as ``score`` does), with all their columns as they are.

    Null and empty texts go; ids are not looked at; repeated rows stay or go together.
    """
    held = docs.sparkSession.sparkContext.broadcast(model["weights"])
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        kind, shape = _memos(memo_entries)
        for b in slices(batches):
            yield b.filter(pa.array([s >= 0.5 for s, _ in _judge(b.column(at).to_pylist(), held.value, kind, shape, None)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
