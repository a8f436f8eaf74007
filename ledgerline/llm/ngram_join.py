"""Exact Jaccard self-join of n-gram sets with prefix trees.

All sets share one global order of n-grams: rare ones by hash, then the frequent
ones. Two sets that are similar enough share an n-gram among the first few of
each, so every n-gram found in the beginnings of several sets is the root of a
subtree: the beginnings of these sets from that n-gram on, stored as a compact
trie. A set is joined with a trie by one walk from its root. What the set shares
with the path walked so far holds for every set below it, and a subtree is left
as soon as what remains of the set and of the longest set below cannot reach the
overlap needed. What survives the beginnings is walked again with whole sets.

Equal sets are one node. First each subtree's members are joined with two of
them only, which joins groups of near copies without making their pairs. Then the
subtrees whose members are still in different components are joined with
themselves: members without a partner by size and place of the n-gram leave,
then those without one by beginnings, and whole sets link the rest. Each of
these steps gives members, not pairs, and the last only so many links as join
the same components; no link between components is lost.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import free, stage, table
from ledgerline.llm.components import components
from ledgerline.llm.wordtokens import slices, worker_cache

#: Keys of n-grams have 63 bits; those of the frequent ones come after all others.
LATER = np.uint64(1 << 63)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Rows of an Arrow batch; sets and texts are long.
ARROW_ROWS = 1000
#: Keys of a trie's edge that are compared at once.
STEP = 64


class WordHashes(dict):
    """word -> 64-bit hash; of at most ``limit`` entries."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def ngram_set(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's k-word shingles; of fewer words, one for the whole sequence; of none, empty.

    A-Z is lower-cased; words are runs of anything but space and the
    characters from tab to carriage return, as bytes.split() has them.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n) >> 1], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    g = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        g *= _MIX[4]
        g ^= g >> np.uint64(31)
        g += h[i : n - k + 1 + i] * _MIX[i % 4]
    g ^= g >> np.uint64(29)
    g *= _MIX[1]
    g ^= g >> np.uint64(32)
    g >>= np.uint64(1)
    g.sort()
    return g[np.append(True, g[1:] != g[:-1])]


def prefix_length(n: int, percent: int) -> int:
    """So many first n-grams of a set of n hold one of any set that is similar enough."""
    return n - -(-percent * n // 100) + 1


def needed(nx, ny, percent: int):
    """Least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


def ordered(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sort keys of sorted hashes: the frequent ones (``hot``, sorted) last."""
    if not len(hot) or not len(s):
        return s
    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate([s[~is_hot], s[is_hot] | LATER])


def beginning(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The first ``prefix_length`` of ``ordered``; only so many of the lowest hashes are looked up as it takes to have enough rare ones."""
    want = prefix_length(len(s), percent)
    look = want + want // 2 + 8
    while look < len(s):
        found = ordered(s[:look], hot)[:want]
        if found[-1] < LATER:
            return found
        look *= 4
    return ordered(s, hot)[:want]


class Branch:
    """A node of a compact trie: the edge ``keys[start:end]`` to it, the ``sets`` that end at it, and of all sets below it the least size, the most that remains from the trie's root on, and the component if it is the same."""

    __slots__ = ("children", "end", "group", "keys", "least", "most", "sets", "start")

    def __init__(self, keys, start: int, end: int):
        self.keys, self.start, self.end, self.children, self.sets = keys, start, end, [], []


def build_trie(sets: list[tuple]) -> Branch:
    """The compact trie of ``sets``: (keys in global order, size, what remains of the size from the root on, component, mark)."""
    root = Branch(None, 0, 0)
    path, last = [root], None
    for keys, n, rest, group, mark in sorted(sets, key=lambda s: s[0].astype(">u8").tobytes()):  # bytes sort as the keys do
        shared = 0
        if last is not None:
            most = min(len(keys), len(last))
            differ = keys[:most] != last[:most]
            shared = int(differ.argmax()) if differ.any() else most
        below = None
        while path[-1].end > shared:
            below = path.pop()
        if below is not None and path[-1].end < shared:  # the edge to it forks
            fork = Branch(below.keys, below.start, shared)
            fork.children.append(below)
            below.start = shared
            path[-1].children[-1] = fork
            path.append(fork)
        if len(keys) > shared:
            leaf = Branch(keys, shared, len(keys))
            path[-1].children.append(leaf)
            path.append(leaf)
        path[-1].sets.append((n, rest, group, mark))
        last = keys
    order, at = [root], 0
    while at < len(order):
        order += order[at].children
        at += 1
    for b in reversed(order):
        b.least = min([s[0] for s in b.sets] + [c.least for c in b.children])
        b.most = max([s[1] for s in b.sets] + [c.most for c in b.children])
        groups = {s[2] for s in b.sets} | {c.group for c in b.children}
        b.group = groups.pop() if len(groups) == 1 else None
    return root


def walk_trie(x: np.ndarray, nx: int, rest: int, root: Branch, percent: int, base: int = 0, group=-1):
    """The marks of the sets in the trie, of other components than ``group``, that can reach the overlap needed with a set of size nx.

    ``x``: its first keys from the root on, of ``rest`` that remain; ``base``:
    the overlap up to the root. Keys that either side does not give count as
    shared, so with whole sets the answer is exact, else it lacks no set.
    """
    stack, size = [(root, base, 0)], len(x)
    while stack:
        b, overlap, px = stack.pop()
        d, least = b.start, needed(nx, b.least, percent)
        ended = False
        while b.group != group and overlap + min(rest - px, b.most - d) >= least:
            if d == b.end or ended:
                below = [b]
                for c in below:  # all sets below, if x has no further keys
                    for n, r, g, mark in c.sets:
                        if g != group and overlap + min(rest - px, r - d) >= needed(nx, n, percent):
                            yield mark
                    if ended:
                        below += c.children
                if not ended:
                    stack += [(c, overlap, px) for c in b.children]
                break
            edge = b.keys[d : min(b.end, d + STEP)]
            at = x.searchsorted(edge)
            k = len(edge) if size and at[-1] < size else int(at.searchsorted(size))
            if k:
                same = x[at[:k]] == edge[:k]
                overlap += int(np.count_nonzero(same))
                px = int(at[k - 1]) + int(same[-1])
                d += k
            if k < len(edge):
                px, ended = size, True


def distinct_sets(texts, k: int, memo_entries: int, seen: set, most_seen: int = 1_000_000):
    """(digest, set, whether it is the first of its like) of each text; where over ``most_seen`` are held in ``seen``, one may come first again."""
    hashes = worker_cache(("words", memo_entries), lambda: WordHashes(memo_entries))
    for t in texts:
        s = ngram_set(t or "", k, hashes)
        d = xxhash.xxh3_128_intdigest(s.tobytes())
        yield d, s, d not in seen and len(s) > 0
        if len(seen) < most_seen:
            seen.add(d)


def new_sets(batches, k: int, memo_entries: int):
    """(digest, set) of the different sets of a task's texts."""
    seen: set = set()
    for b in slices(batches):
        for digest, s, new in distinct_sets(b.column(0).to_pylist(), k, memo_entries, seen):
            if new:
                yield digest, s


def halves(digest: int) -> tuple[int, int]:
    """A 128-bit digest as two signed 64-bit numbers."""
    low, high = ((digest >> shift & (1 << 64) - 1) for shift in (0, 64))
    return (low ^ 1 << 63) - (1 << 63), (high ^ 1 << 63) - (1 << 63)


def node_of(digest: int, turn: int) -> int:
    """The number of a set, as ``node_sql`` has it."""
    low, high = halves(digest)
    turned = ((high << turn & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)
    return low ^ turned


def node_sql(turn: int) -> str:
    return f"s0 ^ shiftleft(s1, {turn})"


def survey(texts: DataFrame, k: int, memo_entries: int, keys_held: int = 1 << 21) -> DataFrame:
    """``doc``, ``key``, ``s0``, ``s1`` (digest of the set), ``n`` of each row; and rows of ``t``, ``c`` alone: frequent n-grams.

    Every text takes part: each run of sets with ``keys_held`` n-grams names those
    that two and more of its sets hold. The order of n-grams, and with it the
    work but never the result, depends on these.
    """
    doc_type = texts.schema["doc_"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names, ints = ["doc", "key", "s0", "s1", "n", "t", "c"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        held, size, kind, seen = [], 0, None, set()

        def often():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c > 1
            none = [pa.nulls(int(keep.sum()), t) for t in (kind, pa.binary(), *ints[:3])]
            return pa.RecordBatch.from_arrays([*none, pa.array(u[keep].view(np.int64)), pa.array(c[keep], pa.int64())], names=names)

        for b in slices(batches):
            kind, rows = b.column(0).type, []
            for digest, s, new in distinct_sets(b.column(2).to_pylist(), k, memo_entries, seen):
                rows.append((*halves(digest), len(s)))
                if new:
                    held.append(s)
                    size += len(s)
            numbers = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ints, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, *(pa.nulls(len(rows), pa.int64()) for _ in "tc")], names=names)
            if size >= keys_held:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return texts.select("doc_", "key_", "text_").mapInArrow(run, f"doc {doc_type}, key binary, s0 long, s1 long, n int, t long, c long")


def key_rows(rows):
    """Batches of ``node``, ``n``, ``keys`` from (node, size, keys)."""
    import pyarrow as pa

    while part := list(islice(rows, 200)):
        node, n, keys = zip(*part, strict=True)
        ends = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists], names=["node", "n", "keys"])


def key_sets(texts: DataFrame, k: int, percent: int, memo_entries: int, turn: int, hot, whole: bool) -> DataFrame:
    """``node``, ``n``, ``keys`` of the different sets of each task: their beginnings or the whole sets, in global order."""

    def run(batches):
        sets = new_sets(batches, k, memo_entries)
        yield from key_rows((node_of(d, turn), len(s), ordered(s, hot.value) if whole else beginning(s, hot.value, percent)) for d, s in sets)

    return texts.select("text_").mapInArrow(run, "node long, n int, keys array<long>")


def grouped(batches, keys: int):
    """The rows of batches sorted by their first ``keys`` columns, group by group: a list of columns each, the last one as a list of its arrays."""
    import pyarrow as pa

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        rest = b = t.to_batches()[0] if t.num_rows else None
        if b is None:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns[:keys]:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        yield from cut(columns, b.column(b.num_columns - 1), zip(starts, starts[1:], strict=False))
        rest = b.slice(starts[-1])
    if rest is not None:
        columns = [rest.column(i).to_numpy(zero_copy_only=False) for i in range(rest.num_columns - 1)]
        yield from cut(columns, rest.column(rest.num_columns - 1), [(0, rest.num_rows)])


def cut(columns, lists, spans):
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    for i, j in spans:
        yield [c[i:j] for c in columns], [values[at[r] : at[r + 1]] for r in range(i, j)]


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A staged table of narrow rows, broadcast if it has few enough, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def within(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` that can link by what ``sets`` (``node``, ``n``, ``keys``) has of them: whole sets, or their beginnings.

    Each ``a`` is joined with tries of at most about ``chunk`` of its partners.
    """
    few = pairs.count() <= 250_000
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    split = pairs.join(F.broadcast(load) if few else load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    probes = load.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("a").alias("node"))
    taking = split.unionByName(probes)
    rows = sets.join(F.broadcast(taking) if few else taking, "node").select("a", "part", "node", "n", "keys")

    def run(batches):
        import pyarrow as pa

        for (a, _, node, n), keys in grouped(batches, 2):
            mine, me = np.flatnonzero(node == a[0]), int(a[0])
            if not len(mine) or len(node) < 2:
                continue
            at = int(mine[0])
            trie = build_trie([(keys[i], int(n[i]), int(n[i]), int(node[i]), int(node[i])) for i in range(len(node)) if node[i] != me])
            if found := list(walk_trie(keys[at], int(n[at]), int(n[at]), trie, percent, group=me)):
                yield pa.RecordBatch.from_arrays([pa.array([me] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "a long, b long").distinct()


class Members:
    """Members of a subtree in one task: sets that share its n-gram, with their component and the n-gram's place in each."""

    def __init__(self, token, node, root, n, pos, keys, percent: int):
        self.token, self.node, self.root, self.n, self.pos, self.keys, self.percent = token, node, root, n.astype(np.int64), pos.astype(np.int64), keys, percent
        self.rest = self.n - self.pos

    def can(self, some: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which pairs are left by component, size and place."""
        least = needed(self.n[some][:, None], self.n[held][None, :], self.percent)
        return (1 + np.minimum(self.rest[some][:, None], self.rest[held][None, :]) >= least) & (self.root[some][:, None] != self.root[held][None, :])

    def partners(self, some: np.ndarray, held: np.ndarray):
        """Each of ``some`` that is left with the walk of it through the trie of ``held``."""
        can = self.can(some, held)
        if not can.any():
            return
        trie = build_trie([(self.keys[i][self.pos[i] :], int(self.n[i]), int(self.rest[i]), int(self.root[i]), i) for i in held[can.any(axis=0)].tolist()])
        for i in some[can.any(axis=1)].tolist():
            yield i, walk_trie(self.keys[i][self.pos[i] :], int(self.n[i]), int(self.rest[i]), trie, self.percent, base=1, group=int(self.root[i]))

    def rows(self, which) -> list[tuple]:
        return [(int(self.token), int(self.node[i]), int(self.root[i]), int(self.n[i]), int(self.pos[i])) for i in sorted(which)]


def by_place(m: Members, some, held) -> list[tuple]:
    """The members that have a partner by component, size and place."""
    can = m.can(some, held)
    return m.rows({*some[can.any(axis=1)].tolist(), *held[can.any(axis=0)].tolist()})


def by_beginning(m: Members, some, held) -> list[tuple]:
    """The members whose beginning has a partner's in the trie, of those pairs that share no n-gram before this one."""

    def apart(i, j):
        x, y = m.keys[i][: m.pos[i] - 1], m.keys[j][: m.pos[j] - 1]
        at = x.searchsorted(y)
        inside = at < len(x)
        return not (x[at[inside]] == y[inside]).any()

    stay = set()
    for sides in ((some, held), (held, some)) if some is not held else ((some, held),):
        stay |= {i for i, found in m.partners(*sides) if any(apart(i, j) for j in found)}
    return m.rows(stay)


def by_whole(m: Members, some, held) -> list[tuple]:
    """Links among the members, as few as join the same components; their keys are whole sets."""
    up: dict[int, int] = {}

    def top(r):
        while r in up:
            r = up[r]
        return r

    links = []
    for i, found in m.partners(some, held):
        for j in found:
            a, b = top(int(m.root[i])), top(int(m.root[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((max(int(m.node[i]), int(m.node[j])), min(int(m.node[i]), int(m.node[j]))))
    return links


MEMBERS = "token long, node long, root long, n int, pos int"


def subtrees(members: DataFrame, compare, percent: int, schema: str, sets: DataFrame | None = None, chunk: int = 128) -> DataFrame:
    """What ``compare`` gives for the members of each n-gram's subtree, in blocks of about ``chunk`` of them against each other, with the keys that ``sets`` has of them."""
    load = members.groupBy("token").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(load, "token").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.withColumn("keys", F.expr("cast(array() as array<bigint>)")) if sets is None else dealt.join(sets.select("node", "keys"), "node")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        out = []
        for (token, i, j, own, node, root, n, pos), keys in grouped(batches, 3):
            m, each = Members(token[0], node, root, n, pos, keys, percent), np.arange(len(node))
            out += compare(m, each, each) if i[0] == j[0] else compare(m, each[own == i[0]], each[own == j[0]])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    rows = dealt.select("token", "i", "j", "own", "node", "root", "n", "pos", "keys")
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, schema.replace(" int", " long")).distinct()


def resolve(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, key=None, memo_entries: int = 200_000, most_hot: int = 200_000) -> DataFrame:
    """``doc``, ``key`` (of the row, if any), ``n``, ``s0``, ``s1``, ``root`` of each row; rows with one root are in one component, and those without n-grams have none."""
    spark = docs.sparkSession
    key = F.lit(None).cast("binary") if key is None else key
    texts = docs.select(F.col(id_col).alias("doc_"), key.alias("key_"), F.col(text_col).alias("text_"))
    seen = stage(survey(texts, k, memo_entries), "ngram-survey", ARROW_ROWS)
    rows = seen.filter("n is not null").drop("t", "c")
    often = seen.filter("n is null").groupBy("t").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "t").limit(most_hot).collect()
    hot = spark.sparkContext.broadcast(np.unique(np.array([r.t for r in often], np.int64).view(np.uint64)))  # at most most_hot n-grams
    sets = rows.filter("n > 0").groupBy("s0", "s1", "n").agg(F.min("doc").alias("least"))
    for turn in range(64):
        nodes = stage(sets.withColumn("node", F.expr(node_sql(turn))), "ngram-nodes")
        if nodes.count() == nodes.select("node").distinct().count():
            break
        free(spark, nodes)
    else:
        raise ValueError("64 bits do not tell the sets apart")
    how = {"k": k, "percent": percent, "memo_entries": memo_entries, "turn": turn, "hot": hot}
    starts = stage(key_sets(texts, whole=False, **how).dropDuplicates(["node"]), "ngram-starts", ARROW_ROWS)
    posts = starts.select("node", "n", F.posexplode("keys").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    met = stage(posts.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high")).filter("c > 1"), "ngram-met")
    known = stage(posts.join(small(met.filter("c > 2")), "token"), "ngram-known")

    def verified(pairs: DataFrame) -> DataFrame:
        """The staged ``pairs`` that link, by whole sets."""
        whole = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        found = stage(within(pairs, whole, percent), "ngram-links", ARROW_ROWS)
        free(spark, whole)
        return found

    def sets_of(which: DataFrame) -> DataFrame:
        """The whole sets of the nodes, made anew from their texts."""
        who = stage(which.distinct(), "ngram-who")
        need = stage(nodes.select("node", "least").join(small(who), "node", "left_semi"), "ngram-need")
        theirs = texts.join(small(need.select(F.col("least").alias("of")).distinct()), F.expr("doc_ <=> of"), "left_semi")
        made = key_sets(theirs, whole=True, **how).join(small(who), "node", "left_semi")  # beside the sets asked for, there are those of texts of a repeated id
        made = stage(made.dropDuplicates(["node"]), "ngram-made", ARROW_ROWS)
        free(spark, who)
        free(spark, need)
        return made

    # each member against the first and the last one of its subtree
    star = met.filter("c = 2").select(F.col("low").alias("x"), F.col("high").alias("y"))
    for centre in ("low", "high"):
        star = star.unionByName(known.filter(f"node != {centre}").select(F.col("node").alias("x"), F.col(centre).alias("y")))
    size = small(nodes.select("node", "n"))
    once = star.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    both = once.join(size.withColumnsRenamed({"node": "a", "n": "an"}), "a").join(size.withColumnsRenamed({"node": "b", "n": "bn"}), "b")
    fitting = stage(both.filter(f"{percent} * greatest(an, bn) <= 100 * least(an, bn)").select("a", "b"), "ngram-star")
    close = stage(within(fitting, starts, percent), "ngram-close", ARROW_ROWS)
    links = verified(close)
    roots = components(links)
    # the others of a subtree against each other, if they are in different components; of three members, all pairs are done
    now = known.filter("c > 3").select("token", "node", "n", "pos").join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = stage(now, "ngram-now")
    split = stage(now.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last")).filter("first < last").select("token"), "ngram-split")
    left = now.join(small(split), "token", "left_semi")
    for df in (met, known, fitting, close, roots):
        free(spark, df)
    placed = stage(subtrees(left, by_place, percent, MEMBERS), "ngram-placed", ARROW_ROWS)
    begun = stage(subtrees(placed, by_beginning, percent, MEMBERS, starts), "ngram-begun", ARROW_ROWS)
    for df in (now, split, placed):
        free(spark, df)
    whole = sets_of(begun.select("node"))
    rest = stage(subtrees(begun, by_whole, percent, "a long, b long", whole), "ngram-rest", ARROW_ROWS)
    for df in (begun, whole):
        free(spark, df)
    free(spark, starts)
    roots = components(links.unionByName(rest))
    free(spark, links)
    free(spark, rest)
    root = nodes.select("s0", "s1", "node").join(small(roots), "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    root = stage(root, "ngram-root")
    out = rows.join(root, ["s0", "s1"], "left").select("doc", "key", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    out = stage(out, "ngram-rows")
    for df in (root, roots, nodes, seen):
        free(spark, df)
    return out


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, **how) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of distinct ``k``-word shingles; a document of fewer words has its
    whole sequence as one. ``component_id`` is the smallest id reachable by
    links, itself included. Documents without words (null, empty) link with
    nothing and keep their own id. Shingles are told apart by 63-bit hashes,
    sets by 128-bit ones. The most frequent n-grams (``most_hot`` at most) go
    last in the order; the result is the same for any order. A null id is never
    smallest; repeated rows are in one component; an empty table gives no row;
    other columns are not read. Texts are read whole and never cut. The texts
    are read several times (whole sets are never all kept), so stage ``docs``
    if it is costly to make. Nothing is staged any longer than it is read but
    the answer's own rows.
    """
    rows = resolve(docs, id_col, text_col, k, percent, **how)
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc").alias("component_id"))
    out = rows.join(least, "root", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null: last), then the smallest digest of its text.

    Rows are told apart by id and text, so rows that share an id but not the
    text are each their own; of rows that share both, one (any) stays. Rows
    without words are components of their own, and all stay. All columns are
    carried along; an empty table gives an empty one.
    """
    spark, taken = docs.sparkSession, {c.lower() for c in docs.columns}
    doc, key = (next(name for name in (f"_{base}{'_' * i}" for i in range(99)) if name not in taken) for base in ("doc", "key"))
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = resolve(docs, id_col, text_col, k, percent, key=digest, **how).filter("n > 0")
    first = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "key")).alias("first")
    chosen = rows.groupBy("root").agg(first, F.count("*").alias("c"))
    several = stage(chosen.filter("c > 1"), "ngram-several")
    others = rows.join(small(several), "root").select("doc", "key", F.expr("doc <=> first.doc and key = first.key").alias("stays"))
    # one row for each id and text that goes, or that is there more than once and stays
    marks = others.groupBy("doc", "key").agg(F.first("stays").alias("stays"), F.count("*").alias("c")).filter("not stays or c > 1")
    marks = stage(marks.select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("stays").alias(f"{key}s")), "ngram-marks")
    for df in (rows, several):
        free(spark, df)
    on = (docs[id_col].eqNullSafe(F.col(doc))) & (digest == F.col(key))
    gone = marks.filter(~F.col(f"{key}s")).drop(f"{key}s")
    out = docs.join(small(gone), on, "left_anti")
    twice = marks.filter(f"{key}s").drop(f"{key}s")
    if twice.isEmpty():
        return out
    once = docs.join(small(twice), on, "left_semi").withColumn(key, digest).dropDuplicates([id_col, key]).drop(key)
    return out.join(small(twice), on, "left_anti").unionByName(once)
