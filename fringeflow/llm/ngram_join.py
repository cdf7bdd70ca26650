"""N-gram Jaccard join by prefix trees, and the components of its links.

Documents with equal n-gram sets are one class. N-grams have one global order:
the rarer first, and those of one class alone before all others. A set that
links has at least ``need`` percent of its n-grams in common with another, so
sets with too few shared n-grams are set aside: at first by a part of each set
(its first n-grams by hash, of which a link leaves a known number in common),
then by all of it. Two sets that link share an n-gram of their prefixes (the
first ones in global order, all but as many as must be common). Sets that share a prefix n-gram, directly or through others,
are a group; no pair in two groups links.

A group's sets form a trie in global order. A search walks the trie once for all
its queries, sharing the overlap found so far on common paths, and leaves a
subtree as soon as what remains of either side can't reach the overlap needed.
Members already known to be connected are not compared again. In a group of more
than ``block`` sets each set first meets one centre: of those that share a
prefix n-gram with it, the one whose n-grams are the most widely shared. Then
only prefix n-grams whose sets are not yet connected are left, and the sets
outside the largest connected part there are searched for, block by block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, table, texts
from .words import LOWER, signed, window_hashes, words_of

SIZE, NEED, BLOCK, CELLS, OPEN, GIVEN, BITS = 3, 90, 400, 1 << 23, 1 << 20, 1 << 18, 1 << 24


def sets_of(column, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; shorter texts are one n-gram, texts without words have none."""
    words = words_of(column)
    h = words.hashes(table=LOWER)
    grams = window_hashes(h, size)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        else:
            out.append(window_hashes(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def overlap_needed(a: int, b: int, need: int = NEED) -> int:
    """The least intersection with 100 * intersection >= need * union, for sets of sizes a and b."""
    return -(-need * (a + b) // (100 + need))


def _mark(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _spare(n, need: int):
    """How many n-grams a set of size n may lack and still link."""
    return n - -(-need * n // 100)


def _prints(size: int, need: int):
    """Each text's set: its size, its mark, and its first n-grams by hash (none where the task has lately given those of an equal set). If two sets link, the first 2 * _spare(n) + 1 of each have _spare(m) + 1 in common, m being the smaller size."""

    def run(batches):
        given = set()  # so that a large group of copies gives each n-gram once a task
        for batch in batches:
            sets = sets_of(batch.column(1), size)
            marks, heads = [_mark(s) for s in sets], []
            for s, mark in zip(sets, marks):
                heads.append(s[: 2 * _spare(len(s), need) + 1] if mark not in given and _linkable(len(s), need) else s[:0])
                given.add(mark)
            if len(given) > GIVEN:
                given.clear()
            marks = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in heads])]).astype(np.int32))
            first = pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *heads]))))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), first]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "first"])

    return run


def _linkable(n: int, need: int) -> bool:
    """Whether a different set can link with one of size n: one of n + 1 shares n at most."""
    return 100 * n >= need * (n + 1)


def _rows(size: int, need: int):
    """(gram, f1, f2) of all sets that a different set can link with."""

    def run(batches):
        for batch in batches:
            sets = [x for x in sets_of(batch.column(0), size) if _linkable(len(x), need)]
            marks = np.frombuffer(b"".join(_mark(x) for x in sets), np.int64).reshape(-1, 2)
            lengths = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *sets]))), *(pa.array(np.repeat(marks[:, i], lengths)) for i in (0, 1))], ["gram", "f1", "f2"])

    return run


NODE = "node long, n long, spread double, grams array<long>, dfs array<int>"


def _nodes(need: int):
    """Rows (f1, f2, df, gram) in that order, a set's first one with df = -n and gram = doc_id: the sets with enough shared n-grams. Sets without such a row are left out."""

    def build(f1, f2, df, gram):
        starts = np.flatnonzero(np.append(True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]))) if len(f1) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(f1))
        n, shared = -df[starts], ends - starts - 1
        keep = (n > 0) & (100 * shared >= need * n)
        inside = np.repeat(keep, shared + 1)
        inside[starts] = False
        spread = np.add.reduceat(df, starts)[keep] + n[keep] if len(starts) else np.zeros(0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(shared[keep])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gram[inside], df[inside].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(gram[starts][keep]), pa.array(n[keep]), pa.array(spread / n[keep]), *lists], ["node", "n", "spread", "grams", "dfs"])

    def run(batches):
        held, count, upto = [], 0, 1 << 16
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("f1", "f2", "df", "gram")])
            count += batch.num_rows
            if count < upto:
                continue
            f1, f2, df, gram = (np.concatenate(c) for c in zip(*held))
            cut = int(np.flatnonzero(df < 0)[-1:].sum())  # the last set may go on
            yield build(f1[:cut], f2[:cut], df[:cut], gram[:cut])
            held, count = [[x[cut:] for x in (f1, f2, df, gram)]], len(f1) - cut
            upto = max(1 << 16, 2 * count)
        if held:
            yield build(*(np.concatenate(c) for c in zip(*held)))

    return run


class Trie:
    """A prefix tree over sets in global order, with chains of single children joined to one edge. N-grams are numbered in that order.

    ``sets`` are pairs (n-grams, frequencies) of shared n-grams in global order; ``sizes`` count those of one class alone too.
    """

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]):
        grams, dfs = (np.concatenate(x) for x in zip(*sets))
        unique, first, number = np.unique(grams, return_index=True, return_inverse=True)
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((unique, dfs[first]))] = np.arange(len(unique))
        self.sets, self.sizes, self.width = np.split(rank[number], np.cumsum([len(g) for g, _ in sets])[:-1]), np.array(sizes), len(unique)
        order, top = sorted(range(len(sets)), key=lambda i: self.sets[i].tolist()), []
        todo = [(order, 0, top)]
        while todo:
            ids, depth, siblings = todo.pop()
            node, groups, upto = self._node(ids, depth)
            siblings.append(node)
            todo += [(group, upto, node[2]) for group in groups]
        self.root = top[0]

    def _node(self, ids: list[int], depth: int):
        """((edge, ids that end here, children, least and most size below, longest list below), the children's ids, depth below); ids share the first ``depth`` n-grams."""
        sets = self.sets
        first, last = sets[ids[0]], sets[ids[-1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        upto = depth + int(differ[0]) if len(differ) else m
        sizes = self.sizes[ids]
        ends = [i for i in ids if len(sets[i]) == upto]
        groups = []
        for i in ids:
            if len(sets[i]) > upto:
                if not groups or sets[groups[-1][-1]][upto] != sets[i][upto]:
                    groups.append([])
                groups[-1].append(i)
        return (first[depth:upto], ends, [], int(sizes.min()), int(sizes.max()), max(len(sets[i]) for i in ids)), groups, upto

    def search(self, queries: list[int], need: int):
        """(set, queries that link with it): one walk for all queries that fit in ``CELLS``, each node with those still alive there."""
        step = max(1, CELLS // max(1, self.width))
        for k in range(0, len(queries), step):
            yield from self._walk(np.array(queries[k : k + step]), need)

    def _walk(self, queries: np.ndarray, need: int):
        has = np.zeros((len(queries), self.width), bool)
        for k, q in enumerate(queries):
            has[k, self.sets[q]] = True
        upto, n = has.cumsum(axis=1, dtype=np.int32), self.sizes[queries]
        total = has.sum(axis=1)
        shortest = -(-need * n // 100)
        stack = [(self.root, 0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            (edge, ends, children, least, most, longest), depth, live, overlap = stack.pop()
            fits = 100 * np.minimum(n[live], most) >= need * np.maximum(n[live], least)
            live, overlap = live[fits], overlap[fits]
            if not len(live):
                continue
            used = np.zeros(len(live), np.int64)
            if len(edge):
                overlap = overlap + has[np.ix_(live, edge)].sum(axis=1)
                used, depth = upto[live, edge[-1]], depth + len(edge)
            # the best that is left: all of the query beyond this path, or all of the longest set below
            able = overlap + np.minimum(total[live] - used, longest - depth) >= overlap_needed(n[live], np.maximum(least, shortest[live]), need)
            live, overlap = live[able], overlap[able]
            if not len(live):
                continue
            for i in ends:
                hits = live[(overlap >= overlap_needed(n[live], self.sizes[i], need)) & (100 * np.minimum(n[live], self.sizes[i]) >= need * np.maximum(n[live], self.sizes[i]))]
                if len(hits):
                    yield i, queries[hits].tolist()
            stack += [(child, depth, live, overlap) for child in children]


class Forest:
    def __init__(self, ids):
        self.up, self.parts = list(range(len(ids))), len(ids)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
            self.parts -= 1


def link(ids: list[int], sets: list, sizes: list[int], queries: list[int], need: int = NEED, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever links between a query and any member: (doc, smaller doc) pairs, a forest. Members of one ``known`` component are connected already."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    place = {p: k for k, p in enumerate(order)}
    ids, sets, sizes = [ids[i] for i in order], [sets[i] for i in order], [sizes[i] for i in order]
    forest, trie, todo, asked = Forest(ids), None, {place[q] for q in queries}, len(queries)
    first = {}
    for k, p in enumerate(order if known else ()):
        forest.join(first.setdefault(known[p], k), k)
    step = 8
    while todo and forest.parts > 1:
        parts = [forest.find(i) for i in range(len(ids))]
        big = int(np.argmax(np.bincount(parts)))
        # pairs within the largest part need no search, and pairs with it are found from the other side
        now = [i for i in sorted(todo) if parts[i] != big]
        if not now:
            if asked == len(ids):
                break
            now = sorted(todo)
        now = now[:step]
        todo.difference_update(now)
        trie, step = trie or Trie(sets, sizes), 2 * step
        for i, linked in trie.search(now, need):
            for q in linked:
                forest.join(q, i)
    return [(ids[i], ids[forest.find(i)]) for i in range(len(ids)) if forest.find(i) != i]


def _edges(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _groups(need: int):
    """Rows sorted by (key, part): trie search within each group of at most two blocks."""

    def run(batches):
        now, members = None, []

        def done():
            if len(members) < 2 or not any(m[2] for m in members):
                return []
            return link([m[0] for m in members], [m[4] for m in members], [m[1] for m in members], [k for k, m in enumerate(members) if m[2]], need, [m[3] for m in members])

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("node", "n", "query", "known")]
            grams, dfs = batch.column("grams"), batch.column("dfs")
            values, counts, offsets = grams.values.to_numpy(), dfs.values.to_numpy(), grams.offsets.to_numpy()
            for i, (group, row) in enumerate(zip(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()), zip(*columns))):
                if group != now:
                    out += done()
                    now, members = group, []
                members.append((*row, (values[offsets[i] : offsets[i + 1]].copy(), counts[offsets[i] : offsets[i + 1]].copy())))
            yield _edges(out)
        yield _edges(done())

    return run


def _open(need: int):
    """Rows sorted by key: those of sets that may link with one of another component whose first n-gram in common is the key. ``left`` counts n-grams from the key on.

    Keys of more than ``OPEN`` sets pass whole.
    """

    def able(n, left, comp):
        order = np.lexsort((-left, n))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        sizes, start, which = np.unique(n[order], return_index=True, return_inverse=True)
        first = comp[order][start]  # the best of each size, and the best of another component than that
        best, other = left[order][start], np.maximum.reduceat(np.where(comp[order] != first[which], left[order], -1), start)
        out = np.zeros(len(n), bool)
        for size, one, two, c in zip(sizes.tolist(), best.tolist(), other.tolist(), first.tolist()):
            t = overlap_needed(n, size, need)
            out |= (100 * np.minimum(n, size) >= need * np.maximum(n, size)) & (left >= t) & (np.where(comp == c, two, one) >= t)
        return out

    def run(batches):
        now, held, count = None, [], 0

        def done():
            rows = [np.concatenate(c) for c in zip(*held)]
            keep = able(rows[2], rows[3], rows[4]) if 1 < count <= OPEN else np.full(len(rows[0]), count > 1)
            return pa.RecordBatch.from_arrays([pa.array(rows[i][keep]) for i in (0, 1, 4)], ["key", "node", "comp"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "node", "n", "left", "comp")]
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if columns[0][lo] != now and held:
                    yield done()
                    held.clear()
                    count = 0
                now, count = columns[0][lo], count + hi - lo
                held.append([c[lo:hi] for c in columns])
                if count > OPEN:  # what is held goes on as it is
                    yield done()
                    held.clear()
        if held:
            yield done()

    return run


def _search(rows: DataFrame, nodes: DataFrame, need: int) -> DataFrame:
    """Links (a, b) within the groups of rows (key, part, node, query, known)."""
    rows = rows.join(nodes.select("node", "n", "grams", "dfs"), "node").select("key", "part", "node", "n", "query", "known", "grams", "dfs")
    return materialise(rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_groups(need), "a long, b long").where("a <> b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable by edges (a, b), for every node of an edge.

    Each round, a node, and the node that its label names, take the least label of a neighbour's label, and labels jump to the label's label; rounds grow
    with the logarithm of a component's width. State is written to the shared folder each round.
    """
    pairs = edges.where("a <> b")
    both = materialise(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        further = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        jumped = labels.join(further, "comp").select("node", "comp", "far")
        near = both.join(jumped.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("m"))
        met = jumped.join(near, "node").select("node", "comp", F.least("far", "m").alias("m"))
        news = met.select("node", "m", F.col("comp").alias("own")).union(met.select(F.col("comp").alias("node"), "m", F.lit(None).cast("long")))
        new = materialise(news.groupBy("node").agg(F.min("m").alias("m"), F.max("own").alias("own")).select("node", F.least("own", "m").alias("comp"), "own"), "labels")
        moved = new.where("comp <> own").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return new.select("node", "comp")


def _met(rows: DataFrame) -> DataFrame:
    """(gram, df) of n-grams that rows (gram, f1) have from more than one class."""
    found = rows.groupBy("gram").agg(F.count("*").alias("df"), F.min("f1").alias("low"), F.max("f1").alias("high"))
    return found.where("low <> high").select("gram", F.least("df", F.lit((1 << 31) - 1)).alias("df"))


def _hopeful(prints: DataFrame, classes: DataFrame, need: int) -> DataFrame:
    """The classes of which as many first n-grams are found in other classes as a link needs."""
    rows = prints.select("f1", "n", F.explode("first").alias("gram"))
    met = rows.join(_met(rows).select("gram").hint("shuffle_hash"), "gram").distinct().groupBy("f1", "n").agg(F.count("*").alias("met"))
    m = F.ceil(F.lit(need) * F.col("n") / F.lit(100))  # no smaller set links
    enough = met.where(F.col("met") > m - F.ceil(F.lit(need) * m / F.lit(100))).select("f1").distinct()
    return materialise(classes.join(enough, "f1", "left_semi"), "hopeful")


def _sieve(d: DataFrame, ids: DataFrame) -> DataFrame:
    """``d`` without most of the rows whose doc_id isn't among ``ids``, so that their texts don't move in a join.

    Ids are kept as ``BITS`` bits at most (``BITS`` / 64 rows are sent to the tasks, whatever the input); an id that shares its bit with another passes.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    place = bit.bitwiseAND(F.lit(63)).cast("int")
    taken = ids.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    # a semi-join, below which Catalyst moves no other join
    return d.join(F.broadcast(taken), (F.shiftright(bit, 6) == F.col("word")) & (F.getbit("bits", place) == 1), "left_semi")


def _shared(d: DataFrame, prints: DataFrame, classes: DataFrame, size: int, need: int) -> DataFrame:
    """The sets with enough n-grams that another class has too: node (the class's first doc_id), n, spread (mean frequency), shared n-grams in global order and their frequencies."""
    hopeful = _hopeful(prints, classes, need)
    reps = hopeful.select(F.col("rep").alias("doc_id")).distinct()
    own = materialise(_sieve(d, reps).join(reps, "doc_id", "left_semi"), "own")
    rows = own.select("text").mapInArrow(_rows(size, need), "gram long, f1 long, f2 long")
    shared = rows.join(_met(rows).hint("shuffle_hash"), "gram").select("f1", "f2", "df", "gram").distinct()
    heads = hopeful.select("f1", "f2", (-F.col("n")).alias("df"), F.col("rep").alias("gram"))
    # a repeated doc_id may have another text, of a class that isn't hopeful: it has no head row and makes no node
    rows = shared.union(heads).repartition("f1", "f2").sortWithinPartitions("f1", "f2", "df", "gram")
    out = materialise(rows.mapInArrow(_nodes(need), NODE), "nodes")
    discard(hopeful, own)
    return out


def links(nodes: DataFrame, need: int = NEED, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all sets whose links connect them."""
    least = F.ceil(F.lit(need) * F.col("n") / F.lit(100)).cast("int")
    members = nodes.select("node", "spread", "n", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", F.lit(1), F.size("grams") - least + 1)).alias("pos", "key"))
    heads = members.groupBy("key").agg(F.max_by("node", F.struct("spread", "node")).alias("head"), F.max("spread").alias("top"), F.count("*").alias("n")).where("n > 1")
    met = members.join(heads.select("key", "head", "top"), "key")
    near = materialise(met.select(F.col("node").alias("a"), F.col("head").alias("b"), "top").distinct(), "near")
    groups = components(near)
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    groups = materialise(groups.join(sizes, "comp"), "groups")

    small = groups.where(F.col("size") <= block).select(F.col("comp").alias("key"), F.lit(0).cast("long").alias("part"), "node", F.lit(True).alias("query"), F.col("node").alias("known"))
    found = _search(small, nodes, need)
    large = groups.where(F.col("size") > block).select("node")
    if not large.limit(1).count():
        return found

    # each set meets the best of its centres
    best = near.join(large.withColumnRenamed("node", "a"), "a", "left_semi").groupBy("a").agg(F.max_by("b", F.struct("top", "b")).alias("b")).where("a <> b")
    best = materialise(best, "best")
    parts = best.groupBy("b").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts"))
    own = best.join(parts, "b").select(F.col("b").alias("key"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.col("a").alias("node"), F.lit(False).alias("query"), F.col("a").alias("known"))
    centres = parts.select(F.col("b").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"), F.lit(True).alias("query"), F.col("b").alias("known"))
    found = found.union(_search(own.union(centres), nodes, need))
    out = found.union(_rest(members.join(large, "node", "left_semi").select("key", "node", "n", (F.col("shared") - F.col("pos")).cast("long").alias("left")), found, nodes, need, block))
    discard(near, groups, best)
    return out


def _rest(members: DataFrame, found: DataFrame, nodes: DataFrame, need: int, block: int) -> DataFrame:
    """Links between the sets of one key that ``found`` doesn't connect."""
    comps = components(found)
    each = members.join(comps, "node", "left").select("key", "node", "n", "left", F.coalesce("comp", "node").alias("comp"))
    each = materialise(each, "each")
    apart = each.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    still = each.join(apart, "key", "left_semi").repartition("key").sortWithinPartitions("key").mapInArrow(_open(need), "key long, node long, comp long")
    still = materialise(still, "open")
    firsts = still.groupBy("key").agg(F.min("node").alias("first"))
    each, before = materialise(still.join(firsts, "key"), "apart"), (each, still)
    discard(*before)
    if not each.limit(1).count():
        return found.limit(0)
    groups = components(each.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("comp", "unit")
    whole = each.select("node", "comp").distinct().join(groups, "node").select("unit", "node", "comp")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("long")
    # a key's sets among themselves where fewer sets move so than for the whole group
    work = lambda x, by: x.groupBy(by, "comp").agg(F.count("*").alias("c")).groupBy(by).agg(F.sum("c").alias("n"), F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("left"))
    moves = F.col("n") * blocks("left") + F.col("left") * blocks("n")
    by_unit, by_key = work(whole, "unit"), work(each, "key")
    first = each.groupBy("key").agg(F.min("node").alias("node")).join(groups, "node").select("key", "unit")
    cost = by_key.join(first, "key").groupBy("unit").agg(F.sum(moves).alias("cost"))
    chosen = materialise(by_unit.join(cost, "unit").select("unit", "n", "main", "left", (moves <= F.col("cost")).alias("whole")), "chosen")
    units = whole.join(chosen.where("whole"), "unit").select(F.col("unit").alias("key"), "node", "comp", "n", "main", "left")
    keys = each.select("key", "node", "comp").join(by_key, "key").join(first.join(chosen.where("not whole").select("unit"), "unit").select("key"), "key", "left_semi")
    todo = materialise(units.union(keys.select(*units.columns)), "todo")
    # block i of all members meets block j of those to search for
    deal = lambda c: F.pmod(F.xxhash64("node"), blocks(c))
    span = lambda c: F.sequence(F.lit(0).cast("long"), blocks(c) - 1)
    row = lambda part, query: ("key", F.explode(part).alias("part"), "node", F.lit(query).alias("query"), F.col("comp").alias("known"))
    every = todo.select(*row(F.transform(span("left"), lambda j: deal("n") * blocks("left") + j), False))
    lost = todo.where("comp <> main").select(*row(F.transform(span("n"), lambda i: i * blocks("left") + deal("left")), True))
    rows = every.union(lost).groupBy("key", "part", "node", "known").agg(F.max("query").alias("query"))
    out = _search(rows.select("key", "part", "node", "query", "known"), nodes, need)
    discard(each, chosen, todo)
    return out


def cluster(docs: DataFrame, size: int = SIZE, need: int = NEED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of ``docs`` with a doc_id.

    Words are compared without the case of A-Z; null and empty texts have no n-gram and are linked with nothing, not even each other. Rows that repeat a
    doc_id and text are in one component; one with another text is linked by that text. N-grams are compared by 64-bit hashes, sets by 128-bit ones.
    """
    small_batches(docs.sparkSession)
    d = texts(docs)
    prints = materialise(d.mapInArrow(_prints(size, need), "doc_id long, n long, f1 long, f2 long, first array<long>"), "prints")
    classes = materialise(prints.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    nodes = _shared(d, prints, classes, size, need)
    comps = components(links(nodes, need, block))
    discard(nodes)

    moved = classes.join(comps, classes["rep"] == comps["node"], "left").select("f1", "f2", "copies", "rep", F.coalesce("comp", "rep").alias("comp"))
    moved = moved.where((F.col("copies") > 1) | (F.col("comp") != F.col("rep"))).select("f1", "f2", "comp")
    out = prints.join(moved, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Documents without words are linked with nothing and stay. Rows without a doc_id have no place in the result and go; rows that repeat a doc_id share its
    fate. All columns pass unchanged.
    """
    kept = cluster(docs, size=5, need=80).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long") == kept["kept"], "left_semi")
