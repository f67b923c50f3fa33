"""Near-duplicate texts: a Jaccard self-join of word 5-gram sets by chosen paths.

1. Every text becomes the set of its 5-word shingles (lower-cased; a text of fewer words
   is one shingle).  Texts with equal sets are one class with the least doc_id as its
   representative; only representatives take part from here on.
2. Chosen paths: a set is embedded as TOKENS minhash tokens.  From the root of each run, a
   set follows one or two sampled coordinates to the child that is named by the coordinate
   and its token (nodes are hashes, so several levels need no exchange).  At each of DEPTHS,
   buckets of one set are dropped, buckets of at most SMALL sets are done, and the sets
   of larger ones go on, unless they are so similar that going on would hardly part them: the mean
   similarity of all pairs, told from how often a bit of their tokens is set, is DENSE.  Dense
   buckets, and what is still large at the last depth, are cut into blocks; each pair of blocks is a
   bucket of its own.
3. Buckets are compared by brute force, all pairs of their sets, by the tokens: pairs that agree
   in at least CLOSE of them are candidates.  Sets that are connected by candidates form a cluster
   (``components``).
4. The runs are repeated until a pair at the threshold meets with probability TARGET at the
   last depth.  All runs walk the same TOKENS coordinates, so that is an expectation
   over how many of them agree.  After the FIRST runs, buckets within one cluster are dropped and
   only sets of different clusters are compared, as others have nothing to add.  A bucket of one
   cluster and fewer than SMALL other sets is done, however large: each set of the cluster goes to
   one task, with all the others, so a group of near copies costs rows in proportion to its size.
5. Clusters are compared exactly, on the shingles of the whole texts, so a link is never a matter
   of the tokens.
   A cluster of more than BLOCK sets or ROOM shingles is cut into blocks by hash and each pair of
   blocks is a task of its own, so no task gets more than two blocks however large the cluster.

n_links is exact for the pairs found.  A group of near copies costs the square of its
distinct texts in comparisons; links aren't rows, only counts and roots leave a task.

Edge cases: null, empty and white texts have no shingles and are linked with nothing; rows
with a null doc_id have a null class and no links; repeated rows and copies are one class
(n_copies tells how many other rows share the set) and count once in n_links; of rows that
share a doc_id each has the class of its own text; further columns are ignored; an empty table
gives no rows.
Shingles are told apart by 64-bit hashes, and sets by 64 bits and their size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import components, looked_up
from .storage import Stored, bound_batches, read, shuffle_partitions

WORDS = 5
#: Jaccard similarity of a link, as a fraction.
THRESHOLD = 4, 5
TOKENS = 64
#: Depths at which buckets are formed, and the mean number of coordinates that a node follows on the way to each.
DEPTHS, FOLLOW = (4, 10, 16), (1.5, 1.4, 1.4)
#: Most sets of a bucket that doesn't go on, the mean similarity of one that needn't, and the sets of a block of it.
SMALL, DENSE, PART = 50, 0.5, 4000
#: The coordinates that tell how dense a bucket is, by a bit of each.
PROBES = range(1, TOKENS, 2)
#: Tokens in which a candidate agrees: 4 standard deviations below the mean of a pair at the threshold.
CLOSE = 38
#: Most sets and, about, most shingles of a block of a cluster.
BLOCK, ROOM = 1000, 400_000
#: The probability with which a pair at the threshold meets in a bucket, and the runs before clusters are formed.
TARGET, FIRST = 0.99, 3

_ODD = A.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of text and hash, and how many each has."""
    data = A.LOWER[chunk.data]
    start, end = chunk.words()
    doc = chunk.doc_of(start)
    n_words = chunk.counts(doc).astype(np.int64)
    words = A.slice_hasher(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[WORDS - 1 :] == doc[: 1 - WORDS]) if len(words) >= WORDS else np.zeros(0, np.int64)
    keys = A.combine(*(words[first + k] for k in range(WORDS)))
    owner = doc[first]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        begin = np.cumsum(n_words) - n_words
        own = []
        for d in short:
            h = np.array([n_words[d]], np.uint64)
            for w in words[begin[d] : begin[d] + n_words[d]]:
                h = A.combine(h, np.array([w]))
            own.append(h[0])
        keys, owner = np.append(keys, np.array(own, np.uint64)), np.append(owner, short)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[fresh], np.bincount(owner[fresh], minlength=chunk.n)


def set_keys(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    at = (np.cumsum(sizes) - sizes)[full]
    if len(full):
        out[full] = A.combine(sizes[full].astype(np.uint64), np.add.reduceat(A.mix(keys + np.uint64(7)), at)) | np.uint64(1)
    return out


def sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The minhash tokens of each set; rows of empty sets are 0."""
    out = np.zeros((len(sizes), TOKENS), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        for k in range(TOKENS):
            out[full, k] = np.minimum.reduceat((keys * _ODD[k]) >> np.uint64(32), at)
    return out


def low_bits(tokens: np.ndarray) -> np.ndarray:
    """The last bit of each token of a set, in one number."""
    return np.packbits((tokens & 1).astype(np.uint8), axis=1, bitorder="little").reshape(-1).view("<i8") if len(tokens) else np.zeros(0, np.int64)


def descend(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, levels: int, follow: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that sets reach ``levels`` below; rows: the set of each node, an index into tokens."""
    second = np.uint64(int((follow - 1) * (1 << 32)))
    for _ in range(levels):
        both = np.flatnonzero((A.mix(nodes + np.uint64(1)) & np.uint64(0xFFFFFFFF)) < second)
        out_nodes, out_rows = [], []
        for turn, at in ((2, slice(None)), (3, both)):
            node, row = nodes[at], rows[at]
            coordinate = (A.mix(node + np.uint64(turn)) % np.uint64(TOKENS)).astype(np.int64)
            out_nodes.append(A.combine(node + np.uint64(turn), tokens[row, coordinate].astype(np.uint64)))
            out_rows.append(row)
        nodes, rows = np.concatenate(out_nodes), np.concatenate(out_rows)
    return nodes, rows


def meeting(similarity: float, depth: int = DEPTHS[-1]) -> float:
    """The probability that two sets of that similarity share a node of that depth in one run."""
    p = 1.0
    for level in range(depth, 0, -1):
        second = FOLLOW[next(k for k, d in enumerate(DEPTHS) if level <= d)] - 1
        miss = 1 - similarity * p
        p = 1 - ((1 - second) * miss + second * miss * miss)
    return p


def recall(runs: int, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """The probability that a pair of that similarity shares a node of the last depth in some run: given how many coordinates agree, runs are independent."""
    agree = range(TOKENS + 1)
    chance = (math.comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) for k in agree)
    return 1 - sum(c * (1 - meeting(k / TOKENS)) ** runs for c, k in zip(chance, agree))


def runs_for(target: float = TARGET) -> int:
    return next(runs for runs in itertools.count(1) if recall(runs) >= target)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for chunk in A.chunks(batch.column(1), 2 << 20):
            keys, sizes = shingles(chunk)
            tokens = sketches(keys, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, chunk.n), pa.array(set_keys(keys, sizes).view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(low_bits(tokens)), pa.array([r.tobytes() if n else None for r, n in zip(tokens, sizes)], pa.binary())],
                ["doc_id", "node", "size", "bits", "tokens"],
            )
            at += chunk.n


def _paths(levels: int, follow: float, runs: range = range(0)):
    """(node, label, tokens[, bucket]) to (node, label, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            for low in range(0, n, 4096):
                part = batch.slice(low, 4096)
                if not len(part):
                    continue
                tokens = _token_rows(part.column(2))
                own, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows = np.arange(len(part))
                if part.num_columns > 3:
                    start = part.column(3).to_numpy().view(np.uint64)
                else:
                    start = np.repeat(A.mix(np.array(runs, np.uint64) + np.uint64(1)), len(part))
                    rows = np.tile(rows, len(runs))
                nodes, rows = descend(start, rows, tokens, levels, follow)
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(label[rows]), pa.array(nodes.view(np.int64))], ["node", "label", "bucket"])

    return run


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def least_connected(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least index that each of n is connected with by the pairs (p, q)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidates(tokens: np.ndarray, task: np.ndarray, side: np.ndarray, label: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one task and of different labels that agree in CLOSE tokens, by all pairs; of a task with two sides, pairs across.

    Rows are in order of the task.  About ``most`` pairs are compared at once."""
    order = np.lexsort((side, task))
    tokens, task, side, label = tokens[order], task[order], side[order], label[order]
    first = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    begin = np.repeat(first, np.diff(np.append(first, len(task))))
    # Each row is compared with those before it in its task; rows of side 0 come first and aren't compared with each other.
    before = np.where(side == 0, 0, np.arange(len(task)) - begin)
    done = np.cumsum(before)
    found_p, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = 0
    while low < len(task):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + most, "right")))
        n = before[low:high]
        q = np.repeat(np.arange(low, high), n)
        p = begin[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        real = ((side[p] != side[q]) | (side[p] == 2)) & (label[p] != label[q])
        p, q = p[real], q[real]
        close = (tokens[p] == tokens[q]).sum(1) >= CLOSE
        found_p.append(p[close])
        found_q.append(q[close])
        low = high
    p, q = order[np.concatenate(found_p)], order[np.concatenate(found_q)]
    return np.minimum(p, q), np.maximum(p, q)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, label, tokens), sorted by task, to (node, group): labels connected by candidates, and the least of them."""
    held: list[tuple] = []

    def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        task, side, label, tokens = (np.concatenate(x) for x in zip(*rows))
        p, q = candidates(tokens, task, side, label)
        names, index = np.unique(label[np.concatenate((p, q))], return_inverse=True)
        group = least_connected(len(names), *np.split(index, 2))
        other = np.flatnonzero(group != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[group[other]])], ["node", "group"])

    for batch in batches:
        for low in range(0, len(batch), 4096):
            part = batch.slice(low, 4096)
            own = (*(part.column(k).to_numpy(zero_copy_only=False) for k in range(3)), _token_rows(part.column(3)))
            new = np.flatnonzero(own[0] != own[0][-1])
            if held and held[0][0][0] != own[0][-1]:
                # All tasks but the last are whole.
                cut = new[-1] + 1 if len(new) else 0
                yield from solved([*held, tuple(x[:cut] for x in own)])
                held = []
                own = tuple(x[cut:] for x in own)
            held.append(own)
    if held:
        yield from solved(held)


def linked_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """A square matrix of which sets are linked, by exact intersections."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    keys, index = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(index) > 1)
    place = np.full(len(keys), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[index], np.repeat(np.arange(n), sizes)
    real = column >= 0
    column, row = column[real], row[real]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    for low in range(0, len(shared), 8192):
        i, j = np.searchsorted(column, (low, low + 8192))
        block = np.zeros((n, min(8192, len(shared) - low)), np.float32)
        block[row[i:j], column[i:j] - low] = 1
        common += block @ block.T
    a, b = THRESHOLD
    out = (a + b) * common.astype(np.int64) >= a * (sizes[:, None] + sizes)
    np.fill_diagonal(out, False)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, node, text), sorted by task, to (node, n_links, root) of each task."""

    def solved(rows: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.array(sorted(rows), np.int64)
        side = np.array([rows[k][0] for k in nodes.tolist()])
        linked = linked_pairs([rows[k][1] for k in nodes.tolist()])
        linked &= (side[:, None] != side) | (side == 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(linked.sum(1).astype(np.int64)), pa.array(nodes[least_connected(len(nodes), *np.nonzero(linked))])], ["node", "n_links", "root"])

    task, rows = None, {}
    for batch in batches:
        tasks, sides, nodes = (batch.column(k).to_pylist() for k in range(3))
        for chunk in A.chunks(batch.column(3)):
            keys, sizes = shingles(chunk)
            own = set_keys(keys, sizes).view(np.int64).tolist()
            at = np.cumsum(sizes)
            for i, r in enumerate(chunk.rows):
                if tasks[r] != task:
                    if len(rows) > 1:
                        yield solved(rows)
                    task, rows = tasks[r], {}
                if own[i] == nodes[r]:  # another row with this doc_id may have another text
                    rows[nodes[r]] = sides[r], keys[at[i] - sizes[i] : at[i]]
    if len(rows) > 1:
        yield solved(rows)


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, tokens), written; node is the hash of the set of shingles."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return Stored(docs.mapInArrow(_sketch, f"doc_id {id_type}, node long, size long, bits long, tokens binary"), "join-sketches").frame


def _clusters(classes: DataFrame, target: float) -> DataFrame:
    """(node, label): the cluster of each set that has candidates; label is the least node."""
    tokens = classes.select("node", "bits", "tokens")
    runs = runs_for(target)
    first = components(_met(tokens.select("node", F.col("node").alias("label"), "bits", "tokens"), range(min(FIRST, runs)), False)).frame
    labelled = Stored(tokens.join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "bits", "tokens"), "join-labels").frame
    rest = components(_met(labelled, range(min(FIRST, runs), runs), True)).frame.select(F.col("node").alias("label"), F.col("label").alias("last"))
    found = looked_up(labelled.select("node", "label"), "label", "node", rest).select("node", F.coalesce("last", "label").alias("label"))
    # Those that no candidate connects with another are clusters of one.
    several = found.groupBy("label").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return looked_up(found, "label", "node", several).filter("members is not null").select("node", "label", "members")


def _met(labelled: DataFrame, runs: range, merged: bool) -> DataFrame:
    """(node, group): labels connected by candidates within the buckets of the runs; merged: whether sets may share labels."""
    n = shuffle_partitions(labelled.sparkSession)
    path = "node long, label long, bucket long"

    def buckets(rows: DataFrame) -> Stored:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.expr("bit_xor(xxhash64(node))").alias("sets"), (F.min("label") < F.max("label")).alias("several"))
        return Stored(rows.join(sizes.filter("several").drop("several"), "bucket"), "join-paths", F.col("members") > SMALL)

    labelled, bits = labelled.drop("bits"), labelled.select("node", "bits")
    whole = F.lit(None).cast("boolean").alias("main")
    stored = buckets(labelled.mapInArrow(_paths(DEPTHS[0], FOLLOW[0], runs), path))
    done = stored.frame.filter(F.col("members") <= SMALL).select("*", whole)
    for above, depth, follow in zip(DEPTHS, [*DEPTHS[1:], None], [*FOLLOW[1:], None]):
        if not stored.found:
            break
        large = stored.frame.filter(F.col("members") > SMALL)
        if merged:
            few = Stored(_few(large), "join-few").frame
            done = done.unionByName(large.join(few, "bucket").select(*large.columns, (F.col("label") == F.col("most")).alias("main")))
            large = large.join(few, "bucket", "left_anti")
        if depth is None:
            done = done.unionByName(large.select(*stored.frame.columns, whole))
            break
        dense = Stored(_dense(large.select("node", "bucket", "members").join(bits, "node")), "join-dense").frame
        done = done.unionByName(large.join(dense, "bucket", "left_semi").select(*stored.frame.columns, whole))
        going_on = large.select("node", "bucket").join(dense, "bucket", "left_anti").join(labelled, "node").select("node", "label", "tokens", "bucket")
        stored = buckets(going_on.mapInArrow(_paths(depth - above, follow), path).distinct())
        done = done.unionByName(stored.frame.filter(F.col("members") <= SMALL).select("*", whole))
    # Of buckets with the same sets one is enough.
    once = done.groupBy("sets", "members").agg(F.min("bucket").alias("bucket"))
    once = once.withColumn("blocks", F.ceil(F.col("members") / PART).cast("int")).select("bucket", "blocks")
    tasks = _tasks(done.select("node", "bucket", "main").join(once, "bucket"), "bucket", F.col("main")).join(labelled, "node").select("task", "side", "label", "tokens")
    met = tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_meet, "node long, group long").distinct()
    return met.unionByName(met.select(F.col("group").alias("node"), "group"))


def _few(rows: DataFrame) -> DataFrame:
    """(bucket, most): buckets of rows (bucket, label) with fewer than SMALL sets besides those of one label, the most frequent."""
    counts = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    found = counts.agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    return found.filter(F.col("all") - F.col("most.n") < SMALL).select("bucket", F.col("most.label").alias("most"))


def _dense(rows: DataFrame) -> DataFrame:
    """Buckets of rows (bucket, members, bits) whose pairs have a mean similarity of DENSE.

    Equal tokens have equal bits and others agree in half of them, so pairs agree in a bit with
    probability (1 + similarity) / 2; over all pairs that is p**2 + (1 - p)**2 for a share p of bits set."""
    ones = [F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"p{k}") for k in PROBES]
    sums = rows.groupBy("bucket", "members").agg(*ones)
    share = lambda k: F.col(f"p{k}") / F.col("members")
    agree = F.aggregate(F.array(*(share(k) * share(k) + (1 - share(k)) * (1 - share(k)) for k in PROBES)), F.lit(0.0), lambda a, x: a + x)
    return sums.filter(agree * (2 / len(PROBES)) - 1 >= DENSE).select("bucket")


def _tasks(rows: DataFrame, whole: str, main: Column | None = None) -> DataFrame:
    """Rows (node, whole, blocks) dealt to tasks, the pairs of blocks of each whole; side: 0 and 1 across two blocks, 2 within one.

    Where main is true or false, rows with true aren't compared with each other: each goes to one task (side 0),
    those with false to all tasks of the whole (side 1, and 2 in one of them)."""
    main = F.lit(None).cast("boolean") if main is None else main
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.when(main, F.array("block")).otherwise(every)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    side = F.when(main, 0).when(~main, F.when(F.col("other") == 0, 2).otherwise(1)).otherwise(side)
    pair = F.when(main.isNull(), F.least("block", "other")).otherwise(F.col("other")), F.when(main.isNull(), F.greatest("block", "other")).otherwise(F.col("other"))
    return rows.withColumns({"task": F.xxhash64(whole, *pair), "side": side}).drop("block", "other")


def _linked(docs: DataFrame, sketched: DataFrame, target: float) -> DataFrame:
    """(node, class_id, first, n_links, n_copies) of each set: first is the set with the least (doc_id, node) of its class."""
    n = shuffle_partitions(docs.sparkSession)
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    classes = Stored(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("tokens").alias("tokens")), "join-classes").frame
    clusters = _clusters(classes, target)

    members = Stored(clusters.join(classes.select("node", "doc_id", "size"), "node"), "join-clusters").frame
    sizes = members.groupBy("label", "members").agg(F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.least(F.ceil(F.col("shingles") / ROOM), F.col("members"))).cast("int")
    placed = looked_up(members.drop("members"), "label", "node", sizes.select("label", blocks.alias("blocks")))
    tasks = Stored(_tasks(placed.select("doc_id", "node", "label", "blocks"), "label").select("doc_id", "node", "task", "side"), "join-tasks").frame
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(tasks.hint("merge"), "doc_id").select("task", "side", "node", "text")
    compared = Stored(texts.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_compare, "node long, n_links long, root long"), "join-links").frame

    # In a cut cluster a set is in several tasks: its roots there connect them.
    met = compared.filter("n_links > 0").select("node", F.col("root").alias("group"))
    linked = components(met.unionByName(met.select(F.col("group").alias("node"), "group"))).frame
    counts = compared.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = classes.select("node", "doc_id", "rows").join(linked, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    found = looked_up(named, "label", "node", least)
    return found.select("node", F.col("least.doc_id").alias("class_id"), F.col("least.node").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))


def join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each row of (doc_id, text)."""
    sketched = _sketched(docs)
    found = _linked(docs, sketched, target).drop("first")
    real = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    rows = sketched.select("doc_id", F.when(real, F.col("node")).alias("node"))
    return looked_up(rows, "node", "doc_id", found).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """One row of each group of near-duplicate texts, with all its columns.

    It has the least doc_id of the group and, where several texts share that, the one whose set has
    the least hash; of rows that share both, the one with the least text and other columns (as
    JSON).  Rows with a null doc_id, or without words, all stay."""
    sketched = _sketched(docs)
    least = _linked(docs, sketched, target).filter("node = first").select("node", F.col("class_id").alias("doc_id"))
    least = Stored(least, "join-least").frame
    ids = sketched.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("node").alias("node"), F.max("size").alias("size"))
    ids = Stored(ids.join(least.withColumn("kept", F.lit(True)), ["doc_id", "node"], "left").select("doc_id", "rows", (F.col("kept") | (F.col("size") == 0)).alias("kept")), "join-ids").frame
    # An id of one row tells which row it is; where several share it, their texts do.
    # Lists of ids grow with the documents, so they are merged, not broadcast; both joins read one exchange of the documents.
    kept = docs.join(ids.filter("rows = 1 and kept").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    shared = docs.join(ids.filter("rows > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    marked = _marked(shared)
    order = F.struct("row.text", F.to_json("row"))
    chosen = marked.filter("node is not null").join(least, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.min_by("row", order).alias("row"))
    return kept.unionByName(marked.filter("node is null").select("row.*")).unionByName(chosen.select("row.*")).unionByName(docs.filter(F.col("doc_id").isNull()))


def _marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node): the rows as they are, with the hash of the set of shingles; null without words."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column(2), 2 << 20):
                keys, sizes = shingles(chunk)
                own = [c.slice(chunk.rows.start, chunk.n) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(set_keys(keys, sizes).view(np.int64), mask=sizes == 0)], ["row", "doc_id", "node"])

    row, key = (rows.schema[c].dataType.simpleString() for c in ("row", "_id"))
    return rows.mapInArrow(mark, f"row {row}, doc_id {key}, node long")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, and all rows with a null doc_id or without words."""
    return one_of_each(docs)
