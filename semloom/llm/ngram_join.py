"""N-gram Jaccard join with a prefix tree over globally ordered shingle sets.

Method. Every text becomes the set of its five-word shingles (64-bit hashes). Shingles follow one
global order: those that are frequent in some part of the corpus come last, each kind by hash. Two sets
of Jaccard similarity t share a member among the first ``n - ceil(t n) + 1`` of either, so only sets that
meet in such a prefix can be linked. Prefixes say which sets are to meet; the join itself is made in prefix
trees: the ordered sets that may be linked are stored in a path-compressed trie, a traversal carries the
overlaps counted so far down shared paths, and a subtree is left as soon as the overlap plus what can
remain cannot reach the least overlap any set below needs.

Whole results without all pairs of a group. Equal sets are one class from the start. Classes that share a
prefix member are joined pair by pair where few hold it; a pair must share as many prefix members as linked
sets of their sizes do. Classes with a member that many hold get their prefix again in an order where all
such members come last: two of them that are linked share a member of those prefixes too. Where many hold
one even in the last pass, as in groups of near copies, it joins them itself. The components of all these are clusters, so all links lie within clusters. Each set of a cluster is sent once to the trie that joins it, or
once per block of BLOCK sets where a cluster is larger; blocks emit star forests and numbers of links, never
all their pairs. No group has a cap, and no pair is dropped other than by bounds that hold for every linked pair.

Scale. Texts are read once for each of five scans at most and never shuffled; what moves are prefix entries (about
a quarter of the shingles) and the sets of clusters. Prefix entries of frequent shingles are salted.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Packed, collected, discard, lean, materialize, read_table, shuffle_partitions
from .components import connected_components

#: Shingles in the order table, the most frequent ones; it only orders, so results do not depend on it.
ORDER_LIMIT = 400_000
#: A shingle is frequent if so many texts of some stretch of a million shingles hold it.
FREQUENT, STRETCH = 3, 1_000_000
#: Prefix groups of up to so many classes make pairs; those of larger ones form clusters through their shingle. Sets in a block of a cluster.
SMALL_GROUP, BLOCK = 48, 512
#: Bits of the filter that says which sets may be needed; past its capacity more sets move, none fewer.
FILTER_BITS = 1 << 24
#: Passes over the prefixes of what is in large groups, each with the shingles of all large groups so far last.
PASSES = 3
#: Bits of the filter of shingles that many prefixes hold; past its capacity others come late too, for all sets alike.
LATE_BITS = 1 << 26
_HOT = 1 << 62
#: Entries of shingles this frequent are dealt out with a salt.
SALTS, SALTED = 16, _HOT | 10 << 56


def _needed(n: int, m: int, percent: int) -> int:
    """Least overlap of two sets of n and m members whose similarity is percent / 100 or more."""
    return -(-percent * (n + m) // (100 + percent))


def class_id(members: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def _sets(batches):
    """Batches of (column names -> arrays, sets of the texts), the text column last."""
    from .common import by_bytes
    from .textvec import shingle_sets, texts

    for batch in batches:
        column = texts(batch.column(batch.num_columns - 1))
        for lo, hi in by_bytes(column, 1 << 19):
            yield batch.slice(lo, hi - lo), shingle_sets(column.slice(lo, hi - lo))


def _scan_classes():
    def run(batches):
        """A row (doc_id, n, cls, -1) per text; a row (null, count, shingle, 1) per shingle that is frequent here."""
        import pyarrow as pa

        held, size = [], 0
        names = ["doc_id", "n", "cls", "kind"]

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(counts[often], pa.int64()), pa.array((values[often] >> np.uint64(2)).view(np.int64)), pa.array(np.ones(k, np.int64))], names=names)

        for batch, sets in _sets(batches):
            ids = [class_id(s) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(len(sets), -1), pa.int64())], names=names)
            held += sets
            size += sum(map(len, sets))
            if size > STRETCH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def order_table(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their values in the global order: by doublings of frequency, then by hash."""
    level = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), 63)
    by_hash = np.argsort(shingles)
    return shingles[by_hash], (_HOT | level << 56 | shingles >> 6)[by_hash]


def ordered(members: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the global order, as ascending positive integers: frequent shingles last."""
    v = (members >> np.uint64(2)).view(np.int64)
    known, value = order
    if len(known):
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        frequent = known[at] == v
        if frequent.any():
            v = np.concatenate([v[~frequent], np.sort(value[at[frequent]])])
    return v


def _scan_prefixes(hot: tuple[np.ndarray, np.ndarray], percent: int, late: np.ndarray | None = None, wanted: np.ndarray | None = None):
    """Prefix entries (token, class, size); shingles of the filter ``late`` come after all others, ``wanted`` is the filter of the classes to go on with."""
    filters = Packed(late), Packed(wanted)

    def run(batches):
        import pyarrow as pa

        late, wanted = (x.array for x in filters)
        seen: set[int] = set()
        for _, sets in _sets(batches):
            parts, ids, sizes = [], [], []
            for s in sets:
                if len(s) and (c := class_id(s)) not in seen and (wanted is None or _passes(wanted, c)):
                    seen.add(c)
                    v = ordered(s, hot)
                    if late is not None:
                        last = _held(late, v)
                        v = np.concatenate([v[~last], v[last]])
                    parts.append(v[: len(v) - -(-percent * len(v) // 100) + 1])
                    ids.append(c)
                    sizes.append(len(v))
            if len(seen) > 4_000_000:
                seen.clear()
            if parts:
                counts = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], names=["token", "cls", "n"])

    return run


def _meet(percent: int, small_group: int):
    """Of prefix entries sorted by (token, n, cls): pairs (a, b, sizes, false) of small groups, and of large groups (class, token, null, null, true).

    A group has no pairs of classes whose sizes alone rule out a link. Groups may go on over batches: the last
    one is held back until its end or until it is large, so no more than a batch and a small group are held.
    """

    def groups(token, cls, n, large):
        """Arrays of the rows that these whole groups give; those of ``large`` tokens do so whatever their size."""
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
        hub = (size > small_group) | (token >= SALTED) | np.isin(token, large)  # salted groups may go on in another task
        out = [(cls[hub], token[hub], None, None)]
        token, cls, n = token[~hub], cls[~hub], n[~hub]
        for d in range(1, small_group):
            at = np.flatnonzero(token[d:] == token[:-d])
            if not len(at):
                break
            at = at[100 * n[at].astype(np.int64) >= percent * n[at + d].astype(np.int64)]  # sorted by size: the later is the larger
            x, y, swap = cls[at], cls[at + d], cls[at] > cls[at + d]
            out.append((np.where(swap, y, x), np.where(swap, x, y), np.where(swap, n[at + d], n[at]), np.where(swap, n[at], n[at + d])))
        return out

    def run(batches):
        import pyarrow as pa

        held, large = None, [-1, -1]  # the last two tokens whose group was given out before its end
        for batch in chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                token, cls, n = held
                end = len(token)
            else:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if not len(cols[0]):
                    continue
                token, cls, n = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                same = np.zeros(len(token), bool)  # the same class again, from another task
                same[1:] = (token[1:] == token[:-1]) & (cls[1:] == cls[:-1])
                token, cls, n = token[~same], cls[~same], n[~same]
                end = int(np.searchsorted(token, token[-1]))  # the last group may go on
                if len(token) - end > small_group or token[-1] == large[1]:
                    large, end = [large[1], token[-1]], len(token)
            rows = [r for r in groups(token[:end], cls[:end], n[:end], large) if len(r[0])] if end else []
            held = [x[end:] for x in (token, cls, n)] if end < len(token) else None
            for a, b, n_a, n_b in rows:
                sizes = [pa.nulls(len(a), pa.int32())] * 2 if n_a is None else [pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *sizes, pa.array(np.full(len(a), n_a is None))], names=["a", "b", "n_a", "n_b", "hub"])

    return run


class Trie:
    """A path-compressed prefix tree over ordered sets, held as their sorted order and shared depths."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.ids = order
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.shared = [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        different = np.flatnonzero(a[:k] != b[:k])
        return int(different[0]) if len(different) else k

    def search_many(self, probes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """(stored set, probe) numbers of all linked pairs; one traversal carries the overlaps of all probes together."""
        universe = np.unique(np.concatenate(self.sets))
        at = [np.minimum(np.searchsorted(universe, p), len(universe) - 1) for p in probes]
        at = [i[universe[i] == p] for i, p in zip(at, probes, strict=True)]
        shared = np.unique(np.concatenate(at))
        place = np.full(len(universe), -1)
        place[shared] = np.arange(len(shared))
        out: list[tuple[int, int]] = []
        step = max(1, 32_000_000 // max(1, len(shared)))
        rows = [place[np.searchsorted(universe, s)] for s in self.sets]
        for first in range(0, len(probes), step):
            part = range(first, min(first + step, len(probes)))
            held = np.zeros((len(shared), len(part)), np.uint8)
            for j in part:
                held[place[at[j]], j - first] = 1
            sizes = np.array([len(probes[j]) for j in part])
            stack = [(0, len(self.sets), 0, np.arange(len(part)), np.zeros(len(part), np.int64))]
            while stack:
                lo, hi, depth, live, overlap = stack.pop()
                small, large = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
                end = min(self.shared[lo : hi - 1], default=len(self.sets[lo]))
                for a in range(depth, end, 64):  # probes leave along the edge as soon as their bound fails
                    edge = rows[lo][a : min(a + 64, end)]
                    overlap = overlap + held[edge[edge >= 0]][:, live].sum(axis=0, dtype=np.int64)
                    left = np.minimum(sizes[live] - overlap, large - a - len(edge))
                    keep = overlap + left >= -(-percent * (sizes[live] + small) // (100 + percent))
                    live, overlap = live[keep], overlap[keep]
                    if not len(live):
                        break
                if not len(live):
                    continue
                while lo < hi and len(self.sets[lo]) == end:  # sets that end at this node come first
                    hits = live[overlap >= -(-percent * (sizes[live] + end) // (100 + percent))]
                    out += [(self.ids[lo], first + int(j)) for j in hits]
                    lo += 1
                    if lo < hi and self.shared[lo - 1] < end:
                        break
                start = lo
                for i in range(lo, hi):
                    if i == hi - 1 or self.shared[i] <= end:
                        stack.append((start, i + 1, end, live, overlap))
                        start = i + 1
        return out


def _stars(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """(member, least member) of the components of the pairs among ``size`` numbers, the least members themselves left out."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return [(x, r) for x in range(size) if (r := root(x)) != x]


def _blocks(percent: int):
    def run(batches):
        """Sorted rows (cluster, block, other block, whether of the other one, class, rows of the class, members): links of each two blocks.

        Rows (a, b, null) connect what is linked, no more of them than members; a row (a, null, n) says that class
        a is linked with classes of n rows in all here.
        """
        import pyarrow as pa

        key, ids, sets, weights = None, ([], []), ([], []), ([], [])

        def flush():
            alone = key[1] == key[2]
            right = 0 if alone else 1
            pairs = Trie(sets[0]).search_many(sets[right], percent) if sets[0] and sets[right] else []
            shift = 0 if alone else len(ids[0])
            pairs = [(x, y + shift) for x, y in pairs if not alone or x < y]  # within a block each pair comes in both orders
            cls, weight = np.array(ids[0] + ids[1], np.int64), np.array(weights[0] + weights[1], np.int64)
            stars = np.array(_stars(pairs, len(cls)), np.int64).reshape(-1, 2)
            n = np.zeros(len(cls), np.int64)
            if pairs:
                x, y = np.array(pairs).T
                np.add.at(n, x, weight[y])
                np.add.at(n, y, weight[x])
            linked = np.flatnonzero(n)
            a = pa.array(np.concatenate([cls[stars[:, 0]], cls[linked]]))
            b = pa.concat_arrays([pa.array(cls[stars[:, 1]]), pa.nulls(len(linked), pa.int64())])
            return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.nulls(len(stars), pa.int64()), pa.array(n[linked])])], names=["a", "b", "n"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for root, i, j, second, cls, weight, members in zip(*cols, batch.column(6), strict=True):
                if (root, i, j) != key:
                    if key is not None:
                        yield flush()
                    key, ids, sets, weights = (root, i, j), ([], []), ([], []), ([], [])
                ids[second].append(cls)
                weights[second].append(weight)
                sets[second].append(np.frombuffer(members.as_py(), np.int64))
        if key is not None:
            yield flush()

    return run


def _filter_table(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of a column of ids by their low bits: of fixed size, whatever the input's."""
    slots = ids.select(F.pmod(F.col(ids.columns[0]), F.lit(bits)).alias("s"))
    words = slots.groupBy(F.expr("shiftright(s, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    rows = collected(words)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table


def _passes(table: np.ndarray, cls: int) -> bool:
    return bool(table[(slot := cls % (64 * len(table))) >> 6] >> (slot & 63) & 1)


def _held(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of many ids pass."""
    slot = ids & (64 * len(table) - 1)
    return (table[slot >> 6] >> (slot & 63) & 1).astype(bool)


def _scan_sets(hot: tuple[np.ndarray, np.ndarray], table: np.ndarray):
    packed = Packed(table)

    def run(batches):
        import pyarrow as pa

        table = packed.array
        for _, sets in _sets(batches):
            rows = {class_id(s): s for s in sets if len(s)}
            rows = {c: s for c, s in rows.items() if _passes(table, c)}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([ordered(s, hot).tobytes() for s in rows.values()], pa.binary())], names=["cls", "members"])

    return run


def _met(text: DataFrame, percent: int, hot: tuple[np.ndarray, np.ndarray], late: np.ndarray | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """What the prefix groups of the texts give, as ``_meet`` says. Entries of very frequent shingles are dealt out with a salt."""
    salt = F.when(F.col("token") >= SALTED, F.pmod("cls", F.lit(SALTS))).otherwise(F.lit(0))
    entries = text.mapInArrow(lean(_scan_prefixes(hot, percent, late, wanted)), "token long, cls long, n int")
    dealt = entries.repartition(shuffle_partitions(text.sparkSession), "token", salt).sortWithinPartitions("token", salt, "n", "cls").select("token", "cls", "n")
    return materialize(dealt.mapInArrow(lean(_meet(percent, SMALL_GROUP)), "a long, b long, n_a int, n_b int, hub boolean"), "met")


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose prefixes share as many members, none of a large group, as those of any linked pair.

    Of the overlap at most ``ceil(t max(n, m)) - 1`` members lie behind the prefix that ends first, so the
    rest of the least overlap is common to both prefixes. Two sets that share a member of a large group are
    left to what is made of such groups, so all that others share was counted.
    """
    pairs = met.filter("not hub").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    least = -F.floor(-percent * (F.col("n_a") + F.col("n_b")) / F.lit(100.0 + percent) + F.lit(1e-9))
    behind = -F.floor(-percent * F.greatest("n_a", "n_b") / F.lit(100.0) + F.lit(1e-9)) - 1
    return pairs.filter(F.col("shared") >= least - behind).select("a", "b")


def _cluster_links(clusters: DataFrame, text: DataFrame, hot: tuple[np.ndarray, np.ndarray], percent: int, block: int) -> DataFrame:
    """Links within ``clusters(cls, root, weight, m)``, whose members are dealt to blocks; each two blocks meet in one task.

    Sets come from the texts; others do not leave the scan. A set of a cluster of one block moves once.
    """
    parts = shuffle_partitions(clusters.sparkSession)
    sets = text.mapInArrow(lean(_scan_sets(hot, _filter_table(clusters.select("cls"), FILTER_BITS))), "cls long, members binary").groupBy("cls").agg(F.first("members").alias("members"))
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int")
    rows = clusters.join(sets, "cls").select("root", "cls", "weight", "members", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("second"), "cls", "weight", "members")
    rows = rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "second", "cls")
    return rows.mapInArrow(lean(_blocks(percent)), "a long, b long, n long")


def ngram_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Similarity classes of ``docs(doc_id, text)``: ``doc_id, n_shingles, class_id, component_id, n_links``, a row per input row.

    ``class_id`` is the same for texts of equal shingle sets; ``component_id`` is the smallest doc_id
    reachable by links; ``n_links`` says with how many other rows a row is linked, those of its own class
    included. Null or empty texts have no shingles and are linked with nothing: their component
    is their own doc_id, their class null. Rows without a doc_id are members like others but never name a
    component (null if no member has one). Repeated rows are members of one class. Very long texts are
    taken whole. Other columns are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(docs.mapInArrow(lean(_scan_classes()), "doc_id long, n long, cls long, kind long"), "classes")
    rows = scanned.filter("kind < 0").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"))
    often = scanned.filter("kind > 0").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(ORDER_LIMIT)
    frequent = collected(often)
    hot = order_table(frequent["cls"].to_numpy(), frequent["n"].to_numpy())

    text = docs.select("text")
    met, late, links, used = _met(text, percent, hot), None, [], []
    for k in range(PASSES):
        used.append(met)
        links.append(_candidates(met, percent))
        hubs = met.filter("hub")
        if hubs.isEmpty():
            break
        more = _filter_table(hubs.select("b"), LATE_BITS) | (0 if late is None else late)
        if k == PASSES - 1 or late is not None and (more == late).all():
            links.append(hubs.select("a", "b"))
            break
        late = more
        met = _met(text, percent, hot, late, _filter_table(hubs.select("a"), FILTER_BITS))
    label = connected_components(reduce(DataFrame.unionByName, links))
    for table in used:
        discard(table)

    classes = rows.filter("class_id is not null").groupBy(F.col("class_id").alias("cls")).agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"))
    members = materialize(label.withColumnRenamed("node", "cls").join(classes.select("cls", "weight"), "cls"), "members")  # shingles that stood for large groups go here
    discard(label)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    clusters = materialize(members.join(sizes, "root").select("cls", "root", "weight", "m"), "clusters")
    found = materialize(_cluster_links(clusters, text, hot, percent, BLOCK), "links")
    label = connected_components(found.filter("b is not null").select("a", "b"))

    counts = found.filter("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    named = materialize(named.select("cls", "least", F.coalesce("root", "cls").alias("root"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    for used in (members, clusters, found, label):
        discard(used)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select(F.col("cls").alias("class_id"), "component_id", "n_links")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(by_class, "class_id", "left").select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"))


def dedupe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one of the smallest doc_id, and all documents without words.

    Of rows that share that doc_id the one of the smallest content hash stays, of identical rows one. A
    component whose members all lack a doc_id keeps its member of the smallest hash. Kept rows are
    unchanged.
    """
    found = ngram_components(docs).select("doc_id", "class_id", "component_id").filter("class_id is not null")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = F.regexp_count(text, F.lit(r"[^ \t-\r]+")) == 0
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), blank.alias("blank"), text.alias("words"), F.xxhash64(*columns).alias("content"))
    kept_ids = found.filter("component_id is not null").select(F.col("component_id").alias("id")).distinct()
    named = rows.filter("not blank and id is not null").join(kept_ids, "id", "left_semi").select("id", "row", "content")
    # doc_ids that repeat: few rows, so only theirs are compared
    repeated = materialize(rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated-ids")
    if not repeated.isEmpty():
        twice = named.join(repeated, "id", "left_semi")
        first = twice.groupBy("id").agg(F.min("content").alias("content"))
        named = named.join(repeated, "id", "left_anti").unionByName(twice.join(first, ["id", "content"], "left_semi").dropDuplicates(["id"]).select("id", "row", "content"))
    kept = rows.filter("blank").select("row").unionByName(named.select("row"))
    nameless = rows.filter("not blank and id is null")
    if not nameless.isEmpty():
        kept = kept.unionByName(_nameless(nameless, found))
    return kept.select("row.*")


def _nameless(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``row`` of rows without a doc_id that stand for their class: those of components in which no member has one."""

    @F.pandas_udf("long")
    def class_of(text):
        import pandas as pd
        import pyarrow as pa

        from .textvec import shingle_sets, texts

        return pd.Series([class_id(s) if len(s) else 0 for s in shingle_sets(texts(pa.array(text, pa.string())))])

    lone = found.filter("component_id is null").select("class_id").distinct()
    least = rows.withColumn("class_id", class_of("words")).join(lone, "class_id", "left_semi")
    return least.dropDuplicates(["class_id"]).select("row")
