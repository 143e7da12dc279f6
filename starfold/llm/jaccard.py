"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its word shingles. Equal sets are one class. The links between classes
of similarity 0.75 or more are found exactly, and documents get the component they belong to:

1. Fragments. The global order of n-grams (by hash) is cut into ranges. Each range counts, apart from
   the others, how many n-grams of a class are shared with any other class; summed per class, this
   shows which classes can have a partner at all: at most a quarter of a set may be missing from a
   partner's, so of its m n-grams in the lower half of the order at least m - n/4 are shared.
2. Only those classes go on. Their n-grams are put in a second order, the rare ones first; two sets
   that link meet in a prefix of n/4 + 1. Where classes meet, one is the hub.
3. Overlaps with the hub are counted in each range separately and summed per pair.
4. A class that is not in its hub's component yet meets the other members of the hub's group in
   blocks: bounds from sizes and hub overlaps drop pairs that cannot link, and overlaps of the rest
   are again partial counts, range after range, summed per pair.

So links between members of the hub's component are never expanded; only members outside it meet the
group, in blocks of a fixed size. No link between components is lost. No step holds all documents'
n-grams, pairs or links in one task or on the driver. Sets that differ but have one 64-bit name are
noticed by a second hash; all names are then made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents, stored, whole_row
from starfold.llm.blocks import texts
from starfold.llm.shingles import sets

#: Ranges of the order in step 1: so many at least, and entries of one (16 bytes each), about.
FRAGMENTS = 8
FRAGMENT_ENTRIES = 1_000_000
PARTS = 16
HALF = np.uint64(1 << 63)
BLOOM_BITS_A_CLASS = 16
BLOOM_MOST_BITS = 1 << 27
BLOOM_HASHES = 4
PIECE_BITS = 1 << 16
#: Members of a hub group that meet in one task, and their n-grams.
LEFT, RIGHT, BLOCK_GRAMS = 128, 1024, 400_000


def names_of(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A 64-bit name of a set, and a second hash that tells whether two sets have one name; 0 for the empty one."""
    if not len(s):
        return 0, 0
    digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return tuple(int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))


def class_of(s: np.ndarray, seed: int = 0) -> int:
    return names_of(s, seed)[0]


def lower_half(s: np.ndarray) -> np.ndarray:
    """The n-grams that step 1 looks at: those in the lower half of the order, the same for every set."""
    return s[: np.searchsorted(s, HALF)]


def classes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n (size of the set), low (of these, in the lower half of the order), cls, proof (second hash) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, ends in texts(batch, "text"):
                got = sets(data, ends)
                names = [names_of(s, seed) for s in got]
                columns = [[len(s) for s in got], [len(lower_half(s)) for s in got], [x for x, _ in names], [y for _, y in names]]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n", "low", "cls", "proof"])

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, low long, cls long, proof long")


def shared_counts(docs: DataFrame, fragments: int, seed: int = 0) -> DataFrame:
    """(cls, shared): of the n-grams of each class in the lower half of the order, how many some other class has too.

    N-grams that classes of one block of texts share are counted there; only one entry, without a
    class, goes on for them. So a very frequent n-gram arrives once per block, not once per document.
    Copies of a class in several blocks may count an n-gram twice: the filter then keeps a class too many.
    """
    shift = np.uint64(63 - max(1, (fragments - 1).bit_length()))
    n_frag = 1 << max(1, (fragments - 1).bit_length())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ends in texts(batch, "text"):
                own: dict[int, np.ndarray] = {}
                for s in sets(data, ends):
                    if len(s):
                        own.setdefault(class_of(s, seed), lower_half(s))
                if not own:
                    continue
                name = np.repeat(np.array(list(own), np.int64), [len(s) for s in own.values()])
                gram = np.concatenate(list(own.values()))
                by = np.argsort(gram, kind="stable")
                gram, name = gram[by], name[by]
                new = np.ones(len(gram), bool)
                new[1:] = gram[1:] != gram[:-1]
                size = np.diff(np.append(np.flatnonzero(new), len(gram)))
                many = np.repeat(size > 1, size)
                done, counts = np.unique(name[many], return_counts=True)
                gram, name = np.concatenate([gram[~many], gram[new & many]]), np.concatenate([name[~many], np.zeros((new & many).sum(), np.int64)])
                at = (gram >> shift).astype(np.int64)
                by = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[by], np.arange(n_frag + 1))
                rows = [(f, gram[by[a:b]].tobytes(), name[by[a:b]].tobytes()) for f, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                spare = int(gram[0] % np.uint64(n_frag)) if len(gram) else 0
                columns = [pa.array([r[0] for r in rows] + [spare], pa.int32()), pa.array([r[1] for r in rows] + [b""], pa.binary()), pa.array([r[2] for r in rows] + [b""], pa.binary())]
                columns += [pa.array([b""] * len(rows) + [x.tobytes()], pa.binary()) for x in (done, counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["frag", "grams", "names", "done", "counts"])

    def count(t: pa.Table) -> pa.Table:
        def column(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

        gram, name = column("grams", np.uint64), column("names", np.int64)
        by = np.lexsort((name, gram))
        gram, name = gram[by], name[by]
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (name[1:] == name[:-1]) & (name[1:] != 0)
        gram, name = gram[~same], name[~same]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(gram)))
        first = name[new]
        # an entry without a class was shared inside its block, and counted there
        many = np.repeat((size > 1) | (first == 0), size) if len(gram) else np.zeros(0, bool)
        own = name[many & (name != 0)]
        every = np.concatenate([own, column("done", np.int64)])
        weight = np.concatenate([np.ones(len(own), np.int64), column("counts", np.int64)])
        distinct, at = np.unique(every, return_inverse=True)
        return pa.table({"cls": pa.array(distinct, pa.int64()), "shared": pa.array(np.bincount(at, weight, len(distinct)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64))})

    made = by_arrow(docs.select("text"), emit, "frag int, grams binary, names binary, done binary, counts binary")
    return made.groupBy("frag").applyInArrow(count, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))


def surviving_sets(docs: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """(cls, n, grams) of the classes in ``names``, one row each.

    The scan passes a set on if the bit set may hold its class; the join drops the rest.
    """
    n = names.count()
    spark = docs.sparkSession
    every = docs.select("text")
    shared = spark.sparkContext.broadcast(bloom(names, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value, len(shared.value) * 32
        for batch in batches:
            for _, data, ends in texts(batch, "text"):
                own: dict[int, np.ndarray] = {}
                for s in sets(data, ends):
                    if len(s):
                        c = class_of(s, seed)
                        if all(words[b >> 5] >> (b & 31) & 1 for b in places_of(c, bits)):
                            own.setdefault(c, s)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([len(s) for s in own.values()], pa.int64()), pa.array([s.astype(np.int64) for s in own.values()], pa.list_(pa.int64()))], names=["cls", "n", "grams"])

    found = by_arrow(every, run, "cls long, n long, grams array<long>")
    out = stored(found.join(names.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    shared.destroy()
    return out


def places_of(c: int, bits: int) -> list[int]:
    """Bits of a class name. The name is a hash already; its halves give the rest (double hashing)."""
    a, b = c & 0xFFFFFFFF, (c >> 32) & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def bloom(names: DataFrame, n: int) -> np.ndarray:
    """A bit set of class names, made on the executors; at most BLOOM_MOST_BITS, so it is small enough to broadcast.

    Beyond that bound it lets more classes through, which the join after it drops.
    """
    bits = min(BLOOM_MOST_BITS, max(1 << 16, 1 << (n * BLOOM_BITS_A_CLASS).bit_length()))
    a, b = "(cls & 4294967295L)", "(shiftrightunsigned(cls, 32) | 1L)"
    places = F.expr("explode(array(" + ", ".join(f"({a} + {i}L * {b}) % {bits}L" for i in range(BLOOM_HASHES)) + "))").alias("bit")
    names = names.select(places).select(F.expr(f"bit div {PIECE_BITS}").alias("piece"), F.expr(f"cast(bit % {PIECE_BITS} as int)").alias("at"))

    def pieces(t: pa.Table) -> pa.Table:
        bits_of = np.zeros(PIECE_BITS, np.uint8)
        bits_of[t.column("at").to_numpy()] = 1
        words = np.packbits(bits_of, bitorder="little").tobytes()
        return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int64()), "words": pa.array([words], pa.binary())})

    out = np.zeros(bits // 32, np.uint32)
    for r in names.distinct().groupBy("piece").applyInArrow(pieces, "piece long, words binary").collect():  # BLOOM_MOST_BITS at most
        at = r["piece"] * PIECE_BITS // 32
        out[at : at + PIECE_BITS // 32] = np.frombuffer(r["words"], np.uint32)
    return out


def prefixes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (cls, n, grams): (cls, n, q) and the prefix entries (cls, n, q, gram).

    q: how many n-grams of a class others have too. Rare n-grams come first; those that nobody else
    has can't meet anything and only use up the prefix.
    """
    grams = own.select("cls", "n", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    often = stored(often, "often")  # without a partitioning to keep, Spark may split a frequent n-gram's rows
    held = grams.join(often, "gram").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("list"))
    held = held.withColumn("q", F.size("list")).filter(F.col("q") >= F.col("n") - F.expr("n div 4"))
    length = F.expr("cast(n div 4 + 1 - (n - q) as int)")
    entries = held.select("cls", "n", "q", F.slice("list", 1, length).alias("head"))
    entries = stored(entries, "prefixes")
    return entries.select("cls", "n", "q"), entries.select("cls", "n", "q", F.explode("head.gram").alias("gram"))


def hub_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (cls, hub): the hub of an n-gram is the class with the smallest name that has it in its prefix."""
    hubs = entries.groupBy("gram").agg(F.count("*").alias("k"), F.min_by(F.struct("cls", "n", "q"), "cls").alias("h")).filter("k > 1")
    hubs = stored(hubs, "hubs")
    met = entries.join(hubs, "gram").filter(F.col("cls") != F.col("h.cls"))
    met = met.select("cls", "n", "q", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.q").alias("hub_q"))
    return met.dropDuplicates(["cls", "hub"])


def overlaps(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Adds overlap to pairs (cls, hub, ...): counted in each of PARTS ranges of the order, then summed per pair."""
    ranges = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("part"), F.filter("grams", lambda g: F.shiftrightunsigned(g, 64 - (PARTS - 1).bit_length()) == p).alias("grams")))
    cut = own.select("cls", F.inline(ranges)).filter(F.size("grams") > 0)
    ids = pairs.select("cls", "hub")
    left = ids.join(cut, "cls")
    right = cut.select(F.col("cls").alias("hub"), "part", F.col("grams").alias("hub_grams")).join(ids.select("hub").distinct(), "hub", "left_semi")
    partial = left.join(right, ["hub", "part"]).select("cls", "hub", F.size(F.array_intersect("grams", "hub_grams")).alias("partial"))
    sums = partial.groupBy("cls", "hub").agg(F.sum("partial").alias("overlap"))
    return pairs.join(sums, ["cls", "hub"], "left").na.fill(0, ["overlap"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the least node of each component.

    Each round sends the least label to neighbours and then jumps to the label's label; the labels
    are written and read back, so that neither lineage nor driver grows.
    """
    both = edges.select("a", "b").filter("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a != b")).distinct()
    both = stored(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("j"), F.col("root").alias("far"))
        new = stored(step.join(jump, F.col("root") == F.col("j"), "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.filter("root != old").limit(1).count():
            return labels


def rest_links(groups: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) between components inside hub groups.

    ``groups``: (hub, cls, n, q, overlap, root, hub_root). Members outside the hub's component
    meet all members, block by block; a task holds LEFT of the ones and RIGHT of the others, or fewer
    if these have more than BLOCK_GRAMS n-grams.
    """
    out = groups.filter(F.col("root") != F.col("hub_root"))
    sizes = groups.groupBy("hub").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    sizes = sizes.join(out.groupBy("hub").agg(F.count("*").alias("outside"), F.sum("n").alias("outside_grams")), "hub")
    n_left = F.ceil(F.greatest(F.col("outside") / LEFT, F.col("outside_grams") / BLOCK_GRAMS)).cast("int")
    n_right = F.ceil(F.greatest(F.col("members") / RIGHT, F.col("grams") / BLOCK_GRAMS)).cast("int")
    sized = sizes.select("hub", n_left.alias("n_left"), n_right.alias("n_right"))
    left = out.join(sized, "hub").withColumn("i", F.pmod(F.xxhash64("cls", F.lit(1)), "n_left").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)))
    right = groups.join(sized, "hub").withColumn("j", F.pmod(F.xxhash64("cls", F.lit(2)), "n_right").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)))
    columns = ["hub", "i", "j", "cls", "n", "q", "overlap", "root"]
    left, right = (x.select(*columns).join(own.select("cls", "grams"), "cls").toDF("cls", *(c for c in columns if c != "cls"), "grams") for x in (left, right))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            found = block_links(*(_Members(t) for t in (a, b)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub", "i", "j")).applyInArrow(run, "a long, b long")


class _Members:
    def __init__(self, t: pa.Table):
        self.cls, self.n, self.q, self.overlap, self.root = (t.column(k).to_numpy() for k in ("cls", "n", "q", "overlap", "root"))
        column = t.column("grams").combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        self.ends = np.cumsum(column.value_lengths().to_numpy())
        self.grams = column.flatten().to_numpy().view(np.uint64)


def block_links(a: _Members, b: _Members) -> list[tuple[int, int]]:
    """For each member of ``a`` one link to each component among ``b`` that it links to, other than its own."""
    least = np.ceil((a.n[:, None] + b.n[None]) * 3 / 7 - 1e-9)
    open_ = a.root[:, None] != b.root[None]
    open_ &= np.minimum(a.n[:, None], b.n[None]) >= least
    open_ &= np.minimum(a.q[:, None], b.q[None]) >= least
    # what both share with the hub, and what neither does
    most = np.minimum(a.overlap[:, None], b.overlap[None]) + np.minimum((a.q - a.overlap)[:, None], (b.q - b.overlap)[None])
    open_ &= most >= least
    if not open_.any():
        return []
    shift = np.uint64(64 - (PARTS - 1).bit_length())
    row_a, row_b = (np.repeat(np.arange(len(m.cls)), np.diff(m.ends, prepend=0)) for m in (a, b))
    part_a, part_b = (m.grams >> shift for m in (a, b))
    total = np.zeros(open_.shape, np.int32)
    left = np.diff(a.ends, prepend=0)[:, None] * np.ones((1, len(b.cls)), np.int64)  # n-grams of a still to come
    for part in range(PARTS):
        own_a, own_b = part_a == part, part_b == part
        gram_b, where_b = b.grams[own_b], row_b[own_b]
        by = np.argsort(gram_b, kind="stable")
        gram_b, where_b = gram_b[by], where_b[by]
        keep = open_.any(1)[row_a[own_a]]
        gram_a, where_a = a.grams[own_a][keep], row_a[own_a][keep]
        lo, hi = np.searchsorted(gram_b, gram_a, "left"), np.searchsorted(gram_b, gram_a, "right")
        for first in range(0, len(gram_a), 4096):  # a few n-grams at a time: their postings stay small
            s, e, w = lo[first : first + 4096], hi[first : first + 4096], where_a[first : first + 4096]
            k = e - s
            at = np.repeat(s - (np.cumsum(k) - k), k) + np.arange(k.sum())
            np.add.at(total, (np.repeat(w, k), where_b[at]), 1)
        left -= np.bincount(row_a[own_a], minlength=len(a.cls))[:, None]
        open_ &= total + left >= least
        if not open_.any():
            return []
    x, y = np.nonzero(open_ & (100 * total >= 75 * (a.n[:, None] + b.n[None] - total)))
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        seen.setdefault((i, int(b.root[j])), (int(a.cls[i]), int(b.cls[j])))
    return list(seen.values())


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, cls) of every row and (cls, root) of the classes that have links, both stored, and the seed of cls."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seed = 0
    while True:
        rows = stored(classes(docs, seed), "classes")
        names = rows.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("low").alias("low"), (F.min("proof") != F.max("proof")).alias("twice"))
        names = stored(names, "names")
        if not names.filter("twice").limit(1).count():
            break
        seed += 1  # two sets have one name: other names
    sent = rows.agg(F.sum("low")).first()[0] or 0  # entries of all rows, since each block sends its own
    counts = shared_counts(docs, max(FRAGMENTS, -(-sent // FRAGMENT_ENTRIES)), seed)
    shared = F.coalesce("shared", F.lit(0))
    alive = stored(names.join(counts, "cls", "left").filter(shared >= F.col("low") - F.expr("n div 4")).select("cls"), "alive")
    own = surviving_sets(docs, alive, seed)
    _, entries = prefixes(own)
    pairs = stored(overlaps(stored(hub_pairs(entries), "pairs"), own), "overlaps")
    links = pairs.filter(100 * F.col("overlap") >= 75 * (F.col("n") + F.col("hub_n") - F.col("overlap"))).select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    roots = components(links)
    groups = members(pairs, roots)
    more = rest_links(groups, own)
    both = stored(links.unionByName(more.select("a", "b")), "links")
    return rows.select("doc_id", "n", "cls"), components(both).select(F.col("node").alias("cls"), "root"), seed


def members(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of hub groups, the hub among them, with their roots."""
    hubs = pairs.groupBy("hub").agg(F.first("hub_n").alias("n"), F.first("hub_q").alias("q"))
    self_ = hubs.select("hub", F.col("hub").alias("cls"), "n", "q", F.col("q").cast("long").alias("overlap"))
    every = pairs.select("hub", "cls", "n", "q", F.col("overlap").cast("long").alias("overlap")).unionByName(self_)
    own_root = roots.select(F.col("node").alias("cls"), F.col("root").alias("r"))
    hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hr"))
    every = every.join(own_root, "cls", "left").join(hub_root, "hub", "left")
    return stored(every.select("hub", "cls", "n", "q", "overlap", F.coalesce("r", "cls").alias("root"), F.coalesce("hr", "hub").alias("hub_root")), "members")


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, cls.

    component_id is the least doc_id of the documents that links reach. Null and empty texts have no
    shingles, link with nothing and stand for themselves; null ids count in a component but don't
    name it, unless it has no other; repeated rows are copies like others. Long texts are read in
    slices (see shingles); an empty table gives no rows; other columns are ignored.
    """
    rows, roots, _ = linked(docs)
    some = rows.filter("n > 0").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # stored tables have no partitioning to keep, so Spark may split the rows of a large component
    least = stored(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    some = some.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cls")
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cls")
    return some.unionByName(none)


def named(docs: DataFrame, seed: int) -> DataFrame:
    """The class of its text for every row of ``docs`` (doc, row: a struct with the text): doc, row, cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, ends in texts(batch, "text"):
                got = pa.array([class_of(s, seed) for s in sets(data, ends)], pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), got], names=["doc", "row", "cls"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_row(docs).alias("row"), "text")
    return by_arrow(rows, run, f"doc long, row {rows.schema['row'].dataType.simpleString()}, cls long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, maybe more columns) with one row of each component: its least doc_id's, null last.

    Rows without shingles (null, empty and blank texts) all stay. Of rows equal in doc_id and set, one
    stays. An empty table gives no rows.
    """
    rows, roots, seed = linked(docs)
    some = rows.filter("n > 0").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    best = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("b"))
    known = [F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"), "cls"]
    best = stored(best.select(F.col("b.doc_id").alias("doc"), "b.cls").select(*known), "best")
    every = named(docs, seed)
    # texts are shuffled once: the join and what follows it deal rows by the same keys
    first = every.filter("cls != 0").select("row", *known).join(best, ["none", "id", "cls"], "left_semi")
    first = first.dropDuplicates(["none", "id", "cls"]).select("row.*")
    return first.unionByName(every.filter("cls = 0").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id
  WHERE 100 * o >= 75 * (sx.n + sy.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT reach.node, edges.y FROM reach JOIN edges ON reach.other = edges.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON d.doc_id = r.node
LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
