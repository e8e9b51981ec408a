"""Near-duplicate groups from an LSH forest.

Documents with equal shingle sets become one class.  Every class has a
MinHash signature; a tree of the forest is the list of all classes sorted by
a few of its values.  A region is entered by three values at least, so classes
alike at 0.8 share one in some of 20 trees but for a chance of 0.488**20, less
than one in a million.  Candidates are neighbours in those orders: where a
region (classes that share a prefix) is small all its pairs, where it is large
the region is entered deeper, value by value, until its parts are small, and
next neighbours by longest common prefix are taken at every depth.  So a
region gives a number of pairs in proportion to its classes whatever its size.
In a large region the class that shares most of its prefixes with others, its
centre, is paired with all that are not yet linked to it, and so is the centre
of what is then left, until a round finds no link: copies of one text with
changes of their own are alike to that text but seldom to each other.  What
large regions then still hold in several components is joined on the rarest
shingles of each set (a prefix filter, exact), so that no pair in them is lost.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize, scratch, shuffle_partitions
from termloom.llm.graph import components
from termloom.llm.sieve import sieve
from termloom.llm.shingles import fold, shingle_sets, similar, slices

TREES, DEPTH, REGION, NEAR = 20, 3, 8, 2
SLOT_BITS = 21
_R = np.random.RandomState(77)
_A = (_R.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) << np.uint64(32)) | _R.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = (_R.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) << np.uint64(32)) | _R.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit MinHash values for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), len(_A)), dtype=np.uint64)
    buffer = np.empty_like(flat)
    for k in range(len(_A)):
        np.bitwise_xor(flat, _B[k], out=buffer)
        np.multiply(buffer, _A[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, at)
    return (out >> np.uint64(20)) & np.uint64(0xFFFF)


def _keys(signature: np.ndarray) -> np.ndarray:
    """Sort keys of the trees: three own values and the next tree's first."""
    own = signature.reshape(len(signature), TREES, DEPTH)
    after = np.roll(own[:, :, 0], -1, axis=1)
    s = np.uint64(16)
    return ((((own[:, :, 0] << s | own[:, :, 1]) << s | own[:, :, 2]) << s) | after).astype(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (set hashes), keys (one for each tree)."""

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch, 2 << 20):
                sets = shingle_sets([fold(t) for t in rows.column(1).to_pylist()], words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
                keys = [[]] * len(n)
                if len(full):
                    own = [sets[i] for i in full]
                    flat, start = np.concatenate(own), (np.cumsum(n[full]) - n[full])
                    s1[full] = np.add.reduceat(flat, start)
                    s2[full] = np.add.reduceat(flat * (flat >> np.uint64(17) | np.uint64(1)), start)
                    made = _keys(signatures(own))
                    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * TREES)]), pa.int32()), pa.array(made.reshape(-1), pa.int64()))
                else:
                    keys = pa.array(keys, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), keys], names=["doc_id", "n", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def _pairs(tree, k1, k2, ids, n, percent: int) -> np.ndarray:
    """Candidate pairs (row numbers) of sorted rows."""
    m = len(ids)
    prefix = [k1 >> 16, k1, *(k2 >> s for s in (48, 32, 16, 0))]
    found = []
    region = np.zeros(m, dtype=np.int64)
    for depth, key in enumerate(prefix):
        new = np.ones(m, dtype=bool)
        if m > 1:
            new[1:] = (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])
            if depth > 1:
                new[1:] |= k1[1:] != k1[:-1]
        at = np.cumsum(new) - 1
        small = np.bincount(at)[at] <= REGION
        for w in range(1, REGION):
            same = at[w:] == at[:-w]
            take = same & (small[w:] if w > NEAR else True)
            found.append(np.stack([np.flatnonzero(take), np.flatnonzero(take) + w]))
        region = at
    del region
    p = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    a, b = n[p[0]], n[p[1]]
    ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (ids[p[0]] != ids[p[1]])
    return p[:, ok]


def _crowded(tree: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Rows of regions of two values that hold more than REGION rows here, or
    that may go on beside this partition."""
    m = len(tree)
    new = np.ones(m, dtype=bool)
    new[1:] = (tree[1:] != tree[:-1]) | ((k1[1:] >> 32) != (k1[:-1] >> 32))
    at = np.cumsum(new) - 1
    return np.flatnonzero((np.bincount(at)[at] > REGION) | (at == 0) | (at == at[-1]))


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of classes that are neighbours in some tree, and
    the rows (tree, k1, doc_id, n) of regions that may be large."""
    spark = classes.sparkSession
    turned = F.concat(F.slice("keys", 8, TREES - 7), F.slice("keys", 1, 7))
    rows = classes.select(F.posexplode(F.arrays_zip(F.col("keys").alias("a"), turned.alias("b"))).alias("tree", "k"), "doc_id", "n").select("tree", F.col("k.a").alias("k1"), F.col("k.b").alias("k2"), "doc_id", "n")
    order = ["tree", "k1", "k2", "doc_id"]
    parts = shuffle_partitions(spark)
    schema = "a long, b long, kind int, tree int, k1 long, k2 long, doc_id long, n long"
    names = ["a", "b", "kind", "tree", "k1", "k2", "doc_id", "n"]

    def find(batches, last: bool = False):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        tree, k1, k2, ids, n = (t.column(c).to_numpy() for c in ("tree", "k1", "k2", "doc_id", "n"))
        p = _pairs(tree, k1, k2, ids, n, percent)
        x = np.unique(np.sort(np.stack([ids[p[0]], ids[p[1]]]), axis=0), axis=1)
        k = x.shape[1]
        none = lambda kind: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(np.zeros(k, dtype=np.int32)), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64())], names=names)
        if not last:  # the rows beside a partition's bounds meet once more
            beside = np.unique(np.concatenate([np.arange(min(REGION, len(ids))), np.arange(max(0, len(ids) - REGION), len(ids))]))
            for kind, at in ((1, beside), (2, _crowded(tree, k1))):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(at), kind, dtype=np.int32)), *(pa.array(c[at]) for c in (tree, k1, k2, ids, n))], names=names)

    found = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(find, schema), "candidates")
    edges = found.filter("kind = 1").select(*order, "n").coalesce(1).sortWithinPartitions(*order)
    across = edges.mapInArrow(lambda b: find(b, True), schema)
    pairs = found.filter("kind = 0").select("a", "b").unionByName(across.select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("trees"))
    return pairs, found.filter("kind = 2").select("tree", "k1", "doc_id", "n")


def _members(crowd: DataFrame) -> DataFrame:
    """tree, region, doc_id, n and score of the classes in large regions.

    A class's score is the number of rows that share its prefix of four
    values, over all trees: the original of many changed copies has the
    greatest of them.  The counts joined are tables of their own, so that both
    sides of a join are plain exchanges and a hot key can be split."""
    crowd = crowd.select("tree", F.shiftright("k1", 32).alias("region"), "k1", "doc_id", "n")
    large = crowd.groupBy("tree", "region").agg(F.count("*").alias("c")).filter(F.col("c") > REGION).select("tree", "region")
    large = materialize(large, "large-regions")
    rows = materialize(crowd.join(large, ["tree", "region"]), "crowded")
    alike = materialize(rows.groupBy("tree", "k1").agg(F.count("*").alias("alike")), "alike")
    score = rows.join(alike, ["tree", "k1"]).groupBy("doc_id").agg(F.sum("alike").alias("score"))
    return materialize(rows.drop("k1").join(score, "doc_id"), "members")


def _central_pairs(members: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each region's centre with its classes of other components, and
    the members that are not in their centre's component."""
    root = F.coalesce("root", "doc_id")
    now = materialize(members.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", root), "rooted-members")
    centre = now.groupBy("tree", "region").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("least"), F.col("n").alias("m"), F.col("root").alias("own"))).alias("c"))
    centre = materialize(centre.select("tree", "region", (-F.col("c.least")).alias("centre"), F.col("c.m").alias("m"), F.col("c.own").alias("own")), "centres")
    rest = materialize(now.join(centre, ["tree", "region"]).filter("root <> own"), "rest-members")
    close = rest.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = close.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    return pairs, rest.select("tree", "region", "doc_id", "n", "score")


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and root of the classes that share a large region with a class of
    another component."""
    root = F.coalesce("root", "doc_id").alias("root")
    now = members.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("tree", "region", "doc_id", root)
    now = materialize(now, "rooted-members")
    mixed = now.groupBy("tree", "region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("tree", "region")
    mixed = materialize(mixed, "mixed-regions")
    return materialize(now.join(mixed, ["tree", "region"]).select("doc_id", "root").distinct(), "unsettled")


def _levels(texts: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each hashed slot occur, as a logarithm: 0 for
    once at most.  Four bits of each of the 2**SLOT_BITS slots come to the
    driver.  Slots that shingles share make an order less sharp, never wrong."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for rows in slices(batch):
                sets = shingle_sets([fold(t) for t in rows.column(2).to_pylist()], words)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "c"])

    slots = texts.mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).filter("c > 1")
    slots = slots.select("slot", F.least(F.floor(F.log2("c")), F.lit(15)).cast("long").alias("level"))
    packed = slots.groupBy(F.shiftright("slot", 4).alias("w")).agg(F.bit_or(F.expr("shiftleft(level, int(4 * (slot & 15)))")).alias("m")).collect()
    table = np.zeros(1 << (SLOT_BITS - 4), dtype=np.int64)
    for r in packed:
        table[r["w"]] = r["m"]
    return ((table[:, None] >> (4 * np.arange(16))) & 15).astype(np.uint8).reshape(-1)


def _prefixes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """shingle, doc_id, root, n, at and short: the rarest shingles of each set
    (doc_id, root, text), by rank.  A set meets every alike one that is not
    longer in its first n - percent/100 n + 1 shingles, and every one that is
    not shorter in those marked short."""
    held = texts.sparkSession.sparkContext.broadcast(_levels(texts, words))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                out = []
                for k, own in enumerate(shingle_sets([fold(t) for t in rows.column(2).to_pylist()], words)):
                    level = held.value[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    n = len(own)
                    first = np.lexsort((own, level))[: n + (-percent * n // 100) + 1]
                    at = np.flatnonzero(level[first])  # others occur in this set only
                    short = at <= n + (-2 * percent * n // (100 + percent))
                    out.append((own[first[at]].view(np.int64), np.full(len(at), k), np.full(len(at), n), at, short))
                shingle, k, n, at, short = (np.concatenate(x) for x in zip(*out, strict=True))
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), rows.column(0).take(k), rows.column(1).take(k), pa.array(n), pa.array(at), pa.array(short)], names=["shingle", "doc_id", "root", "n", "at", "short"])

    return texts.mapInArrow(cut, "shingle long, doc_id long, root long, n long, at long, short boolean")


def _exact_pairs(unsettled: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of several components that may be alike; none
    that is alike is left out.

    A shared shingle is a candidate if what follows it in both sets suffices.
    Of a shingle's classes only those outside its commonest component are
    paired with all, since others would pair inside that component."""
    texts = materialize(_texts(docs, unsettled).select("doc_id", "root", "text"), "unsettled-texts")
    rows = materialize(_prefixes(texts, words, percent), "rare-shingles")
    discard(texts)
    counts = materialize(rows.groupBy("shingle", "root").agg(F.count("*").alias("c")), "shingle-roots")
    major = counts.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("shingle", F.col("m.root").alias("major"))
    shared = materialize(rows.join(materialize(major, "major-roots"), "shingle"), "shared-shingles")
    minor = materialize(shared.filter("root <> major"), "minor-shingles")
    x, y = (d.select("shingle", *(F.col(c).alias(p + c) for c in ("doc_id", "root", "n", "at", "short"))) for d, p in ((minor, "x_"), (shared, "y_")))
    longer = lambda p, q: F.col(f"{q}_short") & (F.col(f"{p}_n") >= F.col(f"{q}_n"))
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    close = (F.col("x_root") != F.col("y_root")) & (longer("x", "y") | longer("y", "x")) & ((100 + percent) * left >= percent * (F.col("x_n") + F.col("y_n"))) & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    return x.join(y, "shingle").filter(close).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def _texts(docs: DataFrame, wanted: DataFrame, few: int = 500_000) -> DataFrame:
    """doc_id, text and the columns of ``wanted`` of the documents in it: up to
    ``few`` rows of it (8 MB of numbers) go to the documents, more meet those
    that pass a bitmap."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if wanted.count() <= few:
        return named.join(F.broadcast(wanted), "doc_id")
    return sieve(named, "doc_id", wanted.select("doc_id")).join(wanted, "doc_id")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialize(_texts(docs, materialize(wanted, "candidate-ids")), "candidate-texts")
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            for r in slices(batch, 4 << 20):
                ta, tb = r.column(2).to_pylist(), r.column(3).to_pylist()
                number: dict = {}
                for t in (*ta, *tb):
                    number.setdefault(t, len(number))
                sets = shingle_sets([fold(t) for t in number], words)
                ok = [similar(sets[number[x]], sets[number[y]], percent) for x, y in zip(ta, tb, strict=True)]
                yield pa.RecordBatch.from_arrays([r.column(0), r.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(test, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    component_id is the least doc_id reachable over links of similarity
    ``percent``/100 or more between sets of ``words``-word shingles; kept marks
    the row with that id.  Empty or null texts have no shingle and no link.  A
    null doc_id links with nothing: its component_id is null and it is kept.
    Rows that share a doc_id count as one document.  A text is read whole
    whatever its length, about two megabytes of texts (or one longer text) at a
    time; an empty table gives no rows.  Only doc_id and text are read, so
    other columns never clash.  Of the tables this makes on its way only the
    two that the result reads stay in the shared folder.
    """
    with scratch() as kept:
        return _near_duplicates(docs, words, percent, kept)


def _near_duplicates(docs: DataFrame, words: int, percent: int, kept) -> DataFrame:
    sketch = kept(materialize(sketches(docs, words), "sketches"))
    named = sketch.filter("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    lone = materialize(named.join(classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"]).dropDuplicates(["doc_id", "n", "s1", "s2"]), "class-sketches")
    near, crowd = candidates(lone.select("doc_id", "n", "keys"), percent)
    pairs = materialize(near, "pairs")
    discard(lone)
    # A first round confirms each class's best pair; pairs inside a component need no test after that.
    best = pairs.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "trees").groupBy("x").agg(F.max(F.struct("trees", -F.col("a"), -F.col("b"))).alias("m"))
    first = materialize(best.select((-F.col("m")[F.lit("col2")]).alias("a"), (-F.col("m")[F.lit("col3")]).alias("b")).distinct(), "best-pairs")
    links = materialize(confirm(first, docs, words, percent), "links")
    roots = materialize(components(links), "roots")
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = materialize(rest, "rest")
    if not rest.isEmpty():
        links = materialize(links.unionByName(confirm(rest, docs, words, percent)), "links")
        roots = materialize(components(links), "roots")
    tested = pairs.select("a", "b")
    crowded = members = _members(crowd)
    while not members.isEmpty():
        central, members = _central_pairs(members, roots, percent)
        central = materialize(central.join(tested, ["a", "b"], "left_anti"), "central-pairs")
        fresh = None if central.isEmpty() else materialize(confirm(central, docs, words, percent), "central-links")
        if fresh is None or fresh.isEmpty():
            break  # what is left apart is joined exactly
        tested = tested.unionByName(central)
        links = materialize(links.unionByName(fresh), "links")
        roots = materialize(components(links), "roots")
    unsettled = _unsettled(crowded, roots)
    if not unsettled.isEmpty():
        exact = materialize(_exact_pairs(unsettled, docs, words, percent).join(tested, ["a", "b"], "left_anti"), "exact-pairs")
        if not exact.isEmpty():
            links = materialize(links.unionByName(confirm(exact, docs, words, percent)), "links")
            roots = materialize(components(links), "roots")
    root_of = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("root"))
    root_of = kept(materialize(root_of, "class-roots"))
    with_root = sketch.select("doc_id", "n", "s1", "s2").join(root_of, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return with_root.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
