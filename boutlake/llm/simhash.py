"""SimHash fingerprints and their near-duplicate components by covering locality-sensitive hashing.

For radius r every bit position gets a nonzero vector of r+1 bits; each nonzero
vector v gives the mask that drops the positions whose vectors are orthogonal to v
over GF(2). Any r positions span less than the whole space, so some v is orthogonal
to all of them: two fingerprints at distance r or less agree under that mask, and
collide in its table. Nothing within the radius is missed.

Links within the radius may be checked exactly afterwards, by the similarity of the
two texts' sets of word shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlake.llm.common import hot_keys, join_hot, lanes, pinned, quoted

BITS = 64
BLOCK = 1024


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text; 0 for a text without words (and for null)."""
    w = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) of every whole text, and the columns ``also``; fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=[id_col, "fp", *also])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    return docs.select(id_col, F.col(text_col), *also).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long{kept}")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(r+1)-1 masks as unsigned integers; position i gets the vector i mod (2^(r+1)-1) + 1."""
    size = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (i % size + 1 & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_keys(fp: Column, radius: int) -> Column:
    """One (table, key) struct for each covering mask."""
    return F.array(*[F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(covering_masks(radius))])


def spanning_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), each within ``radius``, that connect just what all pairs within it connect: at any smaller radius too.

    They are a minimum spanning forest of the distances, grown from one fingerprint
    after the other, so there are fewer of them than of fingerprints.
    """
    n = len(fp)
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :])
    apart[apart > radius] = BITS + 1
    outside, least, parent = np.ones(n, bool), np.full(n, BITS + 1, apart.dtype), np.full(n, -1)
    for _ in range(n):
        at = int(np.where(outside, least, BITS + 2).argmin())
        outside[at] = False
        closer = outside & (apart[at] < least)
        least[closer], parent[closer] = apart[at][closer], at
    linked = np.flatnonzero(parent >= 0)
    return linked, parent[linked]


def links(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of node ids, each within ``radius``, that connect all nodes (id, fp) within ``radius``, transitively.

    A bucket of a table with more than ``block`` fingerprints is cut into blocks
    by a hash of the fingerprint, and every pair of its blocks is compared in a
    group of its own, so no task holds a bucket whole and no pair is left out.
    Only spanning links leave a group, never all pairs.
    """
    dealt = nodes.repartition(lanes(nodes.sparkSession), "id")  # a node becomes a row for each table: small tasks before that
    keyed = dealt.select("id", "fp", F.explode(table_keys(F.col("fp"), radius)).alias("k")).select("id", "fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    many = keyed.join(sizes, ["t", "key"])
    mine = F.pmod(F.xxhash64("fp", F.lit(77)), F.col("blocks")).cast("int")
    blocks = (
        many.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "key", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), F.struct("fp", "id").alias("x"))
    )
    groups = blocks.groupBy("t", "key", "b1", "b2").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1).select("xs")
    id_type = nodes.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten()
            fp = values.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            ids = values.field(1).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            out_a, out_b = [ids[:0]], [ids[:0]]
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if hi - lo == 2:
                    if int(fp[lo] ^ fp[lo + 1]).bit_count() <= radius:
                        out_a.append(ids[lo : lo + 1])
                        out_b.append(ids[lo + 1 : hi])
                    continue
                i, j = spanning_links(fp[lo:hi], radius)
                out_a.append(ids[lo:hi][i])
                out_b.append(ids[lo:hi][j])
            id_arrow = values.field(1).type
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), id_arrow) for x in (out_a, out_b)], names=["a", "b"])

    found = groups.mapInArrow(run, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, rep) for every id that is in a link: rep is the same for just the ids that links connect.

    Each round every id moves to the neighbour (or itself) with the least hash of
    that round and the links move along, so that the number of links falls by a
    constant factor a round in expectation, whatever the shape of the components.
    Links and assignments are checkpointed to the shared folder; the driver sees
    only whether any link is left.
    """
    edges = pinned(edges.where("a != b"))
    at = None
    k = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        move = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a")).getField("id").alias("to"))
        move = pinned(move)
        step = move.withColumnRenamed("a", "rep")
        at = pinned(move.select(F.col("a").alias("id"), F.col("to").alias("rep")) if at is None else at.join(step, "rep", "left").select("id", F.coalesce("to", "rep").alias("rep")))
        edges = pinned(
            edges.join(move.select("a", F.col("to").alias("x")), "a")
            .join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        k += 1
    if at is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("rep"))
    return at


def shingle_sets(texts: DataFrame, words: int = 5) -> DataFrame:
    """(node, n, hashes) of every whole text (node, text): its distinct word shingles as XXH64, n of them.

    Words are those of ``fingerprint``; fewer words than ``words`` are one shingle, none give an empty set.
    """

    def run(batches):
        for b in batches:
            sets = []
            for t in b.column(1):
                w = (t.as_py() or "").encode("utf-8").lower().split()
                grams = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else ()
                sets.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams))).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "hashes"])

    return texts.select("node", "text").mapInArrow(run, f"node {texts.schema['node'].dataType.simpleString()}, n int, hashes array<long>")


def alike(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more; two empty sets are equal.

    A text with very many links, such as a star's pivot, is sent to where its links are.
    """
    one, two = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    total = edges.count()
    hot = {c: pinned(hot_keys(edges.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, total)) for c in "ab"}
    # no more than the smaller set can be shared, which spares most pairs of unequal lengths
    both = join_hot(join_hot(edges, one, hot["a"], "a"), two, hot["b"], "b").where(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b"))
    shared = F.size(F.array_intersect("h_a", "h_b"))
    return both.where((F.col("n_a") + F.col("n_b") == 0) | (shared >= F.lit(least) * (F.col("n_a") + F.col("n_b") - shared))).select("a", "b")


def bucket_members(nodes: DataFrame, radius: int) -> DataFrame:
    """(t, key, id, fp, pivot, pivot_fp) of the nodes (id, fp) in buckets of several, with the bucket's first node by a hash that is the same in all tables.

    Most nodes are alone in most buckets, so what is left is written once and read by all that follows.
    """
    keyed = nodes.repartition(lanes(nodes.sparkSession), "id").select("id", "fp", F.explode(table_keys(F.col("fp"), radius)).alias("k")).select("id", "fp", "k.t", "k.key")
    order = F.struct(F.xxhash64("fp", F.lit(5)).alias("h"), F.col("fp").alias("pivot_fp"), F.col("id").alias("pivot"))
    first = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("p")).where("n > 1").select("t", "key", "p.pivot_fp", "p.pivot")
    return pinned(keyed.join(first, ["t", "key"]))


def star_pairs(members: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) within ``radius``: in every bucket each node with the pivot, so a large group of close fingerprints mostly has one, and each of its nodes few pairs."""
    met = members.where((F.col("id") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot_fp"))) <= radius))
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def crossing_pairs(members: DataFrame, reps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) within ``radius`` of bucket members that differ in their rep; ``reps`` has (id, rep), nodes without a row are their own.

    In a bucket everything meets what isn't of the bucket's largest ``rep``, in blocks
    of both: a large group that is connected already costs no more than its nodes times
    the others in its buckets.
    """
    keyed = members.join(reps.select("id", F.col("rep").alias("_rep")), "id", "left").select("t", "key", "id", "fp", F.coalesce("_rep", "id").alias("rep"))
    parts = keyed.groupBy("t", "key", "rep").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("t", "key").agg(F.count(F.lit(1)).alias("reps"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("rep", "n").alias("main")).where("reps > 1")
    of = lambda n: F.ceil(n / block).cast("int")
    rows = keyed.join(mixed.select("t", "key", "main", of(F.col("n")).alias("blocks"), of(F.col("n") - F.col("most")).alias("others")), ["t", "key"])
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = rows.select("t", "key", place(77, "blocks").alias("b"), each("others").alias("o"), "fp", "id", "rep", F.lit(0).alias("side"))
    other = rows.where("rep != main").select("t", "key", each("blocks").alias("b"), place(78, "others").alias("o"), "fp", "id", "rep", F.lit(1).alias("side"))
    groups = every.unionByName(other).groupBy("t", "key", "b", "o").agg(F.collect_list(F.struct("fp", "id", "rep", "side")).alias("xs")).where(F.size("xs") > 1).select("xs")
    id_type = members.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten()
            fp, side = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            fp, ids, reps = fp.view(np.uint64), values.field(1).to_numpy(zero_copy_only=False), values.field(2).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            out_a, out_b = [ids[:0]], [ids[:0]]
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                one, two = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                i, j = np.nonzero(np.bitwise_count(fp[one][:, None] ^ fp[two][None, :]) <= radius)
                i, j = one[i], two[j]
                apart = reps[i] != reps[j]
                out_a.append(ids[i[apart]])
                out_b.append(ids[j[apart]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), values.field(1).type) for x in (out_a, out_b)], names=["a", "b"])

    found = groups.mapInArrow(run, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, radius: int, least: float, words: int = 5) -> DataFrame:
    """Links (a, b) of nodes (id, fp) that connect just what all pairs within ``radius`` and of a similarity of ``least`` connect.

    Stars are checked first. What they leave apart meets again, in full: a pair that is
    within the radius and not yet connected is checked, however many there are.
    ``texts`` has (node, text), a row or more for each node.
    """

    def checked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = texts.join(ends, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        return pinned(alike(pairs, pinned(shingle_sets(own, words)), least))

    members = bucket_members(nodes, radius)
    stars = pinned(star_pairs(members, radius))
    linked = checked(stars)
    rest = pinned(crossing_pairs(members, components(linked), radius).join(stars, ["a", "b"], "left_anti"))
    return linked.unionByName(checked(rest))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, similar_words: int = 5) -> DataFrame:
    """(id, fingerprint as 16 lowercase hex digits, component_id) of every row.

    Fingerprints at ``radius`` or fewer differing bits link; component_id is the
    smallest id that links reach, the row's own included. Texts without words
    (and null texts) have fingerprint 0 and link like any other. Repeated rows
    are all returned; a null id takes part, but is never a component_id unless
    its component has no other id. Copies are folded to one node before any
    bucket is made.

    With ``similarity``, nodes are distinct texts instead of distinct fingerprints, and
    a link counts only if the Jaccard similarity of the texts' sets of ``similar_words``
    words is that or more, exactly. Components are those of all such links, of which only
    as many are checked as connect them; pairs that fail are all checked.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    if similarity is None:
        fps = pinned(fingerprints(rows, "id", "text", words).withColumn("node", F.col("fp")))
    else:
        rows = rows.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))  # 16 bytes, so that no two texts meet in one node
        fps = pinned(fingerprints(rows, "id", "text", words, ("node",)))
    nodes = pinned(fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    ids = nodes.select(F.col("node").alias("id"), "fp")
    edges = links(ids, radius) if similarity is None else similar_links(ids, rows.select("node", "text"), radius, similarity, similar_words)
    reached = components(edges)
    known = reached.withColumnRenamed("id", "node").join(nodes, "node")
    least = known.groupBy("rep").agg(F.min("least").alias("component_id"))
    named = nodes.join(known.select("node", "rep").join(least, "rep").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = join_hot(fps, pinned(named), hot_keys(nodes, "node", fps.count()), "node")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
