"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set of word shingles gives a signature of ``CHUNKS`` x ``WIDTH`` minhashes of b bits. Two documents whose
signatures differ in at most ``CHUNKS * (ERRORS + 1) - 1`` places have, by the pigeonhole principle, a chunk with at most
``ERRORS`` errors; so each chunk is indexed under every choice of ``WIDTH - ERRORS`` of its places, and every such pair meets
in a bucket: none under the distance threshold is missed. At a similarity of 0.8 a pair differs in 8 of 40 places on average, and
in more than the threshold of 19 with a probability of 2e-5, which falls fast above 0.8 (0.85: 2e-7); that is what a signature can
miss. Pairs under the threshold are confirmed on the full shingle sets, and confirmed links make components.

Documents with equal sets are one class from the start. Links between classes are found in rounds, so that a bucket never
gives all its pairs: first each member with the smallest of its bucket, then of salted parts of it, and last, only between
classes of a bucket that no chain of links has joined yet, the pairs that are left, each in the first bucket it shares
only. For those, each set is counted in ``PARTS`` parts by hash, without the shingles that no other document of these
buckets has: the parts' smaller counts bound the intersection from above, so most near pairs that are no links are never
made. Whatever can be linked is compared before two components stay apart, so the components are those of all links.

Defined results: a null, empty or wordless text has n_shingles 0 and is linked with nothing; fewer words than a shingle
make one; rows that share a doc_id are one node (links through equal sets of any of
them, other links by the least of their sets); a null doc_id is linked with nothing, has component_id null and is kept;
a very long text has a signature like any other, and its set
in memory of its own size; among equal hashes and equal sets the smallest doc_id speaks for all, so ties give one result; an empty
table gives no rows; other columns, whatever their names, are not read.

Scale: the text is read once for signatures (a few hundred bytes a document) and once more only for documents in candidate
pairs. Bucket minima are pre-aggregated; joins on buckets are skew-splittable; components iterate on links alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.llm.shared import cut, mapped, small, with_group
from strandline.llm.words import BLANK_SEPARATED, U, Words, chunks, fold, mix, signed, window_hashes

SHINGLE, CHUNKS, WIDTH, ERRORS, BITS = 5, 10, 4, 1, 16
PERCENT, SALTS, PARTS = 80, (16,), 128
PLACES = list(combinations(range(WIDTH), WIDTH - ERRORS))
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 2**63, CHUNKS * WIDTH, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct shingle hashes of each row of a chunk, in row order and sorted; where each row's begin, with the end)."""
    h = words.hashes()
    g = window_hashes(h, size)
    whole = fold(h, words.first, 6)
    parts, first = [], [0]
    for i, n in enumerate(words.counts.tolist()):
        a = int(words.first[i])
        own = np.unique(g[a : a + n - size + 1]) if n >= size else whole[i : i + 1] if n else g[:0]
        parts.append(own)
        first.append(first[-1] + len(own))
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.array(first)


def _signatures(documents: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n (set size), k1, k2 (digest of the set), signature (CHUNKS * WIDTH values of BITS bits), keys (of the buckets)."""
    kind = dict(documents.dtypes)["doc_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, sig, keys = [], [], [], []
            for lo, hi, data, off in chunks(batch.column(1)):
                flat, first = shingle_sets(Words(data, off, BLANK_SEPARATED, lower=True), size)
                counts = np.diff(first)
                k.append(np.stack([fold(flat, first, 1), fold(flat, first, 2)], 1))
                n.append(counts)
                least = np.zeros((hi - lo, CHUNKS * WIDTH), np.uint16)
                full = counts > 0
                if len(flat):
                    for j in range(CHUNKS * WIDTH):
                        low = np.minimum.reduceat(flat * _MULTIPLY[j] + _ADD[j], first[:-1][full])
                        least[full, j] = mix(low) >> U(64 - BITS)
                sig.append(least)
                wide = least.astype(U).reshape(-1, CHUNKS, WIDTH)
                own = []
                for c in range(CHUNKS):
                    for p, places in enumerate(PLACES):
                        x = np.full(hi - lo, U(c * len(PLACES) + p + 1))
                        for q in places:
                            x = mix(x * U(65599) + wide[:, c, q] + U(1))
                        own.append(x)
                keys.append(np.stack(own, 1))
            rows = batch.num_rows
            sig = np.concatenate(sig) if sig else np.empty((0, CHUNKS * WIDTH), np.uint16)
            flat = signed(np.concatenate(keys).ravel()) if keys else np.empty(0, np.int64)
            k = np.concatenate(k) if k else np.empty((0, 2), U)
            per = CHUNKS * len(PLACES)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * CHUNKS * WIDTH, pa.int32()), pa.array(np.ascontiguousarray(sig).ravel().view(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(signed(k[:, 0])), pa.array(signed(k[:, 1])), packed, pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * per, pa.int32()), pa.array(flat))], names=["doc_id", "n", "k1", "k2", "signature", "keys"])

    return mapped(documents, step, f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, signature array<smallint>, keys array<bigint>")


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """doc_id and the distinct shingles of each row."""
    kind = dict(documents.dtypes)["doc_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lo, hi, data, off in chunks(batch.column(1)):
                flat, first = shingle_sets(Words(data, off, BLANK_SEPARATED, lower=True), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(flat)))], names=["doc_id", "shingles"])
                at += hi - lo

    return mapped(documents, step, f"doc_id {kind}, shingles array<bigint>")


def _near(a: str, b: str) -> Column:
    """Whether two signatures (as arrays of places) differ in at most MAX_DISTANCE places."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same >= CHUNKS * WIDTH - MAX_DISTANCE


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable): labels take the minimum over links, then jump along their own labels."""
    links = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        seen = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("other"))
        new = labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = new.join(jump, new.label == jump["at"], "left").select("node", "was", F.least("label", "further").alias("label"))
        told = Observation()
        new = cut(new.observe(told, F.count_if(F.col("was") != F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if not told.get["changed"]:
            return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def _counted(sets: DataFrame) -> DataFrame:
    """rep and how many of its shingles that other of these documents have too fall in each of PARTS parts."""
    part = F.pmod("s", F.lit(PARTS)).cast("int").alias("part")
    spread = sets.select("doc_id", F.explode("shingles").alias("s"))
    alone = spread.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("doc_id")).where("m = 1").groupBy("doc_id", part).agg(F.count(F.lit(1)).alias("own"))
    alone = alone.groupBy("doc_id").agg(F.collect_list("part").alias("parts"), F.collect_list("own").alias("owns"))
    kind = dict(sets.dtypes)["doc_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, PARTS), np.int32)
            for i in range(batch.num_rows):
                counts[i] = np.bincount(np.asarray(batch.column(1)[i].values, np.int64) % PARTS, minlength=PARTS)
                if batch.column(2)[i].is_valid:
                    counts[i] -= np.bincount(np.asarray(batch.column(2)[i].values), np.asarray(batch.column(3)[i].values), PARTS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * PARTS, pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["rep", "h"])

    return mapped(sets.join(alone, "doc_id", "left").select("doc_id", "shingles", "parts", "owns"), step, f"rep {kind}, h array<int>")


def _total(counts: str | Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _possible(percent: int, common: Column | None = None) -> Column:
    """Whether a pair can be similar enough at all: the intersection is no larger than common (the sum of the parts' smaller counts)."""
    enough = lambda c: 100 * c >= percent * (F.col("na") + F.col("nb") - c)
    if common is not None:
        return enough(common)
    return F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x, enough)


def _first_bucket() -> Column:
    """The first of the buckets (numbered as keys are) that two signatures share. One loop over literals: code per bucket would be too long to be compiled."""
    buckets = F.array(*[F.array(*[F.lit(c * WIDTH + q) for q in places]) for c in range(CHUNKS) for places in PLACES])
    shared = F.transform(buckets, lambda places: F.forall(places, lambda q: F.col("pa")[q] == F.col("pb")[q]))
    return F.array_position(shared, True) - 1


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(similar).select("a", "b")


def classes(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents."""
    docs = documents.select("doc_id", "text")
    signed_rows = cut(_signatures(docs, size), "signatures")
    known = signed_rows.where("doc_id is not null and n > 0")
    least = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m"))
    reps = cut(least.select("rep", "n", "signature", "keys", "k1", "k2", "m"), "classes")
    buckets = cut(reps.select("rep", F.posexplode("keys").alias("place", "key")), "buckets")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    buckets = cut(buckets.join(shared, "key", "left_semi"), "buckets")
    # rows that share a doc_id are one node, so their classes are linked
    ties = known.groupBy("doc_id", "k1", "k2").count().groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    tied = known.join(small(cut(ties, "ties")), "doc_id", "left_semi").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    nodes = reps.select(F.col("rep").alias("node")).union(tied.select("b")).distinct()
    members = reps.join(small(cut(buckets.select("rep").distinct(), "ids")), "rep", "left_semi").select("rep", "n", F.col("signature").alias("p"))
    members = cut(members.dropDuplicates(["rep"]), "members")

    def sides(pairs: DataFrame, members: DataFrame, possible: Column) -> DataFrame:
        """The pairs that are near and possible."""
        for x in ("a", "b"):
            pairs = pairs.join(members.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}{x}") for c in members.columns if c != "rep"]), x)
        return pairs.where(possible & _near("pa", "pb")).select("a", "b")

    def stars(buckets: DataFrame, salts: tuple[int, ...]) -> DataFrame:
        """Each member with two of the smallest of its buckets, or of salted parts of them: the least, and the one met most often. A start only: round 3 misses nothing."""
        parts = F.transform(F.array(*[F.lit(m) for m in salts]), lambda m: F.struct(m.alias("m"), F.pmod(F.xxhash64("rep", m), m).alias("salt")))
        salted = buckets.select("rep", "key", F.explode(parts).alias("part"))
        least = salted.groupBy("key", "part").agg(F.min("rep").alias("lo"))
        met = salted.join(least, ["key", "part"]).where("rep <> lo").groupBy("rep").agg(F.min("lo").alias("x"), F.mode("lo", True).alias("y"))
        return met.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("rep").alias("b"))

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = small(cut(ids.select(F.col("rep").alias("doc_id")), "ids"))
        return cut(_sets(docs.join(ids, "doc_id", "left_semi"), size).groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "sets")

    # round 1: with the smallest of each bucket
    pairs = cut(sides(stars(buckets, (1,)), members, _possible(percent, F.least("na", "nb"))), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    links = cut(_confirmed(pairs, sets, percent).union(tied.distinct()), "links")
    labels = cut(components(nodes, links), "components")

    def mixed(labels: DataFrame) -> DataFrame:
        """The buckets that hold several components."""
        named = buckets.join(labels.select(F.col("node").alias("rep"), "component"), "rep")
        keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return named.join(keys, "key", "left_semi")

    # the documents of such buckets: what others have of each set bounds what it can be linked with
    left = cut(mixed(labels), "mixed")
    sets = sets_of(left.select("rep").distinct())
    members = members.join(_counted(sets), "rep").withColumn("t", _total("h"))
    members = cut(members.where(100 * F.col("t") >= percent * F.col("n")), "members")
    # round 2: those that can be linked, with the smallest of salted parts
    named = labels.select("node", "component")
    pairs = stars(left.join(members.select("rep"), "rep", "left_semi"), SALTS)
    for x in ("a", "b"):
        pairs = pairs.join(named.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x)
    pairs = cut(sides(pairs.where("ca <> cb"), members, _possible(percent)), "pairs")
    links = cut(links.union(_confirmed(pairs, sets, percent)), "links")
    labels = cut(components(nodes, links), "components")
    # round 3: all near and possible pairs of a bucket in different components
    left = mixed(labels).join(members, "rep")
    x = left.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("h").alias("ha"), F.col("t").alias("ta"), "place")
    y = left.select(F.col("key").alias("other"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("h").alias("hb"), F.col("t").alias("tb"))
    rest = x.join(y, (x.key == y.other) & (F.col("ca") < F.col("cb")) & _possible(percent, F.least("ta", "tb")) & _near("pa", "pb") & (F.col("place") == _first_bucket()) & _possible(percent)).select("a", "b")
    more = cut(_confirmed(cut(rest, "pairs"), sets, percent), "links")
    if more.limit(1).count():
        labels = cut(components(nodes, links.union(more)), "components")
    owner = cut(reps.join(labels, reps.rep == labels.node).select("k1", "k2", "component", "m"), "owners")
    named = with_group(known.select("doc_id", "n", "k1", "k2"), owner, ["k1", "k2"], known.count())
    alone = signed_rows.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    every = named.select("doc_id", "n", "component").unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its component, with all their columns; of rows that share that doc_id all stay."""
    gone = classes(documents, size, percent).where("not kept").select("doc_id").distinct()
    return documents.join(small(cut(gone, "gone")), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
