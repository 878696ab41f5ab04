"""Substring deduplication by seed and extend.

A window is ``WINDOW`` consecutive words. Anchors of ``ANCHOR`` words are winnowed so that each window holds one and picks
it by its words alone; so two equal windows pick equal anchors, and only anchors that several documents share can lead to
a repeat. Around each such anchor the match is extended both ways, over the windows that picked it: first as a whole (a
digest of all their hashes), and where that is not shared with an earlier document, window by window. What is removed are
the words of maximal repeats: the union of the windows that also start in a document with a smaller id.

Exact copies are settled first: of equal word sequences all but the smallest id are repeats throughout (or, below the
window's length, not at all), so only one copy of each takes part in the joins.

Defined results: a null or wordless text has n_words 0 and keeps the empty string; documents of fewer words than a window
lose nothing; rows that share a doc_id are judged each by its own text against smaller ids only; a null doc_id neither loses nor gives
words; of equal windows the smallest doc_id keeps its own, and windows equal inside one document stay; a very long text is cut
into anchors whole, in memory of its own size; an empty table gives no rows; other columns, whatever their names, are not read.

Scale: shuffled are winnowed anchors (one word in about ``(WINDOW - ANCHOR + 2) / 2``), and for shared anchors only their
digests, window hashes that a digest did not settle, and the texts of affected documents. Groups are aggregated by minimum
before they are joined, so an anchor that a third of all rows holds is one row on one side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import cut, mapped, small, with_group
from strandline.llm.words import BLANK_SEPARATED, U, Words, chunks, fold, mix, signed, window_hashes

WINDOW, ANCHOR = 50, 10


def picked_anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor that each window of a word sequence picks (the last of the smallest), and the anchors' hashes."""
    g = window_hashes(h, anchor)
    span = window - anchor + 1
    if len(g) < span:
        return np.empty(0, np.int64), g
    # running minima in blocks (van Herk): of (hash, nearer the end)
    n = len(g)
    pad = -n % span
    key = np.concatenate([g, np.full(pad, U(2**64 - 1))]).reshape(-1, span)
    head = np.minimum.accumulate(key, axis=1).ravel()
    tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: n - span + 1], head[span - 1 : n])
    # the last place with that hash inside the window
    order = np.argsort(g, kind="stable")
    ranked = g[order]
    rank_of = np.empty(n, np.int64)
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(first) - 1
    rank_of[order] = group
    values = ranked[first]
    wanted = np.searchsorted(values, least)
    # among equal hashes (places ascend in a group) the last at or before the window's end
    big = np.int64(n + 1)
    at = np.searchsorted(group * big + order, wanted * big + np.arange(len(least)) + span - 1, side="right") - 1
    return order[at], g


def _anchors(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per row: doc_id, rk (digest of the text), n_words, k1, k2 (digest of the words), whole_sha256 (all words kept), anchors (distinct hashes)."""
    kind = dict(documents.dtypes)["doc_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, shas, anchors, sizes = [], [], [], [], []
            for lo, hi, data, off in chunks(batch.column(1)):
                words = Words(data, off, BLANK_SEPARATED)
                h = words.hashes()
                counts.append(words.counts)
                keys.append(np.stack([fold(h, words.first, 3), fold(h, words.first, 4)], 1))
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    shas.append(_sha(words, a, b))
                    at, g = picked_anchors(h[a:b], window, anchor)
                    own = np.unique(g[at]) if len(at) else np.empty(0, U)
                    anchors.append(own)
                    sizes.append(len(own))
            keys = np.concatenate(keys) if keys else np.empty((0, 2), U)
            flat = signed(np.concatenate(anchors)) if anchors else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(signed(keys[:, 0])), pa.array(signed(keys[:, 1])), pa.array(shas, pa.string()), lists], names=["doc_id", "rk", "n_words", "k1", "k2", "whole_sha256", "anchors"])

    return mapped(documents, step, f"doc_id {kind}, rk bigint, n_words bigint, k1 bigint, k2 bigint, whole_sha256 string, anchors array<bigint>")


def _sha(words: Words, a: int, b: int, gone: np.ndarray | None = None) -> str:
    """The digest of the kept words of a row, joined by one space."""
    if a == b:
        return hashlib.sha256(b"").hexdigest()
    base = int(words.start[a])
    whole = words.data[base : words.end[b - 1]].tobytes()
    start, end = (words.start[a:b] - base).tolist(), (words.end[a:b] - base).tolist()
    kept = range(b - a) if gone is None else np.flatnonzero(~gone).tolist()
    return hashlib.sha256(b" ".join([whole[start[i] : end[i]] for i in kept])).hexdigest()


def _windows(documents: DataFrame, shared: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per distinct stretch of windows that picked the same shared anchor: doc_id, rk, firsts (where it starts in the document), digest, hashes (of its windows)."""
    kind = dict(documents.dtypes)["doc_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, digests, lists = [], [], [], []
            risky = batch.column(2)
            row = 0
            for lo, hi, data, off in chunks(batch.column(1)):
                words = Words(data, off, BLANK_SEPARATED)
                h = words.hashes()
                for i in range(hi - lo):
                    own = h[words.first[i] : words.first[i + 1]]
                    at, g = picked_anchors(own, window, anchor)
                    if len(at):
                        known = np.sort(np.asarray(risky[row].as_py(), np.int64).view(U))
                        place = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
                        hit = known[place] == g[at]
                        change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
                        whole = window_hashes(own, window)
                        known_at: dict[int, list[int]] = {}
                        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(at)], strict=True):
                            if hit[a]:
                                part = whole[a:b]
                                digest = fold(part, np.array([0, b - a]), 9)[0]
                                if int(digest) in known_at:
                                    known_at[int(digest)].append(a)
                                    continue
                                known_at[int(digest)] = [a]
                                rows.append(row)
                                firsts.append(known_at[int(digest)])
                                digests.append(digest)
                                lists.append(part)
                    row += 1
            sizes = [len(x) for x in lists]
            flat = signed(np.concatenate(lists)) if lists else np.empty(0, np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(3).take(pa.array(rows, pa.int64())), pa.array(firsts, pa.list_(pa.int64())), pa.array(signed(np.array(digests, U))), hashes], names=["doc_id", "rk", "firsts", "digest", "hashes"])

    joined = documents.join(shared, ["doc_id", "rk"]).select("doc_id", "text", "anchors", "rk")
    return mapped(joined, step, f"doc_id {kind}, rk bigint, firsts array<bigint>, digest bigint, hashes array<bigint>")


def deduplicated(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of documents."""
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rk"))
    kind, row = dict(docs.dtypes)["doc_id"], ["doc_id", "rk"]
    seen = cut(_anchors(docs, window, anchor), "anchors")
    # texts below the window's length, the wordless ones among them, are nobody's copies: they take no part in the join
    able = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    classes = cut(able.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")), "classes")
    known = with_group(able.select(*row, "n_words", "k1", "k2", "whole_sha256"), classes, ["k1", "k2"], able.count())
    known = known.select(*row, "n_words", "whole_sha256", (F.col("doc_id") > F.col("least")).alias("copy"))
    rest = seen.where(F.col("doc_id").isNull() | (F.col("n_words") < window)).select(*row, "n_words", "whole_sha256", F.lit(False).alias("copy"))
    known = cut(known.unionByName(rest), "copies")
    copies = small(cut(known.where("copy").select(*row).distinct(), "copy_ids"))
    spread = seen.where("doc_id is not null and size(anchors) > 0").select(*row, "anchors").join(copies, row, "left_anti").select(*row, F.explode("anchors").alias("a"))
    both = spread.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    risky = cut(spread.join(both, "a", "left_semi").groupBy(*row).agg(F.collect_set("a").alias("anchors")), "risky")
    affected = docs.join(small(risky.select(*row)), row, "left_semi")
    stretches = cut(_windows(affected, risky, window, anchor), "stretches")
    # whole stretches that an earlier document has too
    sized = stretches.withColumn("n", F.size("hashes"))
    least = cut(sized.groupBy("digest", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")), "least")
    told = with_group(sized, least, ["digest", "n"], stretches.count())
    settled = F.col("doc_id") > F.col("least")
    told = cut(told.select(*row, "firsts", "n", settled.alias("settled"), F.when(~settled, F.col("hashes")).alias("hashes")), "told")
    single = told.where("not settled").select(*row, "firsts", F.posexplode("hashes").alias("i", "w"))
    early = cut(single.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("m")).where("least < most").select("w", "least", "m"), "early")
    windows = told.where("not settled").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    met = with_group(single, early, ["w"], windows).where("doc_id > least")
    found = met.select(*row, F.explode("firsts").alias("first"), "i").select(*row, (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("n"))
    ranges = told.where("settled").select(*row, F.explode("firsts").alias("first"), "n").unionByName(found)
    gone = cut(ranges.groupBy(*row).agg(F.collect_set(F.struct("first", "n")).alias("ranges")), "ranges")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, shas = [], [], []
            row = 0
            for lo, hi, data, off in chunks(batch.column(1)):
                words = Words(data, off, BLANK_SEPARATED)
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    edge = np.zeros(b - a + 1, np.int64)
                    ranges = batch.column(2)[row].values
                    first, n = (np.asarray(ranges.field(k)) for k in ("first", "n"))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    counts.append(b - a)
                    removed.append(int(out.sum()))
                    shas.append(_sha(words, a, b, out))
                    row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    changed = mapped(affected.join(gone, row).select("doc_id", "text", "ranges"), step, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        known.where("not copy").join(small(gone.select(*row)), row, "left_anti").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
        .unionByName(known.where("copy").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(empty).alias("kept_sha256")))
        .unionByName(changed)
    )
