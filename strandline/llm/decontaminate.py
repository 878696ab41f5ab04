"""Benchmark decontamination with a generalised suffix automaton over the words of normalised items.

Training words are streamed through the automaton; the longest match that ends at each word tells whether a window
(``window`` consecutive item words, or a whole item of fewer) ends there, and the suffix-link ancestor that spans that
window tells which items hold it.

Defined results: a null or wordless text has no words, no hits and no items; items of null or wordless text match nothing;
an item with a null item_id is hit like the others, but is left out of the items (n_items, items_sha256); repeated rows are
judged one by one; an item_id that several rows share counts once, and a window that several items hold counts for each;
an empty benchmark hits nothing; very long texts are streamed whole, in memory of their own size; other columns, whatever
their names, are not read.

Scale: a benchmark of up to ``block_words`` item words is one automaton, sent to all executors, and documents are scanned
once, without a shuffle. It stands in flat arrays, measured at 46 bytes a word on an executor and 417 a
word while the driver builds it (a million words with a Zipf law). A larger
benchmark is cut into blocks of that size: one is built, sent and scanned at a time and then destroyed, so neither the
driver nor a task ever holds two; each pass writes the hits alone, which are put together by a digest of the text.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import cut, mapped, small
from strandline.llm.words import ALPHANUMERIC, U, Words, chunks, mix

WINDOW = 10
BLOCK_WORDS = 1_000_000
SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Automaton:
    """A generalised suffix automaton of word-id sequences, with the items below each window-length state, in flat arrays.

    Nearly all states have one transition, which stands in two arrays; further ones are kept apart, sorted by (state, word),
    and those of the start state, one a word, in an array by word."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [-1])
        more: dict[int, dict[int, int]] = {0: {}}
        ids: dict[int, int] = {}
        ends, of = array("i"), array("i")
        pairs = [np.empty(0, U)]
        self.shortest, self.item_ids, self.whole = window, [], {}
        texts = pa.array([x[1] for x in items], pa.string())
        row = 0
        for lo, hi, data, off in chunks(texts):
            words = Words(data, off, ALPHANUMERIC, lower=True)
            h = words.hashes()
            for i in range(hi - lo):
                own = h[words.first[i] : words.first[i + 1]]
                if len(own):
                    item = len(self.item_ids)
                    self.item_ids.append(items[row][0])
                    self.shortest = min(self.shortest, len(own))
                    pairs.append(np.unique(mix(mix(own[:-1]) + own[1:])))
                    last = 0
                    for w in own.tolist():
                        last = self._extend(last, ids.setdefault(w, len(ids)), more)
                        ends.append(last)
                        of.append(item)
                    if len(own) < window:
                        self.whole.setdefault(last, []).append((len(own), item))
                row += 1
        keys = np.array(list(ids), U)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.bigrams = np.unique(np.concatenate(pairs))
        self.start = array("i", bytes(4 * len(ids)))
        for w, q in more.pop(0).items():
            self.start[w] = q
        flat = sorted((s * len(ids) + w, q) for s, own in more.items() for w, q in own.items())
        self.more, self.more_to = array("q", (k for k, _ in flat)), array("i", (q for _, q in flat))
        self._spread(np.array(ends, np.int32), np.array(of, np.int32))

    def _extend(self, last: int, w: int, more: dict[int, dict[int, int]]) -> int:
        word, to, link, length = self.word, self.to, self.link, self.length

        def after(p: int) -> int:
            return to[p] if word[p] == w else more[p].get(w, -1) if p in more else -1

        def lead(p: int, q: int) -> None:
            if p and word[p] in (-1, w):
                word[p], to[p] = w, q
            else:
                more.setdefault(p, {})[w] = q

        def split(p: int, q: int) -> int:
            """The state of the longest of q's words that end with p's and w, as a state of its own."""
            if length[q] == length[p] + 1:
                return q
            clone = len(link)
            word.append(word[q])
            to.append(to[q])
            if q in more:
                more[clone] = dict(more[q])
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p != -1 and after(p) == q:
                lead(p, clone)
                p = link[p]
            return clone

        q = after(last)
        if q != -1:
            return split(last, q)
        cur = len(link)
        word.append(-1)
        to.append(-1)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1:
            q = after(p)
            if q != -1:
                # looked up before the new state is led to: split may move q's transitions
                link[cur] = split(p, q)
                break
            lead(p, cur)
            p = link[p]
        return cur

    def _spread(self, ends: np.ndarray, of: np.ndarray) -> None:
        """Each item goes to the state on the suffix path of its ends that spans the window length (one state per end)."""
        link, length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        at = np.arange(len(link), dtype=np.int32)
        up = np.where((at > 0) & (length[link] >= self.window), link, at)
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        up[length < self.window] = -1
        self.spanning = array("i", up.astype(np.int32).tobytes())
        state = up[ends]
        held = np.unique(state[state >= 0].astype(np.int64) << 32 | of[state >= 0])
        self.held = array("i", (held & 0xFFFFFFFF).astype(np.int32).tobytes())
        self.held_from = array("i", np.searchsorted(held >> 32, np.arange(len(link) + 1)).astype(np.int32).tobytes())

    def _next(self, state: int, w: int) -> int:
        """The state after one more word, 0 if there is none."""
        if self.word[state] == w:
            return self.to[state]
        if not state:
            return self.start[w]
        key = state * len(self.keys) + w
        i = bisect_left(self.more, key)
        return self.more_to[i] if i < len(self.more) and self.more[i] == key else 0

    def match(self, ids: list[int], at: int, hits: list[tuple[int, int]], found: set[int]) -> None:
        """Streams a run of known words that starts at word ``at``; adds the spans of windows and the items that hold them."""
        link, length, window, step = self.link, self.length, self.window, self._next
        state = size = 0
        for i, w in enumerate(ids, at + 1):
            after = step(state, w)
            while state and not after:
                state = link[state]
                size = length[state]
                after = step(state, w)
            if after:
                state = after
                size += 1
            if size >= window:
                hits.append((i - window, i))
                s = self.spanning[state]
                found.update(self.held[self.held_from[s] : self.held_from[s + 1]])
            if self.whole:
                s = state
                while s > 0:
                    for n, item in self.whole.get(s, ()):
                        if n <= size:
                            hits.append((i - n, i))
                            found.add(item)
                    s = link[s]

    def scan(self, words: Words) -> list[tuple[list[tuple[int, int]], set[int]] | None]:
        """Per row of the chunk: merged spans (word ordinals) and items; None where nothing is hit. Runs of words that no item window can hold are skipped."""
        out: list = [None] * len(words.counts)
        n = len(words.start)
        if not n or not len(self.keys):
            return out
        h = words.hashes()
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[place] == h
        joined = np.zeros(n, bool)
        if len(self.bigrams) and n > 1:
            both = known[:-1] & known[1:] & (words.doc[:-1] == words.doc[1:])
            i = np.flatnonzero(both)
            pair = mix(mix(h[i]) + h[i + 1])
            at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
            joined[i + 1] = self.bigrams[at] == pair
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            row = int(words.doc[a])
            hits, found = out[row] or ([], set())
            self.match(self.values[place[a:b]].tolist(), a - int(words.first[row]), hits, found)
            if hits:
                out[row] = (hits, found)
        return out


    def found(self, texts: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text its number of words, its merged spans and the items that hit it."""
        counts, spans, items = [], [], []
        for _, _, data, off in chunks(texts):
            words = Words(data, off, ALPHANUMERIC, lower=True)
            counts += words.counts.tolist()
            for hit in self.scan(words):
                spans.append(merged(hit[0]) if hit else [])
                items.append(sorted({self.item_ids[i] for i in hit[1]} - {None}) if hit else [])
        return counts, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator()
    for r in rows:
        n = len(r.t.split()) + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


def hit_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans (merged word ordinals, end exclusive), items (sorted) for each row of documents."""
    spark = documents.sparkSession
    df = documents.select("doc_id", "text")
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"spans {SPANS}, items array<string>").fields])
    blocks = blocks_of(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)

    def scanned(rows: DataFrame, block: list, schema: T.StructType) -> tuple:
        """The rows with what an automaton of the block finds in their last column."""
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        names = schema.names

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for batch in batches:
                counts, spans, items = auto.found(batch.column(batch.num_columns - 1))
                spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)
                kept = batch.columns if "text" in names else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], names=names)

        return mapped(rows, step, schema), shared

    if following is None:
        return scanned(df, block, schema)[0]
    # several blocks: one pass over the texts for each, whose automaton goes before the next one comes; what they hit, by text, is put together
    digest = [F.xxhash64("text", F.lit(i)).alias(f"k{i}") for i in (1, 2)]
    part = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *schema.fields[2:]])
    hits = []
    while block is not None:
        found, shared = scanned(documents.select(*digest, "text"), block, part)
        hits.append(cut(found.where("size(spans) > 0"), "hits"))
        shared.destroy()
        block, following = following, next(blocks, None)
    together = F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    hit = small(cut(reduce(DataFrame.unionByName, hits).distinct().groupBy("k1", "k2").agg(*together), "hits"))
    own = [F.xxhash64("text", F.lit(i)) == F.col(f"k{i}") for i in (1, 2)]
    joined = df.join(hit, own, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Words(data, off, ALPHANUMERIC, lower=True).counts for _, _, data, off in chunks(batch.column(1))]
            spans = [merged([(x["start"], x["end"]) for x in own]) for own in batch.column(2).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)
            counts = pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, spans, batch.column(3)], names=schema.names)

    return mapped(joined, settle, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    df = hit_spans(documents, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of documents; hit spans are cut out of the texts (with the white space before them), and rows of which more than ``max_coverage`` of the words is hit go. Clean texts stay byte for byte; n_chars, if there, is counted anew where text was cut."""
    names = documents.columns
    key = "__strandline_row"
    others = [F.col(f"`{c}`").alias(c) for c in names if c != "text"] or [F.lit(0).alias("none")]
    packed = documents.select(F.struct(*others).alias("doc_id"), F.col("text"))
    blocks = blocks_of(benchmark, block_words)
    block, more = next(blocks), next(blocks, None)
    row = packed.schema["doc_id"].dataType

    def cut_out(rows: pa.Array, text: pa.Array, counts: list[int], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        keep, new = [], []
        for i, own in enumerate(spans):
            keep.append(sum(b - a for a, b in own) <= max_coverage * counts[i])
            if own:
                data = np.frombuffer(text[i].as_py().encode(), np.uint8)
                words = Words(data, np.array([0, len(data)]), ALPHANUMERIC, lower=True)
                parts, at = [], 0
                for a, b in own:
                    parts.append(data[at : words.start[a]].tobytes().rstrip(b" "))
                    at = int(words.end[b - 1])
                new.append(b"".join([*parts, data[at:].tobytes()]).decode())
        changed = pa.array([bool(x) for x in spans], pa.bool_())
        if new:
            text = pc.replace_with_mask(text, changed, pa.array(new, text.type))
        return pa.RecordBatch.from_arrays([rows, text, changed, pa.array(keep, pa.bool_())], names=[key, "text", "changed", "keep"])

    if more is None:
        # one automaton: found and cut in one pass, so that a task has one Python worker
        shared = documents.sparkSession.sparkContext.broadcast(Automaton(block, window))

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, _ = shared.value.found(batch.column(1))
                yield cut_out(batch.column(0), batch.column(1), counts, spans)

        out = mapped(packed, once, _schema(row, key))
    else:

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [[(x["start"], x["end"]) for x in own] for own in batch.column(3).to_pylist()]
                yield cut_out(batch.column(0), batch.column(1), batch.column(2).to_pylist(), spans)

        out = mapped(hit_spans(packed, benchmark, window, block_words), known, _schema(row, key))
    out = out.where("keep")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast(dict(documents.dtypes).get("n_chars", "long"))).otherwise(F.col(f"{key}.n_chars") if "n_chars" in names else F.lit(None))}
    return out.select(*[(new[c] if c in new else F.col(f"{key}.`{c}`")).alias(c) for c in names])


def _schema(row: T.DataType, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, row), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("keep", T.BooleanType())])
