"""Language-model scoring: prediction by partial matching over bytes, with a word unigram base beside it.

Training counts the ``ORDER`` + 1 byte runs of all training texts (0xFF, which UTF-8 never has, stands before and after a
text). Their marginals are a trie: contexts of every order down to none, each with its symbols' counts. A symbol is coded
from the longest known context: if the context has seen it, c / (n + t); else an escape, t / (n + t) (t: distinct symbols),
and the next shorter context, without the symbols that the longer one has ruled out; at last all bytes not seen at all are
alike. The score is the log10 probability of the text and its end.

All runs that are counted are used. A run's probability depends on the contexts that end like its own, so the trie is split
by a hash of a context's last two bytes into parts of about ``PART_RUNS`` runs, and each part has all of orders 2 and up that
its runs can fall to; orders 1 and 0 (65,536 runs at most) go to all. Texts are gathered in chunks of about ``CHUNK_TEXT``
bytes; a chunk sends its distinct runs, gets their values by a join and adds them up, so no task holds the model.
Of the word counts, executors get the most frequent ``MAX_HEAD``; rarer words are looked up by a join.

Defined results: a null or empty text has n_tokens 1 (the end); without training texts N and V are 0 and every byte is as
likely; rows that repeat are scored one by one; a null doc_id is not learned from and not held out; a very long text is a chunk of
its own, scored whole; nothing is ranked but words for the head, where ties change the way of a lookup and no score; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.quality_model import remainder
from strandline.llm.shared import cut, mapped
from strandline.llm.words import BLANK_SEPARATED, U, Words, chunks, mix, signed

ORDER, PART_RUNS, CHUNK_TEXT, MAX_HEAD, FOLDS = 4, 500_000, 8_000_000, 500_000, 10
END = 0xFF
#: The hash that stands for the end token; no word has it but by chance.
END_HASH = U(0x0123456789ABCDEF)
_MERGE = 4_000_000


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts


def codes(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of a chunk (the bytes of each row, then its end): the run of its context and itself as one number; and its row."""
    n = len(off) - 1
    gap = order + 1
    size = np.diff(off) + gap
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]) + order, END, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * gap, np.diff(off)) + order] = data
    run = np.zeros(int(at[-1]), U)
    for j in range(order + 1):
        run = (run << U(8)) | out[j : j + len(run)].astype(U)
    row = np.repeat(np.arange(n), size)
    symbol = np.arange(len(run)) - np.repeat(at[:-1], size) <= np.repeat(np.diff(off), size)
    return run[symbol], row[symbol]


def _count(documents: DataFrame) -> DataFrame:
    """Counts of words and ends, from partial counts for each few million symbols of a task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        out = lambda k, c: pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c.astype(np.int64))], names=["key", "c"])
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(0)):
                h = np.append(Words(data, off, BLANK_SEPARATED, lower=True).hashes(), np.full(hi - lo, END_HASH))
                k, c = np.unique(h, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
            if held > _MERGE:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) > _MERGE // 2:
                    yield out(k, c)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            yield out(*_summed(np.concatenate(keys), np.concatenate(counts)))

    return mapped(documents.select("text"), step, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _runs(texts: DataFrame, order: int) -> DataFrame:
    """chunk, key, c: the distinct runs of each chunk of texts (chunk, learn, text) and how often the rows to learn from have them. A chunk that is read in parts gives a row for each."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, now = [], [], 0, None

        def out() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            k, c = _summed(k >> U(1), np.where(k & U(1), c, 0))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now, np.int64)), pa.array(signed(k)), pa.array(c.astype(np.int64))], names=["chunk", "key", "c"])

        for batch in batches:
            chunk, learn = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(U)
            at = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if keys and chunk[a] != now:
                    yield out()
                    keys, counts, held = [], [], 0
                now = chunk[a]
                for lo, hi, data, off in chunks(batch.column(2).slice(a, b - a)):
                    run, row = codes(data, off, order)
                    # the lowest bit tells rows to learn from
                    k, c = np.unique(run << U(1) | learn[a + lo : a + hi][row], return_counts=True)
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
                    if held > _MERGE:
                        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, held = [k], [c], len(k)
                        if held > _MERGE // 2:
                            yield out()
                            keys, counts, held = [], [], 0
        if keys:
            yield out()

    return mapped(texts.select("chunk", "learn", "text"), step, "chunk bigint, key bigint, c bigint")


def _head(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (sorted) and counts of the rows seen at least so often that no more than ``most`` stay. From a histogram over powers of 2^(1/8), so the driver sees a few hundred rows first."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    rows = {r["b"]: r["n"] for r in table.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, cutoff = 0, None
    for b in sorted(rows, reverse=True):
        if total + rows[b] > most:
            break
        total, cutoff = total + rows[b], b
    if cutoff is None:
        return np.empty(0, U), np.empty(0, np.int64)
    got = table.where(step >= cutoff).toArrow()
    k, c = np.asarray(got.column("key")).view(U), np.asarray(got.column("c"))
    order = np.argsort(k)
    return k[order], c[order]


class Trie:
    """Contexts of each order with counts n, distinct symbols t and what the next longer context rules out."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]]):
        """runs[k]: the runs of k context bytes and a symbol, sorted, and their counts."""
        self.order = len(runs) - 1
        self.runs, self.counts = [r[0] for r in runs], [r[1].astype(float) for r in runs]
        self.nodes, self.n, self.t, self.ruled = [], [], [], []
        for k, (keys, counts) in enumerate(runs):
            context = keys >> U(8)
            nodes, first = np.unique(context, return_index=True)
            self.nodes.append(nodes)
            self.n.append(np.add.reduceat(counts.astype(float), first) if len(keys) else np.empty(0))
            self.t.append(np.diff(np.append(first, len(keys))).astype(float))
            if k and len(keys):
                shorter = keys & U((1 << 8 * k) - 1)
                at, hit = _find(self.runs[k - 1], shorter)
                self.ruled.append(np.add.reduceat(np.where(hit, self.counts[k - 1][at], 0), first))
            else:
                self.ruled.append(np.empty(0))

    def score(self, run: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol given its context."""
        n = len(run)
        out, live = np.zeros(n), np.arange(n)
        above_t, above_ruled = np.zeros(n), np.zeros(n)  # of the known context one symbol longer
        for k in range(self.order, -1, -1):
            if not len(live):
                return out
            key = run[live] & U((1 << 8 * (k + 1)) - 1)
            node, known = _find(self.nodes[k], key >> U(8))
            at, hit = _find(self.runs[k], key)
            if len(self.nodes[k]):
                gone_t, gone_n = above_t[live], above_ruled[live]
                fresh = self.t[k][node] - gone_t
                total = np.maximum(self.n[k][node] - gone_n, 0) + fresh
                hit &= known
                with np.errstate(divide="ignore", invalid="ignore"):
                    step = np.where(hit, np.log10(self.counts[k][at] / total), np.where(fresh > 0, np.log10(fresh / total), 0.0))
                out[live] += np.where(known, step, 0.0)
                above_t[live] = np.where(known, self.t[k][node], 0.0)
                above_ruled[live] = np.where(known, self.ruled[k][node], 0.0) if k else 0.0
                live = live[~hit]
        if len(live):
            out[live] -= np.log10(np.maximum(256 - (self.t[0][0] if len(self.nodes[0]) else 0), 1))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Values:
    """A value for each of some runs."""

    def __init__(self, runs: np.ndarray, values: np.ndarray):
        self.runs, first = np.unique(runs, return_index=True)
        self.values = values[first]
        # an open table for the common case; what finds its place taken is left to the sorted runs
        self.bits = max(10, int(2 * max(1, len(self.runs)) - 1).bit_length())
        self.slot_run, self.slot_value = np.full(1 << self.bits, U(2**64 - 1)), np.zeros(1 << self.bits)
        place = mix(self.runs) >> U(64 - self.bits)
        self.slot_run[place], self.slot_value[place] = self.runs, self.values

    def of(self, run: np.ndarray) -> np.ndarray:
        place = mix(run) >> U(64 - self.bits)
        out = self.slot_value[place]
        left = np.flatnonzero(self.slot_run[place] != run)
        if len(left):
            at, hit = _find(self.runs, run[left])
            if not hit.all():
                raise ValueError("a run without a value")
            out[left] = self.values[at]
        return out


def _shorter(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k context bytes that longer runs end with."""
    return _summed(keys & U((1 << 8 * (k + 1)) - 1), counts)


def fit(documents: DataFrame, order: int = ORDER) -> Trie:
    """The whole trie of all texts of documents, on the driver: for small tables."""
    got = _runs(documents.select(F.lit(0).cast("bigint").alias("chunk"), F.lit(True).alias("learn"), "text"), order).toArrow()
    keys, counts = _summed(np.asarray(got.column("key")).view(U), np.asarray(got.column("c")))
    return Trie([_shorter(keys, counts, k) for k in range(order + 1)])


def run_values(totals: DataFrame, order: int = ORDER, part_runs: int = PART_RUNS) -> DataFrame:
    """key, value: the log10 probability of each run of totals (key, c) under the trie of all its counts; c is 0 where only held-out texts have the run."""
    low = totals.where("c > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("c").alias("c")).toArrow()
    pairs = _summed(np.asarray(low.column("key")).view(U), np.asarray(low.column("c")))
    singles = _shorter(*pairs, 0)
    parts = max(1, -(-totals.count() // part_runs))
    part = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(parts))

    def step(table: pa.Table) -> pa.Table:
        keys, counts = _summed(np.asarray(table.column("key")).view(U), np.asarray(table.column("c")))
        k, c = keys[counts > 0], counts[counts > 0]
        trie = Trie([singles, pairs, *[_shorter(k, c, j) for j in range(2, order + 1)]])
        return pa.table({"key": signed(keys), "value": trie.score(keys)})

    return totals.select(part.alias("part"), "key", "c").groupBy("part").applyInArrow(step, "key bigint, value double")


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents."""
    spark = documents.sparkSession
    learn = F.coalesce(remainder(F.col("doc_id"), FOLDS) != 0, F.lit(False))
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), learn.alias("learn"))
    vocabulary = cut(_count(docs.where("learn")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, total = sums["n"], sums["n"] + 0.1 * (sums["v"] + 1)
    head, head_counts = _head(vocabulary, MAX_HEAD)
    shared = spark.sparkContext.broadcast((head, np.log10((head_counts + 0.1) / total)))
    kind = dict(docs.dtypes)["doc_id"]
    rest_is_unseen = len(head) == sums["v"]
    unseen = float(np.log10(0.1 / total))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, value = shared.value
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            n, known, base, rest, sizes, own = [], [], [], [], [], []
            for lo, hi, data, off in chunks(batch.column(1)):
                rows = hi - lo
                if held and held + len(data) > CHUNK_TEXT:
                    chunk, held = chunk + 1, 0
                held += len(data)
                own.append(np.full(rows, chunk))
                words = Words(data, off, BLANK_SEPARATED, lower=True)
                h, doc = np.append(words.hashes(), np.full(rows, END_HASH)), np.append(words.doc, np.arange(rows))
                one, place = np.unique(h, return_inverse=True)
                at, hit = _find(head, one)
                each = np.where(hit, value[at], 0.0) if len(head) else np.zeros(len(one))
                n.append(words.counts + 1)
                known.append(np.bincount(doc[hit[place]], minlength=rows))
                base.append(np.bincount(doc, weights=each[place], minlength=rows))
                tail = ~hit[place]
                order = np.argsort(doc[tail], kind="stable")
                rest.append(h[tail][order])
                sizes.append(np.bincount(doc[tail], minlength=rows))
            together = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(together(sizes, np.int64))]), pa.int32()), pa.array(signed(together(rest, U))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(together(own, np.int64)), pa.array(together(n, np.int64)), pa.array(together(known, np.int64)), pa.array(together(base, float)), lists], names=["doc_id", "text", "tk", "learn", "chunk", "n_tokens", "known", "base", "rest"])

    texts = cut(mapped(docs, step, f"doc_id {kind}, text string, tk bigint, learn boolean, chunk bigint, n_tokens bigint, known bigint, base double, rest array<bigint>"), "texts")
    runs = cut(_runs(texts, ORDER), "runs")
    values = run_values(cut(runs.groupBy("key").agg(F.sum("c").alias("c")), "totals"))
    answers = runs.select("chunk", "key").join(values, "key").select("chunk", "key", "value")

    def add_up(table: pa.Table, answer: pa.Table) -> pa.Table:
        found = Values(np.asarray(answer.column("key")).view(U), np.asarray(answer.column("value")))
        score = [np.empty(0)]
        for lo, hi, data, off in chunks(table.column("text")):
            run, row = codes(data, off, ORDER)
            score.append(np.bincount(row, weights=found.of(run), minlength=hi - lo))
        return table.select(["doc_id", "tk", "n_tokens", "known", "base"]).append_column("score", pa.array(np.concatenate(score))).append_column("rest", table.column("rest"))

    done = texts.drop("learn").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, f"doc_id {kind}, tk bigint, n_tokens bigint, known bigint, base double, score double, rest array<bigint>")
    done = cut(done, "scored")
    # words outside the head: counted by a join, then summed with the rows they came from (rows that repeat come together)
    if rest_is_unseen:
        every = done.select("*", F.lit(0).cast("bigint").alias("more"), (F.size("rest") * F.lit(unseen)).alias("more_base"))
    else:
        looked = done.select("doc_id", "tk", F.explode("rest").alias("key")).join(vocabulary, "key", "left")
        lines = looked.select("doc_id", "tk", F.lit(0).alias("rows"), F.lit(None).cast("bigint").alias("n_tokens"), F.col("c").isNotNull().cast("bigint").alias("known"), F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(total)).alias("base"), F.lit(None).cast("double").alias("score"))
        own = done.select("doc_id", "tk", F.lit(1).alias("rows"), "n_tokens", "known", "base", "score")
        summed = own.unionByName(lines).groupBy("doc_id", "tk").agg(F.sum("rows").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.max("score").alias("score"))
        each = summed.select("doc_id", "n_tokens", (F.col("known") / F.col("rows")).cast("bigint").alias("known"), (F.col("base") / F.col("rows")).alias("base"), "score", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"))
        every = each.select("*", F.lit(0).cast("bigint").alias("more"), F.lit(0.0).alias("more_base"))
    return every.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        "score",
    )
