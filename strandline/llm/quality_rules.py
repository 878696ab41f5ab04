"""Quality rules with risk-controlled thresholds.

Every text gets rule scores (higher: worse) and, for each rule, a level: how many cutoffs of a fixed grid its score is
above. A stratum's verdict rejects a document if any rule's level is above the stratum's cutoff for that rule. What is
bounded is the verdict, not one rule: among the labelled good documents of the stratum (the calibration holdout), the exact
(Clopper-Pearson) upper bound of the share that the rules together reject must stay under ``max_false_rejection``, with
``confidence`` for all strata at once (Bonferroni). Half of a stratum's error goes to a fixed sequence, in which all rules
go from their laxest cutoff to stricter ones in step until a test fails (no further correction is needed, as the sequence
stops). The other half is split over every combination of cutoffs there is, so that from there any search is covered: rule
by rule, the strictest cutoff that passes beside those of the others. Where nothing passes the rules are off.

Defined results: a null text has no words and fails the base; a stratum is a lang value (null and the empty string are
strata of their own), and one without enough labelled good documents has its rules off, like every stratum without labels;
a score equal to a cutoff passes; labels of rows that repeat count with each row; repeated rows are judged one by one; very
long texts are counted whole, in vectors of their own length; other columns, whatever their names, are not read.

Scale: labelled good documents are counted and summed by (stratum, levels) before anything is grouped by stratum: at most
10 to the number of rules rows a stratum, a few hundred as a rule. Each stratum is calibrated in its own group, and the
cutoffs are a table of one row a stratum, joined to the rows; nothing goes to the driver but the number of strata.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import cut, fits, mapped, small
from strandline.llm.words import BLANK_SEPARATED, U, Words, chunks, fold, mix, window_hashes

#: Rules and their grids of cutoffs: a document is rejected if its score is above the cutoff.
RULES = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0],
    "duplicate_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9],
    "repeated_words": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "capitals": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "marks_per_word": [0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0],
}
MAX_FALSE_REJECTION, CONFIDENCE = 0.01, 0.95
STEPS = 9
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks"]
#: The symbols that the base counts, and sentence marks.
_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?;:~^_=+")] = True


def count(words: Words) -> np.ndarray:
    """One row of COUNTS for each text of a chunk."""
    off, data, n = words.offsets, words.data, len(words.counts)
    out = np.zeros((n, len(COUNTS)), np.int64)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[off[1:]] - total[off[:-1]]

    out[:, 0] = words.counts
    out[:, 1] = per_row(words.inside & ((data & 0xC0) != 0x80))
    out[:, 2] = per_row(_SYMBOL[data])
    out[:, 6] = per_row((data >= 65) & (data <= 90))
    out[:, 7] = out[:, 6] + per_row((data >= 97) & (data <= 122))
    out[:, 8] = per_row(_MARK[data])
    # lines: cut at \n and at the rows' ends
    cuts = np.union1d(off, np.flatnonzero(data == 10) + 1)
    line_first = np.searchsorted(words.start, cuts)
    if len(cuts) > 1 and len(words.start):
        ends = cuts[1:] - ((cuts[1:] > 0) & (data[np.maximum(cuts[1:] - 1, 0)] == 10))
        row = np.searchsorted(off, cuts[:-1], side="right") - 1
        real = np.diff(line_first) > 0
        h = _line_hashes(data, cuts[:-1], ends)
        order = np.lexsort((h[real], row[real]))
        r, x = row[real][order], h[real][order]
        again = np.zeros(len(r), bool)
        again[1:] = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
        out[:, 3] = np.bincount(r[again], minlength=n)
        out[:, 5] = np.bincount(row[real], minlength=n)
    if len(words.start) >= 3:
        g = window_hashes(words.hashes(), 3)
        same = words.doc[:-2] == words.doc[2:]
        at = np.flatnonzero(same)
        key = mix(g[at] + words.doc[at].astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        s = key[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:].copy()
        hit = np.zeros(len(words.start), bool)
        found = at[order[twice]]
        hit[found] = hit[found + 1] = hit[found + 2] = True
        out[:, 4] = np.bincount(words.doc[hit], minlength=n)
    return out


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inside = data != 10
    kept = np.concatenate([[0], np.cumsum(inside)])
    return fold(data[inside].astype(U), np.append(kept[starts], kept[ends[-1]]), 11)


def counted(documents: DataFrame, extra: list[str], text: bool = False) -> DataFrame:
    """The extra columns, the text if it is asked for, and COUNTS for each row of documents."""
    df = documents.select("text", *extra)
    first = 0 if text else 1
    fields = T.StructType([*df.schema.fields[first:], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = fields.names

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count(Words(data, off, BLANK_SEPARATED)) for _, _, data, off in chunks(batch.column(0))]
            rows = np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], names=names)

    return mapped(df, step, fields)


def scores() -> dict[str, F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / words,
    }


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def levels() -> list[F.Column]:
    """For each rule, how many cutoffs its score is above."""
    return [sum(((s > c).cast("int") for c in RULES[r]), F.lit(0)).alias(f"level_{r}") for r, s in scores().items()]


def upper_bound(rejected: int, n: int, level: float) -> float:
    """The exact binomial upper confidence bound of a rate, by bisection on the binomial tail."""
    if n == 0 or rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(rejected + 1)]
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else float(p == 0)
        lo, hi = (p, hi) if tail > level else (lo, p)
    return hi


def allowed(n: int, level: float, rate: float) -> int:
    """The largest number of rejections among n whose upper bound is at most the rate; -1 if there is none."""
    lo, hi = -1, n
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if upper_bound(middle, n, level) <= rate:
            lo = middle
        else:
            hi = middle - 1
    return lo


def chosen(seen: np.ndarray, n: np.ndarray, level: float, rate: float) -> np.ndarray:
    """The cutoffs (places in the grids; STEPS: off) of a stratum whose good documents have the levels seen, n of each."""
    rules, total = seen.shape[1], int(n.sum())
    rejected = lambda cutoffs: int(n[(seen > cutoffs).any(axis=1)].sum())
    out = np.full(rules, STEPS)
    limit = allowed(total, level / 2, rate)
    while out[0] and rejected(out - 1) <= limit:
        out = out - 1
    limit = allowed(total, level / 2 / (STEPS + 1) ** rules, rate)
    if limit >= 0:
        for rule in range(rules):
            for step in range(out[rule]):
                trial = out.copy()
                trial[rule] = step
                if rejected(trial) <= limit:
                    out = trial
                    break
    return out


def calibrate(documents: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum and cutoffs (array of places in the rules' grids, STEPS for a rule that is off) for each stratum with labelled good documents."""
    good = cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct(), "good")
    wanted, rows = documents.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum")), None
    if fits(good):
        rows = counted(wanted.join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left_semi"), ["stratum"])
    else:
        # too many labels to send: count all texts where they are and shuffle the counts, not the texts
        rows = counted(wanted, ["doc_id", "stratum"]).join(good, F.col("doc_id") == F.col("__good"), "left_semi").drop("doc_id")
    names = [f"level_{r}" for r in RULES]
    seen = cut(rows.where(~base_failed()).select("stratum", *levels()).groupBy("stratum", *names).agg(F.count(F.lit(1)).alias("n")), "levels")
    error = (1 - confidence) / max(1, seen.select("stratum").distinct().count())

    def step(key: tuple, table: pa.Table) -> pa.Table:
        found = chosen(np.stack([np.asarray(table.column(c)) for c in names], 1), np.asarray(table.column("n")), error, max_false_rejection)
        return pa.table({"stratum": pa.array([key[0].as_py()], pa.string()), "cutoffs": pa.array([found.tolist()], pa.list_(pa.int32()))})

    return cut(seen.groupBy("stratum").applyInArrow(step, "stratum string, cutoffs array<int>"), "cutoffs")


def judged(documents: DataFrame, labels: DataFrame, extra: list[str], stratum: str = "lang", text: bool = False) -> DataFrame:
    """The extra columns, the text if it is asked for, COUNTS, base_failed and kept for each row of documents."""
    cutoffs = small(calibrate(documents, labels, stratum).select(F.col("stratum").alias("__of"), F.col("cutoffs").alias("__cutoffs")))
    rows = counted(documents.withColumn("__stratum", F.col(stratum).cast("string")), [*extra, "__stratum"], text)
    rows = rows.join(cutoffs, F.col("__stratum").eqNullSafe(F.col("__of")), "left")
    rejected = F.exists(F.zip_with(F.array(*levels()), "__cutoffs", lambda a, b: a > b), lambda x: x)
    return rows.select(*extra, *(["text"] if text else []), *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(rejected, F.lit(False))).alias("kept"))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(documents, labels, ["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    names = documents.columns
    # the text goes through Python once, beside the other columns
    others = [F.col(f"`{c}`").alias(c) for c in names if c != "text"] or [F.lit(0).alias("none")]
    packed = documents.select(F.struct(*others).alias("__row"), "text", "lang", "doc_id")
    kept = judged(packed, labels, ["__row"], text=True).where("kept")
    return kept.select(*[(F.col("text") if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in names])
