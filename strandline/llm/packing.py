"""Sequence packing: non-negative least squares over shallow length combinations.

A document's ids (its tokens, then the separator id) are cut where they are made: whole windows of ``window`` ids, then
the rest, so every piece knows its checksum after one pass over the text. Pieces are dealt by a hash into groups of about
``GROUP_PIECES`` (their number follows rows and bytes); in each, combinations of up to four lengths that fill a window are enumerated, non-negative least squares
fits their repeat counts to the length histogram, the counts are rounded down to what is there, and the residual pieces are
packed greedily (best fit, longest first). Nothing but lengths and ids of pieces is shuffled.

Defined results: a null or empty text is the separator alone (one piece); repeated rows are packed one by one; pieces of
equal length are taken in the order of doc_id, start and checksum; a very long text becomes many pieces, which are dealt to
all groups; an empty table gives no pieces; doc_id must be a whole number, or a text that spells one; other columns, whatever their names, are not read. sequence_id: the group times 2^32 plus the
sequence's number there. Every sequence is padded to the window, so none has more than ``window`` ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import mapped
from strandline.llm.words import BLANK_SEPARATED, Words, chunks

WINDOW, SEPARATOR, GROUP_PIECES, CACHE_WORDS, CACHE_PIECES = 4096, 2, 16_384, 500_000, 100_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Texts can be cut at ASCII blanks, as the tokenizer's normaliser turns runs of white space into one space and drops it.
#: Words of printable ASCII and Latin-1 letters, which the normaliser only lower-cases; its pre-tokens for
#: those; the normaliser and pre-tokens for which that holds; and the byte alphabet of byte-level models (printable bytes stand for themselves, the others for 256 and up).
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = [chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches pool[start:start + size], one after another."""
    end = np.cumsum(size)
    return pool[np.repeat(start - end + size, size) + np.arange(int(size.sum()))]


class _Ids:
    """Ids by word hash, in sorted arrays: about 30 bytes a word."""

    def __init__(self) -> None:
        self.keys, self.start, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and the places of those that are."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, at[hit]

    def add(self, keys: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """New keys, sorted, and their ids one after another."""
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate([self.pool, pool])


class Encoder:
    """Ids of blank-separated words, each encoded once while it stays in a cache of two generations (``CACHE_WORDS`` each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        own = told["model"]["type"] == "BPE" and not any(own["content"].find("<|") for own in told["added_tokens"])
        #: Words can be encoded one by one only where the file cuts texts as the fixed values above say; other files get whole texts.
        self.by_word = own and told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and not told["truncation"]
        self.pieces: dict[str, bytes] = {}
        self.new, self.old = _Ids(), _Ids()

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token of a plain word, straight from the model."""
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(_BYTES.__getitem__, text.encode())))]
            got = self.pieces[text] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk of texts, one after another, and where each text's begin, with the end."""
        if not self.by_word:
            raw = data.tobytes()
            every = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = [np.array(e.ids, np.uint32) for e in every]
            return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        words = Words(data, off, BLANK_SEPARATED)
        keys, one, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.new.keys) + len(keys) > CACHE_WORDS:
            self.new, self.old = _Ids(), self.new
        new, old = self.new, self.old
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        hit, at = new.find(keys)
        start[hit], size[hit] = new.start[at], new.size[at]
        added = np.flatnonzero(~hit)
        hit, at = old.find(keys[added])
        start[added[hit]], size[added[hit]] = len(new.pool) + old.start[at], old.size[at]
        missing = added[~hit]
        found: list[bytes] = []
        whole = []
        for j, i in enumerate(one[missing].tolist()):
            text = words.text(i).decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                found.append(b"".join(map(self.piece, _PIECE.findall(text.lower()))))
            else:
                found.append(b"")
                whole.append((j, text))
        for first in range(0, len(whole), 1024):
            part = whole[first : first + 1024]
            for (j, _), e in zip(part, self.tokenizer.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                found[j] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start[missing], size[missing] = len(new.pool) + len(old.pool) + np.cumsum(each) - each, each
        pool = np.concatenate([new.pool, old.pool, np.frombuffer(b"".join(found), "<u4")])
        new.add(keys[added], size[added], _gather(pool, start[added], size[added]))
        begin = np.concatenate([[0], np.cumsum(size[place])])
        return _gather(pool, start[place], size[place]), begin[words.first]


def pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut at multiples of the window."""
    end = struct.pack("<I", separator)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for lo, hi, data, off in chunks(batch.column(1)):
                ids, first = encoder.encode(data, off)
                raw, first = memoryview(ids.tobytes()), first.tolist()
                for i in range(hi - lo):
                    n = first[i + 1] - first[i] + 1
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        part = zlib.crc32(raw[4 * (first[i] + start) : 4 * min(first[i] + start + size, first[i + 1])])
                        rows.append((start, size, zlib.crc32(end, part) if start + size == n else part, n))
                        owner.append(lo + i)
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(np.ascontiguousarray(x)) for x in table.T)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), step, PIECES)


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, depth: int = 4, most: int = 6000) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` of the lengths that there are which fill the window, or all but a hundredth of it."""
    slack = max(1, window // 100)
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    below = np.maximum.accumulate(np.where(there, np.arange(window + 1), 0))  # the largest length that is there, at or below
    out: dict[tuple[int, ...], None] = {}
    common = lengths[np.argsort(-counts, kind="stable")]
    stems: list[tuple[int, ...]] = [()]
    for level in range(depth):
        nxt: list[tuple[int, ...]] = []
        for stem in stems:
            room = window - sum(stem)
            last = int(below[room]) if room > 0 else 0
            if last and room - last <= slack:
                out.setdefault(tuple(sorted((*stem, last), reverse=True)))
            if level < depth - 1:
                take = common if level == 0 else common[:24] if level == 1 else common[:4]
                nxt += [(*stem, int(a)) for a in take.tolist() if a < room]
        stems = nxt[: 4 * most]
        if len(out) >= most * (level + 1):
            break
    return list(out)


def nonnegative_least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, steps: int = 80) -> np.ndarray:
    """x >= 0 that brings the pieces used by the combinations near the histogram (accelerated projected gradient, sparse)."""
    width = max(map(len, combos))
    index = np.array([(*c, *[0] * (width - len(c))) for c in combos])  # length 0 is a dummy
    used = index > 0
    size = len(counts)
    rows = np.bincount(index[used], minlength=size)
    rate = 1.0 / max(1.0, float(rows.max()) * width)
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        made = np.bincount(index[used], weights=np.repeat(y, width).reshape(index.shape)[used], minlength=size)
        gap = made - counts
        gap[0] = 0
        grad = np.where(used, gap[index], 0).sum(1)
        new = np.maximum(0, y - rate * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    hist = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(hist)])
    given = np.zeros(window + 1, np.int64)  # pieces of each length that have a place
    made = 0

    def place(combo: tuple[int, ...], repeats: int) -> None:
        nonlocal made
        at = 0
        for length in combo:
            own = order[first[length] + given[length] : first[length] + given[length] + repeats]
            given[length] += repeats
            sequence[own], offset[own] = made + np.arange(repeats), at
            at += length
        made += repeats

    if hist[window]:
        place((window,), int(hist[window]))
    rest = hist.copy()
    rest[window] = 0
    there = np.flatnonzero(rest)
    combos = combinations(there, rest[there], window) if len(there) else []
    if combos:
        x = nonnegative_least_squares(combos, rest.astype(float))
        for i in np.argsort(-x, kind="stable").tolist():
            need: dict[int, int] = {}
            for length in combos[i]:
                need[length] = need.get(length, 0) + 1
            free = min(int(rest[length]) // k for length, k in need.items())
            repeats = min(free, int(x[i] + 0.5))
            if repeats > 0:
                place(combos[i], repeats)
                for length, k in need.items():
                    rest[length] -= k * repeats
    # residual pieces: best fit, longest first; open[r] are sequences with r ids of room
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    mask = 0  # bit r: open_[r] has a sequence
    for length in range(window - 1, 0, -1):
        for i in order[first[length] + given[length] : first[length + 1]].tolist():
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                s = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            else:
                room, s = window, made
                made += 1
            sequence[i], offset[i] = s, window - room
            room -= length
            if room:
                open_[room].append(s)
                mask |= 1 << room
    return sequence, offset


def packed(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # no more pieces than this: a row has one, and one more for each window of its ids, of which it has no more than bytes; texts have about a third
    known = documents.select(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    groups = max(1, round((known["rows"] + known["bytes"] / (3 * window)) / GROUP_PIECES))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32")])
        sequence, offset = plan(np.asarray(table.column("length")), window)
        first = np.asarray(table.column("group"), np.int64) << 32
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset, pa.int64()))

    rows = pieces(documents, tokenizer or default_tokenizer(), window, separator).withColumn("group", key)
    return rows.groupBy("group").applyInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
