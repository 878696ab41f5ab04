"""The suffix automaton against plain search, where words repeat so much that states split often."""

import random

import numpy as np

from strandline.llm.decontaminate import Automaton, hit_spans, merged
from strandline.llm.words import ALPHANUMERIC, Words


def plain(items, words, window):
    spans, found = [], set()
    for name, text in items:
        own = (text or "").split()
        n = min(window, len(own))
        for w in [own[i : i + n] for i in range(len(own) - n + 1)] if n else []:
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w:
                    spans.append((at, at + n))
                    found.add(name)
    return merged(spans), found - {None}


def test_random_words():
    rng = random.Random(6)
    for trial in range(400):
        letters, window = "ab" if trial % 2 else "abcde", rng.randint(1, 6)
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(rng.choice(("x", "y", "z", None)), text(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        auto, doc = Automaton(items, window), text(rng.randint(1, 40))
        data = np.frombuffer(doc.encode(), np.uint8)
        found = auto.scan(Words(data, np.array([0, len(data)]), ALPHANUMERIC, lower=True))[0]
        spans, names = plain(items, doc.split(), window)
        assert (merged(found[0]), {auto.item_ids[i] for i in found[1]} - {None}) == (spans, names) if spans else found is None


def test_blocks_and_repeated_texts(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = spark.createDataFrame([(str(i % 9), text(rng.randint(0, 12))) for i in range(30)], "item_id string, text string")
    docs = spark.createDataFrame([(i, x, 7, 8) for i, x in enumerate([text(30) for _ in range(20)] * 2 + [None, "", text(3000)])], "doc_id long, text string, k1 int, spans int")
    whole, few = (sorted(map(repr, hit_spans(docs, items, 4, block_words=n).select("doc_id", "n_words", "spans", "items").collect())) for n in (10_000, 25))
    assert whole == few and len(whole) == 43
