import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import repeats

SCHEMA = "doc_id long, text string, key int, spans string, pos int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    words = [WORD.findall(text or "") for _, text in rows]
    least = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if doc is not None:
                g = tuple(w[i : i + window])
                least[g] = min(doc, least.get(g, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, docs, vocabulary, passages):
    draw = random.Random(seed)
    word = lambda: "wörd" * draw.randrange(2) + str(draw.randrange(vocabulary))
    shared = [[word() for _ in range(draw.randrange(13, 70))] for _ in range(passages)]
    out = []
    for doc in range(docs):
        w = []
        for _ in range(draw.randrange(6)):
            w += draw.choice(shared)[draw.randrange(8) :] if draw.random() < 0.5 else [word() for _ in range(draw.randrange(30))]
        text = "".join(x + draw.choice([" ", " ", "\n", "\t ", "\x0b", "\r\n"]) for x in w)
        out.append((doc * 3 % docs, draw.choice([" ", ""]) + text))
    return out


CASES = {
    "passages": corpus(1, 60, 10_000, 6),
    "few words": corpus(2, 40, 3, 2),
    "ties": [(4, "a b c " * 9), (4, "a b c " * 9), (4, "x " + "a b c " * 9), (2, "y " + "a b c " * 5), (None, "a b c " * 9), (None, None), (9, ""), (10, " \n"), (11, None)],
    "short": [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l m"), (5, "a b c d e f g h i j k l m")],
    "touching": [(1, " ".join(f"w{i}" for i in range(26))), (2, " ".join(f"w{i}" for i in range(13))), (3, "q " + " ".join(f"w{i}" for i in range(13, 26)) + "　w x")],
    "long": [(1, "same line here \n" * 20_000), (0, "same line here \n" * 10), (2, "x" * 3_000_000 + " " + "same line here \n" * 9)],
    "hot": [(i, f"own{i} " * 3 + " ".join(f"p{k}" for k in range(40)) + f" end{i}" * 4) for i in range(80)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("bounds", [{}, {"batch_text": 400, "frequent": 3}])
def test_removal_equals_a_plain_search(spark, name, bounds):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    out = repeats.without_repeats(docs, **bounds).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, plain(rows, repeats.WINDOW)))


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_neighbouring_texts_stay_apart():
    texts = ["ab cd", None, "", "cd", " ef\n", "ab", "x" * (repeats._CHUNK + 5) + " cd"]
    words = repeats.Words(pa.array(["unused", *texts])[1:])
    found = [words.data[a:b].tobytes().decode() for a, b in zip(words.begin, words.end, strict=True)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert words.text.tolist() == [i for i, t in enumerate(texts) for _ in WORD.findall(t or "")]
    assert {w: len({h for h, x in zip(words.hash.tolist(), found, strict=True) if x == w}) for w in found} == dict.fromkeys(found, 1)
    assert len(set(words.hash.tolist())) == len(set(found))


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, 4, 200))) for _ in range(5)]
    words = repeats.Words(pa.array(texts))
    begin, anchor, hashes = words.anchors(13)
    seen = {}
    for b, a in zip(begin.tolist(), anchor.tolist(), strict=True):
        key = tuple(words.hash[b : b + 13].tolist())
        assert seen.setdefault(key, a - b) == a - b
        assert hashes[a] == hashes[b : b + 9].min()
