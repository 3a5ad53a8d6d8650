import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from cadenza.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, shard string, n int"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x, key=lambda v: (*v[:2], v[2].encode(), v[3].encode()))] for c, x in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = (*turns.get(base, [])[:h], *turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def drawn(seed, convs, most, alphabet=3):
    draw = random.Random(seed)
    out = []
    for _ in range(convs):
        c = draw.choice([draw.randrange(-150, 400), draw.randrange(0, 5) * 100])
        for t in range(draw.randrange(most + 1)):
            out.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["é", "hi there", "", None, "🙂x", "y"][:alphabet])))
    return out


def long_ones():
    turns = [("user", f"t{i % 7}") for i in range(33)]
    out = [(c, i, *t) for c in (0, 7, 8, 11, 211) for i, t in enumerate(turns)]
    out += [(c, i, *t) for c in (12, 13) for i, t in enumerate(turns[:8])]  # end where a strip ends
    out += [(c, i, *t) for c in (14, 15) for i, t in enumerate([*turns[:16], ("user", "other"), *turns[16:20]])]
    return out


CASES = {
    "drawn": drawn(1, 120, 7),
    "few texts": drawn(2, 80, 9, 1),
    "long": long_ones(),
    "hot": [(c, t, "user", "same") for c in range(300) for t in range(4)] + [(c, 9, "user", f"own {c}") for c in range(0, 300, 7)],
    "ties and nulls": [(5, None, None, None), (5, 1, "b", "x"), (5, 1, "b", "x"), (5, 1, "a", "y"), (None, 1, "a", "y"), (6, None, "a", "z")],
    "without turns": [(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "a", "c")],
    "one": [(100, 0, "user", "long " * 50_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_trie_equals_a_plain_one(spark, name):
    rows = [(*r, 1, "x", 2) for r in CASES[name]]
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), width=4, shard_rows=20)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes) == prefix_trie.NODES.replace("long", "bigint")
    assert sorted(map(tuple, out.collect()), key=lambda r: tuple(map(str, r))) == sorted(plain(CASES[name]), key=lambda r: tuple(map(str, r)))


def test_result_is_one_for_all_shards_and_widths(spark):
    rows = spark.createDataFrame([(*r, 1, "x", 2) for r in CASES["drawn"] + CASES["long"]], SCHEMA)
    found = [sorted(map(str, prefix_trie.prefix_trie(rows, width, shard).collect())) for width, shard in ((64, 1 << 15), (3, 7))]
    assert found[0] == found[1]


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2)], SCHEMA)).count() == 0
