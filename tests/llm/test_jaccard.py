import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import jaccard, shingles
from cadenza.llm.components import connected_components


def brute_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [v for v in (least.get(find(i)), doc_id) if v is not None]
        least[find(i)] = min(ids, default=None)
    return sorted(str((d, len(s), least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted(seed, groups=12):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randint(1, 4)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([4, 6, 8, 20, 60, 200]))]
        if draw.random() < 0.5:
            base += passage
        for _ in range(draw.choice([1, 2, 9, 25])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                own[draw.randrange(len(own))] = word()
            rows.append((" " if draw.random() < 0.5 else "\n\t").join(own))
    rows += [None, "", " \t\n", "One", "one", "a b", "x" * 10_000, "a\x0bb c d e f", "A\x0cB c d e f", "a b c d e f"]
    draw.shuffle(rows)
    return [(draw.choice([i, i, i, max(0, i - 1)]) if draw.random() < 0.97 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "group", "common", "lane"), [(1, 512, 65_536, 1 << 14), (2, 4, 65_536, 2), (3, 3, 2, 1 << 14), (4, 6, 1, 3), (5, 512, 65_536, 1)])
def test_components(spark, monkeypatch, seed, group, common, lane):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "LANE_ROWS", lane)
    rows = planted(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = jaccard.components_of(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)


def test_least_sizes_that_link(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate([(0, 7), (0, 8), (10, 16), (10, 17), (20, 29), (20, 28), (30, 35), (30, 34)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.components_of(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 2, 3, 4, 4, 6, 7]


def test_keep_one_and_empty(spark):
    rows = [(i, t) for i, (_, t) in enumerate(planted(9))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    want = {eval(x)[0] for x in brute(rows) if eval(x)[0] == eval(x)[2]}
    kept = jaccard.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == want and all(ids.count(d) == 1 or not brute_set(dict(rows)[d]) for d in want)
    assert jaccard.components_of(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_keep_one_with_null_and_reused_ids(spark):
    """Each component keeps the row of its smallest id, null last; no row of another component goes with it."""
    draw = random.Random(12)
    rows = [(draw.choice([None, draw.randrange(20), i + 100]), t) for i, (_, t) in enumerate(planted(11))]
    rows += [(7, "quite another text of eight words in all"), (7, None), (None, None), (None, "a b c d e f")]
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = sum(not s for s in sets) + len({g for g, s in zip(group, sets) if s})
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(kept) == want
    seen: dict = {}
    for doc_id, text in kept:
        own = brute_set(text)
        if own:
            g = group[sets.index(own)]
            assert g not in seen
            seen[g] = doc_id
    for g, doc_id in seen.items():
        ids = [d for (d, _), h, s in zip(rows, group, sets) if h == g and s and d is not None]
        assert doc_id == (min(ids) if ids else None)


@pytest.mark.parametrize("group", [3, 2048])
def test_every_link(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rows = list(enumerate(t for _, t in planted(21)))
    links, members = jaccard.links_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    key = {r.doc_id: r.key for r in members.collect()}
    sets = {key[i]: brute_set(t) for i, t in rows if brute_set(t)}
    assert all(sets[key[i]] == brute_set(t) for i, t in rows if brute_set(t)) and all(key[i] is None for i, t in rows if not brute_set(t))
    names = sorted(sets)
    want = sorted((x, y) for i, x in enumerate(names) for y in names[i + 1 :] if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]))
    assert sorted((r.a, r.b) for r in links.collect()) == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    draw = random.Random(3)
    text = " ".join("".join(draw.choices("abcé", k=draw.choice([1, 3, 9, 700]))) for _ in range(3000)) + " \n" * 900
    whole = next(shingles.shingle_sets(pa.array([text])))
    monkeypatch.setattr(shingles, "SLICE", 500)
    assert (next(shingles.shingle_sets(pa.array(["pad", text]).slice(1))) == whole).all()


def test_unrelated_nodes_are_dropped():
    """Of 2,000 unrelated sets no pair is left to compare, though nodes of many sets prune little: about as many pairs are looked at."""
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(2000)]
    tree = jaccard.SignatureTree(sets)
    left = sum(len(p) for p in tree.pairs(75))
    assert left == 0 and tree.tested < 2 * 2000 * 1999 / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\x0b\x1c0", max_size=40)), max_size=6), st.integers(0, 3))
def test_shingle_sets(texts, skip):
    texts = [*["pad pad"] * skip, *texts]
    column = pa.array(texts, pa.string()).slice(skip)
    known: dict = {}
    for text, own in zip(texts[skip:], shingles.shingle_sets(column), strict=True):
        want = brute_set(text)
        assert len(own) == len(want)
        assert known.setdefault(frozenset(want), own.tobytes()) == own.tobytes()
    assert len(set(known.values())) == len(known)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=40))
def test_tree_drops_no_link(sets):
    arrays = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    arrays = [np.sort(a) for a in arrays]
    tree = jaccard.SignatureTree(arrays)
    got = {frozenset((tree.order[a], tree.order[b])) for pairs in tree.pairs(75) for a, b in pairs.tolist()}
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                assert frozenset((i, j)) in got


def test_connected_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    root = {v: v for e in edges for v in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert got == want
