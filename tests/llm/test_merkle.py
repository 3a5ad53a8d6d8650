import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle
from cadenza.operators.order import numbered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, place int, path string, slot0 int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves, fanout):
    """root, and of each leaf its steps (before, after) upwards."""
    level, own, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, at in enumerate(own):
            run, slot = runs[at // fanout], at % fanout
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        own, level = [at // fanout for at in own], [h("".join(run)) for run in runs]
    return level[0], steps


def plain(rows, fanout):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(((r[0] is not None, r[0] or 0), leaf(r, r[4]), r) for r in rows if r[1] == s) for s in sources]
    trees = [tree([x[1] for x in g], fanout) for g in groups]
    root, tops = tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, steps), top in zip(groups, trees, tops, strict=True):
        for (_, digest, row), own in zip(g, steps, strict=True):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for before, after in own + top:
                folded = h(before + folded + after)
            out.append((row[0], digest, subroot, root, h("".join(b + a for b, a in own + top)), folded, folded == root))
    return out


def case(rows):
    return [(*r, "x", 1, "y", 2) for r in rows]


def key(row):
    return tuple(map(str, row))


CASES = {
    "several sources": [(i, s, None if i % 3 else "en", i * 7, "a\nb" * (i % 4) if i % 5 else None) for s, n in (("b", 29), (None, 3), ("é", 1), ("B", 2), ("", 4)) for i in range(n)],
    "one source": [(i, "s", "en", None, "line\n") for i in range(28)],
    "one row": [(5, "s", None, 1, "\n\n")],
    "ties and no ids": [(7, "s", "en", 1, t) for t in ("x", "y\n", "x", None, "")] + [(None, "s", "en", 1, "z\n"), (None, None, None, None, None), (None, None, None, None, None)],
    "many sources": [(i, f"s{i:02}", "en", 1, "t\n" * 3) for i in range(23)],
    "long text": [(i, "s", "en", 1, "word\n" * 60_000) for i in range(2)],
}


@pytest.mark.parametrize(("name", "fanout"), [*[(name, 3) for name in CASES], ("several sources", 2)])
def test_manifest_equals_a_plain_tree(spark, name, fanout):
    docs = spark.createDataFrame(case(CASES[name]), SCHEMA).repartition(3)
    out = merkle.manifest(docs, altered=merkle.without_newlines(), fanout=fanout)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes) == merkle.MANIFEST.replace("long", "bigint")
    assert sorted(map(key, out.collect())) == sorted(map(key, plain(CASES[name], fanout)))


def test_untampered_rows_are_verified_and_empty_tables_are_empty(spark):
    docs = spark.createDataFrame(case(CASES["several sources"]), SCHEMA)
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_places_are_the_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("w"))
    out = numbered(rows, [F.col("v"), F.asc_nulls_first("w")], "places").collect()
    order = sorted(out, key=lambda r: (r.v, r.w is not None, r.w or 0))
    assert sorted(r.place for r in out) == list(range(1000))
    assert [(r.v, r.w) for r in order] == [(r.v, r.w) for r in sorted(out, key=lambda r: r.place)]
