"""Merkle manifest of a data set: a tree over the rows of each source, a tree over the sources.

A row's fields are hashed to its leaf. Leaves of a source stand in the order of their ids;
every ``fanout`` consecutive nodes become one, until one is left. A level is a slot pivot:
nodes are grouped by parent, conditional aggregates spread a parent's children into
``fanout`` columns, the concatenated columns hash to the parent, and the columns without
a child's own are its siblings. Levels are written tables (each a ``fanout``-th of the
one below); the siblings on a node's way up are gathered from the top down, and the rows
meet them once, at their parents. Global places come from range partitions, so neither a
source nor a level passes through one task.

Defined cases: a null field counts as ``-``, a text as its UTF-8 bytes; rows without id come
first in their source; rows of one id stand in the order of their leaves, so equal rows
have neighbouring places and proofs of their own; a null source is a source, the first;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.order import numbered
from cadenza.session import materialize, small_side

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_STEP = "array<struct<before: string, after: string>>"


def field_text(value: Column) -> Column:
    """A field as it enters a leaf: its UTF-8 length, a colon and itself, or ``-``."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(fields.get(f, F.col(f))) for f in FIELDS]), 256)


def _slots(fanout: int) -> list[Column]:
    return [F.coalesce(F.col(f"slot{s}"), F.lit("")) for s in range(fanout)]


def pivot(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """nodes (grp, pos, n, digest) -> grp, pos, n of the level above, and its children's digests slot0, slot1, .. (null: none)."""
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == s, F.col("digest"))).alias(f"slot{s}") for s in range(fanout)]
    return nodes.groupBy("grp", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(*spread)


class Forest:
    """A tree over the nodes of each group. levels[k]: the slot pivot whose children are the nodes of height k."""

    def __init__(self, leaves: DataFrame, rows: int, largest: int, groups: int, name: str, fanout: int = FANOUT) -> None:
        """leaves (grp, pos, n, digest): nodes of a group at pos 0 to n - 1; rows, largest, groups: how many nodes there are in all, in a group at most, and how many groups."""
        self.fanout, self.levels, self.leaves = fanout, [], leaves
        nodes = leaves
        while largest > 1:
            rows, largest = -(-rows // fanout) + groups, -(-largest // fanout)
            level = materialize(pivot(nodes.filter("n > 1"), fanout), f"{name}-{len(self.levels)}", rows=rows)
            self.levels.append(level)
            nodes = self._nodes(level)

    def _nodes(self, level: DataFrame) -> DataFrame:
        return level.select("grp", "pos", "n", F.sha2(F.concat(*_slots(self.fanout)), 256).alias("digest"))

    def roots(self) -> DataFrame:
        """grp, height, digest of each group's last node."""
        every = [self.leaves, *[self._nodes(level) for level in self.levels]]
        return reduce(DataFrame.unionAll, [nodes.filter("n = 1").select("grp", F.lit(k).alias("height"), "digest") for k, nodes in enumerate(every)])

    def parents(self, above: DataFrame) -> DataFrame:
        """above (grp, height, path): the steps above each group's root -> levels[0] with ``path``, the steps above each parent of leaves."""
        known = above.filter(F.col("height") == len(self.levels)).select("grp", F.lit(0).cast("long").alias("pos"), "path")
        for k in reversed(range(len(self.levels))):
            level = self.levels[k].join(known, ["grp", "pos"])
            if k:
                children = F.explode(F.array(*[F.struct((F.col("pos") * self.fanout + s).alias("pos"), F.col(f"slot{s}").alias("own"), self.step(F.lit(s)).alias("step")) for s in range(self.fanout)]))
                below = level.select("grp", "path", children.alias("c")).filter("c.own is not null")
                known = below.select("grp", "c.pos", F.concat(F.array("c.step"), "path").alias("path"))
                known = known.unionAll(above.filter(F.col("height") == k).select("grp", F.lit(0).cast("long"), "path"))
        return level

    def step(self, slot: Column) -> Column:
        """The columns beside a slot: what stands before and after it."""
        side = lambda keep: F.concat(*[F.when(keep(s), c).otherwise("") for s, c in enumerate(_slots(self.fanout))])
        return F.struct(side(lambda s: slot > s).alias("before"), side(lambda s: slot < s).alias("after"))

    def paths(self, rows: DataFrame, above: DataFrame) -> DataFrame:
        """rows (grp, pos, n, ..) of leaves with ``path``: the steps from a leaf to the end of ``above``."""
        alone = rows.filter("n = 1").join(small_side(above.filter("height = 0").select("grp", "path")), "grp")
        if not self.levels:
            return alone
        parents = self.parents(above).select("grp", F.col("pos").alias("__parent"), *[f"slot{s}" for s in range(self.fanout)], F.col("path").alias("__above"))
        met = rows.filter("n > 1").withColumn("__parent", F.expr(f"pos div {self.fanout}")).join(parents, ["grp", "__parent"])
        met = met.withColumn("path", F.concat(F.array(self.step(F.pmod("pos", F.lit(self.fanout)))), "__above"))
        return alone.unionByName(met.select(*alone.columns))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def manifest(docs: DataFrame, altered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and what ``altered`` (a text; null: as it is) does to them: folded_root, verified.

    verified says whether the leaf of the altered row and the original siblings lead to the root.
    """
    leaf = leaf_digest()
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf_digest(text=altered))
    narrow = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf.alias("leaf"), other.alias("other")), "merkle-leaves")
    placed = numbered(narrow, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("leaf")], "merkle-places")
    sources = materialize(placed.groupBy("source").agg(F.min("place").alias("grp"), F.count("*").alias("n")), "merkle-sources")
    size = sources.agg(F.sum("n").alias("rows"), F.max("n").alias("largest"), F.count("*").alias("groups")).first()
    if not size["groups"]:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    named = sources.select(F.col("source").alias("__source"), "grp", "n")
    rows = placed.join(small_side(named), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.select("doc_id", "leaf", "other", "grp", "n", (F.col("place") - F.col("grp")).alias("pos"))
    forest = Forest(rows.select("grp", "pos", "n", F.col("leaf").alias("digest")), size["rows"], size["largest"], size["groups"], "merkle", fanout)
    # a source's group is named by its first place, so groups stand in the order of sources
    subroots = materialize(forest.roots(), "merkle-subroots", rows=size["groups"])
    tops = numbered(subroots, [F.col("grp")], "merkle-tops").select("grp", "height", "digest", F.col("place").alias("pos"), F.lit(size["groups"]).cast("long").alias("n"))
    over = tops.select(F.lit(0).cast("long").alias("grp"), "pos", "n", "digest", F.col("grp").alias("of"), "height")
    upper = Forest(over.select("grp", "pos", "n", "digest"), size["groups"], size["groups"], 1, "merkle-top", fanout)
    end = upper.roots().first()
    start = docs.sparkSession.createDataFrame([(0, end["height"], [])], f"grp long, height int, path {_STEP}")
    above = materialize(upper.paths(over, start).select(F.col("of").alias("grp"), "height", "path", F.col("digest").alias("subroot")), "merkle-above", rows=size["groups"])
    found = forest.paths(rows, above.select("grp", "height", "path")).join(small_side(above.select("grp", "subroot")), "grp")
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", F.lit(end["digest"]).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The tampering of the registered query: an even checksum of the id deletes the text's newlines."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


#: CRC-32 of a decimal number in SQL: its characters, then eight shifts each; the polynomial is fixed.
CRC32_SQL = """xor(list_reduce(list_transform(string_split({id}::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, i: xor(r // 2, 3988292384 * (r % 2))), 4294967295::BIGINT), 4294967295)"""

_LEAF_SQL = "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f} END" for f in FIELDS) + ")"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF_SQL} AS leaf,
         {_LEAF_SQL.replace("text", "replace(text, chr(10), '')")} AS bare, {CRC32_SQL.format(id="doc_id")} % 2 = 0 AS even FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) AS grp FROM d),
up AS (SELECT grp, pos::BIGINT AS pos, n::BIGINT AS n, leaf AS digest, 0 AS height FROM o
       UNION ALL SELECT grp, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)), height + 1 FROM up WHERE n > 1 GROUP BY grp, pos // 3, n, height),
tops AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (SELECT 0 AS grp, pos::BIGINT AS pos, n::BIGINT AS n, subroot AS digest, 0 AS height FROM tops
          UNION ALL SELECT grp, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)), height + 1 FROM over_ WHERE n > 1 GROUP BY grp, pos // 3, n, height),
way AS (SELECT o.doc_id, o.leaf, o.grp, o.pos AS first, CASE WHEN even AND bare IS NOT NULL THEN bare ELSE leaf END AS folded, '' AS proof, o.pos AS pos, o.n AS n, 0 AS height FROM o
        UNION ALL
        SELECT w.doc_id, w.leaf, w.grp, w.first,
               sha256(string_agg(CASE WHEN u.pos = w.pos THEN w.folded ELSE u.digest END, '' ORDER BY u.pos)),
               w.proof || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> w.pos), ''), w.pos // 3, (w.n + 2) // 3, w.height + 1
        FROM way w JOIN up u ON u.grp = w.grp AND u.height = w.height AND u.pos // 3 = w.pos // 3 WHERE w.n > 1
        GROUP BY w.doc_id, w.leaf, w.grp, w.first, w.folded, w.proof, w.pos, w.n, w.height),
high AS (SELECT w.doc_id, w.leaf, w.grp, w.first, t.subroot, w.folded, w.proof, t.pos, t.n, 0 AS height FROM way w JOIN tops t USING (grp) WHERE w.n = 1
         UNION ALL
         SELECT w.doc_id, w.leaf, w.grp, w.first, w.subroot,
                sha256(string_agg(CASE WHEN u.pos = w.pos THEN w.folded ELSE u.digest END, '' ORDER BY u.pos)),
                w.proof || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> w.pos), ''), w.pos // 3, (w.n + 2) // 3, w.height + 1
         FROM high w JOIN over_ u ON u.height = w.height AND u.pos // 3 = w.pos // 3 WHERE w.n > 1
         GROUP BY w.doc_id, w.leaf, w.grp, w.first, w.subroot, w.folded, w.proof, w.pos, w.n, w.height),
r AS (SELECT digest AS root FROM over_ WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM high, r WHERE n = 1
"""
