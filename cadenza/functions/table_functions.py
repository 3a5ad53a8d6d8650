"""Table functions in SQL: windows, tile spans and periodic tiles of a record.

``register`` makes them known to a session; they take columns through LATERAL and Catalyst
inlines their bodies, so no Python worker runs:

    SELECT record_id, w.* FROM records, LATERAL window_plan(length, array(128, 256)) AS w

Defined cases: a null or non-positive length, period or size gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, columns, array of structs that the function opens)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # each size, cut to the length, steps by a quarter (16 at least) and ends flush with the record
    "window_plan": (
        "len INT, sizes ARRAY<INT>",
        "start INT, `end` INT, window_size INT",
        """CASE WHEN len > 0 AND array_min(sizes) > 0 THEN flatten(transform(
             array_distinct(concat(transform(array_sort(sizes), s -> least(len, s)), array(least(len, array_max(sizes))))),
             w -> transform(array_distinct(concat(sequence(0, len - w, greatest(16, CAST(rint(w * 0.25D) AS INT))), array(len - w))),
                            s -> named_struct('start', s, 'end', s + w, 'window_size', w)))) END""",
    ),
    # cores cover each position once; a tile reaches (tile - core) / 2 beyond its core, unclipped
    "tile_spans": (
        "len INT, tile INT, core INT",
        "core_start INT, core_end INT, tile_start INT, tile_end INT",
        """CASE WHEN len > 0 AND core > 0 AND tile >= core THEN transform(sequence(0, len - 1, core), s ->
             named_struct('core_start', s, 'core_end', least(s + core, len), 'tile_start', s - (tile - core) div 2, 'tile_end', s - (tile - core) div 2 + tile)) END""",
    ),
    # edges at offset + k period, rounded half-even and clipped; tiles below 0.45 periods are left out
    "periodic_tiles": (
        "len INT, period DOUBLE, first DOUBLE",
        "unit INT, start INT, `end` INT",
        """CASE WHEN len > 0 AND period > 0 AND first IS NOT NULL THEN transform(
             filter(
               transform(array(array_sort(array_distinct(transform(
                   sequence(CAST(-ceil(greatest(first, 0D) / period) AS INT), CAST(-ceil(greatest(first, 0D) / period) + ceil((len - first + ceil(greatest(first, 0D) / period) * period) / period) AS INT)),
                   k -> CAST(greatest(0D, least(CAST(len AS DOUBLE), rint(first + k * period))) AS INT))))),
                 e -> zip_with(slice(e, 1, greatest(size(e) - 1, 0)), slice(e, 2, greatest(size(e) - 1, 0)), (a, b) -> named_struct('start', a, 'end', b)))[0],
               t -> t.`end` - t.start >= 0.45D * period),
             (t, k) -> named_struct('unit', k, 'start', t.start, 'end', t.`end`)) END""",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session; they last as long as it does."""
    for name, (parameters, columns, rows) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN SELECT inline({rows})")
