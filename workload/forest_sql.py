"""SQL that grows and applies an isolation forest, apart from the Spark side."""

from __future__ import annotations

from collections.abc import Callable

SAMPLE, UNIT, PRIME = 256, "1e9", 2**31 - 1
GAMMA = "0.5772156649015329::DOUBLE"
MOST_LEVELS = 8
KEY = '"user", event_date'


def drawn(text: str) -> str:
    """The first 52 bits of the text's MD5."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def forest_parts(part: Callable[[str, str, str], None], name: str, needs: str, train: str, scored: str, features: list[str],
                 trees: int, contamination: float, seed: int = 42) -> str:
    """Add the parts of one forest, fitted on the rows of ``train`` (SQL) and applied to ``scored``; returns the part with the scores."""
    p, k = name, len(features)
    xs = [f"x{i}" for i in range(k)]
    point = ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {x}" for f, x in zip(features, xs))
    part(f"{p}_train", needs, f"SELECT {KEY}, {point} FROM ({train})")
    part(f"{p}_size", f"{p}_train", f"""SELECT least({SAMPLE}, count(*)) AS n,
      CAST(ceil(log2(greatest(2, least({SAMPLE}, count(*))))) AS INTEGER) AS levels FROM {p}_train""")
    part(f"{p}_lines", "", f"""SELECT CAST(t AS INTEGER) AS tree, 1 + {drawn(f"'{seed}|' || t || '|slope'")} % {PRIME - 1} AS slope,
      {drawn(f"'{seed}|' || t || '|start'")} % {PRIME} AS start FROM range({trees}) r(t)""")
    part(f"{p}_drawn", f"{p}_train {p}_lines", f"""SELECT tree, {', '.join(xs)}, row_number() OVER (
      PARTITION BY tree ORDER BY (hash * slope + start) % {PRIME}, {KEY}) AS place
      FROM (SELECT *, {drawn(f"concat_ws('|', '{seed}', {KEY})")} % {PRIME} AS hash FROM {p}_train), {p}_lines""")

    label = f"'{seed}|' || tree || '|' || node"
    ends = ", ".join(f"{{'f': {i}, 'lo': lo{i}, 'hi': hi{i}}}" for i in range(k))
    place = f"(CAST({drawn(label + " || '|threshold'")} AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"

    def decided(source: str, keep: str) -> str:
        """Feature and threshold of each node of ``source`` (depth, tree, node, n, lo, hi), null where it is a leaf."""
        return f"""SELECT {keep}, n, depth, pick.f AS feature, CASE WHEN pick.lo + {place} * (pick.hi - pick.lo) >= pick.hi THEN pick.lo
            ELSE pick.lo + {place} * (pick.hi - pick.lo) END AS threshold
          FROM (SELECT *, CASE WHEN n > 1 AND len(varying) > 0 AND depth < (SELECT levels FROM {p}_size)
              THEN varying[1 + {drawn(label + " || '|feature'")} % len(varying)] END AS pick
            FROM (SELECT *, list_filter([{ends}], lambda e: e.lo < e.hi) AS varying FROM ({source})))"""

    over = ", ".join(f"min({x}) OVER w AS lo{i}, max({x}) OVER w AS hi{i}" for i, x in enumerate(xs))
    step = decided(f"SELECT *, count(*) OVER w AS n, {over} FROM {p}_walk WINDOW w AS (PARTITION BY tree, node)", f"tree, node, {', '.join(xs)}")
    part(f"{p}_walk", f"{p}_drawn {p}_size", f"""SELECT 0 AS depth, tree, CAST(0 AS BIGINT) AS node, {', '.join(xs)}
        FROM {p}_drawn WHERE place <= (SELECT n FROM {p}_size)
      UNION ALL
      SELECT depth + 1, tree, 2 * node + CASE WHEN [{', '.join(xs)}][feature + 1] <= threshold THEN 1 ELSE 2 END, {', '.join(xs)}
        FROM ({step}) WHERE feature IS NOT NULL""")
    whole = ", ".join(f"min({x}) AS lo{i}, max({x}) AS hi{i}" for i, x in enumerate(xs))
    grouped = decided(f"SELECT depth, tree, node, count(*) AS n, {whole} FROM {p}_walk GROUP BY depth, tree, node", "tree, node")
    rest = f"CASE WHEN n <= 2 THEN CAST(n - 1 AS DOUBLE) ELSE 2 * (ln(CAST(n - 1 AS DOUBLE)) + {GAMMA}) - 2 * CAST(n - 1 AS DOUBLE) / n END"
    part(f"{p}_nodes", f"{p}_walk", f"""SELECT tree, node, feature, threshold,
      CASE WHEN feature IS NULL THEN CAST(round((depth + {rest}) * {UNIT}) AS BIGINT) ELSE 0 END AS path FROM ({grouped})""")

    part(f"{p}_rows", f"{needs} {p}_train", f"""SELECT 0 AS batch, {KEY}, [{', '.join(xs)}] AS x FROM {p}_train
      UNION ALL SELECT 1, {KEY}, [{', '.join(xs)}] FROM (SELECT {KEY}, {point} FROM ({scored}))""")
    part(f"{p}_at0", f"{p}_rows", f"""SELECT batch, {KEY}, x, CAST(t AS INTEGER) AS tree, CAST(0 AS BIGINT) AS node
      FROM {p}_rows, range({trees}) r(t)""")
    for level in range(MOST_LEVELS):
        part(f"{p}_at{level + 1}", f"{p}_at{level} {p}_nodes", f"""SELECT batch, {KEY}, x, a.tree, CASE WHEN feature IS NULL THEN a.node
          WHEN x[feature + 1] <= threshold THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node
          FROM {p}_at{level} a JOIN {p}_nodes n ON a.tree = n.tree AND a.node = n.node""")
    expected = f"""(SELECT CASE WHEN n <= 1 THEN 1.0::DOUBLE WHEN n = 2 THEN 1.0::DOUBLE
      ELSE 2 * (ln(CAST(n - 1 AS DOUBLE)) + {GAMMA}) - 2 * CAST(n - 1 AS DOUBLE) / n END FROM {p}_size)"""
    part(f"{p}_raw", f"{p}_at{MOST_LEVELS} {p}_nodes {p}_size", f"""SELECT batch, {KEY},
      round(-pow(2.0::DOUBLE, -CAST(sum(path) AS DOUBLE) / ({expected} * {trees} * {UNIT})), 9) AS raw
      FROM {p}_at{MOST_LEVELS} a JOIN {p}_nodes n ON a.tree = n.tree AND a.node = n.node GROUP BY batch, {KEY}""")
    part(f"{p}_scores", f"{p}_raw", f"""SELECT {KEY}, round(raw - (SELECT quantile_cont(raw, {contamination}::DOUBLE) FROM {p}_raw WHERE batch = 0), 12)
      + 0.0::DOUBLE AS iforest_score FROM {p}_raw WHERE batch = 1""")
    return f"{p}_scores"
