"""SQL for k-means of hour profiles, principal components and silhouettes, apart from the Spark side."""

from __future__ import annotations

from collections.abc import Callable

HOURS = 168
MOST_ROUNDS = 50
#: Squarings of the covariance, after which its first component is all that is left.
SQUARINGS = 14


def cluster_parts(part: Callable[[str, str, str], None], name: str, shares: str, k: int = 3) -> None:
    """Add ``{name}_points`` (command, d, x) and ``{name}_clusters`` (command, cluster) from the rows of ``shares`` (command, hour_of_week, share)."""
    p = name
    part(f"{p}_points", shares, f"""SELECT command, hour_of_week AS d, CASE WHEN sd > 0 THEN (share - mean) / sd ELSE 0.0::DOUBLE END AS x
      FROM (SELECT *, avg(share) OVER (PARTITION BY hour_of_week) AS mean, stddev_pop(share) OVER (PARTITION BY hour_of_week) AS sd FROM {shares})""")
    part(f"{p}_seed0", f"{p}_points", f"SELECT 0 AS i, min(command) AS command FROM {p}_points")
    for i in range(1, k):
        seeds = " UNION ALL ".join(f"SELECT * FROM {p}_seed{j}" for j in range(i))
        part(f"{p}_seed{i}", " ".join([f"{p}_points", *(f"{p}_seed{j}" for j in range(i))]), f"""SELECT {i} AS i, command FROM (
            SELECT command, min(gap) AS gap FROM (
              SELECT p.command, s.i, round(sum((p.x - c.x) ** 2), 9) AS gap FROM {p}_points p
              JOIN ({seeds}) s ON true JOIN {p}_points c ON c.command = s.command AND c.d = p.d GROUP BY p.command, s.i)
            GROUP BY command ORDER BY gap DESC, command LIMIT 1)""")
    seeds = " UNION ALL ".join(f"SELECT * FROM {p}_seed{j}" for j in range(k))
    nearest = """SELECT command, arg_min(i, (gap, i)) AS i FROM (
        SELECT p.command, c.i, round(sum((p.x - c.x) ** 2), 9) AS gap FROM {points} p JOIN {centres} c ON c.d = p.d GROUP BY p.command, c.i)
        GROUP BY command"""
    part(f"{p}_walk", " ".join([f"{p}_points", *(f"{p}_seed{j}" for j in range(k))]), f"""SELECT 0 AS round, s.i, c.d, c.x, true AS moved
        FROM ({seeds}) s JOIN {p}_points c ON c.command = s.command
      UNION ALL
      SELECT * FROM (SELECT o.round + 1 AS round, o.i, o.d, coalesce(n.x, o.x) AS x, bool_or(coalesce(n.x, o.x) <> o.x) OVER () AS moved
        FROM {p}_walk o LEFT JOIN (SELECT a.i, p.d, round(avg(p.x), 9) AS x FROM ({nearest.format(points=f"{p}_points", centres=f"{p}_walk")}) a
          JOIN {p}_points p ON p.command = a.command GROUP BY a.i, p.d) n ON n.i = o.i AND n.d = o.d)
      WHERE moved AND round <= {MOST_ROUNDS}""")
    # Centres are numbered by their coordinates.
    part(f"{p}_centres", f"{p}_walk", f"""SELECT r.i, w.d, w.x FROM (SELECT old, row_number() OVER (ORDER BY c) - 1 AS i FROM (
        SELECT i AS old, list(x ORDER BY d) AS c FROM {p}_walk WHERE round = (SELECT max(round) FROM {p}_walk) GROUP BY i)) r
      JOIN {p}_walk w ON w.i = r.old AND w.round = (SELECT max(round) FROM {p}_walk)""")
    part(f"{p}_clusters", f"{p}_points {p}_centres", "SELECT command, CAST(i AS INTEGER) AS cluster FROM ("
         + nearest.format(points=f"{p}_points", centres=f"{p}_centres") + ")")
    part(f"{p}_silhouette", f"{p}_points {p}_clusters", f"""SELECT round(avg(CASE WHEN inside IS NULL THEN 0.0::DOUBLE
        ELSE coalesce((outside - inside) / nullif(greatest(inside, outside), 0), 0.0) END), 6) AS silhouette
      FROM (SELECT command, max(CASE WHEN same THEN m END) AS inside, min(CASE WHEN NOT same THEN m END) AS outside FROM (
        SELECT a, ca.cluster = cb.cluster AS same, cb.cluster, avg(gap) AS m FROM (
          SELECT p.command AS a, o.command AS b, sqrt(sum((p.x - o.x) ** 2)) AS gap
          FROM {p}_points p JOIN {p}_points o ON p.d = o.d AND p.command <> o.command GROUP BY ALL)
        JOIN {p}_clusters ca ON ca.command = a JOIN {p}_clusters cb ON cb.command = b GROUP BY ALL) t(command, same, cluster, m) GROUP BY command)""")


def component_parts(part: Callable[[str, str, str], None], name: str) -> None:
    """Add ``{name}_pc1`` and ``{name}_pc2`` (command, pc): coordinates along the two widest directions of ``{name}_points``.

    Powers of the covariance matrix, by squaring, keep only its first direction; without that one, the next is the first.
    """
    p = name
    covariance = f"SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS v FROM {p}_points a JOIN {p}_points b ON a.command = b.command GROUP BY ALL"
    for c in (1, 2):
        source = covariance if c == 1 else f"""SELECT m.i, m.j, m.v - l.v * a.v * b.v AS v FROM {p}_cov1 m, {p}_value1 l
            JOIN {p}_axis1 a ON true JOIN {p}_axis1 b ON true WHERE a.d = m.i AND b.d = m.j"""
        part(f"{p}_cov{c}", f"{p}_points" if c == 1 else f"{p}_cov1 {p}_value1 {p}_axis1", source)
        before = f"{p}_cov{c}"
        for s in range(SQUARINGS):
            part(f"{p}_sq{c}_{s}", before, f"""SELECT i, j, v / max(abs(v)) OVER () AS v FROM (
                SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY ALL)""")
            before = f"{p}_sq{c}_{s}"
        part(f"{p}_axis{c}", before, f"""SELECT d, v * CASE WHEN max(v) OVER () >= -min(v) OVER () THEN 1 ELSE -1 END AS v FROM (
            SELECT i AS d, v / sqrt(sum(v * v) OVER ()) AS v FROM {before} WHERE j = (SELECT i FROM {before} WHERE i = j ORDER BY v DESC LIMIT 1))""")
        part(f"{p}_value{c}", f"{p}_cov{c} {p}_axis{c}", f"""SELECT sum(a.v * m.v * b.v) AS v FROM {p}_cov{c} m
            JOIN {p}_axis{c} a ON a.d = m.i JOIN {p}_axis{c} b ON b.d = m.j""")
        part(f"{p}_pc{c}", f"{p}_points {p}_axis{c}", f"""SELECT command, round(sum(x * v), 6) AS pc FROM {p}_points JOIN {p}_axis{c} USING (d) GROUP BY command""")
