"""Registered plans: pending work, latest record per pair, depth ladder, paired rungs."""

from __future__ import annotations

from costwise.operators import ladder as lad
from costwise.operators import paired as pr
from costwise.plans.common import R6, finish, plan

# Roster of the fixture (13 configs) and the fixture's ladder thresholds.
FX_ROSTER = [f"m{i}" for i in range(13)]
# The order in which results were recorded; rows that tie in it are equal.
RECORD_ORDER = ("seq", "output_tokens", "terminal_correct")
FX_STOP_ACCURACY = 0.48
FX_STOP_EFFICIENCY = 0.14
FX_MAJORITY = 0.5
_ROSTER_SQL = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in FX_ROSTER) + "]) AS model)"
_DEPTHS_SQL = ", ".join(str(d) for d in range(3, 31, 3))


@plan(
    "pending_pairs", "C3 G2",
    f"""
WITH grid AS (SELECT t.task_id, r.model FROM fx_tasks t CROSS JOIN {_ROSTER_SQL} r)
SELECT g.task_id, g.model FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM fx_results d WHERE d.task_id = g.task_id AND d.model = g.model)
""",
    "fx_tasks", "fx_results",
)
def pending_pairs(fx):
    return lad.pending_pairs(fx["fx_tasks"], fx["fx_results"], FX_ROSTER)


@plan(
    "work_grid", "C2",
    f"SELECT t.task_id, t.depth, r.model FROM fx_tasks t CROSS JOIN {_ROSTER_SQL} r",
    "fx_tasks",
)
def work_grid(fx):
    return lad.work_grid(fx["fx_tasks"], FX_ROSTER, keep=["depth"])


@plan(
    "latest_per_pair", "D9",
    """
SELECT user_id, event_type, event_id, ts, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""",
)
def latest_per_pair(fx):
    e = fx["events"].select("user_id", "event_type", "event_id", "ts", "value", "props")
    return lad.latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


@plan(
    "ladder_prune", "D8 E1",
    f"""
WITH rungs AS (SELECT DISTINCT depth FROM fx_tasks WHERE depth IN ({_DEPTHS_SQL})),
grid AS (SELECT r.depth, m.model FROM rungs r CROSS JOIN {_ROSTER_SQL} m),
numbered AS (
  SELECT r.*, row_number() OVER (PARTITION BY task_id, model
           ORDER BY seq DESC, output_tokens DESC, terminal_correct DESC) AS back FROM fx_results r),
rec AS (
  SELECT q.model, t.depth, count(*) AS n, count(*) FILTER (WHERE q.terminal_correct) AS nc, avg(q.efficiency) AS me
  FROM numbered q JOIN fx_tasks t ON t.task_id = q.task_id WHERE q.back = 1 GROUP BY q.model, t.depth),
cells AS (
  SELECT g.model, g.depth, coalesce(rec.n, 0) AS n, coalesce(rec.nc, 0) AS n_correct,
    coalesce(rec.nc / rec.n, CAST(0 AS DOUBLE)) AS accuracy, rec.me AS mean_efficiency
  FROM grid g LEFT JOIN rec ON g.model = rec.model AND g.depth = rec.depth),
c2 AS (
  SELECT *, CASE WHEN accuracy <= CAST({FX_STOP_ACCURACY} AS DOUBLE) THEN 'accuracy'
                 WHEN mean_efficiency IS NOT NULL AND mean_efficiency < CAST({FX_STOP_EFFICIENCY} AS DOUBLE)
                 THEN 'efficiency' END AS prune_reason
  FROM cells),
c3 AS (
  SELECT *, prune_reason IS NOT NULL AS flag FROM c2),
c4 AS (
  SELECT *, coalesce(sum(CAST(flag AS INTEGER)) OVER (PARTITION BY model ORDER BY depth
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS alive
  FROM c3),
per AS (
  SELECT depth, count(*) FILTER (WHERE alive) AS alive_count,
    count(*) FILTER (WHERE alive AND flag) AS pruned_count
  FROM c4 GROUP BY depth),
st AS (
  SELECT *, (pruned_count / greatest(alive_count, 1) > CAST({FX_MAJORITY} AS DOUBLE))
            OR alive_count = pruned_count AS stop_here
  FROM per),
sd AS (SELECT min(depth) AS stop_depth FROM st WHERE stop_here)
SELECT c4.model, c4.depth, c4.n, c4.n_correct, {R6('c4.accuracy')} AS accuracy,
  {R6('c4.mean_efficiency')} AS mean_efficiency, c4.flag AS pruned, c4.prune_reason,
  st.alive_count, st.pruned_count, c4.depth = coalesce(sd.stop_depth, -1) AS stopped_here
FROM c4 JOIN st ON c4.depth = st.depth CROSS JOIN sd
WHERE c4.alive AND (sd.stop_depth IS NULL OR c4.depth <= sd.stop_depth)
""",
    "fx_tasks", "fx_results",
)
def ladder_prune(fx):
    return finish(lad.ladder(
        fx["fx_results"], fx["fx_tasks"], FX_ROSTER, order=RECORD_ORDER,
        stop_accuracy=FX_STOP_ACCURACY, stop_efficiency=FX_STOP_EFFICIENCY, majority=FX_MAJORITY,
    ))


_CELLS_SQL = """
cells AS (
  SELECT model, group_seed, depth, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
    count(*) FILTER (WHERE terminal_correct) = count(*) AS cell_correct
  FROM fx_results GROUP BY model, group_seed, depth),
flips AS (
  SELECT *, lag(cell_correct) OVER (PARTITION BY model, group_seed ORDER BY depth) AS prev_correct,
    first_value(cell_correct) OVER (PARTITION BY model, group_seed ORDER BY depth
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base_correct,
    last_value(cell_correct) OVER (PARTITION BY model, group_seed ORDER BY depth
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS deepest_correct
  FROM cells),
flips2 AS (
  SELECT *, coalesce(prev_correct <> cell_correct, false) AS flipped FROM flips)
"""


@plan(
    "paired_flips", "C8 E3",
    f"""
WITH {_CELLS_SQL}
SELECT model, group_seed, depth, n, n_correct, cell_correct, prev_correct, flipped, base_correct, deepest_correct
FROM flips2
""",
    "fx_results",
)
def paired_flips(fx):
    return pr.paired_flips(fx["fx_results"])


@plan(
    "persistent_failures", "D17 E3",
    f"""
WITH {_CELLS_SQL}
SELECT model, group_seed, count(*) AS n_rungs, count(*) FILTER (WHERE NOT cell_correct) AS n_failed_rungs,
  count(*) FILTER (WHERE flipped) AS n_flips,
  CASE WHEN count(*) FILTER (WHERE NOT cell_correct) = count(*) THEN 'persistent'
       WHEN count(*) FILTER (WHERE NOT cell_correct) > 0 THEN 'transient' ELSE 'clean' END AS status
FROM flips2 GROUP BY model, group_seed
""",
    "fx_results",
)
def persistent_failures(fx):
    return pr.persistent_failures(fx["fx_results"])

