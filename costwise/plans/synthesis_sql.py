"""DuckDB SQL of the task generators: the same rules and draws, written as recursive CTEs.

All attempts of a seed are computed and the first valid one is kept, where the Spark plan stops at it."""

from __future__ import annotations

import re

from costwise.functions import patterns as P
from costwise.operators import synth as sy
from costwise.plans.scoring import sql_tokens

Q = P.sql_literal


def _draw(namespace: str, m: str | int, *parts: str) -> str:
    """``parts``: SQL expressions; string constants quoted."""
    key = f"concat_ws('|', {Q(namespace)}, {', '.join(parts)})"
    return f"(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % ({m}))"


def _chain_draw(m, *parts: str) -> str:
    return _draw(sy.NAMESPACE, m, "seed", "a", *parts)


def _ledger_draw(m, *parts: str) -> str:
    return _draw(sy.LEDGER_NAMESPACE, m, "seed", "a", *parts)


def _text(template: str, **slots: str) -> str:
    """A str.format template as a concatenation; slots are SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(Q(x) if i % 2 == 0 else slots[x] for i, x in enumerate(parts) if x or i % 2) + ")"


def _list(values) -> str:
    return "[" + ", ".join(Q(v) for v in values) + "]"


def _no_leak(prompt: str, hidden: str) -> str:
    return f"len(list_intersect(regexp_extract_all({prompt}, {Q(P.NUMBER_RUN)}), list_transform({hidden}, lambda h: CAST(h AS VARCHAR)))) = 0"


def _picked(source: str, pool: str, draw, name: str) -> str:
    """CTEs ``<name>``: rows of ``source`` with dvals, up to two different values of the list ``pool``."""
    return f"""
{name}_p AS (SELECT *, {pool} AS pool0 FROM {source}),
{name}_q AS (SELECT *, pool0[{draw('len(pool0)', "'dval'", '0')} + 1] AS v0 FROM {name}_p),
{name}_r AS (SELECT *, list_filter(pool0, lambda p: p <> v0) AS pool1 FROM {name}_q),
{name} AS (SELECT *, CASE distractors WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [v0] ELSE [v0, pool1[{draw('len(pool1)', "'dval'", '1')} + 1]] END AS dvals FROM {name}_r)"""


def _placed(source: str, name: str, at, sentence) -> str:
    """CTEs ``<name>``: rows with s2, the sentences with up to two more put in at drawn places."""
    out = []
    for j, (old, new, rows) in enumerate((("sents", "s1", source), ("s1", "s2", f"{name}_0"))):
        out.append(
            f"{name}_{j}_at AS (SELECT *, {at(old, j)} AS at{j} FROM {rows}),\n"
            f"{name}{'_0' if j == 0 else ''} AS (SELECT *, CASE WHEN distractors > {j} THEN "
            f"list_concat({old}[1:at{j} - 1], [{sentence(f'dvals[{j + 1}]', j)}], {old}[at{j}:]) ELSE {old} END AS {new} FROM {name}_{j}_at)"
        )
    return ",\n".join(out)


def chain_ctes(seeds: str) -> str:
    """``chain``: one row per (seed, attempt a) with depth, distractors, place, items, v, vals, surface, sents."""
    places, items = (_list(x) for x in zip(*sy.SCENARIOS, strict=True))
    first = "CASE tpl " + " ".join(
        f"WHEN {i} THEN {_text(t, place='place', items='items', a='x', b='y')}" for i, t in enumerate(sy.FIRST_TEMPLATES)
    ) + " END"
    said = "CASE op " + " ".join(f"WHEN {Q(op)} THEN {_text(t, k='k', items='items')}" for op, t in sy.OP_TEMPLATES.items()) + " END"
    cap = sy.VALUE_CAP
    return f"""
seeds AS ({seeds}),
tries AS (SELECT s.*, t.a FROM seeds s, (SELECT unnest(range({sy.MAX_ATTEMPTS})) AS a) t),
setting AS (
  SELECT *, {places}[sc + 1] AS place, {items}[sc + 1] AS items, {_chain_draw(3, "'first'")} AS tpl,
    20 + {_chain_draw(60, "'a'")} AS x, 20 + {_chain_draw(60, "'b'")} AS y
  FROM (SELECT *, {_chain_draw(len(sy.SCENARIOS), "'scenario'")} AS sc FROM tries)),
fold AS (
  SELECT seed, a, depth, distractors, place, items, 1 AS i, v, [v] AS vals, [x, y] AS surface, [{first}] AS sents
  FROM (SELECT *, CASE WHEN tpl = 2 THEN 3 * x ELSE x + y END AS v FROM setting)
  UNION ALL
  SELECT seed, a, depth, distractors, place, items, i + 1, nv, list_append(vals, nv), list_append(surface, k), list_append(sents, {said})
  FROM (
    SELECT *, CASE op WHEN 'gain' THEN v + k WHEN 'loss' THEN v - k WHEN 'scale' THEN v * k ELSE v // k END AS nv FROM (
      SELECT *, CASE op WHEN 'gain' THEN 13 + {_chain_draw(84, "'k'", 'i')} WHEN 'loss' THEN 7 + {_chain_draw('greatest(loss_hi - 6, 1)', "'k'", 'i')}
          WHEN 'scale' THEN scale_ks[{_chain_draw('greatest(len(scale_ks), 1)', "'k'", 'i')} + 1]
          ELSE split_ks[{_chain_draw('greatest(len(split_ks), 1)', "'k'", 'i')} + 1] END AS k FROM (
        SELECT *, ops[{_chain_draw('len(ops)', "'op'", 'i')} + 1] AS op FROM (
          SELECT *, list_concat(CASE WHEN v + 96 <= {cap} THEN ['gain'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN loss_hi >= 7 THEN ['loss'] ELSE CAST([] AS VARCHAR[]) END,
              CASE WHEN len(scale_ks) > 0 THEN ['scale'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(split_ks) > 0 THEN ['split'] ELSE CAST([] AS VARCHAR[]) END) AS ops FROM (
            SELECT *, least(96, v - 2) AS loss_hi, list_filter(range(2, 10), lambda q: v * q <= {cap}) AS scale_ks,
              list_filter(range(2, 13), lambda q: v % q = 0 AND v // q >= 2) AS split_ks
            FROM fold WHERE i < depth)))))),
chain AS MATERIALIZED (SELECT * FROM fold WHERE i = greatest(depth, 1))"""


def chain_tasks_ctes(seeds: str) -> str:
    """``tasks``: the first valid attempt of each seed, as ``synth.synthesize_chains`` gives it."""
    forbidden = "list_concat(vals, surface)"
    pool = f"list_filter(range(11, 100), lambda p: NOT list_contains({forbidden}, p))"
    place = _placed(
        "drawn", "placed", lambda old, j: f"2 + {_chain_draw(f'len({old})', repr('dpos'), str(j))}",
        lambda d, j: _text(sy.DISTRACTOR_TEMPLATE, place="place", d=d, items="items"),
    )
    return f"""{chain_ctes(seeds)},{_picked("chain", pool, _chain_draw, "drawn")},
{place},
said AS (SELECT *, array_to_string(list_append(s2, {_text(sy.QUESTION, items='items')}), ' ') AS prompt FROM placed),
valid AS (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY a) AS nth FROM said
  WHERE list_min(vals) >= {sy.VALUE_FLOOR} AND list_max(vals) <= {sy.VALUE_CAP} AND {_no_leak('prompt', 'vals')}
    AND NOT regexp_matches(prompt, {Q(P.DECOMPOSITION_MARKERS)}) AND len(dvals) = distractors),
tasks AS MATERIALIZED (
  SELECT concat({Q(f'{sy.FAMILY}::{sy.VERSION}::')}, substr(sha256(concat({Q(sy.FAMILY + sy.VERSION)}, seed, '[(''depth'', ', depth, '), (''distractors'', ',
      distractors, ')]', prompt, v)), 1, 12)) AS task_id, seed, depth, distractors, CAST(a AS INTEGER) AS attempt, CAST(v AS VARCHAR) AS answer, prompt
  FROM valid WHERE nth = 1)"""


CHAIN_SQL = f"""
SELECT task_id, seed, depth, distractors, attempt, answer AS canonical_terminal_answer, CAST(depth - 1 AS BIGINT) AS n_ops,
  CAST(length(prompt) AS INTEGER) AS prompt_chars, {sql_tokens('prompt')} AS v_star_input_tokens, {sql_tokens('answer')} AS v_star_output_tokens, 'ok' AS status
FROM tasks
"""


def ledger_tasks_ctes(source: str, with_chain: bool, family: str) -> str:
    """``tasks`` from ``source`` (seed, a, depth, distractors; with a chain also v, vals, sents as its lead)."""
    p = sy.CELL_PRIME
    fifth = " * ".join(["(cc + j)"] * 5)
    days = sy.LEDGER_DAYS
    plain = f"concat('the ', names[i + 1], ' ', site, ' logged ', cells[i * days + d + 1], ' ', units)"
    entry = f"CASE WHEN i = 0 AND d = 0 THEN concat('the ', names[1], ' ', site, ' logged as many as the count above') ELSE {plain} END" if with_chain else plain
    parts = f"list_transform(range(0, g), lambda i: {entry})"
    day = (f"list_transform(range(0, days), lambda d: concat('On ', {_list(days)}[d + 1], ', ', array_to_string(({parts})[1:g - 1], ', '), ', while ', ({parts})[g], '.'))")
    lead = f"list_append(sents, {Q(sy.HYBRID_BRIDGE)})" if with_chain else "CAST([] AS VARCHAR[])"
    cells = f"""list_transform((list_filter(list_transform(range(0, g * days + 1), lambda j: (ca + cb * (({fifth}) % {p})) % {p}), lambda w: w < {p - 1}))[1:g * days], lambda w: w + 41)"""
    if with_chain:
        cells = f"list_concat([v], ({cells})[2:])"
    hidden = "list_concat(list_append(totals, diff), list_append(vals, v))" if with_chain else "list_append(totals, diff)"
    surface = "cells[2:]" if with_chain else "cells"
    own = ", v, vals, sents AS chain_sents" if with_chain else ""
    pool = "list_filter(range(3, 251), lambda p: NOT list_contains(list_concat(cells, hidden), p))"
    place = _placed(
        "ledger_drawn", "ledger_placed", lambda old, j: f"n_lead + 2 + {_ledger_draw(f'len({old}) - n_lead', repr('dpos'), str(j))}",
        lambda d, j: _text(sy.LEDGER_DISTRACTOR, d=d, units="units", site="site", g=f"names[{_ledger_draw('g', repr('dgroup'), str(j))} + 1]"),
    )
    bounds = f" AND list_min(vals) >= {sy.VALUE_FLOOR} AND list_max(vals) <= {sy.VALUE_CAP}" if with_chain else ""
    return f"""
ledger0 AS (
  SELECT seed, a, depth, distractors{own}, {lead} AS lead_s, 2 + {_ledger_draw(2, "'n_groups'")} AS g, least(depth, {len(days)}) AS days,
    {_list(sy.LEDGER_SITES)}[{_ledger_draw(len(sy.LEDGER_SITES), "'site'")} + 1] AS site, {_list(sy.LEDGER_UNITS)}[{_ledger_draw(len(sy.LEDGER_UNITS), "'units'")} + 1] AS units,
    {_ledger_draw(5, "'names_a'")} AS na, 1 + {_ledger_draw(4, "'names_b'")} AS nb, {_ledger_draw(p, "'cells_a'")} AS ca, 1 + {_ledger_draw(p - 1, "'cells_b'")} AS cb,
    {_ledger_draw(p, "'cells_c'")} AS cc FROM {source}),
ledger1 AS (SELECT *, list_transform(range(0, g), lambda j: {_list(sy.LEDGER_GROUPS)}[(na + nb * j) % 5 + 1]) AS names, {cells} AS cells FROM ledger0),
ledger2 AS (
  SELECT *, list_transform(range(0, g), lambda i: CAST(list_sum(cells[i * days + 1:(i + 1) * days]) AS BIGINT)) AS totals FROM ledger1),
ledger3 AS (SELECT *, list_max(totals) - list_min(totals) AS diff FROM ledger2),
ledger4 AS (SELECT *, {hidden} AS hidden, {surface} AS seen, {day} AS day_s FROM ledger3),
ledger AS (SELECT *{' EXCLUDE (chain_sents)' if with_chain else ''}, list_concat(lead_s, day_s) AS sents, len(lead_s) AS n_lead FROM ledger4),
{_picked("ledger", pool, _ledger_draw, "ledger_drawn").strip()},
{place},
ledger_said AS (SELECT *, array_to_string(list_append(s2, {_text(sy.LEDGER_QUESTION, units='units', site='site')}), ' ') AS prompt FROM ledger_placed),
ledger_valid AS (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY a) AS nth FROM ledger_said
  WHERE len(list_distinct(totals)) = g AND diff >= 2 AND len(list_intersect(hidden, seen)) = 0 AND {_no_leak('prompt', 'hidden')}
    AND NOT regexp_matches(prompt, {Q(P.DECOMPOSITION_MARKERS)}) AND len(dvals) = distractors{bounds}),
ledger_tasks AS (
  SELECT concat({Q(f'{family}::{sy.VERSION}::')}, substr(sha256(concat({Q(family + sy.VERSION)}, seed, '[(''depth'', ', depth, '), (''distractors'', ',
      distractors, ')]', prompt, diff)), 1, 12)) AS task_id, seed, depth, distractors, CAST(a AS INTEGER) AS attempt, CAST(g AS INTEGER) AS n_groups,
    CAST(days AS INTEGER) AS n_days, CAST(diff AS VARCHAR) AS canonical_terminal_answer, CAST(length(prompt) AS INTEGER) AS prompt_chars,
    {sql_tokens('prompt')} AS v_star_input_tokens, 'ok' AS status
  FROM ledger_valid WHERE nth = 1)"""


def chain_oracle(seeds: str) -> str:
    return f"WITH RECURSIVE {chain_tasks_ctes(seeds)}{CHAIN_SQL}"


def ledger_oracle(seeds: str) -> str:
    return f"""WITH RECURSIVE seeds AS ({seeds}),
tries AS (SELECT s.*, t.a FROM seeds s, (SELECT unnest(range({sy.MAX_ATTEMPTS})) AS a) t),{ledger_tasks_ctes('tries', False, sy.LEDGER_FAMILY)}
SELECT * FROM ledger_tasks"""


def hybrid_oracle(seeds: str) -> str:
    return f"""WITH RECURSIVE {chain_ctes(seeds)},{ledger_tasks_ctes('chain', True, sy.HYBRID_FAMILY)}
SELECT * EXCLUDE (v_star_input_tokens), concat('hybrid_chain+table_d', depth) AS difficulty_bucket FROM ledger_tasks"""
