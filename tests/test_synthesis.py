"""Task synthesis against an independent plain-Python generator on a small table."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from costwise.operators import synth as sy

SF = "/root/testdata/sf0.001"
CAP = 500_000


def keyed(namespace, m, *parts):
    return int(hashlib.md5("|".join(map(str, (namespace, *parts))).encode()).hexdigest()[:15], 16) % m


def draw(m, *parts):
    return keyed(sy.NAMESPACE, m, *parts)


def picked(pool, n, pick):
    got = []
    for j in range(min(n, len(pool))):
        got.append(pool.pop(pick(len(pool), j)))
    return got


def numbers(prompt):
    """The runs of digits and dots that a reader of the prompt sees."""
    return set("".join(c if c in "0123456789." else " " for c in prompt).split())


def has_marker(prompt):
    """No narrative word begins like a marker, so its plain spelling is enough here."""
    return any(w in prompt.lower() for w in ("step ", "stage ", "sub-problem", "subproblem", "part a", "q1"))


def leaks(prompt, values):
    return [v for v in values if str(v) in numbers(prompt)]


def chain_part(seed, depth, a):
    place, items = sy.SCENARIOS[draw(len(sy.SCENARIOS), seed, a, "scenario")]
    tpl = draw(3, seed, a, "first")
    x, y = 20 + draw(60, seed, a, "a"), 20 + draw(60, seed, a, "b")
    v = 3 * x if tpl == 2 else x + y
    sents = [sy.FIRST_TEMPLATES[tpl].format(place=place, a=x, b=y, items=items)]
    vals, surface, ops = [v], [x, y], []
    for i in range(1, depth):
        loss_hi = min(96, v - 2)
        scale_ks = [k for k in range(2, 10) if v * k <= CAP]
        split_ks = [k for k in range(2, 13) if v % k == 0 and v // k >= 2]
        ok = {"gain": v + 96 <= CAP, "loss": loss_hi >= 7, "scale": bool(scale_ks), "split": bool(split_ks)}
        cands = [o for o in ("gain", "loss", "scale", "split") if ok[o]]
        op = cands[draw(len(cands), seed, a, "op", i)]
        if op == "gain":
            k = 13 + draw(84, seed, a, "k", i); v += k
        elif op == "loss":
            k = 7 + draw(loss_hi - 6, seed, a, "k", i); v -= k
        elif op == "scale":
            k = scale_ks[draw(len(scale_ks), seed, a, "k", i)]; v *= k
        else:
            k = split_ks[draw(len(split_ks), seed, a, "k", i)]; v //= k
        vals.append(v); surface.append(k); ops.append((op, k))
        sents.append(sy.OP_TEMPLATES[op].format(k=k, items=items))
    return place, items, sents, vals, surface, ops


def attempt(seed, depth, n_dist, a):
    place, items, sents, vals, surface, ops = chain_part(seed, depth, a)
    v = vals[-1]
    forbidden = set(vals) | set(surface)
    pool = [c for c in range(11, 100) if c not in forbidden]
    dvals = picked(pool, n_dist, lambda size, j: draw(size, seed, a, "dval", j))
    for j, d in enumerate(dvals):
        pos = 2 + draw(len(sents), seed, a, "dpos", j)
        sents.insert(pos - 1, sy.DISTRACTOR_TEMPLATE.format(place=place, d=d, items=items))
    prompt = " ".join(sents + [sy.QUESTION.format(items=items)])
    valid = (all(2 <= w <= CAP for w in vals) and not leaks(prompt, vals) and len(dvals) == n_dist)
    return valid, prompt, str(v), ops, vals, dvals


def generate(seed, depth, n_dist):
    for a in range(sy.MAX_ATTEMPTS):
        valid, prompt, answer, ops, vals, dvals = attempt(seed, depth, n_dist, a)
        if valid:
            diff = f"[('depth', {depth}), ('distractors', {n_dist})]"
            digest = hashlib.sha256((sy.FAMILY + sy.VERSION + str(seed) + diff + prompt + answer).encode()).hexdigest()
            return (f"{sy.FAMILY}::{sy.VERSION}::{digest[:12]}", a, prompt, answer, ops, vals, dvals)
    return None


def test_generator_matches_plain_python(spark):
    p = spark.read.parquet(f"{SF}/part.parquet")
    seeds = p.select(F.col("p_partkey").alias("seed"), (F.lit(3) + F.col("p_partkey") % 8).cast("int").alias("depth"),
                     (F.col("p_size") % 3).cast("int").alias("distractors"))
    got = {r["seed"]: r for r in sy.synthesize_chains(seeds).collect()}
    assert len(got) == p.count()
    for r in seeds.collect():
        want = generate(r["seed"], r["depth"], r["distractors"])
        g = got[r["seed"]]
        assert g["status"] == "ok"
        assert (g["task_id"], g["attempt"], g["merged_prompt"], g["canonical_terminal_answer"]) == want[:4]
        assert [(o["name"], o["k"]) for o in g["ops"]] == want[4]
        assert list(g["values"]) == want[5] and list(g["distractor_values"]) == want[6]


def test_seed_grid_and_group_seed(spark):
    base = spark.createDataFrame([(1000,)], "seed0 bigint")
    grid = sy.seed_grid(base, [(3, 1), (6, 2)], 3).collect()
    assert sorted(r["seed"] for r in grid) == sorted(1000 + c * 100_003 + i * 2_027 for c in range(2) for i in range(3))
    g = spark.createDataFrame([(7, 2)], "run_seed bigint, i int").select(
        sy.paired_group_seed(F.col("run_seed"), F.col("i")).alias("g")).first()["g"]
    assert int(g) == int.from_bytes(hashlib.sha256(b"7|group|2").digest()[:8], "big")


def test_ledger_truth_and_narration(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    seeds = c.select(F.col("c_custkey").alias("seed"), (F.lit(2) + F.col("c_custkey") % 7).cast("int").alias("depth"),
                     (F.col("c_custkey") % 3).cast("int").alias("distractors"))
    rows = sy.synthesize_ledgers(seeds).collect()
    assert len(rows) == c.count() and all(r["status"] == "ok" for r in rows)
    for r in rows:
        g, d = r["n_groups"], r["n_days"]
        assert g in (2, 3) and d == min(r["depth"], 7)
        cells = list(r["cells"])
        assert len(set(cells)) == len(cells) == g * d and all(41 <= x <= 196 for x in cells)
        totals = [sum(cells[i * d:(i + 1) * d]) for i in range(g)]
        assert len(set(totals)) == g
        diff = max(totals) - min(totals)
        assert str(diff) == r["canonical_terminal_answer"] and diff >= 2
        numbers = re.findall(r"\d+", r["merged_prompt"])
        for x in cells:
            assert numbers.count(str(x)) == 1
        assert not leaks(r["merged_prompt"], totals + [diff]) and not has_marker(r["merged_prompt"])
        assert len(r["distractor_values"]) == r["distractors"]
        assert not set(r["distractor_values"]) & (set(cells) | set(totals) | {diff})


def test_end_to_end_calibration(spark):
    """generate -> respond -> score -> report, like the reference's CLI smoke test."""
    from costwise.operators.economics import dollars_summary
    from costwise.operators.scoring import calibration_responses, score

    s = spark.read.parquet(f"{SF}/supplier.parquet").select(
        F.col("s_suppkey").alias("seed"), F.lit(4).alias("depth"), F.lit(1).alias("distractors"))
    tasks = sy.synthesize_chains(s)
    results = score(tasks, calibration_responses(tasks))
    prices = spark.createDataFrame([(m, 1.0, 4.0) for m in ("echo_model", "verbose_echo_model", "wrong_echo_model")],
                                   "model string, price_in double, price_out double")
    d = {r["model"]: r for r in dollars_summary(results, prices).collect()}
    assert d["echo_model"]["accuracy"] == 1.0 and d["verbose_echo_model"]["accuracy"] == 1.0
    assert d["wrong_echo_model"]["accuracy"] == 0.0 and d["wrong_echo_model"]["dollars_per_correct"] is None
    by_model = {r[0]: r[1] for r in results.groupBy("model").agg(F.avg("efficiency")).collect()}
    assert by_model["verbose_echo_model"] < by_model["echo_model"] <= 1.0001
    assert by_model["wrong_echo_model"] is None


def _ldraw(m, *parts):
    return keyed(sy.LEDGER_NAMESPACE, m, *parts)


def names_and_cells(g, days, seed, a):
    start, step = _ldraw(5, seed, a, "names_a"), 1 + _ldraw(4, seed, a, "names_b")
    names = [sy.LEDGER_GROUPS[(start + step * j) % 5] for j in range(g)]
    p, q, r = _ldraw(157, seed, a, "cells_a"), 1 + _ldraw(156, seed, a, "cells_b"), _ldraw(157, seed, a, "cells_c")
    values = [v for v in ((p + q * pow(r + j, 5, 157)) % 157 for j in range(g * days + 1)) if v < 156]
    return names, [41 + v for v in values[: g * days]]


def ledger_attempt(seed, depth, n_dist, a):
    g = 2 + _ldraw(2, seed, a, "n_groups")
    days = min(depth, 7)
    site = sy.LEDGER_SITES[_ldraw(3, seed, a, "site")]
    units = sy.LEDGER_UNITS[_ldraw(3, seed, a, "units")]
    names, cells = names_and_cells(g, days, seed, a)
    totals = [sum(cells[i * days:(i + 1) * days]) for i in range(g)]
    diff = max(totals) - min(totals)
    hidden = totals + [diff]
    sents = []
    for d in range(days):
        parts = [f"the {names[i]} {site} logged {cells[i * days + d]} {units}" for i in range(g)]
        sents.append(f"On {sy.LEDGER_DAYS[d]}, {', '.join(parts[:-1])}, while {parts[-1]}.")
    forbidden = set(cells) | set(hidden)
    pool = [x for x in range(3, 251) if x not in forbidden]
    dvals = picked(pool, n_dist, lambda size, j: _ldraw(size, seed, a, "dval", j))
    for j, d in enumerate(dvals):
        pos = 2 + _ldraw(len(sents), seed, a, "dpos", j)
        grp = names[_ldraw(g, seed, a, "dgroup", j)]
        sents.insert(pos - 1, sy.LEDGER_DISTRACTOR.format(d=d, units=units, g=grp, site=site))
    prompt = " ".join(sents + [sy.LEDGER_QUESTION.format(units=units, site=site)])
    valid = (len(set(totals)) == g and diff >= 2 and not set(hidden) & set(cells)
             and not leaks(prompt, hidden) and not has_marker(prompt) and len(dvals) == n_dist)
    return valid, prompt, str(diff), cells, dvals


def test_ledger_generator_matches_plain_python(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    seeds = c.select(F.col("c_custkey").alias("seed"), (F.lit(2) + F.col("c_custkey") % 7).cast("int").alias("depth"),
                     (F.col("c_custkey") % 3).cast("int").alias("distractors"))
    got = {r["seed"]: r for r in sy.synthesize_ledgers(seeds).collect()}
    for r in seeds.collect():
        for a in range(sy.MAX_ATTEMPTS):
            valid, prompt, answer, cells, dvals = ledger_attempt(r["seed"], r["depth"], r["distractors"], a)
            if valid:
                break
        g = got[r["seed"]]
        assert (g["attempt"], g["merged_prompt"], g["canonical_terminal_answer"]) == (a, prompt, answer)
        assert list(g["cells"]) == cells and list(g["distractor_values"]) == dvals


def hybrid_attempt(seed, depth, n_dist, a):
    _place, items, chain_sents, vals, _surface, ops = chain_part(seed, depth, a)
    upstream = vals[-1]
    lead = chain_sents + [sy.HYBRID_BRIDGE]
    g = 2 + _ldraw(2, seed, a, "n_groups")
    days = min(depth, 7)
    site = sy.LEDGER_SITES[_ldraw(3, seed, a, "site")]
    units = sy.LEDGER_UNITS[_ldraw(3, seed, a, "units")]
    names, cells = names_and_cells(g, days, seed, a)
    cells = [upstream, *cells[1:]]
    totals = [sum(cells[i * days:(i + 1) * days]) for i in range(g)]
    diff = max(totals) - min(totals)
    hidden = totals + [diff, upstream] + vals
    sents = list(lead)
    for d in range(days):
        parts = [f"the {names[i]} {site} logged as many as the count above" if (i == 0 and d == 0)
                 else f"the {names[i]} {site} logged {cells[i * days + d]} {units}" for i in range(g)]
        sents.append(f"On {sy.LEDGER_DAYS[d]}, {', '.join(parts[:-1])}, while {parts[-1]}.")
    forbidden = set(cells) | set(hidden)
    pool = [x for x in range(3, 251) if x not in forbidden]
    dvals = picked(pool, n_dist, lambda size, j: _ldraw(size, seed, a, "dval", j))
    for j, dv in enumerate(dvals):
        pos = len(lead) + 2 + _ldraw(len(sents) - len(lead), seed, a, "dpos", j)
        grp = names[_ldraw(g, seed, a, "dgroup", j)]
        sents.insert(pos - 1, sy.LEDGER_DISTRACTOR.format(d=dv, units=units, g=grp, site=site))
    prompt = " ".join(sents + [sy.LEDGER_QUESTION.format(units=units, site=site)])
    valid = (len(set(totals)) == g and diff >= 2 and not set(hidden) & set(cells[1:])
             and not leaks(prompt, hidden) and not has_marker(prompt) and len(dvals) == n_dist
             and all(2 <= w <= CAP for w in vals))
    return valid, prompt, str(diff), cells, dvals, ops


def test_hybrid_generator_matches_plain_python(spark):
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    seeds = s.select(F.col("s_suppkey").alias("seed"), (F.lit(3) + F.col("s_suppkey") % 8).cast("int").alias("depth"),
                     (F.col("s_suppkey") % 3).cast("int").alias("distractors"))
    got = {r["seed"]: r for r in sy.synthesize_hybrids(seeds).collect()}
    for r in seeds.collect():
        for a in range(sy.MAX_ATTEMPTS):
            valid, prompt, answer, cells, dvals, ops = hybrid_attempt(r["seed"], r["depth"], r["distractors"], a)
            if valid:
                break
        g = got[r["seed"]]
        assert (g["attempt"], g["merged_prompt"], g["canonical_terminal_answer"]) == (a, prompt, answer)
        assert list(g["cells"]) == cells and list(g["distractor_values"]) == dvals
        assert [(o["name"], o["k"]) for o in g["ops"]] == ops


def test_seeds_of_one_block_are_dealt_over_the_tasks(spark):
    """A table that is read by one task gave all of its synthesis to that task."""
    seeds = spark.range(1, 41, 1, 1).select(
        F.col("id").alias("seed"), F.lit(4).alias("depth"), F.lit(1).alias("distractors"))
    groups = seeds.select(F.col("seed").alias("group_seed"))
    sets = {
        "chains": sy.synthesize_chains(seeds), "ledgers": sy.synthesize_ledgers(seeds), "hybrids": sy.synthesize_hybrids(seeds),
        "paired": sy.paired_ladder(groups, [3, 6]), "paired hybrids": sy.paired_hybrid_ladder(groups, [3, 6]),
    }
    for name, tasks in sets.items():
        sizes = [r["count"] for r in tasks.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 4 and max(sizes) <= sum(sizes) / 2, (name, sizes)


def test_sentences_read_as_formatted(spark):
    row = spark.range(1).select(
        sy._fmt("{b}% of {a} and {b}", a=F.lit(5), b=F.lit("x")).alias("t"), sy._fmt("{a}!", a=F.lit(None)).alias("n")).first()
    assert (row.t, row.n) == ("x% of 5 and x", "null!")
