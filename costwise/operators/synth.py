"""Bulk task-set synthesis as one Spark job.

Every task is a pure function of (seed, depth, distractors, attempt): random
choices are keyed draws, ``md5(namespace|seed|attempt|scope|step)``, never
``rand()``, so regeneration is exact, any partitioning gives the same rows and
any engine can compute the same draws.
A chain is one native fold (``aggregate`` over ``sequence(1, depth - 1)``)
carrying the running value, the op log, the hidden values and the sentences.

The wording and the draw scheme are this library's own (version namespace
below); the arithmetic rules follow the reference family.

Fixed values that must equal the reference for identical results:
  value cap 500,000 and floor 2 for every running value
  gain k in 13..96, only while v + 96 <= cap
  loss k in 7..min(96, v - 2), only while that range is non-empty
  scale k in 2..9 with v * k <= cap
  split k in 2..12 with v divisible by k and v // k >= 2
  first step: a + b (two templates) or a + 2a (one template)
  up to 25 attempts per seed
  seed grid: seed0 + cell_index * 100003 + i * 2027
"""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwise.functions.text import has_decomposition_marker, heuristic_tokens, leaked_values

FAMILY = "cw_chain"
VERSION = "1.0.0"
NAMESPACE = f"{FAMILY}/{VERSION}"
VALUE_CAP = 500_000
VALUE_FLOOR = 2
MAX_ATTEMPTS = 25

SCENARIOS = [
    ("archive", "folders"), ("aquarium", "snails"), ("foundry", "ingots"),
    ("apiary", "frames"), ("tannery", "hides"), ("observatory", "plates"),
]
# The start is x + y, x + y, or x and twice x again: what the openings have in common is the arithmetic alone.
FIRST_TEMPLATES = [
    "Ledger of the {place}: {a} {items} stood there when it opened, and a cart brought {b} further ones.",
    "Shelf one of the {place} holds {a} {items}, shelf two holds {b}, and both are counted together.",
    "The {place} starts with {a} {items} and then receives twice as many again, all of which are kept.",
]
# Only op sentences begin so: the paired ladder drops those past a rung by it.
OP_OPENING = "Next, "
OP_TEMPLATES = {
    "gain": OP_OPENING + "a delivery raises the count by {k} {items}.",
    "loss": OP_OPENING + "an order lowers the count by {k} {items}.",
    "scale": OP_OPENING + "the count grows to {k} times what it was.",
    "split": OP_OPENING + "the count is cut into {k} equal lots, of which a single lot remains the count.",
}
DISTRACTOR_TEMPLATE = "Elsewhere, unrelated to this count, another {place} owns {d} {items}."
QUESTION = "State the final count of {items} as one integer and nothing else."


def seed_grid(base: DataFrame, cells: Sequence[tuple[int, int]], n_per_cell: int, seed0_col: str = "seed0") -> DataFrame:
    """K1: (seed, depth, distractors) for every cell x i of every base row.

    ``base`` holds one run seed per row (a run table); cells and counts are
    exploded as generators, so the grid is a projection, not a join."""
    cell_arr = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(d).alias("depth"), F.lit(x).alias("distractors"))
                         for i, (d, x) in enumerate(cells)])
    g = base.select(F.col(seed0_col).cast("bigint").alias("seed0"), F.explode(cell_arr).alias("cell"))
    g = g.select("seed0", "cell.*", F.explode(F.sequence(F.lit(0), F.lit(n_per_cell - 1))).alias("i"))
    return g.select(
        (F.col("seed0") + F.col("c") * 100_003 + F.col("i") * 2_027).alias("seed"),
        "depth", "distractors",
    )


def paired_group_seed(run_seed: Column, i: Column) -> Column:
    """First 8 bytes (big-endian, unsigned) of sha256('<run_seed>|group|<i>') as DECIMAL(20,0)."""
    h = F.sha2(F.concat_ws("|", run_seed.cast("string"), F.lit("group"), i.cast("string")), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")


def keyed_draw(m: Column | int, *parts: Column | str) -> Column:
    """K2: a stable draw in [0, m) keyed by the parts (``draw`` under the chain's namespace)."""
    return draw(NAMESPACE, m, *parts)


def draw(namespace: str, m: Column | int, *parts: Column | str) -> Column:
    """A draw in [0, m): the first 60 bits of the MD5 of the namespace and the parts, joined by ``|``, modulo m.

    Built-in functions that every SQL engine has, so an oracle computes the same draws; no state, no seed to pass on."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(namespace), *cols)), 1, 15), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(m).cast("bigint") if isinstance(m, int) else m.cast("bigint"))


def draw_distinct(pool: Column, n: Column, pick) -> Column:
    """n different elements of ``pool``, the j-th by ``pick(size, j)`` among those left: n draws, nothing is sorted.
    Fewer if the pool is smaller."""
    kind = "array<bigint>"
    state = F.struct(pool.cast(kind).alias("left"), F.array().cast(kind).alias("got"))

    def take(s: Column, j: Column) -> Column:
        one = lambda v: F.struct(F.array_remove(s["left"], v).alias("left"), F.concat(s["got"], F.array(v)).alias("got"))
        chosen = F.element_at(s["left"], (pick(F.size(s["left"]), j) + 1).cast("int"))
        return F.when(F.size(s["left"]) > 0, let(chosen, one)).otherwise(s)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), state, take)["got"]).otherwise(F.array().cast(kind))


_FOLDS: dict[tuple[str, str], Column] = {}


def _first_valid_fold(kind: str, base: DataFrame, attempt_fn) -> Column:
    """The 'first valid attempt' fold for one family, built once per application.

    The expression tree is large and building it costs thousands of calls into
    the JVM; it only refers to columns by name (seed, depth, distractors), so
    one Column serves every DataFrame of the session."""
    key = (kind, base.sparkSession.sparkContext.applicationId)
    if key not in _FOLDS:
        found_type = base.limit(0).select(attempt_fn(F.lit(0)).alias("x")).schema["x"].dataType
        none = F.lit(None).cast(found_type)
        _FOLDS[key] = F.aggregate(
            F.sequence(F.lit(0), F.lit(MAX_ATTEMPTS - 1)), none,
            lambda acc, a: F.when(acc.isNotNull(), acc).otherwise(
                let(attempt_fn(a), lambda x: F.when(x["valid"], x).otherwise(none))),
        )
    return _FOLDS[key]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a one-element transform):
    lambdas get no common-subexpression elimination, so a value used many
    times is computed once this way instead of being inlined at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later projections read many times.

    The value goes through a generator (explode of a one-element array), which
    the optimizer does not inline into its consumers, so it is evaluated once
    per row however many fields of it are used downstream."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _fmt(template: str, **cols: Column) -> Column:
    """A str.format-style template with named Column slots; a NULL slot reads ``null``, as in format_string.

    The pieces are concatenated: no format is parsed again for every sentence."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            pieces.append(F.coalesce(cols[name].cast("string"), F.lit("null")))
    return F.concat(*pieces)


def dealt(seeds: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as the session has shuffle partitions, or cores if it has more.

    A task set is much work on few bytes: a file that one task reads as one block holds seeds for hours, and how a
    file is cut does not tell where its blocks lie. Rows that come from no file and are split as far stay where they are."""
    spark = seeds.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not seeds.inputFiles() and seeds.rdd.getNumPartitions() >= n:
        return seeds
    return seeds.repartition(n)


def _chain(seed: Column, attempt: Column, depth: Column, place: Column, items: Column) -> Column:
    """K3: the chain fold. Draws are keyed by (seed, attempt, scope, step) and do
    not depend on the distractor count (distractors never change the chain)."""
    draws = F.struct(
        keyed_draw(len(FIRST_TEMPLATES), seed, attempt, "first").alias("tpl"),
        (F.lit(20) + keyed_draw(60, seed, attempt, "a")).alias("a"),
        (F.lit(20) + keyed_draw(60, seed, attempt, "b")).alias("b"),
    )

    def opening(s: Column) -> Column:
        tpl, a, b = s["tpl"], s["a"], s["b"]
        v0 = F.when(tpl == 2, a * 3).otherwise(a + b).cast("bigint")
        first = F.when(tpl == 0, _fmt(FIRST_TEMPLATES[0], place=place, a=a, items=items, b=b)) \
            .when(tpl == 1, _fmt(FIRST_TEMPLATES[1], place=place, a=a, b=b, items=items)) \
            .otherwise(_fmt(FIRST_TEMPLATES[2], place=place, a=a, items=items))
        return F.struct(
            v0.alias("v"),
            F.array(v0).alias("vals"),
            F.array(a.cast("bigint"), b.cast("bigint")).alias("surface"),
            F.array().cast("array<struct<name:string,k:bigint>>").alias("ops"),
            first.alias("first"),
        )

    init = let(draws, opening)
    steps = F.filter(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda s: s <= depth - 1)

    def step(acc: Column, i: Column) -> Column:
        v = acc["v"]
        top_scale = F.least(F.lit(9).cast("bigint"), F.floor(F.lit(VALUE_CAP) / v).cast("bigint"))
        rules = F.struct(
            F.least(F.lit(96).cast("bigint"), v - 2).alias("loss_hi"),
            F.when(top_scale >= 2, F.sequence(F.lit(2).cast("bigint"), top_scale))
            .otherwise(F.array().cast("array<bigint>")).alias("scale_ks"),
            F.filter(F.sequence(F.lit(2).cast("bigint"), F.lit(12).cast("bigint")),
                     lambda k: (F.pmod(v, k) == 0) & (F.floor(v / k) >= 2)).alias("split_ks"),
        )

        def choose(r: Column) -> Column:
            none = F.array().cast("array<string>")
            cands = F.concat(
                F.when(v + 96 <= VALUE_CAP, F.array(F.lit("gain"))).otherwise(none),
                F.when(r["loss_hi"] >= 7, F.array(F.lit("loss"))).otherwise(none),
                F.when(F.size(r["scale_ks"]) > 0, F.array(F.lit("scale"))).otherwise(none),
                F.when(F.size(r["split_ks"]) > 0, F.array(F.lit("split"))).otherwise(none),
            )
            op = F.element_at(cands, (keyed_draw(F.size(cands), seed, attempt, "op", i) + 1).cast("int"))
            return let(F.struct(op.alias("op"), r["loss_hi"].alias("loss_hi"), r["scale_ks"].alias("scale_ks"),
                                r["split_ks"].alias("split_ks")), pick_k)

        def pick_k(c: Column) -> Column:
            op = c["op"]
            kd = lambda m: keyed_draw(m, seed, attempt, "k", i)
            k = (
                F.when(op == "gain", 13 + kd(84))
                .when(op == "loss", 7 + kd(c["loss_hi"] - 6))
                .when(op == "scale", F.element_at(c["scale_ks"], (kd(F.size(c["scale_ks"])) + 1).cast("int")))
                .otherwise(F.element_at(c["split_ks"], (kd(F.size(c["split_ks"])) + 1).cast("int")))
            ).cast("bigint")
            return let(F.struct(op.alias("op"), k.alias("k")), apply)

        def apply(d: Column) -> Column:
            op, k = d["op"], d["k"]
            nv = (
                F.when(op == "gain", v + k).when(op == "loss", v - k).when(op == "scale", v * k)
                .otherwise(((v - F.pmod(v, k)).cast("decimal(38,0)") / k.cast("decimal(38,0)")).cast("bigint"))
            )
            return let(nv, lambda x: F.struct(
                x.alias("v"),
                F.concat(acc["vals"], F.array(x)).alias("vals"),
                F.concat(acc["surface"], F.array(k)).alias("surface"),
                F.concat(acc["ops"], F.array(F.struct(op.alias("name"), k.alias("k")))).alias("ops"),
                acc["first"].alias("first"),
            ))

        return let(rules, choose)

    return F.aggregate(steps, init, step)


def _sentences(chain: Column, items: Column) -> Column:
    """First sentence, then one sentence per logged op (formatted after the fold)."""
    def say(o: Column) -> Column:
        k = o["k"]
        return (
            F.when(o["name"] == "gain", _fmt(OP_TEMPLATES["gain"], k=k, items=items))
            .when(o["name"] == "loss", _fmt(OP_TEMPLATES["loss"], k=k, items=items))
            .when(o["name"] == "scale", _fmt(OP_TEMPLATES["scale"], k=k))
            .otherwise(_fmt(OP_TEMPLATES["split"], k=k))
        )

    return F.concat(F.array(chain["first"]), F.transform(chain["ops"], say))


def _distractors(sents: Column, n: Column, forbidden: Column, seed: Column, attempt: Column,
                 place: Column, items: Column) -> Column:
    """K6: struct(sents, values): n distractor sentences whose values avoid the
    forbidden set, inserted at keyed positions after the first sentence."""
    pool = F.array_except(F.sequence(F.lit(11).cast("bigint"), F.lit(99).cast("bigint")), forbidden)

    def insert_all(values: Column) -> Column:
        init = F.struct(sents.alias("s"), F.lit(0).alias("j"))

        def ins(acc: Column, d: Column) -> Column:
            pos = (F.lit(2) + keyed_draw(F.size(acc["s"]), seed, attempt, "dpos", acc["j"])).cast("int")
            sent = _fmt(DISTRACTOR_TEMPLATE, place=place, d=d, items=items)
            return F.struct(F.array_insert(acc["s"], pos, sent).alias("s"), (acc["j"] + 1).alias("j"))

        return F.struct(F.aggregate(values, init, ins)["s"].alias("sents"), values.alias("values"))

    return let(draw_distinct(pool, n, lambda size, j: keyed_draw(size, seed, attempt, "dval", j)), insert_all)


def _setting(seed: Column, a: Column) -> Column:
    """The scene of an attempt, struct(place, items): one draw."""
    scenes = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(i).alias("items")) for p, i in SCENARIOS])
    return F.element_at(scenes, (keyed_draw(len(SCENARIOS), seed, a, "scenario") + 1).cast("int"))


def _attempt(a: Column) -> Column:
    """One attempt of the current row's (seed, depth, distractors) as a struct with
    its validity (K12 rules: bounds, no hidden value visible, no marker)."""
    seed, depth, dist = F.col("seed"), F.col("depth"), F.col("distractors")
    setting = _setting(seed, a)

    def with_setting(st: Column) -> Column:
        return let(_chain(seed, a, depth, st["place"], st["items"]), lambda ch: with_chain(st, ch))

    def with_chain(st: Column, ch: Column) -> Column:
        forbidden = F.array_union(ch["vals"], ch["surface"])
        dd = _distractors(_sentences(ch, st["items"]), dist, forbidden, seed, a, st["place"], st["items"])
        return let(dd, lambda d: with_text(st, ch, d))

    def with_text(st: Column, ch: Column, d: Column) -> Column:
        prompt = F.array_join(F.concat(d["sents"], F.array(_fmt(QUESTION, items=st["items"]))), " ")
        return let(prompt, lambda pr: F.struct(
            a.cast("int").alias("attempt"),
            ch.alias("chain"),
            d["values"].alias("distractor_values"),
            pr.alias("merged_prompt"),
            (F.forall(ch["vals"], lambda x: (x >= VALUE_FLOOR) & (x <= VALUE_CAP))
             & (F.size(leaked_values(pr, ch["vals"])) == 0)
             & ~has_decomposition_marker(pr)
             & (F.size(d["values"]) == dist)).alias("valid"),
        ))

    return let(setting, with_setting)


def synthesize_chains(seeds: DataFrame) -> DataFrame:
    """K3 + K6 + K9: one task per (seed, depth, distractors) row.

    A seed's attempts stay inside its own row: a fold over attempts 0..24
    keeps the first valid attempt, and once one is found the remaining steps
    return it unchanged without building another attempt (CASE is lazy). The
    work is the attempts actually needed, the attempt expression appears once
    in the plan, and the job is one narrow projection (no shuffle). Seeds that
    never validate are kept with ``status = 'rejected'``."""
    base = dealt(seeds.select("seed", "depth", "distractors"))
    w = once(base, "w", _first_valid_fold("chain", base, _attempt))
    tasks = _finish_tasks(w.select("seed", "depth", "distractors", "w.*"))
    return tasks.withColumn("status", F.when(F.col("attempt").isNull(), "rejected").otherwise("ok"))


def _finish_tasks(w: DataFrame) -> DataFrame:
    answer = F.col("chain.v").cast("string")
    difficulty = F.format_string("[('depth', %d), ('distractors', %d)]", F.col("depth"), F.col("distractors"))
    digest = F.sha2(F.concat(F.lit(FAMILY), F.lit(VERSION), F.col("seed").cast("string"), difficulty,
                             F.col("merged_prompt"), answer), 256)
    return w.select(
        F.concat(F.lit(f"{FAMILY}::{VERSION}::"), F.substring(digest, 1, 12)).alias("task_id"),
        "seed", "depth", "distractors", "attempt",
        F.lit(VERSION).alias("generator_version"),
        F.lit("chain").alias("template_id"),
        "merged_prompt",
        answer.alias("canonical_terminal_answer"),
        F.col("chain.ops").alias("ops"),
        F.col("chain.vals").alias("values"),
        F.col("chain.surface").alias("surface_numbers"),
        "distractor_values",
        F.element_at("chain.vals", 1).alias("start_value"),
        heuristic_tokens(F.col("merged_prompt")).alias("v_star_input_tokens"),
        heuristic_tokens(answer).alias("v_star_output_tokens"),
        F.concat(F.lit("depth_"), F.col("depth").cast("string")).alias("difficulty_bucket"),
    )


def paired_ladder(groups: DataFrame, depths: Sequence[int], distractors: int = 2) -> DataFrame:
    """K8: one base problem per group, expanded to one task per rung by prefix.

    The chain is folded once at the deepest rung (validity checked there: a
    rung's prompt only drops sentences and hidden values, so it cannot leak
    what the deepest prompt does not); rungs are an ``explode`` with ``slice``
    of the shared op log, the distractor values are shared by the group.
    ``groups``: (group_seed)."""
    max_depth = max(depths)
    base = groups.select(F.col("group_seed").alias("seed"), F.lit(max_depth).alias("depth"),
                         F.lit(distractors).alias("distractors"))
    deep = synthesize_chains(base).filter(F.col("status") == "ok")
    rung = F.explode(F.array(*[F.lit(d) for d in sorted(depths)])).alias("rung")
    # split the deepest prompt into numbered sentences once per group, then fan out the rungs
    sents = F.split(F.col("merged_prompt"), "(?<=\\.) ")
    numbered = F.transform(sents, lambda x, i: F.struct(x.alias("s"), i.alias("i"), x.startswith(OP_OPENING).alias("op")))
    base = deep.select(F.col("seed").alias("group_seed"), "attempt", "ops", "values", "distractor_values",
                       "merged_prompt")
    base = once(base, "numbered", numbered)
    op_idx = once(base, "op_idx", F.transform(F.filter("numbered", lambda e: e["op"]), lambda e: e["i"]))
    t = op_idx.select("group_seed", "attempt", "ops", "values", "distractor_values", "numbered", "op_idx", rung)
    ops = F.slice("ops", 1, F.col("rung") - 1)
    answer = F.element_at("values", F.col("rung")).cast("string")
    # the rung's prompt: deepest prompt without the sentences of the ops past the rung
    t = t.withColumn("drop_from", F.try_element_at("op_idx", F.col("rung")))
    kept = F.filter("numbered", lambda e: F.col("drop_from").isNull() | ~e["op"] | (e["i"] < F.col("drop_from")))
    prompt = F.array_join(F.transform(kept, lambda e: e["s"]), " ")
    return t.select(
        "group_seed", F.col("rung").alias("depth"), "attempt", ops.alias("ops"),
        F.slice("values", 1, F.col("rung")).alias("values"), "distractor_values",
        prompt.alias("merged_prompt"), answer.alias("canonical_terminal_answer"),
    )


# ---------------------------------------------------------------------------
# Ledger tasks (K4, K5, K11): groups x days of distinct cells, narrated by day;
# the answer is the highest group total minus the lowest.
#
# Fixed values that must equal the reference for identical results:
#   2 or 3 groups; days capped at 7; cells distinct in 41..196
#   reject: tied group totals, a difference below 2, a total or the difference
#   equal to a visible cell; distractor values in 3..250 outside every cell,
#   total and the difference
LEDGER_FAMILY = "cw_ledger"
LEDGER_NAMESPACE = f"{LEDGER_FAMILY}/{VERSION}"
LEDGER_GROUPS = ["Alder", "Birch", "Cedar", "Maple", "Rowan"]
LEDGER_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
LEDGER_SITES = ["gallery", "reading room", "swimming hall"]
LEDGER_UNITS = ["visitors", "guests", "children"]
LEDGER_DISTRACTOR = "Not for this log: {d} {units} walked past the {g} {site}."
LEDGER_QUESTION = (
    "Add up each {site} over the days given. How many more {units} did the busiest one have than the quietest? Give the bare integer."
)
#: Cells are 41 + v with v below 156, in the order of a permutation of the residues of this prime.
CELL_PRIME = 157


def _ldraw(m, *parts) -> Column:
    return draw(LEDGER_NAMESPACE, m, *parts)


def _cells(n: Column, seed: Column, a: Column) -> Column:
    """n distinct cells in 41..196: c + j goes to A + B (c + j)^5 modulo the prime, which is a permutation (5 does not
    divide 156), so the first n + 1 places hold n values in range; nothing is drawn twice or sorted."""
    key = F.struct(*[
        (low + _ldraw(m, seed, a, f"cells_{k}")).alias(k) for k, low, m in (("a", 0, CELL_PRIME), ("b", 1, CELL_PRIME - 1), ("c", 0, CELL_PRIME))
    ])

    def at(k: Column, j: Column) -> Column:
        x = k["c"] + j
        return F.pmod(k["a"] + k["b"] * F.pmod(x * x * x * x * x, F.lit(CELL_PRIME)), F.lit(CELL_PRIME))

    return let(key, lambda k: F.transform(
        F.slice(F.filter(F.transform(F.sequence(F.lit(0), n), lambda j: at(k, j)), lambda v: v < CELL_PRIME - 1), F.lit(1), n),
        lambda v: v + 41,
    ))


def _names(n: Column, seed: Column, a: Column) -> Column:
    """n distinct group names: steps of one length around the five."""
    size = len(LEDGER_GROUPS)
    key = F.struct(_ldraw(size, seed, a, "names_a").alias("a"), (1 + _ldraw(size - 1, seed, a, "names_b")).alias("b"))
    return let(key, lambda k: F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.element_at(F.array(*map(F.lit, LEDGER_GROUPS)), (F.pmod(k["a"] + k["b"] * j, F.lit(size)) + 1).cast("int")),
    ))


def _ledger_attempt(a: Column, upstream: Column | None = None, lead: Column | None = None,
                    lead_hidden: Column | None = None, depth: Column | None = None) -> Column:
    """One ledger attempt. With ``upstream`` (K7) the first group's first cell is
    that value, narrated by reference ("as many as the count above")
    instead of by number; ``lead`` sentences go first and ``lead_hidden`` joins
    the hidden values."""
    seed, dist = F.col("seed"), F.col("distractors")
    depth = F.col("depth") if depth is None else depth
    setting = F.struct(
        (F.lit(2) + _ldraw(2, seed, a, "n_groups")).cast("int").alias("g"),
        F.least(depth, F.lit(len(LEDGER_DAYS))).cast("int").alias("days"),
        F.element_at(F.array(*map(F.lit, LEDGER_SITES)), (_ldraw(len(LEDGER_SITES), seed, a, "site") + 1).cast("int")).alias("site"),
        F.element_at(F.array(*map(F.lit, LEDGER_UNITS)), (_ldraw(len(LEDGER_UNITS), seed, a, "units") + 1).cast("int")).alias("units"),
    )

    def with_setting(st: Column) -> Column:
        names, cells = _names(st["g"], seed, a), _cells(st["g"] * st["days"], seed, a)
        if upstream is not None:
            cells = F.concat(F.array(upstream.cast("bigint")), F.slice(cells, 2, st["g"] * st["days"] - 1))
        return let(F.struct(names.alias("names"), cells.alias("cells")), lambda c: with_cells(st, c))

    def with_cells(st: Column, c: Column) -> Column:
        gi = F.sequence(F.lit(0), st["g"] - 1)
        totals = F.transform(gi, lambda i: F.aggregate(
            F.slice(c["cells"], i * st["days"] + 1, st["days"]), F.lit(0).cast("bigint"), lambda s, x: s + x))
        return let(totals, lambda t: with_totals(st, c, t))

    def with_totals(st: Column, c: Column, t: Column) -> Column:
        diff = F.array_max(t) - F.array_min(t)
        hidden = F.concat(t, F.array(diff))
        surface = c["cells"]
        if upstream is not None:
            hidden = F.concat(hidden, F.array(upstream.cast("bigint")), lead_hidden)
            surface = F.slice(c["cells"], 2, F.size(c["cells"]) - 1)
        day_names = F.slice(F.array(*map(F.lit, LEDGER_DAYS)), 1, st["days"])

        def entry(d: Column, i: Column) -> Column:
            name = F.element_at(c["names"], i + 1)
            plain = _fmt("the {name} {site} logged {v} {units}", name=name, site=st["site"],
                         v=F.element_at(c["cells"], i * st["days"] + d), units=st["units"])
            if upstream is None:
                return plain
            injected = _fmt("the {name} {site} logged as many as the count above", name=name, site=st["site"])
            return F.when((i == 0) & (d == 1), injected).otherwise(plain)

        def day_sentence(day: Column, d: Column) -> Column:
            def say(parts: Column) -> Column:
                head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", ")
                return _fmt("On {day}, {head}, while {last}.", day=day, head=head, last=F.element_at(parts, -1))

            return let(F.transform(gi_seq(st), lambda i: entry(d + 1, i)), say)

        sents = F.transform(day_names, day_sentence)
        if lead is not None:
            sents = F.concat(lead, sents)
        forbidden = F.array_union(c["cells"], hidden)
        pool = F.array_except(F.sequence(F.lit(3).cast("bigint"), F.lit(250).cast("bigint")), forbidden)
        dvals = draw_distinct(pool, dist, lambda size, j: _ldraw(size, seed, a, "dval", j))
        return let(dvals, lambda dv: with_distractors(st, c, t, diff, hidden, surface, sents, dv))

    def with_distractors(st, c, t, diff, hidden, surface, sents, dvals) -> Column:
        lead_n = F.lit(0) if lead is None else F.size(lead)

        def ins(acc: Column, d: Column) -> Column:
            # after the first ledger sentence, never inside the lead
            pos = (lead_n + 2 + _ldraw(F.size(acc["s"]) - lead_n, seed, a, "dpos", acc["j"])).cast("int")
            g = F.element_at(c["names"], (_ldraw(st["g"], seed, a, "dgroup", acc["j"]) + 1).cast("int"))
            sent = _fmt(LEDGER_DISTRACTOR, d=d, units=st["units"], g=g, site=st["site"])
            return F.struct(F.array_insert(acc["s"], pos, sent).alias("s"), (acc["j"] + 1).alias("j"))

        placed = F.aggregate(dvals, F.struct(sents.alias("s"), F.lit(0).alias("j")), ins)["s"]
        question = _fmt(LEDGER_QUESTION, units=st["units"], site=st["site"])
        prompt = F.array_join(F.concat(placed, F.array(question)), " ")
        return let(prompt, lambda pr: F.struct(
            a.cast("int").alias("attempt"), st["g"].alias("n_groups"), st["days"].alias("n_days"),
            c["names"].alias("groups"), c["cells"].alias("cells"), t.alias("totals"),
            diff.alias("answer"), dvals.alias("distractor_values"), pr.alias("merged_prompt"),
            hidden.alias("hidden"),
            ((F.size(F.array_distinct(t)) == st["g"]) & (diff >= 2)
             & ~F.arrays_overlap(hidden, surface)
             & (F.size(leaked_values(pr, hidden)) == 0)
             & ~has_decomposition_marker(pr)
             & (F.size(dvals) == dist)).alias("valid"),
        ))

    def gi_seq(st: Column) -> Column:
        return F.sequence(F.lit(0), st["g"] - 1)

    return let(setting, with_setting)


def synthesize_ledgers(seeds: DataFrame) -> DataFrame:
    """K4 + K5 + K6 + K9: one ledger task per (seed, depth, distractors) row, as
    one narrow projection (first valid attempt by a lazily exiting fold)."""
    base = dealt(seeds.select("seed", "depth", "distractors"))
    w = once(base, "w", _first_valid_fold("ledger", base, _ledger_attempt)).select(
        "seed", "depth", "distractors", "w.*")
    answer = F.col("answer").cast("string")
    difficulty = F.format_string("[('depth', %d), ('distractors', %d)]", F.col("depth"), F.col("distractors"))
    digest = F.sha2(F.concat(F.lit(LEDGER_FAMILY), F.lit(VERSION), F.col("seed").cast("string"), difficulty,
                             F.col("merged_prompt"), answer), 256)
    return w.select(
        F.concat(F.lit(f"{LEDGER_FAMILY}::{VERSION}::"), F.substring(digest, 1, 12)).alias("task_id"),
        "seed", "depth", "distractors", "attempt", "n_groups", "n_days", "groups", "cells", "totals",
        "distractor_values", "merged_prompt", answer.alias("canonical_terminal_answer"),
        heuristic_tokens(F.col("merged_prompt")).alias("v_star_input_tokens"),
        heuristic_tokens(answer).alias("v_star_output_tokens"),
        F.concat(F.lit("ledger_d"), F.col("depth").cast("string")).alias("difficulty_bucket"),
        F.when(F.col("attempt").isNull(), "rejected").otherwise("ok").alias("status"),
    )


def ledger_cells_long(tasks: DataFrame) -> DataFrame:
    """Recorded ledger cells in long form (task_id, grp, day_idx, value) for D10 / K11."""
    per_group = tasks.select("task_id", "n_days", F.posexplode("groups").alias("gi", "grp"), "cells")
    return per_group.select(
        "task_id", "grp",
        F.posexplode(F.slice("cells", F.col("gi") * F.col("n_days") + 1, F.col("n_days"))).alias("day_idx", "value"),
    )


# ---------------------------------------------------------------------------
# Chain + ledger hybrids (K7): the chain's final value becomes the first cell of
# the first group, referred to by phrase; the answer is the ledger difference.
HYBRID_FAMILY = "cw_hybrid"
HYBRID_BRIDGE = "All of that count leaves for the sites whose log follows."


def _hybrid_attempt(a: Column) -> Column:
    seed, depth = F.col("seed"), F.col("depth")
    setting = _setting(seed, a)

    def with_setting(st: Column) -> Column:
        return let(_chain(seed, a, depth, st["place"], st["items"]), lambda ch: with_chain(st, ch))

    def with_chain(st: Column, ch: Column) -> Column:
        lead = F.concat(_sentences(ch, st["items"]), F.array(F.lit(HYBRID_BRIDGE)))
        ledger = _ledger_attempt(a, upstream=ch["v"], lead=lead, lead_hidden=ch["vals"], depth=depth)
        return let(ledger, lambda led: F.struct(
            led["attempt"].alias("attempt"), led["n_groups"].alias("n_groups"), led["n_days"].alias("n_days"),
            led["groups"].alias("groups"), led["cells"].alias("cells"), led["totals"].alias("totals"),
            led["answer"].alias("answer"), led["distractor_values"].alias("distractor_values"),
            led["merged_prompt"].alias("merged_prompt"), led["hidden"].alias("hidden"),
            ch["ops"].alias("ops"), ch["vals"].alias("chain_values"),
            (led["valid"] & F.forall(ch["vals"], lambda x: (x >= VALUE_FLOOR) & (x <= VALUE_CAP))).alias("valid"),
        ))

    return let(setting, with_setting)


def synthesize_hybrids(seeds: DataFrame) -> DataFrame:
    """K7: chain+ledger tasks, one narrow projection (first valid attempt)."""
    base = dealt(seeds.select("seed", "depth", "distractors"))
    w = once(base, "w", _first_valid_fold("hybrid", base, _hybrid_attempt)).select(
        "seed", "depth", "distractors", "w.*")
    answer = F.col("answer").cast("string")
    difficulty = F.format_string("[('depth', %d), ('distractors', %d)]", F.col("depth"), F.col("distractors"))
    digest = F.sha2(F.concat(F.lit(HYBRID_FAMILY), F.lit(VERSION), F.col("seed").cast("string"), difficulty,
                             F.col("merged_prompt"), answer), 256)
    return w.select(
        F.concat(F.lit(f"{HYBRID_FAMILY}::{VERSION}::"), F.substring(digest, 1, 12)).alias("task_id"),
        "seed", "depth", "distractors", "attempt", "ops", "chain_values", "n_groups", "n_days", "groups",
        "cells", "totals", "hidden", "distractor_values", "merged_prompt",
        answer.alias("canonical_terminal_answer"),
        heuristic_tokens(F.col("merged_prompt")).alias("v_star_input_tokens"),
        heuristic_tokens(answer).alias("v_star_output_tokens"),
        # the hybrid bucket names the depth only (distractors are not part of it)
        F.concat(F.lit("hybrid_chain+table_d"), F.col("depth").cast("string")).alias("difficulty_bucket"),
        F.when(F.col("attempt").isNull(), "rejected").otherwise("ok").alias("status"),
    )


def _paired_hybrid_attempt(a: Column, rungs: Sequence[int]) -> Column:
    """One attempt of a paired hybrid group: the chain folded to the deepest rung
    and one ledger shared by all rungs, whose first cell is the rung's chain
    value (narrated by reference, so the ledger text is the same on every rung).
    Valid when every rung's ledger is valid and no hidden value of any rung
    shows in the deepest prompt (every rung prompt is a sub-text of it)."""
    seed, depth = F.col("seed"), F.lit(max(rungs))
    setting = _setting(seed, a)
    rung_arr = F.array(*[F.lit(d) for d in sorted(rungs)])

    def with_setting(st: Column) -> Column:
        return let(_chain(seed, a, depth, st["place"], st["items"]), lambda ch: with_chain(st, ch))

    def with_chain(st: Column, ch: Column) -> Column:
        lead = F.concat(_sentences(ch, st["items"]), F.array(F.lit(HYBRID_BRIDGE)))
        led = _ledger_attempt(a, upstream=ch["v"], lead=lead, lead_hidden=ch["vals"],
                              depth=F.lit(len(LEDGER_DAYS)))
        return let(led, lambda lg: with_ledger(ch, lg))

    def with_ledger(ch: Column, lg: Column) -> Column:
        days = lg["n_days"]
        g0_rest = F.aggregate(F.slice(lg["cells"], 2, days - 1), F.lit(0).cast("bigint"), lambda s_, x: s_ + x)
        per_rung = F.transform(rung_arr, lambda d: let(
            F.concat(F.array(F.element_at(ch["vals"], d) + g0_rest), F.slice(lg["totals"], 2, lg["n_groups"] - 1)),
            lambda t: F.struct(d.alias("rung"), F.element_at(ch["vals"], d).alias("injected"), t.alias("totals"),
                               (F.array_max(t) - F.array_min(t)).alias("answer"))))
        return let(per_rung, lambda pr: finish_(ch, lg, pr))

    def finish_(ch: Column, lg: Column, pr: Column) -> Column:
        surface = F.slice(lg["cells"], 2, F.size(lg["cells"]) - 1)
        hidden_all = F.array_distinct(F.flatten(F.concat(
            F.array(ch["vals"]),
            F.transform(pr, lambda r: F.concat(r["totals"], F.array(r["answer"], r["injected"]))))))
        rung_ok = F.forall(pr, lambda r: (F.size(F.array_distinct(r["totals"])) == F.size(r["totals"]))
                           & (r["answer"] >= 2))
        ok = (rung_ok & ~F.arrays_overlap(hidden_all, surface)
              & ~F.arrays_overlap(lg["distractor_values"], hidden_all)
              & (F.size(leaked_values(lg["merged_prompt"], hidden_all)) == 0)
              & ~has_decomposition_marker(lg["merged_prompt"])
              & (F.size(lg["distractor_values"]) == F.col("distractors"))
              & F.forall(ch["vals"], lambda x: (x >= VALUE_FLOOR) & (x <= VALUE_CAP)))
        return F.struct(
            a.cast("int").alias("attempt"), ch["ops"].alias("ops"), ch["vals"].alias("chain_values"),
            lg["n_groups"].alias("n_groups"), lg["n_days"].alias("n_days"), lg["groups"].alias("groups"),
            lg["cells"].alias("cells"), lg["distractor_values"].alias("distractor_values"),
            lg["merged_prompt"].alias("merged_prompt"), pr.alias("rungs"), ok.alias("valid"))

    return let(setting, with_setting)


def paired_hybrid_ladder(groups: DataFrame, depths: Sequence[int], distractors: int = 2) -> DataFrame:
    """K8 (hybrid form): one task per (group, rung) from one group attempt.

    Rung d keeps the first d-1 op sentences of the chain, the shared bridge and
    ledger narration, and the shared distractors; its answer is the ledger
    difference with the rung's chain value in the first cell."""
    rungs = sorted(depths)
    base = dealt(groups.select(F.col("group_seed").alias("seed"))).select(
        "seed", F.lit(max(rungs)).alias("depth"), F.lit(distractors).alias("distractors"))
    fold = _first_valid_fold(f"paired_hybrid:{','.join(map(str, rungs))}", base,
                             lambda a: _paired_hybrid_attempt(a, rungs))
    w = once(base, "w", fold).filter(F.col("w").isNotNull()).select(
        F.col("seed").alias("group_seed"), "w.*")
    numbered = F.transform(F.split(F.col("merged_prompt"), "(?<=\\.) "),
                           lambda x, i: F.struct(x.alias("s"), i.alias("i"), x.startswith(OP_OPENING).alias("op")))
    w = once(w, "numbered", numbered)
    w = once(w, "op_idx", F.transform(F.filter("numbered", lambda e: e["op"]), lambda e: e["i"]))
    t = w.select("group_seed", "attempt", "ops", "chain_values", "n_groups", "n_days", "groups", "cells",
                 "distractor_values", "numbered", "op_idx", F.explode("rungs").alias("r"))
    t = t.withColumn("drop_from", F.try_element_at("op_idx", F.col("r.rung")))
    kept = F.filter("numbered", lambda e: F.col("drop_from").isNull() | ~e["op"] | (e["i"] < F.col("drop_from")))
    cells = F.concat(F.array(F.col("r.injected")), F.slice("cells", 2, F.size("cells") - 1))
    answer = F.col("r.answer").cast("string")
    prompt = F.array_join(F.transform(kept, lambda e: e["s"]), " ")
    return t.select(
        "group_seed", F.col("r.rung").alias("depth"), "attempt",
        F.slice("ops", 1, F.col("r.rung") - 1).alias("ops"),
        F.slice("chain_values", 1, F.col("r.rung")).alias("values"),
        "n_groups", "n_days", "groups", cells.alias("cells"), F.col("r.totals").alias("totals"),
        "distractor_values", prompt.alias("merged_prompt"), answer.alias("canonical_terminal_answer"),
        F.concat(F.lit("hybrid-paired_d"), F.col("r.rung").cast("string")).alias("difficulty_bucket"),
    )
