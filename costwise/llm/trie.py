"""The trie of conversations' common beginnings, with totals of every subtree.

A node is a distinct sequence of first turns; it is named by its depth and the smallest id of the conversations that
begin with it. What two conversations begin with is compared by running sums of 128-bit hashes of (place, role, text),
so that a conversation of any length is dealt out by blocks of turns.

Depth-band rollup: depths are cut into bands of fixed height. Along each conversation's path a node adds to its
ancestors within its band only, at most a band's height of them. The tops of the bands form a smaller trie, whose
totals are found in the same way (so the rounds grow with the logarithm of the greatest depth), and every top's
completed total is then added to its ancestors in the band above.

Defined cases: rows without conversation id take no part; turns are taken by ``turn``, null first, equal turns by hash
of role and text; repeated rows are turns of their own; a null role or text counts as empty; without conversations
there is no node, not even the root; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.ordered import join_counted, running_totals
from costwise.llm.storage import map_batches, prefixed, stored


@dataclass(frozen=True)
class Params:
    #: Depths of one band.
    height: int = 8
    #: Turns of one block of a conversation.
    block: int = 1024
    #: Conversations are rebuilt on the first turns of another one: the id without its remainder by ``family``,
    #: up to crc32(id) % ``most_shared`` turns of it. None: each conversation is taken as it is.
    family: int | None = None
    most_shared: int = 4


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hash of role and text), words: one row for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = prefixed(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("turn"), text, role).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    alike = rows.groupBy("conv_id", "has_turn", "turn", "h1", "h2").agg(F.count("*").alias("copies"), F.max("words").alias("words"))
    placed = running_totals(alike, ["conv_id"], ["has_turn", "turn", "h1", "h2"], {"before": F.col("copies")})
    return placed.select(
        "conv_id", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))).alias("pos"), "h1", "h2", "words"
    )


def rebuilt(turns: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, d, h1, h2, words): the conversations with their shared first turns, depths from 1."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    if params.family is None:
        return convs.select("conv_id", F.col("n_own").alias("n_turns")), turns.withColumnRenamed("pos", "d")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % params.most_shared
    base = F.col("conv_id") - F.col("conv_id") % params.family
    heads = turns.filter((F.col("conv_id") % params.family == 0) & (F.col("pos") < params.most_shared)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head")
    ).withColumnRenamed("conv_id", "base")
    meta = stored(
        convs.withColumn("base", base).withColumn("shared", shared).join(heads, "base", "left")
        .withColumn("head", F.slice("head", F.lit(1), F.col("shared").cast("int")))
        .select("conv_id", "n_own", "shared", "head", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)).cast("long").alias("n_head")),
        "rebuilt",
    )
    sizes = meta.select("conv_id", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("shared"), F.lit(0))).alias("n_turns"))
    from_base = meta.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("d"), "t.h1", "t.h2", "t.words")
    # by blocks of turns, so that a long conversation is not one key of the join
    blocks = meta.select("conv_id", "shared", "n_head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_own") / params.block))).alias("block"))
    own = (
        turns.withColumn("block", F.floor(F.col("pos") / params.block)).join(blocks, ["conv_id", "block"])
        .filter(F.col("pos") > F.col("shared"))
        .select("conv_id", (F.col("n_head") + F.col("pos") - F.col("shared")).alias("d"), "h1", "h2", "words")
    )
    return sizes, from_base.unionByName(own)


def fingerprints(turns: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows with f1, f2: a fingerprint of all turns of the conversation up to this one."""
    low = F.lit(0xFFFFFFFF).cast("long")
    x = [F.xxhash64("d", "h1", "h2"), F.xxhash64("h2", "d", "h1")]
    terms = [t for h in x for t in (F.shiftrightunsigned(h, 32), h.bitwiseAND(low))]  # sums of 2^31 such terms are exact
    rows = turns.withColumn("block", F.floor(F.col("d") / params.block)).withColumns({f"t{i}": t for i, t in enumerate(terms)})
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("conv_id", "block").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(4)])
        .select("conv_id", "block", *[F.sum(f"t{i}").over(before).alias(f"b{i}") for i in range(4)])
        .filter(F.col("block") > 0)
    )
    summed = rows.select("conv_id", "d", "words", "block", *[F.sum(f"t{i}").over(inside).alias(f"s{i}") for i in range(4)])
    summed = summed.join(offsets, ["conv_id", "block"], "left")
    part = [(F.col(f"s{i}") + F.coalesce(f"b{i}", F.lit(0).cast("long"))).bitwiseAND(low) for i in range(4)]
    return summed.select(
        "conv_id", "d", "words",
        F.shiftleft(part[0], 32).bitwiseOR(part[1]).alias("f1"), F.shiftleft(part[2], 32).bitwiseOR(part[3]).alias("f2"),
    )


def _bands(path: DataFrame, height: int) -> DataFrame:
    """conv_id, band, e: along a path, the entries of each band and the top of the next one, ascending.

    Only bands with a node that the conversation gives its name; those nodes are the last entries of ``e``."""
    entry = F.struct(*[F.col(c) for c in path.columns if c != "conv_id"])
    band = F.floor(F.col("i") / height)
    bands = F.when((F.col("i") % height == 0) & (F.col("i") > 0), F.array(band - 1, band)).otherwise(F.array(band))
    return (
        path.select("conv_id", F.explode(bands).alias("band"), entry.alias("x"))
        .groupBy("conv_id", "band").agg(F.array_sort(F.collect_list("x")).alias("e"))  # height + 1 entries at most
        .filter(F.element_at("e", -1)["m"] == F.col("conv_id"))
    )


def _to_ancestors(bands: DataFrame, height: int, sums: dict) -> DataFrame:
    """m, i and the sums: for each entry of a band above its last own node, what ``sums`` gives for (e, place)."""
    upto = F.least(F.size("e") - 1, F.lit(height - 1))
    rows = F.transform(
        F.sequence(F.lit(0), upto),
        lambda j: F.struct(F.col("e")[j]["m"].alias("m"), F.col("e")[j]["i"].alias("i"), *[f(j).alias(k) for k, f in sums.items()]),
    )
    flat = bands.select(F.explode(rows).alias("r")).select("r.*")
    return flat.groupBy("m", "i").agg(*[F.sum(k).alias(k) for k in sums])


def _own(x: Column) -> Column:
    return x["m"] == F.col("conv_id")


def subtree_totals(path: DataFrame, values: list[str], height: int, depth: int) -> DataFrame:
    """m, i and each value summed over the node's subtree.

    ``path``: conv_id, i (depth), m (the node's name) and the node's values, of which those where m = conv_id count;
    one row for each conversation and depth from 0 on. ``depth``: the greatest i."""
    bands = _bands(path, height)
    if depth >= height:
        bands = stored(bands, "bands")

    def below(v: str):
        return lambda j: F.aggregate(
            F.slice(F.col("e"), j + 1, height - j), F.lit(0).cast("long"), lambda s, x: s + F.when(_own(x), x[v]).otherwise(0)
        )

    local = _to_ancestors(bands, height, {v: below(v) for v in values})
    if depth < height:
        return local
    local = stored(local, "band-totals")
    tops = local.filter(F.col("i") % height == 0).select(F.col("m").alias("conv_id"), "i", *[F.col(v).alias(f"top_{v}") for v in values])
    smaller = path.filter(F.col("i") % height == 0).select("conv_id", "i", "m").join(tops, ["conv_id", "i"], "left").select(
        "conv_id", F.floor(F.col("i") / height).alias("i"), "m", *[F.coalesce(f"top_{v}", F.lit(0).cast("long")).alias(v) for v in values]
    )
    done = subtree_totals(stored(smaller, "band-tops"), values, height, depth // height)
    done = done.filter(F.col("i") > 0).select(F.col("m").alias("conv_id"), (F.col("i") - 1).alias("band"), *[F.col(v).alias(f"top_{v}") for v in values])
    under = bands.filter(F.size("e") == height + 1).join(done, ["conv_id", "band"])
    pushed = _to_ancestors(under, height, {v: (lambda j, v=v: F.col(f"top_{v}")) for v in values})
    return local.unionByName(pushed).groupBy("m", "i").agg(*[F.sum(v).alias(v) for v in values])


#: Ids that differ in their last bits only make one piece of the text that a digest is taken of.
_PIECE_BITS = 8


def end_digests(ends: DataFrame) -> DataFrame:
    """m, i, ends_sha256: SHA-256 of the ids (column id, each once) at a node, ascending, joined by commas.

    Pieces of the text are made where the ids are; a digest is sequential, so one task runs over a node's pieces, as a stream."""
    pieces = ends.groupBy("m", "i", F.shiftright("id", _PIECE_BITS).alias("piece")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))).alias("text")
    )

    def run(batches):
        node, digest = None, None

        def done():
            return pa.RecordBatch.from_pylist([{"m": node[0], "i": node[1], "ends_sha256": digest.hexdigest()}])

        for batch in batches:
            for m, i, text in zip(batch["m"].to_pylist(), batch["i"].to_pylist(), batch["text"], strict=True):
                if (m, i) != node:
                    if node is not None:
                        yield done()
                    node, digest = (m, i), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_buffer())
        if node is not None:
            yield done()

    ordered = pieces.repartition("m", "i").sortWithinPartitions("m", "i", "piece").select("m", "i", "text")
    return map_batches(ordered, run, "m long, i long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, params: Params = Params()) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 by node."""
    turns = stored(ranked_turns(conversations), "turns")
    sizes, steps = rebuilt(turns, params)
    sizes = stored(sizes, "sizes")
    last = sizes.select("conv_id", F.col("n_turns").alias("d"), F.lit(True).alias("last"))
    steps = fingerprints(steps, params).join(last, ["conv_id", "d"], "left").withColumn("last", F.coalesce("last", F.lit(False)))
    steps = stored(steps, "steps")
    nodes = stored(
        steps.groupBy("d", "f1", "f2").agg(
            F.min("conv_id").alias("m"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.count_if("last").alias("n_ends")
        ),
        "nodes",
    )
    top = sizes.agg(F.min("conv_id").alias("m"), F.count("*").alias("n"), F.max("n_turns").alias("depth")).first()
    root = F.lit(top.m).cast("long")
    value = {"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    path = stored(
        join_counted(steps.drop("words"), nodes, ["d", "f1", "f2"], "n_convs")
        .select("conv_id", F.col("d").alias("i"), "m", "n_convs", "last", *[v.alias(k) for k, v in value.items()]),
        "path",
    )
    first = sizes.filter("n_turns > 0").select(
        "conv_id", F.lit(0).cast("long").alias("i"), root.alias("m"), F.lit(top.n).alias("n_convs"), F.lit(False).alias("last"),
        *[F.lit(0).cast("long").alias(k) for k in value],
    )
    totals = subtree_totals(path.unionByName(first).drop("n_convs", "last"), list(value), params.height, top.depth or 0)
    # a node and its parent stand side by side on the path of the node's smallest member
    before = path.filter(F.col("m") == F.col("conv_id")).select("conv_id", (F.col("i") - 1).alias("above"), "i", "n_convs")
    parents = path.select("conv_id", F.col("i").alias("above"), F.col("m").alias("parent"))
    named = before.join(parents, ["conv_id", "above"], "left").select(
        "conv_id", F.col("i").alias("depth"), F.coalesce("parent", root).alias("parent_conv_id"), "n_convs"
    )
    named = stored(named, "named")
    children = named.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    rows = named.unionByName(
        sizes.limit(1).select(root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top.n).alias("n_convs"))
    )
    ends = path.filter("last").select("m", "i", F.col("conv_id").alias("id")).unionByName(
        sizes.filter("n_turns = 0").select(root.alias("m"), F.lit(0).cast("long").alias("i"), F.col("conv_id").alias("id"))
    )
    key = [F.col("m").alias("conv_id"), F.col("i").alias("depth")]
    zero = F.lit(0).cast("long")
    return (
        rows.join(children, ["conv_id", "depth"], "left")
        .join(totals.select(*key, "leaves", "saved"), ["conv_id", "depth"], "left")
        .join(end_digests(ends).select(*key, "ends_sha256"), ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
            F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
