"""N-gram Jaccard join as a blocked, masked product of the document by n-gram incidence with its transpose.

Rows of the incidence are documents, columns are n-word shingles in one global
order: shingles known to be frequent last, the others by hash. Of the product's
two column blocks for a row of n shingles, the first holds its n - ceil(t n) + l
leading columns, the second the rest. Rows that link share at least l columns of
the first block (the smaller of their two values of l), so a row with fewer
shared columns there is left out, and the second block is only evaluated for
entries that the first one left. Evaluation ends as soon as what is left of the
columns cannot reach the bound.

Only connectivity is asked for, so the product is not spelled out:

* documents with the same set share one row (class) of the incidence;
* wide columns first link their rows to a pivot (a star, one entry a row);
* entries inside a component that is already connected are not evaluated;
* the others are evaluated as row against component, its rows in chunks, and
  end at the first link. Every pair of rows in different components that shares
  a leading column is covered, so no link that would join two components is lost.

Defined cases: a null or blank text has no shingle, ``n_shingles`` 0, and is its
own component; a text with fewer than ``words`` words is one shingle; a row with
a null id has a null component and links with nothing; repeated rows are
returned each and share their component; extra columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.graph import components
from costwise.llm.storage import bounded, map_batches, prefixed, ship, stored
from costwise.llm.words import mix, shingles, text_buffers, word_hashes


#: Shingles that a task counts at a time (8 bytes each).
RUN = 4_000_000


@dataclass(frozen=True)
class Params:
    words: int = 4
    #: Link when 100 * overlap >= percent * union.
    percent: int = 85
    #: l, as a share of a row's shingles in percent.
    extra: int = 5
    #: Columns that are put last because they are frequent: at most so many (16 bytes each are broadcast).
    #: The order of columns decides the cost, never the result.
    frequent: int = 100_000
    frequent_from: int = 32
    #: Rows of one evaluation chunk.
    chunk: int = 128
    star_width: int = 8
    star_rounds: int = 2


def _sets(batch_text: pa.Array, k: int):
    data, offsets = text_buffers(batch_text)
    words, at = word_hashes(data, offsets)
    for i in range(len(at) - 1):
        yield shingles(words[at[i] : at[i + 1]], k)


def _signature(s: np.ndarray) -> tuple[int, int]:
    a = mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5F00D5EED1234)))
    return int(mix(np.array([a + np.uint64(len(s))], np.uint64)).view(np.int64)[0]), int(b.view(np.int64))


def leading(n: int, p: Params) -> int:
    """How many columns of a row of n the first block holds."""
    return n - -(-p.percent * n // 100) + max(1, -(-p.extra * n // 100))


def pair_bounds(n_u, n_least, n_most, p: Params):
    """For a row of ``n_u`` shingles and others of ``n_least`` to ``n_most``: below which place of the row, below which
    place of the other a shared column counts, and how many such columns a link has at least.

    Rows of a and b shingles that link overlap in o = ceil(t (a + b) / (1 + t)) columns, so they share at least l of the
    first a - o + l columns of the one and b - o + l of the other, l being that of the smaller row. Of a range of
    sizes the one that allows most is taken; no place is allowed where no size can link."""
    low = F.greatest(n_least, F.ceil(n_u * p.percent / 100))
    high = F.least(n_most, F.floor(n_u * 100 / p.percent))

    def overlap(m):
        return F.ceil((n_u + m) * p.percent / (100 + p.percent))

    def extra(m):
        return F.greatest(F.lit(1), F.ceil(F.least(n_u, m) * p.extra / 100))

    possible = low <= high
    # the row's own bound falls with the other's size, but for steps of one where both roundings meet
    step = F.when(low < high, F.lit(1)).otherwise(F.lit(0))
    return (
        F.when(possible, n_u - overlap(low) + extra(low) + step).otherwise(0),
        F.when(possible, high - overlap(high) + extra(high)).otherwise(0),
        extra(low),
    )


def least_shared(n, p: Params):
    """How many of them a row that links shares: the l of the smallest row that it can link with."""
    smallest = F.ceil(n * p.percent / 100)
    return F.greatest(F.lit(1), F.ceil(smallest * p.extra / 100))


def frequent_columns(docs: DataFrame, p: Params) -> np.ndarray:
    """(2, m): frequent shingles, ascending, and their rank by frequency.

    Each task counts its own texts in runs of ``RUN`` shingles and reports those that repeat there."""
    k = p.words

    def count(batches):
        def flush(h):
            h.sort()
            h, n = np.unique(h[2:][h[2:] == h[:-2]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64) + 2)], ["h", "n"])

        held, size = np.empty(RUN, np.uint64), 0
        for batch in bounded(batches):
            for s in _sets(batch.column(0), k):
                if size + len(s) > len(held):
                    yield flush(held[:size])
                    size = 0
                    if len(s) > len(held):
                        yield flush(s)
                        continue
                held[size : size + len(s)] = s
                size += len(s)
        yield flush(held[:size])

    rows = (
        map_batches(docs.select("text"), count, "h long, n long")
        .groupBy("h").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= p.frequent_from)
        .orderBy(F.desc("n"), "h").limit(p.frequent)
        .collect()  # at most p.frequent rows
    )
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    rank = np.arange(len(h), 0, -1, dtype=np.uint64)  # the most frequent column comes last
    order = np.argsort(h)
    return np.stack([h[order], rank[order]])


def incidence(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, s1, s2 (the set's signature), head (leading columns; null when the task has
    already given those of an equal set)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_columns(docs, p))
    kind = docs.schema["doc_id"].dataType.simpleString()
    k = p.words

    def run(batches):
        known, rank = sent.value
        given: set[int] = set()
        for batch in bounded(batches):
            sizes, one, two, heads = [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for s, has_id in zip(_sets(batch.column(1), k), named, strict=True):
                n = len(s)
                sizes.append(n)
                if not n:
                    one.append(0)
                    two.append(0)
                    heads.append(None)
                    continue
                a, b = _signature(s)
                one.append(a)
                two.append(b)
                if a in given or not has_id:
                    heads.append(None)
                    continue
                given.add(a)
                want = leading(n, p)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = known[at] == s
                    rare = s[~common]
                    if len(rare) < want:
                        late = s[common][np.argsort(rank[at[common]], kind="stable")]
                        rare = np.concatenate([rare, late])
                    head = rare[:want]
                else:
                    head = s[:want]
                heads.append(head.view(np.int64).copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(heads, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "head"],
            )

    return map_batches(prefixed(docs, "doc_id", "text"), run, f"doc_id {kind}, n long, s1 long, s2 long, head array<long>")


def _shared_columns(batches):
    """Of rows (h, node, place, n) sorted by h and node: those of columns with two nodes or more, each once."""
    carry = None  # last row so far and whether it was given
    names = ["h", "node", "place", "n"]
    for batch in batches:
        h, node, place, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(h):
            continue
        if carry is not None:
            h, node, place, n = (np.append(c, x) for c, x in zip(carry[0], (h, node, place, n), strict=True))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, place, n = h[fresh], node[fresh], place[fresh], n[fresh]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        keep = same[1:] | same[:-1]
        if carry is not None and carry[1]:
            keep[0] = False  # given with the batch before
        given = bool(keep[-1]) or (len(h) == 1 and carry is not None and carry[1])
        carry = ((h[-1], node[-1], place[-1], n[-1]), given)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], k) for x, k in zip((h, node, place, n), kinds, strict=True)], names)


def _overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Overlap of two sorted sets, by blocks of columns; below ``need`` any smaller number may be given."""
    total, step = 0, 256
    for i in range(0, len(a), step):
        block = a[i : i + step]
        at = np.searchsorted(b, block)
        total += int((b[np.minimum(at, len(b) - 1)] == block).sum())
        if total + len(a) - i - len(block) < need:
            return total
    return total


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    need = -(-percent * (len(a) + len(b)) // (100 + percent))  # 100 o >= percent (|a| + |b| - o)
    return _overlap(x, y, need) >= need


def _evaluate(tests: DataFrame, members: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between each row u and the rows m of its component c.

    tests: u, c. members: c, m. texts: node, text. A component's rows are dealt out in chunks and the
    rows tested against it in shares, so no task gets a whole component or all of its tests."""
    share = 16 * p.chunk
    n_tests = tests.groupBy("c").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    n_members = members.groupBy("c").agg(F.ceil(F.count("*") / p.chunk).cast("int").alias("chunks"))
    plan = n_tests.join(n_members, "c")
    left = tests.join(plan, "c").select(
        "c", F.pmod(F.xxhash64("u"), "shares").cast("int").alias("share"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), F.col("u").alias("node"),
    )
    right = members.join(plan, "c").select(
        "c", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.pmod(F.xxhash64("m"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("role"), F.col("m").alias("node"),
    )
    rows = (
        left.unionByName(right).hint("shuffle_hash").join(texts, "node")
        .repartition("c", "share", "chunk").sortWithinPartitions("c", "share", "chunk", "role", "node")
        .select("c", "share", "chunk", "role", "node", "text")
    )
    k, percent = p.words, p.percent

    def run(batches):
        key, held, ids = None, [], []
        for batch in bounded(batches):
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            a, b = [], []
            for (c, s, q, role, node), own in zip(heads, _sets(batch.column(5), k), strict=True):
                if (c, s, q) != key:
                    key, held, ids = (c, s, q), [], []
                if role == 0:
                    held.append(own)
                    ids.append(node)
                    continue
                for other, m in zip(held, ids, strict=True):
                    if m != node and linked(own, other, percent):
                        a.append(node)
                        b.append(m)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(rows, run, "a long, b long")


def link_components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for every row."""
    docs = prefixed(docs, "doc_id", "text")
    rows = stored(incidence(docs, p), "incidence")
    alive = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = alive.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))

    entries = (
        alive.filter(F.col("head").isNotNull())
        .select(F.posexplode("head").alias("place", "h"), F.col("s1").alias("node"), F.col("n").cast("int").alias("n"))
        .select("h", "node", "place", "n")
        .repartition("h").sortWithinPartitions("h", "node")
    )
    shared = stored(map_batches(entries, _shared_columns, "h long, node long, place int, n int"), "columns")
    for _ in range(2):  # rows that share too little leave, and then the columns that only they shared
        enough = shared.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(
            F.col("k") >= least_shared(F.col("n"), p)
        ).select("node")
        shared = shared.join(enough, "node", "left_semi")
        wide = shared.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > 1).select("h")
        shared = stored(shared.join(wide, "h", "left_semi"), "columns")
    nodes = shared.select("node").distinct()
    wanted = classes.join(nodes, classes["s1"] == nodes["node"]).select(F.col("rep").alias("doc_id"), "node")
    k = p.words

    def own_text(batches):
        for batch in bounded(batches):
            keep = [len(s) > 0 and _signature(s)[0] == node for s, node in
                    zip(_sets(batch.column(1), k), batch.column(0).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = stored(
        map_batches(docs.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "text"), own_text, "node long, text string"), "texts"
    )

    links = None
    degree = stored(shared.groupBy("node").agg(F.count("*").alias("k")), "degrees")
    labels = degree.select("node", F.col("node").alias("label"))
    for r in range(p.star_rounds):
        at = shared.filter(F.pmod("h", F.lit(4)) == r).join(labels, "node").join(degree, "node")
        # first the row with most shared columns, which copies with an edit each have in common; then any row
        first = F.struct((-F.col("k") if r == 0 else F.lit(0)).alias("by"), F.xxhash64("node", F.lit(r)).alias("draw"), "node", "label")
        pivot = at.groupBy("h").agg(F.count("*").alias("width"), F.min(first).alias("pivot")).filter(F.col("width") >= p.star_width)
        star = (
            at.join(pivot, "h").filter(F.col("label") != F.col("pivot.label"))
            .select(F.col("node").alias("u"), F.col("pivot.node").alias("c")).distinct()
        )
        star = stored(star, "star")
        found = _evaluate(star, star.select("c", F.col("c").alias("m")).distinct(), texts, p)
        links = found if links is None else links.unionByName(found)
        links = stored(links, "links")
        labels = stored(
            nodes.join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels"
        )

    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    ranked = stored(labels.join(sizes, "label"), "ranked")
    at = shared.join(ranked, "node")
    groups = at.groupBy("h", F.col("label").alias("c"), F.col("size").alias("c_size")).agg(
        F.min("place").alias("c_place"), F.min("n").alias("n_least"), F.max("n").alias("n_most")
    )
    # overlap counts of the first block: a row that links with a component shares enough columns with it, and both
    # have them where the sizes allow
    own, other, need = pair_bounds(F.col("n"), F.col("n_least"), F.col("n_most"), p)
    met = (
        at.join(groups, "h")
        .filter(
            (F.col("label") != F.col("c")) & (F.struct("size", "label") < F.struct("c_size", "c"))
            & (F.col("place") < own) & (F.col("c_place") < other)
        )
        .groupBy(F.col("node").alias("u"), "c").agg(F.count("*").alias("k"), F.min(need).alias("need"))
    )
    rest = stored(met.filter(F.col("k") >= F.col("need")).select("u", "c"), "tests")
    members = ranked.join(rest.select("c").distinct(), ranked["label"] == F.col("c")).select("c", F.col("node").alias("m"))
    found = _evaluate(rest, members, texts, p)
    links = stored(found if links is None else links.unionByName(found), "links")

    of_class = classes.join(components(links), classes["s1"] == F.col("node"), "left").select(
        classes["s1"], classes["s2"], classes["n"], "rep", F.coalesce("label", "s1").alias("label")
    )
    least = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "label").select("s1", "s2", "n", "component_id")
    kept = rows.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    return kept.join(
        of_class, (kept["s1"] == of_class["s1"]) & (kept["s2"] == of_class["s2"]) & (kept["n_shingles"] == of_class["n"]), "left"
    ).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each component, with its smallest id; rows without shingles stay, and so do rows without id.

    Where ids repeat, rows are linked as rows: one that shares its id with a linked row is judged by its own text."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter(F.col("n") > 1).isEmpty():
        found = link_components(docs, p).filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
        return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    row = next(c for c in (f"row{i or ''}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # fixed once written
    own = numbered.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(row).alias("doc_id"), "text")
    linked = link_components(own.select("doc_id", "text"), p).join(own.select("doc_id", "id"), "doc_id")
    first = linked.groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("k"))
    gone = linked.join(first.select(F.col("k.doc_id").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
