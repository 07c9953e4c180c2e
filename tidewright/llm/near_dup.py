"""Near-duplicate texts by tensored MinHash banding, confirmed on whole shingle sets.

Two small collections of half keys (``HALVES`` each, of ``ROWS`` minhashes)
stand for ``HALVES ** 2`` tables: a table's key is a pair of half keys, one of
either collection, so 2 * HALVES * ROWS minhashes serve as many tables as
HALVES ** 2 * 2 * ROWS would without the pairing. At similarity 0.8 a pair is
missed if no half of one side agrees, at most 2 * (1 - 0.8 ** ROWS) ** HALVES
= 1.5e-4; at 0.85 it is 4e-6.

Texts with equal sets are one node. Pairs of half keys are formed late and of
few nodes. While rounds are productive, each node outside the largest
component of the buckets of its half keys meets the one node inside that its
minhash bits are likest to; links join components, and that settles groups of
near copies with about as many comparisons as they have members a round. Only
half keys that then still meet another component, on both sides of a node, are
paired to table keys. In each table bucket all nodes outside its largest
component lead (where they are very many, a growing share of them, round by
round): in blocks of leaders they meet the nodes of their buckets' other
components, each of which is sent once to a block. No bucket is capped, and
every comparison is of whole sets of 64-bit shingle codes.

Rows: null and empty texts and texts without words have an empty set and stay
alone; a single word is its own shingle; rows with a null doc_id keep a null
component and are kept; rows that share a doc_id are separate texts under
that id; extra columns are ignored, or kept by ``drop_near_duplicates``; an
empty table gives no rows. Ties between equal texts go to the smallest doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import documents, partitions, prepare, release, sieve, sifted, staged
from tidewright.llm.components import components
from tidewright.llm.textunits import give_back, lower_ascii, mix, rolling, slices, word_codes, words

HALVES = 18
ROWS = 4
LEADERS = 1024
PRODUCTIVE = 0.25
BITS = 128
LED = 256
MEMBERS = 2000
CHUNK = 400
_ALONE = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data, off, k: int):
    """Each row's sorted distinct k-word shingle codes (lower-cased A-Z); a shorter text is one shingle."""
    low = lower_ascii(data)
    starts, ends, first = words(low, off)
    code = word_codes(low, starts, ends)
    gram = rolling(code, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(gram[a: b - k + 1])
        elif b > a:
            whole = mix(code[a: a + 1] ^ _ALONE)
            for j in range(a + 1, b):
                whole = mix(whole ^ code[j: j + 1])
            yield whole
        else:
            yield code[:0]


def fingerprint(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    one, two = mix(s), mix(s ^ _ALONE)
    return np.array([one.sum(dtype=np.uint64) + np.uint64(len(s)), two.sum(dtype=np.uint64)], ">u8").tobytes()


class Hashes:
    """The minhashes of the half keys, drawn from a fixed seed."""

    def __init__(self, halves: int, rows: int, seed: int = 17):
        n = 2 * halves * rows
        self.halves, self.rows = halves, rows
        seeds = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(seed * 1_000_003))
        self.mul, self.xor = seeds[:n] | np.uint64(1), seeds[n:]

    def half_keys(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2 * halves, sets) codes, and (2, sets) words of one bit of each of 128 minhashes; flat holds nonempty sets in a row, from bounds[:-1]."""
        mins = np.empty((len(self.mul), len(bounds) - 1), np.uint64)
        for j, (m, x) in enumerate(zip(self.mul, self.xor)):
            mins[j] = np.minimum.reduceat((flat ^ x) * m, bounds[:-1])
        keys = np.zeros((2 * self.halves, len(bounds) - 1), np.uint64)
        for h in range(2 * self.halves):
            keys[h] = mix(np.full(1, h + 1, np.uint64))[0]
            for r in range(self.rows):
                keys[h] = mix(keys[h] ^ mins[h * self.rows + r])
        bits = np.zeros((2, len(bounds) - 1), np.uint64)
        for j in range(min(BITS, len(mins))):
            bits[j // 64] |= (mix(mins[j]) & np.uint64(1)) << np.uint64(j % 64)
        return keys, bits


def sketches(docs: DataFrame, k: int, hashes: Hashes) -> DataFrame:
    """doc_id, n_shingles, node (16 bytes, null for empty sets), halves (array of half keys), s1 and s2 (bits of the minhashes)."""

    def run(batches):
        import pyarrow as pa

        for rows, data, off in slices(batches, "text"):
            sets = list(shingle_sets(data, off, k))
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            halves, bits = [None] * len(sets), np.zeros((2, len(sets)), np.int64)
            if len(full):
                keys, some = (x.view(np.int64) for x in hashes.half_keys(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(size[full])])))
                bits[:, full] = some
                for j, i in enumerate(full.tolist()):
                    halves[i] = keys[:, j]
            nodes = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(halves, pa.list_(pa.int64())), *map(pa.array, bits)], names=["doc_id", "n_shingles", "node", "halves", "s1", "s2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node binary, halves array<long>, s1 long, s2 long")


def node_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Staged (nid, shingles): the sets, eight bytes a shingle, of the texts that stand for ``nodes`` (nid, node, doc_id)."""

    def run(batches):
        import pyarrow as pa

        for rows, data, off in slices(batches, "text"):
            want = rows.column(1).to_pylist()
            sets = list(shingle_sets(data, off, k))
            keep = [i for i, s in enumerate(sets) if len(s) and fingerprint(s) == want[i]]  # rows under one doc_id may differ
            blobs = [sets[i].astype("<u8").tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary())], names=["nid", "shingles"])

    few, _ = sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", sieve(nodes.select("doc_id")))
    both = few.join(nodes, "doc_id")
    sets = staged(both.select("nid", "node", "text").mapInArrow(run, "nid long, shingles binary"), "sets")
    if sets.count() == nodes.count():
        return sets
    once = staged(sets.dropDuplicates(["nid"]), "sets")  # equal rows under one doc_id
    release(sets)
    return once


def _codes(blob) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Staged (u, v, linked) for staged ``pairs`` (u leads, v): exact similarity of whole sets.

    A leader's pairs go to chunks of about CHUNK, each with one copy of the
    leader's set, so no task gets a leader's whole group.
    """
    spark = pairs.sparkSession
    leaders = staged(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "leaders")
    member = pairs.join(leaders, "u").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    member = member.join(sets, member.v == sets.nid).select("u", "chunk", "v", "shingles")
    lead = leaders.join(sets, leaders.u == sets.nid).select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("v"), "shingles")

    def run(batches):
        import pyarrow as pa

        now, lead_set = None, None
        for b in batches:
            us, vs, ok = [], [], []
            for u, c, v, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                mine = _codes(blob.as_buffer())
                if v is None:
                    now, lead_set = (u, c), mine.copy()
                    continue
                if now != (u, c):
                    raise ValueError("a pair came without its leader")
                at = np.searchsorted(lead_set, mine)
                same = int((lead_set[np.minimum(at, len(lead_set) - 1)] == mine).sum())
                us.append(u)
                vs.append(v)
                ok.append(100 * same >= percent * (len(mine) + len(lead_set) - same))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ok, pa.bool_())], names=["u", "v", "linked"])
        give_back()

    both = member.unionByName(lead).repartition(partitions(spark), "u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())
    out = staged(both.mapInArrow(run, "u long, v long, linked boolean"), "tested")
    release(leaders)
    return out


def _met(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' codes in one sorted row, the set of each, and the sets' sizes."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order], size


def confirm_blocks(table: DataFrame, lead: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Staged links (u, v) that join all that is linked among leaders and the nodes of other components in their buckets.

    ``table``: key, nid, root; ``lead``: key, u, root, main, n (the bucket's
    size). A leader belongs to the family of the main component of its largest
    bucket. Leaders of a family are dealt into blocks of about ``LED``; a node
    that shares a bucket with the family goes once to each of its blocks, in
    chunks of about ``MEMBERS``, and meets the block's leaders in one look-up
    of its shingles among all of theirs. Each chunk hands on as many links as
    it takes to join its leaders and nodes, not all of them.
    """
    spark = table.sparkSession
    home = staged(lead.groupBy("u").agg(F.max_by("main", F.struct("n", "main")).alias("family"), F.min("root").alias("root")), "homes")
    where = lead.select("key", "u").join(home.select("u", "family"), "u").select("key", "family").distinct()
    member = staged(table.join(where, "key").select("family", F.col("nid").alias("v"), "root").distinct(), "members")
    count = home.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / LED).alias("blocks"))
    plan = staged(member.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("chunks")).join(count, "family"), "plan")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = member.join(plan, "family").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks"))).withColumn("block", each("blocks"))
    rows = rows.join(sets, rows.v == sets.nid).select("family", "block", "chunk", F.lit(1).alias("side"), "v", "root", "shingles")
    heads = home.join(plan, "family").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks"))).withColumn("chunk", each("chunks"))
    heads = heads.join(sets, heads.u == sets.nid).select("family", "block", "chunk", F.lit(0).alias("side"), F.col("u").alias("v"), "root", "shingles")

    def run(batches):
        import pyarrow as pa

        now, us, roots, held, flat, joined = None, [], [], [], None, []

        def top(i):
            while joined[i] != i:
                i = joined[i]
            return i

        for b in batches:
            out = []
            for fam, blk, chunk, side, v, root, blob in zip(*(c.to_pylist() for c in b.columns[:6]), b.column(6)):
                mine = _codes(blob.as_buffer())
                if now != (fam, blk, chunk):
                    now, us, roots, held, flat = (fam, blk, chunk), [], [], [], None
                if side == 0:
                    us.append(v)
                    roots.append(root)
                    held.append(mine.copy())
                    continue
                if not us:  # the hash dealt this block no leader
                    continue
                if flat is None:
                    flat, owner, size = _met(held)
                    joined = list(range(len(us)))
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = hi - lo
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                same = np.bincount(owner[at], minlength=len(us))
                first = None
                for i in np.flatnonzero(100 * same >= percent * (len(mine) + size - same)).tolist():
                    if roots[i] == root or us[i] == v:
                        continue
                    if first is None:
                        first = i
                        out.append((us[i], v))
                    elif (x := top(first)) != (y := top(i)):
                        joined[max(x, y)] = min(x, y)
                        out.append((us[i], v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
        give_back()

    both = heads.unionByName(rows).repartition(partitions(spark), "family", "block", "chunk").sortWithinPartitions("family", "block", "chunk", "side")
    out = staged(both.mapInArrow(run, "u long, v long"), "found")
    release(home, member, plan)
    return out


def half_buckets(nodes: DataFrame, halves: int) -> DataFrame:
    """Staged (half, side, nid, size, s1, s2): the half keys that two nodes or more have, of nodes with such a one on either side."""
    flat = nodes.select("nid", F.posexplode("halves").alias("at", "half"))
    shared = staged(flat.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "shared")
    met = staged(flat.join(shared, "half").select("half", "nid", (F.col("at") >= halves).alias("side")), "met")
    both = met.groupBy("nid").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("nid")
    out = staged(met.join(both.join(nodes.select("nid", "size", "s1", "s2"), "nid"), "nid"), "half-buckets")
    release(shared, met)
    return out


def half_pairs(marked: DataFrame, turn: int, percent: int) -> DataFrame:
    """(u, v): each node v outside the largest component of its half buckets, with the likest of the nodes u that stand for those components."""
    held = marked.groupBy("half", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("nid", F.lit(turn)).alias("o"), "nid", "size", "s1", "s2")).alias("lead"))
    most = held.groupBy("half").agg(F.max(F.struct("m", "root", "lead")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    most = most.select("half", F.col("most.root").alias("main"), *(F.col(f"most.lead.{c}").alias(f"{c}_u") for c in ("nid", "size", "s1", "s2")))
    fits = 100 * F.least("size", "size_u") >= percent * F.greatest("size", "size_u")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_u"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_u")))
    pick = F.min_by("nid_u", F.struct(apart.alias("a"), F.xxhash64("nid_u", F.lit(turn)).alias("o"))).alias("u")
    return marked.join(most, "half").where("root <> main").where(fits).groupBy(F.col("nid").alias("v")).agg(pick).select("u", "v")


def tables(marked: DataFrame) -> DataFrame:
    """Staged (key, nid, root): the tables' keys, pairs of half keys of either side, both of which meet another component."""
    met = marked.groupBy("half").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("half")
    of = lambda c: F.collect_set(F.when(c, F.col("half")))  # noqa: E731  at most HALVES of them
    sides = marked.join(met, "half", "left_semi").groupBy("nid", "root").agg(of(~F.col("side")).alias("a"), of(F.col("side")).alias("b"))
    pairs = sides.select("nid", "root", F.explode("a").alias("p"), "b").select("nid", "root", "p", F.explode("b").alias("q"))
    return staged(pairs.select(F.xxhash64("p", "q").alias("key"), "nid", "root"), "tables")


def _marked(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """``comp`` (nid, root) with the components that the links ``found`` (u, v) join."""
    edges = found.select("u", "v")
    for c in ("u", "v"):  # links between components, by their roots
        edges = edges.join(comp.select(F.col("nid").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    up = staged(components(edges).select(F.col("node").alias("nid"), F.col("root").alias("top")), "tops")
    old = comp.join(up.withColumnRenamed("nid", "root"), "root", "left").select("nid", F.coalesce("top", "root").alias("root"))
    new = up.join(comp.select("nid"), "nid", "left_anti").select("nid", F.col("top").alias("root"))
    out = staged(old.unionByName(new), "components")
    release(up, comp)
    return out


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int, hashes: Hashes) -> DataFrame:
    """Staged (nid, root): the component of every node that is linked with another.

    ``nodes`` (nid, node, doc_id, size, s1, s2, halves) has a row per distinct set.
    """
    spark = docs.sparkSession
    half = half_buckets(nodes, hashes.halves)
    suspects = staged(half.select("nid").distinct().join(nodes.select("nid", "node", "doc_id"), "nid"), "suspects")
    sets = node_sets(docs, suspects, k)
    comp = staged(spark.createDataFrame([], "nid long, root long"), "components")
    turn, productive = 0, True
    while productive:
        turn += 1
        marked = half.withColumn("root", F.col("nid")) if turn == 1 else staged(_marked(half, comp), "marked")
        pairs = staged(half_pairs(marked, turn, percent), "pairs")
        tested = confirm(pairs, sets, percent)
        n = tested.agg(F.count(F.lit(1)).alias("all"), F.count_if("linked").alias("linked")).first()
        comp = _joined(comp, tested.where("linked"))
        release(marked, pairs, tested)
        productive = n["linked"] >= PRODUCTIVE * n["all"] > 0
    marked = staged(_marked(half, comp), "marked")
    table, leaders, last = tables(marked), LEADERS, False
    release(half, marked, suspects)
    while not last:
        held = table.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
        held = held.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        several = staged(held.select("key", "n", F.col("most.root").alias("main"), F.greatest(F.lit(1.0), (F.col("n") - F.col("most.m")) / leaders).alias("share")), "several")
        last = several.where("share > 1").limit(1).isEmpty()  # then every node outside leads, and all that can be linked is
        outside = table.join(several, "key").where("root <> main").where(F.pmod(F.xxhash64("nid", F.lit(turn)), F.lit(1 << 20)) * F.col("share") <= F.lit(1 << 20))
        lead = staged(outside.select("key", F.col("nid").alias("u"), "root", "main", "n"), "lead")
        found = confirm_blocks(table, lead, sets, percent)
        turn, leaders = turn + 1, leaders << (4 if not found.isEmpty() else 40)  # what links nothing any more may as well be done at once
        comp = _joined(comp, found)
        if not last:
            old, table = table, staged(_marked(table.join(several, "key", "left_semi").drop("root"), comp), "tables")
            release(old)
        release(several, lead, found)
    release(sets, table)
    return comp


def near_duplicates(docs: DataFrame, k: int, percent: int = 80, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    hashes = Hashes(halves, rows)
    sketch = staged(sketches(docs, k, hashes), "sketches")
    usable = sketch.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.min("halves").alias("halves"))
    nodes = nodes.repartition(partitions(docs.sparkSession))  # each row becomes 2 * halves rows next, so few large partitions would be far too large
    nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # numbers hold once written
    comp = links(docs, nodes, k, percent, hashes)
    label = nodes.select("nid", "node", "doc_id").join(comp, "nid", "left").select("node", "doc_id", F.coalesce("root", "nid").alias("root"))
    least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = staged(label.join(least, "root").select("node", "component_id"), "labels")
    release(nodes, comp)
    out = sketch.select("doc_id", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: its smallest doc_id; of repeated rows under that id, one."""
    from pyspark.sql import Window as W

    judged = near_duplicates(docs, k, percent)
    gone = staged(judged.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few, rest = sifted(docs, "doc_id", sieve(gone))  # texts that surely stay are not shuffled
    left = few.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(rest)
    again = staged(left.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    if again.isEmpty():
        return left
    nth = "_".join(["nth", *left.columns])  # no column of the input has this name
    few = left.join(again, "doc_id", "left_semi").withColumn(nth, F.row_number().over(W.partitionBy("doc_id", "text").orderBy(F.lit(1))))
    few = few.where(F.col(f"`{nth}`") == 1).select(*[f"`{c}`" for c in docs.columns])
    return left.join(again, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(few)


def op9_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), 2)
