"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of units of ``unit`` tokens. In every round a queue
gets a quantum, its target proportion of a window of ``window`` tokens; it
sends a unit as soon as its saved quanta (its deficit) cover one, and what is
left over is carried to the next round. As quanta are constant, the round that
sends unit u of a queue with weight w of W in all is known in closed form,
``ceil((u + 1) * W / (w * units per window)) - 1``, so deficits carry over
windows and partitions without any task seeing another's rows: sorting units
by (round, source, u) is the schedule, and a distributed prefix sum gives
positions. While all queues last, every window has the target proportions, to
a unit a source; when one runs dry, the others share its place in proportion
to theirs.

The target is the sources' shares of all tokens, or ``mixture``; there, sources
without a proportion keep their shares, and those with 0 come after all others.

A task's queues end in a part unit. The part units of a source are joined over
the tasks, in their order, and cut into units again; only what is left of each
source after that, less than a unit, is cut into powers of two, which come
last, by falling size, so no unit crosses a window, and the last window, too,
falls into powers of two: nothing is padded.

Rows: a null text is the end id alone; null sources form one queue; repeated
rows are packed each; a null doc_id stays null; extra columns are ignored; an
empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import documents, prepare, running_total, staged
from tidewright.llm.tokens import encoded, tokenizer_path

WINDOW = 2048
UNIT = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, queue string, task int, unit long, size long, at long, ids binary"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


class _Queues:
    """The queues of one task: cuts documents at unit ends and holds the open units' ids."""

    def __init__(self, task: int, unit: int):
        self.task, self.unit = task, unit
        self.length: dict = {}
        self.open: dict = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, source, ids: np.ndarray) -> None:
        n, size = len(ids), self.unit
        q = self.length.get(source, 0)
        raw, wide = memoryview(ids).cast("B"), ids.itemsize
        cuts = [0, *range(size - q % size, n, size), n]
        open_ = self.open.get(source)
        if open_ is None:
            open_ = self.open[source] = []
        for a, b in zip(cuts, cuts[1:]):
            u, at = divmod(q + a, size)
            if at + b - a < size:
                open_.append((doc_id, a, n, at, ids[a:b]))
                continue
            for d, s, total, o, held in open_:
                self.rows.append((d, s, len(held), zlib.crc32(held.data), total, source, self.task, u, size, o, None))
            open_.clear()
            self.rows.append((doc_id, a, b - a, zlib.crc32(raw[a * wide: b * wide]), n, source, self.task, u, size, at, None))
        self.length[source] = q + n

    def close(self) -> None:
        """Hand each queue's last part unit on, with its ids, for the joined part units."""
        for source, open_ in self.open.items():
            for d, s, total, o, held in open_:
                self.rows.append((d, s, len(held), None, total, source, self.task, -1, 0, o, held.tobytes()))


def _edges(size: int) -> list[tuple[int, int]]:
    """Powers of two that add up to ``size``, from the largest, as (start, end)."""
    out, at = [], 0
    for k in reversed(range(size.bit_length())):
        if size >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


def cut_parts(parts: DataFrame, unit: int) -> DataFrame:
    """Cut the joined part units: ``parts`` has PIECE and place (in the source's joined parts), joined (their length), full (the source's full units)."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids, p, n = np.frombuffer(r["ids"], "<u4"), r["place"], r["length"]
                whole = r["joined"] // unit * unit
                ends = [*range(p - p % unit + unit, min(p + n, whole + 1), unit)]
                last = [(whole + a, whole + z) for a, z in _edges(r["joined"] - whole)]
                cuts = sorted({p, p + n, *ends, *(a for a, _ in last if p < a < p + n)})
                for a, z in zip(cuts, cuts[1:]):
                    lo, size = (a - a % unit, unit) if a < whole else next((x, y - x) for x, y in last if x <= a < y)
                    rows.append((r["doc_id"], r["start"] + a - p, z - a, zlib.crc32(ids[a - p: z - p].tobytes()), r["doc_tokens"], r["queue"], r["task"], r["full"] + a // unit, size, a - lo, None))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(_NAMES, map(pa.array, zip(*rows))))).cast(_schema())

    return parts.mapInArrow(cut, PIECE)


def _schema():
    import pyarrow as pa

    return pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(_NAMES, PIECE.split(", "))])


def cut_documents(docs: DataFrame, end_id: int = 1, unit: int = UNIT, path: str | None = None) -> DataFrame:
    """Tokenize once and cut every document at its task queues' unit ends (schema PIECE)."""
    path = path or tokenizer_path()

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        queues = _Queues(TaskContext.get().partitionId(), unit)

        def emit():
            out = pa.RecordBatch.from_pydict(dict(zip(_NAMES, map(pa.array, zip(*queues.rows)))))
            queues.rows = []
            return out.cast(_schema())

        for rows, ids, sizes in encoded(batches, path):
            full = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
            ends = np.cumsum(sizes + 1).tolist()
            a = 0
            for d, s, b in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), ends):
                queues.add(d, s, full[a:b])
                a = b
            if len(queues.rows) > 8_000:
                yield emit()
        queues.close()
        if queues.rows:
            yield emit()

    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, end_id: int = 1, path: str | None = None, mixture: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``mixture``: target proportions by source, at most 1 in all.
    """
    if window % unit or unit & (unit - 1) or window & (window - 1):
        raise ValueError("window and unit must be powers of two, unit no larger than window")
    if mixture and (min(mixture.values()) < 0 or sum(mixture.values()) > 1 + 1e-9):
        raise ValueError("proportions must not be negative, nor more than 1 in all")
    spark = docs.sparkSession
    prepare(spark)
    pieces = staged(cut_documents(docs, end_id, unit, path), "pieces")
    whole = (F.col("size") == unit) & (F.col("at") == 0)
    units = pieces.groupBy("task", "queue").agg(F.count_if(whole).alias("n"), F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("length"))), F.lit(0)).alias("p"))
    each = W.partitionBy("queue")  # a row per task
    so_far = lambda c: F.sum(c).over(each.orderBy("task")) - F.col(c)
    units = staged(units.select("task", "queue", so_far("n").alias("before"), so_far("p").alias("parts_before"), F.sum("n").over(each).alias("full"), F.sum("p").over(each).alias("joined")), "queues")
    queues = units.select("queue", (F.col("full") + F.floor(F.col("joined") / unit)).cast("double").alias("units")).distinct()
    queues = queues.crossJoin(F.broadcast(queues.agg(F.sum("units").alias("all"))))  # one row
    share = F.col("units") / F.col("all")
    if mixture:
        named = spark.createDataFrame([(f"={k}", float(v)) for k, v in mixture.items()], "queue string, aim double")
        queues = queues.join(F.broadcast(named), "queue", "left")  # the caller's proportions
        rest = F.broadcast(queues.agg(F.sum(F.when(F.col("aim").isNull(), share)).alias("unnamed")))
        queues = queues.crossJoin(rest)
        share = F.coalesce("aim", share / F.col("unnamed") * (1 - sum(mixture.values())))
        share = F.round(share * 1_000_000_000)
        queues = queues.select("queue", share.alias("weight"), F.lit(1e9).alias("weights"))
    else:
        queues = queues.select("queue", F.col("units").alias("weight"), F.col("all").alias("weights"))
    queues = staged(queues, "weights")
    parts = pieces.where("size = 0").join(units, ["task", "queue"]).withColumn("place", F.col("at") + F.col("parts_before"))
    parts = cut_parts(parts.select(*_NAMES, "place", "joined", "full"), unit)
    cut = pieces.where("size > 0").join(units.select("task", "queue", "before"), ["task", "queue"]).withColumn("unit", F.col("unit") + F.col("before")).select(*_NAMES)
    tokens = pieces.agg(F.sum("length").alias("t")).first()["t"] or 0
    full = F.col("size") == unit
    turn = F.ceil((F.col("unit") + 1) * F.col("weights") / (F.col("weight") * (window // unit))) - 1
    turn = F.when(~full, 0).when(F.col("weight") > 0, turn).otherwise((1 << 62))
    keyed = cut.unionByName(parts).join(queues, "queue").select(
        *_NAMES[:5], "queue", "at", (~full).cast("int").alias("tail"), (-F.col("size")).alias("fall"), turn.cast("long").alias("turn"), F.col("unit").alias("nth"))
    placed = running_total(keyed, ["tail", "fall", "turn", "queue", "nth", "at"], "length", "place", "placed")
    whole, rest = divmod(tokens, window)
    x = F.col("place") - whole * window
    seq, off, at, k = F.col("place") / window, F.col("place") % window, 0, whole
    seq = F.floor(seq)
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            inside = x >= at
            seq, off = F.when(inside, F.lit(k)).otherwise(seq), F.when(inside, x - at).otherwise(off)
            at, k = at + (1 << bit), k + 1
    source = F.when(F.col("queue") != "null", F.expr("substring(queue, 2)"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", seq.cast("long").alias("sequence_id"), off.cast("long").alias("offset"), source.alias("source"))


def op2_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
