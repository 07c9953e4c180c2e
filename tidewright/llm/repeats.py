"""Stretches of ``width`` units (words or bytes) that an earlier document also has.

The text stays in place: it is written once, in compressed slices, to the
shared folder, and only codes, requests, contexts and answers move.

1. *Anchors.* In each slice, positions whose ``gram``-unit code is least among
   some ``width - gram + 1`` neighbours. Equal stretches pick equal anchors and
   every stretch holds one. Occurrences with equal anchor and equal context
   (all units that a stretch over the anchor can reach), compared unit by unit,
   are one class; a slice sends one head per class, with its smallest doc_id.
2. *Meeting.* Per anchor code, in packed arrays: anchors of a single document
   are dropped; every head of the others is asked for its context.
3. *Resolving.* An anchor's contexts are sorted as suffixes, by the operator's
   own method, and yield, for each head and each number l of units that a
   stretch reaches left of the anchor, the smallest doc_id of an equal stretch.
4. *Cores.* Anchors with more than ``HOT`` heads are split. Heads with equal
   contexts are folded first, by the contexts themselves. All stretches for
   which l lies in a range hold a common core; contexts are grouped by (range,
   core code), and where a group is larger than ``GROUP`` the range is halved,
   which lengthens the core, down to single stretches, whose smallest doc_id is
   a minimum over equal stretches, grouped by the stretches themselves. Each
   group is resolved as above.
5. *Answers* meet the slices again, where whole texts are rewritten.

Codes (of words, grams and contexts) only bring candidates together. Contexts
travel as text, words are told apart by their bytes, and no stretch is removed
that has not been compared with another unit by unit.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import files
from tidewright.llm.common import new_path, partitions, prepare, staged
from tidewright.llm.textunits import anchors, give_back, mix, mix_int, rolling, slices, word_codes, words

SLICE = 2 << 20
BUCKET = 24 << 20
CHUNK = 16_384
GROUP = 16_384
HOT = 65_536
U = np.uint64
_EDGE = U(0x5851F42D4C957F2D)
_BYTE = mix(np.arange(256, dtype=np.uint64))

INDEX = "slice long, uri string, at long, size long"
NOTE = "slice long, kind int, uri string, at long, size long, payload binary"


class Kind:
    """What a unit is, and the stretch and anchor widths; fewer ``bits`` of codes make them clash, as tests do."""

    def __init__(self, name: str, width: int, gram: int, bits: int = 64):
        self.name, self.width, self.gram, self.mask = name, width, gram, U((1 << bits) - 1)
        self.reach = width - gram  # units a stretch can reach to either side of its anchor's gram

    def units(self, data: np.ndarray, off: np.ndarray):
        """(codes, first unit of each row, starts, ends); starts and ends are None for bytes."""
        if self.name == "byte":
            return _BYTE[data], off, None, None
        starts, ends, first = words(data, off)
        return word_codes(data, starts, ends) & self.mask, first, starts, ends

    def exact(self, data, code, starts, ends) -> np.ndarray:
        """Numbers of units, equal where the units are: bytes as they are, words by their codes where no two words share one, else by their bytes."""
        if self.name == "byte":
            return data
        order = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[order][1:] == code[order][:-1])
        if equal_words(data, starts, ends, order[same], order[same + 1]).all():
            return code
        raw, seen = data.tobytes(), {}
        return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def equal_words(data, starts, ends, i, j) -> np.ndarray:
    """Whether words i and j (arrays of places) have equal bytes, eight bytes a step."""
    size = ends[i] - starts[i]
    out = size == ends[j] - starts[j]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, k = np.flatnonzero(out), 0
    while len(live):
        left = size[live] - k
        shift = (U(64) - U(8) * np.minimum(left, 8).astype(np.uint64)) % U(64)
        differ = (eight[starts[i[live]] + k] ^ eight[starts[j[live]] + k]) << shift
        out[live] &= differ == 0
        k += 8
        live = live[(left > 8) & (differ == 0)]
    return out


class Occurrences:
    """The anchors of a slice and their classes, the same whenever the slice is read.

    ``exact`` numbers the units; a class's contexts are equal in these.
    """

    def __init__(self, kind: Kind, code: np.ndarray, first: np.ndarray, skip: np.ndarray, exact: np.ndarray):
        k, r = kind.gram, kind.reach
        self.code, self.first = code, first
        g = rolling(code, k)
        at = anchors(g, r + 1)
        row = np.searchsorted(first, at, side="right") - 1
        ok = (at + k <= first[row + 1]) & ~skip[row] & (first[row + 1] - first[row] >= kind.width)
        self.at, self.row = at[ok], row[ok]
        self.key = g[self.at] & kind.mask
        self.left = np.minimum(r, self.at - first[self.row])
        self.right = np.minimum(r, first[self.row + 1] - self.at - k)
        context = self._contexts(kind, g) & kind.mask
        order = np.lexsort((context, self.key))
        new = np.ones(len(order), bool)
        new[1:] = (self.key[order][1:] != self.key[order][:-1]) | (context[order][1:] != context[order][:-1])
        cls = np.empty(len(order), np.int64)
        cls[order] = np.cumsum(new) - 1
        lead = order[np.flatnonzero(new)][cls] if len(order) else order
        apart = np.flatnonzero(lead != np.arange(len(order)))
        apart = apart[~self._equal(kind, exact, apart, lead[apart])]
        cls[apart] = int(new.sum()) + np.arange(len(apart))  # a clash of codes: classes of their own
        self.cls, self.order = cls, np.argsort(cls, kind="stable")
        self.n = int(new.sum()) + len(apart)
        self.starts = np.searchsorted(cls[self.order], np.arange(self.n))

    def _equal(self, kind: Kind, exact: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the contexts of anchors i and j are equal, unit by unit."""
        lo, hi = self.left[i], self.right[i]
        out = (lo == self.left[j]) & (hi == self.right[j]) & (self.key[i] == self.key[j])
        a, b = self.at[i], self.at[j]
        for s in range(-kind.reach, kind.gram + kind.reach):
            live = np.flatnonzero(out & (s >= -lo) & (s < kind.gram + hi))
            out[live] &= exact[a[live] + s] == exact[b[live] + s]
        return out

    def _contexts(self, kind: Kind, g: np.ndarray) -> np.ndarray:
        """A code of all units from ``left`` before the gram to ``right`` after it."""
        k, r = kind.gram, kind.reach
        out = mix(self.left.astype(np.uint64) * U(1 << 20) + self.right.astype(np.uint64))
        full = np.flatnonzero((self.left == r) & (self.right == r))
        steps = sorted({*range(-r, 0, k), -min(r, k), 0, *range(k, r, k), r})
        c = out[full]
        for s in steps:  # grams that together cover the whole context
            c = mix(c ^ g[self.at[full] + s])
        out[full] = c
        part = np.flatnonzero((self.left < r) | (self.right < r))
        c, a, lo, hi = out[part], self.at[part], self.left[part], self.right[part]
        padded = np.concatenate([self.code, np.zeros(1, np.uint64)])
        for s in range(-r, k + r):
            inside = (s >= -lo) & (s < k + hi)
            c = mix(c ^ np.where(inside, padded[np.where(inside, a + s, 0)], _EDGE))
        out[part] = c
        return out


def _slice_rows(data, off, doc_ids):
    import pyarrow as pa

    import zstandard

    head = np.array([len(off)], "<i8").tobytes() + off.astype("<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + data.tobytes()), pa


def load_slice(uri: str, at: int, size: int):
    """(data, offsets, doc_ids, null flags) of a written slice."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(files.read_bytes(uri, at, size))
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    off = np.frombuffer(raw, "<i8", n, 8)
    null = np.frombuffer(raw, np.uint8, n - 1, 8 + 8 * n).astype(bool)
    ids = np.frombuffer(raw, "<i8", n - 1, 8 + 8 * n + n - 1)
    return np.frombuffer(raw, np.uint8, int(off[-1]), 8 + 8 * n + 9 * (n - 1)), off, ids, null


def write_slices(docs: DataFrame, folder: str) -> DataFrame:
    """Write doc_id and text as slices under ``folder``; returns the index (INDEX)."""
    files.make_folder(folder)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        me, n, name, stream, at, rows = TaskContext.get().partitionId(), 0, None, None, 0, []
        for part, data, off in slices(batches, "text", SLICE):
            if stream is None:
                name = f"{folder}/{uuid.uuid4().hex}"
                store, path = files.opened(name)
                stream = store.open_output_stream(path)
            blob, _ = _slice_rows(data, off, part.column(0).to_pylist())
            stream.write(blob)
            rows.append(((me << 32) + n, name, at, len(blob)))
            at, n = at + len(blob), n + 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict(dict(zip(("slice", "uri", "at", "size"), map(pa.array, zip(*rows)))))

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, INDEX), "slices")


def per_slice(index: DataFrame, notes: DataFrame | None, work, schema: str) -> DataFrame:
    """Run ``work(slice, data, off, ids, null, payloads)``, which yields record batches, on every slice with its notes' payloads.

    ``notes``: slice, payload. Only index rows and notes are shuffled.
    """
    spark = index.sparkSession
    rows = index.select("slice", F.lit(0).alias("kind"), "uri", "at", "size", F.lit(None).cast("binary").alias("payload"))
    if notes is not None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("at", "long"), ("size", "long"))]
        rows = rows.unionByName(notes.select("slice", F.lit(1).alias("kind"), *none, "payload"))
    n = max(2 * partitions(spark), 12)
    rows = rows.repartition(n, "slice").sortWithinPartitions("slice", "kind")

    def run(batches):
        now, held = None, []
        for b in batches:
            for s, kind, uri, at, size, payload in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    if now is not None:
                        yield from work(now[0], *load_slice(*now[1:]), held)
                    now, held = (s, uri, at, size), []
                elif now is not None and now[0] == s:
                    held.append(payload)
        if now is not None:
            yield from work(now[0], *load_slice(*now[1:]), held)
        give_back()

    return rows.mapInArrow(run, schema)


def heads(index: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """bucket, slice, payload: a slice's class heads by bucket of their anchor code.

    A head names its class by its place in the slice; the class's other places
    travel once, under a bucket number past the last.
    """

    def work(slice_, data, off, ids, null, _):
        import pyarrow as pa

        code, first, starts, ends = kind.units(data, off)
        occ = Occurrences(kind, code, first, null, kind.exact(data, code, starts, ends))
        if not occ.n:
            return
        doc = ids[occ.row[occ.order]]
        low, high = np.minimum.reduceat(doc, occ.starts), np.maximum.reduceat(doc, occ.starts)
        head = occ.order[occ.starts]
        key, place = occ.key[head] & U((1 << 40) - 1), occ.at[head]
        bucket = (mix(key) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        table, which = np.unique(low, return_inverse=True)
        wide, rows = 3 + (len(code) >= 1 << 24), []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b]: cuts[b + 1]]
            used, doc_at = np.unique(which[at], return_inverse=True)
            bits = 15 if len(used) < 1 << 15 else 31
            flagged = (doc_at | (high[at] > low[at]).astype(np.int64) << bits).astype(np.uint64)
            parts = [np.array([len(at), len(used), wide], "<u4").tobytes(), table[used].astype("<i8").tobytes()]
            parts += [_low_bytes(key[at], 5), _low_bytes(place[at].astype(np.uint64), wide), _low_bytes(flagged, (bits + 1) // 8)]
            rows.append((b, slice_, b"".join(parts)))
        other = np.ones(len(occ.order), bool)
        other[occ.starts] = False
        if other.any():
            pairs = np.stack([place[occ.cls[occ.order[other]]], occ.at[occ.order[other]]]).astype("<u4")
            rows.append((buckets + slice_ % buckets, slice_, pairs.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "slice", "payload"])

    return per_slice(index, None, work, "bucket int, slice long, payload binary")


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low(raw, at: int, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, count * n, at).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def parse_heads(raw):
    """(key, place, smallest doc_id, several documents) arrays of a payload."""
    n, m, wide = np.frombuffer(raw, "<u4", 3).tolist()
    table = np.frombuffer(raw, "<i8", m, 12)
    bits, at, out = 15 if m < 1 << 15 else 31, 12 + 8 * m, []
    for size in (5, wide, (bits + 1) // 8):
        out.append(_from_low(raw, at, n, size))
        at += size * n
    key, place, doc = out
    doc = doc.astype(np.int64)
    return key, place.astype(np.int64), table[doc & ((1 << bits) - 1)], doc >> bits == 1


ANSWER, ASKED, HOT_HEAD, PLACES = range(4)
MEET = "kind int, bucket int, slice long, payload binary, key long, place long, low long"
_ASK = np.dtype([("key", "<u8"), ("place", "<u4"), ("low", "<i8")])


def meet(sent: DataFrame, buckets: int) -> DataFrame:
    """Settle each bucket's anchors.

    Kinds of rows: ANSWER (slice, payload: a class of several documents of the
    slice has its smallest doc_id for owner); ASKED (bucket, slice, payload: the
    heads whose context is wanted, all those of anchors that two documents
    share); HOT_HEAD, a row per such head of an anchor with more than HOT of
    them; PLACES (slice, payload).
    """
    hot = HOT

    def settle(rows):
        slice_of, parts = [], []
        for s, raw in rows:
            parts.append(parse_heads(raw))
            slice_of.append(np.full(len(parts[-1][0]), s))
        key, place, doc, several = (np.concatenate(x) for x in zip(*parts))
        sl = np.concatenate(slice_of)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        st, of = np.flatnonzero(new), np.cumsum(new) - 1
        lo, hi = np.minimum.reduceat(doc[order], st), np.maximum.reduceat(doc[order], st)
        heads_ = np.diff(np.append(st, len(k)))
        some = order[((lo < hi) & (heads_ > 1))[of]]
        many = heads_[of[((lo < hi) & (heads_ > 1))[of]]] > hot
        within = np.flatnonzero(several)
        return sl, place, key, doc, some[~many], some[many], within

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in MEET.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        def emit(bucket, rows):
            sl, place, key, low, asked, many, within = settle(rows)
            out = []

            def by_slice(kind, which, pack):
                order = which[np.argsort(sl[which], kind="stable")]
                for a, b in _runs(sl[order]):
                    at = order[a:b]
                    out.append((kind, bucket, int(sl[at[0]]), pack(at), None, None, None))

            by_slice(ANSWER, within, lambda at: _pack_answers(place[at], 0, 255, low[at]))
            by_slice(ASKED, asked, lambda at: _packed(_ASK, key=key[at], place=place[at], low=low[at]))
            if out:
                yield table(out)
            if len(many):
                n = len(many)
                cols = [np.full(n, HOT_HEAD), np.full(n, bucket), sl[many], [None] * n, key[many].view(np.int64), place[many], low[many]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)

        now, rows = None, []
        for b in batches:
            for bucket, s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket >= buckets:
                    yield table([(PLACES, bucket, s, raw.as_py(), None, None, None)])
                    continue
                if bucket != now and rows:
                    yield from emit(now, rows)
                    rows = []
                now = bucket
                rows.append((s, raw.as_buffer()))
        if rows:
            yield from emit(now, rows)
        give_back()

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(run, MEET)


def _packed(kind: np.dtype, **columns) -> bytes:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for name, x in columns.items():
        out[name] = x
    return out.tobytes()


def _runs(x: np.ndarray):
    """(start, end) of runs of equal entries."""
    if not len(x):
        return []
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)]))


_ANSWER = np.dtype([("place", "<u4"), ("lo", "u1"), ("hi", "u1"), ("owner", "<i8")])


def _pack_answers(place, lo, hi, owner) -> bytes:
    return _packed(_ANSWER, place=place, lo=lo, hi=hi, owner=owner)


CORE = "lo int, hi int, core long, class long, low long, left int, right int, units binary"
_CORE = [x.split()[0] for x in CORE.split(", ")]


def _cut_contexts(kind: Kind, data, off, place):
    """(left, right, text, bounds): contexts of the anchors at ``place``; their text in a row, words with what is between them and a space behind."""
    code, first, starts, ends = kind.units(data, off)
    row = np.searchsorted(first, place, side="right") - 1
    left = np.minimum(kind.reach, place - first[row])
    right = np.minimum(kind.reach, first[row + 1] - place - kind.gram)
    a, z = place - left, place + kind.gram + right
    if kind.name == "word":
        a, z = starts[a], ends[z - 1] + 1
        data = np.concatenate([data, np.zeros(1, np.uint8)])
    size = z - a
    upto = np.concatenate([[0], np.cumsum(size)])
    text = data[np.arange(int(upto[-1])) + np.repeat(a - upto[:-1], size)]
    if kind.name == "word":
        text[upto[1:] - 1] = 32
    return left, right, text, upto


def unit_codes(kind: Kind, text: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Codes of the units of contexts in a row, equal where the units are."""
    if kind.name == "byte":
        return _BYTE[text]
    code, _, starts, ends = kind.units(text, upto)
    return mix(kind.exact(text, code, starts, ends))


def context_blobs(index: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """bucket, slice, payload: contexts of the asked heads, compressed."""
    notes = asked.select("slice", F.concat(F.encode(F.lpad(F.col("bucket").cast("string"), 12, "0"), "US-ASCII"), "payload").alias("payload"))

    def work(slice_, data, off, ids, null, payloads):
        import pyarrow as pa
        import zstandard

        if not payloads:
            return
        asks = [np.frombuffer(p, _ASK, offset=12) for p in payloads]
        ask = np.concatenate(asks)
        left, right, text, upto = _cut_contexts(kind, data, off, ask["place"].astype(np.int64))
        rows, at, pack = [], 0, zstandard.ZstdCompressor(level=1)
        for p, a in zip(payloads, asks):
            z = at + len(a)
            head = np.array([len(a)], "<u4").tobytes() + a.tobytes() + left[at:z].astype(np.uint8).tobytes() + right[at:z].astype(np.uint8).tobytes() + np.diff(upto[at: z + 1]).astype("<u4").tobytes()
            rows.append((int(p[:12]), slice_, pack.compress(head + text[upto[at]: upto[z]].tobytes())))
            at = z
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "slice", "payload"])

    return per_slice(index, notes, work, "bucket int, slice long, payload binary")


def _read_contexts(raw: bytes):
    """(asks, left, right, sizes, text) of a payload."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ask = np.frombuffer(raw, _ASK, n, 4)
    at = 4 + n * _ASK.itemsize
    left, right = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n)
    size = np.frombuffer(raw, "<u4", n, at + 2 * n)
    return ask, left.astype(np.int64), right.astype(np.int64), size.astype(np.int64), np.frombuffer(raw, np.uint8, offset=at + 6 * n)


def resolve_buckets(blobs: DataFrame, kind: Kind, buckets: int, solve) -> DataFrame:
    """slice, payload: the answers for all asked heads, a bucket at a time, its anchors in chunks of about CHUNK contexts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        from tidewright.llm.suffixes import Chunk

        unpack = zstandard.ZstdDecompressor()

        def emit(parts, slices_):
            ask, left, right, size, text = (np.concatenate(x) for x in zip(*parts))
            sl = np.repeat(slices_, [len(p[0]) for p in parts])
            upto = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(ask["key"], kind="stable")
            key = ask["key"][order]
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # of anchors
            found, a = [], 0
            while a < len(order):
                z = int(ends[max(np.searchsorted(ends, a + CHUNK, side="right") - 1, np.searchsorted(ends, a, side="right"))])
                some = order[a:z]
                own = np.concatenate([[0], np.cumsum(size[some])])
                part = text[np.arange(int(own[-1])) + np.repeat(upto[some] - own[:-1], size[some])]
                at, lo, hi, owner = solve(Chunk(kind, 0, kind.reach, key[a:z].astype(np.int64), ask["low"][some], left[some], right[some], unit_codes(kind, part, own)))
                found.append((sl[some[at]], ask["place"][some[at]], lo, hi, owner))
                a = z
            s, place, lo, hi, owner = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(s, kind="stable")
            rows = [(int(s[order[i]]), _pack_answers(*(x[order[i:j]] for x in (place, lo, hi, owner)))) for i, j in _runs(s[order])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["slice", "payload"])

        now, parts, of = None, [], []
        for b in batches:
            for bucket, s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != now:
                    if parts:
                        yield from emit(parts, of)
                    now, parts, of = bucket, [], []
                parts.append(_read_contexts(unpack.decompress(raw.as_buffer())))
                of.append(s)
        if parts:
            yield from emit(parts, of)
        give_back()

    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(run, "slice long, payload binary")


def contexts(index: DataFrame, hot: DataFrame, kind: Kind) -> DataFrame:
    """slice, place, key, low, left, right, units: a row per head of a hot anchor; words joined by one space."""
    listed = hot.select("slice", F.struct("place", "key", "low").alias("x")).groupBy("slice").agg(F.collect_list("x").alias("x"))  # at most a slice's classes

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            payloads = []
            for xs in b.column(1):
                v = {n: np.asarray(xs.values.field(n)).astype(np.int64) for n in ("place", "key", "low")}
                payloads.append(_packed(_ASK, key=v["key"].view(np.uint64), place=v["place"], low=v["low"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(payloads, pa.binary())], names=["slice", "payload"])

    def work(slice_, data, off, ids, null, payloads):
        import pyarrow as pa

        if not payloads:
            return
        ask = np.concatenate([np.frombuffer(p, _ASK) for p in payloads])
        left, right, text, upto = _cut_contexts(kind, data, off, ask["place"].astype(np.int64))
        raw, cut = text.tobytes(), upto.tolist()
        blobs = [raw[a:b] for a, b in zip(cut, cut[1:])]
        if kind.name == "word":
            blobs = [b" ".join(x.split()) for x in blobs]
        n = len(ask)
        i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slice_)), pa.array(ask["place"].astype(np.int64)), i64(ask["key"]), i64(ask["low"]), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "place", "key", "low", "left", "right", "units"])

    return per_slice(index, listed.mapInArrow(pack, "slice long, payload binary"), work, "slice long, place long, key long, low long, left int, right int, units binary")


def _units(kind: Kind, blobs: list[bytes]) -> np.ndarray:
    """Codes of the units of contexts, in a row."""
    if kind.name == "word":
        blobs = [b + b" " for b in blobs]
    return unit_codes(kind, np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]))


def _plain_codes(kind: Kind, units: bytes) -> np.ndarray:
    """Codes of a context's units that are the same in every task."""
    data = np.frombuffer(units, np.uint8)
    return kind.units(data, np.array([0, len(data)]))[0]


def halved(rows: DataFrame, kind: Kind) -> DataFrame:
    """Rows of either half of their range of l, with the code of its core.

    Stretches l in lo..hi need l units left and reach - l right of the gram, so
    all contain the units from lo left to reach - hi right of it. A context too
    short for the whole range is narrowed to the l that it can serve.
    """
    r, k = kind.reach, kind.gram

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for lo, hi, _, cls, low, left, right, units in zip(*cols):
                mid = (lo + hi) // 2
                code = None
                for a, z in ((lo, mid), (mid + 1, hi)):
                    if a > z or max(a, r - right) > min(z, left):
                        continue
                    code = _plain_codes(kind, units) if code is None else code
                    part = code[left - a: left + k + r - z]
                    if len(part) < a + k + r - z:
                        continue
                    out.append((a, z, _fold(part), cls, low, left, right, units))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=_CORE)

    return rows.mapInArrow(run, CORE)


_POWER = [1]
for _ in range(4096):
    _POWER.append(_POWER[-1] * 0x9E3779B97F4A7C15 % (1 << 64))
_POWERS = np.array(_POWER, np.uint64)


def _fold(code: np.ndarray) -> int:
    """A signed 64-bit code of a row of unit codes."""
    return int(np.array([mix_int(int((mix(code) * _POWERS[1: len(code) + 1]).sum(dtype=np.uint64)) + len(code))], np.uint64).view(np.int64)[0])


RESULT = "class long, lo int, hi int, owner long"


def resolve(cores: DataFrame, kind: Kind, solve) -> DataFrame:
    """Per class and run of l: the smallest doc_id of an equal stretch in another class, where it is below the class's own (RESULT).

    ``solve(chunk)`` handles whole groups of one range in memory.
    """
    spark = cores.sparkSession
    found = None
    rows = staged(halved(cores, kind), "cores")  # halves at once: a single core of the bare gram tells little

    def run(batches):
        import pyarrow as pa

        from tidewright.llm.suffixes import Chunk

        def emit(groups):
            lo, hi, core, cls, low, left, right, units = zip(*groups)
            i64 = lambda x: np.array(x, np.int64)
            at, a, z, owner = solve(Chunk(kind, lo[0], hi[0], i64(core), i64(low), i64(left), i64(right), _units(kind, units)))
            if len(at):
                cols = (i64(cls)[at], a.astype(np.int32), z.astype(np.int32), owner)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["class", "lo", "hi", "owner"])

        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != now:
                    if held and (row[:2] != now[:2] or len(held) >= GROUP):  # several groups of a range at once
                        yield from emit(held)
                        held = []
                    now = row[:3]
                held.append(row)
        if held:
            yield from emit(held)

    def stretches(batches):  # the one stretch of rows with lo = hi, as text
        import pyarrow as pa

        for b in batches:
            lo, cls, low, left, units = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lo", "class", "low", "left", "units"))
            cut = [u[f - l: f - l + kind.width] if kind.name == "byte" else b" ".join(u.split()[f - l: f - l + kind.width]) for l, f, u in zip(lo, left, units)]  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int32()), pa.array(cls, pa.int64()), pa.array(low, pa.int64()), pa.array(cut, pa.binary())], names=["lo", "class", "low", "stretch"])

    while True:
        sizes = rows.groupBy("lo", "hi", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = staged(sizes, "sizes")
        small = rows.join(sizes.where(F.col("n") <= GROUP).select("lo", "hi", "core"), ["lo", "hi", "core"], "left_semi")
        part = small.select(*_CORE).repartition(partitions(spark), "lo", "hi", "core").sortWithinPartitions("lo", "hi", "core", "low").mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
        large = sizes.where(F.col("n") > GROUP).select("lo", "hi", "core")
        if large.isEmpty():
            return staged(found, "owners")
        big = rows.join(large, ["lo", "hi", "core"], "left_semi")
        single = staged(big.where("lo = hi").select(*_CORE).mapInArrow(stretches, "lo int, class long, low long, stretch binary"), "stretches")
        least = staged(single.groupBy("lo", "stretch").agg(F.min("low").alias("owner")), "least")
        same = single.join(least, ["lo", "stretch"]).where("owner < low").select("class", "lo", F.col("lo").alias("hi"), "owner")
        found = found.unionByName(same)
        rows = staged(halved(big.where("lo < hi").select(*_CORE), kind), "cores")


def hot_answers(index: DataFrame, hot: DataFrame, kind: Kind, solve) -> DataFrame:
    """slice, payload: the answers for heads of anchors with more than HOT of them."""
    met = staged(contexts(index, hot, kind), "contexts")
    same = ["key", "left", "right", "units"]
    classes = staged(met.groupBy(*same).agg(F.min("low").alias("low")).withColumn("class", F.monotonically_increasing_id()), "classes")  # numbers hold once written
    heads_ = staged(met.select("slice", "place", *same).join(classes, same).select("slice", "place", "class", "low"), "members")
    cores = classes.select(F.lit(0).alias("lo"), F.lit(kind.reach).alias("hi"), F.lit(0).cast("long").alias("core"), "class", "low", "left", "right", "units")
    owners = resolve(cores, kind, solve)
    lower = heads_.join(owners, "class").select("slice", "place", F.col("lo").alias("a"), F.col("hi").alias("z"), "owner")
    whole = heads_.select("slice", "place", F.lit(0).alias("a"), F.lit(255).alias("z"), F.col("low").alias("owner"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            s, c, a, z, o = (np.asarray(x) for x in b.columns)
            order = np.argsort(s, kind="stable")
            rows = [(int(s[order[i]]), _pack_answers(*(x[order[i:j]] for x in (c, a, z, o)))) for i, j in _runs(s[order])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "payload"])

    return lower.unionByName(whole).mapInArrow(pack, "slice long, payload binary")


def stretch_answers(index: DataFrame, kind: Kind, solve) -> DataFrame:
    """slice, payload: the answers (packed _ANSWER) and the places of a slice's classes.

    There is a bucket of anchor codes for every BUCKET bytes of stored text, so
    that a bucket does not grow with the corpus.
    """
    spark = index.sparkSession
    stored = index.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(spark), 12, -(-stored // BUCKET))
    met = staged(meet(heads(index, kind, buckets), buckets), "met")
    blobs = context_blobs(index, met.where(F.col("kind") == ASKED), kind)
    answers = met.where(F.col("kind") == ANSWER).select("slice", "payload").unionByName(resolve_buckets(blobs, kind, buckets, solve))
    hot = met.where(F.col("kind") == HOT_HEAD).select("slice", "place", "key", "low")
    if not hot.isEmpty():
        answers = answers.unionByName(hot_answers(index, hot, kind, solve))
    places = met.where(F.col("kind") == PLACES).select("slice", F.concat(F.lit(b"P"), "payload").alias("payload"))
    return answers.select("slice", F.concat(F.lit(b"A"), "payload").alias("payload")).unionByName(places)


def covered_units(kind: Kind, n: int, first, ids, payloads) -> np.ndarray:
    """Which of a slice's n units lie in a stretch that a smaller doc_id also has."""
    cover = np.zeros(n + 1, np.int64)
    answers = [np.frombuffer(p, _ANSWER, offset=1) for p in payloads if p[:1] == b"A"]
    if answers:
        ans = np.concatenate(answers)
        pairs = [np.frombuffer(p, "<u4", offset=1).reshape(2, -1) for p in payloads if p[:1] == b"P"]
        head, place = np.concatenate(pairs, axis=1).astype(np.int64) if pairs else np.zeros((2, 0), np.int64)
        order = np.argsort(head, kind="stable")
        head, place = head[order], place[order]
        at = ans["place"].astype(np.int64)
        a, b = np.searchsorted(head, at, "left"), np.searchsorted(head, at, "right")
        which = np.repeat(np.arange(len(at)), b - a)
        more = place[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]]
        which, at = np.concatenate([np.arange(len(at)), which]), np.concatenate([at, more])
        row = np.searchsorted(first, at, side="right") - 1
        lo = np.maximum(ans["lo"].astype(np.int64)[which], kind.reach - (first[row + 1] - at - kind.gram))
        hi = np.minimum(np.minimum(ans["hi"].astype(np.int64)[which], kind.reach), at - first[row])
        ok = (ans["owner"][which] < ids[row]) & (lo <= hi)
        cover += np.bincount(at[ok] - hi[ok], minlength=n + 1) - np.bincount(at[ok] - lo[ok] + kind.width, minlength=n + 1)
    return np.cumsum(cover[:-1]) > 0


def rewrite(docs: DataFrame, kind: Kind, solve, finish, schema: str) -> DataFrame:
    """Find the stretches and run ``finish(data, off, first, starts, ends, covered)`` on every slice; it yields columns beside doc_id."""
    prepare(docs.sparkSession)
    index = write_slices(docs, new_path(docs.sparkSession, "text"))
    answers = stretch_answers(index, kind, solve)

    def work(slice_, data, off, ids, null, payloads):
        import pyarrow as pa

        code, first, starts, ends = kind.units(data, off)
        cover = covered_units(kind, len(code), first, ids, payloads)
        columns = finish(data, off, first, starts, ends, cover)
        doc = pa.array(ids.astype(np.int64), mask=null)
        yield pa.RecordBatch.from_arrays([doc, *columns], names=[x.split()[0] for x in schema.split(", ")])

    return per_slice(index, answers, work, schema)
