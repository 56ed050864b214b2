"""SimHash near-duplicates: links at a Hamming radius, found by bit-sliced comparison, and their components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected

#: XXH64's primes (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
U = np.uint64


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64_many(buf: bytes, at: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of buf: the hash's steps, each over all the slices that need it."""
    if not len(at):
        return np.zeros(0, "u8")
    buf = buf + b"\0" * 8
    n = len(buf) - 7
    as8 = np.ndarray((n,), "<u8", buf, strides=(1,))
    as4 = np.ndarray((n,), "<u4", buf, strides=(1,))
    as1 = np.frombuffer(buf, "u1")
    at, size = at.astype("i8"), size.astype("i8")
    h = np.full(len(at), (int(P5) + seed) & (2**64 - 1), "u8")
    pos = at.copy()
    if len(idx := np.flatnonzero(size >= 32)):
        first = [(seed + int(P1) + int(P2)) & (2**64 - 1), (seed + int(P2)) & (2**64 - 1), seed, (seed - int(P1)) & (2**64 - 1)]
        acc = [np.full(len(idx), v, "u8") for v in first]
        stripes, k = size[idx] // 32, 0
        while len(run := np.flatnonzero(stripes > k)):
            p = pos[idx[run]] + 32 * k
            for j in range(4):
                acc[j][run] = _rot(acc[j][run] + as8[p + 8 * j] * P2, 31) * P1
            k += 1
        x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for j in range(4):
            x = (x ^ (_rot(acc[j] * P2, 31) * P1)) * P1 + P4
        h[idx] = x
        pos[idx] += stripes * 32
    h += size.astype("u8")
    left = size % 32
    for k in range(3):
        if not len(idx := np.flatnonzero(left >= 8 * (k + 1))):
            break
        x = h[idx] ^ (_rot(as8[pos[idx] + 8 * k] * P2, 31) * P1)
        h[idx] = _rot(x, 27) * P1 + P4
    pos += left // 8 * 8
    left = left % 8
    if len(idx := np.flatnonzero(left >= 4)):
        x = h[idx] ^ (as4[pos[idx]].astype("u8") * P1)
        h[idx] = _rot(x, 23) * P2 + P3
        pos[idx] += 4
        left[idx] -= 4
    for k in range(3):
        if not len(idx := np.flatnonzero(left > k)):
            break
        h[idx] = _rot(h[idx] ^ (as1[pos[idx] + k].astype("u8") * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def fingerprints(texts: list[bytes | None], width: int = 4, seed: int = 42, piece: int = 1 << 17) -> np.ndarray:
    """A fingerprint a text. Long texts go through in pieces of so many shingles, so memory stays bounded."""
    out = np.zeros(len(texts), "u8")
    shift = U(1) << np.arange(64, dtype="u8")
    buf, ats, sizes, owner, held = [], [], [], [], 0
    counts: dict[int, tuple[np.ndarray, int]] = {}
    at0 = 0

    def flush() -> None:
        nonlocal buf, ats, sizes, owner, held, at0
        if held:
            h = xxh64_many(b"".join(buf), np.concatenate(ats), np.concatenate(sizes), seed)
            bits = np.unpackbits(h.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *(n for _, n in owner[:-1])])
            sums = np.add.reduceat(bits, starts, axis=0, dtype="u4")
            for (i, n), s in zip(owner, sums, strict=True):
                if i in counts:
                    s, n = s + counts[i][0], n + counts[i][1]
                counts[i] = (s, n)
        buf, ats, sizes, owner, held, at0 = [], [], [], [], 0, 0

    for i, text in enumerate(texts):
        w = (text or b"").lower().split()
        if not w:
            continue
        joined = b" ".join(w)
        gaps = np.flatnonzero(np.frombuffer(joined, "u1") == 32)
        start = np.concatenate([[0], gaps + 1])
        end = np.concatenate([gaps, [len(joined)]])
        if len(w) >= width:
            start, end = start[: len(w) - width + 1], end[width - 1 :]
        else:
            start, end = start[:1], end[-1:]
        buf.append(joined)
        for k in range(0, len(start), piece):
            s, e = start[k : k + piece], end[k : k + piece]
            ats.append(s + at0)
            sizes.append(e - s)
            owner.append((i, len(s)))
            held += len(s)
            if held >= piece and k + piece < len(start):
                flush()
                buf, at0 = [joined], 0
        at0 += len(joined)
        if held >= piece:
            flush()
    flush()
    if counts:
        at = np.fromiter(counts, "i8")
        sums = np.stack([s for s, _ in counts.values()])
        n = np.array([n for _, n in counts.values()], "u4")
        out[at] = np.where(2 * sums > n[:, None], shift, U(0)).sum(axis=1, dtype="u8")
    return out


def close_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j whose fingerprints differ in at most radius (under 8) bits, by bit-sliced comparison.

    Plane p holds bit p of every fingerprint, 64 to a word. A query's distances to 64 fingerprints grow at once: two
    planes of differences enter three vertical counter bits through a carry-save adder, a count of 8 stays marked.
    every 16 planes, words in which all 64 distances exceed the radius are given up.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((64, words * 64), "u1")
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    flip = np.where(bits[:, :n] == 1, ~U(0), U(0))
    void = np.zeros(words * 64, "u1")
    void[n:] = 1
    void = np.packbits(void, bitorder="little").view("<u8")
    # a word before the query's own holds only pairs that are found from the other side
    q, w = np.nonzero(np.arange(words)[None, :] >= (np.arange(n) // 64)[:, None])
    ones = np.zeros(len(q), "u8")
    twos, fours, over = ones.copy(), ones.copy(), void[w]

    def beyond() -> np.ndarray:
        gt, eq = over.copy(), ~U(0)
        for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
            if radius & bit:
                eq = eq & plane
            else:
                gt |= eq & plane
                eq = eq & ~plane
        return gt

    for p in range(0, 64, 2):
        a, b = planes[p][w] ^ flip[p][q], planes[p + 1][w] ^ flip[p + 1][q]
        u = ones ^ a
        carry = (ones & a) | (u & b)
        ones = u ^ b
        c = twos & carry
        twos ^= carry
        d = fours & c
        fours ^= c
        over |= d
        if p % 16 == 14:
            keep = np.flatnonzero(~beyond())
            if len(keep) < len(q):
                q, w, ones, twos, fours, over = (x[keep] for x in (q, w, ones, twos, fours, over))
            if not len(q):
                return np.zeros(0, "i8"), np.zeros(0, "i8")
    near = np.unpackbits((~beyond()).view("u1").reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(near)
    i, j = q[row], w[row] * 64 + bit
    return i[i < j], j[i < j]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A label a vertex: the smallest vertex of its component."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label


def linked(batches: Iterator[pa.RecordBatch], radius: int, pack: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, i, j, fp), sorted by the first four: the links that join each block's components.

    Whole blocks are packed together up to about pack rows and compared at once; links found across blocks are true as well.
    """
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch | None:
        rep = rows[4].astype("i8")
        i, j = close_pairs(rep.view("u8"), radius)
        if not len(i):
            return None
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), "i8")
        rank[order] = np.arange(len(rep))
        label = spanning(len(rep), rank[i], rank[j])
        at = np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[order][at]), pa.array(rep[order][label[at]])], ["a", "b"])

    def work(rows: np.ndarray, last: bool) -> Iterator[np.ndarray]:
        cuts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
        if last:
            cuts = np.append(cuts, rows.shape[1])
        start = done = 0
        for cut in cuts:
            if cut - start > pack and done > start:
                yield rows[:, start:done]
                start = done
            done = cut
            if done - start >= pack:
                yield rows[:, start:done]
                start = done
        if last and done > start:
            yield rows[:, start:done]
            start = done
        held[:] = [rows[:, start:]]

    for batch in batches:
        if batch.num_rows:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns])
            for block in work(np.concatenate([*held, rows], axis=1), False):
                if (out := edges(block)) is not None:
                    yield out
    if held:
        for block in work(held[0], True):
            if (out := edges(block)) is not None:
                yield out


def masks(pieces: int, radius: int) -> list[int]:
    """Masks of the pieces that two fingerprints within the radius share: any pieces - radius of them."""
    cut = [64 * i // pieces for i in range(pieces + 1)]
    part = [((1 << cut[i + 1]) - 1) & ~((1 << cut[i]) - 1) for i in range(pieces)]
    return [sum(part[i] for i in c) for c in combinations(range(pieces), pieces - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_frame(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(id, own, fp): every row's id, hash of its text and fingerprint, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(2).cast(pa.large_binary()).to_pylist(), width, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view("i8"))], ["id", "own", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("own"), text.alias("text")).mapInArrow(run, "id long, own long, fp long")


def close_fingerprints(fps: DataFrame, spark: SparkSession, scratch: Scratch, radius: int, *, block: int = 1024, mean_block: int = 4096) -> DataFrame:
    """Links (a, b), a > b, of different fingerprints (a written table of one column fp) that join what lies within the
    radius: in every block each fingerprint with the smallest one of its component there."""
    if not 0 <= radius < 8:
        raise ValueError("radius must be from 0 to 7")
    total, pieces = fps.count(), radius + 1
    while total / 2 ** (64 * (pieces - radius) // pieces) > mean_block:
        pieces += 1
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks(pieces, radius))))).alias("e")).select("e.t", "e.k", "fp")
    hot = scratch.table(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > block).select("t", "k", F.ceil(F.col("n") / block).cast("int").alias("s")), "hot")
    part = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    meets = F.when(F.col("s").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1), lambda x: F.struct(F.least(x, part).alias("i"), F.greatest(x, part).alias("j")))
    )
    dealt = keyed.join(hot, ["t", "k"], "left").select("t", "k", F.explode(meets).alias("m"), "fp").select("t", "k", "m.i", "m.j", "fp")
    # so many blocks' rows a task; small inputs keep the session's number
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * math.comb(pieces, radius) / 2_000_000))
    dealt = dealt.repartition(parts, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(lambda b: linked(b, radius, block), "a long, b long")


def classes(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42, block: int = 1024, mean_block: int = 4096) -> DataFrame:
    """(id, own, fp, group) of every row, null ids too: group is the smallest fingerprint reachable over links."""
    scratch = Scratch(spark, "simhash")
    marked = scratch.table(fingerprint_frame(docs, id_col, text_col, width, seed), "marked")
    fps = scratch.table(marked.select("fp").distinct(), "fps")
    edges = close_fingerprints(fps, spark, scratch, radius, block=block, mean_block=mean_block)
    roots = scratch.table(connected(edges, scratch), "roots")
    return marked.join(roots, marked["fp"] == roots["v"], "left").select("id", "own", "fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row.

    Texts with one fingerprint are one vertex. Two fingerprints within the radius agree on some pieces of their bits;
    rows meet in blocks by those bits, with as many pieces as keep a mean block under mean_block. Blocks over `block`
    rows are split and their parts meet pairwise, so no task ever holds an unbounded group, and no row is dropped.

    Null or wordless text: fingerprint zero, linked like any other. Null id: the row keeps its fingerprint and links as
    any other; its component_id is the smallest id of its component (null if none has an id). Rows with equal ids are
    judged each by its text. An empty table gives an empty result. Other columns are not read.
    """
    found = Scratch(spark, "found").table(classes(docs, spark, id_col=id_col, **how), "classes")
    least = found.groupBy("group").agg(F.min("id").alias("component_id"))
    return found.join(least, "group").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = classes, **how) -> DataFrame:
    """docs with one row of each group of near-duplicates, with all its columns: the one with the smallest id (null ids
    last), of equal ids the one with the smallest hash of its text.

    find gives the groups as rows (id, own, group): classes, or copies.classes. Rows equal in id and text are one
    document, of which one stays. The rows that go are taken out by a join on id and text hash, which moves texts only
    if those rows are too many to broadcast by their table's size; only documents that stand there twice are dealt out.
    """
    scratch = Scratch(spark, "chosen")
    seen = scratch.table(find(docs, spark, id_col=id_col, text_col=text_col, **how).groupBy("group", "id", "own").agg(F.count("*").alias("n")), "seen")
    best = seen.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "own")).alias("best"))
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("own") == F.col("best.own"))
    key = [F.col("id").alias("__es_id"), F.col("own").alias("__es_of")]
    told = scratch.table(seen.join(best, "group").select(*key, "n", same.alias("stays")), "told")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*cols, F.xxhash64(F.col(text_col).cast("string")).alias("__es_own"))
    met = F.col(id_col).cast("long").eqNullSafe(F.col("__es_id")) & (F.col("__es_own") == F.col("__es_of"))
    left = named.join(scratch.table(told.where("not stays").select("__es_id", "__es_of"), "goes"), met, "left_anti")
    twice = scratch.table(told.where("stays and n > 1").select("__es_id", "__es_of"), "twice")
    if twice.isEmpty():
        return left.select(*cols)
    return left.join(twice, met, "left_anti").union(left.join(twice, met, "left_semi").dropDuplicates([id_col, "__es_own"])).select(*cols)
