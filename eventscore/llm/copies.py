"""Near copies by fingerprints, checked by similarity: links between texts whose shingle sets have a Jaccard similarity of at least a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected, in_small_batches, lean
from .simhash import U, close_fingerprints, fingerprints, xxh64_many

#: Shingles whose minima are taken at once.
PIECE = 1 << 15


def shingles(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, a wordless one has none."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, "u8")
    joined = b" ".join(w)
    gaps = np.flatnonzero(np.frombuffer(joined, "u1") == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    n = min(width, len(w))
    return np.unique(xxh64_many(joined, start[: len(w) - n + 1], (end[n - 1 :] - start[: len(w) - n + 1]), seed))


def factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype="u8") * U(2) + U(1)


def minima(sets: list[np.ndarray], mult: np.ndarray) -> np.ndarray:
    """Per set (none empty) the smallest value under each of the orders that mult gives."""
    out = np.full((len(sets), len(mult)), ~U(0), "u8")
    pieces = [(i, s[k : k + PIECE]) for i, s in enumerate(sets) for k in range(0, len(s), PIECE)]
    at = 0
    while at < len(pieces):
        stop, held = at, 0
        while stop < len(pieces) and (stop == at or held + len(pieces[stop][1]) <= PIECE):
            held += len(pieces[stop][1])
            stop += 1
        h = np.concatenate([p for _, p in pieces[at:stop]])
        starts = np.cumsum([0, *(len(p) for _, p in pieces[at : stop - 1])])
        owner = np.array([i for i, _ in pieces[at:stop]])
        for k, m in enumerate(mult):
            np.minimum.at(out[:, k], owner, np.minimum.reduceat(h * m, starts))
        at = stop
    return out


def blocks(batches: Iterator[pa.RecordBatch], pack: int) -> Iterator[pa.Table]:
    """The rows of batches, sorted by their first three columns, as one table for each value of these; read in packs of about pack rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(rows: pa.Table) -> np.ndarray:
        key = np.stack([rows.column(c).to_numpy() for c in range(3)])
        return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1

    def split(rows: pa.Table) -> Iterator[pa.Table]:
        at = [0, *cut(rows), rows.num_rows]
        for x, y in zip(at, at[1:], strict=False):
            yield rows.slice(x, y - x)

    for batch in batches:
        if not batch.num_rows:
            continue
        held, n = [*held, batch], n + batch.num_rows
        if n >= pack:
            rows = pa.Table.from_batches(held)
            cuts = cut(rows)
            if len(cuts):
                # the last block may go on in the next batch
                yield from split(rows.slice(0, cuts[-1]))
                held, n = rows.slice(cuts[-1]).to_batches(), rows.num_rows - int(cuts[-1])
    if held:
        yield from split(pa.Table.from_batches(held))


def near(size: np.ndarray, root: np.ndarray, marks: np.ndarray, similarity: float, floor: float) -> np.ndarray:
    """Whether a row of a block has a partner of another component whose size and marks don't rule the similarity out."""
    out = np.zeros(len(size), bool)
    for at in range(len(size) - 1):
        far = np.arange(at + 1, len(size))
        far = far[(root[far] != root[at]) & (np.minimum(size[far], size[at]) >= similarity * np.maximum(size[far], size[at]))]
        far = far[(marks[far] == marks[at]).mean(axis=1) >= floor] if len(far) else far
        out[far] = True
        out[at] |= len(far) > 0
    return out


def shared(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """How many members each two sets have in common, by products of 0/1 matrices of so many columns."""
    n = len(sets)
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = many[at] > 1
    owner, at = owner[often], (np.cumsum(many > 1) - 1)[at[often]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((n, n))
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        x, y = np.searchsorted(at, [low, low + columns])
        part = np.zeros((n, columns), "f4")
        part[owner[x:y], at[x:y] - low] = 1
        out += part @ part.T
    return out


def forest(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different components, no more than it takes to join what the links of the block join."""
    size = np.array([len(s) for s in sets])
    both = shared(sets)
    linked = np.triu(both >= similarity * (size[:, None] + size[None, :] - both), 1)
    now, out = root.copy(), []
    for x, y in zip(*np.nonzero(linked), strict=True):
        if now[x] != now[y]:
            now[now == now[y]] = now[x]
            out.append((int(x), int(y)))
    return out


@in_small_batches
def classes(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 7, bands: int = 30, rows: int = 4, seed: int = 42, block: int = 512) -> DataFrame:
    """(id, own, group) of every row, null ids too: group is the smallest vertex reachable over links.

    Texts are linked if the sets of their shingles of `width` words have a Jaccard similarity of at least `similarity`.
    Texts with one set are one vertex. Vertices meet by operator 1's fingerprints of `width` words: equal ones, and those
    within `radius` bits in its blocks, one pair a vertex; what their whole sets bear out is linked.

    64 bits don't hold every such pair (of sf0.1's 48, which differ in up to 14 bits, 13 lie within 7), and a radius that
    does holds unrelated texts too. So there is a way for the rest: vertices of different components that agree on all
    `rows` minima of one of `bands` bands are candidates (a pair at 0.8 meets in none of 30 bands of 4 with a chance of
    1.4e-7); those whose minima don't rule it out are compared by their whole sets. There every vertex meets the smallest
    one of all its bands, then every component the smallest one of each band, so a large group of copies costs about a
    comparison a row. Then, in bands that still hold several components, vertices meet in blocks of `block` rows, a large
    band's parts pairwise: those with a partner of another component that their minima don't rule out meet again with
    their whole sets, and a block gives the links that join its components, fewer than it has rows. No pair is left out,
    and the pairs of a group are never written.

    Null or wordless texts are copies of each other. Rows with equal ids are judged each by its text.
    """
    scratch = Scratch(spark, "copies")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    mult = factors(bands * rows, seed)
    floor = similarity - 5 * (similarity * (1 - similarity) / (bands * rows)) ** 0.5

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = b.column(2).cast(pa.large_binary()).to_pylist()
                sets = [shingles(t, width, seed) for t in texts]
                fps = fingerprints(texts, width, seed, PIECE)
                sizes = np.array([len(s) for s in sets], "i8")
                one = b"".join(s.tobytes() for s in sets)
                same = xxh64_many(one, 8 * (np.cumsum(sizes) - sizes), 8 * sizes, seed)
                full = np.flatnonzero(sizes)
                least = minima([sets[i] for i in full], mult)
                marks = np.zeros((b.num_rows, bands * rows), "u1")
                marks[full] = least >> U(17) & U(255)
                step, many = 8 * rows, len(full) * bands
                keys = xxh64_many(least.tobytes(), step * np.arange(many), np.full(many, step), seed)
                keys = xxh64_many((keys + np.tile(np.arange(bands, dtype="u8"), len(full))).tobytes(), 8 * np.arange(many), np.full(many, 8), seed)
                ends = np.cumsum(np.where(sizes > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.view("i8")))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same.view("i8")), pa.array(sizes), pa.array([m.tobytes() for m in marks], pa.binary()), lists, pa.array(fps.view("i8"))], ["id", "own", "same", "size", "marks", "keys", "fp"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(i).to_pylist()), "u1").reshape(-1, bands * rows) for i in (2, 3))
            at = pa.array(np.flatnonzero((s == t).mean(axis=1) >= floor))
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in (0, 1)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep, kept = [], {}
            for i in range(b.num_rows):
                # rows come sorted by one side, whose set is made once
                kept = {v: kept[v] if v in kept else shingles(b.column(k)[i].as_py().encode(), width, seed) for k, v in ((2, a[i]), (3, c[i]))}
                x, y = kept[a[i]], kept[c[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            keep = np.array(keep, "i8")
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], ["a", "b"])

    marked = src.select("id", F.xxhash64("text").alias("own"), "text").mapInArrow(lean(sketch), "id long, own long, same long, size long, marks binary, keys array<long>, fp long")
    marked = scratch.table(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    first = F.min(F.struct("row", "size", "fp")).alias("first")
    vertex = scratch.table(marked.groupBy("same").agg(first).select("same", "first.row", "first.size", "first.fp"), "vertex")
    # every vertex with the smallest one of its fingerprint, that with the smallest one of the least fingerprint it meets
    leads = scratch.table(vertex.where("size > 0").groupBy("fp").agg(F.min("same").alias("lead"), F.max("same").alias("last")), "leads")
    met = close_fingerprints(leads.select("fp"), spark, scratch, radius).groupBy("a").agg(F.min("b").alias("b"))
    la, lb = (leads.select(F.col("fp").alias(c), F.col("lead").alias(f"l{c}")) for c in "ab")
    equal = vertex.where("size > 0").join(leads.where("lead < last"), "fp").where("lead < same").select(F.col("lead").alias("x"), F.col("same").alias("y"))
    hashed = equal.union(met.join(la, "a").join(lb, "b").select("la", "lb"))
    hashed = scratch.table(hashed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "hash_pairs")
    keyed = marked.select(F.explode("keys").alias("k"), "same")
    met = scratch.table(keyed.groupBy("k").agg(F.min("same").alias("lead"), F.max("same").alias("last")).where("lead < last").select("k", "lead"), "met")
    mine = scratch.table(keyed.join(met, "k").select("k", "same", "lead").distinct(), "mine")
    ends = mine.select("same").union(hashed.select("a")).union(hashed.select("b")).distinct()
    need = scratch.table(ends.join(vertex, "same").select("row"), "need")
    sides = scratch.table(marked.join(need, "row", "left_semi").select("same", "own", "size", "marks"), "sides")
    scratch.drop("met", "need", "leads", "hot")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), a < b, those that are linked by their whole sets."""
        ends = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct().join(sides.select("same", "own"), "same")
        texts = src.select(F.xxhash64("text").alias("own"), "text").join(scratch.table(ends, f"{name}_ends"), "own").select("same", "text").dropDuplicates(["same"])
        texts = scratch.table(texts, f"{name}_texts")
        both = pairs.join(texts.select(F.col("same").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("same").alias("b"), F.col("text").alias("t")), "b")
        out = scratch.table(both.select("a", "b", "s", "t").mapInArrow(lean(compare), "a long, b long"), name)
        scratch.drop(f"{name}_ends", f"{name}_texts")
        return out

    x, y = (sides.select(F.col("same").alias(c), F.col("size").alias(f"z{c}"), F.col("marks").alias(f"m{c}")) for c in "ab")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.distinct().join(x, "a").join(y, "b").where(F.least("za", "zb") >= similarity * F.greatest("za", "zb")).select("a", "b", "ma", "mb")
        return scratch.table(both.mapInArrow(lean(alike), "a long, b long"), name)

    def components(edges: DataFrame, name: str) -> DataFrame:
        roots = scratch.table(connected(edges, Scratch(spark, "copies")), f"{name}_roots")
        return scratch.table(mine.select("k", "same").join(roots, mine["same"] == roots["v"], "left").select("k", "same", F.coalesce("root", "same").alias("root")), f"{name}_now")

    star = links(likely(hashed, "hash_likely"), "hashed")
    # of the rest one pair a vertex, with the smallest vertex that it meets
    now = components(star, "hashed")
    lead = now.groupBy("k").agg(F.min(F.struct("same", "root")).alias("lead"))
    first = now.join(lead, "k").where(F.col("root") != F.col("lead.root")).groupBy("same").agg(F.min("lead.same").alias("a")).select("a", F.col("same").alias("b"))
    star = star.union(links(likely(first, "star_pairs"), "star"))
    # then one pair a component and band that it is in
    now = components(star, "star")
    ends = now.groupBy("k", "root").agg(F.min("same").alias("same"))
    lead = ends.groupBy("k").agg(F.min(F.struct("root", "same")).alias("lead"), F.count("*").alias("n")).where("n > 1").select("k", "lead")
    second = ends.join(lead, "k").where(F.col("root") != F.col("lead.root")).select(F.least("same", "lead.same").alias("a"), F.greatest("same", "lead.same").alias("b"))
    star = star.union(links(likely(second, "again_pairs"), "again"))
    now = components(star, "again")
    scratch.drop("mine", "hash_pairs", "hash_likely", "star_pairs", "again_pairs", "hashed_now", "star_now")
    split = now.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("k", F.ceil(F.col("n") / block).cast("int").alias("s"))
    apart = now.join(scratch.table(split, "split"), "k").join(sides.select("same", "size", "marks"), "same")
    part = F.pmod(F.xxhash64("same"), F.col("s")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda q: F.struct(F.least(q, part).alias("i"), F.greatest(q, part).alias("j")))
    dealt = apart.withColumn("m", F.explode(meets)).select("k", "m.i", "m.j", "same", "size", "root", "marks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 4 * block):
            marks = np.frombuffer(b"".join(rows.column(6).to_pylist()), "u1").reshape(rows.num_rows, -1)
            keep = near(rows.column(4).to_numpy(), rows.column(5).to_numpy(), marks, similarity, floor)
            if keep.any():
                yield from rows.select(["k", "i", "j", "same", "root"]).filter(pa.array(keep)).to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, block):
            same = rows.column(3).to_numpy()
            found = forest([np.frombuffer(s, "u8") for s in rows.column(5).to_pylist()], rows.column(4).to_numpy(), similarity)
            ends = [sorted((same[x], same[y])) for x, y in found]
            yield pa.RecordBatch.from_arrays([pa.array([e[n] for e in ends], pa.int64()) for n in (0, 1)], ["a", "b"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                sets = [shingles(t, width, seed).tobytes() for t in some.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["same", "set"])

    dealt = dealt.repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j")
    fit = scratch.table(dealt.mapInArrow(lean(partnered), "k long, i int, j int, same long, root long"), "fit")
    ends = scratch.table(fit.select("same").distinct().join(sides.select("same", "own"), "same"), "rest_ends")
    texts = src.select(F.xxhash64("text").alias("own"), "text").join(ends, "own").select("same", "text").dropDuplicates(["same"])
    sets = scratch.table(texts.mapInArrow(lean(whole_sets), "same long, set binary"), "sets")
    again = fit.join(sets, "same").select("k", "i", "j", "same", "root", "set").repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j")
    edges = star.union(scratch.table(again.mapInArrow(lean(joined), "a long, b long").distinct(), "rest"))
    scratch.drop("now", "split", "sides", "vertex", "fit", "rest_ends", "sets")
    final = scratch.table(connected(edges, Scratch(spark, "copies")), "final")
    return marked.select("id", "own", "same").join(final, marked["same"] == final["v"], "left").select("id", "own", F.coalesce("root", "same").alias("group"))


def near_copies(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", **how) -> DataFrame:
    """doc_id and component_id (the smallest id of its class) of every row with an id; see classes."""
    found = Scratch(spark, "found").table(classes(docs, spark, id_col=id_col, **how), "classes")
    least = found.groupBy("group").agg(F.min("id").alias("component_id"))
    return found.where("id is not null").join(least, "group").select(F.col("id").alias(id_col), "component_id")
