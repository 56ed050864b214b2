"""Token ids as files of independent zstandard frames with a trailing seek table and a checksum a frame.

A file is: data frames of up to frame_tokens ids (little-endian, 2 or 4 bytes), cut without regard to documents; a
skippable frame with the documents (first position, number of ids, id); and the seek table of the public seekable
format, itself a skippable frame: (compressed size, size, low 32 bits of the content's XXH64) a frame, then the number
of frames, flags and a magic number. Any zstandard program reads the whole file; a reader with the table decompresses
only the frames that hold the documents asked for.
"""

from __future__ import annotations

import gc
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, Scratch, lean, open_store, small_batches

SKIP, TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DOC = np.dtype([("at", "<u8"), ("n", "<u8"), ("named", "u1"), ("id", "<i8")])


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer (its file as JSON) gives a text's ids as those of its pieces between blanks, one after the other.

    It does if no step of it looks over a blank: the normalizer composes (NFC), lowers case, and makes white space
    blanks at most; the pre-tokenizer keeps only matches of an expression, none of whose alternatives takes white space;
    nothing is put in front; and no added token holds white space. Of any other tokenizer nothing is assumed.
    """
    steps = lambda x, many: [] if not x else [s for y in x[many] for s in steps(y, many)] if x["type"] == "Sequence" else [x]
    normal, cut = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ") for x in normal)
    if not plain or not cut or cut[0]["type"] != "Split" or cut[0]["behavior"] != "Removed" or not cut[0]["invert"] or "Regex" not in cut[0]["pattern"]:
        return False
    # each alternative: characters without white space, or one class that leaves white space out
    safe = regex.compile(r"[^\s\\\[\](){}.*+?^$|]+|\[(?:\\p\{[LNPSM]\w*\}|[^\s\\\[\]^-])+\]\+?|\[\^\\s(?:\\p\{\w+\}|[^\\\[\]])*\]\+?")
    if not all(safe.fullmatch(x) for x in cut[0]["pattern"]["Regex"].split("|")):
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in cut[1:]):
        return False
    return not any(c.isspace() for t in spec.get("added_tokens") or () for c in t["content"])


#: Alternatives of a pre-tokenizer's expression that all end between a letter or digit and a sign (fixed values).
RUNS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "[\\p{L}]+", "\\p{L}+", "[\\p{N}]", "[\\p{N}]+", "\\p{N}+", "[^\\s\\p{L}\\p{N}]+"}
#: Signs at a piece's end that are cut off; no apostrophe, which begins contractions.
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def cuts_at_signs(spec: dict) -> bool:
    """Whether, beside blanks, a text may be cut behind a plain letter or digit where signs follow."""
    first = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else spec["pre_tokenizer"]
    return cuts_at_blanks(spec) and set(first["pattern"]["Regex"].split("|")) <= RUNS


class Encoder:
    """Ids of whole texts. Where the tokenizer allows it (cuts_at_blanks) a text is cut at plain spaces and line ends, and
    a memory of at most `most` bytes keeps the ids of the pieces that come again; the ids are those of the whole text's
    encoding. With any other tokenizer whole texts are encoded.

    New pieces go to the library many at a time, with a mark between them that is one id and in none of them.
    """

    #: Candidates for the mark: signs that are no letters; the first that is a single id is used.
    MARKS = "\u00b6\u00a7\u2022\u2665\u2764\u2605\u20ac\u2026\u00bb"
    #: Bytes that an entry takes beside its characters and ids: two objects' heads and its place in the table.
    ENTRY = 200
    _kept: dict[tuple[str, int], Encoder] = KEPT.setdefault("encoders", {})

    def __init__(self, path: str, most: int = 200 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.cuts = cuts_at_blanks(spec)
        self.signs = self.cuts and cuts_at_signs(spec)
        self.lowers = any(x["type"] == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": ""}]))
        self.added = [t["content"][:2].lower() for t in spec.get("added_tokens") or ()]
        self.most, self.held, self.young, self.old = most, 0, {}, {}
        single = [(m, ids[0]) for m in self.MARKS if len(ids := self.tok.encode(m, add_special_tokens=False).ids) == 1]
        self.sign, self.mark = single[0] if single else ("", None)
        # which ids end a word, where the model says so by a suffix and takes runs of letters as words
        suffix = spec["model"].get("end_of_word_suffix") if self.signs and spec["model"]["type"] == "BPE" and not spec["model"].get("unk_token") else None
        self.closing = np.zeros(1 + max(self.tok.get_vocab().values()), bool) if suffix else None
        if suffix:
            self.closing[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str, most: int = 200 << 20) -> Encoder:
        if (path, most) not in cls._kept:
            cls._kept[path, most] = cls(path, most)
        return cls._kept[path, most]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if self.closing is not None:
            # words of plain letters need no mark, each is one word of the tokenizer's and ends in a closing id
            words = [p for p in pieces if p.isascii() and p.isalpha()]
            for k in range(0, len(words), 4096):
                some = words[k : k + 4096]
                ids = np.frombuffer(self._ids([" ".join(some)])[0], self.dtype)
                ends = np.flatnonzero(self.closing[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                    self.young.update(zip(some, [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
            pieces = [p for p in pieces if p not in self.young]
        plain = [p for p in pieces if self.mark is not None and self.sign not in p]
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.frombuffer(self._ids([f" {self.sign} ".join(some)])[0], self.dtype)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(some) - 1:
                raw, w = ids.tobytes(), self.dtype.itemsize
                starts, ends = [0, *((at + 1) * w).tolist()], [*(at * w).tolist(), len(raw)]
                self.young.update(zip(some, [raw[x:y] for x, y in zip(starts, ends, strict=True)], strict=True))
        rest = [p for p in pieces if p not in self.young]
        self.young.update(zip(rest, self._ids(rest), strict=True))

    def _learn_parts(self, pieces: list[str]) -> None:
        """Learns pieces by their words and the signs behind them, each of which comes again in other pieces."""
        parts, rest, added = [], [], self._added_in(pieces)
        for p in pieces:
            word = p.rstrip(SIGNS)
            if word and len(word) < len(p) <= 64 and word[-1] in PLAIN and p not in added:
                parts.append((p, word, p[len(word) :]))
            else:
                rest.append(p)
        known = self.young
        fresh = {x for _, *two in parts for x in two if x not in known} - set(rest)
        self._learn([*fresh, *rest])
        self.held += 3 * sum(map(len, fresh)) + self.ENTRY * len(fresh)
        known.update((p, known[a] + known[b]) for p, a, b in parts)

    def _lowered(self, t: str) -> str:
        """In lower case, so that pieces come again more often; not where the start of an added token stands or other letters do."""
        low = t.lower() if t.isascii() else t
        return t if any(a in low for a in self.added) else low

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, each from memory or learned."""
        if self.held > self.most // 2:
            # the older half goes; what is still in use moves over
            self.old, self.young, self.held = self.young, {}, 0
        out = list(map(self.young.get, pieces))
        missed = [k for k, x in enumerate(out) if x is None]
        if not missed:
            return out
        new = list(dict.fromkeys(pieces[k] for k in missed))
        self.young.update((p, x) for p, x in zip(new, map(self.old.get, new), strict=True) if x is not None)
        if learn := [p for p in new if p not in self.young]:
            self._learn_parts(learn) if self.signs else self._learn(learn)
        for k in missed:
            out[k] = self.young[pieces[k]]
        # long pieces hardly come again; the others' ids take two bytes a character at most
        for p in (long := [p for p in new if len(p) > 64]):
            del self.young[p]
        self.held += 3 * (sum(map(len, new)) - sum(map(len, long))) + self.ENTRY * (len(new) - len(long))
        return out

    def _added_in(self, pieces: list[str]) -> set[str]:
        """The pieces that hold the start of an added token."""
        every = "\n".join(pieces).lower()
        return {p for p in pieces if any(a in p.lower() for a in self.added)} if any(a in every for a in self.added) else set()

    def encode_array(self, texts: list[str], end: int | None) -> pa.Array:
        """Every text's ids as bytes. Pieces are split, told apart and put together by Arrow, so Python sees each different one once."""
        # millions of strings come and go here, none of them in a cycle
        cycles = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end)
        finally:
            if cycles:
                gc.enable()

    def _encode(self, texts: list[str], end: int | None) -> pa.Array:
        last = b"" if end is None else np.array([end], self.dtype).tobytes()
        if not self.cuts or not texts:
            return pa.array([x + last for x in self._ids(texts)] if texts else [], pa.binary())
        if self.lowers:
            texts = [self._lowered(t) for t in texts]
        cut = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        told = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy()
        # behind the last piece of a text comes its end
        each = np.insert(told.indices.to_numpy(), ends[1:], len(told.dictionary))
        pieces = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.lowers:
            # a piece of A-Z and signs alone, whatever the rest of its text holds
            added = self._added_in(pieces)
            pieces = [p.lower() if p.isascii() and p not in added else p for p in pieces] if added else [p.lower() if p.isascii() else p for p in pieces]
        ids = pa.array([*self._known(pieces), last], pa.large_binary()).take(pa.array(each))
        at = np.frombuffer(ids.buffers()[1], "i8", len(ids) + 1, 8 * ids.offset)[ends + np.arange(len(ends))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at.tobytes()), ids.buffers()[2]]).cast(pa.binary())

    def encode_many(self, texts: list[str], end: int | None) -> list[bytes]:
        return self.encode_array(texts, end).to_pylist()


class FrameWriter:
    """Writes one file to a binary sink; memory holds one frame and the index."""

    def __init__(self, sink, dtype: np.dtype, frame_tokens: int, level: int = 3):
        self.sink, self.dtype, self.size, self.level = sink, dtype, frame_tokens * dtype.itemsize, level
        self.held, self.table, self.docs, self.at = bytearray(), [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((self.at, n, doc_id is not None, doc_id or 0))
        self.at += n
        self.held += ids
        while len(self.held) >= self.size:
            self._frame(bytes(self.held[: self.size]))
            del self.held[: self.size]

    def _frame(self, data: bytes) -> None:
        out = zstandard.ZstdCompressor(level=self.level, write_content_size=True).compress(data)
        self.sink.write(out)
        self.table.append((len(out), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        index = struct.pack("<BI", self.dtype.itemsize, self.size) + zstandard.ZstdCompressor(level=3).compress(np.array(self.docs, DOC).tobytes())
        self.sink.write(struct.pack("<II", SKIP, len(index)) + index)
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        self.sink.write(struct.pack("<II", TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class FrameReader:
    """Random access to one file; `frames_read` counts what was decompressed."""

    def __init__(self, source, size: int):
        self.source, self.frames_read = source, 0
        n, flags, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        self.table = np.frombuffer(self._range(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head = self._range(int(self.at[n - 1]), int(self.table[n - 1, 0]))
        kind, length, width, self.size = struct.unpack("<IIBI", head[:13])
        if kind != SKIP or length != len(head) - 8:
            raise ValueError("the document index is damaged")
        self.dtype = np.dtype(f"<u{width}")
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(head[13:]), DOC)
        self._last = (-1, b"")

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the file is cut short")
        return data

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._range(int(self.at[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self._last, self.frames_read = (k, data), self.frames_read + 1
        return self._last[1]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        w = self.dtype.itemsize
        a, b = int(self.docs[k]["at"]) * w, (int(self.docs[k]["at"]) + int(self.docs[k]["n"])) * w
        out = [self._frame(f)[max(0, a - f * self.size) : b - f * self.size] for f in range(a // self.size, -(-b // self.size))] if b > a else []
        return np.frombuffer(b"".join(out), self.dtype)


def encode_frame(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end: int | None, memory: int = 200 << 20, chars: int = 1 << 22, spare: bool = False) -> DataFrame:
    """(id, tie, ids): every text's ids as bytes; tie orders rows of equal id. A worker's memory of pieces takes `memory`
    bytes at most, and texts are encoded about `chars` characters at a time; spare: each task gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.at(tokenizer, memory)
        for b in batches:
            at = 0
            while at < b.num_rows:
                some, held = [], 0
                for x in b.column(2)[at:]:
                    some.append(x.as_py() or "")
                    held += len(some[-1])
                    if held > chars:
                        break
                part = b.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), enc.encode_array(some, end)], ["id", "tie", "ids"])
                at += len(some)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(lean(run, "encoders") if spare else run, "id long, tie long, ids binary")


def write_files(coded: DataFrame, folder: str, width: int, *, parts: int, frame_tokens: int, file_tokens: int, file_docs: int = 1 << 20, spare: bool = False) -> DataFrame:
    """Writes (id, tie, ids) in ascending order as files below folder: (part, seq, path, bytes, n_docs, n_tokens).

    Every attempt of a task writes under names of its own and only the committed attempt's rows name files, so a lost
    executor's halves are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        store, base = open_store(folder)
        dtype = np.dtype(f"<u{width}")
        writer = sink = path = None

        def close() -> pa.RecordBatch:
            writer.close()
            size = sink.tell()
            sink.close()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "bytes": [size], "n_docs": [len(writer.docs)], "n_tokens": [writer.at]})

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    path = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.zst"
                    sink = store.open_output_stream(f"{base}/{path}", compression=None)
                    writer = FrameWriter(sink, dtype, frame_tokens)
                writer.add(i, ids.as_py())
                if writer.at >= file_tokens or len(writer.docs) >= file_docs:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()

    ordered = coded.repartitionByRange(parts, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").select("id", "ids")
    return ordered.mapInArrow(lean(run) if spare else run, "part long, seq long, path string, bytes long, n_docs long, n_tokens long")


def read_files(manifest: DataFrame, folder: str, *, spare: bool = False) -> DataFrame:
    """Every document of the files that a manifest names: (id, start, n_tokens, ids_crc32), each from its own frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{base}/{row['path']}") as source:
                    reader = FrameReader(source, row["bytes"])
                    for at in range(0, len(reader.docs), 20_000):
                        some = reader.docs[at : at + 20_000]
                        crc = [zlib.crc32(reader.ids(at + k).astype("<u4").tobytes()) for k in range(len(some))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.where(some["named"], some["id"], 0), "i8", mask=some["named"] == 0), pa.array(some["at"].astype("i8") + row["first"]), pa.array(some["n"].astype("i8")), pa.array(crc, "i8")],
                            ["id", "start", "n_tokens", "ids_crc32"],
                        )

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # a number of partitions, or else Spark merges these small rows into one task
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered.select("path", "bytes", "first").repartition(parts, "path").mapInArrow(lean(run) if spare else run, "id long, start long, n_tokens long, ids_crc32 long")


def read_documents(folder: str, path: str, size: int, at: Iterable[int]) -> list[np.ndarray]:
    """The ids of a file's documents at the positions asked for; only their frames are decompressed."""
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/{path}") as source:
        reader = FrameReader(source, size)
        return [reader.ids(k) for k in at]


def token_files(docs: DataFrame, spark: SparkSession, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, frame_tokens: int = 1 << 16, file_tokens: int = 1 << 26, folder: str | None = None, memory: int = 200 << 20, chars: int = 1 << 22, spare: bool = False) -> tuple[DataFrame, str]:
    """Encodes whole texts, writes the files in ascending id order; the manifest and the folder (a new shared one if None).

    Null text: empty, so only the end id. Null ids come first. Rows of equal id are ordered by a hash of their text;
    every row is written. An empty table writes no file. memory and chars bound a Python worker's, see encode_frame; spare:
    for workers that other operators use too, in small batches, free memory and at the end the encoder's given back.
    """
    scratch = Scratch(spark, "tokens")
    folder = folder or f"{scratch.path}/files"
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    with small_batches(spark) if spare else nullcontext():
        coded = scratch.table(encode_frame(docs, tokenizer, id_col=id_col, text_col=text_col, end=end, memory=memory, chars=chars, spare=spare), "coded")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files = write_files(coded, folder, Encoder.at(tokenizer).dtype.itemsize, parts=parts, frame_tokens=frame_tokens, file_tokens=file_tokens, spare=spare)
        manifest = scratch.table(files, "manifest")
    scratch.drop("coded")
    return manifest, folder


def token_table(docs: DataFrame, spark: SparkSession, tokenizer: str, *, id_col: str = "doc_id", spare: bool = False, **how) -> DataFrame:
    """Writes docs with token_files and reads the files back: id, start, n_tokens, ids_crc32 a row."""
    manifest, folder = token_files(docs, spark, tokenizer, id_col=id_col, spare=spare, **how)
    return read_files(manifest, folder, spare=spare).withColumnRenamed("id", id_col)
