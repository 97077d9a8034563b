"""Token ids as binary files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents, each with an end id, as little-endian 32-bit integers in
frames that decompress by themselves.  After the frames come two skippable frames: the document index, and
the seek table of the public seekable format, with sizes and a checksum (low 32 bits of XXH64) per frame.  So
a reader takes the index, finds the frames of the documents it wants, and decompresses and checks only those.

Defined results: a NULL or empty text is its end id alone; an empty table writes no file and reads back as an
empty table.  Documents are in the order of doc_id (NULLs first), equal ids in the order of a hash of their
texts; repeated rows follow each other.  Texts of any length are encoded whole; only their ids are cut into
frames.  Other columns of the input are not stored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewarden.llm.words import freeing
from linewarden.session import work_folder

END_ID = 0
#: Ids of a frame: it is closed at the first end of a document beyond, or at the hard limit inside one.
FRAME_IDS, FRAME_LIMIT = 1 << 16, 1 << 22
#: Bytes of texts that are encoded at a time; one longer text is encoded whole.
STRIDE = 1 << 23
#: New words that are encoded at a time, and those of one text of them.
WORDS, GROUP = 10_000, 100
#: Words whose ids a worker remembers, and bytes of them; beyond that it keeps those that it met again.
REMEMBERED, REMEMBERED_BYTES = 700_000, 1 << 26
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part int, path string, n_docs long, n_tokens long"
#: Texts with other white space than blanks and line feeds are encoded by themselves.
ODD_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|<\|"
#: So are those with more than one of these between words, unless the tokenizer cuts such runs as it does here.
RUNS = r"[ \n][ \n]|^[ \n]|[ \n]$"
RUNS_TEXT, RUNS_CUT = "\n\na.\n\n  b \n\n!c  ", ["Ċ", "Ċ", "a", ".", "ĊĊĠ", "Ġb", "ĠĊ", "Ċ", "!", "c", "ĠĠ"]
MARKS = ".,;:!?"
MARKED = f"[A-Za-z0-9][{MARKS}]$"


class Encoder:
    """Encodes columns of texts by the distinct words in them.

    A byte-level vocabulary never merges across the start of a blank and a word, so the ids of a text are the
    ids of its words with their leading blanks, and each distinct word is encoded once while a worker remembers it.
    Nor does it merge a letter with a mark behind it, if its tokenizer says so: then a word and its last mark are
    remembered apart.  And of a run of blanks and line feeds all but the last are a word, at the end of a text all.
    Words are held as Arrow text: workers live on when their stage is over, and as Python strings the words were most
    of their memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.break_ids = self.plain(["\n"])[0]
        self.marks_apart = all(self.cut(f"{c}{m}") == [c, m] for c in "aZ9" for m in MARKS)
        self.odd = ODD_SPACE if self.cut(RUNS_TEXT) == RUNS_CUT else f"{ODD_SPACE}|{RUNS}"
        self.fresh()

    def cut(self, text: str) -> list[str]:
        """The pieces of a text that the tokenizer encodes by themselves."""
        cut = self.tokenizer.pre_tokenizer
        return [text] if cut is None else [x for x, _ in cut.pre_tokenize_str(text)]

    def fresh(self) -> None:
        """Remember the empty word and the line feed alone, in the places 0 and 1."""
        self.known = pa.array(["", "\n"], pa.string())
        self.ids = np.array(self.break_ids, np.uint32)
        self.starts = np.array([0, 0, len(self.ids)], np.int64)
        self.again = np.ones(2, bool)

    def forget(self) -> None:
        """Remember words that were met again after they were learned; none, if these are too many as well."""
        kept = np.flatnonzero(self.again)
        known = self.known.take(pa.array(kept))
        if len(known) > REMEMBERED // 2 or known.nbytes > REMEMBERED_BYTES // 2:
            self.fresh()
            return
        lists = self.lists().take(pa.array(kept))
        self.known, self.ids, self.starts = known, np.array(lists.flatten()), np.array(lists.offsets)
        self.again = np.arange(len(known)) < 2

    def lists(self) -> pa.Array:
        """The ids of each known word."""
        return pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.ids))

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> None:
        """Encode new words many at a time, with line feeds between them as marks."""
        [mark] = self.break_ids
        ids, starts = [self.ids], [self.starts]
        for k in range(0, len(words), WORDS):
            part = pc.binary_join_element_wise(words.slice(k, WORDS), "", "\n")
            bounds = np.append(np.arange(0, len(part), GROUP), len(part))
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), part), "").to_pylist()
            got = np.concatenate([np.array(x, np.uint32) for x in self.plain(groups)])
            cut = np.flatnonzero(got == mark)
            if len(cut) != len(part):
                raise ValueError("the vocabulary joins line feeds with words; use Encoder.plain")
            ids.append(got[got != mark])
            starts.append(starts[-1][-1] + np.cumsum(np.diff(np.concatenate([[-1], cut])) - 1))
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def places(self, words: pa.Array) -> np.ndarray:
        """The places of words among the known ones; new words are learned."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1)).astype(np.int64)
        unknown = place < 0
        self.again[place[~unknown]] = True
        if unknown.any():
            words = words.filter(pa.array(unknown))
            new, before = words.unique(), len(self.known)
            place[unknown] = before + np.asarray(pc.index_in(words, value_set=new))
            self.learn(new)
        return place

    def by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text, for texts without odd white space."""
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        offsets = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        index = np.array(coded.indices)
        words = coded.dictionary
        # A piece opens a text, follows a line feed, or follows a blank.
        opening = offsets[:-1][offsets[:-1] < offsets[1:]]
        initial, where = np.unique(index[opening], return_inverse=True)
        index[opening] = len(words) + where
        # Pieces without a word: each run of them is encoded as it stands.
        white = pc.is_in(words, value_set=pa.array(["", "\n"]))
        at = np.flatnonzero(np.append(np.asarray(white), np.zeros(len(initial), bool))[index])
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        signs = words.take(pa.array(index[at]))
        signs = pc.if_else(pc.equal(signs, ""), " ", signs)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), signs), "").dictionary_encode()
        broken = pc.starts_with(words, "\n")
        plain = pc.if_else(broken, pc.utf8_slice_codeunits(words, 1), pc.binary_join_element_wise(" ", words, ""))
        plain = pa.concat_arrays([pc.if_else(white, "", plain), words.take(pa.array(initial))])
        index[at] = len(plain) + len(runs.dictionary)
        index[at[first]] = len(plain) + np.asarray(runs.indices)
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self.forget()
        # Each word as a line feed or nothing, the word without its last mark, and that mark or nothing.
        marked = pc.match_substring_regex(plain, MARKED) if self.marks_apart else pa.repeat(False, len(plain))
        ends = plain.filter(marked)
        stems = pc.replace_with_mask(plain, marked, pc.utf8_slice_codeunits(ends, 0, -1))
        place = self.places(pa.concat_arrays([stems, pc.utf8_slice_codeunits(ends, -1)]))
        parts = np.zeros((len(plain) + len(runs.dictionary) + 1, 3), np.int64)
        parts[: len(words), 0] = np.asarray(broken)
        parts[: len(plain), 1] = place[: len(plain)]
        parts[np.flatnonzero(marked), 2] = place[len(plain) :]
        lists = self.lists()
        if len(runs.dictionary):
            parts[len(plain) : -1, 1] = len(lists) + np.arange(len(runs.dictionary))
            lists = pa.concat_arrays([lists, pa.array(self.plain(runs.dictionary.to_pylist()), lists.type)])
        ids = lists.take(pa.array(parts.ravel()))
        ids = pa.LargeListArray.from_arrays(pa.array(np.asarray(ids.offsets)[::3]), ids.flatten()).take(pa.array(index))
        return np.asarray(ids.flatten()), np.asarray(ids.offsets)[offsets]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text in order."""
        column = pc.fill_null(column.cast(pa.string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64))
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRIDE, "right")))
            yield from self._encoded(column.slice(i, j - i))
            i = j
        # Else what a batch took stays with the worker, beside the stages that come after this one.
        pa.default_memory_pool().release_unused()

    def _encoded(self, column: pa.Array) -> list[np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(column, self.odd))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        usual = np.flatnonzero(~odd)
        if len(usual):
            ids, offsets = self.by_words(column.take(pa.array(usual)))
            for k, row in enumerate(usual):
                out[row] = ids[offsets[k] : offsets[k + 1]]
        rows = np.flatnonzero(odd)
        for row, ids in zip(rows, self.plain(column.take(pa.array(rows)).to_pylist()), strict=True):
            out[row] = np.array(ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, on one thread: the cores beside it belong to other tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, folder: str, part: int):
        import zstandard

        self.store, base = _place(folder)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        self.unfinished, self.final = f"{base}/.{self.name}.unfinished", f"{base}/{self.name}"
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.unfinished)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.waiting: list[np.ndarray] = []
        self.n = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(ids)))
        for k in range(0, len(ids), FRAME_LIMIT):
            self.waiting.append(ids[k : k + FRAME_LIMIT])
            self.n += len(self.waiting[-1])
            if self.n >= FRAME_IDS:
                self.close_frame()

    def close_frame(self) -> None:
        import xxhash

        if self.n:
            raw = np.concatenate(self.waiting).astype("<u4").tobytes()
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.n = [], 0

    def finish(self) -> tuple[str, int, int]:
        self.close_frame()
        table = np.array(self.index, dtype=[("id", "<i8"), ("known", "?"), ("n", "<i8")]).tobytes()
        entries = b"".join(struct.pack("<III", *x) for x in self.seek)
        footer = struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(_skippable(SKIPPABLE_INDEX, table) + _skippable(SKIPPABLE_SEEK, entries + footer))
        self.out.close()
        self.store.move(self.unfinished, self.final)
        return self.name, len(self.index), sum(x[2] for x in self.index)


class FrameReader:
    """Reads the tables of one file, and frames on request."""

    def __init__(self, folder: str, name: str):
        store, base = _place(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{name} has no seek table")
        start = size - 9 - 12 * count - 8
        self.seek = np.frombuffer(self._at(start + 8, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        frames = int(self.seek[:, 0].sum())
        magic, length = struct.unpack("<II", self._at(frames, 8))
        if magic != SKIPPABLE_INDEX or frames + 8 + length != start:
            raise ValueError(f"{name} has no document index")
        self.index = np.frombuffer(self._at(frames + 8, length), [("id", "<i8"), ("known", "?"), ("n", "<i8")])
        self.packed_at = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        self.ids_at = np.concatenate([[0], np.cumsum(self.seek[:, 1] // 4)])
        self.docs_at = np.concatenate([[0], np.cumsum(self.index["n"])])
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, position: int, n: int) -> bytes:
        self.file.seek(position)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self.held[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.packed_at[k]), int(self.seek[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"checksum of frame {k} is wrong")
            self.held = (k, np.frombuffer(raw, "<u4"))
        return self.held[1]

    def document(self, row: int) -> np.ndarray:
        """The ids of the document in a row of the index."""
        a, b = int(self.docs_at[row]), int(self.docs_at[row + 1])
        out = []
        k = int(np.searchsorted(self.ids_at, a, "right")) - 1
        while a < b:
            stop = min(b, int(self.ids_at[k + 1]))
            out.append(self.frame(k)[a - self.ids_at[k] : stop - self.ids_at[k]])
            a, k = stop, k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _writer(folder: str, tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @freeing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, file = encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            if batch.num_rows and file is None:
                file = FrameWriter(folder, part)
            for doc_id, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1)), strict=True):
                file.add(doc_id, np.concatenate([ids, end]))
        if file is not None:
            name, docs, ids = file.finish()
            row = {"part": [part], "path": [name], "n_docs": [docs], "n_tokens": [ids]}
            yield pa.RecordBatch.from_pydict(
                row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
            )

    return write


def write_files(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and write all documents below a shared folder; gives the manifest of the files that count.

    A task that runs twice leaves a second file that no manifest names.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(_writer(f"{folder}/files", tokenizer), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, folder: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start, n_tokens, ids_crc32, and the ids on request.

    With a list of wanted ids only their frames are read and decompressed.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = f"{folder}/files"
    chosen = None if wanted is None else np.array(sorted(wanted), np.int64)

    @freeing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = FrameReader(files, name)
                index = file.index
                rows = np.arange(len(index)) if chosen is None else np.flatnonzero(index["known"] & np.isin(index["id"], chosen))
                for k in range(0, len(rows), 1000):
                    part = rows[k : k + 1000]
                    ids = [file.document(int(r)) for r in part]
                    columns = [
                        pa.array(index["id"][part], mask=~index["known"][part]),
                        pa.array(file.docs_at[part] + start, pa.int64()),
                        pa.array(index["n"][part], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    columns += [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    spread = placed.select("path", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents to new files and read their digests back from them."""
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    write_files(docs, folder, tokenizer, text, doc_id)
    return read_files(spark, folder)
