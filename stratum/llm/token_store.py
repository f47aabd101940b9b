"""Token ids in binary files: one zstandard frame for each document, all with one dictionary.

A file is

    header   8 bytes "TOKZST01", the SHA-256 of the dictionary (32 bytes), number of documents (u64)
    frames   one zstandard frame for each document: its ids as little-endian unsigned 32-bit integers
    index    for each document 8 + 8 + 8 bytes: its number, offset of its frame, first id's place among the file's ids;
             the top bit of the last says that the document has no number
    footer   offset of the index (u64), number of ids (u64), 8 bytes "TOKZEND1"

so that one document is read with three small reads. The dictionary lies beside the files as dictionary.zdict; a reader
refuses a file with another dictionary's hash. The manifest (a Parquet table) lists the files in order with the ids
before each.

The dictionary is trained on at most TRAIN_DOCS documents, those with the least hash of their text: on their whole id
arrays, or on SLICES slices from all over those of more than TRAIN_BYTES. It only bears on sizes; all documents are
written whole.

Defined cases: a null text counts as empty; rows of equal (or null) id are adjacent, in the order of their texts, nulls
first; an empty table has one dictionary and no file. Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from array import array
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Generations, cached, filesystem, hidden, new_path

MAGIC, TAIL = b"TOKZST01", b"TOKZEND1"
TRAIN_DOCS, TRAIN_BYTES, SLICES, DICT_BYTES = 1_000, 8_192, 8, 64 << 10
#: The bit of a place that says that a document has no number.
NO_ID = 1 << 63
#: Chunks (runs without ASCII white space) whose ids a worker remembers.
CACHE = 500_000
#: Characters of text that are encoded at once.
BLOCK = 1 << 20
#: Documents that a file may hold; a partition writes as many files as it needs.
FILE_DOCS = 1 << 20

_tokenizers: dict = {}
_PROBES = ("the", "thing", "anther", "zzzz", "qwertyuiop", "internationalization")
_CONTROL = "\x1c\x1d\x1e\x1f"
#: All characters with which an ASCII letter can compose lie here.
_COMBINING = re.compile("[\u0300-\u036f]")
#: Latin letters, but for the one whose small form is a letter and a mark; others may decompose.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SPACE = re.compile(r"[ \t\n\r]+")


class Tokenizer:
    """A tokenizers file whose splits never cross white space, with a cache of chunks.

    The text is cut at white space, and each distinct chunk goes through the library once. That needs a tokenizer which
    drops white space; others get whole texts (checked once, by a probe). Where the probe shows that ASCII letters are
    lower-cased and split from marks that follow, texts are lower-cased and cut before those marks as a whole, so that
    there are fewer distinct chunks. New words of small ASCII letters go to the library's model without the steps before it,
    where a probe shows that those leave such words alone. Texts with a combining mark, which might compose with a small letter only, or with
    an added token in other letters, keep theirs.
    """

    def __init__(self, path: str):
        # a worker is one of many on its machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.lib = Library.from_file(path)
        self.lib.encode_special_tokens = False
        self.cache = Generations()
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        probe = "ab, cd\n ef\t\r gh"
        self.splits = [*ids(probe)] == [i for c in probe.split() for i in ids(c)]
        spec = json.loads(self.lib.to_str())
        # tokens that end a word, if the vocabulary says so
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.splits:
            self.ends = np.zeros(self.lib.get_vocab_size() + 1, bool)
            for token, k in self.lib.get_vocab().items():
                self.ends[k] = token.endswith(suffix)
        self.added = [t["content"].encode().lower() for t in spec["added_tokens"]]
        words = ("ab", "Cd", "thing", "QRS", "the", "é", "Ñ", "я")
        marks = "".join(m for m in ".,!?;:$%&#*" if all(ids(w + m + x) == [*ids(w), *ids(m + x)] for w in words for x in ("", "ab", ".", ",", "'s", "9", " ")))
        # a word of small ASCII letters may go to the library's model alone if nothing before that changes or cuts it: the
        # probe has all pairs of letters, and an added token within such a word would consist of letters itself
        self.model = None
        pairs = "".join(a + b for a in ascii_lowercase for b in ascii_lowercase)
        normal, cutter = self.lib.normalizer, self.lib.pre_tokenizer
        if self.splits and not any(a.isalpha() for a in self.added) and cutter and [w for w, _ in cutter.pre_tokenize_str(pairs)] == [pairs] and (not normal or normal.normalize_str(pairs) == pairs):
            model = self.lib.model
            if all(ids(w) == [t.id for t in model.tokenize(w)] for w in (pairs, pairs[::-1], *ascii_lowercase, *_PROBES)):
                self.model = model
        self.lower = all(ids(w) == ids(w.encode().lower().decode()) for w in words)
        self.cut = re.compile(rf"[{re.escape(marks)}](?<=[{_LETTERS}].)") if marks else None

    def _plain(self, text: str) -> str:
        """A text of the same ids, with fewer distinct chunks."""
        if self.lower and (text.isascii() or not _COMBINING.search(text)):
            low = text.encode().lower()
            if not any(a in low for a in self.added):
                text = low.decode()
        return self.cut.sub(r" \g<0>", text) if self.cut else text

    def _learn(self, new: set[str]) -> None:
        known = self.cache
        if self.model is not None:
            one = self.model.tokenize
            for w in [w for w in new if w.isascii() and w.isalpha() and w.islower()]:
                known[w] = array("I", [t.id for t in one(w)]).tobytes()
            new = known.unknown(new)
        words = [w for w in new if w.isalpha()] if self.ends is not None else []
        # many words in one text: each is a word to the tokenizer as well, and its last token says so
        texts = [words[i : i + 128] for i in range(0, len(words), 128)]
        for part, e in zip(texts, self.lib.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and (not len(cut) or cut[-1] == len(ids)):
                raw, at = ids.tobytes(), 0
                for w, k in zip(part, (4 * cut).tolist(), strict=True):
                    known[w] = raw[at:k]
                    at = k
        rest = [*known.unknown(new)]
        for x, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[x] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.splits:
            return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        # split() takes four control characters for white space that a tokenizer does not
        split = [t.split() if not any(c in t for c in _CONTROL) else [c for c in _SPACE.split(t) if c] for t in map(self._plain, texts)]
        known = self.cache
        if len(known) > CACHE:
            known.turn()
        if new := known.unknown(set(chain.from_iterable(split))):
            self._learn(new)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


def _forget() -> None:
    _tokenizers.clear()


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


class FileWriter:
    """Writes one file; close() gives its number of ids."""

    def __init__(self, fs, path: str, dictionary: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=3)
        self.z = z.ZstdCompressor(level=3, dict_data=d)
        self.out, self.at, self.index, self.ids = fs.open_output_stream(path), 48, [], 0
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes(8))

    def add(self, doc: int | None, ids: bytes) -> None:
        frame = self.z.compress(ids)
        self.out.write(frame)
        self.index.append((0, self.at, self.ids | NO_ID) if doc is None else (doc & 0xFFFFFFFFFFFFFFFF, self.at, self.ids))
        self.at += len(frame)
        self.ids += len(ids) // 4

    def close(self) -> int:
        self.out.write(b"".join(struct.pack("<QQQ", *x) for x in self.index) + struct.pack("<QQ", self.at, self.ids) + TAIL)
        self.out.close()
        return self.ids


class FileReader:
    """Reads a file of FileWriter: read(k) gives (number, first id's place, ids) of its k-th document."""

    def __init__(self, fs, path: str, dictionary: bytes):
        import zstandard as z

        self.f = fs.open_input_file(path)
        size = self.f.size()
        head, foot = self.f.read_at(48, 0), self.f.read_at(24, size - 24)
        if head[:8] != MAGIC or foot[16:] != TAIL:
            raise ValueError(f"{path} is not a token file")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.end, self.n_ids = struct.unpack("<QQ", foot[:16])
        self.index = np.frombuffer(self.f.read_at(size - 24 - self.end, self.end), "<u8").reshape(-1, 3)
        self.z = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def read(self, k: int) -> tuple[int | None, int, bytes]:
        doc, at, first = (int(x) for x in self.index[k])
        end = int(self.index[k + 1, 1]) if k + 1 < len(self) else self.end
        doc = None if first & NO_ID else doc - (doc >> 63 << 64)
        return doc, first & ~NO_ID, self.z.decompress(self.f.read_at(end - at, at))

    def __iter__(self):
        return (self.read(k) for k in range(len(self)))


def train_dictionary(docs: DataFrame, text: str, path: str, end_id: int) -> bytes:
    """A dictionary trained on the id arrays of a bounded, repeatable choice of documents; empty if there are too few."""
    import zstandard as z

    t = F.col(f"`{text}`")
    some = docs.where(F.length(t) > 0).withColumn("h", F.xxhash64(t))
    # hashes first, as every task sends its least ones; then only the texts of the least of all
    hashes = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    least = some.where(F.col("h") <= max(hashes, default=0)).groupBy("h").agg(F.min(t).alias("t"))

    def run(batches):
        with cached("token_store", _forget):
            for batch in batches:
                got = [_slices(ids + struct.pack("<I", end_id)) for _, ids in _encoded(tokenizer(path), batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["h", "ids"])

    samples = [bytes(r["ids"]) for r in sorted(least.mapInArrow(run, "h long, ids binary").collect())]
    try:
        return z.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except z.ZstdError:
        return b""


def _slices(ids: bytes) -> bytes:
    """ids, or slices from all over them."""
    if len(ids) <= TRAIN_BYTES:
        return ids
    size = TRAIN_BYTES // SLICES // 4 * 4
    starts = [k * (len(ids) - size) // (SLICES - 1) // 4 * 4 for k in range(SLICES)]
    return b"".join(ids[at : at + size] for at in starts)


def write_tokens(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int, to: str | None = None) -> str:
    """Writes the ids of all documents, in ascending order of doc_id, to files in a folder; gives the folder.

    One range exchange orders the documents; each task writes its own files under names that no other attempt uses,
    and only the files that the manifest names count, so a lost executor's files are never read.
    """
    spark = docs.sparkSession
    to = to or new_path(spark, "tokens")
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dictionary = train_dictionary(d, "text", path, end_id)
    fs, folder = filesystem(to)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary.zdict") as f:
        f.write(dictionary)
    end = struct.pack("<I", end_id)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        with cached("token_store", _forget):
            yield from write(batches)

    def write(batches):
        tok, out, (fs, folder) = tokenizer(path), None, filesystem(to)
        part, docs, first, name = 0, 0, None, ""

        def closed():
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [docs], "n_ids": [out.close()], "first_doc": [first], "part": [part]}, schema=pa.schema(_ARROW))

        for batch in batches:
            for doc, ids in _encoded(tok, batch):
                if out is not None and docs >= FILE_DOCS:
                    yield closed()
                    out, part = None, part + 1
                if out is None:
                    name, first, docs = f"{uuid.uuid4().hex}.tok", doc, 0
                    out = FileWriter(fs, f"{folder}/{name}", shared.value)
                out.add(doc, ids + end)
                docs += 1
        if out is not None:
            yield closed()

    ordered = d.repartitionByRange(*[F.col("doc_id").asc_nulls_first()]).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = ordered.mapInArrow(run, "file string, n_docs long, n_ids long, first_doc long, part int")
    files.write.parquet(f"{to}/files")
    listed = spark.read.schema(files.schema).parquet(f"{to}/files")
    # one row for each file, so that the running sum over all of them stays small
    rows = sorted(listed.collect(), key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["part"], r["file"]))
    start, listing = 0, []
    for r in rows:
        listing.append((r["file"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    spark.createDataFrame(listing, "file string, n_docs long, n_ids long, start long").write.parquet(f"{to}/manifest")
    return to


def _encoded(tok: Tokenizer, batch):
    """(id, ids) of each document of a batch, encoded in blocks of bounded size."""
    docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK):
            n += len(texts[j])
            j += 1
        yield from zip(docs[i:j], tok.encode(texts[i:j]), strict=True)
        i = j


_ARROW = [("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("part", pa.int32())]


def read_tokens(spark: SparkSession, folder_uri: str) -> DataFrame:
    """All documents of a folder of write_tokens: doc_id, start (ids of all documents before it) and ids (binary)."""
    manifest = spark.read.schema("file string, n_docs long, n_ids long, start long").parquet(f"{folder_uri}/manifest")

    def run(batches):
        fs, folder = filesystem(folder_uri)
        with fs.open_input_file(f"{folder}/dictionary.zdict") as f:
            dictionary = f.read()
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc, first, ids in FileReader(fs, f"{folder}/{name}", dictionary):
                    rows.append((doc, start + first, ids))
                    held += len(ids)
                    if held > 16 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n).mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list) -> pa.RecordBatch:
    doc, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
