"""Token ids in binary files with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id and every partition writes one file: all ids end to end, then
the boundaries (start of each document and the end of the last) as an Elias-Fano sequence - low bits
packed, high bits in unary, a position sample for every 256th boundary so that select looks at one
short stretch - then the ascending doc_ids as another such sequence, and a footer. A boundary costs about
2 + log2(ids / documents) bits. Readers get offsets through select, a run of documents at a time; no table of
64-bit numbers is stored or expanded.

Ids take 2 bytes each while the vocabulary has at most 65,536 entries, else 4.

    file   = ids | bounds: low, high, samples | doc_ids: low, high, samples | footer (JSON) | its length (4 bytes) | MAGIC

Defined results: a null text is empty and holds the end id alone; null doc_ids come first; rows with one
doc_id follow each other by hash of their text; an empty table writes no file.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, fresh_dir
from .files import new_output, read_range

MAGIC = b"LCTNTOK1"
SAMPLED = 256
END_ID = 1
CACHE = 400_000
RUN = 16 * SAMPLED
MOST_TASKS = 50_000


class EliasFano:
    """A non-decreasing sequence of n values up to `top` in about n * (2 + log2(top / n)) bits."""

    def __init__(self, n: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top = n, top
        self.width = self.low_bits(n, top)
        self.low, self.high, self.samples = low, high, np.frombuffer(samples, dtype="<u4")

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = cls.low_bits(n, top)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, top, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLED].astype("<u4").tobytes())

    def select(self, i: int, j: int | None = None) -> np.ndarray | int:
        """Value i, or values i to j - 1: from the sample before i to the one after j, high bits' ones give the
        high parts by their positions; the low bits lie at i * width."""
        if j is None:
            return int(self.select(i, i + 1)[0])
        if j <= i:
            return np.zeros(0, dtype=np.int64)
        at, after = int(self.samples[i // SAMPLED]), (j - 1) // SAMPLED + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, end - at // 8, at // 8), bitorder="little")
        bits[: at % 8] = 0
        skip = i % SAMPLED
        ones = np.flatnonzero(bits)[skip : skip + j - i] + at // 8 * 8
        v = (ones - np.arange(i, j)).astype(np.int64) << self.width
        if self.width:
            first, last = i * self.width, j * self.width
            part = np.frombuffer(self.low, np.uint8, (last + 7) // 8 - first // 8, first // 8)
            low = np.unpackbits(part, bitorder="little")[first % 8 :][: last - first]
            v |= low.reshape(j - i, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return v

    def values(self) -> np.ndarray:
        return self.select(0, self.n)

    def pieces(self) -> dict[str, bytes]:
        return {"low": self.low, "high": self.high, "samples": self.samples.tobytes()}


def byte_alphabet() -> list[str]:
    """The character a byte-level pre-tokeniser writes for each byte: printable Latin-1 stands for itself,
    the rest follow each other from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_ALPHABET = byte_alphabet()


class Encoder(dict):
    """UTF-8 pieces between ASCII white space to their ids (little-endian), remembered up to CACHE pieces.

    Only a tokenizer whose normaliser and pre-tokeniser are `BY_PIECES` is taken apart like that; with any other,
    whole texts go to the library. The known pre-tokeniser drops white space and no token crosses it, so a text's ids are its
    pieces' ids end to end. A piece of Latin letters and trailing marks is two pre-tokens, whose ids are
    remembered by themselves; a lower-cased word of Latin letters is one pre-token as it stands and goes to
    the library's model at once, past normaliser and pre-tokeniser."""

    # The normaliser and pre-tokeniser for which pieces may be encoded one by one.
    BY_PIECES = (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
        ]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )
    SPLIT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$*&#]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_pieces = (config["normalizer"], config["pre_tokenizer"]) == self.BY_PIECES and config["model"]["type"] == "BPE"
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def part(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            found = self.parts[text] = self.ids(text)
        return found

    def word(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            form = text if text.isascii() else "".join(_ALPHABET[b] for b in text.encode())
            found = np.array([t.id for t in self.tokenizer.model.tokenize(form)], dtype=self.dtype).tobytes()
            self.parts[text] = found
        return found

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        if m := self.SPLIT.fullmatch(text):
            found = self.word(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        else:
            found = self.ids(text)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_pieces:
            return self.ids(text.encode("utf-8", "replace").decode())
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns their manifest (part, path, n_docs, n_ids), one row per file, in doc_id order."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, dtype = encoder(tokenizer).encode, encoder(tokenizer).dtype
        width = np.dtype(dtype).itemsize
        end = np.array([end_id], dtype=dtype).tobytes()
        part, path, out = TaskContext.get().partitionId(), None, None
        starts, ids, total = [0], [], 0
        for batch in batches:
            if out is None and len(batch):
                path, out = new_output(folder, f"tokens-{part:06d}")
            for text in batch["text"]:
                found = encode(text) + end
                out.write(found)
                total += len(found) // width
                starts.append(total)
            ids.append(batch["doc_id"])
        if out is None:
            return
        keys = pd.concat(ids)
        bounds = EliasFano.build(np.array(starts))
        known = [int(k) for k in keys if k]  # nulls come first
        least, most = (known[0], known[-1] - known[0]) if known else (0, 0)
        names = EliasFano.build(np.array([k - least for k in known], dtype=np.uint64))
        parts = [*bounds.pieces().values(), *names.pieces().values()]
        foot = json.dumps({
            "n_docs": len(keys), "n_ids": total, "dtype": dtype, "n_nulls": len(keys) - len(known), "least_id": least, "top_id": most,
            "sizes": [len(x) for x in parts],
        }).encode()
        for piece in (*parts, foot, len(foot).to_bytes(4, "little"), MAGIC):
            out.write(piece)
        out.close()
        yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [len(keys)], "n_ids": [total]})

    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    # ids as text: pandas would turn longs with nulls into doubles
    ranged = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return cut(ranged.mapInPandas(write, "part int, path string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all
    documents before it, over all files."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # a row per file

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                with read_range(path) as f:
                    yield from _documents(f, int(base))

    # a number of partitions that is given is not coalesced: a task for each file, or for a run beyond MOST_TASKS
    return based.repartitionByRange(max(1, min(manifest.count(), MOST_TASKS)), "part").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def footer(f) -> tuple[dict, EliasFano, EliasFano]:
    """(counts, boundaries, doc_ids less the least one) of an open token file."""
    size = f.size()
    f.seek(size - len(MAGIC) - 4)
    tail = f.read(len(MAGIC) + 4)
    if tail[4:] != MAGIC:
        raise ValueError("not a token file")
    n = int.from_bytes(tail[:4], "little")
    f.seek(size - len(MAGIC) - 4 - n)
    head = json.loads(f.read(n))
    f.seek(head["n_ids"] * np.dtype(head["dtype"]).itemsize)
    pieces = [f.read(n) for n in head["sizes"]]
    bounds = EliasFano(head["n_docs"] + 1, head["n_ids"], *pieces[:3])
    return head, bounds, EliasFano(head["n_docs"] - head["n_nulls"], head["top_id"], *pieces[3:])


def _documents(f, base: int, chunk: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """A run of documents at a time, their offsets through select; of a run, at most `chunk` ids at a time and the
    rest of a longer document."""
    head, bounds, names = footer(f)
    width, nulls = np.dtype(head["dtype"]).itemsize, head["n_nulls"]
    for first in range(0, head["n_docs"], RUN):
        last = min(first + RUN, head["n_docs"])
        starts = bounds.select(first, last + 1)
        lo = 0
        while lo < last - first:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + chunk, "right")) - 1)
            f.seek(int(starts[lo]) * width)
            raw = np.frombuffer(f.read(int(starts[hi] - starts[lo]) * width), head["dtype"]).astype("<u4").tobytes()
            cuts = (starts[lo : hi + 1] - starts[lo]) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            a, b = first + lo, first + hi
            known = names.select(max(a - nulls, 0), max(b - nulls, 0)) + head["least_id"]
            unnamed = (b - a) - len(known)
            yield pd.DataFrame({
                "doc_id": pd.Series([None] * unnamed + known.tolist(), dtype="Int64"),
                "start": starts[lo:hi] + base, "n_tokens": np.diff(starts[lo : hi + 1]), "ids_crc32": sums,
            })
            lo = hi


def document(f, i: int) -> np.ndarray:
    """Ids of the i-th document of an open token file, by two selects and one read."""
    head, bounds, _ = footer(f)
    width = np.dtype(head["dtype"]).itemsize
    a, b = bounds.select(i), bounds.select(i + 1)
    f.seek(a * width)
    return np.frombuffer(f.read((b - a) * width), head["dtype"])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_tokens(write_tokens(docs, fresh_dir(docs.sparkSession, "tokens"), tokenizer))
