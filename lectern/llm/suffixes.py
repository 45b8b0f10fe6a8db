"""Removal of repeated byte strings through a sparse enhanced suffix array and its interval tree.

Every byte that a string of `LENGTH` bytes covers goes, if that string starts anywhere else too.

1. Anchors. Of every run of LENGTH - GRAM + 1 successive GRAM-byte strings the one with the least hash is
   an anchor (ties: the last). Any LENGTH bytes hold an anchor that depends on those bytes alone, so two
   equal strings hold the same anchor at the same place, and suffixes need to be sorted from anchors only.
   An anchor's context, REACH bytes before it and LENGTH after it, decides all strings that hold it.
2. Anchors whose GRAM bytes occur once are dropped by a count. Equal contexts cover themselves whole; one
   of each stands for the others from here on, so exact copies, however many, cost one row.
3. Different contexts of one GRAM are sorted into suffix arrays in buckets. A stack scan of the common
   prefix lengths of neighbours yields the prefix intervals bottom up. In an interval of prefix length p
   the preceding bytes are tested: where they are diverse the interval is a maximal repeat as it stands,
   else its members that share a bytes to the left are extended together by a second scan. A maximal repeat with
   a + p >= LENGTH covers all its occurrences from a before their anchors to p after. `repeat_groups` returns
   these groups with all their occurrences, `remove_repeats` the rest of each text.
4. A GRAM with more than `HOT` different contexts is not gathered: its strings are counted by digest, in
   classes of `STEP` offsets first (what all strings of a class share), offset by offset where a class repeats.
5. The spans meet their texts file by file and the remaining bytes are hashed.

The texts are stored once in the shared folder with row numbers; steps 3 and 5 send positions to the
files, not texts to the positions.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows that repeat (also a
null or repeated doc_id) are documents of their own, which cover each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, small_batches, stored
from .files import read_range
from .shingles import hash_spans, mix, packed

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM
HOT = 20_000
STEP = 13
BUCKET = 20_000
_MASK = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of the anchors of texts packed end to end (one blank after each)."""
    found = []
    width, slice_ = length - gram + 1, 1 << 23
    for lo in range(0, max(1, len(data) - length + 1), slice_):
        part = data[lo : lo + slice_ + length - 1]
        n = len(part) - gram + 1
        if n < width:
            continue
        at = np.arange(n)
        key = (hash_spans(part, at, at + gram) & ~_MASK) | (_MASK - at.astype(np.uint64))
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: -(width - span)], key[width - span :])
        start = np.arange(len(key)) + lo
        ends = offsets[np.searchsorted(offsets, start, "right")] - 1
        whole = start + length <= ends
        found.append((_MASK - (key[whole] & _MASK)).astype(np.int64) + lo)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch["row"].to_numpy()
        for lo, _, data, offsets in packed(batch["text"].tolist()):
            at = anchors(data, offsets)
            if not len(at):
                continue
            owner = np.searchsorted(offsets, at, "right") - 1
            start, end = offsets[owner], offsets[owner + 1] - 1
            left, right = np.minimum(REACH, at - start), np.minimum(LENGTH, end - at)
            context = mix(hash_spans(data, at - left, at + right) + left.astype(np.uint64) * np.uint64(0xDEADBEEFCAFE))
            yield pd.DataFrame({
                "gram": hash_spans(data, at, at + GRAM).view(np.int64), "context": context.view(np.int64),
                "row": rows[lo + owner], "pos": (at - start).astype(np.int32), "after": right.astype(np.int16),
            })


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width), lengths


def _shared(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of a and b, which are la and lb bytes long."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte rows; padding sorts like zero bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(prefix length, first, last) of the prefix intervals of at least `least`, bottom up, by a stack scan;
    lcp[i] belongs to suffixes i - 1 and i."""
    out, stack = [], [(0, 0)]
    for i, p in enumerate([*lcp.tolist()[1:], 0], 1):
        lo = i - 1
        while p < stack[-1][0]:
            top, lo = stack.pop()
            if top >= least:
                out.append((top, lo, i - 1))
        if p > stack[-1][0]:
            stack.append((p, lo))
    return out


class SuffixBucket:
    """Suffix array over anchors: group (equal for suffixes that may share a prefix), bytes from the anchor
    on, bytes before it (nearest first)."""

    def __init__(self, group: np.ndarray, right: list[bytes], left: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        right_bytes, right_len = _padded(right, length)
        left_bytes, left_len = _padded([x[::-1] for x in left], length - gram)
        head = group.astype(">i8").view(np.uint8).reshape(-1, 8)
        self.order = _sorted_rows(np.hstack([head, right_bytes]))
        o = self.order
        self.left, self.left_len = left_bytes[o], left_len[o]
        self.left_rank = np.argsort(_sorted_rows(self.left))
        r, n, g = right_bytes[o], right_len[o], group[o]
        self.lcp = np.zeros(len(o), dtype=np.int64)
        if len(o) > 1:
            self.lcp[1:] = np.where(g[1:] == g[:-1], _shared(r[1:], n[1:], r[:-1], n[:-1]), 0)

    def maximal_repeats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes before the anchor, bytes from it on, all occurrences) of the maximal repeats of at least
        `length` bytes: an interval whose preceding bytes are diverse is one as it stands; the members that
        share their preceding bytes are extended to the left together, until these are diverse."""
        found = intervals(self.lcp, self.gram)
        pairs = np.array([x for x in found if x[2] - x[1] == 1], dtype=np.int64).reshape(-1, 3)
        if len(pairs):  # most intervals: the two are extended to the left as far as they agree
            a, b = pairs[:, 1], pairs[:, 2]
            share = _shared(self.left[a], self.left_len[a], self.left[b], self.left_len[b])
            for p, i, j, s in zip(pairs[:, 0].tolist(), a.tolist(), b.tolist(), share.tolist()):
                if s + p >= self.length:
                    yield s, p, self.order[[i, j]]
        for p, lo, hi in found:
            if hi - lo == 1:
                continue
            m = np.arange(lo, hi + 1)
            m = m[np.argsort(self.left_rank[m], kind="stable")]
            near = _shared(self.left[m[1:]], self.left_len[m[1:]], self.left[m[:-1]], self.left_len[m[:-1]])
            # the same stack scan over the left contexts: an interval of shared length a is left-diverse at a
            shares = [(int(near.min()), 0, len(m) - 1)] if len(near) and near.min() == 0 else []
            shares += intervals(np.concatenate([[0], near]), 1)
            for a, first, last in shares:
                if a + p >= self.length:
                    yield a, p, self.order[m[first : last + 1]]


def _bucket_spans(bucket: pd.DataFrame) -> pd.DataFrame:
    rows, pos, many = bucket["row"].to_numpy(), bucket["pos"].to_numpy(dtype=np.int64), bucket["many"].to_numpy(dtype=bool)
    array = SuffixBucket(bucket["gram"].to_numpy(), bucket["right"].tolist(), bucket["left"].tolist())
    start, end = pos.copy(), pos.copy()
    for before, after, who in array.maximal_repeats():
        # the occurrences of a maximal repeat; spans of one anchor all hold it: their union is one span
        np.minimum.at(start, who, pos[who] - before)
        np.maximum.at(end, who, pos[who] + after)
    hit = (end > start) & ~many
    return pd.DataFrame({"row": rows[hit], "start": start[hit].astype(np.int32), "end": end[hit].astype(np.int32)})


def _bucket_groups(bucket: pd.DataFrame) -> pd.DataFrame:
    gram, rows, pos = (bucket[c].to_numpy() for c in ("gram", "row", "pos"))
    array = SuffixBucket(gram, bucket["right"].tolist(), bucket["left"].tolist())
    made = [
        (f"{gram[who[0]]}-{k}", rows[w], pos[w], before, after)
        for k, (before, after, who) in enumerate(array.maximal_repeats()) for w in who
    ]
    return pd.DataFrame(made, columns=["group_id", "row", "pos", "before", "after"])


def _texts(path: str) -> Iterator[tuple[int, int | None, bytes]]:
    """(row, doc_id, UTF-8 text) of a stored file, a batch of rows at a time."""
    with read_range(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=500):
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                yield row, doc_id, text.encode("utf-8", "replace")


def _contexts(key: tuple, files: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    made: list[tuple] = []
    points = points.sort_values(["row", "pos"])
    at = points["row"].to_numpy()
    cells = list(zip(points["gram"].tolist(), at.tolist(), points["pos"].tolist(), points["many"].tolist()))
    for path in files["path"] if len(cells) else ():
        for row, _, text in _texts(path):
            lo, hi = np.searchsorted(at, [row, row + 1])
            for gram, _, pos, many in cells[lo:hi]:
                made.append((gram, row, pos, many, text[max(0, pos - REACH) : pos], text[pos : pos + LENGTH]))
    return pd.DataFrame(made, columns=["gram", "row", "pos", "many", "left", "right"])


def _cut_texts(key: tuple, files: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    spans = spans.sort_values(["row", "start"])
    at, start, end = (spans[c].to_numpy(dtype=np.int64) for c in ("row", "start", "end"))
    made = []
    for path in files["path"]:
        for row, doc_id, text in _texts(path):
            lo, hi = np.searchsorted(at, [row, row + 1])
            removed = n = last = 0
            digest = hashlib.sha256()
            if hi > lo:
                ends = np.maximum.accumulate(end[lo:hi])
                new = np.ones(hi - lo, dtype=bool)
                new[1:] = start[lo + 1 : hi] > ends[:-1]
                first = np.flatnonzero(new)
                for a, b in zip(start[lo:hi][first].tolist(), ends[np.append(first[1:], hi - lo) - 1].tolist()):
                    digest.update(text[last:a])
                    removed, n, last = removed + b - a, n + 1, b
            digest.update(text[last:])
            made.append((doc_id, len(text), removed, n, digest.hexdigest()))
    out = pd.DataFrame(made, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return out.astype({"doc_id": "Int64"})


def _by_file(files: DataFrame, points: DataFrame, function, schema: str) -> DataFrame:
    """`function` on each stored file with its points; a task for every file or two, whatever their sizes."""
    n = 2 * max(1, files.count())
    numbered = points.withColumn("file", F.shiftright("row", 33))
    return (
        files.repartition(n, "file").groupBy("file")
        .cogroup(numbered.repartition(n, "file").groupBy("file"))
        .applyInPandas(function, schema)
    )


def _hot_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each class of STEP offsets: digest of what all its strings share. An offset is the number
    of bytes of a string before the anchor."""
    for b in batches:
        made = []
        for row, pos, left, right in zip(b["row"], b["pos"], b["left"], b["right"]):
            for o in range(0, REACH + 1, STEP):
                top = min(o + STEP - 1, REACH)
                if o <= len(left) and LENGTH - top <= len(right):
                    core = left[len(left) - o :] + right[: LENGTH - top]
                    made.append((row, pos, o, hashlib.blake2b(core, digest_size=16).digest(), left, right))
        yield pd.DataFrame(made, columns=["row", "pos", "offset", "digest", "left", "right"])


def _hot_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = []
        for row, pos, o, left, right in zip(b["row"], b["pos"], b["offset"], b["left"], b["right"]):
            for k in range(o, min(o + STEP - 1, REACH) + 1):
                if k <= len(left) and LENGTH - k <= len(right):
                    whole = left[len(left) - k :] + right[: LENGTH - k]
                    made.append((row, pos, k, hashlib.blake2b(whole, digest_size=16).digest()))
        yield pd.DataFrame(made, columns=["row", "pos", "offset", "digest"])


def _repeated(df: DataFrame) -> DataFrame:
    again = df.groupBy("offset", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(again, ["offset", "digest"])


def _hot_spans(contexts: DataFrame) -> DataFrame:
    shape = "row long, pos int, offset int, digest binary"
    cores = contexts.mapInPandas(_hot_classes, shape + ", left binary, right binary")
    strings = _repeated(cores).mapInPandas(_hot_strings, shape)
    found = _repeated(strings)
    start = F.col("pos") - F.col("offset")
    return found.select("row", "pos", "offset", "digest", start.alias("start"), (start + LENGTH).alias("end"))


class Search:
    """What both results need: the stored texts and their files, the anchors whose GRAM occurs again (`live`), one of
    each different context (`contexts`) and the sides of those that meet others (`sides`), split at `hot`."""

    def __init__(self, docs: DataFrame, hot: int):
        small_batches(docs.sparkSession)
        self.base = stored(
            docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")),
            "texts",
        )
        files = self.base.select(F.shiftright("row", 33).alias("file"), F.col("_metadata.file_path").alias("path")).distinct()
        self.files = stored(files, "files")
        points = stored(
            self.base.select("row", "text").mapInPandas(_find_anchors, "gram long, context long, row long, pos int, after short"),
            "anchors",
        )
        grams = points.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
        self.live = stored(hub_join(points, grams, ["gram"]), "live")
        self.contexts = stored(
            self.live.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("one")),
            "contexts",
        )

    def sides(self, hot: int, all_many: bool) -> tuple[DataFrame | None, DataFrame | None]:
        """(buckets of cold contexts, hot contexts) of GRAMs with more than one context; where every context of a
        GRAM has copies, all its strings are covered anyway, and it is left out unless `all_many`."""
        met = self.contexts.groupBy("gram").agg(F.count("*").alias("held"), F.min("n").alias("least")).where("held > 1")
        met = met if all_many else met.where("least = 1")
        points = self.contexts.join(met.select("gram"), "gram").select("gram", "one.row", "one.pos", (F.col("n") > 1).alias("many"))
        at = stored(
            _by_file(self.files, points, _contexts, "gram long, row long, pos int, many boolean, left binary, right binary"), "sides"
        )
        busy = met.where(F.col("held") > hot).select("gram")
        total = at.count()
        if not total:
            return None, None
        is_hot = bool(busy.take(1))
        cold = at.join(busy, "gram", "left_anti") if is_hot else at
        n = max(1, total // BUCKET)
        cold = cold.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(n))).repartition(n, "bucket")
        return cold, at.join(busy, "gram") if is_hot else None


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`."""
    found = Search(docs, hot)
    again = found.contexts.where("n > 1").select("gram", "context", "n")
    spans = hub_join(found.live, again, ["gram", "context"]).select(
        "row",
        F.greatest(F.lit(0), F.col("pos") - REACH).alias("start"),
        (F.col("pos") + F.col("after")).cast("int").alias("end"),
    )
    cold, busy = found.sides(hot, all_many=False)
    if cold is not None:
        spans = spans.unionByName(cold.groupBy("bucket").applyInPandas(_bucket_spans, "row long, start int, end int"))
    if busy is not None:
        spans = spans.unionByName(_hot_spans(busy).select("row", "start", "end"))
    return _by_file(found.files, spans, _cut_texts,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeat_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(group_id, n_bytes, maximal, doc_id, row, start): every occurrence of every repeated string of at least LENGTH
    bytes that holds an anchor, as maximal repeats from the interval tree, and equal contexts (REACH bytes before
    an anchor, LENGTH after it) as one group each. Strings of a GRAM with over `hot` contexts come in their
    LENGTH-byte pieces, not maximal ones."""
    found = Search(docs, hot)
    where = found.base.select("row", "doc_id")
    again = found.contexts.where("n > 1").select("gram", "context", "n")
    equal = hub_join(found.live, again, ["gram", "context"]).select(
        F.concat_ws("=", "gram", "context").alias("group_id"),
        (F.least("pos", F.lit(REACH)) + F.col("after")).alias("n_bytes"),
        F.lit(True).alias("maximal"), "row", F.greatest(F.lit(0), F.col("pos") - REACH).alias("start"),
    ).where(F.col("n_bytes") >= LENGTH)
    out = equal
    cold, busy = found.sides(hot, all_many=True)
    ones = found.contexts.select(F.col("one.row").alias("row"), F.col("one.pos").alias("pos"), "gram", "context")
    all_of = found.live.select("gram", "context", "row", "pos")
    if cold is not None:
        tree = cold.groupBy("bucket").applyInPandas(_bucket_groups, "group_id string, row long, pos int, before int, after int")
        full = tree.join(ones, ["row", "pos"]).drop("row", "pos").join(all_of, ["gram", "context"])
        out = out.unionByName(full.select(
            "group_id", (F.col("before") + F.col("after")).alias("n_bytes"), F.lit(True).alias("maximal"), "row",
            (F.col("pos") - F.col("before")).alias("start"),
        ))
    if busy is not None:
        full = _hot_spans(busy).join(ones, ["row", "pos"]).drop("row", "pos", "start", "end").join(all_of, ["gram", "context"])
        out = out.unionByName(full.select(
            F.concat_ws("+", "gram", "offset", F.hex("digest")).alias("group_id"), F.lit(LENGTH).alias("n_bytes"),
            F.lit(False).alias("maximal"), "row", (F.col("pos") - F.col("offset")).alias("start"),
        ))
    return out.join(where, "row").select("group_id", "n_bytes", "maximal", "doc_id", "row", "start")
