"""Benchmark decontamination by template windows.

Canonical form. A text is cut into letter runs and numbers; numbers, names (capitalised inside a
sentence) and units (after a number) become typed placeholders, all else is the lower-cased word. A run of
names, or of a number and number words, with only blanks or hyphens between is one placeholder in a
third form ("New York", "twenty-five", "3 million"), so that values may differ in their number of words. In a
fourth form the capitalised words that open sentences are names too ("Tom bought ..." against "Eve bought ..."). A
window is `WINDOW` successive tokens of that form; only windows with at least `LITERALS` words that are
no placeholders count. The plain lower-cased form is matched too, whatever its words are, so that a copy in
other case and an item dense in numbers or names are found. Scripts without blanks (Chinese, Japanese, Thai
and their like) give a token for each character.

Join. Windows of all documents meet the windows of all benchmark items by hash. While the benchmark has
at most `BROADCAST` distinct hashes (checked), they go to the scan, which passes only windows that match; while
its windows are at most `BROADCAST_ROWS` rows (checked), they are broadcast. Beyond that, sides are shuffled.

Slots. Windows of one document and item at one shift make an alignment. Each placeholder pairs an item's
value with a document's; a value of the item must go to one value of the document everywhere in the
alignment (Ann -> Eve, 3 -> 7; two values may go to one, as 3 and 5 to 7), else the alignment is dropped. Documents with an alignment over
`ENOUGH` tokens (`ENOUGH_CHARACTERS` where most tokens of the item are single characters), or over a whole
shorter item, are contaminated: verbatim if no value changed, else re-parameterised.

Defined results: null and empty texts match nothing; items of under `SHORT` tokens are searched for in
their plain form only; items without a letter or digit match nothing;
a null item_id is an item like others; rows that repeat are matched each; an empty benchmark or an empty
table matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .shingles import hash_spans, mix, packed

WINDOW = 8
SHORT = 5
LITERALS = 5
ENOUGH = 13
ENOUGH_CHARACTERS = 39
BROADCAST = 1_000_000
BROADCAST_ROWS = 200_000
BITS = 24

# Words that count as numbers, and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds lb lbs oz ton tons ml l liter liters litre litres gallon gallons second seconds s minute minutes min "
    "hour hours h day days week weeks month months year years dollar dollars cent cents euro euros degree degrees "
    "percent meter meters metre metres kilometer kilometers kilometre kilometres"
).split()

NUMBER, NAME, UNIT = 1, 2, 3
TEMPLATE, PLAIN, COLLAPSED, OPENED = 0, 1, 2, 3
_TYPE_HASH = np.array([0, 0xA11CE, 0xB0B, 0xC0FFEE], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

_LETTER, _DIGIT = 1, 2
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[128:] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_JOINS = np.zeros(256, dtype=bool)
_JOINS[[ord(c) for c in " \t\r\n-"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n:;\"()[]{}|"]] = True

# First two bytes of the characters of scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, kana and
# ideographs with their punctuation, full-width forms.
_SINGLE = np.zeros(1 << 16, dtype=bool)
for _lo, _hi in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBF), (0xF0A0, 0xF0BF)):
    _SINGLE[_lo : _hi + 1] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer((" ".join(words) + " ").encode(), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    return np.sort(hash_spans(data, starts, starts + lengths))


_NUMBER_HASHES, _UNIT_HASHES = _hash_words(NUMBER_WORDS), _hash_words(UNITS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word hashes, types, first token of each text, whether a token is a character of a script without
    blanks, whether it continues the value of the token before; types and continuation once more with the
    capitalised words that open sentences as names) of texts packed end to end."""
    kind = _CLASS[data]
    dot = (data == ord(".")) | (data == ord(","))
    joins = np.flatnonzero(dot[1:-1] & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)) + 1
    kind[joins] = _DIGIT
    edge = np.diff(kind, prepend=0, append=0) != 0
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    lead = lead[_SINGLE[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    edge[lead] = edge[lead + np.where(data[lead] >= 0xF0, 4, 3)] = True
    change = np.flatnonzero(edge)
    inside = np.append(kind, 0)[change] != 0
    starts, ends = change[inside], change[np.flatnonzero(inside) + 1]
    lower = _LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    lower[latin] += 0x20
    words = hash_spans(lower, starts, ends)
    first = np.searchsorted(starts, offsets)
    types = np.zeros(len(starts), dtype=np.int8)
    single_character = np.isin(starts, lead)
    if not len(starts):
        return words, types, first, single_character, single_character, types, single_character
    types[(kind[starts] == _DIGIT) | _among(words, _NUMBER_HASHES)] = NUMBER
    upper = lower != data
    stops = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opens[first[first < len(starts)]] = True
    caps = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(upper, out=caps[1:])
    second = upper[starts] | upper[np.minimum(starts + 1, len(data) - 1)]
    single = (caps[ends] - caps[starts] == 1) & second & (ends - starts > 1)
    capital = (types == 0) & single & (kind[starts] == _LETTER)
    types[capital & ~opens] = NAME
    after = np.zeros(len(starts), dtype=bool)
    after[1:] = types[:-1] == NUMBER
    after[first[first < len(starts)]] = False
    types[(types == 0) & after & _among(words, _UNIT_HASHES)] = UNIT
    gaps = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~_JOINS[data], out=gaps[1:])
    beside = np.zeros(len(starts), dtype=bool)
    beside[1:] = gaps[starts[1:]] == gaps[ends[:-1]]
    beside[first[first < len(starts)]] = False

    def continues(types: np.ndarray) -> np.ndarray:
        same = np.append(False, types[1:] == types[:-1])
        return beside & same & ((types == NAME) | ((types == NUMBER) & (kind[starts] == _LETTER)))

    opened = np.where(capital & opens, NAME, types).astype(np.int8)
    return words, types, first, single_character, continues(types), opened, continues(opened)


def collapsed(words: np.ndarray, types: np.ndarray, first: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, types and first tokens with each value of several tokens as one, which has the hash of all."""
    if not more.any():
        return words, types, first
    head = np.flatnonzero(~more)
    place = np.arange(len(words)) - head[np.cumsum(~more) - 1]
    sums = np.add.reduceat(mix(words + place.astype(np.uint64)), head)
    size = np.diff(np.append(head, len(words)))
    return np.where(size > 1, sums, words[head]), types[head], np.searchsorted(head, first)


def template_windows(
    words: np.ndarray, types: np.ndarray, first: np.ndarray, size: int, plain: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, token position in the batch) of the windows that count."""
    n = len(words) - size + 1
    empty = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), empty, empty
    token = words if plain else np.where(types == 0, words, _TYPE_HASH[types])
    h = np.full(n, size * 2 + plain, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + token[k : k + n]
    at = np.arange(n)
    owner = np.searchsorted(first, at, "right") - 1
    good = at + size <= first[owner + 1]
    literal = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(types == 0, out=literal[1:])
    if not plain:
        good &= literal[size:] - literal[:-size] >= min(LITERALS, size - 1)
    good = np.flatnonzero(good)
    return mix(h[good]), owner[good], good


def _scan(id_name: str, sizes: list[int], wanted, each_item: bool):
    """A function for mapInPandas that emits windows: all, or those whose hash may be among `wanted`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bitmap = None
        if wanted is not None:
            known = wanted.value
            bitmap = np.zeros(1 << BITS, dtype=bool)
            bitmap[(known >> np.uint64(64 - BITS)).astype(np.int64)] = True
        for batch in batches:
            ids, keys = batch["id"].to_numpy(), batch["text_key"].to_numpy()
            for lo, _, data, offsets in packed(batch["text"].tolist()):
                words, types, first, single, more, opened, more_opened = canonical(data, offsets)
                singles = np.append(0, np.cumsum(single))
                singles = singles[first[1:]] - singles[first[:-1]]
                forms = {
                    TEMPLATE: (words, types, first), PLAIN: (words, types, first),
                    COLLAPSED: collapsed(words, types, first, more), OPENED: collapsed(words, opened, first, more_opened),
                }
                for form, (words, types, first) in forms.items():
                    values = np.where(types == 0, np.uint64(0), words | np.uint64(1)).view(np.int64)
                    for size in sizes:
                        if size < SHORT and form != PLAIN:
                            continue
                        h, owner, at = template_windows(words, types, first, size, form == PLAIN)
                        if known is not None:
                            hit = np.flatnonzero(bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                            hit = hit[_among(h[hit], known)]
                            h, owner, at = h[hit], owner[hit], at[hit]
                        if each_item:
                            n_tokens = np.diff(first)[owner]
                            keep = np.minimum(n_tokens, WINDOW) == size
                            h, owner, at, n_tokens = h[keep], owner[keep], at[keep], n_tokens[keep]
                        if len(h):
                            out = pd.DataFrame({
                                "id": ids[lo + owner], "text_key": keys[lo + owner], "hash": h.view(np.int64),
                                "at": at - first[owner], "size": np.int32(size), "form": np.int32(form),
                                "vals": list(values[at[:, None] + np.arange(size)]),
                            })
                            if each_item:
                                out["n_tokens"] = n_tokens
                                out["enough"] = np.where(2 * singles[owner] > n_tokens, ENOUGH_CHARACTERS, ENOUGH)
                            yield out

    return run


_SCHEMA = "id string, text_key long, hash long, at long, size int, form int, vals array<long>"


def _keyed(df: DataFrame, row_id: str) -> DataFrame:
    # ids as text: pandas would turn longs with nulls into doubles
    return df.select(F.col(row_id).cast("string").alias("id"), F.xxhash64("text").alias("text_key"), "text")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, matched_tokens, item_tokens, changed_slots) of contaminated documents,
    a row for each document text and item."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = list(range(1, WINDOW + 1))
    items = cut(
        _keyed(benchmark, "item_id").mapInPandas(_scan("item_id", sizes, None, True), _SCHEMA + ", n_tokens long, enough long")
    ).select("id", "text_key", "hash", "at", "size", "form", "vals", "n_tokens", "enough")
    found = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW sizes
    few = items.select("hash").distinct().limit(BROADCAST + 1).count() <= BROADCAST
    wanted = None
    right = items.select(
        F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "hash", "size", "form",
        F.col("at").alias("item_at"), F.col("vals").alias("item_vals"), "n_tokens", "enough",
    )
    if few:
        rows = items.select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(rows.view(np.uint64)))  # BROADCAST hashes at most
    left = _keyed(docs, "doc_id").mapInPandas(_scan("doc_id", found, wanted, False), _SCHEMA)
    bounded = items.limit(BROADCAST_ROWS + 1).count() <= min(BROADCAST_ROWS, BROADCAST)
    joined = left.join(F.broadcast(right) if bounded else right, ["hash", "size", "form"])
    # an alignment has at most as many windows as its item
    lined = joined.groupBy("id", "text_key", "item_id", "item_key", "form", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_sort(F.collect_set("at")).alias("places"),
        F.max("size").alias("size"),
        F.max("n_tokens").alias("item_tokens"),
        F.max("enough").alias("enough"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("item_vals"), F.col("vals"))))).alias("slots"),
    )
    slots = F.filter("slots", lambda s: s["item_vals"] != 0)
    lined = (
        lined.withColumn("slots", F.when(F.col("form") == PLAIN, F.array().cast("array<struct<item_vals:bigint,vals:bigint>>")).otherwise(slots))
        .where(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item_vals"]))))
        .withColumn("changed_slots", F.size(F.filter("slots", lambda s: s["item_vals"] != s["vals"])))
        .withColumn(
            "matched_tokens",
            F.aggregate(
                F.zip_with(
                    F.slice("places", F.lit(2), F.size("places")), F.slice("places", F.lit(1), F.size("places") - 1),
                    lambda b, a: F.least(b - a, F.col("size").cast("long")),
                ),
                F.col("size").cast("long"), lambda s, v: s + v,
            ),
        )
        .where(F.col("matched_tokens") >= F.least("enough", "item_tokens"))
    )
    return lined.groupBy("id", "text_key", "item_id").agg(
        F.max(F.struct("matched_tokens", (-F.col("changed_slots")).alias("kept"), "item_tokens")).alias("best")
    ).select(
        F.col("id").cast("long").alias("doc_id"), "text_key", F.col("item_id").cast("long").alias("item_id"),
        "best.matched_tokens", "best.item_tokens", (-F.col("best.kept")).alias("changed_slots"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, verdict, matched_tokens, item_tokens, changed_slots): a row for each contaminated
    document and each item found in it."""
    return matches(docs, benchmark).select(
        "doc_id", "item_id",
        F.when(F.col("changed_slots") > 0, "reparameterised").otherwise("verbatim").alias("verdict"),
        "matched_tokens", "item_tokens", "changed_slots",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated ones."""
    found = matches(docs, benchmark).select(F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_key")).distinct()
    return docs.join(
        found, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_key")), "left_anti"
    )
