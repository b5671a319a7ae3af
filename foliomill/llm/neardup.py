"""Near-duplicate texts by deletion-variant signatures.

A text is the set of its runs of three words.  Its signature, minimum hashes of all runs (common ones too), is cut into
segments that are few and wide enough for one of them to differ in at most one symbol in nearly all pairs above the
threshold.  Texts meet in an equality join of the one-wildcard variants of a segment.  A wildcard stands in one half of its
segment, so the other half is equal: an entry is shuffled by each half, with the symbols of the other one beside it, and
the variants are made in the task that has it.  Every entry also holds the size and a bitmap of its set, from which the
overlap of two sets is bounded from above: pairs that cannot reach the threshold go no further.  The rest is compared exactly.

The segments are indexed in rounds, so that what is on disk at a time does not grow with their number, and they get wider
with the logarithm of the number of texts: chance meetings grow with its square, but a further symbol makes them rarer.

Texts with equal sets are one class with one signature, so copies are never paired with each other before the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliomill.session import staged

SHINGLE, MIN_WORDS, THRESHOLD = 3, 40, 0.5
#: A pair at the threshold has no segment in common with at most this chance.
MISSED = 0.0025
#: Segments have 4 symbols up to so many texts, and one more for each WIDEN times as many.
NARROW, WIDEN = 2_000_000, 20
#: Segments of one round.
ROUND = 4
#: Index entries of one task.
TASK_ENTRIES = 1_000_000
#: An entry holds so many bytes of its class's hash.  Classes that share them are told apart when pairs are verified.
ID_BYTES = 5
#: Size of the bitmaps that bound the overlap of two sets from above.
BITS = 192
ID_MASK = (1 << 8 * ID_BYTES) - 1
#: Entries of one variant beyond so many are compared in tiles, by tasks of their own.
TILE = 4096
#: Comparisons that are held at once.
AT_ONCE = 1_000_000
#: Sets are filtered by a broadcast list of wanted classes up to this many, by a join beyond it.
BROADCAST_CLASSES = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Words with their hashes, computed at first use."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def sets(texts: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """key, h, runs, bits: the sorted hashes of each text's runs of three words, the hash of the whole set and its bitmap.

    Texts of fewer than `min_words` words (null ones too) have no row.
    """
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("h", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        find, hash_of = _WORD.findall, known.__getitem__
        for b in batches:
            if len(known) > 1_000_000:
                known.clear()
            words: list[str] = []
            places, lengths = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ws = find(t.lower())
                if len(ws) >= min_words:
                    words += ws
                    places.append(i)
                    lengths.append(len(ws))
            if not places:
                continue
            w = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words))
            n = np.array(lengths)
            owner = np.repeat(np.arange(len(n)), n)
            g = _mix(w[:-2] * _M1 + _mix(w[1:-1] * _M2 + _mix(w[2:])))
            inside = owner[:-2] == owner[2:]
            packed = np.sort((owner[:-2][inside].astype(np.uint64) << np.uint64(32)) | (g[inside] & np.uint64(0xFFFFFFFF)))
            packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
            own = (packed >> np.uint64(32)).astype(np.int64)
            value = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            starts = np.searchsorted(own, np.arange(len(n)))
            h = np.add.reduceat(_mix(value.astype(np.uint64) + _M1), starts)
            marks = np.zeros(len(n) * BITS, dtype=bool)
            marks[own * BITS + value % np.uint32(BITS)] = True
            bits = np.packbits(marks).view(np.int64)
            columns = [b.column(0).take(pa.array(places)), pa.array(_mix(h).view(np.int64)), _lists(value.view(np.int32), starts), _lists(bits, np.arange(len(n)) * (BITS // 64))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "h", "runs", "bits"])

    return texts.where(F.length(text) >= 2 * min_words - 1).select(F.col(key), F.col(text)).mapInArrow(run, schema)


def shape(total: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(segments, width) for so many texts."""
    width = 4
    while total > NARROW * WIDEN ** (width - 4):
        width += 1
    meet = threshold**width + width * threshold ** (width - 1) * (1 - threshold)
    return math.ceil(math.log(MISSED) / math.log(1 - meet)), width


def symbols(values: np.ndarray, starts: np.ndarray, segments: range, width: int) -> np.ndarray:
    """Minimum hashes of the sets: an array of segments x width x sets."""
    x = _mix(values.astype(np.uint64))
    out = np.empty((len(segments), width, len(starts)), dtype=np.uint64)
    for i, g in enumerate(segments):
        rng = np.random.default_rng([1234, g])
        a = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        c = rng.integers(0, 1 << 63, width, dtype=np.uint64)
        for j in range(width):
            out[i, j] = np.minimum.reduceat((x * a[j] + c[j]) >> np.uint64(32), starts)
    return out


def entry_type(width: int) -> np.dtype:
    """An index entry: the hash of one half, the symbols of the other, the class, the size of its set and its bitmap."""
    return np.dtype([("half", "<u4"), ("rest", "<u2", (width - width // 2,)), ("id", "u1", (ID_BYTES,)), ("n", "<u2"), ("bits", "<u8", (BITS // 64,))])


def entries(h: np.ndarray, runs: np.ndarray, n: np.ndarray, bits: np.ndarray, segments: range, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each entry goes, the entries) of classes with the given hashes, runs one after the other, sizes and bitmaps."""
    s = symbols(runs.view(np.uint32), np.r_[0, np.cumsum(n)[:-1]], segments, width)
    low, out, target = width // 2, [], []
    one = np.zeros(len(h), dtype=entry_type(width))
    one["id"] = np.ascontiguousarray(h & ID_MASK).view(np.uint8).reshape(-1, 8)[:, :ID_BYTES]
    one["n"] = np.minimum(n, 65_535)
    one["bits"] = bits
    for i, g in enumerate(segments):
        for side in (0, 1):
            held, other = (s[i, :low], s[i, low:]) if side == 0 else (s[i, low:], s[i, :low])
            x = np.full(len(h), 2 * g + side + 1, dtype=np.uint64)
            for row in held:
                x = _mix(x * _M1 + row)
            e = one.copy()
            e["half"] = (x >> np.uint64(32)).astype(np.uint32)
            e["rest"][:, : len(other)] = (other.T & np.uint64(0xFFFF)).astype(np.uint16)
            out.append(e)
            target.append((x & np.uint64(0x7FFFFFFF)).astype(np.int64))
    return np.concatenate(target), np.concatenate(out)


def _ids(e: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(e), 8), dtype=np.uint8)
    wide[:, :ID_BYTES] = e["id"]
    return wide.view(np.int64)[:, 0]


def _possible(e: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """True where sizes and bitmaps allow the threshold.

    Sets that share s runs differ in a + b - 2 s of them, so in no more bits.  A size at the field's end says nothing.
    """
    a, b = e["n"][i].astype(np.int32), e["n"][j].astype(np.int32)
    apart = np.bitwise_count(e["bits"][i] ^ e["bits"][j]).sum(axis=1, dtype=np.int32)
    most = np.minimum((a + b - apart) / 2, np.minimum(a, b))
    return (most >= threshold / (1 + threshold) * (a + b) - 1e-9) | (np.maximum(a, b) == 65_535)


def _pairs_of(e: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> pd.DataFrame:
    keep = _possible(e, i, j, threshold)
    a, b = _ids(e[i[keep]]), _ids(e[j[keep]])
    return pd.DataFrame(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0), columns=["a", "b"])


_FOUND = "a bigint, b bigint, left binary, right binary"


def matches(e: np.ndarray, width: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of the entries of one task that share a half and all symbols of the other but one; larger groups as pairs of tiles."""
    for skip in range(width - width // 2):
        rest = np.delete(e["rest"], skip, axis=1)
        key = e["half"].astype(np.uint64)
        for c in rest.T:
            key = _mix(key * _M1 + c)
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[cut, len(order)])
        for at in np.flatnonzero(size > TILE):
            group = e[order[cut[at] : cut[at] + size[at]]]
            parts = [group[i : i + TILE].tobytes() for i in range(0, len(group), TILE)]
            for i, x in enumerate(parts):
                yield pd.DataFrame([(None, None, x, y) for y in parts[i:]], columns=["a", "b", "left", "right"]).astype({"a": "Int64", "b": "Int64"})
        # each entry with the one `step` places later, as long as it is of the same variant
        small = np.repeat((size > 1) & (size <= TILE), size)
        group = np.repeat(np.arange(len(size)), size)
        left, step, found, held = np.flatnonzero(small), 1, [], 0
        while len(left):
            left = left[left + step < len(order)]
            left = left[group[left] == group[left + step]]
            found.append((order[left], order[left + step]))
            held += len(left)
            step += 1
            if held > AT_ONCE or held and not len(left):
                yield _pairs_of(e, *(np.concatenate(x) for x in zip(*found)), threshold).assign(left=None, right=None)
                found, held = [], 0


def candidates(st: DataFrame, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """a < b: the short ids of each two classes that share a variant and whose overlap may reach the threshold, once."""
    count, width = shape(total, threshold)
    kind = entry_type(width)
    rounds = []
    for begin in range(0, count, ROUND):
        segments = range(begin, min(begin + ROUND, count))
        tasks = max(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * len(segments) * 2 // TASK_ENTRIES))

        def index(batches: Iterator[pa.RecordBatch], segments: range = segments, tasks: int = tasks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, at = np.unique(b.column(0).to_numpy(), return_index=True)  # copies within a batch are indexed once
                if not len(h):
                    continue
                runs, bits = b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))
                n = np.diff(runs.offsets.to_numpy())
                target, e = entries(h, runs.flatten().to_numpy(), n, bits.flatten().to_numpy().view(np.uint64).reshape(len(h), -1), segments, width)
                target = target % tasks
                order = np.argsort(target, kind="stable")
                target, e = target[order], e[order]
                cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(target[cut].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(e)])], pa.binary())], names=["target", "entries"])

        def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[bytes]] = {}
            for b in batches:
                for t, x in zip(b["target"], b["entries"]):
                    held.setdefault(t, []).append(x)
            for t in list(held):
                # the same class may come from several tasks
                e = np.unique(np.frombuffer(b"".join(held.pop(t)), dtype=np.dtype((np.void, kind.itemsize)))).view(kind)
                yield from matches(e, width, threshold)

        found = st.select("h", "runs", "bits").mapInArrow(index, "target int, entries binary").repartition(tasks, "target").mapInPandas(pair, _FOUND)
        rounds.append(staged(found, "pairs"))  # the entries of a round leave the disk before the next one begins

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in zip(b["left"], b["right"]):
                e, n = np.frombuffer(x + y, dtype=kind), len(x) // kind.itemsize
                i, j = np.triu_indices(n, 1) if x == y else (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(n, len(e)), indexing="ij"))
                for at in range(0, len(i), AT_ONCE):
                    yield _pairs_of(e, i[at : at + AT_ONCE], j[at : at + AT_ONCE], threshold)

    all_ = rounds[0]
    for r in rounds[1:]:
        all_ = all_.unionByName(r)
    hot = all_.where("left IS NOT NULL").select("left", "right").repartition(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(tile, "a bigint, b bigint")
    return all_.where("a < b").select("a", "b").unionByName(hot.where("a < b")).distinct()


def near_duplicate_classes(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members): links are a < b, similarity between classes of equal sets; members are h, key.

    Edge cases: null texts and those of fewer than 40 words are in no class; a key given twice counts once; an empty
    table gives two empty results; other columns are not read.
    """
    st = staged(sets(texts, key, text), "sets")
    total = st.count()
    names = st.select(F.col("h").bitwiseAND(F.lit(ID_MASK)).alias("k"), "h").distinct()
    cand = candidates(st, total, threshold).join(names.withColumnsRenamed({"k": "a", "h": "ha"}), "a").join(names.withColumnsRenamed({"k": "b", "h": "hb"}), "b")
    cand = staged(cand.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).where("a < b").distinct(), "candidates")
    wanted = cand.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    if wanted.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    chosen = st.select("h", "runs").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    both = cand.join(chosen.select(F.col("h").alias("a"), F.col("runs").alias("ra")), "a").join(chosen.select(F.col("h").alias("b"), F.col("runs").alias("rb")), "b")
    same = F.size(F.array_intersect("ra", "rb"))
    links = both.select("a", "b", (same / (F.size("ra") + F.size("rb") - same)).alias("similarity")).where(F.col("similarity") >= threshold)
    return staged(links, "links"), st.select("h", key).distinct()


def pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """a < b by key: every two texts of linked classes or of one class."""
    copies = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("a"), F.col("h").alias("b"))
    all_links = links.select("a", "b").unionByName(copies)
    out = all_links.join(members.select(F.col("h").alias("a"), F.col(key).alias("x")), "a").join(members.select(F.col("h").alias("b"), F.col(key).alias("y")), "b")
    return out.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
