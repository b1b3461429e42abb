"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else in the table.

Every window of ``LENGTH`` bytes has an anchor: the position in it whose ``GRAM`` following bytes have the least hash.
Equal windows have equal anchors at the same place, so windows are compared by anchor only. A run of windows with
one anchor is a *stretch*; there is about one for every 85 bytes.

1. Stretches are aggregated by the hash of their anchor. Anchors seen once are dropped. Where all stretches of an
   anchor have the same content, all their windows are repeated.
2. Of the others one owner for each distinct content is chosen and its bytes are read. The stretches of an anchor are
   sorted as suffixes from the anchor on: a bottom-up mergesort whose comparisons find the common extension by binary
   search over prefix polynomial hashes. Windows are equal if their parts right of the anchor lie in one run of the
   sorted order with common extensions that long, and the hashes of their parts left of it agree. Every match that
   the sort finds is verified byte by byte; that whole stretches have the same content is trusted to two independent
   64-bit hashes.
3. A task sorts some ``GROUP`` stretches. An anchor with more different ones, such as the edge of a passage that many
   different texts hold, is split over groups. Each group of a split anchor lists its different windows once, by a
   128-bit digest of their bytes; a combined aggregate finds those that several groups list.
4. The covered ranges return to all owners of the content and are merged in each document.

Rules: null text is empty; texts shorter than a window keep all bytes. Matches never cross documents. Rows that
agree in id and text repeat each other. Extra columns are ignored. Null ids come back null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

LENGTH, GRAM = 200, 32
SLICE = 1 << 20  # window starts worked on at once
GROUP = 4096  # different stretches that a task sorts together
_PLACE = np.uint64((1 << 22) - 1)
_SECOND, _VALUES = np.uint64(0xC2B2AE3D27D4EB4F), C.mix(np.arange(1, 257))  # base and byte values of the second hash
_SECOND_INVERSE = np.uint64(pow(int(_SECOND), -1, 1 << 64))
KEY = ["id", "mark"]
CONTENT = ["gram_hash", "content", "check"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key that equal rows share: the id (null as the least long) and a hash of the text."""
    return C.texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("mark"), "text")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - span:]) if width > span else out


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """``row, start, windows, anchor`` (from the start), ``gram_hash``, ``content``, ``check`` of every stretch."""
    found = []
    starts_all = np.arange(max(0, len(data) - length + 1))
    valid = np.zeros(len(starts_all) + 1, bool)
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= length:
            valid[a:b - length + 1] = True
    for low in range(0, len(starts_all), SLICE):
        high = min(len(starts_all), low + SLICE)
        part = data[low:high + length - 1]
        prefix = C.prefix_hashes(part)
        at = np.arange(len(part) - gram + 1)
        grams = C.mix(C.span_hashes(prefix, at, at + gram))
        # The place in the low bits makes the first of equal hashes the least.
        ranked = (grams & ~_PLACE) | at.astype(np.uint64)
        anchor = (_least(ranked, length - gram + 1) & _PLACE).astype(np.int64)
        ok = valid[low:high]
        row = np.searchsorted(offsets, np.arange(low, high), "right") - 1
        begins = ok.copy()
        begins[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        ends = ok.copy()
        ends[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        windows = last - first + 1
        content = C.mix(C.span_hashes(prefix, first, last + length) + C.mix(
            (windows * 512 + anchor[first] - first).astype(np.uint64)))
        second = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * C.powers(len(part), _SECOND), out=second[1:])
        check = (second[last + length] - second[first]) * C.powers(len(part), _SECOND_INVERSE)[first]
        found.append((row[first], first + low - offsets[row[first]], windows, anchor[first] - first, grams[anchor[first]], content, check))
    names = ("row", "start", "windows", "anchor", "gram_hash", "content", "check")
    return {k: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i, k in enumerate(names)}


_STRETCH = "id long, mark long, start int, windows int, anchor int, gram_hash long, content long, check long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for a, b, data, offsets in C.text_blocks(batch):
            s = stretches(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b][s["row"]], pa.int64()), pa.array(marks[a:b][s["row"]], pa.int64())]
                + [pa.array(s[k].astype(np.int32)) for k in ("start", "windows", "anchor")]
                + [pa.array(s[k].astype(np.uint64).view(np.int64)) for k in CONTENT],
                [*KEY, "start", "windows", "anchor", *CONTENT])


class Suffixes:
    """Strings end to end with prefix hashes; each has a suffix from its anchor on."""

    def __init__(self, group: np.ndarray, strings: list[bytes], anchors: np.ndarray):
        self.data, self.offsets = C.as_block(strings)
        self.prefix = C.prefix_hashes(self.data)
        self.unpower = C.powers(len(self.prefix), C.BASE_INVERSE)
        self.group, self.anchors = group, anchors
        self.begin, self.end = self.offsets[:-1] + anchors, self.offsets[1:]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of suffixes x and y, by binary search over hashes."""
        a, b = self.begin[x], self.begin[y]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.end[x] - a, self.end[y] - b)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = ((self.prefix[a + middle] - self.prefix[a]) * self.unpower[a]
                    == (self.prefix[b + middle] - self.prefix[b]) * self.unpower[b])
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether x sorts before y: by group, then by suffix; equal ones by number."""
        out = self.group[x] < self.group[y]
        tied = np.flatnonzero(self.group[x] == self.group[y])
        if len(tied):
            p, q = x[tied], y[tied]
            common = self.extension(p, q)
            a, b = self.begin[p] + common, self.begin[q] + common
            end_a, end_b = a >= self.end[p], b >= self.end[q]
            last = len(self.data) - 1
            byte_a, byte_b = self.data[np.minimum(a, last)], self.data[np.minimum(b, last)]
            out[tied] = np.where(end_a | end_b, np.where(end_a & end_b, p < q, end_a), byte_a < byte_b)
        return out

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort, all merges of a level at once: an element's new place is its own place plus its
        rank in the other run, found by binary search."""
        order = np.argsort(self.group, kind="stable")
        n, width = len(order), 1
        while width < n:
            place = np.arange(n)
            block = place // (2 * width) * (2 * width)
            left = place < block + width
            other = np.where(left, block + width, block)
            stop = np.minimum(np.where(left, block + 2 * width, block + width), n)
            low, high = np.minimum(other, n), np.maximum(np.minimum(other, n), stop)
            # Runs that already stand in order need no search.
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                first = self.before(order[middle], order[open_])
                low[open_[first]] = middle[first] + 1
                high[open_[~first]] = middle[~first]
            target = block + (place - np.where(left, block, block + width)) + (low - np.minimum(other, n))
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order


def repeated_windows(group: np.ndarray, strings: list[bytes], anchors: np.ndarray, windows: np.ndarray,
                     length: int = LENGTH) -> np.ndarray:
    """(strings, most windows) flags: the window from that byte on is also in another string of the group."""
    most = int(windows.max()) if len(windows) else 0
    flags = np.zeros((len(strings), most), bool)
    if len(strings) < 2:
        return flags
    suffixes = Suffixes(group, strings, anchors)
    order = suffixes.sort()
    x, y = order[:-1], order[1:]
    common = np.where(group[x] == group[y], suffixes.extension(x, y), -1)
    # Collision verification: a claimed extension is compared byte by byte, and cut where the bytes differ.
    data, last = suffixes.data, len(suffixes.data) - 1
    for a in range(0, len(x), 4096):
        step = np.arange(int(max(0, common[a:a + 4096].max())))
        p, q = suffixes.begin[x[a:a + 4096], None] + step, suffixes.begin[y[a:a + 4096], None] + step
        wrong = (data[np.minimum(p, last)] != data[np.minimum(q, last)]) & (step < common[a:a + 4096, None])
        bad = wrong.any(axis=1)
        common[a:a + 4096][bad] = wrong[bad].argmax(axis=1)
    anchor, begin, count = anchors[order], suffixes.begin[order], windows[order]
    for back in range(0, length):
        window = anchor - back
        have = np.flatnonzero((window >= 0) & (window < count))
        if len(have) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common < length - back)])[have]
        start = begin[have] - back
        left = (suffixes.prefix[begin[have]] - suffixes.prefix[start]) * suffixes.unpower[start]
        ranked = np.lexsort((left, run))
        same = np.flatnonzero((run[ranked][1:] == run[ranked][:-1]) & (left[ranked][1:] == left[ranked][:-1]))
        if not len(same):
            continue
        p, q = ranked[same], ranked[same + 1]
        if back:
            step = np.arange(back)
            good = (data[start[p][:, None] + step] == data[start[q][:, None] + step]).all(axis=1)
            p, q = p[good], q[good]
        for side in (p, q):
            flags[order[have[side]], window[have[side]]] = True
    return flags


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


_BYTES = "bucket long, part long, parts long, gram_hash long, content long, check long, anchor int, windows int, owners long, stretch binary"
_FLAGS = "gram_hash long, content long, check long, begins array<int>, ends array<int>, places array<int>, digests array<binary>"


def _bytes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the chosen stretches of each document."""
    names = [c.split()[0] for c in _BYTES.split(", ")]
    for frame in frames:
        rows = []
        for text, chosen in zip(frame["text"], frame["chosen"]):
            raw = text.encode()
            rows += [(*(s[c] for c in names[:-1]), raw[s["start"]:s["start"] + s["windows"] + LENGTH - 1]) for s in chosen]
        yield pd.DataFrame(rows, columns=names)


def _listed(strings: list[bytes], windows: np.ndarray) -> list[tuple[list[int], list[bytes]]]:
    """Places and digests of the windows of each string, every different window once in all."""
    out, seen = [], set()
    for string, n in zip(strings, windows):
        places, digests = [], []
        for k in range(n):
            digest = hashlib.blake2b(string[k:k + LENGTH], digest_size=16).digest()
            if digest not in seen:
                seen.add(digest)
                places.append(k)
                digests.append(digest)
        out.append((places, digests))
    return out


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates(CONTENT)
    windows = frame["windows"].to_numpy(np.int64)
    strings = [bytes(s) for s in frame["stretch"]]
    flags = repeated_windows(frame["gram_hash"].to_numpy(), strings, frame["anchor"].to_numpy(np.int64), windows)
    flags[frame["owners"].to_numpy() > 1] = True
    flags &= np.arange(flags.shape[1]) < windows[:, None]
    ranges = [_ranges(f) for f in flags]
    # All rows of a group agree in ``parts``.
    listed = _listed(strings, windows) if frame["parts"].iloc[0] > 1 else [([], [])] * len(frame)
    out = frame[CONTENT].assign(begins=[r[0] for r in ranges], ends=[r[1] for r in ranges],
                                places=[x[0] for x in listed], digests=[x[1] for x in listed])
    return out[(out["begins"].str.len() > 0) | (out["places"].str.len() > 0)]


def repeats(keyed: DataFrame) -> DataFrame:
    """``id, mark, spans``: byte ranges (begin, end) of each text that repeated windows cover, not yet merged."""
    found = settle(keyed.select(*KEY, "text").mapInArrow(_find, _STRETCH), "stretches")
    both = F.struct("content", "check")
    shared = (found.groupBy("gram_hash").agg(F.count("*").alias("n"), F.min(both).alias("low"), F.max(both).alias("high"))
              .where("n > 1").select("gram_hash", (F.col("low") == F.col("high")).alias("alike")))
    met = settle(found.join(shared, "gram_hash"), "shared-stretches")
    span = lambda begin, end: F.struct((F.col("start") + begin).alias("begin"), (F.col("start") + end + LENGTH - 1).alias("end"))
    alike = met.where("alike").select(*KEY, span(F.lit(0), F.col("windows")).alias("span"))
    mixed = met.where("not alike")
    # One owner for each content; the others get its result.
    owner = F.struct(*KEY, "start", "anchor", "windows")
    contents = settle(mixed.groupBy(*CONTENT).agg(F.min(owner).alias("o"), F.count("*").alias("owners")), "contents")
    buckets = max(1, -(-contents.count() // GROUP))
    hot = (contents.groupBy("gram_hash").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
           .select("gram_hash", F.ceil(F.col("n") / GROUP).alias("parts")))
    # Anchors of few stretches share a bucket; those of many have parts of their own, in no bucket.
    dealt = (contents.join(hot, "gram_hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("bucket", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("gram_hash"), F.lit(buckets)))
                         .otherwise(F.col("gram_hash")))
             .withColumn("part", F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.pmod("content", "parts"))))
    chosen = (dealt.select("o.id", "o.mark", F.struct("bucket", "part", "parts", *CONTENT, "o.anchor", "o.windows", "owners", "o.start").alias("s"))
              .groupBy(*KEY).agg(F.collect_list("s").alias("chosen")))
    read = keyed.join(chosen, KEY).select("text", "chosen").mapInPandas(_bytes_of, _BYTES)
    flags = settle(read.groupBy("bucket", "part").applyInPandas(_compare, _FLAGS), "repeated-windows")
    listed = (flags.where(F.size("places") > 0).select(*CONTENT, F.explode(F.arrays_zip("places", "digests")).alias("w"))
              .select(*CONTENT, F.col("w.places").alias("place"), F.col("w.digests").alias("digest")))
    across = (listed.join(listed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest")
              .groupBy(*CONTENT).agg(F.sort_array(F.collect_list("place")).alias("begins"))
              .withColumn("ends", F.transform("begins", lambda x: x + 1)))
    ranges = flags.where(F.size("begins") > 0).select(*CONTENT, "begins", "ends").unionByName(across)
    spread = (mixed.join(ranges, CONTENT)
              .select(*KEY, "start", F.explode(F.arrays_zip("begins", "ends")).alias("r"))
              .select(*KEY, span(F.col("r.begins"), F.col("r.ends")).alias("span")))
    return alike.unionByName(spread).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    keyed = _keyed(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, spans in zip(frame["text"], frame["spans"]):
                raw = text.encode()
                covered = np.zeros(len(raw) + 1, np.int32)
                if spans is not None and len(spans):
                    np.add.at(covered, [s["begin"] for s in spans], 1)
                    np.add.at(covered, [s["end"] for s in spans], -1)
                gone = np.cumsum(covered)[:-1] > 0
                begins, _ = _ranges(gone)
                rows.append((len(raw), int(gone.sum()), len(begins), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            yield out.assign(id=frame["id"].to_numpy())[["id", "n_bytes", "n_removed", "n_spans", "kept"]]

    return (keyed.join(repeats(keyed), KEY, "left").select("id", "text", "spans")
            .mapInPandas(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
            .select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
