"""Near-duplicates by Order MinHash and banded alignment.

A text is read as lower-case words without ASCII punctuation. Its runs of five words are labelled with their
occurrence number; each of ``SKETCHES`` hash functions picks the ``PICKS`` smallest of them and keeps them in text
order, so a sketch is sensitive to order as edit similarity is. Texts that share a sketch are candidates; a
banded alignment of their words (furthest-reaching diagonals, band set by the limit) keeps pairs whose edit
similarity, 1 - distance / longer length, is at least ``SIMILARITY``. Classes are the connected components.

Equal texts are one node from the start. In a bucket of equal sketches every node is first compared with the smallest
node of the bucket, found by an aggregate that is combined before the shuffle. That joins most classes. In buckets that
still hold several classes, the nodes outside the largest class, the *minors*, are compared with all nodes of the
bucket that are in other classes, block by block; words and two-word runs that a pair shares, counted exactly, rule out
most pairs without an alignment.

A bucket with more than ``MINORS`` minors (a passage in many texts that are else unlike) is not compared whole: its nodes
meet by their rarest words instead, which is exact as well. Similar texts share all but a fifth of the longer one's
words, so in any one order of the words at least ``RARE`` shared ones (all, if they share fewer) are among each text's
first fifth and ``RARE`` more; in the order from rare to frequent these are seldom words of the passage. Texts that
share that many of them are aligned. ``minors=None`` compares every bucket whole. Either way each pair that shares a
sketch is compared, ruled out by a bound or connected already.

Rules: null text is empty; all empty texts are copies of each other. A text of fewer than five words has one run,
all its words. Rows with the same id and different texts are documents of their own. A class is named by its
smallest id (null only if all its ids are null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

SKETCHES, PICKS, WORDS, SIMILARITY = 32, 3, 5, 0.8
BLOCK, MINORS = 256, 1024  # nodes in a block of a bucket; minors of a bucket that is compared whole
RARE, FEW = 8, 8  # shared words asked for among the rarest; edits that diagonals are tried for
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)

# Everything in ASCII but letters and digits parts words; capitals become small.
_PARTS = np.zeros(256, bool)
_PARTS[:128] = [not chr(k).isalnum() for k in range(128)]
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def digest(text: str | Column) -> Column:
    """Names a text: 128 bits."""
    return F.unhex(F.md5((F.col(text) if isinstance(text, str) else text).cast("binary")))


def folded(data: np.ndarray) -> np.ndarray:
    """Small ASCII letters, and small two-byte Latin letters."""
    out = _SMALL[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every normalised word of a block."""
    return C.word_hashes(folded(data), offsets, _PARTS)


def numbered(runs: np.ndarray, row: np.ndarray) -> np.ndarray:
    """``runs`` labelled with their occurrence number in the row: no value occurs twice in a row."""
    # Equal (row, run) stand together in a stable order.
    keyed = runs ^ C.mix(row.astype(np.uint64) + np.uint64(1 << 62))  # not what a small run is mixed to
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    group = np.flatnonzero(new)
    count = np.empty(len(order), np.uint64)
    count[order] = np.arange(len(order)) - np.repeat(group, np.diff(np.append(group, len(order))))
    return C.mix(runs + count * np.uint64(0x9E3779B97F4A7C15))


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order MinHash of every row: (rows, SKETCHES); rows without words get zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, SKETCHES), np.uint64)
    runs, row = C.shingles(*normal_words(data, offsets), WORDS)
    if len(runs) == 0:
        return out
    labelled = numbered(runs, row)
    present, starts = np.unique(row, return_index=True)
    dense = np.repeat(np.arange(len(present)), np.diff(np.append(starts, len(row))))
    for j, seed in enumerate(_SEEDS):
        value = labelled * seed
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        picked = np.full((len(present), PICKS), len(row), np.int64)
        for k in range(PICKS):
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero((value == least[dense]) & (value != _FULL))
            first = np.ones(len(at), bool)
            first[1:] = dense[at[1:]] != dense[at[:-1]]
            at = at[first]
            picked[dense[at], k] = at
            value[at] = _FULL
        picked.sort(axis=1)
        padded = np.append(labelled, np.uint64(0))
        key = np.full(len(present), np.uint64(j + 1))
        for k in range(PICKS):
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + padded[picked[:, k]])
        out[present, j] = key
    return out


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two word sequences, by Myers's bit vectors: where a column of the table goes up or down."""
    places: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << k)
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for word in b.tolist():
        equal = places.get(word, 0)
        flat = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up, right_down = down | (full ^ (flat | up)), up & flat
        score += bool(right_up & last) - bool(right_down & last)
        right_up = (right_up << 1 | 1) & full
        up, down = ((right_down << 1) & full) | (full ^ (flat | right_up)), right_up & flat
    return score


def within(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two word sequences if at most ``limit``, else ``limit`` + 1.

    Diagonals within the limit hold how far they reach for a number of edits; equal words extend them. Where that takes
    many edits, bit vectors are faster.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    # Words of one side that the other lacks need an edit each.
    values, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    have_a, have_b = np.bincount(counts[:len(a)], minlength=len(values)), np.bincount(counts[len(a):], minlength=len(values))
    shared = int(np.minimum(have_a, have_b).sum())
    if max(len(a), len(b)) - shared > limit:
        return limit + 1
    goal, width = len(b) - len(a), 2 * limit + 3
    middle = limit + 1
    shift = np.arange(width) - middle
    reach = np.full(width, -2, np.int64)  # along a, on the diagonal b - a = shift
    ends_a, ends_b = np.append(a, 0), np.append(b, 0)
    for edits in range(limit + 1):
        if edits > FEW + len(b) // 64:
            return min(distance(a, b), limit + 1)
        if edits == 0:
            low = high = middle
            now = np.array([0])
        else:
            low, high = max(1, middle - edits), min(width - 2, middle + edits)
            now = np.maximum(reach[low:high + 1] + 1, np.maximum(reach[low - 1:high], reach[low + 1:high + 2] + 1))
        d = shift[low:high + 1]
        now = np.minimum(now, np.minimum(len(a), len(b) - d))
        live = np.flatnonzero((now >= 0) & (now + d >= 0))
        while len(live):
            i = now[live]
            j = i + d[live]
            going = (i < len(a)) & (j < len(b)) & (ends_a[np.minimum(i, len(a))] == ends_b[np.minimum(j, len(b))])
            live = live[going]
            now[live] += 1
        if low <= middle + goal <= high and now[middle + goal - low] >= len(a):
            return edits
        now[(now + d) < 0] = -2
        reach[low:high + 1] = now
    return limit + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    limit = int((1 - least) * longest + 1e-9)
    return within(a, b, limit) <= limit


def _per_text(source: DataFrame, held: list[str], schema: str, make) -> DataFrame:
    """Replace ``text`` by packed bytes that ``make`` derives from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.column(batch.schema.get_field_index(c)) for c in held]
            for first, end, data, offsets in C.text_blocks(batch):
                packed = pa.array(make(data, offsets), pa.binary())
                yield pa.RecordBatch.from_arrays([k.slice(first, end - first) for k in keep] + [packed], held + ["packed"])

    return source.select(*held, "text").mapInArrow(run, schema)


def _sketch_rows(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [s.tobytes() if s.any() else b"" for s in sketches(data, offsets)]


def _word_rows(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    hashes, row = normal_words(data, offsets)
    short = (hashes >> np.uint64(32)).astype("<u4")
    cuts = np.searchsorted(row, np.arange(len(offsets)))
    return [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key``, ``node`` for each sketch of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, node = batch.column(1).to_pylist(), np.asarray(batch.column(0))
            some = np.array([len(p) > 0 for p in packed], bool)
            keys = np.frombuffer(b"".join(packed), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node[some], SKETCHES))], ["key", "node"])

    return nodes.select("node", "packed").mapInArrow(run, "key long, node long")


def _candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b``: the smallest node of a bucket with each other one there."""
    least = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    return (rows.join(least.select("key", "a"), "key").select("a", F.col("node").alias("b")).where("a < b").distinct())


def _words(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node``, ``packed``: the words of candidate texts, read once."""
    needed = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
              .join(nodes.select("node", "digest", "doc_id"), "node")
              .select("node", "digest", F.col("doc_id").alias("first_id")))
    texts = docs.join(needed, docs["digest"].eqNullSafe(needed["digest"]) & docs["doc_id"].eqNullSafe(needed["first_id"]))
    return settle(_per_text(texts.select("node", "text"), ["node"], "node long, packed binary", _word_rows)
                  .dropDuplicates(["node"]), "candidate-words")


def _verified(words: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs that align."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least)
                    for x, y in zip(frame["words_a"], frame["words_b"])]
            yield frame.loc[good, ["a", "b"]]

    side = lambda k: words.select(F.col("node").alias(k), F.col("packed").alias(f"words_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b")
    # Pairs differ much in cost, so they are dealt out anew.
    return settle(joined.repartition("a", "b").mapInPandas(run, "a long, b long"), "verified-pairs")


def shared(ids: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """How many ids each text of ``left`` has in common with each of ``right``; ids occur once in a text."""
    _, code, count = np.unique(ids, return_inverse=True, return_counts=True)
    common = count[code] > 1
    code, row = code[common], row[common]
    code = (np.cumsum(count > 1) - 1)[code]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out, step = np.zeros((len(left), len(right)), np.float32), 4096
    place = np.full((2, rows), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [first, first + step])
        sides = []
        for side, n in zip(place, (len(left), len(right))):
            held = np.zeros((n, step), np.float32)
            at = side[row[a:b]]
            held[at[at >= 0], code[a:b][at >= 0] - first] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def possible(texts: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Which texts of ``left`` can be similar to which of ``right``. An edit changes the length by one and breaks one
    word and two two-word runs at most, so at least ``longest - limit`` words and ``longest - 1 - 2 * limit`` runs are
    shared, each as often as it occurs in both."""
    size = np.array([len(t) for t in texts])
    longest = np.maximum(size[left][:, None], size[right][None])
    limit = ((1 - least) * longest + 1e-9).astype(np.int64)
    fits = np.abs(size[left][:, None] - size[right][None]) <= limit
    for width in (1, 2):
        # Texts without a possible partner drop out before the next count.
        rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if len(rows) == 0:
            break
        used = np.unique(np.concatenate([left[rows], right[columns]]))
        runs, row = [], []
        for k in used:
            t = texts[k].astype(np.uint64)
            runs.append(C.mix(t if width == 1 else t[:-1] * np.uint64(0x9E3779B97F4A7C15) + t[1:]))
            row.append(np.full(len(runs[-1]), k))
        runs, row = np.concatenate(runs), np.concatenate(row)
        count = shared(numbered(runs, row), row, left[rows], right[columns], len(texts))
        part = np.ix_(rows, columns)
        fits[part] &= count >= longest[part] - (width - 1) - width * limit[part]
    return fits


def _by_rare_words(rows: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of ``node``s in different classes that share ``RARE`` of their rarest words (or as many
    as similar texts of their lengths must share); every similar pair does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, packed in enumerate(batch.column(2).to_pylist()):
                text = np.frombuffer(packed, "<u4").astype(np.uint64)
                word = numbered(C.mix(text), np.zeros(len(text), np.int64)).astype(np.int64)
                node, label = (np.full(len(word), batch.column(c)[k].as_py(), np.int64) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, label, np.full(len(word), len(word), np.int64), word)],
                                                 ["node", "label", "size", "word"])

    limit = lambda size: F.floor(F.lit(1 - least) * size + F.lit(1e-9))
    held = settle(rows.join(words, "node").select("node", "label", "packed").mapInArrow(run, "node long, label long, size long, word long"), "split-words")
    often = held.groupBy("word").agg(F.count("*").alias("often"))
    # Words of one text count among its rarest, but nobody meets there.
    rare = (held.join(often, "word").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("often", "word")))
            .where((F.col("place") <= limit(F.col("size")) + RARE) & (F.col("often") > 1)))
    rare = settle(rare.select("word", "node", "label", "size"), "rare-words")
    ends = [rare.select("word", F.col("node").alias(k), F.col("label").alias(f"label_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab"]
    longest = F.greatest("size_a", "size_b")
    met = ends[0].join(ends[1], "word").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
                                              & (longest - F.least("size_a", "size_b") <= limit(longest)))
    return (met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(longest).alias("longest"))
            .where(F.col("n") >= F.least(F.lit(RARE), F.col("longest") - limit(F.col("longest")))).select("a", "b"))


def _mixed(rows: DataFrame) -> DataFrame:
    """``key``, ``n``, ``top`` (largest class), ``minors`` of the buckets that hold several classes."""
    classes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    return (classes.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"))
            .where("n > most").select("key", "n", "top", (F.col("n") - F.col("most")).alias("minors")))


def _rest(rows: DataFrame, words: DataFrame, labels: DataFrame, pairs: DataFrame, least: float,
          minors: int | None = MINORS) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` that meet in a bucket, are in different classes, were not compared in ``pairs`` and
    that no bound rules out."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        node, label = frame["node"].to_numpy(), frame["label"].to_numpy()
        left, right = np.flatnonzero(frame["minor"].to_numpy()), np.flatnonzero(frame["home"].to_numpy())
        texts = [np.frombuffer(x, "<u4") for x in frame["packed"]]
        fits = possible(texts, left, right, least) & (label[left][:, None] != label[right][None])
        i, j = np.nonzero(fits)
        i, j = left[i], right[j]
        # Of the buckets in which two nodes meet, the one with the smallest key lists the pair.
        key, keys = frame["key"].iat[0], [np.sort(k) for k in frame["keys"]]
        first = np.array([np.intersect1d(keys[x], keys[y], assume_unique=True)[0] == key for x, y in zip(i, j)], bool)
        a, b = node[i[first]], node[j[first]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    known = words.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    met = settle(rows.join(known, "node").select("key", "node", "label"), "labelled-buckets")
    held = settle(met.join(settle(_mixed(met), "mixed-buckets"), "key"), "mixed-rows")
    whole = F.lit(minors is None) | (F.col("minors") <= (minors or 0))
    dealt = (held.where(whole).withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("minor", F.col("label") != F.col("top"))
             .withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
             .withColumn("part", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("own"))))
             .select("key", "part", "node", "label", "minor", (F.col("part") == F.col("own")).alias("home")))
    own_keys = held.where(whole).groupBy("node").agg(F.collect_set("key").alias("keys"))
    found = dealt.join(words.join(own_keys, "node"), "node").groupBy("key", "part").applyInPandas(meet, "a long, b long")
    split = held.where(~whole).select("node", "label").distinct()
    if not split.isEmpty():
        found = found.unionByName(_by_rare_words(split, words, least))
    return settle(found.distinct().join(pairs, ["a", "b"], "left_anti"), "further-pairs")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: a node of its connected component, the same for all of them, for each node of an edge.

    Each round every node joins the first of its neighbours and itself, and edges are drawn between those joined; the
    edges that are left shrink, and none is left in the end. Smaller nodes come first in the first round, so that stars
    around the smallest node of a bucket vanish at once; later a hash decides, so that chains shrink by a share.
    """
    rest, labels, turn = edges.select("a", "b"), None, 0
    while True:
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn)))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("node"))).alias("near"))
        own = F.struct(rank("a").alias("rank"), F.col("a").alias("node"))
        step = settle(first.select(F.col("a").alias("node"), F.least("near", own)["node"].alias("into")), "joined-nodes")
        if labels is None:
            labels = step.select("node", F.col("into").alias("label"))
        else:
            moved = labels.join(step.select(F.col("node").alias("label"), "into"), "label", "left")
            labels = settle(moved.select("node", F.coalesce("into", "label").alias("label")), "labels")
        ends = [step.select(F.col("node").alias(k), F.col("into").alias(f"into_{k}")) for k in "ab"]
        drawn = rest.join(ends[0], "a").join(ends[1], "b").where("into_a <> into_b")
        rest = settle(drawn.select(F.least("into_a", "into_b").alias("a"), F.greatest("into_a", "into_b").alias("b")).distinct(), "edges-left")
        if rest.isEmpty():
            return labels
        turn += 1


def _classes_joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``label``, ``into``: the classes of ``labels`` (of nodes without one: the node) that further edges connect."""
    ends = [labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab"]
    between = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
    return components(settle(between, "class-edges")).select(F.col("node").alias("label"), F.col("label").alias("into"))


def _graph(docs: DataFrame, least: float, minors: int | None) -> tuple[DataFrame, DataFrame]:
    """Every row's id and digest; every distinct text's node with its label."""
    source = C.texts(docs).withColumn("digest", digest("text"))
    rows = settle(_per_text(source, ["doc_id", "digest"], "doc_id long, digest binary, packed binary", _sketch_rows), "sketches")
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("packed").alias("packed"))
    nodes = settle(ids.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = settle(_buckets(nodes), "sketch-buckets")
    pairs = settle(_candidates(buckets), "candidate-pairs")
    words = _words(source, nodes, pairs)
    edges = _verified(words, pairs, least)
    labels = components(edges)
    further = _verified(words, _rest(buckets, words, labels, pairs, least, minors), least)
    named = nodes.select("digest", "doc_id", "copies", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if not further.isEmpty():
        named = named.join(_classes_joined(labels, further), "label", "left").withColumn("label", F.coalesce("into", "label"))
    return rows.select("doc_id", "digest"), named


def classes(docs: DataFrame, least: float = SIMILARITY, minors: int | None = MINORS) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size`` (rows in the class) for every row."""
    rows, nodes = _graph(docs, least, minors)
    groups = nodes.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.join(groups, "label").select("digest", "class_id", "class_size")
    return rows.join(named, "digest").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, least: float = SIMILARITY, minors: int | None = MINORS) -> DataFrame:
    """``docs`` with one row of each class: the smallest id (nulls last), then the smallest digest."""
    rows, nodes = _graph(docs, least, minors)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    kept = nodes.groupBy("label").agg(F.min(rank).alias("kept")).select(
        F.col("kept.doc_id").alias("kept_id"), F.col("kept.digest").alias("kept_digest"))
    # A row's own columns travel in one struct, so that no name can clash.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest(text).alias("own_digest"),
                        F.col("doc_id").cast("long").alias("own_id"))
    found = named.join(kept, F.col("own_digest").eqNullSafe(F.col("kept_digest")) & F.col("own_id").eqNullSafe(F.col("kept_id")))
    return found.dropDuplicates(["kept_digest", "kept_id"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
