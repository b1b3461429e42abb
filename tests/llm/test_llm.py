"""The language-model operators against brute force on small tables with nulls, empty texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from barline.llm import (byte_bpe, decontaminate, fingerprints, language, language_model, line_dedup, near_dedup,
                         suffix_dedup, token_files, warc)
from barline.session import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, host string, bad string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeiknorstéü") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    texts = [prose(rng.randrange(5, 220)) + "\n" + prose(9) for _ in range(40)]
    texts += [t + "\nsame line here" for t in texts[:6]] + [texts[7], texts[7], prose(30) + " " + shared, shared + " " + prose(40)]
    near = texts[8].split(" ")
    for k in range(5, len(near), 40):
        near[k] = "changed"
    texts += [" ".join(near), "", "", None, "   ", "one", "a" * 900, "a" * 450 + "b", "x \n\n y", "日本 語 " * 90, prose(9000)]
    langs = [("de", "en", None)[k % 3] for k in range(len(texts))]
    out = [(k, t, lang, f"s{k % 3}" if k % 7 else None, 1, 2, "h", None) for k, (t, lang) in enumerate(zip(texts, langs))]
    return out + [out[3], out[3], (None, texts[5], "en", "s1", 0, 0, "", ""), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _bag(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


def _bytes(text):
    return (text or "").encode()


def test_token_counts_match_the_encoder(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 256)  # documents cross blocks and tasks
    path = work_dir(spark, "t")
    token_files.write(docs, path)
    want = collections.Counter((r[0], len(byte_bpe.encode(r[1] or ""))) for r in rows)
    assert _bag(token_files.count(spark, path), "doc_id", "n_tokens") == want
    path = work_dir(spark, "t")
    token_files.write(none, path)
    assert token_files.count(spark, path).count() == 0


def test_documents_across_many_tasks():
    stream = np.concatenate([np.full(n, 7, "<u2").tolist() + [0] for n in (3, 500, 0, 1, 900)]).astype("<u2").tobytes()
    parts = [list(token_files._scan(k, [stream[a:a + 100]])) for k, a in enumerate(range(0, len(stream), 100))]
    assert sum(r[1] == 3 for p in parts for r in p) > 10  # tasks without a separator
    assert sum(r[2] for p in parts for r in p) == 3 + 500 + 1 + 900


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeated_strings(docs, rows, none, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    width, texts = suffix_dedup.LENGTH, [_bytes(r[1]) for r in rows]
    seen = collections.Counter(t[k:k + width] for t in texts for k in range(len(t) - width + 1))
    want = collections.Counter()
    for row, t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        want[(row[0], len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g))] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                              for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_passage_in_very_many_texts(spark, monkeypatch):
    """The stretches at a passage's edges are all different and have one anchor; no task holds them all."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, other = noise(520), noise(230)
    texts = [(k, noise(150 + k % 90) + passage + noise(150 + k % 70)) for k in range(6000)]
    texts += [(6000, noise(300) + other + noise(40)), (6001, noise(90) + other + noise(300)), (6002, noise(900))]
    monkeypatch.setattr(suffix_dedup, "GROUP", 400)
    compare = suffix_dedup._compare

    def bounded(frame):
        assert len(frame) <= 1600
        return compare(frame)

    monkeypatch.setattr(suffix_dedup, "_compare", bounded)
    width, seen = suffix_dedup.LENGTH, collections.Counter()
    for _, t in texts:
        seen.update({t[k:k + width] for k in range(len(t) - width + 1)})
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(docs).collect()}
    for k, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if seen[t[a:a + width]] > 1:
                gone[a:a + width] = b"\1" * width
        assert got[k] == "".join(x for x, g in zip(t, gone) if not g)
    assert all(len(got[k]) <= len(t) - 520 for k, t in texts[:6000]) and got[6002] == texts[-1][1]


def test_suffix_sort_agrees_with_plain_sorting():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    group, anchors = np.array([rng.randrange(3) for _ in strings]), np.array([rng.randrange(len(s)) for s in strings])
    order = suffix_dedup.Suffixes(group, strings, anchors).sort()
    keys = [(group[k], strings[k][anchors[k]:]) for k in range(len(strings))]
    assert [keys[k] for k in order] == sorted(keys)


def _least(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_benchmark_items_within_their_budget(spark, docs, rows, none, monkeypatch):
    base = " ".join(rows[8][1].split())[20:140]
    items = [(1, base), (2, base[:60] + "XX" + base[62:]), (3, base.upper()), (4, None), (5, "  "), (6, "abc"),
             (7, base[:50] + base[58:]), (8, base), (9, "never " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for row in rows:
        text = decontaminate.normalise(row[1] or "")[:3000] if len(row[1] or "") < 3000 else ""
        for number, item in items:
            item = decontaminate.normalise(item or "")
            edits = decontaminate.budget(len(item))
            if len(item) > 2 * edits + 1 and text and _least(item, text) <= edits:
                want[(row[0], number, _least(item, text))] += 1
    assert len(want) >= 5
    assert _bag(decontaminate.matches(docs, bench), "doc_id", "item_id", "distance") == want
    left = decontaminate.clean(docs, bench)
    hit = {k[0] for k in want}
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in hit)
    monkeypatch.setattr(decontaminate, "BLOCK_PIECES", 1)  # a block an item
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == sorted(str(r.doc_id) for r in left.collect())
    assert _bag(decontaminate.matches(docs, bench), "doc_id", "item_id", "distance") == want
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(none, bench).count() == 0


def test_fingerprints(docs, rows, none):
    got = fingerprints.compare_edited(docs).collect()
    assert len(got) == len(rows) and fingerprints.compare_edited(none).count() == 0
    plain = [r for r in rows if r[0] is not None and r[0] != 3]
    ordered = sorted(plain, key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for own, after in zip(ordered, ordered[1:]):
        a, b = own[1] or "", after[1] or ""
        if own[0] - after[0] == 1:
            edited = a[:len(a) - len(a) // 3] + b[:len(a) // 3]
            assert by_id[own[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by_id[own[0]].n_chars == len(a) and 0 <= by_id[own[0]].near_edited <= 1
    marks = collections.defaultdict(set)
    for r in got:
        marks[r.doc_id].add(r.fingerprint)
    assert marks[46] == marks[47] == marks[7]
    sets = lambda t: set(zip(*[t.split()[k:] for k in range(5)]))
    a, b = rows[8][1], " ".join(rows[8][1].split()[:60]) + " " + " ".join(rows[9][1].split()[:60])
    fa, fb = (fingerprints.fingerprints(*fingerprints.C.as_block([t.encode()])) for t in (a, b))
    true = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    assert abs(float(fingerprints.likeness(*fa, *fb)[0]) - true) < 0.15


def test_lines_by_site(spark, docs, rows, none):
    lines = [(k, "menu\nown %d\n\nmenu" % k if k % 2 else "own %d" % k, "a", "z") for k in range(20)]
    lines += [(k, "menu\nx", "b", "z") for k in range(4)] + [(90, None, "a", "z"), (91, "", None, "z")]
    frame = spark.createDataFrame(lines, "doc_id long, text string, source string, n_lines2 string")
    kept = {r.doc_id if r.source != "b" else -r.doc_id - 1: r for r in line_dedup.drop_boilerplate(frame, "source", "text").collect()}
    assert kept[1].text == "own 1\n" and kept[1].n_dropped == 2 and kept[2].text == "own 2" and kept[-1].text == "menu\nx"
    assert kept[90].text is None and kept[91].text == ""
    assert line_dedup.drop_boilerplate(none, "source", "text").count() == 0
    assert line_dedup.drop_boilerplate(docs, "source", "text").count() == len(rows)


def test_salted_lines_agree(docs, monkeypatch):
    a = _bag(line_dedup.drop_boilerplate(docs, "source", "text", 0.01, 2), "doc_id", "text", "n_dropped")
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert a == _bag(line_dedup.drop_boilerplate(docs, "source", "text", 0.01, 2), "doc_id", "text", "n_dropped")


def test_language_gradients_and_rules(docs, rows, none):
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in language.new_weights(3, rng).items()}
    codes, labels = rng.integers(0, 257, (4, 6)), np.array([0, 1, 2, 1])
    _, grads = language.gradients(weights, codes, labels)
    for name in ("xf", "ub", "vf", "ob", "bias"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        moved = []
        for step in (1e-2, -1e-2):
            other = {k: v.copy() for k, v in weights.items()}
            other[name][at] += step
            moved.append(language.gradients(other, codes, labels)[0])
        assert abs((moved[0] - moved[1]) / 2e-2 - grads[name][at]) < 2e-3
    model, names = language.fit(none)
    assert names == [] and {r.lang_pred for r in language.predict(docs, model, names).collect()} == {"und"}


def test_windows_come_from_the_whole_text():
    text = "".join(chr(65 + k % 26) for k in range(500)) + "é"
    raw = text.encode() + bytes(64)
    windows = np.frombuffer(language.drawn(text), "<i2").reshape(-1, language.WINDOW)
    assert len(windows) == language.WINDOWS_A_DOC and language.drawn(text) == language.drawn(text)
    assert all(w.astype(np.uint8).tobytes() in raw for w in windows) and windows.max() < 256
    short = np.frombuffer(language.drawn("ab"), "<i2").reshape(-1, language.WINDOW)
    assert (short[:, :2] == [97, 98]).all() and (short[:, 2:] == 256).all()


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights, names = language.fit(table, 600)
    told = language.predict(table, weights, names, "lang").where(language.C.fold("doc_id", 5) == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.97 and all(0 <= r.score <= 1 for r in told)


def test_archives_round_trip(spark, none):
    html = ["<p>" + "x" * n for n in (0, 10, 5000, 70000, 70000)] + [None, "", "é\r\n\r\nWARC/1.1\r\n", "<p>xxxxxxxxxx"]
    table = [(k, None if k == 2 else f"http://a/{k} b\n", h, "extra") for k, h in enumerate(html)] + [(8, "u", html[8], "z"), (None, "u", "zz", "z")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, payload string").repartition(3)
    path = work_dir(spark, "w")
    warc.write(pages, path)
    back = warc.read(spark, path)
    largest = {}
    for page, _, h, _ in table:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if page is None else page)
    want = collections.Counter()
    for page, _, h, _ in table:
        raw, top = _bytes(h), largest[h or ""]
        own = page == top or (page is None and top == -1)
        want[(page, len(raw), warc.payload_digest(raw), "response" if own else "revisit", None if own else top)] += 1
    assert _bag(warc.summary(back), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    held = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert held[4] == html[4].encode() and held[7] == html[7].encode()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


def test_records_on_the_way_are_packed_tightly(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "x y " * 999)], "page_id long, url string, html string")
    path = work_dir(spark, "w")
    warc.write(pages, path)
    files = warc.read(spark, path).inputFiles()
    assert files and all(".zstd." in name for name in files)


def test_language_model_counts(docs, rows, none):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", _bytes(t).translate(low)) + [None]
    fold = lambda k: 0 if k is None else zlib.crc32(str(k).encode()) % 10
    counts, pairs = collections.Counter(), collections.Counter()
    for r in rows:
        if fold(r[0]):
            counts.update(split(r[1]))
            pairs.update(zip([None, *split(r[1])], split(r[1])))
    total, kinds = sum(counts.values()), len(counts)
    got = language_model.score(docs, 3).collect()
    base = lambda w: (counts[w] + 0.1) / (total + 0.1 * (kinds + 1))
    want = collections.Counter((r[0], fold(r[0]) == 0, len(split(r[1])), sum(counts[w] > 0 for w in split(r[1])), total,
                                round(sum(math.log10(base(w)) for w in split(r[1])), 6)) for r in rows)
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert language_model.score(none, 3).count() == 0


def test_language_model_scores(spark, monkeypatch):
    """Scores against dictionaries and expectation maximisation on unrounded ratios, with a bucket for every
    50,000 bytes. Ratios rounded to quarter powers of two move a score by less than 0.002 a token."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    rows = docs.collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    fold = lambda k: 0 if k is None else zlib.crc32(str(k).encode()) % 10
    ends = [(fold(r[0]), [None, *re.findall(rb"[^\x20\x09-\x0D]+", _bytes(r[1]).translate(low)), None]) for r in rows]
    one, two, held_one, held_two = (collections.Counter() for _ in range(4))
    for f, t in ends:
        if f:
            one.update(t[1:])
            two.update(zip(t, t[1:]))
        if f not in (0, 1):
            held_one.update(t[1:])
            held_two.update(zip(t, t[1:]))
    floor = sum(one.values()) + 0.1 * (len(one) + 1)
    group = lambda n: n.bit_length()
    seen = collections.defaultdict(list)  # by class of context: estimate of the pair, of the word
    for f, t in ends:
        if f == 1:
            for v, w in zip(t, t[1:]):
                seen[group(held_one[v])].append((held_two[v, w] / max(1, held_one[v]), (held_one[w] + 0.1) / floor))
    weights, last = {}, 0.5
    for k in range(1, language_model.CLASSES):
        if k in seen:
            last = 0.5
            pair, word = np.array(seen[k]).T
            for _ in range(100):
                last = min(max(np.mean(last * pair / (last * pair + (1 - last) * word)), 1e-6), 1 - 1e-6)
        weights[k] = last
    want = collections.defaultdict(list)
    for (f, t), r in zip(ends, rows):
        total = 0.0
        for v, w in zip(t, t[1:]):
            weight = weights[group(one[v])] if one[v] else 0.0
            total += math.log10(weight * two[v, w] / max(1, one[v]) + (1 - weight) * (one[w] + 0.1) / floor)
        want[r[0]].append((total, len(t) - 1))
    assert language_model.bucket_count(docs) == 1
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 50_000)
    assert language_model.bucket_count(docs) > 10
    got = collections.defaultdict(list)
    for r in language_model.score(docs).collect():
        got[r.doc_id].append((r.score, r.n_tokens))
    assert got.keys() == want.keys()
    for k in want:
        for (a, n), (b, m) in zip(sorted(want[k]), sorted(got[k])):
            assert n == m and abs(a - b) <= 0.002 * n


def test_mixture_weights_follow_the_counts():
    cells = np.zeros((language_model.CLASSES, language_model.BINS), np.uint64)
    cells[3, 0], cells[5, 40] = 100, 100
    weights = language_model.learn_weights(cells, 1000, 10)
    assert weights[3] < 0.01 and weights[5] > 0.9 and weights[0] == 0


def test_tokens_as_the_library_gives_them(docs, rows, none):
    enc = byte_bpe.encoding()
    want = collections.Counter()
    for r in rows:
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4")
        want[(r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(_bytes(r[1])).hexdigest())] += 1
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert _bag(byte_bpe.digests(docs), *names) == want
    assert _bag(byte_bpe.digests(docs, chunk=50, overlap=8), *names) == want
    assert _bag(byte_bpe.digests(docs, chunk=50, overlap=8, spread=50), *names) == want
    assert byte_bpe.digests(none).count() == 0


def test_chunks_meet_at_shared_boundaries(spark):
    rng = random.Random(4)
    odd = ["'s", " ", "  ", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "é", "漢字", "👍🏽", "12", "!?", "word"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    texts += ["x" * 2000, "漢" * 700 + " " + "字" * 700, " " * 900, "a b " * 500, "a " * 31 + "b" * 400 + " c" * 300, None, ""]
    docs = spark.createDataFrame([(None if k % 9 == 0 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    enc = byte_bpe.encoding()
    want = collections.Counter((None if k % 9 == 0 else k // 2, t or "", np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
                               for k, t in enumerate(texts))
    for chunk, overlap, spread in ((64, 16, 64), (64, 1, 1000), (7, 3, 1)):
        got = byte_bpe.round_trip(docs, chunk=chunk, overlap=overlap, spread=spread).collect()
        assert collections.Counter((r.doc_id, r.text, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_most_chunks_are_stitched():
    text = " ".join(f"word{k}" for k in range(5000))
    parts = byte_bpe.chunks(text)
    ends = [byte_bpe.edges(t, k * byte_bpe.CHUNK_CHARS) for k, t in enumerate(parts)]
    assert len(parts) > 8 and all(set(a[1]) & set(b[0]) for a, b in zip(ends, ends[1:]))
    assert len(byte_bpe.pieces(text)) == len(parts) and "".join(byte_bpe.pieces(text)) == text


def test_alignment_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(4) for _ in range(rng.randrange(0, 3))]
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            new = [k]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for limit in (0, 2, 5):
            assert near_dedup.within(np.array(a, "u4"), np.array(b, "u4"), limit) == min(row[-1], limit + 1)


def test_near_duplicates(docs, rows, none):
    got = near_dedup.classes(docs).collect()
    named = collections.defaultdict(set)
    for r in got:
        named[r.doc_id].add(r.class_id)
    assert len(got) == len(rows) and near_dedup.classes(none).count() == 0
    assert named[46] == named[47] == named[7] == {7} and named[50] == named[8] == {8} and named[3] == {3}
    assert named[51] == named[52] == named[53] == {51} and named[9] == {9}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.class_id for r in got})


def test_near_duplicate_recall(spark):
    """All pairs of documents whose five-word shingles agree to 0.8 and more, found by brute force, share a class."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = {r.doc_id: r.class_id for r in near_dedup.classes(table).collect()}
    owners, sets = collections.defaultdict(set), {}
    for r in table.select("doc_id", "text").collect():
        words = re.findall(r"\w+", r.text.lower())
        sets[r.doc_id] = set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)}
        for s in sets[r.doc_id]:
            owners[s].add(r.doc_id)
    shared = collections.Counter((a, b) for o in owners.values() if len(o) > 1 for a in o for b in o if a < b)
    near = [(a, b) for (a, b), n in shared.items() if n / len(sets[a] | sets[b]) >= 0.8]
    assert near and np.mean([label[a] == label[b] for a, b in near]) >= 0.98


def test_near_duplicates_among_containing_pages(spark, monkeypatch):
    """Texts whose buckets are led by longer pages that hold them whole: every similar pair that shares a sketch
    shares a class, as brute force finds, also where buckets are cut into many blocks."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, copies = [], []
    for _ in range(6):
        text = prose(150)
        texts += [" ".join(text + prose(62)) for _ in range(40)]
        changed = text[:70] + ["changed"] + text[71:]
        copies += [" ".join(text), " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").coalesce(1)
    made = {k: (near_dedup.sketches(*near_dedup.C.as_block([t.encode()]))[0],
                np.frombuffer(near_dedup._word_rows(*near_dedup.C.as_block([t.encode()]))[0], "<u4"))
            for k, t in enumerate(texts + copies)}
    # Nodes are numbered in the order of the ids, so that pages come before the texts they hold.
    plain = near_dedup.F.monotonically_increasing_id
    monkeypatch.setattr(near_dedup.F, "monotonically_increasing_id", lambda: near_dedup.F.col("doc_id") + plain() * 0)
    pairs = [(a, b) for a in made for b in made if a < b and (made[a][0] == made[b][0]).any()]
    near = [(a, b) for a, b in pairs if near_dedup.similar(made[a][1], made[b][1])]
    assert len(near) >= 6 and len(pairs) > 5 * len(near)
    for block in (near_dedup.BLOCK, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        label = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
        assert all(label[a] == label[b] for a, b in near)
        assert len(set(label.values())) == len(made) - 6
    label = {r.doc_id: r.class_id for r in near_dedup.classes(docs, minors=8).collect()}  # buckets are split
    assert np.mean([label[a] == label[b] for a, b in near]) >= 0.9


def test_bounds_never_rule_out_similar_texts():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice((1, 2, 3, 8, 60, 2000))
        a = [rng.randrange(rng.choice((2, 50))) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, n // 5 + 2)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = [rng.randrange(60)] * rng.randrange(2)
        a, b = np.array(a, "u4"), np.array(b, "u4")
        fits = near_dedup.possible([a, b, a[:1], b], np.array([0, 2]), np.array([1, 3]))
        if near_dedup.similar(a, b):
            assert fits[0].all()
        count = lambda x, k: collections.Counter(zip(*[x[j:].tolist() for j in range(k)]))
        limit = int(0.2 * max(len(a), len(b)) + 1e-9)
        want = abs(len(a) - len(b)) <= limit and all(sum((count(a, k) & count(b, k)).values()) >= max(len(a), len(b)) - (k - 1) - k * limit for k in (1, 2))
        assert fits[0].tolist() == [want, want]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(7)
    names = rng.sample(range(10_000), 400)
    edges = list(zip(names[:150], names[1:150])) + [(names[150], n) for n in names[151:300]] + list(zip(names[300:], names[301:] + names[300:301]))
    edges += [(5, 5000001), (5, 5000001)]
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long").repartition(4)
    label = {r.node: r.label for r in near_dedup.components(frame).collect()}
    parts = [names[:150], names[150:300], names[300:], [5, 5000001]]
    assert len(label) == 402 and all(len({label[n] for n in p}) == 1 and label[p[0]] in p for p in parts)
    assert len(set(label.values())) == 4 and near_dedup.components(frame.limit(0)).count() == 0


def test_work_follows_the_texts_that_share_a_passage(spark, monkeypatch):
    """Texts that share a passage and are else unlike: what is compared grows with their number, not its square, and
    similar ones among them are found."""
    rng, met = random.Random(8), []
    prose = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    plain, passage = near_dedup.possible, prose(100)
    for n in (150, 600):
        texts = [prose(35) + passage + prose(35) for _ in range(n)]
        near = [[*t[:20], "changed", *t[21:]] for t in texts[:n // 10]]
        docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + near)], "doc_id long, text string").repartition(4)
        seen = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(near_dedup, "possible", lambda texts, left, right, *a, seen=seen: (seen.add(len(left) * len(right)), plain(texts, left, right, *a))[1])
        label = {r.doc_id: r.class_id for r in near_dedup.classes(docs, minors=16).collect()}
        met.append(seen.value)
        assert np.mean([label[n + k] == label[k] == k for k in range(len(near))]) >= 0.95
        assert sum(label[k] == k for k in range(n)) == n
    assert 0 < met[1] < 8 * met[0]


def test_alignment_distance_of_many_edits():
    """Bit vectors and diagonals agree with the plain table where edits are many."""
    rng = random.Random(2)
    for n in (1, 20, 70, 200):
        for _ in range(4):
            a = [rng.randrange(12) for _ in range(n)]
            b = [rng.randrange(12) if rng.random() < 0.4 else x for x in a if rng.random() < 0.9] + [3]
            row = list(range(len(b) + 1))
            for k, x in enumerate(a, 1):
                new = [k]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            x, y = np.array(a, "u4"), np.array(b, "u4")
            assert near_dedup.distance(x, y) == row[-1]
            assert [near_dedup.within(x, y, k) for k in (row[-1], max(0, row[-1] - 1), n + 1)] == [row[-1], row[-1], row[-1]]


def test_split_buckets_lose_no_pair(spark):
    """Texts that share a passage, and copies with an eighth of their words changed all over, which share few sketches:
    what buckets compared whole join, buckets met by rare words join as well, and nothing that is not similar."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    passage, texts = prose(100), []
    for _ in range(120):
        own = prose(25) + passage + prose(25)
        texts += [own, [w if k % 8 else f"c{rng.randrange(20000)}" for k, w in enumerate(own)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    whole, split = ({r.doc_id: r.class_id for r in near_dedup.classes(docs, minors=m).collect()} for m in (None, 4))
    met = [k for k in range(0, 240, 2) if whole[k] == whole[k + 1]]
    assert len(met) > 40 and all(split[k] == split[k + 1] for k in met)
    assert all(label in (k, k - k % 2) for found in (whole, split) for k, label in found.items())


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_frequency", "near_duplicates", "benchmark_free", "tokens"]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


CLASHING = ("score lang_pred n_lines n_dropped host bad kept salt row kept_id kept_digest own_digest own_id digest node label key packed "
            "__host __bad __kept __salt __id __digest __text __letters item_id distance text_ n").split()


def test_extra_columns_never_clash(spark, rows):
    """Columns with the operators' own names come back unchanged from every stage, and change no operator's result."""
    import corpus_pipeline as P

    plain = [r[:5] for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(plain, schema).repartition(3).cache()
    wide = spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASHING)) for k, r in enumerate(plain)],
                                 schema + "".join(f", `{c}` string" for c in CLASHING)).repartition(3).cache()
    given = collections.Counter(r[5:] for r in wide.collect())
    for name, stage in P.STAGES:
        out, bare = stage(spark, wide, "/root/testdata/sf0.001"), stage(spark, docs, "/root/testdata/sf0.001")
        if name == "tokens":
            assert _bag(out, *out.columns) == _bag(bare, *bare.columns)
            continue
        assert out.columns == wide.columns
        got = out.collect()
        assert not collections.Counter(r[5:] for r in got) - given
        assert collections.Counter(r[:5] for r in got) == _bag(bare, *docs.columns)
    for operator in (suffix_dedup.remove_repeats, fingerprints.compare_edited, near_dedup.classes):
        assert _bag(operator(wide), *operator(docs).columns) == _bag(operator(docs), *operator(docs).columns)
    assert line_dedup.drop_boilerplate(wide, "source", "text").columns[-2:] == ["n_lines", "n_dropped"]
    assert _bag(language_model.score(wide, 3), "doc_id", "n_tokens", "n_known", "base_score") == _bag(
        language_model.score(docs, 3), "doc_id", "n_tokens", "n_known", "base_score")


def test_rare_languages_are_learned(spark):
    """A language with one document in some hundred has its share of the sample."""
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang)
            for k in range(3000) for lang in ["cc" if k % 300 == 1 else "aabb"[k % 2 * 2:k % 2 * 2 + 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    weights, names = language.fit(docs, 60)
    told = language.predict(docs, weights, names, "lang").collect()
    assert names == ["aa", "bb", "cc"] and np.mean([r.lang_pred == r.lang for r in told]) > 0.99
    assert all(r.lang_pred == "cc" for r in told if r.lang == "cc")
    kept = language.keep_known(docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "'123 !' AS text", "lang")), 60)
    assert 2990 <= kept.count() <= 3000


def test_short_documents_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = table.selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 6), ' ') AS text", "lang").where("text rlike '[a-z]{4}'")
    both = table.select("doc_id", "text", "lang").unionByName(short)
    assert language.keep_known(both, 800).count() >= 0.98 * both.count()


def test_unlikely_documents_stay(spark):
    """Text in two languages at once, less likely than any document of the sample, is kept, and a null language filled in."""
    rng = random.Random(9)
    prose = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(k, prose(("abcdefg", "hijklmn")[k % 2]), ("aa", "bb")[k % 2]) for k in range(400)]
    rows += [(400 + k, prose("abcdefghijklmn"), "aa") for k in range(3)] + [(403, prose("hijklmn"), None), (404, "12 !", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    # The mixed ones are not in the sample, so that it does not follow them.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "_sample", (lambda plain: lambda frame, n: plain(frame.where("doc_id < 400"), n))(language._sample))
        kept = {r.doc_id: r.lang for r in language.keep_known(docs, 60).collect()}
    assert kept[403] == "bb" and set(kept) == set(range(404))
    assert all(kept[r[0]] == r[2] for r in rows if r[0] in kept and r[2])
