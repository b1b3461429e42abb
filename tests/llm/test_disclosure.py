"""Personal data and disclosing terms against a plain reading of the rules."""

import collections
import hashlib
import math
import random
import re

import pytest

from barline.llm import disclosure as D

SCHEMA = "doc_id long, text string, digest string, base string, terms string, row string, entity string, all string, removed string, n long"
EXTRA = ("d", "b", "t", "r", "e", "a", "m", 1)
LETTERS = re.compile(r"[^\W\d_]{4,}")


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def _entities(text):
    out = []
    for kind, name in enumerate(D.KINDS[:-1]):
        found = list(re.finditer(D.PATTERNS[name], text))
        edges = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)]
        for k, m in enumerate(found):
            digits = re.sub("[^0-9]", "", m.group())
            if (name == "ip" and any(int(p) > 255 for p in m.group().split(".")) or name == "phone" and not 9 <= len(digits) <= 15
                    or name == "card" and not (12 <= len(digits) <= 19 and _luhn(digits))):
                continue
            entity = {"email": m.group().lower(), "ip": m.group()}.get(name, digits)
            before = LETTERS.findall(text[edges[0][k]:edges[1][k]].lower())[-D.CONTEXT:]
            after = LETTERS.findall(text[edges[0][k + 1]:edges[1][k + 1]].lower())[:D.CONTEXT]
            out.append((m.start(), kind, m.end(), f"{name}:{entity}", before + after))
    return sorted(out)


def _report(texts):
    """Base spans and added spans (start, end, general) of every text."""
    base = [_entities(t) for t in texts]
    n, n_c, n_t, n_ct = len(texts), collections.Counter(), collections.Counter(), collections.Counter()
    stems = lambda words: set(words) | {w[:D.STEM] + "*" for w in words}
    for text, spans in zip(texts, base):
        n_c.update({s[3] for s in spans})
        n_t.update(stems(LETTERS.findall(text.lower())))
        n_ct.update({(s[3], w) for s in spans for w in stems(s[4])})
    share = {(c, t): math.log(n * k / (n_c[c] * n_t[t])) / math.log(n / n_c[c]) for (c, t), k in n_ct.items() if k >= D.SUPPORT and n_c[c] < n}
    added = []
    for text, spans in zip(texts, base):
        held = {s[3] for s in spans}
        mine = []
        for m in LETTERS.finditer(text):
            word = m.group().lower()
            bad = [c for c in held if share.get((c, word), 0) > D.DISCLOSED]
            if bad and not any(s[0] < m.end() and m.start() < s[2] for s in spans):
                mine.append((m.start(), m.end(), all(share[c, word[:D.STEM] + "*"] <= D.DISCLOSED for c in bad)))
        added.append(mine)
    return base, added


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeéioñrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randrange(3, 80)) for _ in range(120)]
    card, bad = "4111 1111-1111 1111", "4111111111111112"
    for k in range(0, 60, 6):  # one entity with its own words around it, in many texts
        texts[k] += f" Zebulon quartzite {('Ann.Lee@mail.example.com', '10.1.2.3')[k % 4 // 2]} Wymarsk zebra " + prose(5)
        texts[k + 1] += f" call +1 (482) 555-7163 card {card} or {bad}, Zebulon " + prose(3)
    texts += ["", None, "   ", "a@b.c_d@e.f g@h", "x" * 3000, "9" * 3000, ("1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.255 " * 80), "a@b" + ".c" * 4000,
              "+1-2.3(4) 5678901 and +12345678901234567 +1 2", "日本語 ü@x.de 😀 me@x.de 😀", "1-2 3 4-5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
              "%" * 2000 + "@", "0" * 13, "5 5-5", " ".join(f"u{k}@mail.com {k}" for k in range(200))]
    out = [(k, t, *EXTRA) for k, t in enumerate(texts)]
    return out + [out[0], out[0], (None, texts[6], *EXTRA), (3, texts[7], *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _joined(spans):
    return ",".join(f"{D.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def test_report_matches_brute_force(docs, rows):
    base, added = _report([r[1] or "" for r in rows])
    assert sum(map(len, added)) > 30 and {g for a in added for *_, g in a} == {True, False}
    want = collections.Counter()
    for row, mine, more in zip(rows, base, added):
        plain = [(s[0], s[1], s[2]) for s in mine]
        counts = [sum(s[1] == k for s in mine) for k in range(4)]
        want[(row[0], *counts, hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(plain + [(a, 4, b) for a, b, _ in more]),
              sum(g for *_, g in more), sum(not g for *_, g in more))] += 1
    assert collections.Counter(tuple(r) for r in D.report(docs).collect()) == want


def test_sanitised_text(docs, rows):
    base, added = _report([r[1] or "" for r in rows])
    want = collections.Counter()
    for row, mine, more in zip(rows, base, added):
        text = row[1] or ""
        spans = [(s[0], s[2], f"[{D.KINDS[s[1]].upper()}]") for s in mine]
        spans += [(a, b, text[a:a + D.STEM] + "*" if g else "[...]") for a, b, g in more]
        out, done = "", 0
        for a, b, by in sorted(spans):
            out += "" if a < done else text[done:a] + by
            done = max(done, b)
        want[(row[0], None if row[1] is None else out + text[done:], *row[2:])] += 1
    got = D.sanitise(docs)
    assert got.columns == docs.columns
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_no_rows_and_no_python(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert D.report(none).count() == 0 and D.sanitise(none).count() == 0
    plan = D.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quick_patterns_match_the_fixed_ones(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("1a9.@-+_ %(\n") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice("19. -+()") for _ in range(60)) for _ in range(1500)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    got = frame.select("text", *(D._matches(frame["text"], D._QUICK[k]).alias(k) for k in D.KINDS[:-1])).collect()
    for row in got:
        for kind in D.KINDS[:-1]:
            assert [(m.start, m.end, m.match) for m in row[kind]] == [
                (m.start(), m.end(), m.group()) for m in re.finditer(D.PATTERNS[kind], row.text)], (kind, row.text)
