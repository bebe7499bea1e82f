"""Spelling variants, hard negatives and fingerprints against brute force and SQL; with odd inputs and none."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import fingerprints, negatives, spelling
from spanloom.llm.queries import QUERIES


def counted(rows, slip=0, shortest=6, fewest=5):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            if slip:
                h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
                if h % slip == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}


def near_pairs(words):
    """All pairs at distance one, by the words with one sign left out."""
    whole, less = set(words), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in whole:
                near[w].add(v)
                near[v].add(w)
    return near


def variants_of(words, times=5):
    near, form = near_pairs(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def test_variants_of_all_documents(spark, db, data):
    want = variants_of(counted(db.execute("SELECT doc_id, text FROM documents").fetchall(), slip=199))
    got = QUERIES["op11_spelling_variants"](spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == want and any(x[1] for x in want)


@pytest.mark.parametrize("group_rows", [3, 1 << 16])
def test_variants_of_dense_words_with_shared_halves(spark, group_rows):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.randint(1, 400) for _ in range(1500)}
    words |= {"aaaaaa" + "".join(rng.choice("abc") for _ in range(6)): rng.randint(1, 400) for _ in range(300)}  # one half
    words |= {"x" * 300: 7, "x" * 299: 90, "x" * 301: 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df, shard_rows=200, group_rows=group_rows)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == variants_of(words)


def test_variants_of_chains_and_ties(spark):
    words = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aaaaac": 5, "zzzzzz": 3}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaa"].form == "aaaaab" and got["aaaaaa"].root == "aaabbb" and got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].n_near == 0


def test_word_counts_of_odd_documents(spark, odd):
    got = {r.word: r.n for r in spelling.word_counts(odd, slip=2, shortest=1, fewest=1, keep=2).collect()}
    assert got == counted([(r.doc_id, r.text) for r in odd.collect()], slip=2, shortest=1, fewest=1)
    clash = odd.withColumnRenamed("text", "key").withColumnRenamed("doc_id", "word")
    assert {r.word for r in spelling.word_counts(clash, "word", "key", 1, 1).collect()} == set(counted([(0, r.text) for r in odd.collect()], shortest=1, fewest=1))
    assert spelling.variants(spelling.word_counts(odd.limit(0))).count() == 0


def test_runs_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "Ab cdefghijklmnop q ÀÉ " * 20 + "z" * 50
    total = Counter()
    for c in spelling.runs(text):
        total += c
    assert total == Counter(re.findall("[a-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def mined(rows, anchors, positives=5, negatives_=10):
    part = [(k, l, [int(np.floor(256 * float(x))) for x in v]) for k, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, label, v in part:
        if not anchors(k):
            continue
        best = sorted(((dot(v, w), o) for o, m, w in part if m == label and o != k), key=order)[:positives]
        rest = sorted(((dot(v, w), o) for o, m, w in part if m != label), key=order)
        for s, p in best:
            out += [(k, p, i + 1, o, s, t) for i, (t, o) in enumerate([x for x in rest if 30 * s <= 100 * x[0] <= 90 * s][:negatives_])]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 37, "block_rows": 5, "together": 2, "pivots": 4}])
def test_hard_negatives_of_odd_rows(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=8) / 2 + (i % 4 == 0)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, 1, [0.5] * 8) for i in range(300, 420)]  # ties, a hot label
    rows += [(500, None, [1.0] * 8), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")]), (504, 0, [float("inf")] * 8), (505, 2, []), (506, 2, [1.0, 2.0, 3.0]), (None, 2, [0.25] * 8), (510, 0, [-9.0] * 8), (510, 0, [-9.0] * 8), (7, 1, [0.4] * 8)]
    df = vectors(spark, rows).withColumn("key", negatives.F.lit("x")).repartition(4)
    got = negatives.hard_negatives(df, negatives.F.col("key") % 10 == 0, **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda k: k is not None and k % 10 == 0)
    assert negatives.hard_negatives(df.limit(0), negatives.F.col("key") % 10 == 0).count() == 0


def test_large_components_are_multiplied_exactly(spark):
    rows = [(0, 0, [2.0**21, 1.0]), (1, 0, [2.0**21, 3.0]), (2, 1, [2.0**20, 1.0]), (3, 1, [1.0, 1.0])]
    got = negatives.hard_negatives(vectors(spark, rows), negatives.F.col("key") == 0)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda k: k == 0)


def test_pairs_of_trees_are_pruned():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(40, 16)) * 3, 100, axis=0) + rng.normal(size=(4000, 16)) / 20))
    label, key = np.zeros(4000, np.int64), np.arange(4000)
    tree = negatives.Tree.of(rows, label, key, key < 0)
    some = slice(0, 800, 10)
    asked = negatives.Tree.of(rows[some], label[some], key[some], key[some] < 0, negatives.ANCHOR_LEAF)
    w = negatives.Windows(np.arange(80), np.full(80, -negatives.MOST), np.full(80, negatives.MOST), 5)
    assert negatives.search(asked, tree, w, True) < 0.25 * 80 * 4000
    exact = asked.rows @ tree.rows.T
    for a in range(80):
        want = sorted((-int(s), int(k)) for s, k in zip(exact[a], tree.key, strict=True) if k != asked.key[a])[:5]
        assert sorted(zip((-w.score[w.of == a]).tolist(), w.key[w.of == a].tolist(), strict=True)) == want


def test_paragraphs_make_up_the_text_and_depend_on_what_is_near():
    rng = random.Random(2)
    text = "".join(rng.choice("abé日 \n") if rng.random() < 0.3 else rng.choice("etaoin ") for _ in range(30_000))
    (whole, size), (other, _), none = fingerprints.paragraphs([text, text[:9000] + "X" + text[9000:], ""])
    assert size.sum() == len(text) and len(none[0]) == 0 and len(whole) > 100
    assert len(set(whole.tolist()) ^ set(other.tolist())) <= 8
    assert [x[0].tolist() for x in fingerprints.paragraphs(["zz", text])][1] == whole.tolist()  # whatever stands before it
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(raw)])
    assert fingerprints.ends(raw, at).tolist() == fingerprints.ends(raw, at, block=777).tolist()


@pytest.mark.parametrize("seed", range(20))
def test_peeling_recovers_what_differs(seed):
    rng = np.random.default_rng(seed)
    pair = []
    for _ in range(2):
        pair.append([(rng.integers(1 << 60, size=n).astype(np.uint64), rng.integers(1, 99, n)) for n in rng.integers(0, 300, 30)])
    one = [(np.append(a[0], b[0]), np.append(a[1], b[1])) for a, b in zip(pair[0], pair[1], strict=True)]
    for (d, size, side, _), a, b in zip(fingerprints.differing(one, pair[0]), pair[1], pair[0], strict=True):
        assert sorted(zip(d.tolist(), size.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in a), strict=True)) and (side == 1).all() and len(b)
    for (d, _, side, _), a, b in zip(fingerprints.differing(*pair), *pair, strict=True):
        assert set(zip(d.tolist(), side.tolist(), strict=True)) == {(x, 1) for x in a[0].tolist()} | {(x, -1) for x in b[0].tolist()}


def changed_of(a, b):
    """By multisets of paragraphs, without a sketch."""
    one, other = fingerprints.paragraphs([a, b])
    left = {k: (1, s) for k, s in zip(*(x.tolist() for x in one), strict=True)}
    for k, s in zip(*(x.tolist() for x in other), strict=True):
        if left.pop(k, None) is None:
            left[k] = (-1, s)
    return {(f"{k:016x}", side, s) for k, (side, s) in left.items()}


def test_fingerprints_of_all_documents(spark, db, data):
    rows = db.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    got = {r.doc_id: r for r in QUERIES["op13_document_fingerprints"](spark, data).collect()}
    prints = {}
    for i, (key, text) in enumerate(rows):
        onward = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited, r = text[: len(text) - cut] + onward[:cut], got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, onward)):
            changed = sum(s for _, _, s in changed_of(text, other))
            assert near == pytest.approx(1 - changed / (len(text) + len(other)) if text or other else 1.0)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(got) == len(rows) and len(set(prints.values())) == len(prints)


def test_changes_of_odd_documents(spark, odd):
    rows = fingerprints.with_next(odd, range_bytes=1 << 14)
    assert rows.count() == odd.count() and fingerprints.with_next(odd.limit(0)).count() == 0
    order = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in odd.collect())
    got = fingerprints.compared(rows.withColumn("near_next", fingerprints.F.lit("x")), "text", {"next": "next"}, changes=True).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in got) == order
    by = {}
    for r in got:
        assert {(c.digest, c.side, c.n_chars) for c in r.changed_next} == changed_of(r.text or "", r.next or "")
        assert by.setdefault(r.text or "", r.fingerprint) == r.fingerprint
        near = fingerprints.likeness(r.fingerprint, r.fingerprint_next, len(r.text or ""), len(r.next or ""))
        assert near is None or near == pytest.approx(r.near_next)
    ids = [(r.doc_id is None, r.doc_id or 0) for r in got]
    texts = {}
    for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        texts.setdefault(k, set()).add((t, n))
    for k, r in zip(ids, got, strict=True):
        if len(texts[k]) == 1 and k != (False, 4):
            assert (r.text or "", r.next or "") in texts[k]


def test_a_fingerprint_reads_back():
    s = fingerprints.Sketches.of(fingerprints.paragraphs(["some words\nand more\n" * 9]), 24)
    assert len(base64.b64decode(s.text(0))) == 24 * fingerprints.CELL.itemsize
    again = fingerprints.Sketches.read(s.text(0))
    assert (again.count == s.count).all() and (again.sum == s.sum).all() and (again.check == s.check).all() and (again.size == s.size).all()
