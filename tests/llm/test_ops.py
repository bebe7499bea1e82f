"""The ten operators against SQL, brute force, round trips and the libraries; with odd inputs and none."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import chat, html_text, mixing, near_dedup, packing, quality, search, sharding, substrings, token_counts
from spanloom.llm.queries import ORACLE_SQL, QUERIES
from spanloom.llm.words import Words

P = pytest.importorskip("public_tokenizers")


def normal(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(normal(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(map(normal, x)) for x in df.select(*cols).collect()) == want


def texts(db):
    return db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_words_are_split_as_bytes_are():
    rng = random.Random(1)
    for _ in range(200):
        t = ["".join(rng.choice("ab \t\n\x0b\x0c\réß ") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 6))]
        body = np.frombuffer(b"".join(t), np.uint8)
        w = Words(body, np.concatenate([[0], np.cumsum([len(x) for x in t])]))
        got = [body[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
        assert got == [x for y in t for x in y.split()] and w.counts.tolist() == [len(x.split()) for x in t]
        h = w.hashes()
        assert all((h[i] == h[j]) == (got[i] == got[j]) for i in range(len(got)) for j in range(i))


def thue_morse(n):
    """n signs of two kinds, and the same with the kinds exchanged: equal under every polynomial modulo a power of two."""
    signs = [0]
    while len(signs) < n:
        signs += [1 - x for x in signs]
    return ["".join(x[i] for i in signs) for x in ("ab", "ba")]


def test_regular_sequences_have_hashes_of_their_own():
    one, two = thue_morse(4096)
    body = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    assert len(set(Words(body, np.array([0, len(body)])).hashes().tolist())) == 2
    t = quality.Texts(np.frombuffer(f"{one}\n{two}\n{one}".encode(), np.uint8), np.array([0, 3 * 4096 + 2]))
    assert t.n_dup_lines().tolist() == [1]
    rest = [f"w{i}" for i in range(49)]
    lost = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest]))]
    body = np.frombuffer("".join(x for _, x in lost).encode(), np.uint8)
    runs = substrings.runs(body, np.array([0, len(lost[0][1]), len(body)]), 50, 8)
    assert len(set(runs[4].tolist())) == len(runs[4])


# op1


def test_search_odd(spark, odd):
    from spanloom.llm.base import cut

    rows = search.search(cut(search.build_index(odd, shard_rows=3)), search.query_terms(odd.where("doc_id in (0, 5, 7)")), k=3).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.doc_id)
    assert by[5] == [5, 6] and by[7][0] == 7 and set(by[7]) == {7, 8, 11} and 0 not in by


def test_search_nothing(spark, odd):
    from spanloom.llm.base import cut

    none = odd.where("false")
    assert search.search(cut(search.build_index(none)), search.query_terms(none)).count() == 0


def test_pruning_reads_fewer_postings_and_loses_nothing(spark):
    """Queries of rare and frequent terms: the same results as from scoring all, from fewer postings than the terms have."""
    import pyarrow as pa

    rng = random.Random(11)
    weight = [1 / (i + 1) for i in range(3000)]
    docs = [" ".join(rng.choices([f"t{i}" for i in range(3000)], weight, k=rng.randint(5, 60))) for _ in range(4000)]
    index = search.build_index(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1), shard_rows=4000).toPandas().iloc[0]
    arrays = {c.split()[0]: np.asarray(index[c.split()[0]]) for c in search.INDEX.split(", ")[2:]}
    n, mean = len(docs), float(np.mean(arrays["lengths"]))
    df = np.diff(arrays["posting_at"][arrays["block_at"]])
    weights = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shard = search.Shard(pa.array(index["docs"]), arrays, mean, arrays["terms"], weights)
    held = 0
    for _ in range(60):
        text = " ".join([f"t{rng.randint(0, 9)}", f"t{rng.randint(300, 2999)}", f"t{rng.randint(300, 2999)}"]).encode()
        terms = np.unique(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), search.BETWEEN).hashes().view(np.int64))
        place = [int(p) for p in np.searchsorted(arrays["terms"], terms) if p < len(df) and arrays["terms"][p] in terms]
        score = np.zeros(n)
        for p in place:
            at = slice(*arrays["posting_at"][arrays["block_at"][[p, p + 1]]])
            score[arrays["posting_doc"][at]] += shard.points[at]
            held += int(df[p])
        want = [d for d in np.lexsort((np.arange(n), -score))[:10] if score[d] > 0]
        got, points = shard.top(terms, 10, np.arange(n))
        assert got.tolist() == want and points.tolist() == score[want].tolist()
    assert shard.read < 0.7 * held


# op2

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a> Welcome, all.</header><nav><ul><li><a>x</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do.</div><div id=main><h1>A &eacute; b</h1><p>Long text one, with commas; and so on,
and on.</p><ul><li>first item<li>second <b>it</b>em</ul><p>Short.</p><blockquote>quoted text, ok.</blockquote><div class="related"><a>Other</a></div>
<p>Another long<br>text &amp; punctuation, too.</p></div><aside><p>Side text that is quite long, and with commas, too.</p></aside>
<section id=comments><p>I like this article, very much, indeed.</p></section><form><p>Sign up now, please</p></form><footer>c</footer><script>"</p>"</script></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A é b Long text one, with commas; and so on, and on. first item second item Short. quoted text, ok. Another long text & punctuation, too."
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "plain", "<p>a<p>b</i></p>", "<div class=ad>only this</div>")] == ["", "", "", "plain", "a b", "only this"]
    assert html_text.main_text("<" * 20_000) and html_text.main_text("<div>" * 20_000 + "deep") == "deep"


PAGES = {
    """<html><body><div class=top><a href=/>Home</a> <a href=/b>All recipes</a></div><div class=post><h1>Ginger cookies</h1><p>These cookies are crisp outside, soft inside, and ready in half an hour.</p>
<div class="cookie-recipe share alert"><p>Mix the flour, the sugar and the ginger, then work in the butter.</p><p>Bake for twelve minutes, until the edges are brown.</p></div><h2>Notes</h2>
<ul><li>Dark sugar works, too.</li><li>Keep them dry.</li></ul><p>They keep for two weeks, if nobody finds them, that is.</p></div><div class=more><a href=/c>Cake</a><a href=/d>Bread</a></div><div class=legal>Copyright, all of us.</div></body></html>""": "Ginger cookies These cookies are crisp outside, soft inside, and ready in half an hour. Mix the flour, the sugar and the ginger, then work in the butter. Bake for twelve minutes, until the edges are brown. Notes Dark sugar works, too. Keep them dry. They keep for two weeks, if nobody finds them, that is.",
    """<body><div id=w><div class=m><a>One</a> <a>Two</a></div><div class=t>The harbour was quiet, as on every Sunday; only the ferry moved.<br><br>Nobody waited for it, and nobody came.</div>
<div class=t>In the evening the fog rose, slowly, over the roofs and the masts.</div><div class=x>Buy boats.</div><div class=t>Then the light went on, and the night began, as nights do.</div></div></body>""": "The harbour was quiet, as on every Sunday; only the ferry moved. Nobody waited for it, and nobody came. In the evening the fog rose, slowly, over the roofs and the masts. Then the light went on, and the night began, as nights do.",
    """<main><table><tr><td><h1>Related work</h1><p>Earlier work, on the same data, found no effect at all.</p><p>Later work, on more data, did find one, though a small one.</p></td><td role=navigation>Contents, figures, tables, and notes, for all.</td></tr></table></main>
<div role="complementary"><p>Other readers also read this, and that, and then some more of it.</p></div><p hidden>Not shown, at all, to anybody.</p>""": "Related work Earlier work, on the same data, found no effect at all. Later work, on more data, did find one, though a small one.",
    """<div class=page><h1>Title &amp; more</h1><div class=body><p>A text with one paragraph, which is long enough to stand for itself, and then some.</p></div><section id=answers><p>Nice text, thanks.</p><p>Agreed, yes.</p></section></div>""": "Title & more A text with one paragraph, which is long enough to stand for itself, and then some.",
}


def test_pages_without_help():
    """Pages without an article element, with class names that mean nothing here, and with text in bare divs."""
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text


def _said(name, n):
    return [f"Sentence {name}{i} of the text goes on for quite a while, as sentences of this kind will often do, ok." for i in range(n)]


def _paragraphs(name, n):
    return "".join(f"<p>{x}</p>" for x in _said(name, n))


def test_articles_in_sections_come_out_whole():
    a, b, c = _said("a", 1), _said("b", 8), _said("c", 2)
    parts = [_paragraphs("a", 1), _paragraphs("b", 8), _paragraphs("c", 2)]
    sections = "".join(f"<section class=s{i}>{x}</section>" for i, x in enumerate(parts))
    boxes = "".join(f"<div id=s{i}>{x}</div>" for i, x in enumerate(parts))
    assert html_text.main_text(f"<main>{sections}</main>") == html_text.main_text(f"<body>{boxes}</body>") == " ".join(a + b + c)
    assert html_text.main_text(f"<div id=w><h1>Title</h1>{sections}</div>") == " ".join(["Title"] + a + b + c)
    assert html_text.main_text(f"<article><h1>Title</h1><article>{parts[1]}</article></article>") == " ".join(["Title"] + b)
    steps = "".join(f"<div class=step><div>Step {i}</div><p>{x}</p></div>" for i, x in enumerate(c))
    assert html_text.main_text(f"<div><h1>Title</h1>{parts[1]}{steps}</div>") == " ".join(["Title", *b, "Step 0", c[0], "Step 1", c[1]])


@pytest.mark.parametrize("n", [3, 10, 30])
@pytest.mark.parametrize("title", ["<h1>Title</h1>", ""])
def test_comments_stay_out_at_any_length(n, title):
    article, want = title + _paragraphs("a", 10), " ".join(["Title"] * bool(title) + _said("a", 10))
    texts = _said("q", n)
    signed = [f"<b>Reader {chr(65 + i % 26)}{'x' * (i // 26)}</b><p>{x}</p>" for i, x in enumerate(texts)]
    rows = {kind: "".join(f"<{tag} class=c>{x}</{tag}>" for x in inner) for kind, tag, inner in [("signed", "div", signed), ("bare", "div", [f"<p>{x}</p>" for x in texts]), ("items", "li", signed), ("articles", "article", signed)]}
    assert html_text.main_text(f"<div class=post>{article}</div><div class=c>{rows['signed']}</div>") == want
    assert html_text.main_text(f"<div class=post>{article}</div><div class=c>{rows['bare']}</div>") == want
    assert html_text.main_text(f"<div class=post>{article}<ol class=c>{rows['items']}</ol></div>") == want
    assert html_text.main_text(f"<article>{article}<section id=c>{rows['signed']}</section></article>") == want
    assert html_text.main_text(f"<article>{article}{rows['articles']}</article>") == want
    assert html_text.main_text(f"<div>{rows['signed']}</div>").count("Sentence") == n  # nothing else on the page


def test_boxes_beside_a_titled_article_and_forms_around_it():
    article, want = "<h1>Title</h1>" + _paragraphs("a", 10), " ".join(["Title", *_said("a", 10)])
    for n in (3, 10, 30):
        assert html_text.main_text(f"<div class=k>{_paragraphs('k', n)}</div><div class=post>{article}</div><div class=s>{_paragraphs('s', n)}</div>") == want
    assert html_text.main_text(f"<form><div class=post>{article}</div><input type=hidden></form>") == want
    assert html_text.main_text(f"<form>{_paragraphs('a', 10)}</form>") == want[6:]
    assert html_text.main_text(f"<div class=post>{article}</div><form>{_paragraphs('f', 4)}</form>") == want


def test_pages_of_any_shape_in_little_time_and_memory():
    import time
    import tracemalloc

    for page in ("<a " * 350_000, "<div>" * 200_000, "<div>x" * 170_000, "<!" * 500_000, '<a "' * 250_000, "<p><div>" + "<b>" * 100_000 + "<h1>" * 100_000, "<b>x</i>" * 120_000):
        tracemalloc.start()
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()


def test_ratios_decide(db, monkeypatch):
    """With every path taken for content, the advert that stands before each article comes along."""
    pages = [h for (h,) in db.execute("SELECT html FROM pages WHERE html IS NOT NULL LIMIT 200").fetchall()]
    with_ratios = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "content_paths", lambda paths, found, **_: {b.path for b in found})
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, with_ratios, strict=True)) > 0.9 * len(pages)


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<p>a&nbsp;b</p>" * 2)]
    df = spark.createDataFrame([(*r, "mine", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = html_text.main_text(PAGE)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "a b a b", 7), (1, "", 0), (2, "", 0), (3, want, len(want)), (3, want, len(want))]
    assert html_text.extract(df.where("false")).count() == 0


def test_pages_against_their_articles(spark, db, data):
    """The supplied pages hold one article element each; a regular expression finds its blocks."""
    import re
    from html import unescape

    def truth(h):
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        return " ".join(b for b in blocks if b)

    want = {i: truth(h) if h else "" for i, h in db.execute("SELECT page_id, html FROM pages").fetchall()}
    assert {r.page_id: r.text for r in QUERIES["op2_html_extract"](spark, data).collect()} == want


# op3


def test_passages_against_brute_force(spark, db, data):
    got = sorted(tuple(r) for r in QUERIES["op3_substring_dedup"](spark, data).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(substrings.brute_force(texts(db)))


def test_passages_of_small_alphabets(spark):
    """Short windows over few words, so that windows repeat within texts, between them and at their edges."""
    rng = random.Random(2)
    rows = [(i // 2 if i < 6 else i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=6, k=3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect())
    assert got == sorted(substrings.brute_force(rows, 6))


def test_passages_odd(spark, odd):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.dedup(odd, carry=["source"]).collect()}
    assert got[0, 0] == got[1, 0] == 0 and got[3, 30_000] == 0 and got[4, 30_000] == 30_000 and got[7, 63] == 0 and got[8, 62] == 60 and got[11, 60] == 60
    assert substrings.dedup(odd.where("false")).count() == 0


# op4


def check_packed(rows, docs, size=1024):
    seq, own, pad = defaultdict(list), defaultdict(list), 0
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
        pad += size - at if at & (at - 1) else 0
    return own, pad


def test_packing(spark, db, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, pad = check_packed(QUERIES["op4_packing"](spark, data).collect(), texts(db))
    assert pad == 0
    for d, text in texts(db):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_odd(spark, odd):
    rows = packing.pack(odd, P.path("byte_bpe_50k.json"), size=64).collect()
    own, pad = check_packed(rows, None, 64)
    assert pad == 0 and sum(r.length for r in own[0]) == 1 and own[0][0].ids == [0] and len(own) == 13
    assert packing.pack(odd.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_level_rule():
    """The level chosen is one of least sum of squares, by trying all."""
    rng = random.Random(4)
    p = packing.LevelPacker(32)
    for i in range(500):
        n = rng.randint(1, 31)
        c = p.count.copy()

        def after(h, n=n, c=c):
            x = c.copy()
            x[h] -= h > 0
            x[h + n] += h + n < 32
            return (x[:32] ** 2).sum()

        options = [h for h in range(32 - n + 1) if h == 0 or c[h]]
        assert after(p.level(n)) == min(map(after, options))
        list(p.place((i, 0, n, b"\0\0\0\0" * n)))
    left = sum(sum(len(x[3]) for x in w) // 4 for level in p.windows for w in level)
    assert sum(len(x[3]) // 4 for w in p.close() for x in w) == left


def test_packer_is_bounded():
    p = packing.LevelPacker(1024, max_open=16)
    out = [w for i in range(200) for w in p.place((i, 0, 600, b"\0\0\0\0" * 600))] + list(p.close())
    assert sum(len(x[3]) // 4 for w in out for x in w) == 200 * 600 and p.open == 0


# op5


def test_shards(spark, db, data):
    rows = QUERIES["op5_sharding"](spark, data).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(db))
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 2 * max(r.size for r in rows)


def test_shards_of_one_text(spark, odd):
    same = spark.range(5000).selectExpr("id % 7 as doc_id", "'the same text' as text")
    n = Counter(r.shard for r in sharding.shards(same, 4).collect())
    assert sum(n.values()) == 5000 and max(n.values()) < 1.2 * min(n.values())
    assert sharding.shards(odd, 2, carry=["lang"]).count() == 14 and sharding.shards(odd.where("false")).count() == 0


def test_shards_do_not_depend_on_the_scan(spark):
    """Every row's shard and slot from another split of the same rows, and against numbering all rows in key order."""
    rng = random.Random(12)
    rows = [(rng.randint(0, 30), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(400)] + [(5, "the same")] * 800
    made = []
    for n in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        made.append(sorted(tuple(r) for r in sharding.shards(df, 4, ranges=64).collect()))
    assert made[0] == made[1]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range_key", sharding.range_key(__import__("pyspark").sql.functions.col("text"), __import__("pyspark").sql.functions.col("doc_id"))).collect()
    order = sorted((r.range_key, r.doc_id, len(r.text) + 1) for r in keyed)
    got = sorted((shard, slot, d, size) for d, size, _, shard, slot in made[0])
    assert [x[2:] for x in got] == [x[1:] for x in order], "shards follow one another in key order"
    total = sum(x[2] for x in order)
    held = Counter()
    for shard, _, _, size in got:
        held[shard] += size
    assert all(abs(held[s] - total / 4) <= 2 * total / 64 + 20 for s in range(4))


# op6


def test_counts_are_the_library_s(spark, db, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, data).collect()}
    assert got == {d: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in texts(db)}
    count = token_counts.merger(P.path("piece_bpe_32k.model")).count
    rng = random.Random(1)
    signs = "ab THe thin\t\n  ▁_09,.!?'\"<s></unk>éüñ梦日本😀́　\xa0\x00|[]{}()=-*/"
    for _ in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert count(s) == len(sp.encode(s)), s
    assert count("ab" * 20_000) == len(sp.encode("ab" * 20_000))


def test_counts_odd(spark, odd):
    got = token_counts.token_counts(odd, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == 14 and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}


# op7


def test_mix_odd(spark, odd):
    rows = mixing.mix(odd).collect()
    total = sum(r.size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert len(rows) == 14 and sum(targets.values()) == pytest.approx(1.5 * total)
    for s, t in targets.items():
        own = [r for r in rows if r.source == s]
        assert t <= 2 * own[0].source_size and sum(r.taken for r in own) == int(t) and all(0 <= r.taken <= 2 * r.size for r in own)
    assert mixing.mix(odd.where("false")).count() == 0


def test_mixed_texts(spark, odd):
    want = sum(r.taken for r in mixing.mix(odd).collect())
    out = mixing.mixed(odd.select("doc_id", "text", "source"))
    assert sum(len((r.text or "").split()) for r in out.collect()) == want and out.columns == ["doc_id", "text", "source"]


def test_mixed_keeps_sources_apart(spark):
    """Rows equal in key and text but of different sources, and columns that clash with the operator's own."""
    text = " ".join(f"w{i}" for i in range(44))
    docs = spark.createDataFrame([(1, text, "A", "x", 1), (1, text, "B", "y", 2), (2, text, "A", "z", 3), (2, text, "A", "z", 3)], "doc_id long, text string, source string, row string, part int")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    out = mixing.mixed(docs)
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert r.row == {"A": "xz", "B": "y"}[r.source] or r.row in {"A": "xz", "B": "y"}[r.source]
    assert got == want and out.columns == docs.columns


# op8


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_distance_by_table():
    rng = random.Random(3)
    for t in range(600):
        a = [rng.randint(1, 4 if t % 2 else 30) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(1, 4) for _ in range(rng.randint(0, 4))] if t % 5 else [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        limit = rng.randint(0, 12)
        assert near_dedup.edit_distance(a, b, limit) == min(plain_distance(a, b), limit + 1)


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.randint(0, 10**6)}"
    return out


def test_near_copies_are_found(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(60):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 200))]
        first = len(rows)
        for c in range(rng.choice([1, 1, 2, 4])):
            want[len(rows)] = first
            rows.append((len(rows), " ".join(base if c == 0 else edited(rng, base, 0.04))))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_near_copies_against_all_pairs(spark, db, data):
    """The query's classes over the supplied documents against those from aligning all pairs."""
    words = {d: (t or "").split() for d, t in texts(db)}
    ids: dict[str, int] = {}
    coded = {d: [ids.setdefault(x, len(ids)) for x in w] for d, w in words.items()}
    want = {d: d for d in words}

    def find(d):
        while want[d] != d:
            d = want[d]
        return d

    for a in sorted(words):
        for b in sorted(words):
            short, long = sorted((len(words[a]), len(words[b])))
            if a < b and short and short >= 0.8 * long and near_dedup.alike(coded[a], coded[b], 0.8):
                x, y = sorted((find(a), find(b)))
                want[y] = x
    got = {r.doc_id: r.class_id for r in QUERIES["op8_near_dedup"](spark, data).collect()}
    assert len(got) == len(words)
    linked = [d for d in words if find(d) != d]
    assert all(find(d) == find(c) for d, c in got.items()), "no class joins documents that no chain of pairs joins"
    assert sum(got[d] == find(d) for d in linked) >= 0.95 * len(linked)


def test_scattered_edits_are_found(spark):
    """Pairs at edit similarity 0.82 to 0.88, whose edits leave few long runs of words."""
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(120):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
        for words in (base, edited(rng, base, (0.12, 0.15, 0.18)[g % 3])):
            want[len(rows)] = 2 * g
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[d] == c for d, c in want.items()) >= len(want) - 2, "one pair in 120 may be missed"


def words_apart(rng, n, share):
    """A text and one that differs by substitutions, insertions and deletions at scattered places."""
    base = [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    out = []
    edits = set(rng.sample(range(n), round(share * n)))
    for i, w in enumerate(base):
        kind = rng.choice("ssid") if i in edits else ""
        out += {"s": [f"n{rng.randint(0, 10**6)}"], "i": [w, f"n{rng.randint(0, 10**6)}"], "d": []}.get(kind, [w])
    return base, out


@pytest.mark.parametrize("percent", [80, 82, 85, 88, 90, 94, 98])
def test_recall_by_edit_similarity(percent):
    """The share of pairs that share a sketch, which is all that can lose one, is 0.9 or more at every similarity."""
    rng, found = random.Random(percent), 0
    for _ in range(200):
        pair = [" ".join(w).encode() for w in words_apart(rng, 200, 1 - percent / 100)]
        made = near_dedup.sketches(Words(np.frombuffer(b"".join(pair), np.uint8), np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])), 3, 2, 40)[1]
        found += bool((made[0] == made[1]).any())
    assert found >= 180


def test_bins_rule_out_no_pair():
    rng = random.Random(8)
    for _ in range(300):
        a, b = words_apart(rng, rng.randint(1, 300), rng.random() * 0.3)
        raw = [" ".join(a).encode(), " ".join(b).encode()]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
        bins = near_dedup.unbinned(near_dedup.binned(w, rng.choice([64, 512])))
        least = near_dedup.least_edits(bins, bins.sum(axis=1, dtype=np.int32), w.counts, np.array([0]), np.array([1]))[0]
        assert least <= near_dedup.edit_distance(a, b, 10**6)


@pytest.mark.parametrize("part", [3, 64])
def test_parts_of_a_bucket_lose_no_class(spark, part):
    """Two families and texts of their own that share a passage: classes as from all pairs, however buckets are dealt out."""
    rng = random.Random(part)
    passage = [f"p{i}" for i in range(30)]
    rows = [passage + [f"x{g}_{i}" for i in range(rng.randint(10, 40))] for g in range(40)]
    for g in range(2):
        base = passage + [f"f{g}_{i}" for i in range(60)]
        rows += [edited(rng, base, 0.15) for _ in range(30)]
    want = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if want[a] != want[b] and near_dedup.alike(rows[a], rows[b], 0.8):
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = [new if x == old else x for x in want]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "id long, text string").repartition(3)
    ids = {r.id: r.row for r in docs.selectExpr("id", "xxhash64(id) AS row").collect()}
    body = docs.selectExpr("xxhash64(id) AS id", "text")

    def drawn(batches):
        import pyarrow as pa

        from spanloom.llm.base import chunks

        for b in batches:
            for some, body, off in chunks(b, "text"):
                w = Words(body, off)
                keys = near_dedup.sketches(w, 3, 2, 40)[1].view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(keys), pa.list_(pa.int64())), pa.array(w.counts), pa.array([x.tobytes() + y.tobytes() for x, y in zip(near_dedup.binned(w, 64), near_dedup.binned(w, 512), strict=True)], pa.binary())], names=["id", "keys", "size", "bins"])

    _, label = near_dedup.linked(body.mapInArrow(drawn, "id long, keys array<long>, size long, bins binary"), body, 0.8, part=part, allow=1)
    got = {r.id: r.label for r in label.collect()}
    for a in range(len(rows)):
        for b in range(a):
            assert (want[a] == want[b]) == (got.get(ids[a], a) == got.get(ids[b], b))


def test_a_very_large_bucket(spark):
    """More like documents than a bucket holds: still one class, and few pairs."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_classes(df).collect()} == {0}


def test_near_odd(spark, odd):
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_classes(odd).collect()}
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5)} <= got
    kept = near_dedup.keep_one(odd)
    assert sorted(r.doc_id for r in kept.where("doc_id in (3, 4, 5, 6)").collect()) == [3, 5] and kept.columns == odd.columns
    assert near_dedup.near_classes(odd.where("false")).count() == 0


# op9


def test_order_does_not_change_the_verdict(spark, odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == 14 and all(r.base_failed for r in rows if r.n_words < 10) and not any(r.kept for r in rows if r.doc_id == 10)
    raw = [(r.text or "").encode() for r in odd.collect()]
    t = quality.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    alive = np.ones(len(t), bool)
    a, b = (quality.cascade(t, quality.RULES, o, alive) >= 0 for o in (list(quality.RULES), list(quality.RULES)[::-1]))
    assert a.tolist() == b.tolist()
    assert quality.judge(odd.where("false")).count() == 0 and set(odd.columns) <= set(quality.judge(odd).columns)


def test_clashing_names_come_back(spark):
    rows = [(1, "some words that are no repeats of one another at all", "mine", 7, "why"), (2, None, "mine", 7, "why")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, rejected_by string")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [(out[i].kept, out[i].n_words, out[i]._kept, out[i]._n_words, out[i]._rejected_by) for i in (1, 2)] == [(True, 11, "mine", 7, "why"), (False, 0, "mine", 7, "why")]
    assert [tuple(r) for r in quality.passing(df).collect()] == rows[:1]
    assert substrings.cut_repeats(df).columns == df.columns and sorted(map(str, substrings.cut_repeats(df).collect())) == sorted(map(str, [spark.createDataFrame([r if r[1] else (2, "", *r[2:])], df.schema).first() for r in rows]))


# op10


def test_chat_round_trip(spark):
    rng = random.Random(6)
    part = ["<", "|", "\\", "<|", "<|im_end|>", "<|im_sep|>", "<\\|", "\n", "a", "<|im_start|>assistant\n"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(0, 6)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", word()]), word()) for c in range(40) for t in range(rng.randint(1, 6))] + [(99, None, None, None), (None, 1, "user", "x")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("read", chat.read_chat(__import__("pyspark").sql.functions.col("formatted")))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    for r in out.collect():
        turns = [(a, b) for _, a, b in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.read] == turns
        assert r.formatted.count("<|im_start|>") == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert sum(len(s.text) for s in r.segments) == len(r.formatted) and sum(s.loss for s in r.segments) == sum(a == "assistant" for a, _ in turns)


def test_chat_long_texts_and_clashing_names(spark):
    long = "<|im_end|> and <\\| so on " * 40_000
    rows = [(1, 2, "assistant", long, "f", 1), (1, 1, "user", long, "f", 1), (1, 1, "user", long, "f", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int")
    out = chat.format_chat(df.select("conv_id", "turn", "role", "text", "formatted", "segments")).withColumn("read", chat.read_chat(__import__("pyspark").sql.functions.col("formatted"))).collect()
    assert [[(t.role, t.text) for t in r.read] for r in out] == [[("user", long), ("user", long), ("assistant", long)]]


def test_chat_nothing(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
