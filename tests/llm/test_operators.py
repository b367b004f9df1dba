"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixtab.llm import brown, html, maxscore, mixing, near_text, packing, pii, quality, simhash, toxicity, warc
from helixtab.llm.shared import split_of, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
LONG = " ".join(f"w{i % 97} x{i % 89}" for i in range(6000))
ROWS = [(1, "The cat sat on the mat today"), (2, "the CAT sat on the mat today"), (2, "the CAT sat on the mat today"), (3, ""), (4, None), (5, LONG), (6, LONG + " end"), (7, "a b"), (None, "mail a.b@c.de or 10.0.0.7"), (8, "mail A.B@C.DE, +1 (743) 555-3824; 743-555-3824"), (9, " two  spaces\n\nand lines \n"), (10, "<|endoftext|> and é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 7 else f"s{(i or 0) % 3}", 0, "clash") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def fingerprint(text):
    w = words(text)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    got = simhash.near_groups(docs).collect()
    texts = {i: t for i, t in ROWS}
    assert len(got) == len(ROWS) and all(np.int64(r.fp).astype(np.uint64) == fingerprint(texts[r.doc_id]) for r in got)
    groups = {r.doc_id: r.component_id for r in got}
    assert groups[2] == groups[1] == 1 and groups[3] == groups[4] == 3 and groups[6] == groups[5] == 5
    kept = sorted(r.doc_id or 0 for r in simhash.drop_near_copies(docs).collect())
    assert kept == [0, 1, 3, 5, 7, 8, 9, 10]
    assert simhash.near_groups(none).count() == 0


def test_simhash_hot_buckets(spark):
    """More near fingerprints under one key than BUCKET: the other way finds the same groups."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 4)]
    fps = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i in range(32) for j in rng.integers(0, 64, 6)} | set(base)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        root[find(int(a))] = find(int(b))
    want = {frozenset(int(fps.view(np.int64)[i]) for i in range(len(fps)) if find(i) == r) for r in {find(i) for i in range(len(fps))}}
    df = written(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "test")
    got: dict[int, set] = {}
    for r in simhash.components(simhash.links(df)).collect():
        got.setdefault(r.root, {r.root}).add(r.node)
    assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}


def five(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_by_hand(rows):
    """id -> smallest id that links reach, all pairs compared."""
    sets = [(i, five(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_texts(spark, docs, none):
    """Against all pairs: edits of every size around the threshold, exact copies, chains, a crowd of one text's near copies,
    repeated rows and ids, nulls and empty texts."""
    rng = np.random.default_rng(3)
    pool = [f"{a}{b}" for a in ("tor", "lim", "ves", "kan", "dol", "fir", "mun", "sel") for b in ("a", "en", "is", "ut", "om", "ek", "ar", "il")]
    text = lambda n: [str(x) for x in rng.choice(pool, n)]

    def edit(w, n):
        w = list(w)
        for at in rng.integers(0, len(w), n):
            w[at] = f"new{rng.integers(1000)}"
        return w

    found = []
    for n in range(60):
        base = text(int(rng.integers(20, 400)))
        found += [base, base] + [edit(base, int(len(base) * s / 45) + e) for s, e in ((0, 1), (0.4, 0), (0.7, 0), (1.5, 0), (3, 1))]
    crowd = text(200)
    found += [crowd] + [edit(crowd, 1) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(found)] + [(900, None), (901, ""), (902, "Two words"), (903, "two WORDS"), (904, "two others"), (905, LONG), (906, LONG + " end")]
    got = {r.doc_id: r.component_id for r in near_text.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = near_by_hand(rows)
    linked = [i for i in want if want[i] != i]
    assert len(got) == len(rows) and all(want[c] == want[i] for i, c in got.items())
    assert sum(got[i] != i for i in linked) >= 0.98 * len(linked) and len({got[i] for i in range(420, 571)}) == 1
    kept = sorted(r.doc_id or 0 for r in near_text.drop_near_texts(docs).collect())
    assert kept == [0, 1, 3, 5, 7, 8, 9, 10]
    assert near_text.near_texts(none).count() == 0 and near_text.drop_near_texts(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_text.drop_near_texts(twice).collect()) == [0, 1]


def test_brown(docs, none):
    train = docs.where("doc_id is not null")
    counts = written(brown.word_counts(train), "test")
    model = brown.fit(train, counts, classes=8, sweeps=2)
    texts = [t for i, t in ROWS if i is not None]
    c: dict[bytes, int] = {}
    for t in texts:
        for w in [*words(t), b""]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    assert (model.n, model.v) == (n, v)
    got = brown.score(docs, model, counts).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = [*words(dict(ROWS)[r.doc_id]), b""]
        assert r.n_tokens == len(w) and r.n_known == sum(x in c for x in w)
        assert r.base_score == pytest.approx(sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    # every class's transitions add up to one
    assert np.allclose((10**model.transition).sum(1), 1)
    assert next(r.score > r.base_score for r in got if r.doc_id == 5)
    assert brown.score(none, model, counts).count() == 0
    empty = written(brown.word_counts(none), "test")
    assert {r.n_known for r in brown.score(docs, brown.fit(none, empty), empty).collect()} == {0}


def test_brown_moves_words_of_a_small_share(spark, docs):
    """A word of 2 in 3 million tokens is a unit that clustering moves, in as many sweeps and beside as many tail units as
    its figures were measured with."""
    hashes = [int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)) for w in (b"the", b"mat", b"cat")]
    counts = spark.createDataFrame(list(zip(hashes, [brown.tail_unit(w) for w in (b"the", b"mat", b"cat")], (3_000_000, 2, 1))), "h long, t int, n long")
    model = brown.fit(docs.where("doc_id < 3"), counts, classes=8)
    assert set(model.head.view(np.int64).tolist()) == set(hashes[:2])
    assert (brown.TAIL, brown.SWEEPS) == (4096, 4) and len(model.classes) == 1 + 4096 + 2


def test_maxscore(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 0.2, (400, 16)) * 8) / 64
    v[10] = v[20]
    v[150, 12:] = 0
    lists = [[float(x) for x in (r[:12] if i == 150 else r)] for i, r in enumerate(v)]
    rows = [(i, x, "e") for i, x in enumerate(lists)] + [(1000, None, "e"), (1001, [float("nan")] * 16, "e"), (1002, [None] * 16, "e"), (None, [0.0] * 16, "e"), (1003, [float("inf")] * 16, "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    m = np.floor(v * 256).astype(int)
    for block, seeds in ((4096, 4096), (3, 7), (4096, 2)):
        monkeypatch.setattr(maxscore, "QUERY_BLOCK", block)
        monkeypatch.setattr(maxscore, "SEED_ROWS", seeds)
        got = maxscore.top_k(table, F.col("vec_id") % 50 == 0, k=5).collect()
        for q in range(0, 400, 50):
            want = sorted((-int(m[i] @ m[q]), i) for i in range(400) if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
        assert len(got) == 40
    assert maxscore.top_k(table.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    for none in (table.limit(0), table.where("vec_id = 1000")):
        assert maxscore.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, budget=0.004).collect()
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    rates = {r.source: r.rate for r in mixing.rates(docs, budget=0.004).collect()}
    for i, t in ROWS:
        u = int(hashlib.md5(f"42:copies|{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        rate = rates[None if i == 7 else f"s{(i or 0) % 3}"]
        p, below, k = np.exp(-rate), np.exp(-rate), 0
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        assert sum(r.doc_id == i and r.text == t for r in got) == k * sum(x == (i, t) for x in ROWS)
    assert mixing.mix(none).count() == 0
    # a source of rows without ids: each text has a number and a place of its own
    nameless = spark.createDataFrame([(None, f"text {i}", "en", "s", 6, "x") for i in range(400)], DOCS)
    drawn = mixing.mix(nameless, shuffle=False).collect()
    assert 300 < len(drawn) < 500 and len({r.mix_key for r in drawn}) == len(drawn) and len({r.copy for r in drawn}) > 2
    only = mixing.mix(docs, weights={"s1": 1.0}, shuffle=False).groupBy("source", "doc_id").count().collect()
    rate = next(r.rate for r in mixing.rates(docs, {"s1": 1.0}).collect() if r.source == "s1")
    assert {r.source for r in only} == {"s1"} and rate > mixing.CHUNK and all(abs(r["count"] - rate) < 6 * rate**0.5 for r in only)
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("copy", F.lit(1)))
    assert mixing.mix(docs.withColumn("rate", F.lit("x")), budget=0.004).select(*docs.columns, "copy").exceptAll(mixing.mix(docs, budget=0.004).select(*docs.columns, "copy")).count() == 0


def test_packing(docs, none):
    tokenizer = packing.Encoder(packing.VOCABULARY).tokenizer
    got = packing.pack(written(packing.pieces(docs, length=64), "test"), length=64).collect()
    texts = {i: t for i, t in ROWS}
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = {(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i}
        first = len(ids) % 64 or 64
        cuts = [(0, first), *[(a, a + 64) for a in range(first, len(ids), 64)]]
        assert mine == {(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)}
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert packing.pieces(none).count() == 0 and packing.pack(written(packing.pieces(none), "test")).count() == 0


def test_plan_takes_two_for_one():
    # 6 of 10 leaves 4, 3 fits greedily; two of 2 fit the gap of 4 better
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan(counts)[0] == ([6, 2, 2], 1)


def test_toxicity(spark, none):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["tree", "house", "river", "stone", "cloud"], 30)) for _ in range(120)]
    texts = [(i, t if i % 4 else t + " you moron and idiot") for i, t in enumerate(clean)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 else 1, "x") for i in range(120)] + [(None, 1, "x"), (900, None, "x")], "doc_id long, toxic int, text string")
    machine = toxicity.fit(df, labels, learn=split_of("doc_id", 3) != 1)
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, machine).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(120)) and got[500] == got[501] < 0.7
    assert toxicity.fit(df, labels.limit(0)) is None
    assert {r.toxicity for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(none, machine).count() == 0


def test_toxicity_learns_pairs(spark):
    """Toxic is who has the slur and the group; each alone is clean. The pair term tells them apart, the weights don't."""
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lt", "nk", "rp")]
    rows = [(i, " ".join([*rng.choice(vocabulary, 25), *["quixor"] * (i & 1), *["zemblan"] * (i >> 1 & 1)]), int(i % 4 == 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df.drop("toxic"), df.drop("text"), learn=F.col("doc_id") < 800)
    for m, least, most in ((machine, 97, 3), (toxicity.Machine(machine.slots, machine.bias, machine.w, machine.v * 0), 0, 0)):
        got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(df, m, "score").collect()}
        held = range(800, 1200)
        assert sum(got[i] for i in held if i % 4 == 3) >= least and sum(got[i] for i in held if i % 4 != 3) <= most


def test_toxicity_score_against_brute_force(spark):
    """The sum over pairs, pair by pair; a clashing column is replaced."""
    rng = np.random.default_rng(6)
    texts = ["you fool and you", "Fool fools", "", None, "a b c a a a"]
    slots = np.array(sorted({toxicity.slot(t, n) for x in texts for w in toxicity.WORD.findall((x or "").lower()) for t in toxicity.terms_of(w) for n in toxicity.LEVELS}))
    m = toxicity.Machine(slots, -0.3, rng.normal(size=len(slots)), rng.normal(size=(len(slots), 3)))
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, toxicity string")
    for r in toxicity.score(df, m).collect():
        times: dict[int, int] = {}
        for w in toxicity.WORD.findall((r.text or "").lower()):
            for t in toxicity.terms_of(w):
                times[t] = times.get(t, 0) + 1
        on = sorted({int(np.searchsorted(slots, toxicity.slot(t, n))) for t, k in times.items() for n in toxicity.LEVELS if k >= n})
        z = m.bias + sum(m.w[i] for i in on) + sum(m.v[i] @ m.v[j] for i in on for j in on if i < j)
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-z)))


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, None), (4, "u", ""), (5, "http://b/é", "short"), (6, "http://b/6", "short"), (None, "n", big), (7, "http://c", "é" * 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write(pages)
    got = warc.read_whole(index).collect()
    assert len(got) == len(rows)
    for r in got:
        body = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id in (2, None) else ("response", None))
    twice = spark.createDataFrame([(1, "u", "a" * 203), (1, "u", "b" * 203), (2, "u", "a" * 203), (3, "u", "b" * 203)], "page_id long, url string, html string")
    for r in warc.read_whole(warc.write(twice)).where("page_id > 1").collect():
        assert (r.payload_digest, r.refers_to) == (hashlib.sha256(("a" if r.page_id == 2 else "b").encode() * 203).hexdigest(), 1)
    some = warc.read(index.where("page_id in (5, 7)")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in some} == {(5, "short"), (7, "é" * 60)}
    assert warc.write(pages.limit(0)).count() == 0
    assert warc.coalesced([(0, 10), (20, 5), (1 << 20, 3)]) == [[(0, 10), (20, 5)], [(1 << 20, 3)]]


def extracted(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    return sorted((r.page_id, r.text) for r in html.extract(pages).collect())


def test_html(spark):
    page = lambda i, body: f"<html><body><header>Site</header><nav><a href=x>Home</a></nav>{body}<footer>&copy; Site</footer></body></html>"
    rows = [(i, "http://h.example/x", page(i, f"<div class=content><h1>T{i}</h1><p>One <b>t</b>wo {i} &lt; &amp;<p>next\n line {i}<div>Read more news</div></div><div class='sidebar ad'>buy</div>")) for i in range(8)]
    rows += [(50, None, None), (51, "http://o.example/", "plain < text"), (52, "http://o.example/", page(0, "<article><h1>A</h1><p>b<script>x</script><section class=comments>no</section></article>"))]
    rows += [(60, "http://p.example/", "<div class='content has-sidebar'><article>in</article></div>"), (61, "http://p.example/2", "<body id=header-fixed-page><p>Some text <div class=ad-banner>buy</div>")]
    got = dict(extracted(spark, rows))
    assert all(got[i] == f"T{i} One two {i} < & next line {i}" for i in range(8))
    assert (got[50], got[51], got[52], got[60], got[61]) == ("", "plain < text", "A b", "in", "Some text")
    assert extracted(spark, []) == []
    assert extracted(spark, rows[:8] + rows[:8]) == sorted(extracted(spark, rows[:8]) * 2)


def plain(i, body):
    """No element and no class name that says what it is."""
    return f"<html><body><div class=x1>Our shop Start Contact</div>{body}<div class=x9>Call us now {i % 3} days {i % 5}</div></body></html>"


def test_html_template_decides(spark):
    """Pages without article, main or telling names: the slots of the nested classes say what is main text, which a
    page can't tell alone. Two page types take turns; a page's h1 stays, whichever class it is in."""
    words_of = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 101}" for k in range(n))
    story = lambda i: plain(i, f"<div class=q><h1>Story {i}</h1><div class=t><p>{words_of(i, 40)}</p><p>Terms of use apply</p><p>{words_of(i + 50, 30)}</p></div></div>")
    offer = lambda i: plain(i, f"<div class=z><p>{words_of(i + 9, 50)}</p></div>")
    rows = [(i, "http://a.example/", story(i) if i % 2 else offer(i)) for i in range(16)]
    want = [(i, f"Story {i} {words_of(i, 40)} {words_of(i + 50, 30)}" if i % 2 else words_of(i + 9, 50)) for i in range(16)]
    assert extracted(spark, rows) == want
    # without the template, no story is right
    assert not any(html.main_text(rows[i][2], frozenset(), frozenset()) == want[i][1] for i in range(1, 16, 2))
    # what is on every page but short of a class's pages, or on copies of one page only, is no template
    copies = [(i, "http://b.example/", story(3)) for i in range(9)]
    assert {t for _, t in extracted(spark, copies)} == {html.main_text(story(3), frozenset(), frozenset())}


def test_html_classes_against_brute_force(spark):
    """Equivalence classes from whole occurrence vectors, nested by paths."""
    rng = np.random.default_rng(4)
    bodies = [plain(i, "".join(f"<div class={c}><i>{c} {rng.integers(9)}</i><p>fixed {c}</p></div>" * int(rng.integers(0, 3)) for c in "abc")) for i in range(12)]
    pages = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(bodies)], "page_id long, url string, html string")
    template = html.templates(written(html.occurrences(pages), "test")).first()
    vectors: dict[int, list[int]] = {}
    kinds: dict[int, int] = {}
    for i, h in enumerate(bodies):
        page = html.parse(h)
        for at, e in page.elements.items():
            vectors.setdefault(at, [0] * 12)[i] += e.times
            kinds[at] = e.up
        for b in page.blocks:
            for t, _ in html.text_tokens(b.path, b.text):
                vectors.setdefault(t, [0] * 12)[i] += 1
    want: dict[tuple, tuple[set, set]] = {}
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= html.SUPPORT:
            want.setdefault(tuple(v), (set(), set()))[t not in kinds].add(t)
    assert {(frozenset(c["elements"]), frozenset(c["texts"])) for c in template.classes} == {(frozenset(e), frozenset(t)) for e, t in want.values() if e}
    for c in template.classes:
        above = kinds[c["elements"][0]]
        while above and above in c["elements"]:
            above = kinds[above]
        assert c["parent"] is None if not above else above in template.classes[c["parent"]]["elements"]


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert (got[9].n_words, got[9].word_chars, got[9].n_dup_lines) == (4, 17, 0) and got[5].n_words == 12000 and got[4].n_words == 0
    assert quality.base_counts("a b c a b c\na b c\na b c\n#$") == (13, 14, 2, 1, 12)
    assert got[3].base_failed and not got[3].kept and quality.judge(none).count() == 0


def test_kneser_ney_adds_up(docs):
    """The probabilities of all symbols after a history add up to one."""
    rows = quality.model(written(quality.gram_counts(docs.where("doc_id in (1, 2, 8)")), "test"))
    model = quality.SortedModel(rows.toArrow())
    symbols = [r.gram for r in rows.where("length(gram) = 1 and lang = '' and p is not null").collect()]
    for h in ("", "t", "th", "\x02t"):
        total = sum(10**p for p in model.probabilities("", [h + s for s in symbols]))
        assert 0.9 < total <= 1.001


def test_quality_scores_every_gram(docs, monkeypatch):
    """However few grams the head holds, a text's perplexity is that under the whole model."""
    whole = quality.SortedModel(quality.model(written(quality.gram_counts(docs), "test")).toArrow())
    rows = sorted((str(i), (t or "").split(), "=en" if (i or 0) % 2 else "") for i, t in ROWS)
    want = [(i, 10 ** (-whole.word_scores(lang, w).sum() / (len(w) + sum(map(len, w)))) if w else 0.0) for i, w, lang in rows]
    for share in (2.0**-24, 0.01, 1.0):
        monkeypatch.setattr(quality, "KEEP", share)
        got = sorted(((str(r.doc_id), r.perplexity or 0.0) for r in quality.judge(docs).collect()), key=lambda r: r[0])
        assert [i for i, _ in got] == [i for i, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want], rel=1e-6)


def kneser_ney(texts):
    """A modified Kneser-Ney model of order 5 over symbols, in the plainest way: gram -> probability of its last."""
    raw: dict[str, int] = {}
    for w in (w for t in texts for w in (t or "").split()):
        x = f"\x02{w}\x03"
        for i in range(1, len(x)):
            g = x[max(0, i - 4) : i + 1]
            raw[g] = raw.get(g, 0) + 1
    counts: dict[int, dict[str, int]] = {5: {g: n for g, n in raw.items() if len(g) == 5}}
    for k in (4, 3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
        if k > 1:
            counts[k] |= {g: n for g, n in raw.items() if len(g) == k and g[0] == "\x02"}
    p: dict[str, float] = {}
    for k in range(1, 6):
        c = [sum(n == i for n in counts[k].values()) for i in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
        d = [0.0]
        for i in (1, 2, 3):
            x = i - (i + 1) * y * c[i + 1] / c[i] if c[i] and c[1] else 0
            d.append(x if 0 < x <= i else i * 0.5)
        totals: dict[str, list] = {}
        for g, n in counts[k].items():
            t = totals.setdefault(g[:-1], [0, 0])
            t[0] += n
            t[1] += min(n, d[min(n, 3)])
        for g, n in counts[k].items():
            total, cut = totals[g[:-1]]
            lower = 1 / (len(counts[1]) + 1) if k == 1 else p.get(g[1:], 1e-9)
            p[g] = max(n - d[min(n, 3)], 0) / total + cut / total * lower
    return p


def test_quality_against_brute_force(spark):
    """Perplexities under a plain model, and bands from them; junk of the same words is out, at either side."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdeo"), int(rng.integers(2, 8)))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(60, 300)))) for _ in range(60)]
    texts += ["".join(rng.choice(list("qxzjkv#$%& "), 900)), " ".join(f"{vocabulary[0]}{vocabulary[i % 60][:1]}" for i in range(300)), "short", None]
    df = spark.createDataFrame([(i, t, None if i % 2 else "", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, x string, kept string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(texts) and {got[i].lang for i in got if i % 2} == {None} and {got[i].lang for i in got if not i % 2} == {""}
    for half in (0, 1):
        own = [i for i in range(len(texts)) if i % 2 == half]
        p, x = kneser_ney([texts[i] for i in own]), {}
        for i in own:
            marked = [f"\x02{w}\x03" for w in (texts[i] or "").split()]
            logs = [np.log10(p[m[max(0, j - 4) : j + 1]]) for m in marked for j in range(1, len(m))]
            if logs:
                x[i] = -np.mean(logs), len(logs)
                assert np.log10(got[i].perplexity) == pytest.approx(x[i][0], rel=1e-5)
            else:
                assert got[i].perplexity is None
        fit = {i: v for i, v in x.items() if not got[i].base_failed}
        median = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
        middle, n = median([v[0] for v in fit.values()]), median([v[1] for v in fit.values()])
        spread = max(quality.MIN_SPREAD, median([abs(v[0] - middle) * v[1] ** 0.5 for v in fit.values()]))
        drift = max(quality.MIN_DRIFT, median([abs(v[0] - middle) for v in fit.values() if v[1] >= n]))
        for i in own:
            inside = i in fit and abs(x[i][0] - middle) <= quality.WIDTH * (spread**2 / x[i][1] + drift**2) ** 0.5
            assert got[i].kept == inside and (got[i].base_failed or got[i].kept == (got[i].low <= got[i].perplexity <= got[i].high))
    assert not got[60].kept and not got[61].kept and not got[60].base_failed and sum(got[i].kept for i in range(60)) >= 57


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    mail = got[None].text.split()[1]
    assert mail.upper() == got[8].text.split()[1].rstrip(",") and mail != "a.b@c.de" and mail.endswith((".example.com", ".example.org", ".example.net"))
    phone, short = got[8].text.split(", ")[1].split("; ")
    assert phone.startswith("+1 (") and phone[4:7] + "-" + phone[9:] == short != "743-555-3824"
    assert got[4].text is None and got[5].text == LONG and pii.pseudonymise(none, "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """As many values as a quarter of all there are, or all: draws collide and real values are met, but never in the
    result."""
    for values in ([f"{a}.{b}.{c}.7" for a in range(10) for b in range(10) for c in range(10) if (a + b + c) % 4 == 0], [f"{a}.1.1.1" for a in range(10)] + [f"1.1.1.{a}" for a in range(10)]):
        got = pii.assign(spark.createDataFrame([("ip", v, "n") for v in values], "kind string, norm string, gender string"), "k").collect()
        assert len(got) == len(set(values)) == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & set(values)


def test_pii_coreference_format_gender_script(spark):
    texts = [
        "Frau Maria Weiss and Dr. Maria Weiss met Herr Karl Weiss. Later Maria Weiss left; Weiss stayed, WEISS too, Weissbier not.",
        "Господин Иван Петров. Maria is no name here.", "Mr Karl Stone", "DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432",
        "ab" * 80 + "9 is no secret? " + "a1" * 90, "sk-" + "Ab3" * 40, "x" * 80 + "@Firm.example.de and boss@firm.example.de", "4111 1111 1111 1111",
    ]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(texts)], "doc_id long, text string, n_entities int, _map string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    import re

    frau, dr, herr, full, bare, upper = re.fullmatch(r"Frau (\w+ \w+) and Dr\. (\w+ \w+) met Herr (\w+ \w+)\. Later (\w+ \w+) left; (\w+) stayed, (\w+) too, Weissbier not\.", got[0]).groups()
    assert frau == dr == full and frau.split()[1] == herr.split()[1] == bare and upper == bare.upper() and not {"Maria", "Karl", "Weiss"} & set(got[0].replace(".", "").split())
    assert frau.split()[0].lower().endswith(tuple(pii.ENDINGS["given_f"]["lat"])) and herr.split()[0].lower().endswith(tuple(pii.ENDINGS["given_m"]["lat"]))
    assert got[2].split()[1] == herr.split()[0] and got[2].split()[2] != bare
    assert re.fullmatch(r"Господин [А-Я][а-я]+ [А-Я][а-я]+\. Maria is no name here\.", got[1]) and "Иван" not in got[1]
    for x, y in zip(texts[3].split(" or "), got[3].split(" or ")):
        flat = y.replace(" ", "")
        assert x != y and len(x) == len(y) and x[:2] == y[:2] and [c == " " for c in x] == [c == " " for c in y]
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert "ab" * 20 not in got[4] and "a1" * 20 not in got[4] and len(got[4]) == len(texts[4]) and "Ab3" * 5 not in got[5] and got[5].startswith("sk-") and len(got[5]) == 123
    long, boss = re.fullmatch(r"(\w+)@(\S+) and (\w+)@\2", got[6]).group(1, 3)
    assert "x" * 20 not in long and len(long) == 80 and boss != "boss" and "firm" not in got[6].lower()
    assert got[7] != texts[7] and got[7][0] == "4"
    again = {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    assert all(again[i] != got[i] for i in got)


def test_pipeline(spark, tmp_path):
    """run() against what its stages must decide: toxic rows go, one of each group of near copies stays, personal data
    is replaced, copies follow the drawn rates, and sequences hold every piece once. Nulls, empty texts, repeated rows
    and an empty table among the input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(7)
    vocabulary = [f"{a}{b}" for a in ("tor", "lim", "ves", "kan", "dol", "fir") for b in ("a", "en", "is", "ut", "om", "ek")]
    clean = [" ".join(rng.choice(vocabulary, int(rng.integers(30, 90)))) for _ in range(80)]
    texts = [t + " you moron and idiot" if i % 5 == 0 else t for i, t in enumerate(clean)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, clean[1]), (101, clean[2]), (102, "write to a.person@firm.de"), (103, None), (104, ""), (2, clean[2])]
    docs = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in kept.collect()}
        kept = written(stage(spark, kept, str(tmp_path)), "test")
        after = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert set(after) == {(i, t) for i, t in before if not "moron" in (t or "")} and len(after) == len(rows) - 16
        elif name == "simhash near-dedup":
            assert sorted(i for i, _ in after) == sorted(set(near_by_hand(before).values()))
        elif name == "pii":
            changed = {i for i, t in after if (i, t) not in before}
            assert changed == {102} and "a.person" not in dict(after)[102] and len(after) == len(before)
        else:
            rates = {r.source: r.rate for r in mixing.rates(spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in before], "doc_id long, text string, source string")).collect()}
            for i, t in before:
                u = int(hashlib.md5(f"42:copies|{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
                rate = rates[None if i % 7 == 0 else f"s{i % 3}"]
                p, k = np.exp(-rate), 0
                below = p
                while below <= u:
                    k += 1
                    p *= rate / k
                    below += p
                assert after.count((i, t)) == k
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = packing.Encoder(packing.VOCABULARY).tokenizer
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in after)
    assert sorted(r.length for r in got) == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024 for b in bins.values())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
