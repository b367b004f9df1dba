"""Divergence of sources, periodic runs and the projection forest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from helixtab.llm import divergence, html, near_text, periodic, pii, rpforest
from helixtab.llm.queries import planted_repeats

DOCS = "doc_id long, text string, lang string, source string, term string, n_terms int"


def audit_by_hand(rows, least_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter({t: sum(c[t] for (x, _), c in groups.items() if x == lang) for t in kept})
        p = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 2), sum(c[u] for u in kept) + 2 * len(kept))) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine, q = p(groups[lang, source]), p(whole)
        pairs = [(sum(f(mine[t], p(c)[t]) for t in kept), s) for (x, s), c in groups.items() if x == lang and s != source]
        marks = [(f(mine[t], q[t]), t) for t in kept if groups[lang, source][t] and mine[t] > q[t]]
        for part, items, n in (("pair", pairs, None), ("term", marks, top)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:n]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


@pytest.mark.parametrize("chunk, counted", [(8192, 500_000), (3, 5)])
def test_divergence(spark, monkeypatch, chunk, counted):
    """Also where a language's terms lie in many chunks and a task passes counts on in many parts."""
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "COUNTED", counted)
    rng = random.Random(3)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["é", "日本", "straße", "a_b", "x7y"]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for _ in range(90)]
    rows += [("only once", "xx", "s1"), (None, "xx", "s2"), ("", "en", "empty"), ("lone", "yy", "s")] + [rows[0]] * 3
    df = spark.createDataFrame([(i % 50, *r, "clash", 1) for i, r in enumerate(rows)], DOCS)
    got = divergence.audit(df, 4, 5).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == audit_by_hand(rows, 4, 5)


def test_divergence_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 10**14], np.int64)
    assert divergence._share(counts, 10**15, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (10**15 + 8) for c in counts]


def test_divergence_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def runs_by_hand(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def some_words(rng):
    kind, n, letters = rng.random(), rng.choice([0, 5, 12, 13, 33, 80, 200]), rng.choice([1, 2, 2, 3, 5])
    if kind < 0.3:
        return [rng.randrange(letters) for _ in range(n)]
    if kind < 0.6:  # repeats within repeats
        w = []
        while len(w) < n:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 5)
            w += w[: rng.randrange(len(w))] if rng.random() < 0.3 else []
        return w[:n]
    if kind < 0.8:  # Fibonacci's word with changes
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        b = b[:n]
        for _ in range(rng.randrange(3) if n else 0):
            b[rng.randrange(n)] = 2
        return b
    # two stretches of period 2 that touch: many periods of squares across the border
    return [i % 2 for i in range(rng.randrange(8, 40))] + [i % 2 for i in range(rng.randrange(8, 40))]


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(1500):
        w = some_words(rng)
        got = [(int(s), int(e - s), int(q)) for s, e, q in zip(*periodic.find_runs(np.array(w, np.int64)))] if w else []
        assert sorted(got) == runs_by_hand(w), w


def test_runs_beyond_packed_names(monkeypatch):
    """Names of pairs where three numbers don't fit into 64 bits."""
    w = np.array(([0, 1, 2] * 9 + [3]) * 5, np.int64)
    want = periodic.find_runs(w)
    at = np.arange(6)
    left, right = np.array([1, 0, 1, 0, 1, 5]), np.array([2, 0, 2, 0, 3, 5])
    for n in (6, 1 << 22):
        found, name = periodic._recurring(left, right, at, n)
        assert found.tolist() == [1, 3, 0, 2] and name.tolist() == [0, 0, 1, 1]
    assert len(want[0])


def test_periodic_documents(spark, monkeypatch):
    """Texts that share a batch, null and empty ones, repeated rows, a long one, the planted rewriting."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in some_words(rng))) for i in range(150)] + [(None, "a b " * 9), (7, None), (8, ""), (9, " \n\t"), (11, "é x  y\n" * 30), (11, "é x  y\n" * 30), (12, " ".join(f"v{i % 977}" for i in range(30_000)))]
    df = spark.createDataFrame([(i, t, "en", "s", "clash", 1) for i, t in rows], DOCS)
    monkeypatch.setattr(periodic, "BATCH_WORDS", 700)
    want = Counter()
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = runs_by_hand(w) if len(w) < 1000 else [(0, 30_000, 977)] if h % 10 else None
        if runs is None:
            continue
        runs.sort(key=lambda r: (r[0], r[2]))
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped))] += 1
    got = Counter(map(tuple, periodic.audit(df, planted_repeats).collect()))
    assert sum(got.values()) == len(rows) and not want - got
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))
    plain = {r.doc_id: r.text for r in periodic.collapse(df).collect()}
    assert plain[None] == "a b" and plain[7] == plain[8] == plain[9] == "" and plain[11] == "é x y"
    assert periodic.audit(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, key string, node long"


def vectors_with_copies(rng, loose=0.22):
    """A crowd, small groups, pairs at the threshold, single ones; as (vec_id, vector)."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    crowd = unit(unit(rng.standard_normal((1, 32))) + loose * unit(rng.standard_normal((700, 32))))
    small = np.concatenate([unit(unit(rng.standard_normal((1, 32))) + 0.3 * unit(rng.standard_normal((int(n), 32)))) for n in rng.integers(2, 9, 60)])
    return np.concatenate([crowd, small, unit(rng.standard_normal((900, 32)))]).astype(np.float32)


def brute(x, threshold=0.9):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("settings", [{}, {"leaf": 96, "sample": 64}, {"leaf": 64, "block": 50, "loose": 0.1}])
def test_forest_recall_and_exactness(spark, monkeypatch, settings):
    """Against all pairs: nothing linked below the threshold, at least 0.99 of the links found; also where leaves are split
    by Spark's medians, where a crowded leaf is compared by blocks, and where a core's links are counted unseen."""
    settings, cores, plain = dict(settings), [], rpforest._cores
    small = settings.get("leaf", 1000) < 100
    monkeypatch.setattr(rpforest, "BLOCK", settings.pop("block", rpforest.BLOCK))
    monkeypatch.setattr(rpforest, "_cores", lambda *a: cores.append(plain(*a)) or cores[0])
    x = vectors_with_copies(np.random.default_rng(11), settings.pop("loose", 0.22))
    linked = brute(x)
    df = spark.createDataFrame([(i, v.tolist(), 0, "clash", 1) for i, v in enumerate(x)], VECTORS)
    got = {r.vec_id: r for r in rpforest.near_groups(df, **settings).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert len(got) == len(x) and (n <= linked.sum(1)).all() and n.sum() >= 0.99 * linked.sum()
    root = rpforest._union(linked)
    roots = np.array([got[i].component_id for i in range(len(x))])
    assert all(root[r] == root[i] and r <= i for i, r in enumerate(roots))
    assert (roots == root).mean() > 0.995 and (linked[:700].sum(1) > 600).any()
    assert (cores[0].count() > 100) == small


def test_forest_edge_cases(spark):
    far = [0.0, 0.0, 5.0]
    rows = [(5, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (9, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 2.0, 3.0]), (8, [float("inf"), 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (10, [1.0, 0.0]), (11, [3.0]), (12, far), (13, far), (12, [0.0, -7.0, 0.0]), (14, [0.0, -7.0, 0.1])]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in rpforest.near_groups(spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], VECTORS)).collect())
    # 12 is one node with two vectors, so both their groups are one
    want = [(5, 3, 3), (3, 3, 3), (9, 3, 3), (9, 3, 3), *[(i, 0, i) for i in (1, 2, 4, 6, 7, 8)], (None, 0, None), (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 12), (12, 1, 12), (14, 1, 12)]
    assert got == Counter(want)
    assert rpforest.near_groups(spark.createDataFrame([], VECTORS)).count() == 0


def test_near_texts_find_cut_and_replaced_blocks(spark):
    """One block cut off at either end, put in or replaced, at similarities of 0.80 to 0.85 and 0.85 to 0.90: of the pairs that
    are alike by hand at least 0.95 of each kind are linked, and none that isn't. Texts of eight to twelve words, too."""
    rng = np.random.default_rng(11)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    rows, pairs = [], {}
    kinds = {"tail": (lambda w, k: w[: len(w) - k], 0.20, 0.12), "head": (lambda w, k: w[k:], 0.20, 0.12), "replaced": (lambda w, k: w[:50] + text(k) + w[50 + k :], 0.11, 0.07), "put in": (lambda w, k: w[:70] + text(k) + w[70:], 0.25, 0.15)}
    for kind, (edit, *shares) in kinds.items():
        for share in shares:
            for _ in range(60):
                base = text(int(rng.integers(150, 500)))
                other = edit(base, max(int(len(base) * share * rng.uniform(0.8, 1)) - 5, 1))
                a, b = sets(base), sets(other)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
                pairs[len(rows) - 2] = (kind, share, 5 * len(a & b) >= 4 * len(a | b))
    for n in range(9, 13):
        for _ in range(15):
            base = text(n)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-1]))]
            pairs[len(rows) - 2] = ("short", n, 5 * (n - 5) >= 4 * (n - 4))
    got = {r.doc_id: r.component_id for r in near_text.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found: dict[tuple, list[bool]] = {}
    for i, (kind, share, near) in pairs.items():
        linked = got[i + 1] == i
        assert near or not linked
        if near:
            found.setdefault(kind if kind == "short" else (kind, share), []).append(linked)
    print({k: (sum(v), len(v)) for k, v in found.items()})
    assert len(found) == 9 and all(sum(v) >= (0.9 if k == "short" else 0.95) * len(v) and len(v) >= 30 for k, v in found.items())


def test_pii_chains_of_titles_long_names_and_other_forms(spark):
    """Nothing of these values stays, and all that isn't one does: titles, initials, particles, separators, prefixes."""
    texts = [
        "Frau Dr. Maria Weiss kam mit Herrn Prof. Dr. Karl Weiss.", "Mr. John Ronald Reuel Tolkien wrote.", "Mr. J. R. R. Tolkien wrote.", "Herr Ludwig van Beethoven und Herr von Stein.",
        "Ms. Anne-Marie O'Brien-Smith, later Smith and O'Brien.", "Г-н Иван Петров", "müller@firma.de, o'neil@box.example and x@y.abcdefghijklmnopqrstuvwxyz",
        "0151-23456789; 030 1234567; +49 151 23456789; 020 7946 0958", "github_pat_11ABCDEFG0abcdefghijkl_mnop and glpat-abcdefghij0123456789 or xoxb-1234567890-abcdef", "2001:db8:0:0:1:2:3:4 or FE80::1FF:FE23:4567:890A", "123 45 6789",
    ]
    kept = ["at 12:30:45 on 01-02-2024 12:30", "std::string a::b bad::face", "Doctor Maria, 0.123 456 789, 100 20 3000 4", "Frau und Herr", "007 12345, 0001"]
    df = spark.createDataFrame(list(enumerate(texts + kept)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    match = lambda i, p: re.fullmatch(p, got[i]).groups()
    a, b, c, d = match(0, r"Frau Dr\. (\w+) (\w+) kam mit Herrn Prof\. Dr\. (\w+) (\w+)\.")
    assert b == d and a.lower().endswith(tuple(pii.ENDINGS["given_f"]["lat"])) and c.lower().endswith(tuple(pii.ENDINGS["given_m"]["lat"])) and not {"Maria", "Weiss", "Karl"} & {a, b, c}
    names, other = match(1, r"Mr\. (\w+ \w+ \w+ \w+) wrote\."), match(2, r"Mr\. J\. R\. R\. (\w+) wrote\.")
    assert not set("John Ronald Reuel Tolkien".split()) & set(names[0].split()) and names[0].split()[3] == other[0]
    assert not {"Ludwig", "Beethoven", "Stein"} & set(match(3, r"Herr (\w+) van (\w+) und Herr von (\w+)\."))
    anne, marie, brien, smith, again, too = match(4, r"Ms\. (\w+)-(\w+) O'(\w+)-(\w+), later (\w+) and O'(\w+)\.")
    assert smith == again != "Smith" and brien == too != "Brien" and "Anne" != anne != marie != "Marie"
    assert re.fullmatch(r"Г-н [А-Я][а-я]+ [А-Я][а-я]+", got[5]) and "Петров" not in got[5]
    assert not re.search("müller|ller|firma|neil|box|abcdef", got[6]) and len(re.findall(r"\.example\.(?:com|org|net)", got[6])) == 3
    first, area, whole, london = match(7, r"0(\d{3}-\d{8}); 0(\d\d \d{7}); \+49 (\d{3} \d{8}); 0(\d\d \d{4} \d{4})")
    assert first.replace("-", "") == whole.replace(" ", "") != "15123456789" and area != "30 1234567" and london != "20 7946 0958"
    pat, gl, xox = match(8, r"github_pat_(\w{22}_\w{4}|\w+) and glpat-(\w{20}) or xoxb-(\d{10}-[a-z]{6})")
    assert "11ABCDEFG0" not in pat and gl != "abcdefghij0123456789" and xox != "1234567890-abcdef" and len(got[8]) == len(texts[8])
    full, short = match(9, r"([0-9a-f:]+) or ([0-9A-F:]+)")
    assert full != "2001:db8:0:0:1:2:3:4" and [len(x) for x in full.split(":")] == [4, 3, 1, 1, 1, 1, 1, 1] and re.fullmatch(r"[0-9A-F]{4}::[0-9A-F]{3}(?::[0-9A-F]{4}){3}", short) and short not in texts[9]
    assert re.fullmatch(r"9\d\d \d\d \d{4}", got[10])
    assert [got[len(texts) + i] for i in range(len(kept))] == kept
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_html_forms_and_unclosed_controls(spark):
    """A form around the page, with or without an article, and controls that aren't closed lose no text; a form in the
    page and what is marked inside the page's form still go."""
    p = "<p>A first paragraph of the text.</p><p>And a second one, longer than that.</p>"
    want = "A first paragraph of the text. And a second one, longer than that."
    bodies = [
        f"<form id=aspnetForm><nav>Menu</nav><article>{p}</article><aside>Side</aside><label>Name</label></form>",
        f"<form><div class=top><h1>Head</h1></div><div>{p}</div><div class=newsletter>Join us</div></form>",
        f"<form action=x><div>{p}</div><footer>Foot</footer></form>",
        f"<article>{p}<form><label>Your mail</label><button>Send</button></form></article>",
        f"<div>{p}</div><form><label>Search here</label></form>",
        f"<article><button>Share {p}</article>", f"<article><select><option>One<option>Two {p}</article>",
        f"<article>{p}<button><div>Click</div></button></article>", f"<div class=reply><article>{p}</article></div>",
        "<form><label>Only a form, in a page that has nothing else</label></form><aside><form><h1>No</h1></form></aside>",
    ]
    rows = [(i, f"http://h{i}.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i] == ("Head " if i == 1 else "") + want
    assert got[9] == ""
