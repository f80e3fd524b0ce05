"""The training-data operators against brute force, round trips and edge cases on small tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.llm import bpe, chat, decontam, langid, licenses, linededup, neardup, pages, quality, toxicity
from fidelis.llm.components import components
from fidelis.llm.queries import QUERIES, tokenizer_file

DOCS = "doc_id long, text string"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sa", "te") for b in ("ra", "so", "tin", "vel", "n", "mmo", "st")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    long = " ".join(f"w{i}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "some text without an id"), (None, "some text without an id"), (4, long), (4, long), (5, "x")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(120)]
    for i in range(120, 160):  # near-copies of a few, with some words replaced
        words = rows[i % 7][1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows + [(160, "one two"), (161, "One TWO"), (162, ""), (163, None), (164, "one")]


# ---- 1 chat


def test_chat_round_trip_and_masks(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be#<kind>"), (2, None, None, None), (2, 5, "a:b\n<again>", "\\")]
    rows += [(1, i, "assistant" if i % 2 == 0 else "user", "text %d " % i * (i % 9)) for i in range(1, 60)]
    rows += [(1, 3, "user", "text 3 " * 3), (3, 1, "assistant", "w" * 9_000), (None, 1, "user", "no id")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_conversations(df, budget=120, history=2, history_tokens=40)
    assert windows.filter("n_tokens > 120 and n_turns > 1").count() == 0
    first, *later = windows.filter("conv_id = 1").orderBy("window").collect()
    assert later and all(chat.read_back(w["formatted"])[0] == ("system", True, "be#<kind>") for w in later)
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want, c
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_windows_do_not_depend_on_length(spark, monkeypatch):
    """A conversation is cut alike in one task and as a long one, whose turns are dealt out by window."""
    rng = random.Random(12)
    rows = [(c, None if i % 29 == 5 else i, rng.choice(["user", "assistant", "system"] if i else ["user"]), prose(rng, rng.randint(0, 60))) for c in (1, 2, None) for i in range(90)]
    rows += [(3, i, "user", f"t{i}") for i in range(3)] + rows[:4]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    how = {"budget": 150, "history": 3, "history_tokens": 60}
    whole = sorted(map(repr, chat.format_conversations(df, **how).collect()))
    monkeypatch.setattr(chat, "LONG", 7)
    assert sorted(map(repr, chat.format_conversations(df, **how).collect())) == whole and len(whole) > 30
    for w in chat.format_conversations(df, **how).filter("conv_id = 1 and window > 2").collect():
        turns = chat.read_back(w["formatted"])
        assert turns[0][:2] == ("system", True) and sum(again for _, again, _ in turns) == w["n_again"] <= 4


# ---- 2 near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, corpus, size, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)  # groups are dealt out in several blocks
    got = neardup.near_duplicates(spark.createDataFrame(corpus, DOCS), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(corpus, size, percent)


def test_near_duplicates_between_blocks(spark, monkeypatch):
    """Chains whose ends aren't like their group's first document, across many blocks; copies of the first need no second pass."""
    left, between = [], neardup._between
    monkeypatch.setattr(neardup, "_between", lambda *x: left.append(between(*x)) or left[-1])
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    words = [f"w{i}" for i in range(400)]
    chain = [(100 + i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)]
    for rows, passes in ((chain, True), ([(i, " ".join([*words[:100], f"x{i}"])) for i in range(20)], False)):
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows, 3, 85)
        assert (left[-1] is not None) == passes


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame(edge_rows(), DOCS).withColumn("component_id", F.lit("clash"))
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 8 and all(r["kept"] for r in got)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {n: n for n in itertools.chain.from_iterable(x for x in links if None not in x and x[0] != x[1])}
    for _ in range(100):
        for a, b in links:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


# ---- 3 language


def test_language_held_out_and_edges(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "αβγδε"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(6)) for _ in range(30)), k) for i in range(90) for k in alphabets]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id % 3 <> 1"))
    out = langid.predict(df.filter("doc_id % 3 = 1"), model)
    assert out.filter("lang = lang_pred").count() == 90 and out.filter("score < 0 or score > 1").count() == 0
    edges = langid.predict(spark.createDataFrame([*edge_rows(), (9, "123 !?")], DOCS).withColumn("score", F.lit("clash")), model).collect()
    assert [r["lang_pred"] for r in edges if not re.search("[a-z]", r["text"] or "")] == ["und"] * 4
    assert langid.train(df.limit(0)) == {} and langid.predict(df, {}).filter("lang_pred = 'und'").count() == df.count()


# ---- 4 licenses


def test_licenses_match_brute_force(spark, corpus):
    rng = random.Random(3)
    notes = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = [(i, f"{prose(rng, 40)}\n{rng.choice(notes)}\n{prose(rng, 20)}") for i in range(60)] + [(100 + i, t) for i, t in corpus] + edge_rows()
    for i in range(200, 230):  # a long notice with a word replaced
        words = notes[1].split()
        words[rng.randrange(len(words))] = "replaced"
        rows.append((i + 100, prose(rng, 9) + " " + " ".join(words)))
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: set(zip(w, w[1:], w[2:]))
    want = {(i, n) for i, t in rows for n, ts in licenses.TEMPLATES.items() for x in ts if len(grams(tokens(x)) & grams(tokens(t))) >= 0.8 * len(grams(tokens(x)))}
    df = spark.createDataFrame(rows, DOCS).withColumn("license", F.lit("clash"))
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()} == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_damaged_licenses_are_all_found(spark):
    """Every template cut at either end, with words replaced, left out and put in, at the start, the end and inside of texts."""
    rng = random.Random(13)
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: set(zip(w, w[1:], w[2:]))
    rows = []
    for name, texts in licenses.TEMPLATES.items():
        for note in texts:
            whole = tokens(note)
            for n in range(24):
                words, some = list(whole), max(1, len(whole) // 20)
                for _ in range(rng.randint(1, some)):
                    at, kind = rng.randrange(len(words)), n % 5
                    if kind == 0:
                        words.pop(0)
                    elif kind == 1:
                        words.pop()
                    elif kind == 2:
                        words[at] = "replaced"
                    elif kind == 3:
                        words.insert(at, "inserted")
                    else:
                        del words[at]
                before, after = prose(rng, 12 * (n % 3 > 0)), prose(rng, 12 * (n % 4 > 1))
                rows.append((len(rows), f"{before} {' '.join(words)} {after}".strip()))
    want = {(i, n) for i, t in rows for n, ts in licenses.TEMPLATES.items() for x in ts if len(grams(tokens(x)) & grams(tokens(t))) >= 0.8 * len(grams(tokens(x)))}
    assert len(rows) > 450 and len(want) > 300
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_licenses_without_broadcasts(spark, monkeypatch):
    rows = [(i, f"{prose(random.Random(i), 20)} {ts[0]}") for i, ts in enumerate(licenses.TEMPLATES.values())]
    df = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 10)
    monkeypatch.setattr(licenses, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, licenses.scan(df).collect())) == whole and len(whole) >= len(licenses.TEMPLATES)


# ---- 5 toxicity


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = prose(rng, 80).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zwurgling", "kwaxxelig", "plompforth"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.filter("doc_id < 400").select("doc_id", "toxic"))
    out = toxicity.score(df.filter("doc_id >= 400"), model)
    assert out.filter("predicted = toxic").count() >= 190
    edges = toxicity.score(spark.createDataFrame(edge_rows(), DOCS), model).collect()
    assert len(edges) == 8 and all(0 <= r["score"] <= 1 for r in edges) and not any(r["predicted"] for r in edges if not (r["text"] or "").strip())
    empty = toxicity.train(df.limit(0), df.limit(0))
    assert toxicity.score(df.limit(3), empty).count() == 3


# ---- 6 pages


def test_page_text():
    html = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>site</header>
    <nav><ul><li><a>x</a></li></ul></nav><div class="cookie-notice">c</div><!-- <p>no</p> --><article><h1>A &amp; B</h1><p><b>one
    two.<br><p>three&nbsp;four</p><ul><li>i<li>j</ul><div class="ad">buy</div><form>f</form></article><section id="comments"><article>reader</article></section>
    <aside>side</aside><footer>&copy; me</footer>"""
    top = pages.tree(html)
    assert [b for r in pages.roots(top) for b in pages.blocks(r, frozenset())] == ["A & B", "one two.", "three four", "i", "j"]


def test_site_templates_go_and_content_stays(spark):
    page = "<body><div><p>Our site</p></div><div><p>{0} own words</p><p>{0} more</p></div><section><p>Call us</p></section></body>"
    rows = [(i, f"https://a.example/{i}", page.format(f"page{i}")) for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", f"<article><p>same passage</p><p>own {i}</p><div>share me</div></article>") for i in range(6)]
    rows += [(20, None, "<p>no host</p>"), (21, "https://c.example/", None), (22, "https://c.example/", ""), (23, "x", "<<p>a < b</p"), (23, "x", "<<p>a < b</p")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got[3] == "page3 own words\npage3 more" and got[12] == "same passage\nown 2"
    assert (got[20], got[21], got[22]) == ("no host", "", "")
    assert pages.extract(df).count() == len(rows) and pages.extract(df.limit(0)).count() == 0


def test_containers_on_few_pages_of_a_large_host_go(spark):
    html = "<body><div>own words {0}</div>{1}<table><tr><td>cell</td><td>{0}</td></tr></table></body>"
    extra = {**dict.fromkeys(range(6), "<div>Call us</div>"), **dict.fromkeys((10, 11), "<div>Both of us</div>"), **dict.fromkeys(range(12, 16), "<p>So it is.</p>")}
    rows = [(i, f"https://a.example/{i}", html.format(f"n{i}", extra.get(i, ""))) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own words n{i}\nn{i}" for i in range(10))  # the block is on a tenth of the pages, the cell on all
    assert got[10] == "own words n10\nBoth of us\nn10" and got[12] == "own words n12\nSo it is.\nn12"


# ---- 7 tokens


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokenizer_file()), random.Random(6)
    letters = " abcdeéß中\n\t'stre10.#\x1c\x85😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [rng.choice("abAZ=- é") * rng.randint(1, 400) for _ in range(40)] + ["a<|endoftext|>b <|endoftext|>", "", None, "don't   stop  \n"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("decoded", F.lit(1))
    for r in bpe.round_trip(df, tokenizer_file()).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == want, r["text"]
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    both = bpe.decode(bpe.encode(df.drop("decoded"), tokenizer_file()), tokenizer_file())
    assert both.filter("decoded <> coalesce(text, '')").count() == 0
    assert bpe.round_trip(df.limit(0), tokenizer_file()).count() == 0


# ---- 8 quality


def test_quality_counts_match_brute_force(spark, corpus):
    rows = [*corpus, *[(500 + n, t) for n, (_, t) in enumerate(edge_rows())], (600, "a b c a b c d\nx\nx\n\n x\n#|"), (601, "a a a a"), (602, "é ü b")]
    field = quality.Field(np.zeros(quality.FEATURES), np.zeros((2, 2)), np.zeros(2))
    for r in quality.judge(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")), field).collect():
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_viterbi_and_training():
    rng = np.random.default_rng(1)
    for _ in range(50):
        field = quality.Field(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(rng.integers(1, 7), quality.FEATURES))
        value = lambda y: field.first[y[0]] + sum(field.pairs[a, b] for a, b in zip(y, y[1:])) + sum((x[i] @ field.lines) * y[i] for i in range(len(y)))
        best = max(itertools.product((0, 1), repeat=len(x)), key=value)
        assert value(tuple(quality.viterbi(field, x))) == pytest.approx(value(best))
    r = random.Random(2)
    good = ["\n".join(prose(r, 12).capitalize() + "." for _ in range(5)) for _ in range(60)]
    bad = ["\n".join(" | ".join(prose(r, 6).split()) for _ in range(5)) for _ in range(60)]
    field = quality.fit(good[:40], bad[:40])
    marks = lambda t: quality.viterbi(field, quality.line_features(t)[0]).mean()
    assert min(map(marks, good[40:])) > 0.5 > max(map(marks, bad[40:]))


# ---- 9 decontamination


def brute_overlaps(docs, items, window=16, share=0.8):
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for (i, t), (j, u) in itertools.product(docs, items):
        a, b = tokens(t), tokens(u)
        if len(b) < 6:
            continue
        n, best = min(window, len(b)), 0
        for d in range(-len(b), len(a)):
            same = [0 <= q + d < len(a) and a[q + d] == b[q] for q in range(len(b))]
            best = max(best, *(sum(same[s : s + n]) for s in range(len(b) - n + 1)))
        if best >= share * n - 1e-9:
            out[i, j] = best
    return out


@pytest.mark.parametrize("limit", [500_000, 1])  # broadcast, and the shuffled way
def test_decontamination_matches_brute_force(spark, corpus, limit):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(6, 40))) for i in range(8)] + [(90, "too short"), (91, None), (92, "")]
    rows = corpus[:40] + [(1, None), (2, ""), (5, "x")]
    for i in range(300, 330):
        words = rng.choice(items[:8])[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "replaced"
        rows.append((i, f"{prose(rng, 20)} {' '.join(words)} {prose(rng, 9)}"))
    docs, tests = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps([r for r in rows if r[0] >= 6], items)
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.overlaps(docs.filter("doc_id >= 6"), tests, broadcast_rows=limit).collect()}
    assert got == want and want
    kept = decontam.decontaminate(docs, tests, broadcast_rows=limit)
    assert kept.count() == len(rows) - len([1 for i, _ in rows if i in {k for k, _ in brute_overlaps(rows, items)}])
    assert decontam.overlaps(docs.limit(0), tests).count() == 0 == decontam.overlaps(docs, tests.limit(0)).count()


# ---- 10 lines


def test_line_templates(spark):
    passage = prose(random.Random(8), 60)
    rows = [
        (1, f"{passage}\nown line of the first one"), (2, f"{passage}\nown line of the second document here"), (3, "Page 1 of 9 in this book\nx y z"), (4, "Page 22 of 9 in this book"),
        (5, "user alpha logged in from the main desk today"), (6, "user bravo logged in from the main desk today\nrest"), (7, None), (8, ""), (None, passage), (9, "\n \n"),
        (11, "the job x failed on host alpha with code red"), (12, "the job x failed on host bravo with code red"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()}
    assert got[1] == (rows[0][1], 2, 0) and got[2] == ("own line of the second document here", 2, 1)
    assert got[3][2] == 0 and got[4] == ("", 1, 1) and got[None] == ("", 1, 1)
    assert got[7] == (None, 0, 0) and got[8] == ("", 0, 0) and got[9] == ("\n \n", 0, 0)
    assert got[11][2] == 0 and got[12] == ("", 1, 1)  # one leaf, one token of nine differs
    assert got[5][2] == 0 and got[6][2] == 0  # they differ in a leading token, so they are in different leaves
    assert linededup.dedup_lines(df, min_docs=3).filter("doc_id = 4").first()["n_dropped"] == 0
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_generalised_templates():
    a, b, c = "job x y failed on host alpha with code red", "job x y failed on host bravo with code red", "job x y was a quite different line it seems"
    assert linededup.generalise([a, b, c], 0.8) == [0, 0, 2]


def test_crowded_leaves_are_compared_whole(spark):
    words = [f"{a}{b}" for a in WORDS for b in WORDS[:13]]
    rows = [(i, f"the job x failed on host {w}") for i, w in enumerate(words)]
    rows += [(1_000 + i, f"the job x {w} was done {'well' if i % 2 else 'badly'} by all of us here") for i, w in enumerate(words)]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(set(words)) > 600 and {i for i, n in got.items() if n == 0} == {0, 1_000}


def brute_templates(lines, similarity):
    templates, founders, out = [], [], []
    for at, row in enumerate(line.split(" ") for line in lines):
        same = [sum(a == b for a, b in zip(t, row)) / len(row) for t in templates]
        best = max(range(len(same)), key=lambda i: (same[i], -i), default=-1)
        if best >= 0 and same[best] >= similarity - 1e-9:
            templates[best] = [a if a == b else "<*>" for a, b in zip(templates[best], row)]
            out.append(founders[best])
        else:
            templates.append(row)
            founders.append(at)
            out.append(at)
    return out


@pytest.mark.parametrize("width", [4, 5, 7, 10, 15, 23])
def test_indexed_templates_match_brute_force(width):
    for seed in range(3):
        rng = random.Random(100 * width + seed)
        bases = [[rng.choice([*WORDS[:12], "<*>"]) for _ in range(width)] for _ in range(60)]
        lines = [" ".join(w if rng.random() < 0.85 else rng.choice([*WORDS, "<*>"]) for w in rng.choice(bases)) for _ in range(700)]
        found = linededup.generalise(lines, 0.8)
        assert found == brute_templates(lines, 0.8) and len(set(found)) > linededup.INDEXED // 2


# ---- pipeline and registration


def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in corpus]
    item = prose(rng, 30)
    rows.append((900, f"{prose(rng, 50)} {item} {prose(rng, 10)}", "aa", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{n}"))
        docs = spark.read.parquet(str(tmp_path / f"{n}"))
        gone = before - {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert gone == {162, 163}
        if name == "near_copies":
            kept = brute_components([(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / f"{n - 1}")).collect()], 5, 80)
            assert gone == {i for i, (_, _, k) in kept.items() if not k}
        if name == "benchmark":
            assert gone == {900}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.filter("not round_trip").count() == 0


def test_all_thirteen_are_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(n) for n in range(1, 14)}
