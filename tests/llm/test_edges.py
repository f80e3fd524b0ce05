"""Partitions without rows, tables of nulls, clashing columns, long texts, and plain versions of the trained and parsed operators."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fidelis.llm import bpe, chat, decontam, langid, licenses, linededup, neardup, pages, quality, toxicity
from fidelis.llm.common import bounded, join_skewed
from fidelis.llm.queries import QUERIES, tokenizer_file

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sa", "te") for b in ("ra", "so", "tin", "vel", "n", "mmo", "st")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def save(spark, df, path, name):
    df.repartition(3).write.parquet(f"{path}/{name}.parquet")


def tables(spark, path, kind):
    """The tables: "some" has partitions that the labels' and folds' filters empty, "nulls" only nulls but for a key, "none" no rows."""
    rng = random.Random(7)
    docs = [(i, prose(rng, 60) + "\n" + prose(rng, 9), "aa", "s", 1) for i in range(4)] + [(50, None, None, None, None)]
    rows = {
        "documents": (docs, DOCUMENTS), "labels": ([(0, 1, 0), (1, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, prose(rng, 20)), (2, docs[0][1][:200])], "item_id long, text string"),
        "pages": ([(i, f"https://a.example/{i}", f"<body><p>own {i}</p></body>") for i in range(3)], "page_id long, url string, html string"),
        "conversations": ([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string"),
        "embeddings": ([(i, [i / 8] * 64) for i in range(3)], "vec_id long, embedding array<float>"),
    }
    for name, (found, schema) in rows.items():
        if kind == "none":
            found = []
        elif kind == "nulls":
            found = [tuple([None] * len(found[0]))] * 3
        df = spark.createDataFrame(found, schema)
        # A file of its own for each row, and one without rows.
        df.repartition(max(1, len(found)) + 1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("kind", ["some", "nulls", "none"])
def test_every_query_on_empty_partitions(spark, tmp_path, kind):
    sf = tables(spark, tmp_path, kind)
    n_docs, n_pages = (5, 3) if kind == "some" else (3, 3) if kind == "nulls" else (0, 0)
    for name, query in QUERIES.items():
        rows = query(spark, sf).collect()
        if name.startswith(("op2_", "op3_", "op5_", "op7_", "op8_", "op10_", "op13_")):
            assert len(rows) == n_docs, name
        elif name.startswith("op11_"):
            assert len(rows) == (3 if kind == "some" else 0)
        elif name.startswith("op12_"):
            assert len(rows) == 600 * {"some": 2, "nulls": 1, "none": 0}[kind]
        elif name.startswith("op6_"):
            assert len(rows) == n_pages
        elif name.startswith("op1_"):
            assert [r["n_turns"] for r in rows if r["conv_id"] == -7] == [2]
    assert kind != "some" or {r["doc_id"] for r in QUERIES["op9_spaced_seeds"](spark, sf).collect()} == {0}


@pytest.mark.parametrize("kind", ["some", "nulls", "none"])
def test_every_stage_on_empty_partitions(spark, tmp_path, kind):
    import corpus_pipeline

    sf = tables(spark, tmp_path, kind)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:  # each on the table as it is, with a column that clashes
        clash = docs.withColumns({c: F.lit("clash") for c in ("score", "kept", "component_id", "n_lines", "text_hash", "token_ids", "id", "hash")})
        out = stage(spark, clash, sf)
        assert out.columns[:5] == corpus_pipeline.COLUMNS and (name == "tokens" or out.columns == corpus_pipeline.COLUMNS)
        before = out.count()
        assert before <= docs.count() and (name == "language" or kind == "some" or before == docs.count()), name
        # Rows without an id are judged like any other.
        assert stage(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), sf).count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).count() == (0 if kind != "some" else 3)  # doc 0 holds a benchmark item


def test_every_stage_on_very_long_texts(spark, tmp_path):
    """Each stage on texts of up to 200,000 words, alike but for a few, one of which holds a benchmark item at its end."""
    import corpus_pipeline

    rng = random.Random(9)
    item = prose(rng, 40)
    lines = ["\n".join(prose(rng, 19) for _ in range(n)) for n in (10_000, 500, 500)]
    texts = [lines[0], lines[0] + "\nand one more line of its own", lines[1], lines[2] + "\n" + item, "short text here"]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    save(spark, spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = {r["doc_id"]: r for r in stage(spark, docs, str(tmp_path)).collect()}
    assert set(kept["language"]) == {0, 1, 2, 3, 4} == set(kept["tokens"]) and set(kept["near_copies"]) == {0, 2, 3, 4} and set(kept["benchmark"]) == {0, 1, 2, 4}
    assert kept["lines"][0]["text"] == texts[0] and kept["lines"][1]["text"] == "and one more line of its own"
    assert all(r["round_trip"] and r["n_tokens"] > 0 for r in kept["tokens"].values())


def test_helpers_join_and_broadcast(spark):
    many = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 9)], "k long, v long")
    one = many.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 5").withColumn("w", F.col("k") * 10)
    want = Counter((r["k"], r["v"], r["k"] * 10) for r in many.collect() if r["k"] != 5)
    assert Counter(tuple(r) for r in join_skewed(many, one, ["k"], "n").collect()) == want
    assert Counter(tuple(r) for r in join_skewed(many, one, ["k"], "n", "left").collect()) == want + Counter([(5, 0, None)])
    assert "broadcast" in bounded(one, 10)._jdf.queryExecution().toString().lower() and bounded(one, 3) is one


# ---- 3 language: the prototypes and cosines worked out letter by letter


def test_language_equals_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice({"x": "αβγδ ε", "y": "abcd e", "z": "bcde f"}[k]) * 3 + rng.choice("abγ") for _ in range(20)), k) for i in range(8) for k in "xyz"]
    rows += [(90, "12 ..", "x"), (91, None, "y"), (92, "abc abc", None)]

    def letter(c):
        return np.random.default_rng(ord(c) + 1).integers(0, 2, langid.DIMENSIONS, np.int8).astype(np.int64) * 2 - 1

    def bundle(text):
        cut = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        grams = [cut[i : i + langid.ORDER] for i in range(len(cut) - langid.ORDER + 1)] if cut.strip() else []
        return sum((np.prod([np.roll(letter(c), n) for n, c in enumerate(g)], axis=0) for g in grams), np.zeros(langid.DIMENSIONS, np.int64))

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    plain = {k: sum(unit(bundle(t)) for _, t, lang in rows if lang == k) for k in "xyz"}
    assert set(model) == set(plain) and all(float(unit(model[k]) @ unit(plain[k])) > 1 - 1e-9 for k in plain)
    middle = sum(unit(v) for v in plain.values()) / 3
    for r in langid.predict(df, model).collect():
        v = bundle(r["text"])
        cosines = {k: unit(unit(p) - middle) @ unit(unit(v) - middle) for k, p in plain.items()}
        want = max(sorted(cosines), key=cosines.get) if v.any() else "und"
        assert r["lang_pred"] == want and (want == "und" or r["score"] == pytest.approx(1 / sum(math.exp((c - cosines[want]) / langid.TEMPERATURE) for c in cosines.values()), rel=1e-4))


# ---- 5 toxicity: every window compressed by itself, without the operator's compressors


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(4)
    bad = lambda: rng.choice(["zwurgling", "kwaxxelig", "plompforth"])
    texts = [" ".join(w for k in range(60) for w in [rng.choice(WORDS)] + ([bad()] if i % 4 == 0 and k % 15 == 3 else [])) for i in range(200)]
    model = toxicity.fit([t for i, t in enumerate(texts) if i % 4 == 0], [t for i, t in enumerate(texts) if i % 4])
    assert all(w.encode() in model.toxic for w in ("zwurgling", "kwaxxelig", "plompforth"))

    def length(content, window):
        how = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, window_log=18, hash_log=toxicity.TABLE, chain_log=toxicity.TABLE, min_match=toxicity.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(window))

    some = texts[:6] + ["", "a", "zwurgling " * 3]
    got = toxicity.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    for r in got:
        words = r["text"].lower().split()
        starts = range(0, max(len(words) - toxicity.WINDOW + toxicity.STEP, 1), toxicity.STEP) if words else []
        cut = [(" " + " ".join(words[a : a + toxicity.WINDOW]) + " ").encode() for a in starts]
        saved = [length(model.ordinary or b" " * 8, w) - length(model.ordinary + model.toxic, w) for w in cut]
        sure = sum(s for s in saved if s >= model.window) / (len(saved) + toxicity.SMOOTHING)
        assert r["score"] == pytest.approx(sure / (sure + model.document)) and r["predicted"] == (r["score"] >= 0.5)
    assert [r["predicted"] for r in got[:6]] == [1, 0, 0, 0, 1, 0]


def test_toxicity_uses_whole_texts():
    rng = random.Random(5)
    ordinary = [prose(rng, 40) for _ in range(80)]
    toxic = [prose(rng, 700) + " zwurgling " + prose(rng, 3) + " zwurgling " + prose(rng, 3) for _ in range(40)]  # the marks come last
    model = toxicity.fit(toxic, ordinary)
    scorer = toxicity.Scorer(model)
    marked = lambda n: " ".join(f"{prose(rng, 300)} zwurgling and {prose(rng, 3)} zwurgling" for _ in range(n))
    assert scorer.score(prose(rng, 3_000) + " " + marked(10)) >= 0.5 > scorer.score(prose(rng, 300))  # none in the first 3,000 words
    assert scorer.score(prose(rng, 20_000) + " zwurgling") > 0


def test_copies_do_not_make_words_common():
    text = prose(random.Random(6), 90) + " plompforth " + prose(random.Random(7), 90)
    copies = [text.replace(" ", f" n{i} ", 1) + f" tail{i}" for i in range(50)]
    assert toxicity.counted(copies)[" plomp"] == 1 and toxicity.counted([f"a{i} zwurg b{i}" for i in range(50)])[" zwurg"] == 50


# ---- 6 pages: subtrees counted per host by a plain version


def plain_texts(rows, min_pages=3, share=0.3):
    host = lambda url: m[1].lower() if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")) else None
    text = lambda top, gone: "\n".join(b for r in pages.roots(top, gone) for b in pages.blocks(r, gone))
    seen, sizes, trees = defaultdict(set), defaultdict(set), []
    for page, url, html in rows:
        top = pages.tree(html or "")
        pages.sign(top)
        trees.append((page, host(url), top))
        if host(url) and html is not None:
            own = text(top, frozenset())
            sizes[host(url)].add(own)
            for passage, found in enumerate(pages.containers(top)):
                for sign in found:
                    seen[host(url), sign, passage].add(own)
    template = defaultdict(set)
    for (h, sign, passage), found in seen.items():
        if len(found) >= min_pages and (not passage or len(found) >= share * len(sizes[h])):
            template[h].add(sign)
    return {page: text(top, frozenset(template[h])) for page, h, top in trees}


def test_site_templates_equal_a_plain_version(spark):
    rng = random.Random(6)
    chrome = [f"<div class=c{k}><ul><li>{prose(rng, 2)}<li>{prose(rng, 1)}</ul></div>" for k in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(chrome) for _ in range(rng.randint(0, 3))] + [f"<p>{prose(rng, rng.randint(1, 2))}</p>" for _ in range(2)]
        rng.shuffle(parts)
        body = f"<article><h2>{prose(rng, 3)}</h2><p>Same words.</p>{''.join(parts[:2])}</article>" if i % 3 else ""
        rows.append((i, f"https://h{i % 3}.example/{i}", f"<html><body>{body}{''.join(parts)}</body></html>"))
    rows += [(200, "https://h0.example/x", None), (201, None, "<p>alone</p>"), (202, "https://h1.example/y", rows[1][2])]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = plain_texts(rows)
    assert got == want and got != plain_texts(rows, min_pages=10_000)


def test_templates_with_neutral_names_go(spark):
    """Nothing says what it is: only recurrence can tell, inside the article too, and teasers of other articles go."""
    page = "<body><div class=x1><a>Home</a><a>Shop</a></div><article><h1>Title {0}</h1><p>Text of {0}.</p><div class=x2><span>Read this next</span></div></article><article><p>Teaser everywhere</p></article><div class=x3>Made by us</div></body>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda d: {r["page_id"]: r["text"] for r in d.collect()}
    assert texts(pages.extract(df)) == {i: f"Title {i}\nText of {i}." for i in range(5)}
    off = texts(pages.extract(df, min_pages=10_000))
    assert all("Read this next" in t and "Teaser" in t for t in off.values())


def test_only_named_parts_go():
    text = lambda html: [b for r in pages.roots(pages.tree(html)) for b in pages.blocks(r, frozenset())]
    assert text("<form action=x><nav>menu</nav><article><p>in a form</p></article></form>") == ["in a form"]
    assert text('<article><p class="market-share">kept</p><div class="social-science">also</div><div class="ad box">gone</div><p class="notice">gone</p></article>') == ["kept", "also"]
    assert text("<div><form><p>gone</p></form><p>stays</p></div>") == ["stays"]
    long = "<article>" + "<p>word word</p>" * 20_000 + "<div>" * 3_000 + "deep" + "</article>"
    assert len(text(long)) == 20_001


# ---- 7 tokens


def test_one_very_long_word():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    word = "".join(rng.choice("abcdeé") for _ in range(60_000))
    coder = bpe.Coder(bpe.read_vocabulary(tokenizer_file()))
    assert np.frombuffer(coder.encode([word])[0], "<u4").tolist() == Tokenizer.from_file(tokenizer_file()).encode(word, add_special_tokens=False).ids


# ---- 8 quality


def test_boilerplate_within_documents_is_marked():
    rng = random.Random(2)
    line = lambda: prose(rng, 12).capitalize() + "."
    junk = lambda: " | ".join(prose(rng, 8).split())
    good = ["\n".join([line() for _ in range(rng.randint(4, 70))] + [junk()] * (i % 5 == 0)) for i in range(60)]
    bad = ["\n".join([line() for _ in range(3)] + [junk() for _ in range(rng.randint(4, 90))]) for _ in range(60)]
    field = quality.fit(good, bad)
    mixed = "\n".join([line(), line(), junk(), junk(), junk(), line(), line()])
    assert quality.viterbi(field, quality.line_features(mixed)[0]).tolist() == [1, 1, 0, 0, 0, 1, 1]
    assert 0.05 < field.share < 0.95


# ---- 9 decontamination


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16])
def test_masks_cover_every_replacement(n):
    """Wherever a fifth of the tokens is replaced, some mask of that length sees only tokens that are left."""
    for gone in itertools.combinations(range(n), n // 5):
        left = [k not in gone for k in range(n)]
        masks = decontam.MASKS if n >= 16 else (decontam.short_mask(n),)
        assert any(all(left[at + k] for k, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)), (n, gone)


def test_short_items_are_found(spark):
    rng = random.Random(9)
    items = [(n, " ".join(f"t{n}x{k}" for k in range(n))) for n in range(1, 20)]
    rows, want = [], set()
    for n, text in items:
        for k, gone in enumerate([0, n // 5, n // 5 + 1]):
            words = text.split()
            for at in rng.sample(range(n), min(n, gone)):
                words[at] = "replaced"
            rows.append((100 * n + k, f"{prose(rng, 5)} {' '.join(words)} {prose(rng, 5)}"))
            if n - min(n, gone) >= 0.8 * min(n, 16) - 1e-9 and n <= 16:
                want.add((100 * n + k, n))
    found = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert {g for g in got if g[1] <= 16} == want and all((100 * n, n) in got for n in range(1, 20))


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(10)
    item = prose(rng, 30)
    text = prose(rng, 60_000) + " " + item + " " + prose(rng, 60_000)
    df = spark.createDataFrame([(1, text), (1, text), (2, "no")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "id", "hash", "item", "q", "text_hash")})
    tests = spark.createDataFrame([(7, item, "clash")], "item_id long, text string, doc_id string")
    assert [(r["doc_id"], r["item_id"], r["matched"], r["doc_at"]) for r in decontam.overlaps(df, tests).collect()] == [(1, 7, 16, 60_000)]
    assert [r["doc_id"] for r in decontam.decontaminate(df, tests).collect()] == [2]


# ---- 10 lines: the tree parsed by a plain version


def test_line_dedup_equals_a_plain_version(spark):
    rng = random.Random(13)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([1, 3, 6, 11]))] for _ in range(25)]
    line = lambda: " ".join(w if rng.random() < 0.93 else rng.choice([*WORDS, "7", "x9"]) for w in rng.choice(bases))
    rows = [(rng.choice([i, i, None]) if i % 9 == 0 else i, "\n".join(line() if rng.random() < 0.9 else rng.choice(["", "1 2 3", "4 5 6", " "]) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += rows[:5] + [(900, None), (901, " ".join(WORDS * 2_000)), (902, " ".join(WORDS * 2_000))]
    marks, leaves = defaultdict(list), defaultdict(dict)
    for at, (doc, text) in enumerate(rows):
        for k, words in enumerate((text or "").split("\n")):
            if found := linededup.parse(words):
                marks[found[1:3]].append((at, k))
                leaves[found[3]][found[1:3]] = [w.decode() for w in found[0]]
    founder = {}
    for lines in leaves.values():
        templates = []
        for digest, words in sorted(lines.items()):
            allowed = len(words) - math.ceil(0.8 * len(words) - 1e-9)
            same = [sum(a == b for a, b in zip(t, words)) for t, _ in templates]
            best = max(range(len(same)), key=lambda i: (same[i], -i), default=None)
            if best is not None and len(templates[best][0]) == len(words) and same[best] >= len(words) - allowed:
                templates[best] = ([a if a == b else "<*>" for a, b in zip(templates[best][0], words)], templates[best][1])
            else:
                templates.append((words, digest))
                best = -1
            founder[digest] = templates[best][1]
    # A row without an id is a document of its own text, after all others.
    name = lambda at: (rows[at][0] is None, rows[at][0] if rows[at][0] is not None else rows[at][1])
    where = defaultdict(list)
    for digest, places in marks.items():
        where[founder[digest]] += places
    dropped = defaultdict(set)
    for places in where.values():
        docs = {name(at) for at, _ in places}
        if len(docs) > 1 and not (unsure := {d for d in docs if d[0]} == docs):
            for at, k in places:
                if name(at) != min(d for d in docs if not d[0]):
                    dropped[at].add(k)
    got = Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter((doc, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in dropped[at])) for at, (doc, text) in enumerate(rows))
    named = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None})
    assert named(got) == named(want) and sum(got.values()) == len(rows)


def test_lines_of_numbers_only_repeat_as_they_are(spark):
    rows = [(1, "12 34 56\n7"), (2, "12 34 57\n8"), (3, "12 34 56\n9")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "12 34 56\n7", 2: "12 34 57\n8", 3: "9"}
