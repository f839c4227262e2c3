"""Each operator against brute force, and on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from orderlens.llm import coder, common, embeddings, graph, langid, licenses, mixing, pieces, search, shingles, tokenfiles, tokens, warc

LONG = "alpha beta, gamma. " * 4000
PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house near the river bend"
TEXTS = [
    (1, PASSAGE), (2, PASSAGE), (3, PASSAGE + " today"), (4, "An MIT License here, and the Apache License."), (5, ""), (6, None), (None, "no id at all"), (7, "  \t\n "),
    (8, LONG), (9, "GNU General Public  License; general public license."), (9, "GNU General Public  License; general public license."), (10, "日本語 é ▁ text \x00 end"),
    (50, "quick brown fox river"), (100, "stone house near the river"), (11, "x" * 5000), (12, PASSAGE.replace("quick", "slow").replace("river", "lake")),
]


def docs_of(spark, rows=TEXTS):
    """Documents with extra columns whose names operators use inside."""
    full = [(i, t, ["en", "de", None][k % 3], [None, "a", "b", "a"][k % 4], 7, "z", 1.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, row int, key string, position double")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs_of(spark).repartition(3, "doc_id", "text").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_row_numbers_are_the_same_in_every_scan(spark, docs, empty):
    """Whatever the splits, files and columns; also for tables that aren't scans, and with names that clash."""
    def numbers(df):
        own, row = common.row_numbered(df)
        return {(r[row], r["doc_id"], r["text"]) for r in own.collect()}

    once = numbers(docs)
    assert len({x[0] for x in once}) == docs.count() and len(docs.inputFiles()) > 1
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert numbers(docs.select("text", "doc_id")) == once
        assert numbers(docs.filter("doc_id > 5")) < once
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
    clash = docs_of(spark).withColumn("__orderlens_row", F.lit(1)).withColumn("_metadata", F.lit("x"))
    own, row = common.row_numbered(clash)
    assert own.columns[:-1] == clash.columns and own.select(row).distinct().count() == len(TEXTS)
    assert numbers(empty) == set()
    assert mixing.curriculum(clash).columns == shingles.distinct_documents(clash).columns == clash.columns


# --- 1

def brute_mix(items):
    """Targets by resharing until nothing changes; items of (doc_id, source, text)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in items]
    total = defaultdict(int)
    for (_, s, _), n in zip(items, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        goal = {s: 2.0 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if goal[s] > 2 * total[s] + 1e-9}
        if not over:
            return size, dict(total), goal
        capped |= over


def test_mixing_targets_and_taken(docs):
    items = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    size, total, goal = brute_mix(items)
    out = mixing.mixed(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in out) == Counter((d, n, total[s], round(goal[s], 6)) for (d, s, _), n in zip(items, size, strict=True))
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (_, target), n in taken.items():
        assert abs(n - target) < 1 + 1e-6
    placed = [r["position"] for r in out if r["position"] is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)
    assert sorted(map(str, rows(mixing.mixed(docs)))) == sorted(map(str, map(tuple, out)))


def test_mixing_curriculum_keeps_columns(docs, empty):
    assert mixing.curriculum(docs).columns == docs.columns
    assert mixing.mixed(empty).count() == 0
    passes = Counter(r["text"] for r in mixing.curriculum(docs).collect())
    want = Counter()
    for r in mixing.mixed(docs, "text").collect():
        want[r["text"]] += (r["position"] is not None) + (r["again_at"] is not None)
    assert passes == +want


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_schedule_integral_is_inverted(spark, kind):
    knots = mixing.SCHEDULES[kind]
    got = spark.range(0, 21).select((F.col("id") / 20.0).alias("x"), F.lit(kind).alias("k")).select("x", F.expr(mixing.time_sql("x", "k")).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*knots, strict=True))
    share = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    share /= share[-1]
    for x, t in got:
        assert abs(np.interp(t, grid, share) - x) < 1e-6


# --- 2

def test_language_evidence(spark):
    words = {"en": "the house and tree with water of", "de": "der baum und das haus mit wasser"}
    rng = np.random.default_rng(1)
    made = [(i, " ".join(rng.choice(words[l].split(), 30)), l) for i, l in enumerate(["en", "de"] * 60)]
    model = langid.fitted(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    page = lambda lang, text, attr: f'<html lang="{attr}"><script>der das und</script><p>{text}</p></html>'
    pages = [(i, f"http://{l}.example.{'de' if l == 'de' else 'org'}/x", page(l, t, l)) for i, t, l in made]
    pages += [(200, "http://de.example.de/y", "<html></html>"), (201, "http://de.example.de/z", None), (202, None, page("en", made[0][1], "en")), (None, "", "語" * 200), (203, "http://en.example.org/q", page("", made[2][1], "de"))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: r for r in langid.identify(langid.page_rows(table), *model, markup=True).collect()}
    assert len(found) == len(pages)
    assert all(found[i]["lang"] == l and found[i]["accepted"] for i, _, l in made)
    assert found[200]["lang"] == found[201]["lang"] == "de"  # host and suffix alone
    assert found[202]["lang"] == "en" and found[203]["lang"] == "en"
    assert not found[None]["accepted"]


def test_language_against_brute_force(spark):
    words = {"en": "the house and tree with water of", "de": "der baum und das haus mit wasser", "fr": "le chat et la maison avec eau"}
    rng = np.random.default_rng(5)
    made = [(i, " ".join(rng.choice(words[l].split(), int(rng.integers(1, 60)))), l) for i, l in enumerate(["en", "de", "fr"] * 20)]
    names, table = langid.fitted(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    grams = [langid.trigrams(t) for _, t, _ in made]
    for k, name in enumerate(names[:-1]):  # the model is the counts of whole texts
        counts = sum(np.bincount(g, minlength=1 << langid.BITS) for g, (_, _, l) in zip(grams, made, strict=True) if l == name) + langid.ADD
        assert np.allclose(table[k], np.log(counts / counts.sum()))
    html = lambda t, lang: f"<html lang='{lang}'><!-- der das und --><p>{t}</p>" if lang else f"<p>{t}</p>"
    pages = [(i, f"http://h{i % 5}.d{i % 2}.{'de' if l == 'de' else 'com'}/", html(t, l if i % 3 else None)) for i, t, l in made]
    pages += [pages[0], pages[0], (900, None, None), (901, "x", ""), (902, "http://h0.d0.com/", "<script>x" * 30_000), (903, "http://h1.d1.com/", "the house " * 200_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows_ = langid.page_rows(frame).collect()
    n, p, keys = len(names), [], []
    for r in rows_:
        text = r["text"] or ""
        g = langid.trigrams(langid.visible(text))
        x = table[:, g].sum(axis=1) / (1 + len(g) / langid.FULL) ** 0.5 * langid.TEMPER
        p.append((x - x.max(), np.exp(x - x.max()) / np.exp(x - x.max()).sum()))
        keys.append({"declared": langid.declared_language(text), "suffix": r["suffix"], "domain": r["domain"], "host": r["host"]})
    whole = sum(q for _, q in p)
    known = (whole + 1) / (whole.sum() + n)
    want = []
    for i, r in enumerate(rows_):
        others = {by: sum((q for j, (_, q) in enumerate(p) if j != i and keys[j][by] == keys[i][by] is not None), np.zeros(n)) for by in keys[i]}
        smooth = lambda c, prior: (c + langid.KAPPA * prior) / (c.sum() + langid.KAPPA)
        x = p[i][0] + np.log(smooth(others["host"], smooth(others["domain"], known))) + sum(np.log(smooth(others[by], known) / known) for by in ("declared", "suffix"))
        post = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        want.append((str(r["page_id"]), names[int(post.argmax())], round(float(post.max()), 5)))
    found = langid.identify(langid.page_rows(frame), names, table, markup=True)
    got = [(str(r["page_id"]), r["lang"], round(r["confidence"], 5)) for r in found.collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4
    assert langid.identify(langid.page_rows(frame.limit(0)), names, table, markup=True).count() == 0


def test_language_documents(docs, empty):
    kept = langid.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3, 8} <= ids
    assert langid.accepted_documents(empty).count() == 0


def test_rare_languages_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 60)
    made = [(i, f"the cat sat on the mat {i}", "en") for i in range(3000)] + [(5000 + i, f"le chat est sur le tapis {i}", "fr") for i in range(300)] + [(9000, "zq xq vq kq zqx", "qq")]
    labelled = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4)
    names, table = langid.fitted(labelled)
    assert names == ["en", "fr", "qq", "und"] and table.shape[0] == 4
    taken = Counter(r["lang"] for r in common.dealt_sample(labelled, "lang", ["doc_id", "text"], 60).collect())
    assert taken["qq"] == 1 and taken["fr"] == taken["en"] == 29
    assert common.dealt_sample(labelled, "lang", ["doc_id", "text"], 4000).count() == len(made)


# --- 3

def brute_search(items, queries, top):
    tf = [Counter(licenses.words_of(t or "")) for _, t in items]
    long = [sum(c.values()) for c in tf]
    n, mean = len(items), sum(long) / len(items)
    df = Counter(w for c in tf for w in c)
    out = []
    for q, text in queries:
        scored = []
        for (d, _), c, l in zip(items, tf, long, strict=True):
            s = sum(k * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * l / mean)) for w, k in Counter(licenses.words_of(text or "")).items() if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(q, i + 1, x[3], round(-x[0], 5)) for i, x in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("block,postings", [(20_000, 6_000_000), (1, 8)])
def test_search_is_exact(docs, empty, block, postings):
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = docs.filter(F.col("doc_id") % 50 == 0)
    got = [(q, r, d, round(s, 5)) for q, r, d, s in rows(search.top_k(docs, asked, top=4, block=block, postings=postings))]
    assert sorted(got, key=str) == sorted(brute_search(items, [x for x in items if x[0] and x[0] % 50 == 0], 4), key=str)
    if block == 1:
        assert search.top_k(docs, empty).count() == 0 and search.top_k(empty, empty).count() == 0


def test_blocks_of_queries_share_two_scans(spark, docs):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = docs.filter("doc_id < 5")
    got = [(q, r, d, round(s, 5)) for q, r, d, s in rows(search.top_k(docs.withColumn("text", F.udf(seen, "string")("text")), asked, top=4, block=1))]
    assert sorted(got, key=str) == sorted(brute_search(items, [x for x in items if x[0] and x[0] < 5], 4), key=str)
    assert read.value <= 2 * len(items)


def test_unseen_query_words_count_for_nothing(spark, docs, empty):
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen = next(t for _, t in items if t and len(licenses.words_of(t)) > 3)
    lines = [(1, "qqzx " + seen + " zzqj vvkx"), (2, "qqzx zzqj"), (3, "zzqj " + " ".join(f"xq{i}vv" for i in range(50)))]
    asked = spark.createDataFrame(lines, "doc_id long, text string")
    got = [(q, r, d, round(s, 5)) for q, r, d, s in rows(search.top_k(docs, asked, top=4))]
    assert got and sorted(got, key=str) == sorted(brute_search(items, lines, 4), key=str) and {x[0] for x in got} == {1}
    assert search.top_k(empty, asked).count() == 0


def test_block_pruning_skips_and_stays_exact():
    rng = np.random.default_rng(3)
    held = [(i, np.unique(rng.integers(0, 40, 12)), None, 30, int(i % 5)) for i in range(2000)]
    held = [(i, t, rng.integers(1, 5, len(t)), n, c) for i, t, _, n, c in held]
    index = search.Index(list(held), 40, 30.0)
    terms, weights = np.array([1, 5, 9]), np.array([2.0, 0.1, 0.4])
    best = [[]]
    index.search_all([terms], [weights], best, 7)
    got = best[0]
    impact = lambda tf: tf * 2.2 / (tf + 1.2)
    every = sorted(((sum(w * impact(float(f[np.flatnonzero(t == x)[0]])) for x, w in zip(terms, weights, strict=True) if x in t), -i) for i, t, f, _, _ in held), reverse=True)[:7]
    assert [d for _, d in got] == [d for _, d in every] and np.allclose([s for s, _ in got], [s for s, _ in every])
    assert index.scored < index.n_blocks
    # few documents are much better than others: nearly all blocks are skipped
    held = [(i, np.array([0, 1 + i % 39]), np.array([50 if i % 400 == 0 else 1, 1]), 30, i % 400) for i in range(2000)]
    index, best = search.Index(list(held), 40, 30.0), [[]]
    index.search_all([np.array([0])], [np.array([1.0])], best, 5)
    assert [d for _, d in best[0]] == [0, -400, -800, -1200, -1600] and index.scored < index.n_blocks / 4


# --- 4

def brute_jaccard(items, k=5):
    sets = []
    for _, t in items:
        w = licenses.words_of(t or "")
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    n = len(items)
    link = [[i != j and (sets[i] == sets[j] or bool(sets[i] & sets[j]) and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return link, root


def near_copies(n=60, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(n // 6):
        base = list(rng.choice(vocabulary, 150))
        for c in range(6):
            text = list(base)
            for _ in range(c):
                text[int(rng.integers(0, 150))] = f"new{g}{c}{rng.integers(0, 9)}"
            out.append((g * 6 + c, " ".join(text)))
    return out


@pytest.mark.parametrize("limit", [shingles.LIMIT, 3])
def test_jaccard_join(spark, limit):
    items = TEXTS + [(1000 + i, t) for i, t in near_copies()]
    link, root = brute_jaccard(items)
    got = shingles.jaccard_join(docs_of(spark, items), limit=limit).collect()
    least = {}
    for r, (d, _) in zip(root, items, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, sum(link[i]), least.get(root[i])) for i, (d, _) in enumerate(items))
    assert Counter((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))


def test_chains_of_many_sizes_are_cut(spark, monkeypatch):
    """A group that a chain of growing texts joins: all links, and no comparison of sizes far apart."""
    monkeypatch.setattr(shingles, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[: 24 + 3 * i])) for i in range(120)]
    link, root = brute_jaccard(items)
    assert set(root) == {0}
    got = {r["doc_id"]: r for r in shingles.jaccard_join(docs_of(spark, items)).collect()}
    assert [got[i]["n_links"] for i in range(120)] == [sum(x) for x in link]
    assert {r["component_id"] for r in got.values()} == {0}
    rows = spark.createDataFrame([(i, 1, 120, 20 + 3 * i) for i in range(120)], "id long, grp long, n long, size int")
    pairs = shingles._crossed(shingles._stepped(rows), ["id"])
    met = {(r["grp"], r["i"], r["j"]) for r in pairs.collect()}
    blocks = {x for _, i, j in met for x in (i, j)}
    assert len(met) < len(blocks) * (len(blocks) + 1) // 4
    assert all(abs((i >> 32) - (j >> 32)) <= 1 for _, i, j in met)


def test_jaccard_keeps_one_row_of_each_group(docs, empty):
    out = shingles.distinct_documents(docs)
    assert out.columns == docs.columns
    _, root = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert out.count() == len(set(root))
    assert shingles.distinct_documents(empty).count() == 0


# --- 5

def brute_licenses(text):
    words = licenses.words_of(text or "")
    hits = []
    for phrase, label in licenses.PHRASES:
        p = licenses.words_of(phrase)
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_phrases_and_notices(spark, docs, empty):
    notice = "Permission is hereby granted, free of charge, to any PERSON obtaining one extra copy of this software and associated documentation files (the thing)"
    more = docs_of(spark, TEXTS + [(300, notice), (301, "general public license mit license " * 3), (302, "of the and in the " * 50), (303, "mit  license" + LONG + "apache license")])
    words = licenses.NOTICES[0][0].split()
    chunks = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]
    more = more.unionByName(docs_of(spark, [(304, " ".join(chunks[::-1])), (305, (" filler" * 60).join(chunks)), (306, "so " * 77 + " and one ".join(chunks))]), allowMissingColumns=True)
    got = licenses.licenses(more).collect()
    want = Counter((d, *brute_licenses(t)) for d, t in [(r["doc_id"], r["text"]) for r in more.collect()])
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[300]["labels"] == "mit" and by[300]["base_labels"] == "" and 0.6 <= by[300]["score"] < 1
    assert by[304]["labels"] == by[305]["labels"] == "" and by[306]["labels"] == "mit"  # in order and near each other
    assert by[302]["labels"] == "" and by[302]["score"] == 0 and by[301]["score"] == 1
    assert licenses.licenses(empty).count() == 0


# --- 6

def test_token_files(spark, docs, empty):
    path = tokens.vocabulary("word_bpe_49k.json")
    to = common.fresh_path(spark, "test-ids")
    tokenfiles.write_ids(docs, path, to, block=100)
    got = sorted(rows(tokenfiles.read_ids(spark, to)), key=lambda r: r[1])
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = tokens.Encoder(path).plain([t or "" for _, t in items])
    whole = sorted(((d is not None, d or 0, np.append(x, 2).astype("<u2").tobytes()) for (d, _), x in zip(items, plain, strict=True)))
    at, want = 0, []
    for known, d, raw in whole:
        ids = np.frombuffer(raw, "<u2").astype("<u4")
        want.append((d if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    to = common.fresh_path(spark, "test-none")
    tokenfiles.write_ids(empty, path, to)
    assert tokenfiles.read_ids(spark, to).count() == 0


def test_workers_hold_the_ids_of_a_bounded_portion(monkeypatch):
    rng = np.random.default_rng(4)
    size = rng.integers(0, 6, 50_000)
    start, values, at = np.cumsum(size) - size, rng.integers(0, 49_152, int(size.sum())).astype(np.uint32), rng.integers(0, 50_000, 1_000_000)
    tracemalloc.start()
    got, n = tokens.gathered(values, start, size, at)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * (got.nbytes + n.nbytes)
    few = at[:70_000]
    assert np.array_equal(tokens.gathered(values, start, size, few)[0], np.concatenate([values[start[i] : start[i] + size[i]] for i in few]))
    assert [len(x) for x in tokens.gathered(values, start, size, few[:0])] == [0, 0]

    path, asked, whole = tokens.vocabulary("word_bpe_49k.json"), [], tokens.encoder(tokens.vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(tokenfiles, "encoder", lambda _: lambda texts: asked.append(texts) or whole(texts))
    texts = ["a word " * 100_000, "", "b word " * 100_000] * 20
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    raw = b"".join(x["raw"][2:] for out in tokenfiles._blocks(path, 2, 2, 16, 1 << 17)(iter([batch])) for x in out.to_pylist())
    assert max(sum(pc.binary_length(x).to_pylist()) for x in asked) <= tokens.TOGETHER + 700_000
    assert raw == b"".join(np.append(x, 2).astype("<u2").tobytes() for x in whole(batch.column("text")))


def test_coder_round_trip_and_checksum(spark):
    coder.register(spark)
    rng = np.random.default_rng(2)
    blocks = [np.zeros(0, int), np.array([0]), np.full(5000, 7), rng.integers(0, 65536, 3000), np.tile(rng.integers(0, 50, 20), 300)]
    raws = [bytes([2, 16]) + b.astype("<u2").tobytes() for b in blocks] + [bytes([4, 20]) + rng.integers(0, 1 << 20, 500).astype("<u4").tobytes()]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary").select("i", "raw", F.call_function(coder.ENCODE, "raw").alias("code"))
    assert df.filter(F.call_function(coder.DECODE, "code") != F.expr("substring(raw, 3)")).count() == 0
    sizes = {r["i"]: r["n"] for r in df.select("i", F.length("code").alias("n")).collect()}
    assert sizes[2] < 120 and sizes[4] < 2000  # repetition is learnt
    broken = df.filter("i = 3").select(F.concat(F.expr("substring(code, 1, 50)"), F.lit(bytearray([1, 2, 3]))).alias("code"))
    with pytest.raises(Exception, match="checksum"):
        broken.select(F.call_function(coder.DECODE, "code")).collect()


# --- 7

@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(tokens.vocabulary("piece_bpe_32k.model"))


def test_pieces_are_found_in_two_looks(lattice):
    rng = np.random.default_rng(5)
    for table, *_ in lattice.hashes[1:]:
        own = table.known[: len(table.order)]
        at, hit = table.find(own)
        assert table.depth <= 2 and hit.all() and np.array_equal(table.known[at], own)
        assert not table.find(rng.integers(1 << 40, 1 << 62, 1000).astype(np.uint64))[1].any()
    few = pieces.Hashes(np.zeros(0, np.uint64))
    assert not few.find(np.arange(9, dtype=np.uint64).reshape(3, 3))[1].any()


def test_sampled_pieces_decode_and_repeat(docs, empty):
    path = tokens.vocabulary("piece_bpe_32k.model")
    a = sorted(rows(pieces.sampled(docs, path)), key=str)
    assert all(r[3] and r[1] == len(r[2]) for r in a) and len(a) == len(TEXTS)
    assert a == sorted(rows(pieces.sampled(docs.repartition(7), path)), key=str)
    assert a != sorted(rows(pieces.sampled(docs, path, seed=8)), key=str)
    assert pieces.sampled(empty, path).count() == 0


def test_sampling_follows_the_lattice(lattice):
    def spread(text):
        out = {(): 1.0} if not text else {}
        for n in range(1, min(len(text), lattice.most) + 1):
            if hit := lattice.piece.get(text[:n]):
                for rest, w in spread(text[n:]).items():
                    out[hit[0], *rest] = out.get((hit[0], *rest), 0) + w * hit[1]
        return out

    want = spread(" house")
    ids, n = lattice.sample(list(range(30_000)), ["house"] * 30_000)
    cuts = np.concatenate([[0], np.cumsum(n)])
    got = Counter(tuple(ids[i:j].tolist()) for i, j in zip(cuts, cuts[1:], strict=False))
    for k, w in want.items():
        assert abs(got[k] / 30_000 - w / sum(want.values())) < 0.015


def test_long_units_filter_as_short_ones(lattice, monkeypatch):
    texts = ["alpha beta gammadelta", "日本 é▁x", "n" * 40]
    a = lattice.sample([1, 2, 3], texts)
    monkeypatch.setattr(pieces, "TOGETHER", 0)
    b = lattice.sample([1, 2, 3], texts)
    # the order of edges within a state differs, so compare what both must keep
    for ids, n in (a, b):
        cuts = np.concatenate([[0], np.cumsum(n)])
        assert [lattice.decode(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)] == texts


# --- 8

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_splicing_gives_whole_text_ids(name):
    e = tokens.Encoder(tokens.vocabulary(name))
    rng = np.random.default_rng(4)
    words = ["the", "don't", "<|endoftext|>", "éa", "日本", ",", "...", "\n", "  ", "x" * 60, "Straße", "12345"]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(5)] + ["y" * 3000 + " end of it", "a b " * 10, ""]
    for text in texts:
        for f in {e.spans, e.library_spans}:
            assert np.array_equal(tokens.spliced(f, text, 200, 16), e.plain([text])[0])


def test_token_counts(docs, empty):
    path = tokens.vocabulary("word_bpe_49k.json")
    lib = tokens.Encoder(path).lib
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
    assert Counter(rows(tokens.token_counts(docs, path))) == want
    assert tokens.token_counts(empty, path).count() == 0


# --- 9

def test_warc_store(spark):
    big = "<p>" + "word " * 50 + "</p>"
    pages = [(5, "http://b.example.org/x?q=1#f", big), (3, "https://a.example.org:8080/ü y", big), (4, None, big), (1, "http://b.example.org/x", "short"), (2, "", "short"), (7, "ftp://h/é", None), (None, "http://z/", big), (9, "http://z/9", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "http://z/9", "\r\n\r\nWARC/1.1\r\n" * 20)]
    table = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, refers_to int, url_key string")
    to = common.fresh_path(spark, "test-warc")
    warc.write_store(table, to)
    got = Counter(rows(warc.fetch(spark, to, table)))
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if h == html and j is not None]
        refers = min(same) if len(raw) >= 100 and same and min(same) != i and sum(h == html for _, _, h in pages) > 1 else None
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == want
    hits = warc.lookup(spark, to, "https://A.example.org/ü y")
    assert [(h["warc-type"], p.decode()) for h, p in hits] == [("response", big)]
    assert {h["x-page-id"] for h, _ in warc.lookup(spark, to, "http://b.example.org/x")} == {"1"}
    assert warc.lookup(spark, to, "http://nowhere/") == []
    to = common.fresh_path(spark, "test-warc-none")
    warc.write_store(table.limit(0), to)
    assert warc.fetch(spark, to, table).count() == 0


# --- 10

def vectors_of(spark, items):
    return spark.createDataFrame([(i, v, 3, "c") for i, v in items], "vec_id long, embedding array<float>, label int, code string")


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    items = [(i, list(map(float, v))) for i, v in enumerate(base)]
    items += [(100 + i, list(map(float, base[i % 10] + rng.normal(size=32) * 0.12))) for i in range(80)]
    items += [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] + [1.0] * 31), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, items[0][1]), (307, items[0][1]), (None, items[1][1])]
    monkeypatch.setattr(embeddings, "BLOCK_LEAST", 4)
    got = embeddings.near_duplicates(vectors_of(spark, items)).collect()
    units = [embeddings.usable(None if v is None else [None if x is None else np.float32(x) for x in v]) for _, v in items]
    n = len(items)
    link = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.95 for j in range(n)] for i in range(n)]
    found, there = sum(r["n_links"] for r in got), sum(map(sum, link))
    assert 0.9 * there <= found <= there and there > 100
    assert all(r["n_links"] == 0 for r in got if r["vec_id"] is not None and 300 <= r["vec_id"] <= 304)
    by = {r["vec_id"]: r for r in got}
    assert by[306]["component_id"] == 305 and by[307]["component_id"] == 0 and by[None]["component_id"] == 1
    assert embeddings.near_duplicates(vectors_of(spark, items).limit(0)).count() == 0


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "shared mean"])
def test_recall_at_the_threshold(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(900, 64))
    if kind == "clustered":
        a = rng.normal(size=(6, 64))[rng.integers(0, 6, 900)] + 0.5 * a
    elif kind == "shared mean":
        a = a + 1.8 * rng.normal(size=(1, 64))
    a = unit_rows(a)
    noise = rng.normal(size=a.shape)
    noise = unit_rows(noise - (noise * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * noise
    x = np.concatenate([a, b])
    table = vectors_of(spark, [(i, list(map(float, v))) for i, v in enumerate(x)]).cache()
    x = unit_rows(x.astype(np.float32).astype(np.float64))
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table).collect()}
    assert all(got[i] <= w for i, w in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum() > 1500
    centre, pivots = embeddings.pivots_of(table, 1800)[64]
    lists = np.bincount(np.argsort(-((x - centre) @ pivots.T), 1)[:, : embeddings.ROUTE].ravel())
    assert len(pivots) > 100 and lists.max() < 450  # no list is the table
    monkeypatch.setattr(embeddings, "SPLIT", 40)
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table).collect()} == got  # splitting loses no link


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)] + [(200, x) for x in range(201, 240)]
    got = dict(rows(graph.components(spark.createDataFrame(links, "a long, b long"))))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 240)} == {200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
