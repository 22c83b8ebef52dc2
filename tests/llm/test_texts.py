"""Token counts, quality rules and classifier, decontamination."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import frame, prose

from lumenq.llm import decontamination as D
from lumenq.llm import quality_classifier as C
from lumenq.llm import quality_rules as Q
from lumenq.llm import token_counts as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose and bad: shouting, chains of one word; labels of most."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randrange(20, 80))
        good = i % 3 > 0
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    labels += [(5, 0, 0), (6, None, 0), (None, 1, 0), (9999, 1, 0)]
    return rows, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_token_counts_are_the_library_s(spark, rows, docs):
    library = T._library(T.vocabulary_path())
    odd = [(9001, "it's<|endoftext|>we'll  \n\n x\t1234 日本語 ẞß"), (9002, "<|endoftext|>"), (None, "a"), (9003, "x" * 5000), (9003, " " * 600)]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count(docs.union(frame(spark, odd))).collect()}
    want = set()
    for i, t in [*rows, *odd]:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want


def test_frequent_pre_tokens_come_from_all_texts(spark, docs, rows):
    seen = Counter(t for _, text in rows for part in (text or "").split(T.SPECIAL) for t in T._PRE_TOKENS.findall(part))
    seen = {t: n for t, n in seen.items() if n > 1 and len(t) <= T.LONGEST}
    assert set(T.frequent(docs, T.vocabulary_path())) == set(seen)
    best = sorted(seen, key=lambda t: (-seen[t], t))[:5]
    got = T.frequent(docs.coalesce(1), T.vocabulary_path(), 20)
    assert len(got) <= 20 and set(best) <= set(got)
    assert T.frequent(docs.where("false"), T.vocabulary_path()) == {}


def test_summaries_are_bounded_and_short_by_no_more_than_what_is_left_out():
    seen = Counter({str(i): i for i in range(100)})
    got = T._summary(seen, 10)
    assert len(got) <= 10 and all(0 <= seen[t] - n <= 89 for t, n in got.items()) and set(got) == {str(i) for i in range(90, 100)}
    assert T._summary(seen, 100) == seen and len(T._summary(Counter("abc"), 2)) == 0


def test_token_counts_of_all_characters():
    """Texts of web characters are cut here, not sent to the library whole, and every character counts as the library says."""
    path = T.vocabulary_path()
    library, lengths = T._library(path), T.Lengths(path, {})
    web = "“It’s fine” — she said… 日本語 naïve Ünïcödé שלום 👍🏽 №5 ½ x² \u00a0 \u3000 end"
    assert not lengths.beyond(web) and lengths.beyond(web + chr(0x208F))
    rng = random.Random(5)
    texts = [web] + ["".join(rng.choice("ab1. '") + chr(rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x30000)])) * rng.randrange(1, 3) for _ in range(300)) for _ in range(40)]
    texts += ["".join(f"{a}{chr(c)}{a}" for c in range(low, low + 512)) for low in range(0x80, 0xD000, 4096) for a in "a1."]
    assert lengths(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts_of_a_very_long_text_and_clashing_names(spark):
    rows = [(1, prose(random.Random(1), 60000)), (2, "a" * 40000), (3, None)]
    library = T._library(T.vocabulary_path())
    got = {r.doc_id: r.n_tokens for r in T.count(frame(spark, rows).selectExpr("*", "1 as text__", "2 as n_bytes", "3 as n_tokens")).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in rows}


def test_token_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(T, "CACHE_ROWS", 10)
    texts = [prose(random.Random(k), 40) for k in range(5)]
    library = T._library(T.vocabulary_path())
    assert T.Lengths(T.vocabulary_path(), {})(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    inside = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            inside.update(range(k, k + 5))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, rows):
    some = [r for r in rows if len(r[1] or "") < 2000] + [(None, "a | b # c"), (8000, "x y\n x y\nx y\nz\n\nz"), (8000, "é ü\x1fñ <b>")]
    for r in Q.measure(frame(spark, some, extra=True), None).collect():
        t = next(t for i, t in some if i == r.doc_id and base_counts(t)[1] == r.word_chars)
        counts = base_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*counts, failed, not failed)


def test_quality_rules_learn_from_labels(labelled):
    rows, docs, labels = labelled
    model = Q.fit(docs, labels)
    got = {r.doc_id: r.kept for r in Q.measure(docs, model).collect()}
    right = sum(got[i] == (i % 3 > 0) for i in got)
    assert right >= 0.95 * len(rows)
    kept = Q.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert Q.fit(docs, labels.where("quality = 1")) is None and Q.fit(docs, labels.where("false")) is None


def test_classifier_on_held_out_rows(spark, labelled):
    rows, docs, labels = labelled
    model = C.fit(docs, labels)
    got = C.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) >= 0.95
    flipped = labels.withColumn("quality", C.F.when(C.held_out(C.F.col("doc_id")), 1 - C.F.col("quality")).otherwise(C.F.col("quality")))
    assert [r.score for r in C.score(docs, C.fit(docs, flipped)).orderBy("doc_id").collect()] == [r.score for r in C.score(docs, model).orderBy("doc_id").collect()]
    odd = C.score(frame(spark, [(None, "x"), (1, None), (1, "")], extra=True), model).collect()
    assert {r.doc_id for r in odd} == {None, 1} and len({r.score for r in odd if r.doc_id == 1}) == 1
    assert [r.score for r in C.score(docs.limit(1), None).collect()] == [0.5]


def brute_hits(rows, items):
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = {}
    for i, t in rows:
        d = words(t)
        for k, text in items:
            b = words(text)
            for off in range(-len(b), len(d)):
                same = [p + off >= 0 and p + off < len(d) and b[p] == d[p + off] for p in range(len(b))]
                inside = [0 <= p + off < len(d) for p in range(len(b))]
                for s in range(len(b) - D.OVERLAP + 1):
                    n = sum(same[s : s + D.OVERLAP])
                    if all(inside[s : s + D.OVERLAP]) and n >= D.OVERLAP - D.SUBSTITUTIONS:
                        out[(i, k)] = max(n, out.get((i, k), 0))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randrange(11, 40))) for k in range(8)] + [(8, None), (9, "short item"), (10, None)]
    items[10] = (10, items[0][1])
    rows = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 40)).split()
        piece = rng.choice(items[:8])[1].split()
        low = rng.randrange(0, max(1, len(piece) - 12))
        piece = piece[low : low + rng.randrange(9, 20)]
        for _ in range(rng.randrange(0, 5)):
            piece[rng.randrange(len(piece))] = "changed"
        at = rng.randrange(len(words) + 1)
        rows.append((i, ", ".join(words[:at] + [p.upper() if i % 2 else p for p in piece] + words[at:])))
    rows += [(60, None), (60, ""), (None, items[1][1]), (61, prose(rng, 700) + " " + items[2][1] + " " + prose(rng, 700))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, extra=True)
    got = {(r.doc_id, r.item_id): r.matched for r in D.hits(docs, benchmark).collect()}
    assert got == brute_hits(rows, items) and len(got) > 20
    dirty = {i for i, _ in got}
    assert None in dirty and {r.doc_id for r in D.clean(docs, benchmark).collect()} == {i for i, _ in rows} - dirty
    assert D.clean(docs, benchmark).columns == docs.columns
    # rows that share an id, or have none, are judged by their texts
    odd = frame(spark, [(1, items[1][1]), (1, "clean"), (None, items[2][1]), (None, "clean too"), (2, None)])
    assert sorted(str(r.text) for r in D.clean(odd, benchmark).collect()) == ["None", "clean", "clean too"]


def test_decontamination_by_items_of_a_template(spark):
    """Items that share their beginning are verified as one and reported each; rows of one item too."""
    rng = random.Random(8)
    template = prose(rng, 30)
    items = [(k, template + " " + prose(rng, 14)) for k in range(40)] + [(100 + k, template + " the same") for k in range(30)]
    rows = [(i, prose(rng, 20) + " " + " ".join(template.split()[i : i + 16]) + " " + prose(rng, 9)) for i in range(6)] + [(50, prose(rng, 5) + " " + items[7][1]), (51, prose(rng, 90))]
    docs, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in D.hits(docs, benchmark).collect()}
    assert got == brute_hits(rows, items)
    _, contexts, _ = D._overlaps(docs.selectExpr("doc_id key", "text"), D.items(benchmark)[0])
    assert contexts.where("item_at between 0 and 6").select("context").distinct().count() == 7
    assert [r.doc_id for r in D.clean(docs, benchmark).collect()] == [51]


def test_decontamination_by_short_items(spark):
    """Items of fewer than 13 tokens occur whole, from 7 on with one substitution."""
    rng = random.Random(6)
    items = [(n, prose(rng, n)) for n in range(3, 13)]
    rows, want = [], set()
    for n, text in items:
        for changed in range(3):
            words = text.split()
            for k in rng.sample(range(n), changed):
                words[k] = "changed"
            for lead in (0, 3, 250, 600):
                i = len(rows)
                rows.append((i, " ".join([*prose(rng, lead).split(), *words, *prose(rng, lead).split()])))
                if n >= 5 and changed <= (1 if n >= 7 else 0):
                    want.add((i, n, n - changed, lead))
    docs, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched, r.doc_start) for r in D.hits(docs, benchmark).collect()} == want
    assert {r.doc_id for r in D.clean(docs, benchmark).collect()} == {i for i, _ in rows} - {i for i, *_ in want}


def test_every_pair_of_substitutions_leaves_a_mask():
    for a in range(D.SPAN):
        for b in range(D.SPAN):
            assert any(a not in m and b not in m for m in D.MASKS)


@pytest.mark.parametrize("run", [T.count, lambda d: Q.measure(d, None), lambda d: Q.keep(d, None), lambda d: C.score(d, None)])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
    assert D.hits(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
