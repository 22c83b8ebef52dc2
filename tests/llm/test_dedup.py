"""Near, substring, suffix and line dedup against brute force."""

import random
import re

import pytest
from corpora import corpus, frame, prose

from lumenq.llm import line_dedup, near_dedup, substring_dedup, suffix_dedup


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, window):
    first, out = {}, []
    held = sorted([(i, WORD.findall(t or "")) for i, t in rows if i is not None])
    for i, w in held:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, w in held:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return sorted(out)


def brute_bytes(rows, length):
    count, out = {}, []
    held = {(i, (t or "").encode()) for i, t in rows if i is not None}
    for _, b in held:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    for i, b in held:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def brute_groups(rows, words, threshold=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def test_substring(spark, rows, docs):
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup(docs).collect())
    assert got == brute_words(rows, 13)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_other_corpora(spark, seed):
    rows = corpus(seed, 60)
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup(frame(spark, rows, extra=True)).collect())
    assert got == brute_words(rows, 13)


def test_substring_locates_by_automata(docs, monkeypatch):
    """Without what the automata find, only whole copies lose words."""
    whole = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs).collect()}

    def blind(pieces, passages):
        import pyarrow as pa

        return pa.table({"doc_id": pa.array([], pa.int64()), "lost": pa.array([], pa.int64())})

    monkeypatch.setattr(substring_dedup, "_locate", lambda window: blind)
    without = {r.doc_id: (r.n_removed, r.n_words) for r in substring_dedup.dedup(docs).collect()}
    assert all(n in (0, size) for n, size in without.values()) and sum(n for n, _ in without.values()) < sum(whole.values())


def test_substring_splits_a_common_passage(spark, monkeypatch):
    """A passage of many documents, with few pieces a task and few patterns an automaton."""
    monkeypatch.setattr(substring_dedup, "SPLIT_DOCS", 7)
    monkeypatch.setattr(substring_dedup, "SHARD_PIECES", 50)
    rng = random.Random(5)
    common, other = prose(rng, 25), prose(rng, 40)
    rows = [(i, " ".join([prose(rng, 8), common if i % 3 else other, prose(rng, 8)])) for i in range(90)]
    rows += [(200, "x y " * 60), (201, "x y " * 90), (202, None), (203, "é " * 14)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert got == brute_words(rows, 13)


def test_suffix(spark, rows, docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect())
    assert got == brute_bytes(rows, 400)
    assert sum(r[2] for r in got) > 2000


def test_suffix_of_periodic_and_shifted_texts(spark):
    rng = random.Random(9)
    base = prose(rng, 120)
    rows = [(1, "ab" * 500), (2, "x" + "ab" * 230), (3, base), (4, base[17:600] + "#" + base[17:600]), (5, "q" * 399), (6, "q" * 401), (7, base[:405] + "é" * 300), (8, "é" * 200)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, rows, extra=True)).collect())
    assert got == brute_bytes(rows, 400)


def test_near(spark, rows, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs).collect())
    assert got == brute_groups(rows, 4)
    assert sum(not r[3] for r in got) > 5


def test_near_in_a_large_group(spark):
    """Over LIST near copies at mixed distances from their middle, so that hubs, far rows and blocks all serve."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(80)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(frame(spark, rows, extra=True)).collect())
    assert got == brute_groups(rows, 4)


@pytest.mark.parametrize("each", [1, 5])
def test_near_in_a_large_group_with_text_of_their_own(spark, each):
    """Copies of a template with text appended that nobody, or a few others, share; each links with the template only or with those."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1201):
        if i % each == 0 or i == 1:
            own = [f"o{rng.randrange(10**9)}" for _ in range(24)]
        rows.append((i, " ".join([*base, *own[:23], f"{own[23]}{i}"])))
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.groups(frame(spark, rows)).collect())
    assert got == [(i, 0) for i in range(1201)]
    assert [(i, top) for i, _, top, _ in brute_groups(rows[:300], 4)] == got[:300]


def test_near_keeps_one_row_of_a_group(spark, rows, docs):
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert kept == {i for i, _, _, stays in brute_groups(rows, 5) if stays}


def brute_lines(rows, least=20, many=3):
    upper, low, space = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(space).translate(str.maketrans(upper, low))
    held = [(i, (t or "").split("\n")) for i, t in rows]
    owners = {}
    for i, ls in held:
        for x in ls:
            if len(key(x)) >= least:
                owners.setdefault(key(x), set()).add(i)
    out = []
    for i, ls in held:
        stay = [x for x in ls if len(owners.get(key(x), ())) < many or max(owners[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_lines(spark, rows, docs):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(docs).collect())
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 5
    clash = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(frame(spark, rows, extra=True)).collect())
    assert clash == got


ODD = [(None, "a b c d e f g h i j k l m n o"), (5, None), (5, "a b c d e f g h i j k l m n o"), (6, "a b c d e f g h i j k l m n o"), (7, "")]


def test_nulls_and_repeated_ids(spark):
    docs = frame(spark, ODD)
    assert [r.n_removed for r in sorted(substring_dedup.dedup(docs).collect(), key=str) if r.doc_id is None] == [0]
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect()} == {(None, 15, 0), (5, 0, 0), (5, 15, 0), (6, 15, 15), (7, 0, 0)}
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(docs).collect()} == {(None, 0), (5, 0), (6, 0), (7, 0)}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs).collect()} == {(None, 12, None, True), (5, 0, 5, True), (5, 12, 5, True), (6, 12, 5, False), (7, 0, 7, True)}
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup(docs).collect()} == {(None, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0)}


@pytest.mark.parametrize("run", [substring_dedup.dedup, suffix_dedup.dedup, near_dedup.groups, near_dedup.keep_one, line_dedup.dedup])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_near_dedup_does_not_broadcast_pairs_or_blocks(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i % 7}".encode()) for i in range(40)], "doc_id long, text binary")
    pairs = near_dedup.settled(spark.range(20).selectExpr("id as a", "id + 7 as b"))
    met = near_dedup.settled(spark.range(40).selectExpr("id as doc_id", "2L as n", "0L as hub"))
    sketched = near_dedup.settled(near_dedup.sketches(docs, 4))
    none = spark.createDataFrame([], "a long, b long")
    steps = [near_dedup._likely(pairs, sketched, 0.8), near_dedup._confirmed(pairs, docs, 4, 0.8), near_dedup._far_links(met, none, docs, 4, 0.8)]
    for step in steps:
        assert step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Broadcast\w*Join \[(a|doc_id)#", plan)


def test_hub_members_are_judged_before_they_are_dealt_to_blocks(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i % 7}".encode()) for i in range(40)], "doc_id long, text binary")
    met = near_dedup.settled(spark.range(40).selectExpr("id as doc_id", "2L as n", "0L as hub"))
    none = near_dedup.settled(spark.createDataFrame([], "a long, b long"))
    plan = near_dedup._far_links(met, none, docs, 4, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange (?:hash|Single|range|Round)", plan)) <= 5
