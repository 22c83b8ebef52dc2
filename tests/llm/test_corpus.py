"""Mixing, sharding and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpora import frame, prose

from lumenq.llm import mixing as M
from lumenq.llm import sharding as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    """Targets by repeated sharing."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in full]
        level = (total - sum(full.values())) / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if weight[n] * level > 2 * sizes[n] + 1e-9]
        if not over:
            return {n: full.get(n, weight[n] * level) for n in names}
        full |= {n: 2 * sizes[n] for n in over}


@pytest.mark.parametrize("extra", [False, True])
def test_mix_meets_targets(spark, rows, extra):
    docs = frame(spark, rows, extra).repartition(3)
    source = {r.doc_id: r.source for r in docs.collect()}
    got = M.taken(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t in rows)
    sizes, took = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        took[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    # a block is one word here, and a source is off by a few slots of the schedule
    assert all(abs(took[n] - want[n]) <= 4 for n in want)
    again = M.taken(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_does_not_broadcast_blocks(spark, docs):
    mixed = M.mix(docs)[0]
    mixed.collect()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source_no" in plan and not re.search(r"Broadcast\w*Join \[source_no#\w+, rank#", plan)


def test_mix_plans_few_stages_at_once(spark, docs):
    plan = M.mix(docs)[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange (?:hash|Single|range|Round)", plan)) <= 6


def brute_slots(sources, slots):
    """Source and rank of each slot, one after another."""
    seen, out = Counter(), []
    for k in range(slots):
        p = k * M.GOLDEN % M.POINTS
        n = next(r.source_no for r in sources if r.low <= p < r.high)
        out.append((k, n, seen[n]))
        seen[n] += 1
    return out


def test_schedule_is_that_of_the_points(spark, docs):
    sources = M.targets(M.sizes(docs)).collect()
    got = M.schedule(spark.createDataFrame(sources), 40000).collect()
    assert sorted(map(tuple, got)) == brute_slots(sources, 40000)


def test_the_schedule_decides_what_is_taken(docs, monkeypatch):
    took = lambda: {(r.doc_id, r.size): (r.taken, r.first_slot, r.slots) for r in M.taken(docs).collect()}
    before, plan = took(), M.schedule
    mixed, numbered, _ = M.mix(docs)
    number = {(r.doc_id, r.size): r.source_no for r in numbered.collect()}
    monkeypatch.setattr(M, "schedule", lambda sources, slots: plan(sources, slots).where("source_no <> 1"))
    after = took()
    assert any(number[k] == 1 and before[k][0] > 0 for k in before)
    assert all(after[k] == ((0, None, 0) if number[k] == 1 else before[k]) for k in before)


def test_many_sources(spark):
    """A source for each document, more than a range holds."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i:04}") for i in range(900)], "doc_id long, text string, source string").repartition(4)
    want = fill({f"s{i:04}": 1 + i % 7 for i in range(900)})
    got = M.taken(docs).collect()
    assert len(got) == 900 and all(abs(r.target - want[f"s{r.doc_id:04}"]) < 1e-6 for r in got)
    assert abs(sum(r.taken for r in got) - sum(want.values())) <= 0.05 * sum(want.values())


def test_schedule_spreads_sources(spark, docs):
    mixed, _, sources = M.mix(docs)
    slots = sorted((r.slot, r.source_no) for r in mixed.select("slot", "source_no").distinct().collect())
    assert len({s for s, _ in slots}) == len(slots)
    share = {r.source_no: r.target for r in sources.collect()}
    total = sum(share.values())
    half = Counter(n for _, n in slots[: len(slots) // 2])
    assert all(abs(half[n] - share[n] / total * len(slots) / 2) <= 4 for n in share)


def test_repeat_gives_whole_rows(spark, docs):
    clash = docs.selectExpr("*", "1 as taken_order", "2 as taken_times", "3 as `order`", "4 as slot")
    out = M.repeat(clash)
    assert out.columns == clash.columns
    times = Counter(r.doc_id for r in out.collect())
    for r in M.taken(docs).collect():
        assert abs(times[r.doc_id] * r.size - r.taken) <= r.size / 2 + 1e-9 or r.size == 0


def test_mix_of_odd_rows(spark):
    odd = frame(spark, [(None, "a b c"), (1, None), (1, "x y"), (1, "x y"), (2, "")])
    assert sorted((str(r.doc_id), r.size) for r in M.taken(odd).collect()) == [("1", 0), ("1", 2), ("1", 2), ("2", 0), ("None", 3)]
    assert M.taken(frame(spark, [])).count() == 0 and M.repeat(frame(spark, [])).count() == 0
    assert {r.taken for r in M.taken(frame(spark, [(1, None), (2, "")])).collect()} == {0}


@pytest.mark.parametrize("extra", [False, True])
def test_shards_are_even_and_gapless(spark, rows, extra):
    rng = random.Random(3)
    many = rows + [(5000 + k, prose(rng, 20)) for k in range(400)] + [(7000 + k, "the same text again " * 12) for k in range(300)]
    docs = frame(spark, many, extra)
    got = S.assign(docs, shards=6).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in many)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    share = sum(size.values()) / 6
    assert set(size) == set(range(6)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(len((t or "").encode()) for _, t in many)
    assert all(abs(v - share) <= largest + 0.05 * share for v in size.values())
    whole = S.attach(docs, S.assign(docs, shards=6))
    assert whole.count() == len(many) and whole.columns[: len(docs.columns)] == docs.columns and len(whole.columns) == len(docs.columns) + 2


def test_shards_of_odd_rows(spark):
    odd = frame(spark, [(None, "a"), (1, None), (1, ""), (1, "x"), (1, "x")])
    got = S.assign(odd, shards=2).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert {r.text_crc32 for r in got if r.size == 8} == {0}
    assert S.assign(frame(spark, [])).count() == 0
    assert S.attach(odd, S.assign(odd, shards=2)).count() == 5


def test_pipeline(spark, tmp_path):
    """Each stage's decisions, on its own input, against brute force."""
    import corpus_pipeline as P
    from test_dedup import brute_groups
    from test_texts import brute_hits

    rng = random.Random(12)
    items = [(k, prose(rng, 30)) for k in range(4)]
    rows = [(i, prose(rng, rng.randrange(12, 120))) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " more words") for i in range(20)] + [(200 + i, rows[i][1] + "\n" + items[i % 4][1]) for i in range(30, 40)]
    rows += [(300 + i, prose(rng, 30).upper().replace(" ", "!! ")) for i in range(40)] + [(400, "too short"), (401, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows if i % 5], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, docs, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    text = dict(rows)
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen[name] = [r.doc_id for r in docs.collect()]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    first = set(seen["quality_rules"])
    assert not first & {400, 401} and len([i for i in first if i >= 300]) <= 2 and len([i for i in first if i < 300]) >= 118
    second = {i for i, _, _, stays in brute_groups([(i, text[i]) for i in first], 5) if stays}
    assert set(seen["near_dedup"]) == second and second < first
    third = second - {i for i, _ in brute_hits([(i, text[i]) for i in second], items)}
    assert set(seen["decontamination"]) == third < second
    times = Counter(seen["mixing"])
    assert set(times) <= third and max(times.values()) == 2
    assert Counter(seen["sharding"]) == times
    spread = Counter(r.shard for r in docs.collect())
    assert len(spread) == 24 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert P.run(spark, d).count() == len(seen["sharding"])
