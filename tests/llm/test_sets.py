import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np

from pageloom.llm import consensus as K
from pageloom.llm import grouping as G
from pageloom.llm import packing as P
from pageloom.llm.tokens import Encoder, TOKENIZERS, p8_ids

from .conftest import rows, source


def find(p, x):
    while p.setdefault(x, x) != x:
        x = p[x]
    return x


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(140)] + [("hub", f"h{i}") for i in range(100)] + [("a", "a"), ("x", None)]
    p = {}
    for a, b in edges:
        if b:
            p[find(p, a)] = find(p, b)
    got = {r.v: r.root for r in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == set(p)
    by, want = defaultdict(set), defaultdict(set)
    for v in got:
        by[got[v]].add(v)
        want[find(p, v)].add(v)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_splits_keep_groups_and_shares(spark, make_dir):
    rng = random.Random(3)
    src = [source(f"s{i}", insurer=f"i{rng.randrange(60)}" if i % 9 else None, product=f"p{i % 170}" if i % 5 else None) for i in range(600)]
    d = make_dir(benchmark_source=src + src[:20], split_target=[{"split_name": "train", "share": 0.8}, {"split_name": "validation", "share": 0.1}, {"split_name": "test", "share": 0.1}])
    got = {r.source_id: (r.group_id, r.split) for r in G.p3_splits(spark, d).collect()}
    assert len(got) == 600 and len(set(got.values())) == len({g for g, _ in got.values()})
    groups = {f"g{i}": 1 + i % 7 for i in range(400)}
    df = spark.createDataFrame([(g, w) for g, w in groups.items()] + [("big", 300)], "root string, weight bigint")
    split = {r.root: r.split for r in G.assign_splits(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()}
    total = sum(groups.values()) + 300
    share = Counter()
    for g, s in split.items():
        share[s] += groups.get(g, 300) / total
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03


def check_places(sizes, capacity):
    def total(b):
        return sum(n * n for n in Counter(capacity - x for x in b if x < capacity).values())

    bins, out = [], []
    for s in sizes:
        options = [(total([*bins[:i], b + s, *bins[i + 1 :]]), b, i) for i, b in enumerate(bins) if b + s <= capacity]
        new = total([*bins, s])
        options.append((new, -1, len(bins)))
        out.append(min(o[0] for o in options))
        boxes = P.sum_of_squares(np.array(sizes[: len(out)]), capacity)
        bins = [0] * (max(boxes) + 1)
        for x, b in zip(sizes, boxes.tolist()):
            bins[b] += x
        assert total(bins) == out[-1] and max(bins) <= capacity


def test_sum_of_squares_places_best():
    rng = random.Random(4)
    for _ in range(20):
        check_places([rng.randrange(1, 13) for _ in range(25)], 12)


def test_pack(spark):
    rng = random.Random(5)
    items = [(i, rng.randrange(0, 300)) for i in range(500)] + [(900, None), (901, 0), (902, 100)]
    df = spark.createDataFrame(items, "item_id bigint, size int")
    got = P.pack(df, spark.createDataFrame([("a", 100), ("b", 256)], "budget_name string, capacity int"), shard_items=120).collect()
    for name, cap in (("a", 100), ("b", 256)):
        own = [r for r in got if r.budget_name == name]
        per, box = Counter(), Counter()
        for r in own:
            per[r.item_id] += r.size
            box[r.container] += r.size
            assert (r.container is None) == (r.size == 0)
        assert dict(per) == {i: s or 0 for i, s in items}
        assert max(v for k, v in box.items() if k) <= cap
        assert all(sum(1 for r in own if r.item_id == i) == max(1, -(-(s or 0) // cap)) for i, s in items)
        least = max(-(-sum(per.values()) // cap), sum(1 for r in own if 2 * r.size > cap))
        assert sum(1 for k in box if k) <= 1.15 * least


def test_consensus_beats_majority(spark):
    rng = random.Random(6)
    labels = K.LABELS
    truth = {f"c{i}": rng.randrange(7) for i in range(400)}
    skill = {"a": 0.95, "b": 0.9, "c": 0.35, "d": 0.35, "e": 0.35}
    votes = [(c, who, t if rng.random() < s else (t + 1) % 7) for c, t in truth.items() for who, s in skill.items()]
    df = spark.createDataFrame(votes, "case_id string, annotator_id string, label int")
    got = {r.case_id: r.stratum for r in K.consensus(df).collect()}
    right = sum(got[c] == labels[t] for c, t in truth.items())
    by = defaultdict(list)
    for c, _, v in votes:
        by[c].append(v)
    majority = sum(Counter(v).most_common(1)[0][0] == truth[c] for c, v in by.items())
    assert right > majority and right / 400 > 0.9


def test_last_usable_draft_counts(spark):
    t = lambda h: datetime(2031, 1, 1, h)
    df = spark.createDataFrame(
        [(1, "c", "a", "Single sentence ", False, t(1)), (2, "c", "a", "cross-page-clause", False, t(2)), (2, "c", "a", "cross-page-clause", False, t(2)), (3, "c", "b", None, False, t(1)), (4, "c", "d", "single_sentence", True, t(1)), (5, "c", "e", "?", False, None), (6, None, "e", "single_sentence", False, None)],
        "draft_id bigint, case_id string, annotator_id string, stratum string, annotation_uncertain boolean, request_timestamp timestamp",
    )
    assert rows(K.usable_drafts(df)) == {("c", "a", 3)}


def test_kappa(spark):
    votes = [(str(i), a, i % 2) for i in range(10) for a in "xy"]
    k = K.fleiss_kappa(spark.createDataFrame(votes, "case_id string, annotator_id string, label int")).first()
    assert k.kappa == 1.0 and k.cases == 10


def test_ids_equal_the_library(spark, make_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", "Hello world", "<|endoftext|> it's 3,5%", "本公司，不承担给付责任。", "x" * 5000, "a\n\n  b \t", "é😀́", "    ", "本" * 3000]
    d = make_dir(documents=[{"doc_id": i, "text": x} for i, x in enumerate(texts)])
    got = {r.doc_id: r.ids for r in p8_ids(spark, d).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    e = Encoder()
    for x in filter(None, texts):
        assert e.decode(e.ids([x])[0]) == x
        o = e.offsets(x)
        assert o[0][0] == 0 and o[-1][1] == len(x) and all(a[0] <= b[0] and b[0] <= a[1] for a, b in zip(o, o[1:]))
    assert "�" in e.decode(e.ids(["😀"])[0][:1])
