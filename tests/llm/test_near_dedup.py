import random
from collections import defaultdict

import numpy as np
from helpers import documents, edge_docs, empty_docs

from tablelens.llm import near_dedup, queries


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.random()
        if words and k < 0.4:
            words[r.randrange(len(words))] = r.randint(1, 12)
        elif words and k < 0.7:
            del words[r.randrange(len(words))]
        else:
            words.insert(r.randint(0, len(words)), r.randint(1, 12))
    return words


def test_banded_alignment_is_the_edit_distance_up_to_its_limit(monkeypatch):
    r, pairs, limit = random.Random(1), [], []
    for _ in range(400):
        a = [r.randint(1, 12) for _ in range(r.randint(0, 60))]
        pairs.append((np.array(a, np.uint32), np.array(edited(r, a, r.randint(0, 14)), np.uint32)))
        limit.append(r.choice([0, 2, 5, 9, 12]))
    want = [d if (d := edit_distance(a.tolist(), b.tolist())) <= m else -1 for (a, b), m in zip(pairs, limit)]
    assert near_dedup.distances(pairs, np.array(limit)).tolist() == want
    monkeypatch.setattr(near_dedup, "WIDE", 200)
    assert near_dedup.distances(pairs, np.array(limit)).tolist() == want


def test_sketch_keeps_the_order_of_the_text():
    a = "one two three four five six seven eight nine ten eleven twelve".split()
    b = a[6:] + a[:6]  # the same words in another order
    words, count = near_dedup.words_of([" ".join(a), " ".join(b), " ".join(a).upper() + " !!"])
    values = near_dedup.sketch(words, count, k=1, picked=2)
    assert (values[0] == values[2]).all()
    assert (values[0] != values[1]).any()
    assert (near_dedup.sketch(words, count, k=1, picked=1)[0] == near_dedup.sketch(words, count, k=1, picked=1)[1]).all()


def test_repeated_k_mers_are_told_apart():
    words, count = near_dedup.words_of(["a a a a a a a a", "a a a a a a"])
    values = near_dedup.sketch(words, count)
    assert (values[0] != values[1]).any()


def brute_classes(rows):
    """Components of all pairs of word similarity 0.8 and more."""
    keys = [(r.text or "").lower() for r in rows]
    words, count = near_dedup.words_of(keys)
    edge = np.concatenate([[0], np.cumsum(count)])
    seq = [tuple((words[a:b] >> np.uint64(32)).astype(np.uint32).tolist()) or keys[i] for i, (a, b) in enumerate(zip(edge[:-1], edge[1:]))]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if isinstance(seq[i], tuple) and isinstance(seq[j], tuple)]
    arrays = [np.array(s if isinstance(s, tuple) else [], np.uint32) for s in seq]
    limit = np.array([int(max(len(seq[i]), len(seq[j])) * 0.2 + 1e-9) for i, j in pairs])
    near = near_dedup.distances([(arrays[i], arrays[j]) for i, j in pairs], limit) >= 0
    for (i, j), ok in zip(pairs, near):
        if ok:
            parent[find(i)] = find(j)
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i].text or "") == (rows[j].text or ""):
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i].doc_id)
    return sorted(sorted(map(str, g)) for g in out.values())


def classes(found):
    out = defaultdict(list)
    for r in found.collect():
        out[r.class_id].append(str(r.doc_id))
    return sorted(sorted(g) for g in out.values())


def test_query(spark):
    found = queries.QUERIES["op5_order_minhash"](spark, "/root/testdata/sf0.001")
    rows = documents(spark).collect()
    assert found.columns == ["doc_id", "class_id", "class_size", "n_links", "kept"]
    assert classes(found) == brute_classes(rows)
    for r in found.collect():
        assert r.kept == (r.doc_id == r.class_id)


def test_chains_and_hot_groups(spark):
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    base = r.choices(vocabulary, k=120)
    rows, key = [], 0
    for _ in range(40):  # a group of near copies of one text
        t = list(base)
        for _ in range(4):
            t[r.randrange(120)] = r.choice(vocabulary)
        rows.append((key, " ".join(t)))
        key += 1
    chain = r.choices(vocabulary, k=100)
    for step in range(6):  # each is near the one before it, the last isn't near the first
        rows.append((key, " ".join(chain)))
        key += 1
        chain = list(chain)
        for p in range(10):
            chain[step * 15 + p] = f"new{step}{p}"
    passage = r.choices(vocabulary, k=60)
    for _ in range(30):  # a shared passage makes no near copies
        rows.append((key, " ".join(r.choices(vocabulary, k=60) + passage + r.choices(vocabulary, k=60))))
        key += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(near_dedup.near_classes(docs)) == brute_classes(docs.collect())


def test_components(spark):
    edges = [(5, 2), (9, 5), (9, 3), (20, 11), (21, 20), (22, 21), (23, 22), (24, 23), (30, 7)]
    got = {r.r: r.root for r in near_dedup.components(spark.createDataFrame(edges, "r long, head long")).collect()}
    assert got == {5: 2, 9: 2, 3: 2, 20: 11, 21: 11, 22: 11, 23: 11, 24: 11, 30: 7}


def test_edges(spark):
    docs = edge_docs(spark)
    found = near_dedup.near_classes(docs).collect()
    assert len(found) == docs.count()
    one = {r.doc_id: r for r in found if r.doc_id}
    assert one[1].class_id == one[4].class_id == 1 and one[1].class_size == 3
    assert one[2].class_size == 3  # the null and empty texts
    assert one[8].class_size == one[9].class_size == one[10].class_size == 1
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.kept)
    assert near_dedup.near_classes(empty_docs(spark)).count() == 0
    assert near_dedup.drop_near(empty_docs(spark)).count() == 0


def test_variants_of_a_hub_are_one_class(spark):
    """Edited copies that are near the last row but not near one another."""
    r = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    for words, share, n in ((300, 0.12, 150), (300, 0.15, 50)):
        hub = r.choices(vocabulary, k=words)
        rows = []
        for key in range(n):
            t = list(hub)
            for p in r.sample(range(words), int(words * share)):
                t[p] = f"new{r.randrange(10**9)}"
            rows.append((key, " ".join(t)))
        docs = spark.createDataFrame(rows + [(n, " ".join(hub))], "doc_id long, text string").coalesce(1)
        found = near_dedup.near_classes(docs).collect()
        print("classes", share, n, len({x.class_id for x in found}))
        linked = [x for x in found if x.class_size > 1]
        assert len({x.class_id for x in linked}) == 1 and len(linked) >= 0.95 * n


def replaced(r, words, n):
    words = list(words)
    for p in r.sample(range(len(words)), n):
        words[p] = f"new{r.randrange(10**9)}"
    return words


def test_recall_at_the_least_similarity(spark):
    r = random.Random(12)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows, kinds = [], [(n, int(n * e + 1e-9)) for n in (20, 40, 100, 300) for e in (0.1, 0.15, 0.2)] + [(15, 3), (17, 3)]
    for words, edits in kinds:
        for _ in range(100):
            base = r.choices(vocabulary, k=words)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(replaced(r, base, edits)))]
    found = {x.doc_id: x.class_id for x in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {}
    for i, kind in enumerate(kinds):
        got[kind] = sum(found[k] == found[k + 1] for k in range(200 * i, 200 * i + 200, 2))
    print("recall", got)
    assert min(got.values()) >= 95


def test_short_texts_are_found_exactly(spark):
    r = random.Random(13)
    rows = [(0, "a b c d e f g h i"), (1, "a b c d X f g h i")]
    vocabulary = [f"word{i}" for i in range(500)]
    for words in range(4, 15):
        for _ in range(30):
            base = r.choices(vocabulary, k=words)
            other = list(base)
            for _ in range(max(1, words // 5)):
                what = r.random()
                if what < 0.4:
                    other = replaced(r, other, 1)
                elif what < 0.7:
                    del other[r.randrange(len(other))]
                elif len(other) < 14:
                    other.insert(r.randint(0, len(other)), "more")
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(near_dedup.near_classes(docs)) == brute_classes(docs.collect())


def test_large_buckets_go_on_until_nothing_is_left(spark, monkeypatch):
    """Seven texts of the same sketch; only the last two are near."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    texts = [np.arange(100 * i, 100 * i + 20, dtype="<u4") for i in range(6)]
    texts.append(np.concatenate([texts[5][:-1], [7]]).astype("<u4"))
    values = list(range(near_dedup.VALUES))
    rows = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "r long, words binary")
    reps = spark.createDataFrame([(i, 20, values) for i in range(7)], "r long, n long, values array<long>")
    assert [tuple(x) for x in near_dedup.links(rows, reps).collect()] == [(6, 5)]


def test_a_near_pair_of_a_large_bucket_needs_no_other_value(spark):
    """A bucket of 60 unlike texts whose other values all differ; two of its texts are near."""
    r = random.Random(21)
    texts = [np.array(r.sample(range(10**9), 25), "<u4") for _ in range(60)]
    texts[41] = np.concatenate([texts[17][:21], texts[41][:4]]).astype("<u4")
    rows = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "r long, words binary")
    values = [[7] + [1000 * (i + 1) + k for k in range(1, near_dedup.VALUES)] for i in range(60)]
    reps = spark.createDataFrame([(i, 25, v) for i, v in enumerate(values)], "r long, n long, values array<long>")
    assert [tuple(x) for x in near_dedup.links(rows, reps).collect()] == [(41, 17)]


def test_rows_of_large_buckets_are_verified_inside_them_and_once(spark, monkeypatch):
    """Texts about as far apart as the limit, which maps can't tell, in several buckets: only
    the near pairs of different roots are rows, each once, whatever the blocks."""
    r = random.Random(25)
    base = r.sample(range(10**9), 40)
    texts = []
    for _ in range(50):
        t = list(base)
        for p in r.sample(range(40), 5):
            t[p] = r.randrange(10**9)
        texts.append(t)
    held = {b: r.sample(range(50), 40) for b in (-5, 3, 8, 2**62)}
    root = {(b, x): r.randrange(2) if b == 3 else x // 2 for b in held for x in held[b]}
    want = set()
    for b, members in held.items():
        for x in members:
            for y in members:
                if y < x and root[b, x] != root[b, y] and edit_distance(texts[x], texts[y]) <= 8:
                    want.add((x, y, True, edit_distance(texts[x], texts[y])))
    assert 100 < len(want) < 1000
    rows = spark.createDataFrame([(i, bytearray(np.array(t, "<u4").tobytes())) for i, t in enumerate(texts)], "r long, words binary")
    left = spark.createDataFrame([(b, x, 40, 40, root[b, x]) for b in held for x in held[b]], "b long, r long, n long, held long, root long")
    for block, words, few in ((16, 1 << 23, 10**6), (100, 500, 10**6), (100, 1 << 23, 0)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_WORDS", words)
        monkeypatch.setattr(near_dedup, "FEW", few)
        found = [tuple(x) for x in near_dedup._within(left, rows).collect()]
        assert len(found) == len(want) and set(found) == want


def test_near_texts_share_one_of_their_first_words_in_any_order():
    r = random.Random(22)
    for _ in range(3000):
        a = [r.randint(1, 12) for _ in range(r.randint(1, 40))]
        b = edited(r, a, r.randint(1, 8))
        limit = int(max(len(a), len(b)) * 0.2 + 1e-9)
        if a == b or not b or edit_distance(a, b) > limit:
            continue
        salt = np.uint64(r.randrange(2**63) | 1)
        first = []
        for t in (a, b):
            h = near_dedup.labelled(np.array(t, np.uint32))
            first.append(set(h[np.argsort(h * salt)[: int(0.2 * len(t) + 1e-9) + 1]].tolist()))
        assert first[0] & first[1], (a, b)


def test_components_of_a_long_chain_and_a_star(spark):
    r = random.Random(23)
    nodes = list(range(1, 400))
    r.shuffle(nodes)
    edges = [(max(a, b), min(a, b)) for a, b in zip(nodes, nodes[1:])] + [(1000, k) for k in range(500, 600)]
    got = {x.r: x.root for x in near_dedup.components(spark.createDataFrame(edges, "r long, head long")).collect()}
    assert got == {k: 1 for k in range(2, 400)} | {k: 500 for k in range(501, 600)} | {1000: 500}


def test_near_texts_share_enough_of_their_first_values():
    """For any order of the values, also of texts with few different words."""
    r = random.Random(24)
    often = np.array([r.randrange(50) for _ in range(near_dedup.COUNTERS)])
    tried = 0
    for turn in range(3000):
        a = [r.randint(1, r.choice((4, 12, 10**6))) for _ in range(r.randint(4, 60))]
        b = edited(r, a, r.randint(1, 12))
        limit = int(max(len(a), len(b)) * 0.2 + 1e-9)
        if a == b or not b or edit_distance(a, b) > limit:
            continue
        tried += 1
        one, other = ({h: x for h, *x in zip(*[v.tolist() for v in near_dedup.first_values([np.array(t, np.uint32)], often)[0]])} for t in (a, b))
        move, held = len(a) - len(b), [0, 0]
        for h in one.keys() & other.keys():
            (p, p2, c), (q, q2, d) = one[h], other[h]
            if abs(move) + 2 * max(0, p - q2 - max(0, move), min(0, move) - (p2 - q)) <= limit:
                held = [held[0] + c, held[1] + d]
        assert held[0] > int(len(a) * 0.25 + 1e-9) - limit or held[1] > int(len(b) * 0.25 + 1e-9) - limit, (a, b)
    assert tried > 300


def test_first_values_of_a_batch_are_those_of_each_text():
    r = random.Random(25)
    often = np.zeros(near_dedup.COUNTERS, np.int64)
    texts = [np.array([r.randint(1, 9) for _ in range(r.randint(0, 80))], np.uint32) for _ in range(40)]
    for x, y in zip(near_dedup.first_values(texts, often), [near_dedup.first_values([t], often)[0] for t in texts]):
        assert [v.tolist() for v in x] == [v.tolist() for v in y]


def test_unlike_texts_with_a_rare_word_in_common_are_no_candidates(spark):
    """Sixty texts of one word that is nowhere else; each pair shared it, but no run of words."""
    r = random.Random(26)
    texts = [[7] + r.sample(range(10, 10**9), 40) for _ in range(60)]
    texts.append(texts[5][:36] + r.sample(range(10, 10**9), 5))
    rows = spark.createDataFrame([(i, bytearray(np.array(t, "<u4").tobytes())) for i, t in enumerate(texts)], "r long, words binary")
    some = spark.createDataFrame([(i, i) for i in range(61)], "r long, root long")
    assert [tuple(x) for x in near_dedup._sharing(some, rows).collect()] == [(60, 5)]


def test_maps_rule_out_no_near_pair():
    r = random.Random(27)
    tried = 0
    for turn in range(1500):
        a = [r.randint(1, r.choice((4, 12, 10**6))) for _ in range(r.randint(1, 70))]
        b = edited(r, a, r.randint(1, 14))
        limit = int(max(len(a), len(b)) * 0.2 + 1e-9)
        if not b or edit_distance(a, b) > limit:
            continue
        tried += 1
        texts = [np.array(t, np.uint32) for t in (a, b)]
        i, j = near_dedup.may_be_near(np.array([len(a), len(b)]), [near_dedup.word_maps(t) for t in texts], [np.array([0, 1])])
        assert sorted((*i.tolist(), *j.tolist())) == [0, 1], (a, b)
    assert tried > 300


def test_maps_tell_texts_of_a_common_passage_apart():
    """Any two share half of their words and are at the least similarity's length of each other."""
    r = random.Random(28)
    passage = [r.randrange(10**9) for _ in range(100)]
    texts = [np.array([r.randrange(10**9) for _ in range(90 + k % 30)] + passage, np.uint32) for k in range(300)]
    texts[250] = np.concatenate([texts[40][:-10], texts[3][:10]])
    sizes, maps = np.array([len(t) for t in texts]), [near_dedup.word_maps(t) for t in texts]
    i, j = near_dedup.may_be_near(sizes, maps, [np.arange(300)])
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == {(40, 250)}
    one = np.zeros(300, int)
    assert not len(near_dedup.may_be_near(sizes, maps, [one])[0])


def test_a_large_bucket_makes_no_row_for_each_of_its_runs(spark, monkeypatch):
    """Of 60 texts with a common passage two pairs are near; blocks of 16 find them, too."""
    monkeypatch.setattr(near_dedup, "_sharing", None)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(29)
    passage = [r.randrange(10**9) for _ in range(30)]
    texts = [[r.randrange(10**9) for _ in range(30)] + passage for _ in range(60)]
    texts[41] = texts[17][:55] + [1, 2, 3, 4, 5]
    texts[50] = texts[49][4:]
    rows = spark.createDataFrame([(i, bytearray(np.array(t, "<u4").tobytes())) for i, t in enumerate(texts)], "r long, words binary")
    reps = spark.createDataFrame([(i, len(t), [7] + [1000 * (i + 1) + k for k in range(1, near_dedup.VALUES)]) for i, t in enumerate(texts)], "r long, n long, values array<long>")
    assert sorted(tuple(x) for x in near_dedup.links(rows, reps).collect()) == [(41, 17), (50, 49)]
