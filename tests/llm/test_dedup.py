import collections
import hashlib
import random

import numpy as np
import pandas as pd
import xxhash
from conftest import prose

from locarium.llm import exact_dedup, simhash, substring_dedup
from locarium.llm.common import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups_on_odd_rows(odd, none):
    got = exact_dedup.exact_groups(odd, counters=3).collect()
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in odd.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["digest"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(odd, none):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [2, 4, 5, 6, 7]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_frequent_digests_are_found_and_few(spark):
    rows = [("hot",)] * 400 + [("warm",)] * 120 + [(f"d{i}",) for i in range(480)]
    found = {r["digest"] for r in exact_dedup.frequent_digests(spark.createDataFrame(rows, "digest string").repartition(7), counters=31).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 31


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    for r in odd.collect():
        if len(r["text"] or "") < 1000:
            assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])


def test_components_of_edges_that_differ_by_evaluation(spark):
    def stars(batches):
        for b in batches:
            for _, ids in b.groupby("g")["id"]:
                ids = ids.sample(frac=1)  # another tree of the same group each time
                yield pd.DataFrame({"u": ids.iloc[1:].to_numpy(), "v": ids.iloc[:-1].to_numpy()})

    groups = spark.range(600).selectExpr("id", "id % 20 as g").repartition(6, "g")
    for _ in range(3):
        got = connected_components(groups.mapInPandas(stars, "u long, v long")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == [(i, i % 20) for i in range(600)]


def brute(fps, radius):
    ids = np.array(fps, np.uint64)
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min(label[j] for j in np.flatnonzero(np.bitwise_count(ids ^ ids[i]) <= radius))
            if low < label[i]:
                label[i] = low
                changed = True
    return label


def planted(n=400, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 8, np.uint64)
    out = list(base)
    while len(out) < n:
        f = base[rng.integers(0, 5)] if rng.random() < 0.6 else base[rng.integers(0, len(base))]
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            f ^= np.uint64(1) << np.uint64(b)
        out.append(f)
    return list(dict.fromkeys(out))


def test_bit_sliced_links_reach_the_same_groups(spark, monkeypatch):
    fps = planted()
    for chunk in (1024, 16):  # with hot buckets whole and split
        monkeypatch.setattr(simhash.cells, "__defaults__", (chunk,))
        df = spark.createDataFrame([(int(np.int64(np.uint64(f).view(np.int64))),) for f in fps], "item long")
        edges = [(r["u"], r["v"]) for r in simhash.linked(df, 4).collect()]
        place = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
        i, j = (np.array([place[e[k]] for e in edges], np.int64) for k in (0, 1))
        assert simhash.forest(len(fps), i, j).tolist() == brute(fps, 4)
        assert len(edges) < 12 * len(fps)


def test_match_finds_every_pair_within_the_radius():
    fps = np.array(planted(150, 9), np.uint64)
    for radius in (0, 3, 4, 6):
        i, j = simhash._match(fps, np.array([60, 1, len(fps) - 61]), radius)
        cell = np.repeat([0, 1, 2], [60, 1, len(fps) - 61])
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if cell[a] == cell[b] and np.bitwise_count(fps[a] ^ fps[b]) <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_finer_blocks_for_more_rows_still_agree_somewhere():
    rng = np.random.default_rng(2)
    for rows in (10, 10**7, 10**10):
        masks = simhash._block_masks(rows, 4)
        for _ in range(200):
            x = 0
            for b in rng.choice(64, 4, replace=False):
                x |= 1 << int(b)
            assert any(x & m == 0 for m in masks)


def test_near_dedup_on_odd_rows(odd, none):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    # doc 2 stands twice as a whole row; equal texts differ in case only, and so have one fingerprint
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash.simhash_groups(none).count() == 0 and simhash.near_dedup(none).count() == 0


def shingled(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_passages_are_found_wherever_they_stand(spark):
    """Passages of 51 words and more in lines of their own, in long lines, over short lines and between tabs: every one is found."""
    rng, docs, planted = random.Random(5), [], {}
    joins = (" ", "\t", "\n", "  ", "\x0b", " ")
    for case in range(120):
        words = prose(10_000 + case, 51 + case % 9).split()
        for copy in range(2):
            kind = (case + 3 * copy) % 6
            if kind == 2:
                said = "".join(w + ("\n" if k % 7 == 6 else " ") for k, w in enumerate(words))
            else:
                said = joins[kind].join(words)
            before, after = prose(rng.randrange(10**6), rng.randrange(0, 90)), prose(rng.randrange(10**6), rng.randrange(0, 90))
            around = "\n" if kind == 5 else " "
            text = before + around + (said.upper() if copy and case % 3 == 0 else said) + around + after
            planted[len(docs)] = (case, len(before) + 1, len(before) + 1 + len(said))
            docs.append((len(docs), text))
    clean = [(1000 + i, prose(50_000 + i, 40 + 7 * i)) for i in range(40)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string").repartition(5)
    got = substring_dedup.substring_dedup(df).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["component"]].add(r["id"])
    for i, (case, start, end) in planted.items():
        own = [r for r in got if r["id"] == i]
        assert own and any({2 * case, 2 * case + 1} <= by[r["component"]] for r in own), (i, case)
        # two words outside leave a similarity of 0.8, and a word or so may happen to be the same
        outside = [r for r in own if r["n_words"] == substring_dedup.PARAGRAPH and not start - 24 <= r["start"] <= r["end"] <= end + 24]
        assert not outside, (start, end, outside)
    assert not {r["id"] for r in got} & {i for i, _ in clean}
    assert all(sum(r["kept"] for r in got if r["component"] == c) == 1 for c in by)


def test_lines_against_all_pairs(spark):
    """Whole lines link as the exact Jaccard similarity of all pairs says."""
    rng, lines = random.Random(9), []
    for base in range(12):
        words = prose(70_000 + base, 60 + 5 * base).split()
        for copy in range(4):
            new = list(words)
            for k in range(copy * (1 + base % 4)):
                new[rng.randrange(len(new))] = f"zz{base}{copy}{k}"
            lines.append(new)
    df = spark.createDataFrame([(i, prose(90_000 + i, 5) + "\n" + " ".join(w) + "\n" + prose(91_000 + i, 5)) for i, w in enumerate(lines)], "doc_id long, text string").repartition(4)
    label = list(range(len(lines)))
    sets = [shingled(w) for w in lines]
    for _ in lines:
        for i in range(len(lines)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = [r for r in substring_dedup.substring_dedup(df).collect() if r["n_words"] >= 60]
    found = {r["id"]: r["component_id"] for r in got}
    assert len(got) == len(found) and all(found.get(i, i) == label[i] for i in range(len(lines)))


def test_repeats_are_cut_and_odd_rows_have_defined_results(spark, none, odd):
    passage, long = prose(77, 60), prose(78, 2000)
    docs = [(1, f"{prose(11, 30)}\n{passage}"), (2, f"{passage.upper()}\n{prose(12, 40)}"), (3, prose(13, 80) + ". " + passage + " " + prose(14, 70)), (4, prose(15, 100)), (None, None), (8, ""), (9, long), (9, long), (None, passage), (10, "la " * 500), (11, "la " * 400)]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, row int").repartition(3)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(docs)
    cleaned = collections.defaultdict(list)
    for r in out.collect():
        cleaned[r["doc_id"]].append(r["text"])
    assert cleaned[1] == [docs[0][1]] and cleaned[4] == [docs[3][1]] and None in cleaned[None] and cleaned[8] == [""]
    assert cleaned[2][0].strip() == prose(12, 40)
    # within a long line the two ends of the passage may stay, up to the words from which nothing begins
    assert len(cleaned[3][0].split()) <= 150 + 40 and prose(13, 80) in cleaned[3][0] and prose(14, 70) in cleaned[3][0]
    once, twice = sorted(cleaned[9], key=len)
    assert twice == long and once.strip() == ""
    assert substring_dedup.substring_dedup(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0
    got = substring_dedup.substring_dedup(odd).collect()
    assert {r["id"] for r in got} == {5, 6} and {r["component_id"] for r in got} == {5}  # the two very long texts; no other has fifty words


def test_cells_of_all_sizes_link_as_all_pairs_do():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for cell, n in enumerate([1, 2, 2, 3, 5, 8, 9, 30, 300]):
        base = [rng.integers(0, 1 << 62, 40) for _ in range(1 + n // 6)]
        for k in range(n):
            s = base[rng.integers(0, len(base))].copy()
            s[rng.integers(0, 40, rng.integers(0, 7))] = rng.integers(0, 1 << 62)
            item = 1000 * cell + k
            sets[item] = set(s.tolist())
            rows.append((cell, 0, 0, item, sorted(sets[item])))
    table = pa.Table.from_pylist([dict(zip(("bucket", "a", "b", "item", "shingles"), r, strict=True)) for r in rows])
    got = [e for b in substring_dedup._verified(iter(table.to_batches(max_chunksize=37)), 0.8) for e in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    items = [r[3] for r in rows]
    near = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    want = [(i, j) for i in range(len(items)) for j in range(i) if items[i] // 1000 == items[j] // 1000 and near(items[i], items[j])]
    place = {x: k for k, x in enumerate(items)}
    roots = [simhash.forest(len(items), *(np.array([p[k] for p in pairs], np.int64) for k in (0, 1))).tolist() for pairs in (want, [(place[u], place[v]) for u, v in got])]
    assert roots[0] == roots[1] and len(got) < len(items)


def test_chains_in_large_cells_stay_whole():
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(20):
        starts = rng.sample(range(40), 40)  # each set is similar to its two neighbours in the chain only
        rows = [{"bucket": 0, "a": 0, "b": 0, "item": k, "shingles": list(range(2 * s, 2 * s + 20))} for k, s in enumerate(starts)]
        (got,) = substring_dedup._verified(iter(pa.Table.from_pylist(rows).to_batches()), 0.8)
        assert len(set(simhash.forest(40, got["u"].to_numpy(), got["v"].to_numpy()).tolist())) == 1


def test_meeting_rows_of_sorted_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400), rng.randrange(6)) for _ in range(500)] + [(7, 1)] * 30_000
    counts = collections.Counter(rows)
    sizes = collections.Counter(b for b, _ in rows)
    want = {(b, i, n) for (b, i), n in counts.items() if sizes[b] > 1}
    got = substring_dedup._meeting(spark.createDataFrame(rows, "bucket long, item long").repartition(6)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tune_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995
