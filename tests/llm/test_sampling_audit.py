import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from conftest import prose

from locarium.llm import curve_packing, filter_audit, importance
from locarium.llm.queries import tokenizer_path

LOWER = {i: i + 32 for i in range(65, 91)}


def drawn(docs, target, max_n=1, buckets=10_000, percent=10, least=20):
    """Rows (id, words, features, weight, score, rank) by counting every feature where it stands."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b for f in found for b in f[2]), collections.Counter(b for x in target for b in features(x)[1])
    of_s, of_t = s.total(), t.total()
    out = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    ranks = [r + 1 if r < len(fit) * percent // 100 else None for r in range(len(fit))]
    return [(*o, r) for o, r in zip(fit, ranks, strict=True)] + [(*o, None) for o in out if o[1] < least]


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, prose(i, 5 + i % 60) + (" Ünïcode 42x" if i % 3 else " it's A-b_c"), "en") for i in range(300)] + [(400 + i, prose(7, 40), "en") for i in range(90)] + [(500, None, None), (501, "", ""), (502, prose(3, 20_000), "en"), (None, prose(9, 30), None), (None, "", "de")]
    target = [prose(1000 + i, 25) for i in range(20)] + [None, ""]
    return rows, target, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string").repartition(2)


@pytest.mark.parametrize(("max_n", "percent", "chunk_words", "chunk_distinct"), [(1, 10, 1 << 21, 1 << 19), (1, 37, 300, 50), (3, 10, 1 << 21, 1 << 19), (2, 100, 1, 1)])
def test_importance_against_counting_everywhere(mixed, max_n, percent, chunk_words, chunk_distinct):
    rows, target, docs, aims = mixed
    got = importance.importance(docs, aims, max_n=max_n, percent=percent, chunk_words=chunk_words, chunk_distinct=chunk_distinct).collect()
    want = drawn([r[:2] for r in rows], target, max_n, percent=percent)
    assert in_order((r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == in_order(want)


def test_spelling_doesnt_depend_on_the_words_sent_along(mixed, monkeypatch):
    rows, target, docs, aims = mixed
    whole = importance._spelt.__defaults__
    monkeypatch.setattr(importance._spelt, "__defaults__", (7,))
    few = importance.importance(docs, aims, max_n=2).select("id", "weight").collect()
    monkeypatch.setattr(importance._spelt, "__defaults__", whole)
    assert in_order(few) == in_order((r[0], r[3]) for r in drawn([r[:2] for r in rows], target, 2))


def test_importance_of_odd_and_empty_tables(odd, none, spark):
    got = importance.importance(odd, odd, percent=50).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = drawn(rows, [t for _, t in rows], percent=50)
    assert in_order((r["id"], r["weight"], r["score"], r["rank"]) for r in got) == in_order((w[0], w[3], w[4], w[5]) for w in want)
    assert importance.importance(none, odd).count() == 0
    assert [r["weight"] for r in importance.importance(odd, none).where("id = 3 or id = 4").collect()] == [0, 0]


@pytest.mark.parametrize(("n", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_the_curve_meets_every_cell_once_in_single_steps(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = curve_packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def _check_pieces(rows, docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    by_row, want, got = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in rows:
        by_row[r["row"]].append(r)
    for i, t in docs:
        want[(i, zlib.crc32(np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))] += 1
    ids_of = {i: {zlib.crc32(x.tobytes()): x for x in [np.asarray([*tok.encode(u or "", add_special_tokens=False).ids, 0], "<u4") for j, u in docs if j == i]} for i, _ in docs}
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        fits = [c for c, x in ids_of[pieces[0]["id"]].items() if len(x) == pieces[0]["doc_tokens"] and all(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)]
        assert fits and [r["start"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1] and sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
        got[(pieces[0]["id"], fits[0])] += 1
    assert got == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


@pytest.mark.parametrize("capacity", [1024, 64, 1])
def test_curve_packing_round_trip_without_padding(odd, none, capacity):
    docs = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is null or doc_id not in (5, 6)").collect()]
    of = odd if capacity == 1024 else odd.where("doc_id is null or doc_id not in (5, 6)")
    docs = [(r["doc_id"], r["text"]) for r in of.collect()]
    _check_pieces(curve_packing.pack_along_curve(of, tokenizer_path(), capacity=capacity).collect(), docs, capacity)
    assert curve_packing.pack_along_curve(none, tokenizer_path()).count() == 0


def test_a_group_of_copies_is_split_over_ranges_and_neighbours_are_alike(spark):
    words = [[f"{a}{b}" for b in ("lo", "mi", "ran", "tes", "vu")] for a in ("ba", "kri", "zo")]
    rng = np.random.default_rng(5)
    topics = {i: i % 3 for i in range(240)}
    docs = [(i, " ".join(rng.choice(words[k], 60))) for i, k in topics.items()] + [(1000 + i, "same text " * 30) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = curve_packing.pack_along_curve(df, tokenizer_path()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    _check_pieces(rows, docs, 1024)
    assert len({r["sequence_id"] >> 32 for r in rows if r["id"] >= 1000}) > 1
    order = [topics[i] for i in dict.fromkeys(r["id"] for r in sorted(rows, key=lambda r: (r["key"], r["row"]))) if i in topics]
    assert sum(a == b for a, b in itertools.pairwise(order)) > 0.8 * len(order)


def audited(docs, labels, orders=None):
    """Every order applied to all rows, one filter after another."""
    good, toxic = collections.Counter(), collections.Counter()
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = max(good[i], q or 0), max(toxic[i], t or 0)
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((part or "", {f for f in fails if fails[f]}, good[i] == 1, toxic[i] == 1))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order_by_itself(spark, odd, none):
    texts = [prose(1, 250), prose(2, 100), "x " * 300, "AB cd " * 120, prose(3, 220) + " 5%", "", None, "tab\tand\x0bmore"]
    docs = [(i, texts[(i * i + i // 7) % len(texts)] if i % 5 else prose(i, 30 + 5 * i), ["en", "de", None, "", "fr"][i % 5 if i < 80 else 0]) for i in range(120)]
    docs += [(None, texts[0], "en"), (None, texts[0], "xx"), (7, texts[0], "en"), (7, texts[0], "en"), (-1, texts[2], "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (7, None, 1), (7, 1, None), (None, 1, 1)]
    df, of = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for counters in (1023, 3):
        assert {tuple(r[n] for n in names) for r in filter_audit.audit(df, of, counters=counters).collect()} == audited(docs, labels)
    got = filter_audit.audit(odd, of.limit(0)).collect()
    assert {tuple(r[n] for n in names) for r in got} == audited([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [])
    assert filter_audit.audit(none, of).count() == 0


def test_the_trie_makes_each_unordered_state_once(spark):
    rows = spark.createDataFrame([("", False, False, True, False, True, False)], "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean, D boolean")
    trie = filter_audit.Trie(rows, "ABCD").walk()
    assert len(trie.survivors) == 15 and len(trie.edges) == 15  # all but the one that no filter follows


def test_words_by_merges_are_those_of_the_tokenizer():
    e = curve_packing.MergingEncoder(tokenizer_path())
    assert e.merging is not None
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789.,;:!?'-_()[]{}#$%&*|<>/\\\"éèñßüÆœ€²³½\t\n\u00a0\u0301\u4e2d\u0416\U0001f600")
    for size in (3, 8, 20):
        text = " ".join("".join(rng.choice(letters, rng.integers(1, size))) for _ in range(20_000))
        assert e.ids(text) == e._encode([text])[0]
        for part in (text[:500], text[777:9000], prose(size, 3000)):
            assert e.ids(part) == e._encode([part])[0]
    for text in ("", " lead", "trail ", "a  b", "x <|endoftext|> y", "it's don't we'll", "tab\tx y\n z"):
        assert e.ids(text) == e._encode([text])[0] if text else e.ids(text) == b""
