import collections
import math
import zlib

import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from locarium.llm import mixing, packing
from locarium.llm.queries import tokenizer_path


def water(sizes, weights, epochs=3):
    total, clamped = sum(sizes.values()), set()
    while True:
        free = {s: weights[s] for s in sizes if s not in clamped}
        if not free:
            break
        level = (total - sum(epochs * sizes[s] for s in clamped)) / sum(free.values())
        new = {s for s in free if free[s] * level >= epochs * sizes[s]}
        if not new:
            break
        clamped |= new
    return {s: float(epochs * sizes[s]) if s in clamped else weights[s] * level for s in sizes}


def test_mix_against_plain_water_filling(spark):
    rows = [(i, prose(i, 3 + i % 40), ["a", "B", None, "é", "tiny"][i % 5] if i < 300 or i % 5 != 4 else "a") for i in range(500)]
    rows += [(900, prose(5, 20000), "a"), (901, None, "none"), (902, "  \n", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted((r["id"], r["taken"]) for r in again) == sorted((r["id"], r["taken"]) for r in got)


def test_repeated_ids_are_taken_for_what_they_are(spark):
    rows = [(1, prose(1, 10), "a")] * 7 + [(2, prose(2, 10), "b")] * 5 + [(3, prose(3, 400), "c"), (3, prose(4, 10), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, words = collections.Counter(), collections.Counter()
    for r in mixing.mix(df).collect():
        plan[r["source"]] += r["taken"]
    for r in mixing.mixed_documents(df).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == plan and all(abs(plan[r["source"]] - r["target"]) <= 1 for r in mixing.mix(df).collect())


def test_mixed_documents_hold_the_words_taken(odd, none):
    plan = collections.Counter()
    for r in mixing.mix(odd).collect():
        plan[r["source"]] += r["taken"]
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    words = collections.Counter()
    for r in out.collect():
        words[r["source"]] += len([w for w in (r["text"] or "").replace(" ", "_").split() if w])
    assert words == collections.Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def fewest(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9) | st.lists(st.integers(4, 12), min_size=3, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    lengths = sorted(lengths, reverse=True)
    state = packing.Bins(dict(collections.Counter(lengths)), 20)
    fixed = packing.reduce_instance(state)
    rest = [n for n, c in state.left.items() for _ in range(c)]
    assert fixed + (fewest(sorted(rest, reverse=True), 20) if rest else 0) == fewest(lengths, 20)


def test_three_pieces_are_fixed_together():
    # beside 11 at most two fit; 6 and 3 fill the bin, and no two pieces longer than 3 fit
    state = packing.Bins({11: 2, 6: 2, 3: 2}, 20)
    assert packing.reduce_instance(state) == 2 and not state.left
    assert {(r[0], r[5]) for r in state.rules} == {(11, 0), (6, 11), (3, 17)}
    # 5 and 4 fit as well, and both are longer than 3: nothing dominates
    assert packing.reduce_instance(packing.Bins({11: 1, 6: 1, 5: 1, 4: 1, 3: 1}, 20)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_rules_place_every_piece_once(lengths):
    counts = collections.Counter(lengths)
    state = packing.plan_bins(dict(counts), 50)
    fill, ranks = collections.defaultdict(list), collections.Counter()
    for n, lo, hi, per_bin, first, offset in state.rules:
        for r in range(lo, hi):
            fill[first + (r - lo) // per_bin].append((offset + (r - lo) % per_bin * n, n))
        ranks[n] += hi - lo
    assert ranks == counts and set(fill) == set(range(state.bins))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 50


def test_pack_against_whole_encoding(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()] + [(50, "a  b"), (51, " lead"), (52, "trail "), (53, "x\n y <|endoftext|> z"), (54, "end. \n\nNext"), (55, "a <|endoftext|> b"), (56, "x<|endoftext|>y <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, tokenizer_path()).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.asarray([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == math.ceil(sum(r["length"] for r in got) / 2048) or len(seqs) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_words_learned_together_are_those_learned_alone():
    e = packing.Encoder(tokenizer_path())
    words = ["don't", "naïve", "x\ny", "tab\tz", "日本語", "end.", "\U0001f600smile", "a" * 300, "1234567", "it's\n", "é", "--", "\u00a0x"]
    for size in (1, 3, len(words)):
        for at in range(0, len(words), size):
            e._learn(words[at : at + size])
    assert all(e.known[w] == e._encode([" " + w])[0] for w in words)
    text = "start " + " ".join(words)
    assert e.ids(text) == e._encode([text])[0]


@pytest.mark.parametrize("text", ["", "word", "two words", "a b c", "tab\tx y"])
def test_encoder_by_words(text):
    e = packing.encoder(tokenizer_path())
    assert e.ids(text) == e._encode([text])[0] if text else e.ids(text) == b""
