import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from halogrid.llm.packing import WordIds, best_fit, bin_completion, fillings, lower_bound, pack_documents, reachable

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
IDS = WordIds(PATH)


def true_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("'strevmld <|́Σﬁ漢")), max_size=60))
def test_ids_equal_the_tokenizers(text):
    assert [x.tolist() for x in IDS.ids([text, "a", text])] == [[*true_ids(t), 0] for t in (text, "a", text)]


def test_special_tokens():
    for t in ("a <|endoftext|> b", "it's\x1cWE'LL", "İstanbul ΣΑΣ x²", ""):
        assert IDS.ids([t])[0].tolist() == [*true_ids(t), 0]


def exact_bins(sizes, cap):
    """Fewest bins by trying all ways."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap and bins[j] not in bins[:j]:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    for seed in range(400):
        r = random.Random(seed)
        kinds = [r.randint(5, 60) for _ in range(r.randint(1, 11))]
        sizes = sorted(kinds if seed % 2 else (r.choice(kinds[:4]) for _ in range(r.randint(1, 11))), reverse=True)
        counts = dict(Counter(sizes))
        found = bin_completion(counts, 100)
        plan = found.plan
        assert found.optimal and found.bins == sum(n for _, n in plan)
        got = Counter()
        for f, n in plan:
            assert sum(f) <= 100
            got.update({s: n * k for s, k in Counter(f).items()})
        assert got == Counter(counts)
        assert lower_bound(counts, 100) <= sum(n for _, n in plan) == exact_bins(sizes, 100) <= sum(n for _, n in best_fit(counts, 100))


def test_search_past_best_fit_and_the_bound():
    # Best fit takes the 6s two by two; only the search sees that each 7 needs one of them and a 3.
    found = bin_completion({7: 2, 6: 4, 4: 2, 3: 4, 2: 1}, 16)
    assert found.bins == exact_bins([7, 7, 6, 6, 6, 6, 4, 4, 3, 3, 3, 3, 2], 16) and found.optimal
    # Two of 34 take a bin, and 33 fits beside no two: no bound of sums sees it, the whole tree does.
    found = bin_completion({34: 300, 33: 1}, 100)
    assert (found.bins, found.optimal) == (151, True)
    assert not bin_completion({34: 300, 33: 1}, 100, steps=5).optimal
    # Very many pieces of one id: fillings are as deep as they have sizes, not pieces.
    assert bin_completion({1: 5000, 2047: 3}, 2048).bins == 6


def every_filling(counts, top, cap):
    """Fillings around one piece of size top, each with its rest, by trying all."""
    sizes = sorted(counts)
    out = set()

    def go(i, chosen):
        if sum(chosen) <= cap:
            out.add(tuple(sorted(chosen, reverse=True)))
            for j in range(i, len(sizes)):
                if chosen.count(sizes[j]) < counts[sizes[j]]:
                    go(j, [*chosen, sizes[j]])

    go(0, [top])
    return out


def test_fillings_leave_out_only_dominated_sets():
    for seed in range(100):
        r = random.Random(seed)
        counts = {r.randint(3, 30): r.randint(1, 3) for _ in range(r.randint(1, 7))}
        top, sizes = max(counts), sorted(counts)
        got = list(fillings(sizes, reachable(sizes, 50), counts, top, 50, lambda: 50, None, lambda: None))
        keys = [(50 - sum(f), [-s for s in f]) for f in got]
        assert keys == sorted(keys) and len(set(got)) == len(got)
        whole = every_filling(counts, top, 50)
        assert set(got) <= whole
        for f in whole - set(got):
            room, have = 50 - sum(f), Counter(f)
            free = {s for s in counts if counts[s] > have[s]}
            rest = f[1:]
            pairs = {rest[i] + rest[j] for i in range(len(rest)) for j in range(i)}
            assert any(s <= room for s in free) or any(x < s <= x + room for x in rest for s in free) or any(p <= s <= p + room for p in pairs for s in free)
        for i, f in enumerate(got[:5]):
            assert list(fillings(sizes, reachable(sizes, 50), counts, top, 50, lambda: 50, f, lambda: None)) == got[i + 1 :]


def test_round_trip(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["the", "Where", "ñandú", "x1", "café!!", "it's"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 90))) for i in range(150)] + [(150, None), (151, ""), (7, "again"), (7, "again"), (None, "no id"), (152, text(900)), (153, "漢字 Σ")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, length int, salt string").repartition(5)
    got = pack_documents(df, capacity=64).collect()
    want = Counter()
    for d, t in rows:
        ids = [*true_ids(t), 0]
        for i in range(0, len(ids), 64):
            want[d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    seqs = defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) <= sum(x.length for x in got) // 64 + 3


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
