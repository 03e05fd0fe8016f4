"""Vectorised kernels of the corpus operators against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tessella.llm import chaining, common, decontam, simhash, suffix


def test_words_and_chunks():
    texts = ["Ab c\tab", None, "", "x" * 50, "ä b"]
    got = []
    for i, j, offsets, data in common.text_chunks(pa.array(texts), 8):
        s, e, rows, h = common.words(offsets, data)
        raw = data.tobytes()
        got += [(i + r, raw[a:b].lower(), x) for a, b, r, x in zip(s, e, rows, h)]
    assert [(r, w) for r, w, _ in got] == [(0, b"ab"), (0, b"c"), (0, b"ab"), (3, b"x" * 50), (4, "ä".encode()), (4, b"b")]
    assert got[0][2] == got[2][2] != got[1][2]


def test_simhash_definition():
    def plain(text):
        w = text.encode().translate(common.LOWER).split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = ["", "one", "a b c", "The quick  brown fox\tjumps over the lazy dog", "a b c d a b c d", "é è  ê ë"]
    assert simhash.text_fingerprints([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_trie_links_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    for trial in range(20):
        seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)
        near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(4)]
        keys = np.unique(np.array([*seeds, *near], np.uint64))
        label = simhash.trie_components(keys, 3, 0)
        want = list(range(len(keys)))

        def find(x):
            while want[x] != x:
                x = want[x]
            return x

        for i in range(len(keys)):
            for j in range(i):
                if int(keys[i] ^ keys[j]).bit_count() <= 3:
                    a, b = find(i), find(j)
                    want[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(keys))] == label.tolist()


def test_interval_expansion_equals_counting():
    random.seed(1)
    for trial in range(60):
        length, letters = random.choice([3, 5, 8, 20]), random.choice([b"ab", b"abc", bytes(range(256))])
        texts = list({bytes(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(random.randint(1, 12))})
        weights = np.array([random.choice([1, 1, 1, 2]) for _ in texts])
        counts = Counter()
        for t, k in zip(texts, weights):
            for i in range(len(t) - length + 1):
                counts[t[i : i + length]] += k
        want = [[counts[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        got = [[False] * max(0, len(t) - length + 1) for t in texts]
        for t, a, b in zip(*suffix.repeated_windows(texts, weights, length)):
            got[t][a : b + 1] = [True] * (b - a + 1)
        assert got == want


def test_bounded_prefixes():
    random.seed(5)
    text = bytes(random.choice(b"ab") for _ in range(80)) + b"\0" + bytes(random.choice(b"ab") for _ in range(50)) + b"\0"
    symbols = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    symbols[np.array([80, 131])] = 0
    sa, lcp = suffix.bounded_prefixes(symbols, 6)
    for i in range(1, len(sa)):
        a, b = text[sa[i - 1] :], text[sa[i] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n] and a[n] != 0:
            n += 1
        assert lcp[i] == min(n, 6) or b"\0" in a[: lcp[i]]


def test_super_windows_part_the_windows():
    random.seed(2)
    for trial in range(30):
        length, gram = random.choice([(20, 6), (30, 10), (12, 4)])
        texts = [bytes(random.choice(b"ab") if random.random() < 0.9 else 99 for _ in range(random.randint(0, 120))) for _ in range(6)]
        texts[1], texts[3] = texts[0][5:60] + texts[1], b"z" * 70
        offsets = np.cumsum([0] + [len(t) for t in texts])
        row, lo, hi, v, anchors, _ = suffix.super_windows(offsets, np.frombuffer(b"".join(texts), np.uint8), length, gram)
        value, count, n = {}, Counter(), Counter()
        for r, a, b, x, k in zip(row, lo, hi, v, anchors):
            n[x] += k
            for s in range(a, b + 1):
                w = texts[r][s : s + length]
                assert len(w) == length and value.setdefault(w, x) == x
                count[w] += 1
        assert sum(count.values()) == sum(max(0, len(t) - length + 1) for t in texts)
        assert all(n[value[w]] > 1 for w, c in count.items() if c > 1)


def test_chains_follow_the_order_in_both():
    x = [0, 3, 6, 9, 12, 40, 43]
    y = [100, 103, 106, 5, 112, 300, 303]
    best = chaining.best_chains(x, y)[0]
    assert [(x[i], y[i]) for i in best][:3] == [(0, 100), (3, 103), (6, 106)] and 3 not in best
    brute = max(len(c) for c in chaining.best_chains(x, y))
    assert brute >= 4


def test_common_words_is_the_longest_common_subsequence():
    random.seed(4)
    for trial in range(50):
        u, v = ([random.randint(0, 5) for _ in range(random.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i, a in enumerate(u):
            for j, b in enumerate(v):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        assert chaining.common_words(u, v) == t[-1][-1]


def test_alignment_traces_back_a_longest_common_subsequence():
    random.seed(14)
    for trial in range(80):
        u, v = ([random.randint(0, 6) for _ in range(random.randint(0, 40))] for _ in range(2))
        pairs = chaining.matched_words(u, v)
        assert len(pairs) == chaining.common_words(u, v) and all(u[i] == v[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        best = chaining.best_part(pairs)
        scores = [
            (n - m + 1 + chaining.UNMATCHED * sum(max(c - a, d - b) - 1 for (a, b), (c, d) in zip(pairs[m:n], pairs[m + 1 : n + 1])))
            for m in range(len(pairs))
            for n in range(m, len(pairs))
        ]
        if best:
            i, j = next(x for x, p in enumerate(pairs) if p[0] == best[0]), next(x for x, p in enumerate(pairs) if p[0] == best[1] - 1)
            got = j - i + 1 + chaining.UNMATCHED * sum(max(c - a, d - b) - 1 for (a, b), (c, d) in zip(pairs[i:j], pairs[i + 1 : j + 1]))
            assert got == max(scores) and best[4] == j - i + 1


def test_partners_are_the_first_and_last_of_seed_and_mark():
    rng = np.random.default_rng(7)
    for trial in range(30):
        n = int(rng.integers(1, 60))
        seed, sketch = rng.integers(0, 4, n), rng.integers(0, 3, n)
        doc, place = rng.integers(0, 8, n), (rng.integers(0, 2, n) << 32) | rng.integers(0, 5, n)
        mark = (seed << chaining.SKETCH_BITS) | sketch
        order = np.lexsort((place, doc, mark))
        mark, doc, place = (c[order] for c in (mark, doc, place))
        here = list(zip(doc.tolist(), place.tolist()))
        want = set()
        for i in range(n):
            for key in (mark >> chaining.SKETCH_BITS, mark):
                of = [here[j] for j in range(n) if key[j] == key[i]]
                for other in (min(of), max(of)):
                    if (other[0], other[1] >> 32) != (here[i][0], here[i][1] >> 32):
                        want.add((max(here[i], other), min(here[i], other)))
        x, y = chaining.partners(mark, doc, place)
        assert {(here[a], here[b]) for a, b in zip(x, y)} == want


def test_rare_seeds_are_matched_each_with_each(monkeypatch):
    monkeypatch.setattr(chaining, "EACH", 12)
    rng = np.random.default_rng(9)
    for trial in range(20):
        n = int(rng.integers(1, 70))
        seed, doc = rng.integers(0, 5, n), rng.integers(0, 9, n)
        mark, place = (seed << chaining.SKETCH_BITS) | rng.integers(0, 3, n), (rng.integers(0, 2, n) << 32) | np.arange(n)
        order = np.lexsort((place, doc, mark))
        mark, doc, place = (c[order] for c in (mark, doc, place))
        seed, here = mark >> chaining.SKETCH_BITS, list(zip(doc.tolist(), (place >> 32).tolist(), place.tolist()))
        many = np.bincount(seed, minlength=5)[seed]
        want = {
            (max(here[i], here[j]), min(here[i], here[j]))
            for i in range(n) for j in range(i) if seed[i] == seed[j] and many[i] <= 12 and here[i][:2] != here[j][:2]
        }
        x, y, rest = chaining.each_with_each(mark, doc, place)
        assert sorted((here[a], here[b]) for a, b in zip(x, y)) == sorted(want) and rest.tolist() == (many > 12).tolist()


def test_groups_stay_whole_over_batches():
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 20, 200))
    table = pa.table({"k": keys, "v": np.arange(200)})
    for size in (1, 7, 200):
        got = list(common.whole_groups(table.to_batches(size), 1, "k", "v"))
        assert np.array_equal(np.concatenate([v for _, v in got]), np.arange(200))
        seen = [k for ks, _ in got for k in np.unique(ks)]
        assert len(seen) == len(set(seen))
    assert list(common.whole_groups([], 1, "k", "v")) == []


def test_index_finds_what_brute_force_finds():
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(1, 40)))) for i in range(30)]
    texts = []
    for n in range(40):
        body = random.choices(vocabulary, k=random.randint(0, 120))
        if n % 3 == 0:
            part = items[n % 30][1].split()
            if n % 2 and len(part) > 30:
                part[len(part) // 2] = "edited"
            body[n % 7 : n % 7] = part
        texts.append(" ".join(body))
    index = decontam.Index(items, radius=24)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = {k: v[0] for k, v in index.find(offsets, np.frombuffer("".join(texts).encode(), np.uint8)).items()}
    want = {}
    for r, t in enumerate(texts):
        words = [w.encode() for w in t.split()]
        for i, item in items:
            parts = [w.encode() for w in item.split()]
            m, k = len(parts), min(5, len(parts))
            own = decontam._shingle_counts(parts, k)
            for s in range(max(1, len(words) - m + 1)):
                got_s = decontam.similarity(decontam._shingle_counts(words[s : s + m], k), own)
                if got_s >= 0.8:
                    want[r, i] = max(want.get((r, i), 0), got_s)
    assert want and got == want


def test_index_at_the_radius_that_ships():
    """Items with words replaced to a similarity of 0.8 or a little over: nearly all are found, exact ones always."""
    rng = random.Random(16)
    seen = found = 0
    for m in (14, 40, 120):
        items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(m))) for i in range(40)]
        index = decontam.Index(items)
        texts, pairs = [], []
        for i, item in items:
            parts = item.split()
            own = decontam._shingle_counts([w.encode() for w in parts], 5)
            changed = [*parts]
            for at in rng.sample(range(m), m):
                trial = [*changed]
                trial[at] = "edited"
                if decontam.similarity(decontam._shingle_counts([w.encode() for w in trial], 5), own) < 0.8:
                    break
                changed = trial
            for words in (parts, changed):
                pairs.append((len(texts), i, words == parts))
                texts.append(" ".join([f"a{rng.randint(0, 999)}" for _ in range(30)] + words + [f"b{rng.randint(0, 999)}" for _ in range(30)]))
        offsets = np.cumsum([0] + [len(t) for t in texts])
        got = index.find(offsets, np.frombuffer("".join(texts).encode(), np.uint8))
        for row, item, exact in pairs:
            assert not exact or got[row, item][0] == 1.0
            seen += 1
            found += (row, item) in got
    assert found >= 0.97 * seen
