import random

from rowforge.llm import passages


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def pairs_of(got):
    return {tuple(sorted(p)) for p in zip(got["doc_id"], got["other_doc_id"], strict=True)}


def test_passages_whose_parts_are_common_keep_their_pair(make):
    """60 words of a pair; other documents have parts of them that are too short to count."""
    cases = [[(0, 49)], [(11, 60)], [(5, 54)], [(0, 30), (30, 60)], [(0, 49), (11, 60)]]
    rng, rows, n = random.Random(61), [], 40
    for c, parts in enumerate(cases):
        for i in range(c * n, c * n + n):
            shared = words(rng, 60)
            rows += [(1000 * i + k, " ".join(words(rng, rng.randrange(20, 60)) + shared + words(rng, 40)), "p") for k in range(2)]
            for p, (a, b) in enumerate(parts):
                rows += [(1000 * i + 10 * (p + 1) + k, " ".join(words(rng, 50) + shared[a:b] + words(rng, 50)), "h") for k in range(3)]
    rng.shuffle(rows)
    found = pairs_of(passages.repeated(make(rows, parts=5)).toPandas())
    assert found <= {(1000 * i, 1000 * i + 1) for i in range(len(cases) * n)}  # 49 words are no passage
    for c in range(len(cases)):
        least = 0.8 if c == 4 else 0.95  # the last: two parts that overlap by 38 words
        assert sum(c * n <= i // 1000 < c * n + n for i, _ in found) >= least * n, cases[c]


def test_recall_of_edited_passages(make):
    """80 words with random substitutions, of which 80 % or more are left, against what a comparison of all pairs would find."""
    rates, n = {0.05: 0.97, 0.08: 0.97, 0.1: 0.97, 0.12: 0.95, 0.15: 0.95, 0.18: 0.9}, 60
    rng, rows = random.Random(17), []
    for c, rate in enumerate(rates):
        for i in range(c * n, c * n + n):
            old = words(rng, 80)
            new = old
            while new == old or sum(a == b for a, b in zip(old, new, strict=True)) < 64:
                new = [words(rng, 1)[0] if rng.random() < rate else w for w in old]
            rows += [(2 * i, " ".join(words(rng, 70) + old + words(rng, 70)), "f"), (2 * i + 1, " ".join(words(rng, 80) + new + words(rng, 60)), "f")]
    found = pairs_of(passages.repeated(make(rows)).toPandas())
    assert found <= {(2 * i, 2 * i + 1) for i in range(len(rates) * n)}
    for c, (rate, least) in enumerate(rates.items()):
        assert sum(c * n <= i // 2 < c * n + n for i, _ in found) >= least * n, rate


def brute_force(texts, least=50):
    """Documents that share ``least`` words in a row with a different text, or are copies."""
    runs, out = {}, set()
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    for owners in runs.values():
        if len({texts[i] for i in owners}) > 1 or len(owners) > 1:
            out |= owners
    return out


def test_exact_passages_against_brute_force(make):
    rng = random.Random(5)
    stock = [words(rng, 150) for _ in range(6)]
    texts = {}
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(stock)
            a = rng.randrange(0, 100)
            parts += words(rng, rng.randrange(0, 40)) + s[a : a + rng.randrange(10, 90)]
        texts[i] = " ".join(parts + words(rng, rng.randrange(0, 30)))
    texts |= {900 + i: " ".join(words(rng, 200)) for i in range(20)} | {950 + i: texts[3] for i in range(3)}
    got = passages.repeated(make([(i, t, "s") for i, t in texts.items()])).toPandas()
    found = set(got["doc_id"]) | set(got["other_doc_id"])
    want = brute_force(texts)
    assert len(want) > 100 and len(want - found) <= 0.02 * len(want)
    for r in got.itertuples():  # what is reported holds
        a, b = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.other_doc_id].split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and r.matched >= 0.8 * max(len(a), len(b))
    # every document is linked, perhaps over others, with each that shares a whole passage of the same stock
    assert not found & set(range(900, 920))


def test_equal_stretches_have_equal_keys():
    rng = random.Random(9)
    shared = words(rng, 90)
    keys = []
    for n in (33, 80):
        _, at, seed, _, extent = passages.seeds([" ".join(words(rng, n) + shared + words(rng, 30))])
        order = at.argsort()
        at, seed, extent = at[order], seed[order], extent[order]
        inside = (at >= n) & (at < n + 90)
        found = passages.context_keys(at[inside], seed[inside], extent[inside])
        keys.append([(level, dict(zip((at[inside][i] - n).tolist(), k.tolist(), strict=True))) for level, i, k in found])
    for k, (level, one) in enumerate(keys[0]):
        must = {p for p in one if (6 <= p <= 90 - level if k % 2 == 0 else level <= p <= 90 - 11)}
        assert (must or level < passages.BACKWARD) and all(one[p] == keys[1][k][1].get(p) for p in must)
    every = [v for _, one in keys[0] for v in one.values()]
    assert len(set(every)) == len(every) > 60


def test_one_text_asked_for_by_many(make, monkeypatch):
    monkeypatch.setattr(passages, "ASKED", 3)
    rng = random.Random(4)
    shared = words(rng, 60)
    rows = [(i, " ".join(words(rng, 10) + shared + words(rng, 10)), "s") for i in range(40)] + [(None, " ".join(words(rng, 5) + shared), None)]
    for most in (0, 100_000):
        monkeypatch.setattr(passages, "MOST_HOT", most)
        got = passages.repeated(make(rows)).toPandas()
        assert len(got) == 40 and (got["matched"] == 60).all()


def test_odd_rows(make, nothing, odd):
    got = passages.repeated(odd).toPandas()
    assert set(got["doc_id"]) == set() or set(got["doc_id"]) <= {5, 6, 7}
    assert passages.repeated(nothing).count() == 0
