"""op9 and op10 against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from orrery.llm import bitsliced_simhash as S, rlz_dedup as R


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius):
            x, y = sorted((root(i), root(int(j))))
            parent[y] = x
    return [root(i) for i in range(len(a))]


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_similar_groups_equal_all_pairs(spark):
    """Edited copies at similarities around 0.8 beside others: groups are those of all pairs at 0.8 or more, short of chance misses."""
    rng = np.random.default_rng(11)
    rows = []
    for base in range(40):
        words = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(60, 400)))]
        rows.append((len(rows), " ".join(words)))
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.06):
            edited = [f"e{rng.integers(0, 5000)}" if rng.random() < share else w for w in words]
            rows.append((len(rows), " ".join(edited)))
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at, named = S.similar_groups(df)
    root = {r["did"]: r["root"] for r in at.join(named, "content").collect()}
    near = [(i, j) for i, j in links if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    found = lambda pairs: sum(root[i] == root[j] for i, j in pairs) / len(pairs)
    assert len(links) > 300 and len(near) > 200 and found(near) >= 0.99 and found(links) >= 0.95
    # nothing is joined that links do not reach
    reach = classes_of(len(rows), links)
    assert all(reach[i] == reach[j] for i in range(len(rows)) for j in range(i) if root[i] == root[j])


def classes_of(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_long_lists_are_compared_by_chunks(spark, monkeypatch):
    """A hundred near copies in lists of eight members."""
    monkeypatch.setattr(S, "LIST_MEMBERS", 8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:i], f"own{i}", *words[i:]])) for i in range(100)]
    kept = S.one_per_similar_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in kept] == rows[:1]


def test_similar_groups_of_odd_rows(odd, none):
    kept = S.one_per_similar_group(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6]
    assert S.one_per_similar_group(none).count() == 0


def test_components_equal_all_pairs(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [simhash(t) for _, t in rows]
    want = {(k, f"{f:016x}", rows[c][0]) for (k, _), f, c in zip(rows, fps, classes(fps))}
    assert {tuple(r) for r in S.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("sizes", [[900], [500, 300, 100], [1] * 900])
def test_bit_sliced_forest_equals_all_pairs(sizes):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    one = lambda: np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    fps = np.concatenate([b ^ one() ^ one() for b in base])
    label, at = S.forest(fps, np.array(sizes), 2), 0
    for n in sizes:
        assert [x - at for x in label[at : at + n]] == classes(fps[at : at + n])
        at += n


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_other_radii_keep_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    fps = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(63, radius, replace=False)) for f in fps]
    edges = S.link_edges(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), radius).collect()
    linked = {frozenset(r) for r in edges}
    assert all(frozenset((a, b)) in linked or a == b for a, b in zip(fps[:40], fps[40:]))


def test_long_chain_is_one_component(spark):
    from orrery.llm.common import prepared

    prepared(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = dict(S.components(edges).collect())
    assert got[101] == 100 and all(got[i] == 0 for i in range(1, 61))


def test_odd_rows(odd, none):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["doc_id"]: r for r in got if r["fingerprint"] == "0" * 16}
    assert set(zero) == {2, 3, 4} and {r["component_id"] for r in zero.values()} == {2}
    assert S.near_duplicates(none).count() == 0
    kept = S.one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6]


def repeats(rows, width):
    first, out = {}, {}
    for k, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if (key := tuple(w[i : i + width])) in first and first[key] != (k, i):
                gone[i : i + width] = [True] * width
            first.setdefault(key, (k, i))
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[k] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("words", [2_000, 1_500_000])
def test_removed_words_equal_brute_force(docs, monkeypatch, words):
    monkeypatch.setattr(R, "BLOCK_WORDS", words)
    want = repeats([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 20)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.remove_repeats(docs).collect()}
    assert got == want


@pytest.mark.parametrize("width", [2, 5, 13])
def test_other_widths_and_overlaps(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 60))))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.remove_repeats(df, width=width).collect()}
    assert got == repeats(rows, width)


def test_odd_rows_of_substrings(odd, none):
    got = {r["doc_id"]: r for r in R.remove_repeats(odd).collect()}
    assert R.remove_repeats(odd).count() == odd.count() and R.remove_repeats(none).count() == 0
    assert got[2]["n_words"] == 0 and got[1]["n_removed"] == 0 and got[5]["n_removed"] == 29999
    assert [tuple(s) for s in got[5]["spans"]] == [(1, 30000)]


def test_factors_name_earlier_sources(spark):
    shared = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"x y {shared}"), (2, f"z {shared} q")], "doc_id long, text string")
    assert [tuple(r) for r in R.duplicate_factors(df).collect()] == [(2, 1, 26, 1, 2)]


def test_factor_over_many_windows_ends_within_one(spark):
    """A passage of 87 words copied into two texts, with other text on both sides and a second source behind its end."""
    passage, other = [f"p{i}" for i in range(87)], [f"q{i}" for i in range(40)]
    rows = [
        (1, " ".join(["a1", "a2", *passage, "a3"])),
        (2, " ".join(["b1", *passage[60:], *other[:30], "b2"])),
        (3, " ".join(["c1", *passage, *other[:25], "c2", "c3"])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.remove_repeats(df).collect()}
    assert got == repeats(rows, 20) and got[3][1] == 87 + 25
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in R.remove_repeats(df.coalesce(1)).collect()}
    assert spans == {1: [], 2: [(1, 28)], 3: [(1, 113)]}


def test_greedy_parse_takes_the_longest_factor_and_looks_over_its_end():
    text = np.array([1, 2, 3, 4, 5, 6, 0, 4, 5, 6, 7, 8, 0, 1, 2, 3, 4, 5, 6, 7, 8], np.uint64)
    ends = np.repeat([6, 12, 21], [6, 6, 9])
    windows = [tuple(text[i : i + 3].tolist()) for i in range(19)]
    inside = [i for i in range(19) if i + 3 <= ends[i]]
    first = {}
    for i in inside:
        first.setdefault(windows[i], i)
    at = np.array([i for i in inside if first[windows[i]] != i])
    place, length, source = R.parse(text, ends, at, np.array([first[windows[i]] for i in at]), 3)
    assert list(zip(place, length, source)) == [(7, 3, 3), (13, 6, 0), (17, 4, 8)]


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_hot_addresses_are_split(spark, monkeypatch, hot):
    """A phrase of eight words in 600 contexts, some of them equal, with and without its address dealt by window."""
    monkeypatch.setattr(R, "SEEN", 1)
    monkeypatch.setattr(R, "BLOCK_STRETCHES", 16)
    monkeypatch.setattr(R, "HOT", 200 if hot == 1 else hot)
    phrase = [f"common{i}" for i in range(8)]
    rows = [(i, " ".join([*(f"x{i % 500}y{j}" for j in range(14)), *phrase, *(f"z{i % 500}y{j}" for j in range(14))])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.remove_repeats(df).collect()}
    assert got == repeats(rows, 20) and got[599][1] == 36
