"""op1 to op4 and the pipeline."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from oracle import same_rows
from orrery.llm import chat_snapshots as C, gumbel_segmenter as G, permutation_index as P, queries, raking as R


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[int(i)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_recall_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in e.collect()])
    got = {}
    for r in queries.op1_permutation_index(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = sum(i in got[q] for q, near in want.items() for i, _ in near)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(got[q][i] == pytest.approx(d, abs=1e-9) for q, near in want.items() for i, d in near if i in got[q])


def test_recall_with_a_dense_group(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[:1200] = x[0] + 1e-3 * rng.normal(size=(1200, 32))
    x[1200:1300] = x[1200]
    order = rng.permutation(3000)
    rows = [(int(i), [float(v) for v in x[j]]) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), {}
    for r in P.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(got[q]) & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 10 * len(want)


def test_recall_over_blocks_of_rows_without_clusters(spark):
    """Four blocks of Gaussian vectors, the hardest case: recall at 10 and the postings that a query reads."""
    x = np.random.default_rng(6).normal(size=(26_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    want, got = {}, {}
    norms = (x.astype(float) ** 2).sum(1)
    for i in range(0, len(x), 200):
        d = norms - 2 * (x @ x[i]).astype(float)
        d[i] = np.inf
        want[i] = set(np.argsort(d)[:10].tolist())
    for r in P.nearest(df, df.where("vec_id % 200 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    recall = np.mean([len(want[i] & set(got[i])) / 10 for i in want])
    assert all(len(g) == 10 for g in got.values()) and set(got) == set(want) and recall >= 0.9
    block = x[: P.BLOCK_ROWS].astype(float)
    pivots = P.Pivots(x[-2048:].astype(float), 512)
    files = P.Block(np.arange(len(block)), block, pivots, 16).files
    read = [sum(files.first[p + 1] - files.first[p] for p in o) for o in P.orders(block[:100], pivots, 16)]
    assert np.mean(read) < 0.7 * len(block)


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(0)
    order = np.array([rng.permutation(12)[:5] for _ in range(40)], np.int32)
    files, q = P.InvertedFiles(order, 12), order[0]
    place = lambda o, p: int(np.flatnonzero(o == p)[0]) if p in o else 5
    want = [sum(abs(place(o, p) - place(q, p)) for p in range(12)) for o in order]
    got = files.footrule(q)
    assert np.allclose(got - got[0], want)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, []), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in P.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 7), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert P.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return G.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank")


def segmentations(text, v):
    """All segmentations of a text and their probabilities, by recursion."""
    m = v.model
    names = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    s, out = G.SPACE + text.replace(" ", G.SPACE), []

    def go(at, ids, logp):
        if at == len(s):
            out.append((tuple(ids), logp))
        for n in range(1, min(16, len(s) - at) + 1):
            if (i := names.get(s[at : at + n])) is not None:
                go(at + n, [*ids, i], logp + v.logp[i])

    go(0, [], 0.0)
    z = np.logaddexp.reduce([x for _, x in out])
    return {ids: math.exp(x - z) for ids, x in out}


def test_samples_follow_the_law_without_replacement(vocabulary):
    v = G.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 0.2)
    p, n = segmentations("the of", v), 20000
    got = G.sample_texts(["the of"] * n, np.random.default_rng(1).integers(0, 2**63, n, dtype=np.uint64), 3, v)
    by = {}
    for row, ids in zip(got["row"], got["ids"]):
        by.setdefault(row, []).append(tuple(ids.tolist()))
    assert all(len(set(x)) == 3 for x in by.values())
    pairs = Counter((x[0], x[1]) for x in by.values())
    for a in p:
        for b in p:
            if a != b:
                q = p[a] * p[b] / (1 - p[a])
                assert abs(pairs[a, b] / n - q) < 5 * math.sqrt(q / n) + 1e-3
    thirds = Counter(x[2] for x in by.values())
    for c in p:
        q = sum(p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, c}) == 3)
        assert abs(thirds[c] / n - q) < 5 * math.sqrt(q / n) + 1e-3
    # inverse inclusion scores estimate a sum over all segmentations without bias
    weights = [math.exp(lp - inc) for lp, inc in zip(got["logp"], got["log_inclusion"])]
    assert sum(weights) / n == pytest.approx(1.0, abs=0.05)


def test_all_segmentations_of_a_short_text(vocabulary):
    v = G.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 0.1)
    p = segmentations("then a", v)
    got = G.sample_texts(["then a"], np.array([9], np.uint64), 500, v)
    assert {tuple(i.tolist()) for i in got["ids"]} == set(p) and got["score"] == sorted(got["score"], reverse=True)
    assert all(math.exp(lp) == pytest.approx(p[tuple(i.tolist())]) for lp, i in zip(got["logp"], got["ids"]))
    assert set(got["log_inclusion"]) == {0.0}


def test_round_trip_and_odd_rows(spark, docs, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        out = G.decode(G.encode(df, path), path).collect()
        assert {r["doc_id"] for r in out} == set(text) and all(r["text"] == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert G.encode(none, path).count() == 0
    empty = G.encode(odd.where("doc_id = 2"), path).first()
    assert (empty["n_tokens"], empty["log_prob"], empty["log_inclusion"]) == (0, 0.0, 0.0)


def test_samples_do_not_depend_on_partitions(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    once, again = ({tuple(r) for r in G.encode(d, path, with_ids=False).select("doc_id", "sample", "ids_hash").collect()} for d in (docs, docs.repartition(5)))
    assert once == again


def test_rake_meets_its_marginals():
    rng = np.random.default_rng(0)
    cells = rng.random((5, 3, 4)) * 100
    targets = [x / x.sum() * 300 for x in (rng.random(5) + 1, rng.random(3) + 1, rng.random(4) + 1)]
    fitted = R.rake(cells, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(fitted.sum(tuple(i for i in range(3) if i != axis)), t, rtol=1e-6)
    assert (fitted <= cells + 1e-9).all()
    small = R.rake(np.array([[[1.0]], [[99.0]]]), [np.array([25.0, 25.0]), np.array([50.0]), np.array([50.0])])
    assert small[0, 0, 0] == pytest.approx(1.0)  # kept whole, never more than there is


def test_mixture_meets_targets(spark):
    out = queries.op3_raked_mixture(spark, "/root/testdata/sf0.1").toPandas()
    assert out.n_tokens[out.sampled].sum() / out.n_tokens.sum() == pytest.approx(0.8, abs=0.03)
    for d in ("source", "lang"):
        have = out.groupby(d).n_tokens.sum()
        want = (have**0.9) / (have**0.9).sum()
        expected = (out.n_tokens * out.probability).groupby(out[d]).sum()
        assert np.allclose(expected / expected.sum(), want, atol=0.005)


def test_given_targets_and_odd_rows(spark, odd, none):
    df = spark.createDataFrame([(i, "w " * 10, "en", "a" if i < 900 else "b") for i in range(1000)], "doc_id long, text string, lang string, source string")
    out = R.mix(df, fraction=0.2, targets={"source": {"a": 0.5, "b": 0.5}}).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t"))
    assert {r["source"]: round(r["t"]) for r in out.collect()} == {"a": 1000, "b": 1000}
    assert R.mix(odd).count() == odd.count() and R.mix(none).count() == 0
    assert R.mixed_documents(odd).columns == odd.columns


def test_small_sources_with_targets_stand_alone(spark):
    """A source of a thousandth of the tokens with a target of a fifth of the sample is kept whole; the marginals say what was not met."""
    rows = [(i, "w " * 10, "en", "rare" if i < 2 else "tail" + str(i % 400) if i < 802 else "big", 10 if i < 1000 else 30) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    share = {"rare": 0.2, "big": 0.8}
    out = {r["source"]: r["p"] for r in R.mix(df, fraction=0.5, targets={"source": share}).groupBy("source").agg(F.max("probability").alias("p")).collect()}
    assert out["rare"] == 1.0 and 0 < out["big"] <= 1 and all(p == 0 for s, p in out.items() if s.startswith("tail"))
    met = {(r["dimension"], r["name"]): r for r in R.marginals(df, fraction=0.5, targets={"source": share}).collect()}
    assert not met["source", "rare"]["met"] and met["source", "rare"]["fitted"] == pytest.approx(20.0) and met["source", "rare"]["wanted"] == pytest.approx(2000.0)
    easy = R.marginals(df, fraction=0.3).collect()
    assert all(r["met"] for r in easy) and sum(r["fitted"] for r in easy if r["dimension"] == "source") == pytest.approx(6000.0)
    # the pool weighs as much as its members do on their own
    pool = next(r for r in easy if r["name"] == R.POOLED)
    own = [r["present"] ** 0.9 for r in easy if r["dimension"] == "source" and r["name"] != R.POOLED]
    tail = 400 * 20.0**0.9 + 20.0**0.9
    assert pool["wanted"] == pytest.approx(6000 * tail / (tail + sum(own)), rel=1e-3)
    counted = R.mix(df, tokens_col="tokens")
    assert counted.agg(F.sum("n_tokens")).first()[0] == 40_000


def test_more_samples_than_the_best_region_has(spark):
    """All segmentations of short texts are emitted, each once, also where the best region is empty."""
    v = G.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 0.5)
    for text in ("a b", "the of", "is it", "zq"):
        every = segmentations(text, v)
        keys = np.random.default_rng(len(text)).integers(0, 2**63, 40, dtype=np.uint64)
        got = G.sample_texts([text] * 40, keys, len(every) + 5, v)
        by = {}
        for row, ids in zip(got["row"], got["ids"]):
            by.setdefault(row, []).append(tuple(ids.tolist()))
        assert all(len(set(x)) == len(x) for x in by.values())
        assert all(set(x) <= set(every) for x in by.values())
        assert min(map(len, by.values())) >= sum(p > 1e-9 for p in every.values())


def test_texts_are_spelled_as_the_library_does(spark):
    """Ids with controls, bytes that are no UTF-8, marks in a row, empty and null ids."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = m.piece_to_id(G.SPACE)
    seqs = [m.encode("plain text"), [], [1, *m.encode("with bos"), 2], [m.piece_to_id("<0xE2>"), m.piece_to_id("<0x82>")], [mark, mark, *m.encode("x")], m.encode("日本 😀 é"), [0], None, m.encode(" two  spaces ")]
    df = spark.createDataFrame([(i, s, "kept") for i, s in enumerate(seqs)], "n int, ids array<int>, text string")
    got = {r["n"]: r["text"] for r in G.decode(df, path).collect()}
    assert got == {i: None if s is None else m.decode(s) for i, s in enumerate(seqs)}


def test_very_long_texts_without_spaces(spark):
    from orrery.llm import token_counts as K

    rows = [(1, "ab" * 60_000), (2, "😀" * 30_000), (3, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = G.encode(df, public_tokenizers.path("piece_bpe_32k.model"), with_text=True).collect()
    assert sorted((r["doc_id"], len(r["decoded"])) for r in got if r["sample"] == 1) == [(1, 120_000), (2, 30_000), (3, 0), (3, 1)]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in K.count_tokens(df, path).collect()) == sorted((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_chats_with_clashing_columns_and_rows_without_an_id(spark):
    """Columns named as the operator's own; each turn without an id is a conversation, by the query's SQL too."""
    import duckdb

    rows = [(1, 0, "user", "hi", 9, "x", 5), (1, 1, "assistant", "yes", 9, "x", 5), (None, 0, "user", "hi", 9, "x", 5), (None, 1, "user", "more", 9, "x", 5), (None, 1, "user", "more", 9, "x", 5)]
    rows += [(2, 0, "user", "hi", 9, "x", 5), (3, 4, "user", "more", 9, "x", 5), (None, None, None, None, 9, "x", 5), (None, 7, "user", "last", 9, "x", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long, mark string, place long")
    got = sorted(((r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"]) for r in C.collapse(df).collect()), key=str)
    assert [g[:3] for g in got] == [(1, 2, 1), (3, 1, 2), (None, 1, 1), (None, 1, 1)]
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(con.execute(f"SELECT conv_id, n_turns, n_copies, rendered FROM ({C.ORACLE})").fetchall(), key=str) == got


def test_chats_equal_sql(spark, data):
    same_rows(spark, data, queries.op4_chat_snapshots, queries.ORACLES["op4_chat_snapshots"])


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 3)
    said = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "so long"), ("user", None)]
    chats = {1: said[:1], 2: said[:3], 3: said, 4: said[:2] + [("user", "other")], 5: said, 6: [("user", "hi"), ("user", "hello")], None: [(None, "alone")]}
    rows = [(c, t, r, x) for c, turns in chats.items() for t, (r, x) in enumerate(turns)]
    rows += [(3, 0, "user", "hi")]  # a turn logged twice
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in C.collapse(df).collect()}
    assert got == {3: (5, 2), 4: (3, 1), 6: (2, 1), None: (1, 1)}
    first = C.collapse(df).where("conv_id = 6").first()["rendered"]
    assert first == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nhello<|im_end|>\n"
    assert C.collapse(df.limit(0)).count() == 0


def test_a_long_conversation_keeps_its_order(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 1500), (2, 700), (3, 513)) for t in range(n)]
    got = C.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 1500)]


