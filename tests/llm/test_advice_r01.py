
import pytest

from orrery.llm import bitsliced_simhash as S, disclosure_pii as D, line_frequency as Q, queries, rlz_dedup as R


def test_ip_parts_of_zeros(spark):
    good = ["10.0.0.1", "0.0.0.0", "001.02.3.000", "192.168.0.7", "8.8.8.8", "00255.1.1.1"]
    bad = ["256.0.0.1", "0256.1.1.1", "0.0.0.999"]
    df = spark.createDataFrame([(i, f"from {ip} on") for i, ip in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_ip"] for r in D.spans(df).collect()}
    assert [got[i] for i in range(len(good + bad))] == [1] * len(good) + [0] * len(bad)
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(df).collect()}
    assert [clean[i] for i in range(len(good))] == ["from [IP] on"] * len(good)


def test_boilerplate_pages_count_as_documents(spark):
    """300 of 2,000 pages of a host are navigation and one line of their own."""
    navigation = "\n".join(f"navigation entry {j} of the host" for j in range(20))
    rows = [(i, f"{navigation}\nown line {i}", "h") for i in range(300)] + [(i, f"words{i} of a page{i} that has nothing{i} in common with others{i} on{i} the{i} host{i}", "h") for i in range(300, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in Q.quality(df).collect()}
    assert all(got[i]["n_words_kept"] == 3 and got[i]["depleted"] for i in range(300))
    assert all(got[i]["kept"] for i in range(300, 2000))


def test_terms_of_whole_documents(spark):
    """Terms at the text's ends, far from the entity, of three letters and with digits."""
    rows = [(i, f"Zebulon writes from a@b.com to Quentin {'and so on ' * 60} case{i} bob met x7f9q and said so to Xanthippe") for i in range(4)]
    rows += [(100 + i, f"someone writes from here to there {'and so on ' * 30} and met others and said so number{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, terms = D.find(df)
    got = {r["did"]: set(r["terms"]) for r in terms.collect()}
    assert got == {i: {"zebulon", "quentin", "bob", "x7f9q", "xanthippe"} for i in range(4)}
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(df).collect()}
    assert "bob" not in clean[2] and "Xanthippe" not in clean[2] and "case2" in clean[2] and clean[100] == rows[4][1]


def test_pii_of_rows_that_share_an_id(spark):
    secret = [(None if i % 2 else 7, f"entry {i} names quokka with a@b.com here") for i in range(4)]
    rows = secret + [(7, "plain words that name a quokka not at all in this place")] + [(100 + i, f"other words here {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_email"], r["spans"].count("term")) for r in D.spans(df).where("doc_id is null or doc_id = 7").collect())
    assert [g[0] for g in got] == [0, 1, 1, 1, 1] and got[0][1] == 0 and all(g[1] > 0 for g in got[1:])
    assert sum("[EMAIL]" in r["text"] for r in D.sanitise(df).collect()) == 4


@pytest.mark.parametrize("did", [None, 7])
def test_different_texts_of_one_id(spark, did):
    own = lambda k, n=30: " ".join(f"{k}{i}x{i * i}" for i in range(n))
    rows = [(did, own("a")), (did, own("b")), (did, own("c")), (did, own("a")), (9, own("b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["text"] for r in S.one_per_group(df).collect()) == sorted(own(k) for k in "abc")
    got = sorted((r["doc_id"] == 9, r["n_removed"]) for r in R.remove_repeats(df).collect())
    assert got == [(False, 0)] * 4 + [(True, 30)]
    pages = [(did, f"shared line here\n{own(k, 20)}", "h") for k in "abcdefgh"]
    lines = spark.createDataFrame(pages, "doc_id long, text string, source string")
    assert [(r["n_words_kept"], r["kept"]) for r in Q.quality(lines).collect()] == [(20, True)] * 8
    assert sorted(r["text"] for r in Q.clean(lines).collect()) == sorted(own(k, 20) for k in "abcdefgh")


def test_segmentation_query_returns_ids_that_decode(spark, data, docs):
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = queries.op2_gumbel_segmentation(spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    assert all(len(r["ids"]) == r["n_tokens"] and r["decoded"] == text[r["doc_id"]] for r in rows)
