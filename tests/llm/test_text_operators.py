"""op5 to op8 against plain implementations."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oracle import same_rows
from orrery.llm import disclosure_pii as D, family_langid as L, line_frequency as Q, queries, token_counts as K

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * good
    return out


TRICKY = [
    (1, "a@b.c_d@e.f x.y@z.w.q. 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (743) 555-3824 é😀 +49-30-1234567 .."),
    (2, "😀😀 a@b.co " + "1" * 5000 + " " + "x" * 20000 + " a@b" + ".c" * 5000),
    (3, "4111111111111111@x.yz +4111111111111111 00000255.1.1.001 +1+2+3333333333 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
    (4, "@a.b a@ b@c. d@.e f@g..h 1.2.3 1..2.3.4 ++12345678901 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"),
]


def test_base_spans_equal_plain_regex(spark, docs):
    for df in (docs, spark.createDataFrame(TRICKY, "doc_id long, text string")):
        got = {r["doc_id"]: (r["base_sha256"], r["n_email"], r["n_phone"]) for r in D.spans(df).collect()}
        for r in df.select("doc_id", "text").collect():
            b = base(r["text"])
            assert got[r["doc_id"]] == (hashlib.sha256(",".join(b).encode()).hexdigest(), sum(x[0] == "e" for x in b), sum(x[0] == "p" for x in b))


def planted(spark):
    rows = [(i, f"Unique{i} talk about zanzibar the quokka handler called +1 (743) 555-3824 from office {i}") for i in range(8)]
    rows += [(100 + i, f"plain words with office and talk about the things called from here {i}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    df = planted(spark)
    got = {r["doc_id"]: r["spans"] for r in D.spans(df).collect()}
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    marked = {text[3][int(a) : int(z)] for k, a, z in (s.split(":") for s in got[3].split(","))}
    assert marked == {"+1 (743) 555-3824", "zanzibar", "quokka", "handler"} and got[100] == ""
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(df).collect()}
    assert clean[100] == text[100] and "[PHONE]" in clean[3] and "quokka" not in clean[3] and "office" in clean[3]


def test_terms_equal_counts_by_hand(spark):
    """The share of the entity's information that each flagged term tells, from plain counts."""
    import math

    df = planted(spark)
    hits, terms = D.find(df)
    texts = [r["text"].lower() for r in df.collect()]
    with_entity = [t for t in texts if "555-3824" in t]
    ic = -math.log2(len(with_entity) / len(texts))
    near = set(re.findall("[a-z]{4,}", " ".join(re.split(r"\+1 \(743\) 555-3824", t)[0] + re.split(r"\+1 \(743\) 555-3824", t)[1] for t in with_entity)))
    told = {}
    for w in near:
        n, both = (sum(bool(re.search(rf"\b{w}\b", t)) for t in ts) for ts in (texts, with_entity))
        told[w] = math.log2(both * len(texts) / (len(with_entity) * n)) / ic if both >= 3 else 0
    want = {w for w, x in told.items() if x >= 0.9}
    assert {w for r in terms.collect() for w in r["terms"]} == want


def test_copies_are_one_content(spark):
    rows = [(i, "zanzibar quokka handler +1 (743) 555-3824") for i in range(9)] + [(100 + i, f"other words here {i}") for i in range(50)]
    assert "term" not in D.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()["spans"]


def test_spans_of_fixtures_equal_sql(spark, odd):
    """Terms, copies, ids with two texts, rows without an id, overlapping spans: the query's SQL on small tables."""
    import duckdb

    zebulon = [(i, f"Zebulon writes from a@b.com to Quentin {'and so on ' * 60} case{i} bob met x7f9q, said BOB to Xanthippe") for i in range(4)]
    zebulon += [(100 + i, f"someone writes from here to there {'and so on ' * 30} and met others and said so number{i}") for i in range(100)]
    shared = [(7, f"entry {i} names quokka with a@b.com here") for i in range(3)] + [(7, "a quokka not at all in this place"), (7, "entry 1 names quokka with a@b.com here"), (None, "entry 9 names quokka with a@b.com here"), (None, None)]
    shared += [(200 + i, f"other words here {i}") for i in range(60)]
    for rows in (TRICKY, zebulon, shared, planted(spark).collect(), [(i, f"{t} again") for i in range(5) for _, t in TRICKY]):
        df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
        con = duckdb.connect()
        con.register("documents", df.toArrow())
        names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
        want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({D.ORACLE})").fetchall(), key=str)
        assert sorted((tuple(r[n] for n in names) for r in D.spans(df).collect()), key=str) == want
    assert any("term" in r["spans"] for r in D.spans(spark.createDataFrame(shared, "doc_id long, text string")).collect())


@pytest.mark.parametrize("slots", [1, 64])
def test_terms_do_not_depend_on_full_filters(spark, monkeypatch, slots):
    """Filters that are full let everything pass, and nothing changes."""
    from orrery.llm import common

    df = planted(spark)
    want = {r["doc_id"]: r["spans"] for r in D.spans(df).collect()}
    monkeypatch.setattr(common, "SLOTS", slots)
    assert {r["doc_id"]: r["spans"] for r in D.spans(df).collect()} == want


def test_odd_rows_of_pii(odd, none):
    got = D.spans(odd).collect()
    assert len(got) == odd.count() and D.spans(none).count() == 0
    assert [(r["n_email"], r["n_phone"]) for r in got if r["doc_id"] is None] == [(1, 1)]
    clean = D.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and clean.where("doc_id = 2").first()["text"] is None


def counts(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_plain_ones(docs, odd):
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in Q.quality(df).collect():
            assert counts(text[r["doc_id"]]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def boilerplate(spark):
    rows = []
    for i in range(40):
        own = "\n".join(f"document{i} says thing{j} a{i}{j} b{i}{j} c{i}{j}" for j in range(4))
        rows.append((i, f"Terms of Service  apply\n{own}", "h1"))
    rows += [(100 + i, "Terms of service apply\n" + f"short {i} page", "h1") for i in range(3)]
    rows += [(200 + i, "\n".join(f"page{j} that was{j} copied with line{j} of plain{j} text" for j in range(5)), "h1") for i in range(20)]
    rows += [(300, "Terms of service apply\nanother host may say so in its documents if it likes to", "h2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_lines_above_the_limit(spark):
    df = boilerplate(spark)
    got = {r["doc_id"]: r for r in Q.quality(df).collect()}
    assert all(got[i]["kept"] and got[i]["n_words"] - got[i]["n_words_kept"] == 4 for i in range(40))
    assert not got[100]["kept"] and got[300]["kept"] and got[300]["n_words_kept"] == got[300]["n_words"]
    assert all(got[200 + i]["kept"] and not got[200 + i]["depleted"] for i in range(20))  # copies are one document
    clean = {r["doc_id"]: r["text"] for r in Q.clean(df).collect()}
    assert "Service" not in clean[0] and clean[0].count("\n") == 3 and 100 not in clean and "service" in clean[300]


def over_limit(rows, min_docs, share):
    """(host, normalised line) of the lines in too many distinct texts of (host, text), from plain sets."""
    held, texts = {}, {}
    for host, text in rows:
        texts.setdefault(host, set()).add(text)
        for x in text.split("\n"):
            if x.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                held.setdefault((host, re.sub("[\x20\x09-\x0d]+", " ", x).lower().strip(" ")), set()).add(text)
    return {key for key, s in held.items() if len(s) > min_docs and len(s) > share * len(texts[key[0]])}


def test_line_counts_equal_brute_force(spark, docs):
    rows = [(r["source"], r["text"]) for r in docs.collect()]
    want = over_limit(rows, 1, 0.02)
    table = Q.line_table(docs, "doc_id", "text", "source")
    got = {tuple(r) for r in Q.frequent_lines(table, min_docs=1, share=0.02).collect()}
    keyed = spark.createDataFrame(list(want), "host string, line string").select("host", Q.line_key(F.col("line")))
    assert got == {tuple(r) for r in keyed.collect()} and want


@pytest.mark.parametrize("few", [0, 100_000])
def test_template_of_many_lines(spark, monkeypatch, few):
    """300 documents of 60 template lines and a line of their own: the template goes, by either join."""
    monkeypatch.setattr(Q, "BROADCAST_LINES", few)
    template = "\n".join(f"t{j}a t{j}b t{j}c" for j in range(60))
    rows = [(i, f"{template}\nwhat only document {i} has to say in words of its own, of which there are {i}", "h") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Q.quality(df, min_kept=0.01).collect()
    assert len(got) == 300 and all(r["n_words_kept"] == 17 and r["kept"] for r in got)
    assert {r["text"] for r in Q.clean(df, min_kept=0.01).collect()} == {t.split("\n")[-1] for _, t, _ in rows}


@pytest.mark.parametrize("name", ["op3_raked_mixture", "op5_disclosure_pii", "op6_line_frequency_quality", "op10_substring_dedup"])
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, queries.QUERIES[name], queries.ORACLES[name])


def test_odd_rows_of_quality(odd, none):
    assert Q.quality(odd).count() == odd.count() and Q.quality(none).count() == 0
    kept = Q.clean(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]


def test_held_out_languages(spark):
    from orrery.llm.common import documents

    df = documents(spark, "/root/testdata/sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    rows = [r for r in L.identify(df, sample_rows=400).collect() if r["held_out"]]
    assert len(rows) > 150 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_equal_plain_votes(spark, docs):
    """Every text's grams, margins and votes by plain loops, with the machines that the operator fits."""
    x, langs = L.sample(docs, 2000, 256, "doc_id", "text", "lang")
    m = L.Machines(x, langs, L.FAMILIES)
    families = {f: [la for la in sorted(set(langs)) if la in L.FAMILIES.get(f, (f.removeprefix("only "),))] for f in m.members}
    assert families == m.members

    def bucket(grams):
        out = []
        for g in grams:
            c = [ord(x) for x in g]
            a = c[0] * 2654435761 % 2**32
            if len(c) == 1:
                out.append(a)
                continue
            pair = lambda p, q: (q * 2654435761 ^ (p * 2246822519 + 374761393)) % 2**32
            out.append(pair(*c) * 2654435761 % 2**32 if len(c) == 2 else ((pair(c[1], c[2]) * 3266489917 % 2**32) ^ ((a + 668265263) % 2**32)) * 2654435761 % 2**32)
        return [v >> 19 for v in out]

    def vote(names, margin):
        if len(names) == 1:
            return names[0]
        wins = {n: [0, 0.0] for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                for n, won, size in ((a, margin[a, b] >= 0, margin[a, b]), (b, margin[a, b] < 0, -margin[a, b])):
                    wins[n] = [wins[n][0] + won, wins[n][1] + size]
        return max(names, key=lambda n: wins[n])

    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs).collect()}
    agree = 0
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        t = f" {''.join(c if c.isalpha() else ' ' for c in (r['text'] or '').lower())} "
        t = re.sub(" +", " ", t)
        if not t.strip():
            agree += got[r["doc_id"]] == "und"
            continue
        grams = bucket(t) + bucket(t[i : i + 2] for i in range(len(t) - 1)) + bucket(t[i : i + 3] for i in range(len(t) - 2))
        margin = dict(zip(m.pairs, (m.weights[grams].astype(float).sum(0) / len(grams)).tolist()))
        agree += got[r["doc_id"]] == vote(families[vote(list(families), margin)], margin)
    assert len(got) == len(rows) == agree


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text the and {i}", "en") for i in range(3000)] + [(5000 + i, f"texte les une {i}", "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, langs = L.sample(df, 100, 10, "doc_id", "text", "lang")
    assert 60 <= len(langs) <= 200 and 25 <= langs.count("fr") <= 40


def test_languages_of_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in L.identify(odd).collect()}
    assert len(got) == 7 and got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert not got[None]["held_out"] and L.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.identify(unlabelled).first()["lang_pred"] == "und"


def test_family_comes_first(spark):
    df = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate([("the and of with", "en"), ("der und die nicht", "de"), ("que los una para", "es"), ("les une dans pour", "fr")] * 12)], "doc_id long, text string, lang string")
    x, langs = L.sample(df, 100, 10, "doc_id", "text", "lang")
    m = L.Machines(x, langs, L.FAMILIES)
    assert m.pairs == [("germanic", "romance"), ("de", "en"), ("es", "fr")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, docs, tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    special = spark.createDataFrame([(1, "a<|endoftext|>b <|startoftext|> é x y 'S it's İΣ"), (2, "a" * 5000 + "\r\n\x0b\x0c" + "é" * 300), (3, "")], "doc_id long, text string")
    for df in (docs, special):
        text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        for r in K.count_tokens(df, path).collect():
            n = len(tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text[r["doc_id"]].encode()), n > 2048)


def test_whole_texts_for_other_vocabularies(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(r["n_tokens"] == len(model.encode(text[r["doc_id"]])) for r in K.count_tokens(docs, path, split=False).collect())


def test_vocabularies_that_keep_space_take_whole_texts(docs):
    """Without split: byte_bpe_50k joins a space to the word behind it, so its texts must not be cut."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert K.drops_space(public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) and not K.drops_space(path, whole)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(r["n_tokens"] == len(whole.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in K.count_tokens(docs, path).collect())


def test_token_counts_of_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = K.count_tokens(odd, path)
    assert got.count() == odd.count() and got.where("doc_id = 2").first()["n_tokens"] == 0
    assert K.count_tokens(none, path).count() == 0
