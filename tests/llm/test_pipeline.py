"""The pipeline's stages against a plain implementation of each, in order, each on the plain result of the one before."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from test_dedup import shingle_set
from test_text_operators import PATTERNS, counts, luhn


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def quality(docs):
    key = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x).lower().strip(" ")
    held, hosts = {}, {}
    for d in docs:
        hosts.setdefault(d["source"], set()).add(d["text"])
        for x in d["text"].split("\n"):
            if words(x):
                held.setdefault((d["source"], key(x)), set()).add(d["text"])
    over = {h for h, texts in held.items() if len(texts) > 5 and len(texts) > 0.05 * len(hosts[h[0]])}
    out = []
    for d in docs:
        n, *_, repeats = counts(d["text"])
        kept = "\n".join(x for x in d["text"].split("\n") if not (words(x) and (d["source"], key(x)) in over))
        m = len(words(kept))
        if n >= 10 and 100 * repeats <= 20 * n and not (m < n and (m < 10 or m < 0.3 * n)):
            out.append(d | {"text": kept, "n_chars": len(kept)})
    return out


def near_dedup(docs):
    """Documents whose 5-word shingles are 0.8 similar are linked, over all pairs; the least id of what links reach stays."""
    docs = sorted(docs, key=lambda d: d["doc_id"])
    sets = [shingle_set(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [d for i, d in enumerate(docs) if root[i] == i]


def pii(docs):
    out = []
    for d in docs:
        spans = []
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, d["text"]):
                n = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]:
                    spans.append((m.start(), m.end(), f"[{kind.upper()}]"))
        at, parts = 0, []
        for a, z, label in sorted(spans):
            if a >= at:
                parts += [d["text"][at:a], label]
            at = max(at, z)
        text = "".join([*parts, d["text"][at:]])
        out.append(d | {"text": text, "n_chars": len(text)})
    return out


def mixing(docs):
    def topic(t):
        for name, p in (("legal", "(?i)licen[cs]e|copyright|rights reserved"), ("table", r"\|[^|\n]*\|"), ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]")):
            if re.search(p, t):
                return name
        return "prose"

    cells = [(d["source"], d["lang"], topic(d["text"])) for d in docs]
    n = np.array([len(words(d["text"])) for d in docs], float)
    total = n.sum()
    wanted = []
    for i in range(3):
        have = {c: n[[x[i] == c for x in cells]].sum() for c in {x[i] for x in cells}}
        assert min(have.values()) >= total / 200  # nothing is pooled here
        powered = {c: v**0.9 for c, v in have.items()}
        wanted.append({c: v / sum(powered.values()) * 0.8 * total for c, v in powered.items()})
    tokens = {c: n[[x == c for x in cells]].sum() for c in set(cells)}
    fitted = {c: v * 0.8 for c, v in tokens.items()}
    for _ in range(300):
        before = dict(fitted)
        for i in range(3):
            sums = {}
            for c, v in fitted.items():
                sums[c[i]] = sums.get(c[i], 0.0) + v
            fitted = {c: v * wanted[i][c[i]] / sums[c[i]] for c, v in fitted.items()}
        fitted = {c: min(v, tokens[c]) for c, v in fitted.items()}
        if max(abs(fitted[c] - before[c]) for c in fitted) <= 1e-13 * 0.8 * total:
            break
    u = lambda i: int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return [d for d, c in zip(docs, cells) if u(d["doc_id"]) < fitted[c] / tokens[c]]


@pytest.fixture(scope="module")
def at_each_stage(spark, data):
    """(name, rows of the stage, rows of the plain version) for the first four stages, and the last stage's rows."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, out = docs.columns, []
    plain = [r.asDict() for r in docs.collect()]
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, (quality, near_dedup, pii, mixing)):
        docs = stage(spark, docs, data).persist()
        plain = by_hand(plain)
        assert docs.columns == names
        out.append((name, [r.asDict() for r in docs.collect()], plain))
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()


@pytest.mark.parametrize("i", range(4))
def test_stage_equals_plain_version(at_each_stage, i):
    name, got, want = at_each_stage[0][i]
    order = lambda d: d["doc_id"]
    assert sorted(got, key=order) == sorted(want, key=order), name
    assert want


def test_last_stage_spells_every_document(at_each_stage):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {d["doc_id"]: d["text"] for d in at_each_stage[0][-1][1]}
    rows = at_each_stage[1]
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == 2 * len(text)
    assert all(model.decode(r["ids"]) == text[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows)


def test_run_equals_the_stages(spark, data, at_each_stage):
    got = {(r["doc_id"], r["sample"], r["ids_hash"]) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {(r["doc_id"], r["sample"], r["ids_hash"]) for r in at_each_stage[1]}


def test_pipeline_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").persist()
        assert docs.count() >= 0
