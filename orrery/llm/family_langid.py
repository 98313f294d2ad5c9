"""Language identification by hierarchical discrimination.

A text is a point of hashed letter 1- to 3-gram frequencies (letters lower-cased, all else a space). Linear
support vector machines first tell language families apart, then, within the family found,
one-versus-one machines vote on the closely related languages. Machines are fitted by dual
coordinate descent on the driver, on a bounded sample of labelled rows; prediction reads every
text whole, gathers the weights of its grams and sums them, without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_texts, prepared

#: Hash buckets of grams.
BUCKETS = 8192
#: Characters whose grams are gathered at once.
WORK_CHARS = 2 << 20
# Families of closely related languages. Others are families of their own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


def gram_buckets(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Buckets of the grams of a text; None if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = letters[np.minimum(c, len(letters) - 1)]
    if not known.any():
        return None
    c = np.where(known, c, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]  # runs of spaces are one
    a = c * np.uint32(2654435761)
    b = a[1:] ^ (c[:-1] * np.uint32(2246822519) + np.uint32(374761393))
    t = b[1:] * np.uint32(3266489917) ^ a[:-2] + np.uint32(668265263)
    grams = np.concatenate((a, b * np.uint32(2654435761), t * np.uint32(2654435761)))
    return (grams >> np.uint32(19)).astype(np.uint16)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine (hinge loss, dual coordinate descent) for labels -1 and 1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(x))
    norms = np.einsum("ij,ij->i", x, x).astype(np.float64)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            if norms[i] == 0:
                continue
            new = min(c, max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i]))
            if step := new - alpha[i]:
                w += step * y[i] * x[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    return w


class Machines:
    """Family machines and, within families, one-versus-one language machines."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]) -> None:
        of = {lang: family for family, members in families.items() for lang in members}
        self.langs = sorted(set(langs))
        family = [of.get(lang, f"only {lang}") for lang in langs]
        self.members = {f: sorted({la for la, g in zip(langs, family) if g == f}) for f in sorted(set(family))}
        scale = x.std(0)
        self.scale = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 1e-9)
        unit = x * self.scale.astype(np.float32)
        size = np.float32(max(np.sqrt(np.einsum("ij,ij->i", unit, unit)).mean(), 1e-9)) if len(unit) else np.float32(1)
        unit /= size
        self.pairs: list[tuple[str, str]] = []
        weights = []
        for names, labels in [(list(self.members), family), *((m, langs) for m in self.members.values())]:
            labels = np.array(labels)
            for a, b in combinations(names, 2):
                use = np.flatnonzero((labels == a) | (labels == b))
                w = fit_svm(unit[use], np.where(labels[use] == a, 1.0, -1.0))
                margin = np.median(np.abs(unit[use] @ w)) or 1.0
                self.pairs.append((a, b))
                weights.append(w * self.scale / size * 3 / margin)
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((x.shape[1], 0), np.float32)

    def vote(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most pairwise wins, ties to the greater sum of margins, then to the first; and how surely it won."""
        if len(names) == 1:
            return names[0], 1.0
        wins = {n: [0, 0.0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = margins[a, b]
            p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            for n, won, s, q in ((a, m >= 0, m, p), (b, m < 0, -m, 1 - p)):
                wins[n][0] += won
                wins[n][1] += s
                wins[n][2] += q
        best = max(names, key=lambda n: wins[n][:2])
        return best, wins[best][2] / (len(names) - 1)

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        by = dict(zip(self.pairs, margins.tolist()))
        family, p = self.vote(list(self.members), by)
        lang, q = self.vote(self.members[family], by)
        return lang, min(1.0, max(0.0, p * q))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int, most_langs: int, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str]]:
    """Gram frequencies and labels of about rows labelled rows, the same number of each language where there are as many; never over twice rows."""
    labelled = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("did").isNotNull() & ~held_out("did"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return np.zeros((0, BUCKETS)), []
    each = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    # 52 bits, so that shares of one row in many billions are drawn as they should be
    u = F.shiftrightunsigned(F.xxhash64("did", F.lit(7)), 12) / F.lit(float(1 << 52))
    drawn = labelled.withColumn("u", u).where(F.col("u") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    drawn = drawn.orderBy("u", "did", "lang").limit(2 * max(rows, len(counts)))

    def body(batches):
        letters = letter_table()
        for batch in batches:
            out = {"lang": [], "at": [], "n": []}
            for text, lang in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                grams = gram_buckets(text.decode(), letters)
                if grams is not None:
                    n = np.bincount(grams, minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    for k, v in zip(out, (lang, at.astype(np.uint16).tobytes(), (n[at] / len(grams)).astype(np.float32).tobytes())):
                        out[k].append(v)
            if out["lang"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in drawn.select("text", "lang").mapInArrow(body, "lang string, at binary, n binary").toLocalIterator())
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, (_, at, n) in enumerate(got):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return x, [g[0] for g in got]


def identify(docs: DataFrame, *, sample_rows: int = 2000, most_langs: int = 256, families: dict[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Learns from rows with an id, a text and a lang whose crc32(doc_id) mod 4 is not 2: about sample_rows of
    them, of the most_langs most frequent languages (the bounds of what the driver holds). Predicts from the
    text alone. lang_pred is 'und' with score 0 for texts that are null or have no letter, and where nothing
    could be learned. A null id is not held out and not learned from. Repeated rows are predicted alike.
    An empty table gives an empty result."""
    prepared(docs.sparkSession)
    x, langs = sample(docs, sample_rows, most_langs, id_col, text_col, lang_col)
    machines = Machines(x, langs, families) if langs else None
    del x

    def body(batches):
        letters = letter_table()
        for batch in batches:
            pred, score = [], []
            for text in byte_texts(batch.column(2)):
                grams = gram_buckets(text.decode(), letters) if machines else None
                if grams is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = np.zeros(machines.weights.shape[1])
                for i in range(0, len(grams), WORK_CHARS):
                    part = grams[i : i + WORK_CHARS]
                    if len(part) > BUCKETS:
                        total += np.bincount(part, minlength=BUCKETS) @ machines.weights
                    else:
                        total += machines.weights[part].sum(0, dtype=np.float64)
                lang, p = machines.predict(total / len(grams))
                pred.append(lang)
                score.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(body, "doc_id long, held_out boolean, lang_pred string, score double")
