"""PII: base patterns, and information-theoretic sanitisation of the terms that give entities away.

Base spans of four kinds are found in every whole text. The values found are the protected entities.
All words of the documents that hold an entity, outside of base spans, are candidate terms; for a term
t and an entity e the corpus tells how many documents hold t, e and both. The information that t gives about e is their pointwise mutual
information; e itself carries IC(e) = -log2 p(e). A term that gives at least `generalise` of IC(e)
is generalised in the documents that hold e, from `remove` on it is removed. A pair counts from min_support
different texts on, so the terms of an entity that fewer texts hold are left alone.

DataFrame functions only. Regex matches get their places from the pieces between them (split), as
code points. Patterns use possessive repeats, and may start only at the end of the last match (\\G) or where a
run starts, so long runs cost linear time and no stack. Pairs are counted once for each different text, with
the number of its documents.

What is shuffled is cut first, by bounds that lose no pair. A term of n_t documents tells `generalise` of an entity of n_e
out of N only if n_t <= N (n_e / N) ** generalise, as n_both <= n_e; so terms are counted first (combined in each
task), and only those that may be rare enough for an entity of the text leave it. Such bounds, and the choice of rows to read
again, travel as bit filters: broadcast tables with a row for each slot that has a key, at most 2**20 rows
of 64 bits whatever the corpus. A filter lets some others pass, never too few; exact joins follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bit_filter, bits, content_of, external_id, internal_id, passing, prepared, slot

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# The patterns of the four kinds, in order.
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\\.[{_LABEL}]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What a term is made of: letters, their marks, digits.
_TERM = "\\p{L}\\p{M}\\p{N}"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    places = F.split(F.reverse(number), "")
    total = F.aggregate(F.transform(places, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:int,stop:int,value:string>>)")


def valid_spans(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def placed(text: Column, pattern: Column, kind: str) -> Column:
    """array<struct<kind,start,stop,value>> of the matches of a pattern, left to right, in code points."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), state).otherwise(F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), no_spans().alias("out")), step, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """All valid base spans, by kind as listed, then start."""
    kinds = []
    for kind, pattern in PATTERNS.items():
        possible = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        kinds.append(F.when(possible & text.rlike(pattern), valid_spans(placed(text, F.lit(pattern), kind), kind)).otherwise(no_spans()))
    return F.concat(*kinds)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits outside of base spans, distinct."""
    cut = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(" ").alias("label")))
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), f"[^{_TERM}]+"), lambda w: w != ""))
    return words(masked(text, cut))


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, content (hash of the text), base (spans) of every row."""
    return docs.select(internal_id(id_col).alias("did"), content_of(text_col).alias("content"), base_spans(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("base"))


def size_class(n: Column) -> Column:
    """0 for n under 16, 1 under 256, 2 under 4096, else 3."""
    return F.least(F.lit(3), F.floor(F.log2(F.greatest(n, F.lit(1))) / 4 + 1e-9)).cast("int")


def class_filter(terms: DataFrame) -> DataFrame:
    """at__, mask__: 16 hash bits by 4 classes of frequency for each slot, from terms (term, n_least)."""
    key = F.xxhash64("term")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bits(key, 16) * 4 + size_class(F.col("n_least")))
    return terms.select(slot(key).alias("at__"), mark.alias("mask__")).groupBy("at__").agg(F.bit_or("mask__").alias("mask__"))


def rare_enough(words: DataFrame, filter: DataFrame) -> DataFrame:
    """The rows (term, limit__) whose term may be of a class up to limit__."""
    key = F.xxhash64("term")
    classes = F.call_function("shiftrightunsigned", F.col("mask__"), bits(key, 16) * 4)
    wanted = F.call_function("shiftleft", F.lit(2), F.col("limit__")) - 1
    return words.join(F.broadcast(filter), slot(key) == F.col("at__")).where(classes.bitwiseAND(wanted.cast("long")) != 0).drop("at__", "mask__")


def disclosing_terms(docs: DataFrame, hits: DataFrame, *, generalise: float, remove: float, min_support: int, id_col: str, text_col: str) -> DataFrame:
    """did, content, terms, removed: for each document (id and text) that holds an entity, the terms that disclose it."""
    held = hits.where(F.size("base") > 0).select("did", "content", F.explode("base").alias("span")).select("did", "content", F.xxhash64("span.kind", "span.value").alias("entity")).distinct()
    total = float(max(hits.select("did", "content").distinct().count(), 1))

    def share_told(n_term: str) -> Column:
        """PMI of term and entity as a share of the entity's information."""
        ic = -F.log2(F.col("n_entity") / F.lit(total))
        pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col(n_term)))
        return F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))

    # contents first, then entities: a group of copies is one content, and both sums combine before the shuffle
    by_content = held.groupBy("entity", "content").agg(F.count("*").alias("n"))
    entities = by_content.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("contents")).where(F.col("contents") >= min_support).select("entity", "n_entity").checkpoint()
    # no pair has more contents than its entity, so texts without an entity of enough of them have no pair
    held = held.join(entities, "entity")
    holders = held.groupBy("content").agg(F.collect_set("entity").alias("entities"), F.count_distinct("did").alias("n_docs"), F.min("did").alias("rep"), F.max("n_entity").alias("most")).checkpoint()
    # one document of each content is read; what its rarest-bound entity allows a term goes with its slot
    named = docs.select(internal_id(id_col).alias("did"), content_of(text_col).alias("content"), F.col(text_col).cast("string").alias("text"))
    rarest = F.lit(total) * F.pow(F.col("most") / F.lit(total), F.lit(generalise))
    document = F.xxhash64("did", "content")
    chosen = passing(named, document, bit_filter(holders, F.xxhash64("rep", "content"), size_class(rarest)), keep=True)
    repeated = bit_filter(hits.groupBy("did", "content").agg(F.count("*").alias("n")).where("n > 1"), document)
    words = chosen.select("did", "content", "limit__", F.explode(words_of(F.col("text"))).alias("term"))
    # documents among those read that have the term are a lower bound of all that do; repeated rows do not count, as they are one
    single = passing(chosen, document, repeated, others=True).select(F.explode(words_of(F.col("text"))).alias("term"), F.lit(1).alias("one"))
    twice = passing(chosen, document, repeated).select(F.explode(words_of(F.col("text"))).alias("term"), F.lit(0).alias("one"))
    least = single.unionByName(twice).groupBy("term").agg(F.sum("one").alias("n_least"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_support).select("term", "n_least").checkpoint()
    found = rare_enough(words, class_filter(least)).groupBy("did", "content").agg(F.collect_set("term").alias("terms"))
    pairs = found.join(holders, (found["content"] == holders["content"]) & (F.col("did") == F.col("rep"))).select("n_docs", "entities", F.explode("terms").alias("term")).select("n_docs", "term", F.explode("entities").alias("entity"))
    counted = pairs.groupBy("entity", "term").agg(F.sum("n_docs").alias("n_both"), F.count("*").alias("contents")).where(F.col("contents") >= min_support)
    joint = counted.join(entities, "entity").join(least, "term").where(share_told("n_least") >= generalise).select("entity", "term", "n_both", "n_entity").checkpoint()
    # only rows that repeat a document have to be made distinct; the words of all others combine before the shuffle
    wanted = bit_filter(joint, F.xxhash64("term"))
    of_rows = lambda part: part.select("did", "content", F.explode(words_of(F.col("text"))).alias("term"))
    every = of_rows(passing(named, document, repeated, others=True)).select("term").unionByName(of_rows(passing(named, document, repeated)).distinct().select("term"))
    terms = passing(every, F.xxhash64("term"), wanted).groupBy("term").agg(F.count("*").alias("n_term"))
    told = joint.join(terms, "term").select("entity", "term", share_told("n_term").alias("told")).where(F.col("told") >= generalise)
    per = held.join(told, "entity").groupBy("did", "content", "term").agg(F.max("told").alias("told"))
    return per.groupBy("did", "content").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.collect_set(F.when(F.col("told") >= remove, F.col("term"))).alias("removed")).checkpoint()


def term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(f"(?iu)(?<![{_TERM}])(?:"), F.array_join(terms, "|"), F.lit(f")(?![{_TERM}])"))


def in_contents(docs: DataFrame, contents: DataFrame, text_col: str, *, others: bool = False) -> DataFrame:
    """The rows of docs whose text may be in contents, or (others) all other rows."""
    return passing(docs, content_of(text_col), bit_filter(contents, F.col("content")), others=others)


def find(docs: DataFrame, *, generalise: float = 0.9, remove: float = 0.97, min_support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base, terms): base has did and base spans of every row; terms has did, content, terms, removed of documents with disclosing terms."""
    prepared(docs.sparkSession)
    hits = find_base(docs, id_col, text_col).checkpoint()
    return hits, disclosing_terms(docs, hits, generalise=generalise, remove=remove, min_support=min_support, id_col=id_col, text_col=text_col)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs; spans also has the kind term.

    A null text is empty; a null id is an id of its own; a document is an id and a text, so rows that repeat an id have each their own text's spans.
    No entity in the corpus: base spans only. An empty table gives an empty result."""
    hits, terms = find(docs, id_col=id_col, text_col=text_col, **limits)
    texts = in_contents(docs.select(F.col(id_col), F.col(text_col)), terms, text_col)
    texts = texts.select(internal_id(id_col).alias("did"), content_of(text_col).alias("content"), F.col(text_col).cast("string").alias("text")).join(terms, ["did", "content"])
    more = texts.select("did", "content", placed(F.col("text"), term_pattern(F.col("terms")), "term").alias("more")).groupBy("did", "content").agg(F.first("more").alias("more"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    rows = hits.join(more, ["did", "content"], "left").select("did", "base", told(F.col("base")).alias("b"), told(F.coalesce("more", no_spans())).alias("t"))
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in PATTERNS]
    both = F.concat(F.col("b"), F.when((F.col("b") != "") & (F.col("t") != ""), ",").otherwise(""), F.col("t"))
    return rows.select(external_id("did").alias("doc_id"), *counts, F.sha2("b", 256).alias("base_sha256"), both.alias("spans"))


def masked(text: Column, marks: Column) -> Column:
    """The text with marks (structs start, stop, label) replaced; overlapping marks take the label of the first."""

    def step(state: Column, m: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, m["start"] - state["at"])
        put = F.struct(m["stop"].alias("at"), F.concat(state["out"], F.array(F.concat(gap, m["label"]))).alias("out"))
        return F.when(m["start"] >= state["at"], put).otherwise(F.struct(F.greatest(state["at"], m["stop"]).alias("at"), state["out"].alias("out")))

    done = F.aggregate(F.array_sort(marks), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with personal data masked as [EMAIL], [IP], [CARD], [PHONE], disclosing terms generalised to [TERM] or removed.

    Same columns and rows; texts without a span, and null texts, stay as they are. Texts are shuffled only where terms were found."""
    _, terms = find(docs, id_col=id_col, text_col=text_col, **limits)
    text = F.col("text__")
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    more = F.transform(placed(text, term_pattern(F.col("terms__")), "term"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(F.array_contains("removed__", F.lower(s["value"])), "").otherwise("[TERM]").alias("label")))
    named = terms.select(F.col("did").alias("did__"), F.col("content").alias("content__"), F.col("terms").alias("terms__"), F.col("removed").alias("removed__"))
    hot = in_contents(docs, terms, text_col).withColumn("text__", F.col(text_col).cast("string")).join(named, (internal_id(id_col) == F.col("did__")) & (content_of(text_col) == F.col("content__")), "left")
    cold = in_contents(docs, terms, text_col, others=True).withColumn("text__", F.col(text_col).cast("string"))

    def out(rows: DataFrame, marks: Column) -> DataFrame:
        rows = rows.withColumn("marks__", marks)
        clean = F.when(F.size("marks__") > 0, masked(text, F.col("marks__"))).otherwise(text)
        return rows.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])

    return out(cold, base).unionByName(out(hot, F.when(F.col("terms__").isNull(), base).otherwise(F.concat(base, more))))


def _oracle() -> str:
    """The query's rows in SQL: places from the pieces between matches, terms from joins of whole documents."""
    # The four patterns as the contract states them.
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    number = "regexp_replace(value, '[^0-9]', '', 'g')"
    doubled = "list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END))"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": f"length(digits) BETWEEN 13 AND 19 AND {doubled} % 10 = 0",
        "phone": "length(digits) BETWEEN 9 AND 15",
    }
    runs = "[\\p{L}\\p{M}\\p{N}]+"

    def places(kind: str, pattern: str, source: str) -> str:
        """no, kind, start, stop, value of each match in source's text."""
        parts = f"SELECT *, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM {source}"
        each = f"SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({parts}) AS x"
        start = "list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0)"
        return f"SELECT no, '{kind}' AS kind, ({start})::BIGINT AS start, ({start} + length(found[i]))::BIGINT AS stop, found[i] AS value FROM ({each}) AS y"

    found = " UNION ALL ".join(f"SELECT no, {n} AS nth, kind, start, stop, value FROM (SELECT *, {number} AS digits FROM ({places(kind, pattern, 'd')}) AS z) AS w WHERE {checks[kind]}" for n, (kind, pattern) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in patterns)
    return f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS text FROM documents
), base AS ({found}
), told AS (SELECT no, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY nth, start) AS b, list(struct_pack(a := start, z := stop, t := '') ORDER BY start, stop) AS marks FROM base GROUP BY no
), outside AS (SELECT d.no, d.doc_id, d.text, lower(CASE WHEN marks IS NULL THEN d.text ELSE r.t || substr(d.text, r.z + 1) END) AS rest FROM
    (SELECT d.no, marks, list_reduce(marks, lambda p, m: CASE WHEN m.a >= p.z THEN struct_pack(a := 0::BIGINT, z := m.z, t := p.t || substr(text, p.z + 1, m.a - p.z) || ' ') ELSE struct_pack(a := 0::BIGINT, z := greatest(p.z, m.z), t := p.t) END, struct_pack(a := 0::BIGINT, z := 0::BIGINT, t := '')) AS r FROM d LEFT JOIN told ON d.no = told.no) AS m JOIN d ON d.no = m.no
), docs AS (SELECT min(no) AS no, doc_id, text, any_value(rest) AS rest FROM outside GROUP BY doc_id, text
), total AS (SELECT count(*)::DOUBLE AS n FROM docs
), entity AS (SELECT DISTINCT docs.no, docs.text, kind || ':' || value AS e FROM docs JOIN base ON docs.no = base.no
), entities AS (SELECT e, count(*) AS n_entity FROM entity GROUP BY e HAVING count(DISTINCT text) >= 3
), words AS (SELECT no, text, unnest(list_distinct(regexp_extract_all(rest, '{runs}'))) AS term FROM docs
), terms AS (SELECT term, count(*) AS n_term FROM words GROUP BY term
), pairs AS (SELECT e, term, count(*) AS n_both FROM entity JOIN words ON entity.no = words.no GROUP BY e, term HAVING count(DISTINCT words.text) >= 3
), telling AS (SELECT e, term FROM pairs JOIN entities USING (e) JOIN terms USING (term), total
  WHERE n_entity < n AND log2(n_both * n / (n_entity * n_term::DOUBLE)) / -log2(n_entity / n) >= 0.9::DOUBLE
), flagged AS (SELECT docs.doc_id, docs.text, list(DISTINCT term) AS ts FROM entity JOIN telling USING (e) JOIN docs ON entity.no = docs.no GROUP BY docs.doc_id, docs.text
), holders AS (SELECT d.no, d.text, ts FROM d JOIN flagged f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.text = f.text
), more AS (SELECT p.no, string_agg('term:' || start || ':' || stop, ',' ORDER BY start) AS t FROM ({places('term', runs, 'holders')}) AS p JOIN holders h ON p.no = h.no WHERE list_contains(ts, lower(value)) GROUP BY p.no)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in patterns)}, sha256(coalesce(b, '')) AS base_sha256, concat_ws(',', b, t) AS spans
FROM d LEFT JOIN told ON d.no = told.no LEFT JOIN more ON d.no = more.no
"""


ORACLE = _oracle()
