"""Personal data: patterns, and terms that disclose them by co-occurrence over the corpus.

Patterns find the values to protect (e-mail and IP addresses, card and phone numbers). After the
information-theoretic view of sanitisation (Sanchez, Batet and Viejo, 2013), a term near a protected value discloses it
as far as their pointwise mutual information comes up to the value's own information: PMI(t, e) / IC(e), with probabilities
estimated over all documents. Terms over the threshold, met with the value in enough different contexts, are protected
too, wherever they stand.

DataFrame functions only. A first scan finds the values and their contexts; only terms met in enough contexts are then
counted over the corpus, by a semi-join that holds their table and not the corpus's vocabulary. Texts are never shuffled, but
for those documents that hold a disclosing term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import saved

KINDS = ("email", "ip", "card", "phone")
#: The patterns of each kind. Runs are entered at their begin only and never given back, which finds the
#: same matches as the plain patterns in linear time and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth a try.
_HINTS = {"email": "@", "phone": "+"}
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_TERM = r"\p{L}{3,}"
MIN_CONTEXTS, DISCLOSURE, CONTEXT_CHARS = 3, 0.9, 200
#: Up to so many terms, and keys of documents that hold them, go to all executors; more are joined by shuffle.
BROADCAST_TERMS, BROADCAST_KEYS = 100_000, 1_000_000
_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: _holds(kind, s["value"])


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with positions in code points: what the pattern splits off tells where they stand."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, begin, step)["out"]


def base_spans(text: Column) -> Column:
    """The pattern matches of a text that hold up, by kind and then position."""
    out = []
    for kind in KINDS:
        hint = text.contains(_HINTS[kind]) if kind in _HINTS else text.rlike(r"[0-9]\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[ -]?[0-9]){12}")
        spans = F.filter(_matches(text, F.lit(PATTERNS[kind]), kind), _valid(kind))
        out.append(F.when(hint, spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*out)


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _contexts(text: Column, spans: Column, chars: int) -> Column:
    """For each span its value and the terms around it in its line."""

    def one(s: Column) -> Column:
        before = F.element_at(F.split(F.substr(text, F.greatest(s["start"] - chars, F.lit(0)) + 1, F.least(s["start"], F.lit(chars))), "\n"), -1)
        after = F.element_at(F.split(F.substr(text, s["stop"] + 1, F.lit(chars)), "\n"), 1)
        around = F.regexp_replace(F.lower(F.concat(before, F.lit(" "), after)), r"\S*[@0-9]\S*", " ")
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.array_distinct(F.regexp_extract_all(around, F.lit(_TERM), F.lit(0))).alias("terms"))

    return F.transform(spans, one)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("rid"))


def _base(docs: DataFrame, chars: int) -> DataFrame:
    spans = _keyed(docs).withColumn("spans", base_spans(F.col("text")))
    return saved(spans.select("doc_id", "rid", F.transform("spans", lambda s: s.dropFields("value")).alias("spans"), _contexts(F.col("text"), F.col("spans"), chars).alias("near")))


def disclosing_terms(docs: DataFrame, base: DataFrame, min_contexts: int, disclosure: float) -> tuple[DataFrame, DataFrame] | None:
    """The terms that disclose a protected value, with where they stand: (term, entity, disclosure), (rid, terms).

    None where no term is met with one value in min_contexts different contexts.
    """
    near = base.where("size(near) > 0").select("rid", F.explode("near").alias("x")).select("rid", "x.entity", "x.terms", F.xxhash64("x.terms").alias("context"))
    met = near.select("rid", "entity", "context", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("rid").alias("together")).where(F.col("contexts") >= min_contexts)
    pairs = saved(pairs)
    if pairs.isEmpty():
        return None
    seen = _holding(docs, pairs.select("term").distinct()).groupBy("term").agg(F.count("*").alias("with_term"))  # added up task by task
    total = base.count()
    having = near.groupBy("entity").agg(F.count_distinct("rid").alias("with_entity"))
    pmi = F.log2(F.col("together") * float(total) / (F.col("with_term") * F.col("with_entity").cast("double")))
    own = F.log2(F.lit(float(total)) / F.col("with_entity"))
    told = pairs.join(seen, "term").join(having, "entity").withColumn("disclosure", F.when(own > 0, pmi / own).otherwise(0.0)).where(F.col("disclosure") >= disclosure)
    told = saved(told.select("term", "entity", "disclosure"))
    # where they stand is asked of disclosing terms only: common words are counted, but never listed
    return told, saved(_holding(docs, told.select("term").distinct()).groupBy("rid").agg(F.collect_set("term").alias("terms")))


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, rid): the documents that hold any of the terms."""
    terms = F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    return _keyed(docs).select("rid", F.explode(words).alias("term")).join(terms, "term", "left_semi")


def term_spans(docs: DataFrame, stands: DataFrame) -> DataFrame:
    """(rid, more): spans of the given terms in the documents that hold them."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array("terms"), "|"), F.lit(r")(?!\p{L})"))
    there = _keyed(docs)
    if (keys := _few_keys(stands)) is not None:
        there = there.join(keys, "rid", "left_semi")  # so that only these texts are shuffled
    there = there.join(stands, "rid").dropDuplicates(["rid"])
    return there.select("rid", F.transform(_matches(F.col("text"), pattern, "term"), lambda s: s.dropFields("value")).alias("more"))


def _few_keys(stands: DataFrame) -> DataFrame | None:
    """The documents' keys for a broadcast, if they are few enough."""
    keys = stands.select("rid")
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else None


def personal_data(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(doc_id, base, spans) of each row of docs(doc_id, text): spans of protected values, and with disclosing terms.

    A span is (kind, start, stop) in code points, stop exclusive; by kind (email, ip, card, phone, term), then start. Null and empty
    texts have none; rows without doc_id and repeated rows each give their row; other columns are ignored.
    """
    base = _base(docs, context_chars)
    told = disclosing_terms(docs, base, min_contexts, disclosure)
    if told is None:
        return base.select("doc_id", F.col("spans").alias("base"), "spans")
    more = term_spans(docs, told[1])
    both = base.join(more, "rid", "left")
    return both.select("doc_id", F.col("spans").alias("base"), F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def _cleaned(text: Column, spans: Column) -> Column:
    """text with each maximal run of overlapping spans put as [KIND] of its first one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    return F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """docs with all its columns, protected values and disclosing terms replaced in `text` by [EMAIL], [IP], [CARD], [PHONE], [TERM].

    Null texts stay null. An n_chars column of the text's length, where there is one, follows the new text.
    """
    told = disclosing_terms(docs, _base(docs, context_chars), min_contexts, disclosure)
    spans = F.transform(base_spans(F.col("text")), lambda s: s.dropFields("value"))
    if told is None:
        out = docs.withColumn("__spans", spans)
    else:
        keyed = docs.withColumn("__rid", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
        more = term_spans(docs, told[1]).select(F.col("rid").alias("__rid"), F.col("more").alias("__terms"))
        none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
        if (keys := _few_keys(told[1])) is not None:  # the other texts stay where they are
            keys = keys.withColumnRenamed("rid", "__rid")
            joined = keyed.join(keys, "__rid", "left_semi").join(more, "__rid", "left").unionByName(keyed.join(keys, "__rid", "left_anti").withColumn("__terms", none))
        else:
            joined = keyed.join(more, "__rid", "left")
        out = joined.withColumn("__spans", F.concat(spans, F.coalesce("__terms", none)))
    out = out.withColumn("text", F.when(F.size("__spans") > 0, _cleaned(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
