"""The registered queries of the text operators: thin calls over whole tables, with production parameters."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_text, jaccard, langid, lm, pieces, pii, quality, runs, suffixes, trie, url_filter


#: Where the public vocabularies are; a parameter, they are not a part of the repository.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The one that op4 encodes with, and the one of op3's model.
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SUBWORD_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The rules that op2 judges by: host, path prefix, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=75)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def findable(spark: SparkSession) -> None:
    """Lets local Python workers import this library from where the driver did, and sends them texts in smaller batches."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
    if spark.conf.get(BATCH, "10000") == "10000":  # Spark's default, for narrow rows; whole texts are a thousand times as wide
        spark.conf.set(BATCH, "1000")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.rendered(F.col("base")), 256).alias("base_sha256"), pii.rendered(F.col("spans")).alias("spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), pieces.read_model(spark, SUBWORD_RANKS))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.read_model(spark, PIECE_MODEL))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.removed_bytes(table(spark, sf_dir, "documents"), length=200)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return trie.trie_nodes(*trie.spliced(trie.numbered(table(spark, sf_dir, "conversations")), 20, head))


def with_periods(docs: DataFrame) -> DataFrame:
    """docs in which the texts of every tenth id or so, by crc32, become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    told = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    told = told.select("doc_id", "text", "g", "w", F.size("w").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    told = told.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    periodic = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return told.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")), times=4, least=6)
    stronger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    told = out.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), stronger))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_lm_scores": op3_lm_scores,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_language_id": op11_language_id,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = "case when strpos({0}, '://') > 0 then substr({0}, strpos({0}, '://') + 3) else '' end"


def _undotted(path: str) -> str:
    walked = f"list_reduce(string_split({path}, '/'), lambda t, x: case when x = '..' then regexp_replace(t, '/[^/]*$', '') when x = '.' then t else t || '/' || x end)"
    return f"case when {path} like '%/.%' then {walked} || case when regexp_matches({path}, '/[.][.]?$') then '/' else '' end else {path} end"


def _parts(url: str, plain: bool = False) -> str:
    """host, path and key; of a plain URL the path's dots are taken out."""
    after = _AFTER.format(url)
    host, path = _LOWER.format(f"regexp_extract({after}, $$^[^/?#]*$$)"), f"regexp_extract({after}, $$^[^/?#]*([^?#]*)$$, 1)"
    return f"{host} as host, {_undotted(path) if plain else path} as path, {host} || {_undotted(path)} || regexp_extract({after}, $$^[^?#]*([^#]*)$$, 1) as key"


_URL_SQL = rf"""with recursive rules(rh, rp, rv) as (values {', '.join(map(str, URL_RULES))}),
urls as (select page_id, url, html, {_parts("coalesce(url, '')")} from pages),
tags as (select key, host, path, regexp_replace(html, $${url_filter.NO_TAGS}$$, ' ', 'g') as html from urls where url is not null),
found as (select key, host, path, unnest(list_transform(list_filter(regexp_extract_all(html, $${url_filter.TAG.format('link')}$$), lambda t: regexp_matches(t, $${url_filter.CANONICAL}$$)), lambda t: regexp_extract(t, $${url_filter.HREF}$$, 1)) || list_transform(list_filter(regexp_extract_all(html, $${url_filter.TAG.format('meta')}$$), lambda t: regexp_matches(t, $${url_filter.REFRESH}$$)), lambda t: regexp_extract(t, $${url_filter.TO}$$, 1))) as t from tags),
targets as (select key, host, path, replace(trim(regexp_replace(t, '^["'']|["'']$', '', 'g'), ' '), '&amp;', '&') as t from found),
edges as (select key as a, case when t like '%://%' then t when t like '//%' then 'http:' || t when t like '/%' then 'http://' || host || t when t[1] in ('?', '#') then 'http://' || host || path || t else 'http://' || host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || t end as b from targets where t <> ''),
ends as (select a, {_parts('b', True)} from edges),
pairs as (select a as x, key as y from ends union select key, a from ends),
reach as (select x, y from pairs union select r.x, p.y from reach r join pairs p on p.x = r.y),
nodes as (select key, host, path from urls union select key, host, path from ends),
fits as (select n.key, n.host, n.path, rh || rp as rule, rv from nodes n join rules on (n.host = rh or n.host like '%.' || rh) and starts_with(n.path, rp) qualify row_number() over (partition by n.key, n.host, n.path order by length(rh) + length(rp) desc, length(rh) desc, rv) = 1),
bad as (select distinct r.x as key from reach r join fits f on f.key = r.y where rv = 'block')
select u.page_id, u.host, u.path, f.rule, coalesce(f.rv, case when b.key is not null and u.host <> '' then 'block' else 'allow' end) as verdict
from urls u left join fits f on f.key = u.key and f.host = u.host and f.path = u.path left join bad b on b.key = u.key"""

_JACCARD_SQL = rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, $$[\x20\x09-\x0D]+$$), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
l as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach as (select x, y from l union select r.x, l.y from reach r join l on l.x = r.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(y) from reach r where r.x = d.doc_id), d.doc_id)) as component_id from documents d left join n on n.doc_id = d.doc_id"""

_CRC = "(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * length(c::varchar)), lambda s: s)), lambda v, s: case when (xor(v, case when s % 8 = 0 then ascii(substr(c::varchar, (s // 8 + 1)::bigint, 1)) else 0 end) & 1) = 1 then xor(xor(v, case when s % 8 = 0 then ascii(substr(c::varchar, (s // 8 + 1)::bigint, 1)) else 0 end) >> 1, 3988292384) else xor(v, case when s % 8 = 0 then ascii(substr(c::varchar, (s // 8 + 1)::bigint, 1)) else 0 end) >> 1 end))"
_TRIE_SQL = rf"""with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select c, list({{'r': role, 't': text}} order by turn nulls first, role, text) as own from t group by c),
h as (select c, own, xor({_CRC}, 4294967295) % 4 as h from l),
b as (select h.c, case when h.h = 0 then [] else coalesce(l.own, [])[1 : h.h] end || h.own[h.h + 1 :] as w from h left join l on l.c = h.c - h.c % 20),
q as (select c, d, case when d = 0 then [] else w[1 : d] end as pre, d = len(w) as over from (select c, w, unnest(range(0, len(w) + 1)) as d from b)),
n as (select pre, d, min(c) as c, count(*) as n_convs, string_agg(c::varchar, ',' order by c) filter (over) as e, case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(pre[-1].t, $$[^\x20\x09-\x0D]+$$)) end as saved from q group by pre, d),
m as (select q.c, q.d, n.c as top from q join n on q.pre = n.pre and q.d = n.d),
p as (select n.*, m.top as parent from n left join m on m.c = n.c and m.d = n.d - 1),
k as (select parent as c, d - 1 as d, count(*) as n_children from p where d > 0 group by 1, 2),
f as (select p.*, coalesce(k.n_children, 0) as n_children from p left join k on k.c = p.c and k.d = p.d),
s as (select m.top as c, m.d, count(*) filter (f.n_children = 0) as n_leaves, sum(f.saved) as saved_tokens from f join m on m.c = f.c and m.d <= f.d group by 1, 2)
select f.c as conv_id, f.d as depth, f.parent as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(f.e, '')) as ends_sha256 from f join s on s.c = f.c and s.d = f.d"""

#: The same results in DuckDB's SQL. The others can't be put in SQL, or hang on floating-point sums in a given order.
ORACLES: dict[str, str] = {
    "op2_url_filter": _URL_SQL,
    "op10_ngram_jaccard": _JACCARD_SQL,
    "op12_conversation_trie": _TRIE_SQL,
}
