"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm import bpe, decontaminate, html, masked_lm, minhash, phrases, records, runs, secrets, simhash, toxicity, transducer, url_filter
from motefield.runtime import new_table_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), records.record_folder(spark))
    read = new_table_path(spark, "read-records")
    records.record_digests(index).write.parquet(read)
    return records.with_starts(spark.read.parquet(read)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``, for every id divisible by 100: the documents whose fingerprints differ in at most 16 of 128 bits, itself not counted."""
    path = new_table_path(spark, "prints")
    out = simhash.neighbour_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out.write.option("compression", "zstd").parquet(path)
    prints = spark.read.schema(out.schema).parquet(path)
    counted = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = prints.where("doc_id % 100 = 0")
    found = simhash.within_radius(asked, counted).join(counted, "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    near = asked.join(found.withColumnRenamed("query", "fingerprint"), "fingerprint").select(*prints.columns, "n_near")
    return prints.where("doc_id % 100 <> 0 or doc_id is null").withColumn("n_near", F.lit(None).cast("long")).unionByName(near)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


CONTAMINATION_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
sized as (select *, least(10, len(w)) as n from b where len(w) > 0),
wanted as (select distinct item_id, n, w[i:i+n-1] as win from (select *, unnest(range(1, len(w) - n + 2)) as i from sized)),
places as (select doc_id, n, i, w[i:i+n-1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from sized) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from places join wanted using (n, win)),
hit_words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op6_decontamination"] = CONTAMINATION_SQL


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), link=85)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Fixed rules of the report: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL_SQL = r"""
with parts as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path, row_number() over () as i from pages),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits as (select i, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
    from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by i)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join hits using (i)
"""


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark, URL_RULES))


ORACLES["op11_url_filter"] = URL_SQL


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=runs.planted)


PHRASE_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as x from d),
w as (select lang, regexp_extract_all(x, '[^\x20\x09]+') as ws from pieces),
total as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
words as (select row_number() over () as i, lang, ws from w where len(ws) > 0),
seq as materialized (select i, lang, unnest(ws) as word, generate_subscripts(ws, 1) as j from words),
runs as (select lang, word, lead(word, 1) over p as w2, lead(word, 2) over p as w3, lead(word, 3) over p as w4, lead(word, 4) over p as w5
    from seq window p as (partition by i order by j)),
places as (select lang, 1 as k, word as p from runs union all select lang, 2, word || ' ' || w2 from runs where w2 is not null
    union all select lang, 3, concat_ws(' ', word, w2, w3) from runs where w3 is not null
    union all select lang, 4, concat_ws(' ', word, w2, w3, w4) from runs where w4 is not null
    union all select lang, 5, concat_ws(' ', word, w2, w3, w4, w5) from runs where w5 is not null),
f as materialized (select lang, k, string_split(p, ' ') as ws, p, count(*) as c from places group by all having count(*) >= 100),
parts as (select lang, p, k, c as a, j, array_to_string(ws[1:j], ' ') as p1, array_to_string(ws[j+1:], ' ') as p2
    from (select *, unnest(range(1, k)) as j from f where k > 1)),
cuts as (select b.lang, b.p, b.a, b.j, l.c as l, r.c as r, t.n, cast(1000::hugeint * b.a * t.n // (l.c::hugeint * r.c) as bigint) as score
    from parts b join f l on l.lang = b.lang and l.p = b.p1 join f r on r.lang = b.lang and r.p = b.p2 join total t on t.lang = b.lang),
best as (select *, row_number() over (partition by lang, p order by score, j) as place from cuts),
inner_parts as (select lang, array_to_string(ws[s:e], ' ') as p, max(c) as longer
    from (select *, unnest(range(1, k)) as s from f where k > 2) cross join (select unnest([2, 3, 4, 5]) as e) where e <= k and e > s and e - s + 1 < k group by all),
kept as (select b.lang, b.p as phrase, a, l, r, n, score from best b left join inner_parts i on i.lang = b.lang and i.p = b.p
    where place = 1 and (longer is null or 100 * longer < 100 * a))
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept) where rank <= 2000
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES["op13_collocations"] = PHRASE_SQL
