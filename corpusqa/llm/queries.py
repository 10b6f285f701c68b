"""The registered queries over the given tables, with production parameters."""

from . import (
    decontaminate, exact_dedup, infilling, licenses, minhash, mixing, quality, resampling, secrets, sharding, simhash,
    toxicity, url_filter,
)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", """
with texts as (select doc_id, coalesce(text, '') t from documents)
select doc_id, max(doc_id) over same keep_id, count(*) over same group_size,
       doc_id = max(doc_id) over same kept, sha256(t) text_sha256
from texts window same as (partition by t)""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query("op2_benchmark_leaks")
def op2_benchmark_leaks(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


MIX_SQL = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
       cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':11'), 1, 15) as bigint) number from documents),
sources as (select source, cast(sum(size) as bigint) source_size, 2 * cast(sum(size) as bigint) cap,
       [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] weight from sized group by source),
filled as (select *, sum(cap) over below fixed, sum(weight) over () - sum(weight) over below free,
       1.5 * sum(source_size) over () words, cap / weight ratio from sources window below as (order by cap / weight, source nulls last)),
levels as (select 0.0::double ratio, (any_value(words) / sum(weight))::double lvl from filled
       union all select ratio, ((words - fixed) / free)::double from filled where free > 0),
level as (select max(lvl) lvl from levels where ratio <= lvl),
targets as (select source, source_size, case when source_size = 0 then 0.0 else least(cap::double, lvl * weight) end target from sources, level),
plan as (select *, case when source_size = 0 then 0 else floor(target / source_size) end whole from targets),
ordered as (select *, sum(size) over (partition by source order by number) - sum(size) over (partition by source, number) start,
       sum(size) over (partition by source, number) tied from sized)
select doc_id, cast(size as bigint) size, source_size, target,
       cast(size * (whole + case when 2 * start + tied <= 2 * (target - whole * source_size) then 1 else 0 end) as bigint) taken
from ordered join plan on ordered.source is not distinct from plan.source
"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark, sf_dir):
    return mixing.mix_table(read(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark, sf_dir):
    return quality.quality_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_shards")
def op6_shards(spark, sf_dir):
    return sharding.shard_table(read(spark, sf_dir, "documents"), shards=16)


@query("op7_simhash_groups")
def op7_simhash_groups(spark, sf_dir):
    return simhash.near_duplicate_table(read(spark, sf_dir, "documents"))


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    return licenses.license_table(read(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# Fixed values of the query.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]

URL_SQL = """
with rules(verdict, host, path) as (values %s),
parts as (select page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') rest from pages),
urls as (select page_id, row_number() over () r,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from parts),
fits as (select u.r, u.page_id, u.host, u.path, l.host || l.path rule, l.verdict,
         row_number() over (partition by u.r order by length(l.host || l.path) desc, length(l.host) desc, l.host || l.path) n
         from urls u left join rules l
         on (u.host = l.host or ends_with(u.host, '.' || l.host)) and starts_with(u.path, l.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from fits where n = 1
""" % ", ".join(repr(r) for r in URL_RULES)


@query("op10_url_filter", URL_SQL)
def op10_url_filter(spark, sf_dir):
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@query("op11_minhash_groups")
def op11_minhash_groups(spark, sf_dir):
    return minhash.near_duplicate_table(read(spark, sf_dir, "documents"))


@query("op12_resample")
def op12_resample(spark, sf_dir):
    return resampling.resample_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_infill")
def op13_infill(spark, sf_dir):
    return infilling.infill_table(read(spark, sf_dir, "documents"))
