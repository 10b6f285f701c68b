"""Names, question tables, profiles and evidence."""

from pyspark.sql import functions as F

from corpusqa import session
from corpusqa.operators import documents as docs
from corpusqa.operators import entities as ent
from corpusqa.operators import evidence as ev
from corpusqa.operators import profiles as pr
from corpusqa.plans import metadata
from corpusqa.plans.evidence import evidence_for
from corpusqa.sources import merge

from .registry import registry
from .views import aliases_of_registry_sql, strip_sql, table, view, with_views

QUERIES, ORACLES, query = registry()


def asked(spark, sf_dir):
    return ent.asked_questions(view(spark, sf_dir, "questions"), view(spark, sf_dir, "question_mps"))


def stored_asked(spark, sf_dir):
    """The join as a stored table, for profiles that read it several times or go by its number of rows."""
    return session.write_and_read(asked(spark, sf_dir), "asked")


def latest_first():
    return [F.desc("ord1"), F.desc("ord2"), F.desc("ord3")]


# ---- names -------------------------------------------------------------

NAMES = with_views("registry") + "," + aliases_of_registry_sql()


@query("canonical_names", NAMES + " select name, canonical from name_map")
def canonical_names(spark, sf_dir):
    return ent.canonical_names(view(spark, sf_dir, "registry"))


@query("alias_map", NAMES + " select canonical, array_to_string(aliases, '|') aliases from alias_map")
def alias_map(spark, sf_dir):
    names = ent.canonical_names(view(spark, sf_dir, "registry"))
    return ent.alias_map(names).select("canonical", F.array_join("aliases", "|").alias("aliases"))


@query("name_map_summary", NAMES + """
select (select count(*) from name_map) as names,
       (select count(*) from name_map where name <> canonical) as remapped,
       (select count(*) from alias_map) as canonicals,
       (select count(*) from alias_map where len(aliases) > 1) as multi_alias""")
def name_map_summary(spark, sf_dir):
    return ent.name_map_summary(ent.canonical_names(view(spark, sf_dir, "registry")))


@query("all_canonical_names", NAMES + " select distinct canonical as name from name_map")
def all_canonical_names(spark, sf_dir):
    return ent.all_canonical_names(ent.canonical_names(view(spark, sf_dir, "registry")))


@query("all_ministry_names", with_views("corpus") + f"""
select distinct {strip_sql('ministry')} as name from corpus where {strip_sql('ministry')} <> ''""")
def all_ministry_names(spark, sf_dir):
    return ent.all_ministry_names(view(spark, sf_dir, "corpus"), "ministry")


@query("search_names", NAMES + """
select distinct canonical as name from name_map where contains(upper(canonical), upper('shri sUpplier#00000000'))""")
def search_names(spark, sf_dir):
    names = ent.all_canonical_names(ent.canonical_names(view(spark, sf_dir, "registry")))
    return docs.search_names(names, "shri sUpplier#00000000")


@query("resolve_requests", NAMES + """
select mpName as mp, array_to_string(coalesce(aliases, [mpName]), '|') as names
from (select distinct mpName from registry) r left join alias_map a on a.canonical = r.mpName""")
def resolve_requests(spark, sf_dir):
    registry = view(spark, sf_dir, "registry")
    requests = registry.select(F.col("mpName").alias("mp")).distinct()
    resolved = ent.resolve_requests(requests, ent.alias_map(ent.canonical_names(registry)))
    return resolved.select("mp", F.array_join("names", "|").alias("names"))


# ---- question tables ---------------------------------------------------

LATEST = f"""
winners as (select * from (
    select *, row_number() over (partition by lok_no, session_no, type, ques_no
                                 order by ord1 desc, ord2 desc, ord3 desc) rn from corpus) where rn = 1)"""


@query("build_questions", with_views("corpus") + "," + LATEST + f"""
select lok_no, session_no, ques_no, type, date, nullif({strip_sql('ministry')}, '') as ministry,
       nullif(subject, '') as subject from winners""")
def build_questions(spark, sf_dir):
    return ent.build_questions(view(spark, sf_dir, "corpus"), latest_first())


MENTIONS = f"""
(select * from (select *, {strip_sql('m')} as mp from (
    select *, unnest(string_split(members, ',')) as m from SOURCE)) where mp <> '')"""


@query("build_links", with_views("corpus", "registry") + "," + aliases_of_registry_sql() + "," + LATEST + f"""
select lok_no, session_no, ques_no, type, coalesce(canonical, mp) as mp_name
from {MENTIONS.replace('SOURCE', 'winners')} x left join name_map on name = mp""")
def build_links(spark, sf_dir):
    names = ent.canonical_names(view(spark, sf_dir, "registry"))
    return ent.build_links(view(spark, sf_dir, "corpus"), names, latest_first())


def merged(spark, sf_dir):
    """The metadata tables after two merges: the older documents, then the newer ones."""
    corpus, registry = view(spark, sf_dir, "corpus"), view(spark, sf_dir, "registry")
    root = session.scratch_path(spark, "merged")
    newer = F.col("ord1") >= F.lit("1995-06-17").cast("date")
    for part in (corpus.where(~newer), corpus.where(newer)):
        merge.merge_metadata(part, registry, latest_first(), root)
    return merge.read_metadata(spark, root)


@query("merge_questions", ORACLES["build_questions"])
def merge_questions(spark, sf_dir):
    return merged(spark, sf_dir)[0]


@query("merge_links", ORACLES["build_links"])
def merge_links(spark, sf_dir):
    return merged(spark, sf_dir)[1]


@query("build_counts", with_views("corpus", "registry") + "," + aliases_of_registry_sql() + f"""
select (select count(*) from corpus) as questions, count(*) as links,
       count(*) filter (where canonical is not null and canonical <> mp) as renamed
from {MENTIONS.replace('SOURCE', 'corpus')} x left join name_map on name = mp""")
def build_counts(spark, sf_dir):
    names = ent.canonical_names(view(spark, sf_dir, "registry"))
    return ent.build_counts(view(spark, sf_dir, "corpus"), names)


@query("asked_questions", with_views("questions", "question_mps") + """
select q.lok_no, q.session_no, q.ques_no, q.type, q.date, q.ministry, q.subject, m.mp_name
from questions q join question_mps m using (lok_no, session_no, type, ques_no)""")
def asked_questions(spark, sf_dir):
    return asked(spark, sf_dir)


# ---- profiles ----------------------------------------------------------

PROFILES = with_views("questions", "question_mps") + """,
asked as (select q.*, m.mp_name from questions q join question_mps m using (lok_no, session_no, type, ques_no))"""

LABEL = "'Lok ' || lok_no || ' Session ' || session_no"


def breakdown_sql(source, key):
    parts = [
        f"select {key}, '{kind}' as kind, cast({col} as varchar) as key, count(*) as count from {source} group by all"
        for kind, col in (("lok", "lok_no"), ("session", LABEL), ("type", "type"))
    ]
    return PROFILES + "\n" + "\nunion all\n".join(parts)


def breakdown_rows(profile, key):
    """One row per (key, kind, value) from the three ordered arrays."""
    def tag(kind, col):
        return F.transform(col, lambda e: F.struct(
            F.lit(kind).alias("kind"), e["key"].cast("string").alias("key"), e["count"].alias("count")))
    entries = F.concat(tag("lok", F.col("by_lok")), tag("session", F.col("by_session")), tag("type", F.col("by_type")))
    return profile.select(key, F.inline(entries))


@query("member_profile_breakdowns", breakdown_sql("asked", "mp_name"))
def member_profile_breakdowns(spark, sf_dir):
    rows, keys = stored_asked(spark, sf_dir), ["mp_name"]
    parts = pr.parts_of(rows)
    return breakdown_rows(pr.breakdowns(pr.fine_counts(rows, keys, parts=parts), keys, parts=parts), "mp_name")


@query("member_profile_top_ministries", PROFILES + """
select mp_name, rank, ministry as key, count from (
  select mp_name, ministry, count(*) as count,
         row_number() over (partition by mp_name order by count(*) desc, max(date || lpad(cast(ques_no as varchar), 12, '0')) desc, ministry) as rank
  from asked group by mp_name, ministry) where rank <= 15""")
def member_profile_top_ministries(spark, sf_dir):
    rows = stored_asked(spark, sf_dir)
    return pr.top_categories(rows, ["mp_name"], "ministry", parts=pr.parts_of(rows))


RECENT_SQL = """
select {keys}, rank, lok_no, session_no, ques_no, type, date, {rest} subject from (
  select *, row_number() over (partition by {keys} order by date desc nulls last, ques_no desc, lok_no, session_no, type) as rank
  from {source}) where rank <= 10"""


@query("member_profile_recent", PROFILES + RECENT_SQL.format(keys="mp_name", rest="ministry,", source="asked"))
def member_profile_recent(spark, sf_dir):
    return pr.recent_questions(asked(spark, sf_dir), ["mp_name"])


@query("ministry_profile_breakdowns", breakdown_sql("questions", "ministry"))
def ministry_profile_breakdowns(spark, sf_dir):
    fine = pr.fine_counts(view(spark, sf_dir, "questions"), ["ministry"])
    return breakdown_rows(pr.breakdowns(fine, ["ministry"]), "ministry")


@query("ministry_profile_top_members", PROFILES + """
select ministry, rank, mp_name as key, count from (
  select ministry, mp_name, count(*) as count,
         row_number() over (partition by ministry order by count(*) desc, mp_name) as rank
  from asked group by ministry, mp_name) where rank <= 15""")
def ministry_profile_top_members(spark, sf_dir):
    return pr.top_categories(asked(spark, sf_dir), ["ministry"], "mp_name", tie="name")


@query("ministry_profile_recent", PROFILES + RECENT_SQL.format(keys="ministry", rest="", source="questions"))
def ministry_profile_recent(spark, sf_dir):
    return pr.recent_questions(view(spark, sf_dir, "questions"), ["ministry"])


@query("overlap_profile_types", PROFILES + """
select mp_name, ministry, cast(sum(count(*)) over (partition by mp_name, ministry) as bigint) as total_questions,
       type as key, count(*) as count
from asked group by mp_name, ministry, type""")
def overlap_profile_types(spark, sf_dir):
    rows, keys = stored_asked(spark, sf_dir), ["mp_name", "ministry"]
    parts = pr.parts_of(rows)
    rows = pr.breakdowns(pr.fine_counts(rows, keys, parts=parts), keys, parts=parts)
    return rows.select(*keys, "total_questions", F.inline("by_type"))


@query("overlap_profile_recent", PROFILES + RECENT_SQL.format(keys="mp_name, ministry", rest="", source="asked"))
def overlap_profile_recent(spark, sf_dir):
    return pr.recent_questions(asked(spark, sf_dir), ["mp_name", "ministry"])


# ---- evidence ----------------------------------------------------------

NL = "chr(10)"


def counts_sql(source, key, col, line, order=None):
    return f"""(select {key}, string_agg({line}, {NL} order by {order or 'k'}) as lines from (
        select {key}, {col} as k, count(*) as n from {source} group by all) group by {key})"""


def recent_sql(source, keys, n):
    return f"""(select {keys}, 'Recent Questions (' || count(*) || '):' || {NL} ||
         string_agg('  ' || rank || '. [Lok ' || lok_no || ', Session ' || session_no || ', Q' || ques_no || ', ' || type || '] '
                    || ministry || ' — ' || {strip_sql('subject')} || ' (' || coalesce(nullif(date, ''), 'N/A') || ')',
                    {NL} order by rank) as lines
       from (select *, row_number() over (partition by {keys}
                 order by date desc nulls last, ques_no desc, lok_no, session_no, type) as rank from {source})
       where rank <= {n} group by {keys})"""


def top_sql(key, by, tie):
    return f"""(select {key}, string_agg('  ' || lpad(cast(n as varchar), cast(greatest(4, length(cast(n as varchar))) as int), ' ') || '  ' || {by}, {NL} order by rank) as lines
       from (select *, row_number() over (partition by {key} order by n desc, {tie} {by}) as rank from (
           select {key}, {by}, count(*) as n, max(date || lpad(cast(ques_no as varchar), 12, '0')) as latest
           from asked group by {key}, {by})) where rank <= 15 group by {key})"""


def text_ctes(suffix, n):
    """Text of every member and ministry profile with `n` recent questions."""
    lok = counts_sql("{s}", "{k}", "lok_no", "'  Lok ' || k || ': ' || n")
    return f"""
mt{suffix} as (select a.mp_name, '=== MP STATISTICS ===' || {NL} || 'MP Name: ' || a.mp_name || {NL}
    || 'Total questions asked: ' || a.total || {NL} || {NL} || 'By Lok Sabha:' || {NL} || l.lines || {NL} || {NL}
    || 'By Session:' || {NL} || s.lines || {NL} || {NL} || 'By Type:' || {NL} || t.lines || {NL} || {NL}
    || 'Top Ministries:' || {NL} || m.lines || {NL} || {NL} || r.lines || {NL} || {NL}
    || '{ev.MEMBER_NOTE}' || {NL} || '=== END MP STATISTICS ===' as body
  from (select mp_name, count(*) as total from asked group by mp_name) a
  join {lok.format(s='asked', k='mp_name')} l using (mp_name)
  join {counts_sql('asked', 'mp_name', LABEL, "'  ' || k || ': ' || n")} s using (mp_name)
  join {counts_sql('asked', 'mp_name', 'type', "'  ' || k || ': ' || n")} t using (mp_name)
  join {top_sql('mp_name', 'ministry', 'latest desc,')} m using (mp_name)
  join {recent_sql('asked', 'mp_name', n)} r using (mp_name)),
dt{suffix} as (select a.ministry, '=== MINISTRY STATISTICS ===' || {NL} || 'Ministry: ' || a.ministry || {NL}
    || 'Total questions received: ' || a.total || {NL} || {NL} || 'By Lok Sabha:' || {NL} || l.lines || {NL} || {NL}
    || 'By Type:' || {NL} || t.lines || {NL} || {NL} || 'Top MPs asking this ministry:' || {NL} || m.lines || {NL} || {NL}
    || r.lines || {NL} || {NL} || '{ev.MINISTRY_NOTE}' || {NL} || '=== END MINISTRY STATISTICS ===' as body
  from (select ministry, count(*) as total from questions group by ministry) a
  join {lok.format(s='questions', k='ministry')} l using (ministry)
  join {counts_sql('questions', 'ministry', 'type', "'  ' || k || ': ' || n")} t using (ministry)
  join {top_sql('ministry', 'mp_name', '')} m using (ministry)
  join {recent_sql('questions', 'ministry', n)} r using (ministry))"""


OVERLAP_CTE = f"""
ot as (select a.mp_name, a.ministry, '=== OVERLAP: ' || a.mp_name || ' × ' || a.ministry || ' ===' || {NL}
    || 'Questions from this MP to this Ministry: ' || a.total || {NL} || 'By Type: ' || t.lines || {NL} || {NL}
    || r.lines || {NL} || {NL} || '=== END OVERLAP ===' as body
  from (select mp_name, ministry, count(*) as total from asked group by mp_name, ministry) a
  join (select mp_name, ministry, string_agg(k || ': ' || n, ', ' order by k) as lines from (
        select mp_name, ministry, type as k, count(*) as n from asked group by all) group by mp_name, ministry) t using (mp_name, ministry)
  join {recent_sql('asked', 'mp_name, ministry', 10)} r using (mp_name, ministry))"""


@query("member_profile_text", PROFILES + "," + text_ctes("", 10) + " select mp_name, body as profile from mt")
def member_profile_text(spark, sf_dir):
    rows = stored_asked(spark, sf_dir)
    return pr.member_profiles(rows, parts=pr.parts_of(rows)).select("mp_name", ev.member_text().alias("profile"))


@query("ministry_profile_text", PROFILES + "," + text_ctes("", 10) + " select ministry, body as profile from dt")
def ministry_profile_text(spark, sf_dir):
    profiles = pr.ministry_profiles(view(spark, sf_dir, "questions"), asked(spark, sf_dir))
    return profiles.select("ministry", ev.ministry_text().alias("profile"))


@query("overlap_profile_text", PROFILES + "," + OVERLAP_CTE + " select mp_name, ministry, body as profile from ot")
def overlap_profile_text(spark, sf_dir):
    rows = stored_asked(spark, sf_dir)
    profiles = pr.overlap_profiles(rows, parts=pr.parts_of(rows))
    return profiles.select("mp_name", "ministry", ev.overlap_text().alias("profile"))


@query("question_list_text", PROFILES + f"""
select mp_name, lines || {NL} as questions from {recent_sql('asked', 'mp_name', 10)}""")
def question_list_text(spark, sf_dir):
    profiles = pr._fold_recent(pr.recent_questions(asked(spark, sf_dir), ["mp_name"]), ["mp_name"])
    return profiles.select("mp_name", ev.question_list_text(F.col("recent")).alias("questions"))


# Every member alone, every ministry alone, every member with the ministry of
# its own nation number, and a request without filters.
REQUESTS = """
select s_name as mp, cast(null as string) as ministry from supplier
union all select cast(null as string), n_name from nation
union all select s_name, n_name from supplier join nation on s_nationkey = n_nationkey
union all select cast(null as string), cast(null as string) from region"""


EVIDENCE_CTES = PROFILES + "," + text_ctes("", 10) + "," + text_ctes("5", 5) + "," + OVERLAP_CTE + f""",
requests as ({REQUESTS}),
packets as (select q.mp, q.ministry,
       nullif(concat_ws({NL} || {NL}, o.body,
                        case when q.ministry is null then m.body else m5.body end,
                        case when q.mp is null then d.body else d5.body end), '') as evidence
from requests q left join ot o on o.mp_name = q.mp and o.ministry = q.ministry
     left join mt m on m.mp_name = q.mp left join mt5 m5 on m5.mp_name = q.mp
     left join dt d on d.ministry = q.ministry left join dt5 d5 on d5.ministry = q.ministry)"""


def evidence_requests(spark, sf_dir):
    frames = {t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region")}
    sql = REQUESTS
    for t in frames:
        sql = sql.replace(f"from {t}", "from {" + t + "}").replace(f"join {t} ", "join {" + t + "} ")
    return spark.sql(sql, **frames)


@query("evidence_packets", EVIDENCE_CTES + " select mp, ministry, evidence from packets")
def evidence_packets(spark, sf_dir):
    return evidence_for(evidence_requests(spark, sf_dir), view(spark, sf_dir, "questions"), asked(spark, sf_dir))


@query("build_metadata", with_views("corpus", "registry") + "," + aliases_of_registry_sql() + "," + LATEST + f"""
select 'questions' as name, count(*) as rows from winners
union all select 'question_mps', count(*) from {MENTIONS.replace('SOURCE', 'winners')} x
union all select 'counted', count(*) from corpus""")
def build_metadata(spark, sf_dir):
    root = session.scratch_path(spark, "metadata")
    counts = metadata.build_metadata(view(spark, sf_dir, "corpus"), view(spark, sf_dir, "registry"), latest_first(), root)
    tables = [
        spark.read.parquet(f"{root}/{t}").agg(F.lit(t).alias("name"), F.count("*").alias("rows"))
        for t in ("questions", "question_mps")
    ]
    return tables[0].unionByName(tables[1]).unionByName(
        counts.select(F.lit("counted").alias("name"), F.col("questions").alias("rows")))
