"""Reading, cleaning, filtering and measuring documents; chunking and vectors."""

from pyspark.sql import functions as F

from corpusqa import session
from corpusqa.functions import text as tx
from corpusqa.functions import vectors as vec
from corpusqa.operators import chunking, embedding, reports
from corpusqa.operators import documents as docs
from corpusqa.operators import incremental as inc
from corpusqa.sources import readers, writers

from .registry import registry
from .views import NON_WS_RE, TERM_RE, collapse_sql, strip_sql, table, view, with_views

QUERIES, ORACLES, query = registry()

CORPUS_NAMES = {"doc_id": "id", "text": "full_text", "lang": "type", "source": "ministry"}


def corpus_of(spark, sf_dir, **options):
    return readers.read_corpus(spark, f"{sf_dir}/documents.parquet", rename=CORPUS_NAMES, **options)


# ---- reading -----------------------------------------------------------

@query("read_corpus", """
select cast(doc_id as varchar) as id, md5(text) as full_text, cast(null as int) as lok_no, lang as type,
       cast(null as varchar) as subject, source as ministry from documents""")
def read_corpus(spark, sf_dir):
    return corpus_of(spark, sf_dir).select("id", F.md5("full_text").alias("full_text"), "lok_no", "type", "subject", "ministry")


# The limit is the feature: the first documents in source order.
@query("first_documents", "select cast(doc_id as varchar) as id, lang as type from documents order by doc_id limit 100")
def first_documents(spark, sf_dir):
    return corpus_of(spark, sf_dir, limit=100).select("id", "type")


# ---- cleaning ----------------------------------------------------------

@query("drop_short_docs", f"select doc_id, lang from documents where length({strip_sql('text')}) >= 50")
def drop_short_docs(spark, sf_dir):
    return docs.drop_short_docs(table(spark, sf_dir, "documents"), "text").select("doc_id", "lang")


FLAT = ["lok_no", "session_no", "ques_no", "type", "date", "ministry", "members"]


def listed_corpus(spark, sf_dir):
    """The corpus with members as a list and session 7 missing."""
    return view(spark, sf_dir, "corpus").withColumns({
        "members": F.split("members", ","), "session_no": F.nullif("session_no", F.lit(7)),
    }).select(*FLAT)


@query("flatten_metadata", with_views("corpus") + """
select cast(lok_no as varchar) as lok_no, coalesce(cast(nullif(session_no, 7) as varchar), '') as session_no,
       cast(ques_no as varchar) as ques_no, type, date, ministry,
       array_to_string(string_split(members, ','), ', ') as members from corpus""")
def flatten_metadata(spark, sf_dir):
    return docs.flatten_metadata(listed_corpus(spark, sf_dir), FLAT)


@query("flatten_metadata_keep", with_views("corpus") + """
select lok_no, nullif(session_no, 7) as session_no, ques_no, type, date, ministry,
       array_to_string(string_split(members, ','), ', ') as members from corpus""")
def flatten_metadata_keep(spark, sf_dir):
    return docs.flatten_metadata(listed_corpus(spark, sf_dir), FLAT, nulls="keep", cast=False)


@query("with_qa_id", "select cast(doc_id as varchar) as qa_id, lang from documents")
def with_qa_id(spark, sf_dir):
    return docs.with_qa_id(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("clean_question_fields", with_views("corpus") + f"""
select ques_no, session_no, nullif({strip_sql('ministry')}, '') as ministry, nullif(subject, '') as subject from corpus""")
def clean_question_fields(spark, sf_dir):
    return docs.clean_question_fields(view(spark, sf_dir, "corpus")).select("ques_no", "session_no", "ministry", "subject")


@query("keyed_questions", with_views("corpus") + """
select session_no, type, count(*) as rows from corpus where session_no <> 7 group by session_no, type""")
def keyed_questions(spark, sf_dir):
    rows = docs.keyed_questions(listed_corpus(spark, sf_dir))
    return rows.groupBy("session_no", "type").agg(F.count("*").alias("rows"))


@query("explode_members", with_views("corpus") + f"""
select ques_no, session_no, mp from (
  select ques_no, session_no, {strip_sql('m')} as mp from (
    select ques_no, session_no, unnest(string_split(members, ',')) as m from corpus)) where mp <> ''""")
def explode_members(spark, sf_dir):
    return docs.explode_members(view(spark, sf_dir, "corpus")).select("ques_no", "session_no", "mp")


# ---- filters -----------------------------------------------------------

@query("members_filter", with_views("doc_chunks") + """
select qa_id, members from doc_chunks where contains(members, 'Member 1') or contains(members, 'Member 20')""")
def members_filter(spark, sf_dir):
    return view(spark, sf_dir, "doc_chunks").where(docs.members_filter(["Member 1", "Member 20"])).select("qa_id", "members")


@query("ministry_filter", with_views("doc_chunks") + " select qa_id, ministry from doc_chunks where ministry = 'src3'")
def ministry_filter(spark, sf_dir):
    return view(spark, sf_dir, "doc_chunks").where(docs.ministry_filter("src3")).select("qa_id", "ministry")


@query("metadata_filter", with_views("doc_chunks") + """
select 'both' as filter, qa_id from doc_chunks where contains(members, 'Member 1') and ministry = 'src3'
union all select 'member', qa_id from doc_chunks where contains(members, 'Member 1')
union all select 'none', qa_id from doc_chunks""")
def metadata_filter(spark, sf_dir):
    chunks = view(spark, sf_dir, "doc_chunks")
    cases = {"both": (["Member 1"], "src3"), "member": (["Member 1"], None), "none": (None, None)}
    parts = [
        chunks.where(docs.metadata_filter(*case)).select(F.lit(name).alias("filter"), "qa_id")
        for name, case in cases.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select_where", with_views("doc_chunks") + """
select qa_id, members, ministry from doc_chunks where contains(members, 'Member 5') and ministry = 'src1'""")
def select_where(spark, sf_dir):
    return docs.select_where(
        view(spark, sf_dir, "doc_chunks"), ["qa_id", "members", "ministry"], names=["Member 5"], ministry="src1")


# ---- text measures -----------------------------------------------------

@query("collapse_whitespace", f"select doc_id, md5({collapse_sql('text')}) as text from documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("text"))


@query("session_labels", with_views("questions") + """
select 'Lok ' || lok_no || ' Session ' || session_no as label, count(*) as questions from questions group by 1""")
def session_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "questions").select(tx.session_label().alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("questions"))


@query("passage_prefix", "select doc_id, md5('passage: ' || text) as text from documents")
def passage_prefix(spark, sf_dir):
    return docs.with_prefix(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text"))


@query("text_measures", f"""
select doc_id, length(text) as chars, len(regexp_extract_all(text, '{NON_WS_RE}+')) as words from documents""")
def text_measures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("chars"), tx.word_count(F.col("text")).cast("bigint").alias("words"))


SIZE_SQL = """case when kb >= 1048576 then printf('%.1f GB', kb / 1048576.0)
     when kb >= 1024 then printf('%.1f MB', kb / 1024.0) else printf('%d KB', kb) end"""


@query("collection_stats", with_views("doc_chunks") + f"""
select collection, chunks, has_sparse, bytes, {SIZE_SQL} as storage from (
  select *, bytes // 1024 as kb from (
    select type as collection, count(*) as chunks, type = 'en' as has_sparse,
           cast(count(*) * 1024 * 4 * 2.5 + case when type = 'en' then count(*) * 300 else 0 end + count(*) * 500 as bigint) as bytes
    from doc_chunks group by type))""")
def collection_stats(spark, sf_dir):
    chunks = view(spark, sf_dir, "doc_chunks").withColumnRenamed("type", "collection")
    return reports.collection_stats(chunks, has_sparse=F.col("collection") == "en")


@query("collection_total", with_views("doc_chunks") + f"""
select collections, chunks, bytes, {SIZE_SQL} as storage from (
  select count(*) as collections, cast(sum(n) as bigint) as chunks,
         cast(sum(n * 1024 * 4 * 2.5 + n * 500) as bigint) as bytes,
         cast(sum(n * 1024 * 4 * 2.5 + n * 500) as bigint) // 1024 as kb
  from (select type, count(*) as n from doc_chunks group by type))""")
def collection_total(spark, sf_dir):
    chunks = view(spark, sf_dir, "doc_chunks").withColumnRenamed("type", "collection")
    return reports.collection_total(reports.collection_stats(chunks))


# ---- chunking ----------------------------------------------------------

CHUNK_SQL = f"""
with recursive lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents),
tokens as (
  select doc_id, line_no, unnest(words) as token, generate_subscripts(words, 1) as pos
  from (select *, regexp_extract_all(line, '{NON_WS_RE}+') as words from lines)),
ended as (
  select *, coalesce(sum(case when right(token, 1) in ('.', '!', '?') then 1 else 0 end)
            over (partition by doc_id, line_no order by pos rows between unbounded preceding and 1 preceding), 0) as sentence
  from tokens),
numbered as (
  select *, (row_number() over (partition by doc_id, line_no, sentence order by pos) - 1) // 512 as cut from ended),
pieces as (
  select doc_id, line_no, sentence, cut, count(*) as n, string_agg(token, ' ' order by pos) as piece
  from numbered group by all),
docs as (
  select doc_id, list(piece order by line_no, sentence, cut) as pieces,
         list(cum order by line_no, sentence, cut) as cums
  from (select *, cast(sum(n) over (partition by doc_id order by line_no, sentence, cut) as bigint) as cum from pieces)
  group by doc_id),
walk as (
  select doc_id, 0 as i, 1 as s, 0 as chunk_no from docs
  union all
  select w.doc_id, i + 1,
         case when cums[i + 1] - coalesce(cums[s - 1], 0) <= 512 then s
              else cast(list_filter(range(s, i + 2), lambda j:
                     coalesce(cums[i], 0) - coalesce(cums[j - 1], 0) <= least(64, 512 - (cums[i + 1] - coalesce(cums[i], 0))))[1] as int) end,
         chunk_no + case when cums[i + 1] - coalesce(cums[s - 1], 0) <= 512 then 0 else 1 end
  from walk w join docs using (doc_id) where i < len(cums)),
spans as (
  select doc_id, chunk_no, max(s) as s, max(i) as e from walk where i > 0 group by doc_id, chunk_no)
select doc_id || '#' || chunk_no as chunk_id, chunk_no, md5(array_to_string(pieces[s:e], ' ')) as text,
       cums[e] - coalesce(cums[s - 1], 0) as n_tokens,
       coalesce(cums[lag(e) over (partition by doc_id order by chunk_no)] - coalesce(cums[s - 1], 0), 0) as n_repeated
from spans join docs using (doc_id)"""


def chunked(spark, sf_dir):
    rows = docs.with_qa_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return chunking.chunk_documents(rows, counts=True)


@query("chunk_documents", CHUNK_SQL)
def chunk_documents(spark, sf_dir):
    return chunked(spark, sf_dir).select(
        "chunk_id", "chunk_no", F.md5("text").alias("text"),
        F.col("n_tokens").cast("bigint"), F.col("n_repeated").cast("bigint"))


@query("chunk_table_roundtrip", CHUNK_SQL.replace("select doc_id || '#'", "select cast(n_tokens as bigint) as n_tokens, chunk_id from (select doc_id || '#'") + ")")
def chunk_table_roundtrip(spark, sf_dir):
    path = session.scratch_path(spark, "chunks")
    writers.write_chunks(chunked(spark, sf_dir), path)
    return spark.read.parquet(path).select("chunk_id", F.col("n_tokens").cast("bigint"))


# ---- vectors -----------------------------------------------------------

@query("unit_vectors", """
select vec_id, pos, round(cast(cast(x / nullif(length, 0) as float) as double), 6) as value from (
  select vec_id, length, unnest(scaled) as x, generate_subscripts(scaled, 1) - 1 as pos from (
    select vec_id, scaled, sqrt(list_sum(list_transform(scaled, lambda x: cast(x as double) * x))) as length from (
      select vec_id, list_transform(embedding, lambda x: cast(x * (label + 1) as float)) as scaled from embeddings)))""")
def unit_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scaled = rows.withColumn("embedding", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")))
    out = scaled.select("vec_id", F.posexplode(vec.unit("embedding")).alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("bigint"), F.round(F.col("value").cast("double"), 6).alias("value"))


HASH_DIM = 64


def hashed_sql(source, id_col, text):
    """Feature-hashed unit vectors of a text expression, as `(id, embedding)`."""
    return f"""(select {id_col}, list(value order by bucket) as embedding from (
      select {id_col}, bucket, cast(v / sqrt(sum(v * v) over (partition by {id_col})) as float) as value from (
        select {id_col}, bucket, sum(v) as v from (
          select {id_col}, cast(('0x' || substr(md5(term), 1, 8)) as bigint) % {HASH_DIM} as bucket,
                 case when cast(('0x' || substr(md5(term), 9, 1)) as bigint) % 2 = 0 then 1.0::double else -1.0::double end as v
          from (select {id_col}, unnest(regexp_extract_all(lower({text}), '{TERM_RE}')) as term from {source})
          union all
          select {id_col}, unnest(range(0, {HASH_DIM})), 0.0::double from {source})
        group by all)) group by {id_col})"""


def hashed_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("chunk_id"), "text")
    return embedding.embed(rows, embedding.hashing_model(HASH_DIM))


@query("hashed_embedding", f"""
select chunk_id, pos, round(cast(value as double), 6) as value from (
  select 'D' || doc_id as chunk_id, unnest(embedding) as value, generate_subscripts(embedding, 1) - 1 as pos
  from {hashed_sql('documents', 'doc_id', "'passage: ' || text")})""")
def hashed_embedding(spark, sf_dir):
    out = hashed_documents(spark, sf_dir).select("chunk_id", F.posexplode("embedding").alias("pos", "value"))
    return out.select("chunk_id", F.col("pos").cast("bigint"), F.round(F.col("value").cast("double"), 6).alias("value"))


# ---- incremental work --------------------------------------------------

def halves(spark, sf_dir):
    """Chunks, and the vectors that exist for some of them."""
    chunks = view(spark, sf_dir, "doc_chunks")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), "vec_id").alias("chunk_id"), F.concat(F.lit("D"), "vec_id").alias("qa_id"), "embedding")
    return chunks, vectors


@query("pending_chunks", "select 'D' || doc_id as chunk_id, lang as type from documents where doc_id not in (select vec_id from embeddings)")
def pending_chunks(spark, sf_dir):
    return inc.pending_chunks(*halves(spark, sf_dir)).select("chunk_id", "type")


# Each document counts as two chunks here, of which the first is indexed.
@query("unindexed_chunks", """
select granularity, 'D' || doc_id || '#' || part as chunk_id from (
  select 'chunk' as granularity, doc_id, part from documents d, (select 0 as part union all select 1) p
  where part = 1 or doc_id not in (select vec_id from embeddings)
  union all select 'document', doc_id, part from documents d, (select 0 as part union all select 1) p
  where doc_id not in (select vec_id from embeddings))""")
def unindexed_chunks(spark, sf_dir):
    chunks, vectors = halves(spark, sf_dir)
    parts = chunks.select("qa_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    parts = parts.withColumn("chunk_id", F.concat("qa_id", F.lit("#"), F.col("part").cast("string")))
    indexed = vectors.select("qa_id", F.concat("qa_id", F.lit("#0")).alias("chunk_id"))
    left = [
        inc.unindexed_chunks(parts, indexed, granularity=g).select(F.lit(g).alias("granularity"), "chunk_id")
        for g in ("chunk", "document")
    ]
    return left[0].unionByName(left[1])


@query("with_embeddings", """
select 'D' || doc_id as chunk_id, lang as type, len(embedding) as dim, round(cast(embedding[1] as double), 6) as first
from documents join embeddings on doc_id = vec_id""")
def with_embeddings(spark, sf_dir):
    rows = inc.with_embeddings(*halves(spark, sf_dir))
    return rows.select("chunk_id", "type", F.size("embedding").cast("bigint").alias("dim"),
                       F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("run_counts", """
select count(*) as total, count(vec_id) as skipped, count(*) - count(vec_id) as new
from documents left join embeddings on doc_id = vec_id""")
def run_counts(spark, sf_dir):
    return inc.run_counts(*halves(spark, sf_dir))


# ---- extraction reports ------------------------------------------------

EXTRACTED = f"""extracted as (
  select source as engine, cast(doc_id as varchar) as stem, length(text) / 1000.0::double as time_sec,
         doc_id % 7 + 0.5::double as mem, length(text) as char_count, case when text = '' then '(empty)' else substring(text, 1, 300) end as preview,
         len(regexp_extract_all(text, '{NON_WS_RE}+')) as word_count, lang = 'de' as failed from documents)"""


def extractions(spark, sf_dir):
    """Stand-in measurements: engine by source, German documents count as failed."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("engine"), F.col("doc_id").cast("string").alias("stem"),
        (F.length("text") / 1000.0).alias("time_sec"), (F.col("doc_id") % 7 + 0.5).alias("mem_peak_delta_mb"),
        "text", F.when(F.col("lang") == "de", "ParseError: unreadable").alias("error"))


@query("extraction_rows", "with " + EXTRACTED + """
select engine, stem, char_count, word_count, char_count < 50 as is_empty, preview,
       case when failed then 'ParseError: unreadable' end as error from extracted""")
def extraction_rows(spark, sf_dir):
    rows = reports.extraction_rows(extractions(spark, sf_dir))
    return rows.select("engine", "stem", F.col("char_count").cast("bigint"), F.col("word_count").cast("bigint"), "is_empty", "preview", "error")


@query("engine_totals", "with " + EXTRACTED + """
select engine, count(*) as runs, round(sum(time_sec), 6) as total_time, round(avg(time_sec), 6) as avg_time,
       cast(sum(char_count) as bigint) as chars, round(avg(mem), 6) as avg_mem,
       count(*) filter (where char_count < 50) as empty
from extracted where not failed group by engine""")
def engine_totals(spark, sf_dir):
    totals = reports.engine_totals(reports.extraction_rows(extractions(spark, sf_dir)))
    return totals.withColumns({c: F.round(c, 6) for c in ("total_time", "avg_time", "avg_mem")})


@query("compare_existing", "with " + EXTRACTED + """
select engine, stem, existing_chars, char_count, char_count - existing_chars as diff,
       case when char_count > existing_chars then '+' else '' end || (char_count - existing_chars) as diff_text
from extracted join (select cast(doc_id as varchar) as stem, n_chars + 5 - 10 * quality as existing_chars
                     from labels join documents using (doc_id)) using (stem)""")
def compare_existing(spark, sf_dir):
    existing = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("stem"), (F.col("n_chars") + 5 - 10 * F.col("quality")).alias("existing_chars"))
    rows = reports.extraction_rows(extractions(spark, sf_dir)).withColumn("char_count", F.col("char_count").cast("bigint"))
    return reports.compare_existing(rows, existing)
