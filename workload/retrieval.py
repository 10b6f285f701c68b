"""Dense, lexical, hybrid and approximate search; reranking, prompts, evaluation, ingestion."""

from pyspark.sql import functions as F

from corpusqa import session
from corpusqa.operators import approximate as ann
from corpusqa.operators import dense, embedding, hybrid, lexical, prompts, topk
from corpusqa.operators import evaluation as ev
from corpusqa.operators import rerank as rr
from corpusqa.operators.evidence import source_rows as display_rows
from corpusqa.plans import ask as ask_plan
from corpusqa.plans import bucketed, ingest, retrieve
from corpusqa.sources import readers, writers
from corpusqa.streaming import ingest as streaming

from .registry import registry
from .relational import EVIDENCE_CTES, asked, evidence_requests
from .texts import CHUNK_SQL, CORPUS_NAMES, HASH_DIM, corpus_of, hashed_documents, hashed_sql
from .views import TERM_RE, collapse_sql, strip_sql, table, view, with_views

QUERIES, ORACLES, query = registry()

MODEL = embedding.hashing_model(HASH_DIM)


# ---- inputs ------------------------------------------------------------

def label_means(spark, sf_dir):
    """One query per label: the mean of its vectors."""
    points = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = points.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("embedding"))


MEANS_SQL = """means as (select label as query_id, list(m order by pos) as embedding from (
  select label, pos, avg(cast(x as double)) as m from (
    select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)
  group by label, pos) group by label)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_chunks(spark, sf_dir):
    """Vectors with the metadata of the document of the same id."""
    chunks = view(spark, sf_dir, "doc_chunks").drop("chunk_id")
    return vectors(spark, sf_dir).join(chunks, F.col("chunk_id") == F.col("doc_id")).drop("doc_id")


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def hashed_collection(spark, sf_dir):
    """The vector collection of all documents, stored as the index step stores it."""
    chunks = doc_chunks(spark, sf_dir)
    return session.write_and_read(embedding.embed(chunks, MODEL, keep=chunks.columns), "collection")


def doc_chunks(spark, sf_dir):
    return view(spark, sf_dir, "doc_chunks").drop("doc_id")


RANKED = """select query_id, chunk_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {source}) where rank <= {k}"""


def ranked(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


# ---- dense -------------------------------------------------------------

DENSE_SQL = f"""with {MEANS_SQL}, scored as (
  select query_id, vec_id as chunk_id, round(list_inner_product(m.embedding, cast(e.embedding as double[])), 9) as score
  from means m, embeddings e)
""" + RANKED.format(source="scored", k=10)


@query("dense_topk", DENSE_SQL)
def dense_topk(spark, sf_dir):
    return ranked(dense.dense_topk(vectors(spark, sf_dir), label_means(spark, sf_dir)))


# Labels up to 5 ask for a member, 4 to 8 for a ministry, 9 for neither.
@query("dense_topk_filtered", with_views("doc_chunks") + f""", {MEANS_SQL}, scored as (
  select query_id, vec_id as chunk_id, round(list_inner_product(m.embedding, cast(e.embedding as double[])), 9) as score
  from means m, embeddings e join doc_chunks d on vec_id = doc_id
  where (query_id > 5 or contains(members, 'Member ' || query_id))
    and (query_id < 4 or query_id > 8 or ministry = 'src' || query_id))
""" + RANKED.format(source="scored", k=10))
def dense_topk_filtered(spark, sf_dir):
    queries = label_means(spark, sf_dir).withColumns({
        "names": F.when(F.col("query_id") <= 5, F.array(F.concat(F.lit("Member "), "query_id"))),
        "ministry": F.when(F.col("query_id").between(4, 8), F.concat(F.lit("src"), "query_id")),
    })
    return ranked(dense.dense_topk(vector_chunks(spark, sf_dir), queries))


HASHED_D = hashed_sql("documents", "doc_id", "'passage: ' || text")
HASHED_Q = hashed_sql("benchmark", "item_id", "'query: ' || text")
HASHED = f"""hd as materialized (select doc_id, cast(embedding as double[]) as embedding from {HASHED_D}),
hq as materialized (select item_id, cast(embedding as double[]) as embedding from {HASHED_Q})"""


@query("dense_topk_text", f"""with {HASHED}, scored as (
  select item_id as query_id, 'D' || doc_id as chunk_id, round(list_inner_product(hq.embedding, hd.embedding), 9) as score
  from hq, hd)
""" + RANKED.format(source="scored", k=10))
def dense_topk_text(spark, sf_dir):
    queries = embedding.embed_queries(passages(spark, sf_dir), MODEL)
    return ranked(dense.dense_topk(hashed_documents(spark, sf_dir), queries))


@query("ivf_topk_full_probe", DENSE_SQL)
def ivf_topk_full_probe(spark, sf_dir):
    index = ann.build_ivf(vectors(spark, sf_dir), 16)
    index = ann.write_ivf(index, session.scratch_path(spark, "ivf"))
    return ranked(ann.ivf_topk(index, label_means(spark, sf_dir), nprobe=16))


# Cells around the label means: centroids that both engines can compute. A query
# without ten matches reads twice as many cells.
CELLS_SQL = f"""{MEANS_SQL},
centres as (select query_id as cell, cast(embedding as float[]) as centre from means),
celled as (select vec_id, embedding, arg_min(cell, (d, cell)) as cell from (
  select vec_id, embedding, cell, round(list_sum(list_transform(list_zip(cast(embedding as double[]), cast(centre as double[])), lambda p: (p[1] - p[2]) ** 2)), 9) as d
  from embeddings, centres) group by all),
probes as (select query_id, cell, row_number() over (partition by query_id order by d, cell) as place from (
  select query_id, cell, round(list_sum(list_transform(list_zip(cast(embedding as double[]), cast(centre as double[])), lambda p: (p[1] - p[2]) ** 2)), 9) as d
  from queries, centres)),
scored as (select q.query_id, vec_id as chunk_id, place, round(list_inner_product(q.embedding, cast(e.embedding as double[])), 9) as score
  from queries q join probes p using (query_id) join celled e using (cell) WHERE),
rounds as (select query_id, n, count(*) filter (place <= n) as matches from scored, (values (3), (6), (12)) r(n) group by all),
width as (select query_id, coalesce(min(n) filter (matches >= 10), 12) as n from rounds group by query_id),
probed as (select s.* from scored s join width using (query_id) where place <= n)
""" + RANKED.format(source="probed", k=10)


def celled_index(chunks, spark, sf_dir):
    """The collection stored by cell, with the label means as centroids."""
    centroids = label_means(spark, sf_dir).select(
        F.col("query_id").cast("int").alias("cell"), F.col("embedding").cast("array<float>").alias("embedding"))
    index = ann.IvfIndex(ann.assign_cells(chunks, centroids), centroids)
    return ann.write_ivf(index, session.scratch_path(spark, "ivf"))


def mixed_means(spark, sf_dir):
    """Queries between the cells: sums of the mean of a label and half the next one's."""
    means = label_means(spark, sf_dir)
    after = means.select((F.col("query_id") - 1).alias("query_id"), F.col("embedding").alias("next"))
    mixed = F.zip_with("embedding", "next", lambda a, b: a + b / 2)
    return means.join(after, "query_id").select("query_id", mixed.alias("embedding"))


MIXED_SQL = """queries as (select a.query_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] + p[2] / 2) as embedding
  from means a join means b on b.query_id = a.query_id + 1)"""


def cells_sql(where, views=""):
    return f"with {views}" + CELLS_SQL.replace(MEANS_SQL, f"{MEANS_SQL}, {MIXED_SQL}").replace("WHERE", where)


@query("ivf_topk", cells_sql(""))
def ivf_topk(spark, sf_dir):
    index = celled_index(vectors(spark, sf_dir), spark, sf_dir)
    return ranked(ann.ivf_topk(index, mixed_means(spark, sf_dir), nprobe=3))


# Ministries are spread over all cells: three cells rarely hold ten of one.
@query("ivf_topk_filtered", cells_sql(
    "join doc_chunks d on e.vec_id = d.doc_id where d.ministry = 'src' || q.query_id", with_views("doc_chunks").removeprefix("with ") + ", "))
def ivf_topk_filtered(spark, sf_dir):
    index = celled_index(vector_chunks(spark, sf_dir), spark, sf_dir)
    queries = mixed_means(spark, sf_dir).withColumn("ministry", F.concat(F.lit("src"), "query_id"))
    return ranked(ann.ivf_topk(index, queries, nprobe=3))


# More queries than one block holds: every vector asks for its neighbours.
@query("dense_topk_many", """with scored as (
  select q.vec_id as query_id, e.vec_id as chunk_id,
         round(list_inner_product(cast(q.embedding as double[]), cast(e.embedding as double[])), 9) as score from embeddings q, embeddings e)
select query_id, chunk_id, rank from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored) where rank <= 10""")
def dense_topk_many(spark, sf_dir):
    queries = vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id")
    return ranked(dense.dense_topk(vectors(spark, sf_dir), queries, block=400)).drop("score")


# Each passage asks twice under one id, and once without an id.
@query("embed_repeated_ids", f"""with {HASHED}, asked as (
  select item_id as query_id, item_id from hq union all select item_id, item_id from hq union all select null, item_id from hq)
select query_id, count(*) as n, round(sum(embedding[1] + 2 * embedding[2]), 4) as checksum from asked join hq using (item_id) group by query_id""")
def embed_repeated_ids(spark, sf_dir):
    rows = passages(spark, sf_dir)
    asked_rows = rows.unionByName(rows).unionByName(rows.withColumn("query_id", F.lit(None).cast("bigint")))
    made = embedding.embed_queries(asked_rows, MODEL)
    checksum = F.col("embedding")[0].cast("double") + 2 * F.col("embedding")[1].cast("double")
    return made.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum(checksum), 4).alias("checksum"))


# Two runs of the steps, the first over the documents that have a given vector, the second over all.
@query("step_counts", """with n as (select count(*) as total, count(vec_id) as known from documents left join embeddings on doc_id = vec_id)
select run, step, case when run = 1 then known else total end as total, case when run = 1 then known else total - known end as new,
       case when run = 1 then 0 else known end as skipped
from n, (select unnest([1, 2]) as run), (select unnest(['embed', 'index']) as step)""")
def step_counts(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    known = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("D"), F.col("vec_id")).alias("chunk_id"))
    vectors, collection, rows = session.scratch_path(spark, "vectors"), session.scratch_path(spark, "collection"), []
    for run, part in enumerate((chunks.join(known, "chunk_id", "left_semi"), chunks), 1):
        counts = {"embed": ingest.Counts(), "index": ingest.Counts()}
        made = ingest.embed_step(part, vectors, MODEL, counts=counts["embed"])
        ingest.index_step(part, made, collection, counts=counts["index"])
        rows += [(run, step, c["total"], c["new"], c["skipped"]) for step, c in counts.items()]
    return spark.createDataFrame(rows, "run int, step string, total long, new long, skipped long")


# ---- lexical and hybrid ------------------------------------------------

def bm25_ctes(queries, where="true"):
    """CTEs that score `queries(query_id, query, ...)` against all documents as `bm25`."""
    return f"""
words as (select doc_id, regexp_extract_all(lower(text), '{TERM_RE}') as w from documents),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by all),
dl as (select doc_id, len(w) as dl from words),
stats as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
qt as (select distinct query_id, unnest(regexp_extract_all(lower(query), '{TERM_RE}')) as term from {queries}),
bm25 as materialized (
  select query_id, 'D' || doc_id as chunk_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 9) as score
  from qt join tf using (term) join df using (term) join dl using (doc_id) join {queries} q using (query_id)
       join doc_chunks d using (doc_id), stats
  where {where} group by 1, 2)"""


PASSAGES_SQL = "passages as (select item_id as query_id, text as query from benchmark)"
BM25_SQL = with_views("doc_chunks") + "," + PASSAGES_SQL + "," + bm25_ctes("passages") + "\n" + RANKED.format(source="bm25", k=10)


@query("bm25_topk", BM25_SQL)
def bm25_topk(spark, sf_dir):
    return ranked(lexical.bm25_topk(lexical.bm25_scan(doc_chunks(spark, sf_dir)), passages(spark, sf_dir)))


@query("bm25_stored_index_topk", BM25_SQL)
def bm25_stored_index_topk(spark, sf_dir):
    index = lexical.bm25_index(doc_chunks(spark, sf_dir)).write(session.scratch_path(spark, "bm25"))
    return ranked(lexical.bm25_topk(index, passages(spark, sf_dir)))


def filtered_passages(spark, sf_dir):
    """Long passages ask for a member, short ones for a ministry, some for both."""
    return passages(spark, sf_dir).withColumns({
        "names": F.when(F.length("query") > 200, F.array(
            F.concat(F.lit("Member "), F.col("query_id") % 37), F.concat(F.lit("Shri Member "), F.col("query_id") % 37))),
        "ministry": F.when(F.length("query") < 260, F.concat(F.lit("src"), F.col("query_id") % 20)),
    })


PASSES = """(length(q.query) <= 200 or contains(members, 'Member ' || q.query_id % 37))
    and (length(q.query) >= 260 or ministry = 'src' || q.query_id % 20)"""


@query("bm25_topk_filtered", with_views("doc_chunks") + "," + PASSAGES_SQL + "," + bm25_ctes("passages", PASSES)
       + "\n" + RANKED.format(source="bm25", k=10))
def bm25_topk_filtered(spark, sf_dir):
    return ranked(lexical.bm25_topk(lexical.bm25_scan(doc_chunks(spark, sf_dir)), filtered_passages(spark, sf_dir)))


def hybrid_ctes(where):
    return f"""
dense as (select q.query_id, 'D' || hd.doc_id as chunk_id, round(list_inner_product(hq.embedding, hd.embedding), 9) as score
          from passages q join hq on item_id = q.query_id, hd join doc_chunks d using (doc_id) where {where}),
legs as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense
         union all
         select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25),
fused as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as score from legs where rank <= 10 group by 1, 2)"""


HYBRID_SQL = (
    with_views("doc_chunks") + "," + PASSAGES_SQL + "," + HASHED + "," + bm25_ctes("passages", PASSES) + "," + hybrid_ctes(PASSES)
)


@query("hybrid_topk", HYBRID_SQL + "\n" + RANKED.format(source="fused", k=10))
def hybrid_topk(spark, sf_dir):
    queries = embedding.embed_queries(filtered_passages(spark, sf_dir), MODEL)
    scan = lexical.bm25_scan(doc_chunks(spark, sf_dir))
    return ranked(hybrid.hybrid_topk(hashed_collection(spark, sf_dir), scan, queries))


# ---- retrieval in one call ---------------------------------------------

def member_aliases(spark, sf_dir):
    """Every member of the documents under its canonical name."""
    names = doc_chunks(spark, sf_dir).select(F.explode(F.split("members", ", ")).alias("name")).distinct()
    canonical = F.concat(F.lit("Shri "), "name")
    return names.select(canonical.alias("canonical"), F.array(F.col("name"), canonical).alias("aliases"))


def requests(spark, sf_dir):
    return passages(spark, sf_dir).withColumns({
        "mp": F.when(F.length("query") > 200, F.concat(F.lit("Shri Member "), F.col("query_id") % 37)),
        "ministry": F.when(F.length("query") < 260, F.concat(F.lit("src"), F.col("query_id") % 20)),
    })


DENSE_TEXT_SQL = with_views("doc_chunks") + "," + PASSAGES_SQL + "," + HASHED + f""",
dense as (select q.query_id, 'D' || hd.doc_id as chunk_id, round(list_inner_product(hq.embedding, hd.embedding), 9) as score
          from passages q join hq on item_id = q.query_id, hd join doc_chunks d using (doc_id) where {PASSES})"""


@query("retrieve_dense", DENSE_TEXT_SQL + f"""
select query_id, rank, chunk_id, ministry, members, md5(text) as text, round(score, 6) as score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense)
join doc_chunks using (chunk_id) where rank <= 10""")
def retrieve_dense(spark, sf_dir):
    found = retrieve.retrieve(
        requests(spark, sf_dir), hashed_collection(spark, sf_dir), MODEL, aliases=member_aliases(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("bigint"), "chunk_id", "ministry", "members",
                        F.md5("text").alias("text"), F.round("score", 6).alias("score"))


@query("retrieve_hybrid", HYBRID_SQL + f"""
select query_id, rank, chunk_id, ministry, round(score, 6) as score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused)
join doc_chunks using (chunk_id) where rank <= 10""")
def retrieve_hybrid(spark, sf_dir):
    found = retrieve.retrieve(
        requests(spark, sf_dir), hashed_collection(spark, sf_dir), MODEL, aliases=member_aliases(spark, sf_dir),
        mode="hybrid", lexical=lexical.bm25_scan(doc_chunks(spark, sf_dir)))
    return found.select("query_id", F.col("rank").cast("bigint"), "chunk_id", "ministry", F.round("score", 6).alias("score"))


# ---- reranking, sources, prompts, answers ------------------------------

TOP_BM25 = with_views("doc_chunks") + "," + PASSAGES_SQL + "," + bm25_ctes("passages") + """,
top as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25),
found as (select t.query_id, t.rank, t.score, p.query, d.* from top t join doc_chunks d using (chunk_id)
          join passages p using (query_id) where rank <= 10)"""


def rerank_ctes(source):
    return f""",
covered as (select * exclude (score, rank),
    round(len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{TERM_RE}')), list_distinct(regexp_extract_all(lower(text), '{TERM_RE}'))))
          / len(list_distinct(regexp_extract_all(lower(query), '{TERM_RE}'))), 9) as score from {source}),
kept as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from covered) where rank <= 4)"""


def bm25_candidates(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    queries = passages(spark, sf_dir)
    top = retrieve.search(queries, None, mode="lexical", lexical=lexical.bm25_scan(chunks))
    return topk.attach_chunks(top, chunks).join(queries, "query_id")


@query("source_rows", TOP_BM25 + f"""
select query_id, rank, qa_id, printf('%.3f', score) as score_text, ministry, subject,
       {strip_sql('substring(text, 1, 200)')} || '...' as excerpt from found""")
def source_rows(spark, sf_dir):
    return display_rows(bm25_candidates(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query("rerank", TOP_BM25 + rerank_ctes("found") + " select query_id, chunk_id, rank, round(score, 6) as score from kept")
def rerank(spark, sf_dir):
    return ranked(rr.rerank(bm25_candidates(spark, sf_dir)))


# The two templates with the context and the query in place.
CONTEXT = "string_agg(text, chr(10) || chr(10) order by rank) as context"
HEAD = "'Context information is below.' || chr(10) || '---------------------' || chr(10) || context || chr(10) || '---------------------' || chr(10)"
PLAIN = HEAD + " || 'Given the context information and not prior knowledge, answer the query.' || chr(10) || 'Query: ' || query || chr(10) || 'Answer:'"
FULL = HEAD + """ || chr(10) || 'The following aggregate statistics from the parliamentary database are also available to help you give a comprehensive answer.'
 || chr(10) || '---------------------' || chr(10) || evidence || chr(10) || '---------------------' || chr(10)
 || 'Given the context information, statistics, and not prior knowledge, answer the query.' || chr(10) || 'Query: ' || query || chr(10) || 'Answer:'"""


@query("build_prompts", TOP_BM25 + rerank_ctes("found") + f""",
filled as (select query_id, any_value(query) as query, {CONTEXT},
                  case when any_value(length(query)) > 200 then 'Statistics for ' || query_id end as evidence
           from kept group by query_id)
select query_id, md5(case when evidence is null then {PLAIN} else {FULL} end) as prompt from filled""")
def build_prompts(spark, sf_dir):
    queries = passages(spark, sf_dir).withColumn(
        "evidence", F.when(F.length("query") > 200, F.concat(F.lit("Statistics for "), "query_id")))
    built = prompts.build_prompts(queries, rr.rerank(bm25_candidates(spark, sf_dir)))
    return built.select("query_id", F.md5("prompt").alias("prompt"))


@query("ask", DENSE_TEXT_SQL + """,
found as (select t.query_id, t.rank, t.score, p.query, d.* from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense) t
  join doc_chunks d using (chunk_id) join passages p using (query_id) where rank <= 10)""" + rerank_ctes("found") + f""",
filled as (select p.query_id, any_value(p.query) as query, coalesce(string_agg(text, chr(10) || chr(10) order by rank), '') as context,
                  string_agg(qa_id, '|' order by rank) as sources
           from passages p left join kept k on k.query_id = p.query_id group by p.query_id)
select query_id, md5({PLAIN}) as answer, sources from filled""")
def ask(spark, sf_dir):
    answers = ask_plan.ask(
        requests(spark, sf_dir), hashed_collection(spark, sf_dir), MODEL, aliases=member_aliases(spark, sf_dir))
    ids = F.array_join(F.transform("sources", lambda s: s["qa_id"]), "|")
    return answers.select("query_id", F.md5("answer").alias("answer"), ids.alias("sources"))


@query("ask_with_evidence", EVIDENCE_CTES + f""",
filled as (select concat_ws('|', coalesce(mp, ''), coalesce(ministry, '')) as query_id, 'Questions of ' || coalesce(mp, 'all') as query,
                  '' as context, evidence from packets where mp is not null or ministry is not null)
select query_id, md5(case when evidence is null then {PLAIN} else {FULL} end) as answer from filled""")
def ask_with_evidence(spark, sf_dir):
    """Requests that name members and ministries of the question tables; no document has these, so statistics stand alone."""
    named = evidence_requests(spark, sf_dir).where("mp is not null or ministry is not null").select(
        F.concat_ws("|", F.coalesce("mp", F.lit("")), F.coalesce("ministry", F.lit(""))).alias("query_id"),
        F.concat(F.lit("Questions of "), F.coalesce("mp", F.lit("all"))).alias("query"), "mp", "ministry")
    none = member_aliases(spark, sf_dir).where("false")
    answers = ask_plan.ask(
        named, hashed_collection(spark, sf_dir), MODEL, aliases=none, tables=(view(spark, sf_dir, "questions"), asked(spark, sf_dir)))
    return answers.select("query_id", F.md5("answer").alias("answer"))


# ---- evaluation --------------------------------------------------------

def cases(spark, sf_dir):
    """Benchmark passages as test cases with expectations on member, ministry or text."""
    rows = requests(spark, sf_dir).withColumn("id", F.concat(F.lit("b"), "query_id"))
    plain = F.when(F.col("mp").isNotNull(), F.array(F.concat(F.lit("Member "), F.col("query_id") % 37)))
    return rows.select(
        "id", "query", F.when(F.col("mp").isNull(), "topic").otherwise("member").alias("category"), "mp", "ministry",
        F.struct(
            plain.alias("members_contains_any"), F.col("ministry").alias("ministry_eq"),
            F.when(F.col("mp").isNull(), F.array("query")).alias("text_contains_any"),
        ).alias("expected"), F.lit("").alias("notes"))


@query("effective_expected", """
select 'b' || item_id as id,
       case when length(text) > 200 then 'Member ' || item_id % 37 || '|Shri Member ' || item_id % 37 end as members
from benchmark""")
def effective_expected(spark, sf_dir):
    resolved = ev.effective_expected(cases(spark, sf_dir), member_aliases(spark, sf_dir))
    return resolved.select("id", F.array_join("expected.members_contains_any", "|").alias("members"))


EVAL = with_views("doc_chunks") + "," + PASSAGES_SQL + "," + HASHED + f""",
requests as (
  select 'unfiltered:b' || query_id as query_id, query_id as item, 'unfiltered' as mode, query, null as mp, null as wanted from passages
  union all
  select 'filtered:b' || query_id, query_id, 'filtered', query,
         case when length(query) > 200 then 'Member ' || query_id % 37 end,
         case when length(query) < 260 then 'src' || query_id % 20 end from passages),
dense as (select q.query_id, 'D' || hd.doc_id as chunk_id, round(list_inner_product(hq.embedding, hd.embedding), 9) as score
          from requests q join hq on item_id = item, hd join doc_chunks d using (doc_id)
          where (mp is null or contains(members, mp)) and (wanted is null or ministry = wanted)),
LEGS
judged as (
  select f.query_id, r.item, r.mode, f.rank, d.qa_id, d.members, d.ministry, d.subject,
    length(r.query) <= 200 or contains(lower(members), lower('Member ' || r.item % 37)) as member_ok,
    length(r.query) >= 260 or ministry = 'src' || r.item % 20 as ministry_ok,
    length(r.query) > 200 or contains(lower({collapse_sql("d.text || ' ' || d.subject")}), lower(r.query)) as text_ok
  from found f join requests r using (query_id) join doc_chunks d using (chunk_id)),
scores as (
  select r.query_id, 'b' || r.item as test_id, r.mode, case when length(r.query) > 200 then 'member' else 'topic' end as category,
    coalesce(avg(case when member_ok and ministry_ok and text_ok then 1.0 else 0.0 end) filter (where j.query_id is not null), 0) as p,
    coalesce(bool_or(member_ok and ministry_ok and text_ok and rank = 1), false) as h1,
    coalesce(bool_or(member_ok and ministry_ok and text_ok), false) as hk,
    count(distinct qa_id) as docs, count(j.query_id) as k
  from requests r left join judged j on j.query_id = r.query_id group by all)"""
DENSE_FOUND = """found as (select * from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense) where rank <= 10),"""
EVAL_DENSE = EVAL.replace("LEGS", DENSE_FOUND)


def evaluated(spark, sf_dir, collection=None, **options):
    collection = hashed_collection(spark, sf_dir) if collection is None else collection
    return retrieve.run_eval(cases(spark, sf_dir), collection, MODEL, aliases=member_aliases(spark, sf_dir), **options)


@query("eval_scores", EVAL_DENSE + """
select query_id, test_id, mode, category, round(p, 6) as precision_at_k, h1 as hit_at_1, hk as hit_at_k,
       docs as unique_docs, k from scores""")
def eval_scores(spark, sf_dir):
    scores, _ = evaluated(spark, sf_dir)
    return scores.drop("query").withColumn("precision_at_k", F.round("precision_at_k", 6))


@query("eval_summary", EVAL_DENSE + """
select mode, count(*) as count, round(avg(p), 6) as avg_precision_at_k, round(avg(cast(h1 as int)), 6) as avg_hit_at_1,
       round(avg(cast(hk as int)), 6) as avg_hit_at_k, round(avg(docs), 6) as avg_unique_docs from scores group by mode""")
def eval_summary(spark, sf_dir):
    summary = ev.summary_by_mode(evaluated(spark, sf_dir)[0])
    return summary.select("mode", "count", *[F.round(c, 6).alias(c) for c in summary.columns[2:]])


@query("eval_report", EVAL_DENSE + """
select test_id, category, mode, printf('%.2f', p) as p_at_k, case when h1 then 'Y' else 'N' end as hit_1,
       case when hk then 'Y' else 'N' end as hit_k, docs from scores""")
def eval_report(spark, sf_dir):
    return ev.report_rows(evaluated(spark, sf_dir)[0])


# Scores of eighths and sixteenths, where rounding meets ties.
@query("eval_report_ties", """select 'd' || doc_id as test_id, lang as category, source as mode,
       printf('%.2f', (n_chars % 9) / 8.0::double) as p_at_k, case when n_chars % 2 = 0 then 'Y' else 'N' end as hit_1,
       'N' as hit_k, n_chars as docs, printf('%.0fms', (n_chars % 32) / 2.0::double) as latency from documents""")
def eval_report_ties(spark, sf_dir):
    return ev.report_rows(table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("test_id"), F.col("lang").alias("category"), F.col("source").alias("mode"),
        (F.col("n_chars") % 9 / 8.0).alias("precision_at_k"), (F.col("n_chars") % 2 == 0).alias("hit_at_1"),
        F.lit(False).alias("hit_at_k"), F.col("n_chars").alias("unique_docs"), (F.col("n_chars") % 32 / 2.0).alias("latency_ms")))


@query("source_rows_ties", f"""select doc_id as query_id, 1 as rank, 'q' as qa_id, printf('%.3f', n_chars / 16.0::double) as score_text,
       source as ministry, lang as subject, {strip_sql('substring(text, 1, 200)')} || '...' as excerpt from documents""")
def source_rows_ties(spark, sf_dir):
    return display_rows(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.lit("q").alias("qa_id"), (F.col("n_chars") / 16.0).alias("score"),
        F.col("source").alias("ministry"), F.col("lang").alias("subject"), "text"))


@query("eval_failures", EVAL_DENSE + """
select 'b' || item as test_id, mode, rank, qa_id, ministry, substring(members, 1, 60) as members,
  case when member_ok and ministry_ok and text_ok then 'PASS' else 'FAIL' end as verdict,
  concat_ws('; ', case when not member_ok then 'members=''' || members || '''' end,
                  case when not ministry_ok then 'ministry=''' || ministry || '''' end,
                  case when not text_ok then 'subject=''' || subject || '''' end) as reasons
from judged where query_id in (select query_id from scores where p < 1)""")
def eval_failures(spark, sf_dir):
    return ev.failures(*evaluated(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


HYBRID_FOUND = bm25_ctes("requests", "(q.mp is null or contains(members, q.mp)) and (q.wanted is null or ministry = q.wanted)") + """,
legs as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense
         union all
         select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25),
fused as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as score from legs where rank <= 10 group by 1, 2),
found as (select * from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused) where rank <= 10),"""


@query("compare_searches", "select d.mode, round(d.p, 6) as dense, round(h.p, 6) as hybrid, round(h.p - d.p, 6) as delta from ("
       + EVAL_DENSE + " select mode, avg(p) as p from scores group by mode) d join ("
       + EVAL.replace("LEGS", HYBRID_FOUND) + " select mode, avg(p) as p from scores group by mode) h on d.mode = h.mode")
def compare_searches(spark, sf_dir):
    scan, collection = lexical.bm25_scan(doc_chunks(spark, sf_dir)), hashed_collection(spark, sf_dir)
    dense_scores = evaluated(spark, sf_dir, collection)[0].withColumn("search", F.lit("dense"))
    hybrid_scores = evaluated(spark, sf_dir, collection, mode="hybrid", lexical=scan)[0].withColumn("search", F.lit("hybrid"))
    table_ = ev.compare_searches(dense_scores.unionByName(hybrid_scores))
    return table_.select("mode", *[F.round(c, 6).alias(c) for c in ("dense", "hybrid", "delta")])


# ---- ingestion ---------------------------------------------------------

INGESTED = CHUNK_SQL.replace("from documents)", f"from documents where length({strip_sql('text')}) >= 50)", 1)


def chunk_rows(collection):
    return collection.select("chunk_id", F.md5("text").alias("text"), F.size("embedding").cast("bigint").alias("dim"))


INGESTED_SQL = f"select chunk_id, text, cast({HASH_DIM} as bigint) as dim from ({INGESTED})"


@query("ingest_steps", INGESTED_SQL)
def ingest_steps(spark, sf_dir):
    root = session.scratch_path(spark, "ingest")
    chunks = ingest.chunk_step(corpus_of(spark, sf_dir), f"{root}/chunks")
    vectors_ = ingest.embed_step(chunks, f"{root}/embeddings", MODEL)
    # A second run of a step finds nothing left to do.
    vectors_ = ingest.embed_step(chunks, f"{root}/embeddings", MODEL)
    ingest.index_step(chunks, vectors_, f"{root}/collection")
    return chunk_rows(ingest.index_step(chunks, vectors_, f"{root}/collection"))


@query("ingest_bucketed", INGESTED_SQL)
def ingest_bucketed(spark, sf_dir):
    root = session.scratch_path(spark, "bucketed")
    name = f"ingest_{root.rsplit('-', 1)[-1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed.create_tables(spark, name, buckets=buckets, location=root)
    corpus = corpus_of(spark, sf_dir)
    third = F.crc32(F.coalesce("id", F.lit(""))) % 3
    # The corpus arrives in two parts that overlap.
    for part in (corpus.where(third < 2), corpus.where(third > 0)):
        bucketed.add_chunks(part, name)
        bucketed.embed_pending(spark, name, MODEL)
        bucketed.index_pending(spark, name)
    return chunk_rows(spark.table(f"{name}_collection"))


@query("stream_ingest", INGESTED_SQL)
def stream_ingest(spark, sf_dir):
    root = session.scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # The second run starts from the checkpoint and finds no new file.
    for _ in range(2):
        streaming.ingest_stream(
            spark, f"{sf_dir}/documents*.parquet", schema, f"{root}/collection", f"{root}/checkpoint", MODEL,
            rename=CORPUS_NAMES,
        ).awaitTermination()
    return chunk_rows(streaming.read_collection(spark, f"{root}/collection"))


@query("metadata_tables_roundtrip", with_views("questions", "question_mps") + """
select 'questions' as name, lok_no, session_no, ques_no, type, date, ministry, subject, cast(null as varchar) as mp_name from questions
union all select 'question_mps', lok_no, session_no, ques_no, type, null, null, null, mp_name from question_mps""")
def metadata_tables_roundtrip(spark, sf_dir):
    root = session.scratch_path(spark, "metadata")
    writers.write_metadata(view(spark, sf_dir, "questions"), view(spark, sf_dir, "question_mps"), root)
    tables = [spark.read.parquet(f"{root}/{t}").withColumn("name", F.lit(t)) for t in ("questions", "question_mps")]
    return tables[0].unionByName(tables[1], allowMissingColumns=True)


@query("alias_map_roundtrip", with_views("doc_chunks") + """
select distinct 'Shri ' || name as canonical, name || '|Shri ' || name as aliases from (
  select unnest(string_split(members, ', ')) as name from doc_chunks)""")
def alias_map_roundtrip(spark, sf_dir):
    path = session.scratch_path(spark, "aliases")
    writers.write_alias_map(member_aliases(spark, sf_dir), path)
    return readers.read_alias_map(spark, path).select("canonical", F.array_join("aliases", "|").alias("aliases"))


@query("registry_json_roundtrip", with_views("registry") + " select lok, mpNo, mpName from registry")
def registry_json_roundtrip(spark, sf_dir):
    """One JSON array per term, in a directory named by the term."""
    root = session.scratch_path(spark, "registry")
    rows = view(spark, sf_dir, "registry")
    for lok in (16, 17, 18):
        entries = F.collect_list(F.struct("mpNo", "mpName"))
        rows.where(F.col("lok") == lok).agg(F.to_json(entries).alias("value")).write.text(f"{root}/{lok}")
    return readers.read_registry(spark, f"{root}/*/*").select("lok", "mpNo", "mpName")


@query("eval_cases_json_roundtrip", """
select 'b' || item_id as id, text as query, case when length(text) > 200 then 'member' else 'topic' end as category,
       case when length(text) > 200 then 'Shri Member ' || item_id % 37 end as mp, case when length(text) < 260 then 'src' || item_id % 20 end as ministry,
       case when length(text) > 200 then 'Member ' || item_id % 37 end as members, '' as notes from benchmark""")
def eval_cases_json_roundtrip(spark, sf_dir):
    path = session.scratch_path(spark, "cases")
    written = cases(spark, sf_dir)
    entry = F.struct(*[c for c in written.columns if c != "notes"])
    written.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(path)
    back = readers.read_eval_cases(spark, path)
    members = F.array_join("expected.members_contains_any", "|")
    return back.select("id", "query", "category", "mp", "ministry", members.alias("members"), "notes")


@query("collection_append", """select vec_id, label, round(cast(embedding[1] as double), 6) as first, len(embedding) as dim
from (select * from embeddings union all select * from embeddings)""")
def collection_append(spark, sf_dir):
    path = session.scratch_path(spark, "collection")
    rows = table(spark, sf_dir, "embeddings")
    writers.drop_and_write_collection(rows, path, partition_by=("label",))
    writers.write_collection(rows, path, partition_by=("label",))
    stored = spark.read.parquet(path)
    return stored.select(
        "vec_id", F.col("label").cast(rows.schema["label"].dataType), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
        F.size("embedding").cast("bigint").alias("dim"))
