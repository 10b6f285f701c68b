"""Views that map the given tables onto the corpus tables, in Spark and in SQL."""

from functools import lru_cache

from corpusqa.functions.text import WHITESPACE


# Tables that are scanned by heavy queries.
LARGE = {"documents", "lineitem", "orders"}


@lru_cache(maxsize=64)
def table(spark, sf_dir, name):
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The small test tables are one file of one row group, which can't be split.
    if name in LARGE and len(scan.inputFiles()) == 1:
        return scan.repartition(spark.sparkContext.defaultParallelism)
    return scan


SQL = {
    "questions": """
select cast(year(o_orderdate) as int) lok_no, cast(quarter(o_orderdate) as int) session_no,
       cast(o_orderkey as int) ques_no, o_orderstatus type,
       cast(cast(o_orderdate as date) as string) date, n_name ministry, o_orderpriority subject
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "question_mps": """
select q.lok_no, q.session_no, q.ques_no, q.type, s_name mp_name
from lineitem join questions q on l_orderkey = q.ques_no join supplier on l_suppkey = s_suppkey""",
    "registry": """
select lok, s_suppkey + 1 pos, cast(s_suppkey + 1 as int) mpNo,
       case lok when 16 then upper(s_name) when 17 then s_name else concat('Shri ', s_name) end mpName
from (select *, explode(array(16, 17, 18)) lok from supplier)
where lok < 18 or s_suppkey % 2 = 0""",
    "corpus": """
select 1 lok_no, l_linenumber session_no, cast(l_orderkey as int) ques_no, l_returnflag type,
       cast(cast(l_shipdate as date) as string) date, o_orderpriority subject,
       concat('  ', n_name, ' ') ministry, concat(s_name, ', ', upper(s_name), ', ') members,
       l_shipdate ord1, l_extendedprice ord2, l_partkey ord3
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
     join nation on c_nationkey = n_nationkey join supplier on l_suppkey = s_suppkey""",
    "doc_chunks": """
select concat('D', doc_id) chunk_id, concat('D', doc_id) qa_id, text, source ministry, lang type,
       concat('Member ', doc_id % 37, ', Member ', doc_id % 11) members,
       concat(lang, ' text from ', source) subject, doc_id
from documents""",
}

# The same view where the two dialects differ.
DUCK = dict(SQL)
DUCK["registry"] = SQL["registry"].replace("explode(array(16, 17, 18))", "unnest([16, 17, 18])")

BASE = {
    "questions": ["orders", "customer", "nation"],
    "question_mps": ["lineitem", "supplier"],
    "registry": ["supplier"],
    "corpus": ["lineitem", "orders", "customer", "nation", "supplier"],
    "doc_chunks": ["documents"],
}
NEEDS = {"question_mps": ["questions"]}


def view(spark, sf_dir, name):
    """The mapped table as a DataFrame over the given Parquet files."""
    frames = {t: table(spark, sf_dir, t) for t in BASE[name]}
    frames.update({v: view(spark, sf_dir, v) for v in NEEDS.get(name, [])})
    sql = SQL[name]
    for key in frames:
        sql = sql.replace(f"from {key}", "from {" + key + "}").replace(f"join {key} ", "join {" + key + "} ")
    return spark.sql(sql, **frames)


def with_views(*names):
    """`WITH` clause that defines the mapped tables for an SQL check."""
    order = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    return "with " + ",\n".join(f"{n} as ({DUCK[n]})" for n in order)


@lru_cache
def ws_sql():
    """The whitespace characters as an SQL string expression."""
    return "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip_sql(expr):
    return f"trim({expr}, {ws_sql()})"


WS_RE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_WS_RE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
TERM_RE = r"[\p{L}\p{N}]+"


def collapse_sql(expr):
    return f"trim(regexp_replace({expr}, '{WS_RE}+', ' ', 'g'))"


def aliases_of_registry_sql():
    """CTE bodies for the name map and alias map over the `registry` view."""
    return """
numbers as (select mpNo, arg_max(mpName, lok * 100000000 - pos) canonical, min(lok * 100000000 + pos) first_seen
            from registry group by mpNo),
name_map as (select mpName name, arg_max(canonical, first_seen) canonical
             from registry join numbers using (mpNo) group by mpName),
alias_map as (select canonical, list_sort(list_distinct(list_concat(list(name), [canonical]))) aliases
              from name_map group by canonical)"""
