"""Document preparation: filtering, flattening, member lists, filters on metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx


def drop_short_docs(df: DataFrame, text_col="full_text", min_chars=schemas.MIN_CHARS) -> DataFrame:
    """Keep documents with at least `min_chars` characters after stripping."""
    return df.where(F.length(tx.strip(F.col(text_col))) >= min_chars)


def flatten_metadata(df: DataFrame, fields=None, *, nulls="empty", cast=True) -> DataFrame:
    """Turn metadata into strings: null to `""`, lists joined by `", "`.

    `nulls="keep"` with `cast=False` leaves nulls and scalar types as they are
    and only joins the lists.
    """
    out = {}
    for field in fields or schemas.META_FIELDS:
        column = F.col(field)
        if isinstance(df.schema[field].dataType, T.ArrayType):
            # A null element prints as the source language prints it.
            items = F.transform(column, lambda v: F.coalesce(v.cast("string"), F.lit("None")))
            column = F.when(column.isNotNull(), F.array_join(items, ", "))
        elif cast:
            column = column.cast("string")
        out[field] = F.coalesce(column, F.lit("")) if nulls == "empty" else column
    return df.withColumns(out)


def with_qa_id(df: DataFrame, source="id") -> DataFrame:
    """Replace the source id by `qa_id`, a string, empty when missing."""
    return df.withColumn("qa_id", F.coalesce(F.col(source).cast("string"), F.lit(""))).drop(source)


def clean_question_fields(df: DataFrame) -> DataFrame:
    """Ministry stripped, empty to null; empty subject to null."""
    return df.withColumns({
        "ministry": tx.blank_to_null(F.col("ministry")),
        "subject": F.nullif(F.col("subject"), F.lit("")),
    })


def keyed_questions(df: DataFrame) -> DataFrame:
    """Rows whose three key numbers are present; `type` may be null."""
    return df.where(tx.all_of([F.col(c).isNotNull() for c in ("lok_no", "session_no", "ques_no")]))


def member_array(df: DataFrame, col="members") -> Column:
    """Member names, stripped, blanks dropped, from an array or a comma-joined string."""
    return F.filter(F.transform(_listed(df, col), tx.strip), lambda name: name != "")


def _listed(df: DataFrame, col) -> Column:
    """The members as listed, from an array or a comma-joined string."""
    names = F.col(col)
    return names if isinstance(df.schema[col].dataType, T.ArrayType) else F.split(names, ",")


def explode_members(df: DataFrame, col="members", out="mp") -> DataFrame:
    """One row per named member; documents without members drop out.

    Names are stripped as rows: functions over arrays are interpreted, not compiled.
    """
    rows = df.withColumn(out, F.explode(_listed(df, col))).drop(col)
    return rows.withColumn(out, tx.strip_short(F.col(out))).where(F.col(out) != "")


def members_filter(names, col="members") -> Column:
    """True where `members` contains any of the names as a plain substring."""
    return tx.any_of([F.col(col).contains(name) for name in names], empty=True)


def ministry_filter(ministry, col="ministry") -> Column:
    return F.col(col) == F.lit(ministry)


def metadata_filter(names=None, ministry=None) -> Column:
    """Conjunction of the filters given; no filter passes every row."""
    conditions = []
    if names:
        conditions.append(members_filter(names))
    if ministry:
        conditions.append(ministry_filter(ministry))
    return tx.all_of(conditions)


def request_matches(names="names", wanted="wanted_ministry", members="members", ministry="ministry") -> Column:
    """The same conjunction with the filter values in columns.

    A null or empty name list and a null or empty ministry are not checked.
    """
    by_name = F.exists(F.col(names), lambda name: F.col(members).contains(name))
    no_names = F.col(names).isNull() | (F.size(F.col(names)) == 0)
    no_ministry = F.col(wanted).isNull() | (F.col(wanted) == "")
    return (no_names | by_name) & (no_ministry | (F.col(wanted) == F.col(ministry)))


def search_names(df: DataFrame, term, col="name") -> DataFrame:
    """Names containing the term, whatever the case."""
    return df.where(F.upper(F.col(col)).contains(F.upper(F.lit(term))))


def with_prefix(df: DataFrame, prefix=schemas.PASSAGE_PREFIX, col="text") -> DataFrame:
    return df.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


def select_where(df: DataFrame, columns, *, names=None, ministry=None, limit=None) -> DataFrame:
    """Metadata-only lookup: filter, project and limit, with no vector involved."""
    out = df.where(metadata_filter(names, ministry)).select(*columns)
    return out.limit(limit) if limit is not None else out
