"""Table schemas and the constants that define results."""

from pyspark.sql import types as T

# The defaults of the reference configuration.
EMBED_DIM = 1024
EMBED_BATCH = 256
TOP_K = 10
RERANK_TOP_N = 4
RRF_K = 60
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
MIN_CHARS = 50
TOP_CATEGORIES = 15
TOP_QUESTIONS = 10
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# The metadata fields carried from a document to its chunks.
META_FIELDS = ["lok_no", "session_no", "ques_no", "type", "date", "subject", "ministry", "members"]

QUESTION_KEY = ["lok_no", "session_no", "type", "ques_no"]

CORPUS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("lok_no", T.IntegerType()),
    T.StructField("session_no", T.IntegerType()),
    T.StructField("ques_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("ministry", T.StringType()),
    T.StructField("members", T.ArrayType(T.StringType())),
])

CHUNKS = T.StructType(
    [T.StructField("chunk_id", T.StringType()),
     T.StructField("chunk_no", T.IntegerType()),
     T.StructField("qa_id", T.StringType()),
     T.StructField("text", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in META_FIELDS]
)

EMBEDDINGS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
])

QUESTIONS = T.StructType([
    T.StructField("lok_no", T.IntegerType()),
    T.StructField("session_no", T.IntegerType()),
    T.StructField("ques_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("ministry", T.StringType()),
    T.StructField("subject", T.StringType()),
])

LINKS = T.StructType([
    T.StructField("lok_no", T.IntegerType()),
    T.StructField("session_no", T.IntegerType()),
    T.StructField("ques_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("mp_name", T.StringType()),
])

MEMBER_ENTRY = T.StructType([
    T.StructField("mpNo", T.IntegerType()),
    T.StructField("mpName", T.StringType()),
])

MINISTRY_ENTRY = T.StructType([T.StructField("minName", T.StringType())])

ALIASES = T.StructType([
    T.StructField("canonical", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
])

EVAL_CASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("mp", T.StringType()),
    T.StructField("ministry", T.StringType()),
    T.StructField("expected", T.StructType([
        T.StructField("members_contains_any", T.ArrayType(T.StringType())),
        T.StructField("ministry_eq", T.StringType()),
        T.StructField("text_contains_any", T.ArrayType(T.StringType())),
    ])),
    T.StructField("notes", T.StringType()),
])

EXTRACTION = T.StructType([
    T.StructField("engine", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("time_sec", T.DoubleType()),
    T.StructField("mem_peak_delta_mb", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("group", T.StringType()),
])
