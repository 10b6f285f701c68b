"""Secret scans by sliding-window entropy.

Runs of characters of one class, such as hexadecimal digits, are candidates. A
window of fixed length slides over each; the counts of its characters change by
one in and one out per step, and with them the Shannon entropy, kept as a sum of
whole numbers so that no rounding adds up. Windows above the threshold of their
class are merged to spans. An allow-list suppresses examples and placeholders, plain
words, alphabets in order, identifiers in UUID form, and patterns that the caller
adds: windows that touch what a pattern matches are not looked at, all others are. A
pattern that begins with `^` speaks of the whole run or span: it suppresses a run where
it matches, and a span where it matches all of it.

Three base patterns, assignments, access keys and long hexadecimal numbers, are
reported besides whatever their entropy. One look per text with a linear-time
pattern decides which texts are scanned at all; each text is scanned whole, in one
task, in time proportional to its length. Nothing is shuffled.

Positions count code points, ends are exclusive. Defined results: null is the
empty text, which has no spans and the digest of nothing. Spans of one kind never
overlap, spans of different kinds may. Repeated rows each get their result. Empty
tables give no rows. Other columns are not read.
"""

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import slices

# The base patterns, in the order of their kinds.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}

WINDOW = 20
# Kind, characters of the class, and the least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", "0-9a-fA-F", 2.75),
    ("entropy_upper", "A-Z0-9", 3.4),
    ("entropy_base64", "A-Za-z0-9+/_-", 3.75),
)
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|sample|redacted|your[_-]?(?:key|token|secret)",
    r"^[a-z]+$|^[A-Z][a-z]+$|^[A-Z]+$|^[0-9]+$",
    r"^(?:[a-z]+[-_/+])+[a-z]+$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(.)\1{7}",
)
KINDS = [kind for kind, _ in BASE] + [kind for kind, _, _ in CLASSES]

SCALE = 1 << 32


def _any_case(pattern):
    """The first group of a pattern with ASCII letters in either case."""
    head, rest = pattern[: pattern.index(")")], pattern[pattern.index(")"):]
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + rest


def hot_spans(run, window, least):
    """Merged spans of the windows of `run` whose entropy is at least `least` bits."""
    if len(run) < window:
        return []
    # Entropy is log2(w) - sum(c * log2 c) / w over the counts c.
    part = [0] + [round(SCALE * c * math.log2(c)) for c in range(1, window + 1)]
    most = round(SCALE * window * (math.log2(window) - least))
    counts, total, spans = {}, 0, []
    for at, char in enumerate(run):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += part[n + 1] - part[n]
        if at >= window:
            gone = run[at - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += part[n - 1] - part[n]
        if at >= window - 1 and total <= most:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return spans


class Scanner:
    """The compiled patterns of one task."""

    def __init__(self, window=WINDOW, classes=CLASSES, allowed=ALLOWED):
        self.base = [
            (kind, re.compile(_any_case(p) if kind == "assign" else p if kind == "access" else f"{p[:-1]}{{{LEAST[kind]},}}"))
            for kind, p in BASE]
        self.window = window
        self.classes = [(kind, re.compile(f"[{chars}]{{{window},}}"), least) for kind, chars, least in classes]
        whole = [bool(re.match(r"(?:\(\?[a-zA-Z]+\))?\^", a)) for a in allowed]
        self.whole = [re.compile(a) for a, w in zip(allowed, whole) if w]
        self.parts = [re.compile(a) for a, w in zip(allowed, whole) if not w]
        runs = "|".join(f"[{chars}]{{{window}}}" for _, chars, _ in classes)
        self.gate = f"(?i:password|passwd|secret|token|api_?key)[\"']?[ ]*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|{runs}"

    def base_spans(self, text):
        out = []
        for kind, pattern in self.base:
            for m in pattern.finditer(text):
                if kind == "hex" or len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                    out.append((m.start(), kind, m.end()))
        return out

    def looked_at(self, run):
        """(start, end) of the parts of a run between what the allow-list matches."""
        low = 0
        for start, end in sorted(m.span() for a in self.parts for m in a.finditer(run)):
            if end > start:
                if start - low >= self.window:
                    yield low, start
                low = max(low, end)
        if len(run) - low >= self.window:
            yield low, len(run)

    def entropy_spans(self, text):
        out = []
        for kind, pattern, least in self.classes:
            for m in pattern.finditer(text):
                run = m[0]
                if any(a.search(run) for a in self.whole):
                    continue
                for low, high in self.looked_at(run):
                    for start, end in hot_spans(run[low:high], self.window, least):
                        if not any(a.fullmatch(run[low + start: low + end]) for a in self.whole):
                            out.append((m.start() + low + start, kind, m.start() + low + end))
        return out

    def scan(self, text):
        """(base spans, all spans), each (start, kind, end) in order."""
        def order(s):
            return s[0], KINDS.index(s[1])

        base = sorted(self.base_spans(text), key=order)
        return base, sorted(base + self.entropy_spans(text), key=order)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, key="doc_id", text="text", window=WINDOW, classes=CLASSES, allow=()) -> DataFrame:
    """One row per document: counts of each base kind, of entropy spans, the digest of the base spans, and all spans.

    `allow` adds patterns to the allow-list.
    """
    out = T.StructType([
        T.StructField(key, docs.schema[key].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_entropy")),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    arrow = to_arrow_schema(out)
    allowed = (*ALLOWED, *allow)

    def run(batches):
        scanner = Scanner(window, classes, allowed)
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text")
                likely = pc.fill_null(pc.match_substring_regex(texts, scanner.gate), False).to_numpy(zero_copy_only=False)
                rows = [nothing] * part.num_rows
                for i in likely.nonzero()[0]:
                    base, spans = scanner.scan(texts[int(i)].as_py())
                    kinds = [kind for _, kind, _ in base]
                    rows[i] = (
                        *(kinds.count(kind) for kind, _ in BASE), len(spans) - len(base),
                        hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, out)
