"""Corpus and registry to the two metadata tables."""

from pyspark.sql import DataFrame

from ..operators import entities as ent
from ..session import write_and_read
from ..sources import writers


def build_metadata(corpus: DataFrame, registry: DataFrame, order_cols, root) -> DataFrame:
    """Write `questions` and `question_mps` under `root`; return the run's counts.

    The surviving rows are found once and stored, as both tables read them.
    """
    names = ent.canonical_names(registry)
    fields = ["lok_no", "session_no", "ques_no", "type", "date", "ministry", "subject", "members"]
    latest = write_and_read(ent.latest_questions(corpus, order_cols).select(*fields), "latest")
    writers.write_metadata(ent.questions_of(latest), ent.links_of(latest, names), root)
    return ent.build_counts(corpus, names)
