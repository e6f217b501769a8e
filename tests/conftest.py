"""A local session, a ticket history made from a small plan, and helpers shared by the tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caselore.functions.embed import hash_embed  # noqa: E402
from caselore.operators import clean as C  # noqa: E402
from caselore.operators import patterns as P  # noqa: E402
from caselore.operators import retrieve as R  # noqa: E402
from caselore.operators import vectors as X  # noqa: E402
from caselore.session import build_session  # noqa: E402

TEXT_COLUMNS = ["unique_key", "created_date", "closed_date", "complaint_type", "descriptor", "descriptor_2",
                "resolution_description", "status"]
COLUMNS = ", ".join(f"{c} string" for c in TEXT_COLUMNS)

# What the history is to contain, as rows (type, product, outcome, tickets). The sizes are chosen from the tier limits:
# one class just above 9 in 10 and 30 tickets, one just above a half, one without a majority.
PLAN = [
    ("Parcel", "Arrived wet", "A new parcel was sent.", 34), ("Parcel", "Arrived wet", "The sender was paid back.", 2),
    ("Ferry", "Crossing missed", "A later boat was booked.", 27), ("Ferry", "Crossing missed", "The fare was refunded.", 14),
    ("Ferry", "Crossing missed", "No seat was left that week.", 10),
    ("Library card", "Refused at the gate", "The card was charged anew.", 18),
    ("Library card", "Refused at the gate", "The reader had lost power.", 15),
    ("Library card", "Refused at the gate", "A fee was still open.", 12),
    ("Library card", "Refused at the gate", "The visitor came after closing time.", 9),
]
SETTLED, SPLIT, OPEN = "Parcel", "Ferry", "Library card"
SIZE = {kind: sum(row[3] for row in PLAN if row[0] == kind) for kind in (SETTLED, SPLIT, OPEN)}
TOTAL = sum(SIZE.values())


def hours_of(number: int) -> float:
    """Hours to close the ticket with this number inside its outcome; the frame below has the same rule."""
    return 1.5 * (number * number % 11 + 1)


def tickets(spark, plan=PLAN, mark="H"):
    """All-text tickets for a plan, without a row loop: each plan row is spread over its tickets."""
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(plan)],
                                 "row int, complaint_type string, descriptor string, resolution_description string, n int")
    spread = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    opened = F.timestamp_seconds(F.lit(1_725_264_000) + F.col("row") * 86_400 + F.col("number") * 2_820)
    minutes = (F.col("number") * F.col("number") % 11 + 1) * 90
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    return spread.withColumns({
        "unique_key": F.concat_ws("-", F.lit(mark), "row", "number"), "created_date": F.date_format(opened, stamp),
        "closed_date": F.date_format(opened + F.make_dt_interval(mins=minutes), stamp), "descriptor_2": F.lit(""),
        "status": F.lit("Closed")}).select(*TEXT_COLUMNS)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


class History:
    def __init__(self, spark):
        self.tickets = C.clean_tickets(tickets(spark)).persist()
        self.counts = P.outcome_counts(self.tickets).persist()
        self.patterns = P.build_patterns(self.tickets).persist()
        self.resolutions = P.resolution_catalogue(self.tickets).persist()
        self.vectors = X.embed_rows(X.index_rows(self.patterns), hash_embed).persist()
        self.cards = R.pattern_cards(self.patterns, self.counts, self.resolutions, 5).persist()


@pytest.fixture(scope="session")
def history(spark):
    return History(spark)


def complaints(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, complaint string")
    return df.withColumn("embedding", hash_embed(df.complaint))
