"""Revised texts that can't stand, case by case."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import reporting

LONG = "I recall the onset was approximately 2019. I observed pain twice a week. " * 5
FORM = f"# Facts\n{LONG}\n**Impact:**\nHe [Confirm  date] stayed.\n2) Signature\nI certify that this is true.\n[Name]"


@pytest.mark.parametrize(
    ("before", "after", "reason"),
    [
        (LONG, None, "no statement"),
        (LONG, " \n  \x1f", "no statement"),
        (LONG, LONG[:200], "too short"),
        ("x" * 1000, "x" * 395 + "\n" * 50, "too short"),
        ("x" * 1000, "x" * 401, "text changed"),
        (LONG, LONG.replace("2019", "2021"), "text changed"),
        (LONG, LONG.replace("twice", "daily"), "text changed"),
        (LONG, "\n" + LONG.replace(" ", "  \t"), ""),
        (None, LONG, "text changed"),
        (FORM, FORM, ""),
        (FORM, FORM.replace("  date", " date"), ""),
        (FORM, FORM.replace("[Confirm  date]", "in May"), "placeholder lost"),
        (FORM + "\n[Name]", FORM + "\nName", "placeholder lost"),
        (FORM, FORM.replace("**Impact:**", "Impact of it"), "heading lost"),
        (FORM, FORM.replace("# Facts", "## FACTS :"), "text changed"),
        (FORM, FORM.replace("He [Confirm  date] stayed.\n", "") + "\n[Confirm date]", "section emptied"),
        (FORM, FORM.replace("true.", "so."), "closing changed"),
        (FORM, FORM + "\nP.S.", "closing changed"),
        (FORM, FORM.replace("stayed", "went"), "text changed"),
        (LONG + "\nClosing\nend", LONG + "\nend", "heading lost"),
    ],
)
def test_rejected(spark, before, after, reason):
    df = spark.createDataFrame([(before, after)], "b string, a string")
    assert df.select(reporting.rejected(F.col("b"), F.col("a"))).first()[0] == reason


def test_headings(spark):
    text = "# One\n\n body \n**Two:**\n3. Three\n\r\nrest Continuity:\n#\n12) \n" + "4. " + "x" * 121
    got = spark.createDataFrame([(text,)], "t string").select(reporting.headings(F.col("t")).alias("h")).first().h
    assert [(h.label, h.filled) for h in got if h.label] == [("one", True), ("two", False), ("three", True), ("continuity", True)]
