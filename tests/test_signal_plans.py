"""Work on messages is not repeated, and the side of the events is never the built one."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_built_once(spark):
    assert "StructsToJson" not in plan(entry.queries()["src1_signal_stream_rejects"](spark, SF))


def test_evidence_is_decoded_once_and_streams_through_the_join(spark):
    text = plan(entry.queries()["jon2_evidence_failures"](spark, SF))
    assert text.count("from_json") == 1 and "BuildLeft" not in text
