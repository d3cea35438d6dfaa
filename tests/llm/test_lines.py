"""Repeated lines (problem 4)."""

from inkstream.llm import lines

def frames(spark, given):
    df = spark.createDataFrame(given, SCHEMA)
    return df.select("doc", "body", "clean_body", "key"), df.select("doc", "source", "key").distinct()


def frequent(spark, given, *limits):
    bodies, origins = frames(spark, given)
    return lines.frequent_lines(lines.source_lines(bodies, origins), bodies, origins, *limits)


SCHEMA = "doc long, source string, body string, clean_body string, key string"


def rows():
    out = [(i, "s", f"Share  THIS {i}\n\nstory {chr(97 + i % 26)}{chr(97 + i // 26)}x\nshare this ৯", None, "k") for i in range(60)]
    out += [(100, "t", "share this 1", None, None), (101, "t", None, None, None), (102, None, "share this 1", None, None), (103, "t", "", None, None), (104, "t", "y" * 100_000, None, None)]
    return out


def test_found_and_rebuilt(spark):
    bodies, origins = frames(spark, rows())
    got = {(r.doc, r.line_no) for r in lines.repeated_lines(bodies, origins).collect()}
    assert got == {(i, n) for i in range(60) for n in (1, 4)}
    clean = {r.doc: r.clean_body for r in lines.without_repeated_lines(bodies, origins).collect()}
    assert clean[0] == "\nstory aax" and clean[101] is None and clean[103] == "" and clean[100] == "share this 1"
    assert len(clean) == len(rows())


def test_share_and_count_thresholds(spark):
    given = [(i, "s", "rare" if i < 3 else f"l{chr(97 + i % 26)}{chr(97 + i // 26)}", None, None) for i in range(151)]
    assert frequent(spark, given, 3, 0.02).count() == 0
    assert frequent(spark, given, 3, 0.019).count() == 1
    assert frequent(spark, given, 4, 0.01).count() == 0


def test_empty_and_repeated_rows(spark):
    bodies, origins = frames(spark, rows())
    assert lines.repeated_lines(bodies.limit(0), origins).count() == 0
    assert lines.repeated_lines(bodies, origins.limit(0)).count() == 0
    assert lines.repeated_lines(*frames(spark, [(1, "s", "a", None, None)] * 5)).count() == 0
