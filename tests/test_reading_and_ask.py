from pyspark.sql import functions as F

from sheetwise.functions import reading
from sheetwise.operators import ask


def test_clean_and_repair(spark):
    rows = [(" mv-101 ", "MV-101"), ("a  b", "A B"), ("1”-PL", '1"-PL'), ("smudge…", ""), ("-", ""), (None, ""), ("", "")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", reading.clean(F.col("t")))
    assert all(r.got == r.want for r in df.collect())
    texts = ["PI-123", "P I-1 23", "03 01C", "[0301C]", "hello world", "P1-1O3", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.how, r.repaired) for r in reading.repair(df).collect()}
    assert got["PI-123"] == ("direct", "PI-123") and got["P I-1 23"] == ("spaces_removed", "PI-123") and got["[0301C]"][0] == "direct"
    assert got["03 01C"] == got["hello world"] == got[""] == got[None] == got["P1-1O3"] == (None, None)
    more = {r.text: (r.how, r.repaired) for r in reading.repair(spark.createDataFrame([("PI-1O3",), ("P1-103",)], "text string"), budget=1).collect()}
    assert more["PI-1O3"] == ("substituted", "PI-103")
    assert tuple(reading.repair_stats(reading.repair(df)).first()) == (8, 3, 0, 5)


def test_cache(spark):
    crops = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "", 0.0, "x")], "key string, text string, confidence double, backend string")
    hits, misses = reading.split_by_cache(crops, cache)
    assert [r.key for r in hits.collect()] == ["a"] and [r.key for r in misses.collect()] == ["b"]


def test_questions(spark):
    nodes = spark.createDataFrame([("src", 0, "V-100", "component", None, 1, 0.9), ("valve", 1, "MV-101", "component", None, 1, 0.9), ("dst", 2, None, "component", "V-102", 1, 0.9)], "key string, seq int, tag string, kind string, label string, page int, confidence double")
    edges = spark.createDataFrame([("src", "valve", "l1", '2"-GAS'), ("valve", "dst", None, None)], "src string, dst string, via string, line_number string")
    assert [r.key for r in ask.find_tag(nodes, "mv-101").collect()] == ["valve"] and ask.find_tag(nodes, " ").count() == 0
    assert [r.key for r in ask.find_tag(nodes, "component", 2).collect()] == ["src", "valve"] and [r.key for r in ask.find_tag(nodes, "V-102").collect()] == ["dst"]
    q = spark.createDataFrame([("Where do MV-101 and MV-715-02A connect?",)], "question string")
    assert ask.tag_candidates(q).first().candidates == ["MV-715-02A", "MV-101"]
    e = ask.ask(nodes, edges, "Where does MV-101 connect?")
    assert {r.node for r in e["upstream"].collect()} == {"valve", "src"} and {(r.neighbour, r.direction) for r in e["neighbours"].collect()} == {("src", "in"), ("dst", "out")}
    assert e["describe"].first().line_numbers == ['2"-GAS']
