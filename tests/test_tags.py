from pyspark.sql import functions as F

from sheetwise.functions import quantity, tags


def parsed(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return {r.raw: r.p for r in df.select("raw", tags.parse(F.col("raw")).alias("p")).collect()}


def test_every_safety_device_and_nothing_else(spark):
    letters = [f"{a}{b}" for a in "FPTLZ" for b in ("SV", "SE", "IT", "IC", "SH")]
    p = parsed(spark, [f"{x}-{400 + i}" for i, x in enumerate(letters)])
    assert {k.split("-")[0] for k, v in p.items() if v.is_safety} == set(tags.SAFETY_DEVICES)
    assert all(v.variable == k[0] for k, v in p.items())


def test_the_second_letter_modifies_only_where_it_can(spark):
    p = parsed(spark, ["FQI-31", "TDIC-32", "PD-33", "PS-34", "LSL-35", "FZT-36", "PSE-37"])
    assert {k: v.modifier for k, v in p.items()} == {"FQI-31": "Q", "TDIC-32": "D", "PD-33": "D", "PS-34": None, "LSL-35": None, "FZT-36": "Z", "PSE-37": "S"}
    assert [k for k, v in p.items() if v.is_sis] == ["FZT-36"]


def test_rules_go_in_order(spark):
    p = parsed(spark, ["dfit - 812", "DTI-812-3B", "V-386", "V-386 c / d", "X-386", "MV-512-09", "MOV-51", '8"-NG-7713-C2', '3/4" - w-1', "[418B]", "418B", "[418]", "418", "K07Q", "DRAIN", " ", None])
    kinds = {k: v.kind for k, v in p.items()}
    assert kinds["dfit - 812"] == kinds["X-386"] == "instrument" and kinds["MV-512-09"] == kinds["MOV-51"] == "valve"
    assert kinds["V-386"] == kinds["V-386 c / d"] == "equipment" and kinds['8"-NG-7713-C2'] == kinds['3/4" - w-1'] == "line_number"
    assert kinds["[418B]"] == kinds["418B"] == kinds["[418]"] == kinds["K07Q"] == "off_page_connector"
    assert all(kinds[x] == "unknown" for x in ("418", "DRAIN", " ", None))
    assert (p["dfit - 812"].canonical, p["dfit - 812"].conformance) == ("FDIT-812", "nonconformant_normalised")
    assert (p["DTI-812-3B"].canonical, p["DTI-812-3B"].loop_id, p["DTI-812-3B"].suffix) == ("TDI-812-3B", "TD-812-3", "B")
    assert p["V-386 c / d"].canonical == "V-386C/D" and p["[418B]"].canonical == "418B" and p["MV-512-09"].loop_id is None


def test_fields_subjects_and_hints(spark):
    df = spark.createDataFrame([("2” – kw - 4471-B-G-RS-M-N",)], "raw string")
    assert df.select(tags.line_fields(F.col("raw")).alias("m")).first().m == {"size": "2", "service": "KW", "sequence": "4471", "spec": "B", "extra1": "G", "extra2": "RS", "unparsed_fields": "M-N"}
    rows = [("pumps P-264 C, D & E", "P-264C,P-264D,P-264E", None), ("T-90 C/D-418", "T-90C,D-418", None), ("C-77 (Jacket) and V-8", "C-77", "jacket"), ("nothing", "", None), ("Ｐ－２６４ Ａ", "P-264A", None)]
    df = spark.createDataFrame(rows, "s string, want string, part string")
    for r in df.select("want", "part", F.array_join(tags.subject_tags(F.col("s")), ",").alias("got"), tags.subject_part(F.col("s")).alias("p")).collect():
        assert (r.got, r.p) == (r.want, r.part)
    df = spark.createDataFrame([("Flushing the Northgate Header at Élan, NORTHGATE",)], "t string")
    assert df.select(tags.facility_hints(F.col("t")).alias("h")).first().h == ["flushing", "header", "northgate"]


def test_quantities_and_units(spark):
    rows = [("88", 88.0, 88.0), ("-7 to 19.5", -7.0, 19.5), ("31/-4", -4.0, 31.0), ("690/1/50", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, lo double, hi double").withColumn("q", quantity.parse_quantity(F.col("c"), F.lit("psig")))
    assert all((r.q and r.q.min, r.q and r.q.max) == (r.lo, r.hi) for r in df.collect())
    heads = [("Test pressure, barg", "barg"), ("Max temp C", "degC"), ("temperature", "degF"), ("Volume", None), ("PRESSURE (PSIG)", "psig")]
    df = spark.createDataFrame(heads, "h string, u string").withColumn("q", quantity.unit_from_header(F.col("h")))
    assert all((r.q and r.q.unit) == r.u for r in df.collect())
