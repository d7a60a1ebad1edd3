from cueloom.plans import adapters
from cueloom.sources import text_files


def test_long_ssa_lines(spark):
    text, names = "x" * 120_000 + "END", ["Pad" + str(i) for i in range(3000)]
    lines = ["[V4+ Styles]", "Format: " + ", ".join([*names, "Name", "Bold"]), "Style: " + ",".join(["0"] * 3000 + ["Last", "1"]), "[Events]", "Format: Start, End, Style, Text", "Dialogue: 0:00:01.00,0:00:02.00,Last," + text]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id long, line_no int, line string")
    style = text_files.ssa_styles(frame).first()
    assert (style.name, style.bold) == ("Last", 1) and text_files.ssa_events(frame).first().text == text


def test_long_pages(spark, tmp_path):
    html = "<p>" + "y" * 150_000 + "<b>END"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert adapters.cues_pages(spark, str(tmp_path)).first().text.endswith(html[240:])
