"""Lines too variable for a template, in the pipeline's line dedup."""

from tidemark.llm import line_dedup


def test_verbatim_lines_without_a_template_go(spark):
    log = "2024-01-02 12:00:01 10.0.0.7 8080 8443 GET from host"
    passage = "这一整行文字在许多文档中一字不差地重复出现因此应当删除"
    text = [f"{log}\n{passage}\nThe.\nown words of one", f"  {log.replace(' ', '  ')}\nown words of two", f"{log.replace('07', '08').replace('8080', '8081')}\nThe.",
            f"own words of four\n{passage}", f"1 2 3\n{passage[:8]}", f"1 2 3\n{passage[:8]}\n1 2 4"]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(df).collect()}
    assert got == {0: text[0], 1: "own words of two", 2: text[2], 3: "own words of four", 4: text[4], 5: f"{passage[:8]}\n1 2 4"}
    assert {r.doc_id: r.text for r in line_dedup.report(df).collect()} == dict(enumerate(text))  # as its SQL says
