"""Sanitisation over whole texts."""

from riskbench.llm import personal_data

DOCS = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_terms_that_reveal_go_wherever_they_stand(spark):
    filler = [(100 + k, f"common words mail here number {'abcdefghij'[k % 10] * 4} alone") for k in range(80)]
    far = "common zyxware mail ann@site.org here " + "common words mail here " * 20 + "zyxware alone Qqqware"
    rows = [(50 + k, far) for k in range(4)] + [(70, "Zyxware alone qqqware here")] + filler
    out = {r["doc_id"]: r["text"] for r in personal_data.sanitise(docs_of(spark, rows)).collect()}
    assert "zyx" not in out[50] and "Qqq" not in out[50] and out[50].endswith("here <term> alone <term>") and out[70] == "<term> alone <term> here"
    found = {r["doc_id"]: r for r in personal_data.find(docs_of(spark, rows)).collect()}
    assert found[50]["n_terms"] == 3 and found[70]["spans"] == "term:0:7,term:14:21" and found[100]["n_terms"] == 0
    assert {i for i, _ in rows} == set(out) and out[100] == filler[0][1]


def test_each_text_is_keyed_once_in_a_pass_of_its_own(spark):
    # Two Python steps in one task take two workers, which stay and fill the executors of all later stages.
    rows = [(1, "mail ann@site.org now"), (1, "mail ann@site.org now"), (2, None), (None, "call +31 20 123 4567 today"), (3, "nothing here"), (4, "")]
    out = personal_data.sanitise(docs_of(spark, rows))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    want = [(1, "mail <email> now"), (1, "mail <email> now"), (2, None), (None, "call <phone> today"), (3, "nothing here"), (4, "")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
