"""Pages are parsed piece by piece."""

from fieldloom.operators import html as H


def test_pages_are_held_in_small_pieces(spark, monkeypatch):
    pages = [(i, f"https://x.example/{i}/", f"<title>t{i}</title><body><a href='/a{i}'>l</a><table><tr><td>{'c' * i}</td></tr></table>") for i in range(40)] + [(90, None, None), (91, "u", "")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").coalesce(1)
    monkeypatch.setattr(H, "PIECE", 400)  # a few pages at a time
    parsed = H.parse_pages(df)
    assert parsed.columns == ["page_id", "url", "title", "text", "focus", "links", "tables"]
    got = {r.page_id: r for r in parsed.collect()}
    assert len(got) == 42 and got[90].text == "" and got[91].links == []
    assert all(got[i].title == f"t{i}" and got[i].links == [f"https://x.example/a{i}"] and got[i].text == "\n".join(["l", "c" * i][: 1 + (i > 0)]) for i in range(40))
    assert all(got[i].tables == ([[["c" * i]]] if i else []) for i in range(40))
    # One step of the plan takes batches and gives batches, so a task holds no Series of whole batches.
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
