"""Texts that a cut would lose parts of: pages of any depth and shape, training texts of many lines."""

from __future__ import annotations

import pytest

from vellum.llm import html_layout, quality

DEEP = 50_000
VISIBLE = {
    "<table><tr><td>a</td></tr>after<caption>cap</caption></table>": "after\ncap\na",
    "<table><tr>stray<td>a</table>": "stray\na",
    "<table><tbody><form><tr><td>cell</td></tr></form></tbody></table>": "cell",
    "<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c</table>": "a | b\nc |",
    "<table><form hidden><tr><td>no</td></tr></form><tr><td>yes</table>": "yes",
    "<table><colgroup>loose<col><tr><td>a</table>": "loose\na",
    "x<svg><title>no</title><defs/><text>one</text><text>two</text><desc>no</desc></svg>y": "x\none\ntwo\ny",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "x=1",
    "<select><option>red<option>blue</select>": "red\nblue",
    "<object data=a>fallback</object>": "fallback",
    "<div>" * 118 + "<table><tr><td>in</table><textarea>area</textarea>": "in\n\narea",
    "<b>" * DEEP + "<table><tr><td>in</table><textarea>area</textarea>" + "</i></b>" * DEEP: "in\n\narea",
}


@pytest.mark.parametrize("html", VISIBLE, ids=range(len(VISIBLE)))
def test_html_keeps_visible_text(html):
    assert html_layout.page_text(html) == VISIBLE[html]


def test_html_of_any_depth():
    for tag in ("div", "blockquote", "ul><li", "table><tr><td", "svg", "details open"):
        text = html_layout.page_text(f"<{tag}>" * 2000 + "deep")
        assert text.count("deep") == 1 and text.count("-") == (2000 if tag == "ul><li" else 0)


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    good = "\n".join("The river runs past the old mill and the town." for _ in range(201))
    docs = spark.createDataFrame([(k, good + ("" if k % 2 else "\n" + "\n".join(["$$$ WIN!!! @@@ ###"] * 300))) for k in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id bigint, quality int")
    score = lambda: {x["doc_id"]: x["score"] for x in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all((x > 0.5) == bool(k % 2) for k, x in score().items())
    # fewer documents once they have the lines, never parts of them
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, size, first, label: seen.append(len(first) - 1) or quality.Field(x[0], x[:2, :2]))
    monkeypatch.setattr(quality, "SAMPLE_TOTAL_LINES", 600)
    quality.train(docs, labels)
    assert 2 <= seen[0] <= 3
