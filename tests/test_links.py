"""Tags, links, graph and layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import links
from quillstack.operators.history import with_derived
from quillstack.operators.layout import _draws, layout, layout_graph
from quillstack.schema import NOTE


def notes(spark, rows):
    full = [{"note_id": i, "title": t, "body": b, "created_at": 0, "updated_at": u, "tags": [], "links": [], "pinned": False, "archived": False, "locked": False, "trashed_at": x, "rev": 1} for i, t, b, u, x in rows]
    return with_derived(spark.createDataFrame(full, NOTE)).select(NOTE.names)


def one(spark, body, f):
    return spark.createDataFrame([(body,)], "body string").select(f(F.col("body"))).first()[0]


def test_tags(spark):
    body = "#Work/Plan/ and (#été) not#this #2026 #1a\n#work/plan `#code` ```\n#fenced\n``` [#x ##y # z #日本"
    assert one(spark, body, links.extract_tags) == ["work/plan", "ete", "1a", "x", "日本"]


def test_wikilinks(spark):
    found = one(spark, "[[ A  b ]] [[C|see]] [[ ]] [[D| ]] [[x\ny]] `[[no]]` [[É]] [[a B]]", links.extract_links)
    assert [(x["target"], x["key"], x["label"]) for x in found] == [("A  b", "a b", "A  b"), ("C", "c", "see"), ("D", "d", "D"), ("É", "e", "É"), ("a B", "a b", "a B")]
    assert one(spark, "[[A]] [[a]] [[B]]", links.extract_link_keys) == ["a", "b"]
    body = "é `code [[no]]` [[ A  b ]] ```\n[[no]]\n``` [[C|see]] [[ ]]x[[É]]"
    assert [body[x["start"] : x["end"]] for x in one(spark, body, links.extract_links)] == ["[[ A  b ]]", "[[C|see]]", "[[É]]"]
    assert one(spark, body, links.without_code) == "é " + " " * 13 + body[15:27] + " " * 14 + body[41:]


GRAPH = [("1", "Alpha", "[[Beta]] [[beta]] [[Nowhere]] [[Alpha]]", 50, None), ("2", "Beta", "[[Alpha]] [[Gone]]", 40, None), ("3", "beta", "[[Gamma]]", 30, None), ("4", "Gamma", "alone", 20, None), ("5", "Gone", "[[Alpha]]", 10, 1), ("6", "Solo", "[[NOWHERE]]", 5, None)]


def test_graph(spark):
    n = notes(spark, GRAPH)
    assert {tuple(r) for r in links.edges(n).collect()} == {("1", "2"), ("2", "1"), ("3", "4")}
    assert {r["key"]: r["sources"] for r in links.unresolved(n).collect()} == {"nowhere": 2, "gone": 1}
    assert [tuple(r) for r in links.invitations(n).collect()] == [("nowhere", "Nowhere"), ("gone", "Gone")] or {tuple(r) for r in links.invitations(n).collect()} == {("nowhere", "Nowhere"), ("gone", "Gone")}
    assert {r["note_id"]: r["degree"] for r in links.degrees(n).collect()} == {"1": 2, "2": 2, "3": 1, "4": 1, "6": 0}
    assert [r["note_id"] for r in links.graph_nodes(n, 3).orderBy(F.desc("degree"), F.desc("updated_at")).collect()] == ["1", "2", "3"]
    assert links.graph_stats(n, 3).first().asDict() == {"connected": 2, "shown": 3, "hidden": 2, "edges": 2}
    assert {r["note_id"] for r in links.orphans(n).collect()} == set() and links.follow(n, "nowhere", 9, "7").count() == 7 and links.follow(n, "ALPHA", 9, "7").count() == 6


def test_tag_tree(spark):
    n = notes(spark, [("1", "", "#work/a #work/b", 1, None), ("2", "", "#work", 1, None), ("3", "", "#home #work/a", 1, None), ("4", "", "#work", 1, 5)])
    tree = {r["path"]: r for r in links.tag_tree_order(links.tag_tree(n)).collect()}
    assert {p: r["notes"] for p, r in tree.items()} == {"work": 3, "work/a": 2, "work/b": 1, "home": 1}
    assert tree["work/a"]["parent"] == "work" and tree["work"]["parent"] is None and tree["work"]["place"] == 1 and tree["work/b"]["place"] == 2


def test_suggestions_and_counts(spark):
    n = notes(spark, [("1", "Roman road", "", 1, None), ("2", "The roman", "", 9, None), ("3", "Romance", "", 5, None), ("4", "Roma", "", 7, 1), ("5", " ", "", 8, None)])
    rows = links.title_suggestions(n, [("a", " ROM "), ("b", "")], 3).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["note_id"]) for r in rows] == [("a", "3"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("b", "1")]
    assert links.library_counts(n).first().asDict() == {"active": 4, "archived": 0, "trashed": 1}


@pytest.mark.parametrize("n,pairs", [(0, []), (1, []), (2, [(0, 1)]), (11, [(0, k) for k in range(1, 11)]), (40, [(k, k + 1) for k in range(39)])])
def test_layout_stays_inside_and_apart(n, pairs):
    pos, degree = layout(n, np.array(pairs), 360, 480)
    again, _ = layout(n, np.array(pairs), 360, 480)
    assert np.array_equal(pos, again) and degree.sum() == 2 * len(pairs)
    if n:
        assert (pos >= 34).all() and (pos <= np.array([326, 446])).all()
        gaps = np.sqrt(((pos[:, None] - pos[None]) ** 2).sum(-1))[np.triu_indices(n, 1)]
        assert not len(gaps) or gaps.min() > 3


def test_layout_generator_rounds_like_doubles():
    seed, out = 1, []
    for _ in range(50):
        seed = int(float(seed * 1103515245) + 12345) & 0x7FFFFFFF if seed * 1103515245 < 2**53 else int(np.float64(seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        out.append(seed / 0x7FFFFFFF)
    assert np.allclose(_draws(50, 1), out)


def test_layout_rows(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "note_id string, ord long")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "x"), ("c", "c")], "src string, dst string")
    rows = {r["note_id"]: r for r in layout_graph(nodes, e).collect()}
    assert {k: r["weight"] for k, r in rows.items()} == {"a": 2, "b": 2, "c": 0}
