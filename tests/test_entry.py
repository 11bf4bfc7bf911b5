"""The registered queries against their SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__
from quillstack import catalog
from quillstack.functions import markdown as md
from quillstack.functions import tokens as tk

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [n for n in catalog.ORACLES if not n.startswith(("search_", "index_", "stem_e", "prefix", "fuzzy", "decomp", "recomp", "trigram"))] + ["search_bm25f_multi", "search_phrases", "fuzzy_expand"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert ours == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    spark.catalog.clearCache()


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_editor_operations_reach_every_note_inside_its_text(spark):
    notes = {r["note_id"]: r["body"] for r in catalog.notes(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tails = {str(k): notes[str(k)][len(t) :] for k, t in texts.items()}
    rows = catalog.QUERIES["editor_operations"](spark, SF).collect()
    inside = [r for r in rows if r["start"] <= len(notes[r["note_id"]]) - len(tails[r["note_id"]])]
    assert len(rows) == 12 * len(notes) and len(inside) == 6 * len(notes) and {r["note_id"] for r in inside} == set(notes)
    assert all(r["text"].endswith(tails[r["note_id"]]) for r in inside if r["op"] != "task")


def test_token_offsets_and_inline_spans_reach_every_note(spark):
    notes = {r["note_id"]: r["body"] for r in catalog.notes(spark, SF).collect()}
    tokens = [tuple(r) for r in catalog.QUERIES["token_offsets"](spark, SF).collect()]
    assert sorted(tokens) == sorted((k, *t) for k, body in notes.items() for t in tk.tokenize(body))
    spans = catalog.QUERIES["markdown_inline"](spark, SF).collect()
    assert len(spans) == sum(len(md.parse_inline(x)) for body in notes.values() for x in body.split("\n"))
    assert {r["note_id"] for r in spans} == set(notes)
