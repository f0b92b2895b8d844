"""The driver's tables as terms, entities and seeds, against plain Python over the whole tables."""

import re

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.functions import constants as K
from corpuskit.operators import placement as P
from corpuskit.plans import graph_queries as Q, views as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILL = "alpha beta. " * 60


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    texts = [FILL + "zebra quartz walnut", FILL + "zebra quartz", FILL + "Walnut abc", "zebra", None, ""]
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t, "en", f"src{i % 2}", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{d}/documents.parquet")
    return texts, d


def words(text):
    return {w for w in re.findall("[a-z]+", (text or "").lower()) if len(w) > 3}


def test_terms_of_whole_texts(spark, long_texts):
    texts, d = long_texts
    rows = W.terms(spark, d).collect()
    assert len(rows) == len(set(rows))
    assert {(x.doc_id, x.source, x.term) for x in rows} == {(i, f"src{i % 2}", w) for i, t in enumerate(texts) for w in words(t)}


def test_folder_overlap_of_whole_texts(spark, long_texts):
    texts, d = long_texts
    generic = set(K.GENERIC_TERMS)
    docs = {i: words(t) - generic for i, t in enumerate(texts)}
    folders = {f"src{k}": {w for w in set().union(*docs.values()) if sum(w in v for i, v in docs.items() if i % 2 == k) >= 2} for k in (0, 1)}
    want = {(i, f): round(len(t & u) / min(len(t), len(u)), 6) for i, t in docs.items() for f, u in folders.items() if t & u}
    assert {(x.doc_id, x.folder): x.graph for x in Q.folder_overlap(spark, d).collect()} == want


@pytest.mark.parametrize("most", [0, 2, 3])
def test_common_terms_of_many_folders_are_counted_in_tasks(spark, long_texts, monkeypatch, most):
    """With more terms than are broadcast, the counts of common and of other terms add up; common ones are not joined."""
    texts, d = long_texts
    want = {tuple(x) for x in Q.folder_overlap(spark, d).collect()}
    monkeypatch.setattr(P, "BROADCAST_TERMS", most)
    found = Q.folder_overlap(spark, d)
    assert {tuple(x) for x in found.collect()} == want and ("MapInArrow" in found._jdf.queryExecution().toString()) == (most > 2)


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    tables = {
        "part": ("p_partkey long, p_name string, p_size int, p_brand string", [(i, f"name{i // 2}", 10, f"brand{i % 2}") for i in range(2100)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(i, f"supplier_{i}", i % 4) for i in range(110)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long", [(0, "customer_0", 3)]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(i, f"nation_{i}", 0) for i in range(4)]),
        "region": ("r_regionkey long, r_name string", [(0, "region_0")]),
        "orders": ("o_orderkey long, o_custkey long, o_totalprice double", [(i, 0, 7.0) for i in (1, 2050, 2101)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_all_parts_are_entities(spark, many_parts):
    assert {x.id for x in W.entities(spark, many_parts).where("entity_type = 'Product'").collect()} == {f"p{i}" for i in range(2100)}
    links = {(x.source_id, x.target_id) for x in Q.shared_entity_links(spark, many_parts).collect()}
    assert {tuple(sorted((f"p{i}", f"p{i + 1}"))) for i in range(0, 2100, 2)} == links


def test_links_reach_all_parts(spark, many_parts):
    owns = {(x.source_id, x.target_id) for x in Q.merged_edges(spark, many_parts).where("relationship_type = 'OWNS'").collect()}
    assert owns == {("c0", "p1"), ("c0", "p2051")}


def test_seeds_grow_with_the_tables(spark, many_parts):
    assert {x.seed for x in Q.k_hop_neighbourhood(spark, many_parts).collect()} == {"s0", "s50", "s100"}
    assert {x.seed for x in Q.entity_context_edges(spark, many_parts).collect()} == {f"n{i}" for i in range(4)}
    found = {x.pair_id: x.found for x in Q.shortest_paths(spark, many_parts).collect()}
    assert found == {i: i % 4 != 3 for i in (0, 1, 2, 3, 50, 51, 52, 53, 100, 101, 102, 103)}


def test_common_terms_are_counted_some_at_a_time(spark, long_texts, monkeypatch):
    """However few terms a task lists at a time, counts of a document cut in between add up."""
    texts, d = long_texts
    want = {tuple(x) for x in Q.folder_overlap(spark, d).collect()}
    holders = P._Holders(pa.table({"folder": ["f", "g", "f", "g"], "term": ["a", "a", "b", "c"]}), "folder")
    listed = []
    repeat = np.repeat
    monkeypatch.setattr(P, "TERMS_AT_ONCE", 2)
    monkeypatch.setattr(P.np, "repeat", lambda a, n: (listed.append(int(np.sum(n))), repeat(a, n))[1])
    row, which, n = holders.shared(pa.array([["a", "b", "c", "x"], [], ["c"], ["a"]]))
    assert list(zip(row.tolist(), which.tolist(), n.tolist())) == [(0, 0, 2), (0, 1, 2), (2, 1, 1), (3, 0, 1), (3, 1, 1)]
    assert want and max(listed[1:]) <= 2
