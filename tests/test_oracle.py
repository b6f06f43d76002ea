"""Every query with SQL gives the rows of its SQL; every other query runs."""

import pytest

from quillgraph import catalog
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def rows_by_document(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r.document_id, []).append(tuple(r[n] for n in names))
    return out


def test_entity_clusters_equal_all_pairs(spark):
    """The query's clusters against the greedy definition over all pairs of a document's entities."""
    from quillgraph.operators import chunking, entities
    from tests.test_graph import greedy

    found = rows_by_document(entities.heuristic_entities(chunking.sentence_chunks(catalog.normal_docs(spark, DATA))), "ord", "name", "label", "chunk_id")
    got = rows_by_document(catalog.entity_clusters(spark, DATA), "cluster", "member", "name", "label")
    assert got.keys() == found.keys()
    for d, rows in found.items():
        _, names, labels, chunks = zip(*sorted(rows), strict=True)
        flat = [(k, names[i], labels[i]) for k, g in enumerate(greedy(names, labels, chunks)) for i in g]
        assert [(c, n, x) for c, _, n, x in sorted(got[d], key=lambda r: r[1])] == flat


def test_recursive_chunks_by_hand(spark):
    """No chunk is over the size, together they hold all words, and each is found at its offsets."""
    texts = {r.document_id: r.text for r in catalog.normal_docs(spark, DATA).collect()}
    for d, rows in rows_by_document(catalog.recursive_chunks(spark, DATA), "chunk_id", "text", "start_index", "end_index").items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert all(len(t.split()) <= 200 and e - s == len(t) for _, t, s, e in rows)
        words = [w for _, t, _, _ in rows for w in t.split()]
        assert set(words) == set(texts[d].split()) and len(words) >= len(texts[d].split())


def test_graph_json_holds_the_graph(spark):
    import json

    from quillgraph.sources import narrative, store

    nodes, edges = narrative.nodes(spark, DATA), narrative.edges(spark, DATA)
    want_n, want_e = rows_by_document(nodes, "id"), rows_by_document(edges, "id")
    for r in store.graph_json(nodes, edges).collect():
        g = json.loads(r.graph_data)
        assert sorted(n["id"] for n in g["nodes"]) == sorted(x for x, in want_n[r.document_id])
        assert sorted(e["id"] for e in g["edges"]) == sorted(x for x, in want_e[r.document_id])


def test_graph_json_parts_joined_are_the_whole(spark, tmp_path):
    import json

    from quillgraph.sources import narrative, store

    nodes, edges = narrative.nodes(spark, DATA), narrative.edges(spark, DATA)
    store.write_graph_json(nodes, edges, str(tmp_path / "g"), rows=7)
    got = {}
    for r in sorted(spark.read.json(str(tmp_path / "g")).collect(), key=lambda r: (r.document_id, r.kind, r.part)):
        part = json.loads(r.data)
        assert len(part) == r.rows <= 7
        got.setdefault(r.document_id, {}).setdefault(r.kind, []).extend(part)
    want = {r.document_id: {k: v for k, v in json.loads(r.graph_data).items() if v} for r in store.graph_json(nodes, edges).collect()}
    assert got == want


def test_plans_compute_shared_tables_once(spark):
    """Provenance and the whole pipeline read each input a few times, not once for each branch."""
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(catalog.provenance(spark, DATA)) <= 20 and scans(catalog.pipeline_graph(spark, DATA)) <= 4
