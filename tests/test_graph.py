import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import similarity as S
from quillgraph.operators import entities, graph, relations, resolution, windows
from quillgraph.operators.chunking import chunk_metrics, sentence_chunks
from quillgraph.plans import pipeline, questions, reads
from quillgraph.sources import files, models, store
from quillgraph.streaming import ingest

TWO = "Elarin lives in Whisperwood. Moonkeep is based in Whisperwood."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "document_id long, text string")


@pytest.fixture(scope="module")
def built(spark):
    g = pipeline.process(docs(spark, TWO, "", "Elarin lives in Whisperwood."))
    # small local tables from here on: each test plans its own query, not the pipeline again
    return g, *(spark.createDataFrame(df.collect(), df.schema).coalesce(1) for df in (g.nodes, g.edges))


def test_pipeline(built):
    g, nodes, edges = built
    assert {r.name for r in nodes.where("document_id = 1").collect()} == {"Elarin", "Whisperwood", "Moonkeep"}
    assert edges.where("document_id = 1").count() == 12
    assert {r.type for r in edges.collect()} == {"LIVES_IN", "LOCATED_IN"}
    m = graph.graph_metrics(nodes, edges).where("document_id = 1").first()
    assert (m.nodes, m.edges, m.isolated_nodes, m.components, m.largest_component, m.average_degree, m.density) == (3, 12, 0, 1, 3, 2.0, 4.0)
    zero = g.metrics.where("document_id = 2").first()
    assert (zero.chunk_count, zero.total_words, zero.avg_words) == (0, 0, 0.0)


def test_stage_logs(spark):
    got = [r.stage for r in pipeline.stage_logs(docs(spark, "x")).orderBy("nth").collect()]
    assert got[0] == "START" and got[-1] == "COMPLETE" and "CHUNKING" in got


def test_process_logs_equal_a_recount(spark, tmp_path):
    """Counts per stage and document, and of all rows as they passed; appended as log rows and exported."""
    d = spark.createDataFrame([(1, TWO), (2, "Ann Lee lives in Oak Town."), (3, "")], "document_id long, text string")
    g = pipeline.process(d)
    tables = {"CHUNKING": g.chunks, "ENTITY_EXTRACTION": g.entities, "ENTITY_RESOLUTION": g.entities, "GRAPH_BUILDING": g.nodes}
    assert {s.name: s.rows for s in g.stages} == {k: t.count() for k, t in tables.items()} and all(s.seconds > 0 for s in g.stages)
    store.append(pipeline.process_logs(g), str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    got = {(r.document_id, r.stage): int(r.message.split()[0]) for r in logs.collect()}
    assert got == {(i, k): t.where(F.col("document_id") == i).count() for k, t in tables.items() for i in (1, 2, 3)}
    (text,) = [r.export for r in reads.log_export(logs).collect() if r.document_id == 2]
    assert [x.split("] ")[1][1:] for x in text.split("\n")] == list(tables)


def test_analysis_text_is_searched(spark):
    w = spark.createDataFrame([(1, 0, "Elarin entered Whisperwood. He lives in the village.", 0, 52, "Elarin entered Whisperwood. Elarin lives in the village.", [])], "document_id long, chunk_id int, text string, start_index int, end_index int, analysis_text string, source_chunk_ids array<int>")
    e = spark.createDataFrame([(1, 0, "Person", "Elarin", 0, 0, 0), (1, 1, "Location", "Whisperwood", 0, 0, 0)], "document_id long, ord long, label string, name string, chunk_id int, start_index int, end_index int")
    assert {r.type for r in relations.heuristic_relations(w, e).collect()} == {"LIVES_IN"}


def test_chunk_metrics(spark):
    d = docs(spark, "one two three. one two.")
    m = chunk_metrics(d, sentence_chunks(d)).first()
    assert (m.chunk_count, m.total_words, m.avg_words, m.min_words, m.max_words) == (2, 5, 2.5, 2, 3)


def test_resolved_texts_only_where_counts_agree(spark):
    c = sentence_chunks(docs(spark, "He ran. It fell.", "He ran."))
    r = sentence_chunks(docs(spark, "Bo ran. Cup fell.", "Bo ran. On."))
    got = {(x.document_id, x.chunk_id): x.analysis_text for x in windows.with_resolved_texts(c, r).collect()}
    assert got == {(1, 0): "Bo ran.", (1, 1): "Cup fell.", (2, 0): None}


def greedy(names, labels, chunks):
    """All pairs, in order."""
    f = [S.surface(n) for n in names]
    sim = lambda i, j: S.score(f[i], f[j], chunks[i] == chunks[j], labels[i] == labels[j] == "Person")
    order = []
    for label in dict.fromkeys(labels):
        groups = []
        for i in (i for i, x in enumerate(labels) if x == label):
            for g in groups:
                if any(label == "Person" and S.surname_alias(f[i], f[j]) for j in g) or max(sim(i, j) for j in g) >= S.THRESHOLDS.get(label, S.OTHER):
                    g.append(i)
                    break
            else:
                groups.append([i])
        order += groups
    merged = []
    for g in order:
        for h in merged:
            if max(sim(i, j) for i in g for j in h) >= S.CROSS_LABEL:
                h.extend(g)
                break
        else:
            merged.append(list(g))
    return merged


def test_blocking_equals_all_pairs():
    r = random.Random(3)
    words = ["Smith", "Smiths", "John", "Jane", "City", "Cities", "The Hobbit", "Hobbit", "Box", "Boxes", "Apple", "APPLE", "é", "ü"]
    for _ in range(400):
        n = r.randint(1, 12)
        names = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n)]
        labels = [r.choice(["Person", "Concept", "Organization", "Location"]) for _ in range(n)]
        chunks = [r.randint(0, 2) for _ in range(n)]
        assert resolution.cluster(names, labels, chunks) == greedy(names, labels, chunks)


def test_order_decides_between_surnames():
    at = [0, 1, 2]
    assert resolution.cluster(["John Smith", "Jane Smith", "Smith"], ["Person"] * 3, at) == [[0, 2], [1]]
    assert resolution.cluster(["Smith", "John Smith", "Jane Smith"], ["Person"] * 3, at) == [[0, 1, 2]]


def property_graph(spark, edge_pairs, isolated=()):
    names = sorted({x for e in edge_pairs for x in e[:2]} | set(isolated))
    nodes = spark.createDataFrame([(f"1:X:{n}", n, "X", 1) for n in names], "id string, name string, label string, document_id long")
    rows = [(f"1:X:{a}-{t}-1:X:{b}", f"1:X:{a}", f"1:X:{b}", a, b, "X", "X", t, 1) for a, b, t in edge_pairs]
    edges = spark.createDataFrame(rows, "id string, source string, target string, source_name string, target_name string, source_label string, target_label string, type string, document_id long")
    return nodes, edges


def test_paths(spark):
    nodes, edges = property_graph(spark, [("a", "b", "R"), ("b", "c", "R"), ("c", "d", "R"), ("d", "e", "R"), ("a", "x", "S"), ("x", "c", "S")])
    p = graph.shortest_path(nodes, edges, "A", "c").first()
    assert p.path_node_ids == ["1:X:a", "1:X:b", "1:X:c"] and p.path_length == 2
    assert graph.shortest_path(nodes, edges, "a", "d").first().path_length == 3
    assert graph.shortest_path(nodes, edges, "a", "e").count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randint(0, 60):02d}", f"m{r.randint(0, 60):02d}", "R") for _ in range(55)] + [(f"p{i:02d}", f"p{i + 1:02d}", "R") for i in range(30)]
    nodes, edges = property_graph(spark, pairs, ["alone"])
    root = {r_.id: r_.id for r_ in nodes.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        x, y = find(f"1:X:{a}"), find(f"1:X:{b}")
        root[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in graph.components(nodes, edges).collect()}
    assert got == {k: find(k) for k in root}


def test_summary_of_an_isolated_node(spark):
    nodes, edges = property_graph(spark, [("a", "b", "R")], ["alone"])
    got = graph.summary(nodes, edges, "alone").first()
    assert [tuple(x) for x in got.related_entities] == [(None, None, None)]


def by_hand(question, names):
    """Longest names first, by trying every place."""
    low, taken, out = question.lower(), set(), []
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    spans = [(-len(n), i, n) for n in names for i in range(len(low)) if n and low.startswith(n.lower(), i) and not (i and word(i - 1)) and not word(i + len(n))]
    for minus, i, n in sorted(spans):
        if not taken & set(range(i, i - minus)):
            out.append(n)
            taken |= set(range(i, i - minus))
    return out


def test_matched_names(spark):
    cases = {
        1: (["Major", "Old Major", "old", "or"], ["Is Old Major like Major?", "majority", "", "MAJOR,old major;Old-Major"]),
        2: (["C++", "++", "a b", "b c", "B", "é", "São Paulo"], ["c++ or ++?", "a b c", "a  b c b", "École é", "in são paulo_ são paulo"]),
        3: ([], ["nothing"]),
    }
    asked = spark.createDataFrame([(d, i, q) for d, (_, qs) in cases.items() for i, q in enumerate(qs)], "document_id long, question_id long, question string")
    names = spark.createDataFrame([(d, n) for d, (ns, _) in cases.items() for n in ns], "document_id long, name string")
    got = {(r.document_id, r.question_id): r.matched for r in questions.matched_names(asked, names).collect()}
    assert got == {(d, i): by_hand(q, ns) for d, (ns, qs) in cases.items() for i, q in enumerate(qs)}
    assert got[1, 0] == ["Old Major", "Major"] and got[1, 1] == []


def test_matched_names_shuffle_no_text_for_each_word(spark):
    """Questions and names are dealt once; repeated rows, ids that are null and further columns are kept."""
    import random

    from tests.conftest import shuffled

    rng = random.Random(4)
    word = lambda: f"{rng.getrandbits(64):016x}"
    rows = [(d, i, " ".join(word() for _ in range(200)), "more") for d in range(20) for i in range(3)]
    names = [(d, w) for d, i, q, _ in rows if i == 1 for w in q.split()[::9]] + [(None, rows[0][2].split()[0])]
    rows += [rows[4], (None, 1, rows[0][2], "x"), (1, None, rows[4][2], "y"), (2, 9, None, "z")]
    asked = spark.createDataFrame(rows, "document_id long, question_id long, question string, other string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        got = questions.matched_names(asked, spark.createDataFrame(names, "document_id long, name string")).collect()
        sent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(d, i, q, o, [w for w in q.split() if (d, w) in set(names)] if i == 1 and d is not None else []) for d, i, q, o in rows if q] + [(2, 9, None, "z", [])]
    assert sorted(map(str, ((r.document_id, r.question_id, r.question, r.other, list(r.matched)) for r in got))) == sorted(map(str, want))
    assert sent < 1.5 * sum(len(q or "") for _, _, q, _ in rows)


def test_matched_names_grow_with_the_question(spark):
    """A question of 6,000 words, each a name, takes no more than a few times what one of 600 takes."""
    import time

    took = {}
    for n in (600, 6_000):
        words = [f"w{i}x" for i in range(n)]
        asked = spark.createDataFrame([(1, 1, " ".join(words))], "document_id long, question_id long, question string")
        names = spark.createDataFrame([(1, w) for w in words], "document_id long, name string")
        for _ in range(2):
            start = time.time()
            got = questions.matched_names(asked, names).first().matched
            took[n] = time.time() - start
        assert got == sorted(words, key=lambda w: (-len(w), int(w[1:-1])))
    assert took[6_000] < 5 * max(took[600], 1)


def test_matched_names_across_batches(spark):
    """Rows of one question, and a document's names, may come in several batches; the places in all texts of one
    question count for each of its rows, as in the SQL."""
    rows = [(1, 1, "Ann met Bob"), (1, 1, "Bob met Old Tom"), (1, 1, "nobody"), (1, 2, "Ann"), (2, 1, "Ann"), (2, None, "Eve"), (None, 1, "Eve"), (2, 2, None)]
    asked = spark.createDataFrame(rows, "document_id long, question_id long, question string")
    names = spark.createDataFrame([(1, "Ann"), (1, "Bob"), (1, "ann"), (1, "Old Tom"), (1, "Tom"), (2, "Eve")], "document_id long, name string")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for size in ("1", "2", "100"):
            spark.conf.set(conf, size)
            got = sorted(((r.document_id, r.question_id, r.question, list(r.matched)) for r in questions.matched_names(asked, names).collect()), key=str)
            want = {(1, 1): ["Old Tom", "Ann"], (1, 2): ["Ann"]}  # both Bobs overlap what stands there in the other text
            assert got == sorted(((d, q, t, want.get((d, q), [])) for d, q, t in rows), key=str)
    finally:
        spark.conf.set(conf, before)


def test_texts_are_made_once(spark):
    """No step puts a text's making into a lambda or a list of phrases, where it would run for each of their elements."""
    from quillgraph.functions import text as X
    from quillgraph.operators import chunking

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([(1, "Ann lives in  Oak Town. Bob met Ann.")], "document_id long, text string").repartition(1)
    normal = X.normalized(docs)
    for chunks in (chunking.sentence_chunks(normal, ahead=True), chunking.sentence_chunks(normal), chunking.paragraph_chunks(normal)):
        assert plan(chunks).count(" AS text#") >= 2
    w = windows.adjacent_windows(chunking.sentence_chunks(normal, ahead=True))
    e = entities.heuristic_entities(chunking.sentence_chunks(normal))
    seen, cut = [], relations.cut
    try:
        relations.cut = lambda df: seen.append(plan(df)) or cut(df)
        got = {(r.source, r.target, r.type) for r in relations.heuristic_relations(w, e).collect()}
    finally:
        relations.cut = cut
    assert {("Ann", "Oak Town", "LIVES_IN"), ("Bob", "Ann", "MET")} <= got
    assert len(seen) == 1 and "Contains(lower" not in seen[0]


def test_entities_alone_meet_no_others(spark):
    """An entity alone in its cluster has the form that the aggregates give, and isn't shuffled for it."""
    from tests.conftest import shuffled

    odd = [(1, 0, "Person", "Ann Lee", 0), (1, 0, "Person", "Lee", 1), (1, 1, "Concept", "The Boxes", 2), (1, 2, "Thing", " ABC Cities ", 3), (1, 3, "Organization", "Oak Labs", 4), (1, 4, "Person", "The Boxes", 5), (1, 5, "Location", "...", 6), (2, 0, "Concept", "Box", 0), (2, 0, "Location", "Boxes", 1)]
    members = spark.createDataFrame(odd, "document_id long, cluster int, label string, name string, member int")
    sizes = members.groupBy("document_id", "cluster").agg({"*": "count"}).toDF("document_id", "cluster", "size")
    rows = lambda df: sorted((r.document_id, r.cluster, r.canonical_name, r.canonical_label, list(r.label_counts.items()), r.aliases) for r in df.collect())
    assert rows(resolution.canonical_forms(members.join(sizes, ["document_id", "cluster"]))) == rows(resolution.canonical_forms(members))

    n = 4_000
    found = spark.createDataFrame([(i % 10, i, "Concept", f"Word{i}x", i, 0, 9) for i in range(n)], "document_id long, ord long, label string, name string, chunk_id int, start_index int, end_index int")
    clusters = resolution.entity_clusters(found)
    before = shuffled(spark)
    clusters.write.format("noop").mode("overwrite").save()
    once = shuffled(spark) - before
    members = resolution.cut(resolution.sized_clusters(found))
    before = shuffled(spark)
    forms = resolution.canonical_forms(members)
    assert forms.count() == n
    assert shuffled(spark) - before < once / 4


def test_offsets_grow_with_the_text(spark):
    """A text of a million sentences has the offsets that its parts' lengths add up to, in time like that of ten of a
    tenth each."""
    import time

    from pyspark.sql import functions as F

    from quillgraph.operators import chunking

    took = {}
    for n in (100_000, 1_000_000):
        d = spark.range(1).select(F.col("id").alias("document_id"), F.repeat(F.lit("Ab c. "), F.lit(n)).alias("text"))
        for _ in range(2):
            start = time.time()
            got = chunking.sentence_chunks(d).agg(F.count("*"), F.count_if(F.col("start_index") == F.col("chunk_id") * 5), F.max("end_index")).first()
            took[n] = time.time() - start
        assert tuple(got) == (n, n, 5 * n)
    assert took[1_000_000] < 25 * max(took[100_000], 0.2)


def test_engine(spark, built):
    _, nodes, edges = built
    model = models.StubModel(lambda p: "```sql\nSELECT name FROM kg_nodes ORDER BY name\n```" if "Spark SQL" in p else "an answer")
    e = questions.Engine(spark, nodes, edges, model)
    got = e.ask(1, "What is Whisperwood?")
    assert got["question_analysis"]["intent"] == questions.BASIC and got["rows"] == [{"entity_name": "Whisperwood", "label": "Concept"}]
    assert got["highlight"]["node_ids"] == ["1:Concept:Whisperwood"] and got["provenance"][0]["title"] == "Whisperwood (Concept)"
    path = e.ask(1, "How is Elarin related to Whisperwood?")
    assert path["question_analysis"]["matched_entities"] == ["Whisperwood", "Elarin"] and path["rows"][0]["path_length"] == 1
    assert e.ask(1, "Who is central in the document?")["question_analysis"]["ranking_basis"] == "degree"
    assert e.ask(1, "List all names.")["answer"] == "Elarin, Moonkeep, Whisperwood"


def test_engine_repairs_once(spark, built):
    _, nodes, edges = built
    said = iter(["SELECT nothing FROM kg_nodes", "SELECT count(*) AS n FROM kg_nodes"])
    e = questions.Engine(spark, nodes, edges, models.StubModel(lambda p: next(said)))
    assert e.ask(1, "List them")["answer"] == "3"


@pytest.mark.parametrize("query", ["DROP TABLE kg_nodes", "SELECT * FROM other", "INSERT INTO kg_nodes SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT * FROM range(5)", "SET x = 1"])
def test_guard(spark, built, query):
    built[1].createOrReplaceTempView("kg_nodes")
    with pytest.raises(ValueError):
        questions.guarded(spark, query, {"kg_nodes"})


@pytest.mark.parametrize("query", [
    "SELECT java_method('java.lang.Math', 'max', 1, 2) FROM kg_nodes",
    "SELECT reflect('java.lang.Math', 'max', 1, 2) FROM kg_nodes",
    "SELECT name FROM kg_nodes WHERE id IN (SELECT `java_method`('java.lang.System', 'getProperty', 'user.dir'))",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1) SELECT * FROM a",
    "SELECT (SELECT max(x) FROM secret) AS m FROM kg_nodes",
    "SELECT input_file_name() FROM kg_nodes",
    "SELECT 1) AS a; DROP TABLE kg_nodes --",
    "SELECT * FROM global_temp.gsecret",
    "SELECT name, (SELECT max(x) FROM global_temp.gsecret) AS m FROM kg_nodes",
    "WITH kg AS (SELECT x AS name FROM global_temp.grows) SELECT name FROM kg",
    "SELECT name FROM kg_nodes WHERE name IN (SELECT x FROM global_temp.grows)",
    "SELECT name FROM spark_catalog.default.kg_nodes",
])
def test_guard_has_no_way_round(spark, built, query):
    built[1].createOrReplaceTempView("kg_nodes")
    spark.range(3).toDF("x").createOrReplaceTempView("secret")
    spark.range(3).toDF("x").createOrReplaceGlobalTempView("gsecret")
    spark.createDataFrame([("a",)], "x string").createOrReplaceGlobalTempView("grows")
    with pytest.raises(ValueError):
        questions.guarded(spark, query, {"kg_nodes"})


@pytest.mark.parametrize("query", ["SELECT label, count(*) AS n FROM kg_nodes GROUP BY label ORDER BY n DESC LIMIT 3", "SELECT a.name FROM kg_nodes a JOIN kg_nodes b ON a.id = b.id WHERE lower(a.name) LIKE '%e%' AND b.id IN (SELECT id FROM kg_nodes)", "SELECT name, row_number() OVER (ORDER BY id) AS k FROM kg_nodes LATERAL VIEW explode(aliases) t AS x", "SELECT DISTINCT upper(trim(name)) AS n FROM kg_nodes UNION SELECT 'x'"])
def test_guard_lets_common_reads_pass(spark, built, query):
    built[1].createOrReplaceTempView("kg_nodes")
    assert questions.guarded(spark, query, {"kg_nodes"}).count() > 0


def test_guard_lets_reads_pass(spark, built):
    built[1].createOrReplaceTempView("kg_nodes")
    assert questions.guarded(spark, "WITH c AS (SELECT name FROM kg_nodes) SELECT count(*) AS n FROM c", {"kg_nodes"}).first().n > 0


def test_answered_entities(spark):
    rows = [(1, 0, 0, 9, 'x {"entities": [{"label": "Person", "name": " Ann "}, {"label": "Alien", "name": "Zed"}, {"label": "", "name": "No"}, {"label": "person", "name": "zed"}]} y')]
    got = entities.answered_entities(spark.createDataFrame(rows, "document_id long, chunk_id int, start_index int, end_index int, answer string"))
    assert {(r.label, r.name) for r in got.collect()} == {("Person", "Ann"), ("Concept", "Zed")}


def test_store_replaces_documents(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path))
    nodes, edges = property_graph(spark, [("a", "b", "R")])
    more = nodes.withColumn("document_id", F.lit(2).cast("long"))
    s.save(spark.createDataFrame([(1,), (2,)], "document_id long"), nodes.union(more), edges)
    assert s.read("nodes").count() == 4
    s.save(spark.createDataFrame([(1,)], "document_id long"), nodes.where("name = 'a'"), edges.limit(0))
    assert {(r.document_id, r.name) for r in s.read("nodes").collect()} == {(1, "a"), (2, "a"), (2, "b")}
    s.delete(spark.createDataFrame([(2,)], "document_id long"))
    assert {(r.document_id, r.name) for r in s.read("nodes").collect()} == {(1, "a")}
    # another object reads what this one wrote, tables without rows too, and earlier folders may go
    t = store.GraphStore(spark, str(tmp_path))
    t.compact(times=100)
    t.vacuum()
    assert t.read("nodes").count() == 1 and t.read("edges").count() == 0 and t.read("edges").columns == edges.columns
    assert [e["kind"] for e in t.state()["entries"]] == ["rows"] and len(list(tmp_path.glob("versions/*.json"))) == 1
    t.clear()
    assert s.read("nodes").count() == 0
    with pytest.raises(ValueError):
        store.GraphStore(spark, str(tmp_path / "none")).read("nodes")


def test_store_keeps_what_it_had_if_a_write_fails(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path))
    nodes, edges = property_graph(spark, [("a", "b", "R")])
    one = spark.createDataFrame([(1,)], "document_id long")
    s.save(one, nodes, edges)
    with pytest.raises(Exception, match="broken"):
        s.save(one, nodes.limit(0), edges.withColumn("type", F.raise_error(F.lit("broken")).cast("string")))
    assert s.read("nodes").count() == 2 and s.read("edges").count() == 1


def test_store_writes_only_the_rows_of_a_change(spark, tmp_path):
    """One document of ten thousand: its rows and its id are written; a status is written without text or graph."""
    s = store.GraphStore(spark, str(tmp_path))
    rows = spark.range(10_000).select(F.col("id").alias("document_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("pending").alias("status"), F.lit(None).cast("int").alias("progress"))
    s.replace(rows, documents=rows)
    one = spark.createDataFrame([(7, "new", "pending", None)], rows.schema)
    s.replace(one, documents=one)
    s.update("documents", spark.createDataFrame([(7, "processing"), (8, "processing")], "document_id long, status string"))
    s.update("documents", spark.createDataFrame([(7, "complete", 100)], "document_id long, status string, progress int"))
    assert [(e["kind"], e["rows"]) for e in s.state()["entries"]] == [("gone", 10_000), ("rows", 10_000), ("gone", 1), ("rows", 1), ("columns", 2), ("columns", 1)]
    assert all("text" not in [f["name"] for f in e["schema"]["fields"]] for e in s.state()["entries"] if e["kind"] == "columns")
    want = {7: ("new", "complete", 100), 8: ("text 8", "processing", None), 9: ("text 9", "pending", None)}
    get = lambda df: {r.document_id: (r.text, r.status, r.progress) for r in df.collect()}
    assert get(s.read("documents", want)) == want and s.read("documents").count() == 10_000
    # a newer row hides older changes of its columns; merging keeps all of it
    s.replace(one, documents=one)
    want[7] = ("new", "pending", None)
    assert get(s.read("documents", want)) == want
    s.compact()
    assert get(s.read("documents", want)) == want and s.read("documents").count() == 10_000
    s.compact(times=100_000)
    assert [e["kind"] for e in s.state()["entries"]] == ["rows"] and get(s.read("documents", want)) == want


def test_store_equals_a_dict_after_random_changes(spark, tmp_path):
    import random

    rng, s, want = random.Random(5), store.GraphStore(spark, str(tmp_path)), {}
    for step in range(14):
        ids = rng.sample(range(8), rng.randint(1, 4))
        some = spark.createDataFrame([(i,) for i in ids], "document_id long")
        match rng.choice(["replace", "replace", "a", "b", "ab", "delete", "compact"]) if step else "replace":
            case "replace":
                s.replace(some, t=spark.createDataFrame([(i, f"a{step}", f"b{step}") for i in ids], "document_id long, a string, b string"))
                want |= {i: (f"a{step}", f"b{step}") for i in ids}
            case "delete":
                s.delete(some)
                want = {i: x for i, x in want.items() if i not in ids}
            case "compact":
                s.compact(rng.choice([1, 100]))
            case which:
                s.update("t", spark.createDataFrame([(i, *[f"{c}{step}" for c in which]) for i in ids], "document_id long, " + ", ".join(f"{c} string" for c in which)))
                want = {i: (f"a{step}" if i in ids and "a" in which else a, f"b{step}" if i in ids and "b" in which else b) for i, (a, b) in want.items()}
        assert {r.document_id: (r.a, r.b) for r in s.read("t").collect()} == want


def test_store_writers_conflict(spark, tmp_path):
    """Two writers from one version: the second is told so, and what it wrote doesn't count; it may try again."""
    from quillgraph.sources.versioned import Conflict

    s, t = store.GraphStore(spark, str(tmp_path)), store.GraphStore(spark, str(tmp_path))
    row = lambda i, x: spark.createDataFrame([(i, x)], "document_id long, x string")
    s.replace(row(1, "a"), t=row(1, "a"))
    base = t.state()
    s.replace(row(1, "b"), t=row(1, "b"))
    with pytest.raises(Conflict):
        t.change(row(2, "c"), {"t": row(2, "c")}, base=base)
    assert [tuple(r) for r in s.read("t").collect()] == [(1, "b")]
    t.replace(row(2, "c"), t=row(2, "c"))
    assert sorted(tuple(r) for r in s.read("t").collect()) == [(1, "b"), (2, "c")]


def test_documents_in_work_are_not_deleted(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "complete"), (2, "pending"), (3, "error"), (4, "complete")], "document_id long, status string")
    s.replace(rows, documents=rows, nodes=rows.select("document_id", F.lit("n").alias("name")))
    s.update("documents", spark.createDataFrame([(2, "processing")], "document_id long, status string"))
    assert [r.document_id for r in s.delete_documents(spark.createDataFrame([(1,), (2,), (3,), (9,)], "document_id long")).collect()] == [2]
    assert sorted(r.document_id for r in s.read("documents").collect()) == sorted(r.document_id for r in s.read("nodes").collect()) == [2, 4]
    s.update("documents", spark.createDataFrame([(2, "complete")], "document_id long, status string"))
    assert s.delete_documents(spark.createDataFrame([(2,)], "document_id long")).count() == 0 and s.read("documents").count() == 1


def test_model_server(spark):
    """The connector against a local server: what is sent, what is taken from the answer, which models there are."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    sent = []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            sent.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self._say({"response": " hello \n"})

        def do_GET(self):
            self._say({"models": [{"name": "llama3:latest"}]})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = models.OllamaModel("llama3", f"http://127.0.0.1:{server.server_port}", timeout=5)
    assert model.complete("Hi") == "hello"
    assert sent == [("/api/generate", {"model": "llama3", "prompt": "Hi", "stream": False, "options": {"temperature": 0.0}})]
    assert models.available("llama3", model) == (True, "")
    assert models.available("mistral", model) == (False, "model mistral is not installed")
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, prompt string")
    url = model.url
    assert [r.answer for r in models.answers(prompts, lambda: models.OllamaModel("llama3", url, 5)).collect()] == ["hello", "hello"]
    server.shutdown()
    server.server_close()
    assert models.available("llama3", model)[0] is False


def test_sessions_store_messages(spark, built, tmp_path):
    from quillgraph.plans.sessions import Sessions

    engine = questions.Engine(spark, built[1], built[2], models.StubModel(lambda p: "an answer"))
    s = Sessions(spark, str(tmp_path))
    first = s.create(1, 7)
    got = s.ask(first, "Who is Elarin?", engine)
    s.ask(first, "Who is Moonkeep?", engine)
    rows = s.messages(first).collect()
    assert [(r.turn, r.role) for r in rows] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")] and rows[1].text == got["answer"] and "highlight" in rows[1].payload
    s.create(1, 7)
    s.create(2, 7)
    assert [(r.title, r.n_messages) for r in s.listed(1, 7).collect()] == [("Conversation 2", 0), ("Conversation 1", 4)]
    with pytest.raises(ValueError):
        s.ask("none", "x", engine)


def test_engine_takes_highlights_from_all_rows(spark, built):
    _, nodes, edges = built
    e = questions.Engine(spark, nodes, edges, models.StubModel(lambda p: "SELECT name, label FROM kg_nodes" if "Spark SQL" in p else "said"), rows=1)
    got = e.ask(1, "List all names with labels.")
    assert got["truncated"] and len(got["rows"]) == 1 and len(got["highlight"]["node_ids"]) == 3 and got["answer"] == "said (from the first 1 rows)"
    assert not e.ask(1, "Who is Elarin?")["truncated"]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.md").write_text("# x")
    got = {r.format: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"text": "one\ntwo\nthree", "markdown": "# x"}
    (tmp_path / "c.docx").write_text("x")
    with pytest.raises(Exception, match="unsupported"):
        files.read_files(spark, str(tmp_path)).collect()


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(1, TWO, "2024-01-01 00:00:00"), (2, "Ann Lee lives in Oak Town.", "2024-01-01 00:00:01")]
    d = spark.createDataFrame(rows, "document_id long, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    s = store.GraphStore(spark, str(tmp_path / "out"))
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination(120)
    want = pipeline.process(d.select("document_id", "text"))
    assert {r.id for r in s.read("nodes").collect()} == {r.id for r in want.nodes.collect()}
    assert {r.id for r in s.read("edges").collect()} == {r.id for r in want.edges.collect()}


def test_reuploads_end_with_the_newest_text(spark, tmp_path):
    """A, B, A: the graph of A; a late older upload changes nothing; the documents table has the status and the counts."""
    text = {"A": "Ann Lee lives in Oak Town.", "B": "Bob Ray works for Acme Corp."}
    s = store.GraphStore(spark, str(tmp_path / "out"))
    for which, minute in (("A", 1), ("B", 2), ("A", 3), ("B", 0)):
        d = spark.createDataFrame([(1, text[which], f"2024-01-01 00:0{minute}:00")], "document_id long, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
        d.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination(120)
    assert "Ann Lee" in {r.name for r in s.read("nodes").collect()} and "Bob Ray" not in {r.name for r in s.read("nodes").collect()}
    (doc,) = s.read("documents").collect()
    assert (doc.text, doc.status, doc.nodes) == (text["A"], "complete", s.read("nodes").count())


def test_endpoint_repair_equals_all_pairs(spark):
    """The filters before the ratio lose nothing: every pair of a window is scored by hand."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    rows, said = [], []
    for w in range(30):
        names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(8)]
        rows += [(1, w, i, n, "Concept") for i, n in enumerate(names)]
        for n in names[:5]:
            i = rng.randrange(len(n))
            said += [(1, w, x) for x in (n, n[:i] + n[i + 1 :], "the " + n + "s", " ".join(reversed(n.split())), word())]
    within = spark.createDataFrame(rows, "document_id long, window_id int, ord long, name string, label string")
    asked = spark.createDataFrame(sorted(set(said)), "document_id long, window_id int, said string")
    got = {(r.window_id, r.said): r.name for r in relations.repaired_endpoints(asked, within).collect()}
    want = {}
    for _, w, x in set(said):
        form = S.surface(x)
        scored = [(2.0 if form == S.surface(n) else S.token_sort_ratio(form, S.surface(n)), -i, n) for _, v, i, n, _ in rows if v == w]
        if form and max(scored)[0] >= 0.90:
            want[w, x] = max(scored)[2]
    assert got == want and len(want) > 300


def test_log_export_of_a_document_without_logs(spark):
    logs = spark.createDataFrame([(1, "S", "m", "2024-01-02 03:04:05")], "document_id long, stage string, message string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.document_id: r.export for r in reads.log_export(logs, docs(spark, "a", "b")).collect()}
    assert got == {1: "[2024-01-02 03:04:05] [S] m", 2: "No logs available."}


def test_availability():
    assert models.available("gpt4")[0] is False and models.available("none") == (False, "unsupported model: none")


def test_failed_model_call_stays_in_its_row(spark):
    def load():
        def said(p):
            if "bad" in p:
                raise ValueError("no")
            return "ok"

        return models.StubModel(said)

    got = models.answers(spark.createDataFrame([(1, "good"), (2, "bad")], "document_id long, prompt string"), load).orderBy("document_id").collect()
    assert [(r.answer, r.error) for r in got] == [("ok", None), (None, "no")]


def test_lone_entities_are_not_compared(monkeypatch):
    """Entities that share no last word with others are their own clusters, without a look at their names."""
    import pyarrow as pa

    from quillgraph.operators import resolution

    asked, real = [], resolution.cluster
    monkeypatch.setattr(resolution, "cluster", lambda names, *more: asked.append(names) or real(names, *more))
    rows = [[(7, 3, "Oak Town")], [(1, 1, "Ann Lee"), (4, 1, "Bo Lee"), (9, 1, "ann lee")], [], [(2, 1, "Cy Orr")]]
    one = lambda at, first, name: {"_ord": at, "first": first, "e": {"label": "Person", "name": name, "chunk_id": 0}}
    kind = pa.list_(pa.struct({"_ord": pa.int64(), "first": pa.int64(), "e": pa.struct({"label": pa.string(), "name": pa.string(), "chunk_id": pa.int32()})}))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2]), pa.array([[one(*r) for r in group] for group in rows], kind)], names=["document_id", "rows"])
    for cut in (batch, batch.slice(1)):
        asked.clear()
        (got,) = resolution.clustered(iter([cut]), True)
        assert asked == [["Ann Lee", "Bo Lee", "ann lee"]]
        whole = [[[3], [7], [0]], [[1, 1, 1], [1, 4, 1], [0, 0, 1]], [[], [], []], [[1], [2], [0]]]
        assert [list(r.values())[2:] for r in got.to_pylist()] == whole[4 - cut.num_rows :]
