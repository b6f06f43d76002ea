"""The queries of the library and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import chunking, coreference, entities, graph, relations, resolution, windows
from .plans import pipeline, questions, reads
from .sources import files, models, narrative, store

FLAGSHIP = "graph_metrics"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is what it must equal, where SQL can say it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


def normal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.normalized(docs(spark, sf_dir))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one paragraph a turn."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("document_id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def counted(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Text

SQL_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
SQL_NORMAL = SQL_STRIP.format(
    r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{2,}', chr(1), 'g'), '\n', ' ', 'g'), chr(1), chr(10) || chr(10), 'g'), chr(2), '')"
)
SQL_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"SELECT doc_id AS document_id, {SQL_NORMAL} AS text FROM documents")
def text_normalize(spark, sf_dir):
    """SCL-01."""
    return normal_docs(spark, sf_dir)


@query(f"SELECT doc_id AS document_id, CAST({SQL_WORDS.format('text')} AS BIGINT) AS words, CAST(round_even({SQL_WORDS.format('text')} * 1.3::DOUBLE, 0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """SCL-02, SCL-03."""
    return counted(docs(spark, sf_dir).select("document_id", X.word_count(F.col("text")).alias("words"), X.token_estimate(F.col("text")).alias("tokens")), "words", "tokens")


def _numbered(parts: str, source: str) -> str:
    return f"""p AS (SELECT document_id, {parts} AS ps FROM {source}),
e AS (SELECT document_id, unnest(ps) AS text, unnest(range(len(ps))) AS chunk_id FROM p),
c AS (SELECT document_id, chunk_id, text, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_index FROM e)"""


SQL_CHUNKS = f"WITH d AS (SELECT doc_id AS document_id, {SQL_NORMAL} AS text FROM documents), {_numbered(SQL_SENTENCES.format('text'), 'd')}"


@query(f"{SQL_CHUNKS} SELECT document_id, CAST(chunk_id AS BIGINT) AS chunk_id, text, CAST(start_index AS BIGINT) AS start_index, CAST(start_index + length(text) AS BIGINT) AS end_index FROM c")
def sentence_chunks(spark, sf_dir):
    """TXT-02, SCL-05, WIN-03, WIN-04."""
    return counted(chunking.sentence_chunks(normal_docs(spark, sf_dir)), "chunk_id", "start_index", "end_index")


SQL_TALKS = "t AS (SELECT conv_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
SQL_PARAGRAPHS = "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"WITH {SQL_TALKS}, {_numbered(SQL_PARAGRAPHS, 't')} SELECT document_id, CAST(chunk_id AS BIGINT) AS chunk_id, text, CAST(start_index AS BIGINT) AS start_index, CAST(start_index + length(text) AS BIGINT) AS end_index FROM c")
def paragraph_chunks(spark, sf_dir):
    """TXT-03, SCL-04."""
    return counted(chunking.paragraph_chunks(talks(spark, sf_dir)), "chunk_id", "start_index", "end_index")


@query(r"""
WITH w AS (SELECT doc_id AS document_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT document_id, ws, unnest(range(0, len(ws), 180)) AS start_index FROM w)
SELECT document_id, CAST(start_index // 180 AS BIGINT) AS chunk_id, array_to_string(ws[start_index + 1 : start_index + 200], ' ') AS text, CAST(start_index AS BIGINT) AS start_index, CAST(least(len(ws), start_index + 200) AS BIGINT) AS end_index FROM s
""")
def word_chunks(spark, sf_dir):
    """TXT-01, WIN-05."""
    return counted(chunking.word_chunks(docs(spark, sf_dir)), "chunk_id", "start_index", "end_index")


@query()
def recursive_chunks(spark, sf_dir):
    """TXT-04."""
    return counted(chunking.recursive_chunks(normal_docs(spark, sf_dir)), "chunk_id", "start_index", "end_index")


@query(f"""{SQL_CHUNKS}, n AS (SELECT document_id, {SQL_WORDS.format('text')} AS n FROM c)
SELECT d.document_id, count(n) AS chunk_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_words, coalesce(round(avg(n), 2), 0.0) AS avg_words, CAST(coalesce(min(n), 0) AS BIGINT) AS min_words, CAST(coalesce(max(n), 0) AS BIGINT) AS max_words
FROM d LEFT JOIN n ON n.document_id = d.document_id GROUP BY d.document_id""")
def chunk_metrics(spark, sf_dir):
    """TXT-06, AGG-01."""
    return counted(chunking.chunk_metrics(docs(spark, sf_dir), chunking.sentence_chunks(normal_docs(spark, sf_dir))), "chunk_count", "total_words", "min_words", "max_words")


@query(f"""{SQL_CHUNKS}, a AS (SELECT *, start_index + length(text) AS end_index, lead(text) OVER w AS nt, lead(chunk_id) OVER w AS ni, lead(start_index + length(text)) OVER w AS ne FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_id))
SELECT document_id, CAST(chunk_id AS BIGINT) AS chunk_id, CASE WHEN ni IS NULL THEN text ELSE text || ' ' || nt END AS text, CAST(start_index AS BIGINT) AS start_index, CAST(coalesce(ne, end_index) AS BIGINT) AS end_index, CASE WHEN ni IS NULL THEN '' ELSE chunk_id || ',' || ni END AS source_chunk_ids FROM a""")
def adjacent_windows(spark, sf_dir):
    """TXT-11, WIN-01."""
    w = windows.adjacent_windows(chunking.sentence_chunks(normal_docs(spark, sf_dir), ahead=True)).drop("analysis_text")
    return counted(w.withColumn("source_chunk_ids", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ",")), "chunk_id", "start_index", "end_index")


# Entities

_MASK = r"regexp_replace(text, '[A-Za-z]*(?:[\p{N}_]|[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])[\p{L}\p{N}_]*', '·', 'g')"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
SQL_CANDIDATES = rf"""
f AS (SELECT document_id, chunk_id, regexp_extract_all({_MASK}, '\b(?:[A-Z][a-zA-Z]+|[A-Z]{{2,}})(?:\s+(?:[A-Z][a-zA-Z]+|[A-Z]{{2,}}))*\b') AS ps FROM c),
u AS (SELECT document_id, chunk_id, unnest(ps) AS raw, unnest(range(len(ps))) AS pos FROM f),
v AS (SELECT document_id, chunk_id, pos, regexp_replace(raw, '\s+', ' ', 'g') AS name, string_split(regexp_replace(raw, '\s+', ' ', 'g'), ' ') AS w FROM u),
cand AS (SELECT document_id, chunk_id, pos, name, CASE WHEN len(w) >= 2 AND w[-1] IN ({_quoted(X.ORG_SUFFIXES)}) THEN 'Organization' WHEN list_has_any(w, [{_quoted(X.LOCATION_HINTS)}]) THEN 'Location'
  WHEN len(w) = 1 AND regexp_full_match(name, '[A-Z]{{2,}}') THEN 'Organization' WHEN len(w) >= 2 THEN 'Person' ELSE 'Concept' END AS label
  FROM v WHERE length(name) >= 2 AND name NOT IN ({_quoted(X.STOPWORDS)})),
ent AS (SELECT document_id, chunk_id, pos, name, label FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(label), lower(name) ORDER BY chunk_id, pos) AS r FROM cand) WHERE r = 1)"""


@query(f"{SQL_CHUNKS}, {SQL_CANDIDATES} SELECT document_id, CAST(chunk_id AS BIGINT) AS chunk_id, name, label FROM ent")
def heuristic_entities(spark, sf_dir):
    """TXT-12, SCL-06, SCL-07, PRJ-01, PRJ-02, WIN-02."""
    found = entities.heuristic_entities(chunking.sentence_chunks(normal_docs(spark, sf_dir)))
    return counted(found.select("document_id", "chunk_id", "name", "label"), "chunk_id")


@query(f"""{SQL_CHUNKS}, {SQL_CANDIDATES}
SELECT lang, label, name, n FROM (SELECT lang, label, name, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, name, label) AS r FROM ent JOIN documents ON doc_id = document_id GROUP BY lang, label, name) WHERE r <= 10""")
def top_entities(spark, sf_dir):
    """The ten most widespread entities of each language."""
    from pyspark.sql.window import Window

    found = entities.heuristic_entities(chunking.sentence_chunks(normal_docs(spark, sf_dir)))
    langs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    n = found.join(langs, "document_id").groupBy("lang", "label", "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "name", "label"))
    return n.withColumn("r", place).where("r <= 10").drop("r")


@query(f"""{SQL_CHUNKS}, {SQL_CANDIDATES} SELECT document_id, count(*) FILTER (WHERE label = 'Organization') AS organizations, count(*) FILTER (WHERE label = 'Location') AS locations, count(*) FILTER (WHERE label = 'Person') AS persons, count(*) FILTER (WHERE label = 'Concept') AS concepts FROM ent GROUP BY document_id""")
def entity_label_counts(spark, sf_dir):
    """AGG-08, RES-01."""
    found = entities.heuristic_entities(chunking.sentence_chunks(normal_docs(spark, sf_dir)))
    n = lambda label: F.count(F.when(F.col("label") == label, 1))
    return found.groupBy("document_id").agg(n("Organization").alias("organizations"), n("Location").alias("locations"), n("Person").alias("persons"), n("Concept").alias("concepts"))


SQL_SURFACE = r"regexp_replace(trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\-'' ]', ' ', 'g'), ' +', ' ', 'g')), '^(?:the|a|an) +', '')"
SQL_SINGULAR_WORD = r"CASE WHEN regexp_matches({0}, '[^aeiou]ies$') AND length({0}) > 4 THEN left({0}, length({0}) - 3) || 'y' WHEN regexp_matches({0}, '(?:s|x|z|ch|sh)es$') AND length({0}) > 4 THEN left({0}, length({0}) - 2) WHEN regexp_matches({0}, '[^sui]s$') AND length({0}) > 2 THEN left({0}, length({0}) - 1) ELSE {0} END"
SQL_CAPITALS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


def _sql_canonical(name: str, source: str) -> str:
    return f"""sf AS (SELECT *, {SQL_SURFACE.format(name)} AS norm FROM {source}),
sg AS (SELECT *, regexp_extract(norm, '^(.* )?[^ ]*$', 1) AS head, regexp_extract(norm, '([^ ]*)$', 1) AS last FROM sf),
sn AS (SELECT *, head || {SQL_SINGULAR_WORD.format('last')} AS singular FROM sg),
cn AS (SELECT *, CASE WHEN singular = '' THEN {name} WHEN upper({name}) = {name} AND lower({name}) <> {name} THEN upper(singular) WHEN regexp_matches(left({name}, 1), '^\\p{{Lu}}') THEN {SQL_CAPITALS.format('singular')} ELSE singular END AS canonical FROM sn)"""


SQL_NAMES = "nm AS (SELECT p_name AS name FROM part UNION ALL SELECT initcap_.n FROM (SELECT upper(left(r_name, 1)) || lower(substr(r_name, 2)) || ' Cities' AS n FROM region) initcap_ UNION ALL SELECT 'The ' || n_name || ' Boxes' FROM nation UNION ALL SELECT c_name FROM customer)"


def _names(spark, sf_dir):
    part, region, nation, customer = (read(spark, sf_dir, t) for t in ("part", "region", "nation", "customer"))
    cities = F.concat(F.upper(F.left("r_name", F.lit(1))), F.lower(F.substring("r_name", 2, 100)), F.lit(" Cities"))
    boxes = F.concat(F.lit("The "), "n_name", F.lit(" Boxes"))
    return part.select(F.col("p_name").alias("name")).union(region.select(cities)).union(nation.select(boxes)).union(customer.select("c_name"))


@query(f"WITH {SQL_NAMES}, {_sql_canonical('name', 'nm')} SELECT name, norm, singular, canonical FROM cn")
def canonical_names(spark, sf_dir):
    """SCL-08, SCL-09, SCL-10, AGG-10."""
    n = F.col("name")
    return _names(spark, sf_dir).select("name", X.surface(n).alias("norm"), X.singular(X.surface(n)).alias("singular"), resolution.canonical_surface(n).alias("canonical"))


def doc_clusters(spark, sf_dir):
    found = entities.heuristic_entities(chunking.sentence_chunks(normal_docs(spark, sf_dir)))
    return resolution.sized_clusters(found)


@query()
def entity_clusters(spark, sf_dir):
    """RES-02 to RES-05, JOIN-06, JOIN-07, SCL-11 to SCL-13."""
    return counted(doc_clusters(spark, sf_dir).select("document_id", "cluster", "member", "label", "name"), "cluster", "member")


@query()
def resolved_forms(spark, sf_dir):
    """RES-06, AGG-08 to AGG-11 over the clusters of all documents."""
    forms = resolution.canonical_forms(doc_clusters(spark, sf_dir))
    return forms.select("document_id", F.col("cluster").cast("bigint").alias("cluster"), "canonical_name", "canonical_label", F.array_join("aliases", "|").alias("aliases"), F.col("label_counts")["Person"].cast("bigint").alias("persons"))


SQL_MEMBERS = """m AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS document_id, CAST(o_custkey % 7 AS BIGINT) AS cluster, CASE o_orderkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Location' ELSE 'Concept' END AS label,
 'Cust ' || translate(CAST(o_custkey % 400 AS VARCHAR), '0123456789', 'abcdefghij') AS name, o_orderkey AS member FROM orders)"""


def _members(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "Person").when(k == 1, "Organization").when(k == 2, "Location").otherwise("Concept")
    name = F.concat(F.lit("Cust "), F.translate((F.col("o_custkey") % 400).cast("string"), "0123456789", "abcdefghij"))
    return o.select((F.col("o_custkey") % 50).cast("bigint").alias("document_id"), (F.col("o_custkey") % 7).cast("bigint").alias("cluster"), label.alias("label"), name.alias("name"), F.col("o_orderkey").alias("member"))


@query(f"""WITH {SQL_MEMBERS}, l AS (SELECT document_id, cluster, label, count(*) AS n, CASE label WHEN 'Organization' THEN 4 WHEN 'Location' THEN 3 WHEN 'Person' THEN 2 ELSE 1 END AS p FROM m GROUP BY document_id, cluster, label),
b AS (SELECT document_id, cluster, label FROM (SELECT *, row_number() OVER (PARTITION BY document_id, cluster ORDER BY n DESC, p DESC) AS r FROM l) WHERE r = 1),
o AS (SELECT m.document_id, m.cluster, b.label, m.name, row_number() OVER (PARTITION BY m.document_id, m.cluster ORDER BY CASE WHEN b.label = 'Person' THEN -length(name) ELSE length(name) END, lower(name), member) AS r FROM m JOIN b ON b.document_id = m.document_id AND b.cluster = m.cluster),
t AS (SELECT document_id, cluster, label, name FROM o WHERE r = 1), {_sql_canonical('name', 't')},
a AS (SELECT document_id, cluster, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, count(*) FILTER (WHERE label = 'Person') AS persons FROM m GROUP BY document_id, cluster)
SELECT cn.document_id, cn.cluster, CASE WHEN cn.label = 'Person' THEN cn.name ELSE canonical END AS canonical_name, cn.label AS canonical_label, aliases, persons FROM cn JOIN a ON a.document_id = cn.document_id AND a.cluster = cn.cluster""")
def canonical_forms(spark, sf_dir):
    """AGG-08 to AGG-11, RES-06 on given clusters."""
    forms = resolution.canonical_forms(_members(spark, sf_dir))
    return forms.select("document_id", "cluster", "canonical_name", "canonical_label", F.array_join("aliases", "|").alias("aliases"), F.col("label_counts")["Person"].cast("bigint").alias("persons"))


# Relations and graphs over the narrative corpus

SQL_NARRATIVE = f"WITH c AS ({narrative.CHUNKS}), {SQL_CANDIDATES.strip()}"
_phrases = ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(relations.PHRASES))
SQL_RELATIONS = f"""
win AS (SELECT document_id, chunk_id, CASE WHEN nt IS NULL THEN text ELSE text || ' ' || nt END AS text, ni FROM (SELECT *, lead(text) OVER w AS nt, lead(chunk_id) OVER w AS ni FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_id))),
ph AS (SELECT * FROM (VALUES {_phrases}) t(nth, phrase, type)),
wp AS (SELECT document_id, chunk_id, ni, nth, type FROM win JOIN ph ON contains(lower(win.text), phrase)),
eo AS (SELECT *, chunk_id * 4294967296 + pos AS ord FROM ent),
we AS (SELECT DISTINCT wp.document_id, wp.chunk_id AS win, eo.ord, eo.name, eo.label FROM (SELECT DISTINCT document_id, chunk_id, ni FROM wp) wp JOIN eo ON eo.document_id = wp.document_id AND (eo.chunk_id = wp.chunk_id OR eo.chunk_id = wp.ni)),
rr AS (SELECT a.document_id, a.win, wp.nth, a.ord AS i, b.ord AS j, a.name AS source, a.label AS source_label, b.name AS target, b.label AS target_label, wp.type
 FROM we a JOIN we b ON a.document_id = b.document_id AND a.win = b.win AND a.ord <> b.ord AND a.name <> b.name JOIN wp ON wp.document_id = a.document_id AND wp.chunk_id = a.win),
rel AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(source), lower(target), upper(type) ORDER BY win, nth, i, j) AS r FROM rr) WHERE r = 1)"""


def _story(spark, sf_dir):
    chunks = graph.cut(narrative.chunks(spark, sf_dir))
    found = graph.cut(entities.heuristic_entities(chunks))
    w = graph.cut(windows.adjacent_windows(chunks))
    return chunks, w, found, relations.heuristic_relations(w, found)


@query(f"{SQL_NARRATIVE}, {SQL_RELATIONS} SELECT document_id, source, source_label, target, target_label, type, CAST(win AS BIGINT) AS chunk_id FROM rel")
def narrative_relations(spark, sf_dir):
    """TXT-14, JOIN-01 to JOIN-03, PRJ-10."""
    told = _story(spark, sf_dir)[3]
    return counted(told.select("document_id", "source", "source_label", "target", "target_label", "type", "chunk_id"), "chunk_id")


SQL_RENAMED = "k AS (SELECT document_id, label, name, 'Known ' || name AS canonical_name, CASE WHEN label = 'Concept' THEN 'Person' ELSE label END AS canonical_label FROM ent WHERE length(name) % 2 = 0)"


@query(f"""{SQL_NARRATIVE}, {SQL_RELATIONS}, {SQL_RENAMED}
SELECT r.document_id, coalesce(a.canonical_name, source) AS source, coalesce(a.canonical_label, source_label) AS source_label, coalesce(b.canonical_name, target) AS target, coalesce(b.canonical_label, target_label) AS target_label, type
FROM rel r LEFT JOIN k a ON a.document_id = r.document_id AND a.label = source_label AND a.name = source LEFT JOIN k b ON b.document_id = r.document_id AND b.label = target_label AND b.name = target""")
def relation_rewrite(spark, sf_dir):
    """RES-07, JOIN-04."""
    _, _, found, told = _story(spark, sf_dir)
    known = found.where(F.char_length("name") % 2 == 0).select("document_id", "label", "name", F.concat(F.lit("Known "), "name").alias("canonical_name"), F.when(F.col("label") == "Concept", "Person").otherwise(F.col("label")).alias("canonical_label"), F.lit(0).alias("member"))
    return resolution.rewritten_relations(told, known).select("document_id", "source", "source_label", "target", "target_label", "type")


SQL_BUILT = f"""{SQL_NARRATIVE}, {SQL_RELATIONS},
el AS (SELECT document_id, name AS canonical_name, label AS canonical_label, name, chunk_id, pos FROM ent),
bn AS (SELECT document_id, document_id || ':' || canonical_label || ':' || canonical_name AS id, canonical_name AS name, canonical_label AS label, chunk_id FROM el),
be AS (SELECT r.document_id, s.id AS source, t.id AS target, upper(trim(type)) AS type, win FROM rel r JOIN bn s ON s.document_id = r.document_id AND lower(s.name) = lower(r.source) AND s.label = r.source_label JOIN bn t ON t.document_id = r.document_id AND lower(t.name) = lower(r.target) AND t.label = r.target_label WHERE s.id <> t.id)"""


def _built(spark, sf_dir):
    chunks, w, found, told = _story(spark, sf_dir)
    same = found.select("document_id", F.col("name").alias("canonical_name"), F.col("label").alias("canonical_label"), "name", F.array("name").alias("aliases"), F.create_map(F.col("label"), F.lit(1)).alias("label_counts"), "chunk_id", "start_index", "end_index", F.col("ord").alias("member"))
    nodes = graph.cut(graph.build_nodes(same, chunks))
    return nodes, graph.build_edges(told, nodes, w)


@query(f"{SQL_BUILT} SELECT bn.document_id, id, name, label, CAST(bn.chunk_id AS BIGINT) AS chunk_id, c.text AS source_text FROM bn JOIN c ON c.document_id = bn.document_id AND c.chunk_id = bn.chunk_id")
def graph_nodes(spark, sf_dir):
    """GRF-01."""
    return counted(_built(spark, sf_dir)[0].select("document_id", "id", "name", "label", "chunk_id", F.col("provenance.source_text").alias("source_text")), "chunk_id")


@query(f"{SQL_BUILT} SELECT be.document_id, source || '-' || type || '-' || target AS id, source, target, type, CAST(win AS BIGINT) AS chunk_id, w.text AS source_text FROM be JOIN win w ON w.document_id = be.document_id AND w.chunk_id = be.win")
def graph_edges(spark, sf_dir):
    """GRF-02, JOIN-05, SCL-26."""
    return counted(_built(spark, sf_dir)[1].select("document_id", "id", "source", "target", "type", "chunk_id", F.col("provenance.source_text").alias("source_text")), "chunk_id")


@query()
def pipeline_graph(spark, sf_dir):
    """TXT-16: the whole pipeline from texts to graphs, with clustering."""
    g = pipeline.process(docs(spark, sf_dir))
    return graph.graph_counts(g.nodes, g.edges).join(g.documents.select("document_id", F.col("estimated_tokens").cast("bigint").alias("estimated_tokens")), "document_id", "right").na.fill(0)


# The property graph

SQL_GRAPH = f"""WITH RECURSIVE n AS (SELECT document_id || ':' || label || ':' || name AS id, * FROM ({narrative.NODES})),
e AS (SELECT source || '-' || type || '-' || target AS id, * FROM (SELECT document_id || ':' || source_label || ':' || source_name AS source, document_id || ':' || target_label || ':' || target_name AS target, * FROM ({narrative.EDGES}))),
b AS (SELECT document_id, source AS node, target AS neighbor, id, type FROM e UNION ALL SELECT document_id, target, source, id, type FROM e)"""


def _graph(spark, sf_dir):
    return narrative.nodes(spark, sf_dir), narrative.edges(spark, sf_dir)


@query(f"{SQL_GRAPH} SELECT n.document_id, n.c AS nodes, coalesce(e.c, 0) AS edges, coalesce(e.t, 0) AS relation_types FROM (SELECT document_id, count(*) AS c FROM n GROUP BY document_id) n LEFT JOIN (SELECT document_id, count(*) AS c, count(DISTINCT type) AS t FROM e GROUP BY document_id) e ON e.document_id = n.document_id")
def graph_counts(spark, sf_dir):
    """AGG-02."""
    return graph.graph_counts(*_graph(spark, sf_dir))


# a nation that is part of no region is a component with its customers and suppliers; the rest of a region is one
SQL_COMPONENTS = """top AS (SELECT n_regionkey AS document_id, n_nationkey, 'Nation' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS name, n_nationkey % 7 = 3 AS apart FROM nation),
lab AS (SELECT n.document_id, n.id, CASE WHEN t.apart THEN t.name ELSE 'rest' END AS grp FROM n LEFT JOIN (SELECT source AS id, target_name FROM e WHERE type <> 'PART_OF') m ON m.id = n.id LEFT JOIN top t ON t.document_id = n.document_id AND t.name = coalesce(m.target_name, n.name)),
cmp AS (SELECT document_id, id, min(id) OVER (PARTITION BY document_id, grp) AS component FROM lab)"""


@query(f"{SQL_GRAPH}, {SQL_COMPONENTS} SELECT * FROM cmp")
def components(spark, sf_dir):
    """GRF-04, AGG-06."""
    return graph.components(*_graph(spark, sf_dir))


@query(f"{SQL_GRAPH}, {SQL_COMPONENTS} SELECT document_id, component, count(*) AS size FROM cmp GROUP BY document_id, component")
def component_sizes(spark, sf_dir):
    """AGG-06, AGG-07."""
    return graph.components(*_graph(spark, sf_dir)).groupBy("document_id", "component").agg(F.count("*").alias("size"))


@query(f"""{SQL_GRAPH}, {SQL_COMPONENTS}, dg AS (SELECT n.document_id, n.id, count(DISTINCT neighbor) AS d FROM n LEFT JOIN b ON b.node = n.id GROUP BY n.document_id, n.id),
x AS (SELECT document_id, count(*) AS nodes, count(*) FILTER (WHERE d = 0) AS isolated_nodes, round(avg(d), 2) AS average_degree FROM dg GROUP BY document_id),
y AS (SELECT document_id, count(*) AS components, max(s) AS largest_component FROM (SELECT document_id, component, count(*) AS s FROM cmp GROUP BY document_id, component) GROUP BY document_id),
z AS (SELECT document_id, count(*) AS edges FROM e GROUP BY document_id)
SELECT x.document_id, nodes, coalesce(edges, 0) AS edges, isolated_nodes, average_degree, CASE WHEN nodes > 1 THEN round(2 * coalesce(edges, 0) / (nodes::DOUBLE * (nodes - 1)), 4) ELSE 0.0 END AS density, components, largest_component
FROM x JOIN y ON y.document_id = x.document_id LEFT JOIN z ON z.document_id = x.document_id""")
def graph_metrics(spark, sf_dir):
    """GRF-03, AGG-03 to AGG-07."""
    return graph.graph_metrics(*_graph(spark, sf_dir))


@query(f"{SQL_GRAPH} SELECT document_id, name AS entity_name, label FROM n WHERE lower(name) = 'nationb'")
def lookup_basic(spark, sf_dir):
    """GRF-05, PRJ-06, PRJ-07, SRT-03."""
    return graph.lookup(narrative.nodes(spark, sf_dir), "NATIONB").drop("id")


@query(f"{SQL_GRAPH} SELECT DISTINCT n.document_id, n.name AS entity_name, n.label, m.name AS related_entity, m.label AS related_label, b.type AS relation FROM n LEFT JOIN b ON b.node = n.id LEFT JOIN n m ON m.id = b.neighbor WHERE lower(n.name) = 'nationc'")
def lookup_summary(spark, sf_dir):
    """GRF-06, JOIN-09, AGG-14."""
    return graph.neighborhood(*_graph(spark, sf_dir), "Nationc")


SQL_PATH = """s AS (SELECT DISTINCT document_id, node, neighbor, min(type) OVER (PARTITION BY node, neighbor) AS type FROM b),
w AS (SELECT n.document_id, n.id AS node, [n.id] AS ids, []::VARCHAR[] AS types FROM n WHERE lower(n.name) = lower('{a}')
 UNION ALL SELECT w.document_id, s.neighbor, list_append(w.ids, s.neighbor), list_append(w.types, s.type) FROM w JOIN s ON s.node = w.node WHERE len(w.types) < 3 AND NOT list_contains(w.ids, s.neighbor)),
r AS (SELECT w.document_id, w.ids, w.types, row_number() OVER (PARTITION BY w.document_id ORDER BY len(types), ids, types) AS k FROM w JOIN n ON n.id = w.node AND lower(n.name) = lower('{b}') WHERE len(types) > 0)
SELECT document_id, array_to_string(ids, '|') AS path_node_ids, array_to_string(types, '|') AS path_relations, CAST(len(types) AS BIGINT) AS path_length FROM r WHERE k = 1"""


def _path(spark, sf_dir, a, b):
    p = graph.shortest_path(*_graph(spark, sf_dir), a, b)
    return p.select("document_id", F.array_join("path_node_ids", "|").alias("path_node_ids"), F.array_join("path_relations", "|").alias("path_relations"), F.col("path_length").cast("bigint").alias("path_length"))


@query(f"{SQL_GRAPH}, {SQL_PATH.format(a='Nationa', b='Nationf')}")
def shortest_path(spark, sf_dir):
    """GRF-07, JOIN-10."""
    return _path(spark, sf_dir, "Nationa", "Nationf")


def _sql_rank(score: str, count: str) -> str:
    return f"""{SQL_GRAPH}, k AS (SELECT n.document_id, n.name AS entity_name, n.label, {count} AS {score} FROM n LEFT JOIN b ON b.node = n.id GROUP BY n.document_id, n.id, n.name, n.label)
SELECT * FROM (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY {score} DESC, entity_name, label) AS place, entity_name, label, {score} FROM k) WHERE place <= 10"""


@query(_sql_rank("degree", "count(DISTINCT b.id)"))
def rank_degree(spark, sf_dir):
    """GRF-08, AGG-12, SRT-01."""
    return counted(graph.ranking(*_graph(spark, sf_dir)), "place")


@query(_sql_rank("influence_score", "count(b.id)"))
def rank_influence(spark, sf_dir):
    """GRF-09, AGG-13, SRT-02."""
    return counted(graph.ranking(*_graph(spark, sf_dir), "influence_score"), "place")


@query(f"{SQL_GRAPH} SELECT DISTINCT document_id, type FROM e")
def relation_types(spark, sf_dir):
    """GRF-10, SET-03, SET-06."""
    return graph.relation_types(narrative.edges(spark, sf_dir))


@query(f"{SQL_GRAPH} SELECT DISTINCT document_id, name AS entity_name FROM n WHERE label = 'Location'")
def entities_by_label(spark, sf_dir):
    """GRF-10, SET-06."""
    return graph.entities_by_label(narrative.nodes(spark, sf_dir), "Location")


@query(f"{SQL_GRAPH} SELECT document_id, string_agg(DISTINCT label, ',' ORDER BY label) AS entity_labels, array_to_string(list_sort(list_distinct(list(name)))[1:25], ',') AS sample_entity_names, max((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM e WHERE e.document_id = n.document_id)) AS relationship_types FROM n GROUP BY document_id")
def schema_summary(spark, sf_dir):
    """QA-10, AGG-15, SRT-08."""
    s = questions.schema_summary(*_graph(spark, sf_dir))
    return s.select("document_id", *[F.array_join(c, ",").alias(c) for c in ("entity_labels", "sample_entity_names", "relationship_types")])


_json = lambda **kv: "'{" + ",".join(f'"{k}":"\' || {v} || \'"' for k, v in kv.items()) + "}'"
_colour = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.COLOURS.items()) + " ELSE '#8b5cf6' END"


@query(f"{SQL_GRAPH} SELECT document_id, 'nodes' AS kind, id, {_json(id='id', label='name', type='label', color=_colour)} AS data FROM n UNION ALL SELECT document_id, 'edges', id, {_json(id='id', source='source', target='target', label='type')} FROM e")
def element_export(spark, sf_dir):
    """GRF-12, SCL-31."""
    return graph.elements(*_graph(spark, sf_dir))


SQL_CHOSEN = "ch AS (SELECT document_id, id FROM n WHERE name IN ('Nationa', 'Nationb', 'Nationc', 'Regiona', 'Regionb'))"


def _chosen(nodes):
    return nodes.where(F.col("name").isin("Nationa", "Nationb", "Nationc", "Regiona", "Regionb"))


@query(f"{SQL_GRAPH}, {SQL_CHOSEN} SELECT document_id, id FROM ch UNION SELECT b.document_id, b.neighbor FROM b JOIN ch ON ch.id = b.node")
def highlighted_neighbors(spark, sf_dir):
    """GRF-11."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.highlighted(edges, _chosen(nodes).select("document_id", "id"))


@query(f"""{SQL_GRAPH}, {SQL_CHOSEN} SELECT document_id, 'node' AS kind, id FROM ch
UNION SELECT e.document_id, 'edge', e.id FROM e JOIN ch a ON a.id = e.source JOIN ch b2 ON b2.id = e.target UNION SELECT document_id, 'edge', id FROM e WHERE type = 'LOCATED_IN' AND document_id IN (SELECT document_id FROM ch)""")
def highlight(spark, sf_dir):
    """QA-08, JOIN-12, JOIN-13, SET-01."""
    nodes, edges = _graph(spark, sf_dir)
    chosen = _chosen(nodes)
    n, e = questions.highlight(nodes, edges, chosen.select("document_id", F.upper("name").alias("name")), chosen.select("document_id").distinct().withColumn("type", F.lit("located_in")))
    return n.select("document_id", F.lit("node").alias("kind"), "id").union(e.select("document_id", F.lit("edge").alias("kind"), "id"))


def _sql_snippet(text: str, terms: list[str]) -> str:
    at = "CASE " + " ".join(f"WHEN instr(lower({text}), lower({t})) > 0 THEN instr(lower({text}), lower({t})) - 1" for t in terms) + " ELSE -1 END"
    n = "CASE " + " ".join(f"WHEN instr(lower({text}), lower({t})) > 0 THEN length({t})" for t in terms) + " ELSE 0 END"
    start, end = f"greatest(0, {at} - 70)", f"least(length({text}), {at} + {n} + 70)"
    return f"CASE WHEN {at} < 0 THEN CASE WHEN length({text}) <= 140 THEN {text} ELSE rtrim(left({text}, 140), ' ' || chr(10)) || '...' END ELSE CASE WHEN {start} > 0 THEN '...' ELSE '' END || trim(substr({text}, {start} + 1, {end} - {start}), ' ' || chr(10)) || CASE WHEN {end} < length({text}) THEN '...' ELSE '' END END"


@query(f"""{SQL_BUILT}, bx AS (SELECT be.*, source || '-' || type || '-' || target AS id, w.text AS st FROM be JOIN win w ON w.document_id = be.document_id AND w.chunk_id = be.win),
ev AS (SELECT bn.document_id, 0 AS rank, bn.id, 'node' AS kind, bn.name || ' (' || bn.label || ')' AS title, c.text AS source_text, {_sql_snippet('c.text', ['bn.name'])} AS snippet FROM bn JOIN c ON c.document_id = bn.document_id AND c.chunk_id = bn.chunk_id WHERE bn.name LIKE 'Nation%'
 UNION ALL SELECT bx.document_id, 1, bx.id, 'edge', s.name || ' -[' || type || ']-> ' || t.name, st, {_sql_snippet('st', ['s.name', 't.name', 'type'])} FROM bx JOIN bn s ON s.id = bx.source JOIN bn t ON t.id = bx.target WHERE type = 'LOCATED_IN')
SELECT document_id, CAST(place AS BIGINT) AS place, kind, title, source_text, snippet FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, id) AS place FROM ev) WHERE place <= 6""")
def provenance(spark, sf_dir):
    """QA-09, JOIN-11, SRT-04, SET-04, SCL-21."""
    nodes, edges = _built(spark, sf_dir)
    found = questions.provenance(nodes, edges, nodes.where("name LIKE 'Nation%'").select("document_id", "id"), edges.where("type = 'LOCATED_IN'").select("document_id", "id"))
    return counted(found.select("document_id", "place", "kind", "title", "source_text", "snippet"), "place")


@query("SELECT doc_id AS document_id, " + _sql_snippet("t", ["'zzqx'", "lang", "'the'"]) + " AS snippet FROM (SELECT doc_id, lang, " + SQL_STRIP.format("coalesce(text, '')") + " AS t FROM documents)")
def snippet(spark, sf_dir):
    """SCL-21."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), X.snippet(F.col("text"), [F.lit("zzqx"), F.col("lang"), F.lit("the")]).alias("snippet"))


# The store

SQL_TYPES = "ty AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 6 WHEN 0 THEN 'co-founded' WHEN 1 THEN '  ' WHEN 2 THEN '--' WHEN 3 THEN '9th of' WHEN 4 THEN 'works at' ELSE o_orderpriority END AS type FROM orders)"


def _types(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, "co-founded").when(k == 1, "  ").when(k == 2, "--").when(k == 3, "9th of").when(k == 4, "works at").otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), t.alias("type"))


SQL_SANITIZE = "CASE WHEN s = '' THEN 'RELATED_TO' WHEN regexp_matches(s, '^[0-9]') THEN 'REL_' || s ELSE s END"


@query(f"WITH {SQL_TYPES}, z AS (SELECT k, type, regexp_replace(regexp_replace(upper(trim(type)), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') AS s FROM ty) SELECT k, type, {SQL_SANITIZE} AS stored, replace(upper(type), ' ', '_') AS spoken FROM z")
def type_sanitize(spark, sf_dir):
    """SCL-16, SCL-17."""
    t = F.col("type")
    return _types(spark, sf_dir).select("k", "type", X.relation_type(t).alias("stored"), X.spoken_type(t).alias("spoken"))


@query(f"""WITH {SQL_TYPES}, nd AS (SELECT DISTINCT c % 20 AS document_id, 'N' || c % 30 AS name, 'Person' AS label FROM ty WHERE c % 3 <> 0),
z AS (SELECT k, c % 20 AS document_id, 'N' || c % 30 AS source_name, 'N' || k % 30 AS target_name, regexp_replace(regexp_replace(upper(trim(type)), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') AS s FROM ty),
y AS (SELECT z.*, {SQL_SANITIZE} AS stored_type FROM z JOIN nd a ON a.document_id = z.document_id AND a.name = source_name JOIN nd b ON b.document_id = z.document_id AND b.name = target_name)
SELECT document_id, source_name, stored_type, target_name, max(k) AS ord FROM y GROUP BY document_id, source_name, stored_type, target_name""")
def store_upsert(spark, sf_dir):
    """SNK-05, SNK-06."""
    t = _types(spark, sf_dir)
    n = lambda c: F.concat(F.lit("N"), (F.col(c) % 30).cast("string"))
    nodes = store.stored_nodes(t.where("c % 3 <> 0").select((F.col("c") % 20).alias("document_id"), n("c").alias("name"), F.lit("Person").alias("label"), F.col("k").alias("ord")))
    edges = t.select((F.col("c") % 20).alias("document_id"), n("c").alias("source_name"), F.lit("Person").alias("source_label"), n("k").alias("target_name"), F.lit("Person").alias("target_label"), "type", F.col("k").alias("ord"))
    return store.stored_edges(edges, nodes).select("document_id", "source_name", "stored_type", "target_name", "ord")


@query(f"{SQL_GRAPH} SELECT document_id, id FROM n WHERE document_id % 2 = 0")
def store_delete(spark, sf_dir):
    """SNK-03."""
    nodes = narrative.nodes(spark, sf_dir)
    return store.without_documents(nodes, nodes.where("document_id % 2 = 1").select("document_id").distinct()).select("document_id", "id")


@query(f"{SQL_GRAPH}, old AS (SELECT document_id, id FROM n), new AS (SELECT document_id, id || '!' AS id FROM n WHERE document_id = 1) SELECT * FROM old WHERE document_id NOT IN (1, 2) UNION ALL SELECT * FROM new")
def store_replace(spark, sf_dir):
    """SNK-02 as a plan: documents 1 and 2 are replaced, and 2 has nothing any more."""
    nodes = narrative.nodes(spark, sf_dir).select("document_id", "id")
    gone = spark.createDataFrame([(1,), (2,)], "document_id long")
    return store.without_documents(nodes, gone).union(nodes.where("document_id = 1").select("document_id", F.concat("id", F.lit("!"))))


SQL_JSON_PART = "SELECT document_id, '{0}' AS kind, (place // 100)::BIGINT AS part, count(*) AS rows, '[' || string_agg(json, ',' ORDER BY place) || ']' AS data FROM (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS place, to_json({1})::VARCHAR AS json FROM {2}) GROUP BY ALL"
SQL_NODE_FIELDS = "{id: id, document_id: document_id, name: name, label: label}"
SQL_EDGE_FIELDS = "{id: id, source: source, target: target, document_id: document_id, source_name: source_name, source_label: source_label, target_name: target_name, target_label: target_label, type: type}"


@query(f"{SQL_GRAPH} {SQL_JSON_PART.format('nodes', SQL_NODE_FIELDS, 'n')} UNION ALL {SQL_JSON_PART.format('edges', SQL_EDGE_FIELDS, 'e')}")
def graph_json(spark, sf_dir):
    """SNK-01: all graphs as JSON, a hundred nodes or edges a part."""
    return store.graph_json_parts(*_graph(spark, sf_dir), rows=100)


# Questions

#: How turns are asked, by the number of the turn; names of a conversation are its assistant's words of at least four
#: letters and pairs of such words that are beside each other.
ASKED = ("", "Who is ", "Tell me about ", "How are ", "Who is most influential: ", "What is central? ", "what can you tell me about ")
SQL_ASKED = "qs AS (SELECT conv_id AS document_id, turn AS question_id, " + "CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ASKED)) + " END || text || CASE WHEN turn % 7 = 3 THEN ' related' ELSE '' END AS question FROM conversations)"
SQL_TOLD = r"""w AS (SELECT conv_id AS document_id, regexp_extract_all(text, '[\p{L}]+') AS w FROM conversations WHERE role = 'assistant'),
ns AS (SELECT DISTINCT document_id, unnest(list_concat(list_filter(w, lambda x: length(x) >= 4), list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN length(w[i]) >= 4 AND length(w[i + 1]) >= 4 THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL))) AS name FROM w)"""
SQL_MATCHED = r"""l AS (SELECT *, lower(question) AS low FROM qs), pairs AS (SELECT l.*, name, lower(name) AS known FROM l JOIN ns USING (document_id) WHERE contains(low, lower(name))),
spans AS (SELECT document_id, question_id, name, known, low, unnest(list_filter(range(0, length(low)), lambda i: substr(low, i + 1, length(known)) = known)) AS s FROM pairs),
free AS (SELECT document_id, question_id, {'minus': -length(known), 's': s, 'name': name, 'e': s + length(known)} AS x FROM spans WHERE NOT regexp_matches(CASE WHEN s > 0 THEN substr(low, s, 1) ELSE '' END, '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(low, s + length(known) + 1, 1), '[\p{L}\p{N}_]')),
held AS (SELECT document_id, question_id, list_reduce(list_transform(list_sort(list(DISTINCT x)), lambda y: [y]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.s < y[1].e AND y[1].s < z.e)) > 0 THEN acc ELSE list_concat(acc, y) END) AS h FROM free GROUP BY ALL),
m AS (SELECT qs.document_id, qs.question_id, question, lower(trim(question)) AS l, coalesce(list_transform(h, lambda y: y.name), []) AS names FROM qs LEFT JOIN held USING (document_id, question_id))"""
SQL_INTENT = """CASE WHEN (l LIKE 'how are %' OR l LIKE 'how is %') AND l LIKE '% related%' AND len(names) >= 2 THEN 'relationship_path' WHEN l LIKE '%most influential%' OR l LIKE '%who is influential%' THEN 'ranking_influence'
WHEN l LIKE '%who is central%' OR l LIKE '%what is central%' OR l LIKE '%most central%' THEN 'ranking_centrality' WHEN (l LIKE 'tell me about %' OR l LIKE 'what can you tell me about %') AND len(names) > 0 THEN 'lookup_summary' WHEN (l LIKE 'who is %' OR l LIKE 'what is %') AND len(names) > 0 THEN 'lookup_basic' ELSE 'generic_fallback' END"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions and names of all conversations."""
    t = read(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "document_id", "turn": "question_id"})
    how = F.get(F.array(*map(F.lit, ASKED)), (F.col("question_id") % 7).cast("int"))
    asked = t.select("document_id", "question_id", F.concat(how, "text", F.when(F.col("question_id") % 7 == 3, " related").otherwise("")).alias("question"))
    w = t.where("role = 'assistant'").select("document_id", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    long = lambda x: F.char_length(x) >= 4
    after = F.transform("w", lambda x, i: F.when(long(x) & long(F.get("w", i + 1)), F.concat(x, F.lit(" "), F.get("w", i + 1))))
    return asked, w.select("document_id", F.explode(F.concat(F.filter("w", long), F.array_compact(after))).alias("name"))


@query(f"WITH {SQL_ASKED}, {SQL_TOLD}, {SQL_MATCHED} SELECT document_id, question_id, array_to_string(names, '|') AS matched FROM m")
def question_spans(spark, sf_dir):
    """SCL-23, QA-02: all turns of all conversations against all names of each."""
    return questions.matched_names(*_asked(spark, sf_dir)).select("document_id", "question_id", F.array_join("matched", "|").alias("matched"))


@query(f"WITH {SQL_ASKED}, {SQL_TOLD}, {SQL_MATCHED}, i AS (SELECT *, {SQL_INTENT} AS intent FROM m) SELECT document_id, question_id, intent, array_to_string(CASE intent WHEN 'relationship_path' THEN names[1:2] WHEN 'lookup_summary' THEN names[1:1] WHEN 'lookup_basic' THEN names[1:1] WHEN 'generic_fallback' THEN names ELSE [] END, '|') AS matched FROM i")
def intent_classify(spark, sf_dir):
    """QA-01, QA-02, SCL-24: what is asked in every turn, and of whom."""
    return questions.analyses(*_asked(spark, sf_dir)).select("document_id", "question_id", "intent", F.array_join("matched", "|").alias("matched"))


#: Query texts about the words of each turn, by the number of the turn.
GUARDED = ("MATCH (n) WHERE n.document_id = 1 AND n.name = '{}' RETURN n", "match (n) return '{}'", "MATCH (n) SET n.x = '{}' RETURN n.document_id", "CREATE (n {})", "RETURN '{}' // document_id", "CALL x('{}') YIELD document_id", "DROP INDEX {}", "SUNSET {}")
SQL_FORBIDDEN = "CASE " + " ".join(f"WHEN contains(u, '{w}') THEN 'contains {w.strip()}'" for w in questions.FORBIDDEN)
SQL_GUARDED = "g AS (SELECT conv_id, turn, upper(replace(CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN $${g}$$" for i, g in enumerate(GUARDED)) + " END, '{}', text)) AS u FROM conversations)"


@query(f"WITH {SQL_GUARDED} SELECT conv_id, turn, coalesce({SQL_FORBIDDEN} WHEN NOT ({' OR '.join(f'starts_with(u, $${s}$$)' for s in questions.READ_ONLY_STARTS)}) THEN 'not read-only' WHEN NOT contains(u, 'DOCUMENT_ID') THEN 'not scoped to a document' END, 'allowed') AS verdict FROM g")
def guard_legacy(spark, sf_dir):
    """QA-05."""
    how = F.get(F.array(*map(F.lit, GUARDED)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(how, F.lit("{}"), F.col("text")).alias("query"))
    return rows.select("conv_id", "turn", F.coalesce(questions.textual_guard(F.col("query")), F.lit("allowed")).alias("verdict"))


@query("SELECT n_regionkey AS document_id, string_agg(n_name, ', ' ORDER BY n_nationkey) AS answer FROM nation GROUP BY n_regionkey")
def answer_shortcut(spark, sf_dir):
    """QA-07, AGG-19."""
    n = read(spark, sf_dir, "nation")
    return questions.shortcut(n.withColumnRenamed("n_regionkey", "document_id"), "n_name", "n_nationkey")


SQL_CUST = "'Cust' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"


@query(f"SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN {SQL_CUST} || ' came. ' || {SQL_CUST} || ' left ' || {SQL_CUST} || chr(39) || 's ' || c_mktsegment || '.' WHEN 1 THEN {SQL_CUST} || ' came. ' || {SQL_CUST} || ' left the ' || c_mktsegment || '.' ELSE 'It was It' || chr(39) || 's ' || c_mktsegment || '.' END AS text FROM customer")
def coref_replace(spark, sf_dir):
    """TXT-09, SCL-14, SCL-15: every customer in a sentence or two, with the places of what tells of them; one in three has
    pronouns alone, of which the first counts as the name."""
    name = F.concat(F.lit("Cust"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    kind, n = F.col("c_custkey") % 3, F.char_length(name)
    text = F.when(kind == 0, F.concat(name, F.lit(" came. He left his "), "c_mktsegment", F.lit("."))).when(kind == 1, F.concat(name, F.lit(" came. He left the "), "c_mktsegment", F.lit("."))).otherwise(F.concat(F.lit("It was his "), "c_mktsegment", F.lit(".")))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    named = F.array(span(F.lit(0), n), span(n + 7, n + 9))
    found = F.when(kind == 0, F.array(F.concat(named, F.array(span(n + 15, n + 18))))).when(kind == 1, F.array(named)).otherwise(F.array(F.array(span(F.lit(0), F.lit(2)), span(F.lit(7), F.lit(10)))))
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), text.alias("text"), found.alias("clusters"))
    return d.select("document_id", coreference.replace_mentions(F.col("text"), F.col("clusters")).alias("text"))


def _model(label: str):
    import re

    def said(prompt: str) -> str:
        import json

        names = re.findall(r"[A-Z][a-z]+", prompt.split("\n\n", 1)[1])
        if label == "entities":
            return "```json\n" + json.dumps({"entities": [{"name": n, "label": "Thing" if i % 2 else "Person"} for i, n in enumerate(names)]}) + "\n```"
        return "Here: " + json.dumps({"relations": [{"source": a, "target": b + "s", "type": "knows of"} for a, b in zip(names, names[1:])]})

    return lambda: models.StubModel(said)


@query()
def llm_entities_stub(spark, sf_dir):
    """TXT-13, SCL-18 to SCL-20, PRJ-03."""
    said = models.answers(models.entity_prompts(narrative.chunks(spark, sf_dir)), _model("entities")).where("answer IS NOT NULL")
    return entities.answered_entities(said).select("document_id", "label", "name", "ord")


@query()
def llm_relations_stub(spark, sf_dir):
    """TXT-15, PRJ-04, JOIN-08, RES-08."""
    chunks, w, found, _ = _story(spark, sf_dir)
    within = relations.window_entities(w, found)
    said = models.answers(models.relation_prompts(w, within), _model("relations")).where("answer IS NOT NULL")
    return relations.answered_relations(said, w, found).select("document_id", "source", "target", "type")


@query()
def endpoint_repair(spark, sf_dir):
    """JOIN-08, RES-08."""
    _, w, found, _ = _story(spark, sf_dir)
    within = relations.window_entities(w, found)
    said = within.select("document_id", "window_id", F.concat(F.lit("the "), "name", F.lit("s")).alias("said")).distinct()
    return relations.repaired_endpoints(said, within).select("document_id", F.col("window_id").cast("bigint").alias("window_id"), "said", "name")


# Reads

SQL_LINE = "'[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || event_type || '] ' || coalesce(props, '')"


@query(f"SELECT user_id AS document_id, string_agg({SQL_LINE}, chr(10) ORDER BY ts, {SQL_LINE}) AS export FROM events GROUP BY user_id")
def log_export(spark, sf_dir):
    """SNK-10, SRC-08, SCL-28."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.coalesce("props", F.lit("")).alias("message"), F.col("ts").alias("created_at"))
    return reads.log_export(e)


@query("""SELECT conv_id AS session_id, count(*) AS turns, coalesce(left(min_by(text, turn) FILTER (WHERE role = 'user'), 80), '') AS title, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def session_list(spark, sf_dir):
    """QA-11, SRT-09, JOIN-15."""
    return reads.sessions(read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id"))


@query("SELECT c_nationkey AS document_id, c_custkey % 3 AS user_id, 'Conversation ' || (count(*) + 1) AS title FROM customer GROUP BY c_nationkey, c_custkey % 3")
def session_titles(spark, sf_dir):
    """AGG-17."""
    s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document_id"), (F.col("c_custkey") % 3).alias("user_id"))
    return reads.next_session_title(s)


@query("SELECT event_id, greatest(0, least(100, CAST(trunc(value) AS INTEGER))) AS progress FROM events")
def progress_clamp(spark, sf_dir):
    """SNK-08."""
    return read(spark, sf_dir, "events").select("event_id", X.progress(F.col("value")).alias("progress"))


@query("SELECT doc_id % 10 AS user_id, doc_id AS document_id, lang || '_' || source || '.txt' AS name, n_chars AS created_at, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars DESC, doc_id DESC) AS place FROM documents")
def document_dashboard(spark, sf_dir):
    """SRC-07, PRJ-05, SRT-06, SCL-30: the dashboards of all users."""
    name = X.safe_filename(F.concat("lang", F.lit(" "), "source", F.lit(".txt")))
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("user_id"), F.col("doc_id").alias("document_id"), name.alias("name"), F.col("n_chars").alias("created_at"))
    return counted(reads.dashboards(d), "place")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' WHEN 3 THEN 'text' END AS format FROM documents")
def format_dispatch(spark, sf_dir):
    """SRC-04."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    ends = F.get(F.array(*[F.lit(x) for x in (".txt", ".md", ".pdf", ".TXT", ".docx")]), (F.col("doc_id") % 5).cast("int"))
    return d.select("doc_id", files.format_of(F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), ends), strict=False).alias("format"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 1e6 AS seconds, CAST(event_id % 2 = 0 AS BOOLEAN) AS may_start, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'complete' END AS status FROM events")
def task_status(spark, sf_dir):
    """SCL-27, PRJ-09."""
    e = read(spark, sf_dir, "events")
    start = F.lit("2020-01-01 00:00:00").cast("timestamp")
    status = F.when(F.col("event_id") % 2 == 0, "pending").otherwise("processing")
    return e.select("event_id", X.seconds_between(start, F.col("ts").cast("timestamp")).alias("seconds"), reads.may_start(status).alias("may_start"), reads.final_status(F.when(F.col("event_id") % 3 == 0, "failed")).alias("status"))


@query("SELECT n_nationkey AS k, list_has_any([n_name || ':latest', 'x'], [n_name]) OR len(list_filter([n_name || ':latest', 'x'], lambda m: starts_with(m, n_name || ':'))) > 0 AS found FROM nation")
def model_available(spark, sf_dir):
    """CON-03."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("k"), models.has_model(F.array(F.concat("n_name", F.lit(":latest")), F.lit("x")), F.col("n_name")).alias("found"))


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['x']) AS shares, CAST(len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_type, ' ')))) AS BIGINT) AS both_, CAST(len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))) AS BIGINT) AS either FROM part")
def token_overlap(spark, sf_dir):
    """SET-02."""
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(a, F.array(F.lit("x"))).alias("shares"), F.size(F.array_intersect(a, b)).cast("bigint").alias("both_"), F.size(F.array_union(a, b)).cast("bigint").alias("either"))


@query(f"""{SQL_CHUNKS} SELECT document_id, CAST(chunk_id AS BIGINT) AS chunk_id, CASE WHEN document_id % 3 <> 0 THEN '> ' || text END AS analysis_text FROM c""")
def resolved_texts(spark, sf_dir):
    """TXT-10, JOIN-14: chunks take their resolved texts where both sides have equally many; document_id % 3 = 0 has one more."""
    chunks = graph.cut(chunking.sentence_chunks(normal_docs(spark, sf_dir)))
    more = chunks.where("chunk_id = 0 AND document_id % 3 = 0").withColumn("chunk_id", F.lit(-1))
    resolved = chunks.union(more).withColumn("text", F.concat(F.lit("> "), "text"))
    return counted(windows.with_resolved_texts(chunks, resolved).select("document_id", "chunk_id", "analysis_text"), "chunk_id")


@query("SELECT document_id, CAST(0 AS BIGINT) AS clusters, FALSE AS changed FROM (SELECT doc_id AS document_id FROM documents)")
def coreference_noop(spark, sf_dir):
    """TXT-07: without a resolver, texts stay and no cluster is told."""
    return counted(coreference.coreference_stats(coreference.no_coreference(docs(spark, sf_dir).na.fill("", ["text"]))), "clusters")
