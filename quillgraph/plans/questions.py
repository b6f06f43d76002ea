"""Questions over graphs: intents, plans, guard, answers, highlights and evidence."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import graph as G
from ..sources.models import Model

PATH, INFLUENCE, CENTRALITY, SUMMARY, BASIC, FALLBACK = "relationship_path", "ranking_influence", "ranking_centrality", "lookup_summary", "lookup_basic", "generic_fallback"


def intent(question: Column, matched: Column) -> Column:
    """The intent of a question with ``matched`` entities; the first rule that holds counts."""
    q = F.lower(X.strip(F.coalesce(question, F.lit(""))))
    has = lambda *parts: F.lit(False) if not parts else _any(F.contains(q, F.lit(p)) for p in parts)
    starts = lambda *parts: _any(F.startswith(q, F.lit(p)) for p in parts)
    return (
        F.when(starts("how are ", "how is ") & has(" related") & (matched >= 2), PATH)
        .when(has("most influential", "who is influential"), INFLUENCE)
        .when(has("who is central", "what is central", "most central"), CENTRALITY)
        .when(starts("tell me about ", "what can you tell me about ") & (matched >= 1), SUMMARY)
        .when(starts("who is ", "what is ") & (matched >= 1), BASIC)
        .otherwise(FALLBACK)
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def entity_names(nodes: DataFrame) -> DataFrame:
    """Names and aliases of each document, blank ones left out."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in nodes.columns else F.array("name")
    rows = nodes.select("document_id", F.explode(names).alias("name")).select("document_id", X.strip(F.coalesce("name", F.lit(""))).alias("name"))
    return rows.where("name <> ''").distinct()


#: Letters, digits and underscores: a name ends where none of these goes on.
WORD = re.compile(r"\w+")


@lru_cache(1 << 16)
def _first_word(low: str) -> tuple[str, int]:
    """A name's first word and its place; an empty word if it has no letter."""
    word = WORD.search(low)
    return (word[0], word.start()) if word else ("", 0)


class _Known:
    """The names of one document by their lower case, and for each first word its places in them with their lengths: a word
    of a question looks up one piece of the text for each of these, however many names begin with it."""

    def __init__(self) -> None:
        self.names: dict[str, set[str]] = {}
        self.by_word: dict[str, set[tuple[int, int]]] = {}

    def add(self, name: str, low: str) -> None:
        if low in self.names:
            self.names[low].add(name)
            return
        self.names[low] = {name}
        first, skip = _first_word(low)
        self.by_word.setdefault(first, set()).add((skip, len(low)))

    def spans(self, low: str) -> set[tuple[int, int, str]]:
        """(-length, start, name) of each place where a name stands as whole words in a text in lower case."""
        out, names, by_word = set(), self.names, self.by_word
        places = [(m.start(), by_word[m[0]]) for m in WORD.finditer(low) if m[0] in by_word] if names else []
        if "" in by_word:  # names without any letter stand at the other characters
            places += [(i, by_word[""]) for i, c in enumerate(low) if not WORD.match(c)]
        for at, shapes in places:
            for skip, n in shapes:
                start = at - skip
                found = names.get(low[start : start + n]) if start >= 0 else None
                if found and not (start and WORD.match(low, start - 1)) and not WORD.match(low, start + n):
                    for name in found:
                        out.add((-n, start, name))
        return out


def _longest(spans: set[tuple[int, int, str]]) -> list[str]:
    """The names of the longest spans, ties by place, then name, that don't overlap one taken before.  That is no shorter,
    so it holds the first or last character of a span that it overlaps."""
    out, taken = [], set()
    for minus, start, name in sorted(spans):
        end = start - minus
        if start not in taken and end - 1 not in taken:
            out.append(name)
            taken.update(range(start, end))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``document_id, question_id, name, low, row`` with each document's names before its questions, and rows of one question
    together, to the questions' ``row`` and ``matched``.  One document's names are held at a time."""
    document, known, question, spans, waiting, held = None, _Known(), None, set(), 0, []
    make = lambda rows, found: pa.RecordBatch.from_arrays([rows, pa.array(found, pa.list_(pa.string()))], names=["row", "matched"])
    for batch in batches:
        column, found = batch.column, []
        asked = np.flatnonzero(column("name").is_null().to_numpy(zero_copy_only=False))
        ids = iter(column("question_id").take(pa.array(asked)).to_pylist())
        # as numpy gives strings and whole numbers in a fifteenth of the time
        plain = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
        for d, name, low in zip(plain(column("document_id")), column("name").to_numpy(zero_copy_only=False), plain(column("low")), strict=True):
            if d != document:
                document, known = d, _Known()
            if name is not None:
                known.add(name, low)
                continue
            q = next(ids)
            if (d, q) != question:
                found += [_longest(spans)] * waiting
                question, spans, waiting = (d, q), set(), 0
            waiting += 1
            if d is not None and q is not None:
                spans |= known.spans(low)
        held.append(batch.column("row").take(pa.array(asked)))
        if found:
            rows = pa.concat_arrays(held)
            yield make(rows.slice(0, len(found)), found)
            held = [rows.slice(len(found))]
    if waiting:
        yield make(pa.concat_arrays(held), [_longest(spans)] * waiting)


def matched_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``questions(document_id, question_id, question)`` with ``matched``, the names of the same document that each has as
    whole words, whatever their case.

    Questions and ``names(document_id, name)`` are dealt once, by document, and sorted there, so no more than the texts and
    names is shuffled.  Python takes them as they come, in time that grows with the texts: a name can only stand where its
    first word does, and what is found is an interval.  Per question the longest are taken first (ties: by place, then name)
    if they don't overlap one that is taken; built-ins took the square of a text's words for that.  A question without names
    has an empty array."""
    whole = F.struct(*[F.col(f"`{c}`") for c in questions.columns])
    asked = questions.select("document_id", "question_id", whole.alias("row"), F.lit(None).cast("string").alias("name"))
    told = names.where("document_id is not null and name <> ''").select("document_id", F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "name")
    dealt = asked.union(told).repartition("document_id").sortWithinPartitions("document_id", F.col("name").isNull(), "question_id")
    dealt = dealt.select("document_id", "question_id", "name", F.lower(F.coalesce("name", "row.question", F.lit(""))).alias("low"), "row")
    each = dealt.mapInArrow(_found, T.StructType([dealt.schema["row"], T.StructField("matched", T.ArrayType(T.StringType()))]))
    first = ["document_id", "question_id"]
    return each.select(*[F.col("row").getField(c).alias(c) for c in [*first, *[c for c in questions.columns if c not in first]]], "matched")


def analyses(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``questions`` with ``intent`` and the ``matched`` names that its plan takes: two for a path, one for a lookup, none
    for a ranking, all for the fallback."""
    rows = matched_names(questions, names)
    rows = rows.withColumn("intent", intent(F.col("question"), F.size("matched")))
    most = F.when(F.col("intent") == FALLBACK, F.size("matched")).when(F.col("intent") == PATH, 2).when(F.col("intent").isin(SUMMARY, BASIC), 1).otherwise(0)
    return rows.withColumn("matched", F.slice("matched", F.lit(1), most))


@dataclass
class Analysis:
    intent: str
    matched_entities: list[str]
    strategy: str = "intent_query_builder"
    fallback_used: bool = False
    max_hops: int | None = None
    ranking_basis: str | None = None


def analyze(question: str, nodes: DataFrame) -> Analysis:
    """One question as a table of one row; only its own analysis comes to the driver."""
    names = entity_names(nodes).withColumn("document_id", F.lit(0).cast("long"))
    asked = nodes.sparkSession.createDataFrame([(0, 0, question.strip())], "document_id long, question_id long, question string")
    got = analyses(asked, names).select("intent", "matched").first()
    if got.intent == FALLBACK:
        return Analysis(got.intent, got.matched, "generated_query", True)
    return Analysis(got.intent, got.matched, max_hops=3 if got.intent == PATH else None, ranking_basis={INFLUENCE: "incoming_plus_outgoing_edges", CENTRALITY: "degree"}.get(got.intent))


def plan(a: Analysis, nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """The rows that answer an intent, or None for the fallback."""
    if a.intent == BASIC:
        return G.lookup(nodes, a.matched_entities[0]).select("entity_name", "label")
    if a.intent == SUMMARY:
        return G.summary(nodes, edges, a.matched_entities[0]).drop("document_id")
    if a.intent == PATH:
        return G.shortest_path(nodes, edges, *a.matched_entities[:2], a.max_hops or 3).drop("document_id")
    if a.intent in (CENTRALITY, INFLUENCE):
        score = "degree" if a.intent == CENTRALITY else "influence_score"
        return G.ranking(nodes, edges, score).orderBy("place").drop("document_id", "place")
    return None


#: Words that the textual guard refuses, and those with which a query may begin.
FORBIDDEN = ("CREATE ", "MERGE ", "DELETE ", "DETACH DELETE ", "SET ", "REMOVE ", "DROP ", "LOAD CSV ", "FOREACH ")
READ_ONLY_STARTS = ("MATCH", "OPTIONAL MATCH", "WITH", "RETURN", "CALL")


def textual_guard(query: Column) -> Column:
    """The reason why a graph query text is refused, or null.  It looks for words, not for their meaning."""
    q = F.upper(query)
    out = F.when(~_any(F.startswith(q, F.lit(s)) for s in READ_ONLY_STARTS), "not read-only").when(~F.contains(q, F.lit("DOCUMENT_ID")), "not scoped to a document")
    found = F.coalesce(*[F.when(F.contains(q, F.lit(w)), w.strip()) for w in FORBIDDEN])
    return F.when(found.isNotNull(), F.concat(F.lit("contains "), found)).otherwise(out)


#: What a generated query may be made of, by the names of Spark's plan and expression classes.
PLAN_PARTS = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LocalLimit LocalRelation LogicalRDD OneRowRelation Project Sort SubqueryAlias Union View Window WithCTE WithWindowDefinition "
    "Alias AttributeReference Literal OuterReference ScalarSubquery ListQuery InSubquery Exists SortOrder Cast TypeCast And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual In InSet Between IsNull IsNotNull CaseWhen If Coalesce NullIf Nvl "
    "Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Abs Round BRound Ceil Floor Greatest Least Pow Sqrt "
    "Upper Lower Length OctetLength Concat ConcatWs Substring SubstringIndex Left Right StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringReplace StringInstr StringLocate StringSplit Like LikeAny LikeAll RLike RegExpReplace RegExpExtract StartsWith EndsWith Contains ContainsExpressionBuilder InitCap Reverse StringLPad StringRPad "
    "AggregateExpression Count CountIf Sum Average Min Max MinBy MaxBy First Last CollectList CollectSet BoolAnd BoolOr "
    "WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ RowNumber Rank DenseRank NTile Lag Lead "
    "CreateArray CreateNamedStruct GetStructField GetArrayItem GetArrayStructFields GetMapValue ElementAt Size ArrayContains ArrayJoin ArraySort SortArray ArrayDistinct Explode PosExplode MapKeys MapValues".split()
)


def guarded(spark: SparkSession, query: str, views: set[str]) -> DataFrame:
    """The rows of a SQL query that only reads the given views of the session; anything else is a ValueError.

    The query is first analysed, as a subquery (so it can be no command), in a session that has nothing but empty
    frames under the views' names: a table, another view, a file or a name that a CTE doesn't hide is then unknown.
    What sessions share, such as global temporary views, is known by a qualified name or not at all, so each view of the
    analysed plan must be one of the given, and what it reads its empty frame.  Every part of the plan must be on the list
    above."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.runSQLOnFiles", "false")
    marks = {}
    for v in views:
        # a column that tells the frame from any other rows
        marks[v] = f"_{v}_{uuid.uuid4().hex}"
        frame = apart.createDataFrame([], T.StructType([*spark.table(v).schema.fields, T.StructField(marks[v], T.NullType())]))
        frame.createOrReplaceTempView(f"{v}{marks[v]}")
        apart.table(f"{v}{marks[v]}").drop(marks[v]).createOrReplaceTempView(v)
    try:
        apart.sql(f"SELECT * FROM (\n{query}\n) AS q")
        analysed = apart.sql(query)
    except ParseException as e:
        raise ValueError(f"no query that reads: {e.getCondition()}") from e
    except AnalysisException as e:
        if e.getCondition() in ("UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
            raise  # the model may mend a wrong column
        raise ValueError(f"the query doesn't fit the views: {e.getCondition()}") from e
    tree = json.loads(analysed._jdf.queryExecution().analyzed().toJSON())
    if odd := _parts(tree) - PLAN_PARTS:
        raise ValueError(f"the query may not use {sorted(odd)}")
    if not all(any(m in named for m in marks.values()) for named in _leaves(tree)):
        raise ValueError("the query may only read the given views")
    return spark.sql(query)


def _leaves(plan) -> list[str]:
    """Of each relation in a plan and its subqueries, its columns."""
    if isinstance(plan, list):
        return [x for p in plan for x in _leaves(p)]
    if not isinstance(plan, dict):
        return []
    own = [json.dumps(plan.get("output"))] if plan.get("class", "").rpartition(".")[2] in ("LocalRelation", "LogicalRDD") else []
    return own + [x for v in plan.values() for x in _leaves(v)]


def _parts(plan) -> set[str]:
    """The names of all classes in a plan, its expressions and their subqueries."""
    if isinstance(plan, list):
        return set().union(*map(_parts, plan))
    if not isinstance(plan, dict):
        return set()
    return set().union({plan["class"].rpartition(".")[2]} if "class" in plan else set(), *map(_parts, plan.values()))


def answer_shortcut(rows: list[dict]) -> str | None:
    """Rows of one column answer by themselves."""
    if rows and all(len(r) == 1 for r in rows):
        return ", ".join(str(v) for r in rows for v in r.values())
    return None


def shortcut(rows: DataFrame, value: str, order: str, key: str = "document_id") -> DataFrame:
    """The same for many answers at once: each key's values in order, with commas."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["v"]), ", ").alias("answer"))


def highlight(nodes: DataFrame, edges: DataFrame, names: DataFrame, types: DataFrame | None = None, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that an answer touches.

    ``names(document_id, name)`` and ``types(document_id, type)`` are values of the answer's rows; ``paths(document_id,
    path_node_ids, path_edges)`` the explicit paths.  A name is its last node.  An edge counts if both ends are chosen,
    if its type is named, or if it lies on a path."""
    order = "ord" if "ord" in nodes.columns else "id"
    by_name = nodes.groupBy("document_id", F.lower(X.strip(F.col("name"))).alias("k")).agg(F.max_by("id", order).alias("id"))
    chosen = names.select("document_id", F.lower(X.strip(F.col("name"))).alias("k")).join(by_name, ["document_id", "k"]).select("document_id", "id")
    if paths is not None:
        chosen = chosen.union(paths.select("document_id", F.explode("path_node_ids").alias("id")))
    chosen = chosen.distinct()
    ends = edges.select("document_id", "source", "type", "target", X.edge_id(F.col("source"), F.col("type"), F.col("target")).alias("id"))
    s, t = (chosen.select("document_id", F.col("id").alias(c)) for c in ("source", "target"))
    found = ends.join(s, ["document_id", "source"], "left_semi").join(t, ["document_id", "target"], "left_semi").select("document_id", "id")
    if types is not None:
        found = found.union(ends.join(types.select("document_id", F.upper("type").alias("type")), ["document_id", "type"], "left_semi").select("document_id", "id"))
    if paths is not None:
        steps = paths.select("document_id", F.explode("path_edges").alias("e"))
        found = found.union(steps.select("document_id", X.edge_id(F.col("e.source"), F.col("e.type"), F.col("e.target")).alias("id")))
    return chosen, found.distinct()


def provenance(nodes: DataFrame, edges: DataFrame, node_ids: DataFrame, edge_ids: DataFrame, top: int = 6) -> DataFrame:
    """Evidence for highlighted nodes, then edges, in order of their ids; equal evidence once, ``top`` a document."""
    where = ["provenance.chunk_id", "provenance.start_index", "provenance.end_index"]
    source = X.strip(F.coalesce(F.col("provenance.source_text"), F.lit("")))
    n = nodes.join(node_ids, ["document_id", "id"], "left_semi").where(source != "")
    n = n.select("document_id", F.lit(0).alias("rank"), "id", F.lit("node").alias("kind"), F.concat("name", F.lit(" ("), "label", F.lit(")")).alias("title"), *where, source.alias("source_text"), X.snippet(source, [F.col("name")]).alias("snippet"))
    e = edges.join(edge_ids, ["document_id", "id"], "left_semi").where(source != "")
    title = F.concat("source_name", F.lit(" -["), "type", F.lit("]-> "), "target_name")
    e = e.select("document_id", F.lit(1).alias("rank"), "id", F.lit("edge").alias("kind"), title.alias("title"), *where, source.alias("source_text"), X.snippet(source, [F.col("source_name"), F.col("target_name"), F.col("type")]).alias("snippet"))
    both = n.unionByName(e)
    first = both.groupBy("document_id", "kind", "title", F.col("chunk_id").alias("c"), F.col("source_text").alias("s")).agg(F.min_by(F.struct(*[x for x in both.columns if x not in ("document_id", "kind", "title")]), F.struct("rank", "id")).alias("r")).select("document_id", "kind", "title", "r.*")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("rank", "id"))
    return first.withColumn("place", place).where(F.col("place") <= top).drop("rank", "id")


def schema_summary(nodes: DataFrame, edges: DataFrame, sample: int = 25) -> DataFrame:
    """Labels, relation types and the first names of each document."""
    n = nodes.groupBy("document_id").agg(F.array_sort(F.collect_set("label")).alias("entity_labels"))
    names = nodes.where("name <> ''").select("document_id", "name").distinct()
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("name"))
    names = names.withColumn("p", place).where(F.col("p") <= sample).groupBy("document_id").agg(F.array_sort(F.collect_list("name")).alias("sample_entity_names"))
    e = edges.groupBy("document_id").agg(F.array_sort(F.collect_set("type")).alias("relationship_types"))
    return n.join(names, "document_id", "left").join(e, "document_id", "left")


SQL_PROMPT = "Write one Spark SQL query that answers the question. It may only read the views kg_nodes(id, name, label) and kg_edges(source, target, source_name, target_name, type).\nSchema: {schema}\nQuestion: {question}\n{more}"
ANSWER_PROMPT = "Answer the question from these rows only.\nQuestion: {question}\nRows: {rows}"


class Engine:
    """Questions about one document: analysis, plan or generated query, one repair, answer, highlight and evidence."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, model: Model, rows: int = 1_000):
        self.spark, self.nodes, self.edges, self.model, self.rows = spark, nodes, edges, model, rows

    def _generated(self, nodes: DataFrame, edges: DataFrame, question: str) -> tuple[str, DataFrame]:
        nodes.createOrReplaceTempView("kg_nodes")
        edges.createOrReplaceTempView("kg_edges")
        views = {"kg_nodes", "kg_edges"}
        schema = [r.asDict(True) for r in schema_summary(nodes, edges).collect()]
        query = plain_answer(self.model.complete(SQL_PROMPT.format(schema=json.dumps(schema), question=question, more="")))
        try:
            rows = guarded(self.spark, query, views)
            rows.limit(1).collect()  # errors at run time count too
        except (AnalysisException, PySparkException) as e:
            more = f"This query failed: {query}\nError: {e}"
            query = plain_answer(self.model.complete(SQL_PROMPT.format(schema=json.dumps(schema), question=question, more=more)))
            rows = guarded(self.spark, query, views)
        return query, rows

    def ask(self, document_id: int, question: str) -> dict:
        """Names, relation types, highlight and evidence come from all rows of the answer, on the executors.  ``rows`` has
        at most ``self.rows`` of them, as a client and a model can take; ``truncated`` says whether there are more."""
        nodes, edges = G.scoped(self.nodes, document_id), G.scoped(self.edges, document_id)
        a = analyze(question, nodes)
        rows, query = plan(a, nodes, edges), a.intent
        if rows is None:
            query, rows = self._generated(nodes, edges, question)
        got = [r.asDict(True) for r in rows.limit(self.rows + 1).collect()]
        truncated, got = len(got) > self.rows, got[: self.rows]
        answer = answer_shortcut(got)
        if answer is None:
            answer = self.model.complete(ANSWER_PROMPT.format(question=question, rows=json.dumps(got, default=str)))
        if truncated:
            answer += f" (from the first {self.rows} rows)"
        scope = F.lit(document_id).cast("long").alias("document_id")
        names, types = (rows.select(F.explode(values_of(rows.schema, fields)).alias(k)).distinct().select(scope, k) for k, fields in (("name", NAME_FIELDS), ("type", TYPE_FIELDS)))
        paths = rows.withColumn("document_id", scope) if a.intent == PATH else None
        node_ids, edge_ids = highlight(nodes, edges, names, None if a.intent == PATH else types, paths)
        evidence = provenance(nodes, edges, node_ids, edge_ids).orderBy("place").drop("document_id", "place").collect() if "provenance" in nodes.columns and "provenance" in edges.columns else []
        return {
            "question": question, "query": query, "rows": got, "truncated": truncated, "answer": answer, "question_analysis": a.__dict__,
            "highlight": {"node_ids": sorted(r.id for r in node_ids.collect()), "edge_ids": sorted(r.id for r in edge_ids.collect()), "focus": True},
            "provenance": [r.asDict(True) for r in evidence],
        }


def plain_answer(answer: str) -> str:
    """A model's answer without its code fence."""
    text = answer.strip()
    return re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", text)).strip() if text.startswith("```") else text


#: Fields whose values are entity names, and those whose values are relation types.
NAME_FIELDS = ("name", "entity_name", "entity", "related_entity", "source", "target")
TYPE_FIELDS = ("relation", "relation_type", "type")


def values_of(schema: T.StructType, fields: tuple[str, ...]) -> Column:
    """An array of the values, without blanks around them, of all string fields of these names, however nested."""
    none = F.array().cast("array<string>")

    def within(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, T.StructType):
            parts = [F.array(value.getField(f.name)) if isinstance(f.dataType, T.StringType) and f.name in fields else within(f.dataType, value.getField(f.name)) for f in kind]
            return F.concat(none, *[F.coalesce(p, none) for p in parts])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.coalesce(F.flatten(F.transform(value, lambda x: within(kind.elementType, x))), none)
        return none

    found = within(schema, F.struct(*[F.col(f"`{c}`") for c in schema.names]))
    return F.filter(F.transform(F.array_distinct(F.array_compact(found)), X.strip), lambda v: v != "")
