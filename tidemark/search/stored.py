"""Stored queries: many queries at once, by one join of all their words with the postings.

Each different query is parsed once, on executors, into its phrases and a program in postfix order. Words that
are prefixes become the words of the vocabulary that begin with them. Phrases are found by one aggregation on
the place where they would begin, and the program decides about each document from the hits gathered for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.search.engine import _folders, parse
from tidemark.search.syntax import Both, Near, Not, Phrase, phrases
from tidemark.search.upkeep import PARTS, part_of

#: Words of all queries that are broadcast at most.
BROADCAST_WORDS = 100_000
_PARSED = "struct<phrases:array<struct<tokens:array<string>,prefix:boolean,initial:boolean,column:string,placed:boolean>>,program:array<struct<op:string,args:array<int>,distance:int>>>"


def _program(node, known: list[Phrase]) -> list[tuple]:
    if isinstance(node, Phrase):
        return [("phrase", [known.index(node)] if node.tokens else [], 0)]
    if isinstance(node, Near):
        return [("near", [known.index(p) for p in node.phrases], node.distance)]
    if isinstance(node, Not):
        return [*_program(node.left, known), *_program(node.right, known), ("not", [], 0)]
    parts = [_program(p, known) for p in node.parts if not (isinstance(p, Phrase) and not p.tokens)]
    sign = ("and" if isinstance(node, Both) else "or", [], 0)
    return [x for k, p in enumerate(parts) for x in (p + [sign] if k else p)] or [("phrase", [], 0)]


def compiled(typed: str | None):
    """(phrases, program) of a query, taken as it is or else rewritten; None if it is no query."""
    for raw in (True, False):
        try:
            query = parse(typed or "", raw)
        except ValueError:
            continue
        known = phrases(query)
        program = _program(query, known)
        near = {k for op, args, _ in program if op == "near" for k in args}
        return [(list(p.tokens), p.prefix, p.initial, p.column, k in near) for k, p in enumerate(known)], program
    return None


def _near(hits: Column, step: Column) -> Column:
    def of(k: Column) -> Column:
        return F.filter(hits, lambda h: h["phrase"] == k)

    def behind(x: Column, y: Column) -> Column:
        return y["col"].eqNullSafe(x["col"]) & (y["start"] >= x["start"]) & (y["start"] - x["start"] - x["size"] <= step["distance"])

    return F.exists(step["args"], lambda first: F.exists(of(first), lambda x: F.forall(step["args"], lambda k: (k == first) | F.exists(of(k), lambda y: behind(x, y)))))


def _holds(program: Column, hits: Column) -> Column:
    """Runs a program on a stack of booleans."""

    def step(stack: Column, s: Column) -> Column:
        depth = F.size(stack)
        a, b, rest = F.get(stack, depth - 2), F.get(stack, depth - 1), F.slice(stack, 1, F.greatest(depth - 2, F.lit(0)))
        return (
            F.when(s["op"] == "phrase", F.concat(stack, F.array(F.exists(hits, lambda h: h["phrase"] == F.coalesce(F.get(s["args"], 0), F.lit(-1))))))
            .when(s["op"] == "near", F.concat(stack, F.array(_near(hits, s))))
            .when(s["op"] == "and", F.concat(rest, F.array(a & b)))
            .when(s["op"] == "or", F.concat(rest, F.array(a | b)))
            .otherwise(F.concat(rest, F.array(a & ~b)))
        )

    return F.get(F.aggregate(program, F.array().cast("array<boolean>"), step), F.lit(0))


def match_all(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, at_doc) of all documents that each query of ``queries`` (query) matches, in the language of the search.

    ``postings`` are (at_doc, token) with ``col`` and ``pos`` if they are known; without ``pos`` a query that needs
    places fails. A text that is no query, and a null one, match nothing.
    """
    placed = "pos" in postings.columns
    stored = "part" in postings.columns  # folders of a stored index: those of the words and prefixes are read
    postings = postings.withColumns({c: F.lit(None).cast(t) for c, t in (("col", "string"), ("pos", "int")) if c not in postings.columns})
    parsed = queries.select("query").distinct().withColumn("p", F.udf(compiled, _PARSED)("query")).where("p IS NOT NULL").select("query", "p.*")
    terms = parsed.select("query", F.posexplode("phrases").alias("phrase", "x"))
    terms = terms.select("query", "phrase", "x.prefix", "x.initial", "x.column", "x.placed", F.size("x.tokens").alias("size"), F.posexplode("x.tokens").alias("part", "token"))
    last = F.col("prefix") & (F.col("part") == F.col("size") - 1)
    begun = terms.where(last).withColumnRenamed("token", "begin")
    vocabulary = postings
    if stored:
        begins = [r["begin"] for r in begun.select(F.substring("begin", 1, 2).alias("begin")).distinct().limit(PARTS + 1).collect()]
        if len(begins) <= PARTS and all(len(b) > 1 for b in begins):
            vocabulary = postings.where(_folders(begins)) if begins else postings.limit(0)
    sizes = begun.agg(F.collect_set(F.length("begin")).alias("sizes"))
    vocabulary = vocabulary.select("token").distinct().join(F.broadcast(sizes))
    vocabulary = vocabulary.select("token", F.explode(F.filter("sizes", lambda n: n <= F.length("token"))).alias("n")).select("token", F.expr("substring(token, 1, n)").alias("begin"))
    words = terms.where(~last).unionByName(begun.join(vocabulary, "begin").drop("begin")).cache()
    # Few words go to the postings, so that these are not exchanged; many are joined by token.
    many = words.count() > BROADCAST_WORDS
    if stored:
        folders = [r["part"] for r in words.select(part_of(F.col("token")).alias("part")).distinct().collect()]  # PARTS at most
        postings = postings.where(F.col("part").isin(folders)).drop("part")
    words = words if many else F.broadcast(words)
    rows = words.join(postings, "token").where((F.col("column").isNull() | (F.lower("col") == F.col("column"))) & (~F.col("initial") | (F.col("pos") == F.col("part")) | F.col("pos").isNull()))
    if not placed:
        needs = F.col("placed") | F.col("initial") | (F.col("size") > 1)
        rows = rows.withColumn("pos", F.when(needs, F.raise_error(F.lit("postings without pos can't answer phrases")).cast("int")).otherwise(F.col("pos")))
    start = F.when(F.col("placed") | (F.col("size") > 1), F.col("pos") - F.col("part")).otherwise(F.lit(0))
    found = rows.select("query", "at_doc", "col", "phrase", "size", "placed", start.alias("start"), "part")
    found = found.groupBy("query", "at_doc", "col", "phrase", "size", "placed", "start").agg(F.count_distinct("part").alias("parts")).where("parts = size")
    hit = F.struct("phrase", "col", "size", F.when(F.col("placed"), F.col("start")).otherwise(F.lit(0)).alias("start"))
    found = found.groupBy("query", "at_doc").agg(F.collect_set(hit).alias("hits"))
    return found.join(parsed.select("query", "program"), "query").where(_holds(F.col("program"), F.col("hits"))).select("query", "at_doc")
