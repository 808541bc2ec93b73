"""Boolean retrieval: a query becomes a tree, the tree a column predicate or semi and anti joins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.index import Index, tokenise
from kiln.operators.ranked import small

#: What the query language consists of; the texts of its errors are fixed, too.
LEXEME = re.compile(r"\(|\)|\bAND\b|\bOR\b|\bNOT\b|[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*")
BINDING = {"OR": 1, "AND": 2, "NOT": 3}


class BooleanQueryError(ValueError):
    """The query has no meaning."""


@dataclass(frozen=True)
class Node:
    kind: str
    term: str = ""
    args: tuple[Node, ...] = ()


def lex(query: str | None) -> list[str]:
    """Parentheses, operators (any case) and terms; everything else is passed over."""
    found = LEXEME.findall(query or "")
    return [x.upper() if x.upper() in BINDING else x for x in found]


def parse(query: str | None) -> Node:
    """Precedence NOT, AND, OR. Operators are applied when one that binds less comes, so that a postfix order is
    understood as well; two terms side by side aren't."""
    lexemes = lex(query)
    if not lexemes:
        raise BooleanQueryError("Empty query")
    operands: list[Node] = []
    waiting: list[str] = []
    ready: list[str | Node] = []
    for x in lexemes:
        if x == "(":
            waiting.append(x)
        elif x == ")":
            while waiting and waiting[-1] != "(":
                ready.append(waiting.pop())
            if not waiting:
                raise BooleanQueryError("Mismatched parentheses in query")
            waiting.pop()
        elif x in BINDING:
            while waiting and waiting[-1] in BINDING and (BINDING[waiting[-1]] > BINDING[x] or BINDING[waiting[-1]] == BINDING[x] and x != "NOT"):
                ready.append(waiting.pop())
            waiting.append(x)
        else:
            ready.append(Node("TERM", x))
    if "(" in waiting:
        raise BooleanQueryError("Mismatched parentheses in query")
    for x in [*ready, *reversed(waiting)]:
        if isinstance(x, Node):
            operands.append(x)
            continue
        need = 1 if x == "NOT" else 2
        if len(operands) < need:
            raise BooleanQueryError("NOT without an operand" if need == 1 else f"{x} without two operands")
        args = tuple(operands[-need:])
        del operands[-need:]
        operands.append(Node(x, args=args))
    if len(operands) != 1:
        raise BooleanQueryError("Invalid query structure")
    return operands[0]


def leaves(node: Node) -> list[str]:
    return [node.term] if node.kind == "TERM" else sorted({t for a in node.args for t in leaves(a)})


def predicate(node: Node, flags: dict[str, Column]) -> Column:
    if node.kind == "TERM":
        return flags[node.term]
    args = [predicate(a, flags) for a in node.args]
    return ~args[0] if node.kind == "NOT" else args[0] & args[1] if node.kind == "AND" else args[0] | args[1]


def evaluate(index: Index, query: str) -> DataFrame:
    """(doc_id string) of the matches, in one pass: a flag per term and document."""
    node = parse(query)
    terms = leaves(node)
    every = index.flags(terms)
    return every.where(predicate(node, {t: F.col(f"t{i}") for i, t in enumerate(terms)})).select("doc_id")


def evaluate_by_joins(index: Index, query: str) -> DataFrame:
    """The same by set operations: AND is a semi join, AND NOT an anti join, OR a union, NOT the rest of the universe."""

    def go(node: Node) -> DataFrame:
        if node.kind == "TERM":
            return index.bool_postings.where(F.col("term") == node.term).select("doc_id").distinct()
        if node.kind == "NOT":
            return index.universe.join(go(node.args[0]), "doc_id", "left_anti")
        a, b = node.args
        if node.kind == "OR":
            return go(a).union(go(b)).distinct()
        if b.kind == "NOT":
            return go(a).join(go(b.args[0]), "doc_id", "left_anti")
        if a.kind == "NOT":
            return go(b).join(go(a.args[0]), "doc_id", "left_anti")
        return go(a).join(go(b), "doc_id", "left_semi")

    return go(parse(query))


#: Documents of a chunk: the bits of a bitmap that bitmap_construct_agg makes.
CHUNK = 32768
_CHUNK_SQL = f"number div {CHUNK}"


def bitmaps(index: Index, terms: DataFrame, numbers: DataFrame) -> DataFrame:
    """(term, chunk, bits): for the wanted terms (term) a bitmap of the documents that have them, by the documents' numbers
    (doc_id, number), in chunks of CHUNK documents."""
    wanted = index.bool_postings.join(small(terms), "term", "left_semi")
    placed = wanted.join(numbers, "doc_id").withColumn("chunk", F.expr(_CHUNK_SQL)).withColumn("bit", F.col("number") % CHUNK)
    return placed.groupBy("term", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def numbered(index: Index) -> DataFrame:
    """(doc_id, number): the universe, numbered from 0 by the ids as strings; by a range shuffle and counts per range."""
    placed = index.universe.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("at", 33).alias("part")
    parts = placed.groupBy(part).agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("all", F.lit(0))
    shift = F.sum("n").over(Window.partitionBy("all").orderBy("part")) - F.col("n") - F.col("first")  # a row for each range
    return placed.withColumn("part", part).join(F.broadcast(parts.select("part", shift.alias("shift"))), "part").select("doc_id", (F.col("at") + F.col("shift")).alias("number"))


@dataclass(frozen=True)
class Dag:
    """Trees of a batch as one graph: nodes (kind, term, arguments) by number, arguments before what uses them, each
    subterm once; roots by query."""

    nodes: tuple[tuple[str, str, tuple[int, ...]], ...]
    roots: dict


def merged(queries: dict) -> Dag:
    """Arguments of AND and OR are put in order, so that a AND b and b AND a are one node; NOT NOT a is a."""
    known: dict[tuple, int] = {}
    nodes: list[tuple] = []

    def put(node: Node) -> int:
        args = tuple(put(a) for a in node.args)
        if node.kind == "NOT" and nodes[args[0]][0] == "NOT":
            return nodes[args[0]][2][0]
        if node.kind in ("AND", "OR"):
            args = tuple(sorted(set(args)))
            if len(args) == 1:
                return args[0]
        made = (node.kind, node.term, args)
        if made not in known:
            known[made] = len(nodes)
            nodes.append(made)
        return known[made]

    roots = {qid: put(parse(text)) for qid, text in queries.items()}
    return Dag(tuple(nodes), roots)


def _evaluated(dag: Dag, size: int, held: dict[str, int]) -> list[int]:
    """Bits of every node over a chunk of size documents; NOT is what a chunk has besides."""
    full, out = (1 << size) - 1, []
    for kind, term, args in dag.nodes:
        if kind == "TERM":
            out.append(held.get(term, 0))
        elif kind == "NOT":
            out.append(full & ~out[args[0]])
        else:
            x = out[args[0]]
            for a in args[1:]:
                x = x & out[a] if kind == "AND" else x | out[a]
            out.append(x)
    return out


def search_many(index: Index, queries: dict, k: int | None = None) -> DataFrame:
    """(qid, doc_id) of the matches of all queries (qid: text) in one job, in no order; with k the first k of each query by
    ids as strings. A query without meaning raises, as it does alone.

    The postings of all terms are read once and become bitmaps of CHUNK documents; a chunk's bitmaps (a few kilobytes a
    term of the batch) meet in one row, where the merged trees are evaluated by operations on whole bitmaps. Chunks without
    any term are only made if some query has a NOT.
    """
    dag = merged(queries)
    spark = index.universe.sparkSession
    terms = spark.createDataFrame([(t,) for kind, t, _ in dag.nodes if kind == "TERM"], "term string")
    numbers = numbered(index)
    chunks = bitmaps(index, terms, numbers).groupBy("chunk").agg(F.collect_list(F.struct("term", "bits")).alias("held"))
    sizes = numbers.groupBy(F.expr(_CHUNK_SQL).alias("chunk")).agg(F.count("*").cast("int").alias("size"))
    if any(kind == "NOT" for kind, _, _ in dag.nodes):
        rows = sizes.join(chunks, "chunk", "left").select("chunk", "size", "held")
    else:
        rows = chunks.select("chunk", F.lit(CHUNK).alias("size"), "held")
    qids = list(dag.roots)
    kind = "string" if all(isinstance(x, str) for x in qids) else "long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, size, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bits = _evaluated(dag, size, {x["term"]: int.from_bytes(x["bits"], "little") for x in held or ()})
                for qid, root in dag.roots.items():
                    where = np.flatnonzero(np.unpackbits(np.frombuffer(bits[root].to_bytes(CHUNK // 8, "little"), "u1"), bitorder="little"))
                    where = where[:k] if k is not None else where
                    if len(where):
                        yield pa.RecordBatch.from_arrays([pa.array([qid] * len(where)), pa.array(where.astype("i8") + chunk * CHUNK)], names=["qid", "number"])

    found = rows.mapInArrow(run, f"qid {kind}, number long")
    if k is not None:
        w = Window.partitionBy("qid").orderBy("number")
        found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return found.join(numbers, "number").select("qid", "doc_id")


def search(index: Index, query: str, k: int | None = None) -> DataFrame:
    """Matches in the order of their ids as strings, the first k."""
    out = evaluate(index, query).orderBy("doc_id")
    return out if k is None else out.limit(k)


def normalise_query(query: str, clean) -> str:
    """Terms cleaned like the index's tokens: the first token counts; a term that is cleaned away stays in lower case."""
    out = []
    for x in lex(query):
        if x in BINDING or x in "()":
            out.append(x)
        else:
            got = clean(x)
            out.append(got[0] if got else x.lower())
    return " ".join(out)


def cleaned(index: Index, query: str) -> str:
    """The query with its terms cleaned by the index's own options; the terms of one query are all that is collected."""
    terms = sorted({x for x in lex(query) if x not in BINDING and x not in "()"})
    if not terms:
        return query
    each = tokenise(index.docs.sparkSession.createDataFrame([(t, t) for t in terms], "doc_id string, text string"), index.config, lexicon=index.lexicon if index.config.lemma else None)
    found = {r["doc_id"]: r["tokens"] for r in each.select("doc_id", "tokens").collect()}
    return normalise_query(query, lambda x: found.get(x, []))
