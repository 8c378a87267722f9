"""Segments of a source: which blocks it has, how they hang together, and which of them say little.

Python code runs here and in the parser alone, one source at a time, with nothing shared between sources.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import gt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.operators.java_source import Node, ParseError, locate_unit, parse

#: Units of so few lines are kept whole.
SMALL_UNIT = 3
#: What is made of so many sources, or of so many bytes of them, is held by Python at a time: some hundred times their text.
PART_ROWS, PART_BYTES = 200, 1 << 18
SEGMENT = "struct<ordinal: int, label: string, kind: string, start_off: int, end_off: int, start_line: int, end_line: int, depth: int, weight: double, benefit: double, is_root: boolean, irrelevant: boolean>"
EDGE = "struct<from_ord: int, to_ord: int, weight: double>"
NAME = "struct<pos: int, name: string, start_off: int, end_off: int>"
UNIT = "struct<kind: string, name: string, ordinal: int, start_off: int, end_off: int, start_line: int, end_line: int>"
PARSED = f"source_id long, unit {UNIT}, units array<{UNIT}>, segments array<{SEGMENT}>, edges array<{EDGE}>, names array<{NAME}>, error string, left_out array<struct<start_off: int, end_off: int>>"


class Lines:
    """Line numbers, from 1, by offset."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, offset: int) -> int:
        return bisect_left(self.ends, offset) + 1


class SegmentGraph:
    """Blocks of a unit in order of insertion, and edges from a block to those within it or called by it.

    With compat, a method without a body and an edge that closes a cycle (recursive calls) are errors; else such a
    method has no segment and such an edge is left out.
    """

    def __init__(self, every: list[Node], unit: Node, line: Lines, compat: bool = True):
        self.unit, self.line, self.compat = unit, line, compat
        self.nodes: list[Node] = []
        self.place: dict[Node, int] = {}
        self.weight: list[float] = []
        self.benefit: list[float] = []
        self.edges: dict[tuple[int, int], None] = {}  # in order of insertion
        self.after: dict[int, list[int]] = {}
        self.root: int | None = None
        self.visited: set[Node] = set()
        self.outsiders: list[Node] = []
        self.names = Counter([n.name for n in every if n.kind == "name"])
        self.gains: dict[Node, float] = {}
        self.callees: dict[tuple[str, int], Node] = {}
        for m in every:
            if m.kind == "method":
                self.callees.setdefault((m.name, m.parameters), m)
        self.follow(unit)

    def gain(self, target: Node) -> float:
        """What a block gains by each edge to it: how often else the names are said that its parts say."""
        if target not in self.gains:
            self.gains[target] = sum([abs(self.names[name] - 1) for part in target.parts for name in said_names(part)]) / max(1, target.depth)
        return self.gains[target]

    def lines_of(self, node: Node) -> int:
        return self.line(max(node.start, node.end - 1)) - self.line(node.start) + 1

    def vertex(self, node: Node) -> int:
        if node not in self.place:
            self.place[node] = len(self.nodes)
            self.nodes.append(node)
            self.weight.append(float(self.lines_of(node)))
            self.benefit.append(1.0)
        return self.place[node]

    def rooted(self, node: Node) -> int:
        v = self.vertex(node)
        if self.root is None:
            self.root = v
        return v

    def reaches(self, start: int, goal: int) -> bool:
        stack, seen = [start], set()
        while stack:
            v = stack.pop()
            if v == goal:
                return True
            if v not in seen:
                seen.add(v)
                stack += self.after.get(v, ())
        return False

    def connect(self, source: Node, target: Node) -> None:
        """An edge, unless the target already is a direct parent of the source; the target gains by it."""
        a, b = self.vertex(source), self.vertex(target)
        if (b, a) in self.edges:
            return
        if (a, b) not in self.edges:
            if self.reaches(b, a):
                if self.compat:
                    raise ParseError("calls between blocks form a cycle")
                return
            self.edges[a, b] = None
            self.after.setdefault(a, []).append(b)
        self.benefit[b] += self.gain(target)
        if source.covers(target):
            self.weight[b] = max(0.0, self.weight[a] - self.weight[b])

    def in_scope(self, node: Node) -> bool:
        return self.unit.covers(node) or any(o.covers(node) for o in self.outsiders)

    def follow(self, node: Node) -> None:
        kind = node.kind
        if kind == "block" and self.in_scope(node):
            around = enclosing_block(node)
            if around is not None and not (around in self.visited and node in self.visited):
                self.connect(around, node)
            self.expand(node)
        elif kind == "method" and self.in_scope(node):
            body = first_block(node)
            around = enclosing_block(node)
            if around is None:
                if body is None:
                    if self.compat:
                        raise ParseError(f"method {node.name} has no body")
                    return
                self.rooted(node)
                around = node
            if body is not None:
                self.link(around, body)
                self.expand(body)
        elif kind == "call" and self.unit.covers(node):
            callee = self.callees.get((node.name, node.parameters))
            body = callee and first_block(callee)
            if body is not None:
                around = enclosing_block(node)
                if around is not None:
                    self.link(around, body)
                self.expand(body)
        for part in node.parts:
            if part.kind != "name":  # which has no parts
                self.follow(part)

    def link(self, source: Node, target: Node) -> None:
        if source is target:
            return
        self.connect(source, target)
        if not source.covers(target) and target not in self.visited:
            self.outsiders.append(target)
            self.follow(target)

    def expand(self, node: Node) -> None:
        self.rooted(node)
        for block in [] if node in self.visited else blocks_beneath(node):
            if block in self.visited:
                continue
            self.visited.add(block)
            if block is not node:
                self.connect(node, block)
                self.follow(block)

    def irrelevant(self, compat: bool = True) -> set[int]:
        """Segments that a choice of most benefit within the unit's lines leaves out; none of a small unit or a single segment.

        A segment is taken only if the one inserted after it is its direct child. compat=False also keeps what holds a
        segment that is kept.
        """
        room, n = self.lines_of(self.unit), len(self.nodes)
        if room <= SMALL_UNIT or n <= 1:
            return set()
        above = [0.0] * (room + 1)
        takes: list[bytes | None] = []  # by room, of the segments that can be taken
        for k in range(n):
            weight, benefit = int(self.weight[k]), self.benefit[k]
            least = max(1, weight)
            if least > room:
                takes.append(None)
                continue
            without, with_ = above[least:], [benefit + x for x in above[least - weight : room + 1 - weight]]
            takes.append(bytes(least) + bytes(map(gt, with_, without)) if (k, k + 1) in self.edges else None)
            above[least:] = map(max, without, with_)
        left, w = set(range(n)), room
        for k in range(n - 1, -1, -1):
            if (take := takes[k]) and take[w]:
                left.discard(k)
                w = int(w - self.weight[k])
        if not compat:
            kept = [k for k in range(n) if k not in left]
            left = {k for k in left if not any(self.nodes[k].covers(self.nodes[j]) for j in kept)}
        return left


def enclosing_block(node: Node) -> Node | None:
    node = node.parent
    while node is not None and node.kind != "block":
        node = node.parent
    return node


def first_block(node: Node) -> Node | None:
    return node if node.kind == "block" else next((p for p in node.parts if p.kind == "block"), None)


def blocks_beneath(node: Node) -> list[Node]:
    """node and all blocks in it, outer ones first; of an if, only the first block that is a part of it."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.kind == "block":
            found.append(n)
        if n.kind == "if":
            block = first_block(n)
            if block is not None:
                todo.append(block)
        elif n.parts:
            todo += [p for p in n.parts[::-1] if p.kind != "name"]
    return found


def said_names(node: Node) -> list[str]:
    """Names that a part of a block says: of a call, its own and its arguments'; of a labelled statement, the label."""
    if node.kind == "name":
        return [node.name]
    if node.kind == "labeled":
        return [node.parts[0].name]
    said: list[str] = []
    for p in node.parts:
        if p.kind == "name":
            said.append(p.name)
        elif p.parts:
            said += said_names(p)
    return said


def describe(text: str, relevant: frozenset[str], compat: bool = True, wanted: frozenset[str] | None = None) -> dict:
    """Unit, segments, edges, names and places of irrelevant segments of one source, as rows; what went wrong, in error. Of
    segments and edges only those wanted are made, if wanted says which."""
    out = {"unit": None, "units": [], "segments": [], "edges": [], "names": [], "error": None, "left_out": []}
    try:
        top = parse(text)
        line = Lines(text)
        row = lambda n, k: {"kind": n.kind, "name": n.name, "ordinal": k, "start_off": n.start, "end_off": n.end, "start_line": line(n.start), "end_line": line(max(n.start, n.end - 1))}
        every = top.walk()
        if wanted is None or "unit" in wanted or "units" in wanted:
            out["units"] = [row(n, k) for k, n in enumerate([top, *[n for n in every if n.kind == "method"]])]
        unit = locate_unit(top, relevant)
        if unit is None:
            out["error"] = "no such method"
            return out
        out["unit"] = next((u for u in out["units"] if (u["start_off"], u["end_off"], u["kind"]) == (unit.start, unit.end, unit.kind)), None)
        names = sorted([n for n in (every if unit is top else unit.walk()) if n.kind == "name"], key=lambda n: n.start)
        out["names"] = [{"pos": k, "name": n.name, "start_off": n.start, "end_off": n.end} for k, n in enumerate(names)]
        graph = SegmentGraph(every, unit, line, compat)
        dropped = graph.irrelevant(compat)
        out["left_out"] = [{"start_off": n.start, "end_off": n.end} for k, n in enumerate(graph.nodes) if k in dropped]
        out["segments"] = [
            {
                "ordinal": k, "label": " ".join(text[n.start : n.end].split()), "kind": n.kind, "start_off": n.start, "end_off": n.end, "start_line": line(n.start), "end_line": line(n.end - 1),
                "depth": n.depth, "weight": graph.weight[k], "benefit": graph.benefit[k], "is_root": k == graph.root, "irrelevant": k in dropped,
            }
            for k, n in enumerate(graph.nodes if wanted is None or "segments" in wanted else ())
        ]
        for n in every:
            n.parent = None  # what holds itself would be left to the garbage collector
        out["edges"] = [{"from_ord": a, "to_ord": b, "weight": 0.0} for a, b in graph.edges] if wanted is None or "edges" in wanted else []
    except (ParseError, RecursionError) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def parse_sources(sources: DataFrame, relevant: list[str] | None = None, compat: bool = True, wanted: Sequence[str] | None = None) -> DataFrame:
    """A row of PARSED for each source: its unit (the first method of a name in relevant, or all of it), segments, names.

    relevant is the list of method names of a query, a parameter. A source that cannot be parsed has an error, not a failure.
    wanted: the columns to give beside source_id, if not all. What is made of sources leaves Python in parts of few sources.
    """
    names, made = frozenset(relevant or ()), None if wanted is None else frozenset(wanted)
    every = StructType.fromDDL(PARSED)
    given = StructType([f for f in every if f.name == "source_id" or wanted is None or f.name in wanted])
    schema = to_arrow_schema(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                rows = [describe(text or "", names, compat, made) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name != "source_id"]], schema=schema)

    return sources.select(F.col("source_id").cast("long").alias("source_id"), "content").mapInArrow(run, given)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (source_id, content) in parts of at most PART_ROWS, of which only the last may go beyond PART_BYTES."""
    start = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if k + 1 - start >= PART_ROWS or size >= PART_BYTES:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def units(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.explode("units").alias("u")).select("source_id", "u.*")


def segments(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.explode("segments").alias("s")).select("source_id", "s.*")


def edges(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.explode("edges").alias("e")).select("source_id", "e.*")


def names(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.explode("names").alias("n")).select("source_id", "n.*")


def irrelevant_locations(parsed: DataFrame) -> DataFrame:
    """source_id, start_off, end_off of the segments left out."""
    return segments(parsed).where("irrelevant").select("source_id", "start_off", "end_off")


def relevant_locations(parsed: DataFrame) -> DataFrame:
    """source_id, start_off, end_off of the segments kept: all but the irrelevant ones."""
    return segments(parsed).where("not irrelevant").select("source_id", "start_off", "end_off")


def outside(tokens: DataFrame, spans: DataFrame, id_col: str = "source_id") -> DataFrame:
    """tokens that lie in no span of their source: the spans of a source come to its tokens as one array."""
    listed = spans.groupBy(id_col).agg(F.collect_list(F.struct("start_off", "end_off")).alias("_spans"))
    met = tokens.join(listed, id_col, "left")
    inside = F.exists("_spans", lambda s: (s["start_off"] <= F.col("start_off")) & (F.col("end_off") <= s["end_off"]))
    return met.where(~F.coalesce(inside, F.lit(False))).drop("_spans")


def unit_code(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """source_id, data: the text of each source's unit; null with an error if it has none."""
    met = sources.join(parsed.select("source_id", "unit", "error"), "source_id")
    return met.select("source_id", F.substr("content", F.col("unit.start_off") + 1, F.col("unit.end_off") - F.col("unit.start_off")).alias("data"), "error")


def segments_code(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """source_id, data, error: the text that the segments kept span; empty without a unit, null if none is kept."""
    kept = F.filter("segments", lambda s: ~s["irrelevant"])
    first = F.array_min(F.transform(kept, lambda s: F.struct(s["start_off"].alias("start"), s["end_off"].alias("end"))))
    last = F.array_max(F.transform(kept, lambda s: F.struct(s["start_off"].alias("start"), s["end_off"].alias("end"))))
    end = F.when(last["end"] <= first["end"], first["end"]).otherwise(last["end"])
    spans = parsed.select("source_id", "unit", "error", first["start"].alias("s"), end.alias("e"), F.size(kept).alias("n"))
    data = F.when(F.col("unit").isNull(), F.lit("")).otherwise(F.substr("content", F.col("s") + 1, F.col("e") - F.col("s")))
    why = F.when((F.col("n") == 0) & F.col("unit").isNotNull() & F.col("error").isNull(), F.lit("no segment is kept")).otherwise(F.col("error"))
    return sources.join(spans, "source_id").select("source_id", data.alias("data"), why.alias("error"))
