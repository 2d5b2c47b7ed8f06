"""Newick and NEXUS text: splitting, parsing into edge rows, rendering.

A parser makes one pass over a text and returns the tree's nodes with depth and tip interval, so
that nothing recursive is left for the plan. Spark reaches it through the UDTFs registered by
`register` (parse_newick, split_newick, parse_nexus), through `parse_trees`, which turns a table of
texts into edge rows and rejects, and through the `newick` data source.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from stratabranch.session import settle
from stratabranch.sources import files

EDGE = "edge_id int, parent long, child long, length double, b double, d double, tip_lo long, tip_hi long, is_tip boolean, label string"
#: A label that needs no quotes.
_PLAIN = re.compile(r"[A-Za-z0-9_.\-|]+")


class TreeError(ValueError):
    """Text or edges that aren't a valid tree."""


def strip_comments(text: str) -> str:
    """Without [...] outside quotes; a [ that is never closed stays. A quote opens a label only where
    a label can begin."""
    out, i, fresh = [], 0, True
    while i < len(text):
        c = text[i]
        if c == "'" and fresh:
            end = _quote_end(text, i)
            out.append(text[i:end])
            i, fresh = end, False
            continue
        if c == "[" and (end := text.find("]", i)) >= 0:
            i = end + 1
            continue
        out.append(c)
        fresh = c in "(,)" or (fresh and c.isspace())
        i += 1
    return "".join(out)


def _quote_end(text: str, start: int) -> int:
    """The index after the closing quote of the label that opens at start."""
    i = start + 1
    while i < len(text):
        if text[i] == "'":
            if text[i + 1 : i + 2] != "'":
                return i + 1
            i += 1
        i += 1
    raise TreeError("unterminated quoted label")


def split_records(text: str) -> list[str]:
    """The trees of a text, each ending in a semicolon; empty records are dropped."""
    out, start, i, fresh = [], 0, 0, True
    while i < len(text):
        c = text[i]
        if c == "'" and fresh:
            i, fresh = _quote_end(text, i), False
            continue
        if c == "[" and (end := text.find("]", i)) >= 0:
            i = end + 1
            continue
        if c == ";":
            out.append(text[start : i + 1])
            start, fresh = i + 1, True
        else:
            fresh = c in "(,)" or (fresh and c.isspace())
        i += 1
    if text[start:].strip():
        out.append(text[start:].strip() + ";")
    return [r.strip() for r in out if r.strip(" \t\r\n;")]


def nexus_trees(text: str) -> list[tuple[str, str]]:
    """(name, Newick) of the trees blocks of a NEXUS text."""
    found, inside = [], False
    pending = ""
    for line in text.splitlines():
        bare = line.strip()
        if not inside:
            inside = bool(re.match(r"begin\s+trees\s*;", bare, re.I))
        elif re.match(r"end(block)?\s*;", bare, re.I):
            inside = False
        else:
            pending = f"{pending} {bare}".strip()
            if pending.endswith(";"):
                m = re.match(r"u?tree\s+(\*\s*)?('(?:[^']|'')*'|[^=\s]+)\s*=\s*(.*)", pending, re.I | re.S)
                if m:
                    found.append((m[2].strip("'"), re.sub(r"^(\[[^\]]*\]\s*)+", "", m[3])))
                pending = ""
    if not found:
        raise TreeError("no trees found in the NEXUS text")
    return found


@dataclass
class Tree:
    """Nodes in preorder: tips are numbered along it, the root is n_tips, other nodes follow."""

    labels: list[str]
    edges: list[tuple[int, int, float]]  # parent, child, length, in preorder of the child
    root_edge: float = 0.0
    depth: dict[int, float] = field(default_factory=dict)
    tips: dict[int, tuple[int, int]] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        n = len(self.labels)
        return [(k, p, c, x, self.depth[p], self.depth[c], *self.tips[c], c < n, self.labels[c] if c < n else None) for k, (p, c, x) in enumerate(self.edges)]


def number(children: dict[int, list[int]], root: int, length: dict[int, float], label: dict[int, str], root_edge: float = 0.0, prefix: str = "tip_") -> Tree:
    """A tree from node links, checked and renumbered in preorder; no recursion."""
    preorder, stack, seen = [], [root], set()
    while stack:
        v = stack.pop()
        if v in seen:
            raise TreeError("a node has more than one parent, or nodes form a cycle")
        seen.add(v)
        preorder.append(v)
        stack.extend(reversed(children.get(v, ())))
    if seen != {root, *length} or not children.get(root):
        raise TreeError("some nodes can't be reached from the root")
    tips = [v for v in preorder if not children.get(v)]
    if len(tips) < 2:
        raise TreeError("a tree needs at least two tips")
    names = [label.get(v) or f"{prefix}{i + 1}" for i, v in enumerate(tips)]
    if len(set(names)) < len(names):
        raise TreeError("tip labels are not unique")
    new = {v: i for i, v in enumerate(tips)}
    for v in preorder:
        new.setdefault(v, len(new))
    parent = {c: v for v, cs in children.items() for c in cs}
    depth, edges = {new[root]: 0.0}, []
    for v in preorder[1:]:
        x = length[v]
        if not math.isfinite(x):
            raise TreeError("branch lengths must be finite")
        if x < 0:
            raise TreeError("branch lengths must not be negative")
        depth[new[v]] = depth[new[parent[v]]] + x
        edges.append((new[parent[v]], new[v], x))
    if not math.isfinite(root_edge) or root_edge < 0:
        raise TreeError("the root's stem must be finite and not negative")
    spans: dict[int, tuple[int, int]] = {}
    for v in reversed(preorder):
        cs = children.get(v)
        spans[new[v]] = (spans[new[cs[0]]][0], spans[new[cs[-1]]][1]) if cs else (new[v], new[v] + 1)
    return Tree(names, edges, root_edge, depth, spans)


def parse(text: str, prefix: str = "tip_") -> Tree:
    """One Newick tree. Labels of inner nodes are read and dropped; a missing length is 0."""
    text = strip_comments(text).strip()
    if not text.endswith(";"):
        raise TreeError("a Newick text must end with ';'")
    children: dict[int, list[int]] = {0: []}
    length: dict[int, float] = {}
    label: dict[int, str] = {}
    count, at, stack, i = 1, 0, [], 0
    root_edge, closed = 0.0, False

    def child(of: int) -> int:
        nonlocal count
        children[of].append(count)
        children[count] = []
        length[count] = 0.0
        count += 1
        return count - 1

    while True:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "(":
            if closed:
                raise TreeError("text after a closed group")
            stack.append(at)
            at = child(at)
            i += 1
        elif c == ",":
            if not stack:
                raise TreeError("a comma outside parentheses")
            at, closed = child(stack[-1]), False
            i += 1
        elif c == ")":
            if not stack:
                raise TreeError("unbalanced parentheses")
            at, closed = stack.pop(), True
            i += 1
        elif c == ":":
            m = re.compile(r"\s*([^(),:;\s]+)").match(text, i + 1)
            try:
                value = float(m[1])  # type: ignore[index]
            except (TypeError, ValueError):
                raise TreeError("a branch length is not a number") from None
            if at == 0:
                root_edge = value
            else:
                length[at] = value
            i = m.end()  # type: ignore[union-attr]
        elif c == ";":
            break
        else:
            if c == "'":
                end = _quote_end(text, i)
                name = text[i + 1 : end - 1].replace("''", "'")
            else:
                end = i
                while text[end] not in "(),:;" and not text[end].isspace():
                    end += 1
                name = text[i:end]
            if not closed and not children[at]:
                label[at] = name
            i = end
    if stack:
        raise TreeError("unbalanced parentheses")
    if text[i + 1 :].strip():
        raise TreeError("text after the end of the tree")
    return number(children, 0, length, label, root_edge, prefix)


def from_edges(rows: list[tuple[int, int, float, str | None]], root_edge: float = 0.0) -> Tree:
    """A tree from (parent, child, length, label) rows in any order of nodes; children keep row order."""
    children: dict[int, list[int]] = {}
    length, label = {}, {}
    for p, c, x, name in rows:
        if c in length:
            raise TreeError("a node has more than one parent, or nodes form a cycle")
        children.setdefault(p, []).append(c)
        length[c] = x
        if name is not None:
            label[c] = name
    roots = [p for p in children if p not in length]
    if len(roots) != 1:
        raise TreeError("a tree needs exactly one root")
    return number(children, roots[0], length, label, root_edge)


def quote(label: str) -> str:
    return label if _PLAIN.fullmatch(label) else "'" + label.replace("'", "''") + "'"


def render(tree: Tree, digits: str = "%.12g") -> str:
    """Newick text of a tree, bottom up."""
    children: dict[int, list[int]] = {}
    length = {}
    for p, c, x in tree.edges:
        children.setdefault(p, []).append(c)
        length[c] = digits % x
    text: dict[int, str] = {}
    for p, c, _ in reversed(tree.edges):
        own = f"({','.join(text.pop(k) for k in children[c])})" if c in children else quote(tree.labels[c])
        text[c] = f"{own}:{length[c]}"
    root = len(tree.labels)
    stem = f":{digits % tree.root_edge}" if tree.root_edge else ""
    return f"({','.join(text.pop(k) for k in children[root])}){stem};"


def render_nexus(texts: list[str], names: list[str] | None = None) -> str:
    names = names or [f"tree_{i + 1}" for i in range(len(texts))]
    return "\n".join(["#NEXUS", "BEGIN TREES;", *(f"  TREE {n} = {t}" for n, t in zip(names, texts, strict=True)), "END;", ""])


@udtf(returnType=EDGE)
class ParseNewick:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from parse(text).rows()


@udtf(returnType="draw int, newick string")
class SplitNewick:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from enumerate(split_records(text))


@udtf(returnType="draw int, name string, newick string")
class ParseNexus:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for i, (name, tree) in enumerate(nexus_trees(text)):
                yield i, name, tree


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_newick", ParseNewick)
    spark.udtf.register("split_newick", SplitNewick)
    spark.udtf.register("parse_nexus", ParseNexus)
    spark.dataSource.register(NewickSource)


def parse_trees(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and rejects with a reason, of a table (tree_id, newick). A bad text costs its own tree."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for tree_id, text in zip(pdf["tree_id"], pdf["newick"]):
                try:
                    tree = parse(text)
                    rows.append((tree_id, None, tree.root_edge, [dict(zip((f.split()[0] for f in EDGE.split(", ")), r)) for r in tree.rows()]))
                except (TreeError, TypeError, AttributeError) as e:
                    rows.append((tree_id, str(e), None, None))
            yield pd.DataFrame(rows, columns=["tree_id", "reason", "root_edge", "edges"])

    fields = ",".join(":".join(f.split()) for f in EDGE.split(", "))
    # Settled, since edges and rejects both read it, and each tree is parsed once.
    parsed = texts.select("tree_id", "newick").mapInPandas(run, f"tree_id string, reason string, root_edge double, edges array<struct<{fields}>>")
    parsed = settle(parsed)
    edges = parsed.where("reason IS NULL").select("tree_id", "root_edge", F.inline("edges"))
    return edges, parsed.where("reason IS NOT NULL").select("tree_id", "reason")


def render_trees(edges: DataFrame, digits: str = "%.12g") -> DataFrame:
    """tree_id, newick of a table (tree_id, edge_id, parent, child, length, label)."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("edge_id")
        rows = [(p, c, float(x), None if n is None or n != n else n) for p, c, x, n in zip(pdf["parent"], pdf["child"], pdf["length"], pdf["label"])]
        return pd.DataFrame({"tree_id": pdf["tree_id"][:1], "newick": [render(from_edges(rows), digits)]})

    return edges.select("tree_id", "edge_id", "parent", "child", "length", "label").groupBy("tree_id").applyInPandas(one, "tree_id string, newick string")


def equal_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """tree_id, equal of edge tables that are compared as text: tip order, edges, lengths. A tree that one
    side lacks isn't equal."""
    a, b = render_trees(left).withColumnRenamed("newick", "a"), render_trees(right).withColumnRenamed("newick", "b")
    return a.join(b, "tree_id", "full").select("tree_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def write_newick(texts: DataFrame, folder: str, force: bool = False, name: str = "{}.tre") -> int:
    """A file for each tree (tree_id, newick) in a folder; how many were written. Texts pass through the
    driver one at a time: for slices and other sets of trees that a person looks at. Pools are tables."""
    spark = texts.sparkSession
    if files.exists(spark, folder):
        if not force:
            raise FileExistsError(f"{folder} exists")
        files.remove(spark, f"{folder}/{name.format('*')}")
    n = 0
    for row in texts.select("tree_id", "newick").orderBy("tree_id").toLocalIterator():
        files.write_text(spark, f"{folder}/{name.format(row.tree_id)}", f"{row.newick}\n", True)
        n += 1
    return n


def nexus(texts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, nexus: the NEXUS text of the trees (tree_id, newick) of each group, in order of tree_id. A group's
    texts are one row."""
    rows = F.sort_array(F.collect_list(F.struct("tree_id", "newick")))
    line = F.transform(rows, lambda x: F.concat(F.lit("  TREE "), _nexus_name(x["tree_id"]), F.lit(" = "), x["newick"]))
    return texts.groupBy(*by).agg(F.concat(F.lit("#NEXUS\nBEGIN TREES;\n"), F.array_join(line, "\n"), F.lit("\nEND;\n")).alias("nexus"))


def _nexus_name(name):
    plain = name.rlike(f"^(?:{_PLAIN.pattern})$")
    return F.when(plain, name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def read_newick(spark: SparkSession, source: str) -> DataFrame:
    """Edges of one tree: the first record of a file, else of the source itself if it looks like Newick. NEXUS
    and bad trees are errors."""
    if not any(c in source for c in "();") and not files.exists(spark, source):
        raise FileNotFoundError(f"{source} is neither a file nor a Newick text")
    if not any(c in source for c in "();") or files.exists(spark, source):
        text = spark.read.text(source, wholetext=True).first()
        source = text[0] if text else ""
    if source.lstrip().upper().startswith("#NEXUS"):
        raise TreeError("a NEXUS text; read it as a pool")
    records = split_records(source)
    if not records:
        raise TreeError("no tree in the text")
    tree = parse(records[0])
    return spark.createDataFrame([("tree", *row) for row in tree.rows()], f"tree_id string, {EDGE}")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """tree_id, draw, newick of the trees in a file, a directory or a glob, in order of file and
    record; NEXUS texts are told by their first word."""
    register(spark)
    texts = spark.read.option("pathGlobFilter", "*.{tre,tree,nwk,newick,nex,t}").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    # The filters stand below the table functions, which would fail on the other kind of text.
    is_nexus = F.upper(F.ltrim("value")).startswith("#NEXUS")
    texts.where(~is_nexus).createOrReplaceTempView("_pool_plain")
    texts.where(is_nexus).createOrReplaceTempView("_pool_nexus")
    plain = spark.sql("SELECT file, draw AS record, newick FROM _pool_plain, LATERAL split_newick(value)")
    nexus = spark.sql("SELECT file, draw AS record, newick FROM _pool_nexus, LATERAL parse_nexus(value)")
    from pyspark.sql import Window

    found = settle(plain.unionByName(nexus))  # split once: read for numbers, and for trees
    # Records are numbered within their file; files, a small table, by how many come before.
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = found.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(offsets, "file").select(F.concat_ws("#", "file", F.col("record").cast("string")).alias("tree_id"), (F.col("before") + F.col("record")).cast("long").alias("draw"), "newick")


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, skip: bool):
        self.path, self.skip = path, skip

    def partitions(self) -> list[_Part]:
        import glob
        import os

        kinds = (".tre", ".tree", ".nwk", ".newick", ".t")
        paths = sorted(p for p in glob.glob(os.path.join(self.path, "*")) if p.endswith(kinds)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not paths:
            raise FileNotFoundError(f"no tree files at {self.path}")
        return [_Part(p) for p in paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path) as f:
            text = f.read()
        try:
            records = split_records(text)
        except TreeError as e:
            raise TreeError(f"{partition.path}: {e}") from e
        for k, record in enumerate(records):
            try:
                tree = parse(record)
            except TreeError as e:
                if not self.skip:
                    raise TreeError(f"{partition.path}#{k}: {e}") from e
                continue
            for row in tree.rows():
                yield (f"{partition.path}#{k}", *row)


class NewickSource(DataSource):
    """spark.read.format("newick").load(path): edge rows of the trees in files that every executor
    can open. A bad tree costs itself only; option("mode", "failfast") makes it an error. For other stores,
    and for the reasons of rejects, use read_pool and parse_trees."""

    @classmethod
    def name(cls) -> str:
        return "newick"

    def schema(self) -> str:
        return f"tree_id string, {EDGE}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("mode", "dropmalformed").lower() != "failfast")
