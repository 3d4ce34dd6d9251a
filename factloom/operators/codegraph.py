"""A code graph from symbols and occurrences, and its structural operations, set at a time.

symbols: (id, ord, source_path). occurrences: (path, place, symbol, is_definition, range, enclosing), ranges as arrays of
three or four numbers. edges: (src, dst, freq, first, is_call...). All joins have an equality key: interval tests come
after a join on the file.
"""

from __future__ import annotations

import ast
import hashlib
import keyword
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx

HIDDEN = ("module", "parameter", "term")
# What ends a line of a source.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# What ends a line for Python's parser, and how a line begins that goes on with no statement before it.
CODE_ENDS = "\r\n|[\n\r]"
FRESH = r"(?<=\n)(?:@|(?:async|class|def)\b)"
# End of fixed values.
#: Characters of a piece of a source, about: a batch of some thousand pieces stays small in a reader, a syntax tree in a parser.
PIECE = 8192
BOUNDS = "struct<l0:int,c0:int,l1:int,c1:int>"


def catalogue(symbols: DataFrame, root: str | None = None) -> DataFrame:
    """symbols with kind, name and descriptor path (null for files and parameters) and the cleaned source path."""
    path = fx.clean_path(F.col("source_path"))
    if root:
        prefix = root.strip("/") + "/"
        path = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    kind = fx.symbol_kind(F.col("id"))
    named = ~kind.isin("file", "parameter")
    return symbols.select("id", "ord", path.alias("source_path"), kind.alias("kind"), F.when(named, fx.display_name(F.col("id"))).alias("name"), F.when(named, fx.descriptor_path(F.col("id"))).alias("path"))


def containment(cat: DataFrame) -> DataFrame:
    """(parent, child): the parent's id is the child's without its last descriptor, found by an equi-join."""
    parent = F.regexp_extract("id", r"^(.*?)[A-Za-z_][A-Za-z0-9_]*(?:#|\.|\([^()]*\)\.)$", 1)
    child = cat.select(F.col("id").alias("child"), F.col("ord").alias("child_ord"), parent.alias("parent")).where("parent <> ''")
    return child.join(cat.where(F.col("kind").isin("struct", "module")).select(F.col("id").alias("parent")), "parent").select("parent", "child", "child_ord")


def implementations(relationships: DataFrame, cat: DataFrame) -> DataFrame:
    """(interface, implementor) of flagged relationships (id, target, is_implementation) with both ends known."""
    flagged = relationships.where("is_implementation").select(F.col("target").alias("interface"), F.col("id").alias("implementor")).distinct()
    ids = cat.select("id")
    return flagged.join(ids.withColumnRenamed("id", "interface"), "interface", "left_semi").join(ids.withColumnRenamed("id", "implementor"), "implementor", "left_semi")


def bounds(r: Column) -> Column:
    """A range of three or four numbers as (first line, column, last line, column); null for others."""
    four = lambda *i: F.struct(*[r[k].cast("int").alias(n) for k, n in zip(i, ("l0", "c0", "l1", "c1"), strict=True)])
    return F.when(F.size(r) == 3, four(0, 1, 0, 2)).when(F.size(r) >= 4, four(0, 1, 2, 3))


def holds(b: Column, line: Column, column: Column) -> Column:
    """Whether a place lies in bounds, the start included and the end not."""
    here = F.struct(line.cast("int").alias("l"), column.cast("int").alias("c"))
    return (here >= F.struct(b["l0"].alias("l"), b["c0"].alias("c"))) & (here < F.struct(b["l1"].alias("l"), b["c1"].alias("c")))


def dyadic(start: Column, end: Column) -> Column:
    """[start, end) as an array of blocks (level, block) of 2^level places each that start at a multiple of their size, two of a level at most."""

    def at(level: Column) -> Column:
        low = F.call_function("shiftright", start - 1, level) + 1
        high = F.call_function("shiftright", end, level)
        block = lambda b: F.struct(level.alias("level"), b.alias("block"))
        return F.array(F.when((low < high) & (low % 2 == 1), block(low)), F.when((low < high) & (high % 2 == 1), block(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(end))), at)), lambda b: b.isNotNull())


#: Scopes of a file that each of its points may meet one by one.
FEW_SCOPES = 32


def innermost_scope(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points (path, point, line, column) with scope, the smallest of scopes (path, scope, bounds, ord) around it, else the file's own id.

    Places of a file are numbered by line and column. A scope covers a few blocks of places, and of all scopes that
    cover a block whole only the smallest is kept; a point lies in one block of each size, and meets what is kept
    there by equal columns. So the work grows with points and scopes times the bits of a place, not with their product
    in a file, and a large file is spread over tasks by its blocks. Scopes may overlap in any way. The scopes of a file
    that has a few are an array beside each of its points, so that nothing is grouped or joined again there. What grows
    with the number of files or scopes is merged in order: a planner that takes exploded rows for a few would send them
    through the driver.
    """
    size = F.struct((F.col("bounds.l1") - F.col("bounds.l0")).alias("l"), (F.col("bounds.c1") - F.col("bounds.c0")).alias("c"), F.col("ord").alias("o"))
    # a column beyond all that bound a scope of the file counts like the last of them
    many = scopes.groupBy("path").agg(F.count("*").alias("__n"), F.max(F.greatest("bounds.c0", "bounds.c1")).cast("long").alias("widest")).where(F.col("__n") > FEW_SCOPES).drop("__n")
    counted = scopes.select("path", F.struct(size.alias("size"), "scope", "bounds").alias("s"), (F.count("*").over(Window.partitionBy("path")) <= FEW_SCOPES).alias("__is_few"))
    files = counted.groupBy("path").agg(F.collect_list(F.when(F.col("__is_few"), F.col("s"))).alias("__few"), F.bool_and("__is_few").alias("__is_few"))
    around = F.filter("__few", lambda s: holds(s["bounds"], F.col("line"), F.col("column")))
    near = points.join(files.hint("merge"), "path", "left").where(F.coalesce("__is_few", F.lit(True))).withColumn("scope", F.array_min(around)["scope"]).drop("__few", "__is_few")
    place = lambda line, column: line.cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("widest"))) + F.least(column.cast("long"), F.col("widest"))
    placed = scopes.join(many.hint("merge"), "path").select("path", "scope", size.alias("size"), "widest", place(F.col("bounds.l0"), F.col("bounds.c0")).alias("start"), place(F.col("bounds.l1"), F.col("bounds.c1")).alias("end")).where("start < end")
    cover = placed.select("path", "scope", "size", "widest", F.explode(dyadic(F.col("start"), F.col("end"))).alias("b")).groupBy("path", "b.level", "b.block").agg(F.min_by("scope", "size").alias("kept"), F.min("size").alias("size"), F.max("widest").alias("widest"))
    levels = cover.groupBy("path").agg(F.collect_set("level").alias("levels"), F.max("widest").alias("widest"))
    inside = points.join(many.hint("merge"), "path", "left_semi")
    asked = inside.select("path", "point", "line", "column").join(levels.hint("merge"), "path").select("path", "point", place(F.col("line"), F.col("column")).alias("at"), F.explode("levels").alias("level"))
    in_blocks = asked.select("path", "point", "level", F.call_function("shiftright", "at", "level").alias("block")).join(cover.drop("widest").hint("merge"), ["path", "level", "block"])
    best = in_blocks.groupBy("path", "point").agg(F.min_by("kept", "size").alias("scope"))
    return near.unionByName(inside.join(best.hint("merge"), ["path", "point"], "left")).withColumn("scope", F.coalesce("scope", F.concat(F.lit("file:"), F.col("path"))))


#: Names of some length, but no words of the language.
NAMES = re.compile(rf"(?<![\w\\])(?!(?:{'|'.join([*keyword.kwlist, *keyword.softkwlist])})\b)[A-Za-z_]\w{{3,}}", re.ASCII)


def tree(code: str) -> ast.AST:
    """The syntax tree of Python code, in which names are only where they stand: the interpreter keeps every name that it has ever parsed, so names of one length become one name."""
    if code.isascii():
        try:
            return ast.parse(NAMES.sub(lambda m: "x" * len(m[0]), code))
        except (SyntaxError, ValueError):
            pass  # a name that was more than that, in an escape or a number; or a fault
    return ast.parse(code)


def parsed_spans(code: str) -> list[tuple[int, int, int, int]] | None:
    """Zero-based spans of the names that Python code calls; of an attribute only its own name. None where it does not parse."""
    try:
        calls = [n.func for n in ast.walk(tree(code)) if isinstance(n, ast.Call)]
    except (SyntaxError, ValueError):
        return None
    out = []
    for f in calls:
        if isinstance(f, ast.Attribute):
            out.append((f.end_lineno - 1, f.end_col_offset - len(f.attr), f.end_lineno - 1, f.end_col_offset))
        elif isinstance(f, ast.Name):
            out.append((f.lineno - 1, f.col_offset, f.end_lineno - 1, f.end_col_offset))
    return out


def spans_of_pieces(pieces: Iterable[str]) -> list[tuple[int, int, int, int]]:
    """Spans of the names that a source calls which comes in pieces; faulty sources have none.

    Statements are parsed a few at a time. Code that parses up to a line that begins a definition ends there in no
    string, bracket or block, so what follows is parsed for itself; code that does not is parsed with twice as much.
    """
    fresh, feed, more, out = re.compile(FRESH), iter(pieces), True, []
    held, at, base, want = "", 0, 0, PIECE
    while True:
        cut = fresh.search(held, at + want)
        if cut is None and more:
            # what is held doubles, so that no text is copied or searched often
            waiting, size = [held[at:]], 0
            while more and size <= max(want, len(waiting[0])):
                piece = next(feed, None)
                more = piece is not None
                waiting.append(piece or "")
                size += len(waiting[-1])
            held, at = "".join(waiting), 0
            continue
        code = held[at : cut.start()] if cut else held[at:]
        spans = parsed_spans(code)
        if spans is None and cut is None:
            return []
        if spans is None:
            want = 2 * len(code)
            continue
        out += [(a + base, b, c + base, d) for a, b, c, d in spans]
        if cut is None:
            return out
        at, base, want = cut.start(), base + len(re.findall(CODE_ENDS, code)), PIECE


def call_target_spans(source: str | None) -> list[tuple[int, int, int, int]]:
    """Zero-based spans of the names that a Python source calls; of an attribute only its own name. Faulty sources have none."""
    return spans_of_pieces([source or ""])


SPAN = "path string, l0 int, c0 int, l1 int, c1 int"


def call_spans(sources: DataFrame) -> DataFrame:
    """(path, bounds) of each called name in sources (path, text), or in those of in_pieces().

    Pieces are parsed wherever they are. Only sources with a piece that does not parse alone are put in order and parsed
    as they run on, since a piece may end within a statement.
    """

    def run(batches):
        for batch in batches:
            rows = [(p, *s) for p, t in zip(batch["path"], batch["text"], strict=True) for s in call_target_spans(t)]
            yield pd.DataFrame(rows, columns=["path", "l0", "c0", "l1", "c1"])

    def alone(batches):
        for batch in batches:
            for i in range(0, len(batch), PIECES):
                part, rows = batch.iloc[i : i + PIECES], []
                for p, t, n in zip(part["path"], part["text"], part["code_line"], strict=True):
                    spans = parsed_spans(t)
                    rows += [(p, None, None, None, None)] if spans is None else [(p, a + n, b, c + n, d) for a, b, c, d in spans]
                yield pd.DataFrame(rows, columns=["path", "l0", "c0", "l1", "c1"]).astype({c: "Int32" for c in ("l0", "c0", "l1", "c1")})

    def in_order(batches):
        for path, pieces in groupby(chain.from_iterable(zip(b["path"], b["text"], strict=True) for b in batches), lambda x: x[0]):
            spans = spans_of_pieces(t for _, t in pieces)
            for i in range(0, len(spans), SPANS):
                yield pd.DataFrame([(path, *s) for s in spans[i : i + SPANS]], columns=["path", "l0", "c0", "l1", "c1"])

    def shaped(flat: DataFrame) -> DataFrame:
        return flat.select("path", F.struct("l0", "c0", "l1", "c1").alias("bounds"))

    if "piece" not in sources.columns:
        return shaped(sources.select("path", "text").mapInPandas(run, SPAN))
    flat = session.written(sources.select("path", "text", "code_line").mapInPandas(alone, SPAN), "spans")
    failed = flat.where("l0 IS NULL").select("path").distinct()
    if failed.isEmpty():
        return shaped(flat)
    failed = session.written(failed, "failed")
    again = sources.join(failed, "path", "left_semi").select("path", "piece", "text").repartition("path").sortWithinPartitions("path", "piece").select("path", "text")
    return session.written(shaped(flat.join(failed, "path", "left_anti").unionByName(again.mapInPandas(in_order, SPAN))), "spans")


#: Pieces whose spans leave a Python worker at once, and spans of a source that do.
PIECES, SPANS = 64, 20_000


def cut_source(text: str | None) -> Iterator[str]:
    """A source in pieces of whole lines, about PIECE characters each, that begin with a definition where one comes soon enough; an empty source is one piece."""
    text, start, fresh = text or "", 0, re.compile(FRESH)
    while True:
        cut = fresh.search(text, start + PIECE, start + 16 * PIECE)
        end = cut.start() if cut else text.find("\n", start + 16 * PIECE) + 1
        if not start < end < len(text):
            break
        yield text[start:end]
        start = end
    yield text[start:]


def in_pieces(sources: DataFrame) -> DataFrame:
    """sources (path, text) as pieces (path, piece, text, line, code_line) with the lines before them, of any kind and as Python counts them.

    Sources may come in pieces (path, piece, text): all but a source's last end with a line's end.
    """

    def run(batches):
        for batch in batches:
            rows = [(p, n, x) for p, t in zip(batch["path"], batch["text"], strict=True) for n, x in enumerate(cut_source(t))]
            yield pd.DataFrame(rows, columns=["path", "piece", "text"])

    if "piece" not in sources.columns:
        sources = sources.select("path", "text").mapInPandas(run, "path string, piece long, text string")
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    lines = lambda ends: F.coalesce(F.sum(F.regexp_count("text", F.lit(ends))).over(before), F.lit(0)).cast("int")
    return sources.select("path", "piece", "text", lines(LINE_ENDS).alias("line"), lines(CODE_ENDS).alias("code_line"))


def stamps(sources: DataFrame) -> DataFrame:
    """(path, source_hash, available) of sources (path, text), or of those of in_pieces(), which run through the hash in order."""

    def run(batches):
        for path, pieces in groupby(chain.from_iterable(zip(b["path"], b["text"], strict=True) for b in batches), lambda x: x[0]):
            said, there = hashlib.sha256(), False
            for _, text in pieces:
                said.update(text.encode())
                there = there or text != ""
            yield pd.DataFrame([(path, said.hexdigest(), there)], columns=["path", "source_hash", "available"])

    if "piece" not in sources.columns:
        return sources.select("path", F.sha2("text", 256).alias("source_hash"), (F.col("text") != "").alias("available"))
    ordered = sources.select("path", "piece", "text").repartition("path").sortWithinPartitions("path", "piece").select("path", "text")
    return session.written(ordered.mapInPandas(run, "path string, source_hash string, available boolean"), "stamps")


def reference_edges(references: DataFrame) -> DataFrame:
    """(src, dst, freq, calls, first) of references (src, dst, place, is_call), without self references; first is the first place."""
    return references.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("freq"), F.count_if("is_call").alias("calls"), F.min("place").alias("first"))


#: Columns of a block of a line, in which few names have room: a power of two.
BLOCK_BITS = 6


def marked_calls(references: DataFrame, spans: DataFrame) -> DataFrame:
    """references (path, point, line, column, ...) with is_call, whether a called name's span of the same file holds the place.

    A name's span (path, bounds) lies in one line. A place meets the names in its own block of its line, of which there
    are few however long the file or the line is.
    """
    block = lambda column: F.shiftright(column, BLOCK_BITS)
    names = spans.select("path", F.col("bounds.l0").alias("line"), F.col("bounds.c0").alias("c0"), F.col("bounds.c1").alias("c1")).where("c0 < c1")
    cells = names.select("path", "line", "c0", "c1", F.explode(F.sequence(block(F.col("c0")), block(F.col("c1") - 1))).alias("__block"))
    cells = cells.groupBy("path", "line", "__block").agg(F.collect_set(F.struct("c0", "c1")).alias("__names"))
    met = references.withColumn("__block", block(F.col("column"))).join(cells.hint("merge"), ["path", "line", "__block"], "left")
    here = F.exists("__names", lambda s: (s["c0"] <= F.col("column")) & (F.col("column") < s["c1"]))
    return met.select(*references.columns, F.coalesce(here, F.lit(False)).alias("is_call"))


def source_lines(sources: DataFrame) -> DataFrame:
    """(path, line, line_text) of sources (path, text), or of those of in_pieces(), lines from 0 and without their ends, of whatever kind those are; no line follows a last end."""
    # cut once for each source: what stands beside the generator is computed again for each of its rows
    lines = F.transform(F.array(F.split("text", LINE_ENDS, -1)), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))[0]
    before = F.col("line") if "piece" in sources.columns else F.lit(0)
    return sources.select("path", before.alias("before"), F.posexplode(lines).alias("nth", "line_text")).select("path", (F.col("before") + F.col("nth")).alias("line"), "line_text")


def witnesses(places: DataFrame, sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """places (path, point, bounds, ...), one row for each path and point, with first_line and last_line from 1, their text, the source's hash and whether it is there.

    lines: of source_lines(), met by path and line. A missing or empty source is not available; its text is empty and its
    hash that of nothing. A place without bounds has line 1 to 0, no line at all.
    """
    lines = source_lines(sources) if lines is None else lines
    first, last = F.col("bounds.l0"), F.col("bounds.l1")
    wide = places.where(last > first).select("path", "point", F.explode(F.sequence(first, last)).alias("line")).join(lines, ["path", "line"])
    wide = wide.groupBy("path", "point").agg(F.sort_array(F.collect_list(F.struct("line", "line_text"))).alias("found"))
    long = places.where(last > first).join(wide, ["path", "point"], "left").withColumn("text", F.array_join(F.transform("found", lambda x: x["line_text"]), "\n")).drop("found")
    short = places.where(~F.coalesce(last > first, F.lit(False)))
    here = lines.select("path", F.col("line").alias("__line"), F.col("line_text").alias("text"))
    met = short.withColumn("__line", F.when(last == first, first)).join(here, ["path", "__line"], "left").drop("__line")
    out = met.unionByName(long).join(stamps(sources), "path", "left")
    return out.select(
        *places.columns, F.coalesce("source_hash", F.sha2(F.lit(""), 256)).alias("source_hash"), F.coalesce("available", F.lit(False)).alias("available"),
        (F.coalesce(first, F.lit(0)) + 1).alias("first_line"), F.coalesce(last + 1, F.lit(0)).alias("last_line"), F.coalesce("text", F.lit("")).alias("text"),
    )


def degree(edges: DataFrame, contains: DataFrame | None = None, implements: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree): distinct neighbours over references both ways, children and implementors; of ids (id) only, where they are given."""
    views = [edges.select(F.col("src").alias("id"), F.col("dst").alias("near")), edges.select(F.col("dst").alias("id"), F.col("src").alias("near"))]
    if contains is not None:
        views.append(contains.select(F.col("parent").alias("id"), F.col("child").alias("near")))
    if implements is not None:
        views.append(implements.select(F.col("interface").alias("id"), F.col("implementor").alias("near")))
    if ids is not None:
        views = [v.join(ids, "id", "left_semi") for v in views]
    return reduce(DataFrame.unionByName, views).groupBy("id").agg(F.count_distinct("near").alias("degree"))


def frequency(edges: DataFrame, operation: str) -> Column:
    """How often an edge counts for an operation: references for callers, calls for callees, nothing for others."""
    return F.col("freq") if operation == "callers" else F.col("calls") if operation == "callees" else F.lit(0)


def shown(ids: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    return ids.where(~fx.symbol_kind(F.col("id")).isin(*hidden))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows (target, id, ...) once each with place, their order for the target."""
    once = rows.groupBy("target", "id").agg(F.min(F.struct(*order)).alias("key"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("key", "id"))).drop("key")


def callers(targets: DataFrame, edges: DataFrame, implements: DataFrame | None = None, mode: str = "calls", cat: DataFrame | None = None) -> DataFrame:
    """target, id, place: who calls (or refers to) each target in the order first seen, then its implementors; of a file its own symbols, where cat is given."""
    if cat is not None:
        is_file = F.col("target").startswith("file:")
        own = targets.where(is_file).select("target", F.substring("target", 6, 1 << 30).alias("path_")).join(cat, F.col("path_") == F.col("source_path"))
        here = numbered(shown(own.select("target", "id", "ord"), HIDDEN), ["ord"])
        return callers(targets.where(~is_file), edges, implements, mode).unionByName(here)
    used = edges if mode == "references" else edges.where("calls > 0")
    found = targets.join(used, F.col("target") == F.col("dst")).select("target", F.col("src").alias("id"), F.lit(0).alias("tier"), "first")
    if implements is not None:
        more = targets.join(implements, F.col("target") == F.col("interface")).select("target", F.col("implementor").alias("id"), F.lit(1).alias("tier"), F.lit(None).cast(dict(edges.dtypes)["first"]).alias("first"))
        found = found.unionByName(more)
    return numbered(shown(found, HIDDEN), ["tier", "first"])


def callees(targets: DataFrame, edges: DataFrame, mode: str = "calls") -> DataFrame:
    used = edges if mode == "references" else edges.where("calls > 0")
    found = targets.join(used, F.col("target") == F.col("src")).select("target", F.col("dst").alias("id"), "first")
    return numbered(shown(found, (*HIDDEN, "file")), ["first"])


def contained_by(targets: DataFrame, contains: DataFrame) -> DataFrame:
    """Children of each target; of a struct its functions first."""
    found = targets.join(contains, F.col("target") == F.col("parent"))
    late = (fx.symbol_kind(F.col("target")) == "struct") & (fx.symbol_kind(F.col("child")) != "function")
    return numbered(found.select("target", F.col("child").alias("id"), late.alias("late"), "child_ord"), ["late", "child_ord"])


def file_symbols(cat: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols of each file (target: its path) but modules and parameters."""
    found = paths.join(cat, F.col("target") == F.col("source_path")).where(~F.col("kind").isin("module", "parameter"))
    return numbered(found.select("target", "id", "ord"), ["ord"])


def orphans(cat: DataFrame, edges: DataFrame, degrees: DataFrame, kind: str | tuple[str, ...] = "function") -> DataFrame:
    """Symbols of a kind that nobody calls: id, place; of several kinds with their kind. Free ones before members, public before private, well-connected first."""
    kinds = (kind,) if isinstance(kind, str) else kind
    rest = cat.where(F.col("kind").isin(*kinds)).join(edges.where("calls > 0").select(F.col("dst").alias("id")), "id", "left_anti").join(degrees, "id", "left")
    key = F.struct(F.contains("path", F.lit("#")).alias("member"), F.col("name").startswith("_").alias("private"), (-F.coalesce("degree", F.lit(0))).alias("loose"), "ord")
    return rest.select(*([] if isinstance(kind, str) else ["kind"]), "id", key.alias("key"))


def lookup(queries: DataFrame, cat: DataFrame) -> DataFrame:
    """query_id, id, confidence. queries: (query_id, name, bare, kind). An id is exact; a bare name is a descriptor path, else a display name; nothing is guessed."""
    asked = queries.select("query_id", F.col("name").alias("asked"), F.col("kind").alias("asked_kind"), "bare")
    exact = asked.where(~F.col("bare")).join(cat, F.col("id") == F.col("asked")).select("query_id", "id", "ord", F.lit(1.0).alias("confidence"))
    bare = asked.where("bare").drop("bare")
    by_path = bare.join(cat.where("path <> ''"), F.col("asked") == F.col("path")).select("query_id", "id", "kind", "asked_kind", "ord")
    rest = bare.join(by_path.select("query_id").distinct(), "query_id", "left_anti")
    by_name = rest.join(cat, F.col("asked") == F.col("name")).select("query_id", "id", "kind", "asked_kind", "ord")
    wanted = F.coalesce(F.lower("asked_kind"), F.lit(""))
    fits = (wanted == "") | (wanted == F.col("kind")) | ((wanted == "class") & (F.col("kind") == "struct"))
    return exact.unionByName(by_path.unionByName(by_name).where(fits).select("query_id", "id", "ord", F.lit(0.98).alias("confidence")))


def implementors(targets: DataFrame, implements: DataFrame, cat: DataFrame) -> DataFrame:
    """target, id, place: what implements each target, in the order of the corpus."""
    found = targets.join(implements, F.col("target") == F.col("interface")).select("target", F.col("implementor").alias("id"))
    return numbered(found.join(cat.select("id", "ord"), "id", "left").withColumn("ord", F.coalesce("ord", F.lit(LAST))), ["ord"])


#: Results of a structural query at most.
LIMIT = 512
#: The place of ids that no catalogue holds; confidence of each operation's results.
LAST = 1 << 62
CONFIDENCE = {"file_symbols": ("file_scope", 1.0), "contained_by": ("containment", 1.0), "implementors": ("implementation", 1.0), "callers": ("{mode}_incoming", 0.95), "callees": ("{mode}_outgoing", 0.95), "orphans": ("orphan_scan", 0.9)}


class Parts(dict):
    """Parts of a graph by name, each made when it is first asked for."""

    def __init__(self, made: dict[str, Callable[[Parts], DataFrame]]):
        super().__init__()
        self.made = made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.made[name](self)
        return self[name]


def graph(symbols: DataFrame, relationships: DataFrame, occurrences: DataFrame, sources: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """The whole graph of a projection: catalogue, contains, implements, references (with scope, call and witness), definitions (id and witness) and edges.

    symbols (id, ord, source_path), relationships (id, target, is_implementation), occurrences (path, point, symbol,
    is_definition, range, enclosing) and sources (path, text), as files.projection_tables() and files.texts() give them;
    sources may come in pieces, see in_pieces(). Scopes are function definitions with an enclosing range; a reference
    belongs to the innermost one around it, or to its file. Both ends of an edge have to be known. Parts are made when
    they are asked for: edges need no line of a source.
    """
    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    # what several steps read is written: else each of them puts the sources together and parses them again
    def called(held: Parts) -> DataFrame:
        cat, places = held["catalogue"], held["occurrences"].where("bounds IS NOT NULL")
        scopes = places.where("is_definition").withColumn("around", bounds(F.col("enclosing"))).where(F.col("around").isNotNull() & (fx.symbol_kind(F.col("symbol")) == "function"))
        scopes = scopes.join(cat.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("path", F.col("symbol").alias("scope"), F.col("around").alias("bounds"), F.col("point").alias("ord"))
        points = places.where("NOT is_definition").join(cat.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("path", "point", F.col("bounds.l0").alias("line"), F.col("bounds.c0").alias("column"), F.col("symbol").alias("dst"), "bounds")
        inside = session.written(innermost_scope(session.written(points, "points"), session.written(scopes, "scopes")).withColumnRenamed("scope", "src"), "inside")
        known = cat.select("id").unionByName(cat.select(F.concat(F.lit("file:"), F.col("source_path")).alias("id"))).distinct().withColumnRenamed("id", "src")
        marked = marked_calls(inside.join(known, "src", "left_semi"), call_spans(held["sources"]))
        return session.written(marked.withColumn("place", F.struct("path", "point")), "called")

    def definitions(held: Parts) -> DataFrame:
        defined = held["occurrences"].where("is_definition").select(F.col("symbol").alias("id"), "path", "point", "bounds").join(held["catalogue"].select("id"), "id", "left_semi")
        return session.written(witnesses(defined, held["sources"], held["lines"]), "definitions")

    return Parts({
        "catalogue": lambda held: session.written(catalogue(symbols, root), "catalogue"),
        "contains": lambda held: containment(held["catalogue"]),
        "implements": lambda held: implementations(relationships, held["catalogue"]),
        "occurrences": lambda held: session.written(occurrences.withColumn("bounds", bounds(F.col("range"))), "occurrences"),
        "sources": lambda held: session.written(in_pieces(sources).repartition(tasks, "path", "piece"), "sources"),
        "lines": lambda held: session.written(source_lines(held["sources"]), "lines"),
        "called": called,
        "edges": lambda held: reference_edges(held["called"]),
        "references": lambda held: session.written(witnesses(held["called"], held["sources"], held["lines"]), "references"),
        "definitions": definitions,
    })


def search(queries: DataFrame, held: dict[str, DataFrame], limit: int = LIMIT, mode: str = "calls") -> DataFrame:
    """query_id, operation, id, place, route, confidence: the first results of structural queries (query_id, operation, target).

    target: a symbol, a file's path for file_symbols, `file:` and a path for callers, a kind for orphans. An operation
    that is not known has no results.
    """
    # every operation reads the edges: a plan that counts them for each takes much of a driver's memory
    cat, edges = held["catalogue"], session.written(held["edges"], "edges")

    def of(operation: str) -> DataFrame:
        return queries.where(F.col("operation") == operation).select("target").distinct()

    degrees = degree(edges, held["contains"], held["implements"])
    free = of("orphans")
    kinds = ("function", "struct", "term", "module", "symbol")
    unused = orphans(cat, edges, degrees, kinds).withColumnRenamed("kind", "target").join(free, "target", "left_semi")
    found = {
        "file_symbols": file_symbols(cat, of("file_symbols")),
        "contained_by": contained_by(of("contained_by"), held["contains"]),
        "implementors": implementors(of("implementors"), held["implements"], cat),
        "callers": callers(of("callers"), edges, held["implements"], mode, cat),
        "callees": callees(of("callees"), edges, mode),
        "orphans": unused.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("key", "id"))).drop("key"),
    }
    parts = [rows.select("target", "id", "place", F.lit(op).alias("operation"), F.lit(CONFIDENCE[op][0].format(mode=mode)).alias("route"), F.lit(CONFIDENCE[op][1]).alias("confidence")) for op, rows in found.items()]
    return queries.join(reduce(DataFrame.unionByName, parts), ["operation", "target"]).where(F.col("place") <= max(0, limit)).select("query_id", "operation", "id", "place", "route", "confidence")


def in_corpus_order(values: DataFrame, cat: DataFrame) -> DataFrame:
    """values (target, id) each once with place, in the order of the catalogue, unknown ids last."""
    return numbered(values.join(cat.select("id", "ord"), "id", "left").withColumn("ord", F.coalesce("ord", F.lit(LAST))), ["ord"])
