"""Bitemporal assertions: canonical identity, validated appends, replacement, recall as of two times, conflicts.

A fact holds over a half-open range of snapshot positions [valid_from, valid_to) and is known from recorded_at on.
Facts are rows (id, entity, predicate, value_json, repository, branch, environment, valid_from, valid_to, recorded_at,
evidence_json, negated); replacements are rows (id, old_id, new_id, effective, recorded_at). Neither is ever changed.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import session

#: Predicates with one value at a time.
SINGLE_VALUED = ("default", "signature", "exists", "parameter_exists")
MODES = ("baseline", "temporal", "conflict", "combined")
SCOPE = ("repository", "branch", "environment")
FOREVER = 1 << 62
#: Rows that a task sorts, about; rows of facts shrink so much in a shuffle that adaptive execution would give it very many.
SHARE = 250_000
#: Rounds that are kept apart before they are written together.
MOST_PARTS = 8


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def canonical_json(value: str | None) -> str | None:
    """Open JSON in canonical form: keys sorted, no spaces, no NaN or infinity."""
    return None if value is None else json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_batch(values: pd.Series) -> pd.Series:
    return values.map(canonical_json)


def canonical_value(value: Column | str) -> Column:
    return F.pandas_udf(canonical_batch, "string")(value)


#: JSON that is canonical as it stands: whole numbers, constants, plain strings, and objects of one plain string.
PLAIN_STRING = r'"[^"\\\x00-\x1f]*"'
PLAIN_JSON = r"^(null|true|false|0|-?[1-9][0-9]*|S|\{S:S\})\z".replace("S", PLAIN_STRING)


def plainly_canonical(value: str) -> Column:
    return F.col(value).isNull() | F.col(value).rlike(PLAIN_JSON)


def in_canonical_form(value: str) -> Column:
    """A JSON column in canonical form. Every row goes through Python; identified() parts rows instead."""
    here, plain = F.col(value), plainly_canonical(value)
    return F.when(plain, here).otherwise(canonical_value(F.when(~plain, here)))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def utc(text: Column) -> Column:
    """An ISO text with an offset or Z as a timestamp; text without an offset is an error."""
    fine = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(fine, F.to_timestamp(text)).otherwise(F.when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("time without offset: "), text))))


def canonical(evidence: Column | None = None, value: Column | None = None) -> Column:
    """The canonical JSON of a fact: keys in order, nulls written out. evidence, value: its open JSON, if it is in canonical form already."""
    evidence = in_canonical_form("evidence_json") if evidence is None else evidence
    value = in_canonical_form("value_json") if value is None else value
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(
        F.lit('{"entity":'), quoted(F.col("entity")), F.lit(',"evidence":'), evidence, F.lit(',"negated":'), F.col("negated").cast("string"),
        F.lit(',"predicate":'), quoted(F.col("predicate")), F.lit(',"recorded_at":"'), utc_text(F.col("recorded_at")),
        F.lit('","scope":{"branch":'), quoted(F.col("branch")), F.lit(',"environment":'), quoted(F.col("environment")), F.lit(',"repository":'), quoted(F.col("repository")),
        F.lit('},"valid_from":'), number("valid_from"), F.lit(',"valid_to":'), number("valid_to"), F.lit(',"value":'), value, F.lit("}"),
    )


def identified(facts: DataFrame) -> DataFrame:
    """facts with id, the SHA-256 of their canonical form. Rows whose JSON is plainly canonical as it stands stay out of Python."""
    plain = plainly_canonical("evidence_json") & plainly_canonical("value_json")
    here = facts.where(plain).withColumn("id", F.sha2(canonical(F.col("evidence_json"), F.col("value_json")), 256))
    parsed = facts.where(~plain).withColumn("id", F.sha2(canonical(canonical_value("evidence_json"), canonical_value("value_json")), 256))
    return here.unionByName(parsed)


def flaw() -> Column:
    """What is wrong with a fact, null if nothing is."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return (
        F.when(blank("entity"), "entity").when(blank("predicate"), "predicate").when(blank("repository"), "repository")
        .when(F.col("valid_from") < 0, "valid_from").when(F.col("valid_to") < 0, "valid_to")
        .when(F.col("valid_to").isNotNull() & F.col("valid_from").isNull(), "valid_to without valid_from")
        .when(F.col("valid_to") <= F.col("valid_from"), "empty interval")
        .when(F.coalesce(F.trim(F.get_json_object("evidence_json", "$.source")), F.lit("")) == "", "evidence source")
        .when(F.col("recorded_at").isNull(), "recorded_at")
    )


def validated(facts: DataFrame) -> DataFrame:
    """facts; the whole batch fails if one is wrong."""
    return facts.withColumn("entity", F.when(flaw().isNotNull(), F.raise_error(F.concat(F.lit("bad fact: "), flaw()))).otherwise(F.col("entity")))


def fresh(batch: DataFrame, journal: DataFrame) -> DataFrame:
    """The facts of a batch that the journal lacks, each once."""
    return identified(validated(batch)).dropDuplicates(["id"]).join(journal.select("id"), "id", "left_anti")


def refusals(proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """proposals (old_id, new_id, effective, recorded_at) with refusal, the first rule that speaks against it, null if none does."""
    keep = ["id", "entity", "predicate", "value_json", *SCOPE, "valid_from", "valid_to", "recorded_at"]
    old = facts.select(*[F.col(c).alias(f"o_{c}") for c in keep])
    new = facts.select(*[F.col(c).alias(f"n_{c}") for c in keep])
    both = proposals.join(old, F.col("old_id") == F.col("o_id"), "left").join(new, F.col("new_id") == F.col("n_id"), "left")
    same = lambda c: F.col(f"o_{c}") == F.col(f"n_{c}")
    number = lambda c: F.col(c).try_cast("double")
    equal = same("value_json") | F.coalesce(number("o_value_json") == number("n_value_json"), F.lit(False))
    alive = lambda s: F.col(f"{s}_valid_from").isNotNull() & (F.col(f"{s}_valid_from") <= F.col("effective"))
    return both.select(
        *proposals.columns,
        F.when(F.col("effective").isNull() | (F.col("effective") < 0) | (F.col("old_id") == F.col("new_id")), "effective")
        .when(F.col("o_id").isNull() | F.col("n_id").isNull(), "unknown fact")
        .when(~(same("entity") & same("predicate") & same("repository") & same("branch") & same("environment")), "other subject")
        .when(~F.col("o_predicate").isin(*SINGLE_VALUED) & ~equal, "other value")
        .when((F.col("o_recorded_at") > F.col("recorded_at")) | (F.col("n_recorded_at") > F.col("recorded_at")), "not yet recorded")
        .when(~(alive("o") & alive("n")), "not yet valid")
        .when((F.col("effective") >= F.col("o_valid_to")) | (F.col("effective") >= F.col("n_valid_to")), "already over")
        .alias("refusal"),
    )


def event_id() -> Column:
    """The content id of a replacement."""
    return F.sha2(F.concat(F.lit('{"effective":'), F.col("effective").cast("string"), F.lit(',"new":"'), F.col("new_id").cast("string"), F.lit('","old":"'), F.col("old_id").cast("string"), F.lit('","recorded_at":"'), utc_text(F.col("recorded_at")), F.lit('"}')), 256)


def replacements(proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """Proposals that no rule about their two facts speaks against, with their content id, each once.

    Cycles are not looked for: that is for proposals that follow the order of time, as a journal's stored events do, and
    so cannot close one. New events go through superseded().
    """
    return refusals(proposals, facts).where("refusal IS NULL").drop("refusal").withColumn("id", event_id()).dropDuplicates(["id"])


def judged(proposals: DataFrame, facts: DataFrame, held: DataFrame) -> DataFrame:
    """proposals with refusal, as refusals() gives it, or `cycle` where the old fact can be reached from the new one.

    held: the journal's replacements (old_id, new_id). A batch counts as one: proposals that close a cycle only
    together are all refused.
    """
    known = refusals(proposals, facts).checkpoint()
    edges = held.select("old_id", "new_id").unionByName(known.where("refusal IS NULL").select("old_id", "new_id"))
    bad = on_cycles(known.where("refusal IS NULL"), edges).select("old_id", "new_id", F.lit("cycle").alias("cycle"))
    return known.join(bad, ["old_id", "new_id"], "left").withColumn("refusal", F.coalesce("refusal", "cycle")).select(*proposals.columns, "refusal")


def superseded(proposals: DataFrame, facts: DataFrame, held: DataFrame) -> DataFrame:
    """The replacements that a batch of proposals adds to held (old_id, new_id, id, ...), with their content ids.

    The whole batch fails, with the name of the refusal, if one proposal is refused.
    """
    seen = judged(proposals, facts, held)
    fine = seen.withColumn("old_id", F.when(F.col("refusal").isNotNull(), F.raise_error(F.concat(F.lit("refused replacement: "), F.col("refusal")))).otherwise(F.col("old_id")))
    return fine.drop("refusal").withColumn("id", event_id()).dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti")


def reachable(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """(source, node) for all nodes that edges (old_id, new_id) lead to from sources (source); frontier by frontier, cycles included.

    A loop of joins: each round meets only nodes that are new, and is written out, so that plans stay short and a lost
    executor costs no earlier round.
    """
    edges = edges.select("old_id", "new_id").distinct()
    frontier = sources.select("source", F.col("source").alias("node")).distinct().checkpoint()
    parts, done = [frontier], 0
    while hops is None or done < hops:
        step = frontier.join(edges, F.col("node") == F.col("old_id")).select("source", F.col("new_id").alias("node")).distinct()
        for part in parts:
            step = step.join(part, ["source", "node"], "left_anti")
        frontier = step.checkpoint()
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > MOST_PARTS:
            parts = [reduce(DataFrame.unionByName, parts).checkpoint()]
        done += 1
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame) -> DataFrame:
    """(source, node) for all nodes that edges lead to from each old_id, itself included, in rounds that double the length of walks.

    Walks of up to 2 n edges are those of up to n, and those followed by a walk of just n. So chains of any length take
    a logarithmic number of rounds; along a chain each pair is made once.
    """
    jump = edges.select(F.col("old_id").alias("node"), F.col("new_id").alias("next")).distinct().checkpoint()
    seen = jump.select(F.col("node").alias("source"), "node").distinct().checkpoint()
    while True:
        new = seen.join(jump, "node").select("source", F.col("next").alias("node")).distinct().join(seen, ["source", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).checkpoint()
        jump = jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("further")), "next").select("node", F.col("further").alias("next")).distinct().checkpoint()


def followed(edges: DataFrame) -> DataFrame:
    """(source, n_after, last_node): how many nodes the edges lead to from each old_id, and the largest of them, where each node has one edge at most.

    Pointer jumping: a node's pointer, the number of edges it spans and the largest node on them take over those of the
    node it points to, so chains of any length take logarithmically many rounds and one row for each node. Two edges
    from one node are an error, and so are cycles, which a journal does not hold.
    """
    once = edges.select("old_id", "new_id").distinct().groupBy("old_id").agg(F.count("*").alias("n"), F.first("new_id").alias("next"))
    ways = once.select(F.col("old_id").alias("source"), F.when(F.col("n") > 1, F.raise_error(F.lit("a node with two edges"))).otherwise(F.col("next")).alias("next"), F.lit(1).cast("long").alias("n_after"))
    ways = session.written(ways.withColumn("last_node", F.col("next")), "ways")
    longest = ways.count()
    spanned = 1
    while True:
        on = ways.select(F.col("source").alias("next"), F.col("next").alias("further"), F.col("n_after").alias("more"), F.col("last_node").alias("theirs"))
        if ways.join(on, "next", "left_semi").isEmpty():
            return ways.select("source", "n_after", "last_node")
        if spanned > longest:
            raise ValueError("the edges hold a cycle")
        met = ways.join(on, "next", "left")
        ways = session.written(met.select("source", F.coalesce("further", "next").alias("next"), (F.col("n_after") + F.coalesce("more", F.lit(0))).alias("n_after"), F.greatest("last_node", "theirs").alias("last_node")), "ways")
        spanned *= 2


def creates_cycle(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """The proposals whose old fact is reachable from their new one."""
    found = reachable(edges, proposals.select(F.col("new_id").alias("source")))
    return proposals.join(found, (F.col("new_id") == F.col("source")) & (F.col("old_id") == F.col("node")), "left_semi")


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, end, rings): the last node of the chain on which each node is. links: (a, b), each node at most once as a and once as b.

    Pointers double, so chains of any length take logarithmically many rounds. rings: after as many steps as there are
    links the pointer still moves, so it goes round.
    """
    ways = session.written(links.select(F.col("a").alias("node"), F.col("b").alias("end")), "ways")
    n, spanned = ways.count(), 1
    while spanned <= n:
        on = ways.select(F.col("node").alias("end"), F.col("end").alias("further"))
        if ways.join(on, "end", "left_semi").isEmpty():
            break
        ways = session.written(ways.join(on, "end", "left").select("node", F.coalesce("further", "end").alias("end")), "ways")
        spanned *= 2
    moving = ways.select(F.col("node").alias("end"), F.lit(True).alias("rings"))
    return ways.join(moving, "end", "left").select("node", "end", F.coalesce("rings", F.lit(False)).alias("rings"))


def on_cycles(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """The proposals (old_id, new_id), themselves among edges (old_id, new_id), that lie on a cycle of edges.

    The graph is made smaller in rounds until nothing is left. Edges from a node to which none leads, and to one that
    leads nowhere, are on no cycle and go. Edges that are the only one out of a node and the only one into the next
    form chains, and each chain becomes one node; an edge from its end back to its start is then a loop, and all edges
    within that node are on a cycle. Long chains, trees and rings take a few such rounds of doubled pointers each, and
    no pairs of nodes are made. A core in which no round makes anything smaller is decided by closure(), whose pairs
    are those of the core alone.
    """
    named = lambda frame, *names: frame.select(*[F.col(c).alias(n) for c, n in zip(("old_id", "new_id"), names, strict=True)]).distinct()
    held = session.written(named(edges, "a", "b"), "edges")
    left = named(proposals, "old_id", "new_id").select("old_id", "new_id", F.col("old_id").alias("a"), F.col("new_id").alias("b"))  # within one node where a = b
    found, n, before = [left.limit(0)], held.count(), None
    while n and n != before:
        loops = session.written(left.where("a = b").join(held.where("a = b").select("a"), "a", "left_semi"), "loops")
        found.append(loops)
        left = left.join(loops, ["old_id", "new_id"], "left_anti")
        held = held.where("a <> b")
        held = session.written(held.join(held.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(held.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "edges")
        # what has gone with its edge, or is within a node without edges, is on no cycle
        alive = held.unionByName(held.select(F.explode(F.array("a", "b")).alias("a")).select("a", F.col("a").alias("b"))).distinct()
        left = session.written(left.join(alive, ["a", "b"], "left_semi"), "left")
        only = lambda c: held.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
        links = session.written(held.join(only("a"), "a", "left_semi").join(only("b"), "b", "left_semi"), "links")
        ends = session.written(chain_ends(links), "ends")
        rings = ends.where("rings").select(F.col("node").alias("a"))
        found.append(session.written(left.join(rings, "a", "left_semi"), "rings"))
        left = left.join(rings, "a", "left_anti")
        rest = held.join(links, ["a", "b"], "left_anti")
        for c in ("a", "b"):
            to = ends.where("NOT rings").select(F.col("node").alias(c), F.col("end").alias("__to"))
            rest, left = [f.join(to, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to") for f in (rest, left)]
        held, left = session.written(rest.select("a", "b").distinct(), "edges"), session.written(left, "left")
        before, n = n, held.count()
    if n:
        ask = left.where("a <> b").select("old_id", "new_id", F.col("b").alias("source"), F.col("a").alias("node"))
        within = left.where("a = b").drop("b").join(held, "a").select("old_id", "new_id", F.col("b").alias("source"), F.col("a").alias("node"))
        reach = closure(held.select(F.col("a").alias("old_id"), F.col("b").alias("new_id")))
        found.append(ask.unionByName(within).join(reach, ["source", "node"], "left_semi"))
    return reduce(DataFrame.unionByName, [f.select("old_id", "new_id") for f in found]).distinct()


def derived(facts: DataFrame, replaced: DataFrame, coordinates: DataFrame, entity: str | None = None) -> DataFrame:
    """Known facts at each coordinate (coordinate, at, known, and scope columns) with effective_to, superseded_by and status; of one entity only if it is named.

    Coordinates may also name an entity and a predicate each: then they are requests, and only facts about their own
    subject are met. Facts meet coordinates by equal columns, replacements meet what is left by the fact they replace,
    so a table of requests of any size is dealt out like the journal; the planner broadcasts one that it knows is small.
    """
    own = [c for c in ("entity", "predicate") if c in coordinates.columns]
    here = coordinates.select("coordinate", "at", "known", *SCOPE, *own)
    facts = facts if entity is None else facts.where(F.col("entity") == entity)
    known = facts.join(here, [*SCOPE, *own]).where(F.col("recorded_at") <= F.col("known"))
    events = replaced.select(F.col("old_id").alias("id"), "new_id", "effective", F.col("recorded_at").alias("replaced_at"), F.col("id").alias("replacement_id"))
    ends = (
        known.select("coordinate", "id", "at", "known").join(events, "id").where(F.col("replaced_at") <= F.col("known"))
        .groupBy("coordinate", "id")
        .agg(F.min("effective").alias("replaced_from"), F.sort_array(F.collect_list(F.when(F.col("effective") <= F.col("at"), F.struct("effective", "replacement_id", "new_id")))).alias("by"))
    )
    out = known.join(ends, ["coordinate", "id"], "left")
    end = F.least("valid_to", "replaced_from")
    by = F.coalesce(F.transform("by", lambda x: x["new_id"]), F.array().cast(f"array<{dict(facts.dtypes)['id']}>"))
    status = (
        F.when(F.col("valid_from").isNull(), "unknown_validity")
        .when(F.col("at") < F.col("valid_from"), "not_yet_valid")
        .when(F.col("at") >= end, F.when(F.size(by) > 0, "superseded").otherwise("expired"))
        .otherwise("active")
    )
    return out.select(*facts.columns, "coordinate", "at", "known", end.alias("effective_to"), by.alias("superseded_by"), status.alias("status"))


def shares(rows: DataFrame) -> int:
    """How many partitions a table is dealt to, so that a task's share does not grow with it."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // SHARE + 1)


def selected(rows: DataFrame, mode: str) -> DataFrame:
    return rows.where(F.col("status") == "active") if mode in ("temporal", "combined") else rows


def incompatible(a: str, b: str) -> Column:
    """Whether two facts about one entity and predicate contradict each other. What is not stated is not denied."""
    other = F.col(f"{a}.negated") != F.col(f"{b}.negated")
    same = F.col(f"{a}.value_json") == F.col(f"{b}.value_json")
    return F.when(other, same).otherwise(~F.col(f"{a}.negated") & F.col(f"{a}.predicate").isin(*SINGLE_VALUED) & ~same)


def diagnosis(a: str, b: str, temporal: bool) -> Column:
    """Null if compatible; else different_scope, unknown_validity, version_change or conflict."""
    scope = F.lit(False)
    for c in SCOPE:
        scope = scope | (F.col(f"{a}.{c}") != F.col(f"{b}.{c}"))
    late = F.greatest(f"{a}.valid_from", f"{b}.valid_from")
    over = F.least(F.coalesce(F.col(f"{a}.effective_to"), F.lit(FOREVER)), F.coalesce(F.col(f"{b}.effective_to"), F.lit(FOREVER)))
    out = F.when(~incompatible(a, b), F.lit(None)).when(scope, "different_scope")
    if temporal:
        out = out.when(F.col(f"{a}.valid_from").isNull() | F.col(f"{b}.valid_from").isNull(), "unknown_validity").when(late >= over, "version_change")
    return out.otherwise("conflict")


def pairs(rows: DataFrame, mode: str, parts: int | None = None) -> DataFrame:
    """Diagnosed pairs among derived rows in modes conflict and combined: coordinate, left_id, right_id, diagnosis, current.

    An equi-join on (coordinate, entity, predicate); facts that cannot be in a pair, because no fact of their key
    differs in value or sign, are left out before it by an aggregate. A key with very many facts is one that adaptive
    execution splits, since both sides of the join are plain shuffles. parts: how many partitions the keys are dealt to,
    where the caller knows the number of rows; they are left to adaptive execution else.
    """
    key = ["coordinate", "entity", "predicate"]
    shape = F.concat_ws("|", "value_json", F.col("negated").cast("string"))
    mixed = rows.groupBy(*key).agg(F.min(shape).alias("__least"), F.max(shape).alias("__most")).where("__least <> __most").select(*key)
    able = rows.join(mixed, key, "left_semi")
    able = able if parts is None else able.repartition(parts, *key)
    a, b = able.alias("a"), able.alias("b")
    on = (F.col("a.coordinate") == F.col("b.coordinate")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.id") < F.col("b.id"))
    now = F.lit(True) if mode == "conflict" else (F.col("a.status") == "active") & (F.col("b.status") == "active")
    met = a.join(b, on).where(incompatible("a", "b"))
    return met.select(F.col("a.coordinate").alias("coordinate"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), diagnosis("a", "b", mode != "conflict").alias("diagnosis"), now.alias("current"))


def answers(rows: DataFrame, coordinates: DataFrame, *modes: str) -> DataFrame:
    """One row for each coordinate and mode, also where nothing is known: mode, n_selected, n_conflicts, answer.

    Mode combined asks for active facts only, which are the only ones joined for it when it is asked alone.
    Rows are written once, and the more there are, the more partitions their pairs take, so that a task's share stays
    the same.
    """
    needed = ["coordinate", "id", "entity", "predicate", "value_json", "negated", *SCOPE, "valid_from", "effective_to", "status"]
    rows = session.written(rows.select(*needed), "answered")
    parts = shares(rows)
    active = F.col("status") == "active"
    n = rows.groupBy("coordinate").agg(F.count("*").alias("n_all"), F.count_if(active).alias("n_active"))
    out = coordinates.select("coordinate").join(n, "coordinate", "left")
    if "conflict" in modes:
        found = pairs(rows, "combined", parts)
        bare, exact = F.count_if(F.col("diagnosis") != "different_scope"), F.count_if((F.col("diagnosis") == "conflict") & F.col("current"))
        out = out.join(found.groupBy("coordinate").agg(bare.alias("bare"), exact.alias("exact")), "coordinate", "left")
    elif "combined" in modes:
        found = pairs(rows.where(active), "combined", parts).where("diagnosis = 'conflict'")
        out = out.join(found.groupBy("coordinate").agg(F.count("*").alias("exact")), "coordinate", "left")
    mode = F.col("mode")
    out = out.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    zero = lambda c: F.coalesce(F.col(c) if c in out.columns else F.lit(0), F.lit(0)).cast("long")
    held = F.when(mode.isin("temporal", "combined"), zero("n_active")).otherwise(zero("n_all"))
    bad = F.when(mode == "conflict", zero("bare")).when(mode == "combined", zero("exact")).otherwise(F.lit(0)).cast("long")
    return out.select("coordinate", "mode", held.alias("n_selected"), bad.alias("n_conflicts"), F.when(bad > 0, "conflict").when(held > 0, "supported").otherwise("unknown").alias("answer"))


def timeline(facts: DataFrame, replaced: DataFrame) -> DataFrame:
    """Assertions and replacements of each scope as one list of events with their place in it: kind, ref, recorded_at, place.

    Events are numbered within hours, and each hour starts where the hours before it end. Only the counts of hours are
    ordered over a whole scope.
    """
    a = facts.select(F.lit("assertion").alias("kind"), F.col("id").cast("string").alias("ref"), "recorded_at", *SCOPE)
    b = replaced.join(facts.select(F.col("id").alias("old_id"), *SCOPE), "old_id").select(F.lit("replacement").alias("kind"), F.col("id").cast("string").alias("ref"), "recorded_at", *SCOPE)
    events = a.unionByName(b).withColumn("__hour", F.date_trunc("hour", "recorded_at"))
    hours = events.groupBy(*SCOPE, "__hour").agg(F.count("*").alias("__n"))
    before = hours.select(*SCOPE, "__hour", (F.sum("__n").over(Window.partitionBy(*SCOPE).orderBy("__hour")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*SCOPE, "__hour").orderBy("recorded_at", "ref"))
    return events.withColumn("__within", within).join(before, [*SCOPE, "__hour"]).select("kind", "ref", "recorded_at", *SCOPE, (F.col("__before") + F.col("__within")).alias("place"))
