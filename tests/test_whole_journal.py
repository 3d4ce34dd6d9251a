"""Registered queries over the journal, against what all predicates and environments give."""

from datetime import datetime, timedelta

from factloom import session
from factloom.operators import journal
from factloom.plans import journal as plans
from factloom.sources import tables


def test_all_predicates_and_environments_count(spark, tmp_path):
    session.ship(spark)
    kinds = ["signup", "purchase", "click", "error", "view"]
    rows = [(n, n // 2 % 2, kinds[n // 4 % 5], float(n % 3), datetime(2024, 1, 1) + timedelta(hours=3 * n)) for n in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    facts = tables.assertions(spark, str(tmp_path))
    edges = [(r.old_id, r.new_id, r.recorded_at) for r in journal.replacements(tables.proposed_replacements(facts), facts).collect()]
    assert {kinds[old // 4 % 5] for old, _, _ in edges} > {"error"} and {old % 2 for old, _, _ in edges} == {0, 1}
    want = {}
    for source in {old for old, _, _ in edges}:
        met, new = set(), {source}
        while new:
            new = {b for a, b, _ in edges if a in new} - met
            met |= new
        want[source] = (len(met - {source}), max(met - {source}))
    assert {r.source: (r.n_after, r.last_node) for r in plans.replacement_reachability(spark, str(tmp_path)).collect()} == want
    events = [(f"env-{n % 2}", ts, str(n)) for n, *_, ts in rows] + [(f"env-{old % 2}", at, f"after-{old}") for old, _, at in edges]
    got = {(r.environment, r.ref): r.place for r in plans.event_timeline(spark, str(tmp_path)).collect()}
    for env in ("env-0", "env-1"):
        assert [got[env, ref] for _, _, ref in sorted(e for e in events if e[0] == env)] == list(range(1, 1 + sum(e[0] == env for e in events)))
