"""Queries over dates in text and over dialogue turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import dates, dialogue
from factloom.sources import tables

FORMS = 12


def dated_sentences(spark, sf_dir):
    """Each order's date rendered in one of twelve forms, explicit ones with and relative ones against a reference."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % FORMS).cast("int").alias("form"))
    f = lambda p: F.date_format("day", p)
    said = [
        F.concat(F.lit("Sent on "), f("d MMMM yyyy"), F.lit(".")), F.concat(F.lit("Sent "), f("MMM d, yyyy"), F.lit(".")), F.concat(F.lit("Paid in "), f("MMMM yyyy")), F.concat(F.lit("Kept since "), f("yyyy"), F.lit("!")),
        F.lit("It came yesterday."), F.lit("the day after tomorrow it goes"), F.lit("That was 3 weeks ago"), F.lit("He left two months ago."), F.lit("she wrote five days ago"), F.lit("next week we meet"), F.lit("Last month was cold"), F.lit("this year is good"),
    ]
    text = F.element_at(F.array(*said), F.col("form") + 1)
    return o.select("o_orderkey", "day", "form", text.alias("text"))


def dates_found(kind):
    def query(spark, sf_dir):
        rows = dated_sentences(spark, sf_dir).where(FILTERS[kind]).withColumn("ref", F.col("day"))
        return rows.select("o_orderkey", F.explode(dates.times("text", "ref")).alias("t")).select("o_orderkey", F.col("t.first").alias("first_day"), F.col("t.last").alias("last_day"), F.col("t.precision").alias("precision"), F.col("t.rule").alias("rule"))

    query.__name__ = f"dates_{kind}"
    return query


def dates_mixed(spark, sf_dir):
    """Sentences with several spans, some inside others: which rule claims which place, in order of place."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    f = lambda p: F.date_format("day", p)
    text = F.concat(F.lit("Tomorrow, not on "), f("d MMMM yyyy"), F.lit(" or in "), f("MMM yyyy"), F.lit(" or "), f("yyyy"), F.lit(", the day before yesterday; 2 years ago, today, last year."))
    rows = o.withColumn("text", text).select("o_orderkey", F.posexplode(dates.times("text", "day")).alias("place", "t"))
    return rows.select("o_orderkey", "place", F.col("t.offset").alias("offset"), F.col("t.expression").alias("expression"), F.col("t.rule").alias("rule"), F.col("t.first").alias("first_day"), F.col("t.last").alias("last_day"))


FILTERS = {"explicit": "form IN (0, 1, 3)", "month": "form = 2", "relative": "form IN (4, 5, 8)", "ago_week": "form IN (6, 7)", "period": "form IN (9, 10, 11)"}


def inputs(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    eps = session.written(dialogue.episodes(turns), "episodes")
    return eps, session.written(dialogue.asked(tables.questions(spark, sf_dir), eps), "questions")


def sentence_events(spark, sf_dir):
    turns = dialogue.with_people(tables.turns(spark, sf_dir))
    return dialogue.sentence_events(turns).select("conversation_id", "dia_id", "sentence", F.array_join("subjects", ",").alias("subjects"), "modality", "normalized_time")


def context_windows(spark, sf_dir):
    return dialogue.windows(tables.turns(spark, sf_dir), 1).select("conversation_id", "dia_id", F.array_join("context_ids", ",").alias("context_ids"), "context")


def previous_turn_links(spark, sf_dir):
    return dialogue.previous_links(tables.turns(spark, sf_dir)).where("previous_id IS NOT NULL").select("conversation_id", "dia_id", "previous_id")


def search(profile):
    def query(spark, sf_dir):
        eps, q = inputs(spark, sf_dir)
        return dialogue.searched(q, eps, profile).select("question_id", "rank", "dia_id", "score", "time_overlap", "candidates")

    query.__name__ = f"{profile}_search"
    return query


def date_reader(spark, sf_dir):
    eps, q = inputs(spark, sf_dir)
    return dialogue.date_answers(q, dialogue.guarded(q, eps))


def route(name, profile):
    def query(spark, sf_dir):
        eps, q = inputs(spark, sf_dir)
        return dialogue.routed(q, eps, profile)

    query.__name__ = name
    return query


def rrf_weighted_context(spark, sf_dir):
    eps, q = inputs(spark, sf_dir)
    return dialogue.fused_context(q, eps, dialogue.settings("context_rrf")).select("question_id", "rank", "dia_id", "score")


def inventory_statistics(spark, sf_dir):
    """Turns, statements, dated and planned ones of each conversation."""
    turns = dialogue.with_people(tables.turns(spark, sf_dir))
    said = dialogue.sentence_events(turns).groupBy("conversation_id").agg(F.count("*").alias("n_events"), F.count_if(F.size("times") > 0).alias("n_dated"), F.count_if(F.col("modality") == "planned").alias("n_planned"))
    return turns.groupBy("conversation_id").agg(F.count("*").alias("n_turns")).join(said, "conversation_id")


ROUTES = {"question_response_bridge": "bridge_adaptive", "calendar_rescue": "calendar_unique", "bridge_calendar": "bridge_calendar", "context_balanced": "context_balanced", "context_only": "context_only"}
QUERIES = {q.__name__: q for q in [*map(dates_found, FILTERS), dates_mixed, sentence_events, context_windows, previous_turn_links, inventory_statistics, *map(search, dialogue.PROFILES), date_reader, rrf_weighted_context, *(route(n, p) for n, p in ROUTES.items())]}

EVENTS_SQL = f"""{tables.TURNS_SQL},
sent AS (SELECT * EXCLUDE (text), unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, text FROM turns),
ev AS (SELECT * EXCLUDE (text), regexp_matches(sentence, '(?i)\\bAnna\\b') OR (speaker = 'Anna' AND regexp_matches(sentence, '(?i)\\b(I|my|me|we|our)\\b')) OR (speaker = 'Ben' AND regexp_matches(sentence, '(?i)\\b(you|your)\\b')) AS anna,
 regexp_matches(sentence, '(?i)\\bBen\\b') OR (speaker = 'Ben' AND regexp_matches(sentence, '(?i)\\b(I|my|me|we|our)\\b')) OR (speaker = 'Anna' AND regexp_matches(sentence, '(?i)\\b(you|your)\\b')) AS ben,
 regexp_matches(sentence, '(?i)\\b(will|gonna|planning|plan to|want to|hope to|thinking of|next month|tomorrow)\\b') AS planned,
 CASE WHEN sentence LIKE '%I met Ben on %' THEN session_date WHEN sentence LIKE '%Anna moved in %' THEN date_trunc('month', session_date)::date WHEN sentence LIKE '%next month.' THEN (date_trunc('month', session_date) + interval 1 month)::date WHEN sentence LIKE '%Ben saw them yesterday.' THEN session_date - 1 END AS f,
 CASE WHEN sentence LIKE '%I met Ben on %' THEN 'day' WHEN sentence LIKE '%Anna moved in %' THEN 'month' WHEN sentence LIKE '%next month.' THEN 'month' WHEN sentence LIKE '%Ben saw them yesterday.' THEN 'day' END AS p
 FROM sent WHERE trim(sentence) <> '' AND NOT rtrim(sentence) LIKE '%?'),
named AS (SELECT *, CASE WHEN p = 'day' THEN strftime(f, '%-d %B %Y') WHEN p = 'month' THEN strftime(f, '%B %Y') ELSE '' END AS said FROM ev)"""


def conversation_scores(name: str, docs: str) -> str:
    """CTE name_sc: question_id, conversation_id, dia_id, raw; BM25 of the questions q2 within their conversations. docs: conversation_id, dia_id, text."""
    from .search import TERMS

    return f"""
{name}_d AS (SELECT conversation_id, dia_id, {TERMS} AS toks FROM ({docs})), {name}_w AS (SELECT conversation_id, count(*) AS total, avg(len(toks)) AS mean FROM {name}_d GROUP BY ALL),
{name}_p AS (SELECT conversation_id, dia_id, term, count(*) AS tf FROM (SELECT conversation_id, dia_id, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
{name}_df AS (SELECT conversation_id, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_parts AS (SELECT question_id, qt.conversation_id, dia_id, term, ln(1 + (total - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * (len(toks) / mean))) AS part
 FROM qt JOIN {name}_p USING (conversation_id, term) JOIN {name}_df USING (conversation_id, term) JOIN {name}_d USING (conversation_id, dia_id) JOIN {name}_w USING (conversation_id)),
{name}_sc AS (SELECT question_id, conversation_id, dia_id, round(sum(part), 6) AS raw FROM {name}_parts GROUP BY ALL)"""


def asked_sql() -> str:
    """CTEs of turns, statements (named) and questions (q2, their terms qt), by the planted names and dates of the rendered turns."""
    from .search import TERMS

    return f"""{EVENTS_SQL}, {tables.QUESTIONS_SQL},
q AS (SELECT *, CASE WHEN question LIKE 'In %' THEN strptime('1 ' || regexp_extract(question, '^In ([A-Za-z]+ [0-9]+)', 1), '%d %B %Y')::date END AS qf, question LIKE 'When %' AS open_when FROM questions),
who AS (SELECT conversation_id, list_sort(list(DISTINCT speaker)) AS people FROM turns GROUP BY ALL),
q2 AS (SELECT q.*, people, CASE WHEN regexp_matches(question, '(?i)\\bAnna\\b') AND list_contains(people, 'Anna') AND NOT (regexp_matches(question, '(?i)\\bBen\\b') AND list_contains(people, 'Ben')) THEN 'Anna' WHEN regexp_matches(question, '(?i)\\bBen\\b') AND list_contains(people, 'Ben') AND NOT (regexp_matches(question, '(?i)\\bAnna\\b') AND list_contains(people, 'Anna')) THEN 'Ben' END AS subject FROM q JOIN who USING (conversation_id)), q3 AS (SELECT * EXCLUDE (conversation_id) FROM q2),
qt AS (SELECT DISTINCT question_id, conversation_id, unnest(toks) AS term FROM (SELECT question_id, conversation_id, {TERMS} AS toks FROM (SELECT question_id, conversation_id, question AS text FROM q2))),
tm AS (SELECT conversation_id, dia_id, string_agg(said, ' ' ORDER BY f, sentence) FILTER (said <> '') AS said FROM named GROUP BY ALL),
tt AS (SELECT turns.*, coalesce(said, '') AS said, regexp_matches(text, '(?i)\\bAnna\\b') OR (speaker = 'Anna' AND regexp_matches(text, '(?i)\\b(I|my|me|we|our)\\b')) OR (speaker = 'Ben' AND regexp_matches(text, '(?i)\\b(you|your)\\b')) AS t_anna,
 regexp_matches(text, '(?i)\\bBen\\b') OR (speaker = 'Ben' AND regexp_matches(text, '(?i)\\b(I|my|me|we|our)\\b')) OR (speaker = 'Anna' AND regexp_matches(text, '(?i)\\b(you|your)\\b')) AS t_ben FROM turns LEFT JOIN tm USING (conversation_id, dia_id))"""


def relation_sql(name: str, pairs: str) -> str:
    """CTE name: question_id, dia_id, mismatch: whether the turn's statements are about others than the asked subject. pairs: question_id, conversation_id, dia_id."""
    return f"""{name} AS (SELECT x.question_id, x.dia_id, any_value(subject) IS NOT NULL AND NOT coalesce(bool_or(CASE subject WHEN 'Anna' THEN anna WHEN 'Ben' THEN ben END), false) AND count(sentence) > 0 AND NOT coalesce(bool_or(NOT anna AND NOT ben) FILTER (sentence IS NOT NULL), false) AS mismatch
 FROM ({pairs}) x JOIN q2 USING (question_id) LEFT JOIN named ON named.conversation_id = x.conversation_id AND named.dia_id = x.dia_id GROUP BY ALL)"""


def search_ctes(profile: str, name: str = "") -> str:
    """CTE name_r: question_id, dia_id, session, pos, time_overlap, score of all hits, and name_top with their ranks and candidates, the first five."""
    guarded, temporal = profile == "guarded", profile in ("temporal", "combined", "guarded")
    text = "speaker || ': ' || text" if guarded or not temporal else "concat_ws(' ', speaker || ': ' || text, said)"
    hard = "AND (subject IS NULL OR CASE subject WHEN 'Anna' THEN t_anna ELSE t_ben END)" if profile in ("provenance", "combined") else ""
    bears = "(subject IS NULL OR (subject = 'Anna' AND anna) OR (subject = 'Ben' AND ben)" + (" OR (NOT anna AND NOT ben))" if guarded else ")")
    boost = "coalesce(over_, false)" if temporal else "false"
    guard = "CASE WHEN mismatch AND NOT open_when THEN 0.5::double ELSE 1 END" if guarded else "1::double"
    return f"""{conversation_scores(name + 's', f"SELECT conversation_id, dia_id, {text} AS text FROM tt")}, {relation_sql(name + '_rel', f'SELECT * FROM {name}s_sc')},
{name}_over AS (SELECT x.question_id, x.dia_id, bool_or({bears} AND f <= (qf + interval 1 month)::date - 1 AND qf <= CASE p WHEN 'day' THEN f ELSE (f + interval 1 month)::date - 1 END) AS over_
 FROM {name}s_sc x JOIN q2 USING (question_id) LEFT JOIN named ON named.conversation_id = x.conversation_id AND named.dia_id = x.dia_id GROUP BY ALL),
{name}_r AS (SELECT question_id, conversation_id, dia_id, session, pos, {boost} AS time_overlap, round(raw * (CASE WHEN {boost} THEN 1.2::double ELSE 1 END * {guard}), 6) AS score
 FROM {name}s_sc x JOIN tt USING (conversation_id, dia_id) JOIN q3 USING (question_id) JOIN {name}_rel USING (question_id, dia_id) JOIN {name}_over USING (question_id, dia_id) WHERE true {hard}),
{name}_top AS (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, session, pos) AS integer) AS rank, count(*) OVER (PARTITION BY question_id) AS candidates FROM {name}_r QUALIFY rank <= 5)"""


def search_sql(profile: str) -> str:
    return f"WITH {asked_sql()}, {search_ctes(profile)} SELECT question_id, rank, dia_id, score, time_overlap, candidates FROM _top"


def reader_ctes(name: str = "") -> str:
    """CTE name_read: question_id, answer, reason, from name_top."""
    from .search import TERMS

    return f"""{name}_qw AS (SELECT question_id, list_filter(list_distinct({TERMS}), lambda w: NOT list_contains(list_transform(people, lambda x: lower(x)), w)) AS terms FROM (SELECT question_id, people, question AS text FROM q2)),
{name}_st AS (SELECT conversation_id, dia_id, anna, ben, planned, f, p, {TERMS} AS toks FROM (SELECT * EXCLUDE (sentence), sentence AS text FROM named) WHERE p IS NOT NULL),
{name}_rd AS (SELECT t.question_id, f, p, len(list_distinct(list_intersect(terms, toks))) AS common FROM {name}_top t JOIN q3 USING (question_id) JOIN {name}_qw USING (question_id) JOIN {name}_st s ON s.conversation_id = t.conversation_id AND s.dia_id = t.dia_id
 WHERE t.rank = 1 AND (subject IS NULL OR CASE subject WHEN 'Anna' THEN anna ELSE ben END) AND planned = regexp_matches(question, '(?i)\\b(will|plan|plans|planning|want|wants|hope|hopes)\\b')),
{name}_bst AS (SELECT question_id, count(DISTINCT f) FILTER (p = 'day') AS days, count(*) FILTER (p <> 'day') AS coarse, min(f) AS day FROM (SELECT *, max(common) OVER (PARTITION BY question_id) AS most FROM {name}_rd WHERE common > 0) WHERE common = most GROUP BY ALL),
{name}_read AS (SELECT q2.question_id, CASE WHEN ok AND days = 1 AND coarse = 0 THEN day END AS answer, CASE WHEN NOT ok THEN 'unsupported_question_or_no_evidence' WHEN days IS NULL THEN 'no_supported_time' WHEN NOT (days = 1 AND coarse = 0) THEN 'non_day_or_ambiguous_time' END AS reason
 FROM (SELECT *, regexp_matches(question, '(?i)^when\\b') AND question_id IN (SELECT question_id FROM {name}_top) AS ok FROM q2) q2 LEFT JOIN {name}_bst USING (question_id))"""


def context_sql(route: str) -> str:
    """The fused context of a route: CTE fused with question_id, dia_id, rank, score."""
    s = dialogue.settings(route)
    near = f"SELECT conversation_id, dia_id, array_to_string(list(speaker || ': ' || text) OVER (PARTITION BY conversation_id, session ORDER BY pos ROWS BETWEEN {s['radius']} PRECEDING AND {s['radius']} FOLLOWING), ' ') AS text FROM turns"
    score = "CASE WHEN mismatch AND NOT (lower(ltrim(question)) LIKE 'when %' AND qf IS NULL) THEN raw * 0.5::double ELSE raw END" if s["penalty"] else "raw"
    return f"""WITH {asked_sql()}, {search_ctes('guarded')}, {conversation_scores('c', near)}, {relation_sql('crel', 'SELECT * FROM c_sc')},
cr AS (SELECT question_id, dia_id, session, pos, row_number() OVER (PARTITION BY question_id ORDER BY {score} DESC, session, pos) AS context_rank FROM c_sc JOIN tt USING (conversation_id, dia_id) JOIN q3 USING (question_id) JOIN crel USING (question_id, dia_id)),
bo AS (SELECT coalesce(b.question_id, cr.question_id) AS question_id, coalesce(b.dia_id, cr.dia_id) AS dia_id, coalesce(b.session, cr.session) AS session, coalesce(b.pos, cr.pos) AS pos, b.rank AS base_rank, context_rank FROM _top b FULL JOIN cr ON cr.question_id = b.question_id AND cr.dia_id = b.dia_id),
fs AS (SELECT *, round(coalesce({1 - s['weight']}::double / ({s['constant']} + base_rank), 0) + coalesce({s['weight']}::double / ({s['constant']} + context_rank), 0), 9) AS score FROM bo),
fused AS (SELECT question_id, dia_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN base_rank <= {min(s['kept'], 5)} THEN base_rank END NULLS LAST, score DESC, session, pos) AS integer) AS rank, score FROM fs QUALIFY rank <= 5)"""


def bridge_ctes(route: str) -> str:
    """CTE bridged: question_id, dia_id, rank, from _top."""
    from .search import TERMS

    s = dialogue.settings(route)
    terms = lambda text, key: f"SELECT {key}, list_distinct({TERMS}) AS toks FROM (SELECT {key}, {text} AS text FROM turns)"
    clause = "list_extract(regexp_split_to_array(trim(text), '[.!?][ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f][-–—][ \\t\\n\\r\\f]'), -1)"
    share = lambda toks: f"coalesce(list_sum(list_transform(list_filter(ws, lambda x: list_contains({toks}, x.term)), lambda x: x.w)), 0) / coalesce(nullif(list_sum(list_transform(ws, lambda x: x.w)), 0), 1)"
    return f"""
bt AS ({terms("speaker || ': ' || text", 'conversation_id, dia_id')}), bdf AS (SELECT conversation_id, term, count(*) AS df FROM (SELECT conversation_id, unnest(toks) AS term FROM bt) GROUP BY ALL), btot AS (SELECT conversation_id, count(*) AS total FROM turns GROUP BY ALL),
btx AS ({terms('text', 'conversation_id, dia_id')}), bcl AS ({terms(clause, 'conversation_id, dia_id')}),
bw AS (SELECT question_id, list({{'term': term, 'w': ln(1 + (total + 0.5::double) / (coalesce(df, 0) + 0.5::double))}}) AS ws FROM qt JOIN q3 USING (question_id) JOIN btot USING (conversation_id) LEFT JOIN bdf USING (conversation_id, term) WHERE NOT list_contains(list_transform(people, lambda x: lower(x)), term) GROUP BY ALL),
bf AS (SELECT question_id, CASE WHEN count(*) >= 5 AND max(score) FILTER (rank = 1) > 0 THEN min(score) / max(score) FILTER (rank = 1) ELSE 0 END AS tail FROM _top GROUP BY ALL),
nx AS (SELECT conversation_id, dia_id, lead(dia_id) OVER w AS n_dia, lead(session) OVER w AS n_session, lead(speaker) OVER w AS n_speaker, lead(text) OVER w AS n_text FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY session, pos)),
bc AS (SELECT t.question_id, t.conversation_id, nx.n_dia AS dia_id, t.rank FROM _top t JOIN bf ON bf.question_id = t.question_id JOIN q3 ON q3.question_id = t.question_id JOIN tt ON tt.conversation_id = t.conversation_id AND tt.dia_id = t.dia_id JOIN nx ON nx.conversation_id = t.conversation_id AND nx.dia_id = t.dia_id LEFT JOIN bw ON bw.question_id = t.question_id
 JOIN btx ON btx.conversation_id = t.conversation_id AND btx.dia_id = t.dia_id JOIN bcl ON bcl.conversation_id = t.conversation_id AND bcl.dia_id = t.dia_id JOIN btx nt ON nt.conversation_id = t.conversation_id AND nt.dia_id = nx.n_dia
 WHERE t.rank <= 2 AND tail <= {s['tail']} AND rtrim(tt.text) LIKE '%?' AND {share('btx.toks')} >= {s['anchor']} AND (tail <= {s['aligned']} OR {share('bcl.toks')} >= {s['clause']}) AND n_session = t.session AND n_speaker <> speaker AND (subject IS NULL OR n_speaker = subject) AND NOT rtrim(n_text) LIKE '%?' AND len(nt.toks) >= 3),
{relation_sql('brel', 'SELECT question_id, conversation_id, dia_id FROM bc')},
bo AS (SELECT question_id, dia_id, 1 AS tier, rank AS place FROM bc JOIN brel USING (question_id, dia_id) WHERE NOT mismatch UNION ALL SELECT question_id, dia_id, CASE WHEN rank <= {min(s['kept'], 5)} THEN 0 ELSE 2 END, rank FROM _top),
bridged AS (SELECT question_id, dia_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY first, dia_id) AS integer) AS rank FROM (SELECT question_id, dia_id, min((tier, place)) AS first FROM bo GROUP BY ALL) QUALIFY rank <= 5)"""


def rescue_ctes(route: str) -> str:
    """CTE rescued: question_id, dia_id, rank, from _top."""
    kept = min(dialogue.settings(route)["kept"], 5)
    return f"""
rm AS (SELECT DISTINCT question_id, dia_id FROM q2 JOIN named USING (conversation_id) WHERE subject IS NOT NULL AND qf IS NOT NULL AND p IS NOT NULL AND CASE subject WHEN 'Anna' THEN anna ELSE ben END AND planned = regexp_matches(question, '(?i)\\b(will|plan|plans|planning|want|wants|hope|hopes)\\b')
 AND qf <= f AND CASE p WHEN 'day' THEN f ELSE (f + interval 1 month)::date - 1 END <= (qf + interval 1 month)::date - 1),
ro AS (SELECT question_id, min(dia_id) AS dia_id FROM rm GROUP BY ALL HAVING count(*) = 1), rn AS (SELECT ro.* FROM ro ANTI JOIN _top USING (question_id, dia_id)),
rx AS (SELECT t.question_id, t.dia_id, 0 AS tier, t.rank AS place FROM _top t LEFT JOIN rn ON rn.question_id = t.question_id WHERE rn.dia_id IS NULL OR t.rank <= {kept} UNION ALL SELECT question_id, dia_id, 1, 1 FROM rn),
rescued AS (SELECT question_id, dia_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY tier, place, dia_id) AS integer) AS rank FROM rx QUALIFY rank <= 5)"""


ROUTE_SQL = {
    "date_reader": f"WITH {asked_sql()}, {search_ctes('guarded')}, {reader_ctes()} SELECT question_id, answer, reason FROM _read",
    "rrf_weighted_context": f"{context_sql('context_rrf')} SELECT question_id, rank, dia_id, score FROM fused",
    "context_balanced": f"{context_sql('context_balanced')} SELECT question_id, rank, dia_id FROM fused",
    "context_only": f"{context_sql('context_only')} SELECT question_id, rank, dia_id FROM fused",
    "question_response_bridge": f"WITH {asked_sql()}, {search_ctes('guarded')}, {bridge_ctes('bridge_adaptive')} SELECT question_id, rank, dia_id FROM bridged",
    "calendar_rescue": f"WITH {asked_sql()}, {search_ctes('guarded')}, {rescue_ctes('calendar_unique')} SELECT question_id, rank, dia_id FROM rescued",
    "bridge_calendar": f"WITH {asked_sql()}, {search_ctes('guarded')}, {bridge_ctes('bridge_calendar')}, {rescue_ctes('bridge_calendar')} SELECT question_id, rank, dia_id FROM rescued JOIN q2 USING (question_id) WHERE qf IS NOT NULL UNION ALL SELECT question_id, rank, dia_id FROM bridged JOIN q2 USING (question_id) WHERE qf IS NULL",
}


DAY = "cast(o_orderdate AS date)"
_CASES = {
    0: (DAY, DAY, "day", "explicit_date"), 1: (DAY, DAY, "day", "explicit_date"), 2: (f"date_trunc('month', {DAY})", f"last_day({DAY})", "month", "explicit_month"), 3: (f"date_trunc('year', {DAY})", f"make_date(year({DAY}), 12, 31)", "year", "explicit_year"),
    4: (f"{DAY} - 1", f"{DAY} - 1", "day", "relative_day"), 5: (f"{DAY} + 2", f"{DAY} + 2", "day", "compound_relative_day"), 6: (f"{DAY} - 24", f"{DAY} - 18", "approximate_week", "relative_ago"),
    7: (f"date_trunc('month', {DAY}) - interval 2 month", f"last_day(cast(date_trunc('month', {DAY}) - interval 2 month AS date))", "month", "relative_ago"), 8: (f"{DAY} - 5", f"{DAY} - 5", "day", "relative_ago"),
    9: (f"date_trunc('week', {DAY}) + interval 7 day", f"date_trunc('week', {DAY}) + interval 13 day", "calendar_week_assumption", "relative_period"), 10: (f"date_trunc('month', {DAY}) - interval 1 month", f"date_trunc('month', {DAY}) - interval 1 day", "month", "relative_period"), 11: (f"date_trunc('year', {DAY})", f"make_date(year({DAY}), 12, 31)", "year", "relative_period"),
}


def dates_sql(kind: str) -> str:
    pick = lambda i, cast="": "CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN " + (f"cast({v[i]} AS date)" if i < 2 else f"'{v[i]}'") for k, v in _CASES.items()) + " END"
    return f"SELECT o_orderkey, {pick(0)} AS first_day, {pick(1)} AS last_day, {pick(2)} AS precision, {pick(3)} AS rule FROM orders WHERE {FILTERS[kind].replace('form', 'o_orderkey % 12')}"


_SPANS = (
    ("'Tomorrow'", "relative_day", f"{DAY} + 1", f"{DAY} + 1", "', not on '"), (f"strftime({DAY}, '%-d %B %Y')", "explicit_date", DAY, DAY, "' or in '"),
    (f"strftime({DAY}, '%b %Y')", "explicit_month", f"date_trunc('month', {DAY})", f"last_day({DAY})", "' or '"), (f"strftime({DAY}, '%Y')", "explicit_year", f"make_date(year({DAY}), 1, 1)", f"make_date(year({DAY}), 12, 31)", "', '"),
    ("'the day before yesterday'", "compound_relative_day", f"{DAY} - 2", f"{DAY} - 2", "'; '"), ("'2 years ago'", "relative_ago", f"make_date(year({DAY}) - 2, 1, 1)", f"make_date(year({DAY}) - 2, 12, 31)", "', '"),
    ("'today'", "relative_day", DAY, DAY, "', '"), ("'last year'", "relative_period", f"make_date(year({DAY}) - 1, 1, 1)", f"make_date(year({DAY}) - 1, 12, 31)", "'.'"),
)


def mixed_sql() -> str:
    """A row for each span, its offset the length of what stands before it."""
    parts, before = [], "''"
    for place, (said, rule, first, last, after) in enumerate(_SPANS):
        parts.append(f"SELECT o_orderkey, {place} AS place, cast(length({before}) AS integer) AS \"offset\", {said} AS expression, '{rule}' AS rule, cast({first} AS date) AS first_day, cast({last} AS date) AS last_day FROM orders")
        before = f"{before} || {said} || {after}"
    return " UNION ALL ".join(parts)


SQL = {f"dates_{k}": dates_sql(k) for k in FILTERS} | {"dates_mixed": mixed_sql()} | {f"{p}_search": search_sql(p) for p in dialogue.PROFILES} | ROUTE_SQL | {
    "sentence_events": f"WITH {EVENTS_SQL}, who AS (SELECT conversation_id, list(DISTINCT speaker) AS people FROM turns GROUP BY ALL) SELECT conversation_id, dia_id, sentence, array_to_string(list_filter(['Anna', 'Ben'], lambda x: list_contains(people, x) AND CASE x WHEN 'Anna' THEN anna ELSE ben END), ',') AS subjects, CASE WHEN planned THEN 'planned' ELSE 'reported' END AS modality, said AS normalized_time FROM named JOIN who USING (conversation_id)",
    "context_windows": f"WITH {tables.TURNS_SQL} SELECT conversation_id, dia_id, array_to_string(list(dia_id) OVER w, ',') AS context_ids, array_to_string(list(speaker || ': ' || text) OVER w, ' ') AS context FROM turns WINDOW w AS (PARTITION BY conversation_id, session ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "inventory_statistics": f"WITH {EVENTS_SQL}, t AS (SELECT conversation_id, count(*) AS n_turns FROM turns GROUP BY ALL) SELECT conversation_id, n_turns, count(*) AS n_events, count(p) AS n_dated, count(*) FILTER (planned) AS n_planned FROM named JOIN t USING (conversation_id) GROUP BY ALL",
    "previous_turn_links": f"WITH {tables.TURNS_SQL}, l AS (SELECT conversation_id, dia_id, text, lag(dia_id) OVER (PARTITION BY conversation_id, session ORDER BY pos) AS previous_id FROM turns) SELECT conversation_id, dia_id, previous_id FROM l WHERE previous_id IS NOT NULL AND regexp_matches(text, '(?i)\\b(it|her|him|they|them|that)\\b')",
}
