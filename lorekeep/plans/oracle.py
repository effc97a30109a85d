"""The same queries in DuckDB's SQL, over the same tables.

Shared steps are common table expressions; a query names those it needs and gets the
ones they rest on as well.
"""

from __future__ import annotations

import math
import re

from lorekeep.functions.text import (
    ENTITIES,
    MARKDOWN,
    NON_WORD,
    PAGE_NOISE,
    PAGE_TAG,
    SENTENCE_END,
    SPACE,
)
from lorekeep.functions.vocabulary import english_stop_words
from lorekeep.operators.context import CALL_FAILED, GRAPH_HUMAN, GRAPH_SYSTEM, RAG_HUMAN, RAG_SYSTEM
from lorekeep.operators.graph import HEADING, NO_EDGES, RELATIONSHIP
from lorekeep.operators.stats import CHART_MEANS, CORRELATED, SHARED
from lorekeep.sources.schemas import SCHEMAS

IDF2 = repr((1.0 + math.log(1.5)) ** 2) + "::DOUBLE"
STAMP = "'%Y-%m-%dT%H:%M:%S.%f'"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), {q(NON_WORD)}, ' ', 'g'), "
        r"'\s+', ' ', 'g'))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(SPACE + '+')}), lambda w: w <> '')"


def count_words(x: str) -> str:
    return f"len({words(x)})"


def terms(x: str) -> str:
    return f"list_distinct(list_filter(string_split({clean(x)}, ' '), lambda w: w <> ''))"


def length_score(a: str, e: str) -> str:
    r = f"(length({a}) / nullif(length({e}), 0))"
    return (
        f"CASE WHEN coalesce({a}, '') = '' OR coalesce({e}, '') = '' THEN 0.0 WHEN {r} BETWEEN 0.8 AND 1.2 THEN 1.0 "
        f"WHEN {r} BETWEEN 0.5 AND 1.5 THEN 0.8 WHEN {r} BETWEEN 0.3 AND 2.0 THEN 0.6 ELSE 0.3 END::DOUBLE"
    )


def completeness(a: str, e: str) -> str:
    hit = f"len(list_intersect({terms(e)}, {terms(a)}))"
    return (
        f"CASE WHEN coalesce({a}, '') = '' OR coalesce({e}, '') = '' THEN 0.0 WHEN len({terms(e)}) = 0 THEN 1.0 "
        f"ELSE least(1.0, {hit} / len({terms(e)})) END::DOUBLE"
    )


def clarity(a: str) -> str:
    pieces = f"regexp_split_to_array({a}, {q(SENTENCE_END)})"
    mean = f"(list_sum(list_transform({pieces}, lambda s: {count_words('s')})) / len({pieces}))"
    return (
        f"CASE WHEN coalesce({a}, '') = '' THEN 0.0 ELSE ((CASE WHEN {mean} BETWEEN 15 AND 20 THEN 1.0::DOUBLE "
        f"WHEN {mean} BETWEEN 10 AND 25 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END) + "
        f"(CASE WHEN len({pieces}) > 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)) / 2 END::DOUBLE"
    )


def quality(sim: str, a: str, e: str) -> str:
    score = f"0.4::DOUBLE * {sim} + 0.2::DOUBLE * ({length_score(a, e)}) + 0.2::DOUBLE * ({completeness(a, e)}) + 0.2::DOUBLE * ({clarity(a)})"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({e}, '') = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score})) END"


def preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN {x}[1:{n}] || '...' ELSE {x} END"


def stamp(*columns: str) -> str:
    return ", ".join(f"strftime({c}, {STAMP}) AS {c.split('.')[-1]}" for c in columns)


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({ts}, '.%f') END || '+00:00'"
    )


def sid(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), chr(1))" for p in parts) + "))"


def fill(template: str, question: str, context: str) -> str:
    before, rest = template.split("{question}")
    middle, after = rest.split("{context}")
    return f"{q(before)} || {question} || {q(middle)} || coalesce({context}, '') || {q(after)}"


def page_text(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, {q(PAGE_NOISE)}, ' ', 'g'), {q(PAGE_TAG)}, ' ', 'g')"
    for entity, char in ENTITIES:
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return strip(f"regexp_replace({bare}, {q(SPACE + '+')}, ' ', 'g')")


def markdown_text(x: str) -> str:
    for mark, text in MARKDOWN:
        x = f"regexp_replace({x}, {q(mark)}, {q(text)}, 'g')"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


# Any number of capitalised words, one blank apart, not inside another word.
PHRASE = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]*(?: \p{Lu}[\p{L}\p{N}_]*)*)"
STOP = ", ".join(q(w) for w in english_stop_words())


def similarity_ctes(name: str, pairs: str, keys: str) -> dict[str, str]:
    """Similarity of the pairs (keys, a, b) of one step, as step ``name``."""
    return {
        f"{name}_tokens": f"""
            SELECT {keys}, side, unnest(string_split({clean('t')}, ' ')) AS term
            FROM (SELECT {keys}, 1 AS side, a AS t FROM {pairs} UNION ALL SELECT {keys}, 2, b FROM {pairs})""",
        f"{name}_counts": f"""
            SELECT {keys}, term, count(*) FILTER (side = 1) AS l, count(*) FILTER (side = 2) AS r FROM {name}_tokens
            WHERE length(term) >= 2 AND term NOT IN ({STOP}) GROUP BY {keys}, term""",
        f"{name}_kept": f"""
            SELECT * FROM {name}_counts
            QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY l + r DESC, term) <= 1000""",
        f"{name}_sums": f"""
            SELECT {keys}, sum(l * r) AS dot,
              sum(CASE WHEN r > 0 THEN l * l ELSE {IDF2} * l * l END) AS nl,
              sum(CASE WHEN l > 0 THEN r * r ELSE {IDF2} * r * r END) AS nr
            FROM {name}_kept GROUP BY {keys}""",
        name: f"""
            SELECT {keys}, CASE WHEN dot > 0 THEN dot / sqrt(nl * nr) ELSE 0.0 END::DOUBLE AS similarity
            FROM {pairs} LEFT JOIN {name}_sums USING ({keys})""",
    }


STEPS: dict[str, str] = {
    # Evaluation
    "talks": """
        SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS query,
          arg_min(text, turn) FILTER (role = 'assistant') AS expected_answer,
          arg_max(text, turn) FILTER (role = 'assistant') AS actual_answer
        FROM conversations GROUP BY conv_id""",
    "got": "SELECT doc_id // 10 AS conv_id, list(doc_id ORDER BY doc_id) AS docs FROM documents GROUP BY 1",
    "good": """
        SELECT conv_id, list(doc_id ORDER BY doc_id) AS docs
        FROM (SELECT doc_id, unnest([doc_id // 10, doc_id // 10 - 1]) AS conv_id FROM labels WHERE quality = 1)
        GROUP BY conv_id""",
    "cases": """
        SELECT t.conv_id AS case_id, query, expected_answer, actual_answer,
          coalesce(got.docs, []::BIGINT[]) AS retrieved, coalesce(good.docs, []::BIGINT[]) AS relevant,
          coalesce(e.value, 0.0::DOUBLE) AS response_time
        FROM talks t LEFT JOIN got USING (conv_id) LEFT JOIN good USING (conv_id)
        LEFT JOIN events e ON e.event_id = t.conv_id""",
    "ready": """
        SELECT *, len(list_intersect(retrieved, relevant)) AS hits FROM cases
        WHERE query IS NOT NULL AND expected_answer IS NOT NULL AND actual_answer IS NOT NULL AND len(retrieved) > 0""",
    "ratios": """
        SELECT *, hits / len(retrieved) AS precision,
          CASE WHEN len(relevant) = 0 THEN 0.0 ELSE hits / len(relevant) END::DOUBLE AS recall FROM ready""",
    "docrows": """
        SELECT case_id, pos, doc, list_contains(relevant, doc) AS is_relevant, query AS a, d.text AS b
        FROM (SELECT case_id, query, relevant, unnest(retrieved) AS doc, unnest(range(len(retrieved))) AS pos FROM ready)
        JOIN documents d ON d.doc_id = doc""",
    "otherdocs": "SELECT case_id, pos, a, b FROM docrows WHERE NOT is_relevant",
    **similarity_ctes("doc_sim", "otherdocs", "case_id, pos"),
    "scores": """
        SELECT case_id, pos, doc::VARCHAR AS doc, is_relevant,
          CASE WHEN is_relevant THEN 1.0::DOUBLE ELSE similarity END AS score
        FROM docrows LEFT JOIN doc_sim USING (case_id, pos)""",
    "answers": "SELECT case_id, expected_answer AS a, actual_answer AS b FROM ready",
    **similarity_ctes("answer_sim", "answers", "case_id"),
    "per_case": """
        SELECT case_id, avg(((score > 0.5) = is_relevant)::INT) AS accuracy, avg(score) AS avg_relevance_score
        FROM scores GROUP BY case_id""",
    "results": f"""
        SELECT case_id, query, expected_answer, actual_answer, response_time, precision, recall, accuracy,
          CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1_score,
          similarity AS semantic_similarity, {quality('similarity', 'actual_answer', 'expected_answer')} AS answer_quality_score,
          len(retrieved) AS num_retrieved_docs, len(retrieved) AS num_relevant_docs, len(relevant) AS num_relevant_true,
          avg_relevance_score
        FROM ratios JOIN answer_sim USING (case_id) JOIN per_case USING (case_id)""",
    "summary": """
        SELECT avg(precision) AS avg_precision, avg(recall) AS avg_recall, avg(accuracy) AS avg_accuracy,
          avg(f1_score) AS avg_f1_score, avg(semantic_similarity) AS avg_semantic_similarity,
          avg(answer_quality_score) AS avg_answer_quality, avg(response_time) AS avg_response_time,
          count(*) AS total_queries, count(*) FILTER (answer_quality_score > 0.5) AS successful_queries
        FROM results HAVING count(*) > 0""",
    # Retrieval
    "near": """
        SELECT q.vec_id AS query_id, v.vec_id AS id,
          list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance
        FROM embeddings q CROSS JOIN embeddings v""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near",
    "found": """
        SELECT query_id, rank, id, distance, text FROM ranked JOIN documents d ON d.doc_id = id WHERE rank <= 4""",
    "contexts": r"""
        SELECT query_id, string_agg(chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM found GROUP BY query_id""",
    "prompts": f"""
        SELECT e.vec_id AS query_id, {q(RAG_SYSTEM)} AS system_text, {fill(RAG_HUMAN, 'd.text', 'context')} AS human_text
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN contexts c ON c.query_id = e.vec_id""",
    # Chunks
    "chunks": """
        SELECT doc_id, n AS chunk_no, n * 1000 AS start_index, text[n * 1000 + 1 : n * 1000 + 1200] AS text, source
        FROM (SELECT *, unnest(range(greatest(1, ceil((length(text) - 200) / 1000)::BIGINT))) AS n FROM documents
              WHERE length(text) > 0)""",
    # Graph
    "doc_lines": f"""
        SELECT doc_id, lang, unnest(list_transform(string_split(text, chr(10)),
          lambda s: regexp_extract_all(s, {q(PHRASE)}, 1))) AS names,
          unnest(range(len(string_split(text, chr(10))))) AS line FROM documents""",
    "doc_names": "SELECT doc_id, lang, line, unnest(names) AS id, unnest(range(len(names))) AS place FROM doc_lines",
    "edges": f"""
        SELECT doc_id, lang, line, n, names[n] AS src, {q(RELATIONSHIP)} AS relationship, names[n + 1] AS dst
        FROM (SELECT doc_id, lang, line, names, unnest(range(1, len(names))) AS n FROM doc_lines WHERE len(names) > 1)""",
    "vertices": "SELECT DISTINCT id FROM doc_names",
    "keywords": f"""
        SELECT DISTINCT item_id AS query_id, unnest({words('lower(text)')}) AS word FROM benchmark""",
    "hits": """
        SELECT DISTINCT query_id, id
        FROM keywords JOIN (SELECT word, id FROM (SELECT DISTINCT word FROM keywords) JOIN vertices
          ON contains(lower(id), word)) USING (word)""",
    "seeds": """
        SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place FROM hits)
        WHERE place <= 5""",
    "graph_contexts": f"""
        SELECT query_id, 0::BIGINT AS page, CASE WHEN count(src) = 0 THEN {q(NO_EDGES)} ELSE {q(HEADING)} ||
          string_agg('- ' || src || ' ' || relationship || ' ' || dst, chr(10) ORDER BY src, relationship, dst)
          FILTER (src IS NOT NULL) END AS context
        FROM seeds LEFT JOIN edges ON src = id GROUP BY query_id""",
    # Telemetry
    "event_rows": """
        SELECT concat_ws('-', user_id, day(ts) // 8) AS session_id,
          concat_ws('-', user_id, day(ts) // 8, day(ts) // 4) AS conversation_id,
          concat_ws('-', user_id, day(ts) // 8, day(ts) // 4, event_id % 3) AS turn_id,
          user_id::VARCHAR AS user_id, ts, event_id::VARCHAR AS source_id, event_id, event_type AS type, value, props
        FROM events""",
    "message_rows": """
        SELECT concat_ws('-', user_id, day(ts) // 8) AS session_id,
          concat_ws('-', user_id, day(ts) // 8, day(ts) // 4) AS conversation_id,
          concat_ws('-', user_id, day(ts) // 8, day(ts) // 4, c.conv_id % 3) AS turn_id,
          user_id::VARCHAR AS user_id, ts, concat_ws('-', c.conv_id, turn) AS source_id, c.conv_id, turn, role, text
        FROM conversations c JOIN events e ON e.event_id = c.conv_id""",
    "telemetry": f"""
        SELECT {sid('type', 'session_id', 'conversation_id', 'turn_id', 'epoch_us(ts)', 'source_id')} AS event_id,
          session_id, conversation_id, turn_id, user_id,
          CASE type WHEN 'signup' THEN 'query' WHEN 'purchase' THEN 'response' WHEN 'click' THEN 'click'
            WHEN 'view' THEN 'scroll' ELSE 'abandonment' END AS interaction_type,
          CASE type WHEN 'purchase' THEN 'system_event' ELSE 'user_interaction' END AS event_type, ts,
          CASE type WHEN 'signup' THEN json_object('query', props)
            WHEN 'purchase' THEN json_object('response', props, 'response_time', value::VARCHAR)
            WHEN 'click' THEN json_object('element', props)
            WHEN 'view' THEN json_object('scroll_depth', value::VARCHAR, 'scroll_direction', 'down')
            ELSE json_object('abandonment_type', 'error') END::VARCHAR AS data,
          '{{}}' AS metadata, props, value
        FROM event_rows""",
}


def _span(keys: str) -> str:
    """First and last event of each key, and whether the last one closes it."""
    return f"""
        SELECT {keys}, user_id, min(ts) AS start, max(ts) AS finish,
          arg_max(interaction_type, (ts, event_id)) IN ('response', 'abandonment') AS closes
        FROM telemetry GROUP BY {keys}, user_id"""


STEPS |= {
    "session_span": _span("session_id"),
    "conversation_span": _span("session_id, conversation_id"),
    "turn_span": _span("session_id, conversation_id, turn_id"),
    "sessions": """
        SELECT s.session_id, s.user_id, s.start AS start_time, CASE WHEN closes THEN finish END AS end_time,
          round(CASE WHEN closes THEN (epoch_us(finish) - epoch_us(start)) / 1e6 END, 6) AS duration_seconds,
          a.n AS interaction_count, coalesce(a.active, s.start) AS last_activity, NOT closes AS is_active
        FROM session_span s JOIN (SELECT session_id, count(*) FILTER (interaction_type IN ('query', 'click', 'scroll')) AS n,
          max(ts) FILTER (interaction_type IN ('query', 'click', 'scroll')) AS active FROM telemetry GROUP BY session_id) a
          USING (session_id)""",
    "conversations_rolled": """
        SELECT s.conversation_id, s.session_id, s.start AS start_time, CASE WHEN closes THEN finish END AS end_time,
          round(CASE WHEN closes THEN (epoch_us(finish) - epoch_us(start)) / 1e6 END, 6) AS duration_seconds,
          t.n AS turn_count, greatest(coalesce(a.active, t.begun), t.begun) AS last_activity, NOT closes AS is_active
        FROM conversation_span s
        JOIN (SELECT conversation_id, count(*) AS n, max(start) AS begun FROM turn_span GROUP BY conversation_id) t
          USING (conversation_id)
        JOIN (SELECT conversation_id, max(ts) FILTER (interaction_type IN ('query', 'click', 'scroll')) AS active
          FROM telemetry GROUP BY conversation_id) a USING (conversation_id)""",
    "turns_rolled": """
        SELECT s.turn_id, s.conversation_id, s.session_id, s.start AS start_time,
          CASE WHEN closes THEN finish END AS end_time,
          round(CASE WHEN closes THEN (epoch_us(finish) - epoch_us(start)) / 1e6 END, 6) AS duration_seconds,
          a.query, a.response, a.response_time_seconds, length(a.query) AS query_length,
          length(a.response) AS response_length, closes AS is_complete,
          coalesce(a.active, s.start) AS last_activity
        FROM turn_span s JOIN (SELECT turn_id,
          arg_min(props, (ts, props)) FILTER (interaction_type = 'query') AS query,
          arg_min(props, (ts, props)) FILTER (interaction_type = 'response') AS response,
          arg_min(value, (ts, value::VARCHAR)) FILTER (interaction_type = 'response') AS response_time_seconds,
          max(ts) FILTER (interaction_type IN ('query', 'click', 'scroll')) AS active
          FROM telemetry GROUP BY turn_id) a USING (turn_id)""",
}


def _late(key: str, rolled: str, span: str, carry: str, active: str | None) -> str:
    """Roll-ups where an open key without an event for three days has timed out."""
    end = "CASE WHEN late THEN last_activity ELSE end_time END"
    rest = f", strftime(last_activity, {STAMP}) AS last_activity, {active} AND NOT late AS {active}" if active else ""
    return sql(
        f"""SELECT r.{key}, {carry}, strftime(start_time, {STAMP}) AS start_time, strftime({end}, {STAMP}) AS end_time,
        round((epoch_us({end}) - epoch_us(start_time)) / 1e6, 6) AS duration_seconds{rest}, late AS timed_out
        FROM {rolled} r JOIN (SELECT {key}, NOT closes AND finish + INTERVAL 3 DAY < (SELECT max(ts) FROM telemetry) AS late
          FROM {span}) USING ({key})"""
    )


def sql(select: str) -> str:
    """``select`` with the steps it rests on put before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(STEPS[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    once = {"ready"}  # read by several steps
    steps = ", ".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({STEPS[n].strip()})" for n in needed)
    return (f"WITH {steps} " if needed else "") + select.strip()


def event_sql(kind: str, rows: str, where: str, itype: str, data: str, etype: str = "user_interaction", meta: str = "'{}'") -> str:
    return sql(
        f"""SELECT {sid(q(kind), 'session_id', 'conversation_id', 'turn_id', 'epoch_us(ts)', 'source_id')} AS event_id,
        session_id, conversation_id, turn_id, user_id, {q(itype)} AS interaction_type, {q(etype)} AS event_type,
        {iso('ts')} AS timestamp, {data}::VARCHAR AS data, {meta}::VARCHAR AS metadata FROM {rows} WHERE {where}"""
    )


SIX = "round({0}, 6) AS {0}"


def six(*columns: str) -> str:
    return ", ".join(SIX.format(c) for c in columns)


_SCORES = ("precision", "recall", "accuracy", "f1_score", "semantic_similarity", "answer_quality_score")
_RESULT = f"""case_id, query, expected_answer, actual_answer, response_time, {six(*_SCORES)},
    num_retrieved_docs, num_relevant_docs, num_relevant_true, {six('avg_relevance_score')}"""
_TYPES = """CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"""
_GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _corr(a: str, b: str) -> str:
    return (
        f"SELECT {q(a)} AS a, {q(b)} AS b, round(CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 "
        f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 6) AS correlation FROM results"
    )


_FILLED = {
    "user_interactions": "(SELECT count(*) FROM telemetry) + (SELECT count(*) + count(*) FILTER (closes) FROM turn_span)",
    "sessions": "(SELECT count(*) FROM session_span)",
    "conversations": "(SELECT count(*) FROM conversation_span)",
    "turns": "(SELECT count(*) FROM turn_span)",
    "evaluation_results": "(SELECT count(*) FROM ready)",
    "performance_metrics": "(SELECT count(*) FROM events WHERE event_type = 'purchase')",
}
_TABLE_COLUMNS = ", ".join(f"({q(t)}, {q(f.name)})" for t, s in SCHEMAS.items() for f in s.fields)

_PLAN = """
    SELECT coalesce(s.doc_id, i.id) AS id, md5(s.text) AS text_hash,
      CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN i.id IS NULL THEN 'insert'
        WHEN i.h <> md5(s.text) THEN 'update' ELSE 'keep' END AS action
    FROM documents s FULL OUTER JOIN (
      SELECT d.doc_id AS id, md5(CASE WHEN l.toxic = 1 THEN d.text || '!' ELSE d.text END) AS h
      FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
      UNION ALL SELECT -1 - item_id, md5(text) FROM benchmark) i ON i.id = s.doc_id"""

_FLAGS = """contains(lower({0}), '[source:') AS has_sources, length({0}) > 100 AS is_comprehensive,
    length({0}) < 1000 AS is_concise"""
_TOPICS = "len(list_filter(['th', 'TION', source, lang], lambda t: contains(lower(text), lower(t))))"
_SYNCED = "SELECT doc_id AS id, md5(text) AS text_hash, 64::BIGINT AS dimensions FROM documents"
_HASHED = """
    SELECT doc_id AS id, md5(text) AS text_hash, list_transform(n, lambda x: x / greatest(sqrt(list_sum(list_transform(n, lambda y: y * y))), 1)) AS v
    FROM (SELECT doc_id, text, list_transform(range(64), lambda i: len(list_filter(slots, lambda s: s = i))::DOUBLE) AS n
      FROM (SELECT doc_id, text, list_transform(
          list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) > 1),
          lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 64) AS slots FROM documents))"""
_UNITS = "array_to_string(list_transform({}, lambda x: round(x::FLOAT::DOUBLE * 10000)::BIGINT), ',')"
_TEL_COLUMNS = "event_id, session_id, conversation_id, turn_id, user_id, interaction_type, event_type"

ORACLE: dict[str, str] = {
    # Sources and sinks
    "corpus_scan": "SELECT lang, text FROM documents",
    "page_text": f"SELECT page_id, url, {page_text('html')} AS text FROM pages",
    "markdown_text": f"""SELECT doc_id, {markdown_text('t')} AS text FROM (
        SELECT doc_id, CASE WHEN lang = 'en' THEN replace(m, '## ', '* ') ELSE m END AS t FROM (
          SELECT doc_id, lang, regexp_replace(regexp_replace(text, '\\n', chr(10) || '## ', 'g'), '(\\w+),',
            '**\\1**, [\\1](x/y) ', 'g') AS m FROM documents))""",
    "chunk_table": sql("SELECT doc_id || '-' || chunk_no AS id, text, coalesce(source, 'unknown') AS source FROM chunks"),
    "graph_vertices": sql("SELECT id FROM vertices"),
    "graph_edges": sql("SELECT src, relationship, dst FROM edges"),
    "vector_table": """SELECT vec_id AS id, unnest(range(len(embedding))) AS position,
        unnest(list_transform(embedding, lambda x: round(x::DOUBLE, 6))) AS value FROM embeddings""",
    "index_refresh": _PLAN,
    "index_synced": _SYNCED,
    "index_stream": _SYNCED,
    "embed_hashed": f"SELECT id, {_UNITS.format('v')} AS vector FROM ({_HASHED})",
    # Vectors of texts that were not labelled toxic stay, all others are made anew.
    "index_written": f"""SELECT h.id, h.text_hash, {_UNITS.format(
        "CASE WHEN e.vec_id IS NOT NULL AND coalesce(l.toxic, 0) <> 1 THEN e.embedding::DOUBLE[] ELSE h.v END"
    )} AS vector FROM ({_HASHED}) h LEFT JOIN embeddings e ON e.vec_id = h.id LEFT JOIN labels l ON l.doc_id = h.id""",
    "telemetry_schema": sql(
        f"""SELECT c.table_name, c.column_name, n.row_count::BIGINT AS row_count FROM (VALUES {_TABLE_COLUMNS}) c(table_name, column_name)
        JOIN ({' UNION ALL '.join(f'SELECT {q(t)} AS table_name, {n} AS row_count' for t, n in _FILLED.items())}) n
        USING (table_name)"""
    ),
    "append_interactions": sql(
        f"SELECT {_TEL_COLUMNS}, strftime(ts, {STAMP}) AS timestamp, data, metadata, strftime(ts, {STAMP}) AS created_at FROM telemetry"
    ),
    "append_evaluations": sql(
        f"""SELECT 'default' AS evaluation_id, case_id::VARCHAR AS session_id, 'default' AS conversation_id,
        'default' AS turn_id, query, expected_answer, actual_answer, {six(*_SCORES)}, response_time AS response_time_seconds,
        num_retrieved_docs, num_relevant_docs, {six('avg_relevance_score')} FROM results"""
    ),
    "append_perf_metrics": sql(
        f"""SELECT 'default' AS metric_id, session_id, 'default' AS conversation_id, turn_id, 'response_time' AS metric_name,
        value AS metric_value, props->>'$.k' AS metric_unit, NULL::VARCHAR AS metric_category, '{{}}' AS metadata,
        strftime(ts, {STAMP}) AS timestamp FROM event_rows WHERE type = 'purchase'"""
    ),
    "table_profile": f"""
        SELECT c.table_name, c.column_name, {_TYPES} AS type, n.row_count
        FROM information_schema.columns c JOIN ({' UNION ALL '.join(f"SELECT {q(t)} AS table_name, count(*) AS row_count FROM {t}" for t in _GIVEN)}) n
        USING (table_name)""",
    "retention": sql(
        f"""SELECT 'user_interactions' AS table_name, event_id AS id, strftime(ts, {STAMP}) AS created_at FROM telemetry
        WHERE ts >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAYS
        UNION ALL SELECT 'sessions', session_id, strftime(start_time, {STAMP}) FROM sessions
        WHERE start_time >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAYS"""
    ),
    # Chunking
    "chunk_recursive_plain": """
        SELECT doc_id, n AS chunk_no, n * 1000 AS start_index, t[n * 1000 + 1 : n * 1000 + 1200] AS text, source
        FROM (SELECT *, unnest(range(greatest(1, ceil((length(t) - 200) / 1000)::BIGINT))) AS n
          FROM (SELECT *, translate(text, ' ' || chr(10) || chr(9), '') AS t FROM documents) WHERE length(t) > 0)""",
    "chunk_fixed": sql("SELECT doc_id, chunk_no, start_index, text, source FROM chunks"),
    "chunk_ids": sql("SELECT row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS id, doc_id, chunk_no FROM chunks"),
    # Text functions
    "clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "text_stats": f"SELECT doc_id, {count_words('text')} AS word_count, length(text) AS length FROM documents",
    "doc_preview": f"SELECT doc_id, source, {preview('text', 100)} AS preview, length(text) AS length FROM documents",
    "doc_head": f"""SELECT doc_id, source, {preview('text', 100)} AS preview, length(text) AS length,
        greatest((SELECT count(*) FROM documents) - 5, 0) AS more FROM documents ORDER BY doc_id LIMIT 5""",
    "response_flags": f"SELECT doc_id, {_FLAGS.format('text')} FROM documents",
    "topic_coverage": f"SELECT doc_id, {_TOPICS} AS topics_found, round({_TOPICS} / 4, 6) AS topic_coverage FROM documents",
    "performance_rows": f"""
        SELECT doc_id, source AS category, CASE WHEN ok THEN round(n_chars / 1000, 6) END AS response_time,
          CASE WHEN ok THEN length(text) ELSE 0 END AS response_length,
          CASE WHEN ok THEN round({_TOPICS} / 4, 6) ELSE 0.0 END::DOUBLE AS topic_coverage,
          CASE WHEN ok THEN {_TOPICS} ELSE 0 END AS topics_found, 4::BIGINT AS total_topics,
          ok AND contains(lower(text), '[source:') AS has_sources, ok AND length(text) > 100 AS is_comprehensive,
          ok AND length(text) < 1000 AS is_concise, CASE WHEN ok THEN text ELSE 'Error: blocked' END AS response
        FROM (SELECT d.*, coalesce(l.toxic, 0) = 0 AS ok FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "valid_questions": f"""SELECT conv_id || '-' || turn AS query_id, {strip('text')} AS query FROM conversations
        WHERE role <> 'system' AND {strip('text')} <> ''""",
    # Evaluation
    "cases_normalised": sql(
        """SELECT case_id, query, expected_answer, actual_answer, array_to_string(retrieved, '|') AS retrieved_docs,
        array_to_string(relevant, '|') AS relevant_docs, response_time FROM ready"""
    ),
    "cases_rejected": sql(
        """SELECT case_id, CASE WHEN query IS NULL OR expected_answer IS NULL OR actual_answer IS NULL THEN 'missing field'
        ELSE 'nothing retrieved' END AS reason FROM cases
        WHERE query IS NULL OR expected_answer IS NULL OR actual_answer IS NULL OR len(retrieved) = 0"""
    ),
    "precision": sql(f"SELECT case_id, {six('precision')} FROM ratios"),
    "recall": sql(f"SELECT case_id, {six('recall')} FROM ratios"),
    "f1_score": sql(
        """SELECT case_id, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6)
        ELSE 0.0 END::DOUBLE AS f1_score FROM ratios"""
    ),
    "tfidf_similarity": sql(f"SELECT case_id, {six('similarity')} FROM answer_sim"),
    "length_score": sql(f"SELECT case_id, {length_score('actual_answer', 'expected_answer')} AS length_score FROM ready"),
    "completeness": sql(
        f"SELECT case_id, round({completeness('actual_answer', 'expected_answer')}, 6) AS completeness FROM ready"
    ),
    "clarity": f"SELECT doc_id, round({clarity('text')}, 6) AS clarity FROM documents",
    "answer_quality": sql(f"SELECT case_id, {six('answer_quality_score')} FROM results"),
    "relevance_scores": sql(f"SELECT case_id, pos, doc, is_relevant, {six('score')} FROM scores"),
    "relevance_labels": sql("SELECT case_id, pos, doc, score > 0.5 AS predicted, is_relevant AS truth FROM scores"),
    "accuracy": sql(f"SELECT case_id, {six('accuracy')} FROM per_case"),
    "avg_relevance": sql(
        "SELECT case_id, round(avg(score), 6) AS avg_relevance_score, count(*) AS num_retrieved_docs FROM scores GROUP BY case_id"
    ),
    "eval_rows": sql(f"SELECT {_RESULT} FROM results"),
    "eval_summary": sql(
        f"""SELECT {six('avg_precision', 'avg_recall', 'avg_accuracy', 'avg_f1_score', 'avg_semantic_similarity',
        'avg_answer_quality', 'avg_response_time')}, total_queries, successful_queries FROM summary"""
    ),
    "metrics_rounded": sql(f"SELECT case_id, query, {', '.join(f'round_even({c}, 3) AS {c}' for c in CORRELATED)} FROM results"),
    "metric_means": sql(" UNION ALL ".join(f"SELECT {q(c)} AS metric, round(avg({c}), 6) AS mean FROM results" for c in CHART_MEANS)),
    "response_time_hist": sql(
        """SELECT b.bin, round(lo + (b.bin - 1) * (hi - lo) / 10, 6) AS lower, round(lo + b.bin * (hi - lo) / 10, 6) AS upper,
          count(r.response_time) AS n
        FROM (SELECT unnest(range(1, 11)) AS bin) b
        CROSS JOIN (SELECT min(response_time) AS lo, max(response_time) AS hi FROM ready) e
        LEFT JOIN ready r ON b.bin = least(10, 1 + floor((r.response_time - lo) / ((hi - lo) / 10))::BIGINT)
        GROUP BY b.bin, lo, hi"""
    ),
    "metric_corr": sql(" UNION ALL ".join(_corr(a, b) for a in CORRELATED for b in CORRELATED)),
    "metric_share": sql(
        " UNION ALL ".join(
            f"SELECT {q(c)} AS metric, {q(c.replace('avg_', '').title())} AS label, "
            f"round({c} / ({' + '.join(SHARED)}), 6) AS share FROM summary WHERE {' + '.join(SHARED)} > 0"
            for c in SHARED
        )
    ),
    "eval_summary_stored": sql(
        f"""SELECT {six('avg_precision', 'avg_recall', 'avg_accuracy', 'avg_f1_score', 'avg_semantic_similarity',
        'avg_answer_quality', 'avg_response_time')}, total_queries, successful_queries FROM summary"""
    ),
    "eval_reports_stored": sql(
        " UNION ALL ".join(
            [f"SELECT 'mean' AS report, {q(c)} AS metric, NULL::VARCHAR AS other, round(avg({c}), 6) AS value FROM results" for c in CHART_MEANS]
            + [f"SELECT 'correlation', a, b, correlation FROM ({_corr(a, b)})" for a in CORRELATED for b in CORRELATED]
            + [
                f"SELECT 'share', {q(c)}, {q(c.replace('avg_', '').title())}, round({c} / ({' + '.join(SHARED)}), 6) "
                f"FROM summary WHERE {' + '.join(SHARED)} > 0"
                for c in SHARED
            ]
        )
    ),
    # Retrieval and prompts
    "knn_cells_all": sql(f"SELECT query_id, rank, id, {six('distance')} FROM ranked WHERE rank <= 4"),
    "knn_l2": sql(f"SELECT query_id, rank, id, {six('distance')} FROM ranked WHERE rank <= 4"),
    "knn_preview": sql(f"SELECT query_id, rank, id, {six('distance')}, {preview('text', 150)} AS preview FROM found WHERE rank <= 3"),
    "retrieve_chunks": sql(f"SELECT query_id, rank, id, {six('distance')}, text FROM found"),
    "format_context": sql("SELECT query_id, context FROM contexts"),
    "rag_prompt": sql("SELECT query_id, system_text, human_text FROM prompts"),
    "llm_requests": sql(
        """SELECT query_id, json_object('messages', json_array(json_object('role', 'system', 'content', system_text),
        json_object('role', 'user', 'content', human_text)), 'temperature', 0.2, 'max_tokens', 1000)::VARCHAR AS payload
        FROM prompts"""
    ),
    "llm_responses": f"""SELECT conv_id || '-' || turn AS query_id,
        CASE WHEN role = 'assistant' THEN text ELSE {q(CALL_FAILED)} END AS response FROM conversations""",
    # Graph
    "extract_triples": sql("SELECT doc_id, src, relationship, dst FROM edges"),
    "extraction_parse": sql(
        """SELECT d.doc_id, coalesce(e.entities, '') AS entities, coalesce(r.relationships, '') AS relationships
        FROM documents d
        LEFT JOIN (SELECT doc_id, string_agg(id, '|' ORDER BY line, place) AS entities
          FROM doc_names WHERE lang <> 'de' GROUP BY doc_id) e USING (doc_id)
        LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN lang = 'fr' THEN src || '>' || relationship
            ELSE src || '>' || relationship || '>' || dst END, '|' ORDER BY line, n) AS relationships
          FROM edges WHERE lang <> 'de' GROUP BY doc_id) r USING (doc_id)"""
    ),
    "triples_valid": sql("SELECT doc_id, src, relationship, dst FROM edges WHERE lang NOT IN ('de', 'fr')"),
    "vertex_keyword": sql("SELECT query_id, id, place FROM seeds"),
    "vertex_keyword_stored": sql("SELECT query_id, id, place FROM seeds"),
    "vertex_runs": sql(
        """SELECT gram, count(*) AS n, count(*) AS total FROM (
          SELECT DISTINCT id, substr(low, place, width) AS gram, width FROM (
            SELECT id, low, place, unnest([1, 2, 3]) AS width FROM (
              SELECT id, lower(id) AS low, unnest(range(1, length(lower(id)) + 1)) AS place FROM vertices)))
        WHERE length(gram) = width GROUP BY gram"""
    ),
    "seed_edges": sql("SELECT src, relationship, dst, count(*) AS n FROM edges WHERE src IN (SELECT id FROM seeds) GROUP BY ALL"),
    "motif_one_hop": sql(
        """SELECT src, relationship, dst, count(*) AS n FROM edges
        WHERE src IN (SELECT id FROM doc_names JOIN labels USING (doc_id))
          AND dst IN (SELECT id FROM doc_names JOIN labels USING (doc_id)) GROUP BY ALL"""
    ),
    "graph_context": sql("SELECT query_id, page, context FROM graph_contexts"),
    "graph_context_stored": sql("SELECT query_id, page, context FROM graph_contexts"),
    "graph_context_paged": sql("SELECT query_id, context FROM graph_contexts"),
    "graph_prompt": sql(
        f"""SELECT item_id AS query_id, {q(GRAPH_SYSTEM)} AS system_text, {fill(GRAPH_HUMAN, 'text', 'context')} AS human_text
        FROM benchmark LEFT JOIN graph_contexts ON query_id = item_id"""
    ),
    "corpus_counts": sql(
        """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks
        UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'vertices', count(*) FROM vertices
        UNION ALL SELECT 'edges', count(*) FROM edges"""
    ),
    # Events
    "event_query": event_sql(
        "query", "message_rows", "role = 'user'", "query",
        f"json_object('query', text, 'query_length', length(text)::VARCHAR, 'word_count', {count_words('text')}::VARCHAR)"),
    "event_response": event_sql(
        "response", "message_rows", "role = 'assistant'", "response",
        f"""json_object('response', text, 'response_time', (length(text) / 100)::VARCHAR,
        'response_length', length(text)::VARCHAR, 'word_count', {count_words('text')}::VARCHAR)""", "system_event"),
    "event_copy": event_sql(
        "copy", "message_rows", "role = 'assistant'", "copy",
        "json_object('copied_text', text, 'source_element', 'response_text', 'copied_length', length(text)::VARCHAR)"),
    "event_click": event_sql(
        "click", "event_rows", "type = 'click'", "click",
        """json_object('element', props, 'position', json_object('x', floor(value)::BIGINT, 'y', event_id % 600)::VARCHAR,
        'click_type', 'left_click')"""),
    "event_hover": event_sql(
        "hover", "event_rows", "type = 'view'", "hover", "json_object('element', props, 'duration', value::VARCHAR)"),
    "event_scroll": event_sql(
        "scroll", "event_rows", "type = 'view'", "scroll",
        "json_object('scroll_depth', value::VARCHAR, 'scroll_direction', 'down')"),
    "event_dwell": event_sql(
        "dwell", "event_rows", "type = 'view'", "hover", "json_object('element', props, 'dwell_time', value::VARCHAR)"),
    "event_abandonment": event_sql(
        "abandonment", "event_rows", "type = 'error'", "abandonment", "json_object('abandonment_type', 'error')"),
    "event_follow_up": event_sql(
        "follow_up", "event_rows", "type = 'signup'", "follow_up", "json_object('follow_up_type', props)"),
    "event_perf": event_sql(
        "performance", "event_rows", "type = 'purchase'", "response",
        "json_object('metric_name', 'response_time', 'metric_value', value::VARCHAR)", "performance_metric",
        "json_object('unit', props->>'$.k')"),
    "event_flatten": sql(f"SELECT {_TEL_COLUMNS}, {iso('ts')} AS timestamp FROM telemetry"),
    "payload_json": sql("SELECT event_id, data, metadata FROM telemetry"),
    "event_ids": sql("SELECT event_id, turn_id, interaction_type FROM telemetry"),
    "answer_events": sql(
        f"""SELECT {sid('kind', 'session_id', 'conversation_id', 'turn_id', 'epoch_us(ts)')} AS event_id, session_id,
          conversation_id, turn_id, user_id, CASE kind WHEN 'performance' THEN 'response' ELSE kind END AS interaction_type,
          CASE kind WHEN 'query' THEN 'user_interaction' WHEN 'response' THEN 'system_event' ELSE 'performance_metric' END AS event_type,
          {iso('ts')} AS timestamp,
          CASE kind WHEN 'query' THEN json_object('query', query, 'query_length', length(query)::VARCHAR, 'word_count', {count_words('query')}::VARCHAR)
            WHEN 'response' THEN json_object('response', response, 'response_time', seconds::VARCHAR, 'response_length', length(response)::VARCHAR,
              'word_count', {count_words('response')}::VARCHAR)
            ELSE json_object('metric_name', 'response_time', 'metric_value', seconds::VARCHAR) END::VARCHAR AS data, '{{}}' AS metadata
        FROM (SELECT u.session_id, u.conversation_id, u.conversation_id || '-' || u.conv_id || '-' || u.turn AS turn_id, u.user_id, u.ts,
            u.text AS query, a.text AS response, length(a.text) / 100 AS seconds, unnest(['query', 'response', 'performance']) AS kind
          FROM message_rows u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""
    ),
    "session_rollup": sql(
        f"""SELECT session_id, user_id, {stamp('start_time', 'end_time')}, duration_seconds, interaction_count,
        {stamp('last_activity')}, is_active FROM sessions"""
    ),
    "conversation_rollup": sql(
        f"""SELECT conversation_id, session_id, {stamp('start_time', 'end_time')}, duration_seconds, turn_count,
        {stamp('last_activity')}, is_active FROM conversations_rolled"""
    ),
    "turn_rollup": sql(
        f"""SELECT turn_id, conversation_id, session_id, {stamp('start_time', 'end_time')}, duration_seconds, query, response,
        response_time_seconds, query_length, response_length, is_complete FROM turns_rolled"""
    ),
    "turn_pairs": """SELECT u.conv_id, u.turn, u.text AS query, u.next AS response
        FROM (SELECT *, lead(text) OVER w AS next, lead(role) OVER w AS next_role FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) u WHERE role = 'user' AND next_role = 'assistant'""",
    # Streams
    "stream_sessions_late": _late("session_id", "sessions", "session_span", "user_id, interaction_count", "is_active"),
    "stream_conversations_late": _late("conversation_id", "conversations_rolled", "conversation_span", "r.session_id, turn_count", "is_active"),
    "stream_turns_late": _late(
        "turn_id", "turns_rolled", "turn_span",
        "r.conversation_id, r.session_id, query, response, response_time_seconds, query_length, response_length, is_complete", None,
    ),
    "stream_sink_days": sql(
        f"SELECT {_TEL_COLUMNS}, strftime(ts, {STAMP}) AS timestamp, data, metadata, strftime(ts, {STAMP}) AS created_at FROM telemetry"
    ),
    "stream_sink": sql(
        f"SELECT {_TEL_COLUMNS}, strftime(ts, {STAMP}) AS timestamp, data, metadata, strftime(ts, {STAMP}) AS created_at FROM telemetry"
    ),
    "stream_sessions": sql(
        f"""SELECT session_id, user_id, interaction_count, {stamp('start_time', 'end_time')}, duration_seconds,
        {stamp('last_activity')}, is_active FROM sessions WHERE NOT is_active"""
    ),
    "stream_conversations": sql(
        f"""SELECT conversation_id, session_id, turn_count, {stamp('start_time', 'end_time')}, duration_seconds,
        {stamp('last_activity')}, is_active FROM conversations_rolled WHERE NOT is_active"""
    ),
    "stream_turns": sql(
        f"""SELECT turn_id, conversation_id, query, response, response_time_seconds, query_length, response_length, is_complete,
        {stamp('start_time', 'end_time')}, duration_seconds, {stamp('last_activity')} FROM turns_rolled WHERE is_complete"""
    ),
}
