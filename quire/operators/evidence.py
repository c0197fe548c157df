"""From evidence to checked answers: past turns, budgets, citations, chronologies, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import blank, query


def compact_turns(turns: DataFrame, keep: int = 6) -> DataFrame:
    """The last turns of each conversation: prompt up to 200 characters, and the answer, else eight summaries one below the other, else three quotes, up to 600.

    `turns`: conv_id, turn, prompt, answer, entries array<string>, quotes array<string>. A turn with
    a list of entries, be it empty, never falls back on quotes.
    """
    summaries, quoted = ("transform(slice({}, 1, {}), x -> coalesce(x, ''))".format(*x) for x in (("entries", 8), ("quotes", 3)))
    said = f"CASE WHEN NOT {blank('answer')} THEN answer WHEN entries IS NOT NULL THEN array_join({summaries}, '\\n') WHEN quotes IS NOT NULL THEN array_join({quoted}, '；') ELSE coalesce(answer, '') END"
    return query(
        f"""SELECT conv_id, turn, left(coalesce(prompt, ''), 200) AS prompt, left({said}, 600) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {{t}}) WHERE n <= {keep}""",
        t=turns,
    )


def fit_budget(items: DataFrame, fixed: DataFrame, context: int = 16384, output: int = 1024, margin: int = 256) -> DataFrame:
    """Evidence (request_id, rank, item) and sizes of past turns against a budget of bytes.

    The oldest turns go first; then the longest prefix of the evidence that fits, shorter than
    all. Sizes add up, an item's JSON and a comma each. `fixed`: request_id, fixed_bytes, past_sizes
    array<int> (bytes, oldest first).
    """
    budget = context - output - margin
    return query(
        f"""SELECT request_id, turns_kept, items, CASE WHEN fixed_bytes > {budget} THEN 'too long' WHEN items = 0 AND n > 0 THEN 'no item fits' WHEN items < n THEN 'cut' ELSE 'fits' END AS outcome FROM (
              SELECT f.request_id, max(f.fixed_bytes) AS fixed_bytes, count(i.rank) AS n,
                     max(CASE WHEN f.fixed_bytes + coalesce(i.total, 0) > {budget} THEN 0 ELSE size(filter(sequence(1, size(past_sizes)), k -> aggregate(slice(past_sizes, -k, k), 0, (a, x) -> a + x) + f.fixed_bytes + coalesce(i.total, 0) <= {budget})) END) AS turns_kept,
                     count_if(f.fixed_bytes <= {budget} AND i.upto + f.fixed_bytes <= {budget}) AS items
              FROM {{f}} f LEFT JOIN (SELECT request_id, rank, sum(octet_length(item) + 1) OVER (PARTITION BY request_id ORDER BY rank) AS upto, sum(octet_length(item) + 1) OVER (PARTITION BY request_id) AS total FROM {{i}}) i ON f.request_id = i.request_id
              GROUP BY f.request_id)""",
        f=fixed,
        i=items,
    )


def validate_citations(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each quote (answer_id, position, chunk_id, quote) against its chunk of the answer's evidence (answer_id, chunk_id, text, start, source_layer).

    A valid one gets the range of its first occurrence; a rejected one stays, with a warning.
    """
    at = "instr(e.text, q.quote)"
    good = f"(e.chunk_id IS NOT NULL AND NOT {blank('q.quote')} AND {at} > 0)"
    return query(
        f"""SELECT q.answer_id, q.position, q.chunk_id, q.quote, coalesce({good}, false) AS valid, if({good}, e.start + {at} - 1, NULL) AS start, if({good}, e.start + {at} - 1 + length(q.quote), NULL) AS end,
                   e.source_layer = 'notes' AS from_notes, CASE WHEN e.chunk_id IS NULL THEN 'not in the evidence' WHEN NOT {good} THEN 'not in the text' END AS warning
            FROM {{q}} q LEFT JOIN {{e}} e ON q.answer_id = e.answer_id AND q.chunk_id = e.chunk_id""",
        q=quotes,
        e=evidence,
    )


#: Fixed value: the answer when no claim has a valid source.
NO_CLAIM = "当前材料不足以确认。"


def number_claims(claims: DataFrame, cited: DataFrame, fallback: str = NO_CLAIM) -> DataFrame:
    """Answers (answer_id) from claims (answer_id, position, claim) and their valid sources (answer_id, position, ordinal, source_id).

    Sources are numbered by first use in the answer. A claim is stripped, and after a blank come
    the marks of its citations in their order, repeated ones too; claims without a valid source go.
    """
    return query(
        rf"""SELECT a.answer_id, coalesce(t.text, '{fallback}') AS text FROM (SELECT DISTINCT answer_id FROM {{c}}) a LEFT JOIN (
              SELECT answer_id, array_join(transform(sort_array(collect_list(struct(position, line))), x -> x.line), '\n\n') AS text FROM (
                SELECT c.answer_id, c.position, concat(regexp_replace(max(c.claim), r'(?U)^\s+|\s+$', ''), ' ', array_join(transform(sort_array(collect_list(struct(s.ordinal, n.number))), x -> concat('[', x.number, ']')), '')) AS line
                FROM {{c}} c JOIN {{s}} s ON c.answer_id = s.answer_id AND c.position = s.position
                JOIN (SELECT answer_id, source_id, row_number() OVER (PARTITION BY answer_id ORDER BY min(struct(position, ordinal)), source_id) AS number FROM {{s}} GROUP BY answer_id, source_id) n ON s.answer_id = n.answer_id AND s.source_id = n.source_id
                GROUP BY c.answer_id, c.position) GROUP BY answer_id) t ON a.answer_id = t.answer_id""",
        c=claims,
        s=cited,
    )


def validate_chronicle(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Entries (answer_id, position, original_date) that a citation outside the notes bears out, with their original date verbatim in one cited text."""
    return query(
        """SELECT e.answer_id, e.position, count_if(NOT c.from_notes) AS citations, coalesce(bool_or(NOT c.from_notes), false) AND coalesce(bool_or(NOT c.from_notes AND contains(c.text, e.original_date)), false) AS valid
           FROM {e} e LEFT JOIN {c} c ON e.answer_id = c.answer_id AND e.position = c.position GROUP BY e.answer_id, e.position""",
        e=entries,
        c=cited,
    )


def order_chronicle(entries: DataFrame) -> DataFrame:
    """Positions by date (answer_id, position, year, month, day, null year: undated), undated last, stable; same_day when a full date repeats the one before."""
    exact = "(year IS NOT NULL AND month > 0 AND day > 0)"
    order = "PARTITION BY answer_id ORDER BY year IS NULL, year, month, day, position"
    return query(
        f"""SELECT answer_id, position, row_number() OVER ({order}) AS place, coalesce({exact} AND struct(year, month, day) = lag(if({exact}, struct(year, month, day), NULL)) OVER ({order}), false) AS same_day FROM {{e}}""",
        e=entries,
    )


def merge_chronicles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both (gregorian, original, position, summary, sources array<string>), those of one date and wording united.

    The first summary stays, of old entries before new ones and each by position; other summaries are kept as
    conflicts. Sources follow each other in the same order, each once.
    """
    return query(
        """SELECT gregorian, original, min_by(summary, struct(age, position, summary)) AS summary, array_distinct(flatten(transform(sort_array(collect_list(struct(age, position, summary, sources))), x -> x.sources))) AS sources,
                  array_except(array_sort(collect_set(summary)), array(min_by(summary, struct(age, position, summary)))) AS conflicts
           FROM (SELECT gregorian, original, position, summary, sources, 0 AS age FROM {o} UNION ALL SELECT gregorian, original, position, summary, sources, 1 FROM {n}) GROUP BY gregorian, original""",
        o=old,
        n=new,
    )


def shared_turns(turns: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected, completed turns with a result, as text, match items or dated items by mode."""
    return query(
        """SELECT t.conv_id, t.turn, t.mode, CASE t.mode WHEN 'chat' THEN t.answer WHEN 'search' THEN array_join(t.items, '\n') ELSE array_join(transform(t.items, x -> concat('· ', x)), '\n') END AS shared
           FROM {t} t LEFT SEMI JOIN {s} s ON t.conv_id = s.conv_id AND array_contains(s.turns, t.turn) WHERE t.status = 'completed' AND (t.answer IS NOT NULL OR size(t.items) > 0)""",
        t=turns,
        s=selected,
    )
